"""Personal data with a fixed form, replaced by typed placeholders before a text goes to a model.

Patterns only, all inside the JVM. Names and places need a named-entity model, which is a slot (``redact(c, names)``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import AADHAAR, PAN

# What is replaced, in this order, by its name in angle brackets.
PATTERNS = (
    ("EMAIL_ADDRESS", r"\b[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}\b"),
    ("URL", r"\b(?:https?://|www\.)[^\s<>]*[^\s<>.,;:!?)\]]"),
    ("IBAN_CODE", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("CREDIT_CARD", r"\b(?:4\d{3}|5[0-5]\d{2}|6\d{3}|1\d{3}|3\d{3})[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b|\b3[47]\d{2}[- ]?\d{6}[- ]?\d{5}\b"),
    ("IN_AADHAAR", AADHAAR),
    ("IN_PAN", PAN),
    ("US_SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    ("IP_ADDRESS", r"\b(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)\b"),
    ("PHONE_NUMBER", r"(?<![\w+])(?:\+\d{1,3}(?:[ -]?\(?\d{2,5}\)?){2,4}|\d{5}[ -]\d{5}|(?:\(\d{2,5}\)[ -]?)?\d{3,5}[ -]?\d{3}[ -]?\d{3,4})(?!\w)"),
)
PLACEHOLDER = "<(?:" + "|".join(name for name, _ in PATTERNS) + ")>"


def redact(c: Column | str, names: Callable[[Column], Column] | None = None) -> Column:
    """The text with placeholders. ``names`` redacts what has no fixed form, by a model; an error there fails the query."""
    text = F.col(c) if isinstance(c, str) else c
    for name, pattern in PATTERNS:
        text = F.regexp_replace(text, pattern, f"<{name}>")
    return text if names is None else names(text)
