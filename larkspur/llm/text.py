"""Small helpers on text that several problems share."""

from __future__ import annotations

import re

#: A word: a run of letters or digits.
WORD = re.compile(r"[^\W_]+")


def lower(text: str) -> str:
    """Lower case without a change of length, so that positions stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower()[0] for c in text)


def words(text: str) -> list[str]:
    return WORD.findall(lower(text))
