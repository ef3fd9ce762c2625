"""Slots for models, with deterministic stand-ins for use without any.

A slot is a column function. The stand-ins are labelled as such: they keep shapes, validation and fallbacks testable,
not quality. Real models are plugged in as pandas functions that load once per worker and run in batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH = 32


def _check(vectors: list, n: int, dims: int) -> list:
    if len(vectors) != n or any(len(v) != dims for v in vectors):
        raise ValueError(f"the model must return one vector of {dims} numbers for each text")
    return vectors


def embedder(model: Callable[[list[str]], list] | None = None, dims: int = 64, batch: int = BATCH) -> Callable[[Column], Column]:
    """Embedding slot: texts in, arrays of ``dims`` floats out, in batches; null texts give null."""
    model = model or (lambda texts: [hashed_vector(t, dims) for t in texts])

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list = [None] * len(s)
            at = [i for i, t in enumerate(s) if t is not None]
            for k in range(0, len(at), batch):
                some = at[k : k + batch]
                for i, v in zip(some, _check(list(model([s.iloc[i] for i in some])), len(some), dims)):
                    out[i] = np.asarray(v, np.float32)
            yield pd.Series(out)

    return run


def hashed_vector(text: str, dims: int) -> np.ndarray:
    """Stand-in embedding: signed hashing of lower-case words, scaled to length 1."""
    v = np.zeros(dims)
    for w in text.lower().split():
        h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
        v[h % dims] += 1 if h >> 63 else -1
    size = np.linalg.norm(v)
    return v / size if size else v


def text_model(model: Callable[[list[str]], list[str]] | None = None, batch: int = BATCH) -> Callable[[Column], Column]:
    """Text slot: prompts in, answers out; an error or no model gives the empty string."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out: list[str] = []
            for k in range(0, len(s), batch):
                some = list(s.iloc[k : k + batch])
                try:
                    out += list(model(some)) if model else [""] * len(some)
                except Exception:
                    out += [""] * len(some)
            yield pd.Series(out, dtype=object)

    return run


def vision(model: Callable[[bytes, str], str]) -> Callable[[bytes, str], str]:
    """Image slot for the readers of files: a picture and the text before it in, a transcription marked as such out; an
    error or nothing gives the empty string."""

    def run(picture: bytes, before: str) -> str:
        try:
            told = (model(picture, before) or "").strip()
        except Exception:
            return ""
        return f"\n[IMAGE ANALYSIS: {told}]\n" if told else ""

    return run
