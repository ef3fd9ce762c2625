"""Problem 1: splitting oversized texts at natural boundaries, with an overlap.

Every position of a text gets a boundary strength (paragraph, sentence, line, clause and word ends; 0 elsewhere). A
sparse table answers range-maximum queries over strength, so each piece is cut at the strongest boundary of the
window of permissible lengths, the rightmost on ties; the next piece starts ``overlap`` characters before the cut.

Defined results: a null limit counts as 1000, a null overlap as 0; an overlap that is negative counts as 0 and one
of at least the limit as a tenth of it. A limit below 1 can't hold a character and is an error. Texts that are null
or within the limit have no pieces. Pieces joined without their overlaps give the text back, character by character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_LIMIT = 1000
#: Strengths of boundaries, from the end of a word to the end of a paragraph.
WORD, CLAUSE, LINE, SENTENCE, PARAGRAPH = 1, 2, 3, 4, 5
# Characters that end sentences and clauses.
SENTENCE_ENDS = ".!?।؟。！？…"
CLAUSE_ENDS = ",;:،؛，；："
CLOSERS = "\"')]}»”’"
#: Least share of a piece that a cut may leave, unless the window has no boundary.
LEAST_FILL = 0.5


@lru_cache(1)
def _classes() -> np.ndarray:
    """Per character code: 1 white space, 2 line end, 3 sentence end, 4 clause end, 5 closing mark."""
    kind = np.zeros(0x110000, np.int8)
    for code in range(0x3001):
        if chr(code).isspace():
            kind[code] = 1
    for chars, value in (("\n\r  \x0b\x0c\x85", 2), (SENTENCE_ENDS, 3), (CLAUSE_ENDS, 4), (CLOSERS, 5)):
        for c in chars:
            kind[ord(c)] = value
    return kind


def boundary_strengths(text: str) -> np.ndarray:
    """Strength of a cut after each character: white space belongs to the piece that it ends."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = _classes()[codes]
    n = len(kind)
    strength = np.zeros(n, np.int8)
    space = (kind == 1) | (kind == 2)
    following_space = np.append(space[1:], True)
    end = space & ~np.append(space[1:], False)  # last character of a run of white space
    if n:
        strength[-1] = PARAGRAPH
    at = np.flatnonzero(end)
    if len(at):
        index = np.arange(n)
        before = np.maximum.accumulate(np.where(space, -1, index))[at]  # last character that is no white space
        plain = np.maximum.accumulate(np.where(space | (kind == 5), -1, index))[at]  # ... nor a closing mark
        last = np.where(plain >= 0, kind[np.maximum(plain, 0)], 0)
        close = (plain >= 0) & (before - plain <= 2)
        lines = np.cumsum((kind == 2) & ~((codes == 10) & np.append(False, codes[:-1] == 13)))
        breaks = lines[at] - np.where(before >= 0, lines[np.maximum(before, 0)], 0)
        strength[at] = np.select([breaks >= 2, close & (last == 3), breaks == 1, close & (last == 4)], [PARAGRAPH, SENTENCE, LINE, CLAUSE], WORD)
    wide = np.isin(codes, np.array([ord(c) for c in "。！？"], np.uint32)) & ~following_space
    strength[wide] = SENTENCE
    return strength


class StrongestCut:
    """Range maxima of (strength, position) by a sparse table: the strongest boundary, the rightmost on ties."""

    def __init__(self, strength: np.ndarray, widest: int):
        keys = strength.astype(np.int64) * (len(strength) + 1) + np.arange(len(strength))
        self.base, self.levels = len(strength) + 1, [keys]
        while (1 << len(self.levels)) <= min(widest, len(keys)):
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.maximum(last[: len(last) - step], last[step:]))

    def __call__(self, lo: int, hi: int) -> tuple[int, int]:
        """(position, strength) of the best cut at lo..hi, both included."""
        k = (hi - lo + 1).bit_length() - 1
        best = int(max(self.levels[k][lo], self.levels[k][hi - (1 << k) + 1]))
        return best % self.base, best // self.base


def pieces(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Spans [start, end) of the pieces of a text that is longer than ``limit``."""
    if limit < 1:
        raise ValueError("the limit must be at least 1")
    overlap = max(0, overlap)
    if overlap >= limit:
        overlap = limit // 10
    n, spans, start, done = len(text), [], 0, 0
    strongest = StrongestCut(boundary_strengths(text), limit)
    while True:
        if n - start <= limit:
            spans.append((start, n))
            return spans
        hi = start + limit - 1
        lo = max(start + int(limit * LEAST_FILL), done)  # every piece brings new characters
        cut, strength = strongest(min(lo, hi), hi)
        if not strength and lo > done:
            cut, strength = strongest(done, hi)
        end = cut + 1 if strength else hi + 1
        spans.append((start, end))
        start, done = max(end - overlap, 0), end


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["run_id", "item_no", "piece_no", "start_pos", "n_chars", "overlap_chars", "piece"]
    for b in batches:
        for run, item, text, limit, overlap in zip(*(b[c].to_pylist() for c in ("run_id", "item_no", "text", "max_chars", "overlap"))):
            spans = pieces(text, limit, overlap)
            n = len(spans)
            shared = [0, *(spans[i][1] - spans[i + 1][0] for i in range(n - 1))]
            yield pa.RecordBatch.from_arrays([pa.array([run] * n, pa.string()), pa.array([item] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([s + 1 for s, _ in spans], pa.int64()), pa.array([e - s for s, e in spans], pa.int64()), pa.array(shared, pa.int64()), pa.array([text[s:e] for s, e in spans], pa.string())], names)


def items(runs: DataFrame) -> DataFrame:
    """run_id, item_no, text, max_chars, overlap: extracted_text as item 0, the stored chunks from 1 on."""
    texts = F.concat(F.array("extracted_text"), F.coalesce("chunks.content", F.array().cast("array<string>")))
    limit = F.coalesce("chunking_config.max_chars", F.lit(DEFAULT_LIMIT)).alias("max_chars")
    overlap = F.coalesce("chunking_config.overlap", F.lit(0)).alias("overlap")
    return runs.select("run_id", limit, overlap, F.posexplode(texts).alias("item_no", "text")).withColumn("item_no", F.col("item_no").cast("long"))


def split_oversized(rows: DataFrame) -> DataFrame:
    """``rows``: run_id, item_no, text, max_chars, overlap. Returns the pieces of the texts beyond their limit.

    Columns: run_id, item_no, piece_no, start_pos (from 1), n_chars, overlap_chars (shared with the piece before), piece.
    No shuffle: the limit is tested in the JVM and only oversized texts reach Python.
    """
    over = rows.where(F.length("text") > F.col("max_chars")).select("run_id", "item_no", "text", "max_chars", "overlap")
    return over.mapInArrow(_split, "run_id string, item_no long, piece_no long, start_pos long, n_chars long, overlap_chars long, piece string")


def oversized(rows: DataFrame) -> DataFrame:
    """run_id and item_no of every text that had to be split."""
    return split_oversized(rows).select("run_id", "item_no").distinct()
