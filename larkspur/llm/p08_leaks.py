"""Problem 8: evaluation passages in corpus documents, by an FM-index per training shard.

A shard (a bounded block of documents inside one task) becomes one sequence of word numbers over the vocabulary of
the test passages; every other word and every document end is the separator 0, in which no phrase can match. Its
suffixes are sorted, the Burrows-Wheeler transform goes into a wavelet matrix, and all phrases of
``MIN_WORDS`` words search it backwards at once by ranks. Occurrences are located from sampled suffix positions and
merged into the spans to remove.

A word is a run of letters or digits in lower case. Defined results: null texts and ids, and cases with fewer than
``MIN_WORDS`` words, match nothing. Repeated rows count once. The test set is a stated query set: it is sent to the
tasks in blocks of at most ``BLOCK_WORDS`` words, so what a task holds doesn't grow with it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.text import WORD, lower

MIN_WORDS = 12
SHARD_WORDS = 400_000
BLOCK_WORDS = 400_000
SAMPLE = 8


def suffix_order(seq: np.ndarray) -> np.ndarray:
    """Suffix positions in lexicographic order: prefix doubling that goes on with unresolved suffixes only."""
    n = len(seq)
    order = np.argsort(seq, kind="stable")
    slots, key, reach = np.arange(n), seq[order].astype(np.int64), 1
    rank = np.empty(n, np.int64)
    while True:
        new = np.append(True, key[1:] != key[:-1])
        starts = np.flatnonzero(new)
        rank[order[slots]] = slots[starts][np.cumsum(new) - 1]
        sizes = np.diff(np.append(starts, len(slots)))
        slots = slots[np.repeat(sizes > 1, sizes)]
        if not len(slots):
            return order
        suffix = order[slots]
        tail = suffix + reach
        after = np.where(tail < n, rank[np.minimum(tail, n - 1)] + 1, 0)
        key = rank[suffix] * (n + 1) + after
        by = np.argsort(key)
        order[slots], key = suffix[by], key[by]
        reach *= 2


class WaveletMatrix:
    """Ranks over a sequence of small numbers: a bit array with cumulative counts for every bit."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        for b in range(bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            up = bit.astype(bool)
            seq = np.concatenate([seq[~up], seq[up]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        start, end = np.zeros(len(at), np.int64), at
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            up = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            s, e = ones[start], ones[end]
            start, end = np.where(up, zeros + s, start - s), np.where(up, zeros + e, end - e)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            one = ones[at + 1] - ones[at]
            value = value * 2 + one
            at = np.where(one == 1, zeros + ones[at], at - ones[at])
        return value


class FMIndex:
    """Index of a sequence of numbers below ``symbols`` (0 separates) that finds all places of many phrases at once."""

    def __init__(self, seq: np.ndarray, symbols: int):
        seq = np.append(seq.astype(np.int64) + 1, 0)  # a unique smallest end, which backward steps rely on
        symbols += 1
        order = suffix_order(seq)
        self.n = len(seq)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=symbols))])
        self.tree = WaveletMatrix(seq[order - 1].astype(np.int32), max(1, int(symbols - 1).bit_length()))
        sampled = order % SAMPLE == 0
        self.sampled, self.samples, self.sample_rank = sampled, order[sampled], np.cumsum(sampled) - sampled

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges [lo, hi) of the suffixes that begin with each phrase (rows of ``phrases``), by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        alive = np.arange(len(phrases))
        for step in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, step] + 1
            lo[alive] = self.first[c] + self.tree.rank(c, lo[alive])
            hi[alive] = self.first[c] + self.tree.rank(c, hi[alive])
            alive = alive[hi[alive] > lo[alive]]
        dead = np.ones(len(phrases), bool)
        dead[alive] = False
        hi[dead] = lo[dead]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places of the suffixes in the given rows: steps back to a sampled suffix each, all rows at once."""
        at, steps, place = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.sampled[at[open_]]
            done = open_[hit]
            place[done] = self.samples[self.sample_rank[at[done]]] + steps[done]
            open_ = open_[~hit]
            c = self.tree.access(at[open_])
            at[open_] = self.first[c] + self.tree.rank(c, at[open_])
            steps[open_] += 1
        return place


class TestSet:
    """Phrases of ``MIN_WORDS`` words of a block of test passages, as numbers over their own vocabulary."""

    __test__ = False

    def __init__(self, passages: list[tuple[str, str]], min_words: int):
        self.min_words, self.numbers = min_words, {}
        of: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for case, text in passages:
            words = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in WORD.findall(lower(text))]
            for i in range(len(words) - min_words + 1):
                of[tuple(words[i : i + min_words])].add(case)
        self.phrases = np.array(list(of), np.int64).reshape(-1, min_words)
        self.cases = [sorted(c) for c in of.values()]

    def sequence(self, text: str) -> np.ndarray:
        get = self.numbers.get
        words = WORD.findall(lower(text))
        return np.fromiter([get(w, 0) for w in words], np.int32, len(words))

    def shard(self, docs: list[np.ndarray]) -> Iterator[tuple[int, str, int]]:
        """(document, case, first word) of every phrase found in a shard of number sequences."""
        seq = np.concatenate([x for d in docs for x in (d, np.zeros(1, np.int32))])
        word_at = np.concatenate([np.arange(len(d) + 1) for d in docs])
        doc_at = np.repeat(np.arange(len(docs)), [len(d) + 1 for d in docs])
        # Runs of known words that are shorter than a phrase can't hold one; they and repeated separators go.
        stops = np.flatnonzero(seq == 0)
        length = np.diff(np.concatenate([[-1], stops])) - 1
        keep = np.repeat(length >= self.min_words, length + 1)
        seq, word_at, doc_at = seq[keep], word_at[keep], doc_at[keep]
        if not len(seq) or not len(self.phrases):
            return
        index = FMIndex(seq, len(self.numbers) + 1)
        lo, hi = index.search(self.phrases)
        found = np.flatnonzero(hi > lo)
        rows = np.concatenate([np.arange(lo[f], hi[f]) for f in found]) if len(found) else np.empty(0, np.int64)
        which = np.repeat(found, (hi - lo)[found])
        for place, phrase in zip(index.locate(rows), which):
            for case in self.cases[phrase]:
                yield int(doc_at[place]), case, int(word_at[place])


def merged(starts: list[int], width: int) -> list[tuple[int, int]]:
    """Spans of words, merged where they touch or overlap."""
    out: list[list[int]] = []
    for s in sorted(starts):
        if out and s <= out[-1][1]:
            out[-1][1] = s + width
        else:
            out.append([s, s + width])
    return [(a, b) for a, b in out]


def _search(passages: list[tuple[str, str]], min_words: int, shard_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = TestSet(passages, min_words)
        ids: list[int] = []
        texts: list[str] = []
        docs: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            by: dict[tuple[int, str], list[int]] = defaultdict(list)
            for doc, case, word in tests.shard(docs):
                by[doc, case].append(word)
            rows, spans = [], {}
            for (doc, case), starts in by.items():
                if doc not in spans:
                    spans[doc] = [m.span() for m in WORD.finditer(lower(texts[doc]))]
                for s, e in merged(starts, min_words):
                    rows.append((ids[doc], case, spans[doc][s][0] + 1, spans[doc][e - 1][1], e - s))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "case_id", "start_pos", "end_pos", "n_words"])

        for b in batches:
            for i, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                doc = tests.sequence(text)
                if len(doc) >= min_words:
                    ids.append(i), texts.append(text), docs.append(doc)
                    size += len(doc)
                if size >= shard_words:
                    yield flush()
                    ids, texts, docs, size = [], [], [], 0
        if docs:
            yield flush()

    return run


def _blocks(cases: DataFrame, block_words: int) -> Iterator[list[tuple[str, str]]]:
    """The test passages in blocks of a bounded size, read one partition at a time."""
    rows = cases.where(F.col("id").isNotNull()).select("id", F.explode(F.array("input", "expected_output")).alias("text")).where(F.col("text").isNotNull()).distinct()
    block, size = [], 0
    for row in rows.toLocalIterator():
        block.append((row["id"], row["text"]))
        size += row["text"].count(" ") + 1
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_spans(documents: DataFrame, cases: DataFrame, min_words: int = MIN_WORDS, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Removal spans: doc_id, case_id, start_pos and end_pos (characters, from 1, both included), n_words.

    ``documents``: doc_id, text; ``cases``: id, input, expected_output. No shuffle: a task indexes its own documents.
    """
    docs = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    schema = "doc_id long, case_id string, start_pos long, end_pos long, n_words long"
    out = None
    for block in _blocks(cases, block_words):
        part = docs.mapInArrow(_search(block, min_words, shard_words), schema)
        out = part if out is None else out.unionByName(part)
    return (docs.sparkSession.createDataFrame([], schema) if out is None else out).distinct()


def leaks(documents: DataFrame, cases: DataFrame, **settings) -> DataFrame:
    """doc_id and case_id of every document that shares a run of words with a case."""
    return leaked_spans(documents, cases, **settings).select("doc_id", "case_id").distinct()
