"""Problem 10: per-document text statistics and how far they lie from natural prose.

Each document gets counts and ratios over its whole text. For every language, the mean and covariance of prose are
estimated robustly over all documents (a start from medians and quartiles, then concentration steps that re-estimate
from documents within the limit), and a document's squared Mahalanobis distance is split into the contributions of
its statistics. Outliers are named list, table or junk by the statistics that set them apart.

Defined results: null and blank texts have zero counts and are ``junk`` ("nothing to read"); rows with a null id are
left out; repeated rows count once. Languages with fewer than ``MIN_DOCUMENTS`` documents use the estimate over all.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.language import language
from larkspur.llm.text import lower
from larkspur.session import cut

STATISTICS = ("mean_word_length", "long_word_share", "symbol_ratio", "digit_ratio", "letter_ratio", "common_word_share", "words_per_sentence", "sentence_end_share", "line_end_share", "words_per_line", "short_line_share", "marker_share", "column_share", "repeat_share", "word_entropy")
COUNTS = ("n_words", "n_lines", "n_sentences")
#: Squared distance beyond which a document isn't prose: about the 0.9999 quantile of chi-square with 15 degrees.
LIMIT = 45.0
#: Documents within this squared distance take part in the next concentration step (about the 0.975 quantile).
INSIDE = 27.5
STEPS = 3
MIN_DOCUMENTS = 50
RIDGE = 0.15
#: What language() says of texts without a known language; they are measured against the estimate over all.
UNKNOWN = ("und", "other")
#: Share of function words from which a text reads as sentences.
READABLE = 0.22

_WORD = re.compile(r"[^\W_]+(?:[’'-][^\W_]+)*")
_SENTENCE = re.compile(r"[.!?।؟。！？]+[\"')\]»”’]*(?=\s|$)")
# Marks that end a line of prose, marks that may close after them, and plain punctuation.
ENDS = frozenset(".!?।؟。！？:")
CLOSERS = "\"')]»”’"
PLAIN = ".,;:!?'\"()-।،؟’"
_MARKER = re.compile(r"\s*(?:[-*•·+→‣▪◦–—>]|o(?=\s)|\[[ xX]?\]|\(?\d{1,3}[.):]|\(?[a-zA-Z][.)]|\(?[ivxIVX]{1,5}[.)])\s+\S")
#: Delimiters of columns: a string that a row holds, and the pattern that counts it where plain counting won't do.
_SPLITS = (("\t", None), ("|", None), (";", None), (",", re.compile(r",(?! )|, (?=[^ ]{0,25}(?:,|$))")), ("  ", re.compile(r"\s{2,}")), ("....", re.compile(r"\.{4,}")))
_CSV_QUOTED = re.compile(r'"[^"\n]*"')


@lru_cache(1)
def _character_classes() -> np.ndarray:
    """Per character code: 0 symbol, 1 letter, 2 digit, 3 combining mark, 4 plain punctuation, 5 blank, 6 other white space."""
    kind = np.zeros(0x110000, np.uint8)
    for code in range(0x20000):
        c = chr(code)
        kind[code] = 1 if c.isalpha() else 2 if c.isdigit() else 6 if c.isspace() else 3 if unicodedata.category(c)[0] == "M" else 0
    kind[0x20000:0x32000] = 1
    for c in PLAIN:
        kind[ord(c)] = 4
    kind[32] = 5
    return kind


def _columns(lines: list[str]) -> float:
    """Share of the lines that are rows of one table: as many columns (2 or more) as most others, by one delimiter."""
    if len(lines) < 2:
        return 0.0
    best = 0
    bare = [_CSV_QUOTED.sub("q", x) if '"' in x else x for x in lines]
    for delimiter, split in _SPLITS:
        counts = Counter(len(split.findall(x)) if split else x.count(delimiter) for x in bare if delimiter in x)
        counts.pop(0, None)
        if counts:
            n, rows = counts.most_common(1)[0]
            near = rows + (counts[n - 1] + counts[n + 1] if n > 2 else 0)
            best = max(best, near)
    return min(best, len(lines)) / len(lines)


def statistics(text: str | None) -> tuple[str, list[float], list[int]]:
    """(language, values in the order of STATISTICS, counts in the order of COUNTS)."""
    text = text or ""
    low = _WORD.findall(lower(text))
    often = Counter(low)
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    n_words, n_lines = len(low), len(lines)
    code, common = language(text, counts=often)
    n_sentences = len(_SENTENCE.findall(text))
    of = np.bincount(_character_classes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], minlength=7).tolist()
    n_chars = max(1, len(text) - of[5])
    triples = len(set(zip(low, low[1:], low[2:])))
    share = np.fromiter(often.values(), float, len(often)) / max(1, n_words)
    entropy = -float(share @ np.log2(share)) / log2(max(2, n_words))
    values = [
        sum(map(len, low)) / max(1, n_words),
        sum(map((20).__lt__, map(len, low))) / max(1, n_words),
        of[0] / n_chars,
        of[2] / n_chars,
        (of[1] + of[3]) / n_chars,
        common,
        log2(1 + n_words / max(1, n_sentences)),
        n_sentences / max(1, n_words),
        sum(x.rstrip().rstrip(CLOSERS)[-1:] in ENDS for x in lines) / max(1, n_lines),
        log2(1 + n_words / max(1, n_lines)),
        sum(len(x.split(None, 8)) <= 7 for x in lines) / max(1, n_lines),
        sum(_MARKER.match(x) is not None for x in lines) / max(1, n_lines),
        _columns(lines),
        1 - triples / max(1, n_words - 2) if n_words > 2 else 0.0,
        entropy,
    ]
    return code, values, [n_words, n_lines, n_sentences]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [statistics(t) for t in b["text"].to_pylist()]
        columns = [b["doc_id"], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
        columns += [pa.array([f[2][i] for f in found], pa.int64()) for i in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "language", "x", *COUNTS])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), float).reshape(-1, len(STATISTICS))


class Prose:
    """Per language (and "" for all) the mean and inverse covariance of prose."""

    def __init__(self, models: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.models = models

    def distances(self, languages: list[str], x: np.ndarray) -> np.ndarray:
        """Contribution of every statistic to the squared distance (rows x statistics); a row sums to its distance."""
        out = np.zeros_like(x)
        codes = np.array([c if c in self.models else "" for c in languages])
        for code in set(codes.tolist()):
            rows = codes == code
            mean, inverse = self.models[code]
            d = x[rows] - mean
            out[rows] = d * (d @ inverse)
        return out


def _moments(prose: Prose, inside: float):
    """Partial sums by language over documents within the limit: 1, x and x x', one row per number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            codes = b["language"].to_pylist()
            x = _matrix(b["x"])
            near = prose.distances(codes, x).sum(1) <= inside
            full = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            codes = np.array(codes)
            for code in set(codes[near].tolist()):
                own = full[near & (codes == code)]
                sums[code] = sums.get(code, 0) + own.T @ own
        for code, total in sums.items():
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array([code] * len(flat)), pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], ["language", "i", "v"])

    return run


def _models(rows: list, floor: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    p = len(STATISTICS) + 1
    totals: dict[str, np.ndarray] = {}
    for r in rows:
        totals.setdefault(r["language"], np.zeros(p * p))[r["i"]] = r["v"]
    if totals:
        totals[""] = sum(totals.values())
    out = {}
    for code, flat in totals.items():
        m = flat.reshape(p, p)
        n = m[0, 0]
        if code and (n < MIN_DOCUMENTS or code in UNKNOWN):
            continue
        mean = m[0, 1:] / n
        cov = m[1:, 1:] / n - np.outer(mean, mean)
        out[code] = mean, np.linalg.inv(cov + np.diag(floor**2))
    return out


def fit(measured: DataFrame) -> Prose:
    """Robust estimate over all documents. The driver receives one small matrix per language."""
    at = [F.col("x")[i] for i in range(len(STATISTICS))]
    quartiles = measured.where("n_words > 0").groupBy("language").agg(F.count("*").alias("n"), *(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"q{i}") for i, c in enumerate(at))).collect()
    if not quartiles:
        p = len(STATISTICS)
        return Prose({"": (np.zeros(p), np.eye(p))})
    # A floor for each deviation keeps statistics that hardly vary in clean prose from taking over.
    floor = RIDGE * np.array([1.0, 0.05, 0.1, 0.2, 0.2, 0.4, 2.0, 0.15, 1.0, 2.0, 0.6, 0.4, 0.6, 0.5, 0.3])
    start = {}
    for row in sorted(quartiles, key=lambda r: r["n"]):
        q = np.array([row[f"q{i}"] for i in range(len(STATISTICS))])
        model = q[:, 1], np.diag(1 / np.maximum((q[:, 2] - q[:, 0]) / 1.349, floor) ** 2)
        start[""] = model  # the largest language comes last and stands in for those without a model
        if row["n"] >= MIN_DOCUMENTS and row["language"] not in UNKNOWN:
            start[row["language"]] = model
    prose = Prose(start)
    for step in range(STEPS):
        rows = measured.where("n_words > 0").select("language", "x").mapInArrow(_moments(prose, INSIDE * (2 if step == 0 else 1)), "language string, i int, v double").groupBy("language", "i").agg(F.sum("v").alias("v")).collect()
        models = _models(rows, floor)
        if not models:
            break
        prose = Prose(models)
    return prose


def kind_of(code: str, x: np.ndarray, n_words: int, n_lines: int, distance: float, limit: float = LIMIT) -> str:
    """prose, list, table or junk: outliers are named by the statistics that set entries, rows and noise apart."""
    v = dict(zip(STATISTICS, x))
    if not n_words:
        return "junk"
    if distance <= limit:
        return "prose"
    if v["repeat_share"] > 0.7 and n_lines < 4 or v["long_word_share"] > 0.2:
        return "junk"
    rows = v["column_share"] >= 0.6 and n_lines >= 3 and v["line_end_share"] < 0.5
    entries = n_lines >= 3 and v["line_end_share"] < 0.35 and (v["marker_share"] >= 0.6 or v["short_line_share"] >= 0.7)
    worded = v["letter_ratio"] >= 0.5 and v["mean_word_length"] >= 2.5
    if rows and v["marker_share"] < 0.5 and v["symbol_ratio"] < 0.6:
        return "table"
    if entries and worded and (v["common_word_share"] < READABLE or not v["sentence_end_share"]):
        return "list"
    if code == "other":
        return "prose" if v["letter_ratio"] >= 0.7 else "junk"
    return "prose" if v["common_word_share"] >= READABLE and v["letter_ratio"] >= 0.7 and v["repeat_share"] <= 0.7 else "junk"


def _judge(prose: Prose, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["x"])
            parts = prose.distances(b["language"].to_pylist(), x)
            total = parts.sum(1)
            words, lines = b["n_words"].to_pylist(), b["n_lines"].to_pylist()
            codes = b["language"].to_pylist()
            kinds = [kind_of(codes[i], x[i], words[i], lines[i], total[i], limit) for i in range(len(x))]
            values = [pa.array(x[:, i]) for i in range(len(STATISTICS))]
            names = [f"{s}_part" for s in STATISTICS]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["language"], *(b[c] for c in COUNTS), *values, pa.array(total), *(pa.array(parts[:, i]) for i in range(len(names))), pa.array(kinds)], ["doc_id", "language", *COUNTS, *STATISTICS, "distance", *names, "kind"])

    return run


def quality(documents: DataFrame, limit: float = LIMIT) -> DataFrame:
    """``documents``: doc_id, text. Statistics, squared distance, each statistic's part in it (..._part) and kind."""
    kinds = "doc_id long, language string, x array<double>, " + ", ".join(f"{c} long" for c in COUNTS)
    measured = cut(documents.where(F.col("doc_id").isNotNull()).select("doc_id", "text").mapInArrow(_measure, kinds))
    prose = fit(measured)
    schema = "doc_id long, language string, " + ", ".join([*(f"{c} long" for c in COUNTS), *(f"{s} double" for s in STATISTICS), "distance double", *(f"{s}_part double" for s in STATISTICS), "kind string"])
    return measured.mapInArrow(_judge(prose, limit), schema)


def not_prose(documents: DataFrame, limit: float = LIMIT) -> DataFrame:
    """doc_id and kind of the documents that aren't natural prose."""
    return quality(documents, limit).where("kind <> 'prose'").select("doc_id", "kind").distinct()
