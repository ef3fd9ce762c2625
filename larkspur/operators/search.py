"""Hybrid retrieval for batches of questions: BM25, vector search, fusion, reranking and the relevance gate.

Every search filters by role before it ranks. Questions are a stated set that meets all permitted rows, in blocks of
a fixed number: a task scores its own rows against a block and passes on its best rows, so neither postings nor
vectors are shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import scores, text as T
from larkspur.session import cut

K1, B = 1.2, 0.75
RRF = 60
CONTENT_WEIGHT, NAME_WEIGHT, TYPE_WEIGHT = 4.0, 2.0, 1.0
CANDIDATES = 50
TOP = 5
THRESHOLD = 0.5
#: Scores are rounded to so many digits before they are ranked, so that ties don't hang on the order of summation.
DIGITS = 9


@dataclass
class Index:
    """Tokenised rows, stored once for any number of questions, with the size and average length of all of them.

    Rows stay together (an index by documents, not by terms): a task scores its own rows for a block of questions and
    passes on the best of them, so no posting ever travels, however frequent its term.
    """

    rows: DataFrame
    n: int
    average: float


def index(docs: DataFrame, content: str = "content") -> Index:
    """``docs``: chunk_id, ``content``, allowed_role, file_name, file_type. The one pass over the texts; null contents don't
    count in the statistics."""
    tokens = docs.select(F.col("chunk_id").cast("string").alias("chunk_id"), "allowed_role", "file_name", "file_type", F.coalesce(F.col(content).rlike(r"\S"), F.lit(False)).alias("readable"), T.tokens(content).alias("t"))
    stored = cut(tokens.withColumn("length", F.size("t")))
    n, average = stored.agg(F.count("t"), F.avg("length")).first()
    return Index(stored, n, float(average or 0.0))


def _only(terms: list[str]) -> Column:
    """The tokens ``t`` that are among the terms: a hashed look-up in the JVM. Terms are letters and digits, so they need no
    quoting; as one expression they are one message to the JVM, not one each."""
    return F.expr("filter(t, x -> x in ({}))".format(", ".join(f"'{t}'" for t in terms)))


def _weights(stored: Index, terms: list[str]) -> dict[str, float]:
    """Inverse document frequency of the terms that occur; one partially aggregated row a term of a block of questions."""
    if not terms:
        return {}
    seen = stored.rows.select(F.explode(F.array_distinct(_only(terms))).alias("term")).groupBy("term").count().collect()
    return {r["term"]: float(np.log(1 + (stored.n - r["count"] + 0.5) / (r["count"] + 0.5))) for r in seen}


class _Best:
    """The best ``top`` permitted rows of a task for each of a block of questions."""

    def __init__(self, ids: list[str], roles: list[list[str]], top: int):
        self.ids, self.roles, self.top = ids, [frozenset(r) for r in roles], top
        self.best: list[list[tuple[float, str]]] = [[] for _ in ids]

    def add(self, scored: np.ndarray, chunk: list[str], role: list[str], usable: np.ndarray) -> None:
        codes = {r: i for i, r in enumerate(dict.fromkeys(role))}
        code = np.array([codes[r] for r in role])
        for q, allowed in enumerate(self.roles):
            at = np.flatnonzero(np.isin(code, [codes[r] for r in allowed if r in codes]) & usable[:, q])
            if len(at) > self.top:
                least = np.partition(scored[at, q], -self.top)[-self.top]
                at = at[scored[at, q] >= least - 10.0**-DIGITS]
            self.best[q] = sorted([*self.best[q], *((-round(float(scored[i, q]), DIGITS), chunk[i]) for i in at)])[: self.top]

    def rows(self, score: str) -> pa.RecordBatch:
        rows = [(self.ids[q], c, -s) for q, hits in enumerate(self.best) for s, c in hits]
        columns = list(zip(*rows)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.float64()))], ["query_id", "chunk_id", score])


def _blocks(queries: DataFrame, size: int) -> Iterator[list]:
    """A stated question set in blocks of a fixed number, one partition at a time."""
    part: list = []
    for r in queries.toLocalIterator():
        part.append(r)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part


def _block_bm25(block: list, idf: dict[str, float], average: float, k1: float, b: float, top: int):
    terms = sorted(idf)
    place = {t: i for i, t in enumerate(terms)}
    asked = np.zeros((len(terms), len(block)))
    for q, r in enumerate(block):
        for t in r["terms"]:
            if t in place:
                asked[place[t], q] += idf[t]
    ids, roles = [str(r["query_id"]) for r in block], [r["roles"] for r in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, known = _Best(ids, roles, top), pa.array(terms, pa.string())
        step = max(1, (1 << 22) // len(terms))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                n, sizes = part.num_rows, np.asarray(pc.list_value_length(part["t"]), np.int64)
                # Every token in these lists is a term of the block.
                cell = np.repeat(np.arange(n), sizes) * len(terms) + np.asarray(pc.index_in(part["t"].flatten(), known), np.int64)
                tf = np.bincount(cell, minlength=n * len(terms)).reshape(n, len(terms)).astype(float)
                length = np.asarray(part["length"], float)[:, None]
                scored = (tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / max(average, 1e-300)))) @ asked
                best.add(CONTENT_WEIGHT * scored, part["chunk_id"].to_pylist(), part["allowed_role"].to_pylist(), scored > 0)
        yield best.rows("score")

    return run


def content_bm25(stored: Index, queries: DataFrame, top: int, k1: float = K1, b: float = B, block: int = 256) -> DataFrame:
    """query_id, chunk_id, score: the weighted BM25 of the content, the best ``top`` permitted rows of each task.

    Statistics cover all rows, whoever may read them. Questions go to the tasks in blocks of a fixed number; only the
    questions' terms leave the JVM.
    """
    schema, out = "query_id string, chunk_id string, score double", None
    for part in _blocks(queries.select("query_id", "roles", T.tokens("query").alias("terms")), block):
        idf = _weights(stored, sorted({t for r in part for t in r["terms"]}))
        if not idf:
            continue
        roles = sorted({x for r in part for x in r["roles"]})
        rows = stored.rows.where(F.col("allowed_role").isin(roles) & F.col("readable")).select("chunk_id", "allowed_role", _only(list(idf)).alias("t"), "length").where(F.size("t") > 0)
        found = rows.mapInArrow(_block_bm25(part, idf, stored.average, k1, b, top), schema)
        out = found if out is None else out.unionByName(found)
    return stored.rows.sparkSession.createDataFrame([], schema) if out is None else out


def bm25(docs: DataFrame, queries: DataFrame, top: int = CANDIDATES, stored: Index | None = None) -> DataFrame:
    """``docs``: chunk_id, content, file_name, file_type, allowed_role; ``queries``: query_id, query, roles.

    Best field per row: the content's BM25 times 4, file name (times 2) and file type, which match as whole values only
    and then score their inverse document frequency. Returns query_id, chunk_id, bm25_score, bm25_rank of the permitted
    rows with readable content; ties go to the smaller id. Questions without roles or words find nothing. ``stored``: the
    index of the contents, if the caller has one.
    """
    asked = queries.where((F.size("roles") > 0) & (F.trim("query") != ""))
    stored = stored or index(docs)
    found = content_bm25(stored, asked, top)
    permitted = asked.select("query_id", "query", F.explode("roles").alias("allowed_role")).distinct()
    for field, weight in (("file_name", NAME_WEIGHT), ("file_type", TYPE_WEIGHT)):
        values = stored.rows.groupBy(F.col(field).alias("query")).agg(F.count("*").alias("df"))
        named = values.join(permitted.select("query").distinct(), "query")
        size = F.lit(stored.rows.where(F.col(field).isNotNull()).count())
        idf = F.lit(weight) * F.log(1 + (size - F.col("df") + 0.5) / (F.col("df") + 0.5))
        rows = permitted.join(named.select("query", idf.alias("score")), "query").join(stored.rows.where("readable").select("chunk_id", F.col(field).alias("query"), "allowed_role"), ["query", "allowed_role"])
        found = found.unionByName(rows.select("query_id", "chunk_id", "score"))
    best = found.groupBy("query_id", "chunk_id").agg(F.round(F.max("score"), DIGITS).alias("bm25_score"))
    return _ranked(best, "bm25_score", "bm25_rank", top).select("query_id", "chunk_id", "bm25_score", "bm25_rank")


def _ranked(rows: DataFrame, score: str, rank: str, top: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return rows.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= top)


def _block_cosines(block: list, matrix: np.ndarray, top: int):
    ids, roles = [str(r["query_id"]) for r in block], [r["roles"] for r in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(ids, roles, top)
        for b in batches:
            v = np.asarray(b["v"].flatten(), np.float64).reshape(-1, matrix.shape[1])
            size = np.sqrt((v * v).sum(1))
            size[size == 0] = np.nan
            cos = (v / size[:, None]) @ matrix.T
            best.add(cos, b["chunk_id"].to_pylist(), b["allowed_role"].to_pylist(), ~np.isnan(cos))
        yield best.rows("ann_score")

    return run


def knn(docs: DataFrame, queries: DataFrame, top: int = CANDIDATES, block: int = 256) -> DataFrame:
    """Exact vector search. ``docs``: chunk_id, v, allowed_role; ``queries``: query_id, v, roles.

    Questions go to the tasks in blocks of a fixed number, as matrices; every task keeps its best ``top`` per question,
    so the shuffle carries (tasks x questions x top) rows. Rows and questions without a usable vector take no part.
    Returns query_id, chunk_id, ann_score, ann_rank; ties go to the smaller id.
    """
    usable_q = (F.size("roles") > 0) & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x)) & F.exists("v", lambda x: x != 0)
    schema, out = "query_id string, chunk_id string, ann_score double", None
    for part in _blocks(queries.where(usable_q).select("query_id", "v", "roles"), block):
        matrix = np.array([r["v"] for r in part], float)
        matrix /= np.sqrt((matrix * matrix).sum(1))[:, None]
        roles = sorted({x for r in part for x in r["roles"]})
        rows = docs.where(F.col("allowed_role").isin(roles) & (F.size("v") == matrix.shape[1])).where(~F.exists("v", lambda x: x.isNull() | F.isnan(x)))
        found = rows.select(F.col("chunk_id").cast("string").alias("chunk_id"), "v", "allowed_role").mapInArrow(_block_cosines(part, matrix, top), schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return _ranked(out, "ann_score", "ann_rank", top)


def rrf(first: DataFrame, second: DataFrame, constant: int = RRF, top: int | None = None) -> DataFrame:
    """Reciprocal-rank fusion of two lists (query_id, chunk_id, bm25_rank / ann_rank): a full outer join.

    Ties go by the first list's rank, then the second's, then the id. Returns both ranks, rrf_score and rrf_rank.
    """
    both = first.join(second, ["query_id", "chunk_id"], "full_outer")
    one = lambda r: F.when(F.col(r).isNotNull(), 1.0 / (constant + F.col(r))).otherwise(0.0)
    fused = both.withColumn("rrf_score", F.round(one("bm25_rank") + one("ann_rank"), 12))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf_score"), F.asc_nulls_last("bm25_rank"), F.asc_nulls_last("ann_rank"), "chunk_id")
    ranked = fused.withColumn("rrf_rank", F.row_number().over(w))
    return ranked if top is None else ranked.where(F.col("rrf_rank") <= top)


class Overlap:
    """Deterministic stand-in for a cross-encoder: the share of the question's words in the content, as a logit.

    ``prepare`` is what a scorer does once for each content, before it meets its questions.
    """

    @staticmethod
    def prepare(content: Column) -> Column:
        return F.array_distinct(T.tokens(content))

    def __call__(self, query: Column, prepared: Column) -> Column:
        asked = F.array_distinct(T.tokens(query))
        return 8.0 * (F.size(F.array_intersect(asked, prepared)) / F.greatest(F.size(asked), F.lit(1))) - 4.0


overlap_logit = Overlap()


def model_logit(scorer: Callable[[list[tuple[str, str]]], list[float]], batch: int = 16) -> Callable[[Column, Column], Column]:
    """Wraps a pair scorer (list of pairs in, list of scores out) as a column function that runs in batches."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, c in parts:
            pairs, out = list(zip(q, c)), []
            for i in range(0, len(pairs), batch):
                got = list(scorer(pairs[i : i + batch]))
                if len(got) != len(pairs[i : i + batch]):
                    raise ValueError("the scorer must return one score for each pair")
                out += got
            yield pd.Series(out, dtype=float)

    return run


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, logit: Callable[[Column, Column], Column] = overlap_logit, top: int = TOP) -> DataFrame:
    """Candidates (query_id, chunk_id, rrf_rank) with relevance_score, the best ``top`` per question; ties keep fusion order."""
    if top < 1:
        raise ValueError("top must be at least 1")
    candidates = cut(candidates)  # read twice
    prepare = getattr(logit, "prepare", lambda content: content)
    needed = docs.select("chunk_id", "content").join(candidates.select("chunk_id").distinct(), "chunk_id", "left_semi")
    texts = candidates.join(needed.select("chunk_id", "content", prepare(F.col("content")).alias("_prepared")), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    scored = texts.withColumn("relevance_score", scores.sigmoid(logit(F.col("query"), F.col("_prepared")))).drop("_prepared")
    w = Window.partitionBy("query_id").orderBy(F.desc("relevance_score"), "rrf_rank")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def gate(ranked: DataFrame, threshold: float = THRESHOLD, score: str = "relevance_score") -> DataFrame:
    """All rows of the questions whose best score reaches the threshold, none of the others."""
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold must be in [0, 1]")
    best = F.max(score).over(Window.partitionBy("query_id"))
    return ranked.withColumn("best_score", best).where(F.col("best_score") >= threshold)


def hybrid(docs: DataFrame, vectors: DataFrame, queries: DataFrame, top: int | None = TOP, candidates: int = CANDIDATES, stored: Index | None = None) -> DataFrame:
    """BM25 and vector search, fused; the first ``top`` per question (all of them if that is None)."""
    return rrf(bm25(docs, queries, candidates, stored), knn(vectors, queries, candidates).select("query_id", "chunk_id", "ann_score", "ann_rank"), top=top)


def context(ranked: DataFrame, file_name: str = "file_name") -> DataFrame:
    """Context of each question: its readable chunks in rank order under source lines. The numbers count all its chunks."""
    w = Window.partitionBy("query_id").orderBy("rank")
    numbered = ranked.withColumn("i", F.row_number().over(w)).where(F.col("content").rlike(r"\S"))
    filled = lambda c, other: F.coalesce(F.when(F.col(c).cast("string") != "", F.col(c).cast("string")), other)
    name, chunk = filled(file_name, F.lit("Unknown document")), filled("chunk_id", F.concat(F.lit("chunk-"), F.col("i").cast("string")))
    head = F.concat(F.lit("[Source "), F.col("i").cast("string"), F.lit(": "), name, F.lit("; chunk "), chunk, F.lit("]\n"))
    block = numbered.withColumn("block", F.concat(head, T.strip("content")))
    return block.groupBy("query_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("i", "block"))), lambda s: s["block"])).alias("context"))
