"""Problem 9: mixing sources to target weights by fitting a subset of documents to each token budget.

Documents are counted by exact token length, per source. A source's budget is first met by whole repeats of the
source; the rest is a subset of its documents: most of it in proportion to the lengths' counts, the last few
documents by a bounded-knapsack dynamic programme over the remaining budget. Which documents of a length are taken
is decided by a seeded hash.

Defined results: sources without a target, targets without documents, with a null or non-positive weight or with
``max_repeats`` below 1 contribute nothing (a null ``max_repeats`` counts as 1); rows with a null id or null text
are left out; repeated rows count once; several targets of one source count as one with the summed weight and the
largest cap. A source that can't reach its share gives all that its cap allows, and the others share the rest by
their weights.
"""

from __future__ import annotations

import base64
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.session import cut

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The pattern that splits text before merges, as published with the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 17
#: Documents of one source and length that one task ranks at most, about.
GROUP_ROWS = 100_000


@lru_cache(2)
def _encoding(ranks: str, pattern: str):
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def _counted(ranks: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            encoding = _encoding(ranks, pattern)
            sizes = [len(encoding.encode_ordinary(t)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array(sizes, pa.int64())], ["doc_id", "source", "n_tokens"])

    return run


def token_counts(documents: DataFrame, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source, n_tokens of every document."""
    rows = documents.where(F.col("doc_id").isNotNull() & F.col("source").isNotNull() & F.col("text").isNotNull())
    return rows.select("doc_id", "source", "text").mapInArrow(_counted(ranks, pattern), "doc_id long, source string, n_tokens long").groupBy("doc_id").agg(F.min_by("source", F.struct("source", "n_tokens")).alias("source"), F.min_by("n_tokens", F.struct("source", "n_tokens")).alias("n_tokens"))


def budgets(tokens: dict[str, int], targets: dict[str, tuple[float, int]], total: int) -> dict[str, int]:
    """Tokens for each source: shares by weight, no more than the cap allows; what capped sources lack goes to the others."""
    left = {s: w for s, (w, _) in targets.items() if w and w > 0 and tokens.get(s, 0) > 0 and targets[s][1] >= 1}
    out: dict[str, int] = {}
    rest = float(total)
    while left:
        weight = sum(left.values())
        full = [s for s, w in left.items() if rest * w / weight >= tokens[s] * targets[s][1]]
        if not full:
            return out | {s: round(rest * w / weight) for s, w in left.items()}
        for s in full:
            out[s] = tokens[s] * targets[s][1]
            rest -= out[s]
            del left[s]
    return out


def fit(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take, each at most once, so that their sum comes as near to the budget as
    possible without exceeding it by the dynamic programme's reach.

    The bulk is taken in proportion to the counts; the programme then finds, over what is left of every length, the
    largest reachable sum within the remaining budget.
    """
    lengths = {k: n for k, n in lengths.items() if k > 0 and n > 0}
    total = sum(k * n for k, n in lengths.items())
    if budget >= total:
        return dict(lengths)
    if budget <= 0 or not lengths:
        return {}
    reach = min(budget, 4 * max(lengths))
    share = max(0.0, (budget - reach) / total)
    taken = {k: int(n * share) for k, n in lengths.items()}
    left = budget - sum(k * n for k, n in taken.items())
    # Rounding down leaves up to one document of each length; the most common lengths give theirs until the programme can take over.
    for k in sorted(lengths, key=lambda k: (-lengths[k], k)):
        while left - k >= reach and taken[k] < lengths[k] and taken[k] < lengths[k] * share + 1:
            taken[k] += 1
            left -= k
    for k in sorted(lengths, reverse=True):
        while left > 2 * reach and taken[k] < lengths[k]:
            step = min(lengths[k] - taken[k], max(1, (left - 2 * reach) // k))
            taken[k] += step
            left -= k * step
    by = np.full(left + 1, -1, np.int32)  # the item by which a sum was first reached
    reached = np.zeros(left + 1, bool)
    reached[0] = True
    items: list[tuple[int, int]] = []
    for k in sorted(lengths, reverse=True):
        spare, part = min(lengths[k] - taken[k], left // k), 1
        while spare > 0:  # binary parts make any count up to ``spare``
            n = min(part, spare)
            new = np.zeros(left + 1, bool)
            if k * n <= left:
                new[k * n :] = reached[: left + 1 - k * n]
                new &= ~reached
                by[new] = len(items)
                reached |= new
                items.append((k, n))
            spare -= n
            part *= 2
        if reached[left]:
            break
    at = int(np.flatnonzero(reached)[-1])
    while at:
        k, n = items[by[at]]
        taken[k] += n
        at -= k * n
    return {k: n for k, n in taken.items() if n}


def plan(histogram: dict[str, dict[int, int]], targets: dict[str, tuple[float, int]], total: int) -> tuple[dict[str, int], dict[str, dict[int, int]]]:
    """(whole repeats of each source, documents of each length to take once more)."""
    tokens = {s: sum(k * n for k, n in h.items()) for s, h in histogram.items()}
    repeats, extra = {}, {}
    for s, b in budgets(tokens, targets, total).items():
        repeats[s] = min(b // tokens[s], targets[s][1])
        extra[s] = fit(histogram[s], b - repeats[s] * tokens[s]) if repeats[s] < targets[s][1] else {}
    return repeats, extra


def wanted(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Weight and cap of each named source (one row per source on the driver)."""
    rows = targets.where(F.col("source").isNotNull()).select("source", F.coalesce("target_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("m")).distinct().groupBy("source").agg(F.sum("w").alias("w"), F.max("m").alias("m")).collect()
    return {r["source"]: (float(r["w"]), int(r["m"])) for r in rows}


def mix(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = SEED, ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source, n_tokens, times (1 to max_repeats) of the documents of the mix.

    ``total_tokens``: size of the mix; by default as much as the named sources hold. The driver gets the counts by exact
    length of the named sources, not their documents. A group of one source and length is ranked in salted parts.
    """
    goals = wanted(targets)
    counted = cut(token_counts(documents.where(F.col("source").isin(list(goals))), ranks, pattern))
    parts = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 20))
    histogram: dict[str, dict[int, int]] = defaultdict(dict)
    for r in counted.groupBy("source", "n_tokens").count().collect():
        histogram[r["source"]][r["n_tokens"]] = r["count"]
    total = total_tokens if total_tokens is not None else sum(k * n for h in histogram.values() for k, n in h.items())
    repeats, extra = plan(histogram, goals, total)
    spark = documents.sparkSession
    rows = [(s, k, int(repeats[s]), int(extra[s].get(k, 0)), 1 + n // GROUP_ROWS) for s in repeats for k, n in histogram[s].items()]
    takes = spark.createDataFrame(rows or [], "source string, n_tokens long, repeats long, extra long, salts long")
    dealt = counted.join(takes, ["source", "n_tokens"]).withColumn("part", F.pmod(parts, F.col("salts")))
    key = ["source", "n_tokens", "part"]
    before = dealt.groupBy(*key).agg(F.count("*").alias("n"))
    before = before.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("source", "n_tokens").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    ranked = dealt.withColumn("place", place).join(before, key)
    times = F.col("repeats") + F.when(F.col("place") + F.col("before") <= F.col("extra"), 1).otherwise(0)
    return ranked.withColumn("times", times).where("times > 0").select("doc_id", "source", "n_tokens", F.col("times").cast("long").alias("times"))


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, reached_share, tokens, documents, most_repeats of every named source."""
    goals = targets.where(F.col("source").isNotNull()).distinct().groupBy("source").agg(F.sum(F.greatest(F.coalesce("target_weight", F.lit(0.0)), F.lit(0.0))).alias("w"))
    goals = goals.withColumn("target_share", F.col("w") / F.sum("w").over(Window.partitionBy(F.lit(1)))).drop("w")
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count("*").alias("documents"), F.max("times").alias("most_repeats"))
    reached = reached.withColumn("reached_share", F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(1))))
    zero = lambda c, t: F.coalesce(c, F.lit(0)).cast(t).alias(c)
    return goals.join(reached, "source", "left").select("source", "target_share", zero("reached_share", "double"), zero("tokens", "long"), zero("documents", "long"), zero("most_repeats", "long"))
