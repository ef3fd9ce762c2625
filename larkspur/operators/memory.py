"""Conversation memory: bounded windows, running numbers, long-term recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import scores
from larkspur.functions import text as T
from larkspur.operators import search
from larkspur.operators.skew import join_by_key
from larkspur.session import cut

HISTORY = 10
RAW_LEAST = 0.6
FUSED_LEAST = 0.6
FUSED_TOP = 3


def numbered(turns: DataFrame, session: list[str], order: list[str], slice_seconds: int = 86_400) -> DataFrame:
    """Turns with ``turn_no``, counted from 1 in each session.

    Where the first order column is a time, a session is numbered by slices of time: slices are counted first, and a turn
    adds the turns of earlier slices to its place in its own, so no session is one task's work.
    """
    kind = dict(turns.dtypes)[order[0]]
    if not kind.startswith("timestamp"):
        return turns.withColumn("turn_no", F.row_number().over(Window.partitionBy(*session).orderBy(*order)))
    sliced = turns.withColumn("_slice", F.coalesce(F.floor(F.unix_seconds(F.col(order[0]).cast("timestamp")) / slice_seconds), F.lit(-1 << 62)))
    counts = sliced.groupBy(*session, "_slice").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*session).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    other = before.select(*(F.col(c).alias(f"_{c}") for c in session), F.col("_slice").alias("_of"), "_before")
    same = F.col("_slice") == F.col("_of")
    for c in session:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(Window.partitionBy(*session, "_slice").orderBy(*order))
    return sliced.join(other, same).withColumn("turn_no", (F.col("_before") + place).cast("long")).select(*turns.columns, "turn_no")


def last_turns(turns: DataFrame, session: list[str], order: list[str], n: int = HISTORY) -> DataFrame:
    """The last ``n`` turns of each session with ``place`` in time order (1 = oldest of them).

    Ranked from the end, so that each task passes on no more than ``n`` rows per session.
    """
    back = [F.desc(c) for c in order]
    kept = turns.withColumn("_back", F.row_number().over(Window.partitionBy(*session).orderBy(*back))).where(F.col("_back") <= n)
    size = F.max("_back").over(Window.partitionBy(*session))
    return kept.withColumn("place", size - F.col("_back") + 1).drop("_back")


def history_at(turns: DataFrame, session: list[str], order: list[str], value: Column, n: int = HISTORY, block: int = 10_000) -> DataFrame:
    """Every turn with the window of up to ``n`` values that ends with it, newest first, as the store holds it then.

    Sessions are cut into blocks of turns; the last n - 1 turns of a block also go to the next one, which needs them.
    """
    own = F.floor((F.col("turn_no") - 1) / block)
    late = (F.col("turn_no") - 1) % block >= block - (n - 1)
    blocked = numbered(turns, session, order).withColumn("_value", value).withColumn("_own", own).withColumn("_block", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy(*session, "_block").orderBy("turn_no").rowsBetween(-(n - 1), 0)
    kept = blocked.withColumn("history", F.reverse(F.collect_list("_value").over(w))).where(F.col("_own") == F.col("_block"))
    return kept.select(*turns.columns, "history")


def scaled(rows: DataFrame, score: str, name: str, by: str = "query_id") -> DataFrame:
    """Rows with ``score`` scaled to [0, 1] in their group as ``name``: bounds are aggregated and joined, salted for hot groups.

    A null group has no bounds, and its rows are left out.
    """
    bounds = rows.groupBy(by).agg(F.min(score).alias("_low"), F.max(score).alias("_high"), F.count("*").alias("_n"))
    joined = join_by_key(rows, bounds, [by], "_n", F.struct(*rows.columns))
    return joined.withColumn(name, scores.min_max(F.col(score), F.col("_low"), F.col("_high"))).drop("_low", "_high", "_n")


def with_embeddings(turns: DataFrame, embed, user: str = "user_message", bot: str = "bot_response") -> DataFrame:
    """Turns with embeddings of question, answer and both, ready to append."""
    both = F.concat_ws(" ", user, bot)
    return turns.select("*", embed(F.col(user)).alias("user_embedding"), embed(F.col(bot)).alias("bot_embedding"), embed(both).alias("combined_embedding"))


def appended(turns: DataFrame, embed) -> DataFrame:
    """Turns of long-term memory as they are stored: with their embeddings and the time of storing (UTC, without a zone)."""
    return with_embeddings(turns, embed).withColumn("timestamp", F.to_timestamp_ntz(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())))


def scoped(turns: DataFrame, user_id: Column | str, session_id: Column | str, scope_id: Column | str) -> DataFrame:
    """Turns of one user, session and scope; a blank scope sees nothing."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    same = (F.col("user_id") == lit(user_id)) & (F.col("session_id") == lit(session_id)) & (F.col("scope_id") == lit(scope_id))
    return turns.where(same & (F.trim(lit(scope_id)) != ""))


def hits(rows: DataFrame, score: str, name: str) -> DataFrame:
    """Hits as callers see them: ids, the score under ``name``, messages without nulls, no embeddings."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select("turn_id", F.col(score).alias(name), "user_id", "session_id", blank("user_message"), blank("bot_response"), "timestamp")


def engine_score(cosine: Column) -> Column:
    """Score of a cosine hit as the vector store reports it."""
    return (1 + cosine) / 2


def recall(lexical: DataFrame, semantic: DataFrame, top: int = FUSED_TOP, raw_least: float = RAW_LEAST, least: float = FUSED_LEAST) -> DataFrame:
    """Fused recall: ``lexical`` (query_id, chunk_id, bm25_score), ``semantic`` (query_id, chunk_id, cosine).

    Semantic hits below ``raw_least`` go first. Either list is scaled to [0, 1] by question, fused by reciprocal ranks,
    and the fused score is scaled over all rows; of the first ``top`` those stay whose semantic score reaches ``least``
    (a lexical hit alone has 0, and so has the worst semantic hit unless all are equal).
    """
    by = Window.partitionBy("query_id")
    one = scaled(cut(lexical), "bm25_score", "bm25_norm").withColumn("bm25_rank", F.row_number().over(by.orderBy(F.desc("bm25_norm"), "chunk_id")))
    two = scaled(cut(semantic.withColumn("raw", engine_score(F.col("cosine"))).where(F.col("raw") >= raw_least)), "raw", "semantic_score")
    two = two.withColumn("ann_rank", F.row_number().over(by.orderBy(F.desc("semantic_score"), "chunk_id")))
    fused = search.rrf(one.select("query_id", "chunk_id", "bm25_norm", "bm25_rank"), two.select("query_id", "chunk_id", "semantic_score", "ann_rank"))
    ranked = scaled(cut(fused), "rrf_score", "fused_score").where(F.col("rrf_rank") <= top)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return ranked.select("query_id", "chunk_id", zero("bm25_norm"), zero("semantic_score"), "rrf_score", "fused_score", "rrf_rank").where(F.col("semantic_score") >= least)


SUMMARY = "topic string, context_summary string, entities array<string>"


def merged_summary(previous: Column, generated: Column, user_message: Column, bot_message: Column, turn_number: Column) -> Column:
    """Session summary after a turn: fields of a readable generated JSON win, others stay; the last messages always change."""
    new = F.from_json(generated, SUMMARY)
    keep = lambda f: F.coalesce(new[f], previous[f]).alias(f)
    return F.struct(turn_number.alias("turn_number"), keep("topic"), keep("context_summary"), keep("entities"), user_message.alias("last_user_message"), bot_message.alias("last_bot_message"))


def summarised(sessions: DataFrame, turns: DataFrame, summarise) -> DataFrame:
    """Summaries of the sessions that ``turns`` (KEYS, issued_at, query_id, message, response) belong to, after these turns.

    ``sessions``: KEYS and state. ``summarise`` takes a prompt of the stored summary and the session's last turn and gives
    JSON; what can't be read leaves the summary as it was. Turns without a scope have no session summary.
    """
    own = turns.where(F.coalesce(F.trim("scope_id"), F.lit("")) != "")
    last = own.groupBy(*KEYS).agg(F.max(F.struct("issued_at", "query_id", "message", "response")).alias("_t"), F.count("*").alias("_n"))
    both = last.join(sessions, list(KEYS), "left")
    said = summarise(F.concat_ws("\n\n", F.to_json("state"), "_t.message", "_t.response"))
    state = merged_summary(F.col("state"), F.col("_said"), F.col("_t.message"), F.col("_t.response"), (F.coalesce("state.turn_number", F.lit(0)) + F.col("_n")).cast("int"))
    return both.withColumn("_said", said).select(*KEYS, state.alias("state"))


def summary_view(state: Column) -> list[Column]:
    """The summary's fields under the names that prompts use."""
    return [state["topic"].alias("current_topic"), state["context_summary"].alias("summary"), state["entities"].alias("known_entities")]


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last value of each key: what a key-value store holds. One partially aggregated row per key and task."""
    rest = [c for c in rows.columns if c not in key]
    packed = rows.select(*key, F.struct(*order, *(c for c in rest if c not in order)).alias("_v"))
    return packed.groupBy(*key).agg(F.max("_v").alias("_v")).select(*key, "_v.*")


def with_columns(rows: DataFrame, **types: str) -> DataFrame:
    """Schema evolution: missing columns are added as nulls of the given types."""
    return rows.select("*", *(F.lit(None).cast(t).alias(c) for c, t in types.items() if c not in rows.columns))


KEYS = ("user_id", "session_id", "scope_id")


def _asked(queries: DataFrame) -> DataFrame:
    """Questions that may recall anything: a blank scope sees nothing."""
    return queries.where(F.coalesce(F.trim("scope_id"), F.lit("")) != "")


def _best(scored: DataFrame, score: str, top: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id")
    return scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def lexical(turns: DataFrame, queries: DataFrame, top: int = HISTORY, k1: float = search.K1, b: float = search.B) -> DataFrame:
    """BM25 over questions and answers of long-term memory, the better field counts: query_id, chunk_id, bm25_score.

    ``turns``: turn_id, user_id, session_id, scope_id, user_message, bot_response; ``queries``: query_id, query and the
    same three keys. A question's terms meet those of its own user's, session's and scope's turns only, by an equi-join on
    the keys and the term, before anything is ranked; frequencies cover all turns. Ties go to the smaller id.
    """
    fields = ("user_message", "bot_response")
    stored = cut(turns.select(F.col("turn_id").alias("chunk_id"), *KEYS, *(T.tokens(f).alias(f) for f in fields)))
    sizes = stored.agg(*(x for f in fields for x in (F.count(f), F.avg(F.size(f))))).first()
    asked = _asked(queries).select("query_id", *KEYS, F.explode(T.tokens("query")).alias("term"))
    found = None
    for i, f in enumerate(fields):
        n, average = sizes[2 * i], float(sizes[2 * i + 1] or 0.0)
        postings = cut(stored.select("chunk_id", *KEYS, F.size(f).alias("length"), F.explode(f).alias("term")).groupBy("chunk_id", *KEYS, "length", "term").agg(F.count("*").alias("tf")))
        idf = postings.groupBy("term").agg(F.count("*").alias("df")).select("term", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / max(average, 1e-300)))
        hits = asked.join(idf, "term").join(postings, [*KEYS, "term"]).groupBy("query_id", "chunk_id").agg(F.sum(part).alias("score"))
        found = hits if found is None else found.unionByName(hits)
    best = found.groupBy("query_id", "chunk_id").agg(F.round(F.max("score"), search.DIGITS).alias("bm25_score"))
    return _best(best.where("bm25_score > 0"), "bm25_score", top)


def semantic(turns: DataFrame, queries: DataFrame, vector: str = "combined_embedding", top: int = HISTORY) -> DataFrame:
    """Exact vector search in long-term memory: query_id, chunk_id, cosine. ``queries`` also need ``v``.

    A question meets the turns of its own user, session and scope only. Unusable vectors take no part.
    """
    usable = lambda c: (F.size(c) > 0) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x)) & F.exists(c, lambda x: x != 0)
    stored = turns.where(usable(vector)).select(F.col("turn_id").alias("chunk_id"), *KEYS, F.col(vector).alias("_v"))
    pairs = _asked(queries).where(usable("v")).select("query_id", "v", *KEYS).join(stored, list(KEYS)).where(F.size("v") == F.size("_v"))
    scored = pairs.select("query_id", "chunk_id", F.round(scores.cosine(F.col("v"), F.col("_v")), search.DIGITS).alias("cosine"))
    return _best(scored.distinct(), "cosine", top)


def member_tags(clusters: DataFrame, chunks: DataFrame) -> DataFrame:
    """``clusters``: cluster_id, chunk_ids; ``chunks``: chunk_id, tags. The members' tags in order of first sight."""
    listed = clusters.select("cluster_id", F.posexplode("chunk_ids").alias("i", "chunk_id")).join(chunks.select("chunk_id", F.posexplode("tags").alias("j", "tag")), "chunk_id")
    first = listed.groupBy("cluster_id", "tag").agg(F.min(F.struct("i", "j")).alias("at"))
    return first.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "tag"))), lambda x: x["tag"]).alias("tags"))
