"""Answering a batch of signed requests as one plan: verify, route, refine, look up in the cache, retrieve, answer, remember."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur import models
from larkspur.functions import crypto
from larkspur.operators import cache, memory, routing, search
from larkspur.session import cut

SOURCES = "array<struct<file_name:string,chunk_id:string>>"
ENTRY = f"cache_key string, response string, sources {SOURCES}, retrieval_passed boolean, written_at long"
TURN = "user_id string, session_id string, scope_id string, turn_id string, user_message string, bot_response string, user_embedding array<float>, bot_embedding array<float>, combined_embedding array<float>, timestamp timestamp_ntz"
STATE = "turn_number int, topic string, context_summary string, entities array<string>, last_user_message string, last_bot_message string"
SESSION = f"user_id string, session_id string, scope_id string, state struct<{', '.join(f.replace(' ', ':', 1) for f in STATE.split(', '))}>"


def admitted(requests: DataFrame, secret: str, now: Column, known_roles: list[str], expected: Column) -> DataFrame:
    """Requests with ``reject_reason`` (null: accepted) and ``query_id``."""
    known = F.array(*map(F.lit, known_roles))
    judged = requests.withColumn("reject_reason", crypto.reject_reason(secret, now, known, expected))
    return judged.withColumn("query_id", F.sha1(F.concat_ws("|", "session_id", "connection_id", "message", F.col("issued_at").cast("string"))))


def readable_messages(messages: DataFrame, live: DataFrame, now: Column) -> DataFrame:
    """Messages (session_id, connection_id, message, expires_at) that hold text, come on the live connection, and whose
    token hasn't expired."""
    alive = live.where("close_code is null").select("session_id", "connection_id")
    return messages.where((F.coalesce(F.trim("message"), F.lit("")) != "") & (F.col("expires_at") > now)).join(alive, ["session_id", "connection_id"], "left_semi")


@dataclass
class Models:
    """The model slots of the plan. ``refine`` and ``summarise`` take a prompt and give JSON, ``compose`` gives a text;
    ``classify`` takes questions (query_id, query) and gives query_id, query without personal data, intent, confidence."""

    classify: Callable[[DataFrame], DataFrame]
    embed: Callable[[Column], Column]
    compose: Callable[[Column], Column] | None = None
    refine: Callable[[Column], Column] | None = None
    summarise: Callable[[Column], Column] | None = None
    logit: Callable[[Column, Column], Column] = search.overlap_logit


@dataclass
class Stores:
    """What is remembered: cache entries (ENTRY), turns (TURN) and the summary of each session (SESSION)."""

    entries: DataFrame
    turns: DataFrame
    sessions: DataFrame


@dataclass
class Answers:
    """Responses, and what is to be added to each store."""

    responses: DataFrame
    entries: DataFrame
    turns: DataFrame
    sessions: DataFrame


def refined(asked: DataFrame, stores: Stores, slots: Models) -> DataFrame:
    """Questions with refined_query and should_refine, from the session's summary and recalled turns of its user and scope.

    A model that says nothing usable leaves the question as it is.
    """
    if slots.refine is None:
        return asked.withColumn("refined_query", F.col("query")).withColumn("should_refine", F.lit(False))
    recalled = memory.recall(memory.lexical(stores.turns, asked), memory.semantic(stores.turns, asked.withColumn("v", slots.embed(F.col("query")))))
    told = recalled.join(stores.turns.select(F.col("turn_id").alias("chunk_id"), "user_message", "bot_response").distinct(), "chunk_id")
    turns = told.groupBy("query_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct("rrf_rank", "user_message", "bot_response")))).alias("_turns"))
    summary = stores.sessions.select(*memory.KEYS, F.to_json(F.struct(*memory.summary_view(F.col("state")))).alias("_summary"))
    whole = asked.join(turns, "query_id", "left").join(summary, list(memory.KEYS), "left")
    said = F.from_json(slots.refine(F.concat_ws("\n\n", "query", "_summary", "_turns")), routing.REFINEMENT)
    return whole.withColumn("_said", said).withColumn("refined_query", routing.refined(F.col("query"), F.trim("_said.refined_query"))).withColumn("should_refine", F.coalesce("_said.should_refine", F.lit(False))).drop("_said", "_turns", "_summary")


def looked_up(asked: DataFrame, entries: DataFrame, key: Callable[[Column, Column], Column], now: Column, ttl: int = cache.TTL_SECONDS) -> DataFrame:
    """Questions with cache_key (null if not eligible), the cached response and sources of a live, usable entry, and ``leader``.

    Of questions of one batch with the same key and no entry the first one is answered for all: what it writes, the
    others would find.
    """
    keyed = asked.withColumn("cache_key", F.when(cache.eligible(F.col("should_refine")), key(F.col("refined_query"), F.col("scope_id"))))
    live = entries.where((now - F.col("written_at") < ttl) & cache.usable(F.col("response"), F.col("retrieval_passed")))
    last = memory.latest(live.select("cache_key", "written_at", "response", "sources"), ["cache_key"], ["written_at"])
    found = keyed.join(last.select("cache_key", F.col("response").alias("cached"), F.col("sources").alias("cached_sources")), "cache_key", "left")
    first = found.where("cached is null").groupBy("cache_key").agg(F.min_by("query_id", F.struct("issued_at", "query_id")).alias("_first")).where("cache_key is not null")
    return found.join(first, "cache_key", "left").withColumn("leader", F.when(F.col("cached").isNull(), F.coalesce("_first", "query_id"))).drop("_first")


def retrieved(asked: DataFrame, docs: DataFrame, vectors: DataFrame, slots: Models, threshold: float = search.THRESHOLD, stored: search.Index | None = None) -> DataFrame:
    """query_id, score, context and passages of the questions (query_id, query, roles) whose best passage reaches the threshold."""
    searched = asked.withColumn("v", slots.embed(F.col("query")))
    fused = search.hybrid(docs, vectors, searched, search.CANDIDATES, stored=stored).select("query_id", "chunk_id", "rrf_rank")
    named = docs.select(F.col("chunk_id").cast("string").alias("chunk_id"), "content", "file_name")
    passed = cut(search.gate(search.rerank(fused, searched, named, slots.logit), threshold).join(named.select("chunk_id", "file_name"), "chunk_id"))
    listed = passed.groupBy("query_id").agg(F.max("best_score").alias("score"), F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "file_name", "content"))).alias("passages"))
    return listed.join(search.context(passed), "query_id", "left")


def sources(passages: Column) -> Column:
    """Passages as responses name them."""
    return F.transform(passages, lambda s: F.struct(s["file_name"].alias("file_name"), s["chunk_id"].alias("chunk_id")))


def answer(requests: DataFrame, docs: DataFrame, vectors: DataFrame, stores: Stores, slots: Models, key: Callable[[Column, Column], Column], now: Column, threshold: float = search.THRESHOLD, stored: search.Index | None = None) -> Answers:
    """Answers to accepted requests (query_id, session_id, connection_id, user_id, message, allowed_roles, scope_id, issued_at).

    Responses: session_id, connection_id, query_id, user_id, response, intent, sources. Small talk gets a composed or
    fixed answer, a live cache entry is returned as it is, a failed gate gives the low-relevance text, everything else an
    answer composed from the passages. Every answer becomes a turn of long-term memory and goes into its session's
    summary. Questions are redacted before any model or index sees them; memory keeps the message as it came.
    """
    compose = slots.compose or models.text_model()
    raw = requests.select("query_id", "session_id", "connection_id", "user_id", "scope_id", "issued_at", F.col("message").alias("query"), F.col("allowed_roles").alias("roles"))
    asked = cut(raw.withColumnRenamed("query", "message").join(slots.classify(raw.select("query_id", "query")), "query_id").withColumn("route", routing.route_intent(F.col("intent"))))
    known = cut(looked_up(refined(asked.where("route = 'knowledge'"), stores, slots), stores.entries, key, now))
    leaders = known.where("leader = query_id").select("query_id", F.col("refined_query").alias("query"), "roles")
    passages = retrieved(leaders, docs, vectors, slots, threshold, stored)
    composed = cut(leaders.join(passages, "query_id", "left").withColumn("generated", compose(F.concat_ws("\n\n", "query", "context"))).select(F.col("query_id").alias("leader"), sources(F.col("passages")).alias("sources"), "context", "generated"))
    whole = asked.join(known.select("query_id", "cache_key", "cached", "cached_sources", "leader"), "query_id", "left").join(composed, "leader", "left")
    talk = F.when(F.col("route") == "small_talk", compose(F.col("query")))
    passed = F.size("sources") > 0
    reason = F.when((F.col("route") == "knowledge") & F.col("cached").isNull() & ~F.coalesce(passed, F.lit(False)), "low_relevance")
    fresh = F.when(reason.isNotNull() | (F.col("route") == "small_talk"), routing.fallback(reason, F.col("intent"), talk)).otherwise(routing.synthesized(F.size("sources"), F.col("context"), F.col("generated")))
    done = cut(whole.withColumn("response", F.coalesce("cached", fresh)).withColumn("sources", F.coalesce("cached_sources", "sources", F.array().cast(SOURCES))))
    written = done.where((F.col("leader") == F.col("query_id")) & F.col("cache_key").isNotNull() & passed & (F.coalesce(F.trim("generated"), F.lit("")) != ""))
    turns = memory.appended(done.select("user_id", "session_id", "scope_id", F.col("query_id").alias("turn_id"), F.col("message").alias("user_message"), F.col("response").alias("bot_response")), slots.embed)
    return Answers(
        done.select("session_id", "connection_id", "query_id", "user_id", "response", "intent", "sources"),
        written.select("cache_key", "response", "sources", F.lit(True).alias("retrieval_passed"), now.cast("long").alias("written_at")),
        turns,
        memory.summarised(stores.sessions, done.select("user_id", "session_id", "scope_id", "issued_at", "query_id", "message", "response"), slots.summarise or models.text_model()),
    )


def refused(requests: DataFrame) -> DataFrame:
    """Responses to requests with a ``reject_reason``: a fixed text, on the connection that they name."""
    blank = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return requests.where("reject_reason is not null").select(blank("session_id"), blank("connection_id"), "query_id", "user_id", F.lit(routing.REFUSED).alias("response"), F.lit(None).cast("string").alias("intent"), F.array().cast(SOURCES).alias("sources"))
