"""Routes and fixed answers of the question workflow, as columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions import pii, scores
from larkspur.functions import text as T

# Intents that need no retrieval.
SMALL_TALK = ("greeting", "farewell", "rapport_smalltalk", "gratitude_ack", "apology_ack", "offtopic_query")
GENERIC = "generic_query"
# Answers that need no model.
LOW_RELEVANCE = "No passage that you may read answers this question well enough."
RETRIEVAL_ERROR = "The search is not available at the moment. Please try again later."
NO_CONTEXT = "There is no readable passage to answer from."
FAILED = "An answer could not be composed from the passages found."
REFUSED = "This request could not be verified. Please connect again and repeat it."
# The fields of structured answers of models.
INTENT = "intent string, confidence string"
REFINEMENT = "should_refine boolean, refined_query string, reason string"
SMALL_TALK_ANSWER = "response string"


def examples(taxonomy: DataFrame) -> DataFrame:
    """``taxonomy``: intent, examples. One row per word of an example."""
    return taxonomy.select("intent", F.explode("examples").alias("example")).select("intent", F.explode(F.array_distinct(T.tokens("example"))).alias("term")).distinct()


def classify(questions: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Deterministic stand-in for the intent model: the intent whose examples share most words with the question.

    Personal data is replaced by placeholders first; questions without a match are generic. Returns query_id, query (as
    it may go on to a model), intent, confidence.
    """
    safe = questions.select("query_id", pii.redact("query").alias("query")).withColumn("_t", F.array_distinct(T.tokens(F.regexp_replace("query", pii.PLACEHOLDER, " "))))
    shared = safe.select("query_id", F.explode("_t").alias("term")).join(examples(taxonomy), "term").groupBy("query_id", "intent").agg(F.count("*").alias("k"))
    best = shared.groupBy("query_id").agg(F.max_by("intent", F.struct("k", "intent")).alias("intent"), F.max("k").alias("k"))
    out = safe.join(best, "query_id", "left")
    return out.select("query_id", "query", F.coalesce("intent", F.lit(GENERIC)).alias("intent"), F.coalesce(F.col("k") / F.greatest(F.size("_t"), F.lit(1)), F.lit(0.0)).alias("confidence"))


def classified(questions: DataFrame, known: list[str], ask: Callable[[Column], Column]) -> DataFrame:
    """Intents by a model slot: ``ask`` gives a JSON answer (intent, confidence) for a question without personal data.

    Unknown intents are generic, unreadable confidences 0, the rest is cut to [0, 1].
    """
    safe = questions.select("query_id", pii.redact("query").alias("query"))
    said = F.from_json(ask(F.col("query")), INTENT)
    judged = safe.withColumn("_a", said)
    intent = F.when(F.col("_a.intent").isin(known), F.col("_a.intent")).otherwise(F.lit(GENERIC))
    return judged.select("query_id", "query", intent.alias("intent"), scores.confidence(F.col("_a.confidence")).alias("confidence"))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """intent, examples of a JSON file {intent: {"examples": [...]} or [...]}; a missing file has no intents."""
    try:
        text = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "intent string, examples array<string>")
    entries = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("intent", "body"))
    listed = F.coalesce(F.from_json(F.get_json_object("body", "$.examples"), "array<string>"), F.from_json("body", "array<string>"), F.array().cast("array<string>"))
    return entries.select("intent", listed.alias("examples"))


def route_intent(intent: Column) -> Column:
    """small_talk or knowledge."""
    return F.when(intent.isin(*SMALL_TALK), "small_talk").otherwise("knowledge")


def route_cache(hit: Column) -> Column:
    return F.when(F.coalesce(hit, F.lit(False)), "answer").otherwise("retrieve")


def route_retrieval(passed: Column) -> Column:
    return F.when(F.coalesce(passed, F.lit(False)), "synthesize").otherwise("fallback")


def fallback(reason: Column, intent: Column, generated: Column) -> Column:
    """Answer without retrieval: fixed texts for failed retrievals, else the model's, else one for the intent."""
    given = F.when(F.coalesce(F.trim(generated), F.lit("")) != "", generated)
    fixed = F.when(intent == "greeting", "Hello. What would you like to know?").when(intent == "farewell", "Goodbye.").when(intent == "gratitude_ack", "You are welcome.").when(intent == "apology_ack", "No harm done.").otherwise("How can I help with the documents?")
    return F.when(reason == "low_relevance", LOW_RELEVANCE).when(reason == "retrieval_error", RETRIEVAL_ERROR).otherwise(F.coalesce(given, fixed))


def refined(query: Column, refined_query: Column) -> Column:
    """The refined question, or the question itself where refinement gives nothing."""
    return F.coalesce(F.when(F.trim(refined_query) != "", refined_query), query)


def synthesized(n_chunks: Column, context: Column, generated: Column) -> Column:
    given = F.when(F.coalesce(F.trim(generated), F.lit("")) != "", generated)
    return F.when((F.coalesce(n_chunks, F.lit(0)) == 0) | (F.coalesce(F.trim(context), F.lit("")) == ""), NO_CONTEXT).otherwise(F.coalesce(given, F.lit(FAILED)))


def error_outcome(name: Column, status_code: Column | None = None) -> Column:
    """Outcome label of an error's class name and, where there is one, its status code."""
    low = F.lower(F.coalesce(name, F.lit("")))
    limited = low.contains("ratelimit") | low.contains("resourceexhausted")
    if status_code is not None:
        limited = limited | F.coalesce(status_code == 429, F.lit(False))
    return F.when(low.contains("timeout"), "timeout").when(limited, "rate_limited").otherwise("error")


def extractor(file_type: Column) -> Column:
    """Which reader a file goes to; anything else is an error."""
    kind = F.regexp_replace(F.lower(F.trim(file_type)), r"^\.+", "")
    return F.when(kind.isin("pdf", "docx", "pptx"), kind).otherwise(F.raise_error(F.concat(F.lit("no reader for file type "), F.coalesce(file_type, F.lit("null")))).cast("string"))


def run_status(dry_run: Column, files: Column, failed: Column) -> Column:
    """Status of an ingestion run of which ``files`` were processed and others failed."""
    return F.when(files == 0, "NO_FILES").when(dry_run & (failed > 0), "DRY_RUN_PARTIAL").when(dry_run, "DRY_RUN").when(failed > 0, "FAILED").otherwise("PUBLISHED")
