"""The named queries on the operators and the SQL that checks them.

Every query runs over its whole tables. Queries on folds that SQL can't express have no SQL here; the tests check
those against plain re-derivations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.functions import crypto, pii
from larkspur.functions import text as T
from larkspur.operators import cache, chunker, evaluation, memory, metrics, policy, routing, search
from larkspur.sources import generations
from larkspur.sources.files import file_type
from larkspur.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

ROLES = ("bank_employee", "compliance_officer", "corporate_banking_staff", "retail_banking_staff")
NOW = 1_706_600_000  # a fixed "now" for the freshness queries


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# --- Inputs ----------------------------------------------------------------------------------------------------------


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("file_name"), "file_type", "allowed_role"))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    return table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("chunk_id"), "allowed_role").join(e, "doc_id")


def _case_no() -> Column:
    return F.regexp_extract("id", r"(\d+)$", 1).cast("int")


def _questions(spark: SparkSession, d: str, vectors: bool = True) -> DataFrame:
    """The evaluation questions, each with two of the four roles and the vector of its number."""
    roles = F.array(*map(F.lit, ROLES))
    pick = lambda k: F.element_at(roles, (F.pmod(F.col("no") + k, F.lit(4)) + 1).cast("int"))
    cases = table(spark, d, "eval_cases").select(F.col("id").alias("query_id"), F.col("input").alias("query"), _case_no().alias("no")).withColumn("roles", F.array(pick(0), pick(1)))
    if not vectors:
        return cases
    return cases.join(table(spark, d, "embeddings").select(F.col("vec_id").alias("no"), F.col("embedding").alias("v")), "no", "left")


_ROLE_SQL = "(['bank_employee','compliance_officer','corporate_banking_staff','retail_banking_staff'])"
_SEARCH_SQL = f"""
WITH docs AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text, allowed_role, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
stats AS (SELECT count(*) AS n_docs, avg(len(t)) AS avg_length FROM docs),
q AS (SELECT id AS query_id, input AS query, CAST(regexp_extract(id, '([0-9]+)$', 1) AS INTEGER) AS no FROM eval_cases),
qr AS (SELECT query_id, unnest([{_ROLE_SQL}[no % 4 + 1], {_ROLE_SQL}[(no + 1) % 4 + 1]]) AS allowed_role FROM q),
qt AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}]+')) AS term FROM q),
post AS (SELECT chunk_id, term, count(*) AS tf, any_value(n) AS length FROM (SELECT chunk_id, len(t) AS n, unnest(t) AS term FROM docs) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM post WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
part AS (SELECT p.chunk_id, p.term, ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length)) AS s FROM post p JOIN df USING (term), stats),
b AS (SELECT query_id, chunk_id, round(4.0 * sum(s), 9) AS bm25_score FROM qt JOIN part USING (term) GROUP BY ALL),
lex AS (SELECT query_id, chunk_id, bm25_score, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS bm25_rank
  FROM b JOIN docs USING (chunk_id) JOIN qr USING (query_id, allowed_role) WHERE regexp_matches(text, '\\S') QUALIFY bm25_rank <= 50),
v AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, allowed_role, CAST(embedding AS DOUBLE[]) AS x FROM documents JOIN embeddings ON doc_id = vec_id),
qv AS (SELECT query_id, CAST(embedding AS DOUBLE[]) AS y FROM q JOIN embeddings ON no = vec_id),
sem AS (SELECT query_id, chunk_id, round(list_inner_product(x, y) / sqrt(list_inner_product(x, x) * list_inner_product(y, y)), 9) AS ann_score,
  row_number() OVER (PARTITION BY query_id ORDER BY ann_score DESC, chunk_id) AS ann_rank FROM qv JOIN qr USING (query_id) JOIN v USING (allowed_role) QUALIFY ann_rank <= 50),
f AS (SELECT query_id, chunk_id, bm25_rank, ann_rank, round(coalesce(1.0::DOUBLE / (60 + bm25_rank), 0) + coalesce(1.0::DOUBLE / (60 + ann_rank), 0), 12) AS rrf_score FROM lex FULL JOIN sem USING (query_id, chunk_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, bm25_rank NULLS LAST, ann_rank NULLS LAST, chunk_id) AS rrf_rank FROM f)
"""


# --- Retrieval -------------------------------------------------------------------------------------------------------


@query(_SEARCH_SQL + "SELECT query_id, chunk_id, CAST(coalesce(bm25_rank, 0) AS BIGINT) AS bm25_rank, CAST(coalesce(ann_rank, 0) AS BIGINT) AS ann_rank, rrf_score, CAST(rrf_rank AS BIGINT) AS rrf_rank FROM ranked WHERE rrf_rank <= 5")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """Permission-scoped hybrid search: role filter, BM25, exact vectors, rank fusion, first five. A missing rank is 0."""
    found = search.hybrid(_docs(spark, d), _vectors(spark, d), _questions(spark, d))
    rank = lambda c: _long(F.coalesce(c, F.lit(0))).alias(c)
    return found.select("query_id", "chunk_id", rank("bm25_rank"), rank("ann_rank"), "rrf_score", rank("rrf_rank"))


@query(_SEARCH_SQL + "SELECT query_id, chunk_id, bm25_score, CAST(bm25_rank AS BIGINT) AS bm25_rank FROM lex")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25(_docs(spark, d), _questions(spark, d, False)).select("query_id", "chunk_id", "bm25_score", _long("bm25_rank").alias("bm25_rank"))


@query(_SEARCH_SQL + "SELECT query_id, chunk_id, ann_score, CAST(ann_rank AS BIGINT) AS ann_rank FROM sem")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.knn(_vectors(spark, d), _questions(spark, d)).select("query_id", "chunk_id", "ann_score", _long("ann_rank").alias("ann_rank"))


@query(_SEARCH_SQL + "SELECT query_id, chunk_id, rrf_score, CAST(rrf_rank AS BIGINT) AS rrf_rank FROM ranked")
def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    found = search.hybrid(_docs(spark, d), _vectors(spark, d), _questions(spark, d), None)
    return found.select("query_id", "chunk_id", "rrf_score", _long("rrf_rank").alias("rrf_rank"))


_RERANK_SQL = (
    _SEARCH_SQL
    + """, cand AS (SELECT r.query_id, r.chunk_id, r.rrf_rank, list_distinct(regexp_extract_all(lower(q.query), '[\\p{L}\\p{N}]+')) AS qt, list_distinct(d.t) AS ct FROM ranked r JOIN q USING (query_id) JOIN docs d USING (chunk_id) WHERE rrf_rank <= 50),
s AS (SELECT query_id, chunk_id, rrf_rank, 1 / (1 + exp(-(8.0::DOUBLE * len(list_intersect(qt, ct)) / greatest(len(qt), 1) - 4.0))) AS relevance_score FROM cand),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance_score DESC, rrf_rank) AS rank FROM s QUALIFY rank <= 5)
"""
)


@query(_RERANK_SQL + "SELECT query_id, chunk_id, round(relevance_score, 6) AS relevance_score, CAST(rank AS BIGINT) AS rank FROM t QUALIFY max(relevance_score) OVER (PARTITION BY query_id) >= 0.5")
def rerank_gate(spark: SparkSession, d: str) -> DataFrame:
    """Candidates reranked by the stand-in scorer, first five, behind the relevance gate."""
    q, docs = _questions(spark, d), _docs(spark, d)
    fused = search.hybrid(docs, _vectors(spark, d), q, search.CANDIDATES).select("query_id", "chunk_id", "rrf_rank")
    return search.gate(search.rerank(fused, q, docs)).select("query_id", "chunk_id", F.round("relevance_score", 6).alias("relevance_score"), _long("rank").alias("rank"))


@query(
    _SEARCH_SQL
    + """SELECT query_id, string_agg('[Source ' || rrf_rank || ': ' || coalesce(source, 'Unknown document') || '; chunk ' || chunk_id || ']' || chr(10) || regexp_replace(text, '^[\\s\\xA0]+|[\\s\\xA0]+$', '', 'g'), chr(10) ORDER BY rrf_rank) AS context
FROM ranked JOIN (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, source FROM documents) USING (chunk_id) JOIN docs USING (chunk_id) WHERE rrf_rank <= 5 AND query_id IN (SELECT query_id FROM ranked) AND regexp_matches(text, '\\S') GROUP BY ALL"""
)
def context_assembly(spark: SparkSession, d: str) -> DataFrame:
    q, docs = _questions(spark, d), _docs(spark, d)
    fused = search.hybrid(docs, _vectors(spark, d), q)
    return search.context(fused.join(docs.select("chunk_id", "content", "file_name"), "chunk_id").withColumnRenamed("rrf_rank", "rank"))


@query(
    _SEARCH_SQL
    + """, truth AS (SELECT id AS query_id, unnest(list_distinct(source_documents)) AS item FROM eval_cases WHERE len(source_documents) > 0),
h AS (SELECT DISTINCT r.query_id, source AS item FROM ranked r JOIN documents ON chunk_id = CAST(doc_id AS VARCHAR) WHERE rrf_rank <= 5)
SELECT t.query_id, count(*) AS relevant, count(h.item) AS found, round(count(h.item)::DOUBLE / count(*), 6) AS recall FROM truth t LEFT JOIN h USING (query_id, item) GROUP BY ALL"""
)
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Share of each case's source files among the files of the first five hits."""
    q, docs = _questions(spark, d), _docs(spark, d)
    fused = search.hybrid(docs, _vectors(spark, d), q)
    hits = fused.join(docs.select("chunk_id", F.col("file_name").alias("item")), "chunk_id").select("query_id", "item", F.col("rrf_rank").alias("rank"))
    truth = table(spark, d, "eval_cases").select(F.col("id").alias("query_id"), F.explode(F.array_distinct("source_documents")).alias("item"))
    return evaluation.recall_at_k(hits, truth, 5).withColumn("recall", F.round("recall", 6))


# --- Policy ----------------------------------------------------------------------------------------------------------


def _policy(spark: SparkSession, d: str) -> DataFrame:
    """The policy with a position: role names stand in alphabetical order."""
    return table(spark, d, "role_policy").withColumn("position", F.dense_rank().over(Window.partitionBy("policy_version").orderBy("role_name")))


@query("SELECT doc_id, source, coalesce(p.document_role, 'bank_employee') AS document_role FROM documents LEFT JOIN (SELECT file_name, min(role_name) AS document_role FROM role_policy GROUP BY 1) p ON source = file_name")
def role_assign(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return policy.assign_roles(docs, _policy(spark, d), "source")


@query(
    """WITH u AS (SELECT DISTINCT user_id, unnest(list_value('bank_employee', CASE WHEN hash_no % 2 = 0 THEN 'compliance_officer' ELSE 'unknown_role' END)) AS role FROM (SELECT user_id, length(user_id) + ascii(right(user_id, 1)) AS hash_no FROM conversations)),
p AS (SELECT DISTINCT role_name AS role, role_name AS granted FROM role_policy UNION SELECT 'compliance_officer', 'retail_banking_staff')
SELECT user_id, array_to_string(list_sort(list(DISTINCT granted)), ',') AS permissions FROM u JOIN p USING (role) GROUP BY 1"""
)
def effective_permissions(spark: SparkSession, d: str) -> DataFrame:
    users = table(spark, d, "conversations").select("user_id").distinct()
    even = F.pmod(F.length("user_id") + F.ascii(F.right("user_id", F.lit(1))), F.lit(2)) == 0
    users = users.withColumn("roles", F.array(F.lit("bank_employee"), F.when(even, "compliance_officer").otherwise("unknown_role")))
    own = table(spark, d, "role_policy").select(F.col("role_name").alias("role"), F.col("role_name").alias("granted")).distinct()
    grants = own.union(spark.createDataFrame([("compliance_officer", "retail_banking_staff")], "role string, granted string"))
    return policy.effective_permissions(users, grants).select("user_id", F.array_join("permissions", ",").alias("permissions"))


@query("SELECT DISTINCT allowed_role AS role, source AS granted FROM documents WHERE source NOT IN (SELECT file_name FROM role_policy)")
def policy_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Anti join: roles granted on files that the policy doesn't name."""
    grants = table(spark, d, "documents").select(F.col("allowed_role").alias("role"), F.col("source").alias("granted")).distinct()
    return policy.policy_violations(grants, table(spark, d, "role_policy").select(F.col("file_name").alias("role_name"))).select("role", "granted")


@query("SELECT role_name, string_agg(DISTINCT file_name, ',' ORDER BY file_name) AS files, bool_and(file_name IN (SELECT source FROM documents)) AS all_present FROM role_policy GROUP BY 1")
def permission_match(spark: SparkSession, d: str) -> DataFrame:
    """Subset test of each role's files against the files that documents have."""
    files = table(spark, d, "role_policy").groupBy("role_name").agg(F.array_sort(F.collect_set("file_name")).alias("files"))
    present = table(spark, d, "documents").select(F.col("source").alias("file")).distinct()
    missing = files.select("role_name", F.explode("files").alias("file")).join(present, "file", "left_anti").groupBy("role_name").agg(F.count("*").alias("n"))
    return files.join(missing, "role_name", "left").select("role_name", F.array_join("files", ",").alias("files"), F.col("n").isNull().alias("all_present"))


@query("SELECT doc_id, source, allowed_role FROM documents WHERE allowed_role IN ('compliance_officer', 'bank_employee') AND regexp_matches(text, '\\S')")
def role_visible_docs(spark: SparkSession, d: str) -> DataFrame:
    docs = policy.visible(table(spark, d, "documents"), ["compliance_officer", "bank_employee"])
    return docs.where(F.col("text").rlike(r"\S")).select("doc_id", "source", "allowed_role")


# --- Text ------------------------------------------------------------------------------------------------------------


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '-\n([\p{L}\p{N}_]+)', '\1', 'g'), '\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS normalized FROM documents""")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.normalize("text").alias("normalized"))


_KEY_SQL = r"""regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[\s\x{{00A0}}]+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\x{{00A0}}]', '', 'g'), '^[\s\x{{00A0}}]+|[\s\x{{00A0}}]+$', '', 'g')"""


@query(f"SELECT doc_id, {_KEY_SQL.format(c='text')} AS dedup_key FROM documents")
def dedup_key(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.dedup_key("text").alias("dedup_key"))


@query(f"SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, {_KEY_SQL.format(c='text')} ORDER BY doc_id) = 1")
def exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The first document of equal normalised text in each source."""
    return chunker.exact_first(table(spark, d, "documents").select("source", "doc_id", "text"), ["source"], ["text"], ["doc_id"]).select("source", "doc_id")


@query(r"SELECT DISTINCT chunk_id, sha1(regexp_replace(content, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')) AS content_hash FROM chunks WHERE content IS NOT NULL")
def content_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "chunks").where("content is not null")
    return rows.select("chunk_id", T.content_hash("content").alias("content_hash")).distinct()


@query("SELECT DISTINCT source, regexp_replace(lower(source), '[^a-z0-9_-]', '_', 'g') || '_live' AS alias FROM documents")
def alias_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("source").distinct().select("source", T.alias_name("source").alias("alias"))


@query("SELECT id, lower(trim(regexp_replace(input, '\\s+', ' ', 'g'))) AS query_key FROM eval_cases")
def query_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases").select("id", T.query_key("input").alias("query_key"))


_ESCAPED = "array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN unicode(c) > 65535 THEN printf('\\\\u%04x\\\\u%04x', 55296 + ((unicode(c) - 65536) >> 10), 56320 + ((unicode(c) - 65536) & 1023)) WHEN unicode(c) > 127 THEN printf('\\\\u%04x', unicode(c)) ELSE c END), '')"
_QUERY_JSON = _ESCAPED.replace("\\\\", "\\").format(x="replace(replace(lower(trim(regexp_replace({t}, '\\s+', ' ', 'g'))), chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"')")
_KEY_OF = """'rag:answer:' || sha256('{"cache_version":"1","candidate_k":"50","embedding_model":"embedder-1","gemini_model":"chat-1","index":"kb_live","permission_scope":"' || {scope} || '","query":"' || {q} || '","reranker_model":"reranker-1","retrieval_threshold":"0.5","top_k":"5"}')"""


def _key(query: Column, scope: Column) -> Column:
    return crypto.cache_key(query, scope, "kb_live", "chat-1", "embedder-1", "reranker-1")


@query("SELECT id, " + _KEY_OF.replace("{scope}", "'scope-1'").replace("{q}", _QUERY_JSON.replace("{t}", "t")) + " AS cache_key FROM (SELECT id, input AS t FROM eval_cases UNION ALL SELECT DISTINCT turn_id, user_message FROM conversations) WHERE regexp_matches(t, '\\S')")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    """Cache keys of the evaluation questions and of all messages, which also hold other scripts."""
    turns = table(spark, d, "conversations").select(F.col("turn_id").alias("id"), F.col("user_message").alias("t")).distinct()
    rows = table(spark, d, "eval_cases").select("id", F.col("input").alias("t")).unionByName(turns).where(F.col("t").rlike(r"\S"))
    return rows.select("id", _key(F.col("t"), F.lit("scope-1")).alias("cache_key"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"))


@query(r"""SELECT doc_id, CAST(pos AS BIGINT) AS line_no, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), LATERAL (SELECT regexp_replace(raw, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS line)
WHERE regexp_matches(line, '(?i)^Chapter\s+\d+\s+[^.!?]{3,120}$') OR regexp_matches(line, '^\d+(?:\.\d+)+\s+[^.!?]{3,120}$') OR regexp_matches(line, '^\d+\.\s+[A-Z][^.!?]{3,120}$')""")
def regex_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = _lines(spark, d).where(T.is_heading("text"))
    return lines.select("doc_id", _long(F.col("ord") + 1).alias("line_no"), T.strip("text").alias("line"))


@query(
    r"""SELECT doc_id, CAST(count(*) AS BIGINT) AS n_sentences, CAST(sum(length(s)) AS BIGINT) AS n_chars FROM (SELECT doc_id, regexp_replace(unnest(string_split(regexp_replace(text, '([.!?])[\s\x{00A0}]+', '\1' || chr(1), 'g'), chr(1))), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS s FROM documents) WHERE s <> '' GROUP BY 1"""
)
def sentence_counts(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "documents").select("doc_id", F.explode(T.sentences("text")).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("s")).cast("long").alias("n_chars"))


@query(
    r"""SELECT doc_id, CAST(len(p) AS BIGINT) AS n_paragraphs, p[1] AS first_paragraph FROM (
SELECT doc_id, CASE WHEN len(blocks) > 0 THEN blocks ELSE [text] END AS p FROM (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n[\s\x{00A0}]*\n'), lambda x: regexp_replace(x, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g')), lambda x: x <> '') AS blocks FROM documents))"""
)
def paragraph_split(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", T.paragraphs("text").alias("p"))
    return p.select("doc_id", _long(F.size("p")).alias("n_paragraphs"), F.element_at("p", 1).alias("first_paragraph"))


@query(
    r"""SELECT doc_id, CASE WHEN length(text) <= 250 THEN text ELSE regexp_replace(CASE WHEN position(' ' IN right(text, 250)) > 1 THEN substr(right(text, 250), position(' ' IN right(text, 250)) + 1) ELSE right(text, 250) END, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') END AS tail FROM documents"""
)
def overlap_tail(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.overlap_tail("text", 250).alias("tail"))


@query(
    """SELECT doc_id, CAST(i AS BIGINT) AS piece_no, substr(text, CAST(i * 700 + 1 AS BIGINT), 800) AS content FROM documents JOIN (SELECT unnest(range(0, 2000)) AS i) ON i * 700 <= greatest(0, length(text) - 101) WHERE length(text) > 0"""
)
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    return chunker.fixed_windows(table(spark, d, "documents").select("doc_id", "text")).withColumn("piece_no", _long("piece_no"))


def _redacted_sql() -> str:
    text = "text"
    for name, pattern in pii.PATTERNS[:-1]:
        text = f"regexp_replace({text}, '{pattern}', '<{name}>', 'g')"
    # DuckDB's expressions know no look-around: the characters around a phone number are captured, in two passes for neighbours.
    phone = pii.PATTERNS[-1][1].removeprefix(r"(?<![\w+])").removesuffix(r"(?!\w)")
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|[^\\w+])(?:{phone})($|\\W)', '\\1<PHONE_NUMBER>\\2', 'g')"
    return f"SELECT doc_id, {text} AS redacted FROM (SELECT turn_id AS doc_id, user_message AS text FROM conversations UNION SELECT turn_id, bot_response FROM conversations) WHERE text IS NOT NULL"


@query(_redacted_sql())
def redact_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages as they may go to a model: personal data of a fixed form replaced by typed placeholders."""
    t = table(spark, d, "conversations")
    rows = t.select(F.col("turn_id").alias("doc_id"), F.col("user_message").alias("text")).union(t.select("turn_id", "bot_response")).where("text is not null").distinct()
    return rows.select("doc_id", pii.redact("text").alias("redacted"))


@query("SELECT DISTINCT file_name, CASE WHEN lower(file_name) LIKE '%.pdf' THEN 'pdf' WHEN lower(file_name) LIKE '%.docx' THEN 'docx' WHEN lower(file_name) LIKE '%.pptx' THEN 'pptx' END AS file_type FROM ingestion_state")
def file_types(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ingestion_state").select("file_name").distinct().select("file_name", file_type(F.col("file_name")).alias("file_type"))


# --- Chunks ----------------------------------------------------------------------------------------------------------


def _elements(spark: SparkSession, d: str) -> DataFrame:
    """Documents as layout elements: one a line, numbered headings found by their pattern."""
    none = F.lit(None)
    return _lines(spark, d).select("doc_id", "ord", "text", F.lit("paragraph").alias("element_type"), none.cast("int").alias("heading_level"), none.cast("int").alias("page"))


@query(
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
n AS (SELECT doc_id, pos, regexp_replace(regexp_replace(replace(raw, chr(13), chr(10)), '[ \t]+', ' ', 'g'), '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS line FROM l),
h AS (SELECT *, regexp_matches(line, '(?i)^Chapter\s+\d+\s+[^.!?]{3,120}$') OR regexp_matches(line, '^\d+(?:\.\d+)+\s+[^.!?]{3,120}$') OR regexp_matches(line, '^\d+\.\s+[A-Z][^.!?]{3,120}$') AS head FROM n WHERE line <> ''),
s AS (SELECT *, sum(head::INT) OVER w AS part, last_value(CASE WHEN head THEN line END IGNORE NULLS) OVER w AS heading FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
b AS (SELECT *, lag(line) OVER (PARTITION BY doc_id, part ORDER BY pos) AS before FROM s WHERE NOT head)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1 AS BIGINT) AS section_no, coalesce(heading, '') AS heading, body FROM
(SELECT doc_id, part, any_value(heading) AS heading, string_agg(CASE WHEN before IS NULL THEN '' WHEN regexp_matches(before, '[.!?]"?$|\)$') THEN chr(10) || chr(10) ELSE ' ' END || line, '' ORDER BY pos) AS body FROM b GROUP BY ALL)"""
)
def sections(spark: SparkSession, d: str) -> DataFrame:
    s = chunker.build_sections(_elements(spark, d))
    return s.select("doc_id", _long("section_no").alias("section_no"), F.coalesce("heading", F.lit("")).alias("heading"), "body")


@query()
def chunk_documents(spark: SparkSession, d: str) -> DataFrame:
    """The whole chunk pipeline: sections, windows, exact and near duplicates, standard form."""
    chunks = chunker.create_chunks(chunker.build_sections(_elements(spark, d)))
    kept = chunker.near_first(chunker.exact_first(chunks, ["doc_id"], ["heading", "subheading", "content"], ["ord"]))
    names = table(spark, d, "documents").select("doc_id", F.col("source").alias("file_name"), "file_type", "allowed_role")
    return chunker.standard_chunks(kept.join(names, "doc_id"))


@query()
def near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Near duplicates among the stored chunks of each run."""
    runs = table(spark, d, "ingestion_state").groupBy("run_id").agg(F.max("chunks").alias("chunks"))
    rows = spread(runs).select(F.col("run_id").alias("doc_id"), F.posexplode("chunks").alias("ord", "c")).select("doc_id", "ord", F.lit("").alias("heading"), F.lit("").alias("subheading"), F.col("c.content").alias("content"))
    return chunker.near_first(rows).select("doc_id", _long("ord").alias("ord"))


@query("SELECT doc_id, CAST(sum(length(l)) + count(*) - 1 AS BIGINT) AS characters FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY 1")
def page_stats(spark: SparkSession, d: str) -> DataFrame:
    return metrics.page_stats(_lines(spark, d).withColumn("page", F.lit(1))).select("doc_id", "characters")


@query(
    """WITH s AS (SELECT event_type AS doc_id, event_id AS ord, value AS size FROM events), m AS (SELECT doc_id, list_sort(list(size))[len(list(size)) // 2 + 1] AS body FROM s WHERE size > 0 GROUP BY 1)
SELECT doc_id, ord, CAST(CASE WHEN size >= 1.35::DOUBLE * body THEN 1 ELSE 2 END AS BIGINT) AS heading_level FROM s JOIN m USING (doc_id) WHERE size >= 1.2::DOUBLE * body"""
)
def heading_promotion(spark: SparkSession, d: str) -> DataFrame:
    """Heading levels from the upper median of sizes; event values stand in for font sizes."""
    spans = table(spark, d, "events").select(F.col("event_type").alias("doc_id"), F.col("event_id").alias("ord"), F.lit("line").alias("text"), F.col("value").alias("size"))
    return metrics.heading_levels(spans).where("heading_level is not null").select("doc_id", "ord", _long("heading_level").alias("heading_level"))


@query(
    """SELECT chunk_id, doc_id, file_name FROM (SELECT DISTINCT chunk_id, doc_id, file_name, created_at, content_hash, content FROM chunks) QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY created_at DESC NULLS LAST, content_hash DESC NULLS LAST, content DESC NULLS LAST) = 1"""
)
def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Idempotent upsert: the last message of each chunk."""
    rows = table(spark, d, "chunks").select("chunk_id", "doc_id", "file_name", "created_at", "content_hash", "content").distinct()
    return generations.last_by_key(rows, "chunk_id", ["created_at", "content_hash", "content"]).select("chunk_id", "doc_id", "file_name")


# --- Conversations ---------------------------------------------------------------------------------------------------


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("turn_id", "user_id", "session_id", "scope_id", "turn_number", "user_message", "bot_response", "timestamp").distinct()


_TURNS_SQL = "(SELECT DISTINCT turn_id, user_id, session_id, scope_id, turn_number, user_message, bot_response, timestamp FROM conversations)"


@query(f"SELECT session_id, turn_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY timestamp, turn_id) AS BIGINT) AS turn_no FROM {_TURNS_SQL}")
def turn_number(spark: SparkSession, d: str) -> DataFrame:
    return memory.numbered(_turns(spark, d), ["session_id"], ["timestamp", "turn_id"]).select("session_id", "turn_id", _long("turn_no").alias("turn_no"))


@query(f"SELECT session_id, turn_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY timestamp, turn_id) AS BIGINT) AS place FROM (SELECT * FROM {_TURNS_SQL} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, turn_id DESC) <= 3)")
def stm_last_n(spark: SparkSession, d: str) -> DataFrame:
    """The last three turns of each session in time order."""
    return memory.last_turns(_turns(spark, d), ["session_id"], ["timestamp", "turn_id"], 3).select("session_id", "turn_id", _long("place").alias("place"))


@query(f"SELECT turn_id, array_to_string(list_reverse(list(user_message) OVER (PARTITION BY session_id ORDER BY timestamp, turn_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)), '|') AS history FROM {_TURNS_SQL}")
def stm_history(spark: SparkSession, d: str) -> DataFrame:
    """The bounded history that the store holds after each turn, newest first."""
    return memory.history_at(_turns(spark, d), ["session_id"], ["timestamp", "turn_id"], F.col("user_message")).select("turn_id", F.array_join("history", "|").alias("history"))


@query(f"SELECT session_id, turn_id, user_message AS last_user_message, bot_response AS last_bot_message FROM {_TURNS_SQL} QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY timestamp DESC, turn_id DESC) = 1")
def stm_latest(spark: SparkSession, d: str) -> DataFrame:
    """The key-value view: the last value of each session."""
    rows = _turns(spark, d).select("session_id", "timestamp", "turn_id", F.col("user_message").alias("last_user_message"), F.col("bot_response").alias("last_bot_message"))
    return memory.latest(rows, ["session_id"], ["timestamp", "turn_id"]).select("session_id", "turn_id", "last_user_message", "last_bot_message")


_SCOPED = "scope_id IS NOT NULL AND trim(scope_id) <> ''"
_LTM_SQL = f"""
WITH t AS (SELECT DISTINCT turn_id, user_id, session_id, scope_id, user_message, bot_response FROM conversations),
tok AS (SELECT turn_id, user_id, session_id, scope_id, 'u' AS f, regexp_extract_all(lower(user_message), '[\\p{{L}}\\p{{N}}]+') AS w FROM t WHERE user_message IS NOT NULL
  UNION ALL SELECT turn_id, user_id, session_id, scope_id, 'b', regexp_extract_all(lower(bot_response), '[\\p{{L}}\\p{{N}}]+') FROM t WHERE bot_response IS NOT NULL),
st AS (SELECT f, count(*) AS n, avg(len(w)) AS a FROM tok GROUP BY 1),
df AS (SELECT f, term, count(*) AS df FROM (SELECT f, unnest(list_distinct(w)) AS term FROM tok) GROUP BY ALL),
qt AS (SELECT turn_id AS query_id, user_id, session_id, scope_id, unnest(regexp_extract_all(lower(user_message), '[\\p{{L}}\\p{{N}}]+')) AS term FROM t WHERE {_SCOPED}),
tf AS (SELECT turn_id, f, term, count(*) AS tf, any_value(n) AS len FROM (SELECT turn_id, f, len(w) AS n, unnest(w) AS term FROM tok) GROUP BY ALL),
sc AS (SELECT q.query_id, k.turn_id AS chunk_id, k.f, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * tf.len / a))) AS s
  FROM qt q JOIN tok k USING (user_id, session_id, scope_id) JOIN tf ON tf.turn_id = k.turn_id AND tf.f = k.f AND tf.term = q.term JOIN df ON df.f = k.f AND df.term = q.term JOIN st ON st.f = k.f GROUP BY ALL),
lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_score DESC, chunk_id) AS r FROM (SELECT query_id, chunk_id, round(max(s), 9) AS bm25_score FROM sc GROUP BY ALL) WHERE bm25_score > 0 QUALIFY r <= 10),
v AS (SELECT DISTINCT turn_id, user_id, session_id, scope_id, CAST(combined_embedding AS DOUBLE[]) AS x FROM conversations WHERE len(combined_embedding) > 0 AND len(list_filter(combined_embedding, lambda e: e IS NULL OR isnan(e))) = 0 AND len(list_filter(combined_embedding, lambda e: e <> 0)) > 0),
sem AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS r FROM (SELECT DISTINCT a.turn_id AS query_id, b.turn_id AS chunk_id, round(list_inner_product(a.x, b.x) / sqrt(list_inner_product(a.x, a.x) * list_inner_product(b.x, b.x)), 9) AS cosine
  FROM v a JOIN v b USING (user_id, session_id, scope_id) WHERE {_SCOPED} AND len(a.x) = len(b.x)) QUALIFY r <= 10)"""


def _ltm(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """All turns, and each of them as a question to the memory of its own user, session and scope."""
    t = table(spark, d, "conversations").select("turn_id", "user_id", "session_id", "scope_id", "user_message", "bot_response", "combined_embedding", "timestamp").distinct()
    return t, t.select(F.col("turn_id").alias("query_id"), F.col("user_message").alias("query"), F.col("combined_embedding").alias("v"), *memory.KEYS)


@query(_LTM_SQL + " SELECT query_id, chunk_id, bm25_score FROM lex")
def ltm_lexical(spark: SparkSession, d: str) -> DataFrame:
    """BM25 in long-term memory."""
    return memory.lexical(*_ltm(spark, d))


@query(_LTM_SQL + " SELECT query_id, chunk_id, cosine FROM sem")
def ltm_semantic(spark: SparkSession, d: str) -> DataFrame:
    """Vector search in long-term memory."""
    return memory.semantic(*_ltm(spark, d))


def _scaled_sql(x: str) -> str:
    return f"CASE WHEN max({x}) OVER w = min({x}) OVER w THEN 1.0::DOUBLE ELSE ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) END"


_FUSED_SQL = (
    _LTM_SQL
    + f""", l AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25_norm DESC, chunk_id) AS r1 FROM (SELECT query_id, chunk_id, {_scaled_sql("bm25_score")} AS bm25_norm FROM lex WINDOW w AS (PARTITION BY query_id))),
s AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, chunk_id) AS r2 FROM (SELECT query_id, chunk_id, {_scaled_sql("raw")} AS semantic_score FROM (SELECT query_id, chunk_id, (1 + cosine) / 2 AS raw FROM sem WHERE (1 + cosine) / 2 >= 0.6::DOUBLE) WINDOW w AS (PARTITION BY query_id))),
f AS (SELECT query_id, chunk_id, semantic_score, r1, r2, round(coalesce(1.0::DOUBLE / (60 + r1), 0) + coalesce(1.0::DOUBLE / (60 + r2), 0), 12) AS rrf FROM l FULL JOIN s USING (query_id, chunk_id)),
g AS (SELECT *, {_scaled_sql("rrf")} AS fused, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, r1 NULLS LAST, r2 NULLS LAST, chunk_id) AS k FROM f WINDOW w AS (PARTITION BY query_id))"""
)


@query(_FUSED_SQL + " SELECT query_id, chunk_id, round(coalesce(semantic_score, 0), 6) AS semantic_score, round(fused, 6) AS fused_score, CAST(k AS BIGINT) AS rrf_rank FROM g WHERE k <= 3 AND coalesce(semantic_score, 0) >= 0.6")
def ltm_fused(spark: SparkSession, d: str) -> DataFrame:
    """Fused recall of long-term memory: both searches, normalised, fused, first three, threshold."""
    t, q = _ltm(spark, d)
    found = memory.recall(memory.lexical(t, q), memory.semantic(t, q))
    return found.select("query_id", "chunk_id", F.round("semantic_score", 6).alias("semantic_score"), F.round("fused_score", 6).alias("fused_score"), _long("rrf_rank").alias("rrf_rank"))


@query(f"SELECT query_id, turn_id, user_message, coalesce(bot_response, '') AS bot_response, round(cosine, 6) AS score FROM (SELECT * FROM sem WHERE r <= 1) JOIN t ON t.turn_id = chunk_id".join([_LTM_SQL + " ", ""]))
def scoped_memory(spark: SparkSession, d: str) -> DataFrame:
    """The nearest turn that each turn may recall, as callers see it: an equi-join on user, session and scope; null scopes see nothing."""
    t, q = _ltm(spark, d)
    found = memory.semantic(t, q, top=1).withColumnRenamed("chunk_id", "turn_id").join(t, "turn_id")
    rows = found.join(memory.hits(found, "cosine", "score").select("turn_id", F.col("user_message").alias("_u"), F.col("bot_response").alias("_b")).distinct(), "turn_id")
    return rows.select("query_id", "turn_id", F.col("_u").alias("user_message"), F.col("_b").alias("bot_response"), F.round("cosine", 6).alias("score")).distinct()


@query("SELECT event_id, round(CASE WHEN max(value) OVER w = min(value) OVER w THEN 1.0 ELSE (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) END, 6)::DOUBLE AS norm FROM events WINDOW w AS (PARTITION BY user_id)")
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    return memory.scaled(table(spark, d, "events").select("event_id", "user_id", "value"), "value", "norm", "user_id").select("event_id", F.round("norm", 6).alias("norm"))


# --- Cache, freshness, routes ----------------------------------------------------------------------------------------


@query(
    """WITH RECURSIVE e AS (SELECT event_type, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
r AS (SELECT event_type, event_id, i, false AS hit, s AS written FROM e WHERE i = 1 UNION ALL
SELECT e.event_type, e.event_id, e.i, e.s - r.written < 900, CASE WHEN e.s - r.written < 900 THEN r.written ELSE e.s END FROM r JOIN e ON e.event_type = r.event_type AND e.i = r.i + 1)
SELECT event_type, event_id, hit FROM r"""
)
def ttl_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Lookups of a cache that lives 900 seconds from the write."""
    return cache.lookups(table(spark, d, "events").select("event_type", "ts", "event_id"), "event_type", "ts", "event_id")


@query(f"SELECT event_id, abs({NOW} - floor(epoch(ts))) <= 86400 AS fresh FROM events")
def freshness_window(spark: SparkSession, d: str) -> DataFrame:
    issued = F.unix_seconds(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", cache.fresh(issued, F.lit(NOW), 86400).alias("fresh"))


@query("SELECT event_id, CASE WHEN event_type IN ('signup', 'click') THEN 'small_talk' ELSE 'knowledge' END AS route, CASE WHEN value > 10 THEN 'answer' ELSE 'retrieve' END AS cache_route FROM events")
def route_intent(spark: SparkSession, d: str) -> DataFrame:
    intent = F.when(F.col("event_type") == "signup", "greeting").when(F.col("event_type") == "click", "gratitude_ack").otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", routing.route_intent(intent).alias("route"), routing.route_cache(F.col("value") > 10).alias("cache_route"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'timeout' WHEN 'click' THEN 'rate_limited' ELSE 'error' END AS outcome FROM events")
def error_outcomes(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("event_type") == "view", "ReadTimeout").when(F.col("event_type") == "click", "RateLimitError").otherwise("ValueError")
    return table(spark, d, "events").select("event_id", routing.error_outcome(name).alias("outcome"))


@query(
    f"""WITH RECURSIVE e AS (SELECT session_id, turn_id, epoch_us(timestamp) AS s, greatest(epoch_us(stored_at), epoch_us(timestamp)) AS e, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, turn_id) AS i FROM (SELECT DISTINCT session_id, turn_id, timestamp, stored_at FROM conversations)),
r AS (SELECT session_id, turn_id, i, 0 AS code, e AS until FROM e WHERE i = 1 UNION ALL
SELECT e.session_id, e.turn_id, e.i, CASE WHEN e.s >= r.until THEN 0 ELSE 4409 END, CASE WHEN e.s >= r.until THEN e.e ELSE r.until END FROM r JOIN e ON e.session_id = r.session_id AND e.i = r.i + 1)
SELECT session_id, turn_id AS connection_id, CAST(code AS BIGINT) AS close_code FROM r"""
)
def live_connections(spark: SparkSession, d: str) -> DataFrame:
    """Turns as connections that end when the turn is stored: one that comes while another of its session is live is refused."""
    e = table(spark, d, "conversations").select("session_id", F.col("turn_id").alias("connection_id"), F.col("timestamp").alias("ts"), F.col("stored_at").alias("closed_at")).distinct()
    return policy.live_connections(e).select("session_id", "connection_id", _long(F.coalesce("close_code", F.lit(0))).alias("close_code"))


@query(
    f"""WITH e AS (SELECT DISTINCT source_documents[1] AS intent, unnest(regexp_extract_all(lower(input), '[\\p{{L}}\\p{{N}}]+')) AS term FROM eval_cases WHERE source_documents[1] IS NOT NULL),
q AS (SELECT doc_id AS query_id, list_distinct(regexp_extract_all(lower(regexp_replace(redacted, '{pii.PLACEHOLDER}', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')) AS w FROM ({_redacted_sql().replace("UNION SELECT turn_id, bot_response FROM conversations", "")})),
k AS (SELECT query_id, intent, count(*) AS k FROM (SELECT DISTINCT query_id, unnest(w) AS term FROM q) JOIN e USING (term) GROUP BY ALL),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY k DESC, intent DESC) = 1)
SELECT DISTINCT q.query_id, coalesce(intent, 'generic_query') AS intent, round(coalesce(k / greatest(len(w), 1), 0)::DOUBLE, 6) AS confidence FROM q LEFT JOIN b USING (query_id)"""
)
def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    """Intents by the words that examples share; sources' first questions stand in for the taxonomy."""
    cases = table(spark, d, "eval_cases")
    taxonomy = cases.groupBy(F.element_at("source_documents", 1).alias("intent")).agg(F.collect_list("input").alias("examples")).where("intent is not null")
    turns = table(spark, d, "conversations").select(F.col("turn_id").alias("query_id"), F.col("user_message").alias("query")).distinct()
    return routing.classify(turns, taxonomy).select("query_id", "intent", F.round("confidence", 6).alias("confidence")).distinct()


# --- Metrics ---------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("tokens", F.get_json_object("props", "$.k").cast("long"))


@query("SELECT event_type, user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def metric_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.counters(_events(spark, d), ["event_type", "user_id"]).withColumn("total", F.round("total", 4))


@query("SELECT epoch(time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01'))::BIGINT AS window_start, count(*) AS n, round(avg(CASE WHEN event_type = 'view' THEN 1.0::DOUBLE ELSE 0.0 END), 6) AS ratio FROM events WHERE event_type IN ('view', 'click') GROUP BY 1")
def hit_ratio_5m(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.hit_ratio(_events(spark, d), F.col("event_type") == "view", F.col("event_type") == "click")
    return r.select(_epoch("window_start"), "n", F.round("ratio", 6).alias("ratio"))


def _epoch(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp")).alias(c)


@query("SELECT epoch(time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01'))::BIGINT AS window_start, event_type, round(count(*) / 300.0::DOUBLE, 9) AS per_second FROM events WHERE event_type IN ('error', 'signup') GROUP BY 1, 2")
def failure_rate_5m(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.rate(_events(spark, d).where(F.col("event_type").isin("error", "signup")), ["event_type"])
    return r.select(_epoch("window_start"), "event_type", F.round("per_second", 9).alias("per_second"))


@query("SELECT epoch(time_bucket(INTERVAL '5 minutes', ts, TIMESTAMP '1970-01-01'))::BIGINT AS window_start, event_type, round(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) / 300.0::DOUBLE, 6) AS per_second FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 0 GROUP BY 1, 2")
def token_rate(spark: SparkSession, d: str) -> DataFrame:
    r = metrics.rate(_events(spark, d).where("tokens > 0"), ["event_type"], amount=F.col("tokens"))
    return r.select(_epoch("window_start"), "event_type", F.round("per_second", 6).alias("per_second"))


@query("SELECT event_type, round(quantile_cont(greatest(value, 0), 0.95), 6) AS p95 FROM events GROUP BY 1")
def p95_duration(spark: SparkSession, d: str) -> DataFrame:
    return metrics.p95(_events(spark, d), ["event_type"], "value").withColumn("p95", F.round("p95", 6))


@query("SELECT event_type, le, CAST(count(*) FILTER (WHERE value <= b) AS BIGINT) AS n FROM events, (VALUES ('0.005', 0.005::DOUBLE), ('0.01', 0.01), ('0.025', 0.025), ('0.05', 0.05), ('0.1', 0.1), ('0.25', 0.25), ('0.5', 0.5), ('1.0', 1.0), ('2.5', 2.5), ('5.0', 5.0), ('10.0', 10.0), ('inf', 1e300)) t(le, b) GROUP BY 1, 2")
def histogram_buckets(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(_events(spark, d), ["event_type"], "value")


@query("SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS tokens FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 0 GROUP BY 1")
def token_counters(spark: SparkSession, d: str) -> DataFrame:
    return metrics.token_counters(_events(spark, d), ["event_type"], "tokens")


@query("SELECT event_type AS topic, CAST(user_id % 3 AS BIGINT) AS partition, CAST(max(event_id) + 1 AS BIGINT) AS offset_next FROM events GROUP BY 1, 2")
def highest_offsets(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("topic"), (F.col("user_id") % 3).alias("partition"), F.col("event_id").alias("offset"))
    return metrics.highest_offsets(e).withColumnRenamed("offset", "offset_next")


@query("SELECT status, count(*) AS runs, CAST(sum(coalesce(len(chunks), 0)) AS BIGINT) AS chunks, CAST(count(*) FILTER (WHERE error IS NOT NULL) AS BIGINT) AS failed FROM (SELECT DISTINCT ON (run_id) run_id, status, chunks, error FROM ingestion_state) GROUP BY 1")
def bulk_counters(spark: SparkSession, d: str) -> DataFrame:
    """Runs, chunks and failures by status."""
    runs = table(spark, d, "ingestion_state").select("run_id", "status", F.coalesce(F.size("chunks"), F.lit(0)).alias("n"), F.col("error").isNotNull().alias("bad")).distinct()
    return runs.groupBy("status").agg(F.count("*").alias("runs"), F.sum(F.greatest("n", F.lit(0))).cast("long").alias("chunks"), F.sum(F.col("bad").cast("int")).cast("long").alias("failed"))


# --- Evaluation ------------------------------------------------------------------------------------------------------


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def eval_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Replace-upsert on two keys: the earlier half of the results stored, the later half new."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", "value", "ts")
    early = e.where("event_id % 2 = 0")
    return evaluation.upsert(early, e.where("event_id % 2 = 1"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("SELECT event_id, user_id, event_type, value FROM events ORDER BY ts DESC, event_id, user_id, event_type, value LIMIT 10")
def latest_results(spark: SparkSession, d: str) -> DataFrame:
    """The report of the last ten results (a top-n by time)."""
    e = table(spark, d, "events").withColumnRenamed("ts", "created_at")
    columns = ["event_id", "user_id", "event_type", "value"]
    return evaluation.latest_results(e.select(*columns, "created_at"), [*columns, "created_at"]).select(*columns)


@query("SELECT id, CAST(CASE WHEN expected_output IS NOT NULL THEN 6 ELSE 3 END AS BIGINT) AS scored, CAST(CASE WHEN expected_output IS NOT NULL THEN 0 ELSE 3 END AS BIGINT) AS skipped FROM eval_cases")
def metric_status(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "eval_cases").select("id", evaluation.metric_rows(F.col("expected_output").isNotNull()).alias("m"))
    count = lambda s: _long(F.size(F.filter("m", lambda x: x["status"] == s)))
    return m.select("id", count("completed").alias("scored"), count("skipped").alias("skipped"))
