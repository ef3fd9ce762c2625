import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import cache, evaluation, memory, metrics, policy, routing, search
from larkspur.operators.components import components
from larkspur.operators.skew import join_by_key


def test_salted_join_is_a_plain_join(spark):
    rows = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(300)], "id long, k long")
    groups = rows.groupBy("k").agg(F.count("*").alias("n"))
    assert sorted(join_by_key(rows, groups, ["k"], "n", F.col("id"), hot_rows=10, salts=4).collect()) == sorted(rows.join(groups, "k").select("k", "id", "n").collect())


def test_components(spark):
    edges = [(f"n{i:03d}", f"n{i + 1:03d}") for i in range(40)] + [("x", "y"), ("y", "z"), ("h", "h"), (None, "q")]
    found = dict(components(spark.createDataFrame(edges, "a string, b string")).collect())
    assert all(found[f"n{i:03d}"] == "n000" for i in range(41)) and found["z"] == "x" and found["h"] == "h" and "q" not in found
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def ttl_plain(times, ttl):
    written, out = None, []
    for t in times:
        hit = written is not None and t - written < ttl
        out.append(hit)
        if not hit:
            written = t
    return out


def test_ttl_cache(spark):
    rnd, start = random.Random(1), datetime(2024, 1, 1)
    rows, t = [], 0.0
    for i in range(400):
        t += rnd.choice([10, 300, 899, 900, 2000])
        rows.append(("a" if i % 2 else "b", start + timedelta(seconds=t), i))
    rows += [("c", start, 1000), ("c", start + timedelta(seconds=900), 1001), ("c", start + timedelta(seconds=1799), 1002), (None, start, 2000), ("c", None, 2001)]
    found = {r["id"]: r["hit"] for r in cache.lookups(spark.createDataFrame(rows, "k string, ts timestamp, id long"), "k", "ts", "id").collect()}
    for k in "abc":
        own = sorted((r[1], r[2]) for r in rows if r[0] == k and r[1])
        assert [found[i] for _, i in own] == ttl_plain([x.timestamp() for x, _ in own], 900)
    assert not found[1001] and found[1002] and 2000 not in found and 2001 not in found


DOCS = [("1", "alpha beta", "f1", "pdf", "r1"), ("2", "alpha alpha gamma", "f2", "pdf", "r2"), ("3", " ", "f3", "pdf", "r1"), ("4", None, "f4", "pdf", "r1"), ("5", "delta alpha", "alpha", "pdf", "r1")]
DOC = "chunk_id string, content string, file_name string, file_type string, allowed_role string"


def test_no_role_sees_what_it_may_not(spark):
    docs = spark.createDataFrame(DOCS, DOC)
    q = spark.createDataFrame([("q1", "alpha", ["r1"]), ("q2", "alpha", []), ("q3", " ", ["r1"]), ("q4", "alpha", ["r2"])], "query_id string, query string, roles array<string>")
    hits = search.bm25(docs, q).collect()
    assert {(r.query_id, r.chunk_id) for r in hits} == {("q1", "1"), ("q1", "5"), ("q4", "2")}
    v = spark.createDataFrame([("1", [1.0, 0.0], "r1"), ("2", [1.0, 0.1], "r2"), ("3", None, "r1"), ("4", [0.0, 0.0], "r1"), ("5", [1.0], "r1")], "chunk_id string, v array<float>, allowed_role string")
    qv = spark.createDataFrame([("q1", [1.0, 0.0], ["r1"]), ("q2", [1.0, 0.0], []), ("q3", None, ["r1"])], "query_id string, v array<float>, roles array<string>")
    assert [(r.query_id, r.chunk_id) for r in search.knn(v, qv).collect()] == [("q1", "1")]
    assert search.knn(v.limit(0), qv).count() == 0 and search.bm25(docs.limit(0), q).count() == 0 and search.bm25(docs, q.limit(0)).count() == 0


def test_fusion_gate_and_context(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, chunk_id string, bm25_rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, chunk_id string, ann_rank int")
    fused = search.rrf(a, b).orderBy("rrf_rank").collect()
    assert [r.chunk_id for r in fused] == ["y", "x", "z"] and fused[0].rrf_score == pytest.approx(1 / 61 + 1 / 62)
    r = spark.createDataFrame([("q", 0.5, 1), ("q", 0.1, 2), ("p", 0.49, 1)], "query_id string, relevance_score double, rank int")
    assert [x.query_id for x in search.gate(r).collect()] == ["q", "q"]
    with pytest.raises(ValueError):
        search.gate(r, 1.5)
    c = spark.createDataFrame([("q", 1, "c1", " one ", "f"), ("q", 2, None, "two", None), ("q", 3, "c3", " ", "f")], "query_id string, rank int, chunk_id string, content string, file_name string")
    assert search.context(c).first()["context"] == "[Source 1: f; chunk c1]\none\n[Source 2: Unknown document; chunk chunk-2]\ntwo"
    blank = spark.createDataFrame([("q", 1, "c1", " ", "f"), ("q", 2, "", "two", "")], "query_id string, rank int, chunk_id string, content string, file_name string")
    assert search.context(blank).first()["context"] == "[Source 2: Unknown document; chunk chunk-2]\ntwo"


def test_one_index_serves_many_blocks_of_questions(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame([(str(i), " ".join(rnd.choices(words, k=rnd.randint(1, 30))), f"f{i % 3}", "pdf", f"r{i % 2}") for i in range(120)], DOC)
    asked = spark.createDataFrame([(f"q{i}", " ".join(rnd.choices(words, k=3)), ["r0", "r1"][: 1 + i % 2]) for i in range(20)], "query_id string, query string, roles array<string>")
    stored = search.index(docs)
    once = search.content_bm25(stored, asked, 200).collect()
    assert sorted(once) == sorted(search.content_bm25(stored, asked, 200, block=7).collect())
    texts = {r.chunk_id: r.content.split() for r in docs.collect()}
    average = sum(map(len, texts.values())) / len(texts)
    q0 = asked.first()
    want = {}
    for c, t in texts.items():
        s = sum(math.log(1 + (120 - n + 0.5) / (n + 0.5)) * t.count(w) * 2.2 / (t.count(w) + 1.2 * (0.25 + 0.75 * len(t) / average)) for w in q0.query.split() if (n := sum(w in x for x in texts.values())))
        if s and f"r{int(c) % 2}" in q0.roles:
            want[c] = 4 * s
    assert {r.chunk_id: r.score for r in once if r.query_id == q0.query_id} == pytest.approx(want)


def test_memory(spark):
    rows = [("s", i, f"m{i}") for i in range(1, 14)] + [("t", 1, "only")]
    df = spark.createDataFrame(rows, "session string, ord long, m string")
    assert [r.m for r in memory.last_turns(df, ["session"], ["ord"], 3).where("session = 's'").orderBy("place").collect()] == ["m11", "m12", "m13"]
    last = memory.history_at(df, ["session"], ["ord"], F.col("m")).where("session = 's' and ord = 13").first()["history"]
    assert last == [f"m{i}" for i in range(13, 3, -1)]
    assert {(r.session, r.m) for r in memory.latest(df, ["session"], ["ord"]).collect()} == {("s", "m13"), ("t", "only")}
    lex = spark.createDataFrame([("q", "a", 2.0), ("q", "b", 1.0)], "query_id string, chunk_id string, bm25_score double")
    sem = spark.createDataFrame([("q", "b", 0.9), ("q", "c", 0.5), ("q", "d", 0.1)], "query_id string, chunk_id string, cosine double")
    assert [r.chunk_id for r in memory.recall(lex, sem).collect()] == ["b"]
    assert memory.scoped(spark.createDataFrame([("u", "s", " ")], "user_id string, session_id string, scope_id string"), "u", "s", " ").count() == 0
    prev = F.from_json(F.lit('{"topic":"old","context_summary":"c"}'), memory.SUMMARY)
    s = spark.range(1).select(memory.merged_summary(prev, F.lit('{"topic":"new"}'), F.lit("u"), F.lit("b"), F.lit(2)).alias("s")).first()["s"]
    assert (s["topic"], s["context_summary"], s["last_bot_message"]) == ("new", "c", "b")


def test_policy(spark):
    pol = spark.createDataFrame([("b", "f1", 2), ("a", "f1", 1), ("c", None, 3)], "role_name string, file_name string, position int")
    docs = spark.createDataFrame([(1, "f1", "x"), (2, "F1", "x"), (3, None, "x")], "id int, file_name string, document_role string")
    assert {(r.id, r.document_role) for r in policy.assign_roles(docs, pol).collect()} == {(1, "a"), (2, "bank_employee"), (3, "bank_employee")}
    users = spark.createDataFrame([("u", ["a", "zz"]), ("v", []), ("w", None)], "user_id string, roles array<string>")
    grants = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "nobody"), ("b", "b")], "role string, granted string")
    assert {r.user_id: r.permissions for r in policy.effective_permissions(users, grants).collect()} == {"u": ["a", "b"], "v": [], "w": []}
    assert policy.visible(docs, [], "file_name").count() == 0
    code = lambda o, a, c: spark.range(1).select(policy.admitted(F.lit(o).cast("string"), ["ok"], F.lit(a).cast("string"), F.lit(c).cast("string"))).first()[0]
    assert [code("ok", "Bearer t", None), code("bad", "bearer t", None), code(None, None, "c"), code("ok", None, None), code("ok", None, "c")] == [None, 4403, 4403, 4401, None]
    assert [code(None, "Bearer t", "c"), code(" ", "BEARER t", None), code(" ", None, "c"), code(None, "Bearer  ", None), code("", "Basic t", None), code("bad", None, None)] == [4403, None, 4403, 4401, 4401, 4403]


def test_one_live_connection_at_a_time(spark):
    start = datetime(2024, 1, 1)
    at = lambda m: None if m is None else start + timedelta(minutes=m)
    rows = [("s", "a", 0, 90), ("s", "b", 10, 20), ("s", "c", 89, 300), ("s", "d", 90, 95), ("s", "e", 96, None), ("s", "f", 9000, 9001), ("t", "g", 5, 4), ("t", "h", 5, 6), (None, "x", 1, 2), ("s", "y", None, 2)]
    df = spark.createDataFrame([(s, c, at(a), at(b)) for s, c, a, b in rows], "session_id string, connection_id string, ts timestamp, closed_at timestamp")
    live = policy.live_connections(df)
    assert {r.connection_id: r.close_code for r in live.collect()} == {"a": None, "b": 4409, "c": 4409, "d": None, "e": None, "f": 4409, "g": None, "h": None}
    said = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("s", None, 3)], "session_id string, connection_id string, n int")
    assert [r.n for r in policy.deliverable(said, live).collect()] == [1]
    assert {r.close_code for r in policy.live_connections(df.drop("closed_at").where("session_id = 's' and ts is not null")).collect()} == {None, 4409}


def test_components_that_do_not_settle_are_an_error(spark, monkeypatch):
    monkeypatch.setattr("larkspur.operators.components.MAX_ROUNDS", 1)
    with pytest.raises(RuntimeError, match="settled"):
        components(spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string"))


def test_quantiles_are_exact_at_any_accuracy(spark):
    rnd = random.Random(2)
    rows = [("a", rnd.expovariate(1) - 0.1) for _ in range(3000)] + [("b", 1.0)] * 50 + [("c", 7.0), ("c", None), (None, 3.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    for q in (0.0, 0.5, 0.95, 1.0):
        for accuracy in (20, 20_000):
            got = {r.k: r["quantile"] for r in metrics.quantile(df, ["k"], "v", q, accuracy).collect()}
            want = {k: float(np.quantile([max(0.0, v) for x, v in rows if x == k and v is not None], q)) for k in ("a", "b", "c", None)}
            assert got == pytest.approx(want)
    assert metrics.quantile(df.limit(0), ["k"], "v", 0.5).count() == 0


def test_sessions_are_cut_into_slices_and_blocks(spark):
    rnd, start = random.Random(3), datetime(2024, 1, 1)
    rows = [("s" if i % 3 else "t", start + timedelta(hours=rnd.randint(0, 90)), i) for i in range(200)] + [(None, start, 900), ("s", None, 901)]
    df = spark.createDataFrame(rows, "s string, ts timestamp, i long")
    got = {r.i: r.turn_no for r in memory.numbered(df, ["s"], ["ts", "i"], 7200).collect()}
    for s in ("s", "t", None):
        own = sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or start, r[2]))
        assert [got[r[2]] for r in own] == list(range(1, len(own) + 1))
    small = {r.i: r.history for r in memory.history_at(df, ["s"], ["ts", "i"], F.col("i"), 4, block=5).collect()}
    whole = {r.i: r.history for r in memory.history_at(df, ["s"], ["ts", "i"], F.col("i"), 4).collect()}
    assert small == whole and len(small) == len(rows)


def test_scaling_leaves_no_group_whole(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 2.0), ("b", 5.0), (None, 1.0)], "query_id string, x double")
    assert sorted((r.query_id, r.y) for r in memory.scaled(df, "x", "y").collect()) == [("a", 0.0), ("a", 0.5), ("a", 1.0), ("b", 1.0)]


def test_role_filter_reaches_the_scan(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, allowed_role string").write.parquet(str(tmp_path / "t"))
    df = policy.visible(spark.read.parquet(str(tmp_path / "t")), ["a", "b"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(allowed_role" in plan


def test_metrics_and_evaluation(spark):
    df = spark.createDataFrame([("a", 0.02), ("a", -1.0), ("a", 3.0), ("a", 20.0)], "k string, v double")
    h = {r.le: r.n for r in metrics.histogram(df, ["k"], "v").collect()}
    assert (h["0.005"], h["0.025"], h["5.0"], h["10.0"], h["inf"]) == (1, 2, 3, 3, 4)
    assert metrics.bucket_quantile(metrics.histogram(df, ["k"], "v"), ["k"], 0.5).first()["quantile"] == pytest.approx(0.025)
    spans = spark.createDataFrame([("d", i, "line", s) for i, s in enumerate([10.0, 10.0, 10.0, 12.0, 13.5])] + [("d", 5, "line", 10.0), ("d", 9, "ends.", 20.0), ("e", 0, "x", 0.0)], "doc_id string, ord int, text string, size double")
    assert {(r.doc_id, r.ord): r.heading_level for r in metrics.heading_levels(spans).collect()} == {("d", 0): None, ("d", 1): None, ("d", 2): None, ("d", 3): 2, ("d", 4): 1, ("d", 5): None, ("d", 9): None, ("e", 0): None}
    up = evaluation.upsert(spark.createDataFrame([(1, 1, "old")], "k int, t int, v string"), spark.createDataFrame([(1, 2, "new"), (2, 1, "x")], "k int, t int, v string"), ["k"], ["t"])
    assert {(r.k, r.v) for r in up.collect()} == {(1, "new"), (2, "x")}
    hits = spark.createDataFrame([("q", "a", 1), ("q", "b", 6)], "query_id string, item string, rank int")
    truth = spark.createDataFrame([("q", "a"), ("q", "b"), ("p", "c")], "query_id string, item string")
    assert {r.query_id: r.recall for r in evaluation.recall_at_k(hits, truth, 5).collect()} == {"q": 0.5, "p": 0.0}


def test_routes(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(routing.route_intent(F.lit("greeting"))) == "small_talk" and one(routing.route_intent(F.lit("task_execute"))) == "knowledge"
    assert one(routing.refined(F.lit("q"), F.lit(" "))) == "q" and one(routing.error_outcome(F.lit("ReadTimeoutError"))) == "timeout"
    assert one(routing.fallback(F.lit("low_relevance"), F.lit("x"), F.lit("y"))) == routing.LOW_RELEVANCE and one(routing.synthesized(F.lit(0), F.lit("c"), F.lit("a"))) == routing.NO_CONTEXT
    with pytest.raises(Exception, match="no reader"):
        one(routing.extractor(F.lit("txt")))
    q = spark.createDataFrame([("1", "open an account"), ("2", "zzz"), ("3", "id 2345 6789 0123 account"), ("4", None)], "query_id string, query string")
    tax = spark.createDataFrame([("open", ["open account", "new account"]), ("close", ["close it"])], "intent string, examples array<string>")
    assert {r.query_id: r.intent for r in routing.classify(q, tax).collect()} == {"1": "open", "2": "generic_query", "3": "open", "4": "generic_query"}
    assert {r.query_id: r.query for r in routing.classify(q, tax).collect()}["3"] == "id <IN_AADHAAR> account"
    said = lambda c: F.when(c.contains("zzz"), '{"intent":"made up","confidence":"high"}').when(c.contains("open"), '{"intent":"open","confidence":7}')
    assert sorted((r.query_id, r.intent, r.confidence) for r in routing.classified(q, ["open"], said).collect()) == [("1", "open", 1.0), ("2", "generic_query", 0.0), ("3", "generic_query", 0.0), ("4", "generic_query", 0.0)]
    status = lambda dry, n, bad: one(routing.run_status(F.lit(dry), F.lit(n), F.lit(bad)))
    assert [status(*x) for x in ((True, 2, 1), (True, 2, 0), (False, 0, 3), (False, 2, 1), (False, 2, 0))] == ["DRY_RUN_PARTIAL", "DRY_RUN", "NO_FILES", "FAILED", "PUBLISHED"]


def test_taxonomy(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"open": {"description": "d", "examples": ["open account"]}, "close": ["close it"], "none": {}}')
    assert {r.intent: r.examples for r in routing.taxonomy(spark, str(tmp_path / "t.json")).collect()} == {"open": ["open account"], "close": ["close it"], "none": []}
    assert routing.taxonomy(spark, str(tmp_path / "missing.json")).count() == 0
