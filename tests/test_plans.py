import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur import models
from larkspur.functions import crypto
from larkspur.operators import memory, routing
from larkspur.plans import evaluate, ingest, requests
from larkspur.sources import generations, topics
from larkspur.sources.objects import ObjectStore
from larkspur.streaming import chat
from tests import pdfs
from tests.test_sources import docx, pptx


def test_ingest_publishes_and_failures_leave_the_live_generation(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(docx())
    (folder / "b.pptx").write_bytes(pptx())
    (folder / "c.pdf").write_bytes(pdfs.pdf(pdfs.TWO_PAGES))
    roles = spark.createDataFrame([("staff", "a.docx", 1)], "role_name string, file_name string, position int")
    store = generations.Generations(spark, f"file://{tmp_path}/kb", "kb")
    embed = models.embedder(dims=8)
    run = lambda where=folder, dims=8, **more: ingest.ingest(spark, str(where), roles, store, embed, dims, **more)
    assert run(tmp_path / "none").status == "NO_FILES"
    assert run(dry_run=True).status == "DRY_RUN" and store.live() is None
    done = run()
    rows = store.read().collect()
    assert done.status == "PUBLISHED" and done.files == 3 and len(rows) == done.chunks and {r.allowed_role for r in rows} == {"staff", "bank_employee"}
    assert any("First (body) line" in r.content for r in rows) and set(done.seconds) == {"extract", "chunk", "embed", "publish"}
    with pytest.raises(Exception):
        run(dims=9)
    assert store.live() == done.generation
    # One bad file: a preview goes on, a rebuild doesn't.
    (folder / "bad.docx").write_bytes(b"no document")
    (folder / "empty.pdf").write_bytes(pdfs.pdf(["BT ET"]))
    preview = run(dry_run=True)
    assert (preview.status, preview.files, preview.failed) == ("DRY_RUN_PARTIAL", 3, ["bad.docx", "empty.pdf"])
    with pytest.raises(ingest.Failed, match="2 files failed, among them bad.docx, empty.pdf"):
        run()
    assert store.live() == done.generation
    only_bad = tmp_path / "bad"
    only_bad.mkdir()
    (only_bad / "bad.docx").write_bytes(b"no document")
    assert run(only_bad).status == "NO_FILES"


SECRET = "k" * 32
REQUEST = "session_id string, connection_id string, message string, user_id string, roles array<string>, allowed_roles array<string>, issued_at long"


def corpus(spark, embed):
    docs = spark.createDataFrame([("1", "the alpha fee is what it is", "f1", "pdf", "r1"), ("2", "the alpha fee for others", "f2", "pdf", "r2"), ("3", "about the beta charge", "f3", "pdf", "r1")], "chunk_id string, content string, file_name string, file_type string, allowed_role string")
    taxonomy = spark.createDataFrame([("greeting", ["hello there"]), ("fees", ["what is the fee"])], "intent string, examples array<string>")
    return docs, docs.select("chunk_id", embed(F.col("content")).alias("v"), "allowed_role"), taxonomy


def empty_stores(spark):
    return requests.Stores(spark.createDataFrame([], requests.ENTRY), spark.createDataFrame([], requests.TURN), spark.createDataFrame([], requests.SESSION))


def key(query, scope):
    return crypto.cache_key(query, scope, "kb_live", "c", "e", "r")


def answers(spark, rows, stores, slots, embed, **more):
    signed = spark.createDataFrame(rows, REQUEST).withColumn("signature", crypto.sign(crypto.request_body(), SECRET))
    judged = requests.admitted(signed, SECRET, F.lit(1001), ["r1", "r2"], F.array(F.lit("r1")))
    docs, vectors, _ = corpus(spark, embed)
    return judged, requests.answer(judged.where("reject_reason is null").withColumn("scope_id", F.lit("x")), docs, vectors, stores, slots, key, F.lit(1001), **more)


def test_requests(spark):
    embed = models.embedder(dims=8)
    taxonomy = corpus(spark, embed)[2]
    slots = requests.Models(lambda q: routing.classify(q, taxonomy), embed, models.text_model(lambda prompts: [f"composed {p[:14]}" for p in prompts]))
    rows = [("s1", "c", "What is the alpha fee", "u", ["r1"], ["r1"], 1000), ("s2", "c", "hello there", "u", ["r1"], ["r1"], 1000), ("s3", "c", "zzz", "u", ["r1"], ["r1"], 1000), ("s4", "c", "late", "u", ["r1"], ["r1"], 1), ("s5", "c", "what IS the  alpha fee", "u", ["r1"], ["r1"], 1001), ("s6", "c", "my id 2345 6789 0123 alpha fee", "u", ["r1"], ["r1"], 1000)]
    judged, done = answers(spark, rows, empty_stores(spark), slots, embed)
    assert [r.response for r in requests.refused(judged).collect()] == [routing.REFUSED]
    out = {r.session_id: r for r in done.responses.collect()}
    assert set(out) == {"s1", "s2", "s3", "s5", "s6"}
    assert out["s1"].response == "composed What is the al" and out["s1"].sources[0].chunk_id == "1"
    assert out["s5"].response == out["s1"].response  # the second of two equal questions finds the answer of the first
    assert out["s2"].intent == "greeting" and out["s2"].sources == [] and out["s2"].response.startswith("composed")
    assert out["s3"].sources == [] and out["s3"].response == routing.LOW_RELEVANCE
    entries = {r.response for r in done.entries.collect()}
    assert "composed What is the al" in entries and not any("zzz" in e for e in entries)
    turns = {r.session_id: r for r in done.turns.collect()}
    assert set(turns) == set(out) and turns["s6"].user_message.startswith("my id 2345") and len(turns["s1"].combined_embedding) == 8 and turns["s1"].timestamp.tzinfo is None


def test_answers_come_from_the_cache_while_they_live(spark):
    embed = models.embedder(dims=8)
    taxonomy = corpus(spark, embed)[2]
    slots = requests.Models(lambda q: routing.classify(q, taxonomy), embed, models.text_model(lambda prompts: ["new"] * len(prompts)))
    rows = [("s1", "c", "What is the alpha fee", "u", ["r1"], ["r1"], 1000)]
    entry = lambda response, passed, at, q="what is the alpha fee": spark.range(1).select(key(F.lit(q), F.lit("x")).alias("cache_key"), F.lit(response).alias("response"), F.array(F.struct(F.lit("f9").alias("file_name"), F.lit("9").alias("chunk_id"))).alias("sources"), F.lit(passed).alias("retrieval_passed"), F.lit(at).cast("long").alias("written_at"))
    for stored, want in (((("old", True, 500), ("older", True, 400)), "old"), ((("old", True, 101),), "new"), ((("old", False, 1000),), "new"), (((" ", True, 1000),), "new"), ((("old", True, 1000, "other"),), "new")):
        stores = empty_stores(spark)
        for e in stored:
            stores.entries = stores.entries.unionByName(entry(*e))
        done = answers(spark, rows, stores, slots, embed)[1]
        got = done.responses.first()
        assert got.response == want and (want == "new") == (done.entries.count() == 1) and got.sources[0].chunk_id == ("9" if want == "old" else "1")


def test_follow_up_questions_are_refined_from_memory_and_not_cached(spark):
    embed = models.embedder(dims=8)
    taxonomy = corpus(spark, embed)[2]

    @F.pandas_udf("string")
    def refine(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: json.dumps({"should_refine": True, "refined_query": " what is the alpha fee "}) if "earlier topic" in p and "told before" in p else "no json")

    slots = requests.Models(lambda q: routing.classify(q, taxonomy), embed, models.text_model(lambda prompts: [f"on {p[:21]}" for p in prompts]), refine, models.text_model(lambda prompts: ['{"topic": "fees"}'] * len(prompts)))
    first = answers(spark, [("s1", "c", "and how much is it then", "u", ["r1"], ["r1"], 1000)], empty_stores(spark), slots, embed)[1]
    assert first.responses.first().response == routing.LOW_RELEVANCE
    stores = empty_stores(spark)
    stores.turns = spark.createDataFrame([("u", "s1", "x", f"t{i}", "and how much is it then", "told before", 990 + i) for i in range(3)], "user_id string, session_id string, scope_id string, turn_id string, user_message string, bot_response string, at long")
    stores.turns = memory.with_embeddings(stores.turns, embed)
    state = spark.range(1).select(F.lit("u").alias("user_id"), F.lit("s1").alias("session_id"), F.lit("x").alias("scope_id"), F.from_json(F.lit('{"turn_number": 4, "topic": "earlier topic", "context_summary": "c", "entities": ["e"]}'), requests.STATE).alias("state"))
    stores.sessions = state
    done = answers(spark, [("s1", "c", "and how much is it then", "u", ["r1"], ["r1"], 1000), ("s1", "c", "and then", "u", ["r1"], ["r1"], 1001)], stores, slots, embed)[1]
    said = {r.response for r in done.responses.collect()}
    assert "on what is the alpha fee" in said and done.entries.count() == 0
    s = done.sessions.collect()
    assert len(s) == 1 and (s[0].state.turn_number, s[0].state.topic, s[0].state.context_summary, s[0].state.entities, s[0].state.last_user_message) == (6, "fees", "c", ["e"], "and then")


def test_the_chat_stream_remembers_across_batches(spark, tmp_path):
    embed = models.embedder(dims=8)
    docs, vectors, taxonomy = corpus(spark, embed)
    slots = requests.Models(lambda q: routing.classify(q, taxonomy), embed, models.text_model(lambda prompts: ["composed"] * len(prompts)))
    folder, store = str(tmp_path / "topics"), str(tmp_path / "store")
    serve = lambda: chat.serve(spark, folder, str(tmp_path / "c"), store, SECRET, ["r1", "r2"], F.array(F.lit("r1")), F.lit("x"), docs, vectors, slots, key, F.lit(1001))
    headers = F.array(F.struct(F.lit("traceparent").alias("key"), F.lit("00-1").cast("binary").alias("value")))
    send = lambda *rows: chat.send(spark.createDataFrame(list(rows), REQUEST), folder, SECRET, headers)
    send(("s1", "c1", "what is the alpha fee", "u", ["r1"], ["r1"], 1000), ("s2", "c2", "hello there", "u", ["r1"], ["r2"], 1000))
    assert serve() == 1
    send(("s1", "c1", "what is the alpha fee", "u", ["r1"], ["r1"], 1001))
    assert serve() == 1 and serve() == 0
    messages = spark.read.schema(topics.MESSAGE).json(f"{folder}/{chat.RESPONSES}")
    assert messages.count() == 3 and all(bytes(h["value"]) == b"00-1" for r in messages.collect() for h in r["headers"])
    live = spark.createDataFrame([("s1", "c1", None), ("s2", "c2", 4409)], "session_id string, connection_id string, close_code int")
    assert [r.response for r in chat.responses(messages, live).collect()] == ["composed"] * 2
    kept = chat.stores(spark, store)
    assert kept.entries.count() == 1 and kept.turns.count() == 2 and kept.sessions.first().state.turn_number == 2  # the second answer came from the cache
    waiting = spark.createDataFrame([("s1", "c1", "m", 2000), ("s1", "c1", " ", 2000), ("s1", "c1", "m", 900), ("s2", "c2", "m", 2000)], "session_id string, connection_id string, message string, expires_at long")
    assert requests.readable_messages(waiting, live, F.lit(1001)).count() == 1


def test_evaluation_run(spark, tmp_path):
    embed = models.embedder(dims=8)
    docs, vectors, taxonomy = corpus(spark, embed)
    slots = requests.Models(lambda q: routing.classify(q, taxonomy), embed, models.text_model(lambda prompts: ["composed"] * len(prompts)))
    case = "id string, input string, expected_output string, source_documents array<string>, source_url string"
    cases = spark.createDataFrame([("a", "what is the alpha fee", "it is", ["f1"], None), ("b", "what is the alpha fee", " ", ["f1"], None), ("c", "zzz", "x", None, "u")], case)
    judge = lambda name: F.when(F.col("response").isNotNull(), F.lit(1.0 if name == "Faithfulness" else 0.5))
    found = {r.golden_case_id: r for r in evaluate.records(cases, ["r1"], docs, vectors, slots, judge, "run").collect()}
    assert [found[i].status for i in "abc"] == ["completed", "completed", "failed"] and found["c"].error == "no passage was retrieved" and found["c"].metrics is None
    assert [m.status for m in found["a"].metrics] == ["completed"] * 6 and [m.status for m in found["b"].metrics] == ["completed"] * 3 + ["skipped"] * 3
    assert found["a"].metrics[0].score == 1.0 and found["a"].passages[0].chunk_id == "1" and found["a"].case_number == 1
    new = evaluate.records(cases, ["r1"], docs, vectors, slots, judge, "run")
    save = lambda rows: rows.write.mode("overwrite").parquet(str(tmp_path / "results"))
    with pytest.raises(RuntimeError, match="case 3 failed"):
        evaluate.run(new.limit(0), new, save)
    assert spark.read.parquet(str(tmp_path / "results")).count() == 3


def test_long_term_memory_is_scoped(spark):
    turns = spark.createDataFrame([("t1", "u", "s", "x", "alpha fee", "beta", [1.0, 0.0]), ("t2", "u", "s", "y", "alpha fee", "beta", [1.0, 0.0]), ("t3", "u", "s", " ", "alpha fee", None, None)], "turn_id string, user_id string, session_id string, scope_id string, user_message string, bot_response string, combined_embedding array<float>")
    q = spark.createDataFrame([("q", "alpha", "u", "s", "x", [1.0, 0.1]), ("p", "alpha", "u", "s", " ", [1.0, 0.1])], "query_id string, query string, user_id string, session_id string, scope_id string, v array<float>")
    assert [(r.query_id, r.chunk_id) for r in memory.lexical(turns, q).collect()] == [("q", "t1")]
    assert [(r.query_id, r.chunk_id) for r in memory.semantic(turns, q).collect()] == [("q", "t1")]
    assert [r.chunk_id for r in memory.recall(memory.lexical(turns, q), memory.semantic(turns, q)).collect()] == ["t1"]


def test_member_tags_keep_first_sight(spark):
    clusters = spark.createDataFrame([("k", ["b", "a"])], "cluster_id string, chunk_ids array<string>")
    chunks = spark.createDataFrame([("a", ["fees", "cards"]), ("b", ["fees", "atm"])], "chunk_id string, tags array<string>")
    assert memory.member_tags(clusters, chunks).first()["tags"] == ["fees", "atm", "cards"]


def test_object_store(spark, tmp_path):
    store = ObjectStore(spark, f"file://{tmp_path}/bucket")
    (tmp_path / "x.bin").write_bytes(b"content")
    store.put(str(tmp_path / "x.bin"), "dir/x.bin")
    assert store.get("dir/x.bin") == b"content"
    store.download("dir/x.bin", str(tmp_path / "y.bin"))
    assert (tmp_path / "y.bin").read_bytes() == b"content"
    for missing in (lambda: store.put(str(tmp_path / "no"), "a"), lambda: store.get("no")):
        with pytest.raises(FileNotFoundError):
            missing()
