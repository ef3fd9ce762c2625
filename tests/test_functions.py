import base64
import hashlib
import hmac
import json

import pytest
from pyspark.sql import functions as F

from larkspur import models
from larkspur.functions import crypto, pii, scores
from larkspur.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("text,expected", [("a-\nb  c\r\nd ", "ab c\n\nd"), ("a-\r\nb", "a-\n\nb"), (None, ""), (" x ", "x")])
def test_normalize(spark, text, expected):
    assert one(spark, T.normalize(F.lit(text).cast("string"))) == expected


def test_keys_and_sentences(spark):
    assert one(spark, T.dedup_key(F.lit("A & B,\tC²"))) == "a  b c²"
    assert one(spark, T.sentences(F.lit("One. Two! Three? 4.5 five"))) == ["One.", "Two!", "Three?", "4.5 five"]
    assert one(spark, T.paragraphs(F.lit("a\n\n b \n\n"))) == ["a", "b"] and one(spark, T.paragraphs(F.lit("a\nb"))) == ["a\nb"] and one(spark, T.paragraphs(F.lit(""))) == [""]
    assert one(spark, T.overlap_tail(F.lit("one two three"), 7)) == "three" and one(spark, T.overlap_tail(F.lit("abc"), 7)) == "abc"
    assert [one(spark, T.is_heading(F.lit(x))) for x in ("Chapter 2 Fees", "8.1 Identity data", "8. Data", "8. data here", "A line.")] == [True, True, True, False, False]
    assert one(spark, T.alias_name(F.lit("My KB.v1"))) == "my_kb_v1_live"
    assert one(spark, T.normalized_tags(F.array(F.lit("ATM Fees"), F.lit(" atm   fees "), F.lit("Withdrawal"), F.lit(" ")))) == ["atm fees", "withdrawal"]


def test_scores(spark):
    assert one(spark, scores.sigmoid(F.lit(1000.0))) == pytest.approx(1.0) and one(spark, scores.sigmoid(F.lit(0.0))) == 0.5
    assert one(spark, scores.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert [one(spark, scores.confidence(F.lit(x))) for x in ("0.4", "7", "-1", "x")] == [0.4, 1.0, 0.0, 0.0]


def test_signed_requests(spark):
    secret = "s" * 32
    fields = "session_id string, connection_id string, message string, user_id string, roles array<string>, allowed_roles array<string>, issued_at long"
    rows = [("s", "c", "hi", "u", ["a"], ["a"], 1000), ("s", "c", " ", "u", ["a"], ["a"], 1000), ("s", "c", "hi", "u", ["a"], ["a"], 900), ("s", "c", "hi", "u", ["a"], ["z"], 1000), ("s", "c", "hi", "u", ["a"], [], 1000)]
    df = spark.createDataFrame(rows, fields).withColumn("signature", crypto.sign(crypto.request_body(), secret))
    reasons = lambda d, now: [r[0] for r in d.select(crypto.reject_reason(secret, F.lit(now), F.array(F.lit("a")), F.array(F.lit("a")))).collect()]
    assert reasons(df, 1060) == [None, "message missing", "too old", "unknown role", "unknown role"]
    assert reasons(df, 1061)[0] == "too old" and reasons(df.withColumn("message", F.lit("changed")), 1000)[0] == "signature wrong"
    assert reasons(df.withColumn("signature", F.lit(None).cast("string")), 1000)[0] == "signature missing"
    plain = base64.urlsafe_b64encode(hmac.new(secret.encode(), b"x", hashlib.sha256).digest()).rstrip(b"=").decode()
    assert one(spark, crypto.sign(F.lit("x"), secret)) == plain
    with pytest.raises(ValueError):
        crypto.sign(F.lit("x"), "short")


def test_keys_and_claims(spark):
    key = lambda q, s, chat="c", **k: one(spark, crypto.cache_key(F.lit(q).cast("string"), F.lit(s), "kb_live", chat, "e", "r", **k))
    assert key("  What  IS it ", "s") == key("what is it", "s") != key("what is it", "s", version="2")
    assert key("q", "s") != key("q", "s", chat="other")
    fields = {"query": "शुल्क क्या है? 😀", "permission_scope": "s", "index": "kb_live", "gemini_model": "c", "embedding_model": "e", "reranker_model": "r", "retrieval_threshold": "0.5", "top_k": "5", "candidate_k": "50", "cache_version": "1"}
    assert key("शुल्क  क्या है? 😀", "s") == "rag:answer:" + hashlib.sha256(json.dumps(fields, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert key(" ", "s") is None and key("q", " ") is None and key(None, "s") is None
    assert crypto.scope_id(1, ["b", "a", "a"], {}, {}, {}) == crypto.scope_id(1, ["a", "b"], {}, {}, {}) != crypto.scope_id(2, ["a", "b"], {}, {}, {})
    roles = lambda text, **k: one(spark, crypto.claim_roles(F.lit(text), **k))
    assert roles('{"realm":{"roles":["b"," a ","b"]}}', path="realm.roles") == ["a", "b"] and roles('{"roles":"x"}') == ["x"] == roles('{"role":"x"}')
    assert roles('{"sub":"u"}') == [] == roles('{"roles":[]}') and roles('{"roles":null,"role":["y"]}') == ["y"]
    assert [roles(x) for x in ('{"roles":["a",""]}', '{"roles":["a",5]}', '{"roles":5}', '{"roles":{"a":1}}', '{"role":null}', "no json")] == [None] * 6
    df = spark.createDataFrame([(["b", "a"],), (["a", "b", "a"],), (["c"],), (None,)], "roles array<string>")
    scopes = [r[0] for r in df.select(crypto.scope_column(F.col("roles"), 1, {"m": ["f"]}, {}, {})).collect()]
    assert scopes[0] == scopes[1] == crypto.scope_id(1, ["a", "b"], {"m": ["f"]}, {}, {}) != scopes[2] and scopes[3] is None


def test_the_signed_body_is_plain_json(spark):
    names = "session_id string, connection_id string, message string, user_id string, roles array<string>, allowed_roles array<string>, issued_at long"
    rows = [("s", None, 'शुल्क "क्या" \\ है? 😀\x01', "u", ["b", "a"], [], 1000), ("s", "c", "m", "u", None, ["a"], None)]
    got = [json.loads(json.dumps(r[0])) for r in spark.createDataFrame(rows, names).select(crypto.request_body()).collect()]
    fields = [n.split()[0] for n in names.split(", ")]
    assert got == [json.dumps(dict(zip(fields, r)), sort_keys=True, separators=(",", ":")) for r in rows]


def test_headers(spark):
    df = spark.createDataFrame([([("a", bytearray(b"1")), ("b", None), ("a", bytearray(b"2"))],), (None,)], "h array<struct<key:string,value:binary>>")
    assert [r[0] for r in df.select(crypto.trace_headers(F.col("h"))).collect()] == [{"a": "2"}, None]
    assert one(spark, crypto.with_trace(F.create_map(F.lit("k"), F.lit("v"))))[0]["value"] == b"v"


def test_personal_data_of_a_fixed_form(spark):
    cases = {
        "write to a.b+c@x-y.co.in now": "write to <EMAIL_ADDRESS> now", "id 2345 6789 0123 and ABCDE1234F": "id <IN_AADHAAR> and <IN_PAN>", "see https://a.b/c?d=1.": "see <URL>.", "card 4111-1111-1111-1111": "card <CREDIT_CARD>",
        "IBAN DE89 3704 0044 0532 0130 00": "IBAN <IBAN_CODE>", "ssn 123-45-6789": "ssn <US_SSN>", "from 10.0.0.1": "from <IP_ADDRESS>", "call +44 20 7946 0958": "call <PHONE_NUMBER>", "call 98765 43210": "call <PHONE_NUMBER>",
        "fee of 1200 in 2024": "fee of 1200 in 2024",
    }
    for text, want in cases.items():
        assert one(spark, pii.redact(F.lit(text))) == want
    assert one(spark, pii.redact(F.lit(None).cast("string"))) is None and one(spark, pii.redact(F.lit("Ann"), lambda c: F.regexp_replace(c, "Ann", "<PERSON>"))) == "<PERSON>"


def test_model_slots(spark):
    df = spark.createDataFrame([("a b",), (None,), ("",)], "t string")
    v = [r[0] for r in df.select(models.embedder(dims=8)(F.col("t"))).collect()]
    assert len(v[0]) == 8 and v[1] is None and len(v[2]) == 8
    with pytest.raises(Exception, match="one vector"):
        df.select(models.embedder(lambda texts: [[1.0]] * len(texts), 8)(F.col("t"))).collect()
    assert [r[0] for r in df.select(models.text_model(lambda p: 1 / 0)(F.coalesce("t", F.lit("")))).collect()] == ["", "", ""]
    assert [models.vision(m)(b"x", "before") for m in (lambda b, t: f" {t} ", lambda b, t: None, lambda b, t: 1 / 0)] == ["\n[IMAGE ANALYSIS: before]\n", "", ""]
