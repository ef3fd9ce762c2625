"""Hashes, signatures and canonical keys."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from larkspur.functions.text import ascii_json, query_key

CACHE_PREFIX = "rag:answer:"
SECRET_LENGTH = 32
MAX_AGE_SECONDS = 60


def canonical_json(value: object) -> str:
    """JSON with sorted keys and no blanks."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def scope_id(version: int, roles: list[str], roles_mapping: dict, role_permissions: dict, defaults: dict) -> str:
    """Identity of a memory scope: changes with the roles or with any part of the policy."""
    # The names of the fields that make up a scope.
    content = {"version": version, "allowed_roles": sorted(set(roles)), "document_role_assignments": roles_mapping, "role_permissions": role_permissions, "security_defaults": defaults}
    return hashlib.sha256(canonical_json(content).encode()).hexdigest()


def scope_column(roles: Column, version: int, roles_mapping: dict, role_permissions: dict, defaults: dict) -> Column:
    """Scope id of each row's roles. The policy, a configuration file, travels with the function; a task hashes each set of roles once."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[tuple, str] = {}
        for s in batches:
            keys = [None if x is None else tuple(sorted(set(x))) for x in s]
            known |= {k: scope_id(version, list(k), roles_mapping, role_permissions, defaults) for k in set(keys) - known.keys() - {None}}
            yield pd.Series([known.get(k) for k in keys], dtype=object)

    return run(roles)


def cache_key(query: Column, scope: Column, index: str, chat_model: str, embedding_model: str, reranker_model: str, threshold: str = "0.5", top_k: str = "5", candidate_k: str = "50", version: str = "1") -> Column:
    """Key of an answer: hash of the normalised question, the scope and all that answers depend on; null without question or scope."""
    # The names of the fields that make up a key.
    fields = {
        "query": query_key(query), "permission_scope": scope, "index": F.lit(index), "gemini_model": F.lit(chat_model), "embedding_model": F.lit(embedding_model), "reranker_model": F.lit(reranker_model),
        "retrieval_threshold": F.lit(threshold), "top_k": F.lit(top_k), "candidate_k": F.lit(candidate_k), "cache_version": F.lit(version),
    }
    body = ascii_json(F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields)))))
    usable = (F.coalesce(query_key(query), F.lit("")) != "") & (F.coalesce(F.trim(scope), F.lit("")) != "")
    return F.when(usable, F.concat(F.lit(CACHE_PREFIX), F.sha2(body, 256)))


def signature(body: str, secret: str) -> str:
    digest = hmac.new(secret.encode(), body.encode(), hashlib.sha256).digest()
    return base64.urlsafe_b64encode(digest).rstrip(b"=").decode()


def sign(body: Column, secret: str) -> Column:
    """HMAC-SHA256 of a text, base64url without padding. The secret travels with the function, not with the data."""
    if len(secret) < SECRET_LENGTH:
        raise ValueError(f"the secret must have at least {SECRET_LENGTH} characters")

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: None if x is None else signature(x, secret))

    return run(body)


#: The signed fields of a request.
SIGNED = ("allowed_roles", "connection_id", "issued_at", "message", "roles", "session_id", "user_id")


def request_body() -> Column:
    """The signed part of a request row: canonical JSON of its fields, nulls included."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in batches:
            yield pd.Series([canonical_json({n: _plain(n, v) for n, v in zip(SIGNED, r)}) for r in rows[list(SIGNED)].itertuples(index=False, name=None)], dtype=object)

    # Numbers travel as text: a null would turn a whole batch of them into floating-point numbers.
    return run(F.struct(*(F.col(n).cast("string").alias(n) if n == "issued_at" else F.col(n) for n in SIGNED)))


def _plain(name: str, value: object) -> object:
    if value is None:
        return None
    if name == "issued_at":
        return int(value)
    return value if isinstance(value, str) else list(value)


def reject_reason(secret: str, now: Column, known_roles: Column, expected_roles: Column) -> Column:
    """Why a signed request row is refused; null if it is accepted. The first failing check names the reason."""
    blank = lambda n: F.coalesce(F.trim(n), F.lit("")) == ""
    reasons = [
        (blank("signature"), "signature missing"),
        (F.col("signature") != sign(request_body(), secret), "signature wrong"),
        (F.col("issued_at").isNull() | (F.abs(now - F.col("issued_at")) > MAX_AGE_SECONDS), "too old"),
        *((blank(n), f"{n} missing") for n in ("session_id", "connection_id", "message", "user_id")),
        (F.col("roles").isNull(), "roles missing"),
        (F.col("allowed_roles").isNull(), "allowed roles missing"),
        ((F.size("allowed_roles") == 0) | (F.size(F.array_except("allowed_roles", known_roles)) > 0), "unknown role"),
        (F.array_sort("allowed_roles") != expected_roles, "roles don't match the policy"),
    ]
    out = F.when(*_when(reasons[0]))
    for r in reasons[1:]:
        out = out.when(*_when(r))
    return out


def _when(reason: tuple[Column, str]) -> tuple[Column, str]:
    return reason


def claim_roles(claims: Column, path: str = "roles", fallback: str = "role") -> Column:
    """Roles of a token's claims (JSON): a list or a single name under a dotted path, else under ``fallback``; stripped,
    distinct, sorted. No claim at all gives no roles; anything but names that aren't blank gives null: refused."""
    parsed = F.try_parse_json(claims)
    part = lambda name: F.try_variant_get(parsed, "$." + name, "variant")
    own, other = F.schema_of_variant(part(path)), F.schema_of_variant(part(fallback))
    found = own.isNotNull() & (own != "VOID")
    node, kind = F.when(found, part(path)).otherwise(part(fallback)), F.when(found, own).otherwise(other)
    names = F.when(kind == "STRING", F.array(F.try_variant_get(node, "$", "string"))).when(kind == "ARRAY<STRING>", F.try_variant_get(node, "$", "array<string>")).when(kind.isNull() & parsed.isNotNull() | (kind == "ARRAY<VOID>"), F.array().cast("array<string>"))
    clean = F.transform(names, lambda r: F.trim(r))
    return F.when(~F.exists(clean, lambda r: r.isNull() | (r == "")), F.array_sort(F.array_distinct(clean)))


def trace_headers(headers: Column) -> Column:
    """Trace context of message headers (array of key and binary value): a map without null values; of equal keys the last."""
    there = F.filter(headers, lambda h: h["value"].isNotNull())
    kept = F.filter(there, lambda h, i: ~F.exists(F.slice(there, i + 2, F.size(there)), lambda later: later["key"] == h["key"]))
    return F.map_from_entries(F.transform(kept, lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value"))))


def with_trace(carrier: Column) -> Column:
    """Headers of a trace context map."""
    return F.transform(F.map_entries(carrier), lambda e: F.struct(e["key"].alias("key"), e["value"].cast("binary").alias("value")))
