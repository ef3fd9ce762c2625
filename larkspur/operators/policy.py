"""Document roles, permissions and the filters that follow from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.operators import chains

FALLBACK_ROLE = "bank_employee"


def document_roles(policy: DataFrame) -> DataFrame:
    """``policy``: role_name, file_name and ``position`` (order in the policy). The first role that names a file, per file."""
    return policy.where(F.col("file_name").isNotNull()).groupBy("file_name").agg(F.min_by("role_name", F.struct("position", "role_name")).alias("document_role"))


def assign_roles(documents: DataFrame, policy: DataFrame, file_name: str = "file_name", fallback: str = FALLBACK_ROLE) -> DataFrame:
    """Every document with its ``document_role``; files outside the policy get the fallback. File names match exactly.

    The policy side is one row per file and left to the optimizer's size check for broadcasting.
    """
    roles = document_roles(policy).toDF("_policy_file", "_policy_role")
    joined = documents.join(roles, F.col(file_name) == F.col("_policy_file"), "left")
    return joined.withColumn("document_role", F.coalesce("_policy_role", F.lit(fallback))).drop("_policy_file", "_policy_role")


def effective_permissions(users: DataFrame, permissions: DataFrame) -> DataFrame:
    """``users``: user_id, roles; ``permissions``: role, granted (rows). Returns user_id and the sorted roles it may read.

    Grants of all the user's roles together, of which only those count that are roles themselves; unknown roles add
    nothing, and a user without any keeps an empty list.
    """
    known = permissions.select(F.col("role").alias("granted")).distinct()
    granted = users.select("user_id", F.explode("roles").alias("role")).distinct().join(permissions, "role").select("user_id", "granted").distinct().join(known, "granted", "left_semi")
    found = granted.groupBy("user_id").agg(F.array_sort(F.collect_set("granted")).alias("permissions"))
    return users.select("user_id").distinct().join(found, "user_id", "left").withColumn("permissions", F.coalesce("permissions", F.array().cast("array<string>")))


def policy_violations(permissions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Grants that name no document role; a sound policy has none."""
    return permissions.join(mapping.select(F.col("role_name").alias("granted")).distinct(), "granted", "left_anti").select("role", "granted")


def visible(rows: DataFrame, roles: list[str], column: str = "allowed_role") -> DataFrame:
    """Rows that one of the roles may read; no roles, no rows. Goes before any ranking, and reaches the scan."""
    return rows.where(F.col(column).isin(roles)) if roles else rows.where(F.lit(False))


def subset(a: Column, b: Column) -> Column:
    """Whether every element of ``a`` is in ``b``."""
    return F.size(F.array_except(a, b)) == 0


def matches_policy(allowed: Column, known: Column, expected: Column) -> Column:
    """Whether a request's roles are known document roles, not empty, and the ones that the policy gives."""
    return (F.size(allowed) > 0) & subset(allowed, known) & (F.array_sort(F.array_distinct(allowed)) == expected)


def admitted(origin: Column, allowed_origins: list[str], authorization: Column, cookie: Column) -> Column:
    """Close code of a connection attempt, null if it is admitted.

    An origin that is given must be allowed (4403), some token must be there (4401), and a cookie needs an origin (4403),
    even beside another token. A blank origin is none.
    """
    given = lambda c: F.coalesce(F.trim(c), F.lit(""))
    header = F.coalesce(authorization, F.lit(""))
    bearer = F.lower(F.left(header, F.lit(7))).eqNullSafe("bearer ") & (F.trim(F.substr(header, F.lit(8))) != "")
    by_cookie = F.coalesce(cookie, F.lit("")) != ""
    wrong = (given(origin) != "") & ~given(origin).isin(allowed_origins)
    return F.when(wrong, 4403).when(~bearer & ~by_cookie, 4401).when(by_cookie & (given(origin) == ""), 4403)


def _accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    of, until = None, float("-inf")
    for b in batches:
        codes = []
        for key, start, end in zip(zip(b["_k"].to_pylist(), b["_piece"].to_pylist()), b["_start"].to_pylist(), b["_end"].to_pylist()):
            if key != of:
                of, until = key, float("-inf")
            free = start >= until
            codes.append(None if free else 4409)
            until = end if free else until
        yield pa.RecordBatch.from_arrays([b["_k"], b["_o"], pa.array(codes, pa.int32())], ["session_id", "connection_id", "close_code"])


def live_connections(connects: DataFrame) -> DataFrame:
    """``connects``: session_id, connection_id, ts and closed_at (null or missing: still open). Adds close_code.

    A session has one live connection; one that comes while another is live is refused (4409), and after a disconnect
    the next is let in. Whether a connection is let in depends on the one before, so a session is a chain; it is cut where
    all earlier connections are closed, and the pieces are dealt to the tasks. Null sessions and times are left out.
    """
    closed = F.col("closed_at") if "closed_at" in connects.columns else F.lit(None).cast("timestamp")
    seconds = lambda c: F.unix_micros(c.cast("timestamp")) / 1e6
    rows = connects.where(F.col("session_id").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select(F.col("session_id").alias("_k"), F.col("connection_id").alias("_o"), seconds(F.col("ts")).alias("_start"), F.when(closed.isNull(), float("inf")).otherwise(F.greatest(seconds(closed), seconds(F.col("ts")))).alias("_end"))
    types = dict(connects.dtypes)
    return chains.pieces(rows, 3600).mapInArrow(_accept, f"session_id {types['session_id']}, connection_id {types['connection_id']}, close_code int")


def deliverable(responses: DataFrame, live: DataFrame) -> DataFrame:
    """Responses whose connection is the live one of their session."""
    return responses.join(live.where("close_code is null").select("session_id", "connection_id"), ["session_id", "connection_id"], "left_semi")
