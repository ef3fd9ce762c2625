"""Problem 5: records that differ only in white space, case, punctuation or the order of named fields.

The characters of an Arrow batch run, slice by slice, through one look-up table that skips everything but letters and
digits and folds case; two rolling polynomial hashes are summed per row from the folded values, so no canonical string
is ever built. Content that consists of named fields (a JSON object, or ``name: value`` items) gets the sum of its
fields' hashes, which doesn't depend on their order; fields of nested objects count under the path of their names. Rows
with equal hashes are verified against the smallest id of their group by a comparison with two pointers that skip what
the table skips.

Defined results: rows with a null id or null content, and content without letters or digits, are left out. Repeated
rows count once. A field named twice counts twice. A content of only one ``name: value`` item is plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import zip_longest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators.skew import join_by_key
from larkspur.session import cut

#: Bases of the two polynomials (odd, so that powers keep all 64 bits).
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: Characters that are hashed at once.
SLICE = 1 << 20
#: Separates the names of a path.
PATH = "\x1f"
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


@lru_cache(1)
def fold_table() -> np.ndarray:
    """0 for characters to skip, else the code of the lower-case letter or digit."""
    table = np.zeros(0x110000, np.uint32)
    for code in range(0x20000):
        c = chr(code)
        if c.isalnum():
            table[code] = ord(c.lower()[0])
    for code in range(0x20000, 0x32000):  # ideographs have no case
        if chr(code).isalnum():
            table[code] = code
    return table


@lru_cache(2)
def powers(which: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(BASES[which]))]), dtype=_U)


def _slices(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """(text number, piece) in order, pieces of about ``SLICE`` characters in all at a time."""
    group, size = [], 0
    for i, t in enumerate(texts):
        for k in range(0, len(t), SLICE):
            group.append((i, t[k : k + SLICE]))
            size += len(group[-1][1])
            if size >= SLICE:
                yield group
                group, size = [], 0
    if group:
        yield group


def rolling_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each text the number of letters and digits and its two polynomial hashes over them."""
    count, totals = np.zeros(len(texts), np.int64), np.zeros((2, len(texts)), _U)
    with np.errstate(over="ignore"):
        for group in _slices(texts):
            rows = np.fromiter((i for i, _ in group), np.int64, len(group))
            sizes = np.fromiter((len(t) for _, t in group), np.int64, len(group))
            folded = fold_table()[np.frombuffer("".join(t for _, t in group).encode("utf-32-le", "surrogatepass"), np.uint32)]
            keep = folded != 0
            before = np.concatenate([[0], np.cumsum(keep)])
            ends = np.cumsum(sizes)
            first, last = before[ends - sizes], before[ends]
            folded = folded[keep].astype(_U)
            at = np.arange(len(folded)) - np.repeat(first, last - first)
            for which in (0, 1):
                values = mix(folded + _U(which << 32)) * powers(which, 2 * SLICE)[at]
                total = np.concatenate([[_U(0)], np.cumsum(values, dtype=_U)])
                # A piece that isn't the first of its text begins at a higher power.
                shift = np.array([pow(BASES[which], int(count[i]), 1 << 64) for i in rows], _U)
                np.add.at(totals[which], rows, (total[last] - total[first]) * shift)
            np.add.at(count, rows, last - first)
        return count, mix(totals[0] + count.astype(_U)), mix(totals[1] + count.astype(_U))


_FIRST = re.compile(r"[\W_]*[^\W\d_][^:=\n]*[:=]|\s*\{")
_ITEM = re.compile(r"[\W_]*?([^\W\d_](?:[^:=]*[\w)])?)\s*[:=](?!//)\s*(.*?)[\s;|,]*", re.S)
_TIME = re.compile(r"[\W_]*?[^\W\d_][^:=]*\d[:=]\d")


def _object_fields(pairs: list, path: str = "") -> Iterator[tuple[str, str]]:
    """Names and values of a JSON object whose members come as pairs; lists keep their order under numbers."""
    for k, v in pairs:
        name = f"{path}{k}"
        if isinstance(v, list) and v:
            nested = v if isinstance(v[0], tuple) else list(enumerate(v))
            yield from _object_fields(nested, name + PATH)
        else:
            yield name, v if isinstance(v, str) else json.dumps(v)


def named_fields(text: str) -> list[tuple[str, str]] | None:
    """Names and values of a text that consists of nothing but named fields, else None. Times and addresses of web pages
    are no fields."""
    if not _FIRST.match(text):
        return None
    if text.lstrip()[:1] == "{":
        try:
            pairs = json.loads(text, object_pairs_hook=list)
        except (ValueError, RecursionError):
            pairs = None
        if isinstance(pairs, list) and pairs and all(isinstance(p, tuple) for p in pairs):
            return list(_object_fields(pairs))
    body = text.strip().strip("{}[]")
    for separator in ("\n", "|", ";", ","):
        items = [x for x in body.split(separator) if any(c.isalnum() for c in x)]
        if len(items) < 2:
            continue
        found = [None if _TIME.match(x) else _ITEM.fullmatch(x) for x in items]
        if all(found):
            return [(m[1], m[2]) for m in found]
    return None


def _path_salt(name: str) -> int:
    """Tells names of one path from other splits of the same letters; 0 for a plain name."""
    return hash(tuple(sum(map(str.isalnum, x)) for x in name.split(PATH))) & 0xFFFFFFFFFFFF if PATH in name else 0


def content_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters and digits, hash, hash) of each text, with named fields taken without their order."""
    count, h1, h2 = rolling_hashes(texts)
    fields = {i: f for i, t in enumerate(texts) if (f := named_fields(t))}
    if fields:
        parts = [part for f in fields.values() for pair in f for part in pair]
        _, p1, p2 = rolling_hashes(parts)
        sizes = np.fromiter((len(f) for f in fields.values()), np.int64, len(fields))
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        rows = np.fromiter(fields, np.int64, len(fields))
        salts = np.array([_path_salt(name) for f in fields.values() for name, _ in f], _U)
        with np.errstate(over="ignore"):
            for h, p in ((h1, p1), (h2, p2)):
                each = mix((p[0::2] + salts) * _U(3) + mix(p[1::2]))
                h[rows] = mix(np.add.reduceat(each, start) + sizes.astype(_U) + _U(1 << 63))
    return count, h1, h2


_RUN = re.compile(r"[^\W_]+")


def same_skipping(a: str, b: str) -> bool:
    """Whether two texts have the same letters and digits in the same order: two pointers, run by run."""
    if a == b:
        return True
    runs_a, runs_b = _RUN.finditer(a), _RUN.finditer(b)
    left = right = ""
    while True:
        if not left:
            m = next(runs_a, None)
            left = _folded(m[0]) if m else ""
        if not right:
            m = next(runs_b, None)
            right = _folded(m[0]) if m else ""
        if not left or not right:
            return left == right
        n = min(len(left), len(right))
        if left[:n] != right[:n]:
            return False
        left, right = left[n:], right[n:]


def _folded(run: str) -> str:
    low = run.lower()
    return low if len(low) == len(run) else "".join(c.lower()[0] for c in run)


def same_record(a: str, b: str) -> bool:
    """Whether two contents are copies of one record."""
    fa, fb = named_fields(a), named_fields(b)
    if not fa or not fb:
        return not fa and not fb and same_skipping(a, b)
    if len(fa) != len(fb):
        return False
    key = lambda f: sorted(f, key=lambda p: (_path_salt(p[0]), *("".join(_RUN.findall(_folded(x))) for x in p)))
    return all(_path_salt(p[0]) == _path_salt(q[0]) and same_skipping(p[0], q[0]) and same_skipping(p[1], q[1]) for p, q in zip_longest(key(fa), key(fb), fillvalue=("", "")))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        count, h1, h2 = content_hashes(b["content"].to_pylist())
        at = pa.array(np.flatnonzero(count > 0))
        yield pa.RecordBatch.from_arrays([b["id"].take(at), pa.array(h1.view(np.int64)).take(at), pa.array(h2.view(np.int64)).take(at)], ["id", "h1", "h2"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        same = [same_record(x, y) for x, y in zip(b["content"].to_pylist(), b["keep_content"].to_pylist())]
        yield pa.RecordBatch.from_arrays([b["keep_id"], b["id"], pa.array(same, pa.bool_())], ["keep_id", "copy_id", "same"])


def _digest(parts: list[str]) -> bytes:
    """SHA-256 over the runs of letters and digits of each part, fed one after the other."""
    h = hashlib.sha256()
    for part in parts:
        for m in _RUN.finditer(part):
            h.update(_folded(m[0]).encode("utf-8", "surrogatepass"))
        h.update(b"\0")
    return h.digest()


def _exact_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keys = []
        for t in b["content"].to_pylist():
            fields = named_fields(t)
            keys.append(hashlib.sha256(b"".join(sorted(_digest([*name.split(PATH), value]) for name, value in fields))).hexdigest() if fields else _digest([t]).hex())
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(keys)], ["id", "exact"])


def hashed_content(rows: DataFrame) -> DataFrame:
    """``rows``: id, content. Returns id, h1, h2 for contents with letters or digits."""
    return rows.where(F.col("id").isNotNull() & F.col("content").isNotNull()).select("id", "content").mapInArrow(_hashed, "id string, h1 long, h2 long")


def format_copies(rows: DataFrame) -> DataFrame:
    """``rows``: id, content. Returns keep_id (smallest id of the group) and copy_id, one row for every other member.

    Only ids and hashes are grouped; content travels for members of groups alone. A group of any size is no more than
    one partially aggregated row per task, and its members are salted for the verifying join.
    """
    rows = rows.select("id", "content")
    hashed = cut(hashed_content(rows))
    groups = hashed.groupBy("h1", "h2").agg(F.min("id").alias("keep_id"), F.max("id").alias("last_id"), F.count("*").alias("n")).where("keep_id <> last_id").drop("last_id")
    members = join_by_key(hashed, groups, ["h1", "h2"], "n", F.col("id")).where("id <> keep_id").select("id", "keep_id", "n").distinct()
    members = cut(members)
    content = rows.where(F.col("id").isNotNull() & F.col("content").isNotNull())
    of_keep = content.join(members.groupBy("keep_id").agg(F.max("n").alias("n")), F.col("id") == F.col("keep_id")).select("keep_id", "n", F.col("content").alias("keep_content")).groupBy("keep_id", "n").agg(F.min("keep_content").alias("keep_content"))
    of_copy = content.join(members.drop("n"), "id")
    checked = cut(join_by_key(of_copy, of_keep, ["keep_id"], "n", F.col("id")).select("keep_id", "id", "content", "keep_content").mapInArrow(_verified, "keep_id string, copy_id string, same boolean"))
    good = checked.where("same").select("keep_id", "copy_id").distinct()
    failed = checked.where("not same")
    if failed.isEmpty():
        return good
    again = content.join(failed.select(F.col("copy_id").alias("id")).distinct(), "id").mapInArrow(_exact_key, "id string, exact string").distinct()
    rest = again.groupBy("exact").agg(F.min("id").alias("keep_id"))
    return good.unionByName(again.join(rest, "exact").where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id")))


def copy_counts(rows: DataFrame) -> DataFrame:
    """One row per record: keep_id and copies, the number of messages (itself included) that hold it."""
    ids = hashed_content(rows).select("id").distinct()
    found = format_copies(rows)
    grouped = found.groupBy("keep_id").agg((F.count("*") + 1).alias("copies"))
    single = ids.join(found.select(F.col("copy_id").alias("id")), "id", "left_anti")
    return single.join(grouped, single.id == grouped.keep_id, "left").select(single.id.alias("keep_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
