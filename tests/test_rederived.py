"""Registered queries that SQL can't express, against plain loops over the same tables."""

import os
import re
from difflib import SequenceMatcher

import duckdb
import pytest

from larkspur.plans import catalogue

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
BY_LOOPS = {"chunk_documents", "near_dedup"}


def test_every_other_query_has_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == BY_LOOPS


def dedup_key(text):
    return re.sub(r"[^\w\s]", "", re.sub(r"\s+", " ", (text or "").lower())).strip()


def unlike(chunks):
    """The chunks (heading, content) that no kept one is equal or similar to, as places."""
    seen, kept = set(), []
    for i, (heading, content) in enumerate(chunks):
        h, c = dedup_key(heading), dedup_key(content)
        if (h, c) in seen:
            continue
        seen.add((h, c))
        if not any(h == g and c and k and SequenceMatcher(None, c, k).ratio() >= 0.85 for _, g, k in kept):
            kept.append((i, h, c))
    return [i for i, _, _ in kept]


def clean(text):
    return re.sub(r"[ \t]+", " ", re.sub(r"-\n(\w+)", r"\1", text).replace("\r", "\n")).strip()


def windows(text, size=1000, overlap=250):
    """Pieces of at most ``size`` characters by the rules, in the plainest form."""
    units = []  # (text, joint before it); None stands for a border that nothing is packed across
    for p in filter(None, (clean(x.strip()) for x in re.split(r"\n\s*\n", text) if x.strip())):
        if len(p) <= size:
            units.append((p, "\n\n"))
            continue
        units.append(None)
        for s in filter(None, (x.strip() for x in re.split(r"(?<=[.!?])\s+", p))):
            if len(s) <= size:
                units.append((s, " "))
                continue
            units.append(None)
            at = 0
            while at < len(s):
                end = min(at + size, len(s))
                if end < len(s) and (gap := s.rfind(" ", at, end)) > at:
                    end = gap
                units += [(s[at:end].strip(), ""), None]
                if end == len(s):
                    break
                at = max(end - overlap, at + 1)
        units.append(None)
    out, fresh = [], True
    for u in units:
        if u is None:
            fresh = True
        elif fresh or len(out[-1]) + len(u[1]) + len(u[0]) > size:
            out, fresh = [*out, u[0]], False
        else:
            out[-1] += u[1] + u[0]
    with_tails = out[:1]
    for before, piece in zip(out, out[1:]):
        tail = before if len(before) <= overlap else before[-overlap:]
        if len(before) > overlap and tail.find(" ") > 0:
            tail = tail[tail.find(" ") + 1 :]
        tail = tail.strip()
        with_tails.append(f"{tail}\n\n{piece}" if tail and len(tail) + 2 + len(piece) <= size else piece)
    return [x for x in with_tails if x.strip()]


def plain_chunks(text):
    """Chunk texts of a document whose elements are its lines."""
    heading, body, parts = None, [], []
    patterns = (r"(?i)^Chapter\s+\d+\s+[^.!?]{3,120}$", r"^\d+(?:\.\d+)+\s+[^.!?]{3,120}$", r"^\d+\.\s+[A-Z][^.!?]{3,120}$")

    def close():
        if body:
            parts.append((heading, "\n\n".join(body).strip()))
            body.clear()

    for line in filter(None, (clean(x) for x in text.split("\n"))):
        if any(re.search(p, line) for p in patterns):
            close()
            heading = line
        elif body and not re.search(r'[.!?]"?$|\)$', body[-1].strip()):
            body[-1] += " " + line
        else:
            body.append(line)
    close()
    chunks = [(h, w) for h, b in parts for w in windows("\n\n".join(x for x in (h, b) if x))]
    return [chunks[i][1].strip() for i in unlike(chunks)]


def test_chunk_documents(spark):
    docs = duckdb.sql(f"select doc_id, text from '{FOLDER}/documents.parquet'").fetchall()
    want = sorted((d, c) for d, t in docs for c in plain_chunks(t or ""))
    got = sorted((r.doc_id, r.content) for r in catalogue.queries()["chunk_documents"](spark, FOLDER).collect())
    assert len(want) > 100 and got == want


def test_near_dedup(spark):
    runs = duckdb.sql(f"select run_id, any_value(list_transform(chunks, lambda c: c.content)) from '{FOLDER}/ingestion_state.parquet' where chunks is not null group by 1").fetchall()
    want = set()
    for run, contents in runs:
        kept = []
        for i, c in enumerate(map(dedup_key, contents)):
            if not any(c and k and SequenceMatcher(None, c, k).ratio() >= 0.85 for k in kept):
                kept.append(c)
                want.add((run, i))
    assert {(r.doc_id, r.ord) for r in catalogue.queries()["near_dedup"](spark, FOLDER).collect()} == want
