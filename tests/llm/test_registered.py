"""Registered queries without SQL against plain loops over the same tables."""

import os
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from larkspur.llm import p02_personal, p07_pairs, p09_mix, p10_quality, queries, sql
from larkspur.llm.text import words

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
BY_LOOPS = {"p1_pieces", "p2_found", "p2_redacted", "p3_nearest", "p4_found", "p4_repaired", "p6_groups", "p7_found", "p8_spans", "p9_mix", "p9_shares", "p10_found", "p10_statistics"}


def table(name, columns):
    return duckdb.sql(f"select distinct {columns} from '{FOLDER}/{name}.parquet'").fetchall()


def rows(spark, name):
    return queries.queries()[name](spark, FOLDER).collect()


def test_every_other_query_has_sql():
    assert set(queries.queries()) - set(sql.oracle_sql()) == BY_LOOPS


def test_pieces_give_the_texts_back(spark):
    texts = {}
    for run, text, chunks, limit, overlap in table("ingestion_state", "run_id, extracted_text, list_transform(chunks, lambda c: c.content), coalesce(chunking_config.max_chars, 1000), coalesce(chunking_config.overlap, 0)"):
        for i, t in enumerate([text, *(chunks or [])]):
            if t and len(t) > limit:
                texts[run, i] = t, limit, overlap
    found = defaultdict(list)
    for r in rows(spark, "p1_pieces"):
        found[r.run_id, r.item_no].append(r)
    assert set(found) == set(texts)
    for k, (t, limit, overlap) in texts.items():
        own = sorted(found[k], key=lambda r: r.piece_no)
        assert own[0].start_pos == 1 and own[-1].start_pos + own[-1].n_chars - 1 == len(t) and all(r.n_chars <= limit for r in own)
        for a, b in zip(own, own[1:]):
            assert a.start_pos + a.n_chars - b.start_pos == b.overlap_chars and b.overlap_chars <= overlap and b.start_pos + b.n_chars > a.start_pos + a.n_chars


def test_personal_data(spark):
    turns = table("conversations", "turn_id, user_message, bot_response")
    want = {(i, f, kind, s + 1) for i, *texts in turns for f, t in zip(("user_message", "bot_response"), texts) for kind, s, _ in p02_personal.find(t)}
    assert {tuple(r) for r in rows(spark, "p2_found")} == want and want
    ends = {(i, f, s + 1): (kind, e) for i, *texts in turns for f, t in zip(("user_message", "bot_response"), texts) for kind, s, e in p02_personal.find(t)}
    redacted = set()
    for i, *texts in turns:
        out = []
        for f, t in zip(("user_message", "bot_response"), texts):
            for (_, _, s), (kind, e) in sorted(((k, v) for k, v in ends.items() if k[:2] == (i, f)), reverse=True):
                t = t[: s - 1] + f"<{kind}>" + t[e:]
            out.append(t)
        redacted.add((i, *out))
    assert {tuple(r) for r in rows(spark, "p2_redacted")} == redacted


def test_neighbours(spark):
    found = defaultdict(set)
    for r in rows(spark, "p3_nearest"):
        found[r.collection, r.id].add(r.neighbour)
    hits = total = 0
    for collection, name, column in (("chunks", "chunk_id", "embedding_vector"), ("conversations", "turn_id", "combined_embedding")):
        usable = {i: v for i, v in table(collection, f"{name}, {column}") if v is not None and len(v) == 64 and np.isfinite(v).all() and any(v)}
        ids = sorted(usable)
        m = np.array([usable[i] for i in ids], np.float32).astype(float)
        m /= np.linalg.norm(m, axis=1)[:, None]
        c = m @ m.T
        np.fill_diagonal(c, -2)
        for i, row in zip(ids, c):
            best = {ids[j] for j in np.lexsort((ids, -np.round(row, 9)))[:5]}
            hits += len(best & found[collection, i])
            total += len(best)
            assert len(found[collection, i]) == 5
    assert hits >= 0.98 * total


def test_scans_are_repaired_where_noise_was_found(spark):
    texts = dict(table("ingestion_state", "run_id, extracted_text"))
    noise = defaultdict(list)
    for r in rows(spark, "p4_found"):
        assert 1 <= r.line_no <= texts[r.run_id].count("\n") + 1 and r.noise in ("header", "page_number", "hyphen", "misread")
        noise[r.run_id].append(r)
    repaired = {r.run_id: r.text for r in rows(spark, "p4_repaired")}
    assert set(repaired) == {i for i, t in texts.items() if t} and noise
    for i, t in repaired.items():
        lines = texts[i].split("\n")
        if i not in noise:
            continue
        gone = [lines[r.line_no - 1] for r in noise[i] if r.noise in ("header", "page_number")]
        left = Counter(words(t))
        assert not re.search(r"[^\W\d_]-\n", t)
        # What remains is the text without its furniture, but for rejoined and corrected words.
        body = Counter(words("\n".join(lines))) - Counter(words("\n".join(gone)))
        changed = sum(r.noise in ("hyphen", "misread") for r in noise[i])
        assert (body - left).total() <= 4 * changed + len(gone) and (left - body).total() <= 2 * changed + len(gone)


def test_near_copy_groups(spark):
    contents = {i: words(t) for i, t in table("chunks", "chunk_id, content") if t is not None}
    sets = {i: frozenset(zip(w, w[1:], w[2:])) for i, w in contents.items() if len(w) >= 40}
    ids, parent = sorted(sets), {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            n = len(sets[a] & sets[b])
            if 2 * n >= len(sets[a]) + len(sets[b]) - n or "".join(contents[a]) == "".join(contents[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    found = {r.id: r.group_id for r in rows(spark, "p6_groups")}
    assert found == {i: root(i) for i in ids}


def test_defects(spark):
    want = {(i, d) for i, q, a in table("conversations", "turn_id, user_message, bot_response") if (d := p07_pairs.defect(q, a))}
    assert {tuple(r) for r in rows(spark, "p7_found")} == want and {d for _, d in want} <= {"empty", "truncated", "refusal", "echo", "language"}


def test_spans_of_leaks(spark):
    grams = defaultdict(set)
    for case, *texts in table("eval_cases", "id, input, expected_output"):
        for t in texts:
            w = words(t or "")
            for k in range(len(w) - 11):
                grams[tuple(w[k : k + 12])].add(case)
    want = set()
    for doc, text in table("documents", "doc_id, text"):
        places = [m.span() for m in re.finditer(r"[^\W_]+", text or "")]
        w = words(text or "")
        covered = defaultdict(set)
        for k in range(len(w) - 11):
            for case in grams.get(tuple(w[k : k + 12]), ()):
                covered[case] |= set(range(k, k + 12))
        for case, at in covered.items():
            for k in sorted(at):
                if k - 1 not in at:
                    end = k
                    while end + 1 in at:
                        end += 1
                    want.add((doc, case, places[k][0] + 1, places[end][1], end - k + 1))
    assert {tuple(r) for r in rows(spark, "p8_spans")} == want and want


def test_mix_and_its_shares(spark):
    targets = {s: (w, m) for s, w, m in table("mix_targets", "source, target_weight, max_repeats")}
    docs = {i: (t, s) for i, t, s in table("documents", "doc_id, text, source")}
    mixed = rows(spark, "p9_mix")
    count = p09_mix._encoding(p09_mix.RANKS, p09_mix.PATTERN)
    for r in mixed:
        assert r.source == docs[r.doc_id][1] and r.n_tokens == len(count.encode_ordinary(docs[r.doc_id][0])) and 1 <= r.times <= targets[r.source][1]
    assert len({r.doc_id for r in mixed}) == len(mixed)
    tokens = Counter()
    for r in mixed:
        tokens[r.source] += r.n_tokens * r.times
    for r in rows(spark, "p9_shares"):
        assert r.tokens == tokens[r.source] and r.reached_share == pytest.approx(tokens[r.source] / tokens.total())


def test_quality(spark):
    docs = dict(table("documents", "doc_id, text"))
    found = {r.doc_id: r for r in rows(spark, "p10_statistics")}
    assert set(found) == set(docs)
    for i, t in docs.items():
        lines = [x for x in (t or "").splitlines() if x.strip()]
        assert found[i].n_lines == len(lines) and (found[i].n_words == 0) == (not words(t or ""))
        assert found[i].distance == pytest.approx(sum(found[i][f"{s}_part"] for s in p10_quality.STATISTICS), abs=1e-6)
        assert found[i].kind == "prose" or found[i].distance > p10_quality.LIMIT or not found[i].n_words  # the distance alone makes an outlier
    assert {tuple(r) for r in rows(spark, "p10_found")} == {(i, r.kind) for i, r in found.items() if r.kind != "prose"}
    assert p10_quality.not_prose(spark.createDataFrame([(i, t) for i, t in docs.items()], "doc_id long, text string"), limit=float("inf")).count() < sum(r.kind != "prose" for r in found.values())
