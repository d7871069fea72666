from __future__ import annotations

import random

import edges
import numpy as np

from corvane.llm import chunks as C

DRAW = random.Random(8)


def say(n):
    return " ".join("".join(DRAW.choice("abcdefghijklmnoprstuvé") for _ in range(DRAW.randint(2, 9))) for _ in range(n))


def test_rolling_hash_is_the_gear_hash():
    raw = np.frombuffer(say(60).encode(), np.uint8)
    h, want = 0, []
    for k in range(len(raw)):
        h = sum(int(C._GEAR[raw[k - j]]) << j for j in range(16) if k >= j) & 0xFFFFFFFF
        cont = k + 1 < len(raw) and raw[k + 1] & 0xC0 == 0x80
        want.append(h >> (32 - C.CUT_BITS) == 0 and not cont)
    assert C._candidates(raw).tolist() == want


def test_chunks_cover_the_text():
    for t in ["", "a", say(400), "é" * 2000, "\x00" * 500, edges.LONG]:
        data = t.encode()
        ends = C.cut_points(data)
        parts = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        assert b"".join(parts) == data and all(0 < len(p) <= C.MAX_CHUNK for p in parts)
        assert all(len(p) >= C.MIN_CHUNK for p in parts[:-1] if len(p) < C.MAX_CHUNK - 3)
        for p in parts:
            p.decode()


def test_insertions_move_few_cuts():
    t = say(3000).encode()
    a = {t[x:y] for x, y in zip([0, *C.cut_points(t)[:-1]], C.cut_points(t), strict=True)}
    u = t[:5000] + b"inserted words" + t[5000:]
    b = {u[x:y] for x, y in zip([0, *C.cut_points(u)[:-1]], C.cut_points(u), strict=True)}
    assert len(b - a) <= 6


def corpus(spark):
    passage = say(60)
    rows = [(i, f"{say(80)} {passage} {say(90)}" if i % 3 == 0 else say(200)) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string"), passage


def test_planted_passages(spark):
    docs, passage = corpus(spark)
    text = {r.doc_id: r.text for r in docs.collect()}
    rows = C.repeated_spans(docs).collect()
    assert {r.doc_id for r in rows} == {i for i in text if i % 3 == 0}
    for r in rows:
        assert text[r.doc_id][r.start : r.end] in passage and r.source_doc_id == 0 and r.first == (r.doc_id == 0) and r.end - r.start >= C.MIN_SPAN
    cut = {r.doc_id: r.text for r in C.without_repeats(docs).collect()}
    spans = {r.doc_id: (r.start, r.end) for r in rows if not r.first}
    assert all(cut[i] == (t[: spans[i][0]] + t[spans[i][1] :] if i in spans else t) for i, t in text.items())


def plain_cuts(data):
    """Byte by byte: the gear hash of the last 16 bytes, cuts between characters, from MIN_CHUNK to MAX_CHUNK bytes."""
    out, at, gear = [], 0, C._GEAR.tolist()
    while at < len(data):
        for end in range(at + 1, min(len(data), at + C.MAX_CHUNK) + 1):
            boundary = end == len(data) or data[end] & 0xC0 != 0x80
            h = 0
            if end - at >= C.MIN_CHUNK and boundary:
                for b in data[max(0, end - 16) : end]:
                    h = ((h << 1) + gear[b]) & 0xFFFFFFFF
                if h >> (32 - C.CUT_BITS) == 0:
                    break
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end -= 1
        out.append(end)
        at = end
    return out


def spans_by_hand(docs):
    """docs: {id: text} -> {(id, start, end, first, source, sources)}: chunks by their own bytes instead of digests, runs by a plain loop."""
    where, parts = {}, {}
    for i in sorted(docs):
        d = (docs[i] or "").encode()
        ends = plain_cuts(d)
        parts[i] = [(len(d[:a].decode()), len(d[:b].decode()), d[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=False)]
        for a, _, p in parts[i]:
            where.setdefault(p, []).append((i, a))
    want = set()
    for i, ps in parts.items():
        run, chars = None, {}
        for a, b, p in [*ps, (0, 0, b"")]:
            first = where[p][0] == (i, a) if p and len(where[p]) > 1 else None
            if run and first != run[2]:
                if run[1] - run[0] >= C.MIN_SPAN:
                    want.add((i, *run, min(chars, key=lambda k: (-chars[k], k)), len(chars)))
                run, chars = None, {}
            if first is not None:
                run = (run[0] if run else a, b, first)
                chars[where[p][0][0]] = chars.get(where[p][0][0], 0) + b - a
    return want


def test_against_brute_force(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {(r.doc_id, r.start, r.end, r.first, r.source_doc_id, r.n_sources) for r in C.op9(spark, small).collect()}
    assert got and got == spans_by_hand(docs)


def test_repeats_within_one_document_and_several_sources(spark):
    a, b, c = say(70), say(70), say(70)
    docs = {1: f"{say(40)} {a} {say(30)}", 2: f"{b} {say(50)}", 3: f"{say(20)} {a} {b} {say(20)}", 4: f"{say(20)} {c} {say(40)} {c} {say(40)} {c}"}
    rows = C.repeated_spans(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.end, r.first, r.source_doc_id, r.n_sources) for r in rows} == spans_by_hand(docs)
    assert [r.first for r in sorted(rows, key=lambda r: r.start) if r.doc_id == 4] == [True, False, False]
    assert {(r.source_doc_id, r.n_sources) for r in rows if r.doc_id == 3} <= {(1, 2), (2, 2), (1, 1), (2, 1)}
    left = {r.doc_id: r.text for r in C.without_repeats(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()}
    assert len(left[4]) < len(docs[4]) - len(c) and left[1] == docs[1]


def test_edges(spark):
    docs = edges.documents(spark)
    rows = C.repeated_spans(docs).collect()
    assert {(r.doc_id, r.first) for r in rows} == {(1, True), (2, False), (6, True), (6, False), (7, True), (7, False)}  # the long texts repeat themselves
    back = C.without_repeats(docs)
    assert back.columns == docs.columns and back.count() == docs.count()
    assert C.repeated_spans(edges.empty(spark)).count() == C.without_repeats(edges.empty(spark)).count() == 0
