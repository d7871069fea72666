from __future__ import annotations

import random

import edges
import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import simhash as S

MASKS = S.masks()


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=S.RADIUS))
def test_every_pair_within_the_radius_collides(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    assert any(x & m == y & m for m in (v % 2**64 for v in MASKS))


def brute_print(t):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    v = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return v - (v >> 63 << 64)


def brute_components(prints: dict[int, int], radius=S.RADIUS, alike=lambda a, b: True) -> dict[int, int]:
    comp = {i: i for i in prints}
    ids = sorted(prints)
    f = np.array([prints[i] for i in ids], np.int64).view(np.uint64)
    near = {i: [ids[j] for j in np.flatnonzero(np.bitwise_count(f ^ f[k]) <= radius) if alike(i, ids[j])] for k, i in enumerate(ids)}
    while True:
        low = {i: min(comp[j] for j in near[i]) for i in ids}
        if low == comp:
            return comp
        comp = low


def test_fingerprints():
    for _, t, *_ in edges.texts():
        if t is None or len(t) < 20000:
            assert S.fingerprint(t) == brute_print(t)


def test_whole_table(spark, medium):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{medium}/documents.parquet").collect()}
    rows = S.op6(spark, medium).collect()
    prints = {i: S.fingerprint(t) for i, t in docs.items()}
    comp = brute_components(prints)
    assert len(rows) == len(docs) and len(set(comp.values())) < len(docs)
    for r in rows:
        assert r.component_id == comp[r.doc_id] and r.fingerprint == f"{prints[r.doc_id] % 2**64:016x}"


def test_blocks_lose_no_link(spark):
    draw = random.Random(3)
    base = draw.getrandbits(64)
    prints = {}
    for i in range(300):  # a large bucket: chains around one fingerprint
        v = base
        for b in draw.sample(range(64), draw.randint(0, 9)):
            v ^= 1 << b
        prints[i] = v - (v >> 63 << 64)
    first = {}
    for i, v in prints.items():
        first.setdefault(v, i)
    df = spark.createDataFrame([(v, i) for v, i in first.items()], "fp long, rep long")
    from corvane.llm.components import connected_components

    for block in (7, 4096):
        got = {r.node: r.component for r in connected_components(S.links(df, block=block)).collect()}
        want = brute_components({i: v for v, i in first.items()})
        assert {i: got.get(i, i) for i in want} == want
        assert {r.rep: r.label for r in S.clusters(df, S.RADIUS, block).collect()} == want


def brute_documents(texts: dict[int, str]) -> dict[int, int]:
    """Components by the definition: all pairs, sets of the word tuples themselves."""
    words = {i: (t or "").encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in words.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    return brute_components({i: S.fingerprint(t, S.PAIR) for i, t in texts.items()}, S.PAIR_RADIUS, alike)


def family(seed, n):
    """Copies of one text with few to many changed words, copies of copies, and texts of their own."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 7)))
    out = [[word() for _ in range(120)]]
    while len(out) < n:
        w = list(draw.choice(out))
        for _ in range(draw.choice([0, 1, 1, 2, 3, 6, 60])):
            w[draw.randrange(len(w))] = word()
        out.append(w)
    return {i: " ".join(w) for i, w in enumerate(out)}


def test_documents_against_all_pairs(spark):
    texts = {i + 200 * k: t for k in range(2) for i, t in family(k, 90).items()}
    want = brute_documents(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert 5 < len(set(want.values())) < len(texts)
    for chars in (S.BLOCK_CHARS, 3000):  # whole clusters, and many pairs of blocks
        rows = S.near_documents(df, block_chars=chars).collect()
        assert {r.doc_id: r.component_id for r in rows} == want
        assert all(r.keeper == (want[r.doc_id] == r.doc_id) for r in rows) and len(rows) == len(texts)
    assert {r.doc_id for r in S.keep_one(df).collect()} == set(want.values())


def test_most_similar_pairs_are_candidates():
    """How many of the pairs with a 5-word similarity of 0.8 the wider fingerprints propose; the rest differ in more bits."""
    draw = random.Random(12)
    hit = n = 0
    for seed in range(150):
        base = family(1000 + seed, 1)[0].split()
        w = list(base)
        for _ in range(2):
            w[draw.randrange(len(w))] = "zz" + str(draw.random())
        a, b = S.shingles(" ".join(base)), S.shingles(" ".join(w))
        if len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)):
            n += 1
            hit += ((S.fingerprint(" ".join(base), S.PAIR) ^ S.fingerprint(" ".join(w), S.PAIR)) % 2**64).bit_count() <= S.PAIR_RADIUS
    assert n > 100 and hit >= 0.75 * n


def test_components_of_a_long_path(spark):
    from corvane.llm.components import connected_components

    order = list(range(400))
    random.Random(5).shuffle(order)
    df = spark.createDataFrame(list(zip(order, order[1:], strict=False)) + [(1000, 1001), (1001, 1001)], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert {got[i] for i in range(400)} == {0} and got[1001] == 1000
    assert connected_components(df.where("a < 0")).count() == 0


def test_edges(spark):
    docs = edges.documents(spark)
    rows = S.near_duplicates(docs).collect()
    assert len(rows) == len(edges.texts())
    got = {r.doc_id: r.component_id for r in rows if r.doc_id != 2}
    assert sorted(r.component_id for r in rows if r.doc_id == 2) == [1, 1, 2]
    assert got[3] == got[4] == got[5] == got[10] == 3 and got[None] is None
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert {(r.doc_id, r.text[:7] if r.doc_id == 2 else "") for r in kept.collect()} == {(2, "another"), *((k, "") for k in (1, 3, 6, 7, 8, 9, None))}
    assert len(kept.collect()) == 8
    named = {(r.doc_id, r.component_id, r.keeper) for r in S.near_documents(docs).collect()}
    assert {(1, 1, True), (2, 1, False), (2, 2, True), (3, 3, True), (4, 3, False), (None, None, True)} <= named
    assert S.near_documents(edges.empty(spark)).count() == 0
    assert S.near_duplicates(edges.empty(spark)).count() == S.keep_one(edges.empty(spark)).count() == 0
