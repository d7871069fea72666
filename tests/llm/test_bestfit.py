from __future__ import annotations

import itertools
import random
import zlib
from collections import Counter, defaultdict

import edges
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm import bestfit as B
from corvane.llm import segments as S


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path(S.BYTES_NAME))


def check(rows, ids_of, window=B.WINDOW):
    """Every id in one piece, only long documents cut, the first piece the shorter one, sequences gapless and within the window."""
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    assert set(docs) == set(ids_of)
    for key, pieces in docs.items():
        ids, at = ids_of[key], 0
        for k, p in enumerate(sorted(pieces, key=lambda r: r.piece)):
            assert p.piece == k and p.start == at and 0 < p.length <= window
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            assert k == 0 or p.length == window
            at += p.length
        assert at == len(ids) and len(pieces) == -(-len(ids) // window)
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(seqs)


def test_ids_are_the_tokenizers(tok):
    draw = random.Random(6)
    texts = ["", " ", "a<|endoftext|> b <|endoftext|>", "don't WE'LL 'tis", "x  y   z\x1c\x1dq", "é́ \U0001f600 字", "1234 ½ ²", *["".join(draw.choice("abAB .,'!\n\t\r\x0b\x85é字٣²́\x00<|9_-") for _ in range(draw.randint(0, 60))) for _ in range(3000)]]
    encode = B._encoder()
    assert [encode(t).tolist() for t in texts] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_merges_must_be_in_order(tmp_path):
    import json

    with open(public_tokenizers.path(S.BYTES_NAME), encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["merges"] = spec["model"]["merges"][::-1]
    (tmp_path / "x.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        S.byte_level(str(tmp_path / "x.json"))


def test_whole_table(spark, small, tok):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, B.END] for i, t in texts.items()}
    n = check(B.op13(spark, small).collect(), ids)
    assert n <= -(-sum(map(len, ids.values())) // B.WINDOW) + 2


def test_edges(spark, tok):
    docs = edges.documents(spark)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, B.END] for i, t, *_ in edges.texts()}
    check(B.best_fit(docs.where("doc_id is null or doc_id <> 2"))[0].collect(), {i: x for i, x in ids.items() if i != 2})
    twice = B.best_fit(docs.where("doc_id = 2"))[0].collect()
    assert sum(r.piece == 0 for r in twice) == 3 and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert B.best_fit(edges.empty(spark))[0].collect() == []


def least(sizes, window):
    """The fewest windows, by trying all partitions."""
    best = len(sizes)

    def go(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                rooms[i] -= sizes[k]
                go(k + 1, rooms)
                rooms[i] += sizes[k]
        go(k + 1, [*rooms, window - sizes[k]])

    go(0, [])
    return best


def test_near_the_optimum_and_never_under_the_bound():
    draw = random.Random(1)
    over = 0
    for _ in range(60):
        window = draw.choice([10, 16, 30])
        sizes = sorted((draw.randint(1, window) for _ in range(draw.randint(1, 9))), reverse=True)
        c = Counter(sizes)
        p = B.plan(np.array(sorted(c)), np.array([c[k] for k in sorted(c)]), window)
        best = least(sizes, window)
        assert p.bound <= best <= p.sequences <= best + 1
        over += p.sequences - best
    assert over <= 3


def test_few_lengths_without_exact_fills():
    """Few lengths of which hardly any combination fills a window: within a twentieth of the bound."""
    lengths, counts = np.array([100, 250, 263, 376, 511]), np.array([4000, 3000, 3000, 4000, 4000])
    p = B.plan(lengths, counts)
    assert p.bound <= p.sequences <= p.bound * 1.05


def test_prices_are_the_best():
    draw = random.Random(3)
    for _ in range(40):
        window, m = 20, draw.randint(1, 4)
        lengths = np.array(sorted(draw.sample(range(1, 21), m)))
        weights, most = np.array([draw.random() for _ in range(m)]), np.array([draw.randint(0, 4) for _ in range(m)])
        free = [range(window // k + 1) for k in lengths.tolist()]
        value = lambda c: sum(a * w for a, w in zip(c, weights.tolist(), strict=True))
        fits = [c for c in itertools.product(*free) if sum(a * k for a, k in zip(c, lengths.tolist(), strict=True)) <= window]
        assert abs(B.price_all(weights, lengths, window)[0][window] - max(map(value, fits))) < 1e-9
        held = [c for c in fits if all(a <= n for a, n in zip(c, most.tolist(), strict=True))]
        assert abs(value(B.price_bounded(weights, lengths, most, window).tolist()) - max(map(value, held))) < 1e-9


@pytest.mark.parametrize("counts", [{700: 9000}, {1: 5000}, {1024: 7}, {1023: 100, 1: 3}, {600: 50000, 500: 50000, 424: 20000, 24: 1}, {k: 1 for k in range(1, 1025)}, {512: 30001, 300: 1, 171: 7}])
def test_plans_place_every_piece_once(counts):
    lengths, n = np.array(sorted(counts)), np.array([counts[k] for k in sorted(counts)])
    p = B.plan(lengths, n)
    length = np.repeat(lengths, n)
    rank = np.concatenate([np.arange(k) for k in n])
    sequence, offset = p.place(length, rank)
    order = np.lexsort((offset, sequence))
    s, o, size = sequence[order], offset[order], length[order]
    new = np.concatenate(([True], s[1:] != s[:-1]))
    assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + size)[:-1][~new[1:]]).all() and (o + size <= B.WINDOW).all()
    assert len(np.unique(sequence)) == p.sequences >= p.bound


def test_lengths_of_many_partitions(spark):
    docs = spark.range(0, 3000, 1, 7).selectExpr("id as doc_id", "repeat('a ', cast(id % 3 * 300 + 5 as int)) as text")
    rows = B.best_fit(docs, lambda: lambda t: np.zeros(len(t) // 2, np.uint32))[0].collect()
    check(rows, {i: [0] * (i % 3 * 300 + 5) + [B.END] for i in range(3000)})
