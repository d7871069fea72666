from __future__ import annotations

import random
import zlib
from collections import defaultdict

import edges
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from corvane.llm import packing as K
from corvane.llm import tokens


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(public_tokenizers.path(tokens.NAME))


ODD = ["a.b,c. d's ...!!, xé, ÉCOLE. 12, 3.5", "<|endoftext|> x", "<|ENDOFTEXT|>", "fin\x1cx y z ", "é É, İ.", "ﬁ ǅ ß ẞ × ÷ ×, ÷.", "…, ’. “x”.", "x.,;:!?#*$%&|.,;: y", "don't we'll 'tis '.", "日本語。 ,a ,", "🙂. 🙂,x", "ĳ Ÿ. ÿ, µ. İ, ı."]


def test_ids(tok):
    texts = [None, "", " ", "\n \n", *ODD, *[t for _, t, *_ in edges.texts()]]
    for got in (tokens.encoder()(texts), [tokens.encoder()([t])[0] for t in texts]):
        assert [x.tolist() for x in got] == [[*tok.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_ids_of_random_texts_and_a_small_table(tok):
    draw = random.Random(6)
    texts = ["".join(draw.choice("abAB .,'!\n\té×ÉßſKΣ́&|<9_-") for _ in range(draw.randint(0, 40))) for _ in range(3000)]
    pieces = tokens.Pieces(public_tokenizers.path(tokens.NAME), slots=1 << 9, batch_bytes=256)
    tokens._loaded["small"] = pieces
    try:
        got = tokens.encoder("small")(texts)
    finally:
        del tokens._loaded["small"]
    assert [x.tolist() for x in got] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_pieces_are_told_by_their_bytes(tok):
    words = []
    for n in range(1, 13):  # Thue-Morse words and their complements, which polynomial hashes confuse
        w = "".join("ab"[k.bit_count() & 1] for k in range(1 << n))
        words += [w, w.translate({97: "b", 98: "a"})]
    words += ["x" * k for k in range(1, 80)] + ["a\0", "a", "a\0\0", "\0" * 9, "\0" * 16, "\0" * 17]
    got = tokens.encoder()([*words, " ".join(words)])
    assert [x.tolist() for x in got] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in [*words, " ".join(words)]]


def test_tables_are_emptied(tok, monkeypatch):
    monkeypatch.setattr(tokens, "MOST_IDS", 300)
    monkeypatch.setattr(tokens, "MOST_LONG", 5)
    monkeypatch.setitem(tokens._loaded, "tiny", tokens.Pieces(public_tokenizers.path(tokens.NAME), slots=1 << 5, batch_bytes=512))
    draw = random.Random(3)
    texts = [" ".join("".join(draw.choice("abcdé") for _ in range(draw.choice([1, 3, 15, 16, 17, 30, 70]))) for _ in range(draw.randint(1, 40))) for _ in range(200)]
    assert [x.tolist() for x in tokens.encoder("tiny")(texts)] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_rule_is_the_least_sum_of_squares():
    draw = random.Random(2)
    for _ in range(60):
        w = 24
        r = K.SumOfSquares(w)
        r.counts[1:w] = [draw.choice([0, 0, 1, 2, 5]) for _ in range(w - 1)]
        before, s = r.counts.copy(), draw.randint(1, w - 1)

        def after(level, before=before, s=s, w=w):
            n = before.copy()
            if level:
                n[level] -= 1
            if level + s < w:
                n[level + s] += 1
            return int((n[1:w] ** 2).sum())

        level = r.place(s)
        options = [g for g in range(w) if g + s <= w and (g == 0 or before[g])]
        assert after(level) == min(map(after, options)) == int((r.counts[1:w] ** 2).sum())


def check(rows, ids_of):
    docs, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for key, pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        ids, at = ids_of[key], 0
        for p in pieces:
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at == K.WINDOW or (at < K.WINDOW and at & (at - 1) == 0)
    return docs


def test_round_trip(spark, small, tok):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    assert set(check(K.op7(spark, small).collect(), ids)) == set(ids)


def test_open_windows_are_bounded():
    p = K.Packer(0, max_open=5)
    for i in range(200):
        p.add(i, np.full(3000, 7, np.uint32))
        assert len(p.open) <= 6
    p.flush()
    assert sum(len(x[2]) for x in p.drain()) == 600000


def test_the_rule_places_most(medium):
    """Of a partition of 1000 documents the cuts at its end move less than a twentieth of the ids."""
    import pyarrow.parquet as pq

    p = K.Packer(0)
    for i, ids in enumerate(tokens.encoder()(pq.read_table(f"{medium}/documents.parquet").column("text").combine_chunks())):
        p.add(i, ids)
    p.flush()
    pieces = p.drain()
    assert p.moved < 0.05 * sum(len(x[2]) for x in pieces)
    fill = defaultdict(int)
    for x in pieces:
        fill[x[4]] += len(x[2])
    assert all(n == K.WINDOW or n & (n - 1) == 0 for n in fill.values()) and sum(n < K.WINDOW for n in fill.values()) <= 12


def test_edges(spark, tok):
    docs = edges.documents(spark).where("doc_id is null or doc_id <> 2")
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in edges.texts() if i != 2}
    assert set(check(K.pack(docs).collect(), ids)) == set(ids)
    twice = K.pack(edges.documents(spark).where("doc_id = 2")).collect()
    assert len({r.sequence_id for r in twice}) >= 1 and sum(r.start == 0 for r in twice) == 3
    assert K.pack(edges.empty(spark)).count() == 0
