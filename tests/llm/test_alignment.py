from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import edges
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corvane.llm import alignment as A
from corvane.llm import segments as S

BYTE = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
BYTE |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if chr(b) not in BYTE)}


@pytest.fixture(scope="module")
def whole():
    """A text's ids and bytes by both tokenizers, over the whole text at once; None: no tokens."""
    tok = Tokenizer.from_file(public_tokenizers.path(S.BYTES_NAME))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(S.PIECES_NAME))

    def go(text):
        if not text:
            return None
        raw = (" " + text).encode()
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        bytes_a = [bytes(BYTE[c] for c in tok.id_to_token(i)) for i in a]
        bytes_b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            return None
        return a, b, [len(x) for x in bytes_a], [len(x) for x in bytes_b]

    return go


def brute(texts, whole):
    """[(n_a, n_b, n_groups, n_links, n_best, count_sum, groups)] by comparing byte ranges."""
    found, count = [], Counter()
    for t in texts:
        got = whole(t)
        if got is None:
            found.append(None)
            continue
        a, b, la, lb = got
        spans = lambda ls: [(sum(ls[:k]), sum(ls[: k + 1])) for k in range(len(ls))]
        sa, sb = spans(la), spans(lb)
        links = [(a[i], b[j]) for i, (s, e) in enumerate(sa) for j, (u, v) in enumerate(sb) if max(s, u) < min(e, v)]
        ends = sorted({e for _, e in sa} & {e for _, e in sb})
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(x) for x, (s, e) in zip(a, sa, strict=True) if low <= s and e <= end) + "|" + ",".join(str(x) for x, (s, e) in zip(b, sb, strict=True) if low <= s and e <= end))
            low = end
        count.update(links)
        found.append((len(a), len(b), len(groups), links, ";".join(groups)))
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], f[2], len(f[3]), sum(count[p] == most[p[1]] for p in f[3]), sum(count[p] for p in f[3]), f[4]) for f in found]


ODD = [" lead", "trail ", "two  spaces   three", "a\nb\n\nc", "\ttab\t x", " ", "\n", "x\r\ny;\rz )\r q", "a b  c\x85", "<|endoftext|> <s> </s> <unk> <0x41>", "held ▁ piece", "é ﬁ ½", "日本語 テキスト 字", "\U0001f600\U0001f600 x", "naïve café's DON'T", "1234567890 12.5%", "\x00 \x1c\x1d y", "word " * 40, "word line"]


def test_whole_texts(spark, whole):
    draw = random.Random(5)
    texts = [None, "", *ODD, *["".join(draw.choice("abcAB .,'!\n\t\r\x0b\x85é字▁<|9") for _ in range(draw.randint(1, 40))) for _ in range(400)]]
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(texts)], "doc_id long, text string, segment string, block int").repartition(3)
    want = brute(texts, whole)
    for chars in (A.BLOCK_CHARS, 200):
        got = {r.doc_id: tuple(r)[1:] for r in A.align(df, block_chars=chars).collect()}
        assert [got[k] for k in range(len(texts))] == want
    assert any(w[0] == 0 for w, t in zip(want, texts, strict=True) if t) and sum(w[0] > 0 for w in want) > 100


def test_query(spark, small, whole):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    short = [t[:1500] if t else t for _, t in rows]  # brute force is quadratic in a text; whole texts are held to the counts below
    df = spark.createDataFrame([(i, t) for (i, _), t in zip(rows, short, strict=True)], "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in A.align(df).collect()}
    assert [got[i] for i, _ in rows] == brute(short, whole)
    got = {r.doc_id: r for r in A.op12(spark, small).collect()}
    for i, t in rows:
        w = whole(t)
        assert (got[i].n_a, got[i].n_b) == ((len(w[0]), len(w[1])) if w else (0, 0))
        assert got[i].n_links == got[i].n_a + got[i].n_b - got[i].n_groups and (len(got[i].groups_sha256) == 64 if w else got[i].groups_sha256 == "")


def test_edges(spark, whole):
    got = A.align(edges.documents(spark)).collect()
    texts = [t for _, t, *_ in edges.texts()]
    assert len(got) == len(texts)
    count = Counter((r.doc_id, r.n_a, r.n_b) for r in got)
    assert count == Counter((i, *(map(len, whole(t)[:2]) if whole(t) else (0, 0))) for i, t, *_ in edges.texts())
    assert A.align(edges.empty(spark)).collect() == []
    assert A.align(spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")).count() == 2


def test_groups_hash(spark, tmp_path):
    spark.createDataFrame([(1, "one two"), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    by = {r.doc_id: r for r in A.op12(spark, str(tmp_path)).collect()}
    groups = A.align(spark.read.parquet(f"{tmp_path}/documents.parquet")).where("doc_id = 1").first().groups
    assert by[1].groups_sha256 == hashlib.sha256(groups.encode()).hexdigest() and by[2].groups_sha256 == ""


def test_cuts_are_read_off_the_vocabulary():
    assert S.safe_cuts(["▁a", "▁▁", "b"]) == S.CUTS
    assert S.safe_cuts(["a▁b"]) == "\n\t"
    assert S.safe_cuts([";\n", "x\t"]) == " "
    for cuts in (S.CUTS, " ", "\n"):
        for t in ODD:
            assert "".join(S.splitter(cuts)(t)) == t
