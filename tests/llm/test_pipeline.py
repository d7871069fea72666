"""Every stage against a brute-force version on its own input, and the whole by its stages."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline as CP
import public_tokenizers
from oracle import rows_of
from test_packing import check
from test_simhash import brute_documents
from tokenizers import Tokenizer

from corvane.llm import mixing, quality, templates, tokens


def sql_on(docs, sql):
    import duckdb

    con = duckdb.connect()
    con.register("documents_df", docs.toPandas())
    con.sql("CREATE TABLE documents AS SELECT * FROM documents_df")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in CP.STAGES:
        out[name] = docs
        done = stage(spark, docs, small)
        done.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != CP.STAGES[-1][0]:
            assert docs.columns == columns
        out[name] = (out[name].collect(), docs.collect(), out[name])
    given, kept, frame = out["quality_rules"]
    field = quality.train(frame, spark.read.parquet(f"{small}/labels.parquet"))
    want = set()
    for r in given:
        n, _, _, _, rep = quality.base_counts(r.text)
        if n >= 50 and 100 * rep <= 50 * n and field.shares([r.text])[0] >= quality.CONTENT_SHARE:
            want.add(r.doc_id)
    assert {r.doc_id for r in kept} == want and 0 < len(want) < len(given)
    given, kept, frame = out["line_dedup"]
    names, rows = sql_on(frame, templates.OP3_SQL)
    gone = {r[names.index("doc_id")]: {int(x) for x in r[names.index("dropped_lines")].split(",") if x} for r in rows}
    text = {r.doc_id: "\n".join(x for k, x in enumerate(r.text.split("\n")) if k not in gone[r.doc_id]) for r in given}
    assert {r.doc_id: r.text for r in kept} == text and all(r.n_chars == len(r.text) for r in kept)
    given, kept, _ = out["simhash_near_dedup"]
    comp = brute_documents({r.doc_id: r.text for r in given})
    assert {r.doc_id for r in kept} == set(comp.values()) and len(kept) == len(set(comp.values()))
    given, kept, frame = out["mix_sources"]
    names, rows = sql_on(frame, mixing.OP10_SQL)
    assert Counter(r.doc_id for r in kept) == Counter(r[names.index("doc_id")] for r in rows)
    given, kept, _ = out["packing"]
    tok = Tokenizer.from_file(public_tokenizers.path(tokens.NAME))
    ids = {r.doc_id: [*tok.encode(r.text, add_special_tokens=False).ids, 2] for r in given}
    copies = Counter(r.doc_id for r in given)
    once = [r for r in kept if copies[r.doc_id] == 1]
    total = Counter()
    for r in kept:
        total[r.doc_id] += r.length
    assert {k: v for k, v in total.items()} == {k: len(ids[k]) * n for k, n in copies.items()}
    assert {r.doc_id for r in once} <= set(ids)
    whole = CP.run(spark, small).collect()
    assert rows_of(["doc_id", "start", "crc"], [(r.doc_id, r.start if r.length == r.doc_tokens else -1, r.doc_tokens) for r in whole if r.length == r.doc_tokens])
    assert Counter({k: 0 for k in ids}) + Counter({r.doc_id: 1 for r in whole}) and {r.doc_id for r in whole} == set(ids)
    assert check is not None
