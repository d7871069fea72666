"""Personal data: fixed patterns find entities; corpus co-occurrence finds the terms that give them away.

A term's disclosure of an entity is the share of the lines with the term in which it stands next to the entity, and
the pair's pointwise mutual information. Next to it are the nearest words of its own line and of the lines around it.
Terms over both thresholds are spans too: generalised to a tag, or removed where the share is near one. A pair needs
several distinct lines of the entity, so copies of a document alone make no pair. Terms are runs of letters, lower-cased.

Keys and tokens are entities too, told by how much they say for themselves: long runs that change between letters and
digits often, of at least so many bits by the entropy of their own characters.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialise, table

KINDS = ["email", "ip", "card", "phone", "term", "secret"]
TERM, SECRET = 4, 5
#: Words to each side of an entity, in its line or the one before or after, that count as next to it.
NEAR = 8
#: Least number of distinct lines of the entity in a pair, least share of the term's lines, least mutual information in bits; share from which a term is removed.
MIN_CONTEXTS = 3
MIN_SHARE = 0.5
MIN_BITS = 4.0
REMOVE_SHARE = 0.9
MIN_TERM = 3
#: Least length of a secret, changes between letters and digits in it, and bits: its length times the entropy of its characters.
SECRET_CHARS = 20
SECRET_CHANGES = 5
SECRET_BITS = 60.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_run = re.compile(rf"[A-Za-z0-9_+/=-]{{{SECRET_CHARS},}}")
_changes = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")
_word = regex.compile(r"\p{L}+")


def _emails(t: str) -> list[tuple[int, int]]:
    """As the pattern finds them, but in linear time: the local part is what precedes an @ since the last match."""
    out, done, at = [], 0, t.find("@")
    while at >= 0:
        s, following = at, at + 1
        while s > done and t[s - 1] in _LOCAL:
            s -= 1
        if s < at and (m := _domain.match(t, at + 1)):
            done = following = m.end()
            out.append((s, done))
        at = t.find("@", following)
    return out


def _luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(2 * d - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def base_spans(t: str | None) -> list[tuple[int, int, int]]:
    """(start, kind, end) in code points, sorted; kind is an index of KINDS. Null: none."""
    if not t:
        return []
    out = [(s, 0, e) for s, e in _emails(t)] if "@" in t else []
    for m in _ip.finditer(t):
        if all(len(p) < 4 and int(p or 0) < 256 for p in (x.lstrip("0") for x in m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _card.finditer(t):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in t:
        for m in _phone.finditer(t):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def secret_spans(t: str | None, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs that are secrets by their own information and touch no base span, as base_spans() has them."""
    out = []
    for m in _run.finditer(t or ""):
        w = m[0]
        if len(_changes.findall(w)) < SECRET_CHANGES:
            continue
        n = len(w)
        bits = sum(k * math.log2(n / k) for k in Counter(w).values())
        if bits >= SECRET_BITS and not any(s < m.end() and e > m.start() for s, _, e in base):
            out.append((m.start(), SECRET, m.end()))
    return out


def _next_to(t: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """For each entity the terms around it, and its line's hash as the context; the words of a line are read once."""
    import xxhash

    ends = sorted(e for _, _, e in spans)
    starts = [s for s, _, _ in spans]  # sorted as the spans are
    lines: dict[int, tuple[int, int, list[int], list[str]]] = {}

    def line_of(a: int, b: int) -> tuple[list[int], list[str]]:
        """Places and words of the line t[a:b] that lie in no entity."""
        if a not in lines:
            # a word touches an entity if more of them start before its end than end before its start
            free = [m for m in _word.finditer(t, a, b) if m.end() - m.start() >= MIN_TERM and bisect_left(starts, m.end()) == bisect_right(ends, m.start())]
            lines[a] = (a, b, [m.start() for m in free], [m[0].lower() for m in free])
        return lines[a][2:]

    found: dict[tuple[str, int, int], set[str]] = {}
    a = b = -1
    for s, k, e in spans:
        if not (a <= s <= b and e <= b):
            a = t.rfind("\n", 0, s) + 1
            b = t.find("\n", e)
            b = len(t) if b < 0 else b
        places, words = line_of(a, b)
        cut = bisect_left(places, s)
        left, right = words[max(0, cut - NEAR) : cut], words[cut : cut + NEAR]
        if len(left) < NEAR and a:
            more = line_of(t.rfind("\n", 0, a - 1) + 1, a - 1)[1]
            left = more[max(0, len(more) - NEAR + len(left)) :] + left
        if len(right) < NEAR and b < len(t):
            end = t.find("\n", b + 1)
            right = right + line_of(b + 1, len(t) if end < 0 else end)[1][: NEAR - len(right)]
        value = t[s:e].lower() if k == 0 else t[s:e] if k == SECRET else "".join(c for c in t[s:e] if c.isdigit() or (k == 1 and c == "."))
        found.setdefault((f"{KINDS[k]}:{value}", a, b), set()).update(left + right)
    context = {a: xxhash.xxh64_intdigest(t[a:b].encode("utf-8", "surrogatepass"), 42) - (1 << 63) for a, b in {(a, b) for _, a, b in found}}
    return [{"entity": name, "context": context[a], "terms": sorted(ws)} for (name, a, _), ws in found.items()]


_SPANS = "array<struct<start:long,kind:int,end:long>>"


def entities(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, _row, spans, near): fixed-pattern entities of every row. _row: xxhash64 of the text."""

    def scan(ids: list, rows: list, texts: list) -> list:
        base = [base_spans(t) for t in texts]
        spans = [sorted(x + secret_spans(t, x)) for t, x in zip(texts, base, strict=True)]
        return [ids, rows, [[{"start": s, "kind": k, "end": e} for s, k, e in x] for x in spans], [_next_to(t, x) if x else [] for t, x in zip(texts, spans, strict=True)]]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_row"), F.col("text").alias("text"))
    return map_rows(rows, scan, f"doc_id long, _row long, spans {_SPANS}, near array<struct<entity:string,context:long,terms:array<string>>>")


def _words_of_lines(docs: DataFrame) -> DataFrame:
    lines = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_row"), F.explode(F.split("text", "\n")).alias("line"))
    words = F.array_distinct(F.split(F.lower(F.regexp_replace("line", r"[^\p{L}]+", " ")), " "))  # letters are told before they are lower-cased, as in _word
    return lines.select("doc_id", "_row", F.xxhash64("line").alias("line"), F.explode(words).alias("term"))


def disclosing_terms(docs: DataFrame, found: DataFrame, min_contexts: int = MIN_CONTEXTS, min_share: float = MIN_SHARE, min_bits: float = MIN_BITS) -> tuple[DataFrame, DataFrame]:
    """Terms over the thresholds (term, share, bits), and where they occur (doc_id, _row, term).

    Counts run over all rows of docs; a term that is never next to an entity often enough is not counted further.
    """
    near = found.select(F.explode("near").alias("n")).select("n.entity", "n.context", "n.terms")
    lines_of = near.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    per = near.select("entity", "context", F.explode("terms").alias("term")).groupBy("entity", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = per.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("together")).where(F.col("contexts") >= min_contexts)
    pairs = materialise(pairs, "pairs")
    if pairs.isEmpty():
        none = pairs.select("term", F.lit(0.0).alias("share"), F.lit(0.0).alias("bits"))
        return none, none.select(F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("_row"), "term")
    n = docs.agg(F.sum(F.size(F.split("text", "\n"))).alias("n")).first()[0]
    # all words are counted before the join, which so has a row a pair and not one a place
    alone = _words_of_lines(docs).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    scored = pairs.join(alone, "term").join(lines_of, "entity")
    scored = scored.select("term", F.least(F.col("together") / F.col("n_term"), F.lit(1.0)).alias("share"), F.log2(F.col("together") * F.lit(float(n)) / (F.col("n_entity") * F.col("n_term"))).alias("bits"))
    terms = scored.where((F.col("share") >= min_share) & (F.col("bits") >= min_bits)).groupBy("term").agg(F.max("share").alias("share"), F.max("bits").alias("bits"))
    terms = materialise(terms, "terms")
    return terms, _words_of_lines(docs).join(terms.select("term"), "term").select("doc_id", "_row", "term").distinct()


def detect(docs: DataFrame, **thresholds) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, _row, spans, removed): entities and disclosing terms; removed: terms to go altogether.

    Null and empty texts have no spans. Repeated rows are treated alike, each with a row of its own.
    """
    found = materialise(entities(docs), "entities")
    terms, where = disclosing_terms(docs, found, **thresholds)
    hits = where.join(terms, "term").groupBy("doc_id", "_row").agg(F.sort_array(F.collect_set(F.struct("term", "share"))).alias("hits"))
    hits = materialise(hits, "hits").withColumnRenamed("doc_id", "_hit_id").withColumnRenamed("_row", "_hit_row")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("_row"), F.col("text").alias("text"))
    texts = texts.join(hits, texts["doc_id"].eqNullSafe(F.col("_hit_id")) & (texts["_row"] == F.col("_hit_row"))).select("doc_id", "_row", "text", "hits").dropDuplicates(["doc_id", "_row"])

    def locate(ids: list, rows: list, texts: list, hits: list) -> list:
        out = []
        for t, h in zip(texts, hits, strict=True):
            known = {x["term"] for x in h}
            out.append([{"start": m.start(), "kind": TERM, "end": m.end()} for m in _word.finditer(t) if m[0].lower() in known])
        return [ids, rows, out, [[x["term"] for x in h if x["share"] >= REMOVE_SHARE] for h in hits]]

    more = map_rows(texts, locate, f"_more_id long, _more_row long, more {_SPANS}, removed array<string>")
    out = found.join(more, found["doc_id"].eqNullSafe(F.col("_more_id")) & (found["_row"] == F.col("_more_row")), "left")
    spans = F.sort_array(F.concat("spans", F.coalesce("more", F.array().cast(_SPANS))))
    return out.select("doc_id", "_row", spans.alias("spans"), F.coalesce("removed", F.array().cast("array<string>")).alias("removed"))


def sanitise(docs: DataFrame, **thresholds) -> DataFrame:
    """docs with text's entities replaced by [KIND] and disclosing terms by [TERM], or by nothing where their share is near one; as many rows as docs, repeated ones too, other columns as they are."""
    found = detect(docs, **thresholds).dropDuplicates(["doc_id", "_row"]).withColumnRenamed("doc_id", "_cv_id").withColumnRenamed("_row", "_cv_row").withColumnRenamed("spans", "_cv_spans").withColumnRenamed("removed", "_cv_removed")

    @F.pandas_udf("string")
    def clean(texts, spans, removed):
        import pandas as pd

        out = []
        for t, sp, gone in zip(texts, spans, removed, strict=True):
            if t is None or sp is None:
                out.append(t)
                continue
            drop, parts, at = set(gone), [], 0
            for x in sorted(sp, key=lambda x: (x["start"], x["kind"])):
                if x["start"] >= at:
                    word = t[x["start"] : x["end"]]
                    parts += [t[at : x["start"]], "" if x["kind"] == TERM and word.lower() in drop else f"[{KINDS[x['kind']].upper()}]"]
                    at = x["end"]
            out.append("".join([*parts, t[at:]]))
        return pd.Series(out, dtype=object)

    out = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col("_cv_id")) & (F.xxhash64(docs["text"]) == F.col("_cv_row")), "left")
    return out.select(*[clean(F.col("text"), F.col("_cv_spans"), F.col("_cv_removed")).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))

    def count(k: int):
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")

    base = joined(F.filter("spans", lambda x: x["kind"] < 4))
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(4)], F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count(TERM).alias("n_term"), count(SECRET).alias("n_secret"), F.size("spans").cast("long").alias("n_spans"))


