"""Line dedup by a log-template tree.

A line's path in the tree has fixed depth: its number of tokens, then its leading tokens, tokens with a digit being
variable fields. Within a leaf, a token seen at its position in at least `min_docs` lines is constant and any other
is a variable field, so lines of a leaf generalise to templates without regard to their order. A template recurs
if enough of its tokens without a digit are constant and at least `MIN_DOCS` different texts have it that are mostly
their own: lines that travel with their whole document are copies of documents, which are not this operator's.
Thresholds are numbers of lines, documents and texts, the same at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Leading tokens in a path; least number of documents of a recurring template; least share of constants.
DEPTH = 3
MIN_DOCS = 10
MIN_CONSTANT = 0.8
FIELD = "<*>"
SPACE = "[\\x20\\x09-\\x0D]+"


def recurring_lines(docs: DataFrame, least: int = MIN_DOCS) -> DataFrame:
    """docs(doc_id, text) -> (_id, _row, _pos): lines, from 0, whose template recurs. _row: xxhash64 of the text, so repeated rows of one id with other texts stay apart."""
    d = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_row"), F.monotonically_increasing_id().alias("rid"), F.split("text", "\n").alias("ls"), F.length("text").alias("total")).where("ls is not null")
    lines = d.select("_id", "_row", "rid", "total", F.expr("""explode(transform(ls, (x, i) -> struct(
        i as pos, length(x) as chars, filter(split(x, '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '') as ws)))""").alias("l"))
    lines = lines.select("_id", "_row", "rid", "total", F.col("l.pos").alias("_pos"), F.col("l.chars").alias("chars"), F.col("l.ws").alias("ws")).where(F.size("ws") > 0)
    lead = F.transform(F.slice("ws", 1, DEPTH), lambda w: F.when(w.rlike("[0-9]"), F.lit(FIELD)).otherwise(w))
    lines = lines.withColumn("leaf", F.xxhash64(F.size("ws"), lead))
    popular = lines.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("leaf")
    popular = materialise(popular, "popular")  # tables of their own, so that joins on a hot leaf or template can be split
    # a token is told by a hash of leaf, place and word, and a field by nothing; a line by the number that its row is written with
    tokens = F.filter(F.transform("ws", lambda w, i: F.when(~(w.rlike("[0-9]") | (w == FIELD)), F.xxhash64("leaf", i, w))), lambda h: h.isNotNull())
    kept = lines.join(popular, "leaf").select("_id", "_row", "rid", "_pos", "chars", "total", tokens.alias("hs"), F.monotonically_increasing_id().alias("line"))
    kept = materialise(kept, "lines")
    words = kept.select("line", F.explode("hs").alias("h"))
    constant = words.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("h")
    constant = materialise(constant, "constant")
    # the tokens of a line that are constant: their number, and a sum that does not depend on order
    share = words.join(constant, "h").groupBy("line").agg(F.count(F.lit(1)).alias("fixed"), F.sum(F.col("h").cast("decimal(20,0)")).alias("shape"))
    tagged = kept.select("line", "rid", "_pos", "_id", "_row", "chars", "total", F.size("hs").alias("n")).join(share, "line").where(F.col("fixed") >= MIN_CONSTANT * F.col("n"))
    tagged = materialise(tagged.select("rid", "_pos", "_id", "_row", "chars", "total", F.xxhash64("shape", "fixed").alias("template")), "templates")
    docs_of = tagged.select("template", "_id", "_row").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n_docs"))
    frequent = materialise(docs_of.where(F.col("n_docs") >= least).select("template"), "frequent")
    hits = materialise(tagged.join(frequent, "template"), "hits")
    own = hits.groupBy("rid").agg(F.sum("chars").alias("chars"), F.max("total").alias("total")).where(2 * F.col("chars") <= F.col("total")).select("rid")
    found = hits.join(materialise(own, "own"), "rid").select("template", "_row").distinct().groupBy("template").agg(F.count(F.lit(1)).alias("n_texts")).where(F.col("n_texts") >= least).select("template")
    return hits.join(materialise(found, "found"), "template").select("_id", "_row", "_pos")


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs, any columns with doc_id and text -> the same rows with _cv_text (recurring lines gone), _cv_lines, _cv_dropped (array of line numbers).

    Null text: null, 0 lines, none dropped. Empty text: one line, kept. A document whose every line recurs keeps an
    empty text. Repeated rows are treated alike. Extra columns pass through untouched.
    """
    gone = recurring_lines(docs).groupBy("_id", "_row").agg(F.array_sort(F.collect_set("_pos")).alias("_cv_dropped"))
    gone = gone.withColumnRenamed("_id", "_cv_id").withColumnRenamed("_row", "_cv_row")
    out = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_cv_id")) & (F.xxhash64(docs["text"]) == F.col("_cv_row")), "left").drop("_cv_id", "_cv_row")
    kept = F.when(F.col("_cv_dropped").isNull(), F.col("text")).otherwise(F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_cv_dropped", i)), "\n"))
    return out.withColumn("_cv_text", kept).withColumn("_cv_lines", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")).withColumn("_cv_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("_cv_lines")).cast("long"))


def without_recurring_lines(docs: DataFrame) -> DataFrame:
    """The documents themselves, their recurring lines dropped; n_chars, where there, follows the text."""
    out = line_dedup(docs)
    cols = {"text": F.col("_cv_text"), "n_chars": F.when(F.col("_cv_dropped").isNull(), F.col("n_chars")).otherwise(F.length("_cv_text")).cast(dict(docs.dtypes).get("n_chars", "long")) if "n_chars" in docs.columns else None}
    return out.select(*[cols[c].alias(c) if cols.get(c) is not None else F.col(c) for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_cv_lines").alias("n_lines"),
        F.coalesce(F.size("_cv_dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.coalesce(F.array_join(F.col("_cv_dropped").cast("array<string>"), ","), F.lit("")).alias("dropped_lines"),
        F.coalesce(F.length("_cv_text"), F.lit(0)).cast("long").alias("n_chars_kept"),
    ).withColumn("n_dropped", F.when(F.col("n_dropped") < 0, F.lit(0)).otherwise(F.col("n_dropped")).cast("long"))


OP3_SQL = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
raw AS (SELECT rid, doc_id, text, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d WHERE text IS NOT NULL),
toks AS (SELECT *, list_transform(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{FIELD}' ELSE x END) AS ws FROM raw),
leafed AS (SELECT *, len(ws) AS n, ws[1:{DEPTH}] AS leads FROM toks WHERE len(ws) > 0),
popular AS (SELECT n, leads FROM leafed GROUP BY n, leads HAVING count(*) >= {MIN_DOCS}),
kept AS (SELECT l.* FROM leafed l JOIN popular p ON l.n = p.n AND l.leads = p.leads),
words AS (SELECT n, leads, rid, pos, unnest(ws) AS w, unnest(range(len(ws))) AS p FROM kept),
constant AS (SELECT n, leads, p, w FROM words WHERE w <> '{FIELD}' GROUP BY n, leads, p, w HAVING count(*) >= {MIN_DOCS}),
shaped AS (SELECT words.n, words.leads, rid, pos, string_agg(words.p || ':' || words.w, ' ' ORDER BY words.p) AS shape, count(*) AS fixed
  FROM words JOIN constant c ON words.n = c.n AND words.leads = c.leads AND words.p = c.p AND words.w = c.w GROUP BY ALL),
tagged AS (SELECT k.rid, k.doc_id, k.text, k.line, k.pos, s.n || '|' || array_to_string(s.leads, ' ') || '|' || s.shape AS template
  FROM kept k JOIN shaped s ON k.rid = s.rid AND k.pos = s.pos WHERE s.fixed >= {MIN_CONSTANT} * len(list_filter(k.ws, lambda x: x <> '{FIELD}'))),
hits AS (SELECT * FROM tagged WHERE template IN (SELECT template FROM tagged GROUP BY template HAVING count(DISTINCT (doc_id, text)) >= {MIN_DOCS})),
own AS (SELECT DISTINCT text FROM (SELECT text FROM hits GROUP BY rid, text HAVING 2 * sum(length(line)) <= length(text))),
recurs AS (SELECT template FROM hits JOIN own USING (text) GROUP BY template HAVING count(DISTINCT text) >= {MIN_DOCS}),
gone AS (SELECT rid, count(*) AS n_dropped, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS dropped_lines, list(pos) AS ps FROM hits JOIN recurs USING (template) GROUP BY rid)
SELECT o.doc_id, coalesce(len(o.ls), 0) AS n_lines, coalesce(g.n_dropped, 0) AS n_dropped, coalesce(g.dropped_lines, '') AS dropped_lines,
  CASE WHEN o.text IS NULL THEN 0 WHEN g.ps IS NULL THEN length(o.text)
    ELSE length(array_to_string(list_filter(list_transform(range(len(o.ls)), lambda i: CASE WHEN list_contains(g.ps, i) THEN NULL ELSE o.ls[i + 1] END), lambda x: x IS NOT NULL), chr(10))) END AS n_chars_kept
FROM d o LEFT JOIN gone g ON o.rid = g.rid
"""
