"""Queries over tables: profiling, comparison, set operations, limits (ids a*, p*, j1-j5, o*, u*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import compare as C
from corvane.operators import profile as P
from corvane.sources.tables import load, selected, selected_sql, values, values_sql, woven

CUSTOMER = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
QUANTILES = [0.0, 0.01, 0.25, 0.5, 0.9, 0.999, 1.0]
MESSY = "('1', '12'), ('2', ' 3.5 '), ('3', 'n/a'), ('4', '1_000'), ('5', NULL), ('6', '12d'), ('7', '-4e2'), ('8', 'NaN')"
NUMBER_SQL = r"CASE WHEN regexp_matches({0}, '^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$') THEN TRY_CAST(trim({0}) AS DOUBLE) END"
LEFT = "(' a1 ', '10'), ('a2', '20'), ('a3', 'x'), (NULL, '5'), ('a4', '7'), ('a4', '8'), ('', '1')"
RIGHT = "('a1', '10'), ('a2', '25.5'), ('a3', '3'), ('a5', '9'), ('a4', '7')"
# how a part's columns come into the rows
MESSY_PARTS = woven("a, b", MESSY, "part", "p_partkey", {"b": "CASE WHEN p_size < 25 THEN v.b ELSE v.b || CAST(p_size AS STRING) END"})
_KEY = {"k": "CASE WHEN v.k IS NULL THEN NULL WHEN trim(v.k) = '' THEN v.k ELSE concat(' a', p_partkey, ' ') END"}
LEFT_PARTS = woven("k, v", LEFT, "part", "p_partkey", _KEY, "coalesce(k, '')")
RIGHT_PARTS = woven("k, v", RIGHT, "part", "p_partkey", _KEY)
MANIFEST = "('d1', 'success'), ('d2', NULL), ('d3', 'failed')"
MANIFEST_PARTS = woven("id, status", MANIFEST, "part", "p_partkey", {"id": "concat(v.id, p_partkey)"})


def _union(parts):
    return " UNION ALL ".join(parts)


def old_new_docs(spark, d):
    """Two snapshots of the documents: French ones are new, Spanish ones removed, German ones changed."""
    docs = load(spark, d, "documents").withColumn("id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    old = docs.where("lang <> 'fr'").select("id", F.sha2("text", 256).alias("content_hash"))
    new = docs.where("lang <> 'es'").select("id", F.sha2(F.when(F.col("lang") == "de", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("content_hash"))
    return old, new


OLD_NEW_SQL = """old AS (SELECT 'd' || doc_id AS id, sha256(text) AS h FROM documents WHERE lang <> 'fr'),
 new AS (SELECT 'd' || doc_id AS id, sha256(CASE WHEN lang = 'de' THEN text || '!' ELSE text END) AS h FROM documents WHERE lang <> 'es')"""


def _orders(spark, d):
    """Two books of orders: one lacks pending orders, the other those of low priority, and its open orders cost more."""
    o = load(spark, d, "orders").withColumn("seq", F.col("o_orderkey").cast("double"))
    left = o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_totalprice", "seq")
    right = o.where("o_orderpriority <> '5-LOW'").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice") + 1.5).otherwise(F.col("o_totalprice")).alias("price2"), F.col("seq").alias("seq2"))
    return left, right


ORDERS_SQL = """l AS (SELECT o_orderkey, o_custkey, o_totalprice, CAST(o_orderkey AS DOUBLE) AS seq FROM orders WHERE o_orderstatus <> 'P'),
 r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'O' THEN o_totalprice + 1.5 ELSE o_totalprice END AS price2, CAST(o_orderkey AS DOUBLE) AS seq2 FROM orders WHERE o_orderpriority <> '5-LOW')"""
VERDICT_SQL = "CASE WHEN {1} - {0} IS NULL THEN 'missing' WHEN {1} - {0} = 0 THEN 'equal' ELSE 'mismatch' END"


#: Areas whose columns stand once for each part.
PART_AREAS = ("finance", "grades", "hr", "other")


def _per_part(s, d, area, columns):
    if area not in PART_AREAS:
        return columns
    return load(s, d, "part").select("p_partkey").crossJoin(columns).withColumn("column", F.concat_ws(" ", "column", F.col("p_partkey").cast("string"))).drop("p_partkey")


def queries():
    q = {}
    q["a01_column_profile"] = lambda s, d: P.column_profile(load(s, d, "customer"), CUSTOMER, "c_custkey")
    q["a02_numeric_stats"] = lambda s, d: P.numeric_stats(load(s, d, "lineitem"), NUMERIC)
    q["a02_quantiles"] = lambda s, d: P.quantiles(P.numbers(load(s, d, "lineitem"), NUMERIC), QUANTILES).select("column", "probability", F.round("value", 4).alias("value"))
    q["a03_categorical_stats"] = lambda s, d: P.categorical_stats(load(s, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])
    q["a04_group_mean"] = lambda s, d: P.group_mean(load(s, d, "customer"), "c_mktsegment", "c_acctbal")
    q["a05_distribution"] = lambda s, d: P.distribution(load(s, d, "events"), "event_type")
    q["a06_equal_width_bins"] = lambda s, d: P.equal_width_bins(load(s, d, "part"), "p_size")
    q["a30_subject"] = lambda s, d: P.subject(selected(s, d, TABLE_PARTS, "part").toDF("table", "column"))
    q["a31_insights"] = lambda s, d: P.insights(P.numeric_stats(load(s, d, "lineitem"), NUMERIC))
    q["a30_direction"] = lambda s, d: P.direction(selected(s, d, HAN_PARTS, "part").toDF("table", "column"))
    for area in (*P.AREAS, "other"):
        q[f"a31_area_{area}"] = lambda s, d, area=area: P.area_insights(_per_part(s, d, area, values(s, STAT_COLUMNS, STATS)).select("pos", "column", *[F.col(c).cast("double").alias(c) for c in ("mean", "median", "std", "min", "max", "sum")]), _per_part(s, d, area, values(s, "pos, column, unique_count", CATEGORIES)), area)
    q["p01_range_spec"] = lambda s, d: P.apply_range(load(s, d, "orders"), "o_orderkey", ["o_orderkey", "o_orderstatus", "o_totalprice", "absent"], (100, 1100), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})
    q["p02_numeric_coercion"] = lambda s, d: P.coerced(selected(s, d, MESSY_PARTS, "part"), ["a", "b"])
    q["p03_clean_pairs"] = lambda s, d: C.clean_pairs(selected(s, d, LEFT_PARTS, "part"), "k", "v")
    q["p04_drop_empty"] = lambda s, d: P.drop_empty(values(s, "a, b, c", "(1, CAST(NULL AS INT), 'x'), (CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS STRING)), (2, CAST(NULL AS INT), 'y')"))
    q["p05_successful"] = lambda s, d: C.successful(selected(s, d, MANIFEST_PARTS, "part").select("id", "status"))
    q["j01_compare"] = lambda s, d: C.compare(C.clean_pairs(selected(s, d, LEFT_PARTS, "part"), "k", "v"), C.clean_pairs(selected(s, d, RIGHT_PARTS, "part"), "k", "v"))
    q["j02_compare_many"] = lambda s, d: C.compare_many(*_orders(s, d), ["o_orderkey", "o_custkey"], [("o_totalprice", "price2"), ("seq", "seq2")])
    q["j03_union_files"] = lambda s, d: C.union_files(load(s, d, "nation").select("n_name", F.col("n_regionkey").cast("string").alias("n_comment")), load(s, d, "region").select(F.col("r_name").alias("n_name"), F.col("r_regionkey").cast("string").alias("region_only")))
    q["j04_same_names"] = lambda s, d: C.same_names(load(s, d, "customer").select(F.replace("c_name", F.lit("Customer"), F.lit("")).alias("name")), load(s, d, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("")).alias("name")).union(load(s, d, "nation").select(F.col("n_name"))))
    q["j05_common_columns"] = lambda s, d: s.createDataFrame([(c,) for c in C.common_columns(load(s, d, "documents"), load(s, d, "labels"))], "column string")
    q["j10_snapshot_diff"] = lambda s, d: C.snapshot_diff(*old_new_docs(s, d))
    q["a11_upsert"] = lambda s, d: C.upsert(load(s, d, "supplier").select(F.col("s_suppkey").alias("id"), "s_name"), load(s, d, "supplier").where("s_acctbal < 2000").select((F.col("s_suppkey") + 2).alias("id"), F.upper("s_name").alias("s_name")), load(s, d, "supplier").where("s_acctbal > 9000").select(F.col("s_suppkey").alias("id")))
    q["a13_per_source"] = lambda s, d: load(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("document_count"))
    q["a17_batch_tally"] = lambda s, d: load(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "error").alias("success"), F.count_if(F.col("event_type") == "error").alias("failed"))
    q["o01_global_sort"] = lambda s, d: load(s, d, "orders").groupBy("o_custkey").agg(F.round(F.sum("o_totalprice"), 2).alias("total")).orderBy(F.desc("total"), "o_custkey")
    q["o05_capped"] = lambda s, d: P.capped(load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), 500, ["l_orderkey", "l_linenumber", "l_quantity"])
    q["o06_preview"] = lambda s, d: P.preview(load(s, d, "nation").select("n_name", F.when(F.col("n_nationkey") > 3, F.col("n_nationkey")).alias("n_nationkey")), ["n_name"])
    q["u01_token_sets"] = lambda s, d: load(s, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_intersect(F.split("p_name", " "), F.array(F.lit("red"), F.lit("bolt"), F.lit("ring")))), ",").alias("common"), F.size(F.array_union(F.split("p_name", " "), F.array(F.lit("red"), F.lit("bolt"), F.lit("ring")))).cast("long").alias("n_union"))
    q["u02_difference"] = lambda s, d: load(s, d, "documents").select("doc_id").exceptAll(load(s, d, "labels").select("doc_id").distinct())
    q["u03_union_of_changes"] = lambda s, d: C.snapshot_diff(*old_new_docs(s, d)).where("change = 'new'").select("id").union(C.snapshot_diff(*old_new_docs(s, d)).where("change = 'changed'").select("id")).distinct()
    q["u04_first_occurrence"] = lambda s, d: C.first_occurrences(load(s, d, "conversations").withColumn("pos", F.col("conv_id") * 1000 + F.col("turn")).withColumn("word", F.element_at(F.split("text", " "), 1)), "word", "pos")
    q["u05_concat_upsert"] = lambda s, d: C.newest(load(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("ord")).union(load(s, d, "orders").select("o_custkey", (F.col("o_orderkey") + 7).alias("ord"))), "o_custkey", "ord")
    return q


TABLE_COLUMNS = "('lineitem', 'l_extendedprice'), ('lineitem', 'l_discount'), ('lineitem', 'l_tax'), ('lineitem', 'l_quantity'), ('orders', 'o_orderkey'), ('orders', 'o_custkey'), ('orders', 'o_orderpriority'), ('region', 'r_name')"


TABLE_PARTS = f"SELECT concat(f.t, '-', p_partkey) AS t, f.c AS c FROM {{part}} JOIN (SELECT * FROM (VALUES {TABLE_COLUMNS}) AS v(t, c)) f ON f.t = CASE p_partkey % 3 WHEN 0 THEN 'lineitem' WHEN 1 THEN 'orders' ELSE 'region' END"
HAN_COLUMNS = "('t1', '销售收入'), ('t1', '客户'), ('t1', '班级'), ('t2', '学生'), ('t2', '课程成绩'), ('t3', '名称')"
#: Each part is one of the tables.
HAN_PARTS = f"SELECT concat(f.t, '-', p_partkey) AS t, f.c AS c FROM {{part}} JOIN (SELECT * FROM (VALUES {HAN_COLUMNS}) AS v(t, c)) f ON f.t = concat('t', p_partkey % 3 + 1)"
STAT_COLUMNS = "pos, column, mean, median, std, min, max, sum"
STATS = "(0, '销售收入', 10.5, 9.0, 2.25, 1.0, 20.0, 105.0), (1, '成本', 4.0, 4.0, CAST(NULL AS DOUBLE), 4.0, 4.0, 4.0), (2, '绩效评分', 88.126, 90.0, 3.5, 60.0, 99.0, 881.26), (3, '工资', 5000.0, 4800.0, 100.0, 4000.0, 9000.0, 50000.0), (4, '考试分数', 91.0, 92.0, 1.0, 80.0, 99.0, 910.0)"
CATEGORIES = "(0, '部门', 4), (1, '班级', 25), (2, '教师', 12), (3, '学科', 3)"


def oracle_sql():
    q = {}
    q["a01_column_profile"] = f"""WITH cells AS ({_union(f"SELECT c_custkey AS k, '{c}' AS col, CAST({c} AS VARCHAR) AS v FROM customer" for c in CUSTOMER)}),
 per AS (SELECT col, v, count(*) AS n, min(k) AS first FROM cells GROUP BY col, v),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v IS NULL, first, v) AS rk FROM per)
 SELECT col AS "column", CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS null_count, count(v) AS unique_count, coalesce(string_agg(v, '|' ORDER BY rk) FILTER (rk <= 3), '') AS samples FROM ranked GROUP BY col"""
    stats = _union(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(stddev_samp({c}), 4) AS std, min({c}) AS min, max({c}) AS max, round(sum({c}), 2) AS sum FROM lineitem""" for c in NUMERIC)
    q["a02_numeric_stats"] = stats
    q["a02_quantiles"] = _union(f"""SELECT '{c}' AS "column", {p}::DOUBLE AS probability, round(quantile_cont({c}, {p}), 4) AS value FROM lineitem""" for c in NUMERIC for p in QUANTILES)
    q["a03_categorical_stats"] = f"""WITH cells AS ({_union(f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value FROM lineitem" for c in ["l_returnflag", "l_linestatus", "l_linenumber"])}),
 per AS (SELECT "column", value, count(*) AS n FROM cells GROUP BY "column", value), whole AS (SELECT "column", count(value) AS unique_count, CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS null_count FROM per GROUP BY "column"),
 best AS (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM per WHERE value IS NOT NULL)
 SELECT "column", unique_count, null_count, value, n, rank FROM best JOIN whole USING ("column") WHERE rank <= 10"""
    q["a04_group_mean"] = "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS mean FROM customer WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment"
    q["a05_distribution"] = "SELECT event_type, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM events), 1) AS percent FROM events GROUP BY event_type"
    q["a06_equal_width_bins"] = "WITH e AS (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part) SELECT CAST(greatest(1, ceil((p_size - lo) / ((hi - lo) / 5.0))) AS INTEGER) AS bin, count(*) AS n FROM part, e GROUP BY 1"
    scores = {k: " + ".join(f"CAST(contains(a, '{w}') AS INTEGER)" for w in ws) for k, ws in P.SUBJECTS.items()}
    keys = sorted(scores)
    q["a30_subject"] = f"""WITH j AS (SELECT "table", string_agg(lower("column"), ' ' ORDER BY lower("column")) AS a FROM (SELECT t AS "table", c AS "column" FROM {selected_sql(TABLE_PARTS, 'part')}) GROUP BY "table"),
 s AS (SELECT "table", {", ".join(f"{scores[k]} AS n_{k}" for k in keys)} FROM j)
 SELECT *, CASE WHEN greatest({", ".join("n_" + k for k in keys)}) = 0 THEN 'general' {" ".join(f"WHEN n_{k} = greatest({', '.join('n_' + x for x in keys)}) THEN '{k}'" for k in keys)} END AS subject FROM s"""
    q["a31_insights"] = f"""WITH s AS ({stats}), k AS (SELECT *, regexp_matches("column", 'price|cost|amount|balance|acctbal') AS money, regexp_matches("column", 'quantity|size|count') AS cnt, regexp_matches("column", 'discount|tax|rate') AS share FROM s)
 SELECT "column", CASE WHEN money THEN 'finance' WHEN cnt THEN 'sales' WHEN share THEN 'research' ELSE 'general' END AS area,
 CASE WHEN money THEN printf('%s: total %.2f, mean %.2f', "column", sum, mean) WHEN cnt THEN printf('%s: from %.2f to %.2f', "column", min, max)
 WHEN share THEN "column" || CASE WHEN mean >= 0.05 THEN ': high' WHEN mean >= 0.02 THEN ': middle' ELSE ': low' END ELSE "column" END AS text FROM k"""
    q["a30_direction"] = "SELECT f.t || '-' || p_partkey AS \"table\", n_company, n_academic, direction FROM part JOIN (VALUES ('t1', 3, 1, 'company'), ('t2', 0, 3, 'academic'), ('t3', 0, 0, 'general')) AS f(t, n_company, n_academic, direction) ON f.t = concat('t', p_partkey % 3 + 1)"
    head = "AS t(\"column\", metric, value)"
    q["a31_area_finance"] = f"SELECT \"column\" || ' ' || p_partkey AS \"column\", metric, value FROM part CROSS JOIN (VALUES ('销售收入', 'mean', '10.50'), ('成本', 'mean', '4.00')) {head}"
    q["a31_area_sales"] = f"SELECT * FROM (VALUES ('销售收入', 'sum', '105.00'), ('销售收入', 'mean', '10.50'), ('销售收入', 'max', '20.00'), ('销售收入', 'min', '1.00'), ('部门', 'unique', '4'), ('教师', 'unique', '12'), ('学科', 'unique', '3')) {head}"
    q["a31_area_hr"] = f"SELECT \"column\" || ' ' || p_partkey AS \"column\", metric, value FROM part CROSS JOIN (VALUES ('绩效评分', 'mean', '88.13'), ('工资', 'mean', '5000.00'), ('工资', 'median', '4800.00'), ('部门', 'unique', '4')) {head}"
    q["a31_area_grades"] = f"SELECT \"column\" || ' ' || p_partkey AS \"column\", metric, value FROM part CROSS JOIN (VALUES ('绩效评分', 'mean', '88.13'), ('绩效评分', 'std', '3.50'), ('绩效评分', 'band', 'good'), ('考试分数', 'mean', '91.00'), ('考试分数', 'std', '1.00'), ('考试分数', 'band', 'excellent'), ('班级', 'unique', '25'), ('学科', 'unique', '3')) {head}"
    q["a31_area_teaching"] = f"SELECT * FROM (VALUES ('绩效评分', 'mean', '88.13'), ('教师', 'unique', '12')) {head}"
    q["a31_area_research"] = f"SELECT \"column\", 'mean' AS metric, printf('%.2f', CAST(mean AS DOUBLE)) AS value FROM {values_sql(STAT_COLUMNS.replace('column', chr(34) + 'column' + chr(34)), STATS)} UNION ALL SELECT \"column\", 'std', printf('%.2f', CAST(std AS DOUBLE)) FROM {values_sql(STAT_COLUMNS.replace('column', chr(34) + 'column' + chr(34)), STATS)} WHERE std IS NOT NULL UNION ALL SELECT \"column\", 'unique', CAST(unique_count AS VARCHAR) FROM {values_sql('pos, ' + chr(34) + 'column' + chr(34) + ', unique_count', CATEGORIES)} WHERE unique_count <= 10"
    q["a31_area_other"] = f"SELECT \"column\" || ' ' || p_partkey AS \"column\", metric, value FROM part CROSS JOIN (VALUES ('销售收入', 'mean', '10.50'), ('成本', 'mean', '4.00'), ('绩效评分', 'mean', '88.13'), ('部门', 'unique', '4'), ('班级', 'unique', '25'), ('教师', 'unique', '12')) {head}"
    q["p01_range_spec"] = "WITH n AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) SELECT o_orderkey, o_orderstatus, o_totalprice FROM n WHERE rn > 100 AND rn <= 1100 AND o_orderstatus = 'F'"
    q["p02_numeric_coercion"] = f"""WITH cells AS (SELECT 'a' AS "column", a AS v FROM {selected_sql(MESSY_PARTS, "part")} UNION ALL SELECT 'b', b FROM {selected_sql(MESSY_PARTS, "part")})
 SELECT "column", count(v) AS n_values, count({NUMBER_SQL.format("v")}) AS n_numeric, count({NUMBER_SQL.format("v")}) > 0 AS is_numeric FROM cells GROUP BY "column" """
    clean = lambda rows: f"(SELECT trim(k) AS key, {NUMBER_SQL.format('v')} AS value FROM {selected_sql(rows, 'part')} WHERE k IS NOT NULL AND trim(k) <> '')"
    q["p03_clean_pairs"] = f"SELECT * FROM {clean(LEFT_PARTS)}"
    q["p04_drop_empty"] = "SELECT * FROM (VALUES (1, 'x'), (2, 'y')) AS t(a, c)"
    q["p05_successful"] = f"SELECT id, status FROM {selected_sql(MANIFEST_PARTS, 'part')} WHERE coalesce(status, 'success') = 'success'"
    q["j01_compare"] = f"""SELECT coalesce(l.key, r.key) AS key, l.value AS left_value, r.value AS right_value, round(r.value - l.value, 4) AS diff, {VERDICT_SQL.format("l.value", "r.value")} AS verdict FROM {clean(LEFT_PARTS)} l FULL JOIN {clean(RIGHT_PARTS)} r ON l.key = r.key"""
    q["j02_compare_many"] = f"""WITH {ORDERS_SQL}, j AS (SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, coalesce(l.o_custkey, r.o_custkey) AS o_custkey, o_totalprice, price2, seq, seq2 FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey AND l.o_custkey = r.o_custkey),
 c AS (SELECT o_orderkey, o_custkey, 'o_totalprice' AS field, o_totalprice AS left_value, price2 AS right_value FROM j UNION ALL SELECT o_orderkey, o_custkey, 'seq', seq, seq2 FROM j)
 SELECT *, round(right_value - left_value, 4) AS diff, {VERDICT_SQL.format("left_value", "right_value")} AS verdict FROM c"""
    q["j03_union_files"] = "SELECT n_name, n_comment, CAST(NULL AS VARCHAR) AS region_only FROM (SELECT n_name, CAST(n_regionkey AS VARCHAR) AS n_comment FROM nation) UNION ALL SELECT r_name, NULL, CAST(r_regionkey AS VARCHAR) FROM region"
    q["j04_same_names"] = """WITH l AS (SELECT DISTINCT replace(c_name, 'Customer', '') AS name FROM customer), r AS (SELECT replace(s_name, 'Supplier', '') AS name FROM supplier UNION SELECT n_name FROM nation)
 SELECT coalesce(l.name, r.name) AS name, CASE WHEN r.name IS NULL THEN 'left' WHEN l.name IS NULL THEN 'right' ELSE 'both' END AS side FROM l FULL JOIN r ON l.name = r.name"""
    q["j05_common_columns"] = "SELECT 'doc_id' AS column"
    diff = "SELECT coalesce(old.id, new.id) AS id, CASE WHEN old.id IS NULL THEN 'new' WHEN new.id IS NULL THEN 'removed' WHEN old.h = new.h THEN 'unchanged' ELSE 'changed' END AS change FROM old FULL JOIN new ON old.id = new.id"
    q["j10_snapshot_diff"] = f"WITH {OLD_NEW_SQL} {diff}"
    q["a11_upsert"] = """WITH n AS (SELECT s_suppkey + 2 AS id, upper(s_name) AS s_name FROM supplier WHERE s_acctbal < 2000), g AS (SELECT id FROM n UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 9000)
 SELECT s_suppkey AS id, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT id FROM g) UNION ALL SELECT id, s_name FROM n"""
    q["a13_per_source"] = "SELECT source, count(*) AS document_count FROM documents GROUP BY source"
    q["a17_batch_tally"] = "SELECT user_id, count(*) AS total, count(*) FILTER (event_type <> 'error') AS success, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY user_id"
    q["o01_global_sort"] = "SELECT o_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey"
    q["o05_capped"] = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY 1, 2, 3 LIMIT 500"
    q["o06_preview"] = "SELECT n_name, coalesce(CAST(CASE WHEN n_nationkey > 3 THEN n_nationkey END AS VARCHAR), '') AS n_nationkey FROM nation ORDER BY n_name LIMIT 200"
    q["u01_token_sets"] = "SELECT p_partkey, coalesce(array_to_string(list_sort(list_intersect(string_split(p_name, ' '), ['red', 'bolt', 'ring'])), ','), '') AS common, CAST(len(list_distinct(list_concat(string_split(p_name, ' '), ['red', 'bolt', 'ring']))) AS BIGINT) AS n_union FROM part"
    q["u02_difference"] = "SELECT doc_id FROM documents EXCEPT ALL SELECT DISTINCT doc_id FROM labels"
    q["u03_union_of_changes"] = f"WITH {OLD_NEW_SQL}, x AS ({diff}) SELECT DISTINCT id FROM x WHERE change IN ('new', 'changed')"
    q["u04_first_occurrence"] = "SELECT string_split(text, ' ')[1] AS word, min(conv_id * 1000 + turn) AS first_pos FROM conversations GROUP BY 1"
    q["u05_concat_upsert"] = "SELECT o_custkey, max(o_orderkey) + 7 AS ord FROM orders GROUP BY o_custkey"
    return q
