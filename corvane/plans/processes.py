"""Queries of matching, slides, timetables, workflows, operation lists and progress (ids j6-j9, j13-j17, w1, w11-w13, a18-a25, a27, g*, f23-f26, f35, o3-o4, p11-p14, r8, t*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import match as M
from corvane.operators import schedule as S
from corvane.operators import slides as D
from corvane.operators import workflow as W
from corvane.plans import operations
from corvane.sources.tables import load, scratch, selected, selected_sql, values, values_sql, woven
from corvane.streaming import progress as G

SLOTS = "(1, 's1', 11, 'Title 1', 40, 'Old heading', 1, 400.0, 80.0, 32.0, 1), (1, 's2', 12, 'Body', 200, 'A body text of some length that stands here already', 5, 300.0, 200.0, CAST(NULL AS DOUBLE), 2), (2, 's3', 13, 'Title 1', 30, 'Name', 1, 60.0, 30.0, 26.0, 1), (2, 's4', 14, 'Foot', 660, 'page', 1, 100.0, 20.0, 10.0, 1)"
SLOT_COLUMNS = "slide, slot_id, shape_id, shape_name, top, text, n_text, width, height, font_px, old_paragraphs"
PLAN = "(1, 1, 's1', NULL, NULL, 'Hello'), (2, 1, NULL, 12, 'x', 'Some words'), (3, 2, NULL, 99, 'Title 1', 'A text that is far too long for its slot'), (4, 2, 'zz', NULL, NULL, 'lost')"
EDITS = "(1, 't1', 0, 0), (2, 't1', 5, 0), (3, 't1', 1, 9), (4, 'zz', 0, 0)"
SIZES = "('t1', 3, 4)"
REFS = "('Mon 1-2'), ('Tue'), ('Wed morning'), ('Thu afternoon'), ('whenever'), ('Mon 1-2 Mon 2-3')"
SPEECH = "('2 consecutive, prefers morning'), ('must not clash'), ('should avoid Friday; prefer afternoon'), ('x')"
PIPES = "(1, '| a | b |~| --- | --- |~| 1 | |~|  | 2 |'), (2, 'no table')"
ERRORS = "(1, 'build', 'disk full on node'), (2, 'build', 'timeout after 3 s'), (3, 'test', 'disk full'), (4, 'build', 'odd')"
RULES = "(1, 'build', 'timeout', 'retry'), (2, 'build', 'disk', 'clean'), (3, 'build', 'full', 'stop')"
REQUESTS = "('Make a knowledge index'), ('compare excel tables'), ('new deck please'), ('format my paper'), ('hello')"
# a part asks and says one of these, fails in one of these ways, and has one of the folders
SPEECH_PARTS = woven("t", SPEECH, "part", "p_partkey", {"t": "concat(v.t, ' ', p_name)"})
#: Each part says one of the forms as it stands.
SPEECH_FORMS = woven("t", SPEECH, "part", "p_partkey", {})
REQUEST_PARTS = woven("request", REQUESTS, "part", "p_partkey", {"request": "concat(v.request, ' ', p_name)"})
ERROR_PARTS = woven("error_id, step, message", ERRORS, "part", "p_partkey", {"error_id": "p_partkey", "message": "concat(v.message, ' ', p_name)"})
FILES = "('p', 'b.txt', false), ('p', '.git', true), ('p', 'src', true), ('p', 'a.log', false), ('p', 'a.txt', false), ('q', 'node_modules', true)"
FOLDERS = f"SELECT concat(v.folder, p_partkey) AS folder, CASE WHEN v.is_dir THEN v.name ELSE concat(substr(v.name, 1, 1), p_size, substr(v.name, 2, 9)) END AS name, v.is_dir AS is_dir FROM {{part}} JOIN (SELECT * FROM (VALUES {FILES}) AS t(folder, name, is_dir)) v ON CASE WHEN p_partkey % 3 = 0 THEN 'q' ELSE 'p' END = v.folder"
FONTS = ("('SimSun'), ('Foo'), ('Bar'), ('Odd')", "('Foo', 'Helvetica')", "('Foo', 0, 'Kai'), ('Bar', 0, 'None'), ('Bar', 1, 'Kai')", "('SimSun'), ('Kai')")
PARTS = "('a', 'b'), ('b', 'c'), ('c', 'a'), ('c', 'd'), ('x', 'y')"
IMAGES = "('p1', 'aa', 1.5), ('p1', 'bb', 1.0), (NULL, 'cc', 2.0), (NULL, 'cc', 2.0)"
IMAGE_PARTS = woven("part, blob, ratio", IMAGES, "part", "p_partkey", {"part": "v.part || p_brand", "blob": "v.blob || CAST(p_size AS STRING)"}, "blob, ratio")
USED = ("(0, 'h1'), (1, 'h2'), (2, 'h1'), (3, 'h9')", "(5, 'h1'), (6, 'h1'), (7, 'h2')")


def _turns(s, d):
    """Conversations as decks: a turn is a slide; user turns from the second on are numbered titles."""
    c = load(s, d, "conversations")
    n = F.row_number().over(__import__("pyspark").sql.Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    c = c.withColumn("n", n)
    title = F.when((F.col("role") == "user") & (F.col("n") > 1), F.concat(F.lpad((F.col("n") % 4).cast("string"), 2, "0"), F.lit(" part"))).otherwise(F.lit("untitled"))
    return c.select(F.col("conv_id").alias("deck"), "n", title.alias("title"), "text")


TURNS_SQL = """turns AS (SELECT conv_id AS deck, n, CASE WHEN role = 'user' AND n > 1 THEN lpad(CAST(n % 4 AS VARCHAR), 2, '0') || ' part' ELSE 'untitled' END AS title, text
 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS n FROM conversations))"""


def _events(s, d):
    e = load(s, d, "events")
    return e.select("user_id", F.date_format("ts", "yyyy-MM-dd HH").alias("hour"), "event_type", "value")


def _slots(s):
    return values(s, SLOT_COLUMNS, SLOTS).select("slide", "slot_id", F.col("shape_id").cast("string").alias("shape_id"), "shape_name", "top", "text", "n_text", "old_paragraphs", *[F.col(c).cast("double").alias(c) for c in ("width", "height", "font_px")])


def _with_roles(s):
    x = _slots(s)
    return x.join(D.slot_roles(x), ["slide", "slot_id"])


def _plan(s):
    return values(s, "plan_row, slide, slot_id, shape_id, shape_name, text", PLAN)


def _assigned(s, d):
    """Line items as assignments: suppliers teach, parts are courses, days and periods from the ship date and line."""
    x = load(s, d, "lineitem")
    day = F.element_at(F.array(*[F.lit(k) for k in S.DAYS]), (F.dayofmonth("l_shipdate") % 5 + 1).cast("int"))
    return x.select(F.col("l_suppkey").alias("teacher"), F.format_string("c%06d", "l_partkey").alias("course"), day.alias("day"), F.col("l_linenumber").alias("period"), (F.col("l_quantity") % 4).cast("int").alias("hours"))


ASSIGNED_SQL = "a AS (SELECT l_suppkey AS teacher, printf('c%06d', l_partkey) AS course, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri'][CAST(day(l_shipdate) % 5 + 1 AS INTEGER)] AS day, l_linenumber AS period, CAST(l_quantity % 4 AS INTEGER) AS hours FROM lineitem)"


def _progress(s, d):
    return G.parse(G.log_lines(load(s, d, "events")))


def _stream(s, d):
    """The progress log as text files, folded as a stream to its end; the last state of each task."""
    base = scratch(s, "progress")
    G.log_lines(load(s, d, "events")).write.text(f"{base}/in")
    G.run_stream(s, f"{base}/in", f"{base}/out", f"{base}/offsets")
    return G.last_states(s, f"{base}/out")


def _run(s, d):
    """Orders as workflows of steps: a customer's orders in turn, priorities as strategies."""
    o = load(s, d, "orders")
    strategy = F.when(F.col("o_orderpriority").startswith("1"), "skip").when(F.col("o_orderpriority").startswith("2"), "retry").when(F.col("o_orderpriority").startswith("3"), "fail")
    return o.select(F.col("o_custkey").alias("workflow"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("s"), "o_orderkey").alias("id"), (F.col("o_orderkey") % 5 != 0).alias("condition"), (F.col("o_orderstatus") != "F").alias("success"), strategy.alias("strategy"))


def _step_events(s, d):
    kind = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("other")
    return load(s, d, "events").select(F.col("user_id").alias("project"), F.col("event_id").alias("seq"), F.date_format("ts", "HH").alias("step"), kind.alias("event"), F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string")).otherwise("").alias("output"))


MATRIX = ("('intro', 'a', 'structure ia'), ('intro', 'g', 'structure ig'), ('defense', 'g', 'structure dg')", "('plain', 'grey'), ('tech', 'blue')", "('a', 'impact'), ('g', 'balance')")


def _choices(s, d):
    c = load(s, d, "customer")
    k = F.col("c_custkey")
    return c.select(k.alias("project"), F.when(k % 3 == 0, "intro").when(k % 3 == 1, "defense").alias("type"), F.when(k % 4 == 0, "tech").when(k % 4 == 1, "odd").alias("style"), F.when(k % 5 < 2, "a").when(k % 5 == 2, "g").alias("track"))


def _leaves(s, d, override):
    """Nested settings of each part: the override changes leaves, subtrees and leaves above them."""
    p = load(s, d, "part").select(F.col("p_partkey").alias("config"), F.col("p_name").alias("v"))
    k = F.col("config")
    paths = F.when(k % 3 == 0, F.array(F.lit("a.b.c"), F.lit("n"))).when(k % 3 == 1, F.array(F.lit("a.b"))).otherwise(F.array(F.lit("t.x"), F.lit("a.q"))) if override else F.array(*[F.lit(x) for x in ("a.b.c", "a.b.d", "a.bc", "t", "u.v")])
    return p.select("config", F.explode(paths).alias("path"), F.col("v").alias("value")).withColumn("value", F.concat(F.lit("new " if override else "old "), "value"))


def queries():
    q = {}
    q["c01_run_steps"] = lambda s, d: W.run_steps(_run(s, d))
    q["c03_step_states"] = lambda s, d: W.step_states(_step_events(s, d))
    q["c05_chosen_config"] = lambda s, d: W.chosen_config(_choices(s, d), values(s, "type, track, structure", MATRIX[0]), values(s, "style, visual", MATRIX[1]), values(s, "track, focus", MATRIX[2]), ("intro", "plain", "g"))
    q["c05_core_points"] = lambda s, d: W.core_points(load(s, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderkey").alias("pos"), F.concat_ws(" ", F.lit("order"), "o_orderpriority", "o_orderstatus").alias("text")))
    q["f29_deep_merge"] = lambda s, d: W.deep_merge(_leaves(s, d, False), _leaves(s, d, True))
    q["t02_fold_stream"] = _stream
    q["j13_named_lookup"] = lambda s, d: S.named(values(s, "course, who", "('a', 'Li'), ('b', 'Wu'), ('c', 'Xi')"), values(s, "pos, name, id", "(1, 'Li', 't1'), (2, 'Li', 't2'), (3, 'Wu', 't3')"), "who", "teacher")
    q["j14_slot_lookup"] = lambda s, d: D.slot_lookup(_plan(s).withColumn("shape_id", F.col("shape_id").cast("string")), _slots(s))
    q["j15_cell_errors"] = lambda s, d: D.cell_errors(values(s, "edit, table_id, row, col", EDITS), values(s, "table_id, n_rows, n_cols", SIZES))
    q["j16_image_occurrences"] = lambda s, d: M.occurrences(values(s, "pos, hash", USED[0]), values(s, "idx, hash", USED[1]))
    q["j17_fonts"] = lambda s, d: W.resolve_fonts(values(s, "font", FONTS[0]), values(s, "font, alias", FONTS[1]), values(s, "font, pos, fallback", FONTS[2]), values(s, "name", FONTS[3]))
    q["w01_outline"] = lambda s, d: D.outline(_turns(s, d))
    q["w11_page_types"] = lambda s, d: D.page_types(_turns(s, d).withColumn("n_slots", F.size(F.split("text", "\n"))))
    q["w12_slot_roles"] = lambda s, d: D.slot_roles(_slots(s))
    q["w13_key_points"] = lambda s, d: D.key_points(_turns(s, d).select("deck", "n", F.posexplode(F.split("text", "\n")).alias("pos", "text")))
    q["a18_check_summary"] = lambda s, d: D.check_summary(_checked_parts(s, d))
    q["r08_check_plan"] = lambda s, d: _checked(s)
    q["f35_fit"] = lambda s, d: D.fit(_with_roles(s).select("*", F.col("text").alias("old_text"), F.lit(2).alias("new_paragraphs")).withColumn("text", F.concat(F.lit("some text for "), "shape_name")))
    q["a19_violations"] = lambda s, d: S.violations(_events(s, d), ["user_id", "event_type"], "hour")
    q["a20_statistics"] = lambda s, d: S.statistics(_assigned(s, d), values(s, "teacher, wish", "(1, 'morning'), (2, 'afternoon')"))
    q["a21_view"] = lambda s, d: S.view(_assigned(s, d), "teacher").na.fill("")
    q["a22_progress"] = lambda s, d: G.fold(_progress(s, d)).select("task_id", "percent")
    q["a23_dashboard"] = lambda s, d: W.dashboard(load(s, d, "documents").select(F.col("source").alias("project"), F.when(F.col("lang") == "en", "artifact").otherwise("input").alias("kind"), F.col("n_chars").alias("bytes")), load(s, d, "documents").select(F.col("source").alias("project"), F.when(F.col("lang") == "de", "document").when((F.col("lang") == "fr") & (F.col("source") != "src3"), "knowledge").otherwise("other").alias("agent"), F.when(F.col("n_chars") > 2000, "completed").otherwise("running").alias("status")))
    q["a24_slide_content"] = lambda s, d: D.rollup_content(decks(s, d))
    q["a25_deck_insights"] = lambda s, d: D.deck_insights(D.rollup_content(decks(s, d)), load(s, d, "part").select(F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("deck"), (F.col("p_size") % 7).alias("n_points"), (F.col("p_size") % 3).alias("n_warnings")))
    q["a25_empty_slides"] = lambda s, d: D.empty_slides(D.rollup_content(decks(s, d)))
    q["a27_image_usage"] = lambda s, d: W.image_usage(selected(s, d, IMAGE_PARTS, "part"))
    q["g04_reachable"] = lambda s, d: W.reachable(values(s, "part", "('a')"), values(s, "source, target", PARTS))
    q["f23_time_slots"] = lambda s, d: values(s, "t", REFS).select("t", F.array_join(S.time_slots(F.col("t")), ",").alias("slots"))
    q["f24_speech"] = lambda s, d: selected(s, d, SPEECH_FORMS, "part").select("t", S.consecutive(F.col("t")).alias("n"), F.coalesce(S.preference(F.col("t")), F.lit("")).alias("wish")).distinct()
    q["f25_table_rows"] = lambda s, d: values(s, "id, t", PIPES).select("id", F.array_join(F.transform(S.table_rows(F.replace("t", F.lit("~"), F.lit("\n"))), lambda r: F.array_join(r, ";")), "/").alias("rows"))
    q["f26_constraints"] = lambda s, d: selected(s, d, SPEECH_PARTS, "part").select("p_partkey", "t", S.classify_constraint(F.col("t")).alias("kind"))
    q["p11_error_rules"] = lambda s, d: W.match_errors(selected(s, d, ERROR_PARTS, "part").drop("p_partkey"), values(s, "pos, step, scenario, action", RULES))
    q["p12_select_workflow"] = lambda s, d: W.select_workflow(selected(s, d, REQUEST_PARTS, "part").select("request"))
    q["p13_exported"] = lambda s, d: W.exported(selected(s, d, FOLDERS, "part"))
    q["p14_listing"] = lambda s, d: W.listing(selected(s, d, FOLDERS, "part"))
    q["x_operation_list"] = lambda s, d: operations.compile_operations(load(s, d, "lineitem"), OPERATIONS)
    q["x_operation_pivot"] = lambda s, d: operations.compile_operations(load(s, d, "orders"), [{"type": "filter", "column": "o_totalprice", "condition": ">1000"}, {"type": "merge", "table": "customer", "on": ["o_custkey"]}, {"type": "pivot", "index": "c_mktsegment", "column": "o_orderstatus", "values": ["F", "O", "P"], "value": "cents"}], {"customer": load(s, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", F.lit(1).cast("long").alias("cents"))})
    q["t01_parse"] = lambda s, d: _progress(s, d).select("type", "task_id", F.coalesce("step_id", F.lit("")).alias("step_id"), "percent", "seq")
    q["t02_fold"] = lambda s, d: G.fold(_progress(s, d))
    q["t03_tracked_steps"] = lambda s, d: G.tracked_steps(_progress(s, d))
    return q


OPERATIONS = [
    {"type": "filter", "column": "l_quantity", "condition": "<10"},
    {"type": "filter", "column": "l_returnflag", "condition": "= R"},
    {"type": "compute", "column": "net", "formula": "l_extendedprice * (1 - l_discount) / 2 + 1"},
    {"type": "select", "columns": ["l_orderkey", "l_linenumber", "net"]},
    {"type": "sort", "column": "l_orderkey", "ascending": False},
]


def _checked(s):
    return D.check_plan(_plan(s).withColumn("shape_id", F.col("shape_id").cast("string")), _with_roles(s)).withColumn("slot_id", F.coalesce("slot_id", F.lit("")))


def _checked_parts(s, d):
    """A plan for the slides of each part: slides, slots and rows carry its key."""
    part, k = load(s, d, "part").select("p_partkey"), F.col("p_partkey")
    own = lambda x: x.crossJoin(part).withColumns({"slide": k * 10 + F.col("slide"), "slot_id": F.concat("slot_id", F.lit("-"), k.cast("string"))}).withColumn("shape_id", F.col("shape_id").cast("string"))
    slots = own(_slots(s)).drop("p_partkey")
    return D.check_plan(own(_plan(s)).withColumn("plan_row", k * 10 + F.col("plan_row")).drop("p_partkey"), slots.join(D.slot_roles(slots), ["slide", "slot_id"]))


def deck(s):
    """A small deck literal in the shape of parsed slides."""
    t = "array(named_struct('row_count', 5L, 'col_count', 4L))"
    none = "array()"
    rows = ", ".join(f"named_struct('slide_number', {n}L, 'texts', {x}, 'notes', {o}, 'tables', {'cast(array() as array<struct<row_count:bigint,col_count:bigint>>)' if tb == none else tb}, 'charts', {c}, 'images', array('')[1:0])".replace("array('')[1:0]", "slice(array(''), 1, 0)") for n, x, o, tb, c in (
        (1, "array('a', 'b')", "array('n')", none, "slice(array(''), 1, 0)"), (2, "array('c')", "slice(array(''), 1, 0)", t, "slice(array(''), 1, 0)"), (3, "slice(array(''), 1, 0)", "array('m')", none, "array('bar', 'pie')"), (4, "slice(array(''), 1, 0)", "slice(array(''), 1, 0)", none, "slice(array(''), 1, 0)")))
    return s.sql(f"SELECT 'd' AS deck, array({rows}) AS slides")


def decks(s, d):
    """A deck for each part: the first one to four slides of the literal one."""
    return load(s, d, "part").crossJoin(deck(s)).select(F.concat("deck", F.col("p_partkey").cast("string")).alias("deck"), F.slice("slides", F.lit(1), (F.col("p_partkey") % 4 + 1).cast("int")).alias("slides"))


def oracle_sql():
    q = {}
    q["c01_run_steps"] = """WITH o AS (SELECT o_custkey AS workflow, o_orderkey AS pos, 's' || o_orderkey AS id, o_orderkey % 5 <> 0 AS c, o_orderstatus <> 'F' AS ok, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'skip' WHEN '2' THEN 'retry' WHEN '3' THEN 'fail' END AS st FROM orders),
 f AS (SELECT workflow, min(pos) AS stop FROM o WHERE c AND NOT ok AND coalesce(st, 'fail') = 'fail' GROUP BY workflow)
 SELECT o.workflow, pos, id, CASE WHEN pos > stop THEN 'not run' WHEN NOT c THEN 'skipped' WHEN ok THEN 'completed' WHEN pos = stop THEN 'failed' ELSE 'error: ' || st END AS outcome,
  CAST(floor((row_number() OVER (PARTITION BY o.workflow ORDER BY pos) - 1) * 100 / count(*) OVER (PARTITION BY o.workflow)) AS BIGINT) AS progress FROM o LEFT JOIN f USING (workflow)"""
    q["c03_step_states"] = """WITH e AS (SELECT user_id AS project, event_id AS seq, strftime(ts, '%H') AS step, event_type = 'error' AS bad, CASE WHEN event_type = 'error' THEN 'error: ' || CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE '' END WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) END AS output
  FROM events WHERE event_type IN ('error', 'purchase'))
 SELECT project, step, bool_or(NOT bad) AS completed, arg_max(bad, seq) AS failed, arg_max(output, CASE WHEN output IS NOT NULL THEN seq END) AS output FROM e GROUP BY ALL"""
    q["c05_chosen_config"] = f"""WITH c AS (SELECT c_custkey AS project, CASE c_custkey % 3 WHEN 1 THEN 'defense' ELSE 'intro' END AS type, CASE c_custkey % 4 WHEN 0 THEN 'tech' WHEN 1 THEN 'odd' ELSE 'plain' END AS style, CASE WHEN c_custkey % 5 < 2 THEN 'a' ELSE 'g' END AS track FROM customer)
 SELECT project, c.type, c.style, c.track, coalesce(structure, 'structure ig') AS structure, coalesce(visual, 'grey') AS visual, coalesce(focus, 'balance') AS focus FROM c LEFT JOIN {values_sql("type, track, structure", MATRIX[0])} m ON c.type = m.type AND c.track = m.track
 LEFT JOIN {values_sql("style, visual", MATRIX[1])} v ON c.style = v.style LEFT JOIN {values_sql("track, focus", MATRIX[2])} f ON c.track = f.track"""
    q["c05_core_points"] = "SELECT page, rank, substr(t, 1, 15) AS text FROM (SELECT o_custkey AS page, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INTEGER) AS rank, 'order ' || o_orderpriority || ' ' || o_orderstatus AS t FROM orders) WHERE rank <= 5"
    q["f29_deep_merge"] = """WITH b AS (SELECT p_partkey AS config, unnest(['a.b.c', 'a.b.d', 'a.bc', 't', 'u.v']) AS path, 'old ' || p_name AS value FROM part),
 o AS (SELECT p_partkey AS config, unnest(CASE p_partkey % 3 WHEN 0 THEN ['a.b.c', 'n'] WHEN 1 THEN ['a.b'] ELSE ['t.x', 'a.q'] END) AS path, 'new ' || p_name AS value FROM part)
 SELECT * FROM o UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.config = b.config AND (o.path = b.path OR starts_with(b.path, o.path || '.') OR starts_with(o.path, b.path || '.')))"""
    # worked out by hand from the rules: consumption in name order; options in order, fewest first
    q["j13_named_lookup"] = "SELECT * FROM (VALUES ('a', 'Li', 't2'), ('b', 'Wu', 't3'), ('c', 'Xi', 'Xi')) AS t(course, who, teacher)"
    q["j14_slot_lookup"] = "SELECT * FROM (VALUES (1, 's1', 'slot_id'), (2, 's2', 'shape_id'), (3, 's3', 'shape_name'), (4, NULL, 'none')) AS t(plan_row, slot_id, \"by\")"
    q["j15_cell_errors"] = "SELECT * FROM (VALUES (2, 't1', 'row out of range'), (3, 't1', 'column out of range'), (4, 'zz', 'unknown table')) AS t(edit, table_id, error)"
    q["j16_image_occurrences"] = "SELECT * FROM (VALUES (0, 5, true), (1, 7, true), (2, 6, true), (3, 3, false)) AS t(pos, idx, by_hash)"
    q["j17_fonts"] = "SELECT * FROM (VALUES ('SimSun', 'SimSun'), ('Foo', 'Kai'), ('Bar', 'Kai'), ('Odd', 'DEFAULT')) AS t(font, used)"
    q["w01_outline"] = rf"""WITH {TURNS_SQL}, o AS (SELECT *, coalesce(last_value(CASE WHEN regexp_matches(title, '^[0-9]{{2}}\s+.+') THEN title END IGNORE NULLS) OVER (PARTITION BY deck ORDER BY n), '(default)') AS section_title FROM turns),
 c AS (SELECT *, CAST(section_title IS DISTINCT FROM lag(section_title) OVER (PARTITION BY deck ORDER BY n) AS INTEGER) AS ch FROM o), i AS (SELECT *, CAST(sum(ch) OVER (PARTITION BY deck ORDER BY n) AS BIGINT) AS section FROM c)
 SELECT deck, n, title, section, section_title, CAST(row_number() OVER (PARTITION BY deck, section ORDER BY n) AS INTEGER) AS ordinal FROM i"""
    q["w11_page_types"] = rf"""WITH {TURNS_SQL} SELECT deck, n, CASE WHEN n = min(n) OVER (PARTITION BY deck) THEN 'cover' WHEN n = max(n) OVER (PARTITION BY deck) OR regexp_matches(lower(text), '{D.THANKS}') THEN 'ending' WHEN regexp_matches(lower(text), '{D.AGENDA}') THEN 'toc'
 WHEN regexp_matches(lower(text), '{D.CHAPTERS}') THEN 'chapter' WHEN len(string_split(text, chr(10))) <= 2 AND length(text) <= 80 THEN 'chapter' ELSE 'content' END AS page_type FROM turns"""
    q["w12_slot_roles"] = "SELECT * FROM (VALUES (1, 's1', 'title'), (1, 's2', 'body'), (2, 's3', 'title'), (2, 's4', 'label')) AS t(slide, slot_id, role)"
    q["w13_key_points"] = f"""WITH {TURNS_SQL}, l AS (SELECT deck, n, unnest(string_split(text, chr(10))) AS t, unnest(range(len(string_split(text, chr(10))))) AS pos FROM turns), r AS (SELECT deck, n, t, CAST(row_number() OVER (PARTITION BY deck, n ORDER BY pos) AS INTEGER) AS rank FROM l WHERE length(t) >= 8)
 SELECT deck, n, rank, CASE WHEN length(t) > 120 THEN substr(t, 1, 119) || '…' ELSE t END AS point FROM r WHERE rank <= 8"""
    q["r08_check_plan"] = "SELECT * FROM (VALUES (1, 's1', 'slot_id', 'OK', 'box'), (2, 's2', 'shape_id', 'OK', 'box'), (3, 's3', 'shape_name', 'WARN', 'short label too long'), (4, '', 'none', 'ERROR', 'no slot')) AS t(plan_row, slot_id, \"by\", status, reason)"
    q["a18_check_summary"] = "SELECT 2 * count(*) AS n_ok, count(*) AS n_warn, count(*) AS n_error, 'ERROR' AS verdict FROM part"
    # widths, boxes and limits worked out by hand from the rules
    q["f35_fit"] = "SELECT * FROM (VALUES ('s1', 17.0::DOUBLE, 38.413::DOUBLE, 'OK', 'box'), ('s2', 15.0, 331.731, 'OK', 'box'), ('s3', 17.0, 6.036, 'WARN', 'short label too long'), ('s4', 15.0, 23.692, 'WARN', 'short label too long')) AS t(slot_id, need, room, status, reason)"
    q["a19_violations"] = """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS user_id, event_type, strftime(ts, '%Y-%m-%d %H') AS hour FROM events), c AS (SELECT 'user_id' AS kind, user_id AS who, hour FROM e UNION ALL SELECT 'event_type', event_type, hour FROM e)
 SELECT kind, who, hour AS time, count(*) - 1 AS n FROM c GROUP BY ALL HAVING count(*) > 1"""
    q["a20_statistics"] = f"""WITH {ASSIGNED_SQL} SELECT a.teacher, CAST(sum(coalesce(hours, 2)) AS BIGINT) AS hours, count(period) AS assigned, count(*) FILTER (period IS NULL) AS unassigned, round(coalesce(avg(CAST(CASE wish WHEN 'morning' THEN period <= 4 WHEN 'afternoon' THEN period > 4 END AS INTEGER)), 1.0), 2) AS satisfaction
 FROM a LEFT JOIN (VALUES (1, 'morning'), (2, 'afternoon')) AS w(teacher, wish) ON a.teacher = w.teacher GROUP BY a.teacher"""
    q["a21_view"] = f"""WITH {ASSIGNED_SQL} SELECT teacher, period, {", ".join(f"coalesce(min(course) FILTER (day = '{k}'), '') AS {chr(34)}{k}{chr(34)}" for k in S.DAYS)} FROM a GROUP BY teacher, period"""
    events = """ev AS (SELECT CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'complete' WHEN 'click' THEN 'start' ELSE 'progress' END AS type, 't' || user_id AS task_id, CASE WHEN event_type <> 'signup' THEN strftime(ts, '%H') END AS step_id, CAST(floor(value) AS BIGINT) AS percent, event_id AS seq FROM events WHERE NOT value BETWEEN 13 AND 14)"""
    fold = f"""{events}, cr AS (SELECT task_id, max(seq) AS f FROM ev WHERE type = 'create' GROUP BY task_id), live AS (SELECT ev.* FROM ev JOIN cr ON ev.task_id = cr.task_id AND ev.seq >= cr.f),
 st AS (SELECT task_id, step_id, arg_max(CASE type WHEN 'start' THEN 0 WHEN 'progress' THEN least(greatest(coalesce(percent, 0), 0), 100) ELSE 100 END, seq) AS p, min(seq) FILTER (type = 'start') AS f, max(seq) AS l FROM live WHERE step_id IS NOT NULL GROUP BY ALL),
 m AS (SELECT task_id, floor(sum(CASE WHEN l >= f THEN p ELSE 0 END) / greatest(count(*), 1)) AS percent FROM st WHERE f IS NOT NULL GROUP BY task_id),
 ts AS (SELECT task_id, arg_max(CASE WHEN type IN ('create', 'start') THEN 'running' WHEN type = 'fail' THEN 'failed' END, CASE WHEN type IN ('create', 'start', 'fail') THEN seq END) AS status, count(*) AS n_events FROM live GROUP BY task_id),
 fo AS (SELECT ts.task_id, status, CAST(coalesce(percent, 0) AS BIGINT) AS percent, n_events FROM ts LEFT JOIN m ON ts.task_id = m.task_id)"""
    q["a22_progress"] = f"WITH {fold} SELECT task_id, percent FROM fo"
    q["t02_fold_stream"] = f"WITH {fold} SELECT * FROM fo"
    q["t02_fold"] = f"WITH {fold} SELECT * FROM fo"
    q["t01_parse"] = f"WITH {events} SELECT type, task_id, coalesce(step_id, '') AS step_id, percent, seq FROM ev"
    q["t03_tracked_steps"] = f"WITH {events} SELECT task_id, step_id, arg_max(type, seq) AS last_type, arg_max(percent, seq) AS last_percent, count(*) AS n FROM ev WHERE step_id IS NOT NULL GROUP BY ALL"
    q["a23_dashboard"] = """SELECT source AS project, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS bytes, count(*) FILTER (lang = 'en') AS n_artifacts, CAST(floor(count(*) FILTER (n_chars > 2000) * 100.0 / count(*) + 0.5) AS BIGINT) AS percent,
 bool_or(lang = 'de') AND NOT bool_or(lang = 'fr' AND source <> 'src3') AS lacks_kb FROM documents GROUP BY source"""
    q["a24_slide_content"] = "SELECT deck || p_partkey AS deck, n, n_texts, n_tables, n_charts, n_images, n_notes, n_rows, n_cols FROM part JOIN (VALUES ('d', 1::BIGINT, 2, 0, 0, 0, 1, 0::BIGINT, 0::BIGINT), ('d', 2, 1, 1, 0, 0, 0, 5, 4), ('d', 3, 0, 0, 2, 0, 1, 0, 0), ('d', 4, 0, 0, 0, 0, 0, 0, 0)) AS t(deck, n, n_texts, n_tables, n_charts, n_images, n_notes, n_rows, n_cols) ON n <= p_partkey % 4 + 1"
    q["a25_deck_insights"] = """SELECT 'd' || p_partkey AS deck, CASE p_partkey % 4 WHEN 0 THEN 'notes' WHEN 1 THEN 'tables,notes' ELSE 'tables,charts,notes' END AS strengths,
 concat_ws(',', CASE WHEN p_size % 3 > 0 THEN p_size % 3 || ' failed pages' END, CASE WHEN p_size % 7 < 5 THEN 'few key points' END) AS gaps, CASE p_partkey % 4 WHEN 0 THEN 'add charts' ELSE '' END AS recommendations FROM part"""
    q["a25_empty_slides"] = "SELECT 'd' || p_partkey AS deck, 4::BIGINT AS n FROM part WHERE p_partkey % 4 = 3"
    q["a27_image_usage"] = "SELECT coalesce(part, sha256(blob)) AS asset, count(*) AS n_uses, array_to_string(list_sort(list(DISTINCT CAST(ratio AS VARCHAR))), ',') AS ratios FROM " + selected_sql(IMAGE_PARTS, "part") + " GROUP BY 1"
    q["g04_reachable"] = f"WITH RECURSIVE r(part) AS (SELECT 'a' UNION SELECT e.target FROM r JOIN {values_sql('source, target', PARTS)} e ON r.part = e.source) SELECT part FROM r"
    q["f23_time_slots"] = "SELECT * FROM (VALUES ('Mon 1-2', 'Mon-1,Mon-2'), ('Tue', 'Tue-1,Tue-2,Tue-3,Tue-4,Tue-5,Tue-6,Tue-7,Tue-8'), ('Wed morning', 'Wed-1,Wed-2,Wed-3,Wed-4'), ('Thu afternoon', 'Thu-5,Thu-6,Thu-7,Thu-8'), ('whenever', 'all'), ('Mon 1-2 Mon 2-3', 'Mon-1,Mon-2,Mon-2,Mon-3')) AS t(t, slots)"
    q["f24_speech"] = "SELECT * FROM (VALUES ('2 consecutive, prefers morning', 2, 'morning'), ('must not clash', 1, ''), ('should avoid Friday; prefer afternoon', 1, 'afternoon'), ('x', 1, '')) AS t(t, n, wish)"
    q["f25_table_rows"] = "SELECT * FROM (VALUES (1, '1;/;2'), (2, '')) AS t(id, rows)"
    q["f26_constraints"] = f"SELECT p_partkey, t, CASE WHEN regexp_matches(lower(t), 'must|never|not allowed|conflict') THEN 'hard' WHEN regexp_matches(lower(t), 'prefer|should|avoid') THEN 'soft' ELSE 'other' END AS kind FROM {selected_sql(SPEECH_PARTS, 'part')}"
    q["p11_error_rules"] = f"""WITH e AS (SELECT * FROM {selected_sql(ERROR_PARTS, "part")}), h AS (SELECT error_id, arg_min(action, pos) AS action FROM e JOIN {values_sql("pos, step, scenario, action", RULES)} r ON e.step = r.step AND contains(e.message, r.scenario) GROUP BY error_id)
 SELECT e.error_id, step, message, coalesce(action, 'fail') AS action FROM e LEFT JOIN h ON e.error_id = h.error_id"""
    q["p12_select_workflow"] = "SELECT request, CASE " + " ".join(f"WHEN regexp_matches(lower(request), '{w}') THEN '{n}'" for n, w in W.WORKFLOWS) + f" ELSE 'general' END AS workflow FROM {selected_sql(REQUEST_PARTS, 'part')}"
    q["p13_exported"] = f"SELECT * FROM {selected_sql(FOLDERS, 'part')} WHERE NOT (starts_with(name, '.') OR ends_with(name, 'node_modules') OR ends_with(name, '.log') OR ends_with(name, '__pycache__'))"
    q["p14_listing"] = f"SELECT *, CAST(row_number() OVER (PARTITION BY folder ORDER BY is_dir DESC, name) AS INTEGER) AS pos FROM {selected_sql(FOLDERS, 'part')} WHERE NOT starts_with(name, '.')"
    q["x_operation_list"] = "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) / 2 + 1 AS net FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'R'"
    q["x_operation_pivot"] = "SELECT c_mktsegment, " + ", ".join(f"CAST(nullif(sum(CASE WHEN o_orderstatus = '{k}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS {chr(34)}{k}{chr(34)}" for k in "FOP") + " FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment"
    return q
