"""Queries that match names one to one (ids j6-j9, f8): two exports of the parts, a listing a brand."""

from __future__ import annotations

from corvane.operators import match as M
from corvane.sources.tables import selected, selected_sql

LEFT = "SELECT DISTINCT p_brand AS listing, concat(p_name, ' v', p_size, '.xlsx') AS name FROM {part}"
# Of some brands the second export has no sizes, of others it has the words run together.
RIGHT = """SELECT DISTINCT p_brand AS listing, CASE WHEN p_brand LIKE 'Brand#1%' THEN concat(p_name, ' ', lower(p_type), '.pdf')
 WHEN p_brand LIKE 'Brand#%2' THEN concat(replace(p_name, ' ', '_'), '-', lower(p_type), '.pdf') ELSE concat(lower(p_type), '_', p_size, ' ', p_name, '.pdf') END AS name FROM {part}"""


def _left(s, d):
    return selected(s, d, LEFT, "part")


def _right(s, d):
    return selected(s, d, RIGHT, "part")


def queries():
    return {
        "j06_number_scores": lambda s, d: M.number_scores(_left(s, d), _right(s, d)),
        "j06_greedy_numbers": lambda s, d: M.match_numbers(_left(s, d), _right(s, d)),
        "j07_token_scores": lambda s, d: M.token_scores(_left(s, d), _right(s, d)),
        "j07_greedy_tokens": lambda s, d: M.match_tokens(_left(s, d), _right(s, d)),
        "f08_similarity_ratio": lambda s, d: M.similarity_scores(_left(s, d), _right(s, d)),
        "j08_similarity": lambda s, d: M.match_similar(_left(s, d), _right(s, d)),
        "j09_auto_match": lambda s, d: M.auto(_left(s, d), _right(s, d)),
    }


NAMES = f"lf AS (SELECT listing, name AS l FROM {selected_sql(LEFT, 'part')}), rf AS (SELECT listing, name AS r FROM {selected_sql(RIGHT, 'part')})"
NUMBERS = """nums AS (SELECT listing, l, r, CASE WHEN a[-1] = b[-1] THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score
 FROM (SELECT listing, l, regexp_extract_all(l, '[0-9]+') AS a FROM lf) JOIN (SELECT listing, r, regexp_extract_all(r, '[0-9]+') AS b FROM rf) USING (listing) WHERE len(a) > 0 AND list_contains(b, a[-1]))"""
_TOKENS = r"list_distinct(list_filter(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]', ' ', 'g'), ' '), lambda x: x <> ''))"
TOKENS = f"""toks AS (SELECT listing, l, r, round(n / CAST(m - n AS DOUBLE), 6) AS score FROM (SELECT listing, l, r, len(list_intersect(a, b)) AS n, len(a) + len(b) AS m
 FROM (SELECT listing, l, {_TOKENS.format("l")} AS a FROM lf) JOIN (SELECT listing, r, {_TOKENS.format("r")} AS b FROM rf) USING (listing)) WHERE n > 0 AND round(n / CAST(m - n AS DOUBLE), 6) > 0.3)"""
# The longest common block, the first in the left on ties and its first place in the right, then both sides of it.
RATIOS = """seg AS (SELECT l, r, l AS a, r AS b, 0 AS m FROM (SELECT DISTINCT l, r FROM lf JOIN rf USING (listing))
 UNION ALL SELECT l, r, unnest([substr(a, 1, i - 1), substr(a, i + k)]), unnest([substr(b, 1, j - 1), substr(b, j + k)]), unnest([k, 0])
 FROM (SELECT l, r, a, b, best.k AS k, best.i AS i, instr(b, substr(a, best.i, best.k)) AS j FROM (SELECT l, r, a, b,
  list_reduce(list_prepend({'k': 0, 'i': 0}, flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(a) - i + 2), lambda k: {'k': CASE WHEN contains(b, substr(a, i, k)) THEN k ELSE 0 END, 'i': i})))), lambda x, y: CASE WHEN y.k > x.k THEN y ELSE x END) AS best
  FROM seg WHERE a <> '' AND b <> '') WHERE best.k > 0)),
 sims AS (SELECT listing, l, r, score FROM (SELECT l, r, round(2.0::DOUBLE * sum(m) / (length(l) + length(r)), 6) AS score FROM seg GROUP BY l, r) JOIN lf USING (l) JOIN rf USING (listing, r) WHERE score > 0.5)"""


def _turns(scores: str) -> str:
    """Pairs by taking turns: a step a left, which takes its best right that none before it has."""
    return f"""{scores}_o AS (SELECT listing, l, list({{'s': score, 'r': r}} ORDER BY score DESC, r) AS o, row_number() OVER (PARTITION BY listing ORDER BY l) AS k FROM {scores} GROUP BY listing, l),
 {scores}_g AS (SELECT DISTINCT listing, 0::BIGINT AS k, NULL::VARCHAR AS l, NULL::STRUCT(s DOUBLE, r VARCHAR) AS pick, []::VARCHAR[] AS used FROM {scores}
  UNION ALL SELECT listing, k, l, pick, list_append(used, pick.r) FROM (SELECT o.listing, o.k, o.l, list_filter(o.o, lambda x: NOT list_contains(g.used, x.r))[1] AS pick, g.used AS used FROM {scores}_g g JOIN {scores}_o o ON o.listing = g.listing AND o.k = g.k + 1)),
 {scores}_p AS (SELECT listing, l, pick.r AS r, pick.s AS score FROM {scores}_g WHERE pick.r IS NOT NULL)"""


def oracle_sql():
    number, token, similar = _turns("nums"), _turns("toks"), _turns("sims")
    return {
        "j06_number_scores": f"WITH {NAMES}, {NUMBERS} SELECT * FROM nums",
        "j06_greedy_numbers": f"WITH RECURSIVE {NAMES}, {NUMBERS}, {number} SELECT * FROM nums_p",
        "j07_token_scores": f"WITH {NAMES}, {TOKENS} SELECT * FROM toks",
        "j07_greedy_tokens": f"WITH RECURSIVE {NAMES}, {TOKENS}, {token} SELECT * FROM toks_p",
        "f08_similarity_ratio": f"WITH RECURSIVE {NAMES}, {RATIOS} SELECT * FROM sims",
        "j08_similarity": f"WITH RECURSIVE {NAMES}, {RATIOS}, {similar} SELECT * FROM sims_p",
        "j09_auto_match": f"""WITH RECURSIVE {NAMES}, {NUMBERS}, {TOKENS}, {RATIOS}, {number}, {token}, {similar},
 every AS (SELECT *, 'number' AS strategy FROM nums_p UNION ALL SELECT *, 'keyword' FROM toks_p UNION ALL SELECT *, 'similarity' FROM sims_p),
 n AS (SELECT listing, (SELECT count(*) FROM lf x WHERE x.listing = lf.listing) AS lefts, (SELECT count(*) FROM nums_p x WHERE x.listing = lf.listing) AS a, (SELECT count(*) FROM toks_p x WHERE x.listing = lf.listing) AS b, (SELECT count(*) FROM sims_p x WHERE x.listing = lf.listing) AS c FROM (SELECT DISTINCT listing FROM lf) lf),
 pick AS (SELECT listing, CASE WHEN a >= 0.8 * lefts THEN 'number' WHEN b > a THEN 'keyword' WHEN c > a THEN 'similarity' ELSE 'number' END AS strategy FROM n)
 SELECT every.* FROM every JOIN pick USING (listing, strategy)""",
    }
