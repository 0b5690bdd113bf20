"""SQL of the queries over grids and grammars: the same trees, by recursion over regions of a grid."""

from __future__ import annotations

from trellis.config import DEFAULTS as O
from trellis.operators import grammar


def _merged(name: str, points: str) -> str:
    """Sorted distinct points of each building with those too near the last one kept left out, the last moved to 1."""
    return f""", {name}_points AS (SELECT building_id, p, row_number() OVER (PARTITION BY building_id ORDER BY p) AS i FROM (SELECT DISTINCT building_id, round(p, 9) AS p FROM ({points}))),
{name}_walk(building_id, i, last, stays) AS (SELECT building_id, i, p, true FROM {name}_points WHERE i = 1 UNION ALL
 SELECT p.building_id, p.i, CASE WHEN p.p > w.last + CAST(0.02 AS DOUBLE) THEN p.p ELSE w.last END, p.p > w.last + CAST(0.02 AS DOUBLE) FROM {name}_walk w JOIN {name}_points p ON p.building_id = w.building_id AND p.i = w.i + 1),
{name}_b AS (SELECT building_id, pos, CASE WHEN pos = n - 1 THEN CAST(1 AS DOUBLE) ELSE v END AS v FROM (SELECT building_id, last AS v, row_number() OVER (PARTITION BY building_id ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY building_id) AS n FROM {name}_walk WHERE stays))"""


def _around(peaks: str) -> str:
    return f"""SELECT building_id, greatest(CAST(0 AS DOUBLE), center - window_mean / 2) AS p FROM {peaks} JOIN fitted USING (building_id) UNION ALL SELECT building_id, least(CAST(1 AS DOUBLE), center + window_mean / 2) FROM {peaks} JOIN fitted USING (building_id)
 UNION ALL SELECT building_id, CAST(unnest([0, 1]) AS DOUBLE) FROM fitted"""


_GRIDS = (
    _merged("row", _around("rows_peaks") + " UNION ALL SELECT building_id, gable_y_end FROM fitted WHERE gable_y_end > 0 AND gable_y_end < 1 UNION ALL SELECT a.building_id, (a.center + b.center) / 2 FROM rows_peaks a JOIN rows_peaks b ON a.building_id = b.building_id AND b.pos = a.pos + 1 JOIN fitted f ON f.building_id = a.building_id")
    + _merged("col", _around("cols_peaks"))
    + """, edges_of AS (SELECT building_id, r.b AS rb, c.b AS cb FROM (SELECT building_id, list(v ORDER BY v) AS b FROM row_b GROUP BY 1) r JOIN (SELECT building_id, list(v ORDER BY v) AS b FROM col_b GROUP BY 1) c USING (building_id)),
hits AS (SELECT building_id, least(greatest(len(list_filter(rb, lambda b: b <= cy / 100)) - 1, 0), len(rb) - 2) AS row, least(greatest(len(list_filter(cb, lambda b: b <= cx / 100)) - 1, 0), len(cb) - 2) AS col, cls, score, ord
 FROM instances JOIN edges_of USING (building_id) WHERE cx / 100 BETWEEN 0 AND 1 AND cy / 100 BETWEEN 0 AND 1),
won AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY building_id, row, col ORDER BY score DESC, ord) AS k FROM hits) WHERE k = 1),
every AS (SELECT building_id, nc, row, unnest(range(nc)) AS col FROM (SELECT building_id, len(cb) - 1 AS nc, unnest(range(len(rb) - 1)) AS row FROM edges_of)),
cells AS (SELECT e.building_id, e.nc, e.row, e.col, coalesce(w.cls, 'wall') AS cls, coalesce(w.score, CAST(0 AS DOUBLE)) AS score FROM every e LEFT JOIN won w ON w.building_id = e.building_id AND w.row = e.row AND w.col = e.col)"""
)

#: One letter a class.
_LETTERS = {c: chr(97 + i) for i, c in enumerate(grammar.CLASSES)}
_LETTER = "CASE cls " + " ".join(f"WHEN '{c}' THEN '{x}'" for c, x in _LETTERS.items()) + " END"
_CLASS = "CASE letter " + " ".join(f"WHEN '{x}' THEN '{c}'" for c, x in _LETTERS.items()) + " END"
_PLACE = "CASE cls " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in grammar.PLACES.items()) + " ELSE 0.5 END"


def _uniform(r0: str, r1: str, c0: str, c1: str) -> str:
    return f"CAST(len(list_filter(range({r0}, {r1}), lambda r: substr(s, r * nc + {c0} + 1, {c1} - ({c0})) <> repeat(substr(s, ({r0}) * nc + {c0} + 1, 1), {c1} - ({c0})))) = 0 AS INT)"


_SCORES = f"""CASE WHEN {_uniform('r0', 'r1', 'c0', 'c1')} = 0 THEN list_concat(list_transform(range(1, r1 - r0), lambda k: {_uniform('r0', 'r0 + k', 'c0', 'c1')} + {_uniform('r0 + k', 'r1', 'c0', 'c1')}),
 list_transform(range(1, c1 - c0), lambda k: {_uniform('r0', 'r1', 'c0', 'c0 + k')} + {_uniform('r0', 'r1', 'c0 + k', 'c1')})) END"""

_TREES = f""", grids AS (SELECT building_id, max(nc) AS nc, max(row) + 1 AS nr, string_agg({_LETTER}, '' ORDER BY row, col) AS s FROM cells GROUP BY 1),
tree(building_id, path, r0, r1, c0, c1, s, nc, scores) AS (SELECT *, {_SCORES} FROM (SELECT building_id, '' AS path, CAST(0 AS BIGINT) AS r0, nr AS r1, CAST(0 AS BIGINT) AS c0, nc AS c1, s, nc FROM grids) UNION ALL
 SELECT *, {_SCORES} FROM (SELECT building_id, path || side AS path, CASE WHEN across AND side = '1' THEN r0 + k ELSE r0 END AS r0, CASE WHEN across AND side = '0' THEN r0 + k ELSE r1 END AS r1,
 CASE WHEN NOT across AND side = '1' THEN c0 + k ELSE c0 END AS c0, CASE WHEN NOT across AND side = '0' THEN c0 + k ELSE c1 END AS c1, s, nc
 FROM (SELECT *, list_position(scores, list_max(scores)) < r1 - r0 AS across, CASE WHEN list_position(scores, list_max(scores)) < r1 - r0 THEN list_position(scores, list_max(scores)) ELSE list_position(scores, list_max(scores)) - (r1 - r0 - 1) END AS k FROM tree WHERE scores IS NOT NULL) t, (VALUES ('0'), ('1')) sides(side))),
cuts AS (SELECT building_id, path, length(path) AS depth, scores IS NULL AS ends, {_CLASS} AS cls_of, CASE WHEN across THEN 'horizontal' ELSE 'vertical' END AS axis_of, CASE WHEN across THEN spot ELSE spot - (r1 - r0 - 1) END AS k, CASE WHEN across THEN r1 - r0 ELSE c1 - c0 END AS n
 FROM (SELECT *, list_position(scores, list_max(scores)) AS spot, list_position(scores, list_max(scores)) < r1 - r0 AS across, substr(s, r0 * nc + c0 + 1, 1) AS letter FROM tree)),
bare AS (SELECT building_id, path, depth, ends, CASE WHEN ends THEN cls_of END AS cls, CASE WHEN NOT ends THEN axis_of END AS axis, CASE WHEN NOT ends THEN k / CAST(n AS DOUBLE) END AS share,
 CASE WHEN ends THEN 'T' || cls_of || ';' ELSE substr(axis_of, 1, 1) || k // gcd(k, n) || '/' || n // gcd(k, n) || ';' END AS token FROM cuts),
above AS (SELECT building_id, path, depth, token, cls, ends, unnest(range(depth + 1)) AS up FROM bare),
texts AS (SELECT building_id, substr(path, 1, up) AS path, string_agg(token, '' ORDER BY above.path) AS text, round(sum(CASE WHEN ends THEN ({_PLACE}) * pow(CAST(0.5 AS DOUBLE), depth - up) ELSE 0 END), 9) AS place FROM above GROUP BY building_id, substr(path, 1, up)),
named AS (SELECT b.*, place, CASE WHEN ends THEN 'T' ELSE 'S' END || substr(md5(text), 1, 15) AS rule, CASE WHEN ends THEN 'T ' || cls ELSE 'S ' || axis || ' ( * ) ( * )' END AS key1, row_number() OVER (PARTITION BY building_id ORDER BY path) - 1 AS node FROM bare b JOIN texts USING (building_id, path)),
nodes AS (SELECT x.*, l.rule AS left_rule, r.rule AS right_rule, l.place AS left_place, r.place AS right_place, CASE WHEN x.ends THEN x.key1 ELSE 'S ' || x.axis || ' ( ' || l.key1 || ' ) ( ' || r.key1 || ' )' END AS key
 FROM named x LEFT JOIN named l ON l.building_id = x.building_id AND l.path = x.path || '0' LEFT JOIN named r ON r.building_id = x.building_id AND r.path = x.path || '1'),
rules AS (SELECT rule, any_value(ends) AS ends, any_value(axis) AS axis, any_value(cls) AS cls, any_value(left_rule) AS left_rule, any_value(right_rule) AS right_rule, any_value(round(share, 6)) AS left_size, any_value(round(1 - share, 6)) AS right_size, any_value(key) AS key, count(*) AS uses, count(*) FILTER (path = '') AS root_uses FROM nodes GROUP BY 1),
names AS (SELECT 'F' || row_number() OVER (ORDER BY key) AS family, row_number() OVER (ORDER BY key) AS number, * FROM (SELECT key, count(*) AS n, sum(uses) AS total, sum(root_uses) AS root_weight FROM rules GROUP BY 1)),
best AS (SELECT family, number, CAST(root_weight AS BIGINT) AS weight FROM names WHERE root_weight > 0)"""

_DRAW = "CAST(CAST('0x' || substr(md5(seed || ':' || sample || ':' || {}), 1, 12) AS BIGINT) AS DOUBLE) / 281474976710656"
_HEAVY, _ANY = f"r.uses >= {O.min_production_weight}", "bool_or({}) OVER (PARTITION BY family)"
_RANGES = f""", family_of AS (SELECT r.*, n.family, l.family AS left_family, t.family AS right_family, {_HEAVY} AS heavy, r.ends OR (r.left_rule LIKE 'T%' AND r.right_rule LIKE 'T%') AS ends_soon, r.uses + CAST({O.dirichlet_concentration} AS DOUBLE) AS p
 FROM rules r JOIN names n ON n.key = r.key LEFT JOIN rules lr ON lr.rule = r.left_rule LEFT JOIN rules rr ON rr.rule = r.right_rule LEFT JOIN names l ON l.key = lr.key LEFT JOIN names t ON t.key = rr.key),
shallow AS (SELECT * FROM (SELECT *, {_ANY.format('heavy')} AS any_heavy FROM family_of) WHERE heavy OR NOT any_heavy), deep AS (SELECT * FROM (SELECT *, {_ANY.format('ends_soon')} AS any_soon FROM shallow) WHERE ends_soon OR NOT any_soon),
modes AS (SELECT 0 AS mode, family, rule, left_family, right_family, p FROM shallow UNION ALL SELECT 1, family, rule, left_family, right_family, p FROM deep),
ranges AS (SELECT mode, family, rule, left_family, right_family, (sum(p) OVER w - p) / sum(p) OVER (PARTITION BY mode, family) AS low, sum(p) OVER w / sum(p) OVER (PARTITION BY mode, family) AS high FROM modes WINDOW w AS (PARTITION BY mode, family ORDER BY rule)
 UNION ALL SELECT 2, '*', min(rule), NULL, NULL, 0, 1 FROM rules WHERE ends)"""


def _weighted(source: str) -> str:
    """Starts of samples drawn by weight."""
    return f""", starts AS (SELECT seed, sample, family FROM (SELECT *, {_DRAW.format("'root'")} AS u FROM (SELECT CAST({O.rng_seed} AS BIGINT) AS seed, unnest(range({O.n_samples})) AS sample)) JOIN (SELECT family, (sum(weight) OVER (ORDER BY number) - weight) / CAST(sum(weight) OVER () AS DOUBLE) AS low, sum(weight) OVER (ORDER BY number) / CAST(sum(weight) OVER () AS DOUBLE) AS high FROM {source}) ON u >= low AND u < high)"""


_EACH = f", starts AS (SELECT CAST({O.rng_seed} + 1009 * (row_number() OVER (ORDER BY weight DESC, number) - 1) AS BIGINT) AS seed, sample, family FROM (SELECT * FROM best ORDER BY weight DESC, number LIMIT 6), (SELECT unnest(range(2)) AS sample))"
_EACH = _EACH.replace("row_number() OVER (ORDER BY weight DESC, number)", "dense_rank() OVER (ORDER BY weight DESC, number)")
_MODE = f"CASE WHEN {{0}} >= {2 * O.max_depth} THEN 2 WHEN {{0}} >= {O.max_depth} THEN 1 ELSE 0 END"
_PICK = f"r.mode = {_MODE.format('c.depth')} AND r.family = CASE WHEN r.mode = 2 THEN '*' ELSE c.family END AND r.low <= c.u AND c.u < r.high"
_GROWN = f""", grown(seed, sample, path, depth, family, rule, left_family, right_family) AS (SELECT c.seed, c.sample, '', 0, c.family, r.rule, r.left_family, r.right_family FROM (SELECT *, 0 AS depth, {_DRAW.format("''")} AS u FROM starts) c JOIN ranges r ON {_PICK} UNION ALL
 SELECT c.seed, c.sample, c.path, c.depth, c.family, r.rule, r.left_family, r.right_family FROM (SELECT *, {_DRAW.format('path')} AS u FROM (SELECT seed, sample, path || side AS path, depth + 1 AS depth, CASE WHEN side = '0' THEN left_family ELSE right_family END AS family FROM grown, (VALUES ('0'), ('1')) sides(side) WHERE left_family IS NOT NULL)) c JOIN ranges r ON {_PICK})"""
_SAMPLED = " SELECT seed * 10000 + sample AS seed, sample, path, CAST(depth AS INT) AS depth, family, rule FROM grown"


def _rects(nodes: str, keys: str) -> str:
    """Rectangles of trees whose nodes have path, axis, share, left_place and right_place."""
    ks = ", ".join(f"n.{k}" for k in keys.split(", "))
    on = " AND ".join(f"n.{k} = t.{k}" for k in keys.split(", "))
    return f""", rects({keys}, path, x, y, w, h) AS (SELECT {keys}, path, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), CAST(1 AS DOUBLE) FROM {nodes} WHERE path = '' UNION ALL
 SELECT {ks}, n.path || side, CASE WHEN axis = 'vertical' AND side = '1' THEN x + w * share ELSE x END, CASE WHEN axis = 'vertical' THEN y WHEN left_place <= right_place AND side = '1' THEN y + h * share WHEN left_place > right_place AND side = '0' THEN y + h * (1 - share) ELSE y END,
 CASE WHEN axis = 'horizontal' THEN w WHEN side = '0' THEN w * share ELSE w * (1 - share) END, CASE WHEN axis = 'vertical' THEN h WHEN side = '0' THEN h * share ELSE h * (1 - share) END
 FROM rects t JOIN {nodes} n ON {on} AND n.path = t.path, (VALUES ('0'), ('1')) sides(side) WHERE axis IS NOT NULL)"""


_SAMPLE_NODES = f""", drawn AS (SELECT g.seed, sample, path, depth, g.rule, cls, axis, left_size AS share FROM grown g JOIN rules USING (rule)),
drawn_up AS (SELECT *, unnest(range(depth + 1)) AS up FROM drawn),
drawn_place AS (SELECT seed, sample, substr(path, 1, up) AS path, round(sum(CASE WHEN cls IS NOT NULL THEN ({_PLACE}) * pow(CAST(0.5 AS DOUBLE), depth - up) ELSE 0 END), 9) AS place FROM drawn_up GROUP BY seed, sample, substr(path, 1, up)),
drawn_nodes AS (SELECT d.*, l.place AS left_place, r.place AS right_place FROM drawn d LEFT JOIN drawn_place l ON l.seed = d.seed AND l.sample = d.sample AND l.path = d.path || '0' LEFT JOIN drawn_place r ON r.seed = d.seed AND r.sample = d.sample AND r.path = d.path || '1')"""
_XYWH = "round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h"


def queries(fit: str) -> dict[str, str]:
    """SQL by query; `fit` begins with WITH and defines instances, buildings, peaks and fitted."""
    base = fit.replace("WITH ", "WITH RECURSIVE ", 1)
    grids, trees = base + _GRIDS, base + _GRIDS + _TREES
    samples = lambda starts: trees + _RANGES + starts + _GROWN
    log_n = "CASE WHEN count(*) > 1 THEN log2(CAST(count(*) AS DOUBLE)) ELSE 0 END"
    return {
        "row_boundaries": grids + ' SELECT building_id, CAST(pos AS INT) AS "at", round(v, 9) AS y FROM row_b',
        "col_boundaries": grids + ' SELECT building_id, CAST(pos AS INT) AS "at", round(v, 9) AS x FROM col_b',
        "lattice_cells": grids + " SELECT building_id, CAST(row AS INT) AS row, CAST(col AS INT) AS col, cls, score FROM cells",
        "lattice_fill_rate": grids + " SELECT building_id, round(avg(CASE WHEN cls <> 'wall' THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS fill_rate FROM cells GROUP BY 1",
        "induced_rules": trees + " SELECT rule, CASE WHEN ends THEN 'terminal' ELSE 'split' END AS kind, axis, cls, left_rule, right_rule, left_size, right_size FROM rules",
        "facade_roots": trees + " SELECT building_id, rule FROM nodes WHERE path = ''",
        "mdl_bits": trees + f" SELECT count(*) AS n_rules, count(*) FILTER (ends) AS n_terminals, CAST(sum(root_uses) AS BIGINT) AS n_roots, round({O.grammar_prior_weight} * (count(*) FILTER (ends) * 3 + count(*) FILTER (NOT ends) * (9 + 2 * {log_n})) + sum(root_uses) * {log_n}, 6) AS mdl_bits FROM rules",
        "parse_edges": trees + " SELECT x.building_id, CAST(x.node AS INT) AS node, CAST(p.node AS INT) AS parent, CAST(CASE WHEN x.path = '' THEN '0' ELSE right(x.path, 1) END AS INT) AS child, CAST(x.depth AS INT) AS depth, x.rule FROM nodes x LEFT JOIN nodes p ON p.building_id = x.building_id AND x.path <> '' AND p.path = left(x.path, length(x.path) - 1)",
        "rule_usage": trees + " SELECT rule, uses FROM rules",
        "family_keys": trees + " SELECT rule, key FROM rules",
        "grammar_families": trees + " SELECT family, key, rule, uses AS weight FROM rules JOIN names USING (key)",
        "root_family_weights": trees + " SELECT family, weight FROM best",
        "production_probs": trees + f" SELECT family, rule, uses AS weight, round((uses + {O.dirichlet_concentration}) / (total + n * {O.dirichlet_concentration}), 6) AS prob FROM rules JOIN names USING (key)",
        "top_root_families": trees + " SELECT family, weight FROM best ORDER BY weight DESC, number LIMIT 6",
        "synthesized": samples(_weighted("best")) + _SAMPLED,
        "photogenic": samples(_weighted("(SELECT * FROM best ORDER BY weight DESC, number LIMIT 1)")) + _SAMPLED,
        "archetype": samples(_EACH) + _SAMPLED,
        "layout_rects": trees + _rects("nodes", "building_id") + f" SELECT n.building_id, CAST(node AS INT) AS node, rule, cls, {_XYWH} FROM rects JOIN nodes n USING (building_id, path)",
        "sample_rects": samples(_weighted("best")) + _SAMPLE_NODES + _rects("drawn_nodes", "seed, sample") + f" SELECT n.seed, n.sample, n.path, rule, cls, {_XYWH} FROM rects JOIN drawn_nodes n USING (seed, sample, path)",
        "contact_sample": fit + f" SELECT building_id, n_floors, n_columns FROM fitted ORDER BY md5('{O.rng_seed}:' || building_id), building_id LIMIT 12",
    }
