"""Split rules of grids, shared by what they are made of; families of rules; and samples of both.

A rule's name is a digest of what it expands to, so equal regions of any fronts get equal rules without a table in
common: each grid is solved alone, and rules meet in one aggregation that sums up in each batch and each task first.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellis.config import DEFAULTS, Options
from trellis.sources.tables import written

#: The classes of cells.
CLASSES = ("wall", "window", "door", "gable", "floor", "chimney", "balcony", "hoist_beam")
#: How far down a class belongs, from 0 to 1; others are in the middle.
PLACES = {"gable": 0.0, "chimney": 0.05, "hoist_beam": 0.08, "balcony": 0.3, "floor": 0.5, "window": 0.5, "wall": 0.5, "door": 1.0}
PARSES = "building_id long, node int, parent int, child int, depth int, rule string, kind string, axis string, cls string, x double, y double, w double, h double"
RULES = "rule string, kind string, axis string, cls string, left_rule string, right_rule string, left_size double, right_size double, key string, left_key string, right_key string, uses long, root_uses long"
#: Fronts whose regions are solved together, which bounds what a task remembers.
TOGETHER = 256


class Region:
    """A solved region: a class, or a cut into two regions."""

    __slots__ = ("axis", "cls", "keys", "kind", "left", "name", "place", "right", "share", "text")

    def __init__(self, cls: str | None, axis: str | None, cut: int, n: int, left: Region | None, right: Region | None, depth: int):
        self.cls, self.axis, self.left, self.right = cls, axis, left, right
        if left is None or right is None:
            self.kind, self.share, self.place = "terminal", 0.0, PLACES.get(cls, 0.5)
            self.text = f"T{cls};"
            self.keys = ["*"] + [f"T {cls}"] * depth
        else:
            # equal shares are equal in lowest terms
            g = math.gcd(cut, n)
            self.kind, self.share, self.place = "split", cut / n, (left.place + right.place) / 2
            self.text = f"{axis[0]}{cut // g}/{n // g};{left.text}{right.text}"
            self.keys = ["*"] + [f"S {axis} ( {left.keys[b]} ) ( {right.keys[b]} )" for b in range(depth)]
        self.name = self.kind[0].upper() + hashlib.md5(self.text.encode()).hexdigest()[:15]


def best_cut(rows: list[str]) -> tuple[str, int, int] | None:
    """(axis, cut, lines) of the cut that leaves most uniform halves; first across, then down, then the nearest to the
    start. None for a region of one class. The lines that are uniform from either end tell it all."""
    flat = "".join(rows)
    if flat == flat[0] * len(flat):
        return None
    best = (-1, "", 0, 0)
    for axis, lines in (("horizontal", rows), ("vertical", ["".join(c) for c in zip(*rows, strict=True)])):
        n = len(lines)
        if n < 2:
            continue
        first, last = (line if line == line[0] * len(line) else None for line in (lines[0], lines[-1]))
        top = next((i for i in range(n) if lines[i] != first), n) if first else 0
        bottom = next((i for i in range(n) if lines[n - 1 - i] != last), n) if last else 0
        if top + bottom == n:
            found = (2, axis, top, n)
        elif top or not bottom:
            found = (int(top > 0), axis, 1, n)
        else:
            found = (1, axis, n - bottom, n)
        if found[0] > best[0]:
            best = found
    return best[1:]


def solve(rows: list[str], names: dict[str, str], memo: dict[str, Region], depth: int) -> Region:
    """The split tree of a grid of one-letter cells; `names` has each letter's class."""
    key = "\n".join(rows)
    if (done := memo.get(key)) is None:
        cut = best_cut(rows)
        if cut is None:
            done = Region(names[rows[0][0]], None, 0, 0, None, None, depth)
        else:
            axis, k, n = cut
            one, two = (rows[:k], rows[k:]) if axis == "horizontal" else ([r[:k] for r in rows], [r[k:] for r in rows])
            done = Region(None, axis, k, n, solve(one, names, memo, depth), solve(two, names, memo, depth), depth)
        memo[key] = done
    return done


def halves(r: Region, box: tuple[float, float, float, float]) -> list[tuple[float, float, float, float]]:
    """The rectangles of a split's two children in its own. Across, the child whose cells belong higher up is placed first."""
    x, y, w, h = box
    sizes = (r.share, 1 - r.share)
    if r.axis == "vertical":
        return [(x, y, w * sizes[0], h), (x + w * sizes[0], y, w * sizes[1], h)]
    if round(r.left.place, 9) <= round(r.right.place, 9):
        return [(x, y, w, h * sizes[0]), (x, y + h * sizes[0], w, h * sizes[1])]
    return [(x, y + h * sizes[1], w, h * sizes[0]), (x, y, w, h * sizes[1])]


def _nodes(building: int, root: Region) -> list[tuple]:
    out: list[tuple] = []

    def walk(r: Region, parent: int | None, child: int, depth: int, box: tuple[float, float, float, float]) -> None:
        node = len(out)
        out.append((building, node, parent, child, depth, r.name, r.kind, r.axis, r.cls, *box))
        if r.left is not None:
            for i, (part, inside) in enumerate(zip((r.left, r.right), halves(r, box), strict=True)):
                walk(part, node, i, depth + 1, inside)

    walk(root, None, 0, 0, (0.0, 0.0, 1.0, 1.0))
    return out


def _rows_of_rules(roots: list[Region], depth: int) -> list[tuple]:
    uses: Counter[str] = Counter()
    known: dict[str, Region] = {}

    def count(r: Region) -> None:
        uses[r.name] += 1
        known.setdefault(r.name, r)
        if r.left is not None:
            count(r.left)
            count(r.right)

    for r in roots:
        count(r)
    tops = Counter(r.name for r in roots)
    part = lambda r: (None, None) if r is None else (r.name, r.keys[depth])
    out = []
    for name, r in known.items():
        (left, left_key), (right, right_key) = part(r.left), part(r.right)
        sizes = (None, None) if r.left is None else (round(r.share, 6), round(1 - r.share, 6))
        out.append((name, r.kind, r.axis, r.cls, left, right, *sizes, r.keys[depth], left_key, right_key, uses[name], tops[name]))
    return out


def _solved(lattices: DataFrame, schema: str, depth: int, emit: Callable[[list[tuple[int, Region]]], list[tuple]]) -> DataFrame:
    """One row of cells goes in for each front; a front's cells are few."""
    grids = lattices.groupBy("building_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "cls"))).alias("cells"))
    grids = grids.select("building_id", F.transform("cells", lambda c: c["row"]).alias("rows"), F.transform("cells", lambda c: c["cls"]).alias("cls"))
    fields = [f.split() for f in schema.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    types = [kinds[k] for _, k in fields]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, TOGETHER):
                memo: dict[str, Region] = {}
                letters: dict[str, str] = {}
                fronts = []
                for bid, rows, classes in zip(*(whole.column(c).slice(a, TOGETHER).to_pylist() for c in ("building_id", "rows", "cls")), strict=True):
                    grid: dict[int, list[str]] = {}
                    for row, cls in zip(rows, classes, strict=True):
                        grid.setdefault(row, []).append(letters.setdefault(cls, chr(65 + len(letters))))
                    lines = ["".join(grid[r]) for r in sorted(grid)]
                    if lines:
                        fronts.append((bid, solve(lines, {v: k for k, v in letters.items()}, memo, depth)))
                if found := emit(fronts):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names=[n for n, _ in fields])

    return grids.mapInArrow(work, schema)


def parses(lattices: DataFrame) -> DataFrame:
    """Every node of every front's split tree in pre-order, with its rule and its rectangle in the unit square."""
    return _solved(lattices, PARSES, 0, lambda fronts: [n for bid, root in fronts for n in _nodes(bid, root)])


def rules(lattices: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Every rule once: its body, how often it is used, at roots too, and its key and its children's: what they are made
    of down to `family_depth`, sizes left out."""
    depth = o.family_depth
    found = _solved(lattices, RULES, depth, lambda fronts: _rows_of_rules([r for _, r in fronts], depth))
    same = [c for c in found.columns if c not in ("rule", "uses", "root_uses")]
    return found.groupBy("rule").agg(*(F.any_value(c).alias(c) for c in same), F.sum("uses").alias("uses"), F.sum("root_uses").alias("root_uses"))


def roots(parse_rows: DataFrame) -> DataFrame:
    return parse_rows.where("parent is null").select("building_id", "rule")


def layout(parse_rows: DataFrame) -> DataFrame:
    """Each node's rectangle in the unit square."""
    return parse_rows.select("building_id", "node", "rule", "cls", *(F.round(c, 6).alias(c) for c in "xywh"))


def mdl_bits(rule_rows: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """The length of the description, in bits: of the rules, and of the fronts by their root rules. One pass."""
    n = rule_rows.agg(F.count("*").alias("n_rules"), F.count_if(F.col("kind") == "terminal").alias("n_terminals"), F.coalesce(F.sum("root_uses"), F.lit(0)).alias("n_roots"))
    log_n = F.when(F.col("n_rules") > 1, F.log2(F.col("n_rules").cast("double"))).otherwise(F.lit(0.0))
    dictionary = F.col("n_terminals") * F.log2(F.lit(float(len(CLASSES)))) + (F.col("n_rules") - F.col("n_terminals")) * (F.lit(9.0) + 2 * log_n)
    return n.select("n_rules", "n_terminals", "n_roots", (F.lit(o.grammar_prior_weight) * dictionary + F.col("n_roots") * log_n).alias("mdl_bits"))


def family_names(rule_rows: DataFrame) -> DataFrame:
    """family (F1, F2 and so on by key), key, and its number of productions, their uses and those at roots.

    Only the distinct keys are numbered: kinds of structure down to a fixed depth, 208 of them at depth 2 with 8
    classes, however many rules there are."""
    keys = rule_rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("uses").alias("total"), F.sum("root_uses").alias("root_weight"))
    return keys.select(F.concat(F.lit("F"), F.row_number().over(Window.orderBy("key"))).alias("family"), "key", "n", "total", "root_weight")


def families(rule_rows: DataFrame) -> DataFrame:
    """One row for each production: its family, key, rule and weight. No family's productions are ever gathered."""
    names = family_names(rule_rows).select("family", "key")
    return rule_rows.join(F.broadcast(names), "key").select("family", "key", "rule", F.col("uses").alias("weight"))


def production_probs(rule_rows: DataFrame, alpha: float = DEFAULTS.dirichlet_concentration) -> DataFrame:
    """Each production's smoothed probability: (w + alpha) / (sum + n * alpha)."""
    rows = rule_rows.join(F.broadcast(family_names(rule_rows)), "key")
    denominator = F.col("total") + F.col("n") * alpha
    return rows.select("family", "rule", F.col("uses").alias("weight"), F.when(denominator > 0, (F.col("uses") + alpha) / denominator).otherwise(1.0 / F.col("n")).alias("prob"))


def root_weights(rule_rows: DataFrame) -> DataFrame:
    return family_names(rule_rows).where("root_weight > 0").select("family", F.col("root_weight").alias("weight"))


def top_roots(weights: DataFrame, k: int = 6) -> DataFrame:
    """The k root families of the greatest weight, of equals by number."""
    return weights.orderBy(F.desc("weight"), F.substr("family", F.lit(2)).cast("int")).limit(k)


def draw(*parts: Column | str) -> Column:
    """A number in [0, 1) made of its arguments, by digest: any engine draws the same."""
    return F.conv(F.substr(F.md5(F.concat_ws(":", *parts).cast("binary")), F.lit(1), F.lit(12)), 16, 10).cast("double") / F.lit(float(1 << 48))


def production_ranges(rule_rows: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """mode, family, rule, its share of [0, 1) as low and high, and its children's families.

    Mode 0 has a family's productions of enough weight (all, if none has), mode 1 those of them with terminal children
    only (or else mode 0's), for deep nodes; mode 2, under the family *, the one terminal that ends the deepest. Shares
    are running sums in the order of names: first of the groups that names begin alike in, then within each, so that a family of any
    size is spread over many tasks. They are taken over the productions left, so they sum to 1."""
    names = written(family_names(rule_rows), "families")
    name = lambda key, family: names.select(F.col("key").alias(key), F.col("family").alias(family))
    rows = rule_rows.join(F.broadcast(names.select("key", "family", "n")), "key").join(F.broadcast(name("left_key", "left_family")), "left_key", "left").join(F.broadcast(name("right_key", "right_family")), "right_key", "left")
    ends = F.coalesce(F.col("left_rule").startswith("T") & F.col("right_rule").startswith("T"), F.lit(True))
    rows = rows.select("family", "n", "rule", "left_family", "right_family", (F.col("uses") + F.lit(o.dirichlet_concentration)).alias("p"), (F.col("uses") >= o.min_production_weight).alias("heavy"), ends.alias("ends"))
    some = rows.groupBy("family").agg(F.bool_or("heavy").alias("any_heavy"), F.bool_or(F.col("heavy") & F.col("ends")).alias("any_heavy_end"), F.bool_or("ends").alias("any_end"))
    rows = rows.join(F.broadcast(some), "family")
    shallow = F.col("heavy") | ~F.col("any_heavy")
    deep = shallow & (F.col("ends") | ~F.when(F.col("any_heavy"), F.col("any_heavy_end")).otherwise(F.col("any_end")))
    modes = F.filter(F.array(F.when(shallow, F.lit(0)), F.when(deep, F.lit(1))), lambda m: m.isNotNull())
    rows = rows.select("family", "rule", "left_family", "right_family", "p", F.substr("rule", F.lit(1), F.lit(3)).alias("part"), F.explode(modes).alias("mode"))
    sums = rows.groupBy("mode", "family", "part").agg(F.sum("p").alias("p"))
    whole = Window.partitionBy("mode", "family")
    offsets = sums.select("mode", "family", "part", (F.sum("p").over(whole.orderBy("part")) - F.col("p")).alias("before"), F.sum("p").over(whole).alias("total"))
    within = Window.partitionBy("mode", "family", "part").orderBy("rule")
    rows = rows.withColumn("upto", F.sum("p").over(within)).join(F.broadcast(offsets), ["mode", "family", "part"])
    out = rows.select("mode", "family", "rule", ((F.col("before") + F.col("upto") - F.col("p")) / F.col("total")).alias("low"), ((F.col("before") + F.col("upto")) / F.col("total")).alias("high"), "left_family", "right_family")
    last = rule_rows.where("kind = 'terminal'").agg(F.min("rule").alias("rule")).where("rule is not null")
    none = F.lit(None).cast("string")
    return out.unionByName(last.select(F.lit(2).alias("mode"), F.lit("*").alias("family"), "rule", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), none.alias("left_family"), none.alias("right_family")))


def starts(weights: DataFrame, n: int = DEFAULTS.n_samples, seed: int = DEFAULTS.rng_seed) -> DataFrame:
    """seed, sample and the root family that each of n samples begins with, drawn by weight."""
    by = Window.orderBy(F.substr("family", F.lit(2)).cast("int"))  # families are few
    shares = weights.select("family", F.sum("weight").over(by).alias("upto"), "weight", F.sum("weight").over(Window.partitionBy()).alias("total"))
    shares = shares.select("family", ((F.col("upto") - F.col("weight")) / F.col("total")).alias("low"), (F.col("upto") / F.col("total")).alias("high"))
    ids = weights.sparkSession.range(n).select(F.lit(seed).cast("long").alias("seed"), F.col("id").alias("sample"))
    ids = ids.withColumn("u", draw(F.lit(str(seed)), F.col("sample").cast("string"), F.lit("root")))
    return ids.join(F.broadcast(shares), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("seed", "sample", "family")


def sampled(begin: DataFrame, ranges: DataFrame, o: Options = DEFAULTS) -> DataFrame:
    """Sampled split trees: one row a node, at a path of 0s and 1s from the root (''), with its family and rule.

    Trees grow level by level, by a join of the open nodes with the ranges: the grammar stays where it is, and only the
    nodes travel. A node's draw is made of its sample and path, so samples don't depend on how many there are."""
    spark = begin.sparkSession
    names = {"begin": "_trellis_begin", "ranges": "_trellis_ranges"}
    written(begin, "starts").createOrReplaceTempView(names["begin"])
    written(ranges, "ranges").createOrReplaceTempView(names["ranges"])
    mode = lambda depth: f"CASE WHEN {depth} >= {2 * o.max_depth} THEN 2 WHEN {depth} >= {o.max_depth} THEN 1 ELSE 0 END"
    drawn = lambda seed, sample, path: f"CAST(conv(substr(md5(concat_ws(':', CAST({seed} AS STRING), CAST({sample} AS STRING), {path})), 1, 12), 16, 10) AS DOUBLE) / 281474976710656D"
    pick = lambda c: f"r.mode = {mode(c + '.depth')} AND r.family = CASE WHEN r.mode = 2 THEN '*' ELSE {c}.family END AND r.low <= {c}.u AND {c}.u < r.high"
    return spark.sql(f"""WITH RECURSIVE grown(seed, sample, path, depth, family, rule, left_family, right_family) AS (
 SELECT b.seed, b.sample, '', 0, b.family, r.rule, r.left_family, r.right_family FROM (SELECT *, 0 AS depth, {drawn('seed', 'sample', "''")} AS u FROM {names['begin']}) b JOIN {names['ranges']} r ON {pick('b')}
 UNION ALL
 SELECT c.seed, c.sample, c.path, c.depth, c.family, r.rule, r.left_family, r.right_family
 FROM (SELECT *, {drawn('seed', 'sample', 'path')} AS u FROM (SELECT seed, sample, concat(path, side) AS path, depth + 1 AS depth, CASE WHEN side = '0' THEN left_family ELSE right_family END AS family FROM grown, (VALUES ('0'), ('1')) AS s(side) WHERE left_family IS NOT NULL)) c
 JOIN {names['ranges']} r ON {pick('c')})
 SELECT seed * 10000 + sample AS seed, sample, path, depth, family, rule FROM grown""")


def sample_layout(nodes: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """The rectangles of sampled trees, as `layout` has them. A tree is drawn by one task; its size is bounded by its depth."""
    body = rule_rows.select("rule", "axis", "cls", "left_size")
    rows = nodes.join(body, "rule", "left").select("seed", "sample", "path", "rule", "cls", "axis", "left_size")

    def work(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["path"])
        by = {r["path"]: r for r in rows}
        done: dict[str, Region] = {}
        for r in reversed(rows):
            parts = [done.get(r["path"] + side) for side in "01"]
            here = Region(r["cls"], r["axis"], 0, 1, *parts, 0)
            here.share = r["left_size"] or 0.0
            done[r["path"]] = here
        boxes = {"": (0.0, 0.0, 1.0, 1.0)}
        for path in by:
            if done[path].left is not None:
                boxes[path + "0"], boxes[path + "1"] = halves(done[path], boxes[path])
        out = [(r["seed"], r["sample"], p, r["rule"], r["cls"], *boxes[p]) for p, r in by.items()]
        return pa.Table.from_pylist([dict(zip(("seed", "sample", "path", "rule", "cls", *"xywh"), x, strict=True)) for x in out], pa.schema([("seed", pa.int64()), ("sample", pa.int64()), ("path", pa.string()), ("rule", pa.string()), ("cls", pa.string()), *((c, pa.float64()) for c in "xywh")]))

    out = rows.groupBy("seed", "sample").applyInArrow(work, "seed long, sample long, path string, rule string, cls string, x double, y double, w double, h double")
    return out.select("seed", "sample", "path", "rule", "cls", *(F.round(c, 6).alias(c) for c in "xywh"))
