"""Quality rules: text statistics, and a learned decision list over them.

Words are parted by space, tab, line feed, vertical tab, form feed and carriage return. The statistics are whole
numbers counted over the whole text. The list is learned by sequential covering: each rule is grown condition by
condition on two thirds of the rows by information gain (as in FOIL), pruned on the rest by (p - n) / (p + n), and
kept while it is right more often than `least_precision` there; the rows it covers then leave. The list becomes one
ordered `CASE WHEN`, so applying it needs no Python.

The list is learned from at most `max_rows` labelled documents, those with the least hashes of their ids; the
bound is a parameter. Everything else covers all rows.

Null and empty texts have no words: all statistics are 0 and base_failed is true. Repeated rows are judged each for
itself. An id with several labels counts as bad if any of them is 0. Without labels of both kinds the list is empty
and the base rules alone decide. Columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import LEADS, NOT_NEWLINE, NOT_SPACE, Tokens, column_bytes, mix64, per_row, slices, sums_between
from .common import small_batches

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_digits", "n_stops", "n_marks", "n_distinct"]
#: What the rules may test, each a ratio of two statistics.
FEATURES = {
    "mean_word_chars": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_line_share": ("n_dup_lines", "n_lines"),
    "repeat_word_share": ("n_repeat_words", "n_words"),
    "upper_share": ("n_upper", "n_letters"),
    "digit_share": ("n_digits", "word_chars"),
    "stops_per_word": ("n_stops", "n_words"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_share": ("n_distinct", "n_words"),
}
MAX_ROWS = 20_000


def _bytes(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_SYMBOLS, _STOPS, _MARKS, _DIGITS = _bytes("[#*$%&|<>]"[1:-1]), _bytes(".,;:"), _bytes("!?"), _bytes("0123456789")
_UPPER, _LETTERS = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = True
_LETTERS[65:91] = _LETTERS[97:123] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """STATS by row."""
    n_rows = len(offsets) - 1
    words, lines = Tokens(data, offsets, NOT_SPACE), Tokens(data, offsets, NOT_NEWLINE)
    in_word = NOT_SPACE[data]
    within = lambda kind, mask=None: sums_between(kind[data] if mask is None else kind[data] & mask, offsets[:-1], offsets[1:])
    with_word = sums_between(in_word, lines.starts, lines.ends) > 0
    line_rows, line_keys = lines.rows[with_word], lines.hashes[with_word] ^ mix64(lines.rows[with_word].astype(np.uint64))
    n_lines = per_row(line_rows, n_rows)
    _, one = np.unique(line_keys, return_index=True)
    first, grams = words.grams(3)
    _, back, many = np.unique(grams ^ mix64(words.rows[first].astype(np.uint64)), return_inverse=True, return_counts=True)
    repeated = first[many[back] > 1]
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[repeated + j] = True
    _, one_word = np.unique(words.hashes ^ mix64(words.rows.astype(np.uint64)), return_index=True)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": within(LEADS, in_word),
        "n_symbols": within(_SYMBOLS),
        "n_dup_lines": n_lines - per_row(line_rows[one], n_rows),
        "n_repeat_words": per_row(words.rows[covered], n_rows),
        "n_lines": n_lines,
        "n_upper": within(_UPPER),
        "n_letters": within(_LETTERS),
        "n_digits": within(_DIGITS),
        "n_stops": within(_STOPS),
        "n_marks": within(_MARKS),
        "n_distinct": per_row(words.rows[one_word], n_rows),
    }


def with_statistics(docs: DataFrame, *, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The documents (without the text, unless it is to stay) and their STATS."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*STATS)
    stay = [c for c in docs.columns if keep_text or c != text_col]
    schema = T.StructType([*(docs.schema[c] for c in stay), *(T.StructField(s, T.LongType()) for s in STATS)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                found = statistics(*column_bytes(batch.column(text_col)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), *(pa.array(found[s], pa.int64()) for s in STATS)], names=[*stay, *STATS])

    return docs.mapInArrow(work, schema)


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    value: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.value if self.at_least else x[self.feature] < self.value

    def column(self) -> Column:
        top, bottom = FEATURES[self.feature]
        ratio = F.when(F.col(bottom) > 0, F.col(top) / F.col(bottom)).otherwise(F.lit(0.0))
        return ratio >= F.lit(self.value) if self.at_least else ratio < F.lit(self.value)


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    precision: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([c.holds(x) for c in self.conditions])

    def column(self) -> Column:
        out = self.conditions[0].column()
        for c in self.conditions[1:]:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(f"{c.feature} {'>=' if c.at_least else '<'} {c.value:.6g}" for c in self.conditions)


def features(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.where(stats[b] > 0, stats[a] / np.maximum(stats[b], 1), 0.0) for k, (a, b) in FEATURES.items()}


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[Condition]:
    """Conditions, each the threshold with the greatest information gain over the rows that are left."""
    left = np.ones(len(bad), bool)
    out: list[Condition] = []
    while len(out) < most and (~bad[left]).any() and bad[left].any():
        base = np.log2(bad[left].mean())
        best = (1e-9, None)
        for name, values in x.items():
            v, y = values[left], bad[left]
            order = np.argsort(v, kind="stable")
            v, y = v[order], y[order]
            cuts = np.flatnonzero(v[1:] > v[:-1]) + 1
            if not len(cuts):
                continue
            below = np.concatenate([[0], np.cumsum(y)])
            for at_least in (True, False):
                p = below[-1] - below[cuts] if at_least else below[cuts]
                n = (len(y) - cuts if at_least else cuts) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], Condition(name, at_least, float((v[cuts[k] - 1] + v[cuts[k]]) / 2)))
        if best[1] is None:
            break
        out.append(best[1])
        left &= best[1].holds(x)
    return out


def learn(stats: dict[str, np.ndarray], bad: np.ndarray, *, most_rules: int = 12, most_conditions: int = 4, least_precision: float = 0.9, least_rows: int = 5, seed: int = 0) -> list[Rule]:
    """Ordered rules for bad rows."""
    x = features(stats)
    out: list[Rule] = []
    rows = np.arange(len(bad))
    rng = np.random.default_rng(seed)
    while len(out) < most_rules and len(rows) and bad[rows].sum() >= least_rows:
        part = rng.permutation(rows)
        cut = 2 * len(part) // 3
        grown = _grow({k: v[part[:cut]] for k, v in x.items()}, bad[part[:cut]], most_conditions)
        if not grown:
            break
        held, held_bad = {k: v[part[cut:]] for k, v in x.items()}, bad[part[cut:]]

        def worth(conditions: list[Condition], held=held, held_bad=held_bad) -> tuple[float, int]:
            covered = np.logical_and.reduce([c.holds(held) for c in conditions])
            p, n = int((covered & held_bad).sum()), int((covered & ~held_bad).sum())
            return ((p - n) / (p + n) if p + n else -1.0, p)

        best = max((worth(grown[:k]) + (-k,) for k in range(1, len(grown) + 1)))
        conditions = tuple(grown[: -best[2]])
        everywhere = np.logical_and.reduce([c.holds({k: v[rows] for k, v in x.items()}) for c in conditions])
        precision = (best[0] + 1) / 2
        if precision < least_precision or bad[rows][everywhere].sum() < least_rows:
            break
        out.append(Rule(conditions, float(precision)))
        rows = rows[~everywhere]
    return out


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_ROWS, **options) -> list[Rule]:
    """A list learned from at most max_rows labelled documents (one text for each id)."""
    chosen = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).alias("_label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
    # of an id's texts the least statistics, chosen before anything comes to the driver: at most max_rows rows do
    one = with_statistics(texts, text_col="_text").groupBy("_id", "_label").agg(F.min(F.struct(*STATS)).alias("s"))
    rows = one.select("_id", "_label", "s.*").toPandas().sort_values("_id")
    bad = (rows["_label"] == 0).to_numpy()
    if not bad.any() or bad.all():
        return []
    return learn({s: rows[s].to_numpy() for s in STATS}, bad, **options)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, else null: ordered conditions, in the JVM."""
    out = F.lit(None).cast("int")
    for i, rule in reversed([*enumerate(rules)]):
        out = F.when(rule.column(), F.lit(i)).otherwise(out)
    return out


def judged(docs: DataFrame, rules: list[Rule], **options) -> DataFrame:
    """Statistics, base_failed, rule (the number of the rule that rejects it) and kept."""
    out = with_statistics(docs.drop("base_failed", "rule", "kept"), **options)
    out = out.withColumn("base_failed", base_failed()).withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
