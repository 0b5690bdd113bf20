"""License scans: MinHash bands over overlapping text windows find templates, exact containment verifies.

Words are runs of digits, letters and all that is not ASCII, in lower case; shingles are runs of five words (a template of
fewer words is one shingle of its length). Templates are put in classes by their number of shingles, doubled
each time. For a class of up to n shingles, windows of 2n shingles start every n/2 (at least 1), so that each
occurrence of up to 3/2 n shingles lies whole within a window. A window and a template of more than n/2 shingles of which 0.8 are in it have a
Jaccard similarity above 0.4 n / 2.1 n, 0.19; with `BANDS` bands of one MinHash each they share none with a
probability below 0.0018 in that worst case, and below 1e-6 for whole occurrences in windows that hold other text
(similarity 0.25 or more). Candidates are then compared shingle by shingle: a window holds a template if at least
`LEAST` of the template's distinct shingles are in it. Runs of windows that hold it are one finding.

A template that is part of a longer one is found in it too.

Templates are a parameter, checked to be at most `MOST_WORDS` words in all, as their bands go to every task; more of
them are taken in several passes. Nulls and texts without words have no findings. Repeated rows are judged each for
itself. Columns named like the results are replaced. Empty tables, or no templates, give no findings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import license_texts
from .bytetext import ALNUM, Tokens, column_bytes, mix64, slices
from .common import small_batches

SHINGLE, LEAST_NUMERATOR, LEAST_DENOMINATOR = 5, 4, 5
BANDS = 32
MOST_WORDS = 500_000
FOUND = T.ArrayType(T.StructType().add("license", "string").add("start", "integer").add("end", "integer").add("containment", "double"))

TEMPLATES = license_texts.templates()


@dataclass(frozen=True)
class Group:
    """Templates of one class: sorted (value, template) pairs of each band, and each template's distinct shingles."""

    width: int
    stride: int
    length: int  # words in a shingle
    values: tuple[np.ndarray, ...]
    owners: tuple[np.ndarray, ...]
    shingles: tuple[np.ndarray, ...]
    names: tuple[str, ...]
    sizes: tuple[int, ...]  # shingles, repeats included


def seeds() -> np.ndarray:
    return mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def grouped(templates: list[tuple[str, str]]) -> list[Group]:
    data, offsets = column_bytes(pa.array([t for _, t in templates], pa.string()))
    words = Tokens(data, offsets, ALNUM, fold=True)
    by: dict[tuple[int, int], list[tuple[str, np.ndarray]]] = {}
    for i, (name, _) in enumerate(templates):
        if n := int(words.counts[i]):
            length = min(n, SHINGLE)
            first, hashes = words.grams(length)
            mine = hashes[words.rows[first] == i]
            by.setdefault((length, 1 << int(np.ceil(np.log2(len(mine))))), []).append((name, mine))
    out = []
    for (length, most), group in sorted(by.items()):
        sets = [np.unique(h) for _, h in group]
        values, owners = [], []
        for seed in seeds():
            least = np.array([mix64(s ^ seed).min() for s in sets], np.uint64)
            order = np.argsort(least, kind="stable")
            values.append(least[order])
            owners.append(order)
        out.append(Group(2 * most, max(1, most // 2), length, tuple(values), tuple(owners), tuple(sets), tuple(n for n, _ in group), tuple(len(h) for _, h in group)))
    return out


def candidates(windows: list[np.ndarray], group: Group) -> np.ndarray:
    """Pairs (window, template) that share a band, from each band's window minima."""
    out = []
    for least, values, owners in zip(windows, group.values, group.owners, strict=True):
        first, last = np.searchsorted(values, least, "left"), np.searchsorted(values, least, "right")
        which = np.flatnonzero(last > first)
        many = (last - first)[which]
        at = np.repeat(first[which], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        out.append(np.stack([np.repeat(which, many), owners[at]], 1))
    return np.unique(np.concatenate(out), axis=0)


def findings(words: Tokens, group: Group, step: int = 2_000_000) -> list[tuple[int, str, int, int, float]]:
    """Row, license, first and last word (end exclusive) and containment of the places that hold a template.

    A band can only match where the window's least shingle is one of a template's, so only windows that hold such
    a shingle get their MinHashes computed: the candidates are the same."""
    at, hashes = words.grams(group.length)
    known = np.unique(np.concatenate(group.shingles))
    where = np.flatnonzero(known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes)
    if not len(where):
        return []
    # shingles of a row are neighbours: the first one's number, and how many there are
    rows = words.rows[at]
    counts = np.bincount(rows, minlength=words.n_rows)
    base = np.cumsum(counts) - counts
    local = where - base[rows[where]]
    last = local // group.stride
    back = last[:, None] - np.arange(-(-group.width // group.stride))
    good = (back >= 0) & (back * group.stride + group.width > local[:, None])
    begins = np.unique((base[rows[where]][:, None] + back * group.stride)[good])
    out = []
    for a in range(0, len(begins), max(1, step // group.width)):
        out += _held(begins[a : a + max(1, step // group.width)], hashes, rows, base, counts, group)
    return out


def _held(begins: np.ndarray, hashes: np.ndarray, rows: np.ndarray, base: np.ndarray, counts: np.ndarray, group: Group) -> list[tuple[int, str, int, int, float]]:
    row = rows[begins]
    spots = begins[:, None] + np.arange(group.width)
    real = spots < (base[row] + counts[row])[:, None]
    values = hashes[np.minimum(spots, len(hashes) - 1)]
    none = np.iinfo(np.uint64).max
    least = [np.where(real, mix64(values ^ seed), none).min(1) for seed in seeds()]
    out = []
    for w, t in candidates(least, group).tolist():
        have = np.isin(values[w], group.shingles[t]) & real[w]
        n = len(np.unique(values[w][have]))
        if LEAST_DENOMINATOR * n >= LEAST_NUMERATOR * len(group.shingles[t]):
            places = np.flatnonzero(have) + (begins[w] - base[row[w]])
            out.append((int(row[w]), group.names[t], int(places[0]), int(places[-1]) + group.length, n / len(group.shingles[t])))
    return out


def merged(found: list[tuple[int, str, int, int, float]], n_rows: int) -> list[list[dict]]:
    """By row: findings of one license that overlap or touch are one, with the greatest containment."""
    out: list[list[dict]] = [[] for _ in range(n_rows)]
    for row, name, a, b, share in sorted(found):
        last = next((x for x in reversed(out[row]) if x["license"] == name), None)
        if last and a <= last["end"]:
            last["end"], last["containment"] = max(b, last["end"]), max(share, last["containment"])
        else:
            out[row].append({"license": name, "start": a, "end": b, "containment": share})
    return [sorted(x, key=lambda f: (f["start"], f["license"])) for x in out]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | tuple[tuple[str, str], ...] = TEMPLATES, *, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The documents (without the text, unless it is to stay) with licenses: where (in words) each was found."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("licenses")
    parts: list[list[tuple[str, str]]] = [[]]
    size = 0
    for name, text in templates:
        if size + len(text) // 2 > MOST_WORDS and parts[-1]:
            parts.append([])
            size = 0
        parts[-1].append((name, text))
        size += len(text) // 2
    stay = [c for c in docs.columns if keep_text or c != text_col]
    out = docs
    for i, part in enumerate(parts):
        out = _scanned(out, part, text_col, [*(stay if i == len(parts) - 1 else docs.columns)], first=i == 0)
    return out


def _scanned(docs: DataFrame, templates: list[tuple[str, str]], text_col: str, stay: list[str], *, first: bool) -> DataFrame:
    groups = docs.sparkSession.sparkContext.broadcast(grouped(templates))
    schema = T.StructType([*(docs.schema[c] for c in stay), T.StructField("licenses", FOUND)])
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("containment", pa.float64())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                words = Tokens(*column_bytes(batch.column(text_col)), ALNUM, fold=True)
                found = [f for g in groups.value for f in findings(words, g)]
                if not first:
                    found += [(i, f["license"], f["start"], f["end"], f["containment"]) for i, fs in enumerate(batch.column("licenses").to_pylist()) for f in fs]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in stay), pa.array(merged(found, words.n_rows), kind)], names=[*stay, "licenses"])

    return docs.mapInArrow(work, schema)


def summary(found: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """One row for each document: how many findings, which licenses, and where."""
    spans = F.array_join(F.transform("licenses", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["license"]))), ",")
    return found.select(id_col, F.size("licenses").cast("long").alias("n_licenses"), names.alias("licenses"), spans.alias("spans"))
