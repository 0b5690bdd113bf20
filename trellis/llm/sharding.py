"""Sharding by minimax contiguous partition, with DataFrame functions only.

Rows with equal texts form one atomic group (nulls count as empty texts). Groups are ordered by a 64-bit hash of the text and parted into `n_shards` runs whose greatest number
of bytes is the least possible for that order. The least capacity is found by binary search, each trial by the
greedy check: take groups until the next one would not fit, then cut.

The driver never sees single groups of a large corpus. It sees cells, runs of the hash order with their
bytes, of which there are a bounded number. Taking cells as divisible gives a capacity that is too small or right,
taking them as indivisible one that is large enough; only cells in which a cut may fall between these two are
split further, by one aggregation. When no such cell is left that holds more than one group, both agree.

A row's size is its text's UTF-8 bytes (none for null) plus 8. Slots number the rows of each shard from 0 without
gaps: rows are dealt to buckets by hash, buckets are counted, and rows are ranked within their bucket only, so that
no task holds a whole shard. Repeated rows get slots of their own. An empty table gives no rows. Fewer groups than
shards leave shards empty. Columns named like the results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, text_column

N_SHARDS = 24
#: Bits of the hash that one step of refinement looks at.
FIRST_BITS, NEXT_BITS = 11, 6
ADDED = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


@dataclass(frozen=True)
class Cell:
    """Groups whose hash, without its last `shift` bits, is `prefix`."""

    prefix: int
    shift: int
    total: int
    groups: int
    last: int  # the greatest hash in it

    @property
    def atomic(self) -> bool:
        return self.groups == 1


def order_key(text: Column) -> Column:
    """A group's place in the order: 63 bits of a hash of its text."""
    return F.shiftrightunsigned(F.xxhash64(text), 1)


def _cells(groups: DataFrame, shift: int, within: DataFrame | None = None, old_shift: int = 0) -> list[Cell]:
    rows = groups.withColumn("prefix", F.shiftrightunsigned("key", shift))
    if within is not None:
        rows = rows.withColumn("old", F.shiftrightunsigned("key", old_shift)).join(F.broadcast(within), "old", "left_semi")
    found = rows.groupBy("prefix").agg(F.sum("bytes").alias("total"), F.count("*").alias("groups"), F.max("key").alias("last")).collect()
    return [Cell(r["prefix"], shift, r["total"], r["groups"], r["last"]) for r in found]


def greedy(cells: list[Cell], capacity: int, n: int, divisible: bool) -> list[int] | None:
    """Where each of the first n - 1 shards ends, in bytes from the start; None if n shards don't suffice.

    Divisible: cells of several groups may be cut anywhere, which reaches at least as far as any real cut."""
    cuts, at, room = [], 0, capacity
    for cell in cells:
        left = cell.total
        if divisible and not cell.atomic:
            while left > room:
                at, left = at + room, left - room
                cuts.append(at)
                room = capacity
                if len(cuts) >= n:
                    return None
        elif left > room:
            if left > capacity:
                return None
            cuts.append(at)
            room = capacity
            if len(cuts) >= n:
                return None
        at, room = at + left, room - left
    return [*cuts, *[at] * (n - 1 - len(cuts))]


def least_capacity(cells: list[Cell], n: int, divisible: bool) -> int:
    total = sum(c.total for c in cells)
    low, high = -(-total // n), total
    while low < high:
        middle = (low + high) // 2
        if greedy(cells, middle, n, divisible) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(groups: DataFrame, n_shards: int = N_SHARDS) -> tuple[int, list[int]]:
    """The least capacity, and the greatest key of each shard but the last (of groups: key, bytes)."""
    spark = groups.sparkSession
    cells = sorted(_cells(groups, 63 - FIRST_BITS), key=lambda c: (c.last,))
    while True:
        low, high = least_capacity(cells, n_shards, True), least_capacity(cells, n_shards, False)
        near, far = greedy(cells, low, n_shards, False), greedy(cells, high, n_shards, True)
        near = near or _reach(cells, low, n_shards)
        spans = [*zip(near, far, strict=True)]
        open_cells, at, k = [], 0, 0
        for cell in cells:
            if not cell.atomic and any(a <= at + cell.total and at <= b for a, b in spans):
                open_cells.append(cell)
            at += cell.total
        if not open_cells or all(c.shift == 0 for c in open_cells):
            break
        open_ids = {id(c) for c in open_cells}
        cells = [c for c in cells if id(c) not in open_ids]
        for shift in sorted({c.shift for c in open_cells}):
            within = spark.createDataFrame([(c.prefix,) for c in open_cells if c.shift == shift], "old long")
            cells += _cells(groups, max(0, shift - NEXT_BITS), within, shift)
        cells.sort(key=lambda c: c.last)
    capacity = least_capacity(cells, n_shards, False)
    ends, at, k, keys = greedy(cells, capacity, n_shards, False) or [], 0, 0, []
    for cell in cells:
        at += cell.total
        while k < len(ends) and ends[k] == at:
            keys.append(cell.last)
            k += 1
    return capacity, keys


def _reach(cells: list[Cell], capacity: int, n: int) -> list[int]:
    """The cuts of the indivisible greedy run, though n shards may not suffice; a cell that is too large is its own shard."""
    cuts, at, room = [], 0, capacity
    for cell in cells:
        if cell.total > room and room < capacity:
            cuts.append(at)
            room = capacity
        at, room = at + cell.total, max(0, room - cell.total)
    return [*cuts, *[at] * n][: n - 1]


def with_shards(docs: DataFrame, *, n_shards: int = N_SHARDS, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 100_000, least_buckets: int = 256, keep_text: bool = False) -> DataFrame:
    """The documents with ADDED columns; the text only if it is to stay."""
    docs = docs.drop(*ADDED)
    text = text_column(docs, text_col)
    stay = F.struct(*(docs[c] for c in docs.columns if keep_text or c != text_col)).alias("_doc")
    rows = docs.select(stay, docs[id_col].alias("_id"), order_key(text).alias("_key"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    groups = kept(rows.groupBy(F.col("_key").alias("key")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n_rows")), "shard-groups")
    _, keys = minimax_cuts(groups, n_shards)
    n_rows = groups.agg(F.sum("n_rows").alias("n")).first()["n"] or 0
    n_buckets = max(least_buckets, -(-n_rows // bucket_rows))
    shard = sum((F.when(F.col("_key") > F.lit(k), 1).otherwise(0) for k in keys), F.lit(0)).cast("int")
    bucket = F.pmod(F.xxhash64("_id", "_key"), F.lit(n_buckets)).cast("int")
    rows = rows.select("_doc", "_id", "_key", "size", "text_crc32", shard.alias("shard"), bucket.alias("_bucket"))
    counts = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n"))
    # n_shards times n_buckets rows at most, about 24 for each 100,000 rows of the corpus
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    before = before.select("shard", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_id", "_key"))
    rows = rows.withColumn("_rank", rank).join(before, ["shard", "_bucket"])
    slot = F.col("_before") + F.col("_rank") - 1
    return rows.select("_doc.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
