"""Benchmark decontamination by winnowing (Schleimer, Wilkerson and Aiken, 2003).

Words are runs of digits, letters and all that is not ASCII, with A-Z as a-z. A window is `WINDOW` consecutive
words of a benchmark item; an item of fewer words, but not none, is one window. A document word is hit if it lies
in any occurrence of a window. From each run of `WINDOW - K + 1` successive k-grams winnowing keeps the least
hash, so that every span of WINDOW words that a document shares with an item leaves one fingerprint in both. An item of
fewer words is its own fingerprint, and documents are fingerprinted at all spans of just those lengths.

Fingerprints of the benchmark and of the documents are tables and meet in a join; a match is extended to the windows that
may hold it, and these are joined with the benchmark's windows by hash and word by word. Before documents' fingerprints leave
Python, a Bloom filter of the benchmark's (16 MB at most, whatever the benchmark) drops nearly all that have no partner; it
drops no other. Texts are judged once for all their copies. Only texts with a fingerprint that passes are
written down. The benchmark's side of a join is broadcast up to `few_prints` rows, which is counted, and beyond
that joined by a shuffle in which frequent fingerprints are salted.

Nulls and texts without words have no words and no hits; null item ids or texts take no part. Repeated rows are
judged each for itself. Items that repeat an id count as one item. An empty benchmark or an empty table leaves everything clean.
Columns of the documents named like the results are replaced by `contamination`; `clean_documents` leaves all columns as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import _FOLDED, _MIX_A, ALNUM, Tokens, column_bytes, mix64, n_tokens, sliding_min, slices
from .common import kept, lean, salted_join, small_batches

WINDOW, K = 13, 5
#: Rows of the benchmark's tables that are broadcast at most: fingerprints have 8 bytes, windows some 100.
FEW_PRINTS, FEW_WINDOWS = 2_000_000, 200_000
#: Bits of the Bloom filter, at most.
MOST_BITS = 1 << 27
ADDED = ["n_words", "hit_spans", "items", "n_hit", "n_items", "contaminated"]
_U = np.uint64


def winnowed(words: Tokens, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The first words and hashes of the kept k-grams: of each window's k-grams the least (ties: all of them)."""
    first, hashes = words.grams(k)
    width = window - k + 1
    if len(first) < width:
        return first[:0], hashes[:0]
    least = sliding_min(hashes, width)
    whole = words.rows[first[: len(first) - width + 1]] == words.rows[first[width - 1 :]]
    best = np.zeros(len(hashes), np.uint64)  # the greatest of the minima of the windows that hold each k-gram
    least = np.where(whole, least, np.uint64(0))
    padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
    best = ~sliding_min(~padded, width)
    keep = hashes == best
    return first[keep], hashes[keep]


def mixed(prints: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints with the length of the window they stand for."""
    return mix64(prints ^ mix64(np.array([length], _U)))


def hash_of(words: Tokens, starts: np.ndarray, length: int, out: np.ndarray) -> np.ndarray:
    """Hashes of the runs of `length` words at the given starts; as Tokens.grams makes them."""
    with np.errstate(over="ignore"):
        for j in range(length):
            out = out * _MIX_A + words.hashes[starts + j]
    return mix64(out)


class Text:
    """Words of a column in order and in lower case, one space between them, so that a window is one slice."""

    def __init__(self, column: pa.Array):
        data, offsets = column_bytes(column)
        self.words = w = Tokens(data, offsets, ALNUM, fold=True)
        lengths = w.ends - w.starts
        self.at = np.concatenate([[0], np.cumsum(lengths + 1)])
        out = np.full(int(self.at[-1]), 32, np.uint8)
        inside = ALNUM[data]
        out[np.repeat(self.at[:-1] - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))] = _FOLDED[data[inside]]
        self.bytes = out.tobytes()

    def windows(self, starts: np.ndarray, length: int) -> list[bytes]:
        first, last = self.at[starts], self.at[starts + length] - 1
        return [self.bytes[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, length, hash and words of each window of the items."""
    for whole in batches:
        for batch in slices(whole, "text", 1_000_000):
            text = Text(batch.column("text"))
            words, items = text.words, batch.column("item")
            for length in np.unique(np.minimum(words.counts[words.counts > 0], WINDOW)).tolist():
                first, hashes = words.grams(length)
                mine = np.minimum(words.counts[words.rows[first]], WINDOW) == length
                first, hashes = first[mine], hashes[mine]
                yield pa.RecordBatch.from_arrays([items.take(pa.array(words.rows[first])), pa.array(np.full(len(first), length, np.int32)), _signed(hashes), pa.array(text.windows(first, length), pa.binary())], names=["item", "length", "hash", "words"])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of the items, and the lengths they stand for."""
    for whole in batches:
        for batch in slices(whole, "text", 1_000_000):
            words = Tokens(*column_bytes(batch.column("text")), ALNUM, fold=True)
            at, prints = winnowed(words)
            found = [(WINDOW, prints)]
            for length in np.unique(words.counts[(words.counts > 0) & (words.counts < WINDOW)]).tolist():
                first, hashes = words.grams(length)
                found.append((length, hashes[words.counts[words.rows[first]] == length]))
            for length, prints in found:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(prints), length, np.int32)), _signed(mixed(prints, length))], names=["length", "print"])


def _bloom(prints: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """Words of a Bloom filter with two bits for each fingerprint, and its number of bits: set by the tasks, joined by OR."""
    bits = min(MOST_BITS, 1 << max(16, (16 * max(1, n) - 1).bit_length()))
    place = lambda shift: F.shiftrightunsigned("print", shift).bitwiseAND(F.lit(bits - 1).cast("long"))
    spots = prints.select(F.explode(F.array(place(0), place(32))).alias("p"))
    words = spots.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS INT))")).alias("b")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy()
    return out.view(_U), bits


def _passes(bloom: tuple[np.ndarray, int], prints: np.ndarray) -> np.ndarray:
    words, bits = bloom
    out = np.ones(len(prints), bool)
    for shift in (0, 32):
        spot = (prints >> _U(shift)) & _U(bits - 1)
        out &= (words[(spot >> _U(6)).astype(np.int64)] >> (spot & _U(63))) & _U(1) == 1
    return out


SUSPECT = "digest binary, text string, n_words long, prints array<struct<print:long,length:int,at:int>>"


def _suspects(docs: DataFrame, bloom, lengths: list[int]) -> DataFrame:
    """Each text with fingerprints that pass the filter, once, with these: where they are, and for what length they stand."""
    kind = pa.list_(pa.struct([("print", pa.int64()), ("length", pa.int32()), ("at", pa.int32())]))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                column = batch.column("text")
                words = Tokens(*column_bytes(column), ALNUM, fold=True)
                found = []
                for length in lengths:
                    at, prints = winnowed(words) if length == WINDOW else words.grams(length)
                    prints = mixed(prints, length)
                    there = _passes(bloom.value, prints)
                    found.append((at[there], prints[there], np.full(int(there.sum()), length, np.int32)))
                at, prints, length = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.argsort(words.rows[at], kind="stable")
                at, prints, length = at[order], prints[order], length[order]
                rows, many = np.unique(words.rows[at], return_counts=True)
                local = at - words.firsts[words.rows[at]]
                ends = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([_signed(prints), pa.array(length), pa.array(local, pa.int32())], fields=[*kind.value_type]))
                texts = column.take(pa.array(rows))
                digests = [hashlib.md5(t).digest() for t in texts.cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), texts, pa.array(words.counts[rows], pa.int64()), lists], names=["digest", "text", "n_words", "prints"])

    return docs.mapInArrow(lean(work), SUSPECT).dropDuplicates(["digest"])


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows that may hold a matched fingerprint: digest, n_words, length, start, hash and words."""
    for whole in batches:
        for batch in slices(whole, "text", 2_000_000):
            text = Text(batch.column("text"))
            words = text.words
            matched = batch.column("matched")
            many = np.diff(matched.offsets.to_numpy())
            flat = matched.flatten()
            at = flat.field("at").to_numpy() + np.repeat(words.firsts[:-1], many)
            lengths = flat.field("length").to_numpy()
            for length in np.unique(lengths).tolist():
                starts = at[lengths == length]
                if length == WINDOW:
                    starts = np.unique((starts[:, None] - np.arange(WINDOW - K + 1)).ravel())
                    starts = starts[(starts >= 0) & (starts + length <= len(words))]
                    starts = starts[words.rows[starts] == words.rows[starts + length - 1]]
                rows = words.rows[starts]
                hashes = hash_of(words, starts, length, np.zeros(len(starts), _U))
                columns = [batch.column("digest").take(pa.array(rows)), batch.column("n_words").take(pa.array(rows)), pa.array(np.full(len(starts), length, np.int32)), pa.array(starts - words.firsts[rows], pa.int32()), _signed(hashes), pa.array(text.windows(starts, length), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["digest", "n_words", "length", "start", "hash", "words"])


def _joined(left: DataFrame, right: DataFrame, key: str, spread: str, few: int, n: int) -> DataFrame:
    """A join of documents with the benchmark's n rows: broadcast if they are few, or else by a salted shuffle.
    Of `right`, a key's rows are one array, so that keys are unique."""
    if n <= few:
        return left.join(F.broadcast(right), key)
    left = kept(left, "documents-side")
    return salted_join(left, right, key, spread, left.groupBy(key).agg(F.count("*").alias("n")), left.count())


def digest_of(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def verdicts(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", few_prints: int = FEW_PRINTS, few_windows: int = FEW_WINDOWS) -> DataFrame:
    """digest (MD5), n_words, hit_spans and items of each distinct text that holds a window of an item; a table."""
    small_batches(docs.sparkSession)
    items = benchmark.select(benchmark[item_col].cast("string").alias("item"), benchmark[item_text_col].cast("string").alias("text")).where("item is not null and text is not null")
    prints = kept(items.mapInArrow(_prints, "length int, print long").distinct(), "benchmark-prints")
    windows = items.mapInArrow(_windows, "item string, length int, hash long, words binary").groupBy("hash").agg(F.collect_set(F.struct("length", "words", "item")).alias("known"))
    windows = kept(windows, "benchmark-windows")
    lengths = sorted(r["length"] for r in prints.select("length").distinct().collect())  # WINDOW at most
    n_prints, n_windows = prints.count(), windows.count()
    if not n_prints:
        return docs.sparkSession.createDataFrame([], "digest binary, n_words long, hit_spans array<struct<start:int,end:int>>, items array<string>")
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(prints, n_prints))
    texts = docs.select(docs[text_col].cast("string").alias("text")).where("text is not null")
    suspects = kept(_suspects(texts, bloom, lengths), "suspects")
    met = _joined(suspects.select("digest", F.explode("prints").alias("p")).select("digest", "p.*"), prints.select("print"), "print", "digest", few_prints, n_prints)
    matched = met.groupBy("digest").agg(F.collect_list(F.struct("length", "at")).alias("matched"))
    extended = suspects.drop("prints").join(matched, "digest").mapInArrow(lean(_extended), "digest binary, n_words long, length int, start int, hash long, words binary")
    held = _joined(extended, windows, "hash", "digest", few_windows, n_windows)
    held = held.select("digest", "n_words", "start", "length", F.filter("known", lambda k: (k["length"] == F.col("length")) & (k["words"] == F.col("words"))).alias("known")).where(F.size("known") > 0)
    spans, names = F.collect_set(F.struct("start", (F.col("start") + F.col("length")).alias("end"))), F.collect_set(F.transform("known", lambda k: k["item"]))
    found = held.groupBy("digest", "n_words").agg(spans.alias("spans"), names.alias("names"))
    return kept(found.select("digest", "n_words", _merged("spans").alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten("names"))).alias("items")), "verdicts")


def _merged(spans: str) -> Column:
    """Ranges that overlap or touch as one, in order."""
    ordered = F.array_sort(spans)
    none = F.array().cast("array<struct<start:int,end:int>>")
    begin = F.struct(none.alias("done"), F.get(ordered, F.lit(0)).alias("now"))

    def step(a: Column, s: Column) -> Column:
        apart = s["start"] > a["now"]["end"]
        grown = F.struct(a["now"]["start"].alias("start"), F.greatest(a["now"]["end"], s["end"]).alias("end"))
        return F.struct(F.when(apart, F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]).alias("done"), F.when(apart, s).otherwise(grown).alias("now"))

    return F.aggregate(ordered, begin, step, lambda a: F.concat(a["done"], F.array(a["now"])))


def n_hit(spans: Column | str) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))


def contaminated(hit: Column, n_words: Column) -> Column:
    return (hit > 0) & (20 * hit >= n_words)


def contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", keep_text: bool = True, **options) -> DataFrame:
    """The documents' rows with n_words, hit_spans (word ranges, end exclusive, apart and in order), items
    (names sorted as strings), n_hit, n_items and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    docs = docs.drop(*ADDED)
    found = verdicts(docs, benchmark, text_col=text_col, **options)
    text = docs[text_col].cast("string")
    stay = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(*(docs[c] for c in stay)).alias("_doc"), text.alias("_text"), digest_of(text).alias("digest"))
    schema = T.StructType([rows.schema["_doc"], rows.schema["digest"], T.StructField("_n", T.LongType())])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "_text"):
                yield pa.RecordBatch.from_arrays([batch.column("_doc"), batch.column("digest"), pa.array(n_tokens(*column_bytes(batch.column("_text")), ALNUM), pa.int64())], names=schema.names)

    out = _with_verdicts(rows.mapInArrow(lean(counted), schema), found)
    spans = F.coalesce("hit_spans", F.array().cast("array<struct<start:int,end:int>>"))
    out = out.select("_doc.*", F.col("_n").alias("n_words"), spans.alias("hit_spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    out = out.withColumn("n_hit", n_hit("hit_spans")).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", contaminated(F.col("n_hit"), F.col("n_words")))


def _with_verdicts(rows: DataFrame, found: DataFrame, *, few: int = 100_000, few_cells: int = 2_000_000) -> DataFrame:
    """Rows with the verdicts on their digests, if any: broadcast up to `few` texts and `few_cells` spans and items, which
    are counted, or else by a shuffle in which texts with many copies are salted."""
    found = found.select("digest", "hit_spans", "items")
    size = found.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("hit_spans") + F.size("items")), F.lit(0)).alias("cells")).first()
    if size["n"] <= few and size["cells"] <= few_cells:
        return rows.join(F.broadcast(found), "digest", "left")
    rows = kept(rows.withColumn("_spread", F.xxhash64("_doc")), "counted-rows")
    return salted_join(rows, found, "digest", "_spread", rows.groupBy("digest").agg(F.count("*").alias("n")), rows.count(), "left")


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", few: int = 1_000_000, **options) -> DataFrame:
    """The documents that aren't contaminated, all their columns as they are. Only the digests of texts to drop are
    joined: broadcast up to `few` (16 bytes each), which are counted."""
    found = verdicts(docs, benchmark, text_col=text_col, **options).where(contaminated(n_hit("hit_spans"), F.col("n_words"))).select(F.col("digest").alias("_bad"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), digest_of(docs[text_col].cast("string")).alias("_digest"))
    found = F.broadcast(found) if found.limit(few + 1).count() <= few else found
    return rows.join(found, F.col("_digest") == F.col("_bad"), "left_anti").select("_doc.*")
