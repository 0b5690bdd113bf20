"""A quality classifier: perplexity under an interpolated modified Kneser-Ney model (Chen and Goodman, 1999).

One model a language, over characters: n-grams of `ORDER` characters, texts padded in front. A character has 12
bits: the `ALPHABET` most frequent characters of a language's training text have a number each (counted over all of it), all
others share one, 0 pads. An n-gram with a character that training never saw has no counts whichever character it is, so nothing is
lost in a language of up to 4,094 characters; in one of more, its rarest share a number. So an n-gram is one 64-bit number, its context that number shifted,
its suffix that number masked. The model is trained on trusted text: documents that `labels` call good and not toxic.
Every fifth of them, by hash, is held out; a language's threshold is a quantile of the perplexities of its held-out
documents, and documents above it are rejected.

A mean over a document hardly sees a few insults in clean prose. So a second model a language is trained on documents that
`labels` call toxic (but every fifth, held out to measure), and a document's contrast is the largest sum, over all its
spans, of log2 of the toxic by the trusted probability of each character. It has its own threshold, the same quantile of the
held-out trusted documents, and documents above either threshold are rejected.

Counts are summed map-side by blocks, then by shards of n-grams. All documents' distinct n-grams are gathered in shards and joined
with the count tables: p(gram) = discounted count of the gram + backoff weight of its context times p(suffix). The lower
orders, of which there are far fewer n-grams, are joined one by one by gram, context and suffix. The highest is
sharded by the characters between the first and the last, which a gram, its context and its suffix have in common, so
that one join of shards has all three. Their scores, in the n-grams' order and with 16 significant bits, go back to the blocks
of documents, which find their n-grams anew from the texts and sum each document's log probabilities. No table of n-grams goes to the driver, and none is broadcast.

Trusted and toxic ids are broadcast while there are at most `few_ids` (8 bytes each), and joined by a shuffle beyond.
A language without held-out documents has no thresholds: its documents are kept (perplexity is null without a model, the
contrast without both).
A null language is one of its own. Null and empty texts have no perplexity and are rejected. Repeated rows
are judged each for itself; an id with several labels is trusted if all of them are good, and toxic if one is. Columns named like the
results are replaced. Empty tables give empty results; without labels everything but empty texts is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks, checksum, packed, released, squeezed, unpacked
from .bytetext import LEADS, column_bytes, slices
from .common import forget, kept, lean, lean_cogroup, lean_group, settled, small_batches, text_column

ORDER, BITS = 5, 12
ALPHABET = (1 << BITS) - 2
QUANTILE = 0.995
FEW_IDS = 2_000_000
ADDED = T.StructType().add("n_scored", "long").add("log2_prob", "double").add("toxic_contrast", "double").add("perplexity", "double").add("threshold", "double").add("toxic_threshold", "double").add("kept", "boolean")
#: Before the language of a toxic model.
TOXIC = "\0toxic\0"


def _toxic(lang: str | None) -> str:
    """The key of a language's toxic model."""
    return TOXIC + (TOXIC if lang is None else lang)


def _toxic_column(lang: Column) -> Column:
    """As _toxic."""
    return F.concat(F.lit(TOXIC), F.coalesce(lang, F.lit(TOXIC)))


def _language(key: str | None) -> str | None:
    """The language of a model's key."""
    if key is None or not key.startswith(TOXIC):
        return key
    rest = key[len(TOXIC) :]
    return None if rest == TOXIC else rest


def codes_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Code points, row after row, and the rows' offsets in them."""
    data, offsets = column_bytes(column)
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum(LEADS[data], dtype=np.int64)])[offsets]
    if len(codes) != starts[-1]:  # not UTF-8 throughout: row by row
        rows = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        codes = np.frombuffer("".join(rows).encode("utf-32-le"), np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return codes, starts


class Alphabets:
    """Each language's known characters. A table of all code points is made when a language is met; a few are kept."""

    def __init__(self, known: dict[str | None, np.ndarray]):
        self.known, self.tables = known, {}

    def __getstate__(self):
        return self.known

    def __setstate__(self, known):
        self.__init__(known)

    def table(self, key: str | None) -> np.ndarray:
        lang = _language(key)
        if lang not in self.tables:
            if len(self.tables) > 3:
                self.tables.pop(next(iter(self.tables)))
            table = np.ones(0x110000, np.int16)
            chars = self.known.get(lang, np.empty(0, np.int64))
            table[chars] = np.arange(2, len(chars) + 2)
            self.tables[lang] = table
        return self.tables[lang]


def alphabets(docs: DataFrame, *, text_col: str, lang_col: str, most: int = ALPHABET) -> Alphabets:
    """The most frequent characters of each language, of equals the least. At most `most` numbers a language come to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col):
                langs = np.array([repr(_language(x)) for x in batch.column(lang_col).to_pylist()], object)
                for lang in dict.fromkeys(langs.tolist()):
                    codes, _ = codes_of(batch.column(text_col).filter(pa.array(langs == lang)))
                    many = np.bincount(codes)
                    chars = np.flatnonzero(many)
                    name = next(x for x, y in zip(batch.column(lang_col).to_pylist(), langs, strict=True) if y == lang)
                    yield pa.RecordBatch.from_arrays([pa.array([_language(name)] * len(chars), pa.string()), pa.array(chars.astype(np.int32)), pa.array(many[chars])], names=["lang", "char", "n"])

    found = docs.select(F.col(lang_col).cast("string").alias(lang_col), text_col).mapInArrow(lean(work), "lang string, char int, n long")
    by = Window.partitionBy("lang").orderBy(F.desc("n"), "char")  # a language has no more characters than there are code points
    rows = found.groupBy("lang", "char").agg(F.sum("n").alias("n")).withColumn("k", F.row_number().over(by)).where(F.col("k") <= most)
    rows = rows.groupBy("lang").agg(F.array_sort(F.collect_list("char")).alias("chars")).collect()
    return Alphabets({r["lang"]: np.array(r["chars"], np.int64) for r in rows})


def grams_of(column: pa.Array | pa.ChunkedArray, table: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Each character's n-gram, row after row, and the rows' offsets in them; `table` has each code point's number."""
    codes, starts = codes_of(column)
    codes = table[codes].astype(np.int64)
    local = np.arange(len(codes)) - np.repeat(starts[:-1], np.diff(starts))
    out = codes.copy()
    for j in range(1, order):
        out[j:] |= np.where(local[j:] >= j, codes[:-j], 0) << (BITS * j)
    return out, starts


def _indexed(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams by a hash table, and each n-gram's place among them."""
    found = pc.dictionary_encode(pa.array(grams))
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _pressed(grams: np.ndarray, order: int) -> bytes:
    """Sorted n-grams, compressed character by character and byte by byte; of the first character, the steps."""
    chars = ((grams[None, :] >> (BITS * np.arange(order - 1, -1, -1))[:, None]) & ((1 << BITS) - 1)).astype("<u2")
    chars[0] = np.diff(chars[0], prepend=chars[0][:0].dtype.type(0))
    return squeezed(chars.view(np.uint8).reshape(order, -1, 2).transpose(0, 2, 1))


def _opened(data: bytes, order: int) -> np.ndarray:
    """What _pressed was given."""
    planes = released(data, np.uint8).reshape(order, 2, -1)
    chars = np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u2")[..., 0].astype(np.int64)
    chars[0] = np.cumsum(chars[0])
    return (chars << (BITS * np.arange(order - 1, -1, -1))[:, None]).sum(axis=0)


def _pressed_logs(logs: np.ndarray) -> bytes:
    """Floats rounded to 16 significant bits, compressed byte by byte."""
    bits = (logs.astype("<f4").view("<u4") + np.uint32(0x80)) & np.uint32(0xFFFFFF00)
    return squeezed(bits.view(np.uint8).reshape(-1, 4).T[1:])


def _opened_logs(data: bytes) -> np.ndarray:
    planes = released(data, np.uint8).reshape(3, -1)
    out = np.zeros((planes.shape[1], 4), np.uint8)
    out[:, 1:] = planes.T
    return out.view("<f4")[:, 0]


def _by_language(table: pa.Table, text_col: str, lang_col: str, order: int, books: Alphabets, step: int = 2_000_000) -> Iterator[tuple[str | None, list[np.ndarray]]]:
    """Each language's n-grams, in arrays of bounded size (but for a single long text)."""
    langs = table.column(lang_col).to_pylist()
    for lang in dict.fromkeys(langs):
        mine = table.filter(pa.array([x == lang for x in langs])).column(text_col).combine_chunks()
        _, offsets = column_bytes(mine)
        first, out = 0, []
        while first < len(mine):
            last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1)
            out.append(grams_of(mine.slice(first, last - first), books.table(lang), order)[0])
            first = last
        yield lang, out


def gram_counts(docs: DataFrame, books: Alphabets, *, text_col: str, lang_col: str, order: int, n_shards: int | None = None) -> DataFrame:
    """lang, gram and count over all the documents given; summed by block, then by shard of n-grams, more of them for a larger input."""
    n_shards, inner = n_shards or _n_shards(docs), (1 << (BITS * max(0, order - 2))) - 1

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in blocks(batches, text_col):
            for lang, parts in _by_language(table, text_col, lang_col, order, books):
                grams, many = _counted([(distinct, np.bincount(at, minlength=len(distinct))) for distinct, at in map(_indexed, parts)])
                shard = _shard((grams >> BITS) & inner, n_shards)
                for s in np.unique(shard):
                    at = shard == s
                    planes = many[at].astype("<u4").view(np.uint8).reshape(-1, 4).T
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((int(s), pa.int32()), (lang, pa.string()), (_pressed(grams[at], order), pa.binary()), (squeezed(planes), pa.binary()))], names=["shard", "lang", "grams", "counts"])

    def total(key, table):
        by: dict[str | None, list] = {}
        for lang, data, counts in zip(table.column("lang").to_pylist(), table.column("grams").to_pylist(), table.column("counts").to_pylist(), strict=True):
            many = np.ascontiguousarray(released(counts, np.uint8).reshape(4, -1).T).view("<u4")[:, 0]
            by.setdefault(lang, []).append((_opened(data, order), many))
        out = []
        for lang, parts in by.items():
            grams, many = _counted(parts)
            out.append(pa.table({"lang": pa.array([lang] * len(grams), pa.string()), "gram": grams, "n": many}))
        return pa.concat_tables(out)

    found = docs.select(F.col(lang_col).cast("string").alias(lang_col), text_col).mapInArrow(lean(work), "shard int, lang string, grams binary, counts binary")
    return found.groupBy("shard").applyInArrow(lean_group(total), "lang string, gram long, n long")


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-grams of all parts, sorted, and the sums of their counts."""
    grams, back = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return grams, np.bincount(back, weights=np.concatenate([x[1] for x in parts]), minlength=len(grams)).astype(np.int64)


def _mask(k: int) -> Column:
    return F.lit((1 << (BITS * k)) - 1).cast("long")


def model(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """Counts of every order: k, lang, gram, n. Below the highest order n is a continuation count: how many different
    characters stand before the gram."""
    level, out = counts, None
    for k in range(order, 0, -1):
        here = level.select(F.lit(k).alias("k"), "lang", "gram", "n")
        out = here if out is None else out.unionByName(here)
        level = level.groupBy("lang", F.col("gram").bitwiseAND(_mask(k - 1)).alias("gram")).agg(F.count("*").alias("n"))
    return out


def discounts(levels: DataFrame) -> DataFrame:
    """k, lang and the three discounts, from how many grams have counts of 1 to 4."""
    met = levels.groupBy("k", "lang").agg(*(F.sum((F.col("n") == i).cast("double")).alias(f"n{i}") for i in (1, 2, 3, 4)))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    d = lambda i: F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(0.5 * i)).alias(f"d{i}")
    return met.select("k", "lang", d(1), d(2), d(3))


def probabilities(grams: DataFrame, levels: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, gram and p, its last character's probability after the others, for the distinct grams given; a table.

    Each order is written before the next one is joined with it: a plan of all of them is drawn anew and kept as text by
    the driver whenever one of its stages ends, which took more of its heap than all else."""
    known = discounts(levels).withColumnRenamed("lang", "_lang")
    least = last = None
    for k in range(1, order + 1):
        here = levels.where(F.col("k") == k).select("lang", "gram", "n")
        d = F.broadcast(known.where(F.col("k") == k).drop("k"))  # a row for each language
        here = here.join(d, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")
        context = F.shiftright("gram", BITS).alias("context")
        weights = here.groupBy("lang", context).agg(
            F.sum("n").alias("total"),
            (F.sum(F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))) / F.sum("n")).alias("backoff"),
        )
        cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        seen = here.select("lang", "gram", (F.col("n") - cut).alias("above"))
        wanted = grams.select("lang", F.col("gram").bitwiseAND(_mask(k)).alias("gram")).distinct() if k < order else grams
        wanted = _left(wanted, seen, ["lang", "gram"]).withColumn("context", context)
        wanted = _left(wanted, weights, ["lang", "context"])
        if least is None:
            lower = F.lit(2.0**-BITS)
        else:
            wanted = _left(wanted.withColumn("suffix", F.col("gram").bitwiseAND(_mask(k - 1))), least, ["lang", "suffix"])
            lower = F.col("lower")
        p = F.when(F.col("total") > 0, F.coalesce("above", F.lit(0.0)) / F.col("total") + F.col("backoff") * lower).otherwise(lower)
        wanted = kept(wanted.select("lang", "gram", p.alias("p")), "gram-probabilities")
        if last is not None:
            forget(last)
        last = wanted
        least = wanted.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("lower"))
    return wanted


def _left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join on keys that may be null."""
    right = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in keys]
    return left.join(right, on[0] & on[1], "left").drop(*(f"_r_{c}" for c in keys))


def scored(docs: DataFrame, levels: DataFrame, books: Alphabets, *, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, keep_text: bool = False, n_shards: int | None = None) -> DataFrame:
    """The documents with n_scored (characters), log2_prob, their sum (null for none, or without a model), and toxic_contrast."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = settled(docs.drop("n_scored", "log2_prob", "toxic_contrast"))
    stay = [c for c in docs.columns if keep_text or c not in (text_col, lang_col)]
    use = docs.select(F.struct(*(docs[c] for c in stay)).alias("_doc"), text_column(docs, text_col).alias("_text"), docs[lang_col].cast("string").alias("_lang"))
    n_shards = n_shards or _n_shards(docs)

    inner, suffix_mask = (1 << (BITS * (order - 2))) - 1, (1 << (BITS * (order - 1))) - 1

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches, "_text"):
            check = checksum(table, "_text")
            for lang, parts in _by_language(table, "_text", "_lang", order, books):
                grams = np.unique(np.concatenate([_indexed(p)[0] for p in parts]))
                shard = _shard((grams >> BITS) & inner, n_shards)
                for s in np.unique(shard):
                    mine = grams[shard == s]
                    yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((int(s), pa.int32()), (block, pa.int64()), (check, pa.int64()), (lang, pa.string()), (_pressed(mine, order), pa.binary()))], names=["shard", "block", "check", "lang", "grams"])

    def suffixes(key, table):
        out: dict[str | None, np.ndarray] = {}
        for lang, data in zip(table.column("lang").to_pylist(), table.column("grams").to_pylist(), strict=True):
            mine = np.unique(_opened(data, order) & suffix_mask)
            out[lang] = np.union1d(out[lang], mine) if lang in out else mine
        out |= {_toxic(k): v for k, v in out.items()}  # languages without a model go below
        langs = pa.concat_arrays([pa.array([k] * len(v), pa.string()) for k, v in out.items()])
        return pa.table({"lang": langs, "gram": pa.array(np.concatenate([*out.values()]), pa.int64())})

    lists = kept(use.select("_text", "_lang").mapInArrow(lean(distinct), "shard int, block long, check long, lang string, grams binary"), "grams-by-block")
    languages = levels.where(F.col("k") == 1).select(F.col("lang").alias("_known")).distinct()
    lower = lists.groupBy("shard").applyInArrow(lean_group(suffixes), "lang string, gram long")
    lower = lower.join(F.broadcast(languages), F.col("lang").eqNullSafe(F.col("_known")), "left_semi")  # a row for each language
    suffix_table = kept(lower, "suffixes")
    lower = probabilities(suffix_table, levels, order - 1)
    forget(suffix_table)
    known = discounts(levels).where(F.col("k") == order).drop("k").withColumnRenamed("lang", "_of")
    top = levels.where(F.col("k") == order).join(F.broadcast(known), F.col("lang").eqNullSafe(F.col("_of")))
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    middle = F.shiftright("gram", BITS)
    tables = top.select(_shard_column(middle.bitwiseAND(F.lit(inner)), n_shards).alias("shard"), "lang", "gram", F.col("n").cast("double").alias("n"), cut.alias("cut"))
    tables = tables.unionByName(lower.select(_shard_column(middle, n_shards).alias("shard"), "lang", "gram", F.col("p").alias("n"), F.lit(None).cast("double").alias("cut")))

    def back(key, left, right):
        langs = np.array([repr(x) for x in right.column("lang").to_pylist()], object)
        grams, values, cuts = (right.column(c).to_numpy(zero_copy_only=False) for c in ("gram", "n", "cut"))
        joined = {lang: _Joined(*(x[langs == lang] for x in (grams, values, cuts)), suffix_mask) for lang in dict.fromkeys(langs.tolist())}
        cells = []
        for row, (lang, data) in enumerate(zip(left.column("lang").to_pylist(), left.column("grams").to_pylist(), strict=True)):
            if (found := joined.get(repr(lang))) is not None:
                grams = _opened(data, order)
                logs, toxic = found(grams), joined.get(repr(_toxic(lang)))
                cells.append((row, _pressed_logs(logs), toxic and _pressed_logs(toxic(grams) - logs)))
        at = pa.array([c[0] for c in cells], pa.int64())
        return left.select(["block", "check", "lang", "shard"]).take(at).append_column("logs", pa.array([c[1] for c in cells], pa.binary())).append_column("ratios", pa.array([c[2] for c in cells], pa.binary()))

    lined = lists.groupBy("shard").cogroup(tables.groupBy("shard")).applyInArrow(lean_cogroup(back), "block long, check long, lang string, shard int, logs binary, ratios binary")

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches, "_text"):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([packed(table, small=True)], pa.binary())], names=["block", "rows"])

    def summed(key, left, right):
        known: dict[str | None, dict[int, tuple[bytes, bytes | None]]] = {}
        for lang, shard, *logs in zip(*(left.column(c).to_pylist() for c in ("lang", "shard", "logs", "ratios")), strict=True):
            known.setdefault(lang, {})[shard] = (*logs,)
        out = []
        for data in right.column("rows").to_pylist():
            table = unpacked(data, small=True)
            if left.num_rows and {checksum(table, "_text")} != {*left.column("check").to_pylist()}:
                raise ValueError(f"block {key} was read twice with different texts")
            langs = table.column("_lang").to_pylist()
            for lang in dict.fromkeys(langs):
                mine = table.filter(pa.array([x == lang for x in langs])).combine_chunks()
                out += _summed(mine, known.get(lang), books.table(lang), order, n_shards, inner)
        out = pa.concat_tables(out)
        return pa.table([*out.column("_doc").combine_chunks().flatten(), out.column("n"), out.column("log"), out.column("contrast")], names=[*stay, "n_scored", "log2_prob", "toxic_contrast"])

    schema = T.StructType([*(docs.schema[c] for c in stay), *ADDED.fields[:3]])
    return lined.groupBy("block").cogroup(use.mapInArrow(lean(ship), "block long, rows binary").groupBy("block")).applyInArrow(lean_cogroup(summed), schema)


def _summed(table: pa.Table, known: dict[int, tuple[bytes, bytes | None]] | None, book: np.ndarray, order: int, n_shards: int, inner: int, step: int = 2_000_000) -> list[pa.Table]:
    """One language's documents of a block with the sums of their n-grams' logs, and their contrast; known: each shard's logs and ratios."""
    column, pieces, first = table.column("_text").combine_chunks(), [], 0
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    _, offsets = column_bytes(column)
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + step, "right")) - 1)
        grams, starts = grams_of(column.slice(first, last - first), book, order)
        pieces.append((first, last, starts, *_indexed(grams)))
        first = last
    if known:
        grams = np.unique(np.concatenate([x[3] for x in pieces]))
        shard, logs, met = _shard((grams >> BITS) & inner, n_shards), np.empty(len(grams)), 0
        ratios = None if any(x[1] is None for x in known.values()) else np.empty(len(grams))
        for s, data in known.items():
            at = np.flatnonzero(shard == s)
            logs[at] = _opened_logs(data[0])
            if ratios is not None:
                ratios[at] = _opened_logs(data[1])
            met += len(at)
        if met != len(grams):
            raise ValueError("n-grams of a block have no score")
    out = []
    for first, last, starts, distinct, at in pieces:
        log = contrast = pa.nulls(last - first, pa.float64())
        if known and len(at):
            place, none = np.searchsorted(grams, distinct), starts[1:] == starts[:-1]
            total = np.concatenate([[0.0], np.cumsum(logs[place][at])])
            log = pa.array(total[starts[1:]] - total[starts[:-1]], pa.float64(), mask=none)
            if ratios is not None:
                contrast = pa.array(_contrasts(ratios[place][at], starts), pa.float64(), mask=none)
        part = table.slice(first, last - first).select(["_doc"])
        out.append(part.append_column("n", pa.array(np.diff(starts), pa.int64())).append_column("log", log).append_column("contrast", contrast))
    return out


def _contrasts(ratios: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each row the largest sum of a span of its ratios, 0 at least."""
    out = np.zeros(len(starts) - 1)
    for i, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        total = np.concatenate([[0.0], np.cumsum(ratios[a:b])])
        out[i] = (total - np.minimum.accumulate(total)).max()
    return out


class _Joined:
    """One shard and language: counts of the highest order, and the probabilities of the suffixes."""

    def __init__(self, grams: np.ndarray, values: np.ndarray, cuts: np.ndarray, suffix_mask: int):
        self.mask = suffix_mask
        top = np.flatnonzero(~np.isnan(cuts))
        top = top[np.argsort(grams[top])]
        self.grams, self.above = grams[top], values[top] - cuts[top]
        self.contexts, first = np.unique(self.grams >> BITS, return_index=True)
        self.totals = np.add.reduceat(values[top], first) if len(top) else values[:0]
        self.backoffs = np.add.reduceat(cuts[top], first) / self.totals if len(top) else values[:0]
        low = np.flatnonzero(np.isnan(cuts))
        low = low[np.argsort(grams[low])]
        self.suffixes, self.lower = grams[low], values[low]

    @staticmethod
    def _find(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(keys, values), max(0, len(keys) - 1))
        return at, keys[at] == values if len(keys) else np.zeros(len(values), bool)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at, there = self._find(self.suffixes, grams & self.mask)
        if not there.all():
            raise ValueError("a suffix has no probability")
        out = self.lower[at]
        context, known = self._find(self.contexts, grams >> BITS)
        at, seen = self._find(self.grams, grams)
        if len(self.grams):
            above = np.where(seen, self.above[at], 0.0)
            out = np.where(known, above / self.totals[context] + self.backoffs[context] * out, out)
        return np.log2(out)


def _n_shards(docs: DataFrame) -> int:
    return max(12, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions() // 4)


def _shard(middles: np.ndarray, n_shards: int) -> np.ndarray:
    return (middles ^ (middles >> 24)) % 1_000_003 % n_shards


def _shard_column(middle: Column, n_shards: int) -> Column:
    """As _shard."""
    return (middle.bitwiseXOR(F.shiftright(middle, 24)) % 1_000_003 % n_shards).cast("int")


def classified(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER, quantile: float = QUANTILE, few_ids: int = FEW_IDS, keep_text: bool = False) -> DataFrame:
    """The documents with n_scored, log2_prob, toxic_contrast, perplexity (of a character), their thresholds and kept."""
    small_batches(docs.sparkSession)
    docs = docs.drop(*ADDED.names)
    good = labels.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("_q"), F.max(F.coalesce("toxic", F.lit(0))).alias("_t"))
    good = good.where("_id is not null and (_q = 1 and _t = 0 or _t = 1)").select("_id", (F.col("_t") == 1).alias("_bad"), F.pmod(F.xxhash64("_id"), F.lit(5)).alias("_fold"))
    good = kept(good, "trusted-ids")  # read as it is: a shuffle in its plan would have the texts written anew
    if good.limit(few_ids + 1).count() <= few_ids:
        good = F.broadcast(good)
    columns = docs.columns
    rows = docs.select(F.struct(*(docs[c] for c in columns)).alias("_row"), docs[id_col].alias("_key")).join(good, F.col("_key") == F.col("_id"), "left")
    lang = F.col("_row")[lang_col].cast("string")
    train = rows.where(F.col("_fold") != 0).select(text_column_of(text_col).alias("text"), F.when(F.col("_bad"), _toxic_column(lang)).otherwise(lang).alias("lang"))
    books = alphabets(train, text_col="text", lang_col="lang")
    counts = kept(gram_counts(train, books, text_col="text", lang_col="lang", order=order), "gram-counts")
    lower = kept(model(counts, order).where(F.col("k") < order), "gram-levels")
    levels = counts.select(F.lit(order).alias("k"), "lang", "gram", "n").unionByName(lower)
    stay = [c for c in columns if keep_text or c != text_col]
    flat = rows.select(F.struct(*(F.col("_row")[c].alias(c) for c in stay)).alias("_stay"), lang.alias("_l"), ((F.col("_fold") == 0) & ~F.col("_bad")).alias("_held"), text_column_of(text_col).alias("_t"), lang.alias("_lang_of"))
    flat = kept(scored(flat, levels, books, text_col="_t", lang_col="_lang_of", order=order), "document-scores")
    perplexity = F.when(F.col("n_scored") > 0, F.pow(F.lit(2.0), -F.col("log2_prob") / F.col("n_scored")))
    flat = flat.withColumn("_p", perplexity)
    limits = flat.where("_held and _p is not null").groupBy(F.col("_l").alias("_of")).agg(F.percentile_approx("_p", quantile, 10_000).alias("_limit"), F.percentile_approx("toxic_contrast", quantile, 10_000).alias("_most"))
    out = flat.join(F.broadcast(limits), F.col("_l").eqNullSafe(F.col("_of")), "left")  # a row for each language
    keep = (F.col("n_scored") > 0) & F.coalesce(F.col("_p") <= F.col("_limit"), F.lit(True)) & F.coalesce(F.col("toxic_contrast") <= F.col("_most"), F.lit(True))
    return out.select("_stay.*", "n_scored", "log2_prob", "toxic_contrast", F.col("_p").alias("perplexity"), F.col("_limit").alias("threshold"), F.col("_most").alias("toxic_threshold"), keep.alias("kept"))


def text_column_of(name: str) -> Column:
    return F.coalesce(F.col("_row")[name].cast("string"), F.lit(""))
