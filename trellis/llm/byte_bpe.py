"""Byte-level BPE, encoding each distinct word of a corpus once.

Texts are cut into words by the tokenizer's pattern. In each block of documents the words are numbered, and the
block's text becomes the list of those numbers: a word's positions. Each block sends its distinct words to
shards by hash; a shard joins the lists of all blocks, encodes each distinct word once, and sends the blocks their ids
back. There the words' places are filled with ids. Decoding joins ids with the table of the tokens' bytes, which has one
row for each token of the vocabulary, in the order of ids.

What travels is each block's distinct words once each way and the positions once, compressed. A word that is in every
text reaches a shard once for each block, not for each use. A shard takes about `shard_blocks` blocks' share of words;
their number grows with the number of input partitions.

A null text is the empty one and has no tokens. Special tokens are ordinary text. Repeated rows are encoded each
for itself. An empty table gives no rows. Columns named like the results are replaced.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import blocks, checksum, packed, released, squeezed, unpacked
from .common import lean, lean_cogroup, settled, small_batches

ADDED = T.StructType().add("token_ids", T.ArrayType(T.IntegerType())).add("decoded", "binary")
_WORDS = "shard int, block long, check long, words binary"
_FILLED = "block long, shard int, check long, ids binary, lengths binary"
_PLACES = "block long, check long, rows binary, places binary, counts binary"


@functools.lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[bytes, ...]:
    """The bytes of each token, by id."""
    with open(path, "rb") as f:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    assert sorted(ranks) == [*range(len(ranks))], "ids without gaps"
    return tuple(ranks[i] for i in range(len(ranks)))


@functools.lru_cache(maxsize=4)
def encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks={b: i for i, b in enumerate(token_bytes(path))}, special_tokens={})


@functools.lru_cache(maxsize=4)
def _token_table(path: str) -> tuple[np.ndarray, np.ndarray]:
    tokens = token_bytes(path)
    ends = np.cumsum([0, *map(len, tokens)])
    return np.frombuffer(b"".join(tokens), np.uint8), ends


class Numbered:
    """A block's words, each distinct one numbered, in the order of (shard, first use)."""

    def __init__(self, table: pa.Table, text_col: str, pattern: str, n_shards: int):
        split = regex.compile(pattern).findall
        numbers: dict[str, int] = {}
        number = numbers.setdefault
        self.counts, places = [], []
        for chunk in table.column(text_col).chunks:
            for text in chunk:
                text = text.as_py()
                found = [number(w, len(numbers)) for w in split(text)] if text else []
                self.counts.append(len(found))
                places.append(np.array(found, np.int32))
        self.places = np.concatenate(places) if places else np.empty(0, np.int32)
        self.words = [w.encode() for w in numbers]
        self.shards = np.array([xxhash.xxh32_intdigest(w) for w in self.words], np.int64) % n_shards
        self.order = np.argsort(self.shards, kind="stable")


def _list_table(rows: list[bytes]) -> bytes:
    return packed(pa.table({"w": pa.array(rows, pa.large_binary())}))


def gathered(values: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists `which` of a list of lists, joined, and their lengths."""
    many = (ends[1:] - ends[:-1])[which]
    total = int(many.sum())
    at = np.arange(total) + np.repeat(ends[which] - (np.cumsum(many) - many), many)
    return values[at], many


def decoded_bytes(path: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids joined with the token table: all bytes, and each id's number of them."""
    values, ends = _token_table(path)
    return gathered(values, ends, ids)


def encode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", n_shards: int | None = None, shard_blocks: int = 4, keep_text: bool = False) -> DataFrame:
    """The documents (without the text, unless it is to stay) with token_ids, and decoded: the bytes that those ids stand for."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = settled(docs.drop(*ADDED.names))
    stay = [c for c in docs.columns if keep_text or c != text_col]
    n_shards = n_shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions() // shard_blocks)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches, text_col):
            found = Numbered(table, text_col, pattern, n_shards)
            cuts = np.searchsorted(found.shards[found.order], np.arange(n_shards + 1))
            full = np.flatnonzero(cuts[1:] > cuts[:-1])
            lists = [[found.words[i] for i in found.order[cuts[s] : cuts[s + 1]]] for s in full]
            same = lambda x: pa.array([x] * len(full), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), same(block), same(checksum(table, text_col)), pa.array(map(_list_table, lists), pa.binary())], names=["shard", "block", "check", "words"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[int, ...]] = {}
        tool, shard = encoding(path, pattern), None
        for batch in batches:
            for row in range(batch.num_rows):
                if (now := batch.column("shard")[row].as_py()) != shard:  # rows come sorted by shard
                    known, shard = {}, now
                ids: list[int] = []
                lengths = []
                for w in unpacked(batch.column("words")[row].as_py()).column("w").to_pylist():
                    if (found := known.get(w)) is None:
                        found = known[w] = tuple(tool.encode_ordinary(w.decode()))
                    ids.extend(found)
                    lengths.append(len(found))
                yield pa.RecordBatch.from_arrays([batch.column("block").slice(row, 1), pa.array([shard], pa.int32()), batch.column("check").slice(row, 1), pa.array([squeezed(np.array(ids, np.int32))], pa.binary()), pa.array([squeezed(np.array(lengths, np.int32))], pa.binary())], names=["block", "shard", "check", "ids", "lengths"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in blocks(batches, text_col):
            found = Numbered(table, text_col, pattern, n_shards)
            back = np.empty(len(found.order), np.int32)
            back[found.order] = np.arange(len(back), dtype=np.int32)
            cells = [[block], [checksum(table, text_col)], [packed(table.select(stay))], [squeezed(back[found.places])], [squeezed(np.array(found.counts, np.int32))]]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds, strict=True)], names=["block", "check", "rows", "places", "counts"])

    def put_together(key, left, right):
        out = []
        parts = {s: (i, n) for s, i, n in zip(left.column("shard").to_pylist(), left.column("ids").to_pylist(), left.column("lengths").to_pylist(), strict=True)}
        lengths = [released(parts[s][1], np.int32) for s in sorted(parts)]
        values = [released(parts[s][0], np.int32) for s in sorted(parts)]
        values, lengths = np.concatenate([np.empty(0, np.int32), *values]), np.concatenate([np.empty(0, np.int32), *lengths])
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        for row in range(right.num_rows):
            counts, at = (released(right.column(c)[row].as_py(), np.int32) for c in ("counts", "places"))
            if {right.column("check")[row].as_py()} != {*left.column("check").to_pylist()} and len(at):
                raise ValueError(f"block {key} was read twice with different texts")
            kept = unpacked(right.column("rows")[row].as_py())
            first = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
            step = 500_000
            a = 0
            while a < len(counts):  # some rows at a time: ids and bytes take more room than places
                b = max(a + 1, int(np.searchsorted(first, first[a] + step, "right")) - 1)
                ids, many = gathered(values, ends, at[first[a] : first[b]])
                data, sizes = decoded_bytes(path, ids)
                id_ends = np.concatenate([[0], np.cumsum(many)])[first[a : b + 1] - first[a]]
                byte_ends = np.concatenate([[0], np.cumsum(sizes)])[id_ends]
                id_list = pa.ListArray.from_arrays(pa.array(id_ends, pa.int32()), pa.array(ids, pa.int32()))
                blob = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(byte_ends.astype(np.int32)), pa.py_buffer(data)])
                part = kept.slice(a, b - a)
                out.append(pa.table([*part.columns, id_list, blob], names=[*stay, *ADDED.names]))
                a = b
        return pa.concat_tables(out) if out else schema_table

    schema = T.StructType([*(docs.schema[c] for c in stay), *ADDED.fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    schema_table = to_arrow_schema(schema).empty_table()
    sharded = docs.select(text_col).mapInArrow(lean(words), _WORDS)
    filled = sharded.repartition(n_shards, "shard").sortWithinPartitions("shard").mapInArrow(lean(fill), _FILLED)
    placed = docs.select(*stay, *([] if keep_text else [text_col])).mapInArrow(lean(places), _PLACES)
    return filled.groupBy("block").cogroup(placed.groupBy("block")).applyInArrow(lean_cogroup(put_together), schema)


def decode(encoded: DataFrame, path: str, *, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the bytes that their ids stand for: ids joined with the token table. A null list gives null; an
    id outside the vocabulary fails the query."""
    encoded = encoded.drop(out_col)
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_tokens = len(token_bytes(path))
        for batch in batches:
            lists = batch.column(ids_col)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(flat) and not (0 <= flat.min() and flat.max() < n_tokens):
                raise ValueError("an id is outside the vocabulary")
            data, sizes = decoded_bytes(path, flat)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            many = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            at = ends[np.concatenate([[0], np.cumsum(many)])].astype(np.int32)
            blob = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at), pa.py_buffer(data)])
            blob = pa.array([b if x.is_valid else None for b, x in zip(blob.to_pylist(), lists, strict=True)], pa.binary()) if lists.null_count else blob
            yield pa.RecordBatch.from_arrays([*batch.columns, blob], names=[*batch.schema.names, out_col])

    return encoded.mapInArrow(work, schema)


def digests(encoded: DataFrame, *, id_col: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (decimal, joined by commas) and of the decoded bytes; the ids if they are to stay."""
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary")
    return encoded.select(id_col, F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), *(["token_ids"] if keep_ids else []))
