"""Near duplicates of word multisets by BagMinHash (Ertl, 2018).

A text is the multiset of its runs of `SHINGLE` words, parted by white space; a text of fewer words, but not none, is
one shingle. Two texts are linked if their weighted Jaccard similarity, the sum of the lesser counts over that of the
greater ones, is at least `LEAST`. Classes are the connected components of the links, copies included.

BagMinHash: a shingle of weight w starts Poisson processes on the levels below w, taken in dyadic blocks [0,1), [1,2),
[2,4) and so on. A block's process has the rate of its length; its points fall on one of the
registers and, halving the block again and again by random bits, on one of its levels. They count if
that level lies below w. Each register keeps the time of its first point, so two texts agree in a register with just the probability
of their similarity. A process stops as soon as its time passes the last register's. `BANDS` bands of `ROWS` registers
each give keys; at similarity 0.8 a pair shares none of them with a probability below 6e-6.

Copies are first made one node by digest. Nodes that share a key are never paired with one another outright: each bucket
compares its members with one leader, and links make components. What remains are buckets whose members lie in several
components: texts that are alike but mostly not enough. The members of those of more than `LARGE` are dealt anew by an exact
prefix filter: two texts of n and m elements (the k-th copy of a shingle is an element of its own) and similarity 0.8 or more
have at least a = 4 (n + m) / 9 elements in common, so they share one of the first n - a + 1 and m - a + 1 in any one order of all elements.
The texts are put in classes of nearly equal n, and a text is dealt once for each class that its partners may be in, under the
elements of the prefix for the least m there. The order puts frequent
elements last; which are frequent is a list of at most `FREQUENT`, so texts meet in small groups, under elements that are
rare. As this finds every link between two such members, smaller buckets that hold nothing else are left out. Whatever the sizes, each remaining bucket is dealt in chunks of at most `CHUNK` members; a task has the texts of two chunks at a time and
counts all overlaps across components exactly; it gives only the links that join components further, at most one for each member.
So every pair that shares a key is tested or lies within a component, at any size of bucket. All comparisons are made on the
texts, counts and all. Joins on keys that many rows share are salted.

A text without words has no shingles and is linked to its exact copies only; a null text is linked to nothing. Null
ids and repeated rows are ordinary rows. Columns named like the results are replaced. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytetext import NOT_SPACE, Tokens, column_bytes, mix64, slices
from .common import forget, kept, lean, salted_join, small_batches
from .components import components

SHINGLE, LEAST_NUMERATOR, LEAST_DENOMINATOR = 5, 4, 5
LEAST = LEAST_NUMERATOR / LEAST_DENOMINATOR
BANDS, ROWS = 40, 6
#: Members of a bucket that one task compares with as many others.
CHUNK = 512
#: Buckets of more members than this, in several components, are dealt anew by rare elements.
LARGE = 1024
#: The least number of elements of each class of sizes; every one is about a twelfth above the one before.
SIZES = np.unique(np.floor(1.08 ** np.arange(300)).astype(np.int64))
#: At most so many elements are known as frequent: those of more than that part of all occurrences.
FREQUENT = 500_000
ADDED = ["class_id", "class_rows"]
_U = np.uint64


def multisets(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows, shingle hashes and counts of a column of texts, and its number of rows."""
    words = Tokens(*column_bytes(column), NOT_SPACE)
    rows, grams = words.grams_or_all(SHINGLE)
    _, first, counts = np.unique(mix64(grams + mix64(rows.astype(_U))), return_index=True, return_counts=True)
    order = np.argsort(rows[first], kind="stable")
    return rows[first][order], grams[first][order], counts[order], words.n_rows


def signatures(rows: np.ndarray, grams: np.ndarray, counts: np.ndarray, n_rows: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """The registers of each row: times of first points, infinite for rows without shingles."""
    out = np.full(n_rows * registers, np.inf)
    levels = np.ceil(np.log2(counts, where=counts > 0, out=np.zeros(len(counts)))).astype(np.int64) + 1 if len(counts) else counts
    element = np.repeat(np.arange(len(rows)), levels)
    block = np.arange(len(element)) - np.repeat(np.cumsum(levels) - levels, levels)
    start = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    length = np.where(block > 0, start, 1)
    row, weight = rows[element], counts[element]
    seed = mix64(grams[element] + block.astype(_U) * _U(0x632BE59BD9B4E019))
    per_row = np.bincount(row, minlength=n_rows)
    for small in (False, True):
        mine = np.flatnonzero((per_row[row] < registers) == small)
        _run(out, registers, row[mine], seed[mine], start[mine], length[mine], weight[mine], 24 if small else 1)
    return out.reshape(n_rows, registers)


def _run(out: np.ndarray, m: int, row: np.ndarray, seed: np.ndarray, start: np.ndarray, length: np.ndarray, weight: np.ndarray, burst: int) -> None:
    """Processes advance by `burst` points a round until each has passed the last register of its row."""
    time, step = np.zeros(len(row)), 0
    table = out.reshape(-1, m)
    while len(row):
        for _ in range(burst):
            with np.errstate(over="ignore"):
                one = mix64(seed + _U(2 * step) * _U(0xA0761D6478BD642F))
                two = mix64(seed + _U(2 * step + 1) * _U(0xA0761D6478BD642F))
            time = time - np.log(((one >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / (m * length)
            level = start + ((two >> _U(32)) % length.astype(_U)).astype(np.int64)
            counts = level < weight
            register = ((two & _U(0xFFFFFFFF)) % _U(m)).astype(np.int64)
            np.minimum.at(out, (row * m + register)[counts], time[counts])
            step += 1
        there, back = np.unique(row, return_inverse=True)
        on = time < table[there].max(axis=1)[back]
        row, seed, start, length, weight, time = row[on], seed[on], start[on], length[on], weight[on], time[on]


def band_keys(table: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each row and band."""
    bits = np.ascontiguousarray(table).view(_U).reshape(len(table), bands, rows)
    keys = np.broadcast_to(np.arange(bands, dtype=_U), (len(table), bands)).copy()
    with np.errstate(over="ignore"):
        for j in range(rows):
            keys = mix64(keys * _U(0xE7037ED1A0B428DB) + bits[:, :, j])
    return keys.view(np.int64)


def overlaps(left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """By row: the sums of the lesser and of the greater counts."""
    sides = [multisets(x) for x in (left, right)]
    keyed = [(mix64(g + mix64(r.astype(_U))), r, c) for r, g, c, _ in sides]
    _, a, b = np.intersect1d(keyed[0][0], keyed[1][0], assume_unique=True, return_indices=True)
    n = len(left)
    common = np.bincount(keyed[0][1][a], weights=np.minimum(keyed[0][2][a], keyed[1][2][b]), minlength=n).astype(np.int64)
    total = sum(np.bincount(r, weights=c, minlength=n).astype(np.int64) for _, r, c in keyed)
    return common, total - common


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text", 2_000_000):
            rows, grams, counts, n = multisets(batch.column("text"))
            keys = band_keys(signatures(rows, grams, counts, n))
            many = np.where(np.bincount(rows, minlength=n) > 0, BANDS, 0)
            ends = pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.array(keys[many > 0].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("digest"), lists], names=["id", "digest", "keys"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text_a", 2_000_000):
            common, union = overlaps(batch.column("text_a"), batch.column("text_b"))
            linked = (union > 0) & (LEAST_DENOMINATOR * common >= LEAST_NUMERATOR * union)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked)], names=["a", "b", "linked"])


def digest_of(text) -> F.Column:
    return F.unhex(F.md5(text.cast("binary")))


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digest (MD5 of the text), root (what a class has in common), class_id (the least id of its class) and class_rows,
    for each distinct text."""
    spark = docs.sparkSession
    small_batches(spark)
    use = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    use = use.withColumn("digest", digest_of(F.col("text")))
    id_type = use.schema["id"].dataType
    schema = T.StructType().add("id", id_type).add("digest", "binary").add("keys", T.ArrayType(T.LongType()))
    signed = use.mapInArrow(lean(_signed), schema)
    nodes = kept(signed.groupBy("digest").agg(F.min("id").alias("id"), F.count("*").alias("n_rows"), F.any_value("keys").alias("keys")), "nodes")
    seed = _seed(nodes)
    node = F.xxhash64("digest", F.lit(seed)).alias("node")
    members = nodes.select(node, F.explode("keys").alias("key"))
    shared = kept(members.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("leader")).where("n > 1"), "buckets")
    n_nodes = nodes.count()
    members = kept(salted_join(members, shared.select("key", "leader"), "key", "node", shared, BANDS * n_nodes), "members")
    texts = _texts(use, nodes.select(node, "digest", "id"), members.select("node").distinct())
    tested = kept(_verify(members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct(), texts), "tested")
    links = tested.where("linked").select("a", "b")
    roots = kept(components(links), "roots")
    members = _mixed(members.select("key", "node"), roots)
    if members.where(F.col("n") > LARGE).limit(1).count():
        dealt = kept(members.where(F.col("n") > LARGE).select("node", "root").distinct(), "dealt")
        small = members.where(F.col("n") <= LARGE).select("key", "node", "root").join(dealt.select("node", F.lit(True).alias("dealt")), "node", "left")
        small = small.join(small.where("dealt is null").select("key").distinct(), "key", "left_semi").select("key", "node", "root")
        members = kept(small.unionByName(_by_rare_elements(dealt, texts)), "members")
        leaders = members.groupBy("key").agg(F.min(F.struct(F.xxhash64("node", "key"), "node", "root")).alias("l")).select("key", F.col("l.node").alias("l"), F.col("l.root").alias("root_l"))
        pairs = salted_join(members, leaders, "key", "node", members.groupBy("key").count().withColumnRenamed("count", "n"), members.count()).where("node <> l and root <> root_l").select(F.least("node", "l").alias("a"), F.greatest("node", "l").alias("b"))
        links = links.unionByName(kept(_verify(pairs.distinct(), texts), "tested").where("linked").select("a", "b"))
        roots = kept(components(links), "roots")
        members = _mixed(members.select("key", "node"), roots)
    more = kept(_chunks(members, texts).groupBy("key", "i", "j").applyInArrow(_compared, "a long, b long"), "links")
    if more.limit(1).count():
        roots = kept(components(links.unionByName(more)), "roots")
    rooted = kept(nodes.select(node, "digest", "id", "n_rows").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n_rows").alias("class_rows"), F.count("*").alias("n"))
    out = salted_join(rooted.select("node", "digest", "root", "n_rows"), least.select("root", "class_id", "class_rows"), "root", "node", least, n_nodes)
    return kept(out.select("digest", "root", "class_id", "class_rows", "n_rows"), "classes")


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The members (key, node) of buckets that lie in several components, with their roots and the buckets' sizes."""
    placed = kept(members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "placed")
    by = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    mixed = by.where("low <> high").select("key", "n")
    out = kept(salted_join(placed, mixed, "key", "node", by, placed.count()), "members")
    forget(placed)
    return out


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's elements (its shingles, the k-th copy of one an element of its own), and the class of their number."""
    for whole in batches:
        for batch in slices(whole, "text", 2_000_000):
            rows, elements = _expanded(*multisets(batch.column("text"))[:3])
            order = np.argsort(rows, kind="stable")
            many = np.bincount(rows, minlength=batch.num_rows)
            ends = np.concatenate([[0], np.cumsum(many)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(elements[order].view(np.int64)))
            sizes = np.searchsorted(SIZES, many, "right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("root"), pa.array(sizes, pa.int32()), lists], names=["node", "root", "size", "elements"])


def _expanded(rows: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and elements of multisets."""
    copy = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(rows, counts), mix64(np.repeat(grams, counts) + copy.astype(_U) * _U(0x8EBC6AF09C88C6E3))


def prefixes_by_size(n: int, mine: int, there: list[int]) -> list[tuple[int, int]]:
    """For a text of n elements, in class `mine`: the classes of `there` that partners may be in, and the length of the prefix
    for each."""
    out = []
    for other in there:
        low, high = int(SIZES[other]), int(SIZES[other + 1]) - 1
        least = max(low, -(-LEAST_NUMERATOR * n // LEAST_DENOMINATOR))  # of the partner's elements
        if least <= high and LEAST_NUMERATOR * least <= LEAST_DENOMINATOR * n:
            out.append((other, n - -(-LEAST_NUMERATOR * (n + least) // (LEAST_NUMERATOR + LEAST_DENOMINATOR)) + 1))
    return out


def _by_rare_elements(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """key, node and root: each of the nodes (node, root) under those pairs of classes and elements of its prefixes that a node
    of another root has too."""
    listed = kept(texts.join(nodes, "node").mapInArrow(lean(_elements), "node long, root long, size int, elements array<long>"), "elements")
    there = sorted(r["size"] for r in listed.select("size").distinct().collect())  # of at most len(SIZES)
    total = listed.agg(F.coalesce(F.sum(F.size("elements")), F.lit(0))).first()[0]
    # occurrences sum to `total`, so at most FREQUENT elements have more than its FREQUENT-th part
    often = listed.select(F.explode("elements").alias("e")).groupBy("e").count().where(F.col("count") > max(8, -(-total // FREQUENT))).toArrow()
    order = np.argsort(often.column("e").to_numpy())
    known = texts.sparkSession.sparkContext.broadcast((often.column("e").to_numpy()[order], often.column("count").to_numpy()[order]))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = known.value
        for batch in batches:
            lists = batch.column("elements")
            keys, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for row, size, mine in zip(range(batch.num_rows), batch.column("size").to_pylist(), (lists[i].values.to_numpy() for i in range(len(lists))), strict=True):
                at = np.minimum(np.searchsorted(names, mine), max(0, len(names) - 1))
                seen = np.where(names[at] == mine, counts[at], 0) if len(names) else np.zeros(len(mine), np.int64)
                ordered = mine[np.lexsort((mine, seen))].view(_U)
                for other, length in prefixes_by_size(len(mine), size, there):
                    pair = mix64(np.array([min(size, other) * len(SIZES) + max(size, other)], _U))
                    keys.append(mix64(ordered[:length] ^ pair).view(np.int64))
                    rows.append(np.full(length, row))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), batch.column("node").take(at), batch.column("root").take(at)], names=["key", "node", "root"])

    found = kept(listed.mapInArrow(lean(prefixes), "key long, node long, root long"), "prefixes")
    by = found.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    return salted_join(found, by.where("low <> high").select("key"), "key", "node", by, found.count())


def _chunks(members: DataFrame, texts: DataFrame) -> DataFrame:
    """The members' texts, once for each pair of chunks (i, j) of their bucket that theirs is one of."""
    n_chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    mine = F.pmod(F.xxhash64("node", "key"), n_chunks).cast("int")
    rows = members.join(texts, "node").select("key", "node", "root", "text", mine.alias("c"), n_chunks.alias("m"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("m") - 1)))
    return rows.select("key", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), (F.col("c") > F.col("o")).alias("right"), "node", "root", "text")


def overlap_table(column: pa.Array | pa.ChunkedArray, slab: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Of all pairs of the texts the sums of the lesser counts, and each text's sum of counts."""
    rows, grams, counts, n = multisets(column)
    # overlaps of counts are overlaps of sets of elements
    row, element = _expanded(rows, grams, counts)
    _, number, many = np.unique(element, return_inverse=True, return_counts=True)
    shared = many[number] > 1
    dense = np.cumsum(many > 1) - 1
    row_shared, number = row[shared], dense[number[shared]]
    order = np.argsort(number, kind="stable")
    row_shared, number = row_shared[order], number[order]
    out = np.zeros((n, n), np.float32)
    for a in range(0, int(number[-1]) + 1 if len(number) else 0, slab):
        first, last = np.searchsorted(number, (a, a + slab))
        there = np.zeros((n, slab), np.float32)
        there[row_shared[first:last], number[first:last] - a] = 1
        out += there @ there.T
    return out.astype(np.int64), np.bincount(row, minlength=n)


def _compared(key, table):
    """Links between the components in two chunks: enough of them to join whatever is linked."""
    common, sizes = overlap_table(table.column("text"))
    linked = LEAST_DENOMINATOR * common >= LEAST_NUMERATOR * (sizes[:, None] + sizes[None, :] - common)
    names, place = np.unique(table.column("root").to_numpy(), return_inverse=True)
    linked &= place[:, None] < place[None, :]
    node, root, out = table.column("node").to_numpy(), list(range(len(names))), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in np.argwhere(linked).tolist():
        x, y = find(int(place[a])), find(int(place[b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(node[a]), int(node[b])))
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def _seed(nodes: DataFrame) -> int:
    """A seed for which no two digests have the same 64-bit number."""
    seed = 0
    while nodes.groupBy(F.xxhash64("digest", F.lit(seed)).alias("h")).count().where("count > 1").limit(1).count():
        seed += 1
    return seed


def _texts(use: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text for each wanted node."""
    chosen = nodes.join(wanted, "node", "left_semi").select("node", F.col("digest").alias("d"), F.col("id").alias("i"))
    found = use.join(chosen, (use["digest"] == F.col("d")) & use["id"].eqNullSafe(F.col("i"))).select("node", "text").dropDuplicates(["node"])
    return kept(found, "texts")


def _verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b and whether they are linked. A text that is in very many pairs is dealt over many tasks."""
    pairs = kept(pairs, "pairs")
    n, out = pairs.count(), pairs
    for side in ("a", "b"):
        other = "b" if side == "a" else "a"
        by = pairs.groupBy(side).agg(F.count("*").alias("n"))
        out = salted_join(out, texts.select(F.col("node").alias(side), F.col("text").alias(f"text_{side}")), side, other, by, n)
    return out.select("a", "b", "text_a", "text_b").mapInArrow(lean(_verified), "a long, b long, linked boolean")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """Every row with class_id, the least id of its class, and class_rows, the number of rows in it."""
    docs = docs.drop(*ADDED)
    found = classes(docs, id_col=id_col, text_col=text_col)
    stay = F.struct(*(docs[c] for c in docs.columns if keep_text or c != text_col)).alias("_doc")
    rows = docs.select(stay, docs[id_col].alias("_id"), digest_of(docs[text_col].cast("string")).alias("digest"))
    out = salted_join(rows, found.select("digest", "class_id", "class_rows"), "digest", "_id", *_copies(found), how="left")
    single = F.col("digest").isNull()
    return out.select("_doc.*", F.when(single, F.col("_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(single, F.lit(1)).otherwise(F.col("class_rows")).cast("long").alias("class_rows"))


def _copies(found: DataFrame) -> tuple[DataFrame, int]:
    """How many rows have each digest, and all of them."""
    return found.select("digest", F.col("n_rows").alias("n")), found.agg(F.coalesce(F.sum("n_rows"), F.lit(0))).first()[0]


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, the one with the least id, with the columns of the documents; rows with null texts stay."""
    found = classes(docs, id_col=id_col, text_col=text_col)
    digest = digest_of(docs[text_col].cast("string"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"), docs[id_col].alias("_id"), digest.alias("digest"))
    # each class's least id, and of the texts that it has under that id the least
    narrow = docs.select(docs[id_col].alias("_id"), digest.alias("digest")).where("digest is not null")
    chosen = salted_join(narrow, found.select("digest", "root", "class_id"), "digest", "_id", *_copies(found)).where(F.col("_id").eqNullSafe(F.col("class_id")))
    repeated = chosen.groupBy("root").count().where("count > 1").limit(1).count() > 0
    chosen = chosen.groupBy("root").agg(F.min("digest").alias("_d"), F.min("class_id").alias("_c"))
    out = rows.join(chosen, F.col("_id").eqNullSafe(F.col("_c")) & (F.col("digest") == F.col("_d")), "left_semi")
    if repeated:
        out = out.dropDuplicates(["_id", "digest"])
    return out.select("_doc.*").unionByName(docs.where(F.col(text_col).isNull()))
