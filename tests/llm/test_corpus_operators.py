"""The operators over whole corpora against brute force, exact round trips and held-out accuracy."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trellis.llm import byte_bpe, components, html_text, kneser_ney, licenses, near_dedup, queries

EDGE = [(1, None, "en"), (2, "", "en"), (3, " \n ", "de"), (4, "a b c", None), (4, "a b c", None), (5, "word " * 50_000, "en"), (None, "no id at all here", "xx"), (6, "tab\tand é \U0001f600 words", "en"), (7, "a b c", "en")]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, "doc_id long, text string, lang string").withColumn("block", F.lit("clash")).withColumn("_doc", F.lit(1)).withColumn("class_id", F.lit("x")).withColumn("kept", F.lit(1)).withColumn("token_ids", F.lit(0)).withColumn("id", F.lit("q")).withColumn("digest", F.lit("q")).withColumn("licenses", F.lit(1))


def oracle_encoding():
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    return path, P.PATTERN, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={b: i for i, b in enumerate(byte_bpe.token_bytes(path))}, special_tokens={})


def test_byte_bpe(spark, small):
    _, _, own = oracle_encoding()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op3_byte_bpe(spark, small).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = own.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())


def test_byte_bpe_edges(spark, edge):
    path, pattern, own = oracle_encoding()
    out = byte_bpe.encode(edge, path, pattern, keep_text=True)
    assert out.columns == [c for c in edge.columns if c != "token_ids"] + ["token_ids", "decoded"]
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i, t) for i, t, _ in EDGE)
    for r in rows:
        assert list(r["token_ids"]) == own.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]) == (r["text"] or "").encode()
    again = byte_bpe.decode(out.select("doc_id", "token_ids"), path).collect()
    assert Counter(bytes(r["decoded"]) for r in again) == Counter((t or "").encode() for _, t, _ in EDGE)
    assert byte_bpe.encode(edge.limit(0), path, pattern).count() == 0


def shingles(text):
    words = [w for w in (text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)])


def dedup_brute(rows):
    """Class of each row number: copies and similar multisets."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_text, by_shingle = {}, defaultdict(set)
    for i, (_, t) in enumerate(rows):
        if t is not None:
            if t in by_text:
                root[find(i)] = find(by_text[t])
            else:
                by_text[t] = i
                for s in sets[i]:
                    by_shingle[s].add(i)
    pairs = {(a, b) for at in by_shingle.values() for a in at for b in at if a < b}
    for a, b in pairs:
        common = sum((sets[a] & sets[b]).values())
        if 5 * common >= 4 * (sum(sets[a].values()) + sum(sets[b].values()) - common):
            root[find(a)] = find(b)
    classes = defaultdict(list)
    for i in range(len(rows)):
        classes[find(i)].append(i)
    return classes


def check_classes(found, rows):
    want = Counter()
    for members in dedup_brute(rows).values():
        ids = [rows[i][0] for i in members]
        least = min((i for i in ids if i is not None), default=None)
        want.update((i, least, len(members)) for i in ids)
    assert Counter((r["doc_id"], r["class_id"], r["class_rows"]) for r in found) == want


def test_near_duplicates(spark, small, edge):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    check_classes(queries.op5_minhash_dedup(spark, small).collect(), rows)
    check_classes(near_dedup.near_duplicates(edge).collect(), [(i, t) for i, t, _ in EDGE])
    assert near_dedup.near_duplicates(edge.limit(0)).count() == 0
    kept = near_dedup.deduplicated(edge).collect()
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter([(1, None), (2, ""), (3, " \n "), (4, "a b c"), EDGE[5][:2], EDGE[6][:2], EDGE[7][:2]])


def family(rng, n, base, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(edits):
            words[int(rng.integers(len(words)))] = f"x{rng.integers(10**9)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """A group of near copies, a family that is alike but not enough, and weights that matter."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    other = [f"v{i}" for i in range(100)]
    texts = family(rng, 60, base, 2) + family(rng, 60, other, 6) + ["a b c d e " * 10, "a b c d e " * 12, "a b c d e " * 40]
    rows = [*enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for large, chunk in ((8192, 512), (8192, 7), (4, 512)):
        monkeypatch.setattr(near_dedup, "LARGE", large)
        monkeypatch.setattr(near_dedup, "CHUNK", chunk)
        check_classes(near_dedup.near_duplicates(docs).collect(), rows)


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(0)
    estimates, truths = [], []
    for trial in range(30):
        grams = np.arange(40, dtype=np.uint64) + np.uint64(1000 * trial)
        a, b = rng.integers(0, 12, 40), rng.integers(0, 12, 40)
        rows = np.repeat([0, 1], 40)
        keep = np.concatenate([a, b]) > 0
        table = near_dedup.signatures(rows[keep], np.concatenate([grams, grams])[keep], np.concatenate([a, b])[keep], 2)
        estimates.append((table[0] == table[1]).mean())
        truths.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    error = np.array(estimates) - np.array(truths)
    assert abs(error.mean()) < 0.012 and np.abs(error).max() < 0.14


def test_components(spark):
    rng = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in [*root]}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def kn_brute(train, grams, order):
    """Interpolated modified Kneser-Ney by the formulas, over tuples of characters."""
    pad = lambda t: [0] * (order - 1) + [ord(c) + 1 for c in t]
    levels = {order: Counter(tuple(p[i - order + 1 : i + 1]) for t in train for p in [pad(t)] for i in range(order - 1, len(p)))}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cuts = {}
    for k, c in levels.items():
        n = [sum(v == i for v in c.values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else 0
        cuts[k] = [0] + [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05), i - 0.05) if n[i] and n[1] else 0.5 * i for i in (1, 2, 3) if i < 4 and i + 1 < 5]

    totals = {k: Counter() for k in levels}
    backs = {k: defaultdict(float) for k in levels}
    for k, c in levels.items():
        for g, v in c.items():
            totals[k][g[:-1]] += v
            backs[k][g[:-1]] += cuts[k][min(v, 3)]

    def p(g):
        k = len(g)
        lower = p(g[1:]) if k > 1 else 2.0**-12
        total = totals[k][g[:-1]]
        if not total:
            return lower
        v = levels[k][g]
        return max(v - cuts[k][min(v, 3)], 0) / total + backs[k][g[:-1]] / total * lower if v else backs[k][g[:-1]] / total * lower

    return {g: p(g) for g in grams}


def test_kneser_ney_probabilities(spark):
    train = ["the cat sat on the mat and the hat", "a dog and a cat sat", "there is no other mat than that", "été à la mer"]
    docs = ["the rat sat", "zzz", "a cat", "été", "", "".join(chr(ord(c) + 4095) for c in "the cat"), "the \U00020000 cat"]
    train_df = spark.createDataFrame([(t, "en") for t in train], "text string, lang string")
    books = kneser_ney.alphabets(train_df, text_col="text", lang_col="lang")
    levels = kneser_ney.model(kneser_ney.gram_counts(train_df, books, text_col="text", lang_col="lang", order=5))
    table = spark.createDataFrame([(i, t, "en") for i, t in enumerate(docs)] + [(99, "the rat", "other")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in kneser_ney.scored(table, levels, books).collect()}
    assert got[99]["log2_prob"] is None
    for i, t in enumerate(docs):
        codes = [0] * 4 + [ord(c) + 1 for c in t]
        grams = [tuple(codes[k : k + 5]) for k in range(len(t))]
        want = kn_brute(train, grams, 5)
        assert got[i]["n_scored"] == len(t)
        if not t:
            assert got[i]["log2_prob"] is None
            continue
        assert got[i]["log2_prob"] == pytest.approx(sum(np.log2(want[g]) for g in grams), rel=1e-4, abs=1e-9)
    # probabilities of what may follow sum to 1
    total = kn_brute(train, [(0, 0, ord("t") + 1, ord("h") + 1, c) for c in range(4096)], 5)
    assert sum(total.values()) == pytest.approx(1.0)


def test_quality_classifier(spark):
    d = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = queries.op1_quality_classifier(spark, d).join(labels, "doc_id").where("toxic = 0")
    share = {r["quality"]: r["share"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert share[1] > 0.985 and share[0] < 0.25


def test_quality_classifier_edges(spark, edge):
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (7, 1, 0), (7, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    out = kneser_ney.classified(edge, labels, keep_text=True)
    assert set(out.columns) == {*edge.columns, *kneser_ney.ADDED.names}
    rows = out.collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((i, t) for i, t, _ in EDGE)
    assert all(r["kept"] == bool(r["text"]) or r["text"] for r in rows)
    assert not [r for r in rows if r["kept"] and not r["text"]]
    assert {r["perplexity"] for r in rows if r["lang"] == "xx"} == {None}
    assert all(r["kept"] for r in kneser_ney.classified(edge, labels.limit(0)).collect() if r["n_scored"])
    assert kneser_ney.classified(edge.limit(0), labels).count() == 0
    small = kneser_ney.classified(edge, labels, few_ids=0).collect()
    assert Counter((r["doc_id"], r["log2_prob"]) for r in small) == Counter((r["doc_id"], r["log2_prob"]) for r in rows)


def contains_brute(text, template):
    import re

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    a, b = words(text), words(template)
    n = min(5, len(b))
    want = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return 5 * len(want & {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}) >= 4 * len(want)


def test_license_scan(spark, small, edge):
    rows = licenses.scan(spark.read.parquet(f"{small}/documents.parquet"), keep_text=True).collect()
    for r in rows:
        assert {x["license"] for x in r["licenses"]} == {n for n, t in licenses.TEMPLATES if contains_brute(r["text"] or "", t)}
    assert any(r["licenses"] for r in rows)
    words = [f"w{i}" for i in range(400)]
    for most, templates in ((licenses.MOST_WORDS, licenses.TEMPLATES), (20, licenses.TEMPLATES[:12])):  # the latter in a pass for each
        whole = [(n, " ".join(words) + " " + t + " " + " ".join(words[:k])) for k, (n, t) in enumerate(templates)]
        broken = [(n, t.replace(" the ", " the extra ", 1).upper()) for n, t in templates if len(t) > 200]
        table = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(whole + broken)], "doc_id long, text string")
        licenses.MOST_WORDS, old = most, licenses.MOST_WORDS
        for r in licenses.scan(table, templates).collect():
            assert (whole + broken)[r["doc_id"]][0] in {x["license"] for x in r["licenses"]}
        licenses.MOST_WORDS = old
    assert all(not r["licenses"] for r in licenses.scan(edge).collect())
    assert licenses.scan(edge.limit(0)).count() == 0 and licenses.scan(table, []).where(F.size("licenses") > 0).count() == 0


def test_licenses_in_altered_copies(spark):
    """Copies with words changed, from whole ones to ones below the least containment: what brute force finds, and no more."""
    rng, rows = np.random.default_rng(5), []
    for _, t in licenses.TEMPLATES:
        for changes in range(5):
            copy = t.split()
            for k in rng.integers(0, len(copy), changes):
                copy[k] = "other"
            rows.append((len(rows), " ".join([f"w{i}" for i in range(int(rng.integers(0, 300)))] + copy + ["tail"] * int(rng.integers(0, 9)))))
    found = {r["doc_id"]: {x["license"] for x in r["licenses"]} for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert found[i] == {n for n, t in licenses.TEMPLATES if contains_brute(text, t)}
    assert any(not x for x in found.values())


def test_html_leaves():
    page = "<html><head><title>t</title></head><body><div class='Menu'>x&amp;y <a href='/'>z</a></div><article><h1>One  \n two</h1><p>a<br>b<p>c <b>d</b>e<!-- <p>no -->f<script>var p='</p>';</script></article>tail &eacute;&#233;"
    found = html_text.leaves(page)
    assert [x.text for x in found] == ["x&y z", "One two", "a b", "c def", "tail éé"]
    assert found[0].path[-2:] == ("div.menu", ".menu") and found[0].linked == 1
    assert [x.text for x in html_text.leaves("<script>never closed <p>x")] == []
    assert html_text.leaves(None) == [] and [x.text for x in html_text.leaves("plain < text")] == ["plain < text"]


def test_html_gradients():
    rng = np.random.default_rng(0)
    model = html_text.Labeller(1)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = rng.standard_normal((5, 3, html_text.PATHS + html_text.WORDS + html_text.MEASURES)) * 0.3
    mask = np.ones((5, 3))
    mask[3:, 1] = 0
    y = (rng.random((5, 3)) < 0.5).astype(float)
    loss = lambda: float((np.logaddexp(0, -(2 * y - 1) * model.forward(model.inner(x), mask)[0]) * mask).sum() / mask.sum())
    for name, g in model.gradients(x, mask, y).items():
        at = tuple(rng.integers(s) for s in g.shape)
        old = model.w[name][at]
        model.w[name][at] = old + 1e-2
        up = loss()
        model.w[name][at] = old - 1e-2
        down = loss()
        model.w[name][at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(g[at]), rel=0.05, abs=2e-4), name


def test_html_extraction(spark, small):
    held = html_text.training_pages(150, 12345)
    found = html_text.trained().labels([p for p, _ in held])
    assert np.concatenate([a == b for a, (_, b) in zip(found, held, strict=True)]).mean() > 0.99
    pages = spark.read.parquet(f"{small}/pages.parquet")
    rows = {r["page_id"]: r for r in queries.op8_html_extraction(spark, small).collect()}
    same = total = 0
    for r in pages.collect():
        inside = r["html"][r["html"].index("<article>") : r["html"].index("</article>")]
        want = "\n".join(x.text for x in html_text.leaves(inside))
        same += rows[r["page_id"]]["text"] == want
        total += 1
        assert rows[r["page_id"]]["n_chars"] == len(rows[r["page_id"]]["text"])
    assert same == total


def test_html_edges(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<<<>>>&&&"), (3, "u", "<<<>>>&&&"), (None, "u", "<article>" + "<p>Some main text here, of words.</p>" * 3000 + "</article>"), (4, "u", "<div>" * 5000 + "deep")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(3)).withColumn("n_chars", F.lit("x"))
    out = html_text.main_text(pages).collect()
    assert len(out) == len(rows) and out[0]["text"] == "" and out[1]["n_chars"] == 0
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_pipeline(spark, tiny):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    step = docs
    for name, stage in c.STAGES[:-1]:
        before = step
        step = stage(spark, step, tiny).cache()
        assert step.columns == docs.columns, name
        assert step.count() <= before.count()
    rows = {r["doc_id"]: r for r in c.run(spark, tiny).collect()}
    texts = {r["doc_id"]: r["text"] for r in step.collect()}
    assert rows.keys() == texts.keys()
    _, _, own = oracle_encoding()
    assert all(list(rows[i]["token_ids"]) == own.encode_ordinary(t) for i, t in texts.items())


def test_blocks_are_whole():
    from trellis.llm.blocks import packed, unpacked

    table = pa.table({"a": [1, None], "b": ["x", None]})
    assert unpacked(packed(table)).equals(table)
