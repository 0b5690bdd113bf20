"""Buckets of many members: every link is found, by comparison with brute force on the planted pairs."""

import numpy as np

from trellis.llm import near_dedup


def test_members_of_large_buckets(spark):
    """9,000 texts that share most words, so that many of them meet in the same buckets, and are alike by 0.6 to 0.7; among
    them pairs at 0.8 or more, and pairs just below."""
    rng = np.random.default_rng(8)
    common = [f"w{i}" for i in range(104)]
    rows = []

    def text(own):
        return " ".join([*common, *own])

    for i in range(9000):
        rows.append((i, text([f"x{i}a{j}" for j in range(24)])))
    links = {}
    for k, i in enumerate(rng.choice(9000, 120, replace=False).tolist()):
        same = (10, 13)[k % 2]  # of 24 own words those at the front: above 0.8, or below
        own = [f"x{i}a{j}" for j in range(same)] + [f"y{i}b{j}" for j in range(24 - same)]
        rows.append((10_000 + k, text(own)))
        links[10_000 + k] = i

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    texts = dict(rows)
    want = {i: i for i, _ in rows}
    n_linked = 0
    for new, old in links.items():
        a, b = shingles(texts[new]), shingles(texts[old])
        if 5 * len(a & b) >= 4 * len(a | b):
            want[new] = old
            n_linked += 1
    assert 0 < n_linked < len(links)
    # without a copy two texts share the common shingles only, which is below 0.8
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 0.5 < len(a & b) / len(a | b) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want


def test_prefixes_by_size():
    """Two sizes that may be similar enough meet in each other's class, with prefixes at least as long as their overlap needs."""

    def size_class(n):
        return int(np.searchsorted(near_dedup.SIZES, n, "right")) - 1

    every = list(range(len(near_dedup.SIZES) - 1))
    for n in range(1, 200):
        found = dict(near_dedup.prefixes_by_size(n, size_class(n), every))
        for m in range(1, 260):
            if 5 * min(n, m) >= 4 * max(n, m):
                assert found[size_class(m)] >= n - -(-4 * (n + m) // 9) + 1


def test_buckets_beyond_the_limit(spark):
    """24,000 texts alike by 0.73, whose buckets exceed the limit, and 100 that have half of the own words of one of them."""
    common = " ".join(f"w{i}" for i in range(136))
    rows = [(i, common + " " + " ".join(f"x{i}a{j}" for j in range(24))) for i in range(24_000)]
    want = {i: i for i, _ in rows}
    for k, i in enumerate(np.random.default_rng(8).choice(24_000, 100, replace=False).tolist()):
        rows.append((1_000_000 + k, common + " " + " ".join([f"x{i}a{j}" for j in range(12)] + [f"y{i}b{j}" for j in range(12)])))
        want[1_000_000 + k] = i  # 144 of 156 shingles in common
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_duplicates(docs).collect()}
    assert got == want
