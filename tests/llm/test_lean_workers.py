import re

import numpy as np
import pyarrow as pa

from trellis.llm import common


def test_workers_give_back_what_they_freed(spark):
    def fills(batches):
        for batch in batches:
            held = [np.ones(10_000) for _ in range(3000)]  # 240 MB, in pieces that are kept for the next ones
            np.last = held.pop()  # stays above them
            yield batch

    def measured(batches):
        for _ in batches:
            pass
        mb = sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read()))) >> 10
        yield pa.RecordBatch.from_arrays([pa.array([mb])], names=["mb"])

    rows = spark.range(1, numPartitions=1)
    for _ in range(2):  # the worker is the same
        rows.mapInArrow(common.lean(fills), "id long").count()
    assert rows.mapInArrow(measured, "mb long").first()["mb"] < 200


def test_lean_functions_give_the_same(spark):
    left = spark.createDataFrame([(1, 2), (1, 3), (2, 5)], "k int, v int")
    same = common.lean_group(lambda key, table: table)
    assert sorted(left.groupBy("k").applyInArrow(same, "k int, v int").collect()) == sorted(left.collect())
    first = common.lean_cogroup(lambda key, a, b: a)
    assert sorted(left.groupBy("k").cogroup(left.groupBy("k")).applyInArrow(first, "k int, v int").collect()) == sorted(left.collect())
