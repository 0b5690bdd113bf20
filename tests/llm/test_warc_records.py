"""The registered query rebuilds records."""

import pytest
from pyspark.sql import functions as F

from trellis.llm import queries, warc


def test_query_rebuilds_records(spark, tiny, monkeypatch):
    want = sorted(map(tuple, warc.read_summaries(spark, warc.write_archive(spark.read.parquet(f"{tiny}/pages.parquet"), warc.archive_path(spark))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)
    assert sorted(map(tuple, queries.op4_warc(spark, tiny).collect()), key=repr) == want
    whole = warc.read_records

    def cut(spark, archive):
        return whole(spark, archive).withColumn("record", F.expr("substring(record, 1, octet_length(record) - 1)"))

    monkeypatch.setattr(warc, "read_records", cut)
    with pytest.raises(Exception, match="record and header differ"):
        queries.op4_warc(spark, tiny).collect()


def _exchanged(plan) -> set:
    """The names of all columns that exchanges of a plan send."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return _exchanged(plan.initialPlan())
    out, inside = set(), plan.children()
    if plan.nodeName() == "Exchange":
        out |= {plan.output().apply(i).name() for i in range(plan.output().size())}
    return out.union(*(_exchanged(inside.apply(i)) for i in range(inside.size())))


def test_payloads_stay_on_reading(spark, tiny):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = _exchanged(queries.op4_warc(spark, tiny)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "header" in sent and "payload" not in sent
    assert not [t for t in spark.catalog.listTables() if "warc" in t.name]


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_many_copies(spark, tmp_path, threshold):
    """One page 3,000 times, another 300 times, with null ids and repeated rows among them, and 700 single ones."""
    rows = [(i, f"u{i}", "same") for i in range(3000)] + [(i, None, None) for i in range(5000, 5300)] + [(i, "u", f"page {i} " * (i % 50)) for i in range(6000, 6700)]
    rows += [(None, "n", "same"), (7, "u7", "same"), (2999, "again", "same"), (6001, "u", "page 6001 ")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    want = sorted(((i, len(h or ""), "response" if i == best[h or ""] else "revisit", None if i == best[h or ""] else best[h or ""], h or "") for i, _, h in rows), key=repr)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        archive = warc.write_archive(pages, f"{tmp_path}/it's an archive")
        assert archive.payloads(spark).count() == len(best) == archive.dealt_payloads(spark).distinct().count()
        for opened in (archive, warc.Archive(archive.path)):
            found = warc.read_records(spark, opened)
            got = [(r.page_id, len(r.payload), r.record_type, r.refers_to, bytes(r.payload).decode()) for r in found.collect()]
            assert sorted(got, key=repr) == want
            assert warc.read_checked(spark, opened).where("payload_bytes is not null").count() == len(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_missing_payload(spark, tmp_path):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "a"), (2, "v", "b")], "page_id long, url string, html string"), str(tmp_path / "a"))
    archive.payloads(spark).where("payload = cast('a' as binary)").write.parquet(f"{tmp_path}/c/payloads")
    archive.headers(spark).write.parquet(f"{tmp_path}/c/headers")
    with pytest.raises(Exception, match="no payload with digest"):
        warc.read_records(spark, warc.Archive(f"{tmp_path}/c")).collect()
