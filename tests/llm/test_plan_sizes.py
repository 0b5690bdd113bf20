import pytest

from trellis.llm import common, kneser_ney

MOST = 40


@pytest.fixture
def exchanges(monkeypatch):
    """How many exchanges each written table's plan has, by what it is."""
    found: dict[str, int] = {}

    def counting(df, what, **options):
        found[what] = max(found.get(what, 0), df._jdf.queryExecution().executedPlan().toString().count("Exchange"))
        return common.kept(df, what, **options)

    monkeypatch.setattr(kneser_ney, "kept", counting)
    return found


def test_the_driver_never_holds_the_plan_of_all_orders(spark, tiny, exchanges):
    docs, labels = (spark.read.parquet(f"{tiny}/{name}.parquet") for name in ("documents", "labels"))
    assert kneser_ney.classified(docs, labels).count() == docs.count()
    assert max(exchanges.values()) <= MOST, exchanges
