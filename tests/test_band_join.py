"""A crowded band joins in blocks, to the same pairs."""

from lodestory.plans import all_oracles, all_queries, news
from tests.compare import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


def test_crowded_bands_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(news, "BAND_ROWS", 3, raising=False)
    df = all_queries()["C8_join_time_band"](spark, SF)
    assert "block" in df._jdf.queryExecution().optimizedPlan().toString()
    assert spark_rows(df) == duck_rows(connect(SF), all_oracles()["C8_join_time_band"])
