"""Landed files keep all their rows, however many partitions wrote them."""

import pytest

from lodestory.plans import all_oracles, all_queries, scans
from tests.compare import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["A4_scan_catalog_json", "A7_scan_feed_items"])
def test_many_partitions_write_the_files(spark, monkeypatch, name):
    monkeypatch.setattr(scans, "PAYLOAD_MODELS", 9, raising=False)
    monkeypatch.setattr(scans, "FEED_ITEMS", 20, raising=False)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "32"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = spark_rows(all_queries()[name](spark, SF))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == duck_rows(connect(SF), all_oracles()[name])
