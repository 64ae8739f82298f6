"""Registry queries rank all of last year's models, however many there are."""

import pytest
from pyspark.sql import functions as F

from lodestory.plans import all_queries
from lodestory.plans import registry as G
from lodestory.sources.fixtures import Fixtures
from lodestory.storage import cut

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def wide(spark):
    w = cut(G.wide(Fixtures(spark, SF)))
    assert w.count() > 200
    return w


def test_registry_shows_every_model(spark, wide):
    got = all_queries()["M8_registry"](spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, wide.select(*got.columns).collect()))


def test_best_models_are_those_of_all(spark, wide):
    got = [r["id"] for r in all_queries()["M11_best_models"](spark, SF).where("view = 'overall'").collect()]
    best = wide.where("eci is not null").orderBy(F.col("eci").desc(), "id").limit(20)
    assert sorted(got) == sorted(r["id"] for r in best.collect())


def test_quadrants_hold_every_scored_model(spark, wide):
    got = all_queries()["M15_insight_frontiers"](spark, SF).where("part = 'quadrant'").count()
    assert got == wide.where("eci is not null").count() > 200
