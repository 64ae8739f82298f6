import corpus_pipeline
import pytest

from lodestory.llm.shared import cut
from tests.llm.test_operators import SF, brute_classes, brute_hits, brute_repeats, check_packing


@pytest.fixture(scope="module")
def pieces(spark):
    """What the stages, run one by one, cut the documents into."""
    return []


def test_stages(spark, pieces):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    stages = dict(corpus_pipeline.STAGES)
    known = cut(stages["language_id"](spark, docs, SF))
    assert known.columns == columns and known.count() >= 0.98 * docs.count()
    one = cut(stages["near_dedup"](spark, known, SF))
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == set(brute_classes(spark, known).values())
    lean = cut(stages["suffix_dedup"](spark, one, SF))
    before = brute_repeats([(r["doc_id"], r["text"]) for r in one.collect()])
    assert lean.columns == columns
    for r in lean.collect():
        n, gone, _, _ = before[r["doc_id"]]
        assert n - gone - 6 <= len(r["text"].encode()) <= n - gone and r["n_chars"] == len(r["text"])
    clean = cut(stages["decontamination"](spark, lean, SF))
    hits = {h[0] for h in brute_hits([(r["doc_id"], r["text"]) for r in lean.collect()], items) if h[-1]}
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in lean.collect()} - hits
    packed = stages["packing"](spark, clean, SF)
    rows = packed.collect()
    check_packing(rows, 2048)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in clean.collect()}
    pieces += sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)


def test_run_equals_its_stages(spark, pieces):
    if not pieces:
        test_stages(spark, pieces)
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, 2048)
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == pieces
