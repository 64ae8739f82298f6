"""The index and its search hold a bounded part of a task's documents and terms at once."""

import glob
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import lodestory.llm.signature_search as G
from lodestory.llm.shared import scratch


def test_row_groups_hold_a_few_blocks(spark):
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 30, 2000))) for i in range(1600)]
    path = scratch(spark)
    index = G.write_signature_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).orderBy("doc_id"), path)
    groups = []
    for f in glob.glob(f"{path.removeprefix('file:')}/*.parquet"):
        m = pq.ParquetFile(f).metadata
        groups += [m.row_group(k).total_byte_size for k in range(m.num_row_groups)]
    assert sum(groups) > 48 << 20 and index.count() > 1
    blocks = index.selectExpr("max(size(ids))").first()[0]
    assert blocks <= 1000 and max(groups) <= 48 << 20 and len(groups) == index.count()


def test_short_documents_make_several_blocks(spark):
    docs = [(i, f"a{i % 7}") for i in range(12_000)]
    index = G.write_signature_index(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), scratch(spark))
    assert max(r[0] for r in index.selectExpr("size(ids)").collect()) < 2 * G.BLOCK_DOCS


def test_bounds_of_many_terms_and_documents_fit():
    rng = np.random.default_rng(2)
    texts = [" ".join(f"t{x}" for x in rng.integers(0, 3000, 3)) for _ in range(8000)]
    row = G.index_block(pa.array(range(len(texts))), pa.array(texts))
    items = [sorted({f"t{x}" for x in rng.integers(0, 3000, 10)}) for _ in range(400)] + [sorted(f"t{x}" for x in range(3000))]
    q = G.Queries(list(range(len(items))), items, {f"t{x}": 1 + x % 5 for x in range(3000)})
    block, best = G.Block(row, len(texts), 3 * len(texts)), G.Best(len(items), 5)
    tracemalloc.start()
    G.search_block(block, q, best)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    # every score, one document after another
    held = [Counter(t.split()) for t in texts]
    for i in (0, 7, 399, 400):
        terms = set(items[i])
        m = 50 + (50 * 3 * len(texts)) // (3 * len(texts))
        score = [(-sum((1 + int(t[1:]) % 5) * ((10**9 * c) // (1000 * c + 20 * m)) for t, c in h.items() if t in terms), d) for d, h in enumerate(held)]
        assert [(-s, d) for s, d in sorted(score)[:5] if s] == [(int(s), int(d)) for s, d in zip(best.score[i], best.ids[i], strict=True)]
