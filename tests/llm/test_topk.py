import math

import numpy as np

from genoweave.llm import topk
from genoweave.llm.topk import ImpactIndex, integer_vectors, op3_impact_ordered_topk, top_k


def brute(rows, k=10):
    good = {(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q, x in good:
        if q % 100 == 0:
            best = sorted(((-sum(a * b for a, b in zip(x, y)), i) for i, y in good if i != q and len(y) == len(x)))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def write(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_supplied_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in op3_impact_ordered_topk(spark, sf_dir).collect()) == brute(rows)


def test_edges(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6) / 2]) for i in range(260)]  # many ties
    rows += [(300, None), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (500, [float("nan")] * 6), (600, [float("inf")] * 6), (700, []), (None, [1.0] * 6), (800, [1.0, 2.0]), (801, [1.0, 2.0])]
    rows += rows[:5]
    sf = write(spark, tmp_path, [(*r, 1) for r in rows])
    assert sorted(tuple(r) for r in op3_impact_ordered_topk(spark, sf).collect()) == brute(rows)


def test_empty(spark, tmp_path):
    assert op3_impact_ordered_topk(spark, write(spark, tmp_path, [])).count() == 0


def test_rounds_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERIES", 4)
    monkeypatch.setattr(topk, "QUERY_ROUND", 2)
    rng = np.random.default_rng(1)
    df = integer_vectors(spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(90)], "vec_id long, embedding array<float>"), "embedding")
    got = sorted(tuple(r) for r in top_k(df, df.filter("vec_id % 3 = 0"), "vec_id", "embedding", 5).collect())
    all_ = {r.vec_id: np.array(r.embedding) for r in df.collect()}
    want = []
    for q in range(0, 90, 3):
        best = sorted((-int(all_[q] @ y), i) for i, y in all_.items() if i != q)[:5]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)


def test_index_is_exact_and_stops_early():
    rng = np.random.default_rng(2)
    base = rng.integers(-400, 400, (5000, 16))
    base[:50] *= 8
    index = ImpactIndex(np.arange(5000), base)
    for _ in range(20):
        q = rng.integers(-300, 300, 16)
        ids, scores = index.search(q, -1, 10)
        order = np.lexsort((np.arange(5000), -(base @ q)))[:10]
        assert ids.tolist() == order.tolist() and scores.tolist() == (base @ q)[order].tolist()
        assert index._possible(q, np.ones(5000, bool), 10).size < 5000
    assert 0 < index.read < 0.7 * index.postings
    big = ImpactIndex(np.arange(60), rng.integers(-(1 << 40), 1 << 40, (60, 3)))
    assert big.search(np.array([1 << 40] * 3), 0, 5)[1][0] == max(int(sum(int(v) << 40 for v in row)) for row in big.x[1:])


def test_shares_on_supplied_vectors(spark, sf_dir):
    """Shares of postings read and of vectors rescored on the supplied vectors, as README states them."""
    data = integer_vectors(spark.read.parquet(f"{sf_dir.rsplit('/', 1)[0]}/sf0.1/embeddings.parquet"), "embedding").collect()
    ids, x = np.array([r.vec_id for r in data]), np.array([r.embedding for r in data])
    index, rescored, queries = ImpactIndex(ids, x), 0, np.flatnonzero(ids % 100 == 0)
    for i in queries:
        rescored += index._possible(x[i], ids != ids[i], 10).size
    assert index.postings == x.size * len(queries)
    assert 0.7 < index.read / index.postings < 0.9
    assert 0.8 < rescored / (len(ids) * len(queries)) < 0.95
