"""The kNN join's contract, and the index against the exact join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusweave.operators.vector_index import build_index, choose_probes, load_index
from corpusweave.operators.vectors import knn_join, measure


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(25, 12))
    rows = [(n, n % 40, [float(x) for x in middle[n % 25] + 0.6 * rng.normal(size=12)]) for n in range(900)]
    rows += [(2000 + n, n, rows[7][2]) for n in range(300)]  # a third of one direction, more than a block
    rows += [(3000, 1, [0.0] * 12), (3001, 2, None)]
    return spark.createDataFrame(rows, "id long, doc int, embedding array<double>").repartition(4).cache()


def brute(rows, k, skip, allowed=None):
    rows = [r for r in rows if r.embedding is not None]
    unit = np.array([r.embedding for r in rows])
    length = np.linalg.norm(unit, axis=1, keepdims=True)
    unit = unit / np.where(length == 0, 1, length)
    cos, out = np.round(unit @ unit.T, 6), {}
    for i, r in enumerate(rows):
        ok = [j for j, o in enumerate(rows) if not (skip and o.doc == r.doc) and (allowed is None or o.id in allowed)]
        best = sorted(ok, key=lambda j: (-cos[i, j], rows[j].id))[:k]
        out[r.id] = [(rows[j].id, round(float(cos[i, j]), 6)) for j in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.l, r["rank"])):
        out.setdefault(r.l, []).append((r.r, r.cos))
        assert len(out[r.l]) == r["rank"]
    return out


def same(a, b):
    assert a.keys() == b.keys()
    for q in a:
        assert [x for x, _ in a[q]] == [x for x, _ in b[q]] or np.allclose([c for _, c in a[q]], [c for _, c in b[q]], atol=1.1e-6)
    return sum(len({x for x, _ in a[q]} & {x for x, _ in b[q]}) for q in a) / sum(map(len, a.values()))


def test_methods_agree_and_recall_is_measured(spark, vectors, tmp_path):
    left, right = vectors.select(F.col("id").alias("l"), "doc", "embedding"), vectors.select(F.col("id").alias("r"), "doc", "embedding")
    want = brute(vectors.collect(), 10, True)
    assert same(want, found(knn_join(left, right, 10, "l", "r", "doc", "doc", block=100))) > 0.999
    index = build_index(right, "r", "doc", block=100, path=str(tmp_path / "index"))
    assert index.sizes.sum() == 1201 and index.rows.select("r_id").distinct().count() == 1201 and index.blocks().max() > 2
    index = load_index(spark, str(tmp_path / "index"), 100)
    exact = found(knn_join(left, right, 10, "l", "r", "doc", "doc", method="cells", index=index, certain=True))
    assert same(want, exact) > 0.999
    probes = choose_probes(left, index, 10, "l", "doc", recall=0.95)
    assert 1 <= probes < len(index.sizes)
    some = found(knn_join(left, right, 10, "l", "r", "doc", "doc", method="cells", index=index, probes=probes))
    assert some.keys() == want.keys() and all(len(x) == 10 for x in some.values())
    hit = sum(len({x for x, _ in want[q]} & {x for x, _ in some[q]}) for q in want) / sum(map(len, want.values()))
    assert hit >= 0.9
    # One probe finds too little for some, and a second look finds the rest: every row has its neighbours.
    assert all(len(x) == 1100 for x in found(knn_join(left.filter("l < 3"), right, 1100, "l", "r", method="cells", index=index, probes=1)).values())


@pytest.mark.parametrize("method", [{"method": "blocks"}, {"method": "cells", "certain": True}])
def test_allow_list(spark, vectors, method):
    left, right = vectors.filter("id < 20").select(F.col("id").alias("l"), "doc", "embedding"), vectors.select(F.col("id").alias("r"), "doc", "embedding")
    allow = spark.createDataFrame([(x,) for x in (1, 2, 2, 5, 2001, 99999)], "r long")
    own = found(knn_join(left, right, 3, "l", "r", **method, allow=allow))
    assert {q: [x for x, _ in v] for q, v in own.items()} == {q: [x for x, _ in v] for q, v in brute(vectors.collect(), 3, False, {1, 2, 5, 2001}).items() if q < 20}
    assert knn_join(left, right, 3, "l", "r", **method, allow=allow.limit(0)).count() == 0
    few = allow.filter("r < 3").distinct()
    assert all(len(x) == 2 for x in found(knn_join(left, right, 50, "l", "r", **method, allow=few)).values())  # k beyond what there is
    assert knn_join(left, right, 0, "l", "r", **method).count() == 0
    assert knn_join(left, right.limit(0), 3, "l", "r", **method).count() == 0
    assert knn_join(left.limit(0), right, 3, "l", "r", **method).count() == 0


def test_vectors_that_cannot_be_searched(spark, vectors):
    right = vectors.select(F.col("id").alias("r"), "embedding")
    one = lambda v: spark.createDataFrame([(1, v)], "l long, embedding array<double>")
    for method in ("blocks", "cells"):
        with pytest.raises(ValueError, match="dimensions"):
            knn_join(one([1.0] * 3), right, 2, "l", "r", method=method)
        for bad in (float("nan"), float("inf"), 1e16, None):
            with pytest.raises(ValueError, match="component"):
                knn_join(one([bad] + [1.0] * 11), right, 2, "l", "r", method=method)
    with pytest.raises(ValueError, match="2 to 3 dimensions"):
        measure(one([1.0] * 3).union(one([1.0] * 2)))
    with pytest.raises(ValueError, match="method"):
        knn_join(one([1.0] * 12), right, 2, "l", "r", method="guess")
    named = vectors.filter("id < 30").select(F.concat(F.lit("n"), "id").alias("r"), "embedding")
    assert {type(r.r) for r in knn_join(one([1.0] * 12), named, 2, "l", "r").collect()} == {str}
