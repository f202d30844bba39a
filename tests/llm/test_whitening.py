import math
import random

import numpy as np
from pyspark.sql import Row

from trailmark.llm import whitening
from trailmark.llm.queries import op13_embedding_whitening
from trailmark.llm.whitening import whiten

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, row int, `index` int"


def brute(rows):
    """(id, component) -> n, deviation, whitened up to sign, explained; the grid by its definition."""
    valid = [
        (i, tuple(math.floor(256 * float(np.float32(c))) for c in v))
        for i, v in rows
        if v and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = sorted({x for _, x in valid})
    n, sums = len(fit), [sum(column) for column in zip(*fit)]
    centred = np.array(fit, float) - np.array(sums, float) / n
    covariance = centred.T @ centred / n
    values, directions = np.linalg.eigh(covariance)
    out = []
    for i, x in valid:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        for k in range(min(4, len(x))):
            e, u = values[-1 - k], directions[:, -1 - k]
            w = abs((np.array(x) - np.array(sums) / n) @ u / math.sqrt(e))
            out.append((i, k + 1, n, deviation, w, e / covariance.trace()))
    return out


def vectors(rng, n, dimensions):
    axes = [[rng.gauss(0, 1) for _ in range(dimensions)] for _ in range(dimensions)]
    for _ in range(n):
        weight = [rng.gauss(0.3, 2.0 / (1 + k)) for k in range(dimensions)]
        yield [sum(w * a[d] for w, a in zip(weight, axes)) / 10 for d in range(dimensions)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, 3) for i, v in rows], SCHEMA)


def check(got, expected):
    def key(r):
        return (r[0] is None, r[0] or 0, r[1], r[3], round(r[4], 6))

    got = sorted(((r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in got), key=key)
    expected = sorted(expected, key=key)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    assert np.allclose([g[4:] for g in got], [e[4:] for e in expected], rtol=1e-9, atol=1e-9)


def test_against_numpy_with_odd_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS_PER_BLOCK", 32)  # many blocks, split among tasks
    rng = random.Random(13)
    good = list(enumerate(vectors(rng, 300, 7)))
    odd = [None, [], [1.0] * 6 + [None], [float("nan")] + [0.0] * 6, [float("inf")] * 7, [-0.0] * 7]
    copies = [(k % 3 + 500, good[0][1]) for k in range(200)]
    rows = [*good, *[(400 + k, v) for k, v in enumerate(odd)], *copies, (None, good[1][1]), (None, None)]
    frame(spark, rows).write.parquet(f"{tmp_path}/embeddings.parquet")
    result = op13_embedding_whitening(spark, str(tmp_path))
    assert result.dtypes == [
        ("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"),
        ("whitened", "double"), ("explained", "double"), ("identity_error", "double"),
    ]
    got = result.collect()
    check(got, brute(rows))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    # one sign for all rows: equal vectors have equal values
    assert len({r.whitened for r in got if r.vec_id in (0, 500, 501, 502) and r.component == 1}) == 1


def test_other_lengths_columns_and_components(spark):
    rng = random.Random(14)
    rows = [*enumerate(vectors(rng, 40, 3)), *enumerate(vectors(rng, 5, 5), 100)]
    got = whiten(frame(spark, rows), components=2)
    assert got.select("row.*").columns == ["vec_id", "embedding", "label", "x", "row", "index"]
    assert sorted({(r.row.vec_id, r.component) for r in got.collect()}) == [(i, k) for i in range(40) for k in (1, 2)]


def test_without_variance_and_without_rows(spark):
    same = whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).collect()
    assert {(r.row.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained) for r in same} == {
        (i, k, 1, 0, None, 0.0) for i in (1, 2) for k in (1, 2)
    }
    flat = whiten(frame(spark, [(k, [float(k), 0.0, 0.0]) for k in range(9)])).collect()
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and isinstance(flat[0], Row)
    assert flat[0].identity_error < 1e-9
    assert whiten(frame(spark, [])).collect() == [] and whiten(frame(spark, [(1, None)])).collect() == []


def test_too_large_entries_go(spark):
    rows = [(1, [1e38, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [1.0, 1.5])]
    assert {r.row.vec_id for r in whiten(frame(spark, rows)).collect()} == {2, 3, 4}
