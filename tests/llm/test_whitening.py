"""Whitening against numpy."""

import numpy as np
import pytest

from turnmill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, index string, x string, whitened string, n string"


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, 0, "i", "x", "w", "n") for i, v in rows], SCHEMA)


def expected(rows, components):
    kept = [(i, v) for i, v in rows if v and len(v) == 5 and all(c is not None and np.isfinite(c) and abs(c) < 2**40 for c in v)]
    x = np.floor(np.array([v for _, v in kept], np.float32).astype(float) * 64).astype(np.int64) + 1_000_000
    fitted = np.unique(x, axis=0)
    n, sums = len(fitted), fitted.sum(0)
    centre = (n * fitted - sums) / n
    variances, directions = np.linalg.eigh(centre.T @ centre / n)
    order = np.argsort(-variances)[:components]
    order = [i for i in order if variances[i] > 1e-9]
    white = ((n * x - sums) / n) @ directions[:, order] / np.sqrt(variances[order])
    return kept, n, ((n * x - sums) ** 2).sum(1), white, variances[order] / variances.sum()


def compare(spark, rows, components=16):
    kept, n, deviations, white, explained = expected(rows, components)
    got = whitening.whiten(table_of(spark, rows), components=components).collect()
    assert len(got) == len(kept) * white.shape[1]
    assert {r.n for r in got} == {n} and all(r.identity_error < 1e-9 for r in got)
    for r in got:
        assert r.explained == pytest.approx(explained[r.component - 1], rel=1e-9)
    # A component's sign is free, but the same for all rows.
    for c in range(white.shape[1]):
        have = sorted((-1 if r.vec_id is None else r.vec_id, r.deviation, r.whitened) for r in got if r.component == c + 1)
        want = [(-1 if i is None else i, int(d)) for (i, _), d in zip(kept, deviations, strict=True)]
        sides = [sorted((*w, s * v) for w, v in zip(want, white[:, c], strict=True)) for s in (1, -1)]
        assert any(
            all(a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-8 for a, b in zip(have, side, strict=True)) for side in sides
        )


def vectors(n, seed=3):
    rnd = np.random.default_rng(seed)
    return [[float(c) for c in v] for v in rnd.normal(size=(n, 5)) * [3, 2, 1, 0.5, 0.3] + 0.7]


def test_rows_with_holes_repeats_and_hot_vectors(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 5 * 16)  # many blocks
    some = vectors(150)
    rows = list(enumerate(some)) + [(1000 + i, some[7]) for i in range(80)] + [(7, some[7]), (None, some[3])]
    odd = [None, [], [None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 5, [float("inf")] * 5, [1e30] * 5, [1.0, 2.0]]
    compare(spark, rows + [(2000 + i, v) for i, v in enumerate(odd)])


def test_columns_are_blocked_too(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 2)
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 64)
    compare(spark, list(enumerate(vectors(90))), components=3)


def test_dimensions_without_variance_give_no_component(spark):
    flat = [v[:2] + [1.0] + [v[0], v[1]] for v in vectors(40)]
    compare(spark, list(enumerate(flat)))


def test_no_rows_and_equal_rows(spark):
    assert whitening.whiten(table_of(spark, [])).count() == 0
    assert whitening.whiten(table_of(spark, [(1, None)])).count() == 0
    alike = whitening.whiten(table_of(spark, [(i, [1.0] * 5) for i in range(6)]))
    assert alike.count() == 0 and "identity_error" in alike.columns


def test_query(spark):
    got = whitening.op13(spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert got.count() == rows * 16
