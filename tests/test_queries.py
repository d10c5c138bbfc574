"""Registered queries against DuckDB at the smallest size, and the flagship's invariants."""

import duckdb
import numpy as np
import pytest

from plurigrade.operators import mapping, partition
from plurigrade.plans import catalog, fixtures, potency
from plurigrade.settings import Settings

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
SF = "/root/testdata/sf0.001"
#: Queries over chunks of cells, whose SQL is compared at the next size too.
LARGER = ("top_features", "chunk_correlation", "markov_matrix", "diffusion_fixed_steps", "pca_distance", "knn30", "shortest_consensus")


def connected(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize(("name", "sf"), [(n, SF) for n in sorted(catalog.oracle_sql())] + [(n, "/root/testdata/sf0.01") for n in LARGER])
def test_query(spark, name, sf):
    con = connected(sf)
    df = catalog.queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_permutation_queries(spark):
    n = catalog._cells(spark, SF).count()
    order = np.arange(n)
    np.random.RandomState(14).shuffle(order)
    assert [r.cell_idx for r in catalog.seeded_permutation(spark, SF).orderBy("pos").collect()] == order.tolist()
    sf = "/root/testdata/sf0.01"
    rows = catalog.batched_cells(spark, sf).collect()
    order = np.arange(len(rows))
    np.random.RandomState(14).shuffle(order)
    at = {int(c): k for k, part in enumerate(np.array_split(order, -(-len(rows) // 40))) for c in part}
    assert {r.cell_idx: r.batch for r in rows} == at and len(set(at.values())) == 3


def test_permutation_in_slices(spark, monkeypatch):
    monkeypatch.setattr(partition, "SLICE", 7)
    got = [r.cell_idx for r in partition.permutation(spark, 30, 3).orderBy("pos").collect()]
    order = np.arange(30)
    np.random.RandomState(3).shuffle(order)
    assert got == order.tolist() and partition.permutation(spark, 0, 3).count() == 0


def test_diffusion_to_its_fixed_point(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.cell_id: r for r in catalog.diffusion_fixed_point(spark, sf).collect()}
    ids = sorted(got)
    a = np.zeros((len(ids), len(ids)))
    for r in catalog.markov_matrix(spark, sf).collect():
        a[ids.index(r.i), ids.index(r.j)] = r.w
    exact = np.linalg.solve(np.eye(len(ids)) - 0.9 * a, 0.1 * np.array([i % 10 / 10 for i in ids]))
    assert len({r.rounds for r in got.values()}) == 1 and 1 < got[ids[0]].rounds < 300
    assert np.abs(np.array([got[i].smooth for i in ids]) - exact).max() < 2e-5


def test_leading_components_against_svd(spark):
    rows = sorted((r.cell_id, r.x) for r in fixtures.points(spark, SF).collect())
    x = np.array([v for _, v in rows])
    z = (x - x.mean(axis=1, keepdims=True)) / x.std(axis=1, keepdims=True)
    u, d, _ = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    e = (u * d)[:, :30]
    want = np.sqrt(((e[1:] - e[:-1]) ** 2).sum(axis=1))
    got = {r.cell_id: r.d for r in catalog.pca30_distance(spark, SF).collect()}
    assert np.allclose([got[i] for i, _ in rows[:-1]], want, atol=2e-6)


def test_flagship(spark):
    rows = catalog.queries()["flagship_potency"](spark, SF).collect()
    assert len(rows) == 10 and {r.cell_idx for r in rows} == set(range(10))
    assert all(r.score == r.preknn_score for r in rows)  # fewer than 100 cells: no neighbours
    known = [r.relative for r in rows if r.relative is not None]
    assert not known or (min(known) == 0 and max(known) == 1)


def test_flagship_in_batches(spark):
    expr = fixtures.expression(spark, "/root/testdata/sf0.01")
    listed = mapping.feature_list(expr)
    settings = Settings(batch_size=50, smooth_batch_size=20, least_for_batches=50, least_for_smoothing=40)
    rows = potency.score(expr, listed, fixtures.model(spark, listed), fixtures.SETS, settings).collect()
    assert len(rows) == 100 and len({r.cell_id for r in rows}) == 100
    assert sum(r.score is not None for r in rows) > 50
