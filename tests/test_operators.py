import numpy as np
import pytest
from pyspark.sql import functions as F

from plurigrade.operators import binning, compare, diffusion, ensemble, features, mapping, neighbours, normalise, partition


def test_average_ranks_with_zeros_and_negatives(spark):
    df = spark.createDataFrame([("a", 0, 5.0), ("a", 2, 3.0), ("a", 4, 3.0), ("b", 0, -1.0), ("b", 1, 2.0)], "cell_id string, feature_idx int, value double")
    got = {(r.cell_id, r.feature_idx): (r.rk, r.zero_rank) for r in normalise.normalised(df, 5).collect()}
    assert got == {("a", 0): (1.0, 4.5), ("a", 2): (2.5, 4.5), ("a", 4): (2.5, 4.5), ("b", 0): (5.0, 3.0), ("b", 1): (1.0, 3.0)}


def test_zero_block_rank(spark):
    df = spark.range(400).select(F.lit("a").alias("cell_id"), F.col("id").cast("int").alias("feature_idx"), (F.col("id") + 1.0).alias("value"))
    assert normalise.normalised(df, 988).first().zero_rank == 694.5


def test_cells_without_total(spark):
    cells = spark.createDataFrame([("a",), ("b",)], "cell_id string")
    expr = spark.createDataFrame([("a", 0, 1.0)], "cell_id string, feature_idx int, value double")
    assert normalise.without_total(cells, expr).collect() == [("b",)]


def test_dispersion_of_equal_and_absent_features(spark):
    lg = spark.createDataFrame([("a", 0, 2.0), ("b", 0, 2.0), ("a", 1, 3.0)], "cell_id string, feature_idx int, lg double")
    listed = spark.createDataFrame([(0,), (1,), (2,)], "feature_idx int")
    assert dict(features.dispersion(lg, listed, 2).select("feature_idx", "disp").collect()) == {0: 0.0, 1: 1.5, 2: 0.0}


def test_alias_needs_a_free_target(spark):
    names = spark.createDataFrame([("A_x",), ("A_y",), ("y",), ("z",)], "name string")
    alias = spark.createDataFrame([("A_x", "x"), ("A_y", "y"), ("z", "w")], "alias string, target string")
    listed = spark.createDataFrame([("x", 0), ("y", 1), ("z", 2)], "feature string, feature_idx int")
    assert dict(mapping.alias_names(names, alias, listed).collect()) == {"A_x": "x", "A_y": "A_y", "y": "y", "z": "z"}


def test_alignment_rejects_two_inputs_for_one_feature(spark):
    expr = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 2.0)], "cell_id string, feature string, value double")
    listed = spark.createDataFrame([("x", 0)], "feature string, feature_idx int")
    with pytest.raises(Exception, match="two inputs"):
        mapping.aligned(expr, listed).collect()


def test_statistics_of_nearly_constant_rows_do_not_cancel(spark):
    lg = spark.createDataFrame([(1, j, 3.1) for j in range(1000)] + [(2, j, 1e6 + j % 2 * 1e-3) for j in range(1000)], "cell_id int, feature_idx int, lg double")
    got = {r.cell_id: r for r in normalise.row_statistics(lg, 1000).collect()}
    assert got[1].sd is None and got[2].sd == pytest.approx(5e-4, rel=1e-6)
    disp = {r.feature_idx: r.disp for r in features.dispersion(lg.where("cell_id = 2").selectExpr("feature_idx as cell_id", "0 as feature_idx", "lg"), spark.createDataFrame([(0,)], "feature_idx int"), 1000).collect()}
    assert 0 <= disp[0] == pytest.approx(2.5e-7 / 1e6, rel=1e-6)


def test_batches_have_their_own_dispersion(spark):
    lg = spark.createDataFrame([(0, 1, 0, 1.0), (0, 2, 0, 3.0), (1, 3, 0, 2.0), (1, 4, 1, 5.0)], "batch int, cell_id int, feature_idx int, lg double")
    listed = spark.createDataFrame([(0,), (1,), (2,)], "feature_idx int")
    sizes = spark.createDataFrame([(0, 2), (1, 4)], "batch int, n long")
    disp = features.batch_dispersion(lg, listed, sizes)
    got = {(r.batch, r.feature_idx): r.disp for r in disp.collect()}
    assert got == {(0, 0): pytest.approx(0.5), (0, 1): 0.0, (0, 2): 0.0, (1, 0): pytest.approx(1.5), (1, 1): pytest.approx(3.75), (1, 2): 0.0}
    top = {(r.batch, r.feature_idx): r.at for r in features.batch_top_dispersed(disp, 2).collect()}
    assert top == {(0, 0): 0, (0, 1): 1, (1, 0): 0, (1, 1): 1}


def test_blocks_embed_as_dense_rows_do(spark, monkeypatch):
    r = np.random.RandomState(3)
    x = r.rand(300, 40) @ np.diag(np.linspace(3, 0.1, 40))
    x[x < 0.4] = 0
    rows = spark.createDataFrame([(i % 2, i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(x)], "batch int, cell_id int, at array<int>, lg array<double>")
    a = {q.cell_id: q.x for q in neighbours.embedded(rows, 40, 8).collect()}
    from plurigrade.operators.neighbours import _embedding_by_blocks

    for batch in (0, 1):
        frame = rows.where(f"batch = {batch}").toPandas().sort_values("cell_id")
        b = _embedding_by_blocks(frame, 40, 8, 14)
        assert np.allclose(b, np.array([a[i] for i in frame["cell_id"]]), atol=1e-7)


def test_digests_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"\x00one")
    (tmp_path / "b.bin").write_bytes(b"two")
    got = {r.path.rsplit("/", 1)[-1]: r.sha256 for r in compare.file_digests(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert got == {"a.bin": hashlib.sha256(b"\x00one").hexdigest(), "b.bin": hashlib.sha256(b"two").hexdigest()}


def test_last_triple_wins_and_zeros_go(spark):
    t = spark.createDataFrame([(1, 0, 0, 5.0), (2, 0, 0, 0.0), (1, 0, 1, 0.0), (3, 0, 1, 2.0)], "seq int, r int, c int, v double")
    assert ensemble.last_triples(t).collect() == [(0, 1, 2.0)]


def test_kernel_agrees_with_joins(spark):
    from plurigrade.plans import catalog

    sf = "/root/testdata/sf0.001"
    a = {r.cell_id: r for r in catalog._kernel(spark, sf).collect()}
    b = {r.cell_id: r for r in ensemble.ensemble_means(ensemble.model_predictions(catalog._logits(spark, sf))).collect()}
    assert a.keys() == b.keys()
    for c in a:
        assert a[c].category == b[c].category and a[c].order_score == pytest.approx(b[c].order_score, abs=1e-9)


def test_array_split_and_permutation(spark):
    n = [r.chunk for r in spark.range(1003).select(partition.chunk_of(F.col("id"), 1003, 4).alias("chunk")).collect()]
    assert np.bincount(n).tolist() == [251, 251, 251, 250] and n == sorted(n)
    got = [r.cell_idx for r in partition.permutation(spark, 10, 14).orderBy("pos").collect()]
    assert got == [3, 9, 0, 5, 4, 2, 1, 7, 6, 8]
    assert [partition.batch_count(*x) for x in ((999, 10), (1000, 2000), (10_001, 10_000))] == [1, 1, 2]


def test_diffusion_stops_at_its_fixed_point():
    r = np.random.RandomState(5)
    a = diffusion.transitions(diffusion.correlations(r.rand(40, 25)))
    x0 = r.rand(40)
    x, n = diffusion.fixed_point(a, x0)
    exact = np.linalg.solve(np.eye(40) - 0.9 * a, 0.1 * x0)
    assert n < 200 and np.abs(x - exact).max() < 1e-4
    assert (np.diag(a) == 0).all() and (a.sum(axis=1) < 1).all()


def test_diffusion_of_constant_rows():
    x = np.vstack([np.ones(6), np.random.RandomState(1).rand(3, 6)])
    a = diffusion.transitions(diffusion.correlations(x))
    assert np.isfinite(a).all() and (a[0] == 0).all()


def test_binning_of_small_classes(spark):
    df = spark.createDataFrame([(0, 1, 0, 0.3), (0, 2, 0, 0.1), (0, 3, 4, 0.9)], "batch int, cell_id int, category int, smooth double")
    got = {r.cell_id: r.binned for r in binning.rank_binned(df).collect()}
    assert got[2] == pytest.approx(1e-8) and got[1] == pytest.approx(1 / 6 - 1e-8) and got[3] is None


def test_relative_of_missing_and_constant(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, None), (4, float("nan"))], "cell_id int, score double")
    assert dict(binning.relative(df).select("cell_id", "relative").collect()) == {1: 0.0, 2: 1.0, 3: None, 4: None}
    assert binning.relative(df.where("cell_id = 1")).first().relative is None


def _brute(ids, x, s, k):
    out = {}
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        d = d / d.max()
        near = sorted(range(len(ids)), key=lambda j: (round(d[j], 9), ids[j]))[:k]
        part = lambda v: next((c for c in range(6) if round(v, 9) <= (c + 1) / 6), -1)
        m = next((m for m in range(2, k // 2 + 1) if part(np.mean([s[j] for j in near[:m]])) == part(np.mean([s[j] for j in near[m : 2 * m]]))), 2)
        w = [(1 - d[j]) ** 2 for j in near[: 2 * m]]
        out[ids[i]] = (2 * m, sum(a * s[j] for a, j in zip(w, near, strict=False)) / sum(w))
    return out


def test_knn_kernel_against_brute_force():
    r = np.random.RandomState(2)
    ids, x, s = np.arange(150)[::-1].copy(), r.rand(150, 5).round(1), r.rand(150)
    keep, score = neighbours.smooth_batch(ids, x, s, 30, block=64)
    want = _brute(ids.tolist(), x, s, 30)
    assert [want[i][0] for i in ids.tolist()] == keep.tolist()
    assert np.allclose([want[i][1] for i in ids.tolist()], score)


def test_consensus_of_missing_scores(spark):
    r = np.random.RandomState(7)
    ids, x, s = np.arange(40), r.rand(40, 3), r.rand(40)
    s[[3, 9, 20]] = np.nan
    keep, _ = neighbours.smooth_batch(ids, x, s, 12)
    rows = spark.createDataFrame([(0, int(i), v.tolist()) for i, v in enumerate(x)], "batch int, cell_id int, x array<double>")
    known = spark.createDataFrame([(int(i), None if np.isnan(v) else float(v)) for i, v in enumerate(s)], "j int, s double")
    near = neighbours.knn(rows, 12).join(known, "j")
    got = {q.i: q.keep for q in neighbours.consensus(near).collect()}
    part = lambda v: -1 if np.isnan(v) else next(c for c in range(6) if round(v, 9) <= (c + 1) / 6)
    for i in range(40):
        d = ((x - x[i]) ** 2).sum(axis=1)
        t = s[np.argsort(d, kind="stable")[:12]]
        m = next((m for m in range(2, 7) if part(t[:m].mean()) == part(t[m : 2 * m].mean())), 2)
        assert got[i] == keep[i] == 2 * m


def test_missing_scores_spread():
    r = np.random.RandomState(2)
    s = r.rand(120)
    s[3] = np.nan
    _, score = neighbours.smooth_batch(np.arange(120), r.rand(120, 4), s, 30)
    assert np.isnan(score[3]) and not np.isnan(score).all()


@pytest.mark.parametrize(("n", "f"), [(128, 70), (12, 9), (96, 8), (60, 100)])
def test_embedding_keeps_distances(n, f):
    x = np.random.RandomState(1729).rand(n, f)
    c = x - x.mean(axis=0)
    e = neighbours.embedding(x, 30)
    u, d, _ = np.linalg.svd(c, full_matrices=False)
    k = min(30, n - 1)
    want = (u * d)[:, :k]
    gap = lambda a: ((a[:, None] - a[None]) ** 2).sum(axis=2)
    assert e.shape == (n, k) and np.allclose(gap(e), gap(want), atol=1e-8)
    assert (e[np.abs(e).argmax(axis=0), np.arange(k)] >= 0).all()


def test_axes_of_distributed_rows(spark):
    r = np.random.RandomState(3)
    x = r.rand(130, 60) @ np.diag(np.linspace(3, 0.1, 60))
    x[x < 0.4] = 0
    rows = spark.createDataFrame([(i, np.flatnonzero(v).tolist(), v[v != 0].tolist()) for i, v in enumerate(x)], "cell_id int, at array<int>, lg array<double>").repartition(3)
    a = {q.cell_id: q.x for q in neighbours.embedded_at_large(rows, 60, 10).collect()}
    b = {q.cell_id: q.x for q in neighbours.embedded(rows.selectExpr("0 as batch", "*"), 60, 10).collect()}
    a, b = (np.array([e[i] for i in range(130)]) for e in (a, b))
    gap = lambda e: ((e[:, None] - e[None]) ** 2).sum(axis=2)
    assert a.shape == b.shape == (130, 10) and np.allclose(gap(a), gap(b), atol=1e-7)


def test_axes_that_do_not_converge_fail(spark):
    x = np.random.RandomState(3).rand(80, 70)
    rows = spark.createDataFrame([(i, list(range(70)), v.tolist()) for i, v in enumerate(x)], "cell_id int, at array<int>, lg array<double>")
    with pytest.raises(ArithmeticError):
        neighbours.principal_axes(rows, 70, 10, steps=1)


def test_embedding_rejects_bad_rows():
    x = np.random.rand(10, 4)
    x[2] = np.nan
    with pytest.raises(ValueError):
        neighbours.embedding(x, 3)


def test_comparison_counts_masks_tolerance_and_labels(spark):
    schema = "cell_id string, score double, relative double, preknn_score double, potency string, preknn_potency string"
    a = spark.createDataFrame([("c1", 0.1, 0.0, 0.2, "x", "x"), ("c2", None, 0.5, 0.2, None, "x"), ("c3", 0.5, 1.0, 0.2, "y", "x")], schema)
    b = spark.createDataFrame([("c1", 0.1, 0.0, 0.2, "x", "x"), ("c2", 0.4, 0.5, 0.2, "x", "x"), ("c3", 0.7, 1.0, 0.2, "y", "x")], schema)
    m = {r.name: r for r in compare.compared(a, b).collect()}
    assert (m["score"].n, m["score"].n_mask_mismatch, m["score"].n_outside) == (2, 1, 1) and m["score"].max_abs_delta == pytest.approx(0.2)
    assert m["potency"].n_mismatch == 1 and m["preknn_potency"].n_mismatch == 0
    assert compare.verdict(compare.compared(a, a), True) and not compare.verdict(compare.compared(a, b), True)
    with pytest.raises(Exception, match="stands twice"):
        compare.compared(a, b.unionByName(b.limit(1))).collect()
    assert compare.spearman(a, a, "score").first().rho == pytest.approx(1.0)
    assert compare.spearman(a, a, "preknn_score").first().rho is None
