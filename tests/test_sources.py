import numpy as np
import pytest
from pyspark.sql import functions as F

from plurigrade.sources import arrays, matrix, sinks


def _write(tmp_path, text, name="m.tsv"):
    p = tmp_path / name
    p.write_bytes(text.encode())
    return str(p)


def test_matrix_is_transposed(spark, tmp_path):
    got = matrix.read_matrix(spark, _write(tmp_path, "c1\tc2\ng1\t1\t0\ng2\t0\t2.5\r\n")).collect()
    assert sorted((r.cell_id, r.feature, r.value) for r in got) == [("c1", "g1", 1.0), ("c2", "g2", 2.5)]


@pytest.mark.parametrize("text", ["c1\tc2\ng1\t1\n", "c1\tc2\ng1\t1\tx\n", "c1\tc1\ng1\t1\t2\n", "c1\tc2\ng1\t1\t2\ng1\t1\t2\n", "c1\tc2\ng1\t1\t\n"])
def test_broken_matrices_fail(spark, tmp_path, text):
    with pytest.raises(Exception):  # noqa: B017
        matrix.read_matrix(spark, _write(tmp_path, text)).collect()


def test_pairs_keep_the_last(spark, tmp_path):
    assert dict(matrix.read_pairs(spark, _write(tmp_path, "a\tx\nb\ty\na\tz\n")).collect()) == {"a": "z", "b": "y"}
    assert [r[0] for r in matrix.read_lines(spark, _write(tmp_path, "p\n\nq\n", "l")).collect()] == ["p", "q"]


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "w.npz", a=np.array([[1.5, 2.0]], dtype=np.float32), b=np.array([3], dtype=np.int64))
    got = {r.name: (r.dtype, r.shape, r.data) for r in arrays.read_arrays(spark, str(tmp_path / "w.npz")).collect()}
    assert got == {"a": ("float32", [1, 2], [1.5, 2.0]), "b": ("int64", [1], [3.0])}
    arrays.write_array(np.arange(3.0), str(tmp_path / "x.npy"))
    assert arrays.read_arrays(spark, str(tmp_path / "x.npy")).first().data == [0.0, 1.0, 2.0]
    with pytest.raises(ValueError):
        arrays.write_array(np.array(["x"]), str(tmp_path / "y.npy"))


def test_results_round_trip(spark, tmp_path):
    schema = "cell_idx long, cell_id string, score double, potency string, relative double, preknn_score double, preknn_potency string"
    rows = [(0, "b", 0.25, "Unipotent", 0.0, 1e-5, "Unipotent"), (1, "a", None, None, None, None, "Totipotent")]
    path = str(tmp_path / "out")
    sinks.write_results(spark.createDataFrame(rows, schema), path, single=True)
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert text == "\tscore\tpotency\trelative\tpreknn_score\tpreknn_potency\nb\t0.25\tUnipotent\t0.0\t1e-05\tUnipotent\na\t\t\t\t\tTotipotent\n"
    got = matrix.read_results(spark, path).orderBy("row").collect()
    assert [tuple(r) for r in got] == [(1, "b", 0.25, "Unipotent", 0.0, 1e-5, "Unipotent"), (2, "a", None, None, None, None, "Totipotent")]


@pytest.mark.parametrize("line", ["a\t1\tx\t1\t1", "\t1\tx\t1\t1\tx", "a\t1\tx\t1\t1\tx\na\t1\tx\t1\t1\tx", "a\tinf\tx\t1\t1\tx", "a\tq\tx\t1\t1\tx"])
def test_broken_results_fail(spark, tmp_path, line):
    with pytest.raises(Exception):  # noqa: B017
        matrix.read_results(spark, _write(tmp_path, "\ta\tb\tc\td\te\n" + line + "\n")).collect()


def test_stages(spark, tmp_path):
    stages = sinks.Stages(str(tmp_path))
    assert stages.keep("one", spark.range(3)).count() == 3 and stages.line().startswith('STAGE_TIMINGS {"one"')
    assert sinks.Stages().keep("x", spark.range(2)).count() == 2


def test_model_order_and_gene_sets(spark):
    m = spark.createDataFrame([('{"model_order": ["b", "a"]}',)], "value string")
    assert matrix.model_order(m).collect() == [(0, "b"), (1, "a")]
    w = spark.createDataFrame([(0, 0, 0, 5, 0.5), (0, 0, 1, 5, -0.1)], "model int, layer int, k int, feature_idx int, weight double")
    assert arrays.gene_sets(w).collect() == [(0, 0, 0, 5)]
    assert w.where(F.lit(False)).count() == 0


def test_assets_folder_is_the_configured_one_or_the_first_there_is(tmp_path):
    from plurigrade.sources.arrays import assets_dir

    assert assets_dir("/configured") == "/configured"
    assert assets_dir(None, (str(tmp_path / "none"), str(tmp_path))) == str(tmp_path)
    assert assets_dir(None, (str(tmp_path / "none"),)) is None


def test_weights_become_model_tables(spark, tmp_path):
    from plurigrade.sources import weights

    r = np.random.RandomState(6)
    (tmp_path / "models").mkdir()
    made = {}
    for m, name in enumerate(("b", "a")):
        files = {}
        for y in range(2):
            files |= {f"layers.{y}.weight": r.randn(7, 3).astype("float32"), f"layers.{y}.maxrank": np.array([0.25 * y], dtype="float32"), f"layers.{y}.out.bias": np.array([y - 1.0], dtype="float32")}
            files |= {f"layers.{y}.{f}": r.rand(6).astype("float32") for f in ("batchnorm.running_mean", "batchnorm.running_var", "out.weight")}
        np.savez(tmp_path / "models" / f"{name}.npz", **files)
        made[m] = files
    np.savez(tmp_path / "graph.npz", indices=np.array([[0, 1, 0, 2], [1, 2, 1, 0]]), values=np.array([5.0, 2.0, 3.0, 0.0], dtype="float32"), shape=np.array([7, 7]))
    order = spark.createDataFrame([(0, "b"), (1, "a")], "position int, model string")
    weights.convert(spark, str(tmp_path / "models"), str(tmp_path / "graph.npz"), order, str(tmp_path / "out"))
    got = weights.load(spark, str(tmp_path / "out"))
    members = {(q.model, q.layer, q.feature_idx, q.k) for q in got["geneset"].collect()}
    assert members == {(m, y, int(f), int(k)) for m, files in made.items() for y in range(2) for f, k in zip(*np.nonzero(files[f"layers.{y}.weight"] > 0), strict=True)}
    assert {(q.model, q.layer): (q.maxrank, q.bias) for q in got["head"].collect()} == {(m, y): (0.25 * y, y - 1.0) for m in made for y in range(2)}
    for q in got["weight"].collect():
        files = made[q.model]
        assert (q.rm, q.rv, q.ow) == tuple(float(files[f"layers.{q.layer}.{f}"][q.j]) for f in ("batchnorm.running_mean", "batchnorm.running_var", "out.weight"))
    assert sorted(tuple(q) for q in got["background"].collect()) == [(0, 1, 3.0), (1, 2, 2.0)]
    with pytest.raises(Exception, match="no such model"):
        weights.model_tables(spark, str(tmp_path / "models"), order.where("position = 0"))["head"].collect()
