"""The whole run against a dense rewrite in NumPy, in one batch and in several, and from a text file."""

import numpy as np
import pytest

from plurigrade.operators import ensemble, mapping
from plurigrade.plans import fixtures, potency, run
from plurigrade.settings import CATEGORIES, Settings
from plurigrade.sources import matrix

SF = "/root/testdata/sf0.01"


def split(n, parts):
    return np.array_split(np.arange(n), parts)


def shuffled(n, seed):
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    return order


def average_rank(row):
    """Average descending ranks."""
    s = np.sort(-row)
    return (np.searchsorted(s, -row, "left") + np.searchsorted(s, -row, "right") + 1) / 2


def part_of(v):
    return next((c for c in range(6) if v <= (c + 1) / 6), -1) if v is not None and not np.isnan(v) else -1


def ensemble_scores(rank, lg, model):
    heads = {(r.model, r.layer): r for r in model["head"].collect()}
    graph = np.zeros((lg.shape[1], lg.shape[1]))
    for r in model["background"].collect():
        graph[r.r, r.c] = r.v
    member, weight = {}, {}
    for r in model["geneset"].collect():
        member.setdefault((r.model, r.layer, r.k), []).append(r.feature_idx)
    for r in model["weight"].collect():
        weight[r.model, r.layer, r.j] = r
    models, layers = sorted({m for m, _ in heads}), sorted({y for _, y in heads})
    prob = np.empty((len(lg), len(models), len(layers)))
    for m in models:
        for y in layers:
            own = {k: np.array(f) for (a, b, k), f in member.items() if (a, b) == (m, y)}
            top = max(map(len, own.values())) + 10 + max(heads[m, y].maxrank, 0) * 1000
            z = np.full(len(lg), heads[m, y].bias)
            for k, f in own.items():
                n, gs = len(f), graph[f].sum(axis=0)
                score = 1 - (np.minimum(rank[:, f], top).sum(axis=1) - n * (n + 1) / 2) / (n * top)
                diff = lg[:, f].sum(axis=1) / n - lg @ gs / gs.sum()
                for j, x in ((k, score), (k + len(own), diff)):
                    w = weight[m, y, j]
                    z += (x - w.rm) / np.sqrt(w.rv + 1e-5) * w.ow
            prob[:, m, y] = z
    prob = np.exp(prob - prob.max(axis=2, keepdims=True))
    prob /= prob.sum(axis=2, keepdims=True)
    return (prob @ (np.arange(len(layers)) / (len(layers) - 1))).mean(axis=1), prob.mean(axis=1).argmax(axis=1)


def plain_run(x, model, s):
    """Score, relative, binned score and category of dense rows, the whole run without Spark."""
    n = len(x)
    lg = np.log2(x * 1e6 / x.sum(axis=1, keepdims=True) + 1)
    order, category = ensemble_scores(np.array([average_rank(r) for r in x]), lg, model)
    count = 1 if n < s.least_for_batches or s.batch_size > n else -(-n // s.batch_size)
    at = shuffled(n, s.seed) if count > 1 else np.arange(n)
    binned, score = np.full(n, np.nan), np.full(n, np.nan)
    for batch in split(n, count):
        cells = np.sort(at[batch])
        y = lg[cells]
        mean = y.mean(axis=0)
        with np.errstate(invalid="ignore", divide="ignore"):
            disp = np.where(y.min(axis=0) == y.max(axis=0), 0.0, y.var(axis=0) / mean)
        top = np.sort(np.lexsort((np.arange(len(disp)), -np.round(disp, 9)))[: s.top_features])
        smooth = np.empty(len(cells))
        pos = shuffled(len(cells), s.seed)
        for chunk in split(len(cells), 1 if s.smooth_batch_size > len(cells) else -(-len(cells) // s.smooth_batch_size)):
            own = pos[chunk]
            c = y[own][:, top]
            c = c - c.mean(axis=1, keepdims=True)
            w = c @ c.T / np.sqrt((c**2).sum(axis=1))[:, None] / np.sqrt((c**2).sum(axis=1))[None]
            w = np.clip(w, -1, 1)
            np.fill_diagonal(w, 0)
            w[~np.isfinite(w)] = 0
            w[w < max(w.mean(), 0)] = 0
            w /= w.sum(axis=1, keepdims=True) + 1e-5
            start = v = order[cells[own]].astype(np.float32).astype(float)
            for _ in range(10_000):
                v, old = 0.9 * w @ v + 0.1 * start, v
                if np.abs(v - old).mean() / (start.astype(np.float32).mean() + 1e-6) < 1e-6:
                    break
            smooth[own] = v
        for k in range(6):
            mine = np.flatnonzero(category[cells] == k)
            mine = mine[np.lexsort((cells[mine], smooth[mine]))]
            if len(mine) > 1:
                binned[cells[mine]] = k / 6 + 1e-8 + np.arange(len(mine)) * ((1 / 6 - 2e-8) / (len(mine) - 1))
        if len(cells) < s.least_for_smoothing:
            score[cells] = binned[cells]
            continue
        z = (y - y.mean(axis=1, keepdims=True)) / y.std(axis=1, keepdims=True)
        u, d, _ = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
        e = (u * d)[:, : s.components]
        for i in range(len(cells)):
            dist = np.sqrt(((e - e[i]) ** 2).sum(axis=1))
            dist /= dist.max()
            near = np.lexsort((cells, np.round(dist, 9)))[: s.neighbours]
            t = binned[cells[near]]
            same = lambda m, t=t: part_of(np.round(t[:m].sum() / m, 9)) == part_of(np.round(t[m : 2 * m].sum() / m, 9))
            m = next((m for m in range(2, len(near) // 2 + 1) if same(m)), 2)
            weight = (1 - dist[near[: 2 * m]]) ** 2
            score[cells[i]] = (t[: 2 * m] * weight).sum() / weight.sum()
    low, high = np.nanmin(score), np.nanmax(score)
    return score, (score - low) / (high - low), binned, category


@pytest.fixture(scope="module")
def corpus(spark):
    expr = fixtures.expression(spark, SF).cache()
    listed = mapping.feature_list(expr).cache()
    model = {k: v.cache() for k, v in fixtures.model(spark, listed).items()}
    index = {r.feature: r.feature_idx for r in listed.collect()}
    rows = expr.collect()
    ids = sorted({r.cell_id for r in rows})
    x = np.zeros((len(ids), len(index)))
    for r in rows:
        x[ids.index(r.cell_id), index[r.feature]] = r.value
    return expr, listed, model, ids, x


def close(rows, ids, want, key):
    at = {key(r): r for r in rows}
    assert len(at) == len(rows) == len(ids)
    score, relative, binned, category = want
    number = lambda v: np.nan if v is None else v
    for i, c in enumerate(ids):
        r = at[c]
        assert r.preknn_potency == CATEGORIES[category[i]]
        assert np.allclose([number(r.score), number(r.relative), number(r.preknn_score)], [score[i], relative[i], binned[i]], rtol=0, atol=1e-6, equal_nan=True), c


@pytest.mark.parametrize(
    "settings",
    [Settings(), Settings(batch_size=50, smooth_batch_size=20, least_for_batches=50, least_for_smoothing=40, top_features=300), Settings(batch_size=34, smooth_batch_size=15, least_for_batches=50, least_for_smoothing=34), Settings(batch_size=10, least_for_batches=10, least_for_smoothing=5, components=5, neighbours=8)],
)
def test_run_equals_the_dense_rewrite(spark, corpus, settings):
    expr, listed, model, ids, x = corpus
    rows = potency.score(expr, listed, model, fixtures.SETS, settings).collect()
    close(rows, ids, plain_run(x, model, settings), lambda r: r.cell_id)
    assert sorted(r.cell_idx for r in rows) == list(range(len(ids)))


def test_the_plan_does_not_grow_with_the_batches(spark, corpus):
    expr, listed, model, _, _ = corpus
    sizes = [len(potency.score(expr, listed, model, fixtures.SETS, Settings(batch_size=b, least_for_batches=10, smooth_batch_size=8, least_for_smoothing=5))._jdf.queryExecution().optimizedPlan().toString()) for b in (50, 10)]
    assert abs(sizes[0] - sizes[1]) < 0.05 * sizes[0]


def test_run_from_a_text_file(spark, corpus, tmp_path):
    _, listed, model, ids, x = corpus
    features = [r.feature for r in listed.orderBy("feature_idx").collect()]
    order = list(np.random.RandomState(5).permutation(len(ids)))
    lines = ["\t".join(f"c{ids[i]:04d}" for i in order)]
    # Every third feature goes by another name, and one name is in no list.
    for j, f in enumerate(features):
        lines.append("\t".join([f"other_{f}" if j % 3 == 0 else f, *(repr(float(x[i, j])) for i in order)]))
    lines.append("\t".join(["unknown", *["7"] * len(ids)]))
    (tmp_path / "in.txt").write_text("\n".join(lines) + "\n")
    alias = spark.createDataFrame([(f"other_{f}", f) for f in features], "alias string, target string")
    with pytest.warns(UserWarning, match="500 features"):
        out, report = run.run(spark, f"file://{tmp_path}/in.txt", listed, model, fixtures.SETS, run.Names(alias), Settings(), f"file://{tmp_path}/out")
    assert (report.n_present, report.looks_logged, report.low_counts) == (len(features), False, True)
    # Cells keep the file's order, which also breaks ties.
    want = plain_run(x[order], model, Settings())
    close(out.collect(), [f"c{ids[i]:04d}" for i in order], want, lambda r: r.cell_id)
    back = matrix.read_results(spark, f"file://{tmp_path}/out").collect()
    assert {r.cell_id for r in back} == {f"c{i:04d}" for i in ids}
    human, _ = run.run(spark, f"file://{tmp_path}/in.txt", listed, model, fixtures.SETS, run.Names(alias, spark.createDataFrame([(f, f) for f in features], "name string, ortholog string")), Settings(species="human"), verbose=False)
    close(human.collect(), [f"c{ids[i]:04d}" for i in order], want, lambda r: r.cell_id)


def test_kernel_in_single_precision_agrees(spark, corpus, monkeypatch):
    expr, listed, model, ids, x = corpus
    monkeypatch.setattr(ensemble, "EXACT", 0)
    rows = potency.score(expr, listed, model, fixtures.SETS).collect()
    close(rows, ids, plain_run(x, model, Settings()), lambda r: r.cell_id)
