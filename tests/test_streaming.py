"""Micro-batch scoring gives what the batch plan gives."""

import pytest

from plurigrade.operators import ensemble, mapping, normalise
from plurigrade.plans import fixtures
from plurigrade.streaming import scorer


def test_streamed_cells_score_as_in_batch(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    expr = fixtures.expression(spark, sf)
    listed = mapping.feature_list(expr).cache()
    model = {k: v.cache() for k, v in fixtures.model(spark, listed).items()}
    source = str(tmp_path / "in")
    # Whole cells per file, as the scorer asks for.
    expr.where("cell_id % 2 = 0").coalesce(1).write.parquet(source)
    expr.where("cell_id % 2 = 1").coalesce(1).write.mode("append").parquet(source)
    got = {}

    def sink(df, number):
        got.setdefault(number, {}).update({r.cell_id: r for r in df.collect()})

    stream = spark.readStream.schema(expr.schema).option("maxFilesPerTrigger", 1).parquet(source)
    scorer.start(stream, listed, model, fixtures.SETS, sink, str(tmp_path / "state")).awaitTermination()
    n = listed.count()
    normal = normalise.normalised(mapping.aligned(expr, listed), n)
    want = ensemble.predictions(normal, model["geneset"], model["background"], model["head"], model["weight"], n, fixtures.SETS)
    streamed = {c: r.preknn_score for batch in got.values() for c, r in batch.items()}
    assert len(got) == 2
    assert streamed == pytest.approx({r.cell_id: r.order_score for r in want.collect()})
    listed.unpersist()
    for v in model.values():
        v.unpersist()
