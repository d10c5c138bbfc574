"""The registered queries of the expression engine.  Their SQL is in :mod:`plurigrade.plans.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurigrade.functions import scalars
from plurigrade.operators import binning, compare, diffusion, ensemble, mapping, neighbours, normalise, partition
from plurigrade.operators import features as dispersed
from plurigrade.plans import fixtures, oracle, potency
from plurigrade.settings import Settings
from plurigrade.sources import arrays, matrix, sinks
from plurigrade.sources.shared import running, settled, shared_dir

#: Places that results are rounded to, since sums run in any order.
PLACES = 6


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, PLACES) + 0.0 for c in columns})


def _normal(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, int]:
    sparse, listed, n = fixtures.sparse(spark, sf)
    return normalise.normalised(sparse, n), listed, n


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.expression(spark, sf).select("cell_id").distinct()


def expr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.expression(spark, sf)


def expr_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix set out as text lines, genes by cells, and read again."""
    expr = fixtures.expression(spark, sf)
    order = [r[0] for r in expr.select("cell_id").distinct().orderBy("cell_id").collect()]  # the header of a text table: one name per column
    cells = spark.createDataFrame(list(enumerate(order)), "cell_idx int, cell_id long")
    values = expr.join(cells, "cell_id").groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("cell_idx", "value"))).alias("m"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(len(order) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("string"))
    lines = values.select(F.concat_ws("\t", "feature", F.array_join(tokens, "\t")).alias("value"))
    return matrix.parsed_rows(lines, len(order)).where("value <> 0").join(cells, "cell_idx").select("cell_id", "feature", "value")


def dup_names(spark: SparkSession, sf: str) -> DataFrame:
    return matrix.duplicates(fixtures.table(spark, sf, "part"), "p_type")


def number_tokens(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of several spellings, good and bad, parsed."""
    d = fixtures.table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice", 2).cast("decimal(20,2)").cast("string").alias("t"))
    forms = F.array(F.col("t"), F.concat(F.lit("-"), F.col("t")), F.concat(F.lit("+"), F.col("t"), F.lit("\r")), F.concat(F.col("t"), F.lit("e-3")), F.concat(F.col("t"), F.lit("d")), F.concat(F.lit(" "), F.col("t")), F.concat(F.col("t"), F.lit(".1")), F.lit(""), F.lit("."))
    token = F.get(forms, (F.col("o_orderkey") % 9).cast("int"))
    return d.select("o_orderkey", scalars.parsed_number(token).alias("value"))


def model_order(spark: SparkSession, sf: str) -> DataFrame:
    """The model names of a manifest, made of the nations' names."""
    names = fixtures.table(spark, sf, "nation").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.array_sort(F.collect_list("n_name")).alias("model_order"))).alias("value"))
    return matrix.model_order(names).select(F.col("position").cast("long").alias("position"), "model")


def _alias(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    listed = fixtures.features(spark, sf)
    i, name = F.col("feature_idx"), F.col("feature")
    names = listed.where(i % 4 != 1).select(F.when(i % 3 == 0, F.concat(F.lit("A_"), name)).otherwise(name).alias("name")).unionByName(listed.where(i % 8 == 0).select(name.alias("name"))).distinct()
    return names, listed.select(F.concat(F.lit("A_"), name).alias("alias"), name.alias("target")), listed


def alias_map(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.alias_names(*_alias(spark, sf))


def _orthologs(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs ``human, mouse, id1, id2``."""
    p = fixtures.table(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_brand", "p_type", "p_size")
    return p.select(F.concat_ws("_", F.lit("H"), "p_brand", F.col("p_size").cast("string")).alias("human"), F.concat_ws("_", F.lit("M"), "p_type", (F.col("k") % 7).cast("string")).alias("mouse"), (F.col("k") * 37 % 101).cast("double").alias("id1"), (F.col("k") * 53 % 103).cast("double").alias("id2"))


def ortholog_double_top_hit(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.double_top_hits(_orthologs(spark, sf))


def ortholog_map(spark: SparkSession, sf: str) -> DataFrame:
    pairs = mapping.double_top_hits(_orthologs(spark, sf)).select(F.col("human").alias("name"), F.col("mouse").alias("ortholog"))
    p = fixtures.table(spark, sf, "part").groupBy(F.concat_ws("_", F.lit("H"), "p_brand", F.col("p_size").cast("string")).alias("name")).agg(F.min("p_partkey").alias("gene_idx"))
    alias = p.where(F.col("gene_idx") % 2 == 0).select(F.col("name").alias("alias"), F.concat(F.lit("M_alias_"), (F.col("gene_idx") % 40).cast("string")).alias("target"))
    return mapping.ortholog_names(p, pairs, alias)


def feature_coverage(spark: SparkSession, sf: str) -> DataFrame:
    names, _, listed = _alias(spark, sf)
    return mapping.coverage(names, listed)


def cpm_log2(spark: SparkSession, sf: str) -> DataFrame:
    normal, listed, _ = _normal(spark, sf)
    return _rounded(normal.select("cell_id", "feature_idx", "lg"), "lg")


def avg_rank_desc(spark: SparkSession, sf: str) -> DataFrame:
    """Ranks of all features, those without value included."""
    normal, listed, _ = _normal(spark, sf)
    zero = normal.groupBy("cell_id").agg(F.first("zero_rank").alias("zero_rank"))
    pairs = normalise.dense(zero, listed, normal.select("cell_id", "feature_idx", "rk")).join(zero, "cell_id")
    return pairs.select("cell_id", "feature_idx", F.coalesce("rk", "zero_rank").alias("rk"))


def row_zscore(spark: SparkSession, sf: str) -> DataFrame:
    normal, _, n = _normal(spark, sf)
    return _rounded(normalise.row_zscores(normal, n), "z", "zero_z")


def col_center(spark: SparkSession, sf: str) -> DataFrame:
    normal, _, _ = _normal(spark, sf)
    return _rounded(normalise.centred(normal, "lg", _cells(spark, sf).count()), "centred")


def qc_lowcount(spark: SparkSession, sf: str) -> DataFrame:
    normal, _, _ = _normal(spark, sf)
    return normalise.low_counts(normal, _cells(spark, sf))


def log_like_check(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.looks_logged(fixtures.expression(spark, sf))


def _dispersion(spark: SparkSession, sf: str) -> DataFrame:
    normal, listed, _ = _normal(spark, sf)
    return dispersed.dispersion(normal, listed, _cells(spark, sf).count())


def dispersion(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_dispersion(spark, sf), "disp")


def top_features(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(dispersed.top_dispersed(_dispersion(spark, sf), GRAPH_FEATURES), "disp")


def coo_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    items = fixtures.table(spark, sf, "lineitem")
    triples = items.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), (F.col("l_partkey") % 300).alias("r"), (F.col("l_suppkey") % 50).alias("c"), (F.col("l_quantity") % 5).alias("v"))
    return ensemble.last_triples(triples)


def background_product(spark: SparkSession, sf: str) -> DataFrame:
    m = fixtures.model(spark, fixtures.features(spark, sf))
    return _rounded(ensemble.background_weights(m["geneset"], m["background"]), "gs")


def geneset_sizes(spark: SparkSession, sf: str) -> DataFrame:
    m = fixtures.model(spark, fixtures.features(spark, sf))
    return _rounded(ensemble.set_sizes(m["geneset"], m["head"]), "maxrank", "half", "denom")


def _measures(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    normal, listed, _ = _normal(spark, sf)
    m = fixtures.model(spark, listed)
    sizes = ensemble.set_sizes(m["geneset"], m["head"])
    ranks = ensemble.rank_scores(normal, m["geneset"], sizes)
    return ranks, ensemble.mean_differences(normal, m["geneset"], ensemble.background_weights(m["geneset"], m["background"]), sizes), m


def geneset_rank_score(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_measures(spark, sf)[0], "score")


def geneset_mean_vs_bg(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_measures(spark, sf)[1], "diff")


def _logits(spark: SparkSession, sf: str) -> DataFrame:
    ranks, diffs, m = _measures(spark, sf)
    return ensemble.head_logits(ranks, diffs, m["head"], m["weight"], fixtures.SETS)


def head_logits(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_logits(spark, sf), "z")


def softmax_order(spark: SparkSession, sf: str) -> DataFrame:
    p = ensemble.model_predictions(_logits(spark, sf))
    return _rounded(p.select("cell_id", "model", "order_score", F.array_max("prob").alias("top_prob")), "order_score", "top_prob")


def _kernel(spark: SparkSession, sf: str) -> DataFrame:
    normal, listed, n = _normal(spark, sf)
    m = fixtures.model(spark, listed)
    return ensemble.predictions(normal, m["geneset"], m["background"], m["head"], m["weight"], n, fixtures.SETS)


def ensemble_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_kernel(spark, sf).select("cell_id", "order_score", F.array_max("prob").alias("top_prob")), "order_score", "top_prob")


def ensemble_argmax(spark: SparkSession, sf: str) -> DataFrame:
    return _kernel(spark, sf).select("cell_id", "category")


def seeded_permutation(spark: SparkSession, sf: str) -> DataFrame:
    """The shuffle of as many places as there are cells."""
    return partition.permutation(spark, _cells(spark, sf).count(), 14)


def batched_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells in shuffled batches of at most 40."""
    cells = running(_cells(spark, sf), ["cell_id"], name="cell_idx")
    return partition.batched(cells, cells.count(), 40, 14, least=10).select("cell_id", "cell_idx", "batch")


def array_split_chunks(spark: SparkSession, sf: str) -> DataFrame:
    orders = fixtures.table(spark, sf, "orders").select(F.col("o_orderkey").alias("cell_id"))
    n = orders.count()
    return running(orders, ["cell_id"], name="pos").select("cell_id", partition.chunk_of(F.col("pos"), n, 7).alias("chunk"))


def batch_plan(spark: SparkSession, sf: str) -> DataFrame:
    """How many batches tables of several sizes come to."""
    n = F.col("n_nationkey") * 450
    return fixtures.table(spark, sf, "nation").select("n_nationkey", n.cast("long").alias("n"), partition.parts_of(n, 4000, 1000).alias("batches"))


#: Features of the diffusion queries, as a run has them.
GRAPH_FEATURES = Settings().top_features


def _chunks(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """The cells in chunks of at most a run's size, in order of id, and the features they have."""
    normal, listed, width = _normal(spark, sf)
    ids = running(_cells(spark, sf), ["cell_id"], name="pos")
    n = ids.count()
    cells = ids.select("cell_id", partition.chunk_of(F.col("pos"), n, partition.parts_of(F.lit(n), Settings().smooth_batch_size)).alias("chunk"))
    top = dispersed.top_dispersed(dispersed.dispersion(normal, listed, n), GRAPH_FEATURES)
    rows = diffusion.sparse_vectors(normal, top).join(cells, "cell_id").select("chunk", "cell_id", "at", "lg", (F.col("cell_id") % 10 / 10.0).alias("score"))
    return rows, min(GRAPH_FEATURES, width)


def chunk_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(diffusion.chunk_pairs(*_chunks(spark, sf)).select("i", "j", "w"), "w")


def markov_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(diffusion.chunk_pairs(*_chunks(spark, sf), markov=True).select("i", "j", "w"), "w")


def diffusion_fixed_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Five rounds, as SQL can follow them; ``diffusion_fixed_point`` has the stop by change."""
    return _rounded(diffusion.diffused(*_chunks(spark, sf), rounds=5, tolerance=0.0).select("cell_id", "smooth"), "smooth")


def diffusion_fixed_point(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(diffusion.diffused(*_chunks(spark, sf)).select("cell_id", "smooth", "rounds"), "smooth")


def rank_binning(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.scores(spark, sf).select(F.lit(0).alias("batch"), "cell_id", "category", "smooth")
    return _rounded(binning.rank_binned(rows).select("cell_id", "category", "binned"), "binned")


def bin_label(spark: SparkSession, sf: str) -> DataFrame:
    rows = fixtures.scores(spark, sf).select("cell_id", F.round(F.col("score") * 1.3 - 0.1, 9).alias("score"))
    return binning.labelled(rows, "score").select("cell_id", "label", scalars.category_index(F.col("score")).alias("category"))


def relative_minmax(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(binning.relative(fixtures.scores(spark, sf)).select("cell_id", "relative"), "relative")


def _near(spark: SparkSession, sf: str) -> DataFrame:
    """By the kernel, one batch."""
    rows = fixtures.points(spark, sf)
    near = neighbours.knn(rows.select(F.lit(0).alias("batch"), "cell_id", "x"), 30)
    return near.join(rows.select(F.col("cell_id").alias("j"), "s"), "j")


def pair_distance(spark: SparkSession, sf: str) -> DataFrame:
    """All pairs, which is what the result holds."""
    return _rounded(neighbours.pair_distances(fixtures.points(spark, sf)), "d")


def knn30(spark: SparkSession, sf: str) -> DataFrame:
    return _near(spark, sf).select("i", "j", "rn")


def shortest_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.consensus(_near(spark, sf))


def knn_smooth(spark: SparkSession, sf: str) -> DataFrame:
    """By the kernel, one batch."""
    rows = fixtures.points(spark, sf).select(F.lit(0).alias("batch"), "cell_id", "x", F.col("s").alias("score"))
    return _rounded(neighbours.knn_smoothed(rows, 30).select("cell_id", "keep", "score"), "score")


def _embedded_gaps(spark: SparkSession, sf: str, components: int) -> DataFrame:
    """Distances between neighbours in id of the embedding, which signs do not change."""
    rows = fixtures.points(spark, sf)
    wide = rows.select(F.lit(0).alias("batch"), "cell_id", F.sequence(F.lit(0), F.lit(63)).alias("at"), F.col("x").alias("lg"))
    e = neighbours.embedded(wide, 64, components)
    after = e.select((F.col("cell_id") - 1).alias("cell_id"), F.col("x").alias("y"))
    return _rounded(e.join(after, "cell_id").select("cell_id", F.sqrt(scalars.squared_distance(F.col("x"), F.col("y"))).alias("d")), "d")


def pca_distance(spark: SparkSession, sf: str) -> DataFrame:
    """All components, which keep the distances of the scaled rows."""
    return _embedded_gaps(spark, sf, 64)


def pca30_distance(spark: SparkSession, sf: str) -> DataFrame:
    """As many components as a run takes."""
    return _embedded_gaps(spark, sf, Settings().components)


def compare_results(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(compare.compared(fixtures.results(spark, sf, False), fixtures.results(spark, sf, True), atol=0.3), "max_abs_delta", "mean_delta")


def result_identity(spark: SparkSession, sf: str) -> DataFrame:
    return compare.identity(fixtures.results(spark, sf, False), fixtures.results(spark, sf, True))


def cells_in_one(spark: SparkSession, sf: str) -> DataFrame:
    return compare.only_in(fixtures.results(spark, sf, False), fixtures.results(spark, sf, True))


def spearman_pair(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(compare.spearman(fixtures.results(spark, sf, False), fixtures.results(spark, sf, True), "score"), "rho")


def result_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of a result table; prices as scores, since SQL spells those the same."""
    o = fixtures.table(spark, sf, "orders")
    price = F.round("o_totalprice", 2)
    rows = o.select(F.col("o_orderkey").alias("cell_idx"), F.col("o_orderkey").alias("cell_id"), F.when(F.col("o_orderkey") % 9 != 2, price).alias("score"), F.when(F.col("o_orderkey") % 7 != 1, F.col("o_orderstatus")).alias("potency"), (F.col("o_orderkey") % 64 / 64.0).alias("relative"), (-price).alias("preknn_score"), F.col("o_orderstatus").alias("preknn_potency"))
    return sinks.result_lines(rows)


def result_exponents(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of all sizes, spelt as result tables have them and read again."""
    o = fixtures.table(spark, sf, "orders").select("o_orderkey", F.concat((1 + F.col("o_orderkey") % 9).cast("string"), F.lit("e"), (F.col("o_orderkey") % 37 - 18).cast("string")).cast("double").alias("x"))
    return o.select("o_orderkey", scalars.parsed_number(scalars.number_text(F.col("x"))).alias("value"))


def matrix_text(spark: SparkSession, sf: str) -> DataFrame:
    """The matrix written as a text table and read back, its structure checked on the way."""
    expr = fixtures.expression(spark, sf)
    order = [r[0] for r in expr.select("cell_id").distinct().orderBy("cell_id").collect()]  # the header of a text table: one name per column
    cells = spark.createDataFrame(list(enumerate(order)), "cell_idx int, cell_id long")
    values = expr.join(cells, "cell_id").groupBy("feature").agg(F.map_from_entries(F.collect_list(F.struct("cell_idx", "value"))).alias("m"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(len(order) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)).cast("string"))
    lines = values.select(F.lit(1).alias("at"), F.concat_ws("\t", "feature", F.array_join(tokens, "\t")).alias("value"))
    header = spark.createDataFrame([(0, "\t".join(map(str, order)))], "at int, value string")
    path = shared_dir(spark, "matrix")
    header.unionByName(lines).coalesce(1).sortWithinPartitions("at").select("value").write.text(path)
    return matrix.read_matrix(spark, path).select(F.col("cell_id").cast("long").alias("cell_id"), "feature", "value")


def line_list(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "lines")
    rows = fixtures.table(spark, sf, "part").select(F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")).alias("value"))
    rows.write.text(path)
    return matrix.read_lines(spark, path)


def pair_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table of two columns in which the last line of a key counts, and lines without tab do not."""
    path = shared_dir(spark, "pairs")
    p = fixtures.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).otherwise(F.concat_ws("\t", "p_type", F.col("p_partkey").cast("string"))).alias("value"))
    p.coalesce(1).sortWithinPartitions("p_partkey").select("value").write.text(path)
    return matrix.read_pairs(spark, path)


def result_table(spark: SparkSession, sf: str) -> DataFrame:
    """A result table written and read back."""
    o = fixtures.table(spark, sf, "orders")
    price = F.round("o_totalprice", 2)
    rows = o.select(F.col("o_orderkey").alias("cell_idx"), F.col("o_orderkey").alias("cell_id"), F.when(F.col("o_orderkey") % 9 != 2, price).alias("score"), F.when(F.col("o_orderkey") % 7 != 1, F.col("o_orderstatus")).alias("potency"), (F.col("o_orderkey") % 64 / 64.0).alias("relative"), (-price).alias("preknn_score"), F.col("o_orderstatus").alias("preknn_potency"))
    path = shared_dir(spark, "results")
    sinks.write_results(rows, path, single=True)
    return matrix.read_results(spark, path).drop("row")


def gene_set_members(spark: SparkSession, sf: str) -> DataFrame:
    """The sets of a table of weights."""
    p = fixtures.table(spark, sf, "part")
    weights = p.select((F.col("p_partkey") % 3).cast("int").alias("model"), (F.col("p_partkey") % 6).cast("int").alias("layer"), (F.col("p_size") % 4).cast("int").alias("k"), F.col("p_partkey").cast("int").alias("feature_idx"), (F.col("p_partkey") % 5 - 2).cast("double").alias("weight"))
    return arrays.gene_sets(weights)


def aligned_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Alignment to every other feature, with the check for two inputs of one feature."""
    expr = fixtures.expression(spark, sf)
    listed = mapping.feature_list(expr).where(F.col("feature_idx") % 2 == 0)
    return mapping.aligned(expr, listed)


def file_sums(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of a file of names."""
    path = shared_dir(spark, "names")
    fixtures.table(spark, sf, "nation").select("n_name").coalesce(1).sortWithinPartitions("n_name").write.text(path)
    return compare.file_digests(spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)).select("sha256")


def flagship_potency(spark: SparkSession, sf: str) -> DataFrame:
    """The whole run: alignment to relative scores."""
    expr = settled(fixtures.expression(spark, sf), "expression")
    listed = settled(mapping.feature_list(expr), "features")
    return potency.score(expr, listed, fixtures.model(spark, listed), fixtures.SETS)


QUERIES = (
    expr_matrix, expr_unpivot, matrix_text, line_list, pair_table, result_table, gene_set_members, file_sums, dup_names, number_tokens, model_order, alias_map, ortholog_map, ortholog_double_top_hit, feature_coverage, aligned_strict,
    cpm_log2, avg_rank_desc, row_zscore, col_center, qc_lowcount, log_like_check, dispersion, top_features, coo_last_wins, background_product, geneset_sizes,
    geneset_rank_score, geneset_mean_vs_bg, head_logits, softmax_order, ensemble_mean, ensemble_argmax, seeded_permutation, array_split_chunks, batch_plan, batched_cells,
    chunk_correlation, markov_matrix, diffusion_fixed_steps, diffusion_fixed_point, rank_binning, bin_label, relative_minmax, pair_distance, knn30, shortest_consensus, knn_smooth, pca_distance, pca30_distance,
    compare_results, result_identity, cells_in_one, spearman_pair, result_lines, result_exponents, flagship_potency,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
