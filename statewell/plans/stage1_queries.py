"""Queries for decomposition and projection (D*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewell.common import materialise
from statewell.operators import consensus, decompose as dec
from statewell.operators.linalg import gram_blocks
from statewell.plans import inputs as src
from statewell.plans.inputs import CELLS, CENTRED, GRAM, SCORES, TWO, eigen_sql
from statewell.plans.registry import query, rounded, table

SVD3 = f"WITH {CELLS}, {CENTRED}, {GRAM}, {eigen_sql(3)}, {SCORES}"


def svd(spark, sf, k=6, center=True):
    return dec.svd(
        src.cells(spark, sf), k=k, center=center, rows=src.rows(spark, sf), feature_ids=src.FEATURES
    )


@query("d1_feature_means", f"WITH {CELLS} SELECT layer, feature_id, round(avg(value), 9) + 0.0 AS mean FROM cells GROUP BY ALL")
def d1(spark, sf):
    return rounded(dec.feature_means(src.cells(spark, sf)), 9, "mean")


@query(
    "d1_center_features",
    f"WITH {CELLS}, {CENTRED} SELECT layer, sample_id, feature_id, round(v, 9) + 0.0 AS value FROM centred",
)
def d1_center(spark, sf):
    cells = src.cells(spark, sf)
    out = dec.center_cells(cells, dec.feature_means(cells)).select("layer", "sample_id", "feature_id", "value")
    return rounded(out, 9, "value")


@query(
    "d2_block_scale",
    f"""WITH {TWO}, {CENTRED} SELECT layer, sample_id, feature_id,
        round(v / sqrt(sum(v * v) OVER (PARTITION BY layer)), 8) + 0.0 AS value FROM centred""",
)
def d2(spark, sf):
    cells = src.two_layers(spark, sf)
    out = dec.block_scale(cells, dec.layer_scaling(cells)).select("layer", "sample_id", "feature_id", "value")
    return rounded(out, 8, "value")


@query(
    "d3_feature_gram",
    f"WITH {CELLS}, {CENTRED}, {GRAM} SELECT layer, i, j, round(v, 8) + 0.0 AS v FROM g1",
)
def d3(spark, sf):
    blocks = gram_blocks(src.rows(spark, sf), ["layer"], "columns")
    wide = blocks.select("layer", "block", "m", F.posexplode("gram").alias("pos", "v"))
    ids = F.array(*[F.lit(f) for f in src.FEATURES])
    row = F.col("block") * F.floor(F.lit(65536) / F.col("m")) + F.floor(F.col("pos") / F.col("m"))
    out = wide.select(
        "layer", F.get(ids, row.cast("int")).alias("i"), F.get(ids, F.col("pos") % F.col("m")).alias("j"), "v"
    )
    return rounded(out, 8, "v")


@query(
    "d4_total_variance",
    f"WITH {CELLS}, {CENTRED} SELECT layer, round(sum(v * v), 6) AS total FROM centred GROUP BY layer",
)
def d4_total(spark, sf):
    spectrum = svd(spark, sf, None).spectrum
    return rounded(spectrum.groupBy("layer").agg(F.sum(F.col("sigma") * F.col("sigma")).alias("total")), 6, "total")


@query(
    "d4_row_energy",
    f"WITH {CELLS}, {CENTRED} SELECT layer, sample_id, round(sum(v * v), 7) AS energy FROM centred GROUP BY ALL",
)
def d4_rows(spark, sf):
    """Full-rank scores keep every sample's squared length."""
    scores = svd(spark, sf, None).scores
    out = scores.groupBy("layer", "sample_id").agg(F.sum(F.col("coord") * F.col("coord")).alias("energy"))
    return rounded(out, 7, "energy")


@query(
    "d4_feature_energy",
    f"WITH {CELLS}, {CENTRED} SELECT layer, feature_id, round(sum(v * v), 7) AS energy FROM centred GROUP BY ALL",
)
def d4_features(spark, sf):
    """Full-rank loadings times singular values keep every feature's energy."""
    d = svd(spark, sf, None)
    joined = d.loadings.join(d.spectrum, ["layer", "component"])
    part = F.col("sigma") * F.col("loading")
    return rounded(joined.groupBy("layer", "feature_id").agg(F.sum(part * part).alias("energy")), 7, "energy")


@query(
    "d4_svd_reconstruct",
    f"WITH {CELLS}, {CENTRED} SELECT layer, sample_id, feature_id, round(v, 7) + 0.0 AS value FROM centred",
)
def d4_reconstruct(spark, sf):
    """Full-rank scores times loadings give back the centred matrix."""
    d = svd(spark, sf, None)
    scores = d.scores.groupBy("layer", "sample_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("component", "coord"))), lambda s: s["coord"]).alias("u")
    )
    # X = U V': projecting the scores on the rows of V, which are bounded by the layer's width
    axes = d.loadings.groupBy("layer", "feature_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("component", "loading"))), lambda s: s["loading"]).alias("w")
    ).groupBy("layer").agg(F.collect_list(F.struct("feature_id", "w")).alias("axes"))
    out = scores.join(axes, "layer").select("layer", "sample_id", "u", F.inline("axes"))
    value = F.aggregate(F.zip_with("u", "w", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return rounded(out.select("layer", "sample_id", "feature_id", value.alias("value")), 7, "value")


@query("d3_sketch_spectrum", SVD3 + " SELECT layer, component, round(sigma, 5) AS sigma FROM spectrum")
def d3_sketch(spark, sf):
    """Leading values from the randomised range finder, asked for by name; with as many directions as features it is exact."""
    from statewell.operators.sketch import sketch_components

    d = sketch_components(src.cells(spark, sf), ["layer"], 3, oversample=61, power=2)
    return rounded(d.spectrum, 5, "sigma")


@query("d4_spectrum", SVD3 + " SELECT layer, component, round(sigma, 7) AS sigma FROM spectrum")
def d4_spectrum(spark, sf):
    return rounded(svd(spark, sf, 3).spectrum, 7, "sigma")


@query("d4_loadings", SVD3 + " SELECT layer, component, feature_id, round(loading, 6) + 0.0 AS loading FROM loadings")
def d4_loadings(spark, sf):
    return rounded(svd(spark, sf, 3).loadings, 6, "loading")


@query("d4_scores", SVD3 + " SELECT layer, sample_id, component, round(coord, 6) + 0.0 AS coord FROM scores")
def d4_scores(spark, sf):
    return rounded(svd(spark, sf, 3).scores, 6, "coord")


TURNED = f"""WITH {CELLS}, g1 AS MATERIALIZED (SELECT a.layer, a.feature_id AS i, b.feature_id AS j, sum(a.v * b.v) AS v
       FROM (SELECT *, value - avg(value) OVER (PARTITION BY sample_id) AS v FROM cells) a
       JOIN (SELECT *, value - avg(value) OVER (PARTITION BY sample_id) AS v FROM cells) b ON a.layer = b.layer AND a.sample_id = b.sample_id
       GROUP BY ALL), {eigen_sql(3)}"""


@query(
    "d4_scores_sample_side",
    TURNED
    + """ SELECT l.layer, feature_id AS sample_id, component, round(pow(loading * sigma, 2), 6) AS energy
          FROM loadings l JOIN spectrum USING (layer, component)""",
)
def d4_sample_side(spark, sf):
    """The matrix turned: 64 positions as samples, every vector a feature; solved on the sample side whatever the number of vectors."""
    turned = src.cells(spark, sf).select("layer", F.col("feature_id").alias("sample_id"), F.col("sample_id").alias("feature_id"), "value")
    out = dec.svd(turned, k=3, side="samples").scores
    return rounded(out.select("layer", "sample_id", "component", (F.col("coord") * F.col("coord")).alias("energy")), 6, "energy")


@query(
    "d4_svd_per_label",
    f"""WITH {CELLS}, centred AS (SELECT 'L' || label AS layer, sample_id, feature_id,
             value - avg(value) OVER (PARTITION BY label, feature_id) AS v FROM cells),
        {GRAM}, {eigen_sql(1)} SELECT layer, component, round(sigma, 6) AS sigma FROM spectrum""",
)
def d4_grouped(spark, sf):
    """One decomposition per label, all in one job."""
    from statewell.plans.registry import table

    rows = table(spark, sf, "embeddings").select(
        F.concat(F.lit("L"), F.col("label").cast("string")).alias("layer"),
        F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").cast("array<double>").alias("vec"),
    )
    return rounded(dec.svd(None, k=1, rows=rows, feature_ids=src.FEATURES, vectors=False).spectrum, 6, "sigma")


TWO_SVD = f"WITH {TWO}, {CENTRED}, {GRAM}, {eigen_sql(2)}, {SCORES}"
AVERAGED = (
    TWO_SVD
    + """, lead AS (SELECT component, arg_max(layer, sigma) AS layer FROM spectrum GROUP BY component),
     ref AS (SELECT l.component, l.feature_id, l.loading FROM loadings l JOIN lead USING (component, layer)),
     turn AS (SELECT l.layer, l.component, CASE WHEN sum(l.loading * r.loading) < 0 THEN -1 ELSE 1 END AS s
              FROM loadings l JOIN ref r USING (component, feature_id) GROUP BY ALL),
     raw AS (SELECT l.component, l.feature_id, sum(s.sigma * s.sigma * t.s * l.loading) AS v
             FROM loadings l JOIN spectrum s USING (layer, component) JOIN turn t USING (layer, component) GROUP BY ALL),
     shared AS (SELECT component, feature_id, v / sqrt(sum(v * v) OVER (PARTITION BY component)) AS loading FROM raw)"""
)


@query("d5_averaged_axes", AVERAGED + " SELECT component, feature_id, round(loading, 5) + 0.0 AS loading FROM shared")
def d5(spark, sf):
    return rounded(dec.decompose(src.two_layers(spark, sf), "averaged", k=2).loadings, 5, "loading")


@query(
    "d7_rescaled_scores",
    AVERAGED
    + """, o AS (SELECT l.layer, l.component, sum(l.loading * s.loading) AS o FROM loadings l
                 JOIN shared s USING (component, feature_id) GROUP BY ALL)
         SELECT layer, sample_id, component, round(coord * o, 5) + 0.0 AS coord FROM scores JOIN o USING (layer, component)""",
)
def d7(spark, sf):
    return rounded(dec.decompose(src.two_layers(spark, sf), "averaged", k=2).scores, 5, "coord")


@query(
    "d6_strongest_axes",
    TWO_SVD
    + """ SELECT component, feature_id, round(loading, 5) + 0.0 AS loading FROM loadings
          WHERE layer = (SELECT arg_max(layer, sigma) FROM spectrum WHERE component = 1)""",
)
def d6(spark, sf):
    return rounded(dec.decompose(src.two_layers(spark, sf), "strongest", k=2).loadings, 5, "loading")


@query(
    "d8_rank_warnings",
    """SELECT layer, 'rank_deficient' AS code, 'only 32 of 40 requested components available' AS message
       FROM (SELECT DISTINCT unnest(['A', 'B']) AS layer FROM embeddings)""",
)
def d8(spark, sf):
    d = dec.svd(src.two_layers(spark, sf), k=40, side="features", vectors=False)
    return dec.rank_warnings(d.spectrum, 40)


@query(
    "d9_detectability",
    f"""WITH {TWO} SELECT layer, count(DISTINCT sample_id) AS n, count(DISTINCT feature_id) AS p,
        round(pow(count(DISTINCT sample_id) * count(DISTINCT feature_id), 0.25), 9) AS threshold FROM cells GROUP BY layer""",
)
def d9(spark, sf):
    return rounded(dec.detectability(src.two_layers(spark, sf)), 9, "threshold")


@query(
    "d9_threshold_warnings",
    SVD3
    + """ SELECT layer, 'below_threshold' AS code FROM spectrum
          WHERE component = 1 AND sigma < (SELECT pow(count(*), 0.25) FROM cells)""",
)
def d9_warn(spark, sf):
    return svd(spark, sf, 1).warnings.select("layer", "code")


UNCENTRED = f"WITH {CELLS}, centred AS (SELECT layer, sample_id, feature_id, value AS v FROM cells), {GRAM}, {eigen_sql(3)}"


@query("d10_uncentred_spectrum", UNCENTRED + " SELECT layer, component, round(sigma, 7) AS sigma FROM spectrum")
def d10(spark, sf):
    return rounded(dec.spectrum(src.cells(spark, sf), n_values=3, side="features"), 7, "sigma")


@query(
    "d10_whole_spectrum",
    f"""WITH {CELLS}, centred AS (SELECT layer, sample_id, feature_id, value AS v FROM cells), {GRAM}
        SELECT layer, least(count(DISTINCT i), (SELECT count(DISTINCT sample_id) FROM cells)) AS n_values, round(sum(v) FILTER (WHERE i = j), 5) AS squares,
               round(sum(v * v), 3) AS fourths FROM g1 GROUP BY layer""",
)
def d10_whole(spark, sf):
    """Every singular value, told by the sums of squares and fourth powers, which need no eigenvectors in SQL."""
    values = dec.spectrum(src.cells(spark, sf), n_values=src.WIDTH, side="features")
    sums = values.groupBy("layer").agg(
        F.count("*").alias("n_values"), F.sum(F.col("sigma") ** 2).alias("squares"), F.sum(F.col("sigma") ** 4).alias("fourths"))
    return rounded(rounded(sums, 5, "squares"), 3, "fourths")


@query(
    "d11_shared_axis",
    SVD3 + " SELECT layer, component, feature_id, round(loading, 6) + 0.0 AS loading FROM loadings WHERE component = 2",
)
def d11(spark, sf):
    return rounded(svd(spark, sf, 3).axis(2), 6, "loading")


LABEL_AXES = f"""WITH {CELLS}, axes AS (SELECT label + 1 AS component, feature_id, avg(value) AS loading
        FROM cells GROUP BY ALL)"""


def _halves(spark, sf):
    """Discovery and secondary cohort: low and high labels."""
    from statewell.plans.registry import table

    emb = table(spark, sf, "embeddings")
    from statewell.sources.matrix import cells_from_arrays

    return (
        cells_from_arrays(emb.filter("label < 5"), "vec_id", "embedding"),
        cells_from_arrays(emb.filter("label >= 5"), "vec_id", "embedding"),
    )


@query(
    "d13_project_secondary",
    LABEL_AXES
    + """, m AS (SELECT feature_id, avg(value) AS mu FROM cells WHERE label >= 5 GROUP BY 1)
         SELECT layer, sample_id, component, round(sum((value - mu) * loading), 8) + 0.0 AS coord
         FROM cells JOIN m USING (feature_id) JOIN axes USING (feature_id) WHERE label >= 5 GROUP BY ALL""",
)
def d13_secondary(spark, sf):
    _, new = _halves(spark, sf)
    out = dec.project_cohort(new, src.label_loadings(spark, sf), centre="own", k=10)
    return rounded(out, 8, "coord")


@query(
    "d13_project_discovery",
    LABEL_AXES
    + """, m AS (SELECT feature_id, avg(value) AS mu FROM cells WHERE label < 5 GROUP BY 1)
         SELECT layer, sample_id, component, round(sum((value - mu) * loading), 8) + 0.0 AS coord
         FROM cells JOIN m USING (feature_id) JOIN axes USING (feature_id) WHERE label >= 5 GROUP BY ALL""",
)
def d13_discovery(spark, sf):
    old, new = _halves(spark, sf)
    out = dec.project_cohort(new, src.label_loadings(spark, sf), dec.feature_means(old), k=10)
    return rounded(out, 8, "coord")


@query(
    "d13_feature_contract",
    f"""WITH {src.CELLS}, new AS (SELECT sample_id, CASE feature_id WHEN 'd005' THEN 'x005' ELSE feature_id END AS feature_id, label FROM cells
             WHERE label >= 5 AND feature_id <> 'd009' AND NOT (feature_id = 'd011' AND label = 7)),
       known AS (SELECT DISTINCT feature_id FROM cells), own AS (SELECT DISTINCT feature_id FROM new)
       SELECT 'missing_feature' AS "check", 'all|' || feature_id AS key, '0' AS detail FROM known ANTI JOIN own USING (feature_id)
       UNION ALL SELECT 'extra_feature', 'all|' || feature_id, '1' FROM own ANTI JOIN known USING (feature_id)
       UNION ALL SELECT 'uneven_sample', 'all|' || sample_id, count(*) || ' of 63 features' FROM new GROUP BY sample_id HAVING count(*) < 63""",
)
def d13_contract(spark, sf):
    """One feature renamed, one lost, one missing in some samples."""
    _, new = _halves(spark, sf)
    label = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.col("label").alias("_label"))
    spoiled = new.join(label, "sample_id").filter("feature_id <> 'd009' AND NOT (feature_id = 'd011' AND _label = 7)")
    name = F.when(F.col("feature_id") == "d005", "x005").otherwise(F.col("feature_id"))
    spoiled = spoiled.withColumn("feature_id", name).select("layer", "sample_id", "feature_id", "value")
    return dec.projection_violations(spoiled, src.label_loadings(spark, sf))


@query(
    "d5_feature_contract",
    f"""WITH {src.TWO}, kept AS (SELECT * FROM cells WHERE NOT (layer = 'A' AND feature_id = 'f010') AND NOT (layer = 'B' AND feature_id = 'f003'))
       SELECT 'unequal_features' AS "check", feature_id AS key, 'in ' || count(DISTINCT layer) || ' of 2 layers' AS detail
       FROM kept GROUP BY feature_id HAVING count(DISTINCT layer) < 2""",
)
def d5_contract(spark, sf):
    kept = src.two_layers(spark, sf).filter("NOT (layer = 'A' AND feature_id = 'f010') AND NOT (layer = 'B' AND feature_id = 'f003')")
    return dec.feature_set_violations(dec.svd(kept, k=1).loadings)


# --- several layers --------------------------------------------------------------------


@query("d14_consensus_scores")
def d14(spark, sf):
    fit = consensus.fit_candidate(src.two_layers(spark, sf), "consensus", ["A", "B"], 2, side="features")
    return rounded(consensus.unpack(fit.scores, "sample_id"), 6, "coord")


CONSENSUS = (
    TWO_SVD
    + """, u AS (SELECT sample_id, sum(CASE WHEN layer = 'A' AND component = 1 THEN coord / sigma END) AS a1,
              sum(CASE WHEN layer = 'A' AND component = 2 THEN coord / sigma END) AS a2,
              sum(CASE WHEN layer = 'B' AND component = 1 THEN coord / sigma END) AS b1,
              sum(CASE WHEN layer = 'B' AND component = 2 THEN coord / sigma END) AS b2
              FROM scores JOIN spectrum USING (layer, component) GROUP BY 1),
         m AS (SELECT sum(b1 * a1) AS a, sum(b1 * a2) AS b, sum(b2 * a1) AS c, sum(b2 * a2) AS d FROM u),
         k AS (SELECT a + s * d AS a, b - s * c AS b, c - s * b AS c, d + s * a AS d
               FROM (SELECT *, CASE WHEN a * d - b * c < 0 THEN -1 ELSE 1 END AS s FROM m)),
         r AS (SELECT a / n AS a, b / n AS b, c / n AS c, d / n AS d FROM (SELECT *, sqrt(a * a + b * b) AS n FROM k)),
         t AS (SELECT sample_id, a1 + b1 * a + b2 * c AS t1, a2 + b1 * b + b2 * d AS t2 FROM u, r),
         g AS (SELECT sum(t1 * t1) AS x, sum(t1 * t2) AS y, sum(t2 * t2) AS z FROM t)"""
)


@query(
    "d14_consensus_leverage",
    CONSENSUS
    + """ SELECT sample_id, round((z * t1 * t1 - 2 * y * t1 * t2 + x * t2 * t2) / (x * z - y * y), 7) + 0.0 AS leverage FROM t, g""",
)
def d14_leverage(spark, sf):
    """Diagonal of the consensus projector, free of rotation; two layers settle at their principal averages."""
    fit = consensus.fit_candidate(src.two_layers(spark, sf), "consensus", ["A", "B"], 2, side="features")
    square = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    return rounded(fit.scores.select("sample_id", square.alias("leverage")), 7, "leverage")


@query(
    "d14_consensus_orthonormal",
    "SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM (SELECT DISTINCT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j FROM embeddings)",
)
def d14_check(spark, sf):
    fit = consensus.fit_candidate(src.two_layers(spark, sf), "consensus", ["A", "B"], 2, side="features")
    return _cross(fit.scores)


def _cross(rows):
    sums = rows.agg(*[F.sum(F.col("vec")[i] * F.col("vec")[j]).alias(f"{i}{j}") for i in (0, 1) for j in (0, 1)])
    pairs = F.array(
        *[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"{i}{j}").alias("v")) for i in (0, 1) for j in (0, 1)]
    )
    return rounded(sums.select(F.inline(pairs)), 8, "v")


SCALED = f"""WITH {TWO}, c0 AS (SELECT layer, sample_id, feature_id, value - avg(value) OVER (PARTITION BY layer, feature_id) AS v
        FROM cells), centred AS (SELECT 'all' AS layer, sample_id, layer || ':' || feature_id AS feature_id,
        v / sqrt(sum(v * v) OVER (PARTITION BY layer)) AS v FROM c0)"""


@query("d15_concatenated_spectrum", SCALED + f", {GRAM}, {eigen_sql(2)} SELECT layer, component, round(sigma, 7) AS sigma FROM spectrum")
def d15(spark, sf):
    return rounded(dec.concatenated_svd(src.two_layers(spark, sf), side="features", vectors=False).spectrum, 7, "sigma")


@query(
    "d15_block_gram_sum",
    SCALED
    + f""", {GRAM}, e AS (SELECT sample_id, sum(v * v) AS energy FROM centred GROUP BY 1)
          SELECT sample_id, round(energy, 9) AS energy, (SELECT round(sum(v * v), 8) FROM g1) AS frobenius, (SELECT round(sum(energy), 8) FROM e) AS trace FROM e""",
)
def d15_gram(spark, sf):
    """The sum of the scaled layers' sample-side matrices: its diagonal, trace and squared Frobenius norm.

    The norm is that of the feature-side matrix, so no pair of samples is built.
    """
    from statewell.operators.linalg import rows_from_cells

    cells = src.two_layers(spark, sf)
    scaled = dec.block_scale(cells, dec.layer_scaling(cells)).select(
        F.when(F.col("layer").isNotNull(), "all").alias("layer"), "sample_id", F.concat_ws(":", "layer", "feature_id").alias("feature_id"), "value"
    )
    rows = materialise(rows_from_cells(scaled, ["layer"], "sample_id", "feature_id"))
    square = lambda name: F.aggregate(name, F.lit(0.0), lambda s, x: s + x * x)
    energy = rows.select("sample_id", square("vec").alias("energy"))
    frobenius = gram_blocks(rows, ["layer"], "none").agg(F.sum(square("gram")).alias("f")).scalar()
    out = energy.withColumns({"frobenius": frobenius, "trace": energy.agg(F.sum("energy").alias("t")).scalar()})
    return rounded(rounded(out, 9, "energy"), 8, "frobenius", "trace")


@query(
    "d16_response_regression",
    SCALED
    + f""", s AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b
               FROM embeddings),
         q AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM s),
         bs AS (SELECT layer, sqrt(sum(v * v)) AS scale FROM c0 GROUP BY layer),
         x AS (SELECT split_part(feature_id, ':', 1) AS layer, split_part(feature_id, ':', 2) AS feature_id,
                      sum(a * v) AS sa, sum(b * v) AS sb FROM centred JOIN s USING (sample_id) GROUP BY ALL)
         SELECT layer, feature_id, round((bb * sa - ab * sb) / (aa * bb - ab * ab) * scale, 7) + 0.0 AS b1,
                round((aa * sb - ab * sa) / (aa * bb - ab * ab) * scale, 7) + 0.0 AS b2
         FROM x JOIN bs USING (layer), q""",
)
def d16(spark, sf):
    cells = src.two_layers(spark, sf)
    scaling = materialise(dec.layer_scaling(cells))
    out = consensus.response_regression(dec.block_scale(cells, scaling), src.narrow(spark, sf, 0, 1), scaling, 2)
    picked = out.select("layer", "feature_id", F.col("vec")[0].alias("b1"), F.col("vec")[1].alias("b2"))
    return rounded(picked, 7, "b1", "b2")


def projection_sql(fit: str = "TRUE", new: str = "TRUE") -> str:
    """CTE ``q(sample_id, q1, q2)``: the candidate-2 projection written out for rank 2."""
    return f"""WITH {TWO}, mu AS (SELECT layer, feature_id, avg(value) AS m FROM cells WHERE {fit} GROUP BY ALL),
       c0 AS (SELECT layer, sample_id, feature_id, value - m AS v FROM cells JOIN mu USING (layer, feature_id) WHERE {fit}),
       sc AS (SELECT layer, sqrt(sum(v * v)) AS s FROM c0 GROUP BY layer),
       centred AS (SELECT 'all' AS layer, sample_id, layer || ':' || feature_id AS feature_id, v / s AS v FROM c0 JOIN sc USING (layer)),
       {GRAM}, {eigen_sql(2)}, {SCORES},
       un AS (SELECT sample_id, sum(CASE WHEN component = 1 THEN coord / sigma END) AS u1,
                     sum(CASE WHEN component = 2 THEN coord / sigma END) AS u2 FROM scores JOIN spectrum USING (layer, component) GROUP BY 1),
       b AS (SELECT split_part(feature_id, ':', 1) AS layer, split_part(feature_id, ':', 2) AS feature_id, sum(u1 * v) AS b1, sum(u2 * v) AS b2
             FROM centred JOIN un USING (sample_id) GROUP BY ALL),
       bb AS (SELECT layer, sum(b1 * b1) AS x, sum(b1 * b2) AS y, sum(b2 * b2) AS z FROM b GROUP BY layer),
       yb AS (SELECT c.layer, sample_id, sum((value - m) / s * b1) AS y1, sum((value - m) / s * b2) AS y2 FROM cells c
              JOIN mu USING (layer, feature_id) JOIN sc USING (layer) JOIN b USING (layer, feature_id) WHERE {new} GROUP BY ALL),
       t AS (SELECT sample_id, sum((z * y1 - y * y2) / (x * z - y * y)) AS t1, sum((x * y2 - y * y1) / (x * z - y * y)) AS t2
             FROM yb JOIN bb USING (layer) GROUP BY sample_id),
       o1 AS (SELECT sample_id, t1 / sqrt(sum(t1 * t1) OVER ()) AS q1, t2 FROM t),
       o2 AS (SELECT sample_id, q1, t2 - q1 * sum(q1 * t2) OVER () AS r2 FROM o1),
       q AS MATERIALIZED (SELECT sample_id, q1, r2 / sqrt(sum(r2 * r2) OVER ()) AS q2 FROM o2)"""


@query(
    "d17_project_samples",
    projection_sql()
    + """ SELECT sample_id, 1 AS component, round(q1, 6) + 0.0 AS coord FROM q UNION ALL SELECT sample_id, 2, round(q2, 6) + 0.0 FROM q""",
)
def d17(spark, sf):
    cells = src.two_layers(spark, sf)
    fit = consensus.fit_candidate(cells, "concatenated", ["A", "B"], 2, side="features")
    return rounded(consensus.unpack(consensus.project_samples(cells, fit), "sample_id"), 6, "coord")


@query(
    "d17_projection_orthonormal",
    "SELECT i, j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END AS v FROM (SELECT DISTINCT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j FROM embeddings)",
)
def d17_check(spark, sf):
    cells = src.two_layers(spark, sf)
    fit = consensus.fit_candidate(cells, "concatenated", ["A", "B"], 2, side="features")
    return _cross(consensus.project_samples(cells, fit))


PROJECTORS = """WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b,
             CAST(embedding[3] AS DOUBLE) AS c, CAST(embedding[4] AS DOUBLE) AS d FROM embeddings),
        q1 AS (SELECT vec_id, a / sqrt(sum(a * a) OVER ()) AS p1, b, c / sqrt(sum(c * c) OVER ()) AS r1, d FROM x),
        q2 AS (SELECT vec_id, p1, b - p1 * sum(p1 * b) OVER () AS b2, r1, d - r1 * sum(r1 * d) OVER () AS d2 FROM q1),
        q3 AS (SELECT vec_id, p1, b2 / sqrt(sum(b2 * b2) OVER ()) AS p2, r1, d2 / sqrt(sum(d2 * d2) OVER ()) AS r2 FROM q2),
        k AS (SELECT sum(p1 * r1) AS c11, sum(p1 * r2) AS c12, sum(p2 * r1) AS c21, sum(p2 * r2) AS c22 FROM q3)"""


@query(
    "d18_projector_distance",
    PROJECTORS
    + " SELECT round(sqrt(2 * (2 - (c11 * c11 + c12 * c12 + c21 * c21 + c22 * c22))), 7) AS distance FROM k",
)
def d18(spark, sf):
    a = consensus.orthonormalise(src.narrow(spark, sf, 0, 1), 2)
    b = consensus.orthonormalise(src.narrow(spark, sf, 2, 3), 2)
    return rounded(consensus.projector_distance(a, b, 2), 7, "distance")


@query("d19_permutation_invariant", "SELECT DISTINCT 0.0 AS distance, TRUE AS invariant FROM embeddings")
def d19(spark, sf):
    """The order of samples and of features follows their ids; reversed ids permute both."""
    cells = src.two_layers(spark, sf)
    other = cells.withColumns({"sample_id": F.reverse("sample_id"), "feature_id": F.reverse("feature_id")})
    fits = [consensus.fit_candidate(c, "concatenated", ["A", "B"], 2, side="features") for c in (cells, other)]
    back = fits[1].scores.withColumn("sample_id", F.reverse("sample_id"))
    return rounded(consensus.permutation_invariant(fits[0].scores, back, 2), 7, "distance")


@query(
    "d20_top_loadings",
    LABEL_AXES
    + """ SELECT 'all' AS layer, component, feature_id, round(loading, 8) + 0.0 AS loading, CAST(rn AS INTEGER) AS position,
                 CASE WHEN loading >= 0 THEN 'branch B' ELSE 'branch A' END AS direction
          FROM (SELECT *, row_number() OVER (PARTITION BY component ORDER BY abs(loading) DESC, feature_id) AS rn FROM axes)
          WHERE rn <= 18""",
)
def d20(spark, sf):
    out = dec.top_loadings(src.label_loadings(spark, sf), ["layer", "component"], 18, "branch B", "branch A")
    return rounded(out, 8, "loading")


@query(
    "d21_assign_axes",
    """WITH x AS (SELECT CAST(embedding[1] AS DOUBLE) AS c1, CAST(embedding[2] AS DOUBLE) AS c2,
                         CAST(embedding[3] AS DOUBLE) AS f0, CAST(embedding[4] AS DOUBLE) AS f1 FROM embeddings),
       r AS (SELECT corr(c1, f0) AS r10, corr(c1, f1) AS r11, corr(c2, f0) AS r20, corr(c2, f1) AS r21 FROM x),
       d AS (SELECT *, abs(r10) + abs(r21) >= abs(r11) + abs(r20) AS direct FROM r)
       SELECT 'trunk' AS field, CASE WHEN direct THEN 1 ELSE 2 END AS component,
              round(CASE WHEN direct THEN r10 ELSE r20 END, 8) AS correlation, sign(CASE WHEN direct THEN r10 ELSE r20 END) * 1.0 AS sign FROM d
       UNION ALL
       SELECT 'branch', CASE WHEN direct THEN 2 ELSE 1 END, round(CASE WHEN direct THEN r21 ELSE r11 END, 8),
              sign(CASE WHEN direct THEN r21 ELSE r11 END) * 1.0 FROM d""",
)
def d21(spark, sf):
    scores = consensus.unpack(src.narrow(spark, sf, 0, 1), "sample_id")
    truth = src.narrow(spark, sf, 2, 3).select(
        "sample_id", F.col("vec")[0].alias("trunk"), F.col("vec")[1].alias("branch")
    )
    return rounded(dec.assign_axes(scores, truth, ["trunk", "branch"]), 8, "correlation")


POOLED = (
    TWO_SVD
    + f""", pc AS MATERIALIZED (SELECT 'pool' AS layer, sample_id, layer || ':' || component AS feature_id, coord / sigma AS v
             FROM scores JOIN spectrum USING (layer, component)),
         zg1 AS MATERIALIZED (SELECT a.layer, a.feature_id AS i, b.feature_id AS j, sum(a.v * b.v) AS v
             FROM pc a JOIN pc b USING (layer, sample_id) GROUP BY ALL), {eigen_sql(2, tag="z")}"""
)


@query(
    "d22_pooled_layer_scores",
    POOLED
    + """ SELECT sample_id, component, round(sum(v * loading) / any_value(sigma), 6) + 0.0 AS coord
          FROM pc JOIN zloadings USING (layer, feature_id) JOIN zspectrum USING (layer, component) GROUP BY ALL""",
)
def d22(spark, sf):
    cells = src.two_layers(spark, sf)
    own = dec.svd(cells, k=2, side="features")
    return rounded(dec.pooled_layer_scores(own.scores, own.spectrum), 6, "coord")
