"""Queries for recovery metrics and figure tables (E*, G*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewell.operators import consensus, decompose as dec, evaluate as ev, figures as fig, landscape as ls
from statewell.plans import inputs as src
from statewell.plans.inputs import CENTRED, GRAM, SCORES, eigen_sql
from statewell.plans.landscape_queries import (
    CRITICAL, NEAR, NRD0, PLUGIN, RAW_AT, SEG_K, SMOOTH, curve_sql, heights_sql, seg_curve,
)
from statewell.plans.prep_queries import document_cohort
from statewell.plans.registry import query, rounded, table
from statewell.plans.stage1_queries import LABEL_AXES, PROJECTORS, UNCENTRED, projection_sql


@query(
    "e1_subspace_angle",
    LABEL_AXES
    + """, p AS (SELECT a.component AS pair, a.loading AS a, b.loading AS b FROM axes a JOIN axes b ON a.feature_id = b.feature_id AND b.component = a.component + 1)
         SELECT 'all' AS layer, pair, round(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))), 8) AS cosine,
                round(degrees(acos(least(1.0, abs(sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))))))), 6) AS angle_deg FROM p GROUP BY pair""",
)
def e1(spark, sf):
    """Angles between the axes of neighbouring labels."""
    axes = src.label_loadings(spark, sf)
    first, second = (axes.withColumn("pair", F.col("component") - shift) for shift in (0, 1))
    out = ev.subspace_angle(first.drop("component"), second.drop("component"), ["layer", "pair"])
    return rounded(rounded(out, 8, "cosine"), 6, "angle_deg")


TRUTH = """truth AS (SELECT g, avg(x) - 2000 AS t1, avg(x) + 2000 AS t2, avg(x) AS tb, 0.05 AS th FROM obs GROUP BY g)"""


def segment_truth(spark, sf):
    mean = F.avg("x")
    return src.segments(spark, sf).groupBy("g").agg(
        F.array(mean - 2000, mean + 2000).alias("true_wells"), mean.alias("true_barrier"), F.lit(0.05).alias("true_height")
    )


def recovery_sql(sign: str = "1.0") -> str:
    """CTE ``rec`` from ``cp``, ``hts(g, h)`` and ``truth``, plus ``sg(g, s)``."""
    return f"""w AS (SELECT g, x FROM cp WHERE kind = 'well'), b AS (SELECT g, x FROM cp WHERE kind = 'barrier'),
       sg AS (SELECT g, {sign} AS s FROM truth),
       nw AS (SELECT t.g, (SELECT count(*) FROM w WHERE w.g = t.g) AS n_wells_found,
                     (SELECT count(*) FROM b WHERE b.g = t.g) AS n_barriers_found,
                     (SELECT min(abs(w.x * s - t1)) FROM w WHERE w.g = t.g) AS d1,
                     (SELECT min(abs(w.x * s - t2)) FROM w WHERE w.g = t.g) AS d2,
                     (SELECT min(abs(b.x * s - tb)) FROM b WHERE b.g = t.g) AS db,
                     (SELECT min(abs(h - th)) FROM hts WHERE hts.g = t.g) AS dh
              FROM truth t JOIN sg USING (g)),
       rec AS (SELECT g, CASE WHEN n_wells_found >= 2 THEN (d1 + d2) / 2 END AS well_error, db AS barrier_error,
                      dh AS barrier_height_error, n_wells_found, n_barriers_found FROM nw)"""


HTS = """hts AS (SELECT ba.g, ba.v - la.v AS h FROM ba JOIN la USING (g, ordinal)
             UNION ALL SELECT ba.g, ba.v - ra.v FROM ba JOIN ra USING (g, ordinal))"""

E2 = SEG_K + f", {NEAR}, {heights_sql()}, {HTS}, {TRUTH}, {recovery_sql()}"


def segment_recovery(spark, sf):
    curve = seg_curve(spark, sf)
    critical = ls.critical_points(curve, ["g"])
    barriers = ls.barrier_heights(critical, curve, ["g"], "u_raw")
    return ev.potential_recovery(critical, barriers, segment_truth(spark, sf), ["g"])


@query(
    "e2_potential_recovery",
    E2
    + """ SELECT g, round(well_error, 3) AS well_error, round(barrier_error, 3) AS barrier_error,
                 round(barrier_height_error, 6) AS barrier_height_error, n_wells_found, n_barriers_found FROM rec""",
)
def e2(spark, sf):
    out = segment_recovery(spark, sf)
    return rounded(rounded(out, 3, "well_error", "barrier_error"), 6, "barrier_height_error")


@query(
    "e8_landscape_recovery_rows",
    E2
    + """ SELECT rec.g, n_obs, round(h, 4) AS bandwidth, round(well_error, 3) AS well_error, round(barrier_error, 3) AS barrier_error,
                 round(barrier_height_error, 3) AS barrier_height_error, n_wells_found, n_barriers_found
          FROM rec JOIN bw USING (g)""",
)
def e8(spark, sf):
    params = ls.plugin_bandwidth(src.segments(spark, sf), ["g"]).select("g", "h", "n_obs")
    return rounded(ev.landscape_recovery_rows(segment_recovery(spark, sf), params, ["g"]), 4, "bandwidth")


@query(
    "e3_shared_recovery_error",
    PROJECTORS
    + """ SELECT round(sqrt(2 * (2 - (c11 * c11 + c12 * c12 + c21 * c21 + c22 * c22))) / 2, 7) AS shared_recovery_error FROM k""",
)
def e3(spark, sf):
    a = consensus.orthonormalise(src.narrow(spark, sf, 0, 1), 2)
    b = consensus.orthonormalise(src.narrow(spark, sf, 2, 3), 2)
    return rounded(ev.shared_recovery_error(a, b, 2), 7, "shared_recovery_error")


def half_responses(spark, sf, first, second):
    """Responses per layer and feature: the mean vectors of two labels."""
    emb = table(spark, sf, "embeddings")
    pos = F.col("pos")
    return emb.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy(
        F.when(pos < src.HALF, "A").otherwise("B").alias("layer"),
        F.concat(F.lit("f"), (pos % src.HALF).cast("string")).alias("feature_id"),
    ).agg(
        F.array(*[F.avg(F.when(F.col("label") == x, F.col("v").cast("double"))) for x in (first, second)]).alias("vec")
    )


@query(
    "e4_response_recovery_error",
    f"""WITH {src.CELLS}, r AS (SELECT pos, avg(value) FILTER (WHERE label = 0) AS a0, avg(value) FILTER (WHERE label = 1) AS a1,
               avg(value) FILTER (WHERE label = 2) AS b0, avg(value) FILTER (WHERE label = 3) AS b1 FROM cells GROUP BY pos),
       s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS p, CAST(embedding[2] AS DOUBLE) AS q,
                    CAST(embedding[3] AS DOUBLE) AS u, CAST(embedding[4] AS DOUBLE) AS w FROM embeddings),
       e AS (SELECT pos < 32 AS a, sum(pow(p * a0 + q * a1 - u * b0 - w * b1, 2)) AS num, sum(pow(u * b0 + w * b1, 2)) AS den
             FROM s, r GROUP BY 1)
       SELECT round(avg(sqrt(num / den)), 8) AS response_recovery_error FROM e""",
)
def e4(spark, sf):
    out = ev.response_recovery_error(
        src.narrow(spark, sf, 0, 1), half_responses(spark, sf, 0, 1), src.narrow(spark, sf, 2, 3),
        half_responses(spark, sf, 2, 3), 2,
    )
    return rounded(out, 8, "response_recovery_error")


@query(
    "e5_exclusive_leakage",
    """WITH x AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, embedding AS e FROM embeddings),
       q1 AS (SELECT vec_id, e, a / sqrt(sum(a * a) OVER ()) AS p1, b FROM x),
       q2 AS (SELECT vec_id, e, p1, b - p1 * sum(p1 * b) OVER () AS b2 FROM q1),
       q3 AS (SELECT e, p1, b2 / sqrt(sum(b2 * b2) OVER ()) AS p2 FROM q2),
       l AS (SELECT sqrt(pow(sum(p1 * e[5]), 2) + pow(sum(p1 * e[6]), 2) + pow(sum(p2 * e[5]), 2) + pow(sum(p2 * e[6]), 2)) / sqrt(2) AS a,
                    sqrt(pow(sum(p1 * e[7]), 2) + pow(sum(p1 * e[8]), 2) + pow(sum(p2 * e[7]), 2) + pow(sum(p2 * e[8]), 2)) / sqrt(2) AS b
             FROM q3)
       SELECT round((a + b) / 2, 7) AS exclusive_leakage FROM l""",
)
def e5(spark, sf):
    scores = consensus.orthonormalise(src.narrow(spark, sf, 0, 1), 2)
    ex = [src.narrow(spark, sf, *p).withColumn("layer", F.lit(n)) for n, p in (("A", (4, 5)), ("B", (6, 7)))]
    return rounded(ev.exclusive_leakage(scores, ex[0].unionByName(ex[1]), 2), 7, "exclusive_leakage")


@query(
    "e6_projection_error",
    projection_sql("label < 5", "label >= 5")
    + """, x AS (SELECT CAST(vec_id AS VARCHAR) AS sample_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b
                 FROM embeddings WHERE label >= 5),
         v1 AS (SELECT sample_id, a / sqrt(sum(a * a) OVER ()) AS p1, b FROM x),
         v2 AS (SELECT sample_id, p1, b - p1 * sum(p1 * b) OVER () AS b2 FROM v1),
         v3 AS (SELECT sample_id, p1, b2 / sqrt(sum(b2 * b2) OVER ()) AS p2 FROM v2)
         SELECT round(sqrt(2 * (2 - pow(sum(p1 * q1), 2) - pow(sum(p1 * q2), 2) - pow(sum(p2 * q1), 2) - pow(sum(p2 * q2), 2))) / 2, 6)
                AS projection_error FROM q JOIN v3 USING (sample_id)""",
)
def e6(spark, sf):
    cells = src.two_layers(spark, sf)
    label = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), "label")
    tagged = cells.join(label, "sample_id")
    fit = consensus.fit_candidate(tagged.filter("label < 5").drop("label"), "concatenated", ["A", "B"], 2, side="features")
    held = tagged.filter("label >= 5").drop("label")
    truth = src.narrow(spark, sf, 0, 1).join(label.filter("label >= 5"), "sample_id").select("sample_id", "vec")
    return rounded(ev.projection_error(fit, held, consensus.orthonormalise(truth, 2)), 6, "projection_error")


PER_LABEL = f"""WITH cells AS (SELECT 'L' || label AS layer, CAST(vec_id AS VARCHAR) AS sample_id,
             'd' || lpad(CAST(i - 1 AS VARCHAR), 3, '0') AS feature_id, CAST(embedding[i] AS DOUBLE) AS value
             FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)),
       {CENTRED}, {GRAM}, {eigen_sql(1)}, {SCORES},
       tv AS (SELECT layer, feature_id, avg(value) AS t FROM cells GROUP BY ALL),
       ang AS (SELECT l.layer AS g, sum(loading * t) / (sqrt(sum(loading * loading)) * sqrt(sum(t * t))) AS cosine
               FROM loadings l JOIN tv USING (layer, feature_id) GROUP BY l.layer)"""


def per_label(spark, sf):
    """One cohort per label: its SVD, and the cohort's mean vector as the true axis."""
    emb = table(spark, sf, "embeddings").withColumn("layer", F.concat(F.lit("L"), F.col("label").cast("string")))
    rows = emb.select("layer", F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").cast("array<double>").alias("vec"))
    cells = rows.select("layer", "sample_id", F.posexplode("vec").alias("pos", "value")).select(
        "layer", "sample_id", F.concat(F.lit("d"), F.lpad(F.col("pos").cast("string"), 3, "0")).alias("feature_id"), "value"
    )
    truth = cells.groupBy("layer", "feature_id").agg(F.avg("value").alias("loading"))
    return cells, dec.svd(cells, k=1, rows=rows, feature_ids=src.FEATURES), truth


@query(
    "e7_recovery_rows",
    PER_LABEL
    + """, th AS (SELECT layer, pow(count(*), 0.25) AS threshold FROM cells GROUP BY layer)
         SELECT s.layer, round(degrees(acos(least(1.0, abs(cosine)))), 2) AS angle_deg, round(threshold, 2) AS threshold,
                sigma >= threshold AS signal_above_threshold, CAST(CASE WHEN sigma < threshold THEN 1 ELSE 0 END AS BIGINT) AS n_warnings
         FROM spectrum s JOIN ang ON ang.g = s.layer JOIN th ON th.layer = s.layer""",
)
def e7(spark, sf):
    cells, d, truth = per_label(spark, sf)
    return ev.recovery_rows(
        d.axis(1), truth, d.spectrum.filter("component = 1"), dec.detectability(cells), d.warnings, ["layer"]
    )


@query(
    "e9_calibration_rows",
    PER_LABEL
    + f""", obs AS MATERIALIZED (SELECT layer AS g, coord AS x FROM scores), {PLUGIN}, {curve_sql()}, {CRITICAL}, {SMOOTH}, {NEAR},
         rw AS MATERIALIZED (SELECT * FROM pot),
         ba AS {RAW_AT.format(q='(SELECT g, ordinal, x FROM near)').replace('u_raw', 'u').replace('pot', 'sm')},
         la AS {RAW_AT.format(q='(SELECT g, ordinal, left_well AS x FROM near WHERE left_well IS NOT NULL)').replace('u_raw', 'u').replace('pot', 'sm')},
         ra AS {RAW_AT.format(q='(SELECT g, ordinal, right_well AS x FROM near WHERE right_well IS NOT NULL)').replace('u_raw', 'u').replace('pot', 'sm')},
         {HTS}, truth AS (SELECT g, -0.1 AS t1, 0.1 AS t2, 0.0 AS tb, 0.5 AS th FROM ang),
         {recovery_sql("(SELECT CASE WHEN cosine < 0 THEN -1.0 ELSE 1.0 END FROM ang WHERE ang.g = truth.g)")}
         SELECT rec.g AS layer, round(degrees(acos(least(1.0, abs(cosine)))), 3) AS subspace_angle_deg, cosine < 0 AS orientation_flipped,
                0.5 AS true_barrier_height, round(well_error, 4) AS well_error, round(barrier_error, 4) AS barrier_error,
                round(barrier_height_error, 3) AS barrier_height_error, n_wells_found, n_barriers_found
         FROM rec JOIN ang USING (g)""",
)
def e9(spark, sf):
    _, d, truth = per_label(spark, sf)
    land = ls.landscape(ls.select_coordinates(d.scores, 1, ["layer"]), ["layer"])
    known = d.spectrum.filter("component = 1").select(
        "layer", F.array(F.lit(-0.1), F.lit(0.1)).alias("true_wells"), F.lit(0.0).alias("true_barrier"), F.lit(0.5).alias("true_height")
    )
    out = ev.calibration_rows(d.axis(1), truth, land.critical, land.barriers, known, ["layer"])
    out = rounded(rounded(out, 4, "well_error", "barrier_error"), 3, "barrier_height_error", "subspace_angle_deg")
    return out


@query(
    "e10_gate_columns",
    """WITH x AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey,
                         CASE WHEN l_returnflag = 'N' THEN 'missing_id' ELSE 'exact_ids' END AS c, l_quantity > 2 AS a,
                         l_discount > 0.01 AS h, l_tax > 0.01 AS e, l_linestatus = 'F' OR l_quantity > 10 AS m, l_discount AS d FROM lineitem),
       g AS (SELECT *, CASE WHEN c = 'missing_id' THEN m ELSE a AND h AND e AND m END AS ok FROM x)
       SELECT CASE WHEN c = 'missing_id' THEN 'typed_failure' ELSE 'success' END AS gate_expected,
              CASE WHEN c = 'missing_id' THEN CASE WHEN ok THEN 'typed_failure' ELSE 'unexpected_success' END
                   WHEN ok THEN 'success' ELSE 'failure' END AS gate_observed, ok AS gate_passed,
              CASE WHEN c = 'missing_id' THEN CASE WHEN ok THEN 'expected projection feature-ID typed failure'
                   ELSE 'missing-ID negative control did not produce a typed failure' END END AS failure_reason,
              count(*) AS n, count(CASE WHEN c = 'exact_ids' THEN d END) AS n_metric
       FROM g GROUP BY ALL""",
)
def e10(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.when(F.col("l_returnflag") == "N", "missing_id").otherwise("exact_ids").alias("projection_case"),
        (F.col("l_quantity") > 2).alias("sample_map_aligned"), (F.col("l_discount") > 0.01).alias("heterogeneous_features"),
        (F.col("l_tax") > 0.01).alias("extra_rejected"),
        ((F.col("l_linestatus") == "F") | (F.col("l_quantity") > 10)).alias("missing_rejected"),
        F.lit(True).alias("permutation_invariant"), F.col("l_discount").alias("shared_recovery_error"),
    )
    return ev.gate_columns(rows).groupBy("gate_expected", "gate_observed", "gate_passed", "failure_reason").agg(
        F.count("*").alias("n"), F.count("shared_recovery_error").alias("n_metric")
    )


@query(
    "e11_alignment_gates",
    """SELECT (SELECT count(*) FROM documents d JOIN labels l USING (doc_id) WHERE d.doc_id IS NULL) = 0 AS sample_map_aligned,
              count(DISTINCT lang) > 0 AS heterogeneous_features FROM documents""",
)
def e11(spark, sf):
    from statewell.operators.contracts import complete_cohort

    c = document_cohort(spark, sf)
    return ev.alignment_gates(complete_cohort(c.sample_map, 2), c.samples, c.cells)


@query(
    "e11_alignment_gates_broken",
    """SELECT count(*) FILTER (WHERE lang = 'fr') = 0 AS sample_map_aligned,
              (SELECT count(DISTINCT f) FROM (SELECT unnest(['quality', 'toxic']) AS f FROM labels)) <> count(DISTINCT 1) + 1 AS heterogeneous_features
       FROM documents JOIN labels USING (doc_id)""",
)
def e11_broken(spark, sf):
    """Metadata without the French texts, and two layers of two features each."""
    from statewell.operators.contracts import complete_cohort

    c = document_cohort(spark, sf)
    twice = c.cells.filter("layer = 'label'").withColumn("layer", F.lit("text")).unionByName(c.cells.filter("layer = 'label'"))
    return ev.alignment_gates(complete_cohort(c.sample_map, 2), c.samples.filter("lang <> 'fr'"), twice)


# --- figure tables ---------------------------------------------------------------------


def gallery_inputs(spark, sf):
    emb = table(spark, sf, "embeddings")
    scores = consensus.unpack(src.narrow(spark, sf, 0, 1, 2), "sample_id").withColumn("layer", F.lit("all"))
    sid = F.col("vec_id").cast("string")
    mapping = emb.select(F.lit("all").alias("layer"), F.concat(F.lit("p"), sid).alias("primary_id"), sid.alias("sample_id"))
    samples = emb.select(F.concat(F.lit("p"), sid).alias("primary_id"), "label")
    return scores, mapping, samples


@query(
    "g1_gallery",
    f"""WITH {src.CELLS} SELECT layer, sample_id, CAST(pos + 1 AS INTEGER) AS component, 'PC' || (pos + 1) AS panel,
        round(value, 9) + 0.0 AS coord, label AS metadata_value FROM cells WHERE pos < 2""",
)
def g1(spark, sf):
    return rounded(fig.gallery(*gallery_inputs(spark, sf), "label", 2), 9, "coord")


@query(
    "g1_gallery_density",
    f"""WITH {src.CELLS}, obs AS (SELECT (pos + 1) || '|' || label AS g, value AS x FROM cells WHERE pos < 2), {NRD0}, {curve_sql(3.0)}
        SELECT 'all' AS layer, CAST(split_part(g, '|', 1) AS INTEGER) AS component, CAST(split_part(g, '|', 2) AS INTEGER) AS metadata_value,
               i, round(x, 7) + 0.0 AS x, round(density, 7) AS density FROM curve""",
)
def g1_density(spark, sf):
    return rounded(fig.gallery_density(fig.gallery(*gallery_inputs(spark, sf), "label", 2)), 7, "x", "density")


@query(
    "g2_rank_ordered",
    f"""WITH {src.CELLS} SELECT layer, sample_id, round(value, 9) + 0.0 AS coord,
        row_number() OVER (PARTITION BY layer ORDER BY value, sample_id) AS sample_ord FROM cells WHERE pos = 0""",
)
def g2(spark, sf):
    return rounded(fig.rank_ordered(gallery_inputs(spark, sf)[0]), 9, "coord")


@query(
    "g2_rank_ordered_lines",
    """SELECT l_returnflag AS layer, l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS sample_id,
              l_extendedprice AS coord, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice,
              l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey) AS sample_ord FROM lineitem""",
)
def g2_lines(spark, sf):
    """Ranks over three large groups."""
    name = F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    scores = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("layer"), name.alias("sample_id"), F.lit(1).alias("component"),
        F.col("l_extendedprice").alias("coord"),
    )
    return fig.rank_ordered(scores)


@query(
    "g3_clip_component",
    """SELECT DISTINCT 5 AS requested, 3 AS available, 3 AS component,
              'no component 5 in every layer; component 3 is drawn instead' AS warning FROM embeddings""",
)
def g3(spark, sf):
    return fig.clip_component(gallery_inputs(spark, sf)[0], 5)


@query(
    "g4_potential_table",
    SEG_K
    + f""" SELECT g, 'curve' AS kind, i AS position, round(x, 3) + 0.0 AS x, round(u_raw, 6) AS u FROM pot
          UNION ALL SELECT g, kind, ordinal, round(x, 3) + 0.0, round(v, 6) FROM {RAW_AT.format(q='cp')}""",
)
def g4(spark, sf):
    curve = seg_curve(spark, sf)
    critical = ls.critical_points(curve, ["g"])
    out = fig.potential_table(curve.withColumn("u", F.col("u_raw")), critical, ["g"], True)
    return rounded(rounded(out, 3, "x"), 6, "u")


@query(
    "g5_barrier_segments",
    SEG_K
    + f""", {NEAR}, {heights_sql()} SELECT g, ordinal, 'left' AS side, round(la.x, 3) + 0.0 AS x, round(la.x, 3) + 0.0 AS xend,
          round(la.v, 6) AS y, round(ba.v, 6) AS yend FROM la JOIN ba USING (g, ordinal)
          UNION ALL SELECT g, ordinal, 'right', round(ra.x, 3) + 0.0, round(ra.x, 3) + 0.0, round(ra.v, 6), round(ba.v, 6)
          FROM ra JOIN ba USING (g, ordinal)""",
)
def g5(spark, sf):
    curve = seg_curve(spark, sf)
    out = fig.barrier_segments(ls.critical_points(curve, ["g"]), curve, ["g"], "u_raw")
    return rounded(rounded(out, 3, "x", "xend"), 6, "y", "yend")


@query(
    "g6_rug",
    f"WITH {src.CELLS} SELECT layer, sample_id, round(value, 9) + 0.0 AS x, label AS metadata_value FROM cells WHERE pos = 0",
)
def g6(spark, sf):
    meta = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), "label")
    return rounded(fig.rug(gallery_inputs(spark, sf)[0], meta, "label"), 9, "x")


@query(
    "g7_group_mean_path",
    """SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(l_quantity), 8) AS l_quantity,
              round(avg(l_extendedprice), 6) AS l_extendedprice FROM lineitem GROUP BY ALL""",
)
def g7(spark, sf):
    out = fig.group_mean_path(
        table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"], ["l_quantity", "l_extendedprice"]
    )
    return rounded(rounded(out, 8, "l_quantity"), 6, "l_extendedprice")


@query(
    "g8_spectrum_table",
    UNCENTRED
    + """ SELECT layer, component, round(sigma, 7) AS sigma, round((SELECT pow(count(*), 0.25) FROM cells), 7) AS threshold,
                 sigma >= (SELECT pow(count(*), 0.25) FROM cells) AS detectable FROM spectrum""",
)
def g8(spark, sf):
    return rounded(fig.spectrum_table(src.cells(spark, sf), n_values=3, side="features"), 7, "sigma", "threshold")


@query(
    "g8_whole_spectrum",
    f"""WITH {src.CELLS}, centred AS (SELECT layer, sample_id, feature_id, value AS v FROM cells), {GRAM}
        SELECT layer, round(sum(v) FILTER (WHERE i = j), 5) AS squares, round((SELECT pow(count(*), 0.25) FROM cells), 7) AS threshold FROM g1 GROUP BY layer""",
)
def g8_whole(spark, sf):
    """The table with all values: their squares add up to the squares of all cells, beside the threshold."""
    values = fig.spectrum_table(src.cells(spark, sf), n_values=src.WIDTH, side="features")
    sums = values.groupBy("layer").agg(F.sum(F.col("sigma") ** 2).alias("squares"), F.max("threshold").alias("threshold"))
    return rounded(rounded(sums, 5, "squares"), 7, "threshold")
