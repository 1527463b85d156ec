"""Queries for densities, potentials and critical points (K*), and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewell.common import materialise
from statewell.operators import landscape as ls
from statewell.operators.quantiles import grouped_median, grouped_quantiles
from statewell.plans import inputs as src
from statewell.plans.inputs import CELLS, CENTRED, GRAM, SCORES, eigen_sql
from statewell.plans.registry import query, rounded, table
from statewell.plans.stage1_queries import svd

SEGMENTS = "obs AS (SELECT c_mktsegment AS g, c_acctbal AS x FROM customer)"
PRIORITY = "obs AS (SELECT o_orderpriority AS g, o_totalprice AS x FROM orders)"

STATS = """stats AS MATERIALIZED (SELECT g, count(*) AS n, avg(x) AS mu, stddev_samp(x) AS sd, min(x) AS lo, max(x) AS hi,
             quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS iqr FROM obs GROUP BY g)"""

BINS = """b0 AS (SELECT g, least(floor(p), 399) AS b, p - least(floor(p), 399) AS f
             FROM (SELECT o.g, (o.x - s.lo) / (s.hi - s.lo) * 400 AS p FROM obs o JOIN stats s USING (g))),
       bins AS MATERIALIZED (SELECT g, CAST(b AS INTEGER) AS bin, sum(w) AS w
             FROM (SELECT g, b, 1 - f AS w FROM b0 UNION ALL SELECT g, b + 1, f FROM b0) GROUP BY g, b)"""

PLUGIN = f"""{STATS}, {BINS},
       sc AS (SELECT *, least(sd, iqr / 1.349) AS s FROM stats),
       s6 AS (SELECT *, (hi - lo) / s / 400 AS delta, pow(2 * pow(sqrt(2), 9) / (7 * n), 1.0 / 9) AS g6 FROM sc),
       e6 AS (SELECT g, sum(wa * wb * (pow(z, 6) - 15 * pow(z, 4) + 45 * z * z - 15) * exp(-z * z / 2)) AS t
              FROM (SELECT a.g, a.w AS wa, b.w AS wb, abs(a.bin - b.bin) * delta / g6 AS z FROM bins a
                    JOIN bins b ON a.g = b.g JOIN s6 ON a.g = s6.g
                    WHERE abs(a.bin - b.bin) <= floor(10 * g6 / delta)) GROUP BY g),
       s4 AS (SELECT s6.*, pow(-3 * sqrt(2 / pi()) / (t / sqrt(2 * pi()) / pow(g6, 7) / (n * n) * n), 1.0 / 7) AS g4
              FROM s6 JOIN e6 USING (g)),
       e4 AS (SELECT g, sum(wa * wb * (pow(z, 4) - 6 * z * z + 3) * exp(-z * z / 2)) AS t
              FROM (SELECT a.g, a.w AS wa, b.w AS wb, abs(a.bin - b.bin) * delta / g4 AS z FROM bins a
                    JOIN bins b ON a.g = b.g JOIN s4 ON a.g = s4.g
                    WHERE abs(a.bin - b.bin) <= floor(8 * g4 / delta)) GROUP BY g),
       bw AS MATERIALIZED (SELECT s4.g, n AS n_obs, lo AS x_min, hi AS x_max,
              s * pow(1 / (4 * pi()), 0.1) * pow(1 / (t / sqrt(2 * pi()) / pow(g4, 5) / (n * n) * n), 0.2) AS h
              FROM s4 JOIN e4 USING (g))"""

NRD0 = f"""{STATS}, bw AS MATERIALIZED (SELECT g, n AS n_obs, lo AS x_min, hi AS x_max,
             0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS h FROM stats)"""


def curve_sql(reach: float = 2.0) -> str:
    return f"""grid AS (SELECT g, h, n_obs, i, x_min - {reach} * h + i * (x_max - x_min + 2 * {reach} * h) / 511 AS x
             FROM bw, (SELECT CAST(unnest(range(512)) AS INTEGER) AS i)),
       curve AS MATERIALIZED (SELECT p.g, p.i, p.x, sum(exp(-0.5 * pow((p.x - o.x) / p.h, 2))) / (p.n_obs * p.h * sqrt(2 * pi())) AS density
             FROM grid p JOIN obs o ON p.g = o.g GROUP BY p.g, p.i, p.x, p.n_obs, p.h),
       pot AS MATERIALIZED (SELECT *, -ln(greatest(density, 2.220446049250313e-16)) AS u_raw FROM curve)"""


CRITICAL = """sl AS (SELECT g, i, (u1 - u_raw) / (x1 - x) AS slope, (x1 + x) / 2 AS mid
             FROM (SELECT *, lead(x) OVER w AS x1, lead(u_raw) OVER w AS u1 FROM pot WINDOW w AS (PARTITION BY g ORDER BY i))
             WHERE x1 IS NOT NULL),
       ch AS (SELECT *, lead(slope) OVER w AS s1, lead(mid) OVER w AS m1 FROM sl WINDOW w AS (PARTITION BY g ORDER BY i)),
       ct AS (SELECT g, CASE WHEN slope < 0 AND s1 > 0 THEN 'well' WHEN slope > 0 AND s1 < 0 THEN 'barrier' END AS kind,
                     mid - slope * (m1 - mid) / (s1 - slope) AS x FROM ch WHERE sign(slope) <> sign(s1)),
       cp AS MATERIALIZED (SELECT *, CAST(row_number() OVER (PARTITION BY g, kind ORDER BY x) AS INTEGER) AS ordinal
             FROM ct WHERE kind IS NOT NULL)"""

# value of the raw potential at positions q(g, x): uniform-grid interpolation
RAW_AT = """(SELECT q.*, a.u_raw + (q.x - a.x) / (b.x - a.x) * (b.u_raw - a.u_raw) AS v FROM {q} q
             JOIN (SELECT g, min(x) AS lo, max(x) AS hi FROM pot GROUP BY g) r ON q.g = r.g
             JOIN pot a ON a.g = q.g AND a.i = CAST(least(floor((q.x - r.lo) / (r.hi - r.lo) * 511), 510) AS INTEGER)
             JOIN pot b ON b.g = q.g AND b.i = a.i + 1)"""



def _smooth_sql() -> str:
    """CTE ``sm(g, i, x, u_raw, u)``: the constrained polynomial of degree 6.

    Constraint rows (weight 1) and grid rows (weight 0) go through one
    Gram-Schmidt pass over the powers; inner products see the constraints only,
    so the fitted values appear on the grid without solving for coefficients.
    """
    powers = range(7)
    value = ", ".join(f"pow(t, {k}) AS c{k}" for k in powers)
    slope = ", ".join("0.0::DOUBLE AS c0" if k == 0 else f"{k} * pow(t, {k - 1}) * s AS c{k}" for k in powers)
    out = [
        f"cf AS MATERIALIZED (SELECT g, x, v AS f FROM {RAW_AT.format(q='cp')})",
        "rg AS (SELECT g, min(x) AS lo, max(x) AS hi FROM pot GROUP BY g)",
        "pts AS (SELECT g, 2 * (x - lo) / (hi - lo) - 1 AS t, 2 / (hi - lo) AS s, f FROM cf JOIN rg USING (g))",
        f"""st0 AS MATERIALIZED (SELECT g, NULL AS i, 1 AS w, {value}, f AS y, 0.0::DOUBLE AS fit FROM pts
            UNION ALL SELECT g, NULL, 1, {slope}, 0, 0 FROM pts
            UNION ALL SELECT g, i, 0, {value}, 0, 0 FROM (SELECT g, i, 2 * (x - lo) / (hi - lo) - 1 AS t FROM pot JOIN rg USING (g)))""",
        "o AS (SELECT g, " + ", ".join(f"sqrt(sum(w * c{k} * c{k})) AS o{k}" for k in powers) + " FROM st0 GROUP BY g)",
    ]
    for k in powers:
        rest = "".join(f", c{j}" for j in range(k + 1, 7))
        out.append(
            f"""q{k} AS MATERIALIZED (SELECT g, i, w, y, fit{rest}, CASE WHEN n >= 1e-7 * o{k} THEN c{k} / n ELSE 0 END AS q
            FROM (SELECT *, sqrt(sum(w * c{k} * c{k}) OVER (PARTITION BY g)) AS n FROM st{k}) JOIN o USING (g))"""
        )
        next_ = "".join(f", c{j} - q * sum(w * q * c{j}) OVER (PARTITION BY g) AS c{j}" for j in range(k + 1, 7))
        out.append(
            f"""st{k + 1} AS MATERIALIZED (SELECT g, i, w, y - q * sum(w * q * y) OVER (PARTITION BY g) AS y,
            fit + q * sum(w * q * y) OVER (PARTITION BY g) AS fit{next_} FROM q{k})"""
        )
    out.append("cn AS (SELECT g, count(*) AS c FROM cp GROUP BY g)")
    out.append(
        """sm AS MATERIALIZED (SELECT p.g, p.i, p.x, p.u_raw, CASE WHEN c >= 2 THEN fit ELSE p.u_raw END AS u
            FROM pot p LEFT JOIN cn USING (g) LEFT JOIN st7 ON st7.g = p.g AND st7.i = p.i)"""
    )
    return ", ".join(out)


SMOOTH = _smooth_sql()

NEAR = """near AS MATERIALIZED (SELECT b.g, b.ordinal, b.x,
             (SELECT max(w.x) FROM cp w WHERE w.g = b.g AND w.kind = 'well' AND w.x < b.x) AS left_well,
             (SELECT min(w.x) FROM cp w WHERE w.g = b.g AND w.kind = 'well' AND w.x > b.x) AS right_well
             FROM cp b WHERE b.kind = 'barrier')"""

SEG_K = f"WITH {SEGMENTS}, {PLUGIN}, {curve_sql()}, {CRITICAL}"


def seg_curve(spark, sf):
    """The potential of every market segment, materialised for the steps after it."""
    obs = src.segments(spark, sf)
    return materialise(ls.density_curve(obs, ls.plugin_bandwidth(obs, ["g"]), ["g"]))


@query(
    "k1_pooled_coordinates",
    f"WITH {CELLS} SELECT round(value, 9) + 0.0 AS x FROM cells WHERE pos IN (0, 32)",
)
def k1(spark, sf):
    """Component 1 of both layers pooled: first position of each half."""
    from statewell.operators.consensus import unpack

    pos = [unpack(src.narrow(spark, sf, p), "sample_id").withColumn("layer", F.lit(n)) for p, n in ((0, "A"), (32, "B"))]
    return rounded(ls.select_coordinates(pos[0].unionByName(pos[1]), 1), 9, "x")


@query(
    "k2_minimum_n",
    """SELECT 'minimum_n' AS "check", l_orderkey || '|' || l_returnflag AS key,
              count(*) || ' coordinate values, need 5' AS detail
       FROM lineitem GROUP BY l_orderkey, l_returnflag HAVING count(*) < 5""",
)
def k2(spark, sf):
    obs = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", F.col("l_quantity").alias("x"))
    return ls.minimum_n_violations(obs, ["l_orderkey", "l_returnflag"])


@query(
    "k3_spread",
    f"WITH {PRIORITY}, {STATS} SELECT g, n AS n_obs, round(sd, 5) AS sd, round(iqr, 5) AS iqr FROM stats",
)
def k3_spread(spark, sf):
    s = ls.spread(orders_obs(spark, sf), ["g"])
    return rounded(s.select("g", "n_obs", F.col("x_sd").alias("sd"), F.col("x_iqr").alias("iqr")), 5, "sd", "iqr")


def orders_obs(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("x"))


@query("k3_plugin_bandwidth", f"WITH {PRIORITY}, {PLUGIN} SELECT g, round(h, 5) AS h FROM bw")
def k3_dpi(spark, sf):
    return rounded(ls.plugin_bandwidth(orders_obs(spark, sf), ["g"]).select("g", "h"), 5, "h")


@query("k3_linear_bins", f"WITH {PRIORITY}, {STATS}, {BINS} SELECT g, bin, round(w, 6) AS w FROM bins")
def k3_bins(spark, sf):
    obs = orders_obs(spark, sf)
    stats = obs.groupBy("g").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    return rounded(ls.linear_bins(obs, stats, ["g"]), 6, "w")


@query("k3_reference_bandwidth", f"WITH {PRIORITY}, {NRD0} SELECT g, round(h, 5) AS h FROM bw")
def k3_nrd0(spark, sf):
    return rounded(ls.normal_reference_bandwidth(orders_obs(spark, sf), ["g"]).select("g", "h"), 5, "h")


@query(
    "k4_evaluation_grid",
    f"WITH {SEGMENTS}, {PLUGIN}, {curve_sql()} SELECT g, i, round(x, 4) + 0.0 AS x FROM grid",
)
def k4(spark, sf):
    obs = src.segments(spark, sf)
    return rounded(ls.evaluation_grid(ls.plugin_bandwidth(obs, ["g"]), ["g"]).select("g", "i", "x"), 4, "x")


@query(
    "k5_density_curve",
    f"WITH {PRIORITY}, {PLUGIN}, {curve_sql()} SELECT g, i, round(x, 3) + 0.0 AS x, round(density, 13) AS density FROM curve",
)
def k5(spark, sf):
    obs = orders_obs(spark, sf)
    curve = ls.density_curve(obs, ls.plugin_bandwidth(obs, ["g"]), ["g"]).select("g", "i", "x", "density")
    return rounded(rounded(curve, 3, "x"), 13, "density")


@query(
    "k6_quasi_potential",
    f"WITH {SEGMENTS}, {PLUGIN}, {curve_sql()} SELECT g, i, round(u_raw, 7) AS u_raw FROM pot",
)
def k6(spark, sf):
    return rounded(seg_curve(spark, sf).select("g", "i", "u_raw"), 7, "u_raw")


@query(
    "k7_slopes",
    f"WITH {SEGMENTS}, {PLUGIN}, {curve_sql()}, {CRITICAL} SELECT g, i, round(slope, 9) + 0.0 AS slope, round(mid, 4) + 0.0 AS mid FROM sl",
)
def k7(spark, sf):
    return rounded(rounded(ls.slopes(seg_curve(spark, sf), ["g"]).drop("_lo", "_hi"), 9, "slope"), 4, "mid")


@query("k8_k10_critical_points", SEG_K + " SELECT g, kind, round(x, 3) + 0.0 AS x, ordinal FROM cp")
def k8(spark, sf):
    return rounded(ls.critical_points(seg_curve(spark, sf), ["g"]), 3, "x")


@query(
    "k11_interpolate",
    f"WITH {SEGMENTS}, {PLUGIN}, {curve_sql()}, q AS (SELECT * FROM obs) SELECT g, x, round(v, 6) AS u FROM {RAW_AT.format(q='q')}",
)
def k11(spark, sf):
    """The potential at every observation."""
    obs = src.segments(spark, sf)
    curve = seg_curve(spark, sf)
    return rounded(ls.interpolate(obs, curve, ["g"], "u_raw", "u"), 6, "u")


@query(
    "k12_polynomial_smooth",
    SEG_K + f", {SMOOTH} SELECT g, i, round(u_raw, 5) + 0.0 AS u_raw, round(u, 4) + 0.0 AS u FROM sm",
)
def k12(spark, sf):
    curve = seg_curve(spark, sf)
    out = ls.smooth_curve(curve, ls.critical_points(curve, ["g"]), ["g"])
    return rounded(rounded(out.select("g", "i", "u_raw", "u"), 5, "u_raw"), 4, "u")


@query(
    "k13_nearest_wells",
    SEG_K + f", {NEAR} SELECT g, ordinal, round(x, 3) + 0.0 AS x, round(left_well, 3) + 0.0 AS left_well, round(right_well, 3) + 0.0 AS right_well FROM near",
)
def k13_near(spark, sf):
    near = ls.nearest_wells(ls.critical_points(seg_curve(spark, sf), ["g"]), ["g"])
    return rounded(near, 3, "x", "left_well", "right_well")


def heights_sql(u: str = "u_raw") -> str:
    at = RAW_AT
    return f"""ba AS {at.format(q='(SELECT g, ordinal, x FROM near)')},
       la AS {at.format(q='(SELECT g, ordinal, left_well AS x FROM near WHERE left_well IS NOT NULL)')},
       ra AS {at.format(q='(SELECT g, ordinal, right_well AS x FROM near WHERE right_well IS NOT NULL)')}"""


@query(
    "k13_barrier_heights_raw",
    SEG_K
    + f""", {NEAR}, {heights_sql()} SELECT ba.g, ba.ordinal, round(ba.v, 5) AS u, round(ba.v - la.v, 5) AS left_height,
          round(ba.v - ra.v, 5) AS right_height
          FROM ba LEFT JOIN la USING (g, ordinal) LEFT JOIN ra USING (g, ordinal)""",
)
def k13_raw(spark, sf):
    curve = seg_curve(spark, sf)
    out = ls.barrier_heights(ls.critical_points(curve, ["g"]), curve, ["g"], "u_raw")
    return rounded(out.select("g", "ordinal", "u", "left_height", "right_height"), 5, "u", "left_height", "right_height")


def smooth_heights_sql() -> str:
    return heights_sql().replace("u_raw", "u").replace("pot", "sm")


@query(
    "k14_landscape_barriers",
    SEG_K
    + f""", {SMOOTH}, {NEAR}, {smooth_heights_sql()}
        SELECT near.g, near.ordinal, round(near.x, 3) + 0.0 AS x, round(ba.v, 3) + 0.0 AS u, round(left_well, 3) + 0.0 AS left_well,
               round(right_well, 3) + 0.0 AS right_well, round(ba.v - la.v, 3) + 0.0 AS left_height, round(ba.v - ra.v, 3) + 0.0 AS right_height
        FROM near JOIN ba USING (g, ordinal) LEFT JOIN la USING (g, ordinal) LEFT JOIN ra USING (g, ordinal)""",
)
def k14_barriers(spark, sf):
    land = ls.landscape(src.segments(spark, sf), ["g"])
    return rounded(land.barriers, 3, "x", "u", "left_well", "right_well", "left_height", "right_height")


SVD_OBS = f"""{CELLS}, {CENTRED}, {GRAM}, {eigen_sql(1)}, {SCORES},
       obs AS MATERIALIZED (SELECT 'all' AS g, coord AS x FROM scores)"""


@query(
    "k14_critical_points_svd",
    f"WITH {SVD_OBS}, {PLUGIN}, {curve_sql()}, {CRITICAL} SELECT g AS layer, kind, round(x, 5) + 0.0 AS x, ordinal FROM cp",
)
def k14_svd(spark, sf):
    """Flagship: embeddings, SVD, density, potential, critical points."""
    scores = svd(spark, sf, 1).scores
    land = ls.landscape(ls.select_coordinates(scores, 1, ["layer"]), ["layer"])
    return rounded(land.critical, 5, "x")


LABEL_OBS = "obs AS (SELECT label AS g, CAST(embedding[1] AS DOUBLE) AS x FROM embeddings)"


def label_obs(spark, sf):
    emb = table(spark, sf, "embeddings")
    return emb.select(F.col("label").alias("g"), F.col("embedding")[0].cast("double").alias("x"))


@query(
    "k14_landscape_by_label",
    f"""WITH {LABEL_OBS}, {PLUGIN}, {curve_sql()}, {CRITICAL}, {SMOOTH}
        SELECT g, i, round(x, 6) + 0.0 AS x, round(u_raw, 5) + 0.0 AS u_raw, round(u, 4) + 0.0 AS u FROM sm""",
)
def k14_labels(spark, sf):
    land = ls.landscape(label_obs(spark, sf), ["g"])
    out = land.curve.select("g", "i", "x", "u_raw", "u")
    return rounded(rounded(rounded(out, 6, "x"), 5, "u_raw"), 4, "u")


@query(
    "k14_barriers_by_label",
    f"""WITH {LABEL_OBS}, {PLUGIN}, {curve_sql()}, {CRITICAL}, {SMOOTH}, {NEAR}, {smooth_heights_sql()}
        SELECT ba.g, ba.ordinal, round(ba.x, 5) + 0.0 AS x, round(ba.v, 4) + 0.0 AS u, round(ba.v - la.v, 4) + 0.0 AS left_height,
               round(ba.v - ra.v, 4) + 0.0 AS right_height
        FROM ba LEFT JOIN la USING (g, ordinal) LEFT JOIN ra USING (g, ordinal)""",
)
def k14_label_barriers(spark, sf):
    land = ls.landscape(label_obs(spark, sf), ["g"])
    out = land.barriers.select("g", "ordinal", "x", "u", "left_height", "right_height")
    return rounded(rounded(out, 5, "x"), 4, "u", "left_height", "right_height")


@query(
    "k15_empirical_density",
    f"WITH {SEGMENTS}, {NRD0}, {curve_sql(3.0)} SELECT g, i, round(x, 4) + 0.0 AS x, round(density, 12) AS density FROM curve",
)
def k15(spark, sf):
    out = ls.empirical_density(src.segments(spark, sf), ["g"])
    return rounded(rounded(out, 4, "x"), 12, "density")


@query(
    "k16_density_2d",
    """WITH o AS (SELECT l_returnflag AS g, l_quantity AS a, l_extendedprice AS b FROM lineitem),
       s AS (SELECT g, count(*) AS n, min(a) AS la, (max(a) - min(a)) / 99 AS sa, min(b) AS lb, (max(b) - min(b)) / 99 AS sb,
             1.06 * least(stddev_samp(a), (quantile_cont(a, 0.75) - quantile_cont(a, 0.25)) / 1.34) * pow(count(*), -0.2) AS ha,
             1.06 * least(stddev_samp(b), (quantile_cont(b, 0.75) - quantile_cont(b, 0.25)) / 1.34) * pow(count(*), -0.2) AS hb
             FROM o GROUP BY g),
       ky AS (SELECT g, a, j, sum(exp(-0.5 * pow((lb + j * sb - b) / hb, 2))) AS k FROM o JOIN s USING (g),
              (SELECT CAST(unnest(range(100)) AS INTEGER) AS j) GROUP BY ALL),
       t AS (SELECT g, i, j, sum(k * exp(-0.5 * pow((la + i * sa - a) / ha, 2))) AS v FROM ky JOIN s USING (g),
              (SELECT CAST(unnest(range(100)) AS INTEGER) AS i) GROUP BY ALL)
       SELECT g, i, j, round(la + i * sa, 4) AS x, round(lb + j * sb, 4) AS y, round(v / (n * ha * hb * 2 * pi()), 12) AS density
       FROM t JOIN s USING (g)""",
)
def k16(spark, sf):
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), "l_quantity", "l_extendedprice")
    out = ls.density_2d(li, ["g"], "l_quantity", "l_extendedprice")
    return rounded(rounded(out, 4, "x", "y"), 12, "density")


@query(
    "k14_degenerate_groups",
    """WITH o AS (SELECT c_mktsegment AS g, count(*) AS n, count(*) FILTER (WHERE c_custkey % 7 = 0) AS odd FROM customer GROUP BY 1)
       SELECT CASE g WHEN 'BUILDING' THEN 'degenerate_spread' WHEN 'MACHINERY' THEN 'degenerate_spread'
                     WHEN 'HOUSEHOLD' THEN 'observation_not_finite' ELSE 'curve' END AS "check", g AS key,
              CASE g WHEN 'HOUSEHOLD' THEN odd || ' observations' WHEN 'BUILDING' THEN n || ' observations'
                     WHEN 'MACHINERY' THEN n || ' observations' ELSE '512 points' END AS detail FROM o""",
)
def k14_degenerate(spark, sf):
    """A constant segment, one with quartiles that coincide, one with null and NaN values: each has a curve or a violation."""
    g, x, k = F.col("c_mktsegment"), F.col("c_acctbal"), F.col("c_custkey")
    odd = F.when(k % 2 == 0, F.lit(float("nan")))
    spoiled = (
        F.when(g == "BUILDING", 1.0)
        .when(g == "MACHINERY", F.when(k % 10 == 0, x).otherwise(5.0))
        .when((g == "HOUSEHOLD") & (k % 7 == 0), odd)
        .otherwise(x)
    )
    land = ls.landscape(table(spark, sf, "customer").select(g.alias("g"), spoiled.alias("x")), ["g"])
    points = F.format_string("%d points", F.col("n"))
    curves = land.curve.groupBy("g").agg(F.count("*").alias("n")).select(F.lit("curve").alias("check"), F.col("g").alias("key"), points.alias("detail"))
    return land.violations.unionByName(curves)


@query(
    "k16_degenerate_groups",
    """SELECT 'degenerate_spread' AS "check", l_returnflag AS key, count(*) || ' points' AS detail FROM lineitem WHERE l_returnflag = 'R' GROUP BY 2""",
)
def k16_degenerate(spark, sf):
    flat = F.when(F.col("l_returnflag") == "R", 3.0).otherwise(F.col("l_quantity").cast("double"))
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("g"), flat.alias("a"), "l_extendedprice")
    return ls.density_2d_violations(li, ["g"], "a", "l_extendedprice")


@query(
    "quantiles_grouped",
    """SELECT l_returnflag, unnest([0.025, 0.5, 0.975]::DOUBLE[]) AS prob, unnest(list_transform(qs, lambda q: round(q, 6))) AS q, n
       FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.025, 0.5, 0.975]) AS qs, count(*) AS n
             FROM lineitem GROUP BY 1)""",
)
def quantiles(spark, sf):
    out = grouped_quantiles(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.025, 0.5, 0.975])
    return rounded(out, 6, "q")


@query(
    "medians_with_ties",
    "SELECT l_suppkey, median(l_quantity) AS median, count(*) AS n FROM lineitem GROUP BY 1",
)
def medians(spark, sf):
    return grouped_median(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity")
