"""Queries for associations, bootstrap stability, longitudinal quantities and floors (X*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewell.common import materialise, with_scalar
from statewell.operators import association as assoc, floors, longitudinal as long, stability as stab
from statewell.plans import inputs as src
from statewell.plans.inputs import BENCH
from statewell.plans.registry import query, rounded, table

# --- inputs: vectors projected on the mean vectors of all labels, beside the customer of the same number --------------


def coordinates(spark, sf):
    """``(sample_id, component, coord)``: every vector on every label's mean vector, one array product a row."""
    emb = table(spark, sf, "embeddings")
    mean = emb.select("label", F.posexplode("embedding").alias("pos", "v")).groupBy("label", "pos").agg(F.avg(F.col("v").cast("double")).alias("m"))
    axes = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("axis"))
    listed = axes.agg(F.array_sort(F.collect_list(F.struct("label", "axis"))).alias("axes"))
    dot = lambda a: F.aggregate(F.zip_with(F.col("embedding").cast("array<double>"), a["axis"], lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    made = with_scalar(emb, listed, "_axes").select(F.col("vec_id").alias("sample_id"), F.transform("_axes", lambda a: F.struct((a["label"] + 1).alias("component"), F.round(dot(a), 9).alias("coord"))).alias("c"))
    return made.select("sample_id", F.inline("c"))


def annotations(spark, sf):
    """Metadata of the same units: label, balance, nation, segment, spending and number of orders, null for those without."""
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.avg("o_totalprice"), 2).alias("spending"), F.count("*").alias("orders"))
    cust = table(spark, sf, "customer").join(spent, "c_custkey", "left")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample_id"), "label").join(
        cust.select(F.col("c_custkey").alias("sample_id"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation_id"), F.col("c_mktsegment").alias("segment"), "spending", "orders"),
        "sample_id", "left",
    )


COORDS = """mean AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2),
       axes AS MATERIALIZED (SELECT label, list(m ORDER BY i) AS axis FROM mean GROUP BY label),
       coords AS MATERIALIZED (SELECT vec_id AS sample_id, axes.label + 1 AS component,
               round(list_sum(list_transform(range(1, len(axis) + 1), lambda i: embedding[i]::DOUBLE * axis[i])), 9) AS coord FROM embeddings, axes),
       spent AS (SELECT o_custkey, round(avg(o_totalprice), 2) AS spending, count(*) AS orders FROM orders GROUP BY 1),
       meta AS MATERIALIZED (SELECT vec_id AS sample_id, label::DOUBLE AS label, c_acctbal AS balance, c_mktsegment AS segment, spending, orders::DOUBLE AS orders
               FROM embeddings LEFT JOIN customer ON c_custkey = vec_id LEFT JOIN spent ON o_custkey = vec_id)"""

FIELDS = ("label", "balance", "spending", "orders")

PAIRS = COORDS + ", pairs AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT component, '{f}' AS field, coord AS x, {f} AS y FROM coords JOIN meta USING (sample_id) WHERE {f} IS NOT NULL" for f in FIELDS) + ")"


def rank_sql(name: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {name}) + (count(*) OVER (PARTITION BY {by}, {name}) - 1) / 2.0"


ATLAS = PAIRS + f""", ranked AS (SELECT component, field, {rank_sql('x', 'component, field')} AS rx, {rank_sql('y', 'component, field')} AS ry FROM pairs),
       atlas AS MATERIALIZED (SELECT component, field, CASE field WHEN 'label' THEN 'target' WHEN 'balance' THEN 'nuisance' ELSE 'discovered' END AS role,
               count(*) AS n, corr(rx, ry) AS spearman FROM ranked GROUP BY ALL)"""


def atlas(spark, sf):
    """All numeric fields but the nation's number, an identifier."""
    return assoc.spearman_atlas(coordinates(spark, sf), annotations(spark, sf), identifiers=["nation_id"], roles={"label": "target", "balance": "nuisance"})


@query(
    "x1_spearman_atlas",
    f"WITH {ATLAS} SELECT component, field, role, 'cross_sectional' AS design, n, round(spearman, 9) AS spearman, round(spearman * sqrt(n - 1), 7) AS z FROM atlas",
)
def x1(spark, sf):
    """Ten components against four numeric fields; spending is null for customers without orders."""
    return rounded(rounded(atlas(spark, sf), 9, "spearman"), 7, "z")


@query(
    "x2_rank_biserial",
    f"""WITH {COORDS}, p AS MATERIALIZED (SELECT component, 'segment=' || s.segment AS field, coord AS x, (m.segment = s.segment)::INT::DOUBLE AS y
              FROM coords JOIN meta m USING (sample_id) CROSS JOIN (SELECT DISTINCT c_mktsegment AS segment FROM customer) s WHERE m.segment IS NOT NULL),
        r AS (SELECT *, {rank_sql('x', 'component, field')} AS rx FROM p),
        t AS (SELECT component, field, sum(c ** 3 - c) AS t FROM (SELECT component, field, count(*)::DOUBLE AS c FROM p GROUP BY component, field, x) GROUP BY ALL),
        g AS (SELECT component, field, sum(1 - y) AS a, sum(y) AS b, sum(rx * y) AS s, corr(x, y) AS pb, t FROM r JOIN t USING (component, field) GROUP BY ALL)
        SELECT component, field, a::BIGINT AS n0, b::BIGINT AS n1, s - b * (b + 1) / 2 AS u, round(2 * (s - b * (b + 1) / 2) / (a * b) - 1, 9) AS rank_biserial,
               round((s - b * (b + 1) / 2 - a * b / 2) / sqrt(a * b / 12 * (a + b + 1 - t / ((a + b) * (a + b - 1)))), 7) AS z, round(pb, 9) AS point_biserial FROM g""",
)
def x2(spark, sf):
    """Each market segment against the others on every component."""
    segments = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("s")).distinct().agg(F.array_sort(F.collect_list("s")))
    meta = with_scalar(annotations(spark, sf).filter("segment is not null"), segments, "_all")
    binary = meta.select("sample_id", "segment", F.explode("_all").alias("s")).select(
        "sample_id", F.concat(F.lit("segment="), "s").alias("field"), (F.col("segment") == F.col("s")).cast("double").alias("y"))
    pairs = coordinates(spark, sf).withColumnRenamed("coord", "x").join(binary, "sample_id").select("component", "field", "x", "y")
    return rounded(rounded(assoc.group_separation(pairs), 9, "rank_biserial", "point_biserial"), 7, "z")


@query(
    "x3_kendall_trend",
    f"""WITH p AS MATERIALIZED (SELECT o_orderstatus AS status, round(o_totalprice, -2) AS x, left(o_orderpriority, 1)::DOUBLE AS y FROM orders),
        r AS (SELECT status, corr(rx, ry) AS rho FROM (SELECT status, {rank_sql('x', 'status')} AS rx, {rank_sql('y', 'status')} AS ry FROM p) GROUP BY status),
        w AS MATERIALIZED (SELECT status, x, y, count(*)::HUGEINT AS w FROM p GROUP BY ALL),
        c AS (SELECT a.status, sum(a.w * b.w * (CASE WHEN (b.y > a.y) THEN 1 WHEN b.y < a.y THEN -1 ELSE 0 END))::DOUBLE AS s
              FROM w a JOIN w b ON a.status = b.status AND b.x > a.x GROUP BY 1),
        n AS (SELECT status, count(*)::DOUBLE AS n FROM p GROUP BY 1),
        tx AS (SELECT status, sum(t * (t - 1)) AS p, sum(t * (t - 1) * (t - 2)) AS q, sum(t * (t - 1) * (2 * t + 5)) AS v FROM (SELECT status, count(*)::DOUBLE AS t FROM p GROUP BY status, x) GROUP BY 1),
        ty AS (SELECT status, sum(t * (t - 1)) AS p, sum(t * (t - 1) * (t - 2)) AS q, sum(t * (t - 1) * (2 * t + 5)) AS v FROM (SELECT status, count(*)::DOUBLE AS t FROM p GROUP BY status, y) GROUP BY 1)
        SELECT status, n::BIGINT AS n, round(rho, 9) AS spearman, round(s / (sqrt((n * (n - 1) - tx.p) / 2) * sqrt((n * (n - 1) - ty.p) / 2)), 9) AS kendall,
               round(s / sqrt((n * (n - 1) * (2 * n + 5) - tx.v - ty.v) / 18 + tx.p * ty.p / (2 * n * (n - 1)) + tx.q * ty.q / (9 * n * (n - 1) * (n - 2))), 7) AS kendall_z
        FROM n JOIN r USING (status) JOIN c USING (status) JOIN tx USING (status) JOIN ty USING (status)""",
)
def x3(spark, sf):
    """Prices to the nearest hundred along the five order priorities, for each order status."""
    pairs = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("status"), F.round("o_totalprice", -2).alias("x"), F.substring("o_orderpriority", 1, 1).cast("double").alias("y"))
    return rounded(rounded(assoc.ordered_trend(pairs, ["status"]), 9, "spearman", "kendall"), 7, "kendall_z")


# --- longitudinal ----------------------------------------------------------------------------


def visits(spark, sf):
    """Events as visits: subject = user, layer = event type, condition = whether the customer of that number is in debt."""
    debt = table(spark, sf, "customer").select(F.col("c_custkey").alias("subject"), (F.col("c_acctbal") < 2500).cast("int").alias("condition"))
    ev = table(spark, sf, "events").select(F.col("event_type").alias("layer"), F.col("user_id").alias("subject"), long.days(F.col("ts")).alias("t"), F.col("value").alias("x"))
    return ev.join(debt, "subject", "left")


VISITS = """v AS MATERIALIZED (SELECT event_type AS layer, user_id AS subject, epoch_us(ts) / 86400e6 AS t, value AS x, (c_acctbal < 2500)::INT AS condition
            FROM events LEFT JOIN customer ON c_custkey = user_id)"""


def _condition_sql(c: int) -> str:
    return f"""SELECT layer, count(*) AS g_all, avg(m) AS m, var_samp(m) AS v, sum(sxx) FILTER (WHERE sxx > 0) AS t, sum(sxy) FILTER (WHERE sxx > 0) AS x,
               count(*) FILTER (WHERE sxx > 0) AS g FROM per WHERE condition = {c} GROUP BY layer"""


@query(
    "x4_trajectory_divergence",
    f"""WITH {VISITS}, per AS MATERIALIZED (SELECT layer, subject, condition, count(*) AS n, avg(x) AS m, regr_sxx(x, t) AS sxx, regr_sxy(x, t) AS sxy FROM v
               WHERE condition IS NOT NULL AND x IS NOT NULL GROUP BY ALL),
        a AS ({_condition_sql(0)}), b AS ({_condition_sql(1)}),
        q AS (SELECT per.layer, sum(CASE WHEN condition = 0 AND sxx > 0 THEN (sxy - a.x / a.t * sxx) ** 2 END) AS u0,
                     sum(CASE WHEN condition = 1 AND sxx > 0 THEN (sxy - b.x / b.t * sxx) ** 2 END) AS u1, sum(n)::BIGINT AS n
              FROM per JOIN a USING (layer) JOIN b USING (layer) GROUP BY per.layer),
        e AS (SELECT layer, a.g_all AS g0, b.g_all AS g1, n, a.x / a.t AS s0, b.x / b.t AS s1, sqrt(u0 / a.t ** 2 * a.g / (a.g - 1) + u1 / b.t ** 2 * b.g / (b.g - 1)) AS se,
                     b.m - a.m AS sep, sqrt(a.v / a.g_all + b.v / b.g_all) AS ses FROM q JOIN a USING (layer) JOIN b USING (layer))
        SELECT layer, g0 AS subjects_0, g1 AS subjects_1, n, round(s0, 8) AS slope_0, round(s1, 8) AS slope_1, round(s1 - s0, 8) AS interaction, round(se, 8) AS interaction_se,
               round((s1 - s0) / se, 6) AS interaction_z, round(sep, 8) AS separation, round(ses, 8) AS separation_se, round(sep / ses, 6) AS separation_z FROM e""",
)
def x4(spark, sf):
    out = long.trajectory_divergence(visits(spark, sf), ["layer"])
    return rounded(rounded(out, 8, "slope_0", "slope_1", "interaction", "interaction_se", "separation", "separation_se"), 6, "interaction_z", "separation_z")


MSD = VISITS + """, d AS (SELECT a.layer, a.subject, least(ceil((b.t - a.t) / 0.5) - 1, 11)::INT AS lag_class, count(*) AS m, sum((b.x - a.x) ** 2) AS s
               FROM v a JOIN v b ON a.layer = b.layer AND a.subject = b.subject AND b.t > a.t AND b.t - a.t <= 6.0 GROUP BY ALL),
        g AS (SELECT layer, lag_class, count(*) AS g, sum(m)::BIGINT AS m, sum(s) AS s FROM d GROUP BY ALL),
        msd AS MATERIALIZED (SELECT layer, lag_class, any_value(g.g) AS subjects, any_value(g.m) AS pairs, any_value(g.s / g.m) AS msd,
               sqrt(sum((d.s - g.s / g.m * d.m) ** 2) * any_value(g.g) / (any_value(g.g) - 1)) / any_value(g.m) AS se FROM d JOIN g USING (layer, lag_class) GROUP BY ALL)"""


@query(
    "x9_msd",
    f"""WITH {MSD} SELECT layer, lag_class, lag_class * 0.5::DOUBLE AS lag_from, (lag_class + 1) * 0.5::DOUBLE AS lag_to, subjects, pairs, round(msd, 7) AS msd, round(se, 7) AS se,
               round(greatest(msd - 1.959964 * se, 0), 7) AS low, round(msd + 1.959964 * se, 7) AS high FROM msd""",
)
def x9(spark, sf):
    """Displacements of event values within six days, by half days."""
    out = long.mean_squared_displacement(visits(spark, sf), ["layer"], 6.0, 0.5)
    return rounded(out, 7, "msd", "se", "low", "high")


@query(
    "x9_diffusion",
    f"""WITH {MSD}, l AS (SELECT layer, lag_class + 0.5::DOUBLE AS l, msd, 1 / se ** 2 AS w FROM msd WHERE se > 0),
        s AS (SELECT layer, count(*) AS k, sum(w * l * msd) AS a, sum(w * l * l) AS b, sum(w * msd * msd) AS c FROM l GROUP BY layer)
        SELECT layer, k AS classes, round(a / b, 7) AS diffusion, round(1 / sqrt(b), 7) AS se, round(c - a * a / b, 5) AS chi2,
               c - a * a / b <= k - 1 + 1.959964 * sqrt(2.0 * (k - 1)) AS adequate FROM s""",
)
def x9_diffusion(spark, sf):
    """Event values do not diffuse; the line is refused by its own check."""
    out = long.diffusion(long.mean_squared_displacement(visits(spark, sf), ["layer"], 6.0, 0.5), ["layer"])
    return rounded(rounded(out, 7, "diffusion", "se"), 5, "chi2")


# --- layers ------------------------------------------------------------------------------------


def measured_layers(spark, sf):
    """Measurements of a customer as layers: balance, mean price, largest price, orders, and the balance turned round."""
    spent = table(spark, sf, "orders").groupBy("o_custkey").agg(
        F.round(F.avg("o_totalprice"), 2).alias("mean_price"), F.max("o_totalprice").alias("top_price"), F.count("*").cast("double").alias("orders"))
    both = table(spark, sf, "customer").join(spent, F.col("c_custkey") == F.col("o_custkey"), "left")
    layers = {"balance": F.col("c_acctbal"), "mean_price": F.col("mean_price"), "top_price": F.col("top_price"), "orders": F.col("orders"), "thrift": -F.col("top_price")}
    listed = F.array(*[F.struct(F.lit(n).alias("layer"), c.alias("coord")) for n, c in layers.items()])
    return both.select(F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("sample_id"), F.inline(listed))


LAYERS = f"""s AS (SELECT o_custkey, round(avg(o_totalprice), 2) AS mean_price, max(o_totalprice) AS top_price, count(*)::DOUBLE AS orders FROM orders GROUP BY 1),
        b AS (SELECT * FROM customer LEFT JOIN s ON o_custkey = c_custkey),
        l AS MATERIALIZED (SELECT * FROM (SELECT c_mktsegment AS segment, c_custkey AS id, 'balance' AS layer, c_acctbal AS x FROM b UNION ALL SELECT c_mktsegment, c_custkey, 'mean_price', mean_price FROM b
              UNION ALL SELECT c_mktsegment, c_custkey, 'top_price', top_price FROM b UNION ALL SELECT c_mktsegment, c_custkey, 'orders', orders FROM b
              UNION ALL SELECT c_mktsegment, c_custkey, 'thrift', -top_price FROM b) WHERE x IS NOT NULL),
        k AS (SELECT segment, id FROM l GROUP BY ALL HAVING count(*) = 5),
        r AS MATERIALIZED (SELECT segment, id, layer, x, {rank_sql('x', 'segment, layer')} AS r FROM l SEMI JOIN k USING (segment, id)),
        t AS MATERIALIZED (SELECT segment, id, sum(r) AS r FROM r GROUP BY ALL)"""


@query(
    "x8_layer_concordance",
    f"""WITH {LAYERS}, u AS (SELECT segment, count(DISTINCT id) AS units FROM l GROUP BY 1), c AS (SELECT segment, count(*)::DOUBLE AS n, var_pop(r) * count(*) AS s FROM t GROUP BY 1),
        ties AS (SELECT segment, sum(q ** 3 - q) AS t FROM (SELECT segment, layer, x, count(*)::DOUBLE AS q FROM r GROUP BY ALL) GROUP BY 1)
        SELECT segment, 5::BIGINT AS layers, units, n::BIGINT AS complete, round(12 * s / (25 * (n ** 3 - n) - 5 * t), 9) AS w,
               round(5 * (n - 1) * 12 * s / (25 * (n ** 3 - n) - 5 * t), 6) AS chi2 FROM u JOIN c USING (segment) JOIN ties USING (segment)""",
)
def x8(spark, sf):
    """Customers without orders have one layer only."""
    return rounded(rounded(assoc.layer_concordance(measured_layers(spark, sf), ["segment"]), 9, "w"), 6, "chi2")


@query(
    "x8_layer_profile",
    f"""WITH {LAYERS}, o AS (SELECT segment, layer, r.r AS rx, {rank_sql('(t.r - r.r)', 'segment, layer')} AS ry FROM r JOIN t USING (segment, id)),
        c AS (SELECT segment, layer, count(*) AS complete, corr(rx, ry) AS a FROM o GROUP BY ALL)
        SELECT segment, layer, complete, round(a, 9) AS agreement, round(a * sqrt(complete - 1), 7) AS z,
               CASE WHEN a * sqrt(complete - 1) < -1.96 THEN 'against' WHEN a * sqrt(complete - 1) > 1.96 THEN 'with' ELSE 'unclear' END AS direction FROM c""",
)
def x8_profile(spark, sf):
    """The layer that is another one turned round runs against the rest."""
    return rounded(rounded(assoc.layer_profile(measured_layers(spark, sf), ["segment"]), 9, "agreement"), 7, "z")


# --- bootstrap ----------------------------------------------------------------------------------

REPLICATES, SEED = 20, 11


def paired_rows(spark, sf):
    """Two layers of one unit: the first and the second half of its vector."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("sample_id"), F.col("embedding").cast("array<double>").alias("e"))
    halves = F.array(*[F.struct(F.lit(n).alias("layer"), F.slice("e", 1 + src.HALF * i, src.HALF).alias("vec")) for i, n in enumerate("AB")])
    return emb.select("sample_id", F.inline(halves))


def weights_sql(n: int, seed: int) -> str:
    """``wt(sample_id, rep, w)``: the drawn weights, replicate 0 all ones."""
    from statewell.operators.evidence import MIX_A, MIX_B, MIX_C, MIX_P

    step = lambda x: f"(({x} * {x}) % {MIX_P} + {x} * {MIX_A} + {MIX_B}) % {MIX_P}"
    count = " + ".join(f"(x >= {v})::INT" for v in stab.POISSON)
    return f"""x0 AS (SELECT DISTINCT vec_id::VARCHAR AS sample_id, r AS rep, ({seed * MIX_A} + ('0x' || left(md5(vec_id::VARCHAR), 7))::BIGINT + r * {MIX_C}) % {MIX_P} AS x
              FROM embeddings, range(0, {n + 1}) t(r)),
       x1 AS (SELECT sample_id, rep, {step('x')} AS x FROM x0), x2 AS (SELECT sample_id, rep, {step('x')} AS x FROM x1), x3 AS (SELECT sample_id, rep, {step('x')} AS x FROM x2),
       wt AS MATERIALIZED (SELECT sample_id, rep, CASE WHEN rep = 0 THEN 1 ELSE {count} END AS w FROM x3)"""


@query(
    "x6_bootstrap_spectrum",
    f"""WITH {src.TWO}, {weights_sql(REPLICATES, SEED)},
        wide AS (SELECT layer, sample_id, rep, feature_id, value, w FROM cells JOIN wt USING (sample_id) WHERE w > 0),
        mu AS (SELECT layer, rep, feature_id, sum(w * value) / sum(w) AS mu FROM wide GROUP BY ALL),
        cen AS MATERIALIZED (SELECT layer, rep, sample_id, feature_id, w, value - mu AS v FROM wide JOIN mu USING (layer, rep, feature_id)),
        g AS (SELECT a.layer, a.rep, a.feature_id AS i, b.feature_id AS j, sum(a.w * a.v * b.v) AS v FROM cen a JOIN cen b ON a.layer = b.layer AND a.rep = b.rep AND a.sample_id = b.sample_id GROUP BY ALL),
        tot AS (SELECT rep, sum(w)::DOUBLE AS weight FROM wt GROUP BY 1)
        SELECT layer, rep::INT AS rep, weight, round(sum(v) FILTER (WHERE i = j), 6) AS total, round(sum(v) FILTER (WHERE i = j), 6) AS squares, round(sum(v * v), 4) AS fourths, 32::BIGINT AS components
        FROM g JOIN tot USING (rep) GROUP BY layer, rep, weight""",
)
def x6(spark, sf):
    """All 32 singular values of both halves in the data and 20 resamples, told by the sums of their squares and fourth powers."""
    boot = stab.bootstrap_spectrum(paired_rows(spark, sf), ["layer"], src.HALF, REPLICATES, SEED)
    sums = boot.spectrum.groupBy("layer", "rep").agg(
        F.sum(F.col("sigma") ** 2).alias("squares"), F.sum(F.col("sigma") ** 4).alias("fourths"), F.count("*").alias("components"))
    return rounded(rounded(boot.totals.join(sums, ["layer", "rep"]), 6, "total", "squares"), 4, "fourths")


@query(
    "x7_axis_stability",
    f"""WITH {src.CELLS}, {weights_sql(REPLICATES, SEED)},
        ax AS MATERIALIZED (SELECT rep, label + 1 AS component, pos, sum(w * value) / sum(w) AS v FROM cells JOIN wt USING (sample_id) GROUP BY ALL HAVING sum(w) > 0),
        len AS (SELECT rep, component, sqrt(sum(v * v)) AS len FROM ax GROUP BY ALL),
        o AS MATERIALIZED (SELECT b.rep, a.component, b.component AS other, sum(a.v * b.v) / any_value(x.len * y.len) AS c FROM ax a JOIN ax b ON a.rep = 0 AND b.rep > 0 AND a.pos = b.pos
              JOIN len x ON x.rep = a.rep AND x.component = a.component JOIN len y ON y.rep = b.rep AND y.component = b.component GROUP BY ALL),
        best AS (SELECT rep, component, arg_max(other, abs(c)) AS matched, max(abs(c)) AS overlap, arg_max(c, abs(c)) AS c FROM o GROUP BY ALL),
        ok AS (SELECT rep, count(DISTINCT matched) = count(*) AS ok FROM best GROUP BY rep)
        SELECT component, count(*) AS replicates, round(avg((overlap >= 0.9)::INT), 9) AS axis_share, round(avg((matched = component)::INT), 9) AS index_share,
               round(avg((c > 0)::INT), 9) AS orientation_share, round(avg(overlap), 9) AS mean_overlap
        FROM best JOIN ok USING (rep) WHERE ok GROUP BY component""",
)
def x7(spark, sf):
    """Mean vectors of all labels under the drawn weights against those of the data. SQL takes each axis's best partner, which is
    the best matching as long as no partner is taken twice."""
    emb = table(spark, sf, "embeddings").select(stab.unit_mark(F.col("vec_id")).alias("m"), "label", "embedding", F.expr(f"explode(sequence(0, {REPLICATES})) AS rep"))
    drawn = emb.withColumn("w", stab.weight_column(F.col("m"), F.col("rep"), SEED)).filter("w > 0").select("label", "rep", "w", F.posexplode("embedding").alias("pos", "v"))
    axes = drawn.groupBy("rep", (F.col("label") + 1).alias("component"), "pos").agg(
        (F.sum(F.col("w") * F.col("v").cast("double")) / F.sum("w")).alias("v"))
    listed = axes.groupBy("rep", "component").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("vec"))
    aligned = stab.align_components(listed.filter("rep = 0").drop("rep"), listed.filter("rep > 0"))
    out = stab.axis_stability(aligned).drop("subspace_share", "result")
    return rounded(out, 9, "axis_share", "index_share", "orientation_share", "mean_overlap")


# --- floors ----------------------------------------------------------------------------------------


MARGINS = {"shared_recovery_error": 0.005, "projection_error": 0.01}


@query(
    "x10_floor_thresholds",
    f"""WITH {BENCH}, e AS MATERIALIZED (SELECT ln, projection_case, metric, value FROM (SELECT ln, projection_case, 'shared_recovery_error' AS metric, coalesce(shared_recovery_error, disc0) AS value
              FROM (SELECT *, elapsed_sec / 100 AS disc0 FROM bench) UNION ALL SELECT ln, projection_case, 'projection_error', coalesce(projection_error, elapsed_sec / 50) FROM bench)),
        r AS (SELECT *, row_number() OVER (PARTITION BY ln, projection_case, metric ORDER BY value) AS k, count(*) OVER (PARTITION BY ln, projection_case, metric) AS n FROM e),
        n AS (SELECT DISTINCT n FROM r),
        b AS (SELECT n, k, sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.9) + (n - k) * ln(0.1))) OVER (PARTITION BY n ORDER BY k) AS cdf
              FROM (SELECT n, unnest(range(0, n + 1)) AS k FROM n)),
        i AS (SELECT n, max(k + 1) FILTER (WHERE cdf <= 0.025) AS low, min(k + 1) FILTER (WHERE cdf >= 0.975) AS high FROM b GROUP BY n)
        SELECT ln, projection_case, metric, n, round(median(value), 9) AS median, round(quantile_cont(value, 0.9), 9) AS floor, round(max(value) FILTER (WHERE k = low), 9) AS floor_low,
               round(max(value) FILTER (WHERE k = high), 9) AS floor_high, any_value(CASE metric WHEN 'projection_error' THEN 0.01 ELSE 0.005 END)::DOUBLE AS margin,
               round(quantile_cont(value, 0.9) + any_value(CASE metric WHEN 'projection_error' THEN 0.01 ELSE 0.005 END)::DOUBLE, 9) AS threshold
        FROM r JOIN i USING (n) GROUP BY ln, projection_case, metric, n""",
)
def x10(spark, sf):
    """Errors of all benchmark rows by order line and projection case; rows without an error take their elapsed share."""
    rows = src.bench_rows(spark, sf)
    value = {"shared_recovery_error": F.coalesce("shared_recovery_error", F.col("elapsed_sec") / 100), "projection_error": F.coalesce("projection_error", F.col("elapsed_sec") / 50)}
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in value.items()])
    out = floors.floor_thresholds(rows.select("ln", "projection_case", F.inline(listed)), ["ln", "projection_case"], MARGINS)
    return rounded(out, 9, "median", "floor", "floor_low", "floor_high", "threshold")


# --- proposal -----------------------------------------------------------------------------------------

DIGEST = """sha256(string_agg(component || '|' || field || '|' || role || '|' || n || '|' || printf('%.6f', spearman), chr(10)
               ORDER BY component || '|' || field || '|' || role || '|' || n || '|' || printf('%.6f', spearman)))"""


@query(
    "x5_proposal",
    f"""WITH {ATLAS}, t AS (SELECT component, abs(spearman) AS score, sign(spearman)::INT AS direction FROM atlas WHERE field = 'label'),
        w AS (SELECT component, arg_max(field, abs(spearman)) AS nuisance_field, max(abs(spearman)) AS nuisance_score FROM atlas WHERE field IN ('balance', 'orders') GROUP BY 1),
        r AS (SELECT *, row_number() OVER (ORDER BY score DESC, component) AS rank, lead(score) OVER (ORDER BY score DESC, component) AS nxt FROM t JOIN w USING (component))
        SELECT component, rank, round(score, 9) AS score, direction, nuisance_field, round(nuisance_score, 9) AS nuisance_score, nuisance_score >= score AS alert, TRUE AS eligible,
               rank = 1 AND score >= 0.1 AND score - nxt >= 0.05 AS recommended, (SELECT {DIGEST} FROM atlas) AS atlas_digest FROM r""",
)
def x5(spark, sf):
    """Components ranked for the label, with balance and number of orders as nuisance; the digest is of the whole atlas."""
    return rounded(assoc.propose_component(atlas(spark, sf), "label", ["balance", "orders"]), 9, "score", "nuisance_score")


@query(
    "x5_stale_confirmation",
    f"""WITH {ATLAS}, late AS (SELECT component, field, role, n, CASE WHEN field = 'spending' THEN spearman + 0.25 ELSE spearman END AS spearman FROM atlas),
        d AS (SELECT (SELECT {DIGEST} FROM atlas) AS was, (SELECT {DIGEST} FROM late) AS now)
        SELECT 'stale_atlas' AS "check", 'given_label_PC1' AS key, 'the atlas is not the one the confirmation rests on' AS detail FROM d WHERE was <> now
        UNION ALL SELECT 'proposal_of_other_atlas', 'given_label_PC1', 'the proposal was made from another atlas' FROM d WHERE was <> now""",
)
def x5_stale(spark, sf):
    """A confirmed choice after one field of the atlas has changed: two links of the chain break."""
    first = materialise(atlas(spark, sf))
    proposal = materialise(assoc.propose_component(first, "label", ["balance", "orders"]))
    record = assoc.confirm_component(proposal, 1, "first axis of the given vectors", "given", "label")
    late = first.withColumn("spearman", F.when(F.col("field") == "spending", F.col("spearman") + 0.25).otherwise(F.col("spearman")))
    return assoc.confirmation_violations(record, late, proposal)
