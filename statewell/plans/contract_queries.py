"""Queries for table contracts (V*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from statewell.functions.digests import canonical_digest, row_text
from statewell.operators import contracts as v
from statewell.operators.evidence import grid_from_table, task_table
from statewell.plans import inputs as src
from statewell.plans.prep_queries import document_cohort
from statewell.plans.registry import query, table
from statewell.plans.stage1_queries import svd


@query(
    "v1_longitudinal_violations",
    """WITH d AS (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY 1, 2)
       SELECT 'duplicate_visit' AS "check", l_suppkey || '|' || strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS key,
              n || ' rows' AS detail FROM d WHERE n > 1""",
)
def v1(spark, sf):
    return v.longitudinal_violations(table(spark, sf, "lineitem"), "l_suppkey", "l_shipdate")


@query(
    "v1_valid_design",
    """SELECT 'no_repeated_subject' AS "check", '' AS key, 'needs a subject with distinct repeated times' AS detail
       FROM (SELECT count(*) AS n FROM (SELECT user_id FROM events GROUP BY 1 HAVING min(ts) < max(ts))) WHERE n = 0
       UNION ALL SELECT 'duplicate_visit', CAST(user_id AS VARCHAR), count(*) || ' rows' FROM events GROUP BY user_id, ts
       HAVING count(*) > 1""",
)
def v1_valid(spark, sf):
    return v.longitudinal_violations(table(spark, sf, "events"), "user_id", "ts")


@query(
    "v1_time_type",
    """SELECT DISTINCT 'time_type' AS "check", 'event_type' AS key, 'must be numeric, date, timestamp or ordered' AS detail
       FROM events""",
)
def v1_type(spark, sf):
    return v.longitudinal_violations(table(spark, sf, "events"), "user_id", "event_type")


@query(
    "v3_ordered_target",
    """WITH l AS (SELECT c_nationkey AS g, c_mktsegment AS s, c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY', 'SPACE') AS known
                  FROM customer GROUP BY ALL)
       SELECT 'target_undeclared_level' AS "check", CAST(g AS VARCHAR) AS key, count(*) FILTER (WHERE NOT known) || ' levels' AS detail
       FROM l GROUP BY g HAVING count(*) FILTER (WHERE NOT known) > 0
       UNION ALL
       SELECT 'target_unseen_level', CAST(g AS VARCHAR), string_agg(lv, ',' ORDER BY lv)
       FROM (SELECT g, lv FROM (SELECT DISTINCT g FROM l), (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'MACHINERY', 'SPACE']) AS lv)
             EXCEPT SELECT g, s FROM l) GROUP BY g""",
)
def v3_ordered(spark, sf):
    levels = ["AUTOMOBILE", "BUILDING", "MACHINERY", "SPACE"]
    return v.target_violations(table(spark, sf, "customer"), "c_mktsegment", "ordered", levels, ["c_nationkey"])


@query(
    "v3_binary_target",
    """SELECT 'target_null' AS "check", '' AS key, count(*) || ' nulls' AS detail FROM documents ANTI JOIN labels USING (doc_id)
       HAVING count(*) > 0""",
)
def v3_binary(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    joined = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    return v.target_violations(joined, "quality", "binary", ["0", "1"])


@query(
    "v3_continuous_target",
    """SELECT 'target_too_few' AS "check", l_partkey || '|' || l_linenumber AS key, 'fewer than two values' AS detail
       FROM lineitem GROUP BY l_partkey, l_linenumber HAVING count(*) < 2
       UNION ALL SELECT 'target_constant', l_partkey || '|' || l_linenumber, 'zero variance'
       FROM lineitem GROUP BY l_partkey, l_linenumber HAVING count(*) >= 2 AND min(l_tax) = max(l_tax)""",
)
def v3_continuous(spark, sf):
    return v.target_violations(table(spark, sf, "lineitem"), "l_tax", "continuous", keys=["l_partkey", "l_linenumber"])


@query(
    "v4_anchor",
    """SELECT 'anchor_null' AS "check", source AS key, count(*) FILTER (WHERE toxic IS NULL) || ' nulls' AS detail
       FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source HAVING count(*) FILTER (WHERE toxic IS NULL) > 0
       UNION ALL SELECT 'anchor_constant', source, 'zero variance' FROM documents LEFT JOIN labels USING (doc_id)
       GROUP BY source HAVING count(*) >= 2 AND coalesce(max(toxic) - min(toxic), 0) = 0
       UNION ALL SELECT 'anchor_too_few', source, 'fewer than two values' FROM documents LEFT JOIN labels USING (doc_id)
       GROUP BY source HAVING count(*) < 2""",
)
def v4(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    joined = docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return v.anchor_violations(joined, "toxic", ["source"])


@query(
    "v5_component_available",
    """SELECT DISTINCT 'component_unavailable' AS "check", 'all' AS key, 'component 4 of 3' AS detail FROM embeddings
       UNION ALL SELECT DISTINCT 'lifecycle', 'proposal', 'a confirmed declaration is required' FROM embeddings""",
)
def v5(spark, sf):
    return v.component_violations(svd(spark, sf, 3).loadings, 4, "proposal")


@query(
    "v6_finite_cells",
    """SELECT 'not_finite' AS "check", event_type AS key, count(*) FILTER (WHERE value > 300) || ' cells' AS detail
       FROM events GROUP BY event_type HAVING count(*) FILTER (WHERE value > 300) > 0""",
)
def v6(spark, sf):
    bad = F.when(F.col("value") > 400, float("inf")).when(F.col("value") > 350, float("nan")).when(
        F.col("value") <= 300, F.col("value")
    )
    cells = table(spark, sf, "events").select(F.col("event_type").alias("layer"), bad.alias("value"))
    return v.finite_violations(cells)


def order_cohort(spark, sf):
    cells = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("layer"), F.col("l_orderkey").cast("string").alias("sample_id")
    )
    mapping = table(spark, sf, "orders").select(
        F.col("o_orderstatus").alias("layer"), F.col("o_custkey").cast("string").alias("primary_id"),
        F.col("o_orderkey").cast("string").alias("sample_id"),
    )
    samples = table(spark, sf, "customer").filter("c_acctbal > 0").select(
        F.col("c_custkey").cast("string").alias("primary_id")
    )
    return cells, mapping, samples


COHORT = """WITH have AS (SELECT DISTINCT l_linestatus AS layer, l_orderkey AS s FROM lineitem),
       m AS (SELECT o_orderstatus AS layer, o_custkey AS p, o_orderkey AS s FROM orders),
       c AS (SELECT c_custkey AS p FROM customer WHERE c_acctbal > 0)"""


@query(
    "v7_sample_map",
    COHORT
    + """ SELECT 'map_duplicate_primary_id' AS "check", layer || '|' || p AS key, count(*) || ' rows' AS detail FROM m
          GROUP BY layer, p HAVING count(*) > 1
          UNION ALL SELECT 'map_duplicate_sample_id', layer || '|' || s, count(*) || ' rows' FROM m GROUP BY layer, s HAVING count(*) > 1
          UNION ALL SELECT DISTINCT 'layer_unmapped', layer, 'no sample-map rows' FROM have ANTI JOIN m USING (layer)
          UNION ALL SELECT 'map_absent_sample', layer || '|' || s, 'no such measured sample' FROM m ANTI JOIN have USING (layer, s)
          UNION ALL SELECT 'map_absent_primary', layer || '|' || p, 'no such sample' FROM m ANTI JOIN c USING (p)""",
)
def v7(spark, sf):
    return v.sample_map_violations(*order_cohort(spark, sf))


@query(
    "v8_complete_cohort",
    """SELECT CAST(doc_id AS VARCHAR) AS primary_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def v8(spark, sf):
    return v.complete_cohort(document_cohort(spark, sf).sample_map)


@query(
    "v8_cohort_size",
    """SELECT 'too_few_complete' AS "check", '' AS key, count(*) || ' of 1000000000' AS detail FROM documents
       WHERE doc_id IN (SELECT doc_id FROM labels)""",
)
def v8_size(spark, sf):
    return v.cohort_size_violations(v.complete_cohort(document_cohort(spark, sf).sample_map, 2), 1_000_000_000)


@query("v9_exclusions", "SELECT CAST(doc_id AS VARCHAR) AS primary_id FROM documents ANTI JOIN labels USING (doc_id)")
def v9(spark, sf):
    c = document_cohort(spark, sf)
    return v.exclusions(c.samples, v.complete_cohort(c.sample_map, 2))


@query(
    "v10_alignment",
    COHORT
    + """ SELECT have.layer, CAST(have.s AS VARCHAR) AS sample_id, CAST(m.p AS VARCHAR) AS primary_id,
                 CASE WHEN m.p IS NULL THEN 'missing_mapping' WHEN c.p IS NULL THEN 'missing_primary' END AS reason
          FROM have LEFT JOIN m ON have.layer = m.layer AND have.s = m.s LEFT JOIN c ON m.p = c.p""",
)
def v10(spark, sf):
    return v.alignment(*order_cohort(spark, sf))


@query(
    "v11_feature_identity",
    """WITH n AS (SELECT l_returnflag AS layer, l_partkey AS f, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY ALL),
       k AS (SELECT DISTINCT l_returnflag AS layer, l_partkey AS f FROM lineitem WHERE l_quantity < 10)
       SELECT CASE WHEN n.n IS NULL THEN 'missing_feature' WHEN k.f IS NULL THEN 'extra_feature' ELSE 'duplicate_feature' END AS "check",
              coalesce(n.layer, k.layer) || '|' || coalesce(n.f, k.f) AS key, CAST(coalesce(n.n, 0) AS VARCHAR) AS detail
       FROM n FULL JOIN k ON n.layer = k.layer AND n.f = k.f WHERE n.n IS NULL OR k.f IS NULL OR n.n > 1""",
)
def v11(spark, sf):
    li = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("layer"), F.col("l_partkey").cast("string").alias("feature_id"), "l_quantity"
    )
    return v.feature_identity_violations(li.filter("l_quantity > 40"), li.filter("l_quantity < 10"))


@query(
    "v12_bench_contract",
    f"""WITH {src.BENCH} SELECT 'other_split' AS "check", '' AS key, count(*) || ' rows' AS detail FROM bench WHERE split <> 'calibration'
        HAVING count(*) > 0
        UNION ALL SELECT 'other_candidate', '', count(*) || ' rows' FROM bench WHERE candidate <> '{src.FIRST}' HAVING count(*) > 0
        UNION ALL SELECT 'mixed_generator', '', 'more than one value' FROM bench HAVING count(DISTINCT ln > 3) > 1""",
)
def v12(spark, sf):
    rows = src.bench_rows(spark, sf).withColumn("generator", F.when(F.col("ln") > 3, "a").otherwise("b"))
    return v.bench_violations(rows, "calibration", src.FIRST, "full")


@query(
    "v13_strata_in_grid",
    """SELECT 'stratum_outside_grid' AS "check", l_returnflag || '|' || l_linestatus || '|' || l_linenumber AS key,
              'not in the frozen grid' AS detail
       FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_linenumber > 5 OR l_linestatus <> 'O')""",
)
def v13(spark, sf):
    li = table(spark, sf, "lineitem")
    fields = ["l_returnflag", "l_linestatus", "l_linenumber"]
    grid = grid_from_table(li.filter("l_linestatus = 'O' AND l_linenumber <= 5"), fields)
    return v.strata_outside_grid(li, grid, fields)


@query(
    "v14_coverage",
    """WITH st AS (SELECT DISTINCT l_returnflag AS f FROM lineitem), ln AS (SELECT DISTINCT l_linenumber AS n FROM lineitem),
       e AS (SELECT f, n, s_suppkey AS seed FROM st, ln, supplier),
       r AS (SELECT l_returnflag AS f, l_linenumber AS n, l_suppkey AS seed, count(*) AS c FROM lineitem
             WHERE l_quantity > 25 GROUP BY ALL)
       SELECT CASE WHEN c IS NULL THEN 'task_missing' ELSE 'task_repeated' END AS "check", f || '|' || n || '|' || seed AS key,
              CAST(coalesce(c, 0) AS VARCHAR) AS detail FROM e LEFT JOIN r USING (f, n, seed) WHERE c IS NULL OR c > 1""",
)
def v14(spark, sf):
    li = table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "seed")
    fields = ["l_returnflag", "l_linenumber"]
    seeds = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("seed"))
    expected = task_table(grid_from_table(li, fields), seeds, fields)
    return v.coverage_violations(expected, li.filter("l_quantity > 25"), [*fields, "seed"], split=None)


@query(
    "v15_version_gate",
    """SELECT 'schema_version' AS "check", CASE WHEN c_nationkey < 5 THEN '1' ELSE '2' END AS key, count(*) || ' rows' AS detail
       FROM customer GROUP BY 2 HAVING key <> '2'""",
)
def v15(spark, sf):
    return v.version_violations(versioned(spark, sf), "2")


def versioned(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_nationkey") < 5, "1").otherwise("2").alias("schema_version"),
        F.when(F.col("c_nationkey") >= 5, F.lit("longitudinal")).alias("sampling_design"),
    )


@query(
    "v15_upgrade",
    """SELECT c_custkey, '2' AS schema_version,
              CASE WHEN c_nationkey < 5 THEN 'unspecified' ELSE 'longitudinal' END AS sampling_design FROM customer""",
)
def v15_up(spark, sf):
    return v.upgrade_version(versioned(spark, sf), {"1": ("2", {"sampling_design": "unspecified"})}, "2")


CHAIN = {"9": ("10", {"a": "from 9"}), "10": ("11", {"b": "from 10"}), "8": ("7", {"a": "lost"})}


@query(
    "v15_upgrade_chain",
    """SELECT c_custkey, CASE WHEN c_nationkey < 20 THEN '11' ELSE '8' END AS schema_version, CASE WHEN c_nationkey < 10 THEN 'from 9' END AS a,
              CASE WHEN c_nationkey < 20 THEN 'from 10' END AS b FROM customer""",
)
def v15_chain(spark, sf):
    return v.upgrade_version(chained(spark, sf), CHAIN, "11").select("c_custkey", "schema_version", "a", "b")


@query(
    "v15_no_upgrade_path",
    """SELECT 'no_upgrade_path' AS "check", '8' AS key, count(*) || ' rows' AS detail FROM customer WHERE c_nationkey >= 20 HAVING count(*) > 0""",
)
def v15_lost(spark, sf):
    return v.upgrade_violations(chained(spark, sf), CHAIN, "11")


def chained(spark, sf):
    version = F.when(F.col("c_nationkey") < 10, "9").when(F.col("c_nationkey") < 20, "10").otherwise("8")
    return table(spark, sf, "customer").select("c_custkey", version.alias("schema_version"))


@query(
    "v20_separators",
    """SELECT count(*) AS n, 2 * count(*) AS digests FROM customer""",
)
def v20_distinct(spark, sf):
    """Rows that differ only in where a separator stands, or in null against its name, have digests of their own."""
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.inline(F.array(
            F.struct(F.lit("a|b").alias("x"), F.lit("NULL").alias("y")), F.struct(F.lit("a").alias("x"), F.lit("b|NULL").alias("y")),
        )),
    ).withColumn("y", F.when(F.col("x") == "a|b", F.lit(None)).otherwise(F.col("y")))
    texts = rows.select("c_custkey", row_text(["c_custkey", "x", "y"]).alias("t"))
    return texts.agg((F.count("*") / 2).cast("bigint").alias("n"), F.countDistinct("t").alias("digests"))


@query(
    "v17_canonical_digest",
    """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_nationkey":' ||
              c_nationkey || '}') AS digest FROM customer""",
)
def v17(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey", canonical_digest(["c_nationkey", "c_mktsegment", "c_custkey"]).alias("digest")
    )


@query(
    "v18_shape_checks",
    """SELECT DISTINCT 'component_disagreement' AS "check", 'all' AS key, '3/2/3' AS detail FROM embeddings""",
)
def v18(spark, sf):
    d = svd(spark, sf, 3)
    return v.shape_violations(d.loadings, d.scores.filter("component <= 2"), d.spectrum)


@query(
    "v19_manifest",
    """WITH a AS (SELECT s_suppkey AS seed, CASE WHEN s_nationkey < 13 THEN 'calibration' ELSE 'holdout' END AS split FROM supplier),
       f AS (SELECT s_suppkey AS seed, CASE WHEN s_nationkey < 12 THEN 'calibration' ELSE 'holdout' END AS split FROM supplier)
       SELECT 'manifest_extra' AS "check", seed || '|' || split AS key, 'not in the protocol' AS detail FROM (FROM a EXCEPT ALL FROM f)
       UNION ALL SELECT 'manifest_missing', seed || '|' || split, 'required by the protocol' FROM (FROM f EXCEPT ALL FROM a)""",
)
def v19(spark, sf):
    def seeds(cut):
        return table(spark, sf, "supplier").select(
            F.col("s_suppkey").alias("seed"), F.when(F.col("s_nationkey") < cut, "calibration").otherwise("holdout").alias("split")
        )

    return v.manifest_violations(seeds(13), seeds(12))


TEXT = " || ".join(
    f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, 'N')" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
)
DIGEST = f"""WITH h AS (SELECT md5({TEXT}) AS h FROM orders),
       b AS (SELECT CAST(('0x' || substr(h, 1, 2)) AS BIGINT) % 256 AS b,
                    sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) AS s, count(*) AS n FROM h GROUP BY 1),
       d AS (SELECT CAST(sum(n) AS BIGINT) AS n_rows, sha256(string_agg(line, ';' ORDER BY line)) AS digest
             FROM (SELECT n, lpad(CAST(b AS VARCHAR), 3, '0') || ':' || CAST(s AS VARCHAR) || ':' || n AS line FROM b))"""


def orders_digest(spark, sf):
    return v.input_digest(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])


@query("v20_input_digest", DIGEST + " SELECT n_rows, digest FROM d")
def v20(spark, sf):
    return orders_digest(spark, sf)


@query(
    "v21_provenance",
    DIGEST
    + """ SELECT 'decompose' AS step, 'svd' AS operator, 'center=true,k=6' AS params, digest AS input_digest, n_rows AS input_rows FROM d
          UNION ALL SELECT 'estimate', 'landscape', 'n_grid=512', digest, n_rows FROM d""",
)
def v21(spark, sf):
    digest = orders_digest(spark, sf)
    log = v.append_provenance(None, v.provenance_step(digest, "decompose", "svd", {"k": 6, "center": "true"}))
    log = v.append_provenance(log, v.provenance_step(digest, "estimate", "landscape", {"n_grid": 512}))
    pairs = F.transform(F.array_sort(F.map_entries("params")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return log.withColumn("params", F.concat_ws(",", pairs))


