"""Queries for sources, parsing and preparation (S*, P*)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from statewell.common import ensure_checkpoint_dir, union_all
from statewell.functions import names
from statewell.operators import prep
from statewell.plans.registry import per_check, query, table
from statewell.sources import matrix, tables

# --- sources -----------------------------------------------------------------


@query(
    "s10_cells_from_arrays",
    """SELECT 'all' AS layer, CAST(vec_id AS VARCHAR) AS sample_id,
              'd' || lpad(CAST(i - 1 AS VARCHAR), 3, '0') AS feature_id, CAST(embedding[i] AS DOUBLE) AS value
       FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
)
def s10(spark, sf):
    return matrix.cells_from_arrays(table(spark, sf, "embeddings"), "vec_id", "embedding")


@query(
    "s1_s8_unpivot_wide",
    """SELECT 'parts' AS layer, s AS sample_id, 'p' || p_partkey AS feature_id, v AS value
       FROM (SELECT p_partkey, unnest(['p_size', 'p_retailprice']) AS s,
                    unnest([CAST(p_size AS DOUBLE), p_retailprice]) AS v FROM part)""",
)
def s8_unpivot(spark, sf):
    wide = table(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("gene"), "p_size", "p_retailprice"
    )
    return matrix.wide_to_cells(wide, "gene", "parts")


@query(
    "s8_pivot_cells",
    """SELECT event_type AS layer, CAST(user_id AS VARCHAR) AS sample_id,
              max(CASE WHEN f = 'total' THEN v END) AS total, max(CASE WHEN f = 'peak' THEN v END) AS peak
       FROM (SELECT event_type, user_id, unnest(['total', 'peak']) AS f, unnest([t, p]) AS v
             FROM (SELECT event_type, user_id, round(sum(value), 6) AS t, max(value) AS p FROM events GROUP BY ALL))
       GROUP BY ALL""",
)
def s8_pivot(spark, sf):
    per = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("layer"), F.col("user_id").cast("string").alias("sample_id")
    ).agg(F.round(F.sum("value"), 6).alias("total"), F.max("value").alias("peak"))
    cells = per.unpivot(["layer", "sample_id"], ["total", "peak"], "feature_id", "value")
    return matrix.cells_to_wide(cells, ["total", "peak"])


@query(
    "s8_transpose",
    """SELECT 'all' AS layer, 'd' || lpad(CAST(i - 1 AS VARCHAR), 3, '0') AS sample_id,
              CAST(vec_id AS VARCHAR) AS feature_id, CAST(embedding[i] AS DOUBLE) AS value
       FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)""",
)
def s8_transpose(spark, sf):
    return matrix.transpose_cells(s10(spark, sf)).select("layer", "sample_id", "feature_id", "value")


@query(
    "s9_id_set_differences",
    """SELECT 'left_only' AS check, CAST(c_nationkey AS VARCHAR) AS key, 'absent on the right' AS detail
       FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier)
       UNION ALL
       SELECT 'right_only', CAST(s_nationkey AS VARCHAR), 'absent on the left'
       FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer)""",
)
def s9(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("id"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("id"))
    return matrix.id_set_differences(a, b, "id")


@query(
    "s5_assemble_cohort",
    """WITH cells AS (
         SELECT 'text' AS layer, doc_id AS id, CAST(n_chars AS DOUBLE) AS value FROM documents
         UNION ALL SELECT 'label', doc_id, CAST(v AS DOUBLE)
         FROM (SELECT doc_id, unnest([quality, toxic]) AS v FROM labels))
       SELECT layer, count(*) AS cells, count(DISTINCT id) AS mapped, sum(value) AS total FROM cells GROUP BY layer""",
)
def s5(spark, sf):
    c = document_cohort(spark, sf)
    per_map = c.sample_map.groupBy("layer").agg(F.count("*").alias("mapped"))
    return c.cells.groupBy("layer").agg(F.count("*").alias("cells"), F.sum("value").alias("total")).join(per_map, "layer")


def document_cohort(spark, sf) -> matrix.Cohort:
    """Two layers over documents: every text is measured, only some are labelled."""
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    text = docs.select(
        F.col("doc_id").cast("string").alias("sample_id"), F.lit("n_chars").alias("feature_id"), F.col("n_chars").alias("value")
    )
    marks = labels.select(F.col("doc_id").cast("string").alias("sample_id"), "quality", "toxic").unpivot(
        "sample_id", ["quality", "toxic"], "feature_id", "value"
    )
    samples = docs.select(F.col("doc_id").cast("string").alias("primary_id"), "lang", "source", "n_chars")
    return matrix.assemble_cohort({"text": text, "label": marks}, samples)


@query(
    "s2_completeness",
    """WITH m AS (SELECT d.doc_id, l.quality, CAST(d.n_chars AS DOUBLE) AS weight
                  FROM documents d LEFT JOIN labels l USING (doc_id))
       SELECT 'incomplete_quality' AS check, '' AS key, count(*) || ' rows' AS detail FROM m
       WHERE quality IS NULL HAVING count(*) > 0""",
)
def s2(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("n_chars").cast("double").alias("weight"))
    joined = docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return tables.completeness_violations(joined, ["doc_id", "quality", "weight"])


@query(
    "s3_conform_metadata",
    """SELECT source AS experiment, CAST(doc_id AS VARCHAR) AS matrix_sample_id, n_chars > 100 AS include,
              CAST(NULL AS VARCHAR) AS exclusion_reason, lang AS genotype, CAST(NULL AS INTEGER) AS temperature_c,
              CAST(NULL AS VARCHAR) AS stage, CAST(NULL AS INTEGER) AS day, CAST(NULL AS VARCHAR) AS tissue,
              CAST(NULL AS VARCHAR) AS biological_unit, CAST(NULL AS VARCHAR) AS source_group,
              CAST(NULL AS VARCHAR) AS source_deg_id, 'matched' AS metadata_status FROM documents""",
)
def s3(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("source").alias("experiment"), F.col("doc_id").alias("matrix_sample_id"),
        (F.col("n_chars") > 100).alias("include"), F.col("lang").alias("genotype"),
        F.lit("matched").alias("metadata_status"),
    )
    return tables.conform(docs)


MANIFEST_SQL = """WITH m AS (SELECT 'doc/' || doc_id AS file, sha256(text) AS sha256 FROM documents)"""


def document_manifest(spark, sf):
    """Every document taken as one file of an artifact."""
    docs = table(spark, sf, "documents")
    return docs.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), F.sha2("text", 256).alias("sha256")
    )


@query(
    "s4_result_table",
    """SELECT fmt, c_custkey AS sample_id, c_mktsegment AS layer, CAST(c_acctbal AS DOUBLE) AS coord,
              CASE WHEN c_acctbal < 0 THEN NULL ELSE 'say "' || c_mktsegment || '", x' END AS note
       FROM customer, (SELECT unnest(['csv', 'parquet']) AS fmt)""",
)
def s4(spark, sf):
    """Scores written as a result table in either format below the shared folder and read again."""
    ensure_checkpoint_dir(spark)
    quoted = F.concat(F.lit('say "'), F.col("c_mktsegment"), F.lit('", x'))
    scores = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("sample_id"), F.col("c_mktsegment").alias("layer"), F.col("c_acctbal").cast("double").alias("coord"),
        F.when(F.col("c_acctbal") >= 0, quoted).alias("note"),
    )
    root = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/results-{uuid.uuid4().hex}"
    back = []
    for fmt in ("csv", "parquet"):
        tables.write_table(scores, f"{root}/{fmt}", fmt)
        back.append(tables.read_table(spark, f"{root}/{fmt}", scores.schema, fmt).withColumn("fmt", F.lit(fmt)))
    return union_all(back)


@query(
    "s6_payload_digest",
    MANIFEST_SQL
    + """, h AS (SELECT md5(length(file) || ':' || file || length(sha256) || ':' || sha256) AS h FROM m),
       b AS (SELECT CAST(('0x' || substr(h, 1, 2)) AS BIGINT) % 256 AS b,
                    sum(CAST(('0x' || substr(h, 1, 15)) AS BIGINT)) AS s, count(*) AS n FROM h GROUP BY 1)
       SELECT CAST(sum(n) AS BIGINT) AS files, sha256(string_agg(line, ';' ORDER BY line)) AS payload_digest
       FROM (SELECT n, lpad(CAST(b AS VARCHAR), 3, '0') || ':' || CAST(s AS VARCHAR) || ':' || n AS line FROM b)""",
)
def s6(spark, sf):
    return tables.payload_digest(document_manifest(spark, sf))


@query(
    "s7_verify_manifest",
    """WITH declared AS (SELECT 'doc/' || doc_id AS file, sha256(text) AS sha256 FROM documents
                         UNION ALL SELECT 'doc/' || doc_id, sha256('label') FROM labels WHERE toxic = 1),
       observed AS (SELECT 'doc/' || doc_id AS file, sha256(CASE WHEN lang = 'fr' THEN trim(text) || '.' ELSE text END) AS sha256
                    FROM documents WHERE n_chars > 200
                    UNION ALL SELECT 'page/' || page_id, sha256(html) FROM pages),
       d AS (SELECT file, count(*) AS n, min(sha256) AS want FROM declared GROUP BY file)
       SELECT coalesce(d.file, o.file) AS file,
              CASE WHEN d.n > 1 THEN 'duplicate' WHEN o.file IS NULL THEN 'missing' WHEN d.file IS NULL THEN 'undeclared'
                   WHEN d.want = o.sha256 THEN 'ok' ELSE 'altered' END AS status
       FROM d FULL JOIN observed o ON d.file = o.file""",
)
def s7(spark, sf):
    docs = table(spark, sf, "documents")
    repeats = table(spark, sf, "labels").filter("toxic = 1").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), F.sha2(F.lit("label"), 256).alias("sha256")
    )
    declared = document_manifest(spark, sf).unionByName(repeats)
    text = F.when(F.col("lang") == "fr", F.concat(F.trim("text"), F.lit("."))).otherwise(F.col("text"))
    seen = docs.filter("n_chars > 200").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("file"), F.sha2(text, 256).alias("sha256")
    )
    extra = table(spark, sf, "pages").select(
        F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("file"), F.sha2("html", 256).alias("sha256")
    )
    return tables.verify_manifest(declared, seen.unionByName(extra))


# --- names ---------------------------------------------------------------------


@query(
    "p1_strip_version",
    r"""SELECT p_partkey, regexp_replace(p_brand || '.' || p_size, '\.[0-9]+$', '') AS feature_id FROM part""",
)
def p1(spark, sf):
    raw = F.concat_ws(".", "p_brand", F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", names.strip_suffix(raw).alias("feature_id"))


ORDER_NAME_SQL = """concat_ws('_', 'T' || month(o_orderdate), o_custkey, 'x', o_orderstatus, 'g',
                     substr(o_orderpriority, 1, 1), o_orderpriority)"""


def order_names(spark, sf):
    name = F.concat_ws(
        "_", F.concat(F.lit("T"), F.month("o_orderdate").cast("string")), F.col("o_custkey").cast("string"), F.lit("x"),
        "o_orderstatus", F.lit("g"), F.substring("o_orderpriority", 1, 1), "o_orderpriority",
    )
    return table(spark, sf, "orders").select("o_orderkey", name.alias("name"))


@query(
    "p2_parse_training_names",
    f"""SELECT o_orderkey, split_part(name, '_', 1) AS timepoint, split_part(name, '_', 2) AS subject_id,
               split_part(name, '_', 4) AS condition, split_part(name, '_', 6) AS sex, split_part(name, '_', 7) AS "group"
        FROM (SELECT o_orderkey, {ORDER_NAME_SQL} AS name FROM orders)""",
)
def p2(spark, sf):
    return order_names(spark, sf).select("o_orderkey", *names.parse_name(F.col("name"), names.LAYOUT_TRAINING))


CUSTOMER_NAME_SQL = """concat_ws('_', 'T' || c_nationkey, c_custkey,
                        CASE WHEN c_mktsegment = 'BUILDING' THEN 'Ctrl' ELSE c_mktsegment END, 'wt',
                        CASE WHEN c_acctbal < 0 THEN 'F' ELSE 'M' END)"""


def customer_names(spark, sf):
    name = F.concat_ws(
        "_", F.concat(F.lit("T"), F.col("c_nationkey").cast("string")), F.col("c_custkey").cast("string"),
        F.when(F.col("c_mktsegment") == "BUILDING", "Ctrl").otherwise(F.col("c_mktsegment")), F.lit("wt"),
        F.when(F.col("c_acctbal") < 0, "F").otherwise("M"),
    )
    return table(spark, sf, "customer").select("c_custkey", name.alias("name"))


@query(
    "p3_p4_parse_recode_names",
    f"""SELECT c_custkey, split_part(name, '_', 1) AS timepoint, split_part(name, '_', 2) AS subject_id,
               CASE split_part(name, '_', 3) WHEN 'Ctrl' THEN 'CTL' ELSE split_part(name, '_', 3) END AS condition,
               split_part(name, '_', 5) AS sex, CAST(NULL AS VARCHAR) AS "group"
        FROM (SELECT c_custkey, {CUSTOMER_NAME_SQL} AS name FROM customer)""",
)
def p3(spark, sf):
    parsed = customer_names(spark, sf).select("c_custkey", *names.parse_name(F.col("name"), names.LAYOUT_VALIDATION))
    return parsed.withColumn("condition", names.recode(F.col("condition")))


@query(
    "p5_exclude_sparse_samples",
    """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events
       WHERE NOT regexp_matches((CASE WHEN event_type = 'error' THEN 'WK' ELSE 'T' END) || user_id, '^WK[0-9]')
       GROUP BY event_type""",
)
def p5(spark, sf):
    tag = F.when(F.col("event_type") == "error", "WK").otherwise("T")
    named = table(spark, sf, "events").withColumn("sample_id", F.concat(tag, F.col("user_id").cast("string")))
    return named.filter(~names.has_prefix(F.col("sample_id"))).groupBy("event_type").agg(
        F.count("*").alias("n"), F.countDistinct("user_id").alias("users")
    )


@query(
    "p7_library_ids",
    r"""SELECT name, CASE WHEN regexp_matches(name, '(^|_)[0-9]+$') THEN 'COHP_' || regexp_extract(name, '([0-9]+)$', 1) END
               AS library_id
        FROM (SELECT replace(s_name, '#', '_') AS name FROM supplier
              UNION ALL SELECT replace(c_name, '#', '_') FROM customer
              UNION ALL SELECT replace(p_name, ' ', '_') || '_' || p_size || 'x' FROM part)""",
)
def p7(spark, sf):
    def renamed(name, col):
        return table(spark, sf, name).select(F.regexp_replace(col, "#", "_").alias("name"))

    part = table(spark, sf, "part").select(
        F.concat(F.regexp_replace("p_name", " ", "_"), F.lit("_"), F.col("p_size").cast("string"), F.lit("x")).alias("name")
    )
    every = union_all([renamed("supplier", "s_name"), renamed("customer", "c_name"), part])
    return every.withColumn("library_id", names.library_id(F.col("name")))


@query(
    "p12_subject_time_key",
    f"""SELECT o_orderkey, split_part(name, '_', 2) || '_' || split_part(name, '_', 1) AS pair_key
        FROM (SELECT o_orderkey, {ORDER_NAME_SQL} AS name FROM orders)""",
)
def p12(spark, sf):
    return order_names(spark, sf).select("o_orderkey", names.subject_time_key(F.col("name")).alias("pair_key"))


@query(
    "p15_strip_mature",
    r"""SELECT p_partkey, regexp_replace(p_name || CASE WHEN p_size > 25 THEN '.mature' ELSE '.mature.1' END, '\.mature$', '')
               AS sample_id FROM part""",
)
def p15(spark, sf):
    raw = F.concat("p_name", F.when(F.col("p_size") > 25, ".mature").otherwise(".mature.1"))
    return table(spark, sf, "part").select("p_partkey", names.strip_suffix(raw, names.MATURE_SUFFIX).alias("sample_id"))


@query(
    "p18_classify_ids",
    r"""SELECT c_custkey, CASE WHEN ok THEN 'S' || regexp_extract(id, '^.+_S([124])_(ZZ|ZW)$', 1) END AS stage,
               CASE WHEN ok THEN regexp_extract(id, '^.+_S([124])_(ZZ|ZW)$', 2) END AS genotype,
               CASE WHEN ok THEN concat_ws('_', regexp_extract(id, '^.+_S([124])_(ZZ|ZW)$', 2), '28C',
                    'S' || regexp_extract(id, '^.+_S([124])_(ZZ|ZW)$', 1)) END AS source_group
        FROM (SELECT *, regexp_matches(id, '^.+_S([124])_(ZZ|ZW)$') AS ok
              FROM (SELECT c_custkey, c_name || '_S' || (c_nationkey // 5) || '_' ||
                           CASE WHEN c_acctbal < 5000 THEN 'ZZ' ELSE 'ZW' END AS id FROM customer))""",
)
def p18(spark, sf):
    id_ = F.concat_ws(
        "_", "c_name", F.concat(F.lit("S"), F.floor(F.col("c_nationkey") / 5).cast("string")),
        F.when(F.col("c_acctbal") < 5000, "ZZ").otherwise("ZW"),
    )
    stage, genotype = names.classify(F.col("id"))
    out = table(spark, sf, "customer").select("c_custkey", id_.alias("id")).select(
        "c_custkey", stage.alias("stage"), genotype.alias("genotype")
    )
    group = F.when(F.col("stage").isNotNull(), F.concat_ws("_", "genotype", F.lit("28C"), "stage"))
    return out.withColumn("source_group", group)


# --- joins and sets ------------------------------------------------------------------


@query(
    "p6_shared_features",
    """SELECT CAST(l_partkey AS VARCHAR) AS feature_id FROM lineitem GROUP BY l_partkey
       HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)""",
)
def p6(spark, sf):
    return prep.shared_features(part_cells(spark, sf))


def part_cells(spark, sf):
    """Parts measured per return flag: layer = flag, sample = supplier."""
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("layer"), F.col("l_suppkey").cast("string").alias("sample_id"),
        F.col("l_partkey").cast("string").alias("feature_id"), F.col("l_quantity").alias("value"),
    )


@query(
    "p6_keep_shared_features",
    """WITH shared AS (SELECT l_partkey FROM lineitem GROUP BY 1
                       HAVING count(DISTINCT l_returnflag) = (SELECT count(DISTINCT l_returnflag) FROM lineitem))
       SELECT l_returnflag AS layer, count(*) AS n_cells, sum(l_quantity) AS total
       FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM shared) GROUP BY 1""",
)
def p6_keep(spark, sf):
    cells = part_cells(spark, sf)
    return prep.keep_features(cells, prep.shared_features(cells)).groupBy("layer").agg(
        F.count("*").alias("n_cells"), F.sum("value").alias("total")
    )


P8_SQL = """WITH l AS (SELECT o_orderkey AS k, count(*) AS ln, min(o_orderstatus) AS ls FROM orders GROUP BY 1),
       r AS (SELECT l_orderkey AS k, count(*) AS rn, min(l_linestatus) AS rs, min(l_quantity) AS q FROM lineitem GROUP BY 1)"""


def attach_orders(spark, sf):
    meta = table(spark, sf, "orders").select(F.col("o_orderkey").alias("sample_id"), F.col("o_orderstatus").alias("status"))
    mapping = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("weeks")
    )
    return prep.attach_one_to_one(meta, mapping, ["sample_id"], ["weeks"], ["status"])


@query(
    "p8_attach_one_to_one",
    P8_SQL + " SELECT k AS sample_id, ls AS status, q AS weeks FROM l JOIN r USING (k) WHERE ln = 1 AND rn = 1",
)
def p8(spark, sf):
    return attach_orders(spark, sf).table


@query(
    "p8_attach_violations",
    P8_SQL
    + """, b AS (SELECT coalesce(l.k, r.k) AS k, ln, rn, ls, rs FROM l FULL JOIN r ON l.k = r.k)
       SELECT "check", CAST(k AS VARCHAR) AS key, 'one-to-one attach' AS detail FROM (
         SELECT k, 'duplicate_sample' AS "check" FROM b WHERE ln > 1
         UNION ALL SELECT k, 'duplicate_mapping' FROM b WHERE rn > 1
         UNION ALL SELECT k, 'unmatched_sample' FROM b WHERE rn IS NULL
         UNION ALL SELECT k, 'unmatched_mapping' FROM b WHERE ln IS NULL
         UNION ALL SELECT k, 'mismatched_status' FROM b WHERE ln IS NOT NULL AND rn IS NOT NULL AND ls IS DISTINCT FROM rs)""",
)
def p8_bad(spark, sf):
    return attach_orders(spark, sf).violations


P9_SQL = """WITH n AS (SELECT concat_ws('_', 'L', l_linestatus, l_orderkey, l_suppkey) AS sample_id,
                              'COHP_' || l_suppkey AS k, l_linestatus AS subj FROM lineitem),
       s AS (SELECT 'COHP_' || s_suppkey AS k, CASE WHEN s_acctbal > 3000 THEN 'O' ELSE 'F' END AS subj,
                    s_acctbal AS weeks, s_nationkey FROM supplier WHERE s_nationkey <> 3)"""


def line_mapping(spark, sf):
    name = F.concat_ws(
        "_", F.lit("L"), "l_linestatus", F.col("l_orderkey").cast("string"), F.col("l_suppkey").cast("string")
    )
    lines = table(spark, sf, "lineitem").select(name.alias("sample_id"))
    lines = lines.select(
        "sample_id", names.library_id(F.col("sample_id")).alias("library_id"),
        names.name_part(F.col("sample_id"), 2).alias("subject"),
    )
    source = table(spark, sf, "supplier").filter("s_nationkey <> 3").select(
        F.concat(F.lit("COHP_"), F.col("s_suppkey").cast("string")).alias("library_id"),
        F.when(F.col("s_acctbal") > 3000, "O").otherwise("F").alias("subject"), "s_acctbal",
    )
    return prep.build_mapping(lines, source, "library_id", "subject", "mrna", {"s_acctbal": "sample_weeks"})


@query(
    "p9_build_mapping",
    P9_SQL
    + """ SELECT n.sample_id AS expression_name, n.k AS library_id, 'mrna' AS prepared_layer, s.subj AS subject_id,
                 s.weeks AS sample_weeks FROM n JOIN s USING (k)""",
)
def p9(spark, sf):
    return line_mapping(spark, sf).table


@query(
    "p9_mapping_violations",
    P9_SQL
    + """ SELECT 'missing_library' AS "check", count(*) AS n FROM n ANTI JOIN s USING (k) HAVING count(*) > 0
          UNION ALL SELECT 'subject_mismatch', count(*) FROM n JOIN s USING (k) WHERE n.subj <> s.subj HAVING count(*) > 0""",
)
def p9_bad(spark, sf):
    return per_check(line_mapping(spark, sf).violations)


@query(
    "p10_contract_order",
    """SELECT event_type, user_id, event_id, list_position(['view', 'click', 'purchase'], event_type) AS layer_rank
       FROM events""",
)
def p10(spark, sf):
    ev = table(spark, sf, "events").select("event_type", "user_id", "event_id", "ts")
    out = prep.in_contract_order(ev, "event_type", ["view", "click", "purchase"], "user_id", "ts").drop("ts")
    rank = F.when(F.col("layer_rank") > 0, F.col("layer_rank")).cast("int")
    return out.withColumn("layer_rank", rank)


@query(
    "p11_union_metadata",
    """SELECT 'customer' AS cohort, c_name AS name, c_nationkey AS nation, c_mktsegment AS segment FROM customer
       UNION ALL SELECT 'supplier', s_name, s_nationkey, NULL FROM supplier""",
)
def p11(spark, sf):
    c = table(spark, sf, "customer").select(
        F.lit("customer").alias("cohort"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"),
        F.col("c_mktsegment").alias("segment"),
    )
    s = table(spark, sf, "supplier").select(
        F.lit("supplier").alias("cohort"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )
    return prep.union_metadata([c, s])


@query(
    "p13_duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
)
def p13(spark, sf):
    return prep.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


PAIR_SQL = """WITH e AS (SELECT user_id || '_' || strftime(ts, '%Y-%m-%d') AS pair_key, event_type,
                                CAST(event_id AS VARCHAR) AS sample_id FROM events),
       a AS (SELECT pair_key, count(*) AS na, min(sample_id) AS sample_a FROM e WHERE event_type = 'view' GROUP BY 1),
       b AS (SELECT pair_key, count(*) AS nb, min(sample_id) AS sample_b FROM e WHERE event_type = 'click' GROUP BY 1)"""


def event_pairs(spark, sf):
    ev = table(spark, sf, "events").select(
        F.concat_ws("_", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("pair_key"),
        "event_type", F.col("event_id").cast("string").alias("sample_id"), "value",
    )
    return ev, prep.matched_pairs(ev.filter("event_type = 'view'"), ev.filter("event_type = 'click'"))


@query(
    "p14_matched_pairs",
    PAIR_SQL + " SELECT pair_key, sample_a, sample_b FROM a JOIN b USING (pair_key) WHERE na = 1 AND nb = 1",
)
def p14(spark, sf):
    return event_pairs(spark, sf)[1].table


@query(
    "p14_pair_violations",
    PAIR_SQL
    + """ SELECT 'duplicate_pair_key_a' AS "check", pair_key AS key, CAST(na AS VARCHAR) AS detail FROM a WHERE na > 1
          UNION ALL SELECT 'duplicate_pair_key_b', pair_key, CAST(nb AS VARCHAR) FROM b WHERE nb > 1""",
)
def p14_bad(spark, sf):
    return event_pairs(spark, sf)[1].violations


@query(
    "p14_rekeyed_cells",
    PAIR_SQL
    + """ SELECT 'view' AS layer, pair_key AS sample_id, value FROM a JOIN b USING (pair_key)
            JOIN events ON CAST(event_id AS VARCHAR) = sample_a WHERE na = 1 AND nb = 1
          UNION ALL SELECT 'click', pair_key, value FROM a JOIN b USING (pair_key)
            JOIN events ON CAST(event_id AS VARCHAR) = sample_b WHERE na = 1 AND nb = 1""",
)
def p14_cells(spark, sf):
    ev, pairs = event_pairs(spark, sf)
    return union_all(
        [
            prep.rekey_pairs(ev.filter(F.col("event_type") == layer), pairs.table, side).select(
                F.lit(layer).alias("layer"), "sample_id", "value"
            )
            for layer, side in (("view", "sample_a"), ("click", "sample_b"))
        ]
    )


@query(
    "p16_constant_columns",
    """SELECT c_custkey, 'cohort_1' AS cohort, 28 AS temperature_c, CAST(NULL AS VARCHAR) AS condition FROM customer""",
)
def p16(spark, sf):
    return prep.with_constants(
        table(spark, sf, "customer").select("c_custkey"), {"cohort": "cohort_1", "temperature_c": 28}, ["condition"]
    )


@query(
    "p17_expected_counts",
    """WITH g AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1),
       e AS (SELECT l_returnflag AS k, count(*) AS w FROM lineitem
             WHERE l_linestatus = 'O' OR l_returnflag = 'R' GROUP BY 1)
       SELECT 'expected_count' AS "check", k AS key, coalesce(n, 0) || ' of ' || coalesce(CAST(w AS VARCHAR), 'none') AS detail
       FROM g FULL JOIN e USING (k) WHERE n IS DISTINCT FROM w""",
)
def p17(spark, sf):
    lines = table(spark, sf, "lineitem")
    expected = lines.filter("l_linestatus = 'O' OR l_returnflag = 'R'").groupBy("l_returnflag").agg(
        F.count("*").alias("n_expected")
    )
    return prep.count_contract(lines, "l_returnflag", expected)


@query(
    "p19_flag_conflicts",
    """SELECT l_orderkey, l_linenumber, l_suppkey, ok AS include,
              CASE WHEN ok THEN '' ELSE 'line status differs' END AS exclusion_reason,
              CASE WHEN ok THEN 'matched' ELSE 'group_deg_conflict' END AS metadata_status
       FROM (SELECT *, l_linestatus = CASE WHEN l_returnflag = 'N' THEN 'O' ELSE 'F' END AS ok FROM lineitem)""",
)
def p19(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "l_returnflag")
    right = F.when(F.col("l_returnflag") == "N", "O").otherwise("F")
    return prep.flag_conflicts(df, F.col("l_linestatus"), right, "line status differs", "group_deg_conflict").drop(
        "l_linestatus", "l_returnflag"
    )


@query(
    "p20_join_with_reasons",
    """WITH s AS (SELECT p_name, max(p_brand) AS tissue FROM part WHERE p_size > 48 GROUP BY 1)
       SELECT p_partkey, p_name, s.p_name IS NOT NULL AS include,
              CASE WHEN s.p_name IS NOT NULL THEN '' WHEN contains(lower(p_name), 'ring') THEN 'other kind of part'
                   ELSE 'no entry in the list' END AS exclusion_reason,
              CASE WHEN s.p_name IS NOT NULL THEN 'matched' ELSE 'unmatched' END AS metadata_status,
              CASE WHEN s.p_name IS NOT NULL THEN s.tissue WHEN contains(lower(p_name), 'ring') THEN 'body'
                   ELSE 'unknown' END AS tissue
       FROM part LEFT JOIN s USING (p_name)""",
)
def p20(spark, sf):
    part = table(spark, sf, "part")
    source = part.filter("p_size > 48").groupBy("p_name").agg(F.max("p_brand").alias("tissue"))
    return prep.join_with_reasons(
        part.select("p_partkey", "p_name"), source, "p_name", "ring", "other kind of part",
        "no entry in the list", "body", "unknown",
    )


@query(
    "p21_row_order",
    """SELECT 'row_order' AS "check", CAST(coalesce(a.p, b.p) AS VARCHAR) AS key,
              coalesce(CAST(a.id AS VARCHAR), 'NULL') || ' vs ' || coalesce(CAST(b.id AS VARCHAR), 'NULL') AS detail
       FROM (SELECT c_custkey AS p, c_nationkey AS id FROM customer) a
       FULL JOIN (SELECT s_suppkey AS p, s_nationkey AS id FROM supplier) b ON a.p = b.p
       WHERE a.id IS DISTINCT FROM b.id""",
)
def p21(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("position"), F.col("c_nationkey").cast("string").alias("id"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("position"), F.col("s_nationkey").cast("string").alias("id"))
    return prep.order_agreement(a, b)


# --- audits ----------------------------------------------------------------------------


@query(
    "p22_prepared_audit",
    """SELECT event_type AS layer, count(DISTINCT props) AS features,
              count(*) FILTER (WHERE value > 400 OR value IS NULL) AS missing_values, count(*) AS observations,
              count(DISTINCT user_id) AS subjects, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS min_time,
              strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS max_time, count(*) FILTER (WHERE ts IS NULL) AS missing_time
       FROM events GROUP BY event_type""",
)
def p22(spark, sf):
    ev = table(spark, sf, "events")
    cells = ev.select(
        F.col("event_type").alias("layer"), F.col("props").alias("feature_id"),
        F.when(F.col("value") <= 400, F.col("value")).alias("value"),
    )
    samples = ev.select(F.col("event_type").alias("layer"), "user_id", "ts")
    out = prep.prepared_audit(cells, samples, "user_id", "ts")
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("min_time", "max_time")})


@query(
    "p23_time_ties",
    """SELECT l_suppkey, CAST(sum(n - 1) AS BIGINT) AS breaks
       FROM (SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1) GROUP BY 1""",
)
def p23(spark, sf):
    return prep.time_order_violations(table(spark, sf, "lineitem"), "l_suppkey", "l_shipdate")


@query(
    "p23_stored_order",
    """SELECT user_id, count(*) AS breaks
       FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)
       WHERE value <= p GROUP BY user_id""",
)
def p23_stored(spark, sf):
    return prep.time_order_violations(table(spark, sf, "events"), "user_id", "value", "event_id", chunk=1000)


@query(
    "p24_cap_rows",
    """SELECT user_id, event_type, event_id FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events)
       WHERE rn <= CASE WHEN user_id = 1 AND event_type = 'view' THEN 3 ELSE 4 END""",
)
def p24(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "event_id")
    return prep.cap_rows(ev, ["user_id", "event_type"], ["event_id"], 4, {("1", "view"): 3})


@query(
    "p25_forbidden_fields",
    """SELECT 'event_id' AS field, count(event_id) AS filled FROM events
       UNION ALL SELECT 'event_type', count(event_type) FROM events""",
)
def p25(spark, sf):
    ev = table(spark, sf, "events")
    found = prep.forbidden_fields(ev)
    counts = ev.agg(*[F.count(c).alias(c) for c in found])
    return counts.unpivot([], found, "field", "filled")


@query(
    "prepare_events_cohort",
    """SELECT layer, features, missing_values, observations, subjects FROM (
         SELECT event_type AS layer, count(DISTINCT props) AS features, count(*) FILTER (WHERE value IS NULL) AS missing_values,
                count(*) AS observations, count(DISTINCT user_id) AS subjects
         FROM events WHERE event_type <> 'error' GROUP BY event_type)""",
)
def prepare_events(spark, sf):
    """The preparation flow end to end: read, drop sparse samples, assemble, audit."""
    ev = table(spark, sf, "events").withColumn(
        "sample_id", F.concat(F.when(F.col("event_type") == "error", "WK").otherwise("T"), F.col("event_id").cast("string"))
    ).filter(~names.has_prefix(F.col("sample_id")))
    cells = ev.select(F.col("event_type").alias("layer"), "sample_id", F.col("props").alias("feature_id"), "value")
    samples = ev.select(F.col("event_type").alias("layer"), "user_id", "ts")
    return prep.prepared_audit(cells, samples, "user_id", "ts").drop("min_time", "max_time", "missing_time")


