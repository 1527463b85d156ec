"""Registered queries of the training-data operators and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statewell.llm import bpe, brown, decontaminate, extract, licenses, merkle, mixing, neighbours, pii, sharding, simhash, toxicity, variants
from statewell.llm.base import held_out, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rated = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), carry=["doc_id"])
    named = rated.select(F.col("row.doc_id").alias("doc_id"), "score")
    return named.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.scan_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), carry=["doc_id"])
    return decontaminate.digest_columns(found)


OP2_SQL = """
WITH item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
starts AS (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0),
win AS (SELECT DISTINCT coalesce(item_id::VARCHAR, 'null') AS item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM starts),
ks AS (SELECT DISTINCT k FROM win),
doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
grams AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, ks WHERE len(w) >= k),
hit AS (SELECT doc_id, i, grams.k, item_id FROM grams JOIN win ON win.k = grams.k AND win.g = array_to_string(w[i:i + grams.k - 1], ' ')),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN pos USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_license_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_parts(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages"))


def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score(table(spark, sf_dir, "documents"), train=~held_out(5, 1))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest_columns(pii.find_spans(table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return mixed.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = sharding.shard_documents(
        table(spark, sf_dir, "documents"), shards=24, carry=["doc_id"], map_path=sharding.map_folder(spark, "op9", sf_dir)
    )
    return sized.select(
        F.col("row.doc_id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "vslot",
    )


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = merkle.manifest(table(spark, sf_dir, "documents"))
    return made.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def crc32_sql(octets: str) -> str:
    """CRC-32 of a list of byte values: eight shifts for each byte."""
    bits = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, z: xor(r >> 1, 3988292384 * (r & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {bits}), 4294967295)"


def octets_sql(text: str) -> str:
    """The bytes of a text as a list of numbers."""
    return f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"


def _field_sql(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE octet_length(encode({column}::VARCHAR)) || ':' || {column}::VARCHAR END"


_LEAF_SQL = "sha256(" + " || ".join(_field_sql(c) for c in merkle.FIELDS) + ")"

OP11_SQL = f"""
WITH RECURSIVE doc AS MATERIALIZED (
  SELECT doc_id, lang, {_LEAF_SQL} AS leaf,
    CASE WHEN {crc32_sql(octets_sql("doc_id::VARCHAR"))} % 7 = 0 THEN {_LEAF_SQL.replace("n_chars", "(n_chars + 1)")} END AS changed
  FROM documents),
placed AS MATERIALIZED (
  SELECT *, coalesce('=' || lang, '') AS g, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY lang) AS n FROM doc),
tree AS (
  SELECT g, 0 AS h, pos, leaf AS d, n FROM placed
  UNION ALL
  SELECT g, h + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY g, h, pos // 2, n),
nodes AS MATERIALIZED (SELECT * FROM tree),
sub AS MATERIALIZED (SELECT g, h AS top, d, row_number() OVER (ORDER BY g) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
high AS (
  SELECT 0 AS h, pos, d, n FROM sub
  UNION ALL
  SELECT h + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2 FROM high WHERE n > 1 GROUP BY h, pos // 2, n),
heads AS MATERIALIZED (SELECT * FROM high),
beside AS MATERIALIZED (
  SELECT p.g, p.pos, k.h, k.pos % 2 = 1 AS is_left, k.d AS own, s.d AS other
  FROM placed p JOIN nodes k ON k.g = p.g AND k.pos = p.pos >> k.h AND k.n > 1 LEFT JOIN nodes s ON s.g = p.g AND s.h = k.h AND s.pos = xor(k.pos, 1)
  UNION ALL
  SELECT p.g, p.pos, sub.top + k.h, k.pos % 2 = 1, k.d, s.d
  FROM placed p JOIN sub ON sub.g = p.g JOIN heads k ON k.pos = sub.pos >> k.h AND k.n > 1 LEFT JOIN heads s ON s.h = k.h AND s.pos = xor(k.pos, 1)),
proofs AS (SELECT g, pos, sha256(coalesce(string_agg(other, '' ORDER BY h), '')) AS proof_sha256 FROM beside GROUP BY g, pos),
fold AS (
  SELECT g, pos, 0 AS h, coalesce(changed, leaf) AS d FROM placed
  UNION ALL
  SELECT g, pos, fold.h + 1, sha256(CASE WHEN other IS NULL THEN d WHEN is_left THEN other || d ELSE d || other END)
  FROM fold JOIN beside USING (g, pos, h)),
folded AS (SELECT g, pos, arg_max(d, h) AS folded_root FROM fold GROUP BY g, pos)
SELECT p.doc_id, p.leaf, sub.d AS subroot, r.d AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = r.d AS verified
FROM placed p JOIN sub USING (g) CROSS JOIN (SELECT d FROM heads WHERE n = 1) r LEFT JOIN proofs ON proofs.g = p.g AND proofs.pos = p.pos
JOIN folded ON folded.g = p.g AND folded.pos = p.pos
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), bpe.vocabulary_path(), carry=["doc_id"])
    return bpe.digest_columns(coded).select(F.col("row.doc_id").alias("doc_id"), "n_tokens", "ids_sha256", "decoded_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(variants.word_counts(table(spark, sf_dir, "documents")))


OP13_SQL = f"""
WITH RECURSIVE run AS MATERIALIZED (
  SELECT doc_id, r, count(*) AS c FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r FROM documents) GROUP BY ALL),
hashed AS (SELECT r, c, {crc32_sql(octets_sql("(doc_id || ':' || r)"))} AS h FROM run),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN left(r, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS MATERIALIZED (SELECT word, length(word) AS l, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM less a JOIN less b ON a.l = b.l AND a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, w.word, w.n FROM less a JOIN words w ON w.word = a.rest
  UNION SELECT w.word, a.word, a.n FROM less a JOIN words w ON w.word = a.rest),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
named AS (SELECT best.word, n_near, best.m, min(encode(other)) AS other FROM best JOIN near ON near.word = best.word AND near.m = best.m GROUP BY ALL),
formed AS MATERIALIZED (
  SELECT words.word, words.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 2 * words.n THEN decode(other) END AS form,
    CASE WHEN m >= 2 * words.n THEN m END AS form_n FROM words LEFT JOIN named ON named.word = words.word),
walk AS (
  SELECT word, word AS at, 0 AS k FROM formed
  UNION ALL
  SELECT walk.word, f.form, k + 1 FROM walk JOIN formed f ON f.word = walk.at WHERE f.form IS NOT NULL)
SELECT f.word, f.n, n_near, form, form_n, arg_max(walk.at, k) AS root FROM formed f JOIN walk ON walk.word = f.word GROUP BY ALL
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_toxicity, op2_decontaminate, op3_simhash, op4_license_scan, op4_license_parts, op5_main_text, op6_language_model, op7_personal_data, op8_mixing, op9_sharding, op10_near_vectors,
                                    op11_merkle_manifest, op12_byte_bpe, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op2_decontaminate": OP2_SQL, "op4_license_scan": licenses.oracle(), "op11_merkle_manifest": OP11_SQL, "op13_spelling_variants": OP13_SQL}
