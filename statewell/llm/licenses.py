"""License scan by canonical digest lookup.

Texts are brought to a canonical form: A-Z in lower case, copyright lines dropped, equivalent spellings made one,
punctuation and white space runs made one blank. The digest of the whole canonical text is looked up in the digests of
known license texts, a fixed set that is broadcast. Only DataFrame functions; no shuffle.

Definitions:
* a null text counts as empty; a text without words left has a digest but no license;
* every row gives one row, repeated rows included; of known texts with equal digests the first by name counts;
* only id and text are read, so other columns cannot clash; an empty table gives an empty result.

``scan_parts`` looks up the lines and blocks (between blank lines) of a text as well, and knows standard statements and more
texts besides. Lines and blocks without a word that every known text has are left out before the digest.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from statewell.llm.base import LOWER, UPPER
from statewell.llm.license_texts import DIGESTS, SPELLINGS, STATEMENTS, TEXTS

COPYRIGHT_LINE = "(^|\\n)[^\\na-z0-9]*(copyright[^\\n]*([12][0-9][0-9][0-9]|\\(c\\)|©|<|\\[)|\\(c\\) |©)[^\\n]*"
RESERVED_LINE = "(^|\\n)[^\\na-z0-9]*all rights reserved[^\\na-z0-9]*"
NOT_WORD = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F«»©–—‘’“”\\u00A0]+"

#: Every known text and statement has one of these words, in any spelling; tested.
ANCHOR = "(?i)licen[cs]|permission|redistribut|unencumbered|released|distributed|free software"
LINE_END, BLOCK_END = "\\R", "\\R\\s*\\R"


def canonical(text: Column) -> Column:
    """Canonical form of a text: words with one blank between, before and after."""
    out = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    out = F.regexp_replace(out, RESERVED_LINE, "\n")
    out = F.regexp_replace(out, COPYRIGHT_LINE, "\n")
    out = F.regexp_replace(F.concat(F.lit(" "), out, F.lit(" ")), NOT_WORD, " ")
    for found, kept in SPELLINGS:
        out = F.replace(out, F.lit(f" {found} "), F.lit(f" {kept} "))
    return out


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known(spark: SparkSession, texts: dict[str, str] = TEXTS) -> DataFrame:
    """``(license, digest)`` of the known texts, one row a digest."""
    rows = F.inline(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in texts.items()]))
    named = spark.range(1).select(rows).select("license", digest(F.col("text")).alias("digest"))
    return named.groupBy("digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: dict[str, str] = TEXTS) -> DataFrame:
    """``(key, digest, license)`` for every row; license is null where the whole text is no known one."""
    own = docs.select(F.col(key), digest(F.col(text)).alias("digest"))
    return own.join(F.broadcast(known(docs.sparkSession, texts)), "digest", "left").select(key, "digest", "license")


def known_parts(spark: SparkSession) -> DataFrame:
    """``(license, part)`` of texts, statements and digests, one row a digest; a title in brackets is no part of a name."""
    rows = [{"license": name.split(" (")[0], "text": text} for name, text in [*TEXTS.items(), *STATEMENTS]]
    fixed = [{"license": name, "part": part} for name, part in DIGESTS.items()]
    one = spark.range(1)
    texts = one.select(F.inline(F.from_json(F.lit(json.dumps(rows)), "array<struct<license:string,text:string>>")))
    digests = one.select(F.inline(F.from_json(F.lit(json.dumps(fixed)), "array<struct<license:string,part:string>>")))
    named = texts.select("license", digest(F.col("text")).alias("part")).unionByName(digests)
    return named.groupBy("part").agg(F.min("license").alias("license"))


def scan_parts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, digest, licenses, n_found)`` for every row: the licenses that the whole text, a line or a block names, and how many known texts that are.

    ``licenses`` are sorted names with commas between, null if there are none. Only ids and digests are shuffled.
    """

    def parts(end: str) -> Column:
        return F.transform(F.filter(F.split(F.col("text"), end), lambda x: x.rlike(ANCHOR)), digest)

    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    within = F.when(F.col("text").rlike(ANCHOR), F.concat(parts(LINE_END), parts(BLOCK_END))).otherwise(F.array().cast("array<string>"))
    digests = own.select("key", digest(F.col("text")).alias("digest"), within.alias("within"), F.monotonically_increasing_id().alias("row"))
    every = digests.select("key", "digest", "row", F.explode(F.array_distinct(F.concat(F.array("digest"), "within"))).alias("part"))
    named = every.join(F.broadcast(known_parts(docs.sparkSession)), "part", "left")
    rows = named.groupBy("row").agg(
        F.first("key").alias("key"), F.first("digest").alias("digest"), F.sort_array(F.collect_set("license")).alias("found"), F.count("license").alias("n_found")
    )
    names = F.when(F.size("found") > 0, F.array_join("found", ","))
    return rows.select(F.col("key").alias(key), "digest", names.alias("licenses"), "n_found")


def sql_literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(text: str) -> str:
    """The same form in DuckDB."""
    out = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    for pattern in (RESERVED_LINE, COPYRIGHT_LINE):
        out = f"regexp_replace({out}, {sql_literal(pattern)}, chr(10), 'g')"
    out = f"regexp_replace(' ' || {out} || ' ', {sql_literal(NOT_WORD.replace(chr(92) + 'u00A0', chr(160)))}, ' ', 'g')"
    for found, kept in SPELLINGS:
        out = f"replace({out}, ' {found} ', ' {kept} ')"
    return out


def oracle(texts: dict[str, str] = TEXTS) -> str:
    """DuckDB SQL of ``scan`` on the table documents."""
    values = ", ".join(f"({sql_literal(name)}, {sql_literal(text)})" for name, text in texts.items())
    return f"""
WITH known AS (SELECT sha256({canonical_sql('body')}) AS digest, min(name) AS license FROM (VALUES {values}) AS t(name, body) GROUP BY 1),
own AS (SELECT doc_id, sha256({canonical_sql('text')}) AS digest FROM documents)
SELECT doc_id, digest, license FROM own LEFT JOIN known USING (digest)
"""
