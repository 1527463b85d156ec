import gzip
import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statewell.common import ContractError, enforce
from statewell.functions import names
from statewell.operators import contracts as con, prep
from statewell.sources import matrix, tables


def checks(df):
    return sorted(r["check"] for r in df.collect())


def test_wide_matrix_gzip(spark, tmp_path):
    path = tmp_path / "m.tsv.gz"
    with gzip.open(path, "wt") as f:
        f.write("gene\tT0_1_a_CM\tT1_1_a_CM\nENS1.4\t1.5\t2\nENS2.11\t-3\tNA\n")
    cells = matrix.read_wide_matrix(spark, str(path), "mrna").withColumn("feature_id", names.strip_suffix(F.col("feature_id")))
    got = {(r.sample_id, r.feature_id): r.value for r in cells.collect()}
    assert got == {("T0_1_a_CM", "ENS1"): 1.5, ("T1_1_a_CM", "ENS1"): 2.0, ("T0_1_a_CM", "ENS2"): -3.0, ("T1_1_a_CM", "ENS2"): None}
    assert checks(con.finite_violations(cells)) == ["not_finite"]
    comma = tmp_path / "m.csv"
    comma.write_text('"id","a","b"\n"x",1,2\n')
    assert matrix.read_wide_matrix(spark, str(comma), "l", sep=",").count() == 2


def sample_times():
    n = 6
    return pd.DataFrame(
        {
            "expression_name": [f"T{i % 3}_{i // 3}_x_{100 + i}" for i in range(n)],
            "library_id": [f"COHP_{100 + i}" for i in range(n)],
            "source_cohort": "c", "prepared_layer": "l", "mouse_id": [str(i // 3) for i in range(n)],
            "sample_weeks": [0.0, 1.5, 4.0, 0.0, 2.0, 3.25],
        }
    )


def test_strict_csv(spark, tmp_path):
    pdf = sample_times()
    pdf.to_csv(tmp_path / "ok.csv", index=False)
    df, bad = tables.read_sample_times(spark, str(tmp_path / "ok.csv"))
    assert df.count() == 6 and not bad.take(1)
    assert [r.sample_weeks for r in df.orderBy("library_id").collect()] == list(pdf.sample_weeks)
    pdf.loc[5, "library_id"] = "COHP_100"
    pdf.to_csv(tmp_path / "dup.csv", index=False)
    assert checks(tables.read_sample_times(spark, str(tmp_path / "dup.csv"))[1]) == ["duplicate_library_id"]
    pdf.drop(columns="mouse_id").to_csv(tmp_path / "cols.csv", index=False)
    with pytest.raises(ContractError):
        tables.read_sample_times(spark, str(tmp_path / "cols.csv"))
    pdf.astype({"sample_weeks": object}).assign(sample_weeks="x").to_csv(tmp_path / "text.csv", index=False)
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|parse"):
        tables.read_sample_times(spark, str(tmp_path / "text.csv"))[0].collect()


def test_attach_reports_every_mismatch(spark):
    meta = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("c", "3")], "sample_id string, mouse_id string")
    mapping = spark.createDataFrame(
        [("a", "1", 0.5), ("b", "9", 1.0), ("d", "4", 2.0), ("c", "3", 3.0)], "sample_id string, mouse_id string, weeks double"
    )
    got = prep.attach_one_to_one(meta, mapping, ["sample_id"], ["weeks"], ["mouse_id"])
    assert {(r["check"], r["key"]) for r in got.violations.collect()} == {
        ("mismatched_mouse_id", "b"), ("unmatched_mapping", "d"), ("duplicate_sample", "c"),
    }
    assert {r.sample_id: r.weeks for r in got.table.collect()} == {"a": 0.5, "b": 1.0}
    with pytest.raises(ContractError, match="mismatched_mouse_id|unmatched|duplicate"):
        enforce(got.violations)


def test_names(spark):
    df = spark.createDataFrame([("T2_4501_x_CM_wt_F_B_77",), ("L_4502_Ctrl_wt_M_78",), ("WK10_3127_a",)], "n string")
    a = df.select(*names.parse_name(F.col("n"), names.LAYOUT_TRAINING)).collect()
    assert tuple(a[0]) == ("T2", "4501", "CM", "F", "B") and a[2].sex is None
    b = df.select(*names.parse_name(F.col("n"), names.LAYOUT_VALIDATION)).select("condition", names.recode(F.col("condition"))).collect()
    assert b[1][1] == "CTL"
    assert [r[0] for r in df.select(names.library_id(F.col("n"))).collect()] == ["COHP_77", "COHP_78", None]
    assert [r[0] for r in df.select(names.has_prefix(F.col("n"))).collect()] == [False, False, True]
    assert df.select(names.subject_time_key(F.col("n"))).first()[0] == "4501_T2"


@pytest.mark.parametrize("chunk", [2, 1000])
def test_stored_time_order(spark, chunk):
    rng = np.random.default_rng(41)
    pdf = pd.DataFrame({"s": rng.choice(list("aab"), 200), "t": rng.integers(0, 30, 200), "i": np.arange(200)})
    want = {s: int((g.t.diff() <= 0).sum()) for s, g in pdf.groupby("s")}
    got = prep.time_order_violations(spark.createDataFrame(pdf), "s", "t", "i", chunk)
    assert {r.s: r.breaks for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_longitudinal_contract(spark):
    ok = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 1.0)], "s string, t double")
    assert checks(con.longitudinal_violations(ok, "s", "t")) == []
    assert checks(con.longitudinal_violations(ok, "s", "other")) == ["missing_column"]
    assert checks(con.longitudinal_violations(ok, "t", "s")) == ["time_type"]
    assert checks(con.longitudinal_violations(ok.filter("t < 2"), "s", "t")) == ["no_repeated_subject"]
    nulls = ok.union(spark.createDataFrame([(None, None), ("a", 1.0)], ok.schema))
    assert checks(con.longitudinal_violations(nulls, "s", "t")) == ["duplicate_visit", "subject_null", "time_null"]


def test_target_and_anchor(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 1.0), (None, float("nan"))], "lab string, v double")
    assert checks(con.target_violations(df, "lab", "binary", ["x", "z"])) == [
        "target_null", "target_undeclared_level", "target_unseen_level",
    ]
    assert checks(con.target_violations(df.filter("lab IS NOT NULL"), "lab", "binary", ["x", "y"])) == []
    assert checks(con.target_violations(df, "v", "continuous")) == ["target_constant", "target_not_finite"]
    assert checks(con.anchor_violations(df, "lab")) == ["anchor_type"]
    assert checks(con.anchor_violations(df, "none")) == ["missing_column"]
    with pytest.raises(ContractError):
        con.target_violations(df, "lab", "binary", ["x"])


def test_alignment_reasons(spark):
    cells = spark.createDataFrame([("A", s) for s in "abcde"], "layer string, sample_id string")
    mapping = spark.createDataFrame(
        [("A", "p1", "a"), ("A", "p2", "b"), ("A", "p3", "b"), ("A", "p4", "c"), ("A", "p5", "d")],
        "layer string, primary_id string, sample_id string",
    )
    samples = spark.createDataFrame([("p1",), ("p4",), ("p4",)], "primary_id string")
    got = {r.sample_id: r.reason for r in con.alignment(cells, mapping, samples).collect()}
    assert got == {"a": None, "b": "ambiguous_mapping", "c": "duplicate_primary", "d": "missing_primary", "e": "missing_mapping"}


def test_digests_ignore_order_and_see_repeats(spark):
    df = spark.range(500).withColumn("v", F.col("id") % 7)
    one = con.input_digest(df, ["id", "v"]).first()
    assert one == con.input_digest(df.repartition(9).orderBy(F.desc("id")), ["id", "v"]).first()
    assert one.digest != con.input_digest(df.union(df.limit(1)), ["id", "v"]).first().digest
    log = con.append_provenance(None, con.provenance_step(con.input_digest(df, ["id"]), "decompose", "svd", {"k": 2}))
    assert log.first().params == {"k": "2"} and log.first().input_rows == 500
    assert con.append_provenance(log, log).count() == 2


def test_file_manifest(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "sub" / "b.txt").write_text("two")
    declared = tables.digest_manifest(spark, str(tmp_path))
    assert {r.file: r.sha256 for r in declared.collect()} == {
        "a.txt": hashlib.sha256(b"one").hexdigest(), "sub/b.txt": hashlib.sha256(b"two").hexdigest(),
    }
    kept = spark.createDataFrame(declared.collect(), declared.schema)
    before = tables.payload_digest(kept).first()
    (tmp_path / "sub" / "b.txt").write_text("changed")
    (tmp_path / "c.txt").write_text("new")
    bad = spark.createDataFrame([("/etc/x", "0"), ("gone.txt", "0"), ("a.txt", "0")], kept.schema)
    status = {r.file: r.status for r in tables.verify_manifest(kept.union(bad), tables.digest_manifest(spark, str(tmp_path))).collect()}
    assert status == {"a.txt": "duplicate", "sub/b.txt": "altered", "c.txt": "undeclared", "gone.txt": "missing", "/etc/x": "unsafe_path"}
    assert before.files == 2 and before != tables.payload_digest(tables.digest_manifest(spark, str(tmp_path))).first()


def test_tables_and_versions(spark, tmp_path):
    raw = spark.createDataFrame([("e", "s1", "true", "28")], "experiment string, matrix_sample_id string, include string, temperature_c string")
    full = tables.conform(raw)
    assert full.columns == tables.EXPERIMENT_METADATA.fieldNames() and full.first().temperature_c == 28
    for fmt in ("csv", "parquet"):
        tables.write_table(full, str(tmp_path / fmt), fmt)
        back = tables.read_table(spark, str(tmp_path / fmt), tables.EXPERIMENT_METADATA, fmt)
        assert back.collect() == full.collect()
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, schema_version string")
    assert checks(con.version_violations(old, "2")) == ["schema_version"]
    steps = {"1": ("2", {"design": "unspecified"})}
    new = con.upgrade_version(old, steps, "2")
    assert checks(con.version_violations(new, "2")) == []
    assert {r.id: r.design for r in new.collect()} == {"a": "unspecified", "b": None}
    a, b = raw.select("experiment", "include"), raw.select("include", "experiment")
    assert matrix.column_set_differences(a, b).count() == 4 and matrix.column_set_differences(a, a).count() == 0


def test_cohort_defaults_and_shape(spark):
    layer = spark.createDataFrame([("s1", "f", 1.0), ("s2", "f", 2.0)], "sample_id string, feature_id string, value double")
    samples = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "primary_id string")
    c = matrix.assemble_cohort({"A": layer, "B": layer.filter("sample_id = 's1'")}, samples)
    assert con.sample_map_violations(c.cells, c.sample_map, samples).count() == 0
    whole = con.complete_cohort(c.sample_map)
    assert [r.primary_id for r in whole.collect()] == ["s1"]
    assert checks(con.cohort_size_violations(whole)) == ["too_few_complete"]
    assert sorted(r.primary_id for r in con.exclusions(samples, whole).collect()) == ["s2", "s3"]
    assert prep.shared_features(c.cells).count() == 1
    assert prep.forbidden_fields(spark.createDataFrame([(1, 2)], "endpoint_day int, x int")) == ["endpoint_day"]
