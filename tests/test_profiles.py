"""Metrics on small tables worked out by hand."""

import datetime
import json
import math
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from colprobe.operators import assess, privacy, quality, samples, scan
from colprobe.operators import frequencies as freq
from colprobe.plans.profile import TableProfile, write_report
from colprobe.session import new_path
from colprobe.sources import tables


def by_column(df):
    return {r["column_name"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Five rows with every kind of gap."""
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, 0.0, "a", None, inf, True, ["x"]),
        (1, -0.0, "b", None, 1.5, True, ["x"]),
        (2, nan, "", None, 2.0, False, ["y"]),
        (None, None, None, None, nan, None, None),
        (3, 1.0, "A", None, -inf, True, ["x"]),
    ]
    schema = "k int, z double, s string, none string, f double, b boolean, tags array<string>"
    return spark.createDataFrame(rows, schema)


def test_missing_is_null_or_nan(odd):
    found = by_column(quality.missing_values(odd))
    counts = {c: r["missing_count"] for c, r in found.items()}
    assert counts == {"k": 1, "z": 2, "s": 1, "none": 5, "f": 1, "b": 1, "tags": 1}


def test_negative_zero_is_zero(odd):
    metrics = by_column(freq.frequency_metrics(odd))
    assert metrics["z"]["distinct_count"] == 2
    assert metrics["z"]["duplicate_count"] == 1
    assert metrics["tags"]["distinct_count"] == 2


def test_missing_counts_as_value_for_numbers_only(odd):
    found = by_column(privacy.entropy_profile(odd))
    # k: groups 2, 1, 1 and the missing group of one
    assert found["k"]["privacy_factor"] == pytest.approx(0.5 / 4)
    assert found["k"]["shannon_entropy"] == pytest.approx(-(0.4 * math.log2(0.4) + 3 * 0.2 * math.log2(0.2)))
    # s: four single values, missing left out, but relative to five rows
    assert found["s"]["privacy_factor"] == 0.0
    assert found["s"]["shannon_entropy"] == pytest.approx(-4 * 0.2 * math.log2(0.2))
    assert found["s"]["hartley_measure"] == pytest.approx(math.log10(4))


def test_mostly_missing_column_is_neutral(odd):
    found = by_column(privacy.privacy_profile(odd))["none"]
    assert (found["privacy_risk_score"], found["privacy_factor"]) == (0.0, 1.0)
    assert (found["shannon_entropy"], found["hartley_measure"]) == (0.0, 0.0)
    assert found["sensitivity_type"] == "None"


@pytest.mark.parametrize(("missing", "skipped"), [(5, False), (6, True)])
def test_skip_needs_more_than_half(spark, missing, skipped):
    rows = [(None,)] * missing + [(f"v{i}@x.com",) for i in range(10 - missing)]
    found = by_column(privacy.privacy_profile(spark.createDataFrame(rows, "c string")))["c"]
    assert (found["privacy_risk_score"] == 0.0) == skipped


def test_unique_column_scores_medium(spark):
    profile = privacy.privacy_profile(spark.range(20))
    row = privacy.with_risk_category(profile).first()
    assert row["privacy_risk_score"] == 0.7
    assert row["risk_category"] == "Medium Risk"
    assert privacy.privacy_summary(profile).first()["overall_privacy_factor"] == 0.0


def test_cells_count_once_per_pattern_and_cap_at_one(spark):
    df = spark.createDataFrame([("a@b.com 10.0.0.1",), ("c@d.org 10.0.0.2",)], "t string")
    row = privacy.sensitivity(df).first()
    assert row["sensitive_data_score"] == 1.0
    assert row["sensitivity_type"] == "email, ip_address"


def test_strict_strings_ignore_columns_with_gaps(spark):
    df = spark.createDataFrame([("a@b.com",), (None,), ("x",)], "t string")
    assert privacy.sensitivity(df).first()["sensitivity_type"] == "email"
    assert privacy.sensitivity(df, strict_strings=True).first()["sensitivity_type"] == "None"
    assert quality.validity(df).first()["invalid_count"] == 1
    assert quality.validity(df, strict_strings=True).first()["invalid_count"] == 0


def test_patterns_against_plain_search(spark):
    import re

    from colprobe.functions.patterns import PATTERNS

    texts = [
        "mail a.b+c@d-e.co now", "call +65 123-456-7890", "call (123) 456 7890", "1234 5678 9012 3456",
        "1234567890123456", "S1234567A", "s1234567A", "12 Long Road", "12 Long  Rd.", "9 A St",
        "1/2/1990", "01-02-90", "1.2.3.4", "999.999.999.999", "1.2.3", "@", "12", "", "x@y", "no",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    row = privacy.pii_counts(df).first()
    for name, pattern in PATTERNS.items():
        assert row[name] == sum(bool(re.search(pattern, t)) for t in texts), name


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string, c timestamp")
    profile = TableProfile(df, with_accuracy=False)
    summary = profile.overall().first()
    assert summary["overall_privacy_score"] == 0.0
    assert summary["overall_quality_score"] == pytest.approx(1.0)
    assert by_column(privacy.entropy_profile(df))["b"]["privacy_factor"] == 1.0
    assert TableProfile(df).quality_summary().first()["accuracy"] == 1.0


def test_validity_counts_infinities_and_empty_strings(odd):
    found = by_column(quality.validity(odd))
    assert (found["f"]["invalid_count"], found["f"]["validity_score"]) == (2, 0.5)
    assert (found["s"]["invalid_count"], found["s"]["validity_score"]) == (2, 0.6)
    assert found["b"]["validity_score"] == 1.0


def test_consistency(odd):
    found = by_column(quality.consistency(odd))
    assert found["f"]["integer_count"] == 1  # infinities are not whole
    assert found["f"]["format_consistency_score"] == 0.75
    assert (found["s"]["lowercase_count"], found["s"]["uppercase_count"]) == (2, 1)
    assert found["none"]["case_consistency_score"] == 1.0
    assert found["tags"]["format_consistency_score"] == 1.0


def test_types(odd):
    found = {c: r["inferred_type"] for c, r in by_column(quality.data_types(odd)).items()}
    assert found == {
        "k": "integer", "z": "integer", "s": "string", "none": "string", "f": "float",
        "b": "boolean", "tags": "string",
    }


def test_decimals_dates_and_odd_names(spark):
    df = spark.sql(
        "SELECT cast(1.50 AS decimal(10,2)) AS `a.b`, date'2024-01-05' AS `d``x`, "
        "timestamp'2024-01-05 00:00:00' AS t, X'00ff' AS raw"
    )
    found = by_column(quality.data_types(df))
    assert found["a.b"]["inferred_type"] == "float"
    assert found["d`x"]["inferred_type"] == "datetime"
    assert found["raw"]["unique_values"] == 1
    values = {r["column_name"]: r["value"] for r in freq.value_frequencies(df).collect()}
    assert values["d`x"] == "2024-01-05"


def test_long_texts_are_told_apart(spark):
    base = "x" * 100
    df = spark.createDataFrame([(base + "a",), (base + "b",), (base + "a",)], "t string")
    assert freq.frequency_metrics(df).first()["distinct_count"] == 2
    assert freq.duplicate_rows(df).first()["duplicate_rows"] == 1
    kept = {r["value"] for r in freq.value_frequencies(df).collect()}
    assert kept == {base + "a", base + "b"}


def test_nulls_are_equal_in_duplicate_rows(spark):
    df = spark.createDataFrame([(None, 1), (None, 1), (0, 1)], "a int, b int")
    assert freq.duplicate_rows(df).first() == Row(row_count=3, duplicate_rows=1)


def test_partitioning_changes_nothing(odd):
    one = by_column(freq.frequency_metrics(odd.coalesce(1)))
    many = by_column(freq.frequency_metrics(odd.repartition(7)))
    assert one == many
    assert sorted(samples.column_samples(odd.coalesce(1)).collect()) == sorted(
        samples.column_samples(odd.repartition(7)).collect()
    )


def test_entropy_bounds(spark):
    df = spark.range(1000).selectExpr("id % 1 AS one", "id % 8 AS eight", "id")
    found = by_column(privacy.entropy_profile(df))
    assert found["one"]["shannon_entropy"] == 0.0
    assert found["eight"]["shannon_entropy"] == pytest.approx(3.0)
    assert found["id"]["shannon_entropy"] == pytest.approx(math.log2(1000))
    assert found["id"]["privacy_factor"] == 0.0


def test_samples(spark):
    df = spark.range(1000).selectExpr(
        "cast(id AS string) AS many", "cast(id % 3 AS string) AS few", "cast(NULL AS string) AS none"
    )
    found = {r["column_name"]: r["samples"] for r in samples.sample_lists(df).collect()}
    assert len(set(found["many"])) == 5
    assert sorted(found["few"]) == ["0", "1", "2"]
    assert "none" not in found
    expected = df.select("many").orderBy(F.md5("many")).limit(5).collect()
    assert found["many"] == [r["many"] for r in expected]


def test_wide_tables_scan_in_passes(spark):
    df = spark.range(3).selectExpr(*[f"concat('v{i}', id) AS c{i}" for i in range(40)])
    found = scan.scan_columns(df).collect()
    assert len(found) == 40
    assert {r["value_count"] for r in found} == {3}


def test_declared_unique_columns_are_not_shuffled(spark):
    df = spark.range(500).selectExpr(
        "id AS k", "concat('key', id) AS t", "id % 5 AS g", "CASE WHEN id > 9 THEN id END AS gaps"
    )
    plain = by_column(freq.frequency_metrics(df))
    declared = freq.frequency_metrics(df, unique_columns=("k", "t", "gaps"))
    assert by_column(declared) == plain
    a = TableProfile(df).quality_summary().first()
    b = TableProfile(df, unique_columns=("k", "gaps")).quality_summary().first()
    assert a == b


def test_approximate_distinct_counts(spark):
    df = spark.range(20000).selectExpr("id", "id % 10 AS few", "cast(NULL AS string) AS none")
    found = {c: r["distinct_count"] for c, r in by_column(freq.approximate_distinct_counts(df)).items()}
    assert found["few"] == 10
    assert found["none"] == 0
    assert abs(found["id"] - 20000) < 2000


def test_ranking_keeps_schema_order_in_ties(spark):
    df = spark.range(4).selectExpr("1 AS a", "id AS b", "2 AS c")
    rows = privacy.ranked_columns(privacy.entropy_profile(df), "shannon_entropy").collect()
    assert [r["column_name"] for r in sorted(rows, key=lambda r: r["rank"])] == ["b", "a", "c"]


def test_assessment_grid(spark):
    def expected(p, q):
        if p > 0.7 and q < 0.4:
            return assess.RISKY_AND_POOR
        if p > 0.7 and q > 0.7:
            return assess.RISKY_BUT_GOOD
        if p < 0.4 and q < 0.4:
            return assess.SAFE_BUT_POOR
        if p < 0.4 and q > 0.7:
            return assess.SAFE_AND_GOOD
        return assess.IN_BETWEEN

    steps = [0.0, 0.39, 0.4, 0.5, 0.69, 0.7, 0.71, 1.0]
    grid = [(p, q) for p in steps for q in steps]
    df = spark.createDataFrame(grid, "overall_privacy_score double, overall_quality_score double")
    for row in assess.assess(df).collect():
        p, q = row["overall_privacy_score"], row["overall_quality_score"]
        assert row["recommendation"] == expected(p, q)
        assert row["privacy_level"] == ("low" if p < 0.4 else "medium" if p < 0.7 else "high")
        assert row["quality_level"] == ("poor" if q < 0.4 else "moderate" if q < 0.7 else "good")


def test_profile_with_and_without_written_tables_agree(spark):
    df = spark.range(300).selectExpr("id", "id % 7 AS d", "concat('n', id % 5) AS s")
    lazy, eager = TableProfile(df, with_accuracy=False), TableProfile(df)
    assert lazy.privacy_summary().first() == eager.privacy_summary().first()
    a, b = lazy.quality_summary().first(), eager.quality_summary().first()
    assert a["uniqueness"] == pytest.approx(b["uniqueness"])
    assert b["duplicate_rows"] == a["duplicate_rows"] == 0
    assert b["accuracy"] < 1.0
    weighted = sum(w * b[name] for name, w in quality.WEIGHTS.items())
    assert b["overall_quality_score"] == pytest.approx(weighted)


def test_json_report(spark):
    df = spark.createDataFrame([(1, "a@b.com"), (2, "x"), (2, "x")], "k int, t string")
    checks = [{"column": "k", "type": "unique", "value": ""}]
    report = TableProfile(df).json_report("mine", "2024-01-01T00:00:00", checks)
    document = json.loads(report.first()["report"])
    assert document["dataset"] == {
        "name": "mine", "num_rows": 3, "num_columns": 2, "columns": ["k", "t"],
    }
    assert document["quality_analysis"]["duplicate_rows"] == 1
    assert document["constraints"]["fail_count"] == 1
    assert [c["column_name"] for c in document["columns"]] == ["k", "t"]
    assert document["columns"][1]["sensitivity_type"] == "email"
    path = new_path(spark, "report")
    write_report(report, path, "json")
    assert json.loads(spark.read.text(path).first()["value"]) == document
    with pytest.raises(ValueError, match="unsupported"):
        write_report(report, path, "pdf")


def test_risk_tables(spark):
    profile = privacy.privacy_profile(
        spark.createDataFrame([("a@b.com", 1), ("c@d.com", 1)], "mail string, k int")
    )
    high = privacy.high_risk_columns(profile).collect()
    assert [(r["column_name"], r["privacy_risk_score"]) for r in high] == [("mail", 1.0)]
    summary = privacy.privacy_summary(profile)
    shares = {r["risk_category"]: r["column_percent"] for r in privacy.risk_distribution(summary).collect()}
    assert shares == {"High Risk": 50.0, "Medium Risk": 50.0, "Low Risk": 0.0}
    level = privacy.dataset_risk_level(summary)
    assert level.first()["risk_level"] == "Medium Risk"
    assert privacy.risk_advice(level).count() == 4


def test_dates_are_counted_as_dates(spark):
    day = datetime.datetime(2024, 1, 5)
    df = spark.createDataFrame([(day,), (day,), (None,)], "t timestamp")
    found = by_column(privacy.entropy_profile(df))["t"]
    assert found["privacy_factor"] == pytest.approx((0.5 + 0.0) / 2)


def test_duplicates_compare_digests_of_whole_rows(spark):
    rows = [("a", None), ("a", ""), ("a", "NULL"), ("a", "-"), (None, "a"), ("1:a", "b"), ("1", ":a1:b"), ("a", None)]
    df = spark.createDataFrame(rows, "x string, y string")
    found = freq.duplicate_rows(df)
    assert tuple(found.first()) == (8, 1)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(digest" in plan


def test_large_samples_and_wide_tables(spark):
    one = spark.range(100).selectExpr("id % 30 AS v")
    assert samples.column_samples(one, 20).count() == 20
    assert samples.column_samples(one, 50).count() == 30
    wide = spark.range(50).selectExpr(*[f"id * {n} AS c{n}" for n in range(1000)])
    began = time.monotonic()
    found = samples.column_samples(wide).groupBy("column_name").count()
    assert found.where("count = 5").count() == 999  # c0 has one value
    assert time.monotonic() - began < 120
    assert freq.approximate_distinct_counts(wide).where("distinct_count > 1").count() == 999
    assert freq.duplicate_rows(wide).first()["duplicate_rows"] == 0


def test_types_of_a_wide_file(spark):
    wide = spark.range(3).selectExpr(*[f"cast(id * {n} AS string) AS c{n}" for n in range(150)])
    found = tables.infer_types(wide)
    assert len(found) == 150 and {t.simpleString() for t in found.values()} == {"bigint"}
