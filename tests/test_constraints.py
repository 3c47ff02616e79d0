import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from colprobe.functions.dates import IllegalFormat, follows, to_spark_format
from colprobe.operators.constraints import (
    apply_constraints,
    constraint_summary,
    constraint_table,
)


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "Ann", 1.5, "2024-1-5", True),
        (2, "bob", None, "2024-02-30", True),
        (2, None, float("nan"), "2024-01-05x", False),
        (4, "Ann", 9.0, None, None),
    ]
    return spark.createDataFrame(rows, "id int, name string, score double, day string, ok boolean")


def check(df, column, kind, value=None):
    return apply_constraints(df, [{"column": column, "type": kind, "value": value}]).first()


@pytest.mark.parametrize(
    ("column", "kind", "value", "rate", "error"),
    [
        ("name", "not_null", "", 0.75, "1 null values found"),
        ("id", "unique", "", 0.0, "1 duplicate values found"),
        ("score", "unique", "", 1.0, ""),
        ("score", "min_value", "2", 0.5, "1 values below minimum"),
        ("score", "min_value", "", 1.0, ""),
        ("score", "max_value", "1e3", 1.0, ""),
        ("score", "max_value", "nan", 0.0, "2 values above maximum"),
        ("score", "max_value", "many", 0.0, "Invalid maximum value"),
        ("ok", "min_value", "1", 2 / 3, "1 values below minimum"),
        ("name", "min_value", "1", 0.0, "Column is not numeric"),
        ("name", "regex", "A", 2 / 3, "1 values don't match pattern"),
        ("name", "regex", "n", 0.0, "3 values don't match pattern"),
        ("name", "regex", "A|b", 1.0, ""),
        ("name", "regex", "(?P<x>[Ab]).*", 1.0, ""),
        ("name", "regex", "", 0.0, "No regex pattern provided"),
        ("name", "regex", "(", 0.0, "Invalid regex pattern"),
        ("id", "regex", "1", 0.0, "Column is not string type"),
        ("name", "value_in_list", " Ann , bob", 1.0, ""),
        ("id", "value_in_list", "1, 2.0", 0.75, "1 values not in allowed list"),
        ("id", "value_in_list", "1,x", 0.0, "Invalid list format or type mismatch"),
        ("name", "value_in_list", "", 0.0, "No list of values provided"),
        ("day", "date_format", "", 1 / 3, "2 values don't match date format"),
        ("day", "date_format", "%Q", 0.0, "3 values don't match date format"),
        ("gone", "not_null", "", 0.0, "Column not found in dataset"),
        ("id", "odd", "", 0.0, "Unknown constraint type"),
    ],
)
def test_kinds(people, column, kind, value, rate, error):
    row = check(people, column, kind, value)
    assert row["pass_rate"] == pytest.approx(rate)
    assert row["error"] == error
    assert row["passed"] == (rate == 1.0)


def test_nothing_present_passes(people):
    nobody = people.where("id > 9")
    for kind, value in [("not_null", ""), ("min_value", "5"), ("date_format", ""), ("unique", "")]:
        column = "score" if kind == "min_value" else "day"
        assert check(nobody, column, kind, value)["passed"]


def test_order_is_kept_and_nameless_entries_drop(people):
    wanted = [
        {"column": "id", "type": "unique", "value": ""},
        {"column": None, "type": "unique", "value": ""},
        {"column": "gone", "type": "unique", "value": ""},
        {"column": "id", "type": "not_null", "value": ""},
    ]
    results = apply_constraints(people, wanted)
    assert [r["column"] for r in results.collect()] == ["id", "gone", "id"]
    assert constraint_summary(results).first()["pass_count"] == 1
    shown = constraint_table(results).collect()
    assert shown[2]["constraint_type"] == "Not Null"
    assert shown[2]["pass_rate"] == "100.0%"


def test_no_constraints(people):
    summary = constraint_summary(apply_constraints(people, [])).first()
    assert (summary["total_count"], summary["overall_score"]) == (0, 1.0)


def test_only_settled_constraints(people):
    assert check(people, "gone", "not_null")["error"] == "Column not found in dataset"


def test_pattern_java_cannot_read(people):
    """Python reads it instead, and the rest of the list runs as ever."""
    names = [r["name"] for r in people.collect()]
    for pattern in (r"(?P<a_b>[Ab])", r"(A)?(?(1).|b)", "(?a:A)"):
        rows = apply_constraints(
            people,
            [
                {"column": "name", "type": "regex", "value": pattern},
                {"column": "name", "type": "not_null", "value": ""},
            ],
        ).orderBy("constraint_ix").collect()
        held = [n is not None and re.match(pattern, n) is not None for n in names if n is not None]
        assert rows[0]["pass_rate"] == pytest.approx(sum(held) / len(held))
        assert len(rows) == 2


def test_iso_weeks_are_those_of_python(spark):
    formats = ["%G-W%V-%u", "%G %V %a", "%V/%G %w", "%G-%V", "%G-%V-%u %j", "%Y-W%V-%u", "W%V %H:%M %G %u"]
    texts = [f"{y}-W{w}-{d}" for y in (1, 2004, 2015, 2020, 2021) for w in ("1", "09", "52", "53", "0") for d in (0, 1, 7)]
    texts = [t.rjust(len(t) + 4 - t.index("-"), "0") for t in texts]
    texts += ["2020 53 Mon", "2021 53 mon", "53/2020 0", "52/2021 7", "2020-53", "2020-10-1 5", "W53 23:59 2020 7", "W53 25:00 2020 7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for fmt in formats:
        for text, got in df.select("t", _follows("t", fmt)).collect():
            try:
                datetime.strptime(text, fmt)
                expected = True
            except ValueError:
                expected = False
            assert got == expected, (text, fmt)


def _follows(name, fmt):
    try:
        return follows(F.col(name), fmt)
    except IllegalFormat:
        return F.lit(False)


def test_formats():
    assert to_spark_format("%Y-%m-%dT%H:%M") == "yyyy-M-d'T'H:m"
    assert to_spark_format("%d o'clock") == "d 'o''clock'"
    with pytest.raises(IllegalFormat):
        to_spark_format("%Q")


def parses(text, fmt):
    try:
        datetime.strptime(text, fmt)
        return True
    except ValueError:
        return False


@pytest.mark.parametrize(
    "fmt",
    [
        "%a %d %b %Y",
        "%A, %d. %B %Y",
        "%d/%m/%Y %w",
        "%c",
        "%x",
        "%X",
        "%x %X",
        "%Y week %U",
        "%Y-%m-%d %Z",
        "%a",
        "%d %b %Y at %I:%M %p",
        "%Y-%m-%dT%H:%M:%S",
    ],
)
def test_dates_follow_strptime(spark, fmt):
    texts = [
        "Mon 05 Feb 2024", "mon 5 feb 2024", "Xyz 05 Feb 2024", "Fri 31 Feb 2024",
        "Sunday, 7. July 2024", "Sun, 7. July 2024", "07/07/2024 3", "07/07/2024 7",
        "Mon Feb  5 10:11:12 2024", "Mon Feb 5 25:11:12 2024", "02/29/24", "02/29/23", "13/01/24",
        "10:11:12", "24:00:00", "02/29/24 10:11:12", "2024 week 53", "2024 week 54",
        "2024-02-03 UTC", "2024-02-03 gmt", "2024-02-03 XYZ", "Tue", "tuesday", "", "x",
        "5 Feb 2024 at 11:05 pm", "5 Feb 2024 at 13:05 pm", "2024-02-03T04:05:06",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", follows(F.col("t"), fmt).alias("found")).collect()
    assert {r["t"]: r["found"] for r in rows} == {t: parses(t, fmt) for t in texts}


def test_an_unusable_format_fails_its_own_row_only(people):
    rows = apply_constraints(
        people,
        [
            {"column": "day", "type": "date_format", "value": "%G-%V"},
            {"column": "id", "type": "not_null", "value": ""},
        ],
    ).collect()
    assert [r["passed"] for r in rows] == [False, True]
    assert rows[0]["pass_rate"] == 0.0 and "date format" in rows[0]["error"]


def test_long_lists_of_constraints(people):
    many = [{"column": "id", "type": "min_value", "value": str(n)} for n in range(300)]
    rows = apply_constraints(people, many).collect()
    assert [r["constraint_ix"] for r in rows] == list(range(300))
    assert [r["pass_rate"] for r in rows[:5]] == [1.0, 1.0, 0.75, 0.25, 0.25]
