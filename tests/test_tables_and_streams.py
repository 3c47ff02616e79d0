import pytest
from pyspark.sql import types as T

from colprobe.operators import interactions
from colprobe.session import spread, work_dir
from colprobe.sources import tables


@pytest.fixture(scope="module")
def delimited(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("csv") / "t.csv"
    path.write_text(
        "n,x,flag,mixed,gone,created_at,plain_day,quoted\n"
        "1,1.5,True,1,NA,2024-01-05 10:00:00,2024-01-05,\"a, \"\"b\"\"\"\n"
        "2,NaN,False,x,,2024-01-06,2024-01-06,None\n"
        "-3,1e3,true,n/a,null,,2024-01-07,\"#N/A\"\n"
    )
    return str(path)


def test_delimited_types(spark, delimited):
    df = tables.load_table(spark, delimited)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    assert kinds == {
        "n": T.LongType(),
        "x": T.DoubleType(),
        "flag": T.BooleanType(),
        "mixed": T.StringType(),
        "gone": T.DoubleType(),
        "created_at": T.TimestampNTZType(),
        "plain_day": T.StringType(),
        "quoted": T.StringType(),
    }
    rows = df.orderBy("n").collect()
    assert [r["x"] for r in rows] == [1000.0, 1.5, None]
    assert [r["mixed"] for r in rows] == [None, "1", "x"]
    assert [r["quoted"] for r in rows] == [None, 'a, "b"', None]


def test_declared_schema(spark, delimited):
    schema = tables.load_table(spark, delimited).schema
    schema["n"].dataType = T.DoubleType()
    assert tables.load_delimited(spark, delimited, schema).schema["n"].dataType == T.DoubleType()


def test_suffixes_of_java_numbers_are_text(spark, tmp_path):
    (tmp_path / "t.csv").write_text("a,b\n1d,12.0\n2f,3\n")
    df = tables.load_delimited(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"a": "string", "b": "double"}


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unsupported"):
        tables.load_table(spark, "/tmp/table.xyz")


def test_normalize(spark):
    df = spark.sql("SELECT double('NaN') AS d, -0.0D AS z, array(1) AS a, struct(1 AS x) AS s")
    row = tables.normalize(df).first()
    assert row["d"] is None
    assert str(row["z"]) == "0.0"
    assert (row["a"], row["s"]) == ('{"v":[1]}', '{"v":{"x":1}}')


def test_spread_leaves_large_inputs_alone(spark):
    assert spread(spark.range(10).repartition(20)).rdd.getNumPartitions() == 20


def test_work_dir_is_the_configured_folder(spark):
    assert work_dir(spark) == spark.conf.get("spark.checkpoint.dir")


def test_append_turns(spark):
    schema = "conv_id long, turn long, role string, text string"
    history = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], schema)
    new = spark.createDataFrame([(1, "q", "r"), (2, "s", "t")], "conv_id long, question string, answer string")
    rows = interactions.append_turns(history, new).orderBy("conv_id", "turn").collect()
    assert [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in rows] == [
        (1, 0, "user", "a"),
        (1, 1, "assistant", "b"),
        (1, 2, "user", "q"),
        (1, 3, "assistant", "r"),
        (2, 0, "user", "s"),
        (2, 1, "assistant", "t"),
    ]
