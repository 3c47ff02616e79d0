"""Secrets in texts, found once per content and rule version and kept in a ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from colprobe.llm.common import texts
from colprobe.session import files_of, new_path

RULE_VERSION = 1
_WORDS = "password|passwd|secret|token|api_?key"
_EITHER_CASE = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in _WORDS)
ASSIGN = rf"({_EITHER_CASE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ASSIGN_LENGTH = 6
# Maximal runs, so asking for the length in the pattern loses no match.
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
PEM = r"-----BEGIN\x20[A-Z0-9\x20]*PRIVATE\x20KEY-----"
# Order breaks ties between spans that start together; "pem" is the added kind.
KINDS = ("assign", "access", "hex", "pem")
BASE = KINDS[:3]


def _hits(kind: str, pattern: str, guard: Column, group: int = 0) -> Column:
    """Array of (kind, nth, gap, length, inner) of the matches of one rule.

    ``gap`` counts the characters since the match before, ``inner`` those of ``group``.
    """
    text = F.col("text")
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    zipped = F.arrays_zip(gaps.alias("gap"), found.alias("found"), inner.alias("inner"))
    hits = F.transform(
        zipped,
        lambda z, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("nth"),
            F.length(z["gap"]).alias("gap"),
            F.length(z["found"]).alias("length"),
            F.length(z["inner"]).alias("inner"),
        ),
    )
    return F.when(guard, hits).otherwise(F.lit([]).cast(HIT))


HIT = "array<struct<kind:string,nth:int,gap:int,length:int,inner:int>>"


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, kind, start, end) of every span, and a row without kind per blob.

    ``blobs`` has (blob, text). Positions follow from the lengths of matches and of the
    text between them, summed over rows, so the work is linear in the matches.
    """
    text = F.col("text")
    hits = F.concat(
        _hits("assign", ASSIGN, F.rlike(text, F.lit(ASSIGN)), 2),
        _hits("access", ACCESS, F.contains(text, F.lit("AKIA"))),
        _hits("hex", HEX, F.rlike(text, F.lit(HEX))),
        _hits("pem", PEM, F.contains(text, F.lit("-----BEGIN "))),
    )
    mark = F.array(
        F.struct(
            F.lit(None).cast("string").alias("kind"),
            *[F.lit(0).alias(n) for n in ("nth", "gap", "length", "inner")],
        )
    )
    rows = blobs.select("blob", F.inline(F.concat(mark, hits)))
    order = W.partitionBy("blob", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("length")).over(order)
    spans = rows.select("blob", "kind", "length", "inner", end.alias("end"))
    enough = (F.col("inner") >= ASSIGN_LENGTH) | ~F.col("kind").eqNullSafe(F.lit("assign"))
    return spans.where(enough).select(
        "blob", "kind", (F.col("end") - F.col("length")).alias("start"), "end"
    )


def update_ledger(
    docs: DataFrame, ledger: str | None = None, rule_version: int = RULE_VERSION
) -> str:
    """Scan the contents of ``docs`` that the ledger has not seen under these rules.

    The ledger is a folder of Parquet files with (blob, rule_version, kind, start, end);
    a blob is the SHA-256 of a text. Copies and versions scanned earlier cost a lookup.
    A new folder in the shared work folder serves where none is given; a named folder
    that isn't there yet is made. Returns the path.
    """
    spark = docs.sparkSession
    path = ledger or new_path(spark, "secrets")
    system, folder = files_of(spark, path)
    blobs = texts(docs).select(F.unhex(F.sha2("text", 256)).alias("blob"), "text")
    if ledger is not None and system.exists(folder):
        seen = spark.read.schema(LEDGER).parquet(path).where(F.col("rule_version") == rule_version)
        known = seen.where("kind IS NULL").select("blob")
        blobs = blobs.join(known, "blob", "left_anti")
    unseen = blobs.dropDuplicates(["blob"])
    found = scan(unseen).withColumn("rule_version", F.lit(rule_version))
    found.select("blob", "rule_version", "kind", "start", "end").write.mode("append").parquet(path)
    return path


LEDGER = "blob binary, rule_version int, kind string, start bigint, end bigint"


def secret_spans(
    docs: DataFrame, ledger: str | None = None, rule_version: int = RULE_VERSION
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row.

    Every path is joined to the findings of its content. Null texts are empty and hold
    nothing; repeated rows get a row each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    path = update_ledger(docs, ledger, rule_version)
    known = spark.read.schema(LEDGER).parquet(path)
    known = known.where((F.col("rule_version") == rule_version) & F.col("kind").isNotNull())
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    # a text holds only as many spans as find room in it
    listed = F.array_sort(F.collect_set(F.struct("start", rank.alias("rank"), "kind", "end")))
    found = known.groupBy("blob").agg(listed.alias("found"))
    paths = texts(docs).select("doc_id", F.unhex(F.sha2("text", 256)).alias("blob"))

    def shown(spans: Column) -> Column:
        one = F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["end"].cast("string")
            ),
        )
        return F.coalesce(F.array_join(one, ","), F.lit(""))

    def count(kind: str) -> Column:
        found = F.size(F.filter("found", lambda s: s["kind"] == kind))
        return F.coalesce(F.when(F.col("found").isNotNull(), found), F.lit(0)).cast("bigint")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return paths.join(found, "blob", "left").select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in BASE],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("found")).alias("spans"),
    )
