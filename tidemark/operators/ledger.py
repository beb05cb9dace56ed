"""Evidence ledger: claims with grades and the assumptions they rest on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F


@dataclass(frozen=True)
class Entry:
    id: str
    grade: str  # E0 (checked) .. E4 (conjecture)
    depends: tuple[str, ...]
    value: str = ""
    status: str = "open"


#: Claims of this engine's own analyses; replace with a table of yours.
ENTRIES = (
    Entry("low-dimension", "E1", ("A1", "A2"), "few components carry most variance"),
    Entry("regimes", "E3", ("A1", "A3"), "months fall into discrete regimes"),
    Entry("lead-lag", "E2", ("A2",), "concentration leads volume"),
    Entry("drift", "E0", ("A4",), "daily means drift"),
    Entry("forecast", "E4", ("A1", "A2", "A3"), "next month can be told"),
)
SCHEMA = "id string, grade string, depends array<string>, value string, status string"


def entries(spark: SparkSession, rows: tuple[Entry, ...] = ENTRIES) -> DataFrame:
    return spark.createDataFrame([(e.id, e.grade, list(e.depends), e.value, e.status) for e in rows], SCHEMA)


GRADES = ("E0", "E1", "E2", "E3", "E4")


def checked(table: DataFrame) -> DataFrame:
    """A ledger from a table with at least id, grade and depends; other columns of the ledger are null where it has none. Unknown grades count as conjecture."""
    missing = {"id", "grade", "depends"} - set(table.columns)
    if missing:
        raise ValueError(f"a ledger needs {sorted(missing)}")
    grade = F.when(F.col("grade").isin(*GRADES), F.col("grade")).otherwise(F.lit(GRADES[-1]))
    rest = [(F.col(c) if c in table.columns else F.lit(None)).cast("string").alias(c) for c in ("value", "status")]
    return table.select(F.col("id").cast("string").alias("id"), grade.alias("grade"), F.coalesce("depends", F.array().cast("array<string>")).alias("depends"), *rest)


def by_grade(ledger: DataFrame) -> DataFrame:
    """(grade, n, free, mean): entries, those that rest on nothing, and the mean number of assumptions."""
    n = F.size("depends")
    return ledger.groupBy("grade").agg(F.count("*").alias("n"), F.count_if(n == 0).alias("free"), F.avg(n).alias("mean"))


def cascade(ledger: DataFrame, assumption: str) -> DataFrame:
    """Adds what becomes of each entry if the assumption falls."""
    rests = F.array_contains("depends", assumption)
    out = F.when(~rests, "clean").when(F.col("grade").isin("E3", "E4"), "invalidated").otherwise("survives, flagged")
    return ledger.withColumn("outcome", out)


def dependents(ledger: DataFrame) -> DataFrame:
    x = ledger.select("id", "grade", F.explode("depends").alias("assumption"))
    return x.groupBy("assumption").agg(F.count("*").alias("dependents"), F.count_if(F.col("grade").isin("E3", "E4")).alias("fragile"))


#: The operator registry: how each source is observed and in which frame.
OPERATORS = (("attention", "monthly volume", "relative"), ("headlines", "hourly ranks", "absolute"), ("narratives", "extracted text", "interpretive"))


def operator_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(OPERATORS), "source string, frame string, scale string")
