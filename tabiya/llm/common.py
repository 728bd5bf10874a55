"""What the operators share: text conventions, and tables written to the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabiya.sources.shared import new_path

#: The six characters that separate words, as a regular-expression class body and as a plain string.
SPACE_CLASS = r"\x20\x09-\x0D"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(frame: DataFrame, label: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: it cuts the lineage, survives lost executors, and is
    computed once however often it is read."""
    spark = frame.sparkSession
    path = new_path(spark, label)
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else (lower() would change other letters too)."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text as an array; null gives an empty array. Blanks become one character first, as
    splitting on a single character avoids the regular-expression engine."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def let(value: Column, body) -> Column:
    """body(value) with the value computed once per row: a lambda variable holds it. Column references inside
    nested lambdas would be evaluated again for every element."""
    return F.transform(F.array(value), body)[0]
