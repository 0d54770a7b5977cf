"""Telemetry: cumulative histograms, counters, and their text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of latency buckets, in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def histogram(rows: DataFrame, labels: list[str], value: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(labels, le, n): how many values are at most each bound, and under ``+Inf`` all; one pass over the rows."""
    counts = [F.count_if(F.col(value) <= b).alias(f"_{i}") for i, b in enumerate(buckets)]
    wide = rows.where(F.col(value).isNotNull()).groupBy(*labels).agg(*counts, F.count(F.lit(1)).alias("_all"))
    pairs = [F.struct(F.lit(str(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(buckets)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("_all").alias("n")))
    return wide.select(*labels, F.explode(F.array(*pairs)).alias("x")).select(*labels, "x.le", "x.n")


def counter(rows: DataFrame, labels: list[str], value: str) -> DataFrame:
    """(labels, n, total)"""
    return rows.groupBy(*labels).agg(F.count(value).alias("n"), F.round(F.coalesce(F.sum(value), F.lit(0.0)), 4).alias("total"))


def _labels(labels: list[str]) -> Column:
    """``a="x",b="y"`` with quotes, backslashes and newlines escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat_ws(",", *(F.concat(F.lit(f'{x}="'), escape(F.coalesce(F.col(x).cast("string"), F.lit(""))), F.lit('"')) for x in labels))


def exposition(name: str, rows: DataFrame, labels: list[str], value: str, help_: str, buckets: tuple[float, ...] = BUCKETS) -> DataFrame:
    """(part, line): a histogram of ``value`` in the text format that scrapers read; ``part`` orders the lines."""
    both = rows.where(F.col(value).isNotNull()).withColumn("_labels", _labels(labels))
    counts = histogram(both, ["_labels"], value, buckets).withColumn("_order", F.when(F.col("le") == "+Inf", F.lit(float("inf"))).otherwise(F.try_to_number("le", F.lit("999999.999999")).cast("double")))
    le = F.concat(F.lit('le="'), F.col("le"), F.lit('"'))
    line = F.concat(F.lit(f"{name}_bucket{{"), F.concat_ws(",", F.nullif(F.col("_labels"), F.lit("")), le), F.lit("} "), F.col("n").cast("string"))
    lines = counts.select(F.struct(F.lit(1).alias("kind"), F.col("_labels").alias("labels"), F.col("_order").alias("le")).alias("part"), line.alias("line"))
    brace = F.when(F.col("_labels") != "", F.concat(F.lit("{"), F.col("_labels"), F.lit("}"))).otherwise(F.lit(""))
    sums = both.groupBy("_labels").agg(F.round(F.sum(value), 6).alias("s"), F.count(value).alias("c"))
    for i, (what, shown) in enumerate((("sum", F.col("s").cast("decimal(38,6)").cast("string")), ("count", F.col("c").cast("string"))), 2):
        part = F.struct(F.lit(i).alias("kind"), F.col("_labels").alias("labels"), F.lit(0.0).alias("le"))
        lines = lines.unionByName(sums.select(part.alias("part"), F.concat(F.lit(f"{name}_{what}"), brace, F.lit(" "), shown).alias("line")))
    heads = [(f"# HELP {name} {help_}", 0.0), (f"# TYPE {name} histogram", 1.0)]
    head = rows.sparkSession.createDataFrame(heads, "line string, n double")
    head = head.select(F.struct(F.lit(0).alias("kind"), F.lit("").alias("labels"), F.col("n").alias("le")).alias("part"), "line")
    return lines.unionByName(head)
