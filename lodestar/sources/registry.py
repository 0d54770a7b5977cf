"""The tenanted chunk registry as a DataFrame: (chunk_index, tenant, text, created_at).

``write`` lays it out in folders by a hash of the tenant, as many however many tenants there are, and in order of tenants
in each. Read back by ``spark.read.parquet`` it has the column ``tenant_bucket``; scans of one tenant then read that tenant's
folder, and joins with the tenants of some requests read theirs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.plans.session import broadcast_if_small, discard, materialized

#: The folders' column, and how many there are. Both belong to the layout: tables that are stored have been written by them.
BUCKET, BUCKETS = "tenant_bucket", 256


def bucket(tenant: Column) -> Column:
    """The folder of a tenant's chunks."""
    return F.pmod(F.xxhash64(tenant), F.lit(BUCKETS)).cast("int")


def all_chunks(registry: DataFrame) -> DataFrame:
    return registry.orderBy("chunk_index")


def by_tenant(registry: DataFrame, tenant: str) -> DataFrame:
    """One tenant's chunks; of a registry laid out by ``write`` only one folder is read."""
    return _of(registry, tenant).orderBy("chunk_index")


def _of(registry: DataFrame, tenant: str) -> DataFrame:
    rows = registry.where(F.col("tenant") == tenant)
    return rows.where(F.col(BUCKET) == bucket(F.lit(tenant))).drop(BUCKET) if BUCKET in registry.columns else rows


def of_tenants(registry: DataFrame, tenants: DataFrame) -> DataFrame:
    """The chunks of any of the tenants (tenant); of a registry laid out by ``write`` only their folders are read.

    Which these are is found at run time, where the tenants are few enough to be broadcast. Nulls are no tenant's.
    """
    # the comparison is true of every tenant: Spark prunes folders only by a side that has a filter
    wanted = tenants.select("tenant").where("tenant >= ''").distinct()
    if BUCKET not in registry.columns:
        return registry.join(broadcast_if_small(wanted), "tenant", "left_semi").select(*registry.columns)
    wanted = wanted.withColumn(BUCKET, bucket(F.col("tenant")))
    rows = registry.join(broadcast_if_small(wanted), [BUCKET, "tenant"], "left_semi")
    return rows.select(*(c for c in registry.columns if c != BUCKET))


def indices_of(registry: DataFrame, tenant: str) -> DataFrame:
    return by_tenant(registry, tenant).select("chunk_index")


def stats(registry: DataFrame) -> DataFrame:
    """(n_chunks, max_index); max_index is -1 for an empty registry."""
    return registry.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.max("chunk_index"), F.lit(-1)).cast("long").alias("max_index"))


def without_tenant(registry: DataFrame, tenant: str) -> DataFrame:
    """What remains after a tenant is deleted."""
    return registry.where(~(F.col("tenant") == tenant) | F.col("tenant").isNull())


def active_tenants(registry: DataFrame) -> DataFrame:
    return registry.agg(F.count_distinct("tenant").alias("active_tenants"))


def numbered(rows: DataFrame, key: str, ties: list[str], start: int, bucket_rows: int = 50_000) -> DataFrame:
    """``rows`` with a dense chunk_index from ``start``, in order of the key and then the ties.

    Rows are dealt into ranges of key and ties, sorted there and written once, each with its place; a small table of
    the ranges' sizes then gives each range its first number. A range is what one task sorts, texts included. No task sees all rows, and the driver none; equal keys
    are spread over ranges by their ties. ``rows`` is evaluated once, for the sizes must be those of the rows returned.
    """
    rows = materialized(rows, "unnumbered")
    buckets = max(1, -(-rows.count() // bucket_rows))
    ordered = rows.repartitionByRange(buckets, key, *ties).sortWithinPartitions(key, *ties)
    kept = materialized(ordered.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    discard(rows)
    # the upper bits of a place are the range, the lower 33 the row's number in it
    range_ = F.shiftrightunsigned("_place", 33)
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = kept.groupBy(range_.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    joined = kept.withColumn("_range", range_).join(broadcast_if_small(sizes), "_range")
    number = F.lit(start) + F.col("_before") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return joined.withColumn("chunk_index", number.cast("long")).drop("_place", "_range", "_before")


def append(registry: DataFrame, new: DataFrame, key: str, ties: list[str]) -> DataFrame:
    """The registry with new rows (tenant, text, created_at and the order's columns), numbered on from its highest index."""
    highest = stats(registry).first()["max_index"]
    return registry.unionByName(numbered(new, key, ties, highest + 1).select(*registry.columns))


def write(registry: DataFrame, path: str, append: bool = False) -> None:
    """Writes the registry in folders by tenant; a tenant with very many chunks is spread over several files."""
    order = (BUCKET, "tenant", "chunk_index")
    rows = registry.withColumn(BUCKET, bucket(F.col("tenant"))).repartitionByRange(*order).sortWithinPartitions(*order)
    rows.write.mode("append" if append else "error").partitionBy(BUCKET).parquet(path)
