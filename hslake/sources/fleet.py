"""A journal's tables in a server's schema: read by ranges of a key over several connections, and merged so that a repeated write changes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hslake.sources.shared import stored


def quoted(spark: SparkSession, options: dict[str, str], name: str) -> str:
    """A column's name as the server's dialect quotes it; names keep their case, as Spark's writer gives them."""
    return spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier(name)


def load_fleet(spark: SparkSession, table: str, options: dict[str, str], *, key: str = "id", parts: int = 8) -> DataFrame:
    """``table`` read in ``parts`` ranges of an integer ``key``; the bounds come from one small query, and filters and columns go to the server."""
    def read():
        return spark.read.format("jdbc").options(**options)

    name = quoted(spark, options, key)
    low, high = read().option("dbtable", f"(select min({name}) as lo, max({name}) as hi from {table}) b").load().first()
    if low is None:
        return read().option("dbtable", table).load()
    return read().options(dbtable=table, partitionColumn=key, lowerBound=str(int(low)), upperBound=str(int(high) + 1), numPartitions=str(parts)).load()


def merge_fleet(rows: DataFrame, table: str, options: dict[str, str], *, key: list[str], revision: str = "change_revision", parts: int = 8) -> int:
    """Adds to ``table`` the rows whose key it lacks or has in an older revision, older ones staying beside them; returns how many were added.

    A server's rows are only compared by key and newest revision, read in ranges. Readers take the newest of each key (``newest``). Written once more, nothing is added.
    """
    spark = rows.sparkSession
    names = ", ".join(quoted(spark, options, k) for k in key)
    read = spark.read.format("jdbc").options(**options).option("dbtable", f"(select {names}, max({quoted(spark, options, revision)}) as held from {table} group by {names}) k").load()
    held = read.toDF(*key, "held")
    fresh = rows.join(held, key, "left").where(F.col("held").isNull() | (F.col(revision) > F.col("held"))).select(rows.columns)
    fresh = stored(fresh, "fleet")
    n = fresh.count()
    if n:
        fresh.coalesce(parts).write.format("jdbc").options(**options).option("dbtable", table).mode("append").save()
    return n


def newest(table: DataFrame, *, key: list[str], revision: str = "change_revision") -> DataFrame:
    """The newest row of each key."""
    rest = [c for c in table.columns if c not in key]
    return table.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(revision, *[c for c in rest if c != revision])).alias("r")).select(*key, "r.*")
