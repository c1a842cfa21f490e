"""Session helpers shared by the text operators: tables cut from their lineage, and joins whose small side is measured."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 24 << 20

_folders: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """A folder for this application below ``spark.checkpoint.dir``; a local one only where that is unset and all runs in one process (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = shared or "file://" + tempfile.mkdtemp(prefix="hslake-")
        _folders[app] = f"{base.rstrip('/')}/hslake-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _remove(spark: SparkSession, folder: str) -> None:
    if spark.sparkContext._jsc is None:
        return
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unused(name: str, taken: list[str]) -> str:
    """A column name that isn't taken; upper and lower case count as the same."""
    low = {c.lower() for c in taken}
    while name in low:
        name += "_"
    return name


def measured(df: DataFrame) -> tuple[int, int]:
    """Rows of ``df`` and the bytes they take at most: 16 a fixed field, strings, binaries and arrays by length."""
    size = F.lit(16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(name), F.lit(0))
        elif kind.startswith("array"):
            size = size + 16 * F.coalesce(F.size(name), F.lit(0))
    row = df.agg(F.count("*").alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return row.n, row.b or 0


def join_measured(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", bound: int = BROADCAST_BYTES) -> DataFrame:
    """Join with ``right`` (a cut table) broadcast if its measured bytes are within ``bound``, else shuffled."""
    return left.join(F.broadcast(right) if measured(right)[1] <= bound else right, on, how)


def buckets_for(n_bytes: int, each: int = 12 << 20, least: int = 8) -> int:
    """How many hash buckets keep each at about ``each`` bytes; grows with the data."""
    return max(least, -(-n_bytes // each))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(column).cast("long"))).first()[0] or 0


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the undirected graph ``edges`` (a, b): every node with the least node that it reaches.

    Alternates large-star and small-star rounds; each is a linear shuffle, and a hub's edges are only grouped by partial minimum.
    Every half round is written, so that no plan holds more than one. Edges lead from the greater node a to the lesser b all through.
    Nodes without an edge don't appear. An empty graph gives no rows.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = _sign(now)
    while before[0]:
        now = cut(_small_star(cut(_large_star(now), "stars")), "edges")
        sign = _sign(now)
        if sign == before:
            break
        before = sign
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """The greater neighbours of every node hang on the least node around it."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), "b"), F.struct(F.col("b").alias("u"), "b"))).alias("e"))
    least = ends.groupBy(F.col("e.u").alias("b")).agg(F.min("e.b").alias("m"))
    return edges.join(least, "b").select("a", F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its lesser neighbours hang on the least of them."""
    linked = edges.join(edges.groupBy("a").agg(F.min("b").alias("m")), "a")
    return linked.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _sign(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
