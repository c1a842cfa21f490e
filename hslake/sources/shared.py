"""Tables kept in the folder that all executors share: written aside, complete before they appear, and found again by the stamp of what they came from."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder for this application below ``spark.checkpoint.dir``; a local one only where that is unset and all runs in one process (tests)."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        _folders[app] = f"{(shared or 'file://' + tempfile.mkdtemp(prefix='hslake-')).rstrip('/')}/journal-{app}-{uuid.uuid4().hex[:8]}"
        atexit.register(_remove, spark, _folders[app])
    return _folders[app]


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _remove(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None:
        path, fs = _path(spark, name)
        fs.delete(path, True)


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = _path(spark, name)
    return fs.exists(path)


def read_text(spark: SparkSession, name: str) -> str | None:
    """The text of a small file, or None."""
    path, fs = _path(spark, name)
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """Replaces a small file as a whole: a reader sees the old text or the new one. One writer at a time."""
    beside = f"{name}.{uuid.uuid4().hex}"
    path, fs = _path(spark, beside)
    stream = fs.create(path, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(path, jvm.org.apache.hadoop.fs.Path(name), options)


#: With it, Spark drops a job's shuffle files as soon as the job ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _write(df: DataFrame, name: str) -> None:
    """Parquet, packed closely, whose job leaves no shuffle files; the session's own setting for other jobs stays."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(name)
    finally:
        conf.set(CLEANUP, before)


def publish(df: DataFrame, name: str, *, sources: tuple[str, ...] = (), write: Callable[[DataFrame, str], None] | None = None, replace: bool = False) -> str:
    """Writes ``df`` beside ``name`` and renames it once it is complete: a write that dies leaves nothing under ``name``.

    A path that is one of ``sources``, lies under one or holds one is refused, and an existing one unless ``replace``: then the old table goes aside first and comes back if
    the rename fails. ``write`` writes another format than Parquet.
    """
    spark = df.sparkSession
    path, fs = _path(spark, name)
    whole = fs.makeQualified(path).toString().rstrip("/") + "/"
    for s in sources:
        other = _path(spark, s)
        kept = other[1].makeQualified(other[0]).toString().rstrip("/") + "/"
        if whole.startswith(kept) or kept.startswith(whole):
            raise ValueError(f"{name} would overwrite its source {s}")
    if fs.exists(path) and not replace:
        raise ValueError(f"{name} exists")
    parent = path.getParent()
    aside = f"{parent.toString()}/.{path.getName()}-{uuid.uuid4().hex}"
    try:
        (write or _write)(df, aside)
    except BaseException:
        fs.delete(_path(spark, aside)[0], True)
        raise
    old = None
    if fs.exists(path):
        old = _path(spark, f"{aside}-old")[0]
        if not fs.rename(path, old):
            raise OSError(f"{name} can't be moved aside")
    if not fs.rename(_path(spark, aside)[0], path):
        if old is not None:
            fs.rename(old, path)
        raise OSError(f"{name} can't be renamed into place")
    if old is not None:
        fs.delete(old, True)
    return name


def stamp(spark: SparkSession, names: list[str]) -> str:
    """Digest of the files below ``names``: their paths, sizes and times. Equal stamps mean unchanged inputs; nothing is read."""
    found = []
    for name in names:
        path, fs = _path(spark, name)
        if fs.getFileStatus(path).isDirectory():
            files = fs.listFiles(path, True)
            while files.hasNext():
                f = files.next()
                found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        else:
            f = fs.getFileStatus(path)
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:32]


def kept(spark: SparkSession, folder: str, name: str, mark: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``name`` as built when its inputs bore ``mark``; built and published only if there is none, so an unchanged stamp starts no job."""
    path = f"{folder}/{name}/{mark}"
    if not exists(spark, f"{path}/_SUCCESS"):
        publish(build(), path, replace=True)
    return spark.read.parquet(path)


def refreshed(old: DataFrame, rows: DataFrame, key: list[str], since: int, aggregate: Callable[[DataFrame], DataFrame], revision: str = "change_revision") -> DataFrame:
    """``old``, the aggregate of ``rows`` by ``key`` as of revision ``since``, brought up to date: cohorts with a newer row are aggregated anew, the others kept as they are.

    A cohort counts as changed by its newer rows only, so rows that are removed need a newer one of their cohort. Nulls in the key are cohorts like others.
    """
    changed = stored(rows.where(F.col(revision) > since).select(*[F.col(k).alias(f"_{k}") for k in key]).distinct(), "changed")
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key])
    fresh = aggregate(rows.join(changed, same, "left_semi"))
    return old.join(changed, same, "left_anti").unionByName(fresh)


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """``df`` written once in the shared folder: its lineage ends there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``stored`` that nothing reads any more, before the application ends."""
    for df in tables:
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            _remove(df.sparkSession, name)
