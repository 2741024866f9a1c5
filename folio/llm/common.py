"""What the operators share: the shared folder, cut lineage, text columns, clashing names."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, with its file system. Where that is unset, a session of one machine (tests) gets a folder of its
    own, and a cluster an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if base:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(base)
        return _qualified(spark, base)
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        own = tempfile.mkdtemp(prefix="folio-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return _qualified(spark, sc.getCheckpointDir())


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme and host that Spark reads it by, so that Python files in the tasks go to the same place."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a table or folder made under new_path()."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again.

    Cuts the lineage for good (an executor's loss costs nothing before this point), and a join on it
    gets an exchange of its own, which adaptive execution can split if a key is hot.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the files of this job's exchanges go with it: nothing reads them again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.folio_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what written() made; no later job may read it."""
    for t in tables:
        drop_path(t.sparkSession, t.folio_path)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores in front until df has no such column (names are compared as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def plain(df: DataFrame, *used: str) -> tuple[DataFrame, list[str], Callable[[DataFrame], DataFrame]]:
    """df with other names for columns that Python functions over batches can't take (dots, backticks), the names of the used ones
    now, and a function that gives a result's columns their names back."""
    new: dict[str, str] = {}
    for c in df.columns:
        if "." in c or "`" in c:
            new[c] = free_name(df, f"column{len(new)}__")
    if not new:
        return df, list(used), lambda out: out
    back = {v: k for k, v in new.items()}
    return df.toDF(*(new.get(c, c) for c in df.columns)), [new.get(u, u) for u in used], lambda out: out.toDF(*(back.get(c, c) for c in out.columns))


def n_tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
