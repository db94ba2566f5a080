"""Session helpers shared by all parts of the library."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BATCH_ROWS = 2000
#: Open scopes, innermost last: the tables written in each.
_scopes: list[list[DataFrame]] = []


def attach(spark: SparkSession) -> None:
    """Let Python workers import this package even if only the driver's sys.path has it, and give
    them fewer rows at a time than Spark's default, unless another number is set: texts are long, and
    a batch is held by both sides at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); a temporary one in local mode where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lineage ends here. The table
    belongs to the innermost scope."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quern/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def drop_table(df: DataFrame) -> None:
    """Delete what ``table`` wrote, once nothing reads it any more."""
    path = getattr(df, "_quern_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        df._quern_path = None
    for s in _scopes:
        s[:] = [x for x in s if x is not df]


def free_shuffles(spark: SparkSession) -> None:
    """Shuffle files go once the driver's objects for them do; waiting for its heap to fill keeps
    files of finished jobs on the executors' disks."""
    gc.collect()
    spark._jvm.System.gc()


class scope:
    """``with scope(spark) as s``: tables written inside are deleted at the end, but for those given
    to ``s.keep``, which the next outer scope owns. Keep what a lazy result still reads."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> scope:
        self.kept: list[DataFrame] = []
        _scopes.append([])
        return self

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df)
        return df

    def __exit__(self, *_: object) -> None:
        mine = _scopes.pop()
        for df in mine:
            if not any(df is k for k in self.kept):
                drop_table(df)
            elif _scopes:
                _scopes[-1].append(df)
        if mine:
            free_shuffles(self.spark)


def scoped(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions of a DataFrame whose result is one table that they wrote last, or reads none
    of their tables: all others go when they return."""

    @wraps(f)
    def run(df: DataFrame, *args: Any, **more: Any) -> DataFrame:
        with scope(df.sparkSession) as s:
            return s.keep(f(df, *args, **more))

    return run


def is_scan(df: DataFrame) -> bool:
    """Whether ``df`` only selects, renames, computes and filters rows of files, always alike."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    return plan.nodeName() == "LogicalRelation"


def numbered(df: DataFrame, name: str) -> DataFrame:
    """(_file, _row, row): rows as structs with an identity that any later scan finds again. Rows of
    files have the file and their place in it; other rows are written first."""
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")
    if is_scan(df):
        return df.select(F.xxhash64("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"), row)
    return table(df.select(F.lit(0).cast("long").alias("_file"), F.monotonically_increasing_id().alias("_row"), row), name, compression="zstd")
