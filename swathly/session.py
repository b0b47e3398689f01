"""Session defaults, the folder that executors share, and tables written to it."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def build(app: str = "swathly", **extra: str) -> SparkSession:
    """A session with adaptive execution, UTC and filter pushdown into Python sources; ``extra`` overrides (underscores for dots)."""
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in extra.items()}
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a temporary folder of this machine serves a local master, as in tests;
    any other master is refused, since its executors could not see that folder.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {sc.master} share")
        found = "file://" + tempfile.mkdtemp(prefix="swathly-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of written tables that were not discarded yet, in this process.
_MADE: set[str] = set()


def materialize(df: DataFrame, tag: str = "table", compression: str | None = None) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. Survives lost executors, unlike cached blocks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/swathly-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    _MADE.add(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    name = folder.rsplit("/", 1)[-1]
    _MADE.difference_update([p for p in _MADE if p.endswith(name)])


def discard(*dfs: DataFrame) -> None:
    """Delete tables of ``materialize`` that nothing reads any more, once what was made from them is written."""
    for df in dfs:
        for f in df.inputFiles()[:1]:
            folder = f.rsplit("/", 1)[0]
            if "/swathly-" in folder:
                _delete(df.sparkSession, folder)


def sweep(spark: SparkSession) -> int:
    """Delete all written tables of this process, once no result that reads them is needed any more; how many there were."""
    left = list(_MADE)
    for folder in left:
        _delete(spark, folder)
    return len(left)
