"""Written intermediate tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from playstat.session import ensure_checkpoint_dir


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark) -> None:
    """Batches of 4 MB and 2,000 rows between Spark and Python, unless the session says
    otherwise: with whole texts, the default of 64 MB is held several times in an executor,
    and so are the 10,000 rows that wait for the answers of a function of their ids."""
    if spark.conf.get(_BATCH_BYTES, None) in ("67108864b", "67108864", "64m", "64MB"):
        spark.conf.set(_BATCH_BYTES, "4m")
    if spark.conf.get(_BATCH_ROWS, None) == "10000":
        spark.conf.set(_BATCH_ROWS, "2000")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and read it back.

    Cuts lineage: the files are on shared storage, so a lost executor costs at
    most the tasks that it was running."""
    spark = df.sparkSession
    small_batches(spark)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_path = path
    return written


def release(*tables: DataFrame) -> None:
    """Deletes tables of ``materialise`` whose readers have all been written themselves.

    What a result still reads stays until the checkpoint folder is cleaned."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t.written_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def unused(name: str, columns: list[str]) -> str:
    """``name``, lengthened until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
