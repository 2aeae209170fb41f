"""Written tables that cut a plan's lineage, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
#: On a local file system Hadoop starts a process for each file it makes beside a checksum file; these tables do without.
PLAIN = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, or one below the warehouse where it is unset on one machine."""
    out = spark.conf.get("spark.checkpoint.dir", None)
    if out:
        return out.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoint"


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written and read back, so that a lost executor costs no recomputation. Columns without a type become strings."""
    spark = df.sparkSession
    path = f"{root(spark)}/telescribe-{uuid.uuid4().hex}"
    df = df.withColumns({c: F.col(f"`{c}`").cast("string") for c, kind in df.dtypes if kind == "void"})
    df.write.options(**PLAIN).parquet(path)
    _written[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of checkpointed() at once. What was made from them must be written by then."""
    for df in tables:
        path = getattr(df, "_written", None)
        if path in _written:
            _delete(path, _written.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def discard_all() -> None:
    """Deletes what is left of this process; tables of a session that has ended stay to its cluster's cleaner."""
    for path, spark in list(_written.items()):
        _written.pop(path)
        if spark._jsc is not None and not spark._jsc.sc().isStopped():
            _delete(path, spark)
