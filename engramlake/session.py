"""Sessions, and the folder that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "engramlake") -> SparkSession:
    """A single-machine session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, as a URI or path.

    Where the session names none, a temporary folder is made and set if all runs on one machine (tests); a cluster's
    executors couldn't read it.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None) or getattr(spark, "_engramlake_dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="engramlake-")
        spark._engramlake_dir = found
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused folder below the shared one; it is not made yet."""
    return f"{shared_dir(spark)}/engramlake/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and any executor can read every part."""
    path = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._engramlake_path = path
    return out


def release(*staged: DataFrame) -> None:
    """Delete tables that stage() has written, once what was made of them is written itself."""
    for df in staged:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._engramlake_path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def file_name_of(path, root: str):
    """A file's path below root, of a column with its URI."""
    from pyspark.sql import functions as F

    base = root.removeprefix("file://").rstrip("/")
    return F.regexp_replace(F.url_decode(F.regexp_replace(path, "\\+", "%2B")), f"^(?:[a-z0-9]+:(?://[^/]*)?)?/*{base}/", "")
