"""Intermediate tables.

Spans and registry keys are used several times; writing them once keeps the texts from being read again, cuts the
lineage and survives the loss of executors.  They go to the shared folder the session names in
`spark.checkpoint.dir`; on a local master a temporary folder is used where that is unset, elsewhere that is an error.
"""
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FOLDER = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get(_FOLDER, None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError(f"set {_FOLDER} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="citegrove-")
        spark.conf.set(_FOLDER, folder)
    return folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows of `df`, computed once and read back from a table of the shared folder."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_once: dict = {}


def once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A table derived from the input, written the first time a session asks for it and shared by its queries."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _once:
        path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        build().write.parquet(path)
        _once[key] = path
    return spark.read.parquet(_once[key])
