"""Where intermediate rows are kept."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of the session for intermediate data.

    It is the one in ``spark.checkpoint.dir``. Where nothing is set, a session on one machine gets a temporary folder; on
    a cluster that is an error, since executors couldn't read such a folder.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if at:
        return at
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can read")
    return _folders.setdefault("", tempfile.mkdtemp(prefix="filelens-"))


def own_folder(spark: SparkSession) -> str:
    """A folder of this application below the shared one, removed when Python ends."""
    application = spark.sparkContext.applicationId
    if application not in _folders:
        _folders[application] = f"{shared_folder(spark)}/settled-{application}"
        atexit.register(_remove, spark, _folders[application])
    return _folders[application]


def _remove(spark: SparkSession, at: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session has ended already
        pass


def settled(rows: DataFrame) -> DataFrame:
    """``rows`` written to a table in the shared folder and read from there: no lineage, and a lost executor loses none of them.

    A table rather than a checkpoint: it is compressed, each use reads its own columns, and the planner knows its size. A
    checkpoint keeps the estimate of the plan it came from, which joins of joins multiply to numbers of many megabytes.
    """
    at = f"{own_folder(rows.sparkSession)}/{uuid.uuid4().hex}"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def write_entries(entries: DataFrame, path: str, mode: str = "error") -> None:
    """Stores entries as Parquet sorted by path, so files hold ranges of paths and their statistics prune scans."""
    entries.sort("path_fold", "name_fold", "name", "id").write.mode(mode).parquet(path)
