"""Session set-up, table access and lineage cutting shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: str = "8", app: str = "lodesieve", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use; on a cluster, pass your own session instead."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    base = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which all executors share.

    It is read from the session. Only where it is unset (tests, a laptop) a temporary one is made, and then only for a
    local master: on a cluster a machine-local folder could not be read by the others.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and not sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc._jsc.sc().getCheckpointDir().get()
    if named is None:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), f"lodesieve-{os.getpid()}")
    return f"{named.rstrip('/')}/lodesieve-{sc.applicationId}"


_CUT: dict[str, list[str]] = {}  # tables written by ``cut``, by application


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared folder: columnar and compressed, it survives lost executors, and
    what was computed with chance (task numbers, say) is fixed by it. ``discard`` deletes one, ``release`` all of them once
    the results are written; what is left goes when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _CUT:
        _CUT[app] = []
        atexit.register(_remove_quietly, spark, shared_folder(spark))
    _CUT[app].append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path  # type: ignore[attr-defined]
    return out


def spread(df: DataFrame, rows: int, rows_per_task: int = 4_000) -> DataFrame:
    """df in as many partitions as its ``rows`` are worth when each costs much CPU time and few bytes: partitions sized by
    bytes would put thousands of such rows into one task. At most 64 tasks per core."""
    n = -(-rows // rows_per_task)
    return df.repartition(max(1, min(n, 64 * df.sparkSession.sparkContext.defaultParallelism)))


def _remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # noqa: BLE001, S110 - the session has ended; the folder is the application's own
        pass


def discard(df: DataFrame) -> None:
    """Delete the table of a ``cut`` that nothing will read again."""
    path = getattr(df, "_cut_path", None)
    if path is not None:
        _CUT[df.sparkSession.sparkContext.applicationId].remove(path)
        _remove(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Delete all tables of ``cut``: call it when the results that depend on them are written."""
    for path in _CUT.get(spark.sparkContext.applicationId, []):
        _remove(spark, path)
    _CUT.pop(spark.sparkContext.applicationId, None)


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per context, so that they needn't have it installed or on their path."""
    sc = spark.sparkContext
    if getattr(sc, "_lodesieve_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="lodesieve-"), "lodesieve.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    sc.addPyFile(path)
    sc._lodesieve_shipped = True
