"""Session settings, scratch folders and size checks shared by the package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. All of them can be changed on a
# running session, so a session made elsewhere can be prepared too.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A split of a hot partition is worth an extra shuffle further down.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A long page or a deep offset is sorted by the cluster, not in one heap.
    "spark.sql.execution.topKSortFallbackThreshold": "100000",
    # JSON objects with a repeated key keep the last value, as JSON decoders do.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # A JSON record that does not fit the schema is broken as a whole.
    "spark.sql.json.enablePartialResults": "false",
}


def prepare(spark: SparkSession) -> SparkSession:
    """Put the runtime settings the operators rely on into a session."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "tidewell", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the package's settings. Extra settings win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the cluster's checkpoint folder, removed at exit.

    The base is `spark.checkpoint.dir`, which every executor can reach. Only a
    local session without that setting (a test) falls back to a local folder; on a
    cluster that is an error.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tidewell-")
    path = f"{base.rstrip('/')}/tidewell/{label}-{uuid.uuid4().hex}"
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(context._jsc.hadoopConfiguration())
    # With its file system: other readers take a bare path as one on their own machine.
    qualified = file_system.makeQualified(hadoop_path)
    file_system.mkdirs(qualified)
    file_system.deleteOnExit(qualified)
    path = qualified.toString()
    return f"file://{path.removeprefix('file:')}" if path.startswith("file:/") and not path.startswith("file:///") else path


def is_single_file(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(context._jsc.hadoopConfiguration())
    return file_system.exists(hadoop_path) and file_system.getFileStatus(hadoop_path).isFile()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it is not there."""
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(context._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in file_system.listStatus(hadoop_path)] if file_system.exists(hadoop_path) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that the package wrote."""
    context = spark.sparkContext
    hadoop_path = context._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate for a plan. Reads nothing."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark itself would broadcast this side."""
    raw = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760b")
    limit = _bytes(raw)
    return limit > 0 and estimated_bytes(df) <= limit


def _bytes(text: str) -> int:
    text = text.strip().lower()
    for suffix, scale in (("kb", 1 << 10), ("mb", 1 << 20), ("gb", 1 << 30), ("k", 1 << 10), ("m", 1 << 20), ("g", 1 << 30), ("b", 1)):
        if text.endswith(suffix):
            return int(float(text[: -len(suffix)]) * scale)
    return int(text)
