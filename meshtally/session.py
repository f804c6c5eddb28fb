"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE picks join strategies from measured sizes and splits skewed join
# partitions at run time; the operators rely on both.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # The JIT skips methods above 8,000 bytes of code. Stages that parse many
    # fields reach that; above it Spark then compiles expression by expression.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}
# The ones above that also fit a session made elsewhere.
_RUNTIME = ("spark.sql.session.timeZone", "spark.sql.codegen.hugeMethodLimit")

_own_scratch: dict[str, str] = {}
_settled: dict[str, list[str]] = {}


def build_session(app: str = "meshtally", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for a session made elsewhere: zone-less timestamps are UTC, short methods."""
    for key in _RUNTIME:
        if spark.conf.get(key) != SETTINGS[key]:
            spark.conf.set(key, SETTINGS[key])
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; only in local mode, and where none is named, one that ends with the process."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own_scratch:
        _own_scratch[app] = tempfile.mkdtemp(prefix="meshtally-")
        atexit.register(shutil.rmtree, _own_scratch[app], ignore_errors=True)
    return _own_scratch[app]


def release(spark: SparkSession) -> None:
    """Remove the folders that ``settle`` wrote so far; results that still read them end with this."""
    jvm = spark.sparkContext._jvm
    for folder in _settled.pop(spark.sparkContext.applicationId, []):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage: later jobs, and tasks re-run after a lost executor, all
    see the same rows. The file sizes also let the planner decide on
    broadcasting from what was really written.
    """
    path = f"{scratch_dir(df.sparkSession)}/meshtally-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _settled.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
