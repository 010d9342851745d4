"""Session helpers: builder defaults, shared checkpoint folder, materialised stages."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", app: str = "duskveil", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    Reads ``spark.checkpoint.dir`` from the session; only where it is unset and all runs in one
    process (tests, a laptop) a temporary folder is created and set as checkpoint folder. On a cluster
    without one this is an error: what executors write to their own disks would be lost.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="duskveil-"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder (survives the loss of executors)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Stage:
    """A DataFrame written as a table below the shared folder and read back.

    ``drop()`` removes the files; loops call it for rounds nobody reads any more. What is left goes
    when the driver ends.
    """

    def __init__(self, df: DataFrame, name: str) -> None:
        self.spark = df.sparkSession
        self.path = os.path.join(shared_dir(self.spark), f"duskveil-{name}-{uuid.uuid4().hex}")
        schema = df.schema
        df.write.parquet(self.path)
        self._files().deleteOnExit(self._path())
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def _path(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path)

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def drop(self) -> None:
        self._files().delete(self._path(), True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers of all executors, once a session.

    The zipped package lies in the shared folder, so nothing need be installed on the executors.
    """
    context = spark.sparkContext
    if getattr(context, "_duskveil_shipped", False):
        return
    import io
    import zipfile

    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(root)):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    place = os.path.join(shared_dir(spark), f"duskveil-{uuid.uuid4().hex}.zip")
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(path)
    out.write(packed.getvalue())
    out.close()
    files.deleteOnExit(path)
    context.addPyFile(place)
    context._duskveil_shipped = True
