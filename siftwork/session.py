"""Session settings, shared scratch storage, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Settings that suit any size, for what is not set otherwise.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Settings of a session in one process of this machine.
LOCAL = {"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}

#: Whether shuffle files go when their query ends, not when the driver collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_shipped: set[str] = set()


def get_spark(master: str | None = "local[8]", **conf: str) -> SparkSession:
    """A session for tests, the bench and scripts; without a master, the cluster's, whose settings win over DEFAULTS."""
    builder = SparkSession.builder.appName("siftwork")
    if master is not None:
        builder = builder.master(master)
    local = LOCAL if master is not None and master.startswith("local") else {}
    for k, v in (local | conf).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    given = spark.sparkContext.getConf()
    for k, v in DEFAULTS.items():
        if not given.contains(k):
            spark.conf.set(k, v)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that Python workers can import it."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="siftwork-")), "siftwork.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(d, n)
                    z.write(full, os.path.join("siftwork", os.path.relpath(full, top)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    atexit.register(shutil.rmtree, os.path.dirname(path), True)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset and all runs in one process, as in tests, a temporary one."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(sc, "_siftwork_shared", None)
    if own is None:
        own = tempfile.mkdtemp(prefix="siftwork-shared-")
        sc._siftwork_shared = own
        sc.setCheckpointDir("file://" + own)
        atexit.register(shutil.rmtree, own, True)
    return "file://" + own


class Scratch:
    """Tables written to the shared folder to cut lineage; each write has a folder of its own.

    A lost executor costs nothing of what is written here. Tables that a returned DataFrame reads
    stay until the driver process ends; others go with drop().
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/siftwork/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        atexit.register(self._remove, self.root)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        # What is written needs its shuffles no more; a later use of the same plan would run them again.
        old = self.spark.conf.get(CLEANUP, None)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.unset(CLEANUP) if old is None else self.spark.conf.set(CLEANUP, old)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._siftwork_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            if path := getattr(t, "_siftwork_path", None):
                self._remove(path)

    def _remove(self, path: str) -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before
            if path.startswith("file://"):
                shutil.rmtree(path[7:], ignore_errors=True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, whole."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
