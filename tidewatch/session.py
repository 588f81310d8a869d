"""Spark session helpers.

On a cluster the session is created by the platform and ``get_spark`` returns it
as it is; operators do not rely on any of the defaults below.  ``checkpoint_dir`` reads ``spark.checkpoint.dir`` from
the session and only invents a local folder when the master is local (tests,
bench), never on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import weakref
from contextlib import contextmanager

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Source files are wide rows; keep Arrow batches to the Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "256",
}


def get_spark(app: str = "tidewatch", master: str | None = None, shuffle_partitions: int | None = None,
              driver_memory: str = "8g") -> SparkSession:
    """Return the active session, or build a local one for tests and benches."""
    active = SparkSession.getActiveSession()
    if active is not None:  # settings of a session that is already there are its owner's
        return active
    builder = SparkSession.builder.appName(app)
    master = master or os.environ.get("TIDEWATCH_MASTER")
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.driver.memory", driver_memory)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one.  Only a local
    master (tests) gets a fresh folder under /tmp.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        path = tempfile.mkdtemp(prefix="tidewatch-ckpt-", dir="/tmp")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def materialize(df, name: str, partition_by: str | None = None):
    """Cut lineage by writing ``df`` as a Parquet table under the shared
    checkpoint folder and reading it back (one job; a reliable RDD checkpoint
    would compute the plan twice).  Survives lost executors: the data lives in
    the shared folder, not in executor memory."""
    import uuid
    spark = df.sparkSession
    root = checkpoint_dir(spark).rstrip("/")
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    w = df.write.mode("error")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    _written(spark).append(path)
    return spark.read.parquet(path)


def materialize_parts(parts, name: str, partition_by: str):
    """``materialize`` for the union of ``parts``, frames of one schema: each is written by a job of its own into
    the same table, so no plan holds more than one of them.  A part may be a function that gives frames from the table as
    it is by then; they go into partitions that are not there yet or are read no more."""
    import uuid
    spark, schema = parts[0].sparkSession, parts[0].schema
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    for part in parts:
        for frame in part(spark.read.schema(schema).parquet(path)) if callable(part) else [part]:
            frame.write.mode("append").partitionBy(partition_by).parquet(path)
    _written(spark).append(path)
    return spark.read.schema(schema).parquet(path)


class PartTable:
    """A table in the shared folder that grows part by part: ``add`` writes a frame and reads it back, ``all`` reads
    every part so far in one scan, so the plans of a loop stay as large as those of its first round."""

    def __init__(self, spark: SparkSession, name: str):
        import uuid
        self.spark, self.parts, self.schema = spark, [], None
        self.path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
        _written(spark).append(self.path)

    def add(self, df):
        self.schema = df.schema
        self.parts.append(f"{self.path}/{len(self.parts)}")
        df.write.mode("error").parquet(self.parts[-1])
        return self._read(self.parts[-1])

    def all(self):
        return self._read(*self.parts)

    def _read(self, *paths: str):
        return self.spark.read.schema(self.schema).parquet(*paths)


# Tables written per context, in order.
_TABLES: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def _written(spark: SparkSession) -> list[str]:
    return _TABLES.setdefault(spark.sparkContext, [])


def delete_path(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store it lies."""
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hpath, True)


@contextmanager
def scratch(spark: SparkSession):
    """Deletes the intermediate tables that are written inside the block when it ends::

        with scratch(spark):
            scan_tree(spark, root).scan.findings.write.parquet(out)

    Frames made inside cannot be read afterwards."""
    tables = _written(spark)
    first = len(tables)
    try:
        yield
    finally:
        for path in tables[first:]:
            delete_path(spark, path)
        del tables[first:]


def spread(df):
    """Deal the rows of a text table over more tasks where the session asks for it
    with ``spark.tidewatch.spread`` (a number of partitions; unset: never).  The
    plan does not depend on the input's size: by default files are split by the
    scan's own settings and texts are not shuffled."""
    n = df.sparkSession.conf.get("spark.tidewatch.spread", None)
    return df.repartition(int(n)) if n else df


# Contexts that have the package already.
_SHIPPED: weakref.WeakSet = weakref.WeakSet()


def ship_package(spark: SparkSession) -> None:
    """Make ``tidewatch`` importable in the Python workers (the fact job, the
    limiter walk and the streaming state function run there).  On a cluster
    the package is zipped once per SparkContext and registered with
    ``addPyFile``, which distributes it to every executor, as ``--py-files``
    would; a local master only needs the path."""
    import zipfile

    sc = spark.sparkContext
    if sc in _SHIPPED:
        return
    import tidewatch
    root = os.path.dirname(os.path.abspath(tidewatch.__file__))
    base = os.path.dirname(root)
    if sc.master.startswith("local"):
        # Executors share the driver's file system: put the package's parent on
        # the workers' PYTHONPATH (sent with every Python function) instead.
        current = sc.environment.get("PYTHONPATH", "")
        if base not in current.split(os.pathsep):
            sc.environment["PYTHONPATH"] = base + (os.pathsep + current if current else "")
        _SHIPPED.add(sc)
        return
    out_dir = tempfile.mkdtemp(prefix="tidewatch-pyfiles-")
    zpath = os.path.join(out_dir, "tidewatch.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(zpath)
    _SHIPPED.add(sc)
