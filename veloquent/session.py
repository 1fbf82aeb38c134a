"""Session, the folder all executors share, and tables staged there."""

from __future__ import annotations

import atexit
import contextlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def get_spark(cpus: int | str = "*", app: str = "veloquent", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder takes its place in local mode (one machine, so
    everything can read it); on a cluster a missing setting is an error, since a folder of one
    machine would be lost with it.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = "file://" + tempfile.mkdtemp(prefix="veloquent-")
        sc.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
        atexit.register(_remove_local, d[7:])
    return d.rstrip("/")


def _remove_local(d: str) -> None:
    import shutil

    if os.path.isfile(d):
        os.unlink(d)
    shutil.rmtree(d, ignore_errors=True)


_OPEN: list[list[str]] = []  # paths made inside each open ``staging`` block, innermost last


def new_path(spark: SparkSession, tag: str, lasting: bool = False) -> str:
    """A path in the shared folder that nothing has used, removed when its ``staging`` block or the driver ends.

    A ``lasting`` one stays to the driver's end: files that executors fetch when they start, whenever that is.
    """
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    if _OPEN and not lasting:
        _OPEN[-1].append(path)
    atexit.register(delete_path, spark, path)
    return path


@contextlib.contextmanager
def staging(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside the block are removed at its end, for drivers that live long.

    A query's result is read from them, so it has to be used (written, collected) inside the block.
    """
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path of the shared folder; a session that is gone already leaves it to the cluster."""
    try:
        if path.startswith("file:"):
            _remove_local(os.path.normpath(path.split(":", 1)[1].replace("//", "/")))
            return
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the JVM may have ended before this hook
        pass


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder of the shared file system; none if there is no such folder."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename a file, over the new name if that exists."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(old), jvm.org.apache.hadoop.fs.Path(new)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    fs.delete(b, False)
    if not fs.rename(a, b):
        raise OSError(f"cannot move {old} to {new}")


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file of the shared file system: written beside its name, then renamed, so it is there whole or not at all."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path + ".new")
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(data)
    finally:
        out.close()
    move(spark, path + ".new", path)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def staged(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written to the shared folder and read back: it survives lost executors and cuts lineage."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    w = df.write
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unstage(spark: SparkSession, df: DataFrame) -> None:
    """Remove what ``staged`` wrote, once nothing reads it any more."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete_path(spark, path)


def add_file(spark: SparkSession, name: str, data: bytes, python: bool = False) -> str:
    """Give a file to all executors, also to those that start later: it lies in the shared folder. Its name there."""
    path = f"{new_path(spark, 'files', lasting=True)}/{name}"
    write_bytes(spark, path, data)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    whole = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()  # with its scheme
    (spark.sparkContext.addPyFile if python else spark.sparkContext.addFile)(whole)
    return name


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that their Python workers can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root, out = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in sorted(os.walk(root)):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("veloquent", os.path.relpath(full, root)))
    add_file(spark, f"veloquent-{uuid.uuid4().hex[:8]}.zip", out.getvalue(), python=True)
