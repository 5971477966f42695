"""Session settings and the shared scratch folder."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(app: str = "aerolith", cpus: int | None = None, **settings: str) -> SparkSession:
    """A session with this package's settings.

    ``cpus`` asks for a local session and sizes its shuffles to the cores.  On a
    cluster leave it out: master, memory and shuffle partitions come from
    spark-submit, and AQE coalesces what is too fine.
    """
    builder = SparkSession.builder.appName(app)
    for name, value in _SETTINGS.items():
        builder = builder.config(name, value)
    if cpus:
        builder = (
            builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", str(cpus))
            .config("spark.ui.enabled", "false")
        )
    for name, value in settings.items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Gives this package to the Python workers, which need not have it on their path."""
    name = __package__ or "aerolith"
    if not any(path.rsplit("/", 1)[-1] == f"{name}.zip" for path in spark.sparkContext.listFiles):
        folder = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='aerolith-')}/{name}", "zip", os.path.dirname(folder), name)
        spark.sparkContext.addPyFile(archive)


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as the session names it.

    A session without ``spark.checkpoint.dir`` is a test session on one machine;
    only there a folder of our own is made and set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="aerolith-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared root, removed when the session's JVM ends."""
    path = f"{shared_root(spark)}/aerolith/{label}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop_path)
    fs.deleteOnExit(hadoop_path)
    return path


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under ``path``; empty when it does not exist."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop_path):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hadoop_path))


def is_directory(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(hadoop_path) and fs.getFileStatus(hadoop_path).isDirectory()


def remove_dir(spark: SparkSession, path: str) -> None:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).open(hadoop_path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str, replace: bool = False) -> bool:
    """Puts a small file in place whole, by renaming; false if it is there already."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not replace:
        return False
    stream = fs.create(draft, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if replace:
        fs.delete(target, False)
    return fs.rename(draft, target)
