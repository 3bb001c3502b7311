"""Parquet table access, durable intermediates and their lifetime."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Table ``name`` of a directory of parquet tables (a file or a folder each)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share: the session's ``spark.checkpoint.dir``.

    Where that setting is absent, a single machine (a ``local`` master, as in tests) gets a
    temporary folder, once for each session; a cluster is refused, since its executors
    don't share one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.conf.get("papyrine.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="papyrine-")
        spark.conf.set("papyrine.shared.dir", found)
    return found.rstrip("/")


class Files:
    """The file system of a path, through the session."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.root = spark.sparkContext._jvm, path.rstrip("/")
        self.fs = self.path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.path(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(name))) if self.exists(name) else []

    def write(self, name: str, text: str = "") -> None:
        out = self.fs.create(self.path(name), True)
        out.writeBytes(text)
        out.close()

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def move(self, a: str, b: str) -> None:
        self.fs.rename(self.path(a), self.path(b))

    def remove(self, name: str = "") -> None:
        self.fs.delete(self.path(name), True)

    def remove_at_exit(self) -> None:
        self.fs.deleteOnExit(self.path())


def scratch_dir(spark: SparkSession) -> str:
    """The application's own folder in the shared one; it is removed when the application ends."""
    path = f"{shared_dir(spark)}/papyrine-{spark.sparkContext.applicationId}"
    marked = spark.conf.get("papyrine.scratch.dir", None)
    if marked != path:
        Files(spark, path).remove_at_exit()
        spark.conf.set("papyrine.scratch.dir", path)
    return path


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's folder."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "step", by: str | None = None) -> DataFrame:
    """Write ``df`` once as parquet in the shared folder and read it back.

    Cuts the lineage and survives the loss of executors: a later stage reads files, not
    blocks that one executor held. Columnar and compressed, so it costs far less disk
    than an RDD checkpoint. With ``by``, rows lie in a folder for each value of that column.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def computed_once(df: DataFrame) -> DataFrame:
    """``df`` behind a step that expressions aren't merged across.

    The planner otherwise writes a costly column out again wherever it is used above, in
    filters and inside lambdas too. The step is a generator of one row for each.
    """
    from pyspark.sql import functions as F

    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_once")).select("_once.*")


def discard(*frames: DataFrame | None) -> None:
    """Remove the files of durable intermediates that no later plan reads."""
    for df in frames:
        if df is None:
            continue
        spark = df.sparkSession
        own = f"/papyrine-{spark.sparkContext.applicationId}/"
        for root in {f.split(own, 1)[0] + own + f.split(own, 1)[1].split("/", 1)[0] for f in df.inputFiles() if own in f}:
            Files(spark, root).remove()


def forget(spark: SparkSession) -> None:
    """Have the shuffle files and broadcasts removed of plans that nothing refers to any more.

    They otherwise stay until the driver happens to collect its garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(spark: SparkSession) -> None:
    """Remove all intermediates of the application, once their results are no longer read."""
    Files(spark, scratch_dir(spark)).remove()
