"""Session helpers: a test session, the shared folder, and written intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def local_session(cores: str = "*", partitions: int = 8, app: str = "waygraph") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("WAYGRAPH_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors reach: the one in spark.checkpoint.dir.

    Only a local master, which has no other machines, gets a temporary folder when the setting is
    missing; on a cluster a missing setting is an error.
    """
    sc = spark.sparkContext
    path = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(path)
        return path
    master = sc.master or ""
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="waygraph-"))
    return sc.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts the lineage, survives lost executors.

    Columns, types and row count are unchanged; row order and partitioning are not kept.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def written_with(df: DataFrame, name: str, value: Column) -> tuple[DataFrame, object]:
    """written(df), and an aggregate of its rows taken by the same job."""
    seen = Observation()
    return written(df.observe(seen, value.alias("value")), name), seen.get["value"]


def hadoop_path(spark: SparkSession, path: str) -> tuple[object, object]:
    """A path and its file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that nothing reads any more."""
    path = getattr(df, "_written_at", None)
    if path:
        discard_folder(df.sparkSession, path)


def discard_folder(spark: SparkSession, path: str) -> None:
    at, fs = hadoop_path(spark, path)
    fs.delete(at, True)


#: bytes that are copied or hashed at a time
_BUFFER = 1 << 20


def write_whole(spark: SparkSession, pieces: list[str | tuple[DataFrame, list[str], int]], path: str, suffix: str) -> None:
    """A new folder with one file: texts, and tables (value) a line each in the given order, one after another.

    A table is (df, order, bytes left out at its start). It is sorted and written by many tasks; their
    parts are joined as bytes, each deleted as soon as it is copied, so nothing is held but a buffer.
    """
    jvm = spark._jvm
    at, fs = hadoop_path(spark, path)
    if fs.exists(at):
        raise FileExistsError(path)
    temp = f"{path.rstrip('/')}.parts-{uuid.uuid4().hex}"
    try:
        for i, piece in enumerate(pieces):
            if not isinstance(piece, str):
                df, order, _ = piece
                df.repartitionByRange(sort_width(df), *order).sortWithinPartitions(*order).select("value").write.text(f"{temp}/{i}")
        fs.mkdirs(at)
        whole = jvm.org.apache.hadoop.fs.Path(at, "_whole")
        out = fs.create(whole)
        try:
            for i, piece in enumerate(pieces):
                if isinstance(piece, str):
                    out.write(piece.encode())
                    continue
                skip = piece[2]
                parts = [x.getPath() for x in fs.listStatus(hadoop_path(spark, f"{temp}/{i}")[0]) if x.getPath().getName().startswith("part-") and x.getLen()]
                for part in sorted(parts, key=lambda x: int(x.getName().split("-")[1])):
                    src = fs.open(part)
                    try:
                        src.seek(skip)
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(src, out, _BUFFER, False)
                    finally:
                        src.close()
                    skip = 0
                    fs.delete(part, False)
        finally:
            out.close()
        fs.rename(whole, jvm.org.apache.hadoop.fs.Path(at, f"part-00000{suffix}"))
        fs.create(jvm.org.apache.hadoop.fs.Path(at, "_SUCCESS")).close()
    finally:
        discard_folder(spark, temp)


def file_sha256(spark: SparkSession, path: str) -> str:
    """Hash of one file's bytes, read as a stream."""
    jvm = spark._jvm
    at, fs = hadoop_path(spark, path)
    hashed = jvm.java.security.DigestInputStream(fs.open(at), jvm.java.security.MessageDigest.getInstance("SHA-256"))
    try:
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(hashed, jvm.java.io.OutputStream.nullOutputStream(), _BUFFER, False)
    finally:
        hashed.close()
    return bytes(hashed.getMessageDigest().digest()).hex()


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: bytes of input files (compressed) that one task of a sort takes on average
TASK_BYTES = 64 << 20


def sort_width(df: DataFrame) -> int:
    """Partitions for a sort of df: as many as the session's shuffles have, more where the input is large.

    A sorted partition is held by one task, so its size must not grow with the input.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    size = sum(x for x in sizes if x < 1 << 60)  # beyond that the size is not known
    return max(shuffle_width(df.sparkSession), min(-(-size // TASK_BYTES), 1_000_000))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_waygraph_shipped", False):
        return
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="waygraph-ship-")) / "waygraph.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, Path(root.name) / f.relative_to(root))
    sc.addPyFile(str(target))
    sc._waygraph_shipped = True
