"""Tables written in the folder that all machines share, to cut lineage or to be read more than once."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

import numpy as np
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .textkernel import give_back

#: While tables are written: shuffle files of the job are dropped, and batches to Python are small, as texts may be long.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": ("false", "true"), "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000")}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not getattr(spark.sparkContext, "_siftwell_shared", None):
        spark.sparkContext._siftwell_shared = tempfile.mkdtemp(prefix="siftwell-")
    return f"file://{spark.sparkContext._siftwell_shared}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back; shuffle files of the job are dropped."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, tag)
    was = {k: spark.conf.get(k, usual) for k, (usual, _) in _WRITING.items()}
    for k, (_, value) in _WRITING.items():
        spark.conf.set(k, value)
    try:
        df.write.parquet(path)
    finally:
        for k, value in was.items():
            spark.conf.set(k, value)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Have the driver collect its garbage: Spark drops broadcasts and shuffle files once nothing refers to them there."""
    give_back()
    spark.sparkContext._jvm.System.gc()


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Have the driver delete a written folder when it ends."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)


def write_bytes(spark: SparkSession, path: str, data: bytes, piece: int = 4 << 20) -> str:
    """Write a file to a folder that only Spark's file systems may reach, piece by piece; returns path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        for k in range(0, len(data), piece):
            out.write(bytearray(data[k : k + piece]))
    finally:
        out.close()
    return path


def ship_arrays(spark: SparkSession, tag: str, arrays: dict[str, np.ndarray]) -> str:
    """Send arrays to each machine once, as a file that all its Python workers map; returns the file's name."""
    found, at = [], 0
    for k, x in arrays.items():
        found.append((k, x.dtype.str, len(x), at))
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(found).encode()
    head += b" " * (-len(head) % 8)
    data = b"".join([len(head).to_bytes(8, "little"), head, *(x.tobytes() + b"\0" * (-x.nbytes % 8) for x in arrays.values())])
    name = f"{tag}-{hashlib.sha256(data).hexdigest()[:24]}"
    if name not in {x.rpartition("/")[2] for x in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(write_bytes(spark, f"{shared_dir(spark)}/{name}", data))
    return name


def mapped_arrays(name: str) -> dict[str, np.ndarray]:
    """The shipped arrays, mapped and not read."""
    raw = np.memmap(SparkFiles.get(name), dtype=np.uint8, mode="r")
    start = 8 + int(raw[:8].view(np.int64)[0])
    return {k: raw[start + at : start + at + n * np.dtype(kind).itemsize].view(kind) for k, kind, n, at in json.loads(bytes(raw[8:start]))}


def with_text(docs: DataFrame, kept: list[str], text_col: str) -> tuple[DataFrame, str]:
    """(docs with the one column _row, a struct of the kept columns as c_<name>; the field that holds the text as a string).

    A text column that is kept and a string goes to Python once."""
    from pyspark.sql import functions as F

    fields = [F.col(f"`{c}`").alias(f"c_{c}") for c in kept]
    own = text_col in kept and dict(docs.dtypes)[text_col] == "string"
    fields.append(F.lit(0).alias("_") if own else F.col(f"`{text_col}`").cast("string").alias("_text"))
    return docs.select(F.struct(*fields).alias("_row")), f"c_{text_col}" if own else "_text"


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Total bytes of a string column."""
    from pyspark.sql import functions as F

    return int(docs.agg(F.sum(F.octet_length(column))).first()[0] or 0)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
