"""What the operators of this subpackage share: the shared folder, written tables, chunks of text."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one task holds at a time.
CHUNK_BYTES = 1 << 20
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). Where that is unset, a temporary one on this machine, but only
    if all tasks run here too; a cluster without a shared folder is an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not path:
        if not (sc.master or "").startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(path)
        path = sc.getCheckpointDir()
    return path.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns of df, whatever else it has. Arrow batches are kept small, so long texts need little memory, unless
    the session has a setting of its own."""
    conf = df.sparkSession.conf
    if BATCH_ROWS not in conf.getAll:
        conf.set(BATCH_ROWS, "1000")
    return df.select(*(F.col(f"`{n}`") for n in names))


def with_row_key(docs: DataFrame) -> DataFrame:
    """doc_id, text and _rid, a hash of both; rows that agree in all three give equal results."""
    return only(docs, "doc_id", "text").withColumn("_rid", F.xxhash64("doc_id", "text"))


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts; it only sets numbers of buckets."""
    return docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("n")).first()["n"]


def chunks(batches: Iterator[pd.DataFrame], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pd.DataFrame]:
    """The rows of a task regrouped into frames of about `limit` bytes of text; a longer text stands alone."""
    held, size = [], 0
    for batch in batches:
        lengths = batch[column].map(lambda t: len(t) if t is not None else 0).to_numpy()
        cuts, start = [], 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                cuts.append((start, i))
                start, size = i, 0
            size += int(n)
        for a, b in cuts:
            yield pd.concat([*held, batch.iloc[a:b]], ignore_index=True)
            held = []
        held.append(batch.iloc[start:])
    held = [x for x in held if len(x)]
    if held:
        yield pd.concat(held, ignore_index=True)
    held = batch = None
    give_back()


def give_back() -> None:
    """Hands freed memory back to the system; a Python worker lives on after its task, beside those of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Row slices of a matrix that is summed up.
SLICES = 32


def summed(rows: DataFrame, parts_of, shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices that parts_of(batches) yields: in each task first, then slice by slice in Spark. Only the sum,
    of a fixed shape, comes to the driver."""
    edges = np.linspace(0, shape[0], SLICES + 1).astype(int)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape)
        for part in parts_of(batches):
            total += part
        salt = TaskContext.get().partitionId() % 16
        for k in range(SLICES):
            part = total[edges[k] : edges[k + 1]]
            if part.any():
                yield pd.DataFrame({"slice": [k], "salt": [salt], "data": [part.astype(np.float64).tobytes()]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1)
        for x in group["data"]:
            total = total + np.frombuffer(x, np.float64)
        return pd.DataFrame({"slice": [group["slice"].iloc[0]], "data": [total.astype(np.float64).tobytes()]})

    parts = rows.mapInPandas(run, "slice int, salt int, data binary")
    parts = parts.groupBy("slice", "salt").applyInPandas(add, "slice int, data binary").groupBy("slice").applyInPandas(add, "slice int, data binary")
    out = np.zeros(shape)
    for row in parts.collect():  # SLICES rows of one fixed-shape matrix
        out[edges[row["slice"]] : edges[row["slice"] + 1]] = np.frombuffer(row["data"], np.float64).reshape(-1, shape[1])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): one row (id, component) per node that has an edge; component is the
    smallest id. Alternating large-star and small-star rounds over written tables, until the edges stay the same."""
    e = saved(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while True:
        both = e.union(e.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").where("v <> m").select("v", "m").toDF("u", "v").union(least.toDF("u", "v")).where("u <> v").distinct()
        e = saved(e, "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    nodes = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.union(e.select("v", "v")).distinct()
