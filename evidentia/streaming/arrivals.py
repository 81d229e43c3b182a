"""A stream of arriving files against a stream of declared artifacts.

Both are put under their path, with typed state for what still waits: declared artifacts without a file, and files without a declaration.
An artifact is told once: as soon as its file is there, or as missing when the watermark is `wait` past its declaration; then
its state goes. So does that of a file which nothing has declared within the wait; a file that comes after its artifact was told as missing
tells nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from evidentia.functions import text as tx
from evidentia.operators import checks
from evidentia.sources.fastq import opened

FILE = "file_bytes long, lf_bytes long, crlf_bytes long, content_ok boolean"
DECLARED = "case_id string, artifact_id string, bytes long"


#: Of the list of files that came and of their contents: columns, and rows and bytes of a batch. Folders are dealt over so many tasks, files over so
#: many or, where that is more, the session's shuffle partitions.
LISTED, CONTENT = "path string, at_us long, length long", "path string, modificationTime timestamp, length long, content binary"
TASKS, BATCH_ROWS, BATCH_BYTES = 64, 1000, 4 << 20


def batch_of(rows: list[tuple], *kinds: pa.DataType, names: str) -> pa.RecordBatch:
    columns = [pa.array(values, kind) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=[n.split()[0] for n in names.split(", ")])


def hidden(name: str) -> bool:
    """Names that Spark's own file sources leave out."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def list_files(spark: SparkSession, folder: str, log: str) -> None:
    """Adds the files of a folder, at any depth, that the table `log` does not name yet. Tasks list the folders, those of one depth after
    those above them; the driver gets no names. folder, log: a local path or a URI that Spark and pyarrow.fs know."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        for path in (p for batch in batches for p in batch["path"].to_pylist()):
            found = [x for x in store.get_file_info(fs.FileSelector(path)) if x.type != fs.FileType.Unknown and not hidden(x.base_name)]
            for k in range(0, len(found), BATCH_ROWS):
                rows = [(x.path, x.mtime_ns // 1000, x.size) if x.is_file else (x.path, None, None) for x in found[k : k + BATCH_ROWS]]
                yield batch_of(rows, pa.string(), pa.int64(), pa.int64(), names=LISTED)

    depths: list[DataFrame] = []
    folders = spark.createDataFrame([(opened(folder)[1],)], "path string")
    try:
        while not depths or not folders.isEmpty():
            # names alone, on the tasks' own disks; what is lost there is listed again
            depths.append(folders.repartition(TASKS, "path").mapInArrow(entries, LISTED).persist(StorageLevel.DISK_ONLY))
            folders = depths[-1].where("length IS NULL").select("path")
        files = reduce(DataFrame.unionAll, depths).where("length IS NOT NULL")
        store, at = opened(log)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            files = files.join(spark.read.schema(LISTED).parquet(log), "path", "left_anti")
        files.write.mode("append").parquet(log)
    finally:
        for depth in depths:
            depth.unpersist()


def read_listed(spark: SparkSession, folder: str, log: str) -> DataFrame:
    """The files that list_files() has added to `log`, in the columns of Spark's binaryFile source; tasks open them."""
    at = opened(folder)[1]
    scheme = folder.rstrip("/").removesuffix(at) if folder.rstrip("/").endswith(at) else ""

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        rows, size, kinds = [], 0, (pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary())
        for path, at_us in (x for b in batches for x in zip(b["path"].to_pylist(), b["at_us"].to_pylist(), strict=True)):
            with store.open_input_file(path) as f:
                content = f.read()
            rows.append((scheme + path, at_us, len(content), content))
            size += len(content)
            if len(rows) == BATCH_ROWS or size >= BATCH_BYTES:
                yield batch_of(rows, *kinds, names=CONTENT)
                rows, size = [], 0
        if rows:
            yield batch_of(rows, *kinds, names=CONTENT)

    tasks = max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.readStream.schema(LISTED).parquet(log).repartition(tasks, "path").mapInArrow(contents, CONTENT)


def arriving_files(spark: SparkSession, folder: str, name: Column | None = None, log: str | None = None) -> DataFrame:
    """path, at (modification time), sizes and content_ok of the files that come into a folder. name: the declared path by the
    file's `path`; by default the last part of it. log: a folder for the list of the files that came, which the stream then follows: tasks list
    what is there when this is called (list_files() adds what comes later), and the driver holds no file's name. Without it, Spark's file
    source looks for new files itself, holds all of them in the driver, and leaves out empty ones."""
    if log is not None:
        list_files(spark, folder, log)
        files = read_listed(spark, folder, log)
    else:
        files = spark.readStream.format("binaryFile").schema(CONTENT).option("recursiveFileLookup", True).load(folder)
    path = F.substring_index("path", "/", -1) if name is None else name
    media = tx.media_type(path)
    stats = checks.file_stats(files.select(path.alias("path"), media.alias("media_type"), "content", F.col("modificationTime").alias("at")), "at", "media_type", "content")
    return stats.select("path", "at", F.col("bytes").alias("file_bytes"), "lf_bytes", "crlf_bytes", tx.content_ok(F.col("media_type"), F.col("content")).alias("content_ok"))


class Arrivals(StatefulProcessor):
    """A path's file and the artifacts that wait for one, a value each, and one timer for what comes next; a timer that comes too early
    finds nothing to do and sets the next one. So a batch costs a path a few calls to its state."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.file = handle.getValueState("file", f"{FILE}, due long")
        self.declared = handle.getValueState("declared", "case_ids array<string>, artifact_ids array<string>, bytes array<long>, dues array<long>")

    def held(self) -> tuple[tuple | None, list[tuple]]:
        waiting = self.declared.get()
        return self.file.get(), list(zip(*waiting, strict=True)) if waiting is not None else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = self.held()
        file, waiting = before[0], list(before[1])
        for batch in rows:
            for r in batch.itertuples(index=False):
                due = int(r.at_ms) + self.wait_ms
                if r.is_file:
                    file = (int(r.file_bytes), int(r.lf_bytes), int(r.crlf_bytes), bool(r.content_ok), due)
                else:
                    waiting.append((*(None if pd.isna(x) else x for x in (r.case_id, r.artifact_id)), None if pd.isna(r.bytes) else int(r.bytes), due))
        yield from self.told(key, before, file, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self.held()
        yield from self.told(key, before, *before, timerValues.getCurrentWatermarkInMs())

    def told(self, key, before: tuple, file: tuple | None, waiting: list[tuple], watermark_ms: int) -> Iterator[pd.DataFrame]:
        now = [d for d in waiting if file is not None or d[3] <= watermark_ms]
        left = [d for d in waiting if file is None and d[3] > watermark_ms]
        out = [(key[0], *d[:3], *(file[:4] if file is not None else (None,) * 4)) for d in now]
        if file is not None and file[4] <= watermark_ms:
            file = None
        if left and left != before[1]:
            self.declared.update(tuple(map(list, zip(*left, strict=True))))
        elif before[1] and not left:
            self.declared.clear()
        if file is not None and file != before[0]:
            self.file.update(file)
        elif before[0] is not None and file is None:
            self.file.clear()
        if left or file is not None:
            self.handle.registerTimer(min([d[3] for d in left] + ([file[4]] if file is not None else [])))
        if out:
            yield pd.DataFrame(out, columns=["path", "case_id", "artifact_id", "bytes", "file_bytes", "lf_bytes", "crlf_bytes", "content_ok"], dtype=object)

    def close(self) -> None:
        pass


def stream_validate_files(files: DataFrame, declared: DataFrame, wait: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Checks (case_id, name, ok, actual, expected) of declared artifacts (case_id, artifact_id, path, bytes, at) against files
    of arriving_files(): `size:` by the rule of artifact_size_check(), so LF and CRLF forms of a file are alike, and `content:` by
    media type; a file that has not come within `wait` of its declaration is `missing` in both."""
    rest = {n: F.lit(None).cast(t) for n, t in (x.split() for x in f"{FILE}, {DECLARED}".split(", "))}
    both = files.select("path", "at", F.lit(True).alias("is_file"), *(F.col(n) if n in files.columns else c.alias(n) for n, c in rest.items()))
    named = {"case_id": F.col("case_id").cast("string"), "artifact_id": F.col("artifact_id").cast("string")}
    own = declared.withColumns(named).select("path", "at", F.lit(False).alias("is_file"), *(F.col(n) if n in (*named, "bytes") else c.alias(n) for n, c in rest.items()))
    rows = both.unionByName(own).withWatermark("at", lateness).withColumn("at_ms", F.unix_millis("at"))
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    found = rows.groupBy("path").transformWithStateInPandas(Arrivals(wait_ms), f"path string, {DECLARED}, {FILE}", "append", "eventTime")
    ok, actual, expected = checks.size_rule("bytes", "file_bytes")
    name = lambda kind: F.concat_ws(":", F.lit(kind), "artifact_id")
    media = tx.media_type(F.col("path"))
    gone = F.col("file_bytes").isNull()
    size = checks.check(F.col("case_id"), name("size"), ok, actual, expected)
    content = checks.check(F.col("case_id"), name("content"), F.col("content_ok") & ~gone, F.when(gone, "missing").when(F.col("content_ok"), media).otherwise("invalid"), media)
    return found.select(F.inline(F.array(F.struct(*size), F.struct(*content))))
