"""What the operators of this package share: tables, the shared folder, batch bounds, dealing of whole documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word and line rules of the contracts.
SPACE = " \t\n\x0b\x0c\r"
#: Stands for a null doc_id: smaller than any other.
NO_ID = -(1 << 63)
#: Bytes of files that one group of documents holds at most, about: what a Python worker has in memory at once is a multiple of it.
SHARD_BYTES = 8 << 20
#: Bytes of text that a task collects before it sends them to their shards.
DEAL_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir."""
    import tempfile

    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        # One process: its own folder is shared.
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


#: Spark removes a query's shuffle files at its end; otherwise they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Paths of the tables saved inside the innermost passing().
SCOPE: ContextVar[list[str] | None] = ContextVar("SCOPE", default=None)


def save(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back, so that lost executors don't repeat what led to it. Shuffle files of the way there go at once."""
    import uuid

    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if (scope := SCOPE.get()) is not None:
        scope.append(path)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    found = spark.read.schema(df.schema).parquet(path)
    found._saved = path
    return found


@contextmanager
def passing(spark: SparkSession, *tables: DataFrame) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that save() writes inside are removed at the end, with those given (if save() wrote them), but not those that the function
    it yields is called with: they belong to the passing() around it, if there is one. Nothing that is read later may come from the others."""
    own = [path for t in tables if (path := t.__dict__.get("_saved"))]
    around = SCOPE.get()
    token = SCOPE.set(own)

    def keep(found: DataFrame) -> DataFrame:
        own.remove(found._saved)
        if around is not None:
            around.append(found._saved)
        return found

    try:
        yield keep
    finally:
        SCOPE.reset(token)
        for path in own:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with each row's place (from 1) in an order over all rows. Rows are sorted over all tasks and written; a task's rows are counted on from a sum
    over the tasks before it, a row a task, so none holds or ranks all rows."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()  # the task's number above 33 bits of the row's
    ordered = save(spark, ordered.withColumn("_part", F.shiftright(row, 33).cast("int")).withColumn("_row", row.bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    sizes = {r["_part"]: r["n"] for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row a task
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    start = F.get(F.lit(before).cast("array<long>"), F.col("_part")) if before else F.lit(0).cast("long")
    return ordered.withColumn(name, start + F.col("_row") + 1).drop("_part", "_row")


def few_rows(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """Batches cut to so many rows, so that what Python holds of whole texts stays small whatever the session's setting."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), rows):
            yield batch.slice(at, rows)


def input_bytes(df: DataFrame) -> int:
    """Size of the files under df, from the plan's statistics; 0 where it is not known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def shard_count(docs: DataFrame, factor: int = 2) -> int:
    """Groups that work is dealt to: a multiple of the session's shuffle partitions, and more where these would hold too much each."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, factor * partitions, -(-input_bytes(docs) // SHARD_BYTES))


def shard_of(doc_id: Column, text: Column, shards: int) -> Column:
    """A shard for each row. Text counts too, so rows that share an id (or have none) still spread."""
    return F.pmod(F.xxhash64(doc_id, F.length(text), F.substring(text, 1, 64)), F.lit(shards)).cast("int")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns that most operators need; a null text is an empty one."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


#: So many rows of a table that is about 20 bytes wide are broadcast.
BROADCAST_ROWS = 500_000
#: Tasks to which the rows of a hot key are dealt.
SALTS = 32


def beside(rows: DataFrame, found: DataFrame, keys: list[str], hot: DataFrame, deal: Column, how: str = "inner") -> DataFrame:
    """rows joined with found by keys. The keys in hot have many rows: these are dealt by `deal` to several tasks, each with a copy of what found has."""
    hot = save(rows.sparkSession, hot.select(*keys), "hot")
    n = hot.count()
    if not n:
        return rows.join(found, keys, how)
    mark = hot.withColumn("_nd_hot", F.lit(True))
    mark = F.broadcast(mark) if n <= BROADCAST_ROWS else mark
    is_hot = F.coalesce("_nd_hot", F.lit(False))
    rows = rows.join(mark, keys, "left").withColumn("_nd_salt", F.when(is_hot, F.pmod(deal, F.lit(SALTS)).cast("int")).otherwise(0)).drop("_nd_hot")
    found = found.join(mark, keys, "left").withColumn("_nd_salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_nd_hot")
    return rows.join(found, [*keys, "_nd_salt"], how).drop("_nd_salt")


class Blob:
    """Named arrays as compressed bytes."""

    codec = "zstd"

    @classmethod
    def pack(cls, *arrays: np.ndarray) -> bytes:
        head = np.array([x.nbytes for x in arrays], np.int64).tobytes()
        raw = head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
        return np.int64(len(raw)).tobytes() + pa.compress(raw, cls.codec, asbytes=True)

    @classmethod
    def unpack(cls, blob: bytes, *kinds) -> list[np.ndarray]:
        raw = pa.decompress(blob[8:], int(np.frombuffer(blob[:8], np.int64)[0]), cls.codec, asbytes=True)
        sizes = np.frombuffer(raw[: 8 * len(kinds)], np.int64)
        out, at = [], 8 * len(kinds)
        for size, kind in zip(sizes.tolist(), kinds, strict=True):
            out.append(np.frombuffer(raw[at : at + size], kind))
            at += size
        return out


def planes(x: np.ndarray) -> np.ndarray:
    """Numbers from 0 on as bytes: how many bytes each takes, then all lowest bytes, all second ones, and so on, which compresses well."""
    x = np.ascontiguousarray(x, "<u8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return np.concatenate([np.array([width], np.uint8), x.view(np.uint8).reshape(-1, 8)[:, :width].T.ravel()])


def unplanes(raw: np.ndarray) -> np.ndarray:
    width = int(raw[0])
    out = np.zeros(((len(raw) - 1) // width, 8), np.uint8)
    out[:, :width] = raw[1:].reshape(width, -1).T
    return out.view("<i8").ravel()


def rows_of(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.Table:
    parts = list(zip(*rows, strict=True)) or [[]] * len(columns)
    return pa.table({n: pa.array(c, k) for (n, k), c in zip(columns.items(), parts, strict=True)})


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[list[int], list[bytes]]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        shards, blobs = [], []
        for shard, (ids, texts) in sorted(held.items()):
            shards.append(shard)
            blobs.append(Blob.pack(np.array(ids, np.int64), np.array([len(x) for x in texts], np.int64), np.frombuffer(b"".join(texts), np.uint8)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "blob"])

    for batch in few_rows(batches):
        for doc_id, text, shard in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
            ids, texts = held.setdefault(shard, ([], []))
            ids.append(NO_ID if doc_id is None else doc_id)
            texts.append(text)
            size += len(text)
            if size >= DEAL_BYTES:
                yield flush()
                size = 0
    if held:
        yield flush()


def deal(docs: DataFrame, shards: int) -> DataFrame:
    """(shard, blob): whole documents, dealt to shards and compressed by task and shard, which halves what is moved."""
    d = id_and_text(docs)
    return d.withColumn("shard", shard_of(F.col("doc_id"), F.col("text"), shards)).mapInArrow(_deal, "shard int, blob binary")


def documents(blobs: list[bytes]) -> tuple[list[int], list[bytes]]:
    """A shard's ids and texts (UTF-8), always in the same order, whatever order its blobs came in."""
    ids, texts = [], []
    for blob in sorted(blobs):
        own, sizes, raw = Blob.unpack(blob, np.int64, np.int64, np.uint8)
        ids += own.tolist()
        text, ends = raw.tobytes(), np.cumsum(sizes).tolist()
        texts += [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
    return ids, texts
