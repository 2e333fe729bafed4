"""Streams: matches as they come, requests, event-time windows, snapshots as state."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lexloom.functions.text import split_lines
from lexloom.operators.search import SearchSpec, predicate


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of files as a stream, with the schema of what is there."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).option("recursiveFileLookup", True).parquet(path)


def match_stream(docs: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matching lines of a stream of documents: no state, so append mode."""
    own = docs.filter(F.col("text").isNotNull()).select("doc_id", F.posexplode(split_lines(F.col("text"))).alias("_at", "line"))
    return own.select("doc_id", (F.col("_at") + 1).cast("int").alias("line_no"), "line").filter(predicate(spec, F.col("line")))


def counts(events: DataFrame, size: str, slide: str | None = None, late: str = "1 hour", keys: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums of value over event-time windows. events: ts, value and keys."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late) if events.isStreaming else own
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return own.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of users: start, end and events."""
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    own = own.withWatermark("ts", late) if events.isStreaming else own
    found = own.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("session_start"), F.col("w.end").cast("timestamp_ntz").alias("session_end"), "n")


def without_repeats(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    own = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return own.withWatermark("ts", late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else own.dropDuplicates([key])


def changes(snapshots: DataFrame) -> DataFrame:
    """(path, change) from a stream of (path, mtime, size): state holds the last of each path. A size of null is a removal."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for frame in frames:
            for mtime, size in sorted(zip(frame["mtime"], frame["size"], strict=True)):
                now = None if pd.isna(size) else (int(mtime), int(size))
                if now != last:
                    out.append("removed" if now is None else "added" if last is None else "modified")
                last = now
        if last is None:
            state.remove()
        else:
            state.update(last)
        yield pd.DataFrame({"path": [key[0]] * len(out), "change": out})

    return snapshots.groupBy("path").applyInPandasWithState(run, "path string, change string", "mtime long, size long", "append", GroupStateTimeout.NoTimeout)


CLAIM_ENDS = "claim_id long, agent_id long, change string, at timestamp"


def claim_ends(events: DataFrame, late: str = "0 seconds") -> DataFrame:
    """(claim_id, agent_id, change, at) of claims that end, from a stream of claim_id, agent_id, kind (submit or release), at, expires_at.

    State holds each live claim's last submission and a timer at its expiry. A release ends it, a submission renews it, and when the watermark has passed the timer it has expired, with no event of its own; so does a
    claim whose next event comes after its expiry. Events of a claim are taken in the order of time and kind within a batch; what is late beyond the watermark is dropped by it.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        live = state.get if state.exists else None  # agent, expiry in microseconds
        out: list[tuple] = []
        if state.hasTimedOut:
            out.append((key[0], live[0], "expired", live[1]))
            live = None
        else:
            whole = pd.concat(list(frames))
            micros = lambda c: whole[c].astype("datetime64[us]").astype("int64")
            for at, kind, agent, expires in sorted(zip(micros("at"), whole["kind"], whole["agent_id"], micros("expires_at"), strict=True)):
                if live is not None and live[1] < at:
                    out.append((key[0], live[0], "expired", live[1]))
                    live = None
                if kind == "release":
                    out += [(key[0], int(agent), "released", at)] if live is not None else []
                    live = None
                else:
                    live = (int(agent), int(expires))
        if live is None:
            state.remove()
        else:
            state.update(live)
            # A timer must lie behind the watermark; one that the watermark has passed already fires with the next.
            state.setTimeoutTimestamp(max(live[1] // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"claim_id": pd.Series([x[0] for x in out], dtype="int64"), "agent_id": pd.Series([x[1] for x in out], dtype="int64"), "change": [x[2] for x in out], "at": pd.to_datetime([x[3] for x in out], unit="us")})

    timed = events.withColumn("at", F.col("at").cast("timestamp")).withColumn("expires_at", F.col("expires_at").cast("timestamp"))
    return timed.withWatermark("at", late).groupBy("claim_id").applyInPandasWithState(run, CLAIM_ENDS, "agent_id long, expires long", "append", GroupStateTimeout.EventTimeTimeout)


class Answers:
    """Answers by request and state of the corpus, the least recently used one first to go. A change of the corpus changes its fingerprint, so old answers are never given again."""

    def __init__(self, most: int = 128):
        self.most, self.hits, self.misses = most, 0, 0
        self.held: OrderedDict[tuple[str, str], list[str]] = OrderedDict()

    def get(self, request: str, fingerprint: str, make: Callable[[], list[str]]) -> list[str]:
        key = (request, fingerprint)
        if key in self.held:
            self.hits += 1
            self.held.move_to_end(key)
            return self.held[key]
        self.misses += 1
        found = self.held[key] = make()
        while len(self.held) > self.most:
            self.held.popitem(last=False)
        return found


def fingerprint(files: DataFrame) -> str:
    """One digest of the paths, times and sizes of a corpus: path, mtime, size. Sums of hashes, so no row order matters and nothing is gathered."""
    h = F.xxhash64("path", "mtime", "size")
    row = files.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("s")).first()
    return f"{row['n']}-{row['x'] or 0:x}-{row['s'] or 0:x}"


def serve(requests: DataFrame, handlers: dict[str, Callable[[SparkSession, dict], DataFrame]], out_dir: str, checkpoint: str) -> StreamingQuery:
    """Answers a stream of requests (id, command, args as JSON). Each answer is written under its id; a repeated batch writes the same again."""
    import json

    def batch(frame: DataFrame, epoch: int) -> None:
        spark = frame.sparkSession
        for row in frame.toLocalIterator():
            handler = handlers.get(row["command"])
            answer = handler(spark, json.loads(row["args"] or "{}")) if handler else spark.createDataFrame([(f"unknown command: {row['command']}",)], "error string")
            answer.write.mode("overwrite").json(f"{out_dir}/id={row['id']}")

    return requests.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", format: str = "parquet") -> None:
    """Everything that is there now, written exactly once."""
    stream.writeStream.outputMode(mode).format(format).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
