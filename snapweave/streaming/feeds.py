"""Incremental feeds: new messages, new versions, assembled output lines and daily counts.

Each takes a streaming (or batch) DataFrame. run_to_end() drives one over the files that are there and gives its rows, with
checkpoint and output in the shared folder, so it can be started again after a failure.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from snapweave.functions.lineage import new_folder
from snapweave.operators.content import Profile, cuts
from snapweave.operators.detect import mentions, redacted


def table_stream(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream, be it a file or a folder, with the schema that a batch read finds."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.removesuffix(".parquet") + "[.]parquet")


def run_to_end(stream: DataFrame, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    out, state = new_folder(spark, "feed"), new_folder(spark, "feed-state")
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def run_looks(looks: list[DataFrame], feed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One feed over tables that come one after the other: each look is a run that goes on from the state of the one before it."""
    spark = looks[0].sparkSession
    out, state, arrived = (new_folder(spark, name) for name in ("feed", "feed-state", "looks"))
    for rows in looks:
        rows.write.mode("append").parquet(arrived)
        found = feed(spark.readStream.schema(rows.schema).parquet(arrived))
        found.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(found.schema).parquet(out)


def fresh_events(messages: DataFrame, since: str, mine: str, names: tuple[str, ...], late: str = "365 days") -> DataFrame:
    """messages (id, at, author, kind, body) seen for the first time, from since on and by others: (id, at, type), an event, mention or message."""
    once = messages.withWatermark("at", late).dropDuplicatesWithinWatermark(["id"]) if messages.isStreaming else messages.dropDuplicates(["id"])
    type_ = F.when(F.col("kind") == "event", "event").when(mentions(F.col("body"), names), "mention").otherwise("message")
    return once.where((F.col("at") >= F.lit(since).cast(messages.schema["at"].dataType)) & (F.col("author") != mine)).select("id", "at", type_.alias("type"))


#: Lots that the keys of a feed are dealt into. It may not change between runs that go on from one state.
LOTS = 4096


def by_lots(rows: DataFrame, key: str, order: str, values: list[str], follow: Callable, output: str) -> DataFrame:
    """Stateful work on each key's rows in order. Keys are dealt into lots, and a lot is one group to Spark with one row of state: a group costs
    some milliseconds, whatever is in it, so that millions of keys as groups of their own would cost hours.

    follow(key, rows, held, out) gets the values of a key's new rows in order and what it held (None at first), adds rows of the output to `out`,
    and returns what to hold; None forgets the key.
    """
    kinds = {"string": "object", "long": "int64", "int": "int32", "double": "float64"}
    fields = {name: kinds[kind] for name, kind in (f.split() for f in output.split(", "))}

    def one_lot(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else {}
        frame = pd.concat(list(parts)).sort_values([key, order], kind="stable")
        keys = frame[key].to_numpy()
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        keys, columns, out = frame[key].tolist(), [frame[v].tolist() for v in values], []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            kept = follow(keys[a], list(zip(*(c[a:b] for c in columns), strict=True)), held.pop(keys[a], None), out)
            if kept is not None:
                held[keys[a]] = kept
        if held:
            state.update((pickle.dumps(held),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=list(fields)).astype(fields)

    dealt = rows.select("*", F.pmod(F.xxhash64(key), F.lit(LOTS)).alias("lot"))
    return dealt.groupBy("lot").applyInPandasWithState(one_lot, output, "held binary", "append", GroupStateTimeout.NoTimeout)


def fresh_saves(versions: DataFrame) -> DataFrame:
    """(project, sequence) of versions (project, sequence) newer than the last look; a project's first look reports none."""

    def look(project: int, rows: list[tuple], seen: int | None, out: list) -> int:
        numbers = sorted({n for (n,) in rows})
        if seen is not None:
            out += [(project, n) for n in numbers if n > seen]
        return max(numbers[-1], numbers[-1] if seen is None else seen)

    known = versions.where("project is not null and sequence is not null")
    return by_lots(known, "project", "sequence", ["sequence"], look, "project long, sequence long")


OMITTED = "[Oversized output line omitted]"


def output_lines(parts: DataFrame, values: tuple[str, ...] = (), most: int = 64 * 1024) -> DataFrame:
    """(stream, number, line, ending) of parts (stream, seq, chunk, last): lines across chunk borders, redacted.

    A line ends with a return, a newline, or (ending is empty) with its stream. One of more than `most` characters is replaced by a note as
    soon as it grows beyond, and the rest of it is passed over, so what is held of a stream is bounded.
    """

    def assemble(stream: int, rows: list[tuple], held: tuple | None, out: list) -> tuple:
        pending, omitting, n = held or ("", False, 0)
        for chunk, last in rows:
            for part in re.split(r"([\r\n])", chunk or ""):
                if part in ("\r", "\n"):
                    if not omitting:
                        out.append((stream, n, pending, part))
                        n += 1
                    pending, omitting = "", False
                elif not omitting:
                    omitting = len(pending) + len(part) > most
                    pending = "" if omitting else pending + part
                    if omitting:
                        out.append((stream, n, OMITTED, "\n"))
                        n += 1
            if last:
                if pending:
                    out.append((stream, n, pending, ""))
                    n += 1
                pending, omitting = "", False
        return pending, omitting, n

    lines = by_lots(parts, "stream", "seq", ["chunk", "last"], assemble, "stream long, number long, line string, ending string")
    return lines.select("stream", "number", redacted(F.col("line"), values).alias("line"), "ending")


def trailing_rates(samples: DataFrame, span_ms: int = 5000, least_ms: int = 250) -> DataFrame:
    """(key, at_ms, rate) of samples (key, at_ms, bytes) in order of time: bytes a second since the oldest sample of the last span; 0 if that is too near.

    Only the samples of a span are held for each key.
    """

    def follow(key: int, rows: list[tuple], held: list | None, out: list) -> list:
        held = held or []
        for at, size in rows:
            held = [h for h in held if h[0] >= at - span_ms] + [(at, size)]
            since = at - held[0][0]
            out.append((key, at, (size - held[0][1]) * 1000 / since if since >= least_ms else 0.0))
        return held

    return by_lots(samples, "key", "at_ms", ["at_ms", "bytes"], follow, "key long, at_ms long, rate double")


#: Parts of a file that are cut together.
PARTS = 1024


def streamed_chunks(parts: DataFrame, profile: Profile) -> DataFrame:
    """(path, position, start, length, sha256) of parts (path, seq, data, last): chunks of files that arrive part by part, the same as of whole files.

    A chunk's end depends on nothing after it, so all chunks but the last come out at once; what is held of a file is less than a chunk of the
    greatest size, and nothing after its last part.
    """

    def follow(path: str, rows: list[tuple], held: tuple | None, out: list) -> tuple | None:
        tail, start, n = held or (b"", 0, 0)
        last, gathered = False, []
        for i, (data, last) in enumerate(rows, 1):
            gathered.append(bytes(data or b""))
            if not last and i % PARTS and i < len(rows):
                continue
            tail, gathered = b"".join([tail, *gathered]), []
            ends, begin = cuts(tail, profile), 0
            for end in ends if last else ends[:-1]:
                out.append((path, n, start, end - begin, hashlib.sha256(tail[begin:end]).hexdigest()))
                n, start, begin = n + 1, start + end - begin, end
            tail = tail[begin:]
        return None if last else (tail, start, n)

    return by_lots(parts, "path", "seq", ["data", "last"], follow, "path string, position int, start long, length long, sha256 string")


def daily_counts(events: DataFrame, at: str, kind: str, late: str = "2 days") -> DataFrame:
    """(day, kind, events) by tumbling days; in append mode a day comes out when the watermark has passed it."""
    timed = events.withWatermark(at, late) if events.isStreaming else events
    return timed.groupBy(F.window(at, "1 day").alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").alias("day"), kind, "events")
