"""Session streams: sentences, silence cuts, automatic stop. State lives per session; each micro-batch adds its rows."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.text import trim_all
from ..operators.speech import correct, rms

# executors need no copy of this package: its functions travel by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SILENCE_RMS = 0.02
SILENCE_MS = 800
MIN_SECONDS = 2.5
MAX_SECONDS = 15.0
PRE_ROLL = 3200
RATE = 16000


def sentences(results: DataFrame, corrected: bool = True) -> DataFrame:
    """Finished sentences of (session, ts, text, is_endpoint). Partial results are previews of the same sentence, so they are
    dropped, never joined; the endpoint text is the sentence. Needs no state."""
    done = results.where("is_endpoint").withColumn("text", F.coalesce("text", F.lit("")))
    done = correct(done) if corrected else done
    return done.withColumn("text", trim_all(F.col("text"))).where("text <> ''").drop("is_endpoint")


def chunk_levels(chunks: DataFrame) -> DataFrame:
    """Audio chunks (session, seq, samples and, if known, ended) as (session, seq, n_samples, rms); sample arrays do not travel to the state."""
    more = [c for c in ("ended",) if c in chunks.columns]
    return chunks.select("session", "seq", F.size("samples").alias("n_samples"), rms(F.col("samples")).alias("rms"), *more)


SEGMENT = "session string, segment_no int, first_seq bigint, last_seq bigint, samples bigint, pre_roll bigint, reason string"
SEGMENT_STATE = "segment_no int, first_seq bigint, buffered bigint, silence_ms double, pre_roll bigint"


def _cut(session: str, rows: pd.DataFrame, state: tuple, rate: int) -> tuple[list, tuple]:
    number, first, buffered, silence, pre = state
    out = []
    for seq, n, level, ended in rows.sort_values("seq")[["seq", "n_samples", "rms", "ended"]].itertuples(index=False):
        first = seq if buffered == 0 else first
        buffered += n
        silence = silence + n / rate * 1000 if level < SILENCE_RMS else 0.0
        quiet = silence >= SILENCE_MS and buffered / rate >= MIN_SECONDS
        if quiet or buffered / rate >= MAX_SECONDS:
            number += 1
            out.append((session, number, first, seq, buffered, pre, "silence" if quiet else "limit"))
            pre = PRE_ROLL if buffered > PRE_ROLL else 0
            buffered, silence = 0, 0.0
        if ended:
            if buffered:
                number += 1
                out.append((session, number, first, seq, buffered, 0, "end"))
            buffered, silence, pre = 0, 0.0, 0
    return out, (number, first, buffered, silence, pre)


def silence_segments(levels: DataFrame, rate: int = RATE) -> DataFrame:
    """R4 as a stream: a segment ends after 800 ms of silence once 2.5 s are buffered, or at 15 s; up to 0.2 s are carried over.
    A chunk whose optional column ``ended`` is true closes the recording: what is buffered is the last segment, without carried samples.

    The cut is greedy, so its state (five numbers) is kept per session; the rows of a session come in micro-batches, in the order of
    ``seq`` from batch to batch and in any order inside one.
    """

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current = state.get if state.exists else (0, 0, 0, 0.0, 0)
        done, current = _cut(key[0], pd.concat(list(frames)), tuple(current), rate)
        state.update(tuple(current))
        yield pd.DataFrame(done, columns=["session", "segment_no", "first_seq", "last_seq", "samples", "pre_roll", "reason"])

    ended = F.coalesce("ended", F.lit(False)) if "ended" in levels.columns else F.lit(False)
    keyed = levels.select(F.col("session").cast("string").alias("session"), "seq", "n_samples", "rms", ended.alias("ended"))
    return keyed.groupBy("session").applyInPandasWithState(run, SEGMENT, SEGMENT_STATE, "append", GroupStateTimeout.NoTimeout)


def auto_stop(inputs: DataFrame, seconds: int) -> DataFrame:
    """R5 in batch: the countdown starts with the first input of a session and is not reset by later ones."""
    per = inputs.groupBy("session").agg(F.min("ts").alias("started_at"), F.max("ts").alias("last_at"))
    stop = F.timestamp_seconds(F.unix_micros(F.col("started_at").cast("timestamp")) / 1_000_000 + seconds)
    return per.select(
        "session", "started_at", stop.alias("stop_at"), (F.col("last_at").cast("timestamp") >= stop).alias("stopped")
    )


def auto_stop_stream(inputs: DataFrame, seconds: int, watermark: str = "1 minute") -> DataFrame:
    """R5 as a stream: one row (session, stop_at) when the event-time clock passes start + ``seconds``."""

    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        empty = pd.DataFrame({"session": pd.Series(dtype=str), "stop_at": pd.Series(dtype="datetime64[ns]")})
        if state.hasTimedOut:
            (stop_ms,) = state.get
            state.update((-1,))
            yield pd.DataFrame({"session": [key[0]], "stop_at": [pd.Timestamp(stop_ms, unit="ms")]})
            return
        first = min(f["ts"].min() for f in frames)
        if not state.exists:
            stop_ms = int(first.timestamp() * 1000) + seconds * 1000
            state.update((stop_ms,))
        (stop_ms,) = state.get
        if stop_ms >= 0:
            if stop_ms > state.getCurrentWatermarkMs():
                state.setTimeoutTimestamp(stop_ms)
            else:
                state.update((-1,))
                yield pd.DataFrame({"session": [key[0]], "stop_at": [pd.Timestamp(stop_ms, unit="ms")]})
                return
        yield empty

    keyed = inputs.withColumn("session", F.col("session").cast("string")).withWatermark("ts", watermark)
    return keyed.groupBy("session").applyInPandasWithState(
        run, "session string, stop_at timestamp", "stop_ms bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def run_available(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """Drive a file-source stream over all its files into a Parquet folder and read that folder."""
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)
