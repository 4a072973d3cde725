"""Structured Streaming over events (D8, Z4, Z7-Z12, Z18). Every function works on batch DataFrames too where it can."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, width: str, late: str = "1 hour", ts: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums by event-time window; on a stream late rows are dropped after the watermark."""
    src = events.withColumn(ts, F.col(ts).cast("timestamp"))
    src = src.withWatermark(ts, late) if events.isStreaming else src
    out = src.groupBy(F.window(ts, width), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), *by, "n", "total")


def hopping(events: DataFrame, width: str, step: str, late: str = "1 hour", ts: str = "ts") -> DataFrame:
    src = events.withColumn(ts, F.col(ts).cast("timestamp"))
    src = src.withWatermark(ts, late) if events.isStreaming else src
    return src.groupBy(F.window(ts, width, step)).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str = "1 hour", key: str = "user_id", ts: str = "ts") -> DataFrame:
    src = events.withColumn(ts, F.col(ts).cast("timestamp"))
    src = src.withWatermark(ts, late) if events.isStreaming else src
    out = src.groupBy(F.session_window(ts, gap), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def idempotent(events: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """Each event once; on a stream the keys that are held are bounded by the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates([key])
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def token_bucket(events: DataFrame, rate: float, burst: float, key: str = "user_id", idle: str = "1 hour") -> DataFrame:
    """(key, event_id, ts, allowed): a bucket of ``burst`` tokens that fills at ``rate`` a second, for each key.

    On a stream the bucket is the key's state, which ends when the key is idle; in batch a key's events go by in order,
    and only its bucket is held, so a key may have any number of them.
    """
    schema = f"{key} long, event_id long, ts timestamp, allowed boolean"

    def take(frame: pd.DataFrame, tokens: float, last: float) -> tuple[pd.DataFrame, float, float]:
        frame, allowed = frame.sort_values(["ts", "event_id"], kind="stable"), []
        for t in frame["ts"]:
            now = t.timestamp()
            tokens = min(burst, tokens + max(0.0, now - last) * rate)
            last = max(last, now)
            allowed.append(tokens >= 1)
            tokens -= 1 if tokens >= 1 else 0
        return frame.assign(allowed=allowed)[[key, "event_id", "ts", "allowed"]], tokens, last

    src = events.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts"))
    if not events.isStreaming:

        def go_by(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bucket: tuple = (None, burst, float("-inf"))
            for f in frames:
                parts = []
                for k, rows in f.groupby(key, sort=False, dropna=False):
                    tokens, last = bucket[1:] if bucket[0] == k else (burst, float("-inf"))
                    out, tokens, last = take(rows, tokens, last)
                    bucket = (k, tokens, last)
                    parts.append(out)
                if parts:
                    yield pd.concat(parts)

        return src.repartition(key).sortWithinPartitions(key, "ts", "event_id").mapInPandas(go_by, schema)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tokens, last = state.get if state.exists else (burst, float("-inf"))
        rows = pd.concat(list(frames))
        out, tokens, last = take(rows, tokens, last)
        state.update((tokens, last))
        state.setTimeoutDuration(idle_ms)
        yield out

    number, unit = idle.split()
    idle_ms = int(number) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")]
    return src.groupBy(key).applyInPandasWithState(step, schema, "tokens double, last double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def run_rules(spark: SparkSession, events: DataFrame, program: str, trigger: str, folder: str, to_facts: Callable[[DataFrame], dict[str, DataFrame]]) -> Any:
    """For each micro-batch only newly derived trigger facts go to ``folder``/out.

    Exactly once an event and a fact: batches write to folders of their own number, so a batch that runs again after
    a failure overwrites its first try, and it reads only what earlier batches wrote. A program without negation goes on
    from all facts that the last batch knew, with the new ones alone as the first delta; one with negation, where a new
    fact may undo derived ones, is inferred again from all events. Event ids are looked up in all earlier batches.
    """
    from orrery.operators.datalog import extend, infer, parse

    rules = parse(program)
    grows = not any(a.negated for r in rules for a in r.body)
    arity = {a.predicate: len(a.terms) for r in rules for a in (r.head, *r.body)}

    def earlier(kind: str, batch: int) -> DataFrame | None:
        paths = [f"{folder}/{kind}/batch={b}" for b in range(batch)]
        return spark.read.parquet(*paths) if paths else None

    def known(batch: int) -> dict[str, DataFrame]:
        if not batch:
            return {}
        held = spark.read.parquet(f"{folder}/facts/batch={batch - 1}")
        return {p: held.where(F.col("predicate") == p).select(*[F.col("terms")[i].alias(f"t{i}") for i in range(n)]) for p, n in arity.items()}

    def step(batch: DataFrame, number: int) -> None:
        seen = earlier("events", number)
        new = batch.dropDuplicates(["event_id"])
        if seen is not None:
            new = new.join(seen.select("event_id"), "event_id", "left_anti")
        new.write.mode("overwrite").parquet(f"{folder}/events/batch={number}")
        if grows:
            facts, fresh = extend(spark, program, known(number), to_facts(spark.read.parquet(f"{folder}/events/batch={number}")))
            rows = [d.select(F.lit(p).alias("predicate"), F.array(*d.columns).alias("terms")) for p, d in facts.items() if p in arity]
            reduce(DataFrame.unionByName, rows).write.mode("overwrite").parquet(f"{folder}/facts/batch={number}")
            fresh[trigger].write.mode("overwrite").parquet(f"{folder}/out/batch={number}")
            return
        every = spark.read.parquet(*[f"{folder}/events/batch={b}" for b in range(number + 1)])
        derived = infer(spark, program, to_facts(every))[trigger]
        before = earlier("out", number)
        fresh = derived if before is None else derived.join(before, derived.columns, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    return events.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def dispatch(spark: SparkSession, outbox: DataFrame, deliver: Callable[[DataFrame], DataFrame], attempts: int, folder: str) -> Any:
    """Deliver each micro-batch up to ``attempts`` times; what fails every time goes to ``folder``/dead.

    ``deliver`` takes rows and returns those that failed.
    """
    from orrery.session import cut

    def step(batch: DataFrame, number: int) -> None:
        left = batch
        for _ in range(attempts):
            left = cut(deliver(left))
            if left.isEmpty():
                break
        left.write.mode("overwrite").parquet(f"{folder}/dead/batch={number}")

    return outbox.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def ingest(spark: SparkSession, stream: DataFrame, key: str, folder: str) -> Any:
    """Apply each micro-batch to a keyed table, with its change set beside it; a batch that runs again gives the same."""
    from orrery.operators.temporal import change_set
    from orrery.sources.writers import upsert

    def step(batch: DataFrame, number: int) -> None:
        one = batch.dropDuplicates([key])
        old = spark.read.parquet(f"{folder}/state/batch={number - 1}") if number else one.limit(0)
        change_set(old, one, key, full_snapshot=False).write.mode("overwrite").parquet(f"{folder}/changes/batch={number}")
        upsert(old, one, [key]).write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


class Views:
    """Named results that are written once and read again until their time is up or an input of theirs changed."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.views, self.runs = spark, folder, {}, {}

    def define(self, name: str, compute: Callable[[], DataFrame], ttl: float, depends_on: tuple[str, ...] = ()) -> None:
        self.views[name] = (compute, ttl, depends_on)

    def get(self, name: str, now: float) -> DataFrame:
        compute, ttl, depends_on = self.views[name]
        made, number = self.runs.get(name, (None, 0))
        stale = made is None or now - made >= ttl or any(self.runs.get(d, (0, 0))[0] is not None and self.runs.get(d, (0, 0))[0] > made for d in depends_on)
        if stale:
            number += 1
            compute().write.mode("overwrite").parquet(f"{self.folder}/{name}/{number}")
            self.runs[name] = (now, number)
        return self.spark.read.parquet(f"{self.folder}/{name}/{number}")
