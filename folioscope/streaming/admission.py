"""Token-bucket admission per key, over a table or a stream of events.

A bucket starts full, refills at a fixed rate up to its capacity, and admits an
event by paying its cost; a rejected event pays nothing. The decision depends on
all earlier decisions of the key, which no built-in aggregate expresses, so the
fold itself runs in Python over Arrow batches. Spark partitions and sorts.

A stream runs the same fold on every micro-batch and hands the buckets on: a key's
events are sorted by Spark, cut where its bucket is surely full, and pass through
workers piece by piece, however many of them one micro-batch holds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioscope.operators.ordering import running_total
from folioscope.sources.store import listed, remove

# Python workers get the fold itself, so they need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Events of one key are sorted together only within a slice of this length.
SLICE_SECONDS = 3600


def _check(capacity: float, refill_per_second: float) -> None:
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    if refill_per_second <= 0:
        raise ValueError("refill_per_second must be positive")


def spend(
    micros, tokens: float, last: int | None, capacity: float, rate: float, cost: float
) -> tuple[list[bool], list[float], float, int | None]:
    """Fold one run of event times through a bucket."""
    allowed, remaining = [], []
    for now in micros:
        if last is not None:
            tokens = min(capacity, tokens + max(0.0, (now - last) / 1e6) * rate)
        last = now
        ok = tokens >= cost
        if ok:
            tokens -= cost
        allowed.append(ok)
        remaining.append(tokens)
    return allowed, remaining, tokens, last


def _with_micros(events: DataFrame, ts: str) -> DataFrame:
    return events.withColumn("_us", F.unix_micros(F.col(ts).cast("timestamp")))


def _episodes(
    events: DataFrame, key: str, order: list[str], capacity: float, rate: float, slice_seconds: int
) -> DataFrame:
    """Number the independent episodes of each key: after a pause long enough to
    fill an empty bucket, the bucket is full whatever happened before. Pauses are
    found per time slice, with one row per slice carrying the time across."""
    sliced = events.withColumn("_slice", F.floor(F.col("_us") / (slice_seconds * 1_000_000)))
    ends = (
        sliced.groupBy(key, "_slice")
        .agg(F.max("_us").alias("_end"))
        .select(key, "_slice", F.lag("_end").over(W.partitionBy(key).orderBy("_slice")).alias("_before"))
    )
    earlier = F.lag("_us").over(W.partitionBy(key, "_slice").orderBy(*order))
    timed = sliced.join(ends, [key, "_slice"]).withColumn("_last", F.coalesce(earlier, F.col("_before"), F.col("_last_us")))
    pause = (F.col("_us") - F.col("_last")) / 1e6
    full = F.when(pause * rate >= capacity, 1).otherwise(0)
    numbered = running_total(
        timed.withColumn("_full", full), [key], order, F.col("_slice"), F.col("_full"), "_done"
    )
    return numbered.withColumn("_episode", F.col("_done") + F.col("_full")).drop(
        "_slice", "_before", "_last", "_full", "_done"
    )


def admit(
    events: DataFrame,
    key: str,
    ts: str,
    capacity: float,
    refill_per_second: float,
    cost: float = 1.0,
    tie: list[str] | None = None,
    slice_seconds: int = SLICE_SECONDS,
    buckets: DataFrame | None = None,
) -> DataFrame:
    """Add ``allowed`` and ``remaining`` to every event of a batch table.

    Keys are cut into independent episodes that go to different tasks. Inside a
    task the sorted rows stream through the fold batch by batch with one bucket
    of state, so no group is ever held in memory. ``key`` must not be null.
    ``buckets`` (key, _tokens, _last_us) are what earlier events left; keys without
    one start full.
    """
    _check(capacity, refill_per_second)
    capacity, rate = float(capacity), float(refill_per_second)
    order = ["_us", *(tie or [])]
    timed = _with_micros(events, ts)
    if buckets is None:
        empty = {"_tokens": F.lit(None).cast("double"), "_last_us": F.lit(None).cast("bigint")}
        timed = timed.withColumns(empty)
    else:
        timed = timed.join(buckets, key, "left")
    episodes = _episodes(timed, key, order, capacity, rate, slice_seconds)
    columns = [*events.columns, "allowed", "remaining"]
    schema = (
        ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)
        + ", allowed boolean, remaining double"
    )

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens, last, current = capacity, None, None
        for batch in batches:
            allowed: list[bool] = []
            remaining: list[float] = []
            keys = list(zip(batch[key].tolist(), batch["_episode"].tolist()))
            micros = batch["_us"].tolist()
            start = 0
            while start < len(keys):
                stop = start + 1
                while stop < len(keys) and keys[stop] == keys[start]:
                    stop += 1
                if keys[start] != current:
                    tokens, last, current = capacity, None, keys[start]
                    if keys[start][1] == 0 and pd.notna(batch["_last_us"].iloc[start]):
                        tokens, last = float(batch["_tokens"].iloc[start]), int(batch["_last_us"].iloc[start])
                ok, left, tokens, last = spend(micros[start:stop], tokens, last, capacity, rate, cost)
                allowed += ok
                remaining += left
                start = stop
            yield batch.assign(allowed=allowed, remaining=remaining)[columns]

    return (
        episodes.repartition(key, "_episode")
        .sortWithinPartitions(key, "_episode", *order)
        .mapInPandas(fold, schema)
    )


@dataclass
class AdmissionStream:
    """foreachBatch target: decisions on a stream's events, by event time and then
    ``tie`` within each micro-batch, as Parquet under ``root``.

    Every batch reads the buckets that the one before left and writes its own. A
    bucket is left out once it is full again at the latest event time less
    ``lateness``: an absent bucket is a full one, so nothing changes, and what is
    handed on follows the keys in use. A replayed batch reads the same buckets
    again and overwrites its folders. Event rows of null keys are left out."""

    root: str
    key: str
    ts: str
    capacity: float
    refill_per_second: float
    cost: float = 1.0
    lateness_seconds: float = 600.0
    tie: list[str] = field(default_factory=list)
    slice_seconds: int = SLICE_SECONDS

    def __post_init__(self) -> None:
        _check(self.capacity, self.refill_per_second)

    def _buckets(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """What the newest earlier batch left: key, _tokens, _last_us, _newest_us."""
        spark, path = batch.sparkSession, f"{self.root}/buckets"
        kind = batch.schema[self.key].dataType.simpleString()
        schema = f"`{self.key}` {kind}, _tokens DOUBLE, _last_us BIGINT, _newest_us BIGINT"
        earlier = [n for n in map(_number, listed(spark, path)) if n is not None and n < batch_id]
        for old in sorted(earlier)[:-1]:
            remove(spark, f"{path}/batch_id={old}")
        return spark.read.schema(schema).parquet(f"{path}/batch_id={max(earlier)}") if earlier else spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = self._buckets(batch, batch_id)
        path = f"{self.root}/decisions/batch_id={batch_id}"
        events = batch.where(F.col(self.key).isNotNull())
        admit(
            events, self.key, self.ts, self.capacity, self.refill_per_second, self.cost, self.tie, self.slice_seconds,
            known.drop("_newest_us"),
        ).write.mode("overwrite").parquet(path)
        decided = _with_micros(spark.read.parquet(path), self.ts)
        last = F.max_by(F.struct(F.col("remaining").alias("_tokens"), F.col("_us").alias("_last_us")), F.struct("_us", *self.tie))
        now = decided.groupBy(self.key).agg(last.alias("b"), F.max("_us").alias("_newest_us")).select(self.key, "b.*", "_newest_us")
        live = known.join(now.select(self.key), self.key, "left_anti").unionByName(now)
        newest = live.agg(F.max("_newest_us")).first()[0]
        full_at = F.col("_last_us") + (self.capacity / self.refill_per_second) * 1e6
        # one row with the latest time stays even if its bucket is full
        kept = live.where((full_at > F.lit(newest) - self.lateness_seconds * 1e6) | (F.col("_newest_us") == newest))
        kept.write.mode("overwrite").parquet(f"{self.root}/buckets/batch_id={batch_id}")

    def decisions(self, spark: SparkSession) -> DataFrame:
        """All events so far with ``allowed`` and ``remaining``."""
        return spark.read.parquet(f"{self.root}/decisions").drop("batch_id")


def _number(name: str) -> int | None:
    return int(name[9:]) if name.startswith("batch_id=") else None
