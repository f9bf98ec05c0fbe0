"""Sliding-window request counts, quotas and response caches over event tables.

A pool may hold a large share of all requests, so windows run per pool and time slice. A row is repeated in
the next slice only while it still counts there; with slices as long as the window that is at most once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.session import small_frame

#: Requests and seconds of a pool without an entry of its own.
DEFAULT_LIMIT, DEFAULT_WINDOW = 60, 60


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _sliced(df: DataFrame, pool: str, ts: str, window: int, slices_per_window: float = 1.0) -> tuple[DataFrame, int]:
    """Rows under every slice in which they count: ``_t`` (micros), ``_slice``, ``_own``."""
    width = max(int(window * 1_000_000 / slices_per_window), window * 1_000_000)
    t = micros(ts)
    own = F.floor(t / width)
    last = F.floor((t + window * 1_000_000) / width)
    spread = df.withColumn("_t", t).withColumn("_slice", F.explode(F.sequence(own, last)))
    return spread.withColumn("_own", F.col("_slice") == F.floor(F.col("_t") / width)), width


def rolling_count(df: DataFrame, pool: str, ts: str, window: int, inclusive: bool = True, name: str = "requests") -> DataFrame:
    """Adds the requests of the pool in the trailing window, this one included.

    ``inclusive``: a request exactly ``window`` seconds old still counts.

    Each request comes in at its time and goes out when it no longer counts. What is inside is a running sum of both, and the
    oldest of it the next to go out, so a row is read a fixed number of times however many others its window holds.
    """
    spread, _ = _sliced(df, pool, ts, window)
    reach = window * 1_000_000 - (0 if inclusive else 1)
    t = F.col("_t")
    moves = spread.withColumn("_step", F.explode(F.array(F.lit(1), F.lit(-1))))
    comes = F.col("_step") == 1
    given = comes & F.col("_own")
    moves = moves.select(
        # Only requests of the slice itself are given back, so only those carry their columns.
        *[F.when(given, F.col(f"`{c}`")).alias(c) for c in df.columns], F.col(f"`{pool}`").alias("_pool"), "_slice", "_step",
        given.alias("_given"), F.when(comes, t).otherwise(t + reach + 1).alias("_t"),
        F.when(comes, t).otherwise(t + reach).alias("_until"), F.when(~comes, t).alias("_since"),
    )
    place = Window.partitionBy("_pool", "_slice")
    counted = moves.withColumn(name, F.sum("_step").over(place.orderBy("_t").rangeBetween(Window.unboundedPreceding, 0)))
    # From the end backwards: the smallest of the times that are to go out still.
    counted = counted.withColumn("_oldest", F.min("_since").over(place.orderBy(F.desc("_until")).rangeBetween(Window.unboundedPreceding, 0)))
    return counted.filter("_given").drop("_pool", "_slice", "_step", "_given", "_until", "_since")


def quotas(
    df: DataFrame, pool: str, ts: str, limits: Sequence[tuple[str, int, int]] = (),
    default_limit: int = DEFAULT_LIMIT, default_window: int = DEFAULT_WINDOW,
) -> DataFrame:
    """Per request: ``requests, remaining, reset_seconds`` under the limit of its pool.

    ``limits`` holds ``(pool, limit, seconds)``. Pools with equal windows share one pass.
    """
    windows = sorted({w for _, _, w in limits} | {default_window})
    rows = [(p, lim, w) for p, lim, w in limits]
    config = small_frame(df.sparkSession, rows, f"`{pool}` string, _limit int, _window int") if rows else None
    tagged = df.join(config, pool, "left") if config is not None else df.withColumns(
        {"_limit": F.lit(None).cast("int"), "_window": F.lit(None).cast("int")})
    tagged = tagged.withColumns({
        "_limit": F.coalesce("_limit", F.lit(default_limit)), "_window": F.coalesce("_window", F.lit(default_window))})
    out = None
    for window in windows:
        part = rolling_count(tagged.filter(F.col("_window") == window), pool, ts, window)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("remaining", F.greatest(F.col("_limit") - F.col("requests"), F.lit(0))).withColumn(
        "reset_seconds",
        F.greatest((F.col("_oldest") + F.col("_window") * F.lit(1_000_000).cast("long") - F.col("_t")) / 1e6, F.lit(0.0)),
    ).drop("_t", "_oldest", "_limit", "_window")


def islands(df: DataFrame, key: str, ts: str, gap: int) -> DataFrame:
    """Adds ``_island``: numbers stretches of a key between which at least ``gap`` seconds are empty.

    Time is cut into slots of ``gap`` seconds. An empty slot between two used ones means a pause of at least
    ``gap``. Only the used slots of a key are numbered, not its rows.
    """
    width = gap * 1_000_000
    slotted = df.withColumn("_slot", F.floor(micros(ts) / width))
    used = slotted.groupBy(key, "_slot").agg(F.count("*").alias("_n")).drop("_n")
    w = Window.partitionBy(key).orderBy("_slot")
    fresh = F.coalesce(F.col("_slot") - F.lag("_slot").over(w) > 1, F.lit(True))
    numbered = used.withColumn("_fresh", fresh.cast("long")).withColumn("_island", F.sum("_fresh").over(w)).drop("_fresh")
    return slotted.join(numbered, [key, "_slot"]).drop("_slot")


def _walk(batches: Iterator[pd.DataFrame], key: str, step) -> Iterator[pd.DataFrame]:
    """Rows sorted by key, island and time, one batch at a time; ``step`` carries a small state per island."""
    here, state = None, None
    for batch in batches:
        flags = []
        for k, island, t in zip(batch[key].tolist(), batch["_island"].tolist(), batch["_t"].tolist()):
            if (k, island) != here:
                here, state = (k, island), None
            flag, state = step(state, t)
            flags.append(flag)
        batch["flag"] = flags
        yield batch


def _sequential(df: DataFrame, key: str, ts: str, tie: str, gap: int, step, flag: str) -> DataFrame:
    """Runs ``step`` over each island in time order without collecting it: a task sees one batch at a time."""
    ready = islands(df, key, ts, gap).withColumn("_t", micros(ts))
    placed = ready.repartition(key, "_island").sortWithinPartitions(key, "_island", "_t", tie)
    schema = T.StructType([*placed.schema.fields, T.StructField("flag", T.BooleanType())])
    out = placed.mapInPandas(lambda batches: _walk(batches, key, step), schema)
    return out.withColumnRenamed("flag", flag).drop("_t", "_island")


def admitted(df: DataFrame, pool: str, ts: str, tie: str, limit: int, window: int) -> DataFrame:
    """Adds ``admitted``: a request passes if fewer than ``limit`` admitted ones are in the trailing window.

    The state is the admitted times still in the window, at most ``limit`` of them. A pause longer than the
    window empties it, so stretches between pauses are independent.
    """
    reach = window * 1_000_000

    def step(state, t):
        recent = [s for s in (state or []) if t - s <= reach]
        if len(recent) < limit:
            return True, [*recent, t]
        return False, recent

    # A request exactly one window old still counts, so a pause must be longer than that.
    return _sequential(df, pool, ts, tie, window + 1, step, "admitted")


def cached(df: DataFrame, key: str, ts: str, tie: str, ttl: int = 300) -> DataFrame:
    """Adds ``fetched``: the request that fills the cache; later ones within ``ttl`` seconds are served from it.

    The entry expires ``ttl`` seconds after it was stored, however often it is read.
    """
    life = ttl * 1_000_000

    def step(state, t):
        return (False, state) if state is not None and state > t else (True, t + life)

    return _sequential(df, key, ts, tie, ttl, step, "fetched")


def live_entries(fetched: DataFrame, key: str, ts: str, now: str, ttl: int = 300) -> DataFrame:
    """Entries of a cache that have not expired at ``now``, and when they do: ``key, expires``."""
    stored = fetched.filter("fetched").filter(F.col(ts) <= F.lit(now).cast("timestamp_ntz"))
    last = stored.groupBy(key).agg(F.max(ts).alias("stored"))
    expires = F.col("stored") + F.make_dt_interval(secs=F.lit(ttl))
    return last.select(key, expires.alias("expires")).filter(F.col("expires") > F.lit(now).cast("timestamp_ntz"))
