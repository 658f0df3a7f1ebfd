"""Incremental daily counts: a watermark as long as counts may still be revised, and an idempotent sink."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.dates import VOLATILE_DAYS


def daily_counts(events: DataFrame, key: str, ts: str = "ts", late: str = f"{VOLATILE_DAYS} days") -> DataFrame:
    """``(<key>, day, views)`` per day of event time, for a stream as for a table. A timestamp without zone is UTC. Events of a null
    key or time are left out; on a stream, days are emitted once the watermark has passed them."""
    rows = events.select(key, F.col(ts).cast("timestamp").alias("_ts")).where(F.col(key).isNotNull() & F.col("_ts").isNotNull())
    if events.isStreaming:
        rows = rows.withWatermark("_ts", late)
    days = rows.groupBy(key, F.window("_ts", "1 day").alias("_w")).agg(F.count("*").alias("views"))
    return days.select(key, F.to_date("_w.start").alias("day"), "views")


def upsert_days(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes closed days to ``path`` by day; a batch that is repeated after a failure replaces its days, so none count twice."""

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)

    return counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()


def rolling_totals(days: DataFrame, key: str, window: int = 7) -> DataFrame:
    """``(<key>, day, views, total, average, complete)`` of a stream of closed days ``(<key>, day, views)``, read from where :func:`upsert_days` writes them: for each
    day the total over the trailing ``window`` days, days that never came counting as 0. State is the last ``window`` days of a
    key. Days of one batch are taken in order; one that comes when later days were emitted gives its own row, of the days
    that are still kept, and ``complete`` says whether all before it were."""

    def step(k: tuple, batches, state):
        held = dict(zip(*state.get)) if state.exists else {}
        rows = sorted((d, v) for b in batches for d, v in zip(b["day"], b["views"]))
        out = []
        for day, v in rows:
            held[day] = held.get(day, 0) + int(v)
            first = day - timedelta(days=window - 1)
            total = sum(n for d, n in held.items() if first <= d <= day)
            out.append((k[0], day, held[day], total, total / window, max(held) == day))
            last = max(held)
            held = {d: n for d, n in held.items() if d > last - timedelta(days=window)}
        state.update((list(held), list(held.values())))
        yield pd.DataFrame(out, columns=[key, "day", "views", "total", "average", "complete"])

    kind = days.schema[key].dataType.simpleString()
    return days.select(key, "day", "views").groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, day date, views bigint, total bigint, average double, complete boolean", "days array<date>, views array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
