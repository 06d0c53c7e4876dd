"""Stateful detectors on streams of positions and errors.

Each has a batch twin in the plans; on in-order input both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GAP_SCHEMA = "vessel_id long, position_id long, gap_start timestamp, gap_end timestamp, hours double"
_GAP_STATE = "ts timestamp"


def gap_stream(positions: DataFrame, min_hours: float = 6.0, lateness: str = "2 days", forget: str = "30 days") -> DataFrame:
    """Gaps of ``min_hours`` or more between a vessel's consecutive positions.

    A micro-batch is put in event-time order per vessel. A position older than
    the vessel's last one is late and ignored; a vessel unseen for ``forget``
    past the watermark leaves the state.
    """
    forget_ms = int(pd.Timedelta(forget).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = pd.Timestamp(state.get[0]) if state.exists else None
        out = []
        for row in pd.concat(list(frames)).sort_values(["ts", "position_id"]).itertuples():
            if last is not None:
                if row.ts < last:
                    continue
                hours = (row.ts - last).total_seconds() / 3600
                if hours >= min_hours:
                    out.append((key[0], row.position_id, last, row.ts, hours))
            last = row.ts
        if last is not None:
            state.update((last.to_pydatetime(),))
            state.setTimeoutTimestamp(max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs()) + forget_ms)
        yield pd.DataFrame(out, columns=["vessel_id", "position_id", "gap_start", "gap_end", "hours"])

    rows = positions.withWatermark("ts", lateness).select("vessel_id", "position_id", "ts")
    return rows.groupBy("vessel_id").applyInPandasWithState(step, GAP_SCHEMA, _GAP_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def failure_spikes(errors: DataFrame, threshold: int = 100, window: str = "5 minutes", slide: str = "1 minute", lateness: str = "10 minutes") -> DataFrame:
    """Sliding windows in which a source has ``threshold`` failures or more."""
    counts = errors.withWatermark("ts", lateness).groupBy("source", F.window("ts", window, slide)).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= threshold).select("source", F.col("window.start").alias("began"), F.col("window.end").alias("ended"), "n")


def spike_alerts(errors: DataFrame, threshold: int = 100, window: int = 300, quiet: int = 600, lateness: str = "10 minutes", forget: str = "1 hour") -> DataFrame:
    """Alerts of sources with ``threshold`` failures in the last ``window`` seconds; a source is silent for ``quiet`` seconds after each.

    ``operators/alerts.py`` has the batch form. Failures count by whole
    seconds, taken in order once the watermark has passed them, so the state of
    a source is a count for each second of the window or still waiting, the
    time of its last alert and how far it has come. A source unheard for
    ``forget`` past the watermark leaves the state, its silence included.
    """
    forget_s = max(int(pd.Timedelta(forget).total_seconds()), window, quiet)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seconds, counts, told, done = state.get if state.exists else ([], [], None, None)
        held = {int(s): int(n) for s, n in zip(seconds, counts, strict=True)}
        if not state.hasTimedOut:
            for frame in frames:
                for s, n in frame.groupby("second").size().items():
                    if done is None or s > done:
                        held[int(s)] = held.get(int(s), 0) + int(n)
        whole = state.getCurrentWatermarkMs() // 1000 - 1  # the last second that is over
        out = []
        for s in sorted(x for x in held if x <= whole and (done is None or x > done)):
            n = sum(c for t, c in held.items() if s - window < t <= s)
            if n >= threshold and (told is None or s - told >= quiet):
                told = s
                out.append((key[0], s, n))
        done = whole if done is None else max(done, whole)
        waiting = [s for s in held if s > done]
        last = max(held, default=done)
        held = {s: n for s, n in held.items() if s > done - window}
        if not waiting and last + forget_s <= done:
            state.remove()
        else:
            state.update((sorted(held), [held[s] for s in sorted(held)], told, done))
            wake = min(waiting) + 1 if waiting else last + forget_s + 1
            state.setTimeoutTimestamp(max(wake * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["source", "second", "failures"])

    rows = errors.withWatermark("ts", lateness).select("source", "ts", F.unix_seconds("ts").alias("second"))
    state = "seconds array<long>, counts array<long>, told long, done long"
    return rows.groupBy("source").applyInPandasWithState(step, "source string, second long, failures long", state, "append", GroupStateTimeout.EventTimeTimeout)


def session_counts(events: DataFrame, gap: str = "1 hour", lateness: str = "1 day") -> DataFrame:
    """Sessions of each user, by event time."""
    s = events.withWatermark("ts", lateness).groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("began"), F.col("session_window.end").alias("closed"), "n")


def once(rows: DataFrame, keys: list[str], ts: str = "ts", lateness: str = "1 day") -> DataFrame:
    """Each key once within the lateness; older keys leave the state."""
    return rows.withWatermark(ts, lateness).dropDuplicatesWithinWatermark(keys)


def correlate(left: DataFrame, right: DataFrame, hours: int = 72) -> DataFrame:
    """Pairs of two streams on ``zone`` up to ``hours`` apart; the watermarks bound the state."""
    a = left.withWatermark("ts", f"{hours} hours").alias("a")
    b = right.withWatermark("ts", f"{hours} hours").alias("b")
    near = F.expr(f"a.zone = b.zone and b.ts >= a.ts - interval {hours} hours and b.ts <= a.ts + interval {hours} hours")
    return a.join(b, near).select("a.zone", F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), F.col("a.ts").alias("a_ts"), F.col("b.ts").alias("b_ts"))


def retries(letters: DataFrame, most: int = 3) -> DataFrame:
    """Letters that go back to their topic, with one more try counted."""
    again = (F.col("category").isin("SOURCE_UNAVAILABLE", "TIMEOUT", "RATE_LIMIT")) & (F.coalesce("_retry_count", F.lit(0)) < most) & F.col("_original_topic").isNotNull()
    return letters.where(again).withColumn("_retry_count", F.coalesce("_retry_count", F.lit(0)) + 1)
