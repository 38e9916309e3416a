"""Transition counts over streams of events, for directed distances that follow a log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from anisomap.session import ship

PAIRS = "user_id long, src string, dst string, ts timestamp"


def _steps(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Consecutive events of a user; the state is the user's last event."""
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    before = state.get[0] if state.exists else None
    kinds = rows["event_type"].tolist()
    state.update((kinds[-1],))
    out = pd.DataFrame({"user_id": key[0], "src": [before, *kinds[:-1]], "dst": kinds, "ts": rows["ts"].to_numpy()})
    yield out[out["src"].notna()]


def transitions(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """(user_id, src, dst, ts) for each event of a stream after a user's first, in the order in which batches bring them."""
    ship(events.sparkSession)
    e = events.select("user_id", "event_id", "event_type", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", delay)
    return e.groupBy("user_id").applyInPandasWithState(_steps, PAIRS, "last string", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(pairs: DataFrame, window: str = "1 day", delay: str = "10 minutes") -> DataFrame:
    """(start, src, dst, n) per tumbling window; late rows beyond the delay are not counted any more."""
    w = F.window("ts", window)
    return pairs.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(w.alias("w"), "src", "dst").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "src", "dst", "n")


def transition_distances(counts: DataFrame) -> DataFrame:
    """(src, dst, n, d): totals of counts, and d = -ln of the share of the source."""
    n = counts.groupBy("src", "dst").agg(F.sum("n").alias("n"))
    total = n.groupBy("src").agg(F.sum("n").alias("all"))
    return n.join(total, "src").select("src", "dst", "n", (-F.log(F.col("n") / F.col("all"))).alias("d"))
