"""Streaming ingest: upserts, best daily observations and observation memory."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rillflow.operators.windows import first_per_key
from rillflow.sources.lake import KEYS, Lake


def upsert_stream(stream: DataFrame, lake: Lake, source: str, checkpoint: str, order: str):
    """Upserts each micro-batch; of several rows for a key in one batch the last by order counts."""

    def put(batch: DataFrame, _: int) -> None:
        lake.upsert(first_per_key(batch, KEYS, [F.desc(order)]), source)

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def best_daily(stream: DataFrame, site: str, ts: str, uncertainty: str, delay: str) -> DataFrame:
    """The observation of least uncertainty of each site and day; rows later than the delay are dropped."""
    rest = [c for c in stream.columns if c not in (site,)]
    best = stream.withWatermark(ts, delay).groupBy(site, F.window(ts, "1 day")).agg(F.min_by(F.struct(*rest), F.struct(uncertainty, ts)).alias("b"))
    return best.select(site, F.to_date("window.start").alias("date"), "b.*")


class _Memory(StatefulProcessor):
    """A site's rows wait until the watermark has passed them, then come out in order with the last valid value up to each. State: rows that wait, and the last valid value with its time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, v double")
        self.last = handle.getValueState("last", "v double, t long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        self.waiting.appendList([(int(t), None if pd.isna(v) else float(v)) for t, v in zip(new["t"], new["v"], strict=True)])
        self.handle.registerTimer(_after(int(new["t"].min())))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = pd.DataFrame(list(self.waiting.get()), columns=["t", "v"]).astype({"t": "int64", "v": "float64"})
        due = rows.t < timerValues.getCurrentWatermarkInMs() * 1000
        rest = rows[~due]
        self.waiting.clear()
        if len(rest):
            self.waiting.put([(int(t), None if pd.isna(v) else float(v)) for t, v in zip(rest.t, rest.v, strict=True)])
            self.handle.registerTimer(_after(int(rest.t.min())))
        ready = rows[due].sort_values(["t", "v"], na_position="first", kind="stable")
        if not len(ready):
            return
        before = self.last.get() if self.last.exists() else (None, None)
        at = ready.t.where(ready.v.notna()).ffill().astype("Int64")
        value = ready.v.ffill()
        if before[1] is not None:
            at, value = at.fillna(before[1]), value.fillna(before[0])
        if not pd.isna(at.iloc[-1]):
            self.last.update((float(value.iloc[-1]), int(at.iloc[-1])))
        yield pd.DataFrame({"site": key[0], "t": ready.t, "last": value, "at": at})

    def close(self) -> None:
        pass


def _after(t: int) -> int:
    """The first whole millisecond behind a time in microseconds."""
    return t // 1000 + 1


def memory_stream(stream: DataFrame, site: str, ts: str, value: str, delay: str = "1 day") -> DataFrame:
    """site, ts, last and staleness_days: the last valid value up to each row, per site in state. Rows may come in any order and in any micro-batch.

    A row comes out once the watermark, the latest time less the delay, has passed it; until then it waits in state, which the delay bounds. Later rows are dropped. Of rows of one site and instant,
    missing values come first, then smaller ones. Runs in append mode on the RocksDB state store, which it sets for the session.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select(F.col(site).cast("string").alias("site"), F.col(ts).cast("timestamp").alias("ts"), F.col(value).cast("double").alias("v"))
    rows = rows.withColumn("v", F.when(~F.isnan("v"), F.col("v"))).where("ts IS NOT NULL").withWatermark("ts", delay).withColumn("t", F.unix_micros("ts"))
    out = rows.groupBy("site").transformWithStateInPandas(_Memory(), "site string, t long, last double, at long", "append", "eventtime")
    return out.select("site", F.timestamp_micros("t").alias("ts"), "last", ((F.col("t") - F.col("at")) / 86400e6).alias("staleness_days"))
