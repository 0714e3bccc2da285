"""Streaming forms of the stateful log operators; each has a batch twin in ``plans.streams`` or ``plans.ops``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


#: ids that a source's list of seen ones holds
SEEN = 400
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_state(events: DataFrame) -> None:
    """State of several kinds and timers need this store; a session that names another keeps its own."""
    conf = events.sparkSession.conf
    name = "spark.sql.streaming.stateStore.providerClass"
    if conf.get(name, "").endswith("HDFSBackedStateStoreProvider") or not conf.get(name, ""):
        conf.set(name, _ROCKS)


def quotas(events: DataFrame, per_minute: int = 3, per_day: int = 20, late: str = "10 minutes") -> DataFrame:
    """Calls of each caller in fixed minutes and days; those over the quota are flagged."""

    def counted(span: str, most: int, form: str) -> DataFrame:
        counts = events.withWatermark("ts", late).groupBy(F.window("ts", f"1 {span}"), "user_id").agg(F.count("*").alias("calls"))
        return counts.select("user_id", F.lit(span).alias("span"), F.date_format("window.start", form).alias("begin_at"), "calls", (F.col("calls") > most).alias("over_quota"))

    return counted("minute", per_minute, "yyyy-MM-dd HH:mm").union(counted("day", per_day, "yyyy-MM-dd"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def seen_once(events: DataFrame, source: str, values: list[str], arrival: str, bound: int = SEEN) -> DataFrame:
    """source, values and arrival of the rows whose values are not among the last ``bound`` new ones of their source, in order of arrival.

    The list is the state: it never grows beyond the bound, and the oldest go first.
    """
    _with_state(events)
    schema = T.StructType([events.schema[c] for c in (source, *values, arrival)])

    class Seen(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.known = handle.getListState("seen", T.StructType([T.StructField("value", T.StringType())]))

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            known = dict.fromkeys(v for (v,) in self.known.get())
            batch = pd.concat(list(rows)).sort_values(arrival, kind="stable")
            kept = []
            for n, value in enumerate(batch[values].astype(str).agg("\x1f".join, axis=1)):
                if value not in known:
                    known[value] = None
                    kept.append(n)
                    if len(known) > bound:
                        del known[next(iter(known))]
            self.known.put([(v,) for v in known])
            yield batch.iloc[kept][[source, *values, arrival]]

        def close(self) -> None:
            pass

    return events.groupBy(source).transformWithStateInPandas(Seen(), schema, "Append", "None")


def expired(events: DataFrame, days: int = 14, late: str = "0 seconds") -> DataFrame:
    """event_id, ts of events that are ``days`` days old: each has a timer, and its state goes with it."""
    _with_state(events)

    class Retention(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle, self.at = handle, handle.getValueState("at", T.StructType([T.StructField("ts", T.TimestampType())]))

        def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
            at = max(part["ts"].max() for part in rows)
            if self.at.exists():
                at = max(at, pd.Timestamp(self.at.get()[0]))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.at.update((at.to_pydatetime(),))
            self.handle.registerTimer(int((at + pd.Timedelta(days=days)).timestamp() * 1000))
            yield pd.DataFrame({"event_id": pd.Series(dtype="int64"), "ts": pd.Series(dtype="datetime64[ns]")})

        def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
            at = self.at.get()[0]
            self.at.clear()
            yield pd.DataFrame([(key[0], at)], columns=["event_id", "ts"])

        def close(self) -> None:
            pass

    rows = events.select("event_id", "ts").withWatermark("ts", late)
    return rows.groupBy("event_id").transformWithStateInPandas(Retention(), "event_id long, ts timestamp", "Append", "EventTime")


def guarded(events: DataFrame, now: str, observed: str = "observed_at") -> DataFrame:
    """Implausible times (over 6 hours ahead, or before 1990) and missing ones give way to the observed one."""
    limit = F.lit(now).cast("timestamp") + F.expr("INTERVAL 6 HOUR")
    return events.withColumn("ts", F.when((F.col("ts") <= limit) & (F.year("ts") >= 1990), F.col("ts")).otherwise(F.col(observed)))


def incremental(events: DataFrame, keys: list[str], arrival: list[str]) -> DataFrame:
    """Only rows newer than all that their source gave before them, in order of arrival: a high-water mark for each source."""

    def newer(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values(arrival, kind="stable")
        mark = pd.Timestamp(state.get[0]) if state.exists else pd.NaT
        tops = pd.concat([pd.Series([mark]), rows["ts"]], ignore_index=True).cummax()
        before = tops.iloc[:-1].to_numpy()
        state.update((tops.iloc[-1].to_pydatetime(),))
        yield rows[pd.isna(before) | (rows["ts"].to_numpy() > before)][names]

    names = events.columns
    return events.groupBy(*keys).applyInPandasWithState(newer, events.schema, "mark timestamp", "append", GroupStateTimeout.NoTimeout)


def spend(events: DataFrame, zone: str, limit: int, late: str = "1 hour") -> DataFrame:
    """Tokens of each caller's local day, and whether they are over the limit (0: none)."""
    local = events.withColumn("local", F.from_utc_timestamp("ts", zone))
    sums = local.withWatermark("local", late).groupBy(F.window("local", "1 day"), "user_id").agg(F.sum("tokens").alias("tokens"))
    return sums.select("user_id", F.to_date("window.start").cast("string").alias("day"), "tokens", ((F.col("tokens") > limit) & F.lit(limit > 0)).alias("over_limit"))


def health(events: DataFrame) -> DataFrame:
    """user_id, failures, state after each batch: the ladder of failures as a state machine. Rows: user_id, ts, event_id,
    failed, code, retryable; times within a batch may be in any order."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, since, told = state.get if state.exists else (0, None, "ACTIVE")
        for r in pd.concat(list(parts)).sort_values(["ts", "event_id"]).itertuples():
            at = r.ts.to_pydatetime()
            since = since or at
            if not r.failed:
                failures, since, told = 0, at, "ACTIVE"
                continue
            failures += 1
            if r.code == "RATE_LIMITED":
                told = "RATE_LIMITED"
            elif not r.retryable:
                told = "QUARANTINED"
            elif failures >= 3:
                told = "QUARANTINED" if (at - since).total_seconds() >= 86_400 else "DEGRADED"
        state.update((failures, since, told))
        yield pd.DataFrame([(key[0], failures, told)], columns=["user_id", "failures", "state"])

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id long, failures long, state string", "failures long, since timestamp, state string", "update", GroupStateTimeout.NoTimeout)


def latency(events: DataFrame, length: str = "2 hours", slide: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Approximate quantiles of each operation over sliding windows."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", length, slide), "event_type").agg(F.count("*").alias("calls"), F.percentile_approx("value", [0.5, 0.95], 10_000).alias("p"))
    return found.select(F.col("window.start").alias("begin_at"), "event_type", "calls", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"))
