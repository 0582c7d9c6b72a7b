"""Live state of chat sessions: readable after every turn, gone two hours after the last one."""

from __future__ import annotations

import contextlib
import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from shelfspark.streaming.keyed_table import KeyedTable

TTL = datetime.timedelta(hours=2)
ITEMS = 20
FACTS = ("brand", "max_price", "city")
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def state_schema(facts: tuple[str, ...] = FACTS) -> str:
    told = "".join(f", fact_{n} string" for n in facts)
    return f"session_id string, started timestamp, updated timestamp, user_message string, assistant_message string, results array<string>{told}, turns bigint, expired boolean"


class LiveSession(StatefulProcessor):
    """One session: messages and results of the last turn, merged facts, a timer two hours behind the last turn."""

    def __init__(self, facts: tuple[str, ...] = FACTS, ttl: datetime.timedelta = TTL) -> None:
        self.facts, self.ttl = facts, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        told = "".join(f", f_{n} string, at_{n} timestamp, by_{n} bigint" for n in self.facts)
        self.state = handle.getValueState(
            "session", f"started timestamp, updated timestamp, turn bigint, user_message string, assistant_message string, results array<string>, turns bigint{told}"
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        turns = pd.concat(list(rows)).sort_values(["ts", "turn_id"], kind="stable")  # one session's turns of one batch
        now = self._load()
        for turn in turns.itertuples(index=False):
            at = (turn.ts, int(turn.turn_id))
            if now is None or turn.ts > now["updated"] + self.ttl:
                now = {"started": turn.ts, "updated": turn.ts, "turn": -1, "turns": 0, "last": None, "facts": {}}
            now["turns"] += 1
            now["started"] = min(now["started"], turn.ts)
            if at >= (now["updated"], now["turn"]):
                now["updated"], now["turn"] = at
                now["last"] = (turn.user_message, turn.assistant_message, list(turn.results)[:ITEMS] if turn.results is not None else None)
            for name, value in dict(turn.facts or {}).items():
                if name in self.facts and value and (name not in now["facts"] or at >= now["facts"][name][1:]):
                    now["facts"][name] = (value, *at)
        self._save(now)
        yield self._row(key, now, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = self._load()
        if now is not None and int((now["updated"] + self.ttl).timestamp() * 1000) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
            yield self._row(key, now, True)

    def close(self) -> None:
        pass

    def _load(self) -> dict | None:
        if not self.state.exists():
            return None
        started, updated, turn, user, assistant, results, turns, *told = self.state.get()
        kept = {n: (v, pd.Timestamp(at), by) for n, v, at, by in zip(self.facts, told[::3], told[1::3], told[2::3]) if v is not None}
        return {"started": pd.Timestamp(started), "updated": pd.Timestamp(updated), "turn": turn, "turns": turns, "last": (user, assistant, results), "facts": kept}

    def _save(self, now: dict) -> None:
        plain = lambda t: None if t is None else t.to_pydatetime()
        kept = [now["facts"].get(n, (None, None, None)) for n in self.facts]
        told = [x for value, at, by in kept for x in (value, plain(at), by)]
        user, assistant, results = now["last"]
        results = None if results is None else [str(x) for x in results]
        self.state.update((plain(now["started"]), plain(now["updated"]), now["turn"], user, assistant, results, now["turns"], *told))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((now["updated"] + self.ttl).timestamp() * 1000))

    def _row(self, key, now: dict, expired: bool) -> pd.DataFrame:
        user, assistant, results = now["last"]
        row = {"session_id": key[0], "started": now["started"], "updated": now["updated"], "user_message": user, "assistant_message": assistant, "results": results}
        row |= {f"fact_{n}": now["facts"].get(n, (None,))[0] for n in self.facts}
        return pd.DataFrame([row | {"turns": now["turns"], "expired": expired}])


def live_states(events: DataFrame, watermark: str = "1 hour", facts: tuple[str, ...] = FACTS, ttl: datetime.timedelta = TTL) -> DataFrame:
    """Changes of session states: a row per session and batch that has turns of it, and one when it expires.

    ``events`` is a stream like that of ``session_state``. Expiry is in event time, once
    the watermark has passed the last turn by ``ttl``.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("session_id", F.col("session_id").cast("string")).withWatermark("ts", watermark)
    return timed.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=LiveSession(facts, ttl), outputStructType=state_schema(facts), outputMode="Update", timeMode="EventTime"
    )


def newest_state(rows: DataFrame) -> DataFrame:
    """One row per session: that of the last batch."""
    values = [c for c in rows.columns if c != "session_id"]
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*values), F.struct("batch", "expired", "updated", "turns")).alias("v")).select("session_id", "v.*").select(*rows.columns)


def session_table(spark: SparkSession, folder: str, facts: tuple[str, ...] = FACTS) -> KeyedTable:
    schema = spark.createDataFrame([], state_schema(facts) + ", batch bigint").schema
    return KeyedTable(spark, folder, schema, ["session_id"], newest_state)


def live(table: KeyedTable) -> DataFrame:
    """States of the sessions that have not expired."""
    return table.read().where("NOT expired").drop("expired", "batch")


@contextlib.contextmanager
def state_store(spark: SparkSession):
    """Timers need the state store on RocksDB; what was set before comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


def run_live(events: DataFrame, table: KeyedTable, checkpoint: str, watermark: str = "1 hour", facts: tuple[str, ...] = FACTS, ttl: datetime.timedelta = TTL) -> None:
    """Drain what the source holds now into the table of live states."""
    changes = live_states(events, watermark, facts, ttl)
    sink = lambda batch, number: table.add(batch.withColumn("batch", F.lit(number).cast("bigint")), number)
    with state_store(events.sparkSession):
        query = changes.writeStream.trigger(availableNow=True).outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(sink).start()
        query.awaitTermination()
