"""Structured Streaming: polling ingest, daily series, deduplication, session state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from opinara.functions import routing
from opinara.storage import exists, scratch

TTL_SECONDS = 3600
HISTORY_TURNS = 10


def poll(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str, keys: list[str], interval: str | None = "30 seconds", by: str | None = None) -> StreamingQuery:
    """Appends what arrives in folder to target, without rows whose keys target has; None takes what is there and ends.

    by: a column by which target is partitioned and which is part of what makes rows equal (a day); a batch then reads only
    the partitions it has rows of. The checkpoint and the target's own rows make a repeated batch add nothing.
    """
    own = [*keys, *([by] if by and by not in keys else [])]

    def write(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(own)
        if exists(batch.sparkSession, target):
            known = batch.sparkSession.read.parquet(target)
            if by:
                known = known.join(batch.select(by).distinct(), by, "left_semi")  # a batch has few days: other partitions are pruned as the join runs
            new = new.join(known.select(*own), own, "left_anti")
        writer = new.write.mode("append")
        (writer.partitionBy(by) if by else writer).parquet(target)

    source = spark.readStream.schema(schema).parquet(folder)
    writer = source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


class Poller:
    """Starts, stops and tells the state of a polling query. Without a restart a failed one stays failed, with its error."""

    def __init__(self, start: Callable[[], StreamingQuery]) -> None:
        self._start, self.query = start, None

    def start(self) -> bool:
        """False if it runs already."""
        if self.query is not None and self.query.isActive:
            return False
        self.query = self._start()
        return True

    def stop(self) -> bool:
        if self.query is None or not self.query.isActive:
            return False
        self.query.stop()
        return True

    def status(self) -> dict[str, Any]:
        if self.query is None:
            return {"running": False, "batches": 0, "error": None}
        last, failed = self.query.lastProgress, self.query.exception()
        return {"running": self.query.isActive, "batches": 0 if last is None else last["batchId"] + 1, "error": None if failed is None else str(failed)}


def daily_series(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Count and mean of each day; in append mode a day comes once the watermark has passed it."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("runs"), F.avg("value").alias("avg_confidence")).select(F.to_date("window.start").alias("date"), "runs", "avg_confidence")


def distinct_events(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def sessions(turns: DataFrame, expire: bool = True, limit: int = HISTORY_TURNS) -> DataFrame:
    """Of turns (session_id, ts, role, said, entity): the last 2 * limit of them in order of ts (history, kept), and the entity
    that the latest turn with one names. Turns may come in any order and in any batch.

    State goes TTL_SECONDS after a session's last turn, by the clock; a replay of past turns, which ends, doesn't expire.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, said, at, entity = state.get if state.exists else ([], [], None, "")
        turns_, at = list(zip(times, said)), None if at is None or pd.isna(at) else at
        for rows in batches:
            turns_ += zip(map(int, rows["ts"]), rows["said"])
            for ts, name in zip(rows["ts"], rows["entity"]):
                if name and (at is None or ts >= at):
                    at, entity = int(ts), name
        turns_ = sorted(turns_)[-2 * limit :]
        state.update(([t for t, _ in turns_], [s for _, s in turns_], at, entity))
        if expire:
            state.setTimeoutDuration(TTL_SECONDS * 1000)
        yield pd.DataFrame({"session_id": [key[0]], "kept": [len(turns_)], "entity": [entity], "history": [[s for _, s in turns_]]})

    rows = turns.select("session_id", F.col("ts").cast("long").alias("ts"), "role", F.coalesce("said", F.lit("")).alias("said"), "entity")
    kept = "times array<long>, said array<string>, at long, entity string"
    return rows.groupBy("session_id").applyInPandasWithState(step, "session_id long, kept int, entity string, history array<string>", kept, "update", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout)


_LAST = "intent string, entity_kind string, entities array<string>, at long"
_ANSWERED = "session_id long, ts long, intent string, entity_kind string, entities array<string>, confidence double, history int"


def inherited(asked: Row, more: bool, late: list[str], last: tuple[str | None, str | None, list[str]]) -> tuple[str, str | None, list[str], float]:
    """What a question asks for, with what it lacks from the session's last intent, kind and entities, as routing.in_session
    fills it in: asked is routing.intent's struct, more is_continued, late what the question names in quotes or after a key."""
    name, kind, entities, sure = asked["intent"], asked["entity_kind"] or last[1], list(asked["entities"]), asked["confidence"]
    if name == "fallback" and not entities and not more:
        entities = list(last[2])
    if more and last[0]:
        named = bool(entities) and name in ("fallback", "rag_search")
        if name == "fallback":
            name, sure = last[0], max(sure, 0.7)
        if named and (asked["intent"] == "rag_search" or last[0] in ("fallback", "rag_search")):
            name, sure = last[0], max(sure, 0.75)
    if name != "fallback" and not entities:
        entities = list(late)
    return name, kind, entities, sure


class Dialogue(StatefulProcessor):
    """A session's state: its last turns as a list, what it last asked for as a value. Both go ttl seconds after their last use, by
    the clock; a turn that comes later than ttl after the one before, by its own time, finds a new session too."""

    def __init__(self, ttl: int, limit: int, expire: bool) -> None:
        self.ttl, self.limit, self.expire = ttl, limit, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        life = self.ttl * 1000 if self.expire else None
        self.last = handle.getValueState("last", _LAST, life)
        self.history = handle.getListState("history", "ts long, role string, said string", life)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timer: Any) -> Iterator[Row]:
        last = tuple(self.last.get()) if self.last.exists() else (None, None, [], None)
        history = [tuple(r) for r in self.history.get()]
        for r in sorted(rows, key=lambda r: (r["ts"], r["said"])):
            if last[3] is not None and r["ts"] - last[3] > self.ttl:
                last, history = (None, None, [], None), []
            history = [*history, (r["ts"], r["role"], r["said"])][-2 * self.limit :]
            if r["asked"] is None:
                last = (*last[:3], r["ts"])
                continue
            name, kind, entities, sure = inherited(r["asked"], r["more"], r["late"], last[:3])
            last = (name if name != "fallback" else last[0], kind or last[1], entities or last[2], r["ts"])
            yield Row(session_id=key[0], ts=r["ts"], intent=name, entity_kind=kind, entities=entities, confidence=sure, history=len(history))
        self.last.update(last)
        self.history.put(history)

    def close(self) -> None:
        pass


def dialogues(turns: DataFrame, expire: bool = True, ttl: int = TTL_SECONDS, limit: int = HISTORY_TURNS) -> DataFrame:
    """Of a stream of turns (session_id, ts, role, said), what each of the user's asks for: (session_id, ts, intent, entity_kind,
    entities, confidence, history), history being the number of turns that the session keeps, this one included.

    What a question lacks comes from the turns before it, in whichever batch they came: a fallback is not remembered, nor are no
    entities. Intents are columns; the state's code gets their small results, a batch's turns of a session in order of ts. Turns of
    a later batch come after those of an earlier one. A replay of past turns has expire=False: by the clock it wouldn't expire as
    its turns say, and a query whose state does goes on without rows, past availableNow. Sets the session's state store to RocksDB.
    """
    turns.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    said = F.coalesce("said", F.lit(""))
    rows = turns.select(
        F.col("session_id").cast("long").alias("session_id"), F.coalesce(F.col("ts").cast("long"), F.lit(0)).alias("ts"), "role", said.alias("said"),
        F.when(F.col("role") == "user", routing.intent(said)).alias("asked"), routing.is_continued(said).alias("more"), routing.named_late(said).alias("late"),
    )
    mode = "ProcessingTime" if expire else "None"
    return rows.groupBy("session_id").transformWithState(Dialogue(ttl, limit, expire), _ANSWERED, "append", mode)


def run_to_table(spark: SparkSession, stream: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """What a stream over what is there now leaves, as a table in the shared folder; of rows with equal keys the last batch's.

    Each batch writes a folder of its own, over what a failed try of it has left, so that a repeated one adds nothing."""
    path = scratch(spark, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/_batch={number}")

    writer = stream.writeStream.outputMode("append" if keys is None else "update").option("checkpointLocation", f"{path}/checkpoint")
    writer.foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    table = spark.read.schema(f"{stream.schema.toDDL()}, _batch long").parquet(f"{path}/table")
    if keys is None:
        return table.drop("_batch")
    rest = [c for c in table.columns if c not in (*keys, "_batch")]
    last = F.max_by(F.struct(*rest), "_batch").alias("_last")
    return table.groupBy(*keys).agg(last).select(*keys, "_last.*")
