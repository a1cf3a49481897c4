"""A stepped production as a stateful stream: one cursor a book, moved by signals and by the clock.

A book goes through ``STEPS``. Each signal about it is one of ``MOVES``: done goes on to the next step; back goes to an earlier one, a
bounded number of times; wait says that the work is still under way; failed starts the step once more, and holds the book when it has
failed as often as it may; go takes a held book on from where it stood. A step that hears nothing for ``QUIET`` is held by the clock.

The rules are one plain function of a state and a signal. The stream keeps the state of each book with ``transformWithState`` and a timer for
the clock, in event time: a signal later than the deadline finds the book held already, so it does not matter in which micro-batch a
signal comes, nor whether the timer fires before or after one that is later. ``replay`` runs the same over a table.

A book's signals of one micro-batch are sorted in memory; the source's limits on a micro-batch bound that. State is a few numbers a book.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..plans.registry import Registry
from ..session import shared_folder, table
from .events import stream

R = Registry()

# The steps in order, how often a step is started, and how often corrections send a book back.
STEPS = ("source", "probe", "write", "levels", "mend", "audit", "settle", "verdict", "promote")
STARTS, ROUNDS = 2, 5
QUIET = 3 * 86_400_000  # milliseconds of event time
#: What the ledger's events say about a book's current step.
MOVES = {"click": "done", "view": "wait", "error": "failed", "signup": "back", "purchase": "go"}
BACK_TO = "levels"

STATE = "step int, starts int, rounds int, held string, since long, moves long"
LOG = "book long, at long, event long, step string, move string, note string"


@dataclass(frozen=True)
class Cursor:
    step: int = 0
    starts: int = 1
    rounds: int = 0
    held: str = ""
    since: int = 0
    moves: int = 0

    @property
    def running(self) -> bool:
        return not self.held and self.step < len(STEPS)

    @property
    def name(self) -> str:
        return STEPS[self.step] if self.step < len(STEPS) else "ready"


def expire(now: Cursor, at: int) -> tuple[Cursor, int] | None:
    """The cursor held by the clock and when, if its step was quiet for too long by then."""
    due = now.since + QUIET
    return (replace(now, held="quiet", since=due, moves=now.moves + 1), due) if now.running and at > due else None


def advance(now: Cursor, at: int, move: str) -> tuple[Cursor, str]:
    """The cursor after a signal, and what happened."""
    then = replace(now, since=at, moves=now.moves + 1)
    if now.step >= len(STEPS):
        return now, "ready already"
    if now.held:
        return (replace(then, held="", starts=1), "taken on") if move == "go" else (now, "held")
    if move == "done":
        return replace(then, step=now.step + 1, starts=1), "next"
    if move == "back" and now.step > STEPS.index(BACK_TO):
        if now.rounds >= ROUNDS:
            return replace(then, held="rounds"), "rounds used up"
        return replace(then, step=STEPS.index(BACK_TO), starts=1, rounds=now.rounds + 1), "sent back"
    if move == "failed":
        return (replace(then, starts=now.starts + 1), "started again") if now.starts < STARTS else (replace(then, held="failed"), "held after failures")
    return replace(now, since=at), "waits"


def follow(now: Cursor | None, signals: list[tuple[int, int, str]]) -> Iterator[tuple[Cursor, tuple]]:
    """(cursor after it, (at, event, step, move, note)) of each signal (at, event, move), in order, and of what the clock did before it."""
    for at, event, move in signals:
        now = now or Cursor(since=at)
        if late := expire(now, at):
            yield late[0], (late[1], None, now.name, "clock", "quiet for too long")
            now = late[0]
        step = now.name
        now, note = advance(now, at, move)
        yield now, (at, event, step, move, note)


class Production(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cursor = handle.getValueState("cursor", STATE)

    def _timer(self, cursor: Cursor) -> None:
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if cursor.running:
            self.handle.registerTimer(cursor.since + QUIET + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        signals = sorted(s for frame in rows for s in zip(frame["at_ms"].tolist(), frame["event"].tolist(), frame["move"].tolist(), strict=True))
        now = Cursor(*self.cursor.get()) if self.cursor.exists() else None
        log = []
        for now, line in follow(now, signals):
            log.append((key[0], *line))
        if now is not None:
            self.cursor.update(astuple(now))
            self._timer(now)
        yield frame_of(log)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = Cursor(*self.cursor.get())
        if late := expire(now, expiredTimerInfo.getExpiryTimeInMs()):
            self.cursor.update(astuple(late[0]))
            yield frame_of([(key[0], late[1], None, now.name, "clock", "quiet for too long")])

    def close(self) -> None:
        pass


def frame_of(log: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(log, columns=[f.split()[0] for f in LOG.split(", ")])
    return frame.astype({"book": "int64", "at": "int64", "event": "Int64"})


def signals(events: DataFrame) -> DataFrame:
    """events(user_id, event_id, event_type, at) -> book, event, move, at, at_ms."""
    known = F.create_map(*[F.lit(x) for kv in MOVES.items() for x in kv])
    return events.select(F.col("user_id").alias("book"), F.col("event_id").alias("event"), F.coalesce(F.try_element_at(known, "event_type"), F.lit("wait")).alias("move"), "at", F.unix_millis("at").alias("at_ms"))


def produce(moves: DataFrame) -> DataFrame:
    """A stream of signals with a watermark on at -> LOG, as a stream."""
    return moves.groupBy("book").transformWithStateInPandas(Production(), LOG, "Append", "EventTime")


PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def run(spark: SparkSession, log: DataFrame, folder: str) -> None:
    """Everything that has come by now; a later call with the same folder goes on from there."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # a query keeps the settings it was started with
        query = log.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/log").format("parquet").trigger(availableNow=True).start()
    finally:
        spark.conf.set(PROVIDER, before)
    query.awaitTermination()


def replay(moves: DataFrame, upto: int) -> DataFrame:
    """A table of signals -> LOG, with what the clock has done up to a time in milliseconds."""

    def book(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        log, now = [], None
        for now, line in follow(None, sorted(zip(frame["at_ms"].tolist(), frame["event"].tolist(), frame["move"].tolist(), strict=True))):
            log.append((key[0], *line))
        if now is not None and (late := expire(now, upto)):
            log.append((key[0], late[1], None, now.name, "clock", "quiet for too long"))
        return frame_of(log)

    return moves.groupBy("book").applyInPandas(book, LOG)


@R.query("STRM-05 STRM-03")
def stepped_production(spark, sf_dir):
    """What happened to each book, signal by signal, from a stream of the ledger's events."""
    folder = f"{shared_folder(spark)}/folioflow/production-{uuid.uuid4().hex}"
    run(spark, produce(signals(stream(spark, sf_dir))), folder)
    log = spark.read.schema(LOG).parquet(f"{folder}/log")
    return log.select("book", F.timestamp_millis("at").cast("timestamp_ntz").alias("at"), "event", "step", "move", "note")
