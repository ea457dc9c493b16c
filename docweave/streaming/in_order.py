"""Streams whose rows of a key count in the order of event time, whatever the order of their arrival.

A key's rows wait in its state until the watermark has passed them; a timer then releases them in order of
(ms, id), so many micro-batches of shuffled files give what a sorted batch gives.  State holds what arrived
within the watermark's delay, and the fold's own value.  Rows later than the watermark are dropped.  Needs the
RocksDB state store, and a column ``ts`` with a watermark.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from docweave.functions.text import squeeze
from docweave.operators.conversations import citation_id, conversation_title

#: The rows of a key that came in one micro-batch, as JSON: [[ms, id, [fields]]].
WAITING = StructType([StructField("said", StringType())])


def missing(value) -> bool:
    return value is None or value != value


class InOrder(StatefulProcessor):
    """A fold over a key's rows: ``step`` takes the state (None at first) and a row, and gives the next state and rows to emit."""

    #: Columns of a row beside ms and id, and of what is emitted behind the key.
    fields: tuple[str, ...] = ()
    emits: tuple[str, ...] = ()

    def step(self, state, ms: int, number: int, *row) -> tuple[object, list[tuple]]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.state = handle.getValueState("state", StructType([StructField("said", StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = []
        for batch in rows:
            columns = [batch["ms"].tolist(), batch["id"].tolist(), *([None if missing(v) else v for v in batch[f].tolist()] for f in self.fields)]
            some += zip(*columns)
        first = int(min(r[0] for r in some))
        # one entry for what a key gets in a micro-batch, as each costs a call to the store
        self.waiting.appendList([(json.dumps([(int(ms), int(n), own) for ms, n, *own in some]),)])
        self.handle.registerTimer(first)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = max(timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())
        rows = sorted((r for (said,) in self.waiting.get() for r in json.loads(said)), key=lambda r: (r[0], r[1], json.dumps(r[2])))
        ready = [r for r in rows if r[0] <= upto]
        if not ready:  # an earlier timer has released them
            return
        left = rows[len(ready) :]
        held = self.state.get()
        state, out = json.loads(held[0]) if held else None, []
        for ms, number, own in ready:
            state, more = self.step(state, ms, number, *own)
            out += more
        if left:
            self.waiting.put([(json.dumps(left),)])
            self.handle.registerTimer(left[0][0])
        else:
            self.waiting.clear()
        if state is not None:
            self.state.update((json.dumps(state),))
        elif held:
            self.state.clear()
        if out:
            yield self.told(key, out)

    def told(self, key: tuple, rows: list[tuple]) -> pd.DataFrame:
        made = pd.DataFrame(rows, columns=list(self.emits), dtype=object)
        made.insert(0, "key", pd.Series([key[0]] * len(rows), dtype=object))
        return made

    def close(self) -> None:
        pass


def folded(rows: DataFrame, processor: InOrder, emits: str) -> DataFrame:
    """Rows of (key, ts, ms, id and the processor's fields) through it."""
    kind = dict(rows.dtypes)["key"]
    return rows.select("key", "ts", "ms", "id", *processor.fields).groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=f"key {kind}, {emits}", outputMode="Append", timeMode="EventTime"
    )


class Limit(InOrder):
    """A fixed window that begins with the first request which finds none open."""

    emits = ("request_id", "ms", "allowed", "retry_after_ms")

    def __init__(self, most: int, window_ms: int):
        self.most, self.window_ms = most, window_ms

    def step(self, state, ms, number):
        count, reset = state or (0, ms)
        if reset <= ms:
            return (1, ms + self.window_ms), [(number, ms, True, 0)]
        if count < self.most:
            return (count + 1, reset), [(number, ms, True, 0)]
        return (count, reset), [(number, ms, False, max(1, reset - ms))]


def rate_limit_stream(requests: DataFrame, most: int = 20, window_ms: int = 60_000) -> DataFrame:
    """The decisions of ``logs.rate_limit_replay`` for a stream of (request_id, key, ts) with a watermark on ts."""
    rows = requests.withColumns({"ms": F.unix_millis("ts"), "id": F.col("request_id").cast("long")})
    return folded(rows, Limit(most, window_ms), "request_id long, ms long, allowed boolean, retry_after_ms long")


class History(InOrder):
    """A conversation's title, time and toggles; each release emits how it stands."""

    fields = ("type", "title", "name")
    emits = ("ms", "event_id", "exists", "title", "updated_ms", "pinned", "archived")

    def step(self, state, ms, number, kind, title, name):
        if kind == "delete":
            return None, [(ms, number, False, None, None, None, None)]
        if state is None:
            if kind != "prompt":
                return None, []
            state = {"title": title, "updated": ms, "pinned": False, "archived": False}
        elif kind == "prompt":
            state |= {"updated": ms, "archived": False}
        elif kind == "transcript":
            state["updated"] = ms
        elif kind == "rename":
            state["title"] = name or state["title"]
        elif kind == "pin":
            state["pinned"] = not state["pinned"]
        elif kind == "archive":
            state["archived"] = not state["archived"]
        return state, [(ms, number, True, state["title"], state["updated"], state["pinned"], state["archived"])]


def history_stream(events: DataFrame) -> DataFrame:
    """Each change of a conversation by a stream of (conv_id, at, event_id, type, text) with a watermark on at."""
    told = {"title": conversation_title(F.coalesce("text", F.lit(""))), "name": F.substring(squeeze(F.coalesce("text", F.lit(""))), 1, 80)}
    rows = events.withColumns({"ms": F.unix_millis("at"), "id": F.col("event_id").cast("long"), **told}).withColumnsRenamed({"conv_id": "key", "at": "ts"})
    made = folded(rows, History(), "ms long, event_id long, exists boolean, title string, updated_ms long, pinned boolean, archived boolean")
    return made.withColumnRenamed("key", "conv_id")


def latest_history(changes: DataFrame) -> DataFrame:
    """Conversations as the changes of ``history_stream``, once written, leave them; deleted ones are gone."""
    last = changes.groupBy("conv_id").agg(F.max(F.struct("ms", "event_id", "exists", "title", "updated_ms", "pinned", "archived")).alias("c"))
    return last.where("c.exists").select("conv_id", "c.title", "c.updated_ms", "c.pinned", "c.archived")


class Parts(InOrder):
    """The parts of an answer, told once its last part has come."""

    fields = ("type", "payload", "citation")
    emits = ("text", "citations", "suggestions", "agent_state", "outcome", "error")

    def __init__(self, ends: tuple[str, ...]):
        self.ends = ends

    def step(self, state, ms, number, kind, payload, citation):
        state = state or {"text": [], "seen": [], "citations": []}
        if kind == "text" and payload is not None:
            state["text"].append(payload)
        elif kind == "citation":
            if citation not in state["seen"]:
                state["seen"].append(citation)
                state["citations"].append(payload)
        elif kind in ("suggestions", "agent-state", "outcome", "error"):
            state[kind] = payload
        if kind not in self.ends:
            return state, []
        return None, [("".join(state["text"]), state["citations"], *(state.get(k) for k in ("suggestions", "agent-state", "outcome", "error")))]


def part_stream(parts: DataFrame, ends: tuple[str, ...] = ("outcome", "error")) -> DataFrame:
    """``conversations.fold_parts`` for a stream of (request_id, seq, type, payload, ts): a row once a part of ``ends`` was released."""
    rows = parts.withColumns({"ms": F.unix_millis("ts"), "id": F.col("seq").cast("long"), "citation": citation_id(F.col("payload"))}).withColumnRenamed("request_id", "key")
    made = folded(rows, Parts(ends), "text string, citations array<string>, suggestions string, agent_state string, outcome string, error string")
    return made.withColumnRenamed("key", "request_id")


def shuffled_files(rows: DataFrame, path: str, files: int, order: Column, last: DataFrame) -> None:
    """``rows`` as so many files in the order of ``order``, and then ``last``, which moves the watermark past them all."""
    rows.repartitionByRange(files, order).write.parquet(path)
    last.select(rows.columns).coalesce(1).write.mode("append").parquet(path)
