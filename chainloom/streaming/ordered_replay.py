"""Streaming replay: events arrive in any order and are applied in order of seq.

State is held by (source, stream) in keyed maps, so that an event reads and writes its own slot, run,
observation and delegation and nothing else, however long the stream is: the next number to apply, early
events that wait for it, the hash applied in every slot, and the runs. An event behind a gap waits, and the
gap heals when it arrives; a second candidate for a slot marks the stream forked, from when on its events
are BLOCKED (what went out before stays as it went). Order is by seq, not by time, so nothing is ever late.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.replay import FIELDS, StreamState
from ..session import workers

OUTPUT = "source string, stream string, seq long, hash string, kind string, run string, step string, outcome string, code string"


class OrderedReplay(StatefulProcessor):
    """The machine of operators.replay over one stream's state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "next long, forked boolean")
        self.slots = handle.getMapState("slots", "seq long", "hash string")
        self.others = handle.getMapState("others", "seq long, hash string", "seen boolean")
        self.waiting = handle.getMapState("waiting", "seq long", "events string")
        self.runs = handle.getMapState("runs", "run string", "state string")
        self.observed = handle.getMapState("observed", "hash string", "run string, step string")
        self.delegations = handle.getMapState("delegations", "delegation string", "seen boolean")

    def _apply(self, r: dict) -> bool:
        machine, run = StreamState(), r["run"]
        if run is not None and self.runs.containsKey((run,)):
            machine.runs[run] = json.loads(self.runs.getValue((run,))[0])
        if r["observation"] is not None and self.observed.containsKey((r["observation"],)):
            machine.observed[r["observation"]] = tuple(self.observed.getValue((r["observation"],)))
        if r["delegation"] is not None and self.delegations.containsKey((r["delegation"],)):
            machine.delegations.add(r["delegation"])
        legal = machine.apply(r["kind"], run, r["step"], r["outcome"], r["hash"], r["observation"], r["delegation"])
        if legal:
            if run in machine.runs:
                self.runs.updateValue((run,), (json.dumps(machine.runs[run]),))
            if r["hash"] in machine.observed:
                self.observed.updateValue((r["hash"],), machine.observed[r["hash"]])
            if r["delegation"] in machine.delegations:
                self.delegations.updateValue((r["delegation"],), (True,))
        return legal

    def _is_new(self, r: dict) -> bool:
        """Whether the event was not seen before; a further candidate of a slot forks the stream."""
        if not self.slots.containsKey((r["seq"],)):
            self.slots.updateValue((r["seq"],), (r["hash"],))
            return True
        at = (r["seq"], r["hash"])
        if self.slots.getValue((r["seq"],))[0] == r["hash"] or self.others.containsKey(at):
            return False
        self.others.updateValue(at, (True,))
        self.forked = True
        return True

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        following, self.forked = self.head.get() if self.head.exists() else (1, False)
        clean = lambda x: None if x is None or x != x else x
        out, early = [], {}

        def emit(r: dict, code: str) -> None:
            out.append({**{k: r[k] for k in ("source", "stream", "seq", "hash", "kind", "run", "step", "outcome")}, "code": code})

        for pdf in rows:
            for r in pdf.to_dict("records"):
                r = {k: clean(v) for k, v in r.items()} | {"seq": int(r["seq"])}
                if not self._is_new(r):
                    continue
                if r["seq"] < following:  # its slot went out already
                    emit(r, "BLOCKED")
                else:
                    early.setdefault(r["seq"], []).append(r)
        for seq, events in early.items():
            if self.waiting.containsKey((seq,)):
                events = json.loads(self.waiting.getValue((seq,))[0]) + events
            self.waiting.updateValue((seq,), (json.dumps(events),))
        while self.waiting.containsKey((following,)):
            for r in sorted(json.loads(self.waiting.getValue((following,))[0]), key=lambda r: r["hash"]):
                emit(r, "BLOCKED" if self.forked else "OK" if self._apply(r) else "STATE_TRANSITION")
            self.waiting.removeKey((following,))
            following += 1
        self.head.update((following, self.forked))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def streaming_replay(events: DataFrame) -> DataFrame:
    """events: a stream with the columns of operators.replay.FIELDS. Appends each event once, with its
    code, as soon as all before it in its stream have arrived. The session keeps state in RocksDB."""
    spark = events.sparkSession
    workers(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return events.select(*FIELDS).groupBy("source", "stream").transformWithStateInPandas(OrderedReplay(), OUTPUT, "Append", "None")


def stage_expiry_stream(stages: DataFrame, ttl: str = "10 minutes") -> DataFrame:
    """stage, created: stages (stage, ts) that saw no terminal event (kind) within ttl of event time."""
    from pyspark.sql import functions as F

    w = stages.withWatermark("ts", ttl).groupBy(F.session_window("ts", ttl), "stage")
    return w.agg(F.min("ts").alias("created"), F.max(F.col("kind").isin("COMMITTED", "CANCELLED")).alias("ended")).where("not ended").select("stage", "created")
