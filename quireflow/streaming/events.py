"""Reader events as streams: decoding, debouncing, latest state, stale results, decorations.

Event rows are (reader, ts, type, payload JSON). Every function works on a batch DataFrame as well,
except the stateful ones, which need a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

TYPES = ("relocated", "selection", "tap", "swipe", "key", "decorationActivated")
PAYLOAD = "struct<epoch:bigint,href:string,progression:double,cfi:string,text:string,x:double,y:double,key:string,direction:string,group:string,id:string>"


def decoded(events: DataFrame, payload: str = "payload", schema: str = PAYLOAD, types: tuple[str, ...] | None = TYPES) -> DataFrame:
    """Events of known types with their payload's fields; text that is no JSON object is dropped."""
    known = events.where(F.col("type").isin(*types)) if types else events
    return known.withColumn("p", F.from_json(payload, schema, {"mode": "PERMISSIVE"})).where(F.startswith(F.ltrim(payload), F.lit("{")) & F.col("p").isNotNull()).select(*[c for c in events.columns if c != payload], "p.*")


def debounced(events: DataFrame, gap: str, value: str, late: str = "1 minute", key: str = "reader") -> DataFrame:
    """The last event of each burst: events of a key closer than `gap` are one. 120 ms for relocations,
    200 ms for selections, 150 ms for resizes."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.max_by(value, "ts").alias(value), F.max("ts").alias("ts"), F.count("*").alias("n")).select(key, "ts", value, "n")


def coalesced(events: DataFrame, frame: str, value: str, late: str = "1 minute", key: str = "reader") -> DataFrame:
    """One redraw a frame: the last value in each tumbling window."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(key, F.window("ts", frame).alias("w")).agg(F.max_by(value, "ts").alias(value)).select(key, F.col("w.end").alias("frame"), value)


def latest(events: DataFrame, value: str, key: str = "reader") -> DataFrame:
    """The state a key is in: its last value (batch, or a stream in update mode)."""
    return events.groupBy(key).agg(F.max_by(value, "ts").alias(value), F.max("ts").alias("ts"))


class _Location(StatefulProcessor):
    """Keeps (epoch, location); an event of an older document epoch is stale and dropped, however early it comes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("location", "epoch bigint, ts timestamp, href string, progression double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get() if self.state.exists() else None
        best = None if now is None else (now[0], pd.Timestamp(now[1]))
        out = None
        for part in rows:
            for r in part.itertuples():
                at = (int(r.epoch), pd.Timestamp(r.ts))
                if best is None or at >= best:
                    best, out = at, (r.href, r.progression)
        if out is not None:
            self.state.update((best[0], best[1].to_pydatetime(), out[0], float(out[1])))
            yield pd.DataFrame({"reader": [key[0]], "epoch": [best[0]], "ts": [best[1]], "href": [out[0]], "progression": [out[1]]})

    def close(self) -> None:
        pass


def location_state(events: DataFrame) -> DataFrame:
    """A stream of (reader, epoch, ts, href, progression) as the reader's current place, one row for each change.
    Needs the RocksDB state store."""
    return events.groupBy("reader").transformWithStateInPandas(_Location(), outputStructType="reader bigint, epoch bigint, ts timestamp, href string, progression double", outputMode="Update", timeMode="None")


class _Decorations(StatefulProcessor):
    """Keeps each group's list; a change replaces the whole list, an empty one deletes the group."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.groups = handle.getMapState("groups", "group string", "revision bigint, items string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple[int, str | None]] = {}
        for part in rows:
            for r in part.sort_values("revision").itertuples():
                known = changed.get(r.group) or (self.groups.getValue((r.group,)) if self.groups.containsKey((r.group,)) else None)
                if known is None or r.revision > known[0]:
                    changed[r.group] = (int(r.revision), r.items)
        for group, (revision, items) in changed.items():
            if items in (None, "", "[]"):
                if self.groups.containsKey((group,)):
                    self.groups.removeKey((group,))
            else:
                self.groups.updateValue((group,), (revision, items))
        if changed:
            yield pd.DataFrame({"reader": [key[0]] * len(changed), "group": list(changed), "revision": [v[0] for v in changed.values()], "items": [v[1] for v in changed.values()]})

    def close(self) -> None:
        pass


def decoration_state(changes: DataFrame) -> DataFrame:
    """A stream of (reader, group, revision, items JSON) as each group's list in force."""
    return changes.groupBy("reader").transformWithStateInPandas(_Decorations(), outputStructType="reader bigint, group string, revision bigint, items string", outputMode="Update", timeMode="None")


def not_stale(event_epoch: Column, current_epoch: Column) -> Column:
    """Whether a result still belongs to the document that is shown."""
    return event_epoch >= F.coalesce(current_epoch, event_epoch)


def with_positions(locations: DataFrame, table: DataFrame, width: int = 1024) -> DataFrame:
    """A stream of places (book, idx, progression) with the position table's numbers: a stream-static join."""
    from ..operators import positions as P

    joined = locations.join(table.select("book", "idx", "length", "count", "start", "total"), ["book", "idx"], "left")
    return joined.withColumn("position", P.at_progression(F.col("progression"), width)).withColumn("total_progression", P.total_at_progression(F.col("progression"), width)).drop("length", "count", "start", "total")


def activations(taps: DataFrame, decorations: DataFrame) -> DataFrame:
    """Activation events with the decoration they name: a stream-static join on (reader, group, id)."""
    flat = decorations.select("reader", "group", F.explode("items").alias("item")).select("reader", "group", F.col("item.id").alias("id"), "item")
    return taps.join(flat, ["reader", "group", "id"])
