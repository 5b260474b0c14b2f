"""The inbox: decisions over a log in batch, exact and as sets, and the same rules one delivery at a time as a stream.

Rules in order: an engagement keeps its stream, a stream (of any tenant) its owner; a known event id of the tenant is
NO_OP or EVENT_CONTENT; a taken position is STREAM_POSITION; then completion. A rejected delivery leaves no trace.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import exact

DECISION = "tenant_id string, engagement_id string, source_stream_id string, source_sequence long, source_event_id string, arrival long, decision string, reject_reason string"
GIVEN = "tenant_id string, engagement_id string, source_stream_id string, source_sequence long, source_event_id string, arrival long, content string, last_data_sequence long"
#: The store of map state; the session's own choice stands if it is one.
ROCKSDB = "RocksDBStateStoreProvider"


def judge(store, r, foreign: bool) -> tuple[str, str | None]:
    """The decision on one delivery, given what ``store`` holds; an accepted one is written to it.

    store: get and put of ``bindings`` (engagement to stream), ``events`` (id to content), ``places`` (stream and position)
    and ``streams`` (marker's limit or 0, highest position, number of positions). foreign: the stream has another owner.
    After a marker no position beyond its limit is taken, and none may stand there before, so the count is that within it.
    """
    named = getattr(r, "last_data_sequence", None)
    named = None if named is None or named != named else int(named)
    stream, place = r.source_stream_id, int(r.source_sequence)
    engagement, event = (r.tenant_id, r.engagement_id), (r.tenant_id, r.source_event_id)
    content = f"{r.engagement_id}|{stream}|{place}|{named}|{r.content}"
    if (store.get("bindings", engagement) or stream) != stream:
        return "REJECTED", "ENGAGEMENT_BINDING"
    if foreign:
        return "REJECTED", "STREAM_OWNERSHIP"
    known = store.get("events", event)
    if known is not None:
        return ("NO_OP", None) if known == content else ("REJECTED", "EVENT_CONTENT")
    if store.get("places", (stream, place)) is not None:
        return "REJECTED", "STREAM_POSITION"
    marker, top, n = store.get("streams", (stream,)) or (0, 0, 0)
    # A marker's own position stands beyond its limit.
    if marker and (n == marker or named is not None or place > marker) or named is not None and top > named:
        return "REJECTED", "COMPLETION"
    store.put("bindings", engagement, stream)
    store.put("events", event, content)
    store.put("places", (stream, place), True)
    store.put("streams", (stream,), (named, max(top, place), n + (place <= named)) if named is not None else (marker, max(top, place), n + 1))
    return "ACCEPTED", None


class Inbox:
    """What has been accepted, in memory: the sequential form over all tenants."""

    def __init__(self):
        self.held: dict[str, dict] = {"bindings": {}, "events": {}, "places": {}, "streams": {}}
        self.owners: dict[str, tuple] = {}

    def get(self, kind: str, key: tuple):
        return self.held[kind].get(key)

    def put(self, kind: str, key: tuple, value) -> None:
        self.held[kind][key] = value

    def step(self, r) -> tuple[str, str | None]:
        owner = (r.tenant_id, r.engagement_id)
        got = judge(self, r, self.owners.get(r.source_stream_id, owner) != owner)
        if got[0] == "ACCEPTED":
            self.owners[r.source_stream_id] = owner
        return got


def replay(deliveries: DataFrame) -> DataFrame:
    """Decisions of each delivery in order of arrival, exact always: :func:`factloom.operators.exact.decide`, as sets.

    Optional column last_data_sequence marks completion markers.
    """
    return exact.decide(deliveries)


class _Owners(StatefulProcessor):
    """By stream: adds whether each delivery is of another tenant or engagement than the stream's first one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owner = handle.getValueState("owner", "tenant_id string, engagement_id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        first = self.owner.get() if self.owner.exists() else None
        if first is None:
            first = (got.iloc[0].tenant_id, got.iloc[0].engagement_id)
            self.owner.update(first)
        yield got.assign(foreign=(got.tenant_id != first[0]) | (got.engagement_id != first[1]))

    def close(self) -> None:
        pass


class _Decisions(StatefulProcessor):
    """By tenant: map state, of which a batch reads and writes the entries that its deliveries name."""

    MAPS = {
        "bindings": ("tenant_id string, engagement_id string", "value string"),
        "events": ("tenant_id string, source_event_id string", "value string"),
        "places": ("source_stream_id string, source_sequence long", "value boolean"),
        "streams": ("source_stream_id string", "marker long, top long, n long"),
    }

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.maps = {name: handle.getMapState(name, *schemas) for name, schemas in self.MAPS.items()}

    def get(self, kind: str, key: tuple):
        # Look-ups of a key that is not there give none.
        found = self.maps[kind].getValue(key) if self.maps[kind].containsKey(key) else None
        return found if found is None or kind == "streams" else found[0]

    def put(self, kind: str, key: tuple, value) -> None:
        self.maps[kind].updateValue(key, value if kind == "streams" else (value,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        said = [judge(self, r, bool(r.foreign)) for r in got.itertuples(index=False)]
        out = got[["tenant_id", "engagement_id", "source_stream_id", "source_sequence", "source_event_id", "arrival"]].copy()
        out["decision"], out["reject_reason"] = [g[0] for g in said], [g[1] for g in said]
        yield out

    def close(self) -> None:
        pass


def start(deliveries: DataFrame) -> DataFrame:
    """The same rules over a streaming DataFrame, with keyed state in RocksDB.

    First the owner of each stream, whoever the tenant is, then the decisions by tenant. A batch reads and writes the
    entries of its own deliveries and nothing else of the state; it sorts each tenant's part of the batch, which the
    source's limit for a batch bounds. Batches come in order of arrival. The one difference to :func:`replay`: a stream
    belongs to who delivers to it first, even if that delivery is rejected for another reason.
    """
    spark = deliveries.sparkSession
    if ROCKSDB not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", f"org.apache.spark.sql.execution.streaming.state.{ROCKSDB}")
    given = deliveries if "last_data_sequence" in deliveries.columns else deliveries.withColumn("last_data_sequence", F.lit(None).cast("long"))
    given = given.select(*[c.split()[0] for c in GIVEN.split(", ")])
    owned = given.groupBy("source_stream_id").transformWithStateInPandas(_Owners(), GIVEN + ", foreign boolean", "Append", "None")
    return owned.groupBy("tenant_id").transformWithStateInPandas(_Decisions(), DECISION, "Append", "None")


__all__ = ["Inbox", "judge", "replay", "start"]
