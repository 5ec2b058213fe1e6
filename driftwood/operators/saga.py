"""Sagas: declared state machines, folded over each key's events in order.

A machine has few states, so what a time slice of a key's events does is a small table: for each state before it, the state
after it and what was counted meanwhile. Such tables compose. A key with very many events is therefore cut into slices
that are folded apart, then its slices are folded, and each slice is run again from the state it really starts in
when single transitions are asked for. All that is column expressions; only which timeouts there are is worked out event by event.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import null_safe_join, running_sum

INITIAL = "Initial"


@dataclass(frozen=True)
class Step:
    """What an event does in a state: go on to `to` (None: stay), publish `emit` (one or several), delete the saga, start a
    timeout (or several)."""

    state: str
    event: str
    to: str | None = None
    emit: str | tuple[str, ...] | None = None
    finalize: bool = False
    timeout_ms: int | tuple[int, ...] | None = None

    @property
    def emits(self) -> tuple[str, ...]:
        return () if self.emit is None else (self.emit,) if isinstance(self.emit, str) else self.emit

    @property
    def delays(self) -> tuple[int, ...]:
        return () if self.timeout_ms is None else (self.timeout_ms,) if isinstance(self.timeout_ms, int) else self.timeout_ms

    def then(self, other: "Step") -> "Step":
        """Both at once: what other says of the next state holds, everything else adds up."""
        return Step(self.state, self.event, other.to or self.to, self.emits + other.emits, self.finalize or other.finalize, self.delays + other.delays)


@dataclass(frozen=True)
class Machine:
    """Steps by state and event; a later one for the same pair replaces an earlier one. during_any holds in every state, after
    the state's own step for the event. An event without a step is ignored and settled all the same."""

    steps: tuple[Step, ...]
    during_any: tuple[Step, ...] = ()
    states: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        named = [INITIAL, *(x for s in (*self.steps, *self.during_any) for x in (s.state, s.to) if x and x != "*")]
        object.__setattr__(self, "states", tuple(dict.fromkeys(named)))

    def table(self) -> dict[tuple[str, str], Step]:
        out = {(s.state, s.event): s for s in self.steps}
        for event, step in {s.event: s for s in self.during_any}.items():
            for q in self.states:
                out[q, event] = out.get((q, event), Step(q, event)).then(step)
        return out


class MachineBuilder:
    """initially(...).during(...).during_any(...).build(), after the way that such machines are usually declared."""

    def __init__(self):
        self.steps: list[Step] = []
        self.anywhere: list[Step] = []

    def initially(self, event: str, **what) -> "MachineBuilder":
        return self.during(INITIAL, event, **what)

    def during(self, state: str, event: str, **what) -> "MachineBuilder":
        self.steps.append(Step(state, event, **what))
        return self

    def during_any(self, event: str, **what) -> "MachineBuilder":
        self.anywhere.append(Step("*", event, **what))
        return self

    def build(self) -> Machine:
        return Machine(tuple(self.steps), tuple(self.anywhere))


def _case(table: dict[tuple[str, str], Step], state: Column, event: Column, value: Callable[[Step], Column], otherwise: Column) -> Column:
    out = otherwise
    for (q, e), s in table.items():
        out = F.when((state == q) & (event == e), value(s)).otherwise(out)
    return out


def _next(machine: Machine, acc: Column, event: Column) -> Column:
    """The accumulator (state, version, finished, ignored, ends) after an event; a deleted saga is Initial again."""
    table, state = machine.table(), acc["state"]
    known = _case(table, state, event, lambda s: F.lit(True), F.lit(False))
    final = _case(table, state, event, lambda s: F.lit(s.finalize), F.lit(False))
    to = _case(table, state, event, lambda s: F.lit(INITIAL if s.finalize else s.to or s.state), state)
    version = F.when(final, F.lit(0)).when(known & (state == INITIAL) & (to != INITIAL), F.lit(0)).when(known, acc["version"] + 1).otherwise(acc["version"])
    ended = _case(table, state, event, lambda s: F.lit((s.to or s.state) if s.finalize else None), F.lit(None).cast("string"))
    fresh = acc["fresh"] | final | (known & (state == INITIAL) & (to != INITIAL))
    return F.struct(
        to.alias("state"), version.cast("int").alias("version"), fresh.alias("fresh"), (acc["ignored"] + (~known).cast("long")).alias("ignored"),
        F.struct(*[(acc["ends"][q] + F.coalesce(ended == q, F.lit(False)).cast("long")).alias(q) for q in machine.states]).alias("ends"),
    )


def _start(machine: Machine, state: Column, version: Column | None = None) -> Column:
    return F.struct(state.alias("state"), (F.lit(0) if version is None else version).cast("int").alias("version"), F.lit(False).alias("fresh"), F.lit(0).cast("long").alias("ignored"), F.struct(*[F.lit(0).cast("long").alias(q) for q in machine.states]).alias("ends"))


def _slices(events: DataFrame, slice_by: str) -> DataFrame:
    """(key, slice, items): the slice's events in order; events has key, ts, id, event."""
    return events.withColumn("slice", F.expr(slice_by)).groupBy("key", "slice").agg(F.array_sort(F.collect_list(F.struct("ts", "id", "event"))).alias("items"))


def _tables(events: DataFrame, machine: Machine, slice_by: str) -> DataFrame:
    """Slices with one result for each state they might start in."""
    return _slices(events, slice_by).withColumns({f"from_{q}": F.aggregate("items", _start(machine, F.lit(q)), lambda acc, x: _next(machine, acc, x["event"])) for q in machine.states})


def _over_slices(machine: Machine, acc: Column, part: Column) -> Column:
    """Composition: what the slice does from the accumulated state, added to it."""
    got = part[f"from_{machine.states[-1]}"]
    for q in machine.states[:-1]:
        got = F.when(acc["state"] == q, part[f"from_{q}"]).otherwise(got)
    version = F.when(got["fresh"], got["version"]).otherwise(acc["version"] + got["version"])
    return F.struct(got["state"].alias("state"), version.cast("int").alias("version"), (acc["fresh"] | got["fresh"]).alias("fresh"), (acc["ignored"] + got["ignored"]).alias("ignored"), F.struct(*[(acc["ends"][q] + got["ends"][q]).alias(q) for q in machine.states]).alias("ends"))


def fold(events: DataFrame, machine: Machine, slice_by: str) -> DataFrame:
    """(key, state, version, ignored, ends): each key's saga after all its events; state Initial means that there is none.

    events has key, ts, id (breaks ties), event. version counts the updates since the saga was made, ends how many
    sagas of the key were deleted in each state.
    """
    parts = _tables(events, machine, slice_by).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("slice", *[f"from_{q}" for q in machine.states]))).alias("parts"))
    out = parts.select("key", F.aggregate("parts", _start(machine, F.lit(INITIAL)), lambda acc, p: _over_slices(machine, acc, p)).alias("x"))
    return out.select("key", "x.state", "x.version", "x.ignored", "x.ends")


def transitions(events: DataFrame, machine: Machine, slice_by: str) -> DataFrame:
    """(key, ts, id, event, from_state, to_state, emitted, finalized, handled) of each event; emitted is an array, in order."""
    parts = _tables(events, machine, slice_by).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("slice", *[f"from_{q}" for q in machine.states]))).alias("parts"))
    step = lambda acc, p: F.struct(_over_slices(machine, acc["x"], p).alias("x"), F.concat(acc["starts"], F.array(F.struct(p["slice"].alias("slice"), acc["x"]["state"].alias("state")))).alias("starts"))
    slice_type = parts.schema["parts"].dataType.elementType["slice"].dataType.simpleString()
    zero = F.struct(_start(machine, F.lit(INITIAL)).alias("x"), F.array().cast(f"array<struct<slice:{slice_type},state:string>>").alias("starts"))
    starts = parts.select("key", F.explode(F.aggregate("parts", zero, step)["starts"]).alias("s")).select("key", "s.slice", "s.state")
    table = machine.table()

    def trail(acc: Column, x: Column) -> Column:
        state, event = acc["state"], x["event"]
        to = F.coalesce(_case(table, state, event, lambda s: F.lit(s.to), F.lit(None).cast("string")), state)
        final = _case(table, state, event, lambda s: F.lit(s.finalize), F.lit(False))
        row = F.struct(
            x["ts"].alias("ts"), x["id"].alias("id"), event.alias("event"), state.alias("from_state"), to.alias("to_state"),
            _case(table, state, event, lambda s: F.array(*map(F.lit, s.emits)).cast("array<string>"), F.array().cast("array<string>")).alias("emitted"), final.alias("finalized"),
            _case(table, state, event, lambda s: F.lit(True), F.lit(False)).alias("handled"),
        )
        return F.struct(F.when(final, F.lit(INITIAL)).otherwise(to).alias("state"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    met = null_safe_join(_slices(events, slice_by), starts, ["key", "slice"])
    items = met.schema["items"].dataType.elementType
    row_type = f"array<struct<ts:{items['ts'].dataType.simpleString()},id:{items['id'].dataType.simpleString()},event:string,from_state:string,to_state:string,emitted:array<string>,finalized:boolean,handled:boolean>>"
    rows = F.aggregate("items", F.struct(F.col("state").alias("state"), F.array().cast(row_type).alias("rows")), trail)["rows"]
    return met.select("key", F.explode(rows).alias("r")).select("key", "r.*")


@dataclass(frozen=True)
class Then:
    """How a handled event changes a field of its saga: `add` a value, or `put` one in its place. value is SQL over the columns of
    the events; events are the names it holds for (none: all that the machine handles)."""

    value: str
    events: tuple[str, ...] = ()
    kind: str = "put"

    def __post_init__(self):
        if self.kind not in ("put", "add"):
            raise ValueError("a field is put or added to")


def carried(events: DataFrame, machine: Machine, slice_by: str, fields: dict[str, Then]) -> DataFrame:
    """(key, saga, *fields): the data of each saga of a key, open or deleted; saga numbers a key's sagas from 1.

    A saga starts with the handled event that finds none. A field to which nothing was added is 0, one that was not put is null; nulls
    that are put count, nulls that are added do not. Values ride along with the id, so that events are not joined with what the
    machine makes of them; what is put is the last in order, so both kinds are aggregated before the shuffle, whatever a key holds.
    """
    values = F.struct(F.col("id").alias("id"), *[F.expr(f.value).alias(name) for name, f in fields.items()])
    met = transitions(events.withColumn("id", values), machine, slice_by).where("handled")
    opens = (F.col("from_state") == INITIAL) & ((F.col("to_state") != INITIAL) | F.col("finalized"))
    met = met.where((F.col("from_state") != INITIAL) | opens)
    rows = running_sum(met, ["key"], ["ts", "id", "event"], opens.cast("long"), slice_by, "saga")

    def one(name: str, f: Then) -> Column:
        holds = F.col("event").isin(*f.events) if f.events else F.lit(True)
        value = F.col("id")[name]
        if f.kind == "add":
            return F.coalesce(F.sum(F.when(holds, value)), F.lit(0)).alias(name)
        return F.max_by(F.struct(value.alias("v")), F.when(holds, F.struct("ts", "id", "event")))["v"].alias(name)

    return rows.groupBy("key", "saga").agg(*[one(n, f) for n, f in fields.items()])


def _scheduled(table: dict[tuple[str, str], Step], name: str):
    """Rows in the order of key, ts, id, event: the timeouts (key, ts, id) that they schedule. A key's rows pass by one at a
    time; what is kept is the state and the timeouts that have not come yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, due = object(), INITIAL, []
        for batch in batches:
            kind, out = batch["ts"].type, ([], [], [])
            for key, ts, id_, event in zip(batch["key"].to_pylist(), batch["ts"].cast(pa.int64()).to_pylist(), batch["id"].to_pylist(), batch["event"].to_pylist()):
                if key != now:
                    now, state, due = key, INITIAL, []
                while True:
                    early = due[0] if due and due[0] < (ts, id_ is not None, id_, event) else None
                    if early:
                        heappop(due)
                    at, of, what = (early[0], early[2], name) if early else (ts, id_, event)
                    if step := table.get((state, what)):
                        for ms in step.delays:
                            heappush(due, (at + 1000 * ms, of is not None, of, name))
                            for column, value in zip(out, (key, at + 1000 * ms, of)):
                                column.append(value)
                        state = INITIAL if step.finalize else step.to or state
                    if not early:
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch["key"].type), pa.array(out[1], pa.int64()).cast(kind), pa.array(out[2], batch["id"].type)], ["key", "ts", "id"])

    return run


def with_timeouts(events: DataFrame, machine: Machine, name: str = "timeout") -> DataFrame:
    """events (key, ts, id, event) and the timeouts that the machine's steps schedule, as events `name` with the id of the
    event that scheduled them.

    Timeouts are events of the machine too: they change what later events do, and so which timeouts are scheduled. One comes
    even if its saga has moved on or was deleted, and then meets the key's next saga; it is for the state to ignore it. A
    timeout that a timeout schedules after a key's last event is not followed up. Since a saga with timeouts depends on all
    that came before, a key's handled events go through one task in order; events without any step are left out first, and
    the task keeps no rows.
    """
    table, kind = machine.table(), {f.name: f.dataType.simpleString() for f in events.schema.fields}
    rows = events.select("key", "ts", "id", "event").where(F.col("event").isin(sorted({e for _, e in table})))
    late = rows.repartition("key").sortWithinPartitions("key", "ts", "id", "event").mapInArrow(_scheduled(table, name), f"key {kind['key']}, ts {kind['ts']}, id {kind['id']}")
    return events.select("key", "ts", "id", "event").unionByName(late.withColumn("event", F.lit(name)))
