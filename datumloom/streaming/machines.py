"""State machines over event streams: each entity moves between states by its events and by time, with side effects.

An entity's events are applied in the order of their times, whatever order they arrive
in: they wait in its state until the watermark has passed them. Timers move an entity
that stays without events, and forget one that has been idle for long, so state doesn't
grow with the entities ever seen. The transitions don't depend on how the stream is cut
into batches, nor on restarts.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from datumloom.registry import query
from datumloom.streaming.windows import plain, run, stream

HOUR = 3_600_000
#: What an entity's walk returns at a time, and a move in it.
OUTPUT = "entity long, moves string"
MOVE = "step int, at long, from_state string, to_state string, event string, effect string"


@dataclass(frozen=True)
class Machine:
    """A life cycle: where entities start, what moves them, and what a move sets off."""

    start: str
    #: (state, event) -> next state; other events leave the state as it is.
    moves: dict[tuple[str, str], str]
    #: state -> (milliseconds without any event, next state)
    timeouts: dict[str, tuple[int, str]] = field(default_factory=dict)
    #: (state, next state) -> a row that the move creates in another table, or updates there, as text
    effects: dict[tuple[str, str], str] = field(default_factory=dict)
    #: An entity in one of these states is forgotten after so many milliseconds without events.
    final: frozenset[str] = frozenset()
    forget_after: int = 30 * 24 * HOUR


class Walk(StatefulProcessor):
    """One entity's walk. ``at`` is the state, how many steps led to it and the time of its last event; ``waiting`` the events to come.

    Each call to the state and each frame costs far more than an event does, so the events
    that come together are one row of ``waiting``, a JSON array, and the moves made together
    are one row of the output.
    """

    def __init__(self, machine: Machine):
        self.machine = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "state string, step int, last long")
        self.waiting = handle.getListState("waiting", "events string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for df in rows:
            events = f"[{','.join(df['what'])}]"
            self.waiting.appendValue((events,))
            ms = min(e["ms"] for e in json.loads(events))
            first = ms if first is None else min(first, ms)
        if first is not None:
            self._wake(first)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, machine = timerValues.getCurrentWatermarkInMs(), self.machine
        waiting = [e for (events,) in self.waiting.get() for e in json.loads(events)]
        waiting.sort(key=lambda e: (e["ms"], "id" not in e, e.get("id", 0)))
        due, later = [e for e in waiting if e["ms"] <= now], [e for e in waiting if e["ms"] > now]
        if due and later:
            self.waiting.put([(json.dumps(later),)])
        elif due:
            self.waiting.clear()
        known = self.at.get() if self.at.exists() else None
        state, step, last = (known[0], known[1], known[2]) if known else (machine.start, 0, None)
        out = []

        def move(to: str, ms: int, event: str | None) -> None:
            nonlocal state, step
            step += 1
            out.append({"step": step, "at": ms, "from_state": state, "to_state": to, "event": event, "effect": machine.effects.get((state, to))})
            state = to

        def wait_until(ms: int) -> None:
            """Timeouts that end by then, one after another: each counts from the last event or the end of the one before."""
            nonlocal last
            while last is not None and state in machine.timeouts and last + machine.timeouts[state][0] <= ms:
                last += machine.timeouts[state][0]
                move(machine.timeouts[state][1], last, None)

        for e in due:
            ms, event = e["ms"], e.get("event")
            wait_until(ms - 1)
            if (state, event) in machine.moves:
                move(machine.moves[state, event], ms, event)
            last = ms
        wait_until(now)
        if last is not None and state in machine.final and not later and last + machine.forget_after <= now:
            self.at.clear()
        else:
            if last is not None and (due or out):
                self.at.update((state, step, last))
            ends = [last + machine.timeouts[state][0]] if last is not None and state in machine.timeouts else []
            ends += [last + machine.forget_after] if last is not None and state in machine.final else []
            self._wake(*(e["ms"] for e in later[:1]), *ends)
        if out:
            yield pd.DataFrame({"entity": [key[0]], "moves": [json.dumps(out)]})

    def _wake(self, *times: int) -> None:
        """A timer at the earliest of these times, once however often it is set; those set before stay, and find nothing to do."""
        if times:
            self.handle.registerTimer(min(times))

    def close(self) -> None:
        pass


def walked(events: DataFrame, machine: Machine, entity: str = "user_id") -> DataFrame:
    """entity, step, at, from_state, to_state, event (null for a timeout) and effect: every move, once the watermark has passed it.

    ``events`` is a stream with a watermark on ``ts``, and has event_id, event_type and the
    entity. Events of one time follow their ids. Events without an entity or a time take
    no part; late ones are dropped by the watermark.
    """
    what = F.to_json(F.struct(F.unix_millis("ts").alias("ms"), F.col("event_id").alias("id"), F.col("event_type").alias("event"))).alias("what")
    rows = events.where(F.col(entity).isNotNull() & F.col("ts").isNotNull()).select(F.col(entity).cast("long").alias("entity"), "ts", what)
    walks = rows.groupBy("entity").transformWithStateInPandas(Walk(machine), outputStructType=OUTPUT, outputMode="append", timeMode="eventTime")
    moves = walks.select("entity", F.explode(F.from_json("moves", f"array<struct<{MOVE}>>")).alias("m")).select("entity", "m.*")
    return moves.withColumn("at", F.timestamp_millis("at"))


#: A customer's life: what events and silence do to it.
CUSTOMER = Machine(
    start="new",
    moves={
        ("new", "signup"): "registered",
        ("registered", "view"): "engaged",
        ("registered", "click"): "engaged",
        ("engaged", "purchase"): "customer",
        ("customer", "error"): "at_risk",
        ("at_risk", "purchase"): "customer",
        ("dormant", "view"): "engaged",
        ("dormant", "purchase"): "customer",
        ("lapsed", "purchase"): "customer",
    },
    timeouts={"engaged": (12 * HOUR, "dormant"), "at_risk": (24 * HOUR, "lapsed"), "dormant": (96 * HOUR, "lapsed")},
    effects={("engaged", "customer"): "accounts:create", ("customer", "at_risk"): "tickets:create", ("at_risk", "customer"): "tickets:update", ("at_risk", "lapsed"): "tickets:update"},
    final=frozenset({"lapsed"}),
)


def machine_sql(machine: Machine, delay_hours: int = 1) -> str:
    """The moves by a recursive query that walks all entities an event, or a timeout, at a time."""
    moves = ", ".join(f"('{s}', '{e}', '{to}')" for (s, e), to in machine.moves.items())
    ends = ", ".join(f"('{s}', {ms}, '{to}')" for s, (ms, to) in machine.timeouts.items())
    effects = ", ".join(f"('{a}', '{b}', '{x}')" for (a, b), x in machine.effects.items())
    return f"""WITH RECURSIVE mark AS (SELECT epoch_us(max(ts)) // 1000 - {delay_hours * HOUR} AS wm FROM events),
e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, event_type, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events, mark WHERE epoch_us(ts) // 1000 <= wm),
moves(s, ev, d) AS (VALUES {moves}), ends(s, wait, d) AS (VALUES {ends}), effects(a, b, effect) AS (VALUES {effects}),
walk AS (
  SELECT DISTINCT user_id, 0::BIGINT AS n, '{machine.start}' AS state, 0 AS step, NULL::BIGINT AS last, NULL::VARCHAR AS was, NULL::VARCHAR AS event, NULL::BIGINT AS at FROM e
  UNION ALL
  SELECT w.user_id, CASE WHEN out THEN w.n ELSE w.n + 1 END,
         CASE WHEN out THEN x.d ELSE coalesce(m.d, w.state) END,
         w.step + CASE WHEN out OR m.d IS NOT NULL THEN 1 ELSE 0 END,
         CASE WHEN out THEN w.last + x.wait ELSE e.ms END,
         CASE WHEN out OR m.d IS NOT NULL THEN w.state END,
         CASE WHEN NOT out AND m.d IS NOT NULL THEN e.event_type END,
         CASE WHEN out THEN w.last + x.wait ELSE e.ms END
  FROM (SELECT w.*, coalesce(w.last + x.wait <= coalesce(e.ms - 1, mark.wm), FALSE) AS out
        FROM walk w CROSS JOIN mark LEFT JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1 LEFT JOIN ends x ON x.s = w.state) w
  LEFT JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1
  LEFT JOIN ends x ON x.s = w.state
  LEFT JOIN moves m ON m.s = w.state AND m.ev = e.event_type
  WHERE out OR e.n IS NOT NULL
)
SELECT w.user_id AS entity, w.step, make_timestamp(w.at * 1000) AS at, w.was AS from_state, w.state AS to_state, w.event, f.effect
FROM walk w LEFT JOIN effects f ON f.a = w.was AND f.b = w.state WHERE w.was IS NOT NULL"""


@query("stream_state_machine", machine_sql(CUSTOMER))
def stream_state_machine(spark, sf_dir):
    """Every move of every user through a customer's life, from the stream of events."""
    events = stream(spark, sf_dir).select("event_id", "ts", "user_id", "event_type")
    return run(walked(events, CUSTOMER), "append").withColumn("at", plain("at"))
