"""Per-source state machines: a circuit breaker and a token bucket, as folds over ordered events.

Each source's events are folded in order by a step function of (state, event). fold() runs it over a table and
stateful() over a stream, in micro-batches with the state kept between them; both give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CLOSED, OPEN, HALF_OPEN, TRIPPED = "CLOSED", "OPEN", "HALF_OPEN", "TRIPPED_PERMANENT"
BREAKER_STATE = "state string, failures long, opened double"
BREAKER_OUT = "seq long, decision string, state string, failures long"
BUCKET_STATE = "tokens double, at double, last double"
BUCKET_OUT = "seq long, granted boolean, wait double, tokens double"


@dataclass(frozen=True)
class Breaker:
    """Opens after threshold failures in a row, lets one probe through after cooldown seconds; a challenge trips it for good."""

    threshold: int = 5
    cooldown: float = 300.0

    def start(self) -> tuple:
        return CLOSED, 0, 0.0

    def step(self, state: tuple, at: float, event: str) -> tuple[tuple, tuple]:
        name, failures, opened = state
        if event in ("resume", "force_resume"):
            if name != TRIPPED or event == "force_resume":
                return (CLOSED, 0, 0.0), ("resumed", CLOSED, 0)
            return state, ("refused", name, failures)
        if name == TRIPPED:
            return state, ("denied", name, failures)
        if name == OPEN:
            if at < opened + self.cooldown:
                return state, ("denied", name, failures)
            name = HALF_OPEN
        if event == "challenge":
            return (TRIPPED, failures, at), ("tripped", TRIPPED, failures)
        if event == "failure":
            failures += 1
            if name == HALF_OPEN or failures >= self.threshold:
                return (OPEN, failures, at), ("opened", OPEN, failures)
            return (name, failures, opened), ("allowed", name, failures)
        return (CLOSED, 0, 0.0), ("allowed", CLOSED, 0)


@dataclass(frozen=True)
class Bucket:
    """rate tokens a second up to capacity, and grants at least spacing seconds apart."""

    rate: float
    capacity: float
    spacing: float = 0.0

    def start(self) -> tuple:
        return self.capacity, -1.0, 0.0

    def step(self, state: tuple, at: float, event: str) -> tuple[tuple, tuple]:
        tokens, before, last = state
        tokens = tokens if before < 0 else min(self.capacity, tokens + max(0.0, at - before) * self.rate)
        wait = max(0.0, self.spacing - (at - last) if self.spacing > 0 and last > 0 else 0.0, (1 - tokens) / self.rate if tokens < 1 else 0.0)
        if wait > 0:
            return (tokens, at, last), (False, wait, tokens)
        return (tokens - 1, at, at), (True, 0.0, tokens - 1)


Machine = Breaker | Bucket


def _types(machine: Machine) -> tuple[str, str]:
    return (BREAKER_STATE, BREAKER_OUT) if isinstance(machine, Breaker) else (BUCKET_STATE, BUCKET_OUT)


def _run(machine: Machine, state: tuple, rows: pd.DataFrame) -> tuple[tuple, list[tuple]]:
    out = []
    for seq, at, event in zip(rows["seq"], rows["at"], rows["event"]):
        state, seen = machine.step(state, float(at), event)
        out.append((int(seq), *seen))
    return state, out


def _frame(key: str, value, out: list[tuple], schema: str) -> pd.DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    frame = pd.DataFrame(out, columns=names)
    frame.insert(0, key, value)
    return frame


def fold(events: DataFrame, key: str, machine: Machine) -> DataFrame:
    """events (key, seq, at in seconds, event) of a table, one output row each. A source is one ordered group."""
    _, schema = _types(machine)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _frame(key, rows[key].iloc[0], _run(machine, machine.start(), rows.sort_values(["at", "seq"]))[1], schema)

    return events.select(key, "seq", "at", "event").groupBy(key).applyInPandas(run, f"{key} {dict(events.dtypes)[key]}, {schema}")


def stateful(events: DataFrame, key: str, machine: Machine) -> DataFrame:
    """The same over a stream, in the order of arrival; state lives between micro-batches."""
    kept, schema = _types(machine)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else machine.start()
        for rows in batches:
            now, out = _run(machine, now, rows.sort_values(["at", "seq"]))
            yield _frame(key, group[0], out, schema)
        state.update(now)

    return events.select(key, "seq", "at", "event").groupBy(key).applyInPandasWithState(run, f"{key} {dict(events.dtypes)[key]}, {schema}", kept, "append", GroupStateTimeout.NoTimeout)


def snapshot(transitions: DataFrame, key: str) -> DataFrame:
    """The newest row of each source."""
    rest = [c for c in transitions.columns if c != key]
    return transitions.groupBy(key).agg(F.max_by(F.struct(*rest), "seq").alias("x")).select(key, "x.*")


def gate(is_active, compliance, breaker_state, robots_allowed, granted):
    """The first gate that refuses a request, or allow."""
    return (
        F.when(breaker_state == TRIPPED, "deny_halted").when(compliance != "ACTIVE", "deny_disabled").when(~is_active, "deny_disabled")
        .when(breaker_state == OPEN, "deny_circuit_open").when(~robots_allowed, "deny_robots").when(~granted, "deny_rate").otherwise("allow")
    )
