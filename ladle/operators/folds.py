"""Folds over the rows of a key in order, in parallel also where one key holds all rows.

Rows are dealt in ranges of key and time, so that a key with many rows lies in many parts, and written once. What a part
hands over matters only for the key that goes on in the next part:

* a machine with a `table` says what becomes of any state that may reach its part, in a few rows; the tables of a key are walked
  in order, and a last pass over the rows starts each part with its state: three passes, whatever the number of parts.
* for a machine without one, every part is folded from the fresh state; parts that got another state than they were folded
  from are folded again until none is left. States are soon forgotten (a success resets, a time ends), so few
  rounds are usual; there are as many as parts at worst. The result is exact either way.

The driver holds a state for each part. A task holds the rows of one key in one part.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.session import checkpointed

State = tuple
Rows = dict[str, np.ndarray]
TABLE = "entry double, until double, n long"


class Windows:
    """A window begins with the first row after the one before has ended; state: its end, and how many rows it has.

    strict: a row at the very end still belongs to the window. Rows get their place in their window, from 0.
    """

    output, start = "place long", (-math.inf, 0)

    def __init__(self, length: float, strict: bool = True):
        self.length, self.side = length, "right" if strict else "left"

    def table(self, rows: Rows) -> list[tuple]:
        ms = rows["ms"]
        n = len(ms)
        after = np.maximum(np.searchsorted(ms, ms + self.length, self.side), np.arange(1, n + 1))
        last = np.where(after < n, after, np.arange(n))
        while True:  # pointers are doubled until each row points to the last window that begins if one begins with it
            further = last[last]
            if (further == last).all():
                break
            last = further
        most = min(n, np.searchsorted(ms, ms[0] + self.length, self.side) + 1)  # the window before began before this part
        ends = np.flatnonzero(np.append(last[: most - 1] != last[1:most], True))
        return [(float(ms[e]), float(ms[last[e]] + self.length), int(n - last[e])) for e in ends] + [(math.inf, 0.0, n)]

    def through(self, table: Rows, state: State) -> State:
        at = np.searchsorted(table["entry"][:-1], state[0], self.side)
        if at == len(table["entry"]) - 1:
            return state[0], state[1] + int(table["n"][-1])
        return float(table["until"][at]), int(table["n"][at])

    def run(self, rows: Rows, state: State) -> tuple[list, State]:
        ms, (until, held), at = rows["ms"], state, 0
        place = np.empty(len(ms), np.int64)
        while at < len(ms):
            opens = max(at, np.searchsorted(ms, until, self.side))
            place[at:opens] = held + np.arange(opens - at)
            held, at = held + opens - at, opens
            if at < len(ms):
                until, held = float(ms[at] + self.length), 0
                stop = max(at + 1, np.searchsorted(ms, until, self.side))
                place[at:stop] = np.arange(stop - at)
                held, at = stop - at, stop
        return place.tolist(), (until, int(held))


class Circuit:
    """Failures in a row open a circuit for a time, then one trial decides. State: the end of the open time, and failures (at most `limit`)."""

    output, start = "met string", (0.0, 0)

    def __init__(self, limit: int, open_ms: float):
        self.limit, self.open_ms = limit, open_ms

    def step(self, state: State, ms: float, ok: bool) -> tuple[State, str]:
        until, failures = state
        if ms < until:
            return state, "open"
        met = "half-open" if failures >= self.limit else "closed"
        if ok:
            return (0.0, 0), met
        failures = min(failures + 1, self.limit)
        return (ms + self.open_ms if failures >= self.limit else 0.0, failures), met

    def run(self, rows: Rows, state: State) -> tuple[list, State]:
        out = []
        for ms, ok in zip(rows["ms"].tolist(), rows["ok"].tolist(), strict=True):
            state, met = self.step(state, ms, bool(ok))
            out.append(met)
        return out, state

    def table(self, rows: Rows) -> list[tuple]:
        ms, ok = rows["ms"], rows["ok"].astype(bool)
        n, limit = len(ms), self.limit
        trial = np.maximum(np.searchsorted(ms, ms + self.open_ms, "left"), np.arange(1, n + 1))  # the row that tries again if the circuit opened here
        closed = [(0.0, f) for f in range(limit)]  # what becomes of f failures from the row at hand on
        calm: list[State] = [(0.0, 0)] * (n + 1)  # of none
        tried: list[State] = [(0.0, 0)] * n  # of a trial with that row
        for i in range(n - 1, -1, -1):
            opened = tried[trial[i]] if trial[i] < n else (float(ms[i] + self.open_ms), limit)
            tried[i] = calm[i + 1] if ok[i] else opened
            closed = [calm[i + 1]] * limit if ok[i] else [*closed[1:], opened]
            calm[i] = closed[0]
        out = []
        for i in range(min(n, np.searchsorted(ms, ms[0] + self.open_ms, "left") + 1)):  # the circuit opened before this part
            if out and tried[i] == out[-1][1:]:
                out.pop()
            out.append((float(ms[i]), *tried[i]))
        return [(0.0, *s) for s in closed] + out

    def through(self, table: Rows, state: State) -> State:
        until, failures = state
        at = failures if failures < self.limit else self.limit + np.searchsorted(table["entry"][self.limit :], until, "left")
        return state if at == len(table["entry"]) else (float(table["until"][at]), int(table["n"][at]))


class Chain:
    """Requests try providers in order until one answers; what a call meets depends on the circuits of all models.

    Within a request, the other providers of an access key that met a limit are left out, and models that do not exist.
    Only passing failures count for a model's circuit; calls that are not made change nothing. State: models with failures,
    their open times and failures. Columns of rows: request, model, access, ok, passing, limited, missing, ms.
    """

    output, start = "outcome string", ()

    def __init__(self, limit: int, open_ms: float):
        self.circuit = Circuit(limit, open_ms)

    def state(self, plain: list) -> State:
        return tuple((model, (until, failures)) for model, (until, failures) in plain)

    def run(self, rows: Rows, state: State) -> tuple[list, State]:
        circuits, out, request = dict(state), [], object()
        names = ("request", "model", "access", "ok", "passing", "limited", "missing", "ms")
        for now, model, access, ok, passing, limited, missing, ms in zip(*(rows[c].tolist() for c in names), strict=True):
            if now != request:
                request, answered, spent, gone = now, False, set(), set()
            held = circuits.get(model, Circuit.start)
            if answered:
                out.append("unused")
            elif ms < held[0]:
                out.append("open")
            elif access in spent:
                out.append("limited")
            elif model in gone:
                out.append("missing")
            else:
                answered = ok
                out.append("answered" if ok else "failed")
                if not ok and limited:
                    spent.add(access)
                elif not ok and missing:
                    gone.add(model)
                if ok or passing:
                    circuits[model] = self.circuit.step(held, ms, ok)[0]
        return out, tuple(sorted((m, s) for m, s in circuits.items() if s != Circuit.start))


class Cache:
    """Keys with a time to live, of which the one stored first goes when there are `most`. State: key, time stored and what was
    found, in the order of storing. lives: of what was not found and of what was, in ms."""

    output, start = "hit boolean", ()

    def __init__(self, lives: tuple[float, float], most: int):
        self.lives, self.most = lives, most

    def state(self, plain: list) -> State:
        return tuple(map(tuple, plain))

    def run(self, rows: Rows, state: State) -> tuple[list, State]:
        held, out = {key: (ms, found) for key, ms, found in state}, []  # a dict keeps the order of storing
        for key, found, ms in zip(rows["key"].tolist(), rows["found"].tolist(), rows["ms"].tolist(), strict=True):
            entry = held.get(key)
            hit = entry is not None and ms - entry[0] < self.lives[entry[1]]
            out.append(hit)
            if hit:
                continue
            held.pop(key, None)
            if len(held) >= self.most:
                del held[next(iter(held))]
            held[key] = (ms, bool(found))
        return out, tuple((key, ms, found) for key, (ms, found) in held.items())


def _groups(frames: Iterator[pd.DataFrame], key: str) -> Iterator[tuple[object, Rows]]:
    """The columns of each key's rows in a sorted part, one key at a time."""
    held: list[Rows] = []

    def joined() -> tuple[object, Rows]:
        return held[0][key][0], held[0] if len(held) == 1 else {c: np.concatenate([h[c] for h in held]) for c in held[0]}

    for pdf in frames:
        columns = {c: pdf[c].to_numpy() for c in pdf.columns}
        values = columns[key]
        cuts = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if held and held[0][key][0] != values[a]:
                yield joined()
                held = []
            held.append({c: v[a:b] for c, v in columns.items()})
    if held:
        yield joined()


def dealt_in_order(rows: DataFrame, key: str, within: list[str], then: list[str] = ()) -> DataFrame:
    """rows in ranges of key and `within` (rows equal in these stay in one part), sorted by these and `then`, with their part; written once."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return checkpointed(rows.repartitionByRange(parts, key, *within).sortWithinPartitions(key, *within, *then).withColumn("part", F.spark_partition_id()))


def _handed_over(dealt: DataFrame, key: str, kind: str, machine) -> dict[int, State]:
    """What reaches the first key of each part that has been begun before, by walking the parts' tables."""

    columns = [key, "part", "leads", "row", "entry", "until", "n"]

    def ends(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, name, group = True, None, None
        for name, group in _groups(frames, key):
            if first:
                yield pd.DataFrame([(name, group["part"][0], True, k, *r) for k, r in enumerate(machine.table(group))], columns=columns)
            first, led = False, first
        if group is not None and not led:  # the last key, which may go on
            yield pd.DataFrame([(name, group["part"][0], False, k, *r) for k, r in enumerate(machine.table(group))], columns=columns)

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, tables in _groups(frames, key):
            state, out = machine.start, []
            cuts = [0, *(np.flatnonzero(np.diff(tables["part"])) + 1).tolist(), len(tables["part"])]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if tables["leads"][a]:
                    out.append((tables["part"][a], *state))
                state = machine.through({c: v[a:b] for c, v in tables.items()}, state)
            if out:
                yield pd.DataFrame(out, columns=["part", "until", "n"])

    tables = dealt.mapInPandas(ends, f"{key} {kind}, part int, leads boolean, row int, {TABLE}")
    walked = tables.repartition(key).sortWithinPartitions(key, "part", "row").mapInPandas(walk, "part int, until double, n long")
    return {r.part: (r.until, r.n) for r in walked.collect()}


def _settled(dealt: DataFrame, key: str, machine) -> dict[int, State]:
    """What reaches the first key of each part, by folding parts again until what they got is what they were folded from."""

    def folds(got: dict[int, State]):
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            first = last = None
            for name, group in _groups(frames, key):
                part = int(group["part"][0])
                _, state = machine.run(group, got.get(part, machine.start) if first is None else machine.start)
                first, last = name if first is None else first, name
            if last is not None:
                yield pd.DataFrame([(part, json.dumps([str(first), str(last)]), json.dumps(state))], columns=["part", "keys", "state"])

        return run

    got: dict[int, State] = {}
    ends: dict[int, tuple[list[str], State]] = {}
    stale = None
    while stale is None or stale:
        again = dealt if stale is None else dealt.filter(F.col("part").isin(sorted(stale)))
        for r in again.mapInPandas(folds(got), "part int, keys string, state string").collect():
            ends[r.part] = (json.loads(r.keys), machine.state(json.loads(r.state)))
        now = {p: ends[q][1] for q, p in zip(sorted(ends), sorted(ends)[1:], strict=False) if ends[q][0][1] == ends[p][0][0]}
        stale = {p for p in now if now[p] != got.get(p, machine.start)}
        got = now
    return got


def fold(dealt: DataFrame, key: str, keep: list[str], machine) -> DataFrame:
    """key, keep and the machine's output for each row of dealt_in_order()."""
    kinds = {f.name: f.dataType.simpleString() for f in dealt.schema}
    got = _handed_over(dealt, key, kinds[key], machine) if hasattr(machine, "table") else _settled(dealt, key, machine)
    column = machine.output.split()[0]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, held, size = True, [], 0
        for _, group in _groups(frames, key):
            out, _ = machine.run(group, got.get(int(group["part"][0]), machine.start) if first else machine.start)
            held.append({c: group[c] for c in (key, *keep)} | {column: np.asarray(out)})
            first, size = False, size + len(out)
            if size >= 10_000:
                yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in held[0]})
                held, size = [], 0
        if held:
            yield pd.DataFrame({c: np.concatenate([h[c] for h in held]) for c in held[0]})

    return dealt.mapInPandas(run, ", ".join([f"{c} {kinds[c]}" for c in (key, *keep)] + [machine.output]))
