"""Row pattern matching: ``A S1+ S2+ ... G`` over each client's rows in time order, however many a client has.

All rows are dealt by range of (client, time, id), so a huge client lies in many tasks, each with one
chunk of it. A task resolves every start that ends in its chunk, and summarises the chunk as a function
of the state that a match may be in when it comes from before: the state at the end, where each step
began, and the staircase of goals met on the way (the latest goal, then the next earlier one of greater
value, and so on: a start takes the latest whose value reaches its own). These functions compose
associatively, so a tree of groups of FAN chunks gives for each chunk the function of all that follows,
which resolves the starts that are still open at its end. A second scan over the numbers of matches
numbers them across chunks; a start's resume position is its next row, so the chains from all entry
positions meet at the first row of a chunk, and the number of matches before it is all they carry.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, tasks_for

#: Rows of a chunk, and chunks (or nodes) that one group of the tree composes.
CHUNK, FAN = 1_000_000, 64


@dataclass(frozen=True)
class Pattern:
    """``first``, then one or more rows of each of ``steps``, then ``goal``.

    A step is (letter, relation to the value of the row before: "<" or ">", condition of the row alone).
    Steps that follow each other need different relations, so that a row fits one of them. The goal needs
    its condition and at least the first row's value. Rows with a null value fit nothing, and every
    row but the first comes at most ``gap_us`` microseconds after the row before it.
    """

    first: str
    steps: tuple[tuple[str, str, Column], ...]
    goal: tuple[str, Column]
    gap_us: int

    def __post_init__(self):
        relations = [r for _, r, _ in self.steps]
        if not relations or any(r not in "<>" for r in relations) or any(a == b for a, b in zip(relations, relations[1:], strict=False)):
            raise ValueError("steps need the relations < and > in turns")


@dataclass
class Run:
    """What becomes of a match in one state: the state at the end (-1: over), where steps began, and the staircase of goals, latest first."""

    state: int
    begun: dict[int, int] = field(default_factory=dict)
    stairs: list[list[int]] = field(default_factory=list)  # [position, value, sum up to it, id]


@dataclass
class Chunk:
    """Rows as a function: ``runs[s]`` is what follows the first row if the state after that row is s. Positions count from the first row."""

    n: int
    total: int
    first: list  # time, value or null, step conditions, goal condition, id
    last: list  # time, value or null
    runs: list[Run]

    def packed(self) -> str:
        return json.dumps([self.n, self.total, self.first, self.last, [[r.state, list(r.begun.items()), r.stairs] for r in self.runs]])

    @staticmethod
    def unpacked(text: str) -> Chunk:
        n, total, first, last, runs = json.loads(text)
        return Chunk(n, total, first, last, [Run(s, dict(map(tuple, b)), g) for s, b, g in runs])


def enter(state: int, last: list, after: Chunk, relations: str, gap_us: int) -> Run:
    """What becomes of a match in ``state`` behind the row ``last`` when the rows of ``after`` follow."""
    time, value, fits, goal, key = after.first
    if value is None or last[1] is None or time - last[0] > gap_us:
        return Run(-1)
    k = next((s for s, r in enumerate(relations, 1) if fits[s - 1] and (value < last[1] if r == "<" else value > last[1]) and s in (state, state + 1)), -1)
    found = [[0, value, value, key]] if goal and state == len(relations) else []
    if k < 0:
        return Run(-1, {}, found)
    rest = after.runs[k]
    return Run(rest.state, ({k: 0} if k > state else {}) | rest.begun, joined(rest.stairs, found))


def joined(later: list, earlier: list) -> list:
    """One staircase of two: of the earlier goals those above all later ones."""
    return later + [g for g in earlier if not later or g[1] > later[-1][1]]


def composed(a: Chunk, b: Chunk, relations: str, gap_us: int) -> Chunk:
    """The function of ``a``'s rows followed by those of ``b``."""
    runs = []
    for run in a.runs:
        if run.state < 0:
            runs.append(run)
            continue
        on = enter(run.state, a.last, b, relations, gap_us)
        begun = run.begun | {s: p + a.n for s, p in on.begun.items()}
        runs.append(Run(on.state, begun, joined([[p + a.n, v, t + a.total, i] for p, v, t, i in on.stairs], run.stairs)))
    return Chunk(a.n + b.n, a.total + b.total, a.first, b.last, runs)


class _Rows:
    """The rows of one task as arrays, with the functions that need no other task."""

    def __init__(self, t: pa.Table, relations: str, gap_us: int):
        self.client, self.time = (t.column(c).cast(pa.int64()).to_numpy() for c in ("client", "time"))
        self.id = t.column("id")
        self.real = ~t.column("value").is_null().to_numpy(zero_copy_only=False)
        self.value = t.column("value").fill_null(0).to_numpy()
        fits = [t.column(f"step{s}").to_numpy(zero_copy_only=False) for s in range(1, len(relations) + 1)]
        self.fits, self.aim = fits, t.column("goal").to_numpy(zero_copy_only=False)
        n, self.k = len(self.client), len(relations)
        near = np.zeros(n, bool)
        near[1:] = (self.client[1:] == self.client[:-1]) & self.real[1:] & self.real[:-1] & (self.time[1:] - self.time[:-1] <= gap_us)
        below, above = np.zeros(n, bool), np.zeros(n, bool)
        below[1:], above[1:] = self.value[1:] < self.value[:-1], self.value[1:] > self.value[:-1]
        # inside[s]: the row begins step s or goes on in it; run_end[s]: the last row of its run of such rows
        self.inside = [None] + [near & f & (below if r == "<" else above) for f, r in zip(fits, relations, strict=True)]
        self.goal = near & self.aim
        self.bounds = np.flatnonzero(np.append(True, self.client[1:] != self.client[:-1]))
        self.ends = np.append(self.bounds[1:], n)
        self.stop = np.repeat(self.ends, self.ends - self.bounds)  # the row behind the client's last one here
        self.sums = np.concatenate([[0], np.cumsum(np.where(self.real, self.value, 0))])
        places = np.arange(n)
        self.run_end = [None]
        for inside in self.inside[1:]:
            broken = np.where(inside, n, places)  # rows outside end the run before them
            self.run_end.append(np.minimum.accumulate(broken[::-1])[::-1] - 1)
        self.latest, self.higher = np.append(np.maximum.accumulate(np.where(self.goal, places, -1)), -1), np.full(n, -1)
        stack: list[int] = []
        for p in np.flatnonzero(self.goal).tolist():  # the nearest earlier goal of greater value
            while stack and self.value[stack[-1]] <= self.value[p]:
                stack.pop()
            self.higher[p] = stack[-1] if stack else -1
            stack.append(p)

    def advance(self, at: np.ndarray, state: np.ndarray):
        """For matches in ``state`` after row ``at``: (state at the client's end here or -1, first rows of the steps, first and last place where goals count)."""
        alive, state, at = np.ones(len(at), bool), state.copy(), at.copy()
        stop = self.stop[at]
        begun = np.full((len(at), self.k + 1), -1)
        low = np.where(state == self.k, at + 1, -1)
        for s in range(1, self.k + 1):
            here = alive & (state == s)  # goes on in its step
            nxt = np.minimum(at + 1, len(self.client) - 1)
            on = here & (at + 1 < stop) & self.inside[s][nxt]
            at = np.where(on, np.minimum(self.run_end[s][nxt], stop - 1), at)
            here = alive & (state == s - 1) & (at + 1 < stop)  # begins it
            nxt = np.minimum(at + 1, len(self.client) - 1)
            new = here & self.inside[s][nxt]
            alive &= ~(here & ~new)
            begun[new, s] = nxt[new]
            if s == self.k:
                low = np.where(new, nxt + 1, low)
            at = np.where(new, np.minimum(self.run_end[s][nxt], stop - 1), at)
            state = np.where(new, s, state)
        high = np.where(alive & (state == self.k), np.minimum(at + 1, stop - 1), -1)
        open_ = alive & (at + 1 >= stop)
        return np.where(open_, state, -1), begun, low, high

    def best(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The latest goal from ``low`` to ``high`` of a value of ``least`` or more; -1 if there is none."""
        at = np.where(high >= 0, self.latest[high], -1)
        at = np.where(at >= low, at, -1)
        while (short := (at >= 0) & (self.value[at] < least)).any():
            up = self.higher[at]
            at = np.where(short, np.where(up >= low, up, -1), at)
        return at

    def chunk(self, a: int, b: int) -> Chunk:
        """The client's rows from a to b (exclusive) as a function."""
        states = np.arange(self.k + 1)
        end, begun, low, high = self.advance(np.full(self.k + 1, a), states)
        value = lambda p: int(self.value[p]) if self.real[p] else None
        runs = []
        for s in states:
            at, stairs = int(self.latest[high[s]]) if high[s] >= 0 else -1, []
            while at >= low[s] >= 0 and at >= 0:
                stairs.append([at - a, int(self.value[at]), int(self.sums[at + 1] - self.sums[a]), self.id[at].as_py()])
                at = int(self.higher[at])
            runs.append(Run(int(end[s]), {t: int(p) - a for t, p in enumerate(begun[s]) if p >= 0}, stairs))
        first = [int(self.time[a]), value(a), [bool(f[a]) for f in self.fits], bool(self.aim[a]), self.id[a].as_py()]
        return Chunk(b - a, int(self.sums[b] - self.sums[a]), first, [int(self.time[b - 1]), value(b - 1)], runs)


_START = "client long, part long, at long, first_id long, last_id long, n_rows long, total long, begun array<long>, state int, least long, n_left long, sum_left long, chunk string"
_ARROW = pa.schema([(c.split()[0], {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[c.split()[1]]) for c in _START.split(", ")])


def _columns(**c) -> pa.RecordBatch:
    n = len(next(iter(c.values())))
    return pa.RecordBatch.from_arrays([pa.array(c[f.name], f.type) if f.name in c else pa.nulls(n, f.type) for f in _ARROW], schema=_ARROW)


def _task(it, relations: str, gap_us: int):
    """Of one task's rows: a row for each match that ends here and each start open at the end of the last client's rows, and the functions of the first and the last client."""
    batches = [b for b in it if b.num_rows]
    if not batches:
        return
    rows, part = _Rows(pa.Table.from_batches(batches).combine_chunks(), relations, gap_us), TaskContext.get().partitionId()
    del batches
    spans = {(int(rows.bounds[i]), int(rows.ends[i])) for i in (0, -1)}
    yield _columns(client=[int(rows.client[a]) for a, _ in spans], part=[part] * len(spans), n_rows=[b - a for a, b in spans], chunk=[rows.chunk(a, b).packed() for a, b in spans])
    starts = np.flatnonzero(rows.real)
    first_of_last, n = int(rows.bounds[-1]), len(rows.client)
    bounds = np.repeat(rows.bounds, rows.ends - rows.bounds)
    for at in range(0, len(starts), 100_000):
        i = starts[at : at + 100_000]
        state, begun, low, high = rows.advance(i, np.zeros(len(i), np.int64))
        goal = rows.best(low, high, rows.value[i])
        open_ = (state >= 0) & (i >= first_of_last)
        keep = np.flatnonzero((goal >= 0) | open_)
        i, begun, goal, open_, state = i[keep], begun[keep], goal[keep], open_[keep], state[keep]
        if not len(i):
            continue
        none = goal < 0
        some = lambda x, gone: pa.array(x, mask=gone)
        ids = rows.id.take(pa.array(np.where(none, 0, goal)))
        yield _columns(
            client=rows.client[i], part=np.full(len(i), part), at=i - bounds[i], first_id=rows.id.take(pa.array(i)).combine_chunks(),
            last_id=some(np.array(ids.to_pylist(), object), none), n_rows=some(goal - i + 1, none), total=some(rows.sums[goal + 1] - rows.sums[i], none),
            begun=[[int(p) - int(s) for p in b[1:] if p >= 0] for b, s in zip(begun, i, strict=True)],
            state=some(state.astype(np.int32), ~open_), least=rows.value[i], n_left=some(n - i, ~open_), sum_left=some(rows.sums[n] - rows.sums[i], ~open_),
        )


def scanned(nodes: DataFrame, n: int, merge: Callable[[str, str], str], forward: bool, fan: int = FAN) -> DataFrame:
    """(client, part, chunk) with the merged values of all the client's nodes before each one (``forward``) or behind it; null where there are none.

    ``nodes`` has (client, part, chunk) with parts under n. Groups of ``fan`` nodes are merged level by level
    and the outer values handed down again: no group has more than ``fan`` nodes.
    """
    form = "client long, part long, chunk string"

    def up(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("part")
        value = df["chunk"].iloc[0]
        for x in df["chunk"].iloc[1:]:
            value = merge(value, x)
        return pd.DataFrame({"client": df["client"].iloc[:1], "part": df["part"].iloc[:1] // fan, "chunk": [value]})

    def down(df: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("part", ascending=forward)
        value, out = next((x for x in outer["chunk"] if isinstance(x, str)), None), []
        for x in df["chunk"]:
            out.append(value)
            value = x if value is None else merge(value, x) if forward else merge(x, value)
        return df.assign(chunk=pd.Series(out, index=df.index, dtype=object))

    levels, over = [nodes], F.floor(F.col("part") / fan)
    while n > fan:
        levels.append(checkpointed(levels[-1].groupBy("client", over.alias("over")).applyInPandas(up, form)))
        n = -(-n // fan)
    top = nodes.sparkSession.createDataFrame([], form)
    for level in reversed(levels):
        top = level.groupBy("client", over.alias("over")).cogroup(top.groupBy("client", F.col("part").alias("over"))).applyInPandas(down, form)
    return top


def matches(df: DataFrame, client: str, time: str, key: str, value: Column, pattern: Pattern, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """Per match: client_id, match_no (from 1), first_id, last_id, n_rows, total, runs (rows of each step).

    Distinct rows of ``df`` in the order of ``time``, ``key`` (both from ``df``, ``key`` and ``client`` whole
    numbers); rows without client or time are left out, a null key comes first. Every row starts a search, as
    after a match the next row does. Rows equal in time and key but not elsewhere follow in the order of
    value and conditions. An empty table gives no rows; columns beside those named only tell rows apart.
    """
    relations, gap_us = "".join(r for _, r, _ in pattern.steps), pattern.gap_us
    cells = [F.coalesce(c, F.lit(False)) for c in (*(c for _, _, c in pattern.steps), pattern.goal[1])]
    names = [*(f"step{s}" for s in range(1, len(relations) + 1)), "goal"]
    rows = df.where(F.col(client).isNotNull() & F.col(time).isNotNull()).distinct().select(F.col(client).cast("long").alias("client"), F.col(time).alias("time"), F.col(key).cast("long").alias("id"), value.alias("value"), *(c.alias(n) for c, n in zip(cells, names, strict=True)))
    rows = checkpointed(rows)
    n, order = tasks_for(df.sparkSession, rows.count(), chunk), ["client", "time", "id", "value", *names]
    found = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(lambda it: _task(it, relations, gap_us), _START)
    found = checkpointed(found)
    n = max(n, found.rdd.getNumPartitions())

    def merge(a: str, b: str) -> str:
        return composed(Chunk.unpacked(a), Chunk.unpacked(b), relations, gap_us).packed()

    chunks = found.where("chunk is not null").select("client", "part", "chunk", "n_rows")
    behind = scanned(chunks.select("client", "part", "chunk"), n, merge, False, fan).where("chunk is not null")
    own = chunks.select("client", "part", F.get_json_object("chunk", "$[3]").alias("last"))
    facts = behind.join(own.hint("merge"), ["client", "part"])

    def resolve(open_: pa.Table, after: pa.Table) -> pa.Table:
        """The open starts of a chunk with the function of what follows it."""
        parts, kept = [], {}
        follow = [(Chunk.unpacked(r["chunk"]), json.loads(r["last"])) for r in after.to_pylist()]
        for batch in open_.to_batches(10_000):
            rows = batch.to_pylist()
            for r in rows if follow else ():
                if r["state"] not in kept:
                    kept[r["state"]] = enter(r["state"], follow[0][1], follow[0][0], relations, gap_us)
                run = kept[r["state"]]
                if goal := next((g for g in run.stairs if g[1] >= r["least"]), None):
                    r |= {"last_id": goal[3], "n_rows": r["n_left"] + goal[0] + 1, "total": r["sum_left"] + goal[2]}
                    r["begun"] = [*r["begun"], *(r["n_left"] + p for _, p in sorted(run.begun.items()))]
            parts.append(pa.Table.from_pylist([r for r in rows if r["n_rows"] is not None], _ARROW))
        return pa.concat_tables(parts) if parts else _ARROW.empty_table()

    starts = found.where("chunk is null")
    late = starts.where("state is not null").groupBy("client", "part").cogroup(facts.groupBy("client", "part")).applyInArrow(resolve, _START)
    every = checkpointed(starts.where("state is null").unionByName(late).select("client", "part", "at", "first_id", "last_id", "n_rows", "total", "begun"))
    counts = every.groupBy("client", "part").agg(F.count("*").cast("string").alias("chunk"))
    counts = counts.join(chunks.select("client", "part").hint("merge"), ["client", "part"])  # only clients at a task's edge go on elsewhere
    before = scanned(counts, n, lambda a, b: str(int(a) + int(b)), True, fan).where("chunk is not null").select("client", "part", F.col("chunk").cast("long").alias("before"))
    place = F.row_number().over(Window.partitionBy("client", "part").orderBy("at")).cast("long")
    numbered = every.withColumn("place", place).join(before.hint("merge"), ["client", "part"], "left")
    k = len(relations)
    ends = [F.get("begun", F.lit(s)) for s in range(1, k)] + [F.col("n_rows") - 1]
    runs = F.array(*(e - F.get("begun", F.lit(s)) for s, e in enumerate(ends)))
    return numbered.select(F.col("client").alias("client_id"), (F.col("place") + F.coalesce("before", F.lit(0))).alias("match_no"), "first_id", "last_id", "n_rows", "total", runs.alias("runs"))


def recoveries(clicks: DataFrame) -> DataFrame:
    """Falls of a client's value that it has made good: ``A D+ U+ P``, with P a click at A's value or above, in cents.

    Null, NaN, infinite and (from 9e16 on) overlong values fit no letter, null kinds neither D, U nor P.
    """
    real = (~F.isnan("value")) & (F.abs("value") < 9e16)
    cents, moves = F.when(real, F.floor(100 * F.col("value") + 0.5)), F.col("kind") != "error"
    fall = Pattern("A", (("D", "<", moves), ("U", ">", moves)), ("P", F.col("kind") == "click"), 300_000_000)
    letters = [F.expr(f"repeat('{letter}', int(runs[{s}]))") for s, (letter, _, _) in enumerate(fall.steps)]
    labels = F.concat(F.lit(fall.first), *letters, F.lit(fall.goal[0]))
    found = matches(clicks, "client_id", "ts", "click_id", cents, fall)
    return found.select("client_id", "match_no", "first_id", "last_id", "n_rows", F.col("total").alias("sum_cents"), F.sha2(labels, 256).alias("labels_sha256"))


ORACLE = """
with o as (select client_id, click_id, ts, kind, floor(100*value+0.5)::bigint as cents, row_number() over w as rn,
    lag(ts) over w as ts0, lag(floor(100*value+0.5)::bigint) over w as cents0
  from (select distinct * from clicks) where client_id is not null and ts is not null window w as (partition by client_id order by ts, click_id)),
c as (select *, coalesce(ts - ts0 <= interval 5 minute and cents is not null and cents0 is not null, false) as near,
    case when near and kind <> 'error' and cents < cents0 then 'D' when near and kind <> 'error' and cents > cents0 then 'U' else '-' end as step,
    coalesce(near and kind = 'click', false) as goal, sum(coalesce(cents, 0)) over (partition by client_id order by rn) as total from o),
g as (select *, rn - row_number() over (partition by client_id, step order by rn) as run from c),
r as (select client_id, step, run, min(rn) as a, max(rn) as b from g where step <> '-' group by all),
s as (select x.client_id, x.rn, x.click_id, x.cents, x.total - x.cents as total0, d.b - x.rn as d, u.a as u0, u.b as u1, u.run
  from g x join g y on y.client_id = x.client_id and y.rn = x.rn + 1 and y.step = 'D'
  join r d on d.client_id = x.client_id and d.step = 'D' and d.run = y.run
  join r u on u.client_id = x.client_id and u.step = 'U' and u.a = d.b + 1
  where x.cents is not null),
e as (select s.client_id, s.rn, g.rn as last from s join g on g.client_id = s.client_id and g.rn = s.u1 + 1 and g.goal and g.cents >= s.cents
  union all select s.client_id, s.rn, g.rn from s join g on g.client_id = s.client_id and g.step = 'U' and g.run = s.run and g.rn > s.u0 and g.goal and g.cents >= s.cents),
m as (select client_id, rn, max(last) as last from e group by all)
select m.client_id, row_number() over (partition by m.client_id order by m.rn) as match_no, s.click_id as first_id, g.click_id as last_id, m.last - m.rn + 1 as n_rows,
  (g.total - s.total0)::bigint as sum_cents, sha256('A' || repeat('D', s.d::int) || repeat('U', (m.last - s.u0)::int) || 'P') as labels_sha256
from m join s using (client_id, rn) join g on g.client_id = m.client_id and g.rn = m.last
"""
