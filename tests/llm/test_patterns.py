"""Row pattern matching against a plain backtracking search over each client's rows."""

import hashlib
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorebase.llm import patterns

START = datetime(2024, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, props string"


def brute(rows):
    """Letters of each row, then the expression of the contract on them, row by row from every start."""
    out = []
    clients = {r[3] for r in rows if r[3] is not None}
    for client in clients:
        own = sorted({r for r in rows if r[3] == client and r[1] is not None}, key=lambda r: (r[1], r[0]))
        cents = [None if r[5] is None else int((100 * r[5] + 0.5) // 1) for r in own]
        no = 0
        for i in range(len(own)):
            if cents[i] is None:
                continue
            text = ""
            for j in range(i + 1, len(own)):
                near = cents[j] is not None and cents[j - 1] is not None and own[j][1] - own[j - 1][1] <= timedelta(minutes=5)
                moves = near and own[j][4] not in (None, "error")
                letter = "D" if moves and cents[j] < cents[j - 1] else "U" if moves and cents[j] > cents[j - 1] else "-"
                goal = near and own[j][4] == "click" and cents[j] >= cents[i]
                text += letter.lower() if goal else letter if letter != "-" else "."
                if not near:
                    break
            text = text.replace("-", "p")  # a goal that is neither D nor U
            if m := re.match("[Dd]+[Uu]+[dup]", text):
                no += 1
                used = own[i : i + 1 + m.end()]
                inner = text[: m.end() - 1].upper()
                out.append((client, no, own[i][0], used[-1][0], len(used), sum(cents[i : i + 1 + m.end()]), hashlib.sha256(f"A{inner}P".encode()).hexdigest()))
    return sorted(out)


def got(spark, rows, chunk=None, fan=None):
    df = spark.createDataFrame(rows, SCHEMA)
    if chunk is None:
        found = patterns.recoveries(df)
    else:
        real = patterns.matches
        try:
            patterns.matches = lambda *a: real(*a, chunk, fan)
            found = patterns.recoveries(df)
        finally:
            patterns.matches = real
    assert found.columns == ["client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", "labels_sha256"]
    return sorted(tuple(r) for r in found.collect())


def walk(n, seed, client=1, still=0.0):
    """Rows of one client whose value goes down and up in runs."""
    rng, ts, value, rows, way = random.Random(seed), START, 50.0, [], -1
    for k in range(n):
        ts += timedelta(seconds=rng.choice([0, 10, 60, 300, 301] if rng.random() < 0.1 else [5, 30]))
        way = -way if rng.random() < 0.3 else way
        value = max(0.0, value + way * rng.choice([0.0, 0.01, 3.0, 20.0]) * (rng.random() >= still))
        kind = rng.choice(["click", "click", "view", "purchase", "error", None] if rng.random() < 0.3 else ["click", "view"])
        rows.append((client * 100_000 + k, ts, ts, client, kind, None if rng.random() < 0.02 else round(value, 2), None))
    return rows


@pytest.mark.parametrize(("chunk", "fan"), [(None, None), (60, 3)])
def test_against_backtracking(spark, chunk, fan):
    rows = walk(1500, 1) + walk(60, 2, client=2) + walk(3, 3, client=3) + walk(1, 4, client=4)
    rows += rows[5:50] + [(None, START, None, 1, "click", 5.0, None), (7, None, None, 1, "click", 5.0, None), (8, START, None, None, "click", 5.0, None)]
    want = brute([r for r in rows if r[0] is not None])
    assert len(want) > 40
    rows = [r for r in rows if r[0] is not None]
    assert got(spark, rows, chunk, fan) == want


def test_a_match_across_many_chunks(spark):
    """One fall and one rise of hundreds of rows: every start of the fall is open in all chunks between."""
    values = [1000 - k for k in range(150)] + [851 + k / 2 for k in range(1, 400)]
    kinds = ["view"] * 150 + ["click" if k % 7 == 0 else "view" for k in range(399)]
    rows = [(k, START + timedelta(seconds=k), None, 1, kind, float(v), None) for k, (v, kind) in enumerate(zip(values, kinds, strict=True))]
    want = brute(rows)
    assert len(want) == 149
    assert got(spark, rows, 40, 3) == want


def test_edges(spark):
    assert got(spark, []) == []
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, at(0), None, 1, None, 2.0, None), (2, at(0), None, 1, "view", 1.0, None), (3, at(300), None, 1, "view", 1.5, None), (4, at(600), None, 1, "click", 2.0, None)]
    assert got(spark, rows) == brute(rows) != []  # equal times follow by id; five minutes are near enough; a start of any kind
    late = [*rows[:3], (4, at(600) + timedelta(microseconds=1), None, 1, "click", 2.0, None)]
    assert got(spark, late) == brute(late) == []
    odd = [(k, at(k), None, 1, "click", v, None) for k, v in enumerate([float("nan"), float("inf"), 5.0, 4.0, 1e300, 5.0])]
    assert got(spark, odd) == []


def test_extra_columns_and_repeats(spark):
    rows = walk(300, 1)
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.union(df).withColumn("part", F.lit(1)).withColumn("chunk", F.lit("x")).withColumn("id", F.lit(None).cast("long")).withColumn("time", F.lit(0))
    found = sorted(tuple(r) for r in patterns.recoveries(wide).collect())
    assert found == brute(rows) != []


def test_composition_is_associative():
    """Any way to put chunks together gives the same function."""
    import pyarrow as pa

    rng = random.Random(5)
    n = 60
    table = {"client": [1] * n, "time": list(range(n)), "id": list(range(n)), "value": [rng.choice([None, *range(8)]) if rng.random() < 0.9 else 3 for _ in range(n)]}
    table |= {"step1": [rng.random() < 0.9 for _ in range(n)], "step2": [rng.random() < 0.9 for _ in range(n)], "goal": [rng.random() < 0.5 for _ in range(n)]}
    table = pa.table(table, schema=pa.schema([("client", pa.int64()), ("time", pa.int64()), ("id", pa.int64()), ("value", pa.int64()), ("step1", pa.bool_()), ("step2", pa.bool_()), ("goal", pa.bool_())]))
    whole = lambda a, b: patterns._Rows(table.slice(a, b - a), "<>", 5).chunk(0, b - a)
    for _ in range(40):
        a, b, c = sorted(rng.sample(range(1, n), 3))
        left = patterns.composed(patterns.composed(whole(0, a), whole(a, b), "<>", 5), whole(b, c), "<>", 5)
        right = patterns.composed(whole(0, a), patterns.composed(whole(a, b), whole(b, c), "<>", 5), "<>", 5)
        assert left.packed() == right.packed() == whole(0, c).packed()
