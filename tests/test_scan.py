"""Two-level running measures, composed recursions and the streaming jobs that use them, against plain versions."""

import datetime as dt
import math
import random
import re

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelwright.functions import window as T
from panelwright.operators import panel as P
from panelwright.operators import scan
from panelwright.streaming import jobs

START = dt.datetime(2024, 1, 1)


def series(n, seed, missing=0.0):
    draw = random.Random(seed)
    at, rows = START, []
    for _ in range(n):
        at += dt.timedelta(minutes=draw.choice([1, 20, 600, 4000]))
        rows.append((draw.choice(["a", "b", "c"]), at, None if draw.random() < missing else float(draw.randint(-9, 9))))
    return rows


def plain_plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_running_measures(spark):
    rows = series(400, 1, 0.2)
    df = scan.bucketed(spark.createDataFrame(rows, "symbol string, ts timestamp, x double"), ["symbol"], "ts")
    x = F.col("x")
    got = scan.running(df, ["symbol"], ["ts"], s=("sum", x), hi=("max", x), lo=("min", x), late=("last", x), before=("previous", x)).orderBy("ts").collect()
    past: dict[str, list] = {}
    assert [(r["symbol"], r["x"]) for r in got] == [(s, v) for s, _, v in rows]
    for r in got:
        mine = past.setdefault(r["symbol"], [])
        assert (r["before"] is None) == (not mine) and (not mine or r["before"]["value"] == mine[-1])
        mine.append(r["x"])
        there = [v for v in mine if v is not None]
        assert (r["s"], r["hi"], r["lo"], r["late"]) == (sum(there), max(there, default=None), min(there, default=None), there[-1] if there else None)


def test_composed_maps():
    draw = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 100):
        a, b, c = draw.choice([0.0, 0.5, 1.0, 0.93], n), draw.normal(size=n), draw.normal(size=n)
        s = t = 3.0
        want = [(s := a[i] * s + b[i], t := a[i] * t + c[i]) for i in range(n)]
        decay, left, right = scan.compose(a, b, c)
        assert np.allclose(np.column_stack([decay * 3 + left, decay * 3 + right]), want)


def plain_rsi(values, n):
    before, seen, gain, loss, out = None, 0, 0.0, 0.0, []
    for v in values:
        if v is None or before is None:
            seen, gain, loss = 0, 0.0, 0.0
        else:
            up, down, seen = max(v - before, 0), max(before - v, 0), seen + 1
            gain, loss = (gain + up / n, loss + down / n) if seen <= n else (gain + (up - gain) / n, loss + (down - loss) / n)
        before = v
        out.append(None if v is None or seen < n else 50.0 if gain + loss == 0 else 100 * gain / (gain + loss))
    return out


def close(a, b):
    return len(a) == len(b) and all(x == y or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9)) for x, y in zip(a, b, strict=True))


def test_index_of_one_long_symbol_spreads_over_tasks(spark):
    rows = [("a", START + dt.timedelta(hours=i), None if i in (300, 301, 700) else float((i * 7919) % 101)) for i in range(1500)]
    made = T.ts_rsi(spark.createDataFrame(rows, "symbol string, ts timestamp, x double"), "x", 5, bucket="day")
    assert close([r["rsi"] for r in made.orderBy("ts").collect()], plain_rsi([r[2] for r in rows], 5))
    # No window takes a whole symbol's rows: those by symbol alone have one row a bucket.
    assert not re.findall(r"windowspecdefinition\(symbol#\d+, ts", plain_plan(made))


def test_funding_totals_have_no_window_over_a_symbol(spark):
    events = spark.createDataFrame([("a", START, 0.1, 8.0)], "symbol string, event_ts timestamp_ntz, rate double, interval_hours double")
    left = events.select("symbol", F.col("event_ts").alias("available_at"))
    assert not re.findall(r"windowspecdefinition\(symbol#\d+, (event_ts|_t)", plain_plan(P.funding_window(left, events, 24)))


def test_index_goes_on_from_batch_to_batch(spark):
    rows = [(s, t, 1, v) for s, t, v in series(300, 5, 0.1)]
    schema = "symbol string, ts timestamp, user_id long, value double"
    before = spark.createDataFrame([], "symbol string, ts timestamp, x double, seen long, gain double, loss double")
    found = []
    for part in (rows[:3], rows[3:120], [r for r in rows[120:200] if r[0] != "b"], rows[200:]):
        out, after = jobs.rsi_of_batch(spark.createDataFrame(part, schema), before, 4, ["symbol"])
        found += out.collect()
        before = spark.createDataFrame(after.collect(), after.schema)
    kept = [*rows[:120], *(r for r in rows[120:200] if r[0] != "b"), *rows[200:]]
    for symbol in "abc":
        assert close([r["rsi"] for r in sorted(found, key=lambda r: r["ts"]) if r["symbol"] == symbol], plain_rsi([r[3] for r in kept if r[0] == symbol], 4))


class _Handle:
    """A key's state and timers, as Spark keeps them."""

    def __init__(self):
        self.timers, self.held = set(), {}

    def getValueState(self, name, schema):
        return _State(self.held, name)

    getListState = getValueState

    def registerTimer(self, at):
        self.timers.add(at)


class _State:
    def __init__(self, held, name):
        self.held, self.name = held, name

    def exists(self):
        return self.name in self.held

    def get(self):
        return self.held[self.name]

    def put(self, value):
        self.held[self.name] = value

    update = put

    def appendList(self, rows):
        self.held[self.name] = [*self.held.get(self.name, []), *rows]

    def clear(self):
        self.held.pop(self.name, None)


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_snapshots_out_of_order_with_expiry():
    """Rows of ten batches in random order within half an hour, against the latest snapshot of the whole; state goes when it expires."""
    draw = random.Random(9)
    minute = 60_000_000
    rows = [(draw.randrange(0, 3000) * minute // 10, draw.randrange(2), i, *(None if draw.random() < 0.4 else float(v) for v in (i, -i))) for i in range(300)]
    rows = [(t, side, i if side else None, None if side else x, None if side else y) for t, side, i, x, y in rows]
    snapshots = sorted(((t, x, y) for t, side, _, x, y in rows if not side), key=lambda s: (s[0], s[1] is not None, s[1] or 0, s[2] is not None, s[2] or 0))
    want = {}
    for t, side, i, _, _ in rows:
        if side:
            latest = [s for s in snapshots if s[0] <= t][-1:]
            fresh = latest and t - latest[0][0] < 5 * minute
            values = latest[0][1:] if fresh else (None, None)
            want[i] = (*values, "stale" if not fresh else ("missing", "partial", "valid")[sum(v is not None for v in values)])
    job, handle = jobs.Snapshots(5, ["x", "y"], "ask"), _Handle()
    job.init(handle)
    came, found, mark = sorted(rows, key=lambda r: r[0] + draw.randrange(30) * minute), {}, 0

    def fire(clock):
        while due := [t for t in handle.timers if t <= clock.ms]:
            handle.timers.discard(min(due))
            for part in job.handleExpiredTimer(("k",), clock, None):
                found.update({r.ask: (*(None if pd.isna(v) else v for v in (r.x, r.y)), r.status) for r in part.itertuples()})

    for k in range(0, len(came), 30):
        part = came[k : k + 30]
        job.handleInputRows(("k",), iter([pd.DataFrame(part, columns=["micros", "side", "ask", "x", "y"])]), None)
        fire(_Clock(mark))
        mark = max(mark, max(r[0] for r in part) // 1000 - 30 * 60_000)
    fire(_Clock(10**9))
    assert found == want and len({w[2] for w in want.values()}) == 4
    assert not handle.held and not handle.timers
