"""Skewed keys, nested records and intervals on awkward input."""

import json
import random
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skydrift.operators import intervals, nested, skew

HITS = "coarse_channel int, obs_id string, hit_id long, incoherent_snr double, n long, b string"


def test_heavy_keys_ties_nulls_nan_and_clashing_columns(spark):
    rows = [(5, "a", i, 1.0, 9, "x") for i in range(3, 63)] + [(5, "a", 2, 7.0, 9, "x"), (5, "a", 1, 7.0, 9, "x"), (5, "a", 1, 7.0, 9, "x")]
    rows += [(6, "a", 900, None, 9, "x"), (6, "a", 901, float("nan"), 9, "x"), (None, "a", 902, 99.0, 9, "x"), (400, "a", 903, 99.0, 9, "x"), (5, None, 904, 99.0, 9, "x")]
    df = spark.createDataFrame(rows, HITS)
    got = [tuple(r)[:3] for r in skew.heavy_key_best(df, "coarse_channel", "obs_id", "incoherent_snr", "hit_id", share=50).collect()]
    assert sorted(got) == [(5, "a", 1), (6, "a", 900)]
    assert skew.heavy_key_best(df.limit(0), "coarse_channel", "obs_id", "incoherent_snr", "hit_id").count() == 0
    counts = {r[0]: r["n"] for r in skew.key_counts(df, "coarse_channel", 0, 255).collect()}
    assert counts == {5: 64, 6: 2, None: 2}


def test_one_key_with_most_rows(spark):
    df = spark.range(20000).selectExpr("if(id % 3 > 0, 7, cast(id % 200 as int)) as coarse_channel", "concat('o', id % 5) as obs_id", "id as hit_id", "cast(id % 97 as double) as incoherent_snr")
    got = {(r[0], r[1]): r[2] for r in skew.heavy_key_best(df, "coarse_channel", "obs_id", "incoherent_snr", "hit_id").collect()}
    want = {}
    for r in df.collect():
        k = (r[0], r[1])
        if k[0] == 7 and (k not in want or (-r[3], r[2]) < want[k]):
            want[k] = (-r[3], r[2])
    assert got == {k: v[1] for k, v in want.items()}


def merged(ranges):
    out = []
    for a, b in sorted(r for r in ranges if r[1] > r[0]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2] += 1
        else:
            out.append([a, b, 1])
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 60), st.integers(1, 40)), min_size=1, max_size=40))
def test_dyadic_runs_equal_sweep(items):
    bits = 7
    items = sorted((k, a, min(128, a + n)) for k, a, n in items)
    keys = sorted({k for k, _, _ in items})
    dense = np.array([keys.index(k) for k, _, _ in items])
    k, a, b, n = intervals.dyadic_runs(dense, np.array([x[1] for x in items]), np.array([x[2] for x in items]), np.ones(len(items), np.int64), bits)
    got = [[keys[i], x, y, m] for i, x, y, m in zip(k.tolist(), a.tolist(), b.tolist(), n.tolist())]
    assert got == [[key, *r] for key in keys for r in merged([(x, y) for q, x, y in items if q == key])]


def test_periods_and_gaps_against_sweep_across_segments_and_batches(spark):
    rng = random.Random(5)
    rows = []
    for k in ("a", "b", None):
        for _ in range(3000):
            a = rng.randrange(0, 40_000_000)
            rows.append((k, a, a + rng.choice([1, 50, 31250, -3, 0, 3_000_000 if rng.random() < 0.01 else 900]), 1, "x"))
    rows += [("a", None, 5, 1, "x"), ("a", 5, None, 1, "x"), ("b", 10, 20, 1, "x"), ("b", 10, 20, 1, "x"), ("c", -100, -50, 1, "x"), ("c", -50, 7, 1, "x"), ("c", 9, 12, 1, "x")]
    df = spark.createDataFrame(rows, "k string, row0 long, row1 long, n int, kind string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        got = sorted(tuple(r) for r in intervals.periods_and_gaps(df, ["k"]).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = []
    for k in ("a", "b", "c"):
        m = merged([(a, b) for q, a, b, *_ in rows if q == k and a is not None and b is not None])
        want += [(k, "period", *x) for x in m] + [(k, "gap", x[1], y[0], 0) for x, y in zip(m, m[1:])]
    assert got == sorted(want)
    assert intervals.periods_and_gaps(df.limit(0), ["k"]).count() == 0


def found(spark, payloads):
    t = [datetime(2025, 1, 1), datetime(2025, 1, 2), datetime(2025, 1, 3)]
    rows = [(r, t[k], p, "x", 1) for r, k, p in payloads]
    df = spark.createDataFrame(rows, "report_id long, received_at timestamp, payload string, doc string, name int")
    tables = nested.report_tables(df)
    return sorted(tuple(r) for r in nested.channels_table(tables).collect()), tables


def test_nested_shapes_depths_and_versions(spark):
    a = {"plan_name": "p", "signals": [{"name": "s", "target_channels": [{"channel_index": 3}, {"channel_index": "4"}, {"channel_index": 3.0}]}, {"name": "t", "target_channels": None},
                                       {"name": "u", "target_channels": {"7": {"amp": 1}, "8": {}}}, {"name": "v", "target_channels": {"channel_index": 9}},
                                       {"name": "w", "target_channels": json.dumps([{"channel_index": 5}])}, {"name": "x", "resolved": json.dumps({"start_s": "2.5"})}]}
    one = {"plan_name": "q", "signals": {"name": "lone", "target_channels": []}}
    payloads = [(1, 0, json.dumps(a)), (1, 1, json.dumps(a)[:-5]), (1, 2, None), (2, 0, json.dumps(one)), (2, 1, json.dumps({"payload": {"report": a}, "version": 2})),
                (3, 0, json.dumps({"report": one})), (4, 0, json.dumps({"plan_name": "no signals"})), (5, 0, "{"), (6, 0, ""), (7, 0, "[]"), (8, 0, "7"),
                (9, 0, json.dumps({"plan_name": "t", "signals": json.dumps([{"name": "z", "target_channels": [{"channel_index": 1}]}])})),
                # A byte-order mark, a record in an array, one held as text, and a wrapper with an odd name.
                (10, 0, "\ufeff" + json.dumps(one)), (11, 0, json.dumps([1, {"x": 2}, {"in": [[], [one]]}])), (12, 0, json.dumps({"body": " " + json.dumps({"report": one})})),
                (13, 0, json.dumps({"a.b [c]": {"it's `odd`?": one}}))]
    got, tables = found(spark, payloads)
    of_a = [(1, 3), (1, 4), (2, -1), (3, 7), (3, 8), (4, 9), (5, 5), (6, -1)]
    assert got == [(1, *x) for x in of_a] + [(2, *x) for x in of_a] + [(3, 1, -1), (9, 1, 1)] + [(k, 1, -1) for k in (10, 11, 12, 13)]
    signals = {(r["report_id"], r["signal_no"]): r for r in nested.signals_table(tables).collect()}
    assert signals[1, 6]["start_s"] == 2.5 and signals[3, 1]["name"] == "lone" and signals[1, 2]["start_s"] is None
    assert {r["report_id"]: r["plan_name"] for r in nested.reports_table(tables).collect()} == {1: "p", 2: "p", 3: "q", 4: "no signals", 7: None, 8: None, 9: "t", 10: "q", 11: "q", 12: "q", 13: "q"}


def test_levels_that_no_code_names_become_tables(spark):
    docs = {1: {"kind": "k", "runs": [{"at": 1, "steps": [{"n": 1.5, "w": [7, 8]}, {"n": "x", "opt": {"deep": [{"z": True}]}}]}, {"at": 2, "steps": None}]},
            2: {"wrap": {"kind": "l", "runs": {"at": 3, "steps": json.dumps([{"n": 4}])}}}, 3: {"kind": "m", "runs": {"a": {"steps": []}, "b": {"at": 5}}}, 4: {"kind": "n"}}
    df = spark.createDataFrame([(k, json.dumps(d)) for k, d in docs.items()], "id long, t string").selectExpr("id", "parse_json(t) AS doc")
    tables = nested.shred(df, "id", {"kind"})
    assert set(tables) == {"", "runs", "runs.steps", "runs.steps.w", "runs.steps.opt.deep"}
    rows = lambda name, *c: sorted(tuple(r) for r in nested.scalars(tables[name]).select(*c).collect())
    assert rows("", "id", "kind") == [(1, "k"), (2, "l"), (3, "m"), (4, "n")]
    assert sorted(rows("runs", "id", "runs_no", "name", "at"), key=repr) == sorted([(1, 1, None, 1.0), (1, 2, None, 2.0), (2, 1, None, 3.0), (3, 1, "a", None), (3, 2, "b", 5.0)], key=repr)
    assert rows("runs.steps", "id", "runs_no", "steps_no", "n") == [(1, 1, 1, "1.5"), (1, 1, 2, "x"), (2, 1, 1, "4")]
    assert sorted((r["id"], r["runs_no"], r["steps_no"], r["w_no"], int(str(r["doc"].toPython()))) for r in tables["runs.steps.w"].collect()) == [(1, 1, 1, 1, 7), (1, 1, 1, 2, 8)]
    assert rows("runs.steps.opt.deep", "id", "runs_no", "steps_no", "deep_no", "z") == [(1, 1, 2, 1, True)]
    assert nested.shred(df.limit(0), "id", {"kind"})[""].count() == 0


def test_nested_empty_table(spark):
    assert found(spark, [(1, 0, "{")])[0] == []


def test_deep_and_long_payload(spark):
    deep = {"plan_name": "p", "signals": [{"name": "s", "target_channels": [{"channel_index": n} for n in range(3000)]}], "notes": ["x" * 200_000]}
    got, _ = found(spark, [(1, 0, json.dumps(deep))])
    assert len(got) == 3000
