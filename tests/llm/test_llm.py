"""The operators tagged llm against brute force, exact round trips and held-out accuracy."""

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skydrift.llm import duplicates, leaks, mojibake, nearest, packing, queries, topn
from skydrift.llm.components import components
from tests.test_queries import check


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    check(spark, sf, duck, queries.QUERIES[name], queries.SQL[name])


# Components and duplicates


def union(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(root)}


def test_components_of_chains_stars_and_noise(spark):
    rng = random.Random(3)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(200, k) for k in range(201, 260)] + [(rng.randrange(400, 460), rng.randrange(400, 460)) for _ in range(45)] + [(7, 7), (9, 8), (8, 9)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: v for k, v in union([p for p in pairs if p[0] != p[1]]).items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


ROW = "hit_id long, o string, c int, row0 long, row1 long, f double, source string, refined_snr double, incoherent_snr double, g int, near string, cell double"


def detections(rows):
    pairs = []
    ok = [r for r in rows if None not in r[:6] and r[4] > r[3] and r[5] == r[5]]
    for i, a in enumerate(ok):
        for b in ok[i + 1:]:
            shared = min(a[4], b[4]) - max(a[3], b[3])
            if a[1:3] == b[1:3] and abs(a[5] - b[5]) <= 20 and shared * 2 > min(a[4] - a[3], b[4] - b[3]):
                pairs.append((a[0], b[0]))
    return union(pairs)


def survivors(rows):
    by, groups = {r[0]: r for r in rows}, detections(rows)
    clean = lambda v: -1e99 if v is None or v != v else v
    best = {}
    for h, g in groups.items():
        r = by[h]
        k = (clean(r[7]), clean(r[8]), -r[3], -h)
        best[g] = max(best.get(g, (k, h)), (k, h))
    return sorted(h for _, h in best.values())


@pytest.mark.parametrize("spread", [30, 4000])
def test_survivors_against_all_pairs(spark, spread):
    rng, rows = random.Random(spread), []
    for k in range(500):
        a = rng.randrange(0, 200_000)
        rows.append((k, rng.choice(["a", "b", None] if k % 50 == 0 else ["a", "b"]), rng.randrange(2), a, a + rng.choice([31250, 5000, 700, 150_000, 0, -5, 1]),
                     1e9 + rng.choice([rng.uniform(0, spread), float("nan") if k % 60 == 0 else 10.0, 20.0, 5119.0, 5121.0]), rng.choice(["r1", "r2", None]),
                     rng.choice([None, float("nan"), 20.0, 21.5, round(rng.uniform(10, 30), 1)]), rng.choice([5.0, 6.0, None]), 1, "x", 2.0))
    rows += [(9000 + k, "hot", 1, 10, 500, 1e9 + 3, "r1", 15.0, 5.0, 1, "x", 2.0) for k in range(300)]
    rows += [(9900, "a", 1, None, 5, 1e9, "r", 1.0, 1.0, 1, "x", 1.0), (9901, "a", 1, 1, 5, None, "r", 1.0, 1.0, 1, "x", 1.0)]
    df = spark.createDataFrame(rows, ROW)
    out = duplicates.best_representatives(df, ["o", "c"], queries.ORDER)
    got = out.collect()
    assert sorted(r["hit_id"] for r in got) == survivors(rows)
    assert {r["hit_id"]: r["n_rows"] for r in got}[9000] == 300
    groups = {}
    for h, g in detections(rows).items():
        groups.setdefault(g, set()).add(h)
    labelled = {}
    for r in duplicates.detection_groups(df, ["o", "c"], ["source"]).collect():
        labelled.setdefault(r["g"], set()).add(r["hit_id"])
    assert sorted(map(sorted, labelled.values())) == sorted(map(sorted, groups.values()))
    assert duplicates.best_representatives(df.limit(0), ["o", "c"], queries.ORDER).count() == 0


def test_truth_discovery_learns_which_sources_to_trust(spark):
    rng, rows = random.Random(1), []
    for g in range(200):
        truth = rng.randrange(1000)
        for s, right in (("good", 0.97), ("fair", 0.75), ("bad1", 0.2), ("bad2", 0.2)):
            wrong = truth + (1 if s.startswith("bad") and rng.random() < 0.7 else rng.randrange(2, 50))
            rows.append((g, s, float(truth if rng.random() < right else wrong), float(truth)))
    df = spark.createDataFrame(rows, "g long, source string, x double, truth double")
    truths, sources = duplicates.discover(duplicates.votes_of(df.drop("truth"), ["g"], {"x": 0.1}))
    right = truths.join(df.select("g", "truth").distinct(), "g").where("v = truth * 10").count()
    rel = {r["source"]: r["reliability"] for r in sources.collect()}
    assert rel["good"] > rel["fair"] > rel["bad1"] and right >= 185
    majority = sum(Counter(v for g2, s, v, t in rows if g2 == g).most_common(1)[0][0] == next(t for g2, s, v, t in rows if g2 == g) for g in range(200))
    assert right >= majority


def claims(groups):
    """Rows of detections: [(source, refined_snr, incoherent_snr)] each, far apart in frequency."""
    out = []
    for g, rows in enumerate(groups):
        out += [(100 * g + k, "o", 1, 1000, 2000, 1e9 + 1000.0 * g, *r) for k, r in enumerate(rows)]
    return out


CLAIM = "hit_id long, obs_id string, coarse_channel int, row0 long, row1 long, f double, source string, refined_snr double, incoherent_snr double"


def test_reliable_sources_outvote_an_extreme_value_in_the_query(spark):
    """With the parameters of p1_supported: the liar's 99 loses, and so does its reliability."""
    rows = claims([[("a", 20.0, 9.0), ("b", 20.04, 9.0), ("c", 19.96, 9.1), ("liar", 99.0, 50.0)] for _ in range(50)]
                  + [[("a", 20.0, 9.0), ("liar", 35.0, 9.0), ("liar", 35.0, 9.0)], [("a", None, None), ("b", float("nan"), 3.0)], [("a", None, 7.0), ("b", 25.0, 7.0)]])
    df = spark.createDataFrame(rows, CLAIM)
    got = {r["hit_id"] // 100: r for r in duplicates.supported_values(df, queries.LINE, queries.STEPS).collect()}
    assert all(got[g]["refined_snr"] == 20.0 and got[g]["incoherent_snr"] == 9.0 and got[g]["row0"] == 1000 and got[g]["n_rows"] == 4 for g in range(50))
    # A reliable source alone outvotes two claims of an unreliable one; null and NaN are no claims.
    assert got[50]["refined_snr"] == 20.0 and got[51]["refined_snr"] is None and got[51]["incoherent_snr"] == 3.0 and got[52]["refined_snr"] == 25.0
    votes = duplicates.votes_of(df.withColumn("g", F.floor(F.col("f"))), ["g"], queries.STEPS)
    trust = {r["source"]: r["reliability"] for r in duplicates.discover(votes)[1].collect()}
    assert trust["liar"] < 0.4 < 0.95 < min(trust[s] for s in "abc")


def test_a_group_with_most_rows_and_close_calls(spark):
    """Blocks whose bounds leave a link open are decided by their rows."""
    rng, rows = random.Random(11), []
    for k in range(700):
        a = rng.choice([0, 40_000]) + rng.randrange(0, 9000)
        rows.append((k, "hot", 1, a, a + rng.randrange(9_000, 20_000), 1e9 + rng.uniform(0, 8) + rng.choice([0, 24.0, 26.0, 60.0]), rng.choice("rs"), rng.choice([None, 20.0, 21.5]), 5.0, 1, "x", 2.0))
    rows += [(5000 + k, "hot", 2, 10 + k, 500 + k, 1e9 + k % 3, "r", 15.0, 5.0, 1, "x", 2.0) for k in range(600)]
    got = duplicates.best_representatives(spark.createDataFrame(rows, ROW), ["o", "c"], queries.ORDER).collect()
    assert sorted(r["hit_id"] for r in got) == survivors(rows)
    assert max(r["n_rows"] for r in got) >= 600


def test_supported_values_miss_no_detection(spark, sf):
    supported = {r["n_rows"]: r["n"] for r in queries.p1_supported(spark, sf).groupBy("n_rows").agg({"*": "count"}).toDF("n_rows", "n").collect()}
    fused = {r["n_rows"]: r["n"] for r in queries.p1_fused(spark, sf).groupBy("n_rows").agg({"*": "count"}).toDF("n_rows", "n").collect()}
    assert supported == fused and supported


# Top n


def brute_top(rows, n):
    groups = {}
    for g, s, i in {r[:3] for r in rows}:
        if g is not None and i is not None and s is not None and s == s and abs(s) != float("inf"):
            groups.setdefault(g, set()).add((-(s + 0.0), i.encode(), i))
    return sorted((g, i) for g, v in groups.items() for _, _, i in sorted(v)[:n])


def test_top_n_ties_nulls_hot_group_and_odd_identifiers(spark):
    rng, rows = random.Random(4), []
    odd = ["", "a", "a\0", "ab", "é", "zz", "日本", "a" * 60, "a" * 7, "a" * 14, "a" * 8]
    for k in range(4000):
        g = "hot" if k % 3 else f"g{rng.randrange(40)}"
        s = rng.choice([1.0, 1.0, 2.5, -0.0, 0.0, -3.0, 1e300, None, float("nan"), float("inf"), round(rng.uniform(0, 5), 1)])
        rows.append((g, s, rng.choice([f"e{rng.randrange(900):05d}", rng.choice(odd)]), 1, "x"))
    rows += rows[:50] + [(None, 1.0, "x", 1, "x"), ("g1", 1.0, None, 1, "x")]
    df = spark.createDataFrame(rows, "g string, score double, id string, need int, code string")
    for n in (1, 10):
        got = topn.top_n(df, "g", "score", "id", n)
        assert sorted((r["g"], r["id"]) for r in got.collect()) == sorted(brute_top(rows, n))
    assert topn.top_n(df.limit(0), "g", "score", "id", 3).count() == 0


def test_codes_keep_the_order(spark):
    rows = [(s, i) for s in (-1e308, -1.5, -1e-300, 0.0, 1e-300, 2.0, 1e308) for i in ("", "a", "a\0", "a\0b", "b", "é", "a" * 20, "a" * 21)]
    got = topn.with_code(spark.createDataFrame(rows, "s double, i string"), "s", "i").collect()
    by_code = [(r["s"], r["i"]) for r in sorted(got, key=lambda r: r["code"], reverse=True)]
    assert by_code == sorted(rows, key=lambda r: (-r[0], r[1].encode()))


# Nearest in time


def test_nearest_in_time_against_all_pairs(spark):
    rng = random.Random(6)
    f = lambda: round(1e9 + rng.choice([rng.uniform(0, 3000), 100.0, 220.0]), 3)
    left = [(k, rng.choice("ab"), rng.choice([round(rng.uniform(0, 60), 3), 5.0, 48.0, None if k % 40 == 0 else 10.25]), f() if k % 37 else None,
             rng.choice([60.0, 120.0, 200.0, 0.0, 5000.0, -1.0]), 1, "x") for k in range(300)]
    right = [(f"e{k:04d}", rng.choice("ab"), rng.choice([round(rng.uniform(0, 60), 3), 5.0, 5.5, 4.5, 46.5]), f() if k % 41 else None, 1, "x") for k in range(1500)]
    right += [("hot%03d" % k, "a", 5.0, 1e9 + 100.0, 1, "x") for k in range(500)] + [(None, "a", 5.0, 1e9, 1, "x")]
    want = {}
    for i, e, t, q, tol, *_ in left:
        for r, e2, t2, q2, *_ in right:
            if None in (t, q, r, q2) or e != e2 or abs(t - t2) > 1.5 or abs(q - q2) > tol:
                continue
            want[i] = min(want.get(i, (9e9, "")), (abs(t - t2), r))
    a = spark.createDataFrame(left + left[:20], "id long, entity string, t double, freq double, tol double, bucket int, w string")
    b = spark.createDataFrame(right + right[:20], "rid string, entity string, t double, freq double, seg int, rt string")
    got = {r["id"]: (r["dt"], r["rid"]) for r in nearest.nearest_in_time(a, b, 1.5).collect()}
    assert got == want
    assert nearest.nearest_in_time(a.limit(0), b, 1.5).count() == 0 and nearest.nearest_in_time(a, b.limit(0), 1.5).count() == 0


# Packing


def test_hilbert_key_is_a_walk_over_all_cells():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(grid, 3)
    assert sorted(key.tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 99), max_size=300))
def test_packer_never_overfills_and_places_all(sizes):
    p = packing.Packer(100, 0)
    box, offset = p.pack(np.array(sizes, np.int64))
    used = Counter()
    for b, o, s in sorted(zip(box.tolist(), offset.tolist(), sizes), key=lambda x: (x[0], x[1], x[2])):
        assert o == used[b]
        used[b] += s
    assert all(v <= 100 for v in used.values())


def test_packing_is_whole_and_tight(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(-1, None), (-2, ""), (-3, "word " * 9000), (-4, "same"), (-5, "same"), (-5, "same")], docs.schema)).selectExpr("*", "1 as piece", "'x' as curve")
    sizes = packing.measured(docs)
    out = [r.asDict() for r in packing.packed(sizes).collect()]
    tokens = {}
    for r in sizes.collect():
        tokens.setdefault(r["doc_id"], []).append(r["n_tokens"])
    got = Counter()
    for r in out:
        got[r["doc_id"]] += r["size"]
        assert r["container_offset"] + r["size"] <= 2048 and r["token_from"] == r["piece"] * 2048
        assert r["size"] == 2048 or r["piece"] == max(x["piece"] for x in out if x["doc_id"] == r["doc_id"])
    assert dict(got) == {d: sum(n) for d, n in tokens.items()} and set(got) == {r[0] for r in docs.select("doc_id").collect()}
    fill = Counter()
    for r in out:
        fill[r["container_id"]] += r["size"]
    assert max(fill.values()) <= 2048 and sum(fill.values()) / (2048 * len(fill)) > 0.95
    assert packing.packed(packing.measured(docs.limit(0))).count() == 0


# Leaks


def brute_leaks(docs, items, length=12):
    out = set()
    for i, p in items:
        passage = leaks.words(p or "")
        if len(passage) < length:
            continue
        for d, t in docs:
            for ws in leaks.readings(t or "", set(passage).__contains__, max(map(len, passage))):
                for j in range(len(passage) - length + 1):
                    want = passage[j:j + length]
                    for s in range(len(ws)):
                        k, n = s, 0
                        while k < len(ws) and n < length:
                            if ws[k] == want[n]:
                                n += 1
                            elif not (n and ws[k].isdigit()):
                                break
                            k += 1
                        if n == length:
                            out.add((d, i))
    return out


PASSAGE = "Suppose that 258 buoyant samples of cellulose are weighed before the emitter filters and pupils ask why the self-aligning quill locks the ratchet"


def test_leaks_in_all_disguises(spark):
    w = PASSAGE.split()
    texts = {1: "x " * 50 + PASSAGE + " y", 2: " ".join(w[:12]), 3: " ".join(w[:11]), 4: PASSAGE.upper().replace(" ", "\n"), 5: "<p>" + " ".join(f"<b>{x}</b>" for x in w) + "</p>",
             6: " [0012] ".join([" ".join(w[:6]), " ".join(w[6:12])]), 7: PASSAGE.replace("buoyant", "buo-\nyant").replace("self-aligning", "self-\naligning"),
             8: PASSAGE.replace("samples", "sam­ples"), 9: " ".join(reversed(w)), 10: None, 11: "", 12: "z" * 300_000 + " " + PASSAGE, 13: PASSAGE.replace("258", "259"),
             14: " ".join(w[3:15]), 15: PASSAGE.replace("ff", "ﬀ").replace("fi", "ﬁ"), 16: "7 8 9 " * 30, 17: PASSAGE.replace(" ", "  ,; ")}
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in texts.items()] + [(1, texts[1], 1, "x")], "doc_id long, text string, item_id int, passage string")
    items = spark.createDataFrame([(100, PASSAGE, "a"), (101, " ".join(w[8:]), "a"), (102, None, "a"), (103, "too short", "a"), (104, "", "a"), (105, "1 2 3 4 5 6 7 8 9 10 11 12 13", "a")],
                                  "item_id long, passage string, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(docs, items).collect()}
    full = {1, 4, 5, 7, 8, 12, 15, 17}
    assert {d for d, i in got if i == 100} == full | {2, 6, 13, 14}
    assert {d for d, i in got if i == 101} == full | {13}
    assert leaks.leaked_items(docs.limit(0), items).count() == 0 and leaks.leaked_items(docs, items.limit(0)).count() == 0


def test_leaks_equal_brute_force_on_random_texts(spark):
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(12)] + ["7", "42"]
    vocabulary = [v.replace("w", "word") if v.startswith("w") else v for v in vocabulary]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(20))) for k in range(8)]
    docs = []
    for d in range(60):
        p = items[rng.randrange(8)][1].split()
        a = rng.randrange(8)
        part = p[a:a + rng.randrange(9, 16)]
        for _ in range(rng.randrange(3)):
            part.insert(rng.randrange(1, len(part)), rng.choice(["9", "1234", "other"] if rng.random() < 0.5 else ["55"]))
        docs.append((d, " ".join([rng.choice(vocabulary) for _ in range(30)] + part + [rng.choice(vocabulary) for _ in range(30)])))
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")).collect()}
    want = brute_leaks(docs, items)
    assert got == want and want


def found_leaks(spark, docs, items, **kwargs):
    out = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), **kwargs)
    return {(r["doc_id"], r["item_id"]): r["n_words"] for r in out.collect()}


def test_nothing_between_the_words_is_too_long(spark):
    w = PASSAGE.replace("258", "many").split()
    items = [(1, " ".join(w))]
    docs = [(n, "before " + (" " + " ".join(str(k) for k in range(n)) + " ").join(w[2:14]) + " after") for n in (1, 2, 3, 4, 5, 8, 20, 50, 400)]
    docs += [(1000 + n, " ".join(w[:7]) + f' <span style="{"x: 1; " * n}">' + " ".join(w[7:12]) + "</span>") for n in (10, 60, 2000)]
    docs += [(2000 + n, " ".join(w[:6]) + f" <!-- {'hidden words ' * n}--> " + " ".join(w[6:12])) for n in (1, 3000)]
    # A word in many pieces, and one with a hyphen at the line's end; what stands between brackets may be prose.
    docs += [(3000, " ".join(w[:3]) + " " + "-\n".join("buoyant") + " " + " ".join(w[4:])), (3001, " ".join(w).replace("self-aligning", "self-\naligning")),
             (3002, "-\n".join("z" * 5000) + " " + "-\n   ".join(["x" * 70, "y"]) + " " + " ".join(w)), (3003, "if a <" + " ".join(w[:12]) + " and b> c"), (3004, "<b " + " ".join(w[:12]))]
    docs = [(d, t) for d, t in docs]
    if "buoyant" not in w[3]:
        docs = [(d, t) for d, t in docs if d != 3000] + [(3000, " ".join(w).replace("buoyant", "-\n".join("buoyant")))]
    got = found_leaks(spark, docs, items)
    assert set(got) == {(d, 1) for d, _ in docs} == brute_leaks(docs, items)
    assert got[50, 1] == 12 and got[3002, 1] == len(leaks.words(" ".join(w)))


def test_windows_with_many_numbers_of_their_own(spark):
    passage = "the 12 rotors turn 5 times in 7 or 9 seconds while 3 valves open 11 ports at once"
    w = passage.split()
    mixed = [x for a in w for x in (a, "777")]
    docs = [(1, passage), (2, " ".join(mixed)), (3, passage.replace("5", "6")), (4, " ".join(w[2:14])), (5, " ".join(w[2:13])), (6, passage.replace("valves", "other"))]
    items = [(1, passage), (2, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (3, "one and 1 2 3 4 5 6 7 8 9 10 11 12 more words")]
    docs += [(7, "1 2 3 4 5 6 7 8 9 10 11 12"), (8, "and 1 2 3 555 4 5 6 7 8 9 10 11")]
    got = found_leaks(spark, docs, items)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (7, 2), (7, 3), (8, 3)}


def test_a_full_bit_set_loses_nothing(spark, monkeypatch):
    rng = random.Random(3)
    items = [(k, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "12"]) + rng.choice("abcdefgh") for _ in range(30))) for k in range(40)]
    docs = [(k, " ".join(["x"] * 20 + items[k % 40][1].split()[3:3 + 8 + k % 10] + ["y"] * 5)) for k in range(120)]
    want = brute_leaks(docs, items)
    got = set(found_leaks(spark, docs, items))
    bits = leaks.Bits([(k, -1) for k in range(1 << (leaks.SLOT_BITS - 6))])
    monkeypatch.setattr(leaks, "bit_set", lambda *a: bits)
    assert got == want == set(found_leaks(spark, docs, items)) and set(found_leaks(spark, docs, items, radius=3)) == want and want


def test_fingerprints_within_the_radius_share_a_block():
    rng = np.random.default_rng(2)
    own = rng.integers(0, 2**63, 300, dtype=np.uint64)
    for radius in (0, 1, 3):
        keys = leaks.block_keys(own, 12, radius)
        for flips in range(radius + 1):
            far = own ^ sum((np.uint64(1) << np.uint64(b) for b in rng.choice(64, flips, replace=False)), np.uint64(0))
            assert (keys == leaks.block_keys(far, 12, radius)).any(axis=1).all()
        assert not (keys == leaks.block_keys(own, 11, radius)).any()


def test_words_and_order_are_compared_and_not_fingerprints_alone():
    text, passage = [1, 9, 2, 3, 9, 9, 4], [1, 2, 3, 4]
    assert leaks.stands_in(passage, text, [x == 9 for x in text]) and not leaks.stands_in(passage, text, [False] * 7) and not leaks.stands_in([1, 3, 2, 4], text, [x == 9 for x in text])
    same = list(range(12))
    assert leaks.similarity(same, same, {}) == 1.0
    assert leaks.similarity(same[:-1] + [99], same, {}) == pytest.approx(7 / 9) and leaks.similarity(same[:-1] + [99], same, {11: 0.1} | {k: 1.0 for k in range(11)}) > 0.75


def test_equal_windows_have_equal_fingerprints():
    h = np.random.default_rng(0).integers(0, 2**63, 40, dtype=np.uint64)
    s = leaks.simhashes(np.concatenate([h, h[:20]]), 12)
    assert (s[:9] == s[40:49]).all() and len(s) == 49


# Wrong encodings


CLEAN = ["Der Kühler überträgt das Gehäuse rückwärts bei 12.5 °C und 3 µm.", "Gemäß Fig. 2 führt die Öffnung größere Schlüssel – außen.", "Le réservoir est réglable et l’élément séparé à côté du châssis.",
         "O invólucro é flexível e a conexão não está na posição de fixação.", "Чтобы исключить износ, деталь фильтр выполнена из никеля.", "外側の導管は中空の貯留槽を有する。冷却器を押圧する。",
         "A “pawl” of 3 × 4 kΩ ± 2 mm² – Zorvex® © and Ø; type Ã-28, mark ¬22, ½.", "Θ = ⁿ√(68·a) ≈ 28 ∞ │ 45 │ 14 │", "plain words only"]


def corpus(spark, extra):
    rows = [(1000 + k, CLEAN[k % len(CLEAN)] + f" {k}.") for k in range(900)] + extra
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, word string")


def test_wrong_encodings_are_found_and_restored(spark):
    chains = ["utf-8>cp1252", "utf-8>cp437", "utf-8>mac_roman", "cp1252>cp437", "cp1252>mac_roman", "utf-8>cp1252>cp1252", "utf-8>cp1251"]
    extra, truth = [], {}
    for k, chain in enumerate(chains):
        for n in range(4):
            good = CLEAN[n]
            bad = mojibake.garble(good, chain)
            if bad and bad != good:
                extra.append((10 * k + n, bad))
                truth[10 * k + n] = good
    place = CLEAN[1].replace("Öffnung", mojibake.garble("Öffnung", "utf-8>cp1252"))
    ru = mojibake.garble(CLEAN[4].replace(",", ""), "cp1251>cp1252")
    extra += [(500, place), (501, ru), (502, "F�hrung und K�hler"), (503, None), (504, ""), (505, "x" * 200_000 + " Kühler"), (506, CLEAN[1]), (506, CLEAN[1]), (507, "???? 12 ?????? 5"), (508, "what??"), (509, "What is this???? Nobody knows."),
              (510, "Is it so????"), (511, "A gap of 3 × 4 k? ± 2 mm²."), (512, "type �-28"), (513, "Really? Yes? No???? Was it? plain words? only?")]
    docs = corpus(spark, extra)
    out = {r["doc_id"]: r for r in mojibake.affected(docs).collect()}
    assert set(out) == set(truth) | {500, 501, 502, 507, 511, 512}
    assert out[502]["n_lost"] == 2
    fixed = {}
    for r in mojibake.garbled_words(docs).collect():
        fixed.setdefault(r["doc_id"], {})[r["word"]] = r["restored"]
    right = total = 0
    for d, good in truth.items():
        words, want = mojibake.foreign_words(dict(extra)[d]), mojibake.foreign_words(good)
        for w in set(words):
            total += 1
            right += fixed[d].get(w) in want or any(fixed[d].get(w) and x in fixed[d][w] for x in want)
    assert total > 100 and right / total > 0.85
    assert mojibake.affected(docs.limit(0)).count() == 0


def test_garbling_and_its_inverse_are_exact():
    for word in ("Öffnung", "réglable", "–", "“pawl”"):
        for chain in ("utf-8>cp1252", "utf-8>latin-1", "utf-8>cp437", "cp1252>mac_roman", "mac_roman>cp1252"):
            bad = mojibake.garble(word, chain)
            assert bad is None or bad == word or word in mojibake.candidates(bad)
    assert mojibake.foreign_words("plain") == [] and mojibake.foreign_words("") == []
    assert mojibake.foreign_words("a é b Kühler\tx") == ["a é b ", "Kühler"]


def test_recall_of_the_model_on_held_out_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    words = Counter(w for r in docs for w in mojibake.foreign_words(r["text"]))
    clean = [(w, n) for w, n in words.items() if not mojibake.is_suspect(w) and n >= 3 and len(w) > 3]
    df = spark.createDataFrame([(w, n) for w, n in words.items() if not mojibake.is_suspect(w)], "word string, n long")
    model = mojibake.train(df)
    total = float(sum(words.values()))
    assert mojibake.recall(model, clean, total, 2.0, ("utf-8>cp1252", "utf-8>cp437", "utf-8>mac_roman")) > 0.95
    assert mojibake.recall(model, clean, total, 2.0, ("cp1252>cp437", "cp1252>mac_roman")) > 0.9
    assert mojibake.validated_margin(model, clean, total) in mojibake.MARGINS


def test_margins_of_chains_do_not_depend_on_the_size_of_the_table():
    sure = {"rare": 1, "false": 3}
    beyond = {"rare": [1, 1, 0, 0, 0], "false": [60, 40, 20, 9, 4], "between": [5, 2, 1, 0, 0], "unseen": [0, 0, 0, 0, 0]}
    want = {"rare": 2.0, "false": 5.0, "between": 4.0, "unseen": 2.0}
    for times in (1, 10, 1000):
        assert mojibake.chain_margins({c: n * times for c, n in sure.items()}, {c: [k * times for k in n] for c, n in beyond.items()}, 2.0) == want
    assert mojibake.chain_margins({}, {"a": [7]}, 9.0) == {"a": 9.0}


def test_the_margin_is_taken_over_all_clean_words(spark):
    def margin(n_beyond):
        # Of 30 000 distinct clean words, some 0.2 % are likelier otherwise by 2.2 nats; what is not clean doesn't count.
        rows = [(1, "utf-8>cp1252", -10.0, -12.2)] * n_beyond + [(1, "utf-8>cp1252", -10.0, -10.5)] * 500 + [(0, "utf-8>cp1252", -1.0, -30.0)] * 300 + [(1, None, 0.0, 0.0)] * 50
        return mojibake.margin_of_all(spark.createDataFrame(rows, "n long, chain string, score double, own double"), 1e12, 30_000)

    assert margin(60) == 2.0 and margin(61) == 2.5
    assert mojibake.margin_of_all(spark.createDataFrame([], "n long, chain string, score double, own double"), 1.0, 0) == 2.0
