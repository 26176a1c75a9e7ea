"""The general data problems against brute force, and their edge cases."""

import random
from collections import Counter
from datetime import datetime

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from allelica.operators import imputation, intervals, orphans, parsing, skew
from tests.conftest import rows


def brute_periods(blocks):
    out = []
    for key in {b[0] for b in blocks if None not in b}:
        spans = sorted((min(s, e), max(s, e)) for k, s, e in (b for b in blocks if None not in b) if k == key)
        merged = [list(spans[0])]
        for s, e in spans[1:]:
            if s <= merged[-1][1] + 1:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(key, "period", s, e) for s, e in merged]
        out += [(key, "gap", a[1] + 1, b[0] - 1) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def test_periods_match_brute_force(spark):
    rng = random.Random(5)
    blocks = [("a", -5, 3), ("a", 4, 4), ("a", 70000, 65536), ("a", 131072, 196607), ("a", 196608, 196609), ("b", 7, 7), ("b", 7, 7), ("c", None, 4), (None, 1, 2), ("b", -(2**31), -(2**31)), ("b", 2**31 - 1, 2**31 - 1)]
    for _ in range(400):
        s = rng.randrange(0, 3_000_000)
        blocks.append((rng.choice("abd"), s, s + rng.choice([0, 1, 5, 300, 70_000]) * rng.choice([1, -1])))
    df = spark.createDataFrame(blocks, "k string, s int, e int")
    got = intervals.periods_and_gaps(df, ["k"], "s", "e")
    assert rows(got) == sorted(brute_periods(blocks), key=lambda r: tuple(str(x) for x in r))


@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 300), st.integers(1, 90)), max_size=30))
@settings(max_examples=200, deadline=None)
def test_merged_blocks_are_the_decomposition_of_the_union(spans):
    g, a, n = (np.array([x[i] for x in spans], "int64") for i in range(3))
    blocks = intervals.canonical(g, a, a + n)
    again = intervals.dyadic_blocks(*intervals.union(g, a, a + n))
    assert sorted(zip(*(c.tolist() for c in blocks))) == sorted(zip(*(c.tolist() for c in again)))
    assert {(i, x) for i, s, k in zip(*(c.tolist() for c in blocks)) for x in range(s, s + 2**k)} == {(i, x) for i, s, m in spans for x in range(s, s + m)}


def test_periods_of_empty_table(spark):
    assert intervals.periods_and_gaps(spark.createDataFrame([], "k string, s int, e int"), ["k"], "s", "e").count() == 0


def test_periods_with_clashing_columns(spark):
    df = spark.createDataFrame([("a", 1, 2, 9, 9, "x")], "k string, s int, e int, level int, tile int, run string")
    assert rows(intervals.periods_and_gaps(df, ["k"], "s", "e")) == [("a", "period", 1, 2)]


def test_orphans(spark):
    t = lambda d: datetime(2024, 1, d)
    parents = spark.createDataFrame([("a", t(2), t(5)), ("a", t(8), None), ("a", t(8), None), ("b", t(1), None), (None, t(1), None), ("d", None, None)], "key string, f timestamp, t timestamp")
    kids = [(1, "a", t(1)), (2, "a", t(2)), (3, "a", t(5)), (4, "a", t(9)), (5, "b", t(1)), (6, "c", t(3)), (7, None, t(3)), (8, "b", None), (9, "c", t(3)), (10, "d", t(3))]
    df = spark.createDataFrame(kids, "rec long, key string, at timestamp")
    got = [r["rec"] for r in orphans.orphan_references(df, parents, "key", "at", "rec", "f", "t").collect()]
    assert sorted(got) == [1, 3, 6, 8, 9, 10]
    none = orphans.orphan_references(df, parents.limit(0), "key", "at", "rec", "f", "t")
    assert none.count() == 9
    assert orphans.orphan_references(df.limit(0), parents, "key", "at", "rec", "f", "t").count() == 0


def test_orphans_with_full_filter_and_hot_key(spark):
    t = datetime(2024, 1, 1)
    parents = spark.createDataFrame([(f"k{i}", t, None) for i in range(500)], "key string, f timestamp, t timestamp")
    kids = spark.createDataFrame([(i, "k1" if i % 2 else f"k{i}", t) for i in range(1000)], "rec long, key string, at timestamp")
    want = {i for i in range(0, 1000, 2) if i >= 500}
    table, words = orphans.bloom_words(parents, "key", max_bytes=64)
    assert words == orphans.PACK and table.count() == 1
    assert {r["rec"] for r in orphans.orphan_references(kids, parents, "key", "at", "rec", "f", "t").collect()} == want


def strict(line, sep):
    """Reason by the definition, character by character."""
    fields, i, n = 1, 0, len(line)
    while True:
        if i < n and line[i] == '"':
            i += 1
            while True:
                j = line.find('"', i)
                if j < 0:
                    return "quoting"
                if line[j + 1 : j + 2] == '"':
                    i = j + 2
                    continue
                i = j + 1
                break
            if i < n and line[i] != sep:
                return "quoting"
        else:
            while i < n and line[i] != sep:
                if line[i] == '"':
                    return "quoting"
                i += 1
        if i >= n:
            return None if fields == 5 else "columns"
        fields, i = fields + 1, i + 1


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet='a",\n ', max_size=14))
def test_error_parse_reason(line):
    q, d, edits = parsing.error_parse(line, ",", 5)
    reason = "quoting" if q else "columns" if d else None
    assert reason == strict(line, ",")
    assert (edits == "") == (reason is None)


def test_error_parse_edits():
    assert parsing.error_parse("a,b,c", ",", 5) == (0, 2, "+delimiter@5;+delimiter@5")
    assert parsing.error_parse("a,b,c,d,e,f,g", ",", 5) == (0, 2, "-delimiter@9;-delimiter@11")
    assert parsing.error_parse('"a,b,c,d,e', ",", 5) == (1, 0, "+quote@2")
    assert parsing.error_parse('a,b"x,c,d', ",", 5) == (1, 1, "-quote@3;+delimiter@9")


@given(st.lists(st.text('a" ,\x01', max_size=14), min_size=1, max_size=40))
@settings(max_examples=6, deadline=None)
def test_records_agree_with_the_programme(spark, lines):
    df = spark.createDataFrame([(i, x, ",") for i, x in enumerate(lines)], "i int, line string, sep string")
    for r in parsing.parse_records(df, "line", "sep", 3).collect():
        q, d, edits = parsing.error_parse(r["line"], ",", 3)
        assert r["_reason"] == ("quoting" if q else "columns" if d else None) and r["_edits"] == edits
        assert r["_fields"] == (None if edits else parsing._fields_of(r["line"], ","))


def test_parse_variants(spark):
    chroms = spark.createDataFrame([("1", 1000), ("scf1", 50)], "chr string, length_bp int")
    lines = [
        (1, ",", "rs1,chr1,10,A,T"), (2, ",", '"rs1"," CHR1 ","1000","A,C","T"\r'), (3, ",", "rs1,1,10,A"), (4, ",", '"rs1,1,10,A,T'), (5, ",", "rs 1,1,10,A,T"), (6, ",", "rs1,2,10,A,T"), (7, ",", "rs1,1,1001,A,T"),
        (8, ",", "rs1,1,0,A,T"), (9, ",", "rs1,1,1e2,A,T"), (10, ";", ";scf1; 50 ;A;T"), (11, ",", None), (12, None, "x"), (13, ",", ""), (14, ",", '"rs1" ,1,10,A,T'), (15, "\t", "rs\x071\t1\t10\tA\tT"), (16, ",", "rs1,1,99999999999999999999999999999999999999999999,A,T"), (17, ",", '"a""b",1,0010,A,T'),
    ]
    df = spark.createDataFrame(lines, "line_id long, sep string, line string")
    got = {r["line_id"]: r for r in parsing.parse_variants(df, chroms).collect()}
    want = {1: None, 2: None, 3: "columns", 4: "quoting", 5: "value", 6: "value", 7: "value", 8: "value", 9: "value", 10: None, 11: "columns", 12: "columns", 13: "columns", 14: "quoting", 15: "value", 16: "value", 17: None}
    assert {k: r["reason"] for k, r in got.items()} == want
    assert (got[2]["snp"], got[2]["chr"], got[2]["pos"], got[2]["ref_allele"]) == ("rs1", "1", 1000, "A,C")
    assert got[17]["snp"] == 'a"b' and got[17]["pos"] == 10 and got[10]["snp"] == ""
    assert "quote" in got[4]["edits"] and "delimiter" in got[3]["edits"]
    assert parsing.parse_variants(df.limit(0), chroms).count() == 0
    long = spark.createDataFrame([(1, ",", '"' + "x" * 300_000 + '",1,10,A,T')], "line_id long, sep string, line string")
    assert parsing.parse_variants(long, chroms).first()["reason"] is None


def test_fill_genotypes(spark):
    rng = random.Random(3)
    calls, samples, truth, n = [], [], {}, 0
    for g in range(12):
        for s in range(5):
            samples.append((f"s{g}_{s}", f"g{g}" if s % 2 == 0 else None, ))
            samples.append((f"s{g}_{s}", f"g{g}"))
    for v in range(30):
        for g in range(12):
            d = rng.choice([0, 0, 1, 2])
            for s in range(5):
                n += 1
                gt = ["0/0", "0|1", "1/1:3"][d]
                if rng.random() < 0.1:
                    truth[n], gt = d, rng.choice([None, "./.", "0/.", "NN", ".", ""])
                calls.append((n, f"s{g}_{s}", "chr1" if n % 2 else " 1", v, gt, rng.choice([None, 5, 30])))
    calls += [(9001, None, None, None, None, None), (9002, "unknown", "9", 1, "./.", 3)]
    c = spark.createDataFrame(calls, "call_id long, sample_id string, chr string, pos int, gt string, depth int")
    s = spark.createDataFrame(samples, "sample_id string, line_grp string")
    got = {r["call_id"]: r["dosage"] for r in imputation.fill_genotypes(c, s).collect()}
    assert set(got) == set(truth) | {9001, 9002}
    assert sum(got[k] == v for k, v in truth.items()) > 0.95 * len(truth)
    everything = imputation.all_dosages(c, s)
    assert everything.count() == len(calls) and everything.where("filled").count() == len(truth) + 2
    assert imputation.fill_genotypes(c.limit(0), s).count() == 0
    assert imputation.fill_genotypes(c, s.limit(0)).count() == len(truth) + 2


def test_fill_missing_numeric_and_categorical(spark):
    data = [(i, "x" if i % 3 else "y", (10.0 if i % 3 else 50.0) + i % 2, None if i % 7 == 0 else ("p" if i % 3 else "q")) for i in range(210)]
    data += [(900, None, 50.5, "q"), (901, "x", None, "p"), (902, "y", float("nan"), None), (903, None, None, None)]
    df = spark.createDataFrame(data, "id int, a string, v double, b string")
    got = {r["id"]: r for r in imputation.fill_missing(df, ["a", "b"], ["v"], 4).collect()}
    assert got[900]["a"] == "y" and got[900]["a_filled"] and not got[900]["v_filled"]
    assert got[901]["v"] < 12 and got[901]["v_filled"]
    assert got[902]["v"] > 49 and got[902]["b"] == "q"
    assert all(got[i]["b"] == ("p" if i % 3 else "q") for i in range(210))
    assert None not in (got[903]["a"], got[903]["v"], got[903]["b"])
    empty = spark.createDataFrame([(1, None)], "id int, a string")
    assert imputation.fill_missing(empty, ["a"], []).first()["a"] is None


def test_key_profile(spark):
    rng = random.Random(1)
    data = [("hot", rng.randrange(50)) for _ in range(4000)] + [("cold", rng.randrange(1000)) for _ in range(37)] + [(None, 3), ("empty", None), ("one", 8)]
    got = {r[0]: r for r in skew.per_key_profile(spark.createDataFrame(data, "k string, v int"), "k", "v").collect()}
    for key in {k for k, _ in data}:
        vals = sorted(v for k, v in data if k == key and v is not None)
        r = got[key]
        assert r["n_rows"] == sum(k == key for k, _ in data) and r["n_values"] == len(vals) and r["n_distinct"] == len(set(vals))
        if vals:
            c = Counter(vals)
            best = min(c, key=lambda v: (-c[v], v))
            assert (r["mode_value"], r["mode_count"]) == (best, c[best])
            for q in (25, 50, 75):
                assert r[f"p{q}"] == vals[max(1, -(-len(vals) * q // 100)) - 1]
        else:
            assert r["mode_value"] is None and r["p50"] is None
    assert skew.per_key_profile(spark.createDataFrame([], "k string, v int"), "k", "v").count() == 0
