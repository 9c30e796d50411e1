"""Snapshot differences and keyed chunking: against brute force, with skew, ties, nulls and empty tables."""

import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievework.operators import keyed_chunks as chunks
from sievework.operators import snapshot_diff as diff

SCHEMA = "src string, snap int, k string, v string, extra int, cells int, hi string"


def brute(rows):
    by = defaultdict(dict)
    for s, n, k, v, *_ in rows:
        if n is not None:
            by[s, n][k] = v
    out = set()
    for s in {s for s, _ in by}:
        nos = sorted(n for x, n in by if x == s)
        for a, b in zip(nos, nos[1:]):
            old, new = by[s, a], by[s, b]
            out |= {(s, b, k, "added") for k in new.keys() - old.keys()} | {(s, b, k, "removed") for k in old.keys() - new.keys()}
            out |= {(s, b, k, "changed") for k in new.keys() & old.keys() if new[k] != old[k]}
    return out


def found(spark, rows, settings=diff.DiffSettings()):
    df = spark.createDataFrame(rows, SCHEMA)
    return {tuple(r) for r in diff.snapshot_changes(df, ["src"], "snap", ["k"], ["v"], settings).collect()}


@pytest.mark.parametrize("settings", [diff.DiffSettings(), diff.DiffSettings(rows_per_bin=20, share=0.001)])
def test_changes_equal_brute_force(spark, settings):
    """Also where tables are far too small at first, so that buckets fail and are enlarged."""
    r = random.Random(1)
    rows = []
    for src in ("a", "b", None):
        for snap in (1, 2, 4):
            for k in range(120):
                if r.random() < 0.9:
                    rows.append((src, snap, f"k{k}" if k else None, r.choice(["x", "", None]) if r.random() < 0.2 else "same", 1, 2, "h"))
    assert found(spark, rows, settings) == brute(rows)


def test_first_delivery_empty_table_and_null_snapshot(spark):
    assert found(spark, [("a", 1, "k", "v", 0, 0, "")]) == set()
    assert found(spark, [("a", 1, "k", "v", 0, 0, ""), ("a", None, "z", "v", 0, 0, "")]) == set()
    assert diff.snapshot_changes(spark.createDataFrame([], SCHEMA), ["src"], "snap", ["k"], ["v"]).count() == 0


def test_everything_changes(spark):
    rows = [("a", n, f"k{i}", str(n), 0, 0, "") for n in (1, 2) for i in range(3000)]
    assert found(spark, rows) == brute(rows)


def test_latest_rows_hold_whatever_the_spelling(spark):
    """Repeated rows of a record: the latest loaded holds, a null time is earliest, and spellings of JSON and blanks agree."""
    rows = [("s", 1, "k", 1, "a  b", '{"x": 1, "y": 2}'), ("s", 1, "k", None, "z", "no json {"), ("s", 2, "k", 5, " a b", '{"y":2,"x":1.0}'), ("s", 2, "k", 4, "old", None), ("s", 3, "k", 6, "a b", None), ("s", 3, "k", 6, "a b", None)]
    df = spark.createDataFrame(rows, "src string, snap int, k string, at int, m string, j string").withColumns({"m": diff.squeezed(F.col("m")), "j": diff.canonical_json(F.col("j")), "at": F.timestamp_seconds("at")})
    assert [tuple(r) for r in diff.snapshot_changes(df, ["src"], "snap", ["k"], ["m", "j"], loaded="at").collect()] == [("s", 3, "k", "changed")]
    tied = df.where("snap < 3").withColumn("at", F.lit(None).cast("timestamp"))
    both = {tuple(map(tuple, diff.snapshot_changes(d, ["src"], "snap", ["k"], ["m", "j"], loaded="at").collect())) for d in (tied, tied.orderBy(F.desc("m")))}
    assert len(both) == 1  # ties do not depend on the order of rows


def test_one_source_and_one_record_hold_most_rows(spark):
    rows = [("hot", n, f"k{i}", str(i % 7 + (n == 3) * (i % 50 == 0)), 0, 0, "") for n in (1, 2, 3) for i in range(4000)] + [(f"s{i}", n, "k", str(n), 0, 0, "") for i in range(300) for n in (1, 2)]
    again = rows + [("hot", 2, "k1", "1", 0, 0, "")] * 5000
    assert found(spark, rows, diff.DiffSettings(rows_per_bin=500)) == brute(rows) == found(spark, again, diff.DiffSettings(rows_per_bin=500))


def numbered(spark, rows, chunk=7):
    df = spark.createDataFrame(rows, "k string, o int, v string")
    return chunks.numbered_rows(df, ["k"], ["o", "v"], chunk, partitions=5)


def test_row_numbers_are_gapless_and_ordered_under_skew(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.6 else r.choice(["a", "b", None]), r.randrange(40), r.choice(["x", "y", None])) for _ in range(900)]
    got = numbered(spark, rows).toPandas()
    assert len(got) == len(rows)
    key = got["k"].fillna("\0")
    for _, g in got.groupby(key):
        g = g.sort_values("key_row")
        assert list(g["key_row"]) == list(range(1, len(g) + 1))
        assert list(g["o"]) == sorted(g["o"])
        assert g["key_chunk"].value_counts().max() <= 7


def test_profile_equals_brute_force_and_runs_cross_borders(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", "hot", "b"]), i, r.choice(["x", "x", "x", "y", None])) for i in range(300)]
    got = {x["k"]: x for x in chunks.run_profile(numbered(spark, rows), ["k"], "v").collect()}
    for k in ("hot", "b"):
        values = [v for kk, _, v in sorted(rows, key=lambda t: t[1]) if kk == k]
        runs, longest, n = 1, 1, 1
        for a, b in zip(values, values[1:]):
            n = n + 1 if a == b else 1
            runs += a != b
            longest = max(longest, n)
        assert (got[k]["n_rows"], got[k]["n_runs"], got[k]["longest_run"]) == (len(values), runs, longest)


def test_heavy_keys_and_empty_table(spark):
    rows = [("hot", i, "") for i in range(90)] + [("c", i, "") for i in range(6)] + [(None, i, "") for i in range(50)] + [("d", 1, "")]
    heavy = chunks.heavy_keys(numbered(spark, rows), ["k"], len(rows), 0.04)
    assert {r["k"] for r in heavy.collect()} == {"hot", "c"} - ({"c"} if 6 < 0.04 * len(rows) else set())
    assert numbered(spark, []).count() == 0


def test_clashing_names_are_kept_beside_the_new_ones(spark):
    df = spark.createDataFrame([("a", 7, 8, 9), ("a", 6, 8, 9)], "k string, key_row int, key_chunk int, _part int")
    got = chunks.numbered_rows(df, ["k"], ["key_row"], 1).orderBy("key_row").collect()
    assert [(r["key_row"], r["key_row_in"], r["key_chunk"], r["key_chunk_in"], r["_part_in"]) for r in got] == [(1, 6, 0, 8, 9), (2, 7, 1, 8, 9)]


def test_all_rows_equal(spark):
    got = numbered(spark, [("k", 1, "v")] * 50).toPandas()
    assert sorted(got["key_row"]) == list(range(1, 51))
    assert isinstance(got, pd.DataFrame)


def test_a_hot_key_whose_rows_all_tie_is_spread(spark):
    df = spark.range(4000).selectExpr("'k' AS k", "1 AS o", "'v' AS v", "7 AS _tie")
    got = chunks.numbered_rows(df, ["k"], ["o"], 100, partitions=8)
    assert sorted(r[0] for r in got.select("key_row").collect()) == list(range(1, 4001)) and got.columns == ["k", "o", "v", "_tie", "key_row", "key_chunk"]
    assert got.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 2000
