"""Packing: nothing lost, nothing cut that fits, no container too full, and little room left."""

import random

from sievework.llm import packing as P


def check(rows, sizes, capacity):
    by_doc, fills = {}, {}
    for d, piece, first, n, c in rows:
        by_doc.setdefault(d, []).append((piece, first, n))
        fills[c] = fills.get(c, 0) + n
    assert max(fills.values(), default=0) <= capacity
    for d, n in sizes.items():
        pieces = sorted(by_doc.get(d, []))
        if not n:
            assert not pieces
            continue
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(x for _, _, x in pieces) == n
        assert [f for _, f, _ in pieces] == [sum(x for _, _, x in pieces[:i]) for i in range(len(pieces))]
        assert len(pieces) == 1 or n > capacity
    return fills


def test_packing(spark):
    r = random.Random(5)
    sizes = {i: r.choice([0, 1, 7, 50, 64, 65, 200, r.randrange(1, 64)]) for i in range(2000)}
    df = spark.createDataFrame([(i, n, "clash") for i, n in sizes.items()], "doc_id long, n_tokens long, container string").repartition(6)
    fills = check([tuple(x) for x in P.packed(df, 64).collect()], sizes, 64)
    assert sum(fills.values()) / (64 * len(fills)) > 0.97
    assert P.packed(df.limit(0), 64).count() == 0


def test_levels_choose_the_least_sum_of_squares():
    levels, counts = P.Levels(10), {}
    r = random.Random(6)
    for _ in range(400):
        size = r.randrange(1, 11)
        before = levels.counts.copy()
        costs = {}
        for level in [0, *[h for h in range(1, 11 - size) if before[h]], *([10 - size] if size < 10 and before[10 - size] else [])]:
            after = before.copy()
            if level:
                after[level] -= 1
            if level + size < 10:
                after[level + size] += 1
            costs[level] = int((after**2).sum())
        number = levels.place(size)
        counts[number] = counts.get(number, 0) + size
        assert int((levels.counts**2).sum()) == min(costs.values())
    assert max(counts.values()) <= 10


def test_whole_texts_are_counted():
    short = "one two three, four! " * 10
    code = P.encoding(P.VOCABULARY)
    assert P.count_tokens(short) == len(code.encode_ordinary(short))
    long = "word and more ünï " * 12_000
    assert P.count_tokens(long) == len(code.encode_ordinary(long))
    assert P.count_tokens("x" * 120_000) > 1000


def test_edges_of_tables(spark):
    import datetime as dt

    at = dt.datetime(2025, 1, 1)
    df = spark.createDataFrame([(1, None, at), (2, "", at), (3, "hello world", at), (3, "hello", at + dt.timedelta(days=1)), (None, "x", at)], "doc_id long, text string, ingested_at timestamp")
    assert {r["doc_id"]: r["n_tokens"] for r in P.sizes(df).collect()} == {1: 0, 2: 0, 3: 1}


def test_parts_of_a_text_have_the_tokens_of_the_whole():
    r = random.Random(3)
    code = P.encoding(P.VOCABULARY)
    for _ in range(6):
        text = "".join(r.choice(["word", " ", "  \n", "\t", "it's", "12345", "...", "ü漢", " " * r.randrange(40), "x" * r.randrange(300)]) for _ in range(r.randrange(20_000, 40_000)))
        assert len(P.parts(text)) > 1 and "".join(P.parts(text)) == text
        assert P.count_tokens(text) == len(code.encode_ordinary(text))
    assert P.parts("y" * 120_000) == ["y" * 120_000] and P.parts(" " * 120_000) == [" " * 120_000] and P.parts("") == [""]
