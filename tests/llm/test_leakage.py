"""Leaked passages: the index against brute force."""

import random

from sievework.llm import leakage as L

r = random.Random(7)
COMMON = [f"w{i}" for i in range(60)]


def sentence(n):
    return [r.choice(COMMON) if r.random() < 0.7 else f"rare{r.randrange(4000)}" for _ in range(n)]


def edited(words, edits):
    out = list(words)
    for _ in range(edits):
        i = r.randrange(len(out))
        kind = r.randrange(3)
        if kind == 0:
            out[i] = "changed"
        elif kind == 1:
            del out[i]
        else:
            out.insert(i, "added")
    return out


def brute(item, doc):
    n = min(len(item), L.PASSAGE)
    return any(L.edits_within(item[i : i + n], doc, n // L.EDIT_SHARE) for i in range(len(item) - n + 1))


def test_index_equals_brute_force(spark):
    items = [(i, " ".join(sentence(r.choice([3, 9, 13, 19, 20, 35, 60])))) for i in range(25)]
    docs = []
    for d in range(120):
        words = sentence(r.randrange(0, 60))
        if r.random() < 0.7:
            source = r.choice(items)[1].split()
            length = r.choice([len(source), 20, 22, 18])
            low = r.randrange(max(1, len(source) - length + 1))
            words += edited(source[low : low + length], r.randrange(5)) + sentence(r.randrange(0, 30))
        docs.append((d, " ".join(words)))
    docs += [(1000, None), (1001, ""), (None, items[0][1]), (1002, items[4][1]), (1003, items[4][1])]
    shape = "doc_id long, text string, item_id string"
    got = {tuple(x) for x in L.leaked(spark.createDataFrame([(*d, "clash") for d in docs], shape), spark.createDataFrame(items, "item_id long, text string")).collect()}
    prepared, vocabulary = L.prepared(items)
    want = {(d, i.item_id) for d, t in docs if d is not None and t for i in prepared if brute(i.words, [vocabulary.get(w, -1) for w in L.words(t)])}
    assert got == want and len(want) > 30
    none = spark.createDataFrame([], shape)
    assert L.leaked(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert L.leaked(spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_markup_prefixes_and_case_do_not_matter(spark):
    text = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi."
    shown = "> ALPHA **beta** gamma,\n> delta <b>epsilon</b> zeta\n2025-01-01T10:00:00Z WARN worker-3 eta theta iota\n- kappa lambda; mu nu\n3. xi omicron pi rho\xa0sigma tau upsilon phi chi"
    items = [(1, "Read this first. " + text), (2, "Read this first. Nothing of it."), (3, "Read this first.")]
    docs = spark.createDataFrame([(1, shown), (2, "Read this first. " * 3), (3, "x" * 200_000 + " " + text)], "doc_id long, text string")
    assert {tuple(x) for x in L.leaked(docs, spark.createDataFrame(items, "item_id long, text string")).collect()} == {(1, 1), (3, 1)}


def test_longer_passages_with_close_edits(spark):
    items = [(i, " ".join(sentence(n))) for i, n in enumerate([24, 28, 32, 39, 45, 70, 90])]
    docs = []
    for item_id, text in items:
        source = text.split()
        for d, (length, places) in enumerate([(24, (10, 11, 12)), (24, (5, 12, 18)), (32, (13, 14, 16, 18)), (32, (12, 13, 17, 19)), (32, (12, 13, 14, 15, 16)), (24, (9, 10, 11, 12)), (40, (15, 18, 20, 21, 24)), (48, (18, 19, 20, 27, 28, 29))]):
            low = r.randrange(max(1, len(source) - length + 1))
            passage = source[low : low + length]
            for p in places:
                if p < len(passage):
                    passage[p] = "changed"
            docs.append((item_id * 10 + d, " ".join([*sentence(7), *passage, *sentence(9)])))
    shape = "doc_id long, text string"
    got = {tuple(x) for x in L.leaked(spark.createDataFrame(docs, shape), spark.createDataFrame(items, "item_id long, text string")).collect()}
    prepared, vocabulary = L.prepared(items)

    def any_length(item, doc):
        return any(L.edits_within(item[i : i + n], doc, n // L.EDIT_SHARE) for n in range(L.PASSAGE, len(item) + 1) for i in range(len(item) - n + 1))

    ids = {d: [vocabulary.get(w, -1) for w in L.words(t)] for d, t in docs}
    assert got == {(d, i.item_id) for d in ids for i in prepared if any_length(i.words, ids[d])}
    assert any(not brute(i.words, ids[d]) for d, k in got for i in prepared if i.item_id == k)
