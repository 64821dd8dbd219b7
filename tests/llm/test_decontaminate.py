import random

import numpy as np

from starlace.llm.decontaminate import FMIndex, WaveletMatrix, decontaminate, leaks, phrases_of, shard_spans
from starlace.llm.textops import Words


def test_wavelet_matrix():
    r = np.random.default_rng(0)
    for n, top in ((0, 3), (1, 1), (63, 5), (64, 9), (500, 40)):
        seq = r.integers(0, top, n).astype(np.int32)
        tree = WaveletMatrix(seq, max(1, int(top).bit_length()))
        c, i = np.repeat(np.arange(top), n + 1), np.tile(np.arange(n + 1), top)
        assert tree.rank(c, i).tolist() == [int((seq[:k] == x).sum()) for x, k in zip(c, i)]
        if n:
            got, before = tree.access_rank(np.arange(n))
            assert got.tolist() == seq.tolist() and before.tolist() == [int((seq[:k] == seq[k]).sum()) for k in range(n)]


def test_search_and_locate():
    r = random.Random(4)
    for sample in (1, 3, 8):
        texts = [" ".join(r.choice("abc") for _ in range(r.randint(0, 30))) for _ in range(5)]
        w = Words(texts)
        index = FMIndex(w, sample)
        words = [t.split() for t in texts]
        for k in (1, 2, 4):
            some = [[r.choice("abcd") for _ in range(k)] for _ in range(6)]
            which, rows = index.search(np.stack([Words([" ".join(s)]).hash for s in some]))
            got = sorted(zip(which.tolist(), index.locate(rows).tolist()))
            want = sorted((q, int(w.first[d]) + at) for q, s in enumerate(some) for d, x in enumerate(words) for at in range(len(x) - k + 1) if x[at : at + k] == s)
            assert got == want


def spans(words, items, n, least):
    hits = []
    for i, it in items:
        v = it.split()
        for p in [v[k : k + n] for k in range(len(v) - n + 1)] if len(v) >= n else [v] if len(v) >= least else []:
            hits += [(k, k + len(p), i) for k in range(len(words) - len(p) + 1) if words[k : k + len(p)] == p]
    out = []
    for a, b, i in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
            out[-1][2].add(i)
        else:
            out.append([a, b, {i}])
    return [(a, b - a, sorted(i)) for a, b, i in out]


def test_against_brute_force():
    r = random.Random(6)
    for _ in range(80):
        vocabulary = [f"w{i}" for i in range(r.choice([2, 4, 30]))]
        make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
        texts = [make(r.choice([0, 1, 5, 30, 60])) for _ in range(6)]
        items = [(i, make(r.choice([2, 3, 4, 9]))) for i in range(5)]
        got = shard_spans(texts, phrases_of(items, 4, 3), sample=r.choice([1, 3, 8]))
        for t, g in zip(texts, got):
            assert [(s, n, i) for s, n, _, _, i in g] == spans(t.split(), items, 4, 3)


def test_cut(spark):
    item = "Alpha beta, gamma delta\nepsilon zeta eta theta iota"
    docs = spark.createDataFrame([(1, f"é avant: ALPHA beta gamma DELTA epsilon zeta eta; theta iota! après 🙂"), (2, "alpha beta gamma delta epsilon"), (3, item), (4, f"{item} x {item}")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, item), (9, None), (None, item), (10, "short one")], "item_id long, text string")
    got = {r.doc_id: r.text for r in decontaminate(docs, bench).collect()}
    assert got == {1: "é avant: ! après 🙂", 2: "alpha beta gamma delta epsilon", 3: "", 4: " x "}
    assert [s["items"] for s in leaks(docs, bench).where("doc_id = 4").first().spans] == [[7, 8], [7, 8]]


def test_several_parts(spark, monkeypatch):
    import starlace.llm.decontaminate as d

    monkeypatch.setattr(d, "PHRASES", 20)
    words = [f"q{k}" for k in range(40)]
    bench = spark.createDataFrame([(k, " ".join(words[k : k + 10])) for k in range(0, 30, 3)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(words[:37]) + " b")], "doc_id long, text string")
    assert decontaminate(docs, bench).first().text == "a  b"


def test_odd(spark, odd, none, clashing):
    bench = spark.createDataFrame([(1, "seven wise owls watch from a hollow oak near the river")], "item_id long, text string")
    got = decontaminate(odd, bench)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert got.where("text LIKE '%owls%'").count() == 0 and got.where("text IS NULL").count() == 2
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert sorted(map(str, decontaminate(odd, nothing).collect())) == sorted(map(str, odd.collect()))
    assert decontaminate(none, bench).count() == 0
    assert decontaminate(clashing, bench).columns == clashing.columns
