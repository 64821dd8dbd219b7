import random
from collections import defaultdict

from starlace.llm.components import components
from starlace.llm.near_dedup import drop_near_copies, jaccard, least_matches, near_groups, shingles


def groups_of(pairs, ids):
    at = {i: i for i in ids}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        at[b] = a
    some = defaultdict(list)
    for i in ids:
        some[find(i)].append(i)
    return {i: min(m) for m in some.values() if len(m) > 1 for i in m}


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 130)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    want = groups_of([e for e in edges if e[0] != e[1]], {x for e in edges for x in e})
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bounds():
    """Pairs at the threshold are pruned about as often as the miss probability says."""
    steps = least_matches(160, 0.5, 32, 0.001)
    assert steps[0] == (32, min(m for m in range(33) if m == steps[0][1])) and all(m < n * 0.5 for n, m in steps)
    r = random.Random(1)
    lost = 0
    for _ in range(2000):
        hits, seen = 0, 0
        for n, m in steps:
            hits += sum(r.random() < 0.6 for _ in range(n - seen))
            seen = n
            if hits < m:
                lost += 1
                break
    assert lost < 20


def test_against_all_pairs(spark, small):
    docs = small.select("doc_id", "text").collect()
    h, first = shingles([d.text for d in docs])
    sets = [h[first[k] : first[k + 1]] for k in range(len(docs))]
    pairs = [(docs[a].doc_id, docs[b].doc_id) for a in range(len(docs)) for b in range(a) if jaccard(sets[a], sets[b]) >= 0.5]
    want = groups_of(pairs, [d.doc_id for d in docs])
    got = dict(map(tuple, near_groups(small).collect()))
    assert sum(got.get(a) is not None and got.get(a) == got.get(b) for a, b in pairs) >= 0.9 * len(pairs) > 0
    # no group joins what all pairs don't, and those that are whole are the same
    assert all(want[i] == want[g] for i, g in got.items())
    assert sum(got.get(i) == g for i, g in want.items()) >= 0.9 * len(want)


def test_many_near_copies_and_a_link_through_a_late_pair(spark):
    """A bucket of many copies, and one document that is near some of them but not their leader."""
    r = random.Random(5)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    docs = []
    for k in range(150):
        w = list(base)
        for at in r.sample(range(120), 3):
            w[at] = f"e{k}_{at}"
        docs.append((k, " ".join(w)))
    docs.append((500, " ".join(f"z{r.randint(0, 10**6)}" for _ in range(120))))
    got = dict(map(tuple, near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert set(got) == set(range(150)) and set(got.values()) == {0}


def test_odd(odd, none, clashing):
    got = dict(map(tuple, near_groups(odd).collect()))
    assert got[1] == got[2] == got[3] == 1 and got[8] == got[9] == 8
    assert not {4, 5, 6, 10, -3, None} & set(got)
    kept = [r.doc_id for r in drop_near_copies(odd).collect()]
    assert sorted(k for k in kept if k is not None) == [-3, 1, 4, 5, 6, 7, 8, 10, 11, 12] and kept.count(None) == 2
    assert near_groups(none).count() == 0 and drop_near_copies(none).count() == 0
    other = drop_near_copies(clashing)
    assert other.columns == clashing.columns and other.count() == len(kept)


def test_an_id_with_several_texts_is_near_what_any_of_them_is(spark):
    text = lambda seed: " ".join(f"w{random.Random(seed * 1000 + k).randint(0, 10**6)}" for k in range(60))
    docs = [(1, text(1)), (1, text(2)), (1, text(2)), (2, text(1) + " end"), (3, text(2) + " end"), (4, text(3)), (5, text(4)), (6, text(4)), (6, text(5)), (7, "more " + text(5)), (8, text(9)), (8, text(9))]
    got = dict(map(tuple, near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5}
    kept = drop_near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [1, 4, 5, 8]
