import numpy as np

import starlace.llm.class_lm as lm
from starlace.llm.class_lm import _dump, _load, exchange, exchange_together, objective, perplexity, train
from starlace.llm.textops import Words


def matrix(pairs, label, classes):
    m = np.zeros((classes + 1, classes + 1))
    np.add.at(m, (label[:, None].repeat(len(label), 1), label[None].repeat(len(label), 0)), pairs)
    return m


def test_exchange_takes_the_best_move():
    rng = np.random.default_rng(0)
    for _ in range(40):
        v, c = 12, 4
        pairs = rng.integers(0, 4, (v + 1, v + 1)).astype(float)
        pairs[:, v] = 0
        label = np.append(rng.integers(0, c, v), c)
        profile = np.stack([[np.bincount(label, pairs[i], c + 1), np.bincount(label, pairs[:, i], c + 1)] for i in range(v)])
        i = int(rng.integers(v))
        m = matrix(pairs, label, c)
        new = exchange(np.arange(i, i + 1), profile[i : i + 1], np.diag(pairs)[i : i + 1], label[i : i + 1], m, c)
        moved = label.copy()
        moved[i] = new[0]
        assert np.allclose(m, matrix(pairs, moved, c))
        best = max(objective(matrix(pairs, np.where(np.arange(v + 1) == i, k, label), c)) for k in range(c))
        assert abs(objective(m) - best) < 1e-6


def test_packing():
    rng = np.random.default_rng(1)
    some = [rng.integers(0, 2**63, 1000).astype(np.uint64) * np.uint64(2), np.arange(1000), np.empty(0, np.int64), rng.integers(0, 70_000, 17)]
    for x, y in zip(some, _load(_dump(*some))):
        assert (x == y).all() and len(x) == len(y)


def test_visited_together_each_moves_as_alone():
    rng = np.random.default_rng(2)
    for _ in range(40):
        v, c = 12, 4
        pairs = rng.integers(0, 4, (v + 1, v + 1)).astype(float)
        pairs[:, v] = 0
        label = np.append(rng.integers(0, c, v), c)
        profile = np.stack([[np.bincount(label, pairs[i], c + 1), np.bincount(label, pairs[:, i], c + 1)] for i in range(v)])
        m, selves = matrix(pairs, label, c), np.diag(pairs)[:v]
        alone = [exchange(np.arange(i, i + 1), profile[i : i + 1], selves[i : i + 1], label[i : i + 1], m.copy(), c)[0] for i in range(v)]
        assert exchange_together(profile, selves, label[:v], m.copy(), c).tolist() == alone
        i = int(rng.integers(v))
        moved, now = label.copy(), m.copy()
        moved[i] = exchange_together(profile[i : i + 1], selves[i : i + 1], label[i : i + 1], now, c)[0]
        assert np.allclose(now, matrix(pairs, moved, c))


def test_looked_up_gains_are_those_of_large_counts(monkeypatch):
    """The table of small counts changes nothing."""
    rng = np.random.default_rng(5)
    v, c = 60, 5
    pairs = rng.integers(0, 9, (v + 1, v + 1)).astype(float)
    pairs[:, v] = 0
    label = np.append(rng.integers(0, c, v), c)
    profile = np.stack([[np.bincount(label, pairs[i], c + 1), np.bincount(label, pairs[:, i], c + 1)] for i in range(v)])
    some = []
    for small in (1, 12, 400):
        monkeypatch.setattr(lm, "_SMALL", small)
        some.append(exchange_together(profile, np.diag(pairs)[:v], label[:v], matrix(pairs, label, c), c).tolist())
    assert some[0] == some[1] == some[2]


def test_against_a_loop(spark, small, monkeypatch):
    """Every word has its count, a class and an emission of its own; the counts of class pairs are
    those of a loop over the texts, and so are the scores."""
    monkeypatch.setattr(lm, "_BATCH", 5_000)
    monkeypatch.setattr(lm, "_BLOCK", 20_000)
    frequent = " ".join(f"w{k} w{k} w{k + 1}" for k in range(70_000))
    docs = small.select("doc_id", "text").union(spark.createDataFrame([(-1, frequent), (-2, None), (-3, "")], "doc_id long, text string"))
    model = train(docs, classes=6, passes=3)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    h, n = np.unique(Words(list(texts.values())).hash, return_counts=True)
    held = [_load(bytes(r.blob)) for r in model.words.collect()]
    k, count, label = (np.concatenate([x[j] for x in held]) for j in range(3))
    order = np.argsort(k)
    assert len(h) > 70_000 and (k[order] == h).all() and (count[order] == n).all()
    assert max(model.objectives) > model.objectives[0]
    emission = np.log(count + model.add) - np.log(model.totals)[label]
    assert np.allclose(np.bincount(label, np.exp(emission)), 1) and np.allclose(np.exp(model.transition).sum(1), 1)
    at = {x: j for j, x in enumerate(k.tolist())}
    got = {r.doc_id: r for r in model.scores(docs.schema, "n", "p").collect()}
    assert len(got) == len(texts)
    m = np.zeros((7, 7))
    for id, t in texts.items():
        assert got[id].text == (t or None) or id == -3
        before, p, w = 6, 0.0, Words([t]).hash.tolist()
        for x in w:
            now = int(label[at[x]])
            m[before, now] += 1
            p += model.transition[before, now] + emission[at[x]]
            before = now
        assert got[id].n == len(w) and abs(got[id].p - p) < 1e-6 * max(1, abs(p))
    assert abs(objective(m) - max(model.objectives)) < 1e-6 * abs(objective(m))


def test_likelihood_does_not_hang_on_the_number_of_parts(spark, small, monkeypatch):
    reached = []
    for share in (2_000, 50_000):
        monkeypatch.setattr(lm, "_SHARE", share)
        values = train(small, classes=8, passes=5).objectives
        assert values[-1] > values[0]
        reached.append((max(values) - values[0]) / abs(values[0]))
    assert min(reached) > 0.7 * max(reached)


def test_what_parts_tell_each_other_grows_with_the_text(spark, small, monkeypatch):
    """Four times the text, by what a part's share is: about four times the rows, not sixteen,
    and a part holds no more than _MOST shares."""
    words = len(Words([r.text or "" for r in small.collect()]).hash)
    rows, real = [], lm.written
    monkeypatch.setattr(lm, "_FEW", 8, raising=False)
    monkeypatch.setattr(lm, "written", lambda df, what: rows.append([what, got := real(df, what), got.count()]) or got)
    many = []
    for shares in (16, 64):
        monkeypatch.setattr(lm, "_SHARE", words // shares)
        rows.clear()
        model = train(small, classes=4, passes=1)
        parts = model.parts
        many.append(sum(n for what, _, n in rows if what in ("asked", "told")))
    assert many[1] < 6 * many[0]
    assert parts >= words / (lm._MOST * lm._SHARE)
    assert lm._parts(1_000 * words) >= 1_000 * words / (lm._MOST * lm._SHARE)


def test_pairs_added_up_by_runs_are_those_of_one_count(monkeypatch):
    rng = np.random.default_rng(7)
    for united in (1, 7, 10_000):
        monkeypatch.setattr(lm, "_UNITED", united)
        held, loop = [], {}
        for k in range(12):
            a = np.sort(rng.integers(0, 30, k * 5)).astype(np.uint32)
            p, b, n = (rng.integers(lo, hi, len(a)).astype(kind) for lo, hi, kind in ((0, 3, np.uint8), (0, 70_000, np.uint32), (1, 250, np.uint8)))
            b[: len(b) // 2] %= 2
            held.append([a, p, b, n])
            for *key, many in zip(*(x.tolist() for x in held[-1])):
                loop[tuple(key)] = loop.get(tuple(key), 0) + many
        a, p, b, n = (x.tolist() for x in lm._gathered(iter(held)))
        assert list(zip(a, p, b)) == sorted(loop) and n == [loop[x] for x in sorted(loop)]
        steps, at, many, part, place = (x.astype(np.int64) for x in _load(lm._linked(*lm._united(held))))
        assert np.cumsum(steps).tolist() == a and part[at].tolist() == p and place[at].tolist() == b and many.tolist() == n


def test_odd(odd, none, clashing):
    got = {(r.doc_id, r.n_chars): r.lm for r in perplexity(odd, classes=3, passes=1).collect()}
    assert got[4, 0].n_words == 0 and got[4, 0].perplexity is None and got[5, None].log_prob == 0
    assert got[6, len(" ".join(f"w{k % 977}x{k % 1009}" for k in range(30_000)))].n_words == 30_000
    assert perplexity(none, classes=3, passes=1).count() == 0
    assert perplexity(clashing, classes=3, passes=1).count() == odd.count()
    assert perplexity(odd, classes=3, passes=1, only=("doc_id",)).columns == ["doc_id", "lm"]
