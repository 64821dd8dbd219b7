import random

from starlace.llm.repetition import filter_repetitive, repeats, repetition


def brute(t, least):
    cover, longest, n = set(), 0, len(t)
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and t[i + k] == t[j + k]:
                k += 1
            if k >= least:
                cover |= set(range(i, i + k)) | set(range(j, j + k))
                longest = max(longest, k)
    return len(cover), longest


def test_against_brute_force():
    r = random.Random(3)
    for k in range(120):
        texts = ["".join(r.choice("ab" if k % 2 else "abcé漢") for _ in range(r.randint(0, 40))) for _ in range(3)]
        least = r.choice([2, 3, 5, 9, 14])
        covered, longest = repeats(texts, least)
        assert [(int(a), int(b)) for a, b in zip(covered, longest)] == [brute(t, least) for t in texts]


def test_rules(odd, none, clashing):
    got = {(r.doc_id, r.n_chars): r.rule for r in repetition(odd).collect()}
    assert got[5, None].keep and got[4, 0].keep and got[4, 0].fraction == 0
    assert not got[12, 4000].keep and got[12, 4000].fraction > 0.9
    kept = filter_repetitive(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert filter_repetitive(none).count() == 0
    assert filter_repetitive(clashing).columns == clashing.columns and filter_repetitive(clashing).count() == odd.count() - 1


def test_longest_repeat(spark):
    text = "".join(chr(97 + k * k % 23) + chr(97 + k % 26) + str(k) for k in range(400))
    df = spark.createDataFrame([(1, text + " - " + text + "z" * 3 + str(list(range(9000))))], "doc_id long, text string")
    got = repetition(df).first().rule
    assert got.longest >= len(text) and not got.keep
