import random
import re

import numpy as np

from starlace.llm.textops import Words, codepoints, suffix_ranks, windows


def test_words_are_those_of_a_regex():
    texts = ["Foo_1 bar, BAR", "", "é É  x-y", "a", "b", "漢字 かな 12³", "İ ß"]
    w = Words(texts)
    got = [["".join(map(chr, w.cp[w.start[k] : w.end[k]])) for k in range(w.first[d], w.first[d + 1])] for d in range(len(texts))]
    assert got == [re.findall(r"\w+", t) for t in texts]
    assert w.hash[1] == w.hash[2] and w.hash[3] == w.hash[4] and len(set(w.hash.tolist())) == len(w.hash) - 2


def test_windows_stay_in_a_text():
    w = Words(["a b c", "a b", "a b c"])
    h, at = windows(w, 3)
    assert at.tolist() == [0, 5] and h[0] == h[1]
    assert len(windows(Words(["a"]), 3)[0]) == 0


def test_suffix_order():
    r = random.Random(1)
    for _ in range(60):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in range(4)]
        cp, base = codepoints(texts)
        if not len(cp):
            continue
        doc = np.repeat(np.arange(len(texts)), np.diff(base))
        ends = base[1:][doc]
        s = "".join(texts)
        for separate in (True, False):
            for _, _, order, _ in suffix_ranks(cp.astype(np.int64), doc, ends, separate):
                pass
            want = sorted(range(len(s)), key=lambda p: ((doc[p],) if separate else ()) + (s[p : ends[p]] + "\0", doc[p]))
            assert order.tolist() == want
