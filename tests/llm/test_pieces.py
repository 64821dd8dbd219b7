import random

import numpy as np

from starlace.llm.pieces import MODEL, SPACE, Decoder, Encoder, Vocabulary, encode_decode, load, tokenize


def odd_texts():
    r = random.Random(1)
    some = ["", " ", "  Hello   world\n\ttest x é漢字kana", "    a", "a" * 3000, " " * 70, "日本語のテキスト", "x\n\n\n  y", "🙂🙃 ok", "http://foo.bar/baz?x=1&y=2", "<s> </s> <unk> <0x0A>", "İstanbul"]
    return some + ["".join(r.choice("abcdefgh  \n\t.,éüß漢1234 {}()_-") for _ in range(r.randint(1, 80))) for _ in range(400)]


def test_bpe_is_the_librarys(small):
    import sentencepiece

    texts = odd_texts() + [r.text for r in small.select("text").collect()]
    v = load()
    ids, first = Encoder(v).encode(texts)
    want = sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(texts)
    assert [ids[first[k] : first[k + 1]].tolist() for k in range(len(texts))] == want
    assert Decoder(v).decode(ids, first) == texts


def test_remembering_changes_nothing(monkeypatch):
    import starlace.llm.pieces as p

    v = load()
    texts = odd_texts()
    want = Encoder(v).encode(texts)[0].tolist()
    monkeypatch.setattr(p, "REMEMBER", 50)
    e = Encoder(v)
    for _ in range(3):
        assert e.encode(texts)[0].tolist() == want


def test_unigram_viterbi():
    r = random.Random(9)
    letters = "abc"
    pieces = ["<unk>", *letters, SPACE, *{"".join(r.choice(letters) for _ in range(r.randint(2, 4))) for _ in range(12)}, SPACE + "a", SPACE + "ab"]
    scores = [0.0, *[-r.random() * 5 for _ in pieces[1:]]]
    v = Vocabulary(pieces, scores, False, 0, None, {0})
    texts = ["".join(r.choice("abc ") for _ in range(r.randint(1, 14))) for _ in range(60)]
    ids, first = Encoder(v).encode(texts)

    def best(s):
        top = [(0.0, ())] + [(-np.inf, ())] * len(s)
        for j in range(1, len(s) + 1):
            for k in range(j):
                if s[k:j] in v.id_of and top[k][0] > -np.inf:
                    top[j] = max(top[j], (top[k][0] + scores[v.id_of[s[k:j]]], top[k][1] + (v.id_of[s[k:j]],)))
        return top[-1][0]

    for k, t in enumerate(texts):
        s = SPACE + t.replace(" ", SPACE)
        got = ids[first[k] : first[k + 1]].tolist()
        assert "".join(pieces[i] for i in got) == s and abs(sum(scores[i] for i in got) - best(s)) < 1e-9


def test_table(odd, none, clashing):
    got = {(r.doc_id, r.decoded): r for r in encode_decode(odd).collect()}
    assert all((r.doc_id, r.text) in got for r in odd.collect())
    assert got[5, None].piece_ids is None and got[5, None].n_pieces is None and got[4, ""].piece_ids == []
    assert encode_decode(none).count() == 0
    assert tokenize(clashing).count() == odd.count() and encode_decode(clashing).count() == odd.count()


def test_unbroken_runs_longer_than_the_tables_of_powers():
    import sentencepiece

    v, text = load(), "a" * 1_500_000
    ids, first = Encoder(v).encode([text])
    assert first.tolist() == [0, len(ids)] and Decoder(v).decode(ids, first) == [text]
    text = "abc" * 10_000  # merged one by one as well
    assert Encoder(v).encode([text])[0].tolist() == sentencepiece.SentencePieceProcessor(model_file=MODEL).encode(text)
    # without priorities there is no merging; no piece is tried here, which would take minutes
    v = Vocabulary(["<unk>", "a", "aa", SPACE], [0.0, -1.0, -1.5, -1.0], False, 0, None, {0})
    v.longest = 0
    last, _ = v.viterbi(np.ones((1, (1 << 20) + 1), v.code.dtype))
    assert last.shape == (1, (1 << 20) + 2)
