"""SentencePiece encoding and decoding by a batched Viterbi in numpy.

A text is cut wherever no piece of the vocabulary has both neighbouring characters, so nothing
can go over a cut. Each distinct segment is encoded once: segments of equal length advance
together, hashes of their substrings are looked up among the sorted hashes of the pieces, and
the best last piece at every place is kept as a backpointer.

With a unigram model the best is the largest sum of scores. A BPE model's scores are merge
priorities, and their sum doesn't give the model's own segmentation; there the recurrence
admits a piece only if, beside the last piece of the prefix before it, no merge would have
come earlier than theirs did. Exactly one piece is admitted at each place, so the result is
the model's. (Pieces of equal priority, runs of spaces in practice, are told apart by place;
segments that could hold two of them are merged one by one.)

Defined results: a null text has null ids; an empty one has none. Encoding takes any text
whole. Decoding gives the text back exactly, but for U+2581, which reads as a space, as the
format has it. Repeated rows and ties have equal results; other columns are carried along.
The model is a parameter, read by the driver and sent to the workers as arrays (a few MB, of
the vocabulary's size whatever the data are).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import kept_names, own, quoted
from .textops import _powers, bounded, lazily, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Characters a block; distinct segments that a worker remembers.
BLOCK, REMEMBER = 1_000_000, 500_000
#: A longer segment is encoded one by one: alone in its length, it would be advanced character by character.
_LONG = 1 << 10


class Vocabulary:
    """Pieces and scores as sorted arrays; bpe: scores are merge priorities."""

    def __init__(self, pieces: list[str], scores: list[float], bpe: bool, unknown: int, byte_ids: list[int] | None, skip: set[int] = frozenset()):
        self.pieces, self.bpe, self.unknown, self.byte_ids = pieces, bpe, unknown, byte_ids
        self.name = zlib.crc32(repr((pieces, scores, bpe, unknown, byte_ids)).encode())
        usable = [i for i in range(len(pieces)) if i not in skip and pieces[i]]
        self.score = np.array(scores, np.float64)
        chars = sorted({c for i in usable for c in pieces[i]})
        single = {pieces[i] for i in usable if len(pieces[i]) == 1}
        # 0 for characters that only bytes can write, else a small number
        self.code = np.zeros(0x110000, np.uint16 if len(chars) < 65000 else np.uint32)
        for k, c in enumerate(chars):
            self.code[ord(c)] = k + 1
        n = len(chars) + 1
        self.lone = np.zeros(n, bool)
        for c in single:
            self.lone[self.code[ord(c)]] = True
        joined = [(int(self.code[ord(p[j])]), int(self.code[ord(p[j + 1])])) for i in usable if len(p := pieces[i]) > 1 for j in range(len(p) - 1)]
        self.width = n
        self.pair_keys = np.unique(np.array([a * n + b for a, b in joined], np.int64)) if joined else np.empty(0, np.int64)
        self.longest = max((len(pieces[i]) for i in usable), default=1)
        self.id_of = {pieces[i]: i for i in reversed(usable)}
        ids = np.array(sorted(self.id_of.values()), np.int64)
        keys = np.array([self._hash_text(pieces[i]) for i in ids], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], ids[order]
        self.maybe = np.zeros(1 << 20, bool)  # most substrings are no piece: one look tells
        self.maybe[(self.keys >> np.uint64(44)).astype(np.int64)] = True
        if len(keys) and (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        if bpe:
            self._merges(usable)

    def _hash_text(self, text: str) -> np.uint64:
        c = self.code[np.frombuffer(text.encode("utf-32-le"), np.uint32)].astype(np.uint64)
        up, _ = _powers(1 << max(20, len(c).bit_length()))
        with np.errstate(over="ignore"):
            return mix(np.array([(c * up[: len(c)]).sum(dtype=np.uint64)]) + np.uint64(len(c)))[0]

    def _merges(self, usable: list[int]) -> None:
        n = len(self.pieces)
        # priority: 0 is merged first; a single character is there from the start
        by = sorted({-self.score[i] for i in usable if len(self.pieces[i]) > 1})
        place = {s: k for k, s in enumerate(by)}
        self.rank = np.full(n, -1, np.int64)
        for i in usable:
            if len(self.pieces[i]) > 1:
                self.rank[i] = place[-self.score[i]]
        keys, made = [], []
        for i in usable:
            p = self.pieces[i]
            if self.id_of.get(p) != i:
                continue
            for j in range(1, len(p)):
                a, b = self.id_of.get(p[:j]), self.id_of.get(p[j:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64)) if keys else np.empty(0, np.int64)
        self.join_keys, self.join_made = np.array(keys, np.int64)[order], np.array(made, np.int64)[order]
        self.join_maybe = np.zeros(1 << 22, bool)
        self.join_maybe[self._place(self.join_keys)] = True
        # how merging makes each piece of its characters; those it can't make are never used
        self.left, self.right, self.reachable = np.full(n, -1, np.int64), np.full(n, -1, np.int64), np.zeros(n, bool)
        for i in usable:
            p = self.pieces[i]
            if self.id_of.get(p) != i:
                continue
            if len(p) == 1:
                self.reachable[i] = True
                continue
            parts, last = self.merge(p, trace=True)
            if parts == [i] and last:
                self.reachable[i] = True
                self.left[i], self.right[i] = last
        times = np.bincount(self.rank[self.rank >= 0]) if (self.rank >= 0).any() else np.zeros(0, int)
        self.twins = {c for i in usable if self.rank[i] >= 0 and times[self.rank[i]] > 1 for c in self.pieces[i]}
        self.twin_pair = np.array(sorted({int(self.code[ord(p[j])]) * self.width + int(self.code[ord(p[j + 1])]) for i in usable if self.rank[i] >= 0 and times[self.rank[i]] > 1 for p in [self.pieces[i]] for j in range(len(p) - 1)}), np.int64)

    def merge(self, text: str, trace: bool = False):
        """Merging one by one, the best priority first, then the leftmost. Ids; characters without a piece are -1."""
        n = len(text)
        ids: list = [self.id_of.get(c, -1) for c in text]
        size, prev, nxt, made = [1] * n, list(range(-1, n - 1)), list(range(1, n + 1)), [None] * n
        heap: list = []

        def offer(a: int) -> None:
            b = nxt[a]
            if a >= 0 and b < n and ids[a] >= 0 and ids[b] >= 0:
                i = self.id_of.get(text[a : a + size[a] + size[b]])
                if i is not None:
                    heapq.heappush(heap, (-self.score[i], a, size[a], size[b], i))

        for a in range(n - 1):
            offer(a)
        alive = [True] * n
        while heap:
            _, a, sa, sb, i = heapq.heappop(heap)
            b = nxt[a] if alive[a] else n
            if not alive[a] or b >= n or size[a] != sa or size[b] != sb:
                continue
            made[a] = (ids[a], ids[b])
            ids[a], size[a], alive[b], nxt[a] = i, sa + sb, False, nxt[b]
            if nxt[a] < n:
                prev[nxt[a]] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        out = [ids[k] for k in range(n) if alive[k]]
        return (out, made[0]) if trace else out

    @staticmethod
    def _place(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(42)).astype(np.int64)

    def joins(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The priority at which a and b, side by side, merge; a very large number if never."""
        key = a * len(self.pieces) + b
        out = np.full(len(a), 1 << 60)
        rows = np.flatnonzero(self.join_maybe[self._place(key)])
        if len(rows):
            at = np.minimum(np.searchsorted(self.join_keys, key[rows]), len(self.join_keys) - 1)
            hit = self.join_keys[at] == key[rows]
            out[rows[hit]] = self.rank[self.join_made[at[hit]]]
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging would leave a and b side by side: their merges are undone, the latest
        first, and at no time may a merge over the border have been due."""
        ok = np.ones(len(a), bool)
        at = np.arange(len(a))
        # a merge over the border wins against one within the right part at equal priority, being further left
        limit = np.full(len(a), 1 << 59)
        a, b = a.copy(), b.copy()
        while len(at):
            early = self.joins(a, b) < limit
            ok[at[early]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~early & ((ra >= 0) | (rb >= 0))
            at, a, b, ra, rb = at[go], a[go], b[go], ra[go], rb[go]
            left = ra > rb
            limit = np.where(left, ra, rb + 1)
            a, b = np.where(left, self.right[a], a), np.where(left, b, self.left[b])
        return ok

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """codes: segments x length. Backpointers: the last piece, and its length, at each place."""
        m, length = codes.shape
        up, down = _powers(1 << max(20, length.bit_length()))
        sums = np.zeros((m, length + 1), np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(codes.astype(np.uint64) * up[:length], axis=1, out=sums[:, 1:])
        best = np.full((m, length + 1), -np.inf)
        best[:, 0] = 0
        last, size = np.full((m, length + 1), -1, np.int64), np.zeros((m, length + 1), np.int32)
        for j in range(1, length + 1):
            for n in range(1, min(j, self.longest) + 1):
                with np.errstate(over="ignore"):
                    key = mix((sums[:, j] - sums[:, j - n]) * down[j - n] + np.uint64(n))
                rows = np.flatnonzero(self.maybe[(key >> np.uint64(44)).astype(np.int64)] & (last[:, j - n] >= 0 if n < j else True))
                at = np.minimum(np.searchsorted(self.keys, key[rows]), len(self.keys) - 1)
                hit = self.keys[at] == key[rows]
                rows, at = rows[hit], at[hit]
                if not len(rows):
                    continue
                piece = self.ids[at]
                if self.bpe:
                    use = self.reachable[piece]
                    if n < j:
                        use[use] = self.fits(last[rows[use], j - n], piece[use])
                    rows, piece = rows[use], piece[use]
                    value = np.zeros(len(rows))
                else:
                    value = best[rows, j - n] + self.score[piece]
                better = value > best[rows, j]
                rows, piece = rows[better], piece[better]
                best[rows, j], last[rows, j], size[rows, j] = value[better], piece, n
        return last, size

    def encode_segments(self, segments: list[np.ndarray]) -> list[np.ndarray]:
        """Piece ids of segments of known characters."""
        out: list = [None] * len(segments)
        lengths = np.array([len(s) for s in segments], np.int64)
        # filled up to few lengths with a code that no piece has, so that many are of equal length
        filled = np.maximum(4, lengths)
        top = 1 << np.maximum(0, np.int64(np.ceil(np.log2(filled))) - 2)
        filled = -(-filled // top) * top
        order = np.argsort(filled, kind="stable")
        cuts = np.flatnonzero(np.append(True, np.diff(filled[order]) > 0)) if len(order) else np.empty(0, np.int64)
        for lo, hi in zip(cuts, np.append(cuts[1:], len(order))):
            length = int(filled[order[lo]])
            step = max(1, 1_000_000 // (length + 1))
            for k in range(lo, hi, step):
                rows = order[k : min(hi, k + step)]
                codes = np.zeros((len(rows), length), self.code.dtype)
                codes[np.arange(length) < lengths[rows][:, None]] = np.concatenate([segments[r] for r in rows])
                last, size = self.viterbi(codes)
                at, parts = lengths[rows].copy(), []
                where = np.arange(len(rows))
                while len(where):  # back from the ends, all rows together
                    p = last[where, at[where]]
                    if (p < 0).any():
                        raise ValueError("a segment can't be written in pieces")
                    parts.append((where, p))
                    at[where] -= size[where, at[where]]
                    where = where[at[where] > 0]
                who = np.concatenate([w for w, _ in reversed(parts)])
                what = np.concatenate([p for _, p in reversed(parts)])
                by = np.argsort(who, kind="stable")
                what, count = what[by], np.bincount(who, minlength=len(rows))
                for r, x in zip(rows.tolist(), np.split(what, np.cumsum(count)[:-1])):
                    out[r] = x
        return out


def load(model: str = MODEL) -> Vocabulary:
    """A SentencePiece model file: BPE or unigram, without normalisation but for the leading space."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    norm = proto.normalizer_spec
    if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
        raise ValueError("only models without normalisation, with a leading space")
    kind = [p.type for p in proto.pieces]
    byte = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 6}
    byte_ids = [byte[f"<0x{b:02X}>"] for b in range(256)] if byte else None
    if any(k == 4 for k in kind):
        raise ValueError("models with user-defined symbols aren't read")
    return Vocabulary([p.piece for p in proto.pieces], [p.score for p in proto.pieces], proto.trainer_spec.model_type == 2, kind.index(2), byte_ids, {i for i, k in enumerate(kind) if k != 1})


class Encoder:
    """Encodes blocks of texts, remembering segments."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.joined = np.zeros(v.width * v.width, bool)
        self.joined[v.pair_keys] = True
        self.twin = np.zeros(v.width * v.width, bool)
        if v.bpe:
            self.twin[v.twin_pair] = True
        self._forget()

    def _forget(self) -> None:
        self.known = np.empty(0, np.uint64)  # hashes, sorted
        self.slot = np.empty(0, np.int64)
        self.flat, self.begin, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.again = np.empty(0, bool)  # asked for again since it was learnt

    def _trim(self) -> None:
        """Keeps the segments that were asked for again."""
        keep = self.again[self.slot]
        known, slot = self.known[keep], self.slot[keep]
        count, begin = self.count[slot], self.begin[slot]
        first = np.append(0, np.cumsum(count))
        flat = self.flat[np.repeat(begin - first[:-1], count) + np.arange(first[-1])]
        self._forget()
        if len(known) <= REMEMBER // 2:
            self.known, self.slot, self.flat, self.begin, self.count = known, np.arange(len(known)), flat, first[:-1], count
            self.again = np.zeros(len(known), bool)

    def _keep(self, hashes: np.ndarray, ids: list) -> None:
        count = np.array([len(x) for x in ids], np.int64)
        begin = len(self.flat) + np.cumsum(count) - count
        slot = len(self.begin) + np.arange(len(ids))
        self.flat = np.concatenate([self.flat, np.concatenate(ids).astype(np.int32)])
        self.begin, self.count = np.append(self.begin, begin), np.append(self.count, count)
        self.again = np.append(self.again, np.zeros(len(ids), bool))
        known, slots = np.append(self.known, hashes), np.append(self.slot, slot)
        order = np.argsort(known)
        self.known, self.slot = known[order], slots[order]

    def _learn(self, hashes: np.ndarray, segments: list[np.ndarray], texts: list[str], slow: np.ndarray) -> None:
        ids: list = [None] * len(segments)
        slow = slow | np.array([len(s) > _LONG for s in segments], bool)
        fast = np.flatnonzero(~slow)
        for r, x in zip(fast.tolist(), self.v.encode_segments([segments[k] for k in fast])):
            ids[r] = x
        for r in np.flatnonzero(slow).tolist():
            ids[r] = np.array(self.v.merge(texts[r]) if self.v.bpe else self._unigram(texts[r]))
        self._keep(hashes, ids)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids end to end, and where each text's begin."""
        v = self.v
        whole = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        joined = "".join(whole)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        base = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in whole], out=base[1:])
        if not len(cp):
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        code = v.code[cp]
        pair = code[:-1].astype(np.int64) * v.width + code[1:]
        cut = np.ones(len(cp), bool)
        cut[1:] = ~self.joined[pair]
        cut[base[:-1][base[:-1] < len(cp)]] = True
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(cp))
        # characters that aren't pieces by themselves are written in bytes; pieces may still hold them
        lone = v.lone[code]
        odd = np.zeros(len(start), bool)
        if not lone.all():
            odd = np.add.reduceat(~lone, start) > 0
        hashes = np.empty(len(start), np.uint64)
        lo, step = 0, 1 << 20
        with np.errstate(over="ignore"):
            while lo < len(start):
                hi = max(lo + 1, int(np.searchsorted(stop, start[lo] + step, "right")))
                a, b = int(start[lo]), int(stop[hi - 1])
                up, down = _powers(1 << max(20, int(b - a).bit_length()))
                sums = np.zeros(b - a + 1, np.uint64)
                np.cumsum(cp[a:b].astype(np.uint64) * up[: b - a], out=sums[1:])
                s, e = start[lo:hi] - a, stop[lo:hi] - a
                hashes[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
                lo = hi
        hashes = mix(hashes)
        if len(self.known) > REMEMBER:
            self._trim()
        # each distinct segment is looked up once, in order of the hashes
        order = np.argsort(hashes)
        ranked = hashes[order]
        lead = np.append(True, ranked[1:] != ranked[:-1])
        distinct, example = ranked[lead], order[lead]
        which = np.empty(len(start), np.int64)
        which[order] = np.cumsum(lead) - 1
        at = np.minimum(np.searchsorted(self.known, distinct), max(0, len(self.known) - 1))
        new = self.known[at] != distinct if len(self.known) else np.ones(len(distinct), bool)
        if new.any():
            first = example[new]
            segments = [code[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())]
            strings = [joined[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist())]
            slow = odd[first].copy()
            if v.bpe and len(v.twin_pair):
                twin = np.append(self.twin[pair], False)
                n = np.append(0, np.cumsum(twin))
                slow |= n[stop[first] - 1] > n[start[first]]
            plain = self._bytes(strings, odd[first])
            keep = ~plain
            if keep.any():
                pick = np.flatnonzero(keep)
                self._learn(hashes[first[pick]], [segments[k] for k in pick], [strings[k] for k in pick], slow[pick])
            at = np.searchsorted(self.known, distinct)
        slot = self.slot[at]
        self.again[slot[~new]] = True
        slot = slot[which]
        count, begin = self.count[slot], self.begin[slot]
        first = np.append(0, np.cumsum(count))
        out = self.flat[np.repeat(begin - first[:-1], count) + np.arange(first[-1])]
        text_first = first[np.searchsorted(start, base)]
        return out, text_first

    def _bytes(self, strings: list[str], odd: np.ndarray) -> np.ndarray:
        """Segments with characters that aren't pieces: merged one by one, the rest in bytes. Says which are learnt here."""
        done = np.zeros(len(strings), bool)
        rows = np.flatnonzero(odd)
        if not len(rows):
            return done
        ids, hashes = [], []
        for r in rows.tolist():
            text = strings[r]
            x: list = []
            place = 0
            for i in self.v.merge(text) if self.v.bpe else self._unigram(text):
                if i >= 0:
                    x.append(i)
                    place += len(self.v.pieces[i])
                    continue
                c = text[place]
                place += 1
                x += [self.v.byte_ids[b] for b in c.encode("utf-8", "surrogatepass")] if self.v.byte_ids else [self.v.unknown]
            ids.append(np.array(x, np.int64))
            cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
            up, _ = _powers(1 << max(20, len(cp).bit_length()))
            with np.errstate(over="ignore"):
                hashes.append(np.uint64((cp * up[: len(cp)]).sum(dtype=np.uint64)) + np.uint64(len(cp)) * np.uint64(0xD6E8FEB86659FD93))
            done[r] = True
        self._keep(mix(np.array(hashes, np.uint64)), ids)
        return done

    def _unigram(self, text: str) -> list[int]:
        n, find = len(text), self.v.id_of.get
        floor = float(self.v.score.min()) - 10.0  # of a character that no piece has
        best, back = [0.0] + [-np.inf] * n, [(0, -1)] * (n + 1)
        for j in range(1, n + 1):
            for k in range(max(0, j - self.v.longest), j):
                i = find(text[k:j], -1)
                if i < 0 and k < j - 1:
                    continue
                s = best[k] + (self.v.score[i] if i >= 0 else floor)
                if s > best[j]:
                    best[j], back[j] = s, (k, i)
        out, j = [], n
        while j:
            j, i = back[j]
            out.append(i)
        return out[::-1]


class Decoder:
    def __init__(self, vocabulary: Vocabulary):
        v = vocabulary
        raw = [p.replace(SPACE, " ").encode() for p in v.pieces]
        if v.byte_ids:
            for b, i in enumerate(v.byte_ids):
                raw[i] = bytes([b])
        self.size = np.array([len(r) for r in raw], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[str]:
        count = self.size[ids]
        upto = np.append(0, np.cumsum(count))
        data = self.flat[np.repeat(self.begin[ids] - upto[:-1], count) + np.arange(upto[-1])].tobytes()
        cuts = upto[first].tolist()
        return [data[a:b].decode("utf-8", "replace")[1:] for a, b in zip(cuts[:-1], cuts[1:])]


_HELD: dict = {}


def _held(kind: type, v: Vocabulary):
    """A worker's encoder or decoder, kept for the next task that has the same vocabulary."""
    if kind not in _HELD or _HELD[kind][0] != v.name:
        _HELD[kind] = (v.name, kind(v))
    return _HELD[kind][1]


def encode(text: Column, vocabulary) -> Column:
    """Array of piece ids. vocabulary: a broadcast of one."""

    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = _held(Encoder, vocabulary.value)
        for texts in batches:
            parts, firsts, n = [], [np.zeros(1, np.int64)], 0
            for _, some in bounded(range(len(texts)), lazily(texts), BLOCK):
                ids, first = encoder.encode(some)
                parts.append(ids)
                firsts.append(first[1:] + n)
                n += len(ids)
            first = np.concatenate(firsts).astype(np.int32)
            flat = np.concatenate(parts) if parts else np.empty(0, np.int32)
            mask = texts.is_null().to_numpy(zero_copy_only=False)
            yield pa.ListArray.from_arrays(pa.array(first), pa.array(flat, pa.int32()), mask=pa.array(mask) if mask.any() else None)

    return F.arrow_udf(make, T.ArrayType(T.IntegerType())).asNondeterministic()(text)


def decode(ids: Column, vocabulary) -> Column:
    def make(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decoder = _held(Decoder, vocabulary.value)
        for lists in batches:
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            first = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))
            got = decoder.decode(lists.flatten().to_numpy(zero_copy_only=False), first)
            valid = lists.is_valid().to_pylist()
            yield pa.array([t if ok else None for t, ok in zip(got, valid)], pa.string())

    return F.arrow_udf(make, T.StringType())(ids)


@kept_names
def tokenize(docs: DataFrame, text: str = "text", model: str = MODEL, into: str = "piece_ids") -> DataFrame:
    """docs with one more column, the ids of text's pieces."""
    v = docs.sparkSession.sparkContext.broadcast(load(model))
    return docs.select(*own(docs, into), encode(F.col(quoted(text)), v).alias(into))


@kept_names
def detokenize(docs: DataFrame, ids: str = "piece_ids", model: str = MODEL, into: str = "decoded") -> DataFrame:
    v = docs.sparkSession.sparkContext.broadcast(load(model))
    return docs.select(*own(docs, into), decode(F.col(quoted(ids)), v).alias(into))


@kept_names
def encode_decode(docs: DataFrame, text: str = "text", model: str = MODEL, id: str = "doc_id") -> DataFrame:
    """(id, piece_ids, n_pieces, decoded) of each document, in one pass through Python."""
    v = docs.sparkSession.sparkContext.broadcast(load(model))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _held(Encoder, v.value), _held(Decoder, v.value)
        for batch in batches:
            at = 0
            texts = batch.column(1)
            for some, values in bounded(range(batch.num_rows), lazily(texts), BLOCK):
                ids, first = encoder.encode(values)
                valid = texts.slice(at, len(some)).is_valid()
                mask = None if texts.null_count == 0 else pa.compute.invert(valid)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32()), mask=mask)
                n = pa.compute.if_else(valid, pa.array(np.diff(first)), pa.scalar(None, pa.int64()))
                back = pa.compute.if_else(valid, pa.array(decoder.decode(ids, first), pa.string()), pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(some)), lists, n, back], [id, "piece_ids", "n_pieces", "decoded"])
                at += len(some)

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(quoted(id)).alias(id), F.col(quoted(text)).alias("text_")).mapInArrow(make, f"{quoted(id)} {kind}, piece_ids array<int>, n_pieces bigint, decoded string")


def query(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
