"""PII: candidate spans from high-recall generators, ranked by boosted trees.

Generators propose overlapping spans: addresses of mail, numbers that could be telephones or
cards (of numbers side by side every run of groups of digits), network addresses, account
numbers, and secrets, by their own look or by the word and sign before them, whatever they are
made of. Each span is described by its format
(digits, groups, checksums, entropy) and its context (neighbouring characters, cue words);
gradient-boosted trees turn that into a score, calibrated on held-out candidates into a
probability. A span is redacted when it reaches its kind's threshold; of spans that overlap
the likeliest wins, then the longest, then the first.

The trees are trained here, on ``TRAINING`` made-up candidates (documented bound, independent
of the data): formats drawn from public definitions, with look-alikes such as card numbers
with a wrong check digit, versions, dates, amounts and ordinary words.

Defined results: null stays null; an empty text has no spans; texts are read whole, in windows
around places that could matter (digits, @, = and :, capitals inside words), and windows never cut
a candidate; a secret of small letters alone is proposed only after a word such as "password" and
= or :, and one of capitals alone too; equal rows have equal
results; other columns are carried along.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import fresh, kept_names, own, quoted
from .textops import bounded, codepoints, lazily

KINDS = ("EMAIL", "PHONE", "CARD", "IP", "SECRET", "ACCOUNT")
#: Production parameters: made-up candidates, trees, depth, shrinkage, and the wanted precision.
TRAINING, TREES, DEPTH, SHRINK, PRECISION = 24_000, 60, 5, 0.3, 0.99
_BLOCK = 1_000_000
_GENERATORS = (
    ("EMAIL", re.compile(r"(?<![\w.%+'-])[\w.%+'-]+@[\w-]+(?:\.[\w-]+)*")),
    ("PHONE", re.compile(r"(?<![\w.])(?:\+|\()?\d(?:[ \t().\-/]{0,3}\d){6,16}(?!\w|\.\d)")),
    ("PHONE", re.compile(r"(?<![\w.])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{2,4}[ .-]?\d{2,5}(?!\d)")),
    ("CARD", re.compile(r"(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w)")),
    ("CARD", re.compile(r"(?<!\w)\d{12,19}(?!\w)")),
    ("CARD", re.compile(r"(?<!\w)\d{4}(?:[ -]\d{4}){3}(?!\w)")),
    ("IP", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)")),
    ("IP", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])")),
    ("IP", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){1,7}:(?![\w:])")),
    ("SECRET", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*\d)[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")),
    ("SECRET", re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Z+/_-]*[a-z])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_-])")),
    ("SECRET", re.compile(r"(?i)(?<![a-z])(?:[a-z0-9]{1,20}[_-]){0,3}(?:password|passwd|passphrase|pass|pwd|secret|token|apikey|key|auth|bearer|credentials?)(?:[_-][a-z0-9]{1,20}){0,3}[\"']?[ \t]{0,3}(?:[:=]|=>)[ \t]{0,3}[\"']?([^\s\"'<>]{6,})")),
    ("ACCOUNT", re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ACCOUNT", re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])")),
)
_CUES = ("token", "key", "secret", "passw", "api", "auth", "bearer", "tel", "phone", "call", "fax", "mobile", "mail", "contact", "card", "visa", "credit", "iban", "account", "ssn", "social", "ip", "host", "server", "addr", "version", "ver", "v.", "pwd", "credential", "pass", "isbn", "order", "no.", "part", "commit", "sha", "figure", "page", "id")
_SPACE = set(" \t\r\n\f\v   ")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * log2(c / n) for c in (s.count(x) for x in set(s)))


def features(text: str, start: int, stop: int, kind: str) -> list[float]:
    s = text[start:stop]
    left, right = text[max(0, start - 40) : start], text[stop : stop + 20]
    digits = "".join(c for c in s if "0" <= c <= "9")
    n, d = len(s), len(digits)
    letters = sum(c.isalpha() for c in s)
    groups = re.findall(r"\d+", s)
    octets = [int(g) for g in groups[:4] if len(g) < 5]
    cue = left.lower()
    local, _, domain = s.partition("@")
    tail = domain.rsplit(".", 1)[-1] if "." in domain else ""
    hexes = sum(c in "0123456789abcdefABCDEF" for c in s)
    iban = re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9 ]{8,40}", s) is not None
    row = [float(kind == k) for k in KINDS]
    row += [
        n, d, letters, d / n, hexes / n, len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0), float(len(groups[0]) if groups else 0), float(len(groups[-1]) if groups else 0),
        _entropy(s), float(13 <= d <= 19 and _luhn(digits)), float(digits[:1] in ("3", "4", "5", "6") and d > 0), float(len(octets) == 4 and all(o < 256 for o in octets)), float(len(octets) == 4 and octets[0] > 0), s.count("."), s.count("-"), s.count(" "), s.count(":"), s.count("/") + s.count("_"),
        float(s[:1] == "+"), float("(" in s and ")" in s), float("(" in s) - float(")" in s), float("@" in s), len(tail), float(tail.isalpha()), len(local), domain.count("."), float(iban and _mod97(s)), float(s.isupper()), float(s.islower()), float(s == s.lower() and hexes == n),
        float(left[-1:].isspace() or not left), float(left[-1:] in "\"'=:"), float(left[-1:].isdigit()), float(left[-1:].isalnum()), float(left[-1:] == "."), float(left[-1:] == "/"), float(left[-1:] in "+("),
        float(right[:1].isspace() or not right), float(right[:1] in "\"'"), float(right[:1].isalnum()), float(right[:2].strip().isdigit() and bool(right.strip())), float(right[:1] == "-"), float(left[-2:].strip().isdigit() and bool(left.strip())), float(left[-1:] in "$€£#"), float(right[:1] == "%"),
    ]
    sorts = ["a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "." for c in s[:200]]
    row += [sum(x != y for x, y in zip(sorts, sorts[1:])), sorts.count("."), sorts.count("A"), sum(c in "aeiouAEIOU" for c in s) / max(1, letters), float(left.rstrip("\"' ")[-1:] in (":", "=")), s.count("::"), float(s[:1] in "'.%+-_"), float(s[-1:] in "-_'"), float(right[:1] in (".", "-", "/", ":") and right[1:2].isdigit()), float(left[-1:] in (".", "-", "/", ":") and left[-2:-1].isdigit())]
    return row + [float(c in cue) for c in _CUES]


#: Runs of groups of digits in which numbers may stand side by side, and the digits of one number.
_RUNS = (
    ("PHONE", re.compile(r"(?<!\w)[+(]?\d(?:[ \t().\-/]{0,3}\d)*(?!\w)"), 7, 17),
    ("CARD", re.compile(r"(?<!\w)\d(?:[ -]?\d)*(?!\w)"), 13, 19),
)


_INSIDE = re.compile("[a-z][A-Z]")


def candidates(text: str) -> list[tuple[int, int, str]]:
    out = set()
    for kind, rule in _GENERATORS:
        for m in rule.finditer(text):
            a, b = m.span(m.lastindex or 0)
            if kind == "SECRET" and not m.lastindex and not any("0" <= c <= "9" for c in m[0]) and not _INSIDE.search(m[0]):
                continue  # a long word
            out.add((a, b, kind))
            # marks at either end may be its text's
            x, y = a, b
            while kind == "EMAIL" and x < y and text[x] in "'.%+-":
                x += 1
            while kind in ("SECRET", "EMAIL") and y > x and text[y - 1] in ".,;:!?)]}*|$-_'":
                y -= 1
            if y > x:
                out.add((x, y, kind))
    # a long number may be several numbers side by side
    for a, b, kind in list(out):
        if kind in ("PHONE", "CARD"):
            for m in re.finditer(r"\d+", text[a:b]):
                if m.end() - m.start() >= 7 and (m.start(), m.end()) != (0, b - a):
                    out.add((a + m.start(), a + m.end(), "CARD" if m.end() - m.start() >= 12 else "PHONE"))
    # and so may any groups of its digits
    for kind, rule, least, most in _RUNS:
        for run in rule.finditer(text):
            groups = [(run.start() + m.start(), run.start() + m.end()) for m in re.finditer(r"\d+", run.group())]
            for k, (a, _) in enumerate(groups):
                start = a - (a > run.start() and text[a - 1] in "+(")
                digits = 0
                for x, b in groups[k:]:
                    digits += b - x
                    if digits > most:
                        break
                    if digits >= least and not (text[b : b + 1] == "." and text[b + 1 : b + 2].isdigit()):  # not within a dotted number
                        out.add((start, b, kind))
    return sorted(out)


class Trees:
    """Gradient boosting of binary deviance with shallow trees over binned features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, shrink: float = SHRINK, least: float = 5.0):
        self.trees, self.depth, self.shrink, self.least = trees, depth, shrink, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        score, self.nodes = np.full(len(y), self.base), []
        width = 34
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            leaf = np.zeros(len(y), np.int64)
            splits = {}
            for level in range(self.depth):
                size = 1 << level
                best = np.full(size, 1e-9)
                where = np.full((size, 2), -1)
                for j in range(x.shape[1]):
                    cell = leaf * width + bins[:, j]
                    sg = np.bincount(cell, g, size * width).reshape(size, width).cumsum(1)
                    sh = np.bincount(cell, h, size * width).reshape(size, width).cumsum(1)
                    tg, th = sg[:, -1:], sh[:, -1:]
                    gain = sg**2 / (sh + 1) + (tg - sg) ** 2 / (th - sh + 1) - tg**2 / (th + 1)
                    gain[(sh < self.least / 20) | (th - sh < self.least / 20)] = -1
                    k = gain.argmax(1)
                    top = gain[np.arange(size), k]
                    better = top > best
                    best[better] = top[better]
                    where[better] = np.stack([np.full(size, j), k], 1)[better]
                splits[level] = where
                f, c = where[leaf, 0], where[leaf, 1]
                leaf = leaf * 2 + ((f >= 0) & (bins[np.arange(len(y)), np.maximum(f, 0)] > c))
            size = 1 << self.depth
            value = self.shrink * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + 1)
            self.nodes.append((splits, value))
            score += value[leaf]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        bins = np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)], 1)
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for splits, value in self.nodes:
            leaf = np.zeros(len(x), np.int64)
            for level in range(self.depth):
                f, c = splits[level][leaf, 0], splits[level][leaf, 1]
                leaf = leaf * 2 + ((f >= 0) & (bins[rows, np.maximum(f, 0)] > c))
            out += value[leaf]
        return out


def _fix_luhn(digits: str, right: bool) -> str:
    for c in "0123456789":
        if _luhn(digits[:-1] + c) == right:
            return digits[:-1] + c
    raise AssertionError


_SYLLABLES = ("an", "der", "ti", "on", "le", "qui", "os", "ment", "sch", "ar", "the", "ing", "ou", "es", "ra")


def _word(r: random.Random) -> str:
    return "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4)))


def _thing(r: random.Random) -> tuple[str, str, str | None]:
    """A cue, a thing, and its kind, or None for a look-alike."""
    word = lambda: _word(r)
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    cue, kind = "", None
    pick = r.randrange(30)
    if pick in (0, 1):
        local = r.choice([word(), f"{word()}.{num(2)}", f"{word()}_{word()}", f"{word()}+{word()}", word() + num(3), r.choice("äéøñ") + word(), word() + r.choice(["üll", "é", "ß", "ø"]) + word()])
        thing, kind = f"{local}@{word()}{r.choice(['', '', num(1), 'ä' + word(), '-' + word()])}.{r.choice(['example.com', 'com', 'org', 'co.uk', 'de', 'net', 'fr', word() + '.com'])}", "EMAIL"
        cue = r.choice(["", "", "mail ", "contact: ", "<", "'", '"', "mailto="])
    elif pick in (2, 3):
        a, b, c = num(3), num(3), num(4)
        thing = r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+{num(2)} {num(2)} {num(2)} {num(2)} {num(2)} {num(2)}", f"+{num(11)}", f"+{r.randint(1, 9)}-{a}-{b}-{c}", f"0{num(2)}/{num(7)}"])
        kind, cue = "PHONE", r.choice(["", "", "tel ", "phone: ", "call "])
    elif pick in (4, 5, 6):
        n = r.choice([16, 16, 16, 15, 13, 19])
        d = _fix_luhn(r.choice("34562") * (r.random() < 0.7) + num(n), True)[-n:]
        d = _fix_luhn(d, True)
        thing, kind = (r.choice([d, d, d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4))]) if n == 16 else d), "CARD"
        cue = r.choice(["", "", "", "card ", "visa: "])
    elif pick in (7, 8, 9):
        n = r.choice([16, 16, 16, 15, 13, 14])
        d = _fix_luhn(num(n), False)
        thing = r.choice([d, d, d, " ".join(d[k : k + 4] for k in range(0, 16, 4))]) if n == 16 else d
        cue = r.choice(["", "", "", "order ", "id ", "no. ", "part "])
    elif pick in (10, 11):
        thing, kind = ".".join(str(r.randint(1 if k == 0 else 0, 255)) for k in range(4)), "IP"
        cue = r.choice(["", "", "", "host ", "ip: ", "server "])
    elif pick == 12:
        part = lambda n: ":".join("%x" % r.randint(0, 65535) for _ in range(n))
        thing, kind = r.choice([part(8), part(8), f"fe80::{part(r.randint(1, 4))}", f"2001:db8::{part(r.randint(1, 3))}", f"{part(r.randint(1, 4))}::{part(r.randint(1, 3))}", f"{part(r.randint(2, 4))}::"]), "IP"
        cue = r.choice(["", "", "host ", "ip: "])
    elif pick == 13:
        thing = r.choice([".".join(str(r.randint(256, 999)) for _ in range(4)), f"{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}.{num(4)}", ".".join(str(r.randint(0, 12)) for _ in range(5)), f"{r.randint(300, 999)}.{r.randint(0, 255)}.{num(3)}.{num(3)}"])
        cue = r.choice(["", "version ", "section "])
    elif pick in (14, 15, 16):
        thing = r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 40, 64]))), r.choice(["sk-", "ghp_", "AKIA", ""]) + "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(r.randint(20, 48)))])
        kind, cue = "SECRET", r.choice(['token = "', 'token: ', "key=", 'api_key = "', "secret: ", "password = '", "Bearer ", 'token = "'])
    elif pick in (24, 25, 26):
        kind, letters, capitals = "SECRET", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        some = lambda which, n: "".join(r.choice(which) for _ in range(n))
        thing = r.choice([
            r.choice(["AKIA", "ASIA"]) + some(capitals + "234567", 16), r.choice(["xoxb-", "glpat-", "sk_live_", "rk_", "pk_test_", "ghp_", "hf_"]) + some(letters + capitals + "0123456789", r.randint(20, 36)), some(letters + capitals, r.randint(16, 40)), f"xoxb-{num(r.randint(10, 13))}-{some(letters + capitals + '0123456789', r.randint(12, 24))}", some(letters + capitals + "0123456789+/", r.choice([24, 32, 44])) + r.choice(["", "=", "=="]), some(letters + capitals + "0123456789+/", r.choice([22, 43])) + "=",
            word() + num(r.randint(1, 4)) + r.choice(["", word()]), word().capitalize() + num(2) + r.choice("!$#@%"), some(letters + capitals + "0123456789!$#@%&*", r.randint(8, 15)),
        ])
        if len(thing) < 6:
            thing += num(6 - len(thing) + 2)
        prefixed = thing.startswith(("AKIA", "ASIA", "xoxb-", "glpat-", "sk_live_", "pk_test_", "ghp_"))
        cue = r.choice(["", "key "]) if prefixed and r.random() < 0.5 else r.choice(["password: ", "password=", "passwd = '", "pwd=", "api_key = '", 'secret = "', "secret_key: ", "token=", "auth_token: ", 'client_secret="', "DB_PASSWORD=", "passphrase: "])
    elif pick == 27:  # what stands after such words and is no secret
        thing = r.choice([word(), f"{word()}-{word()}", f"{word()}_{word()}", "required", "changed", "<none>", f"{word()}()", f"{word()}.{word()}", word().capitalize(), f"os.{word()}", "${" + word().upper() + "}"])
        cue = r.choice(["password: ", "key: ", "token: ", "secret: ", "auth: ", "key = ", "keyword: ", "password=", "passwd: "])
    elif pick == 28:
        thing = r.choice([word() + word().capitalize() + word().capitalize() + word().capitalize(), f"{word()}/{word()}/{word().capitalize()}{word().capitalize()}", f"{word().capitalize()}{word()}-{word().capitalize()}{word()}", word() + word() + word() + word()])
    elif pick == 29:
        thing = r.choice([f"{num(1)}::{num(1)}", f"{word()}::{word()}", "::".join(word() for _ in range(3)), f"{num(2)}:{num(2)}", f"{word()}: {word()}", f"a:b:{num(1)}", f"{word()}={word()}", f"https://{word()}.org/{word()}", f"16:9", f"{num(1)}:{num(2)}:{num(2)}"])
    elif pick == 17:
        thing = r.choice([f"{word()}-{word()}-{num(4)}-{word()}-{word()}", f"{word()}/{word()}/{num(2)}/{word()}-{word()}", f"{word()}_{word()}_{word()}{num(1)}_{word()}", f"{num(4)}-{num(2)}-{num(2)}T{num(2)}", "=" * r.randint(16, 40), "-" * r.randint(16, 40) + num(1)])
    elif pick == 18:
        country, rest = r.choice(["DE", "FR", "ES", "GB"]), num(18)
        check = 98 - int("".join(str(int(c, 36)) for c in rest + country + "00")) % 97
        thing = f"{country}{check:02d}{rest}"
        if r.random() < 0.5:
            thing = " ".join(thing[k : k + 4] for k in range(0, len(thing), 4))
        kind, cue = "ACCOUNT", r.choice(["", "IBAN ", "account "])
    elif pick == 19:
        thing = r.choice(["DE", "FR", "ES", "XY"]) + num(20)
        kind = "ACCOUNT" if _mod97(thing) else None
        cue = r.choice(["", "ref "])
    elif pick == 20:
        thing, kind, cue = f"{num(3)}-{num(2)}-{num(4)}", "ACCOUNT", r.choice(["ssn ", "SSN: ", "social security "])
    else:
        thing = r.choice([f"{num(4)}-{num(2)}-{num(2)} {num(2)}:{num(2)}:{num(2)}", f"{r.randint(1, 9)},{num(3)},{num(3)}", f"{num(1)}.{num(8)}", f"{num(4)} {num(4)}", num(8), num(10), f"{num(3)} {num(2)} {num(3)}", f"978-{num(1)}-{num(4)}-{num(4)}-{num(1)}", f"{num(2)}.{num(2)}.{num(4)} {num(2)}", f"1990-{num(4)}", f"{num(7)}", f"{word()}@{word()}", f"@{word()}", f"{num(2)}:{num(2)}:{num(2)}"])
        cue = r.choice(["", "", "isbn ", "page ", "version ", "$", "order no. "])
    return cue, thing, kind


def _made(r: random.Random) -> tuple[str, set[tuple[int, int, str]]]:
    """A text with one to three things in it, often side by side; where those are that are no look-alikes."""
    words = lambda n: " ".join(_word(r) for _ in range(r.randint(0, n)))
    text, real = words(6), set()
    for k in range(r.choice([1, 1, 1, 2, 2, 3])):
        cue, thing, kind = _thing(r)
        if k and r.random() < 0.6 and not (kind == "SECRET" and len(thing) < 16):  # nothing else tells a short one
            cue = ""
        if text:
            text += r.choice([" ", " ", "\n", ", "])
        if r.random() < 0.1:
            text, cue = text.upper(), cue.upper()
            if kind == "SECRET" and r.random() < 0.5:
                thing = thing.upper()
        text += cue
        if kind:
            real.add((len(text), len(text) + len(thing), kind))
        text += thing + (cue[-1] if cue[-1:] in ("'", '"') else r.choice(["", "", "", ".", ",", "***", "$$$", "!!", " |"]))
        if r.random() < 0.4:
            text += " " + words(4)
    return text + " " + words(4), real


class Detector:
    def __init__(self, trees: Trees, slope: float, offset: float, threshold: dict[str, float]):
        self.trees, self.slope, self.offset, self.threshold = trees, slope, offset, threshold

    def probability(self, rows: list[list[float]]) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.trees.score(np.array(rows, np.float64)) + self.offset)))

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Redactions of each text, in order, none overlapping."""
        out: list[list] = [[] for _ in texts]
        rows, of = [], []
        for d, window in _windows(texts):
            base, text = window
            for a, b, kind in candidates(text):
                rows.append(features(text, a, b, kind))
                of.append((d, base + a, base + b, kind))
        if not rows:
            return out
        p = self.probability(rows)
        best: dict[int, list] = {}
        for (d, a, b, kind), q in zip(of, p.tolist()):
            if q >= self.threshold[kind]:
                best.setdefault(d, []).append((-round(q, 6), a - b, a, b, kind))
        for d, some in best.items():
            taken: list = []
            for _, _, a, b, kind in sorted(some):
                if all(b <= x or a >= y for x, y, _ in taken):
                    taken.append((a, b, kind))
            out[d] = sorted(taken)
        return out


def _windows(texts: list[str], reach: int = 100) -> Iterator[tuple[int, tuple[int, str]]]:
    """(text, (offset, window)): all that lies near a digit, @, =, : or a capital inside a word, cut at white space only."""
    cp, base = codepoints(texts)
    small, large = (cp >= 97) & (cp <= 122), (cp >= 65) & (cp <= 90)
    hot = ((cp >= 48) & (cp <= 57)) | (cp == 64) | (cp == 61) | (cp == 58)
    hot[1:] |= small[:-1] & large[1:]
    hot = np.flatnonzero(hot)
    if not len(hot):
        return
    doc = np.searchsorted(base, hot, "right") - 1
    new = np.append(True, (hot[1:] - hot[:-1] > 2 * reach) | (doc[1:] != doc[:-1]))
    cuts = np.flatnonzero(new)
    last = np.append(cuts[1:], len(hot)) - 1
    where: dict[int, list] = {}
    for k, z in zip(cuts.tolist(), last.tolist()):
        d = int(doc[k])
        text = texts[d]
        a, b = int(hot[k] - base[d]), int(hot[z] - base[d]) + 1
        a, b = max(0, a - reach), min(len(text), b + reach)
        while a > 0 and text[a - 1] not in _SPACE:
            a -= 1
        while b < len(text) and text[b] not in _SPACE:
            b += 1
        some = where.setdefault(d, [])
        if some and a <= some[-1][1]:
            some[-1][1] = max(b, some[-1][1])
        else:
            some.append([a, b])
    for d, spans in where.items():
        for a, b in spans:
            yield d, (a, texts[d][a:b])


def _sample(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    r = random.Random(seed)
    x, y, kinds = [], [], []
    while len(x) < n:
        text, real = _made(r)
        for a, b, kind in candidates(text):
            x.append(features(text, a, b, kind))
            y.append(float((a, b, kind) in real))
            kinds.append(kind)
    return np.array(x), np.array(y), kinds


@lru_cache(maxsize=1)
def trained() -> Detector:
    """Trees, Platt's calibration and thresholds; the same each time."""
    x, y, _ = _sample(TRAINING // 2, 1)
    trees = Trees().fit(x, y)
    x, y, kinds = _sample(TRAINING // 2, 2)
    s = trees.score(x)
    slope, offset = 1.0, 0.0
    for _ in range(60):  # Newton steps on the calibration sample
        p = 1 / (1 + np.exp(-(slope * s + offset)))
        w = p * (1 - p) + 1e-9
        g = np.array([((y - p) * s).sum() - 1e-3 * slope, (y - p).sum()])
        h = np.array([[(w * s * s).sum() + 1e-3, (w * s).sum()], [(w * s).sum(), w.sum()]])
        slope, offset = np.array([slope, offset]) + np.linalg.solve(h, g)
    p = 1 / (1 + np.exp(-(slope * s + offset)))
    threshold = {}
    kinds_ = np.array(kinds)
    for k in KINDS:
        q, t = p[kinds_ == k], y[kinds_ == k]
        order = np.argsort(-q, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(q) + 1)
        good = np.flatnonzero(right >= PRECISION)
        # the lowest probability at which what lies above it is as precise as wanted; never under an even chance
        threshold[k] = max(0.5, float(q[order[good[-1]]])) if len(good) else 1.1
    return Detector(trees, float(slope), float(offset), threshold)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType()), T.StructField("kind", T.StringType())]))
_PA = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("kind", pa.string())]))


def find(text: Column, detector) -> Column:
    """Redactions of a text; null where there are none. detector: a broadcast of one."""

    def make(texts: pa.Array) -> pa.Array:
        rows: list = []
        for _, some in bounded(range(len(texts)), lazily(texts), _BLOCK):
            rows += [[{"start": a, "stop": b, "kind": k} for a, b, k in spans] or None for spans in detector.value.spans(some)]
        return pa.array(rows, _PA)

    return F.arrow_udf(make, _SPANS).asNondeterministic()(text)


def masked(text: Column, spans: Column) -> Column:
    """text with [KIND] in the place of each span."""
    n = F.size(spans)
    stop = lambda k: F.when(k == 0, 0).otherwise(F.get(spans, k - 1)["stop"])
    part = lambda k: F.concat(F.substr(text, (stop(k) + 1).cast("int"), (F.coalesce(F.get(spans, k)["start"], F.length(text)) - stop(k)).cast("int")), F.coalesce(F.concat(F.lit("["), F.get(spans, k)["kind"], F.lit("]")), F.lit("")))
    return F.when(spans.isNull(), text).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n), part), ""))


@kept_names
def detect(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """docs with one more column, the redactions."""
    detector = docs.sparkSession.sparkContext.broadcast(trained())
    return docs.select(*own(docs, into), find(F.col(quoted(text)), detector).alias(into))


@kept_names
def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the redactions made; their own columns."""
    name = fresh(docs, "pii")
    return detect(docs, text, name).withColumn(text, masked(F.col(quoted(text)), F.col(name))).select(*own(docs))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = detect(docs).where("pii is not null")
    return got.select("doc_id", F.expr("transform(pii, x -> struct(x.start, x.stop, x.kind, substr(text, int(x.start + 1), int(x.stop - x.start)) AS found))").alias("spans"), masked(F.col("text"), F.col("pii")).alias("redacted"))
