"""Personal data: patterns with checks, and a linear-chain conditional random field over word shapes that adds to them.

The field is trained on the driver from a small labelled table (:func:`examples`, or one's own) and decoded in tasks by
Viterbi over many lines at once.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import whole_text

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
#: Labels: nothing, then begin and inside of each kind.
LABELS = 1 + 2 * len(KINDS)
#: Lines of a labelled table that a fit reads at most.
LINES = 5000
#: Tokens that are decoded at once; a longer line is decoded by itself.
AT_ONCE = 1 << 20
WINDOW = (-3, -2, -1, 0, 1, 2, 3)
SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"

# ---- patterns ----------------------------------------------------------------------------------------------------

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number that goes on from a digit before it would start there, so looking from its first digit only is the same.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(d - 9 if d > 9 else d for d in twice) + sum(map(int, digits[::-2]))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, found from their @: a local part is all of its characters before it back to the last match."""
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        end = DOMAIN.match(text, at + 1) if at > free and text[at - 1] in LOCAL else None
        if end:
            while start > free and text[start - 1] in LOCAL:
                start -= 1
            yield start, end.end()
            free = end.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the patterns find and the checks let pass, in order; places count code points."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = "".join(DIGITS.findall(m.group()))
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(DIGITS.findall(m.group())) <= 15]
    return sorted(out)


# ---- shapes ------------------------------------------------------------------------------------------------------

#: A token is a run of letters, a run of digits or one other character, with the space before it: tokens make up the text.
TOKEN = re.compile(r"\s*(?:[^\W\d_]+|[0-9]+|\S)|\s+")
# Words that stand for a sign or announce a kind.
CUES = {
    "at": "at", "arroba": "at", "dot": "dot", "punto": "dot", "punkt": "dot", "point": "dot", "com": "top", "org": "top", "net": "top", "edu": "top", "de": "top", "fr": "top", "es": "top", "io": "top", "uk": "top",
    "mail": "mail", "email": "mail", "correo": "mail", "courriel": "mail", "adresse": "mail", "phone": "tel", "tel": "tel", "call": "tel", "mobile": "tel", "fax": "tel", "telefon": "tel", "handy": "tel", "ruf": "tel",
    "llame": "tel", "appelez": "tel", "whatsapp": "tel", "cell": "tel", "card": "card", "visa": "card", "mastercard": "card", "karte": "card", "tarjeta": "card", "carte": "card", "ip": "ip", "server": "ip", "host": "ip", "ping": "ip",
}


def shape(token: str) -> tuple[str, str, str]:
    """What a token is known by: the space before it, its shape, its cue."""
    word = token.lstrip()
    gap = "" if len(word) == len(token) else " "
    if word.islower():
        return gap, "x" if len(word) > 1 else "x1", CUES.get(word, "") if len(word) <= 10 else ""
    if not word:
        return gap, "", ""
    if word[0] in "0123456789":
        n = len(word)
        return gap, f"d{n if n <= 4 else 5 if n <= 9 else 10 if n <= 13 else 14 if n <= 19 else 20}", ""
    if not word[0].isalpha():
        return gap, word if word.isascii() else "?", ""
    kind = "X" if word.isupper() else "Xx" if word[0].isupper() and word[1:].islower() else "xX"
    return gap, kind if len(word) > 1 else "X1", CUES.get(word.lower(), "") if len(word) <= 10 else ""


class Shapes:
    """Class numbers of tokens, by what they are known by; class 0 is the edge of a line."""

    MOST = 1 << 17

    def __init__(self) -> None:
        self.numbers = {("", "<", ""): 0}
        #: The three features of each class: its shape with the space before it, its shape alone, its cue.
        self.features: list[tuple[str, str, str]] = [("<", "<", "")]
        self.known: dict[str, int] = {}

    def of(self, token: str) -> int:
        got = self.known.get(token)
        if got is None:
            f = shape(token)
            got = self.numbers.get(f)
            if got is None:
                got = self.numbers[f] = len(self.features)
                self.features.append((f[0] + f[1], f[1], f[2]))
            if len(token) <= 32:
                # The memory only saves time.
                if len(self.known) >= self.MOST:
                    self.known.clear()
                self.known[token] = got
        return got


def lines(texts: Iterable[str], shapes: Shapes) -> tuple[np.ndarray, np.ndarray, list[int], list[list[str]]]:
    """(class of every token, first token of every line, first line of every text and their end, tokens of every text)."""
    classes: list[int] = []
    starts: list[int] = []
    first, tokens = [], []
    for text in texts:
        own = TOKEN.findall(text)
        first.append(len(starts))
        tokens.append(own)
        if own:
            at = len(classes)
            starts.append(at)
            if "\n" in text:
                starts.extend(at + i for i, t in enumerate(own) if i and "\n" in t)
            known = shapes.known.get
            classes.extend([c if (c := known(t)) is not None else shapes.of(t) for t in own])
    return np.array(classes, dtype=np.int32), np.array(starts, dtype=np.int64), [*first, len(starts)], tokens


def neighbours(classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The classes at WINDOW around every token; beyond its line class 0."""
    n = len(classes)
    line = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    out = np.zeros((len(WINDOW), n), dtype=np.int32)
    for k, o in enumerate(WINDOW):
        lo, hi = max(0, -o), min(n, n - o)
        if lo < hi:
            same = line[lo:hi] == line[lo + o : hi + o]
            out[k, lo:hi] = np.where(same, classes[lo + o : hi + o], 0)
    return out


# ---- the field ---------------------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights: (place in WINDOW, feature, label), the features' numbers, and (label, label) for steps; first for starts."""

    features: dict[tuple[int, str], int]
    weights: np.ndarray
    steps: np.ndarray
    first: np.ndarray

    def table(self, shapes: Shapes, have: np.ndarray | None = None) -> np.ndarray:
        """(place, class, label): the sum of the weights of each class's features; grown as classes come up."""
        old = 0 if have is None else have.shape[1]
        new = [sum((self.weights[:, self.features[key]] for key in enumerate(f) if key in self.features), np.zeros((len(WINDOW), LABELS))) for f in shapes.features[old:]]
        rows = np.stack(new, axis=1) if new else np.zeros((len(WINDOW), 0, LABELS))
        return rows if have is None else np.concatenate([have, rows], axis=1)

    def emissions(self, near: np.ndarray, table: np.ndarray) -> np.ndarray:
        out = table[0][near[0]]
        for k in range(1, len(WINDOW)):
            out += table[k][near[k]]
        return out


def allowed() -> np.ndarray:
    """Steps between labels that can be: inside a kind only after its begin or inside."""
    ok = np.ones((LABELS, LABELS), dtype=bool)
    for inside in range(2, LABELS, 2):
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


NEVER = -1e9


def _by_time(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Lines by falling length: their starts and lengths, and how many of them have a token at each time."""
    size = np.diff(np.append(starts, n))
    order = np.argsort(-size, kind="stable")
    size = size[order]
    alive = (len(size) - np.searchsorted(size[::-1], np.arange(1, (size[0] if len(size) else 0) + 1), side="left")).tolist()
    return starts[order], size, alive


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis=axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis=axis, keepdims=True))).squeeze(axis)


def gradient(emit: np.ndarray, steps: np.ndarray, first: np.ndarray, labels: np.ndarray, starts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of ``labels`` and its derivatives by emissions, steps and starts, by forward and backward sums."""
    n = len(emit)
    at, size, alive = _by_time(starts, n)
    fore, back = np.zeros((n, LABELS)), np.zeros((n, LABELS))
    for t, k in enumerate(alive):
        i = at[:k] + t
        fore[i] = emit[i] + (first if t == 0 else _logsum(fore[i - 1][:, :, None] + steps, 1))
    for t in range(len(alive) - 1, 0, -1):
        i = at[: alive[t]] + t
        back[i - 1] = _logsum(steps + (emit[i] + back[i])[:, None, :], 2)
    total = _logsum(fore[at + size - 1], 1)
    whole = np.empty(n)
    for t, k in enumerate(alive):
        whole[at[:k] + t] = total[:k]
    p = np.exp(fore + back - whole[:, None])
    inner = np.ones(n, dtype=bool)
    inner[starts] = False
    i = np.flatnonzero(inner)
    pair = np.exp(fore[i - 1][:, :, None] + steps + (emit[i] + back[i])[:, None, :] - whole[i][:, None, None]).sum(axis=0)
    hit = np.eye(LABELS)[labels]
    seen = np.zeros((LABELS, LABELS))
    np.add.at(seen, (labels[i - 1], labels[i]), 1)
    gold = emit[np.arange(n), labels].sum() + first[labels[starts]].sum() + steps[labels[i - 1], labels[i]].sum()
    return float(gold - total.sum()), hit - p, seen - pair, (hit - p)[starts].sum(axis=0)


def train(rows: Iterable[tuple[str, list[tuple[int, int, str]]]], rounds: int = 100, decay: float = 0.02) -> Field:
    """The field of labelled lines (text, [(start, end, kind)]), by ``rounds`` of gradient ascent with step sizes of their own."""
    rows = list(rows)
    shapes = Shapes()
    classes, starts, _, tokens = lines([t for t, _ in rows], shapes)
    labels = np.zeros(len(classes), dtype=np.int64)
    n = 0
    for (_, spans), own in zip(rows, tokens, strict=True):
        ends = np.cumsum([0, *map(len, own)])
        begins = ends[:-1] + [len(t) - len(t.lstrip()) for t in own]
        for s, e, kind in spans:
            inside = np.flatnonzero((begins >= s) & (ends[1:] <= e)) + n
            labels[inside] = 2 + 2 * KINDS.index(kind)
            labels[inside[:1]] -= 1
        n += len(own)
    names = sorted({key for f in shapes.features for key in enumerate(f)})
    field = Field({key: i for i, key in enumerate(names)}, np.zeros((len(WINDOW), len(names), LABELS)), np.where(allowed(), 0.0, NEVER), np.where(allowed()[0], 0.0, NEVER))
    near = neighbours(classes, starts)
    has = np.zeros((len(shapes.features), len(names)))
    for c, f in enumerate(shapes.features):
        for key in enumerate(f):
            has[c, field.features[key]] = 1
    parts = [field.weights, field.steps, field.first]
    m, v = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for r in range(1, rounds + 1):
        _, d_emit, d_steps, d_first = gradient(field.emissions(near, field.table(shapes)), field.steps, field.first, labels, starts)
        by_class = np.stack([np.stack([np.bincount(c, weights=d, minlength=len(shapes.features)) for d in d_emit.T], axis=1) for c in near])
        slopes = [np.einsum("cf,kcl->kfl", has, by_class) - decay * field.weights, np.where(allowed(), d_steps - decay * field.steps, 0), np.where(allowed()[0], d_first - decay * field.first, 0)]
        for p, g, a, b in zip(parts, slopes, m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += 0.1 * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-8)
    return field


def viterbi(emit: np.ndarray, steps: np.ndarray, starts: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The best labels of every sequence, all of them one token at a time; of equal paths the smaller labels.

    ``before`` and ``after`` are the sequences' scores of a first and of a last label.
    """
    n = len(emit)
    at, size, alive = _by_time(starts, n)
    order = np.argsort(-np.diff(np.append(starts, n)), kind="stable")
    before, after = before[order], after[order]
    came = np.zeros((n, LABELS), dtype=np.int8)
    best = np.zeros((len(at), LABELS))
    for t, k in enumerate(alive):
        i = at[:k] + t
        if t == 0:
            best[:k] = emit[i] + before
        else:
            through = best[:k, :, None] + steps
            came[i] = through.argmax(axis=1)
            best[:k] = emit[i] + through.max(axis=1)
    out = np.zeros(n, dtype=np.int8)
    # Sequences that end earlier kept their last scores.
    out[at + size - 1] = (best + after).argmax(axis=1)
    for t in range(len(alive) - 1, 0, -1):
        i = at[: alive[t]] + t
        out[i - 1] = came[i, out[i]]
    return out


def decode(field: Field, classes: np.ndarray, starts: np.ndarray, table: np.ndarray, whole: bool = False) -> np.ndarray:
    """The labels of all tokens; ``whole`` runs over whole lines, else over what is left of them.

    A token gains at most what its emission adds over that of nothing, plus the best step into its label and the best step
    back. Where no stretch of tokens around it has a sum of gains above zero, nothing is its best label whatever the others
    are; a stretch between such tokens stands for itself.
    """
    n = len(classes)
    labels = np.zeros(n, dtype=np.int8)
    if not n:
        return labels
    emit = field.emissions(neighbours(classes, starts), table.astype(np.float64 if whole else np.float32))
    if whole:
        return viterbi(emit, field.steps, starts, np.tile(field.first, (len(starts), 1)), np.zeros((len(starts), LABELS)))
    rest = field.steps[0, 0]
    # At a line's ends there is one step less, which the step from nothing to nothing has to outweigh.
    slack = max(0.0, float(rest), float(-rest)) + 1e-3
    into = np.maximum(field.steps.max(axis=0) - rest, field.first - field.first[0])[1:].astype(np.float32)
    back = max(0.0, float(field.steps[1:, 0].max() - rest))
    gain = (emit[:, 1:] + into).max(axis=1) - emit[:, 0] + np.float32(back + slack)
    gain = np.maximum(gain, -50.0).astype(np.float64)
    # The largest sum of gains of a stretch through each token, by running extremes of the sums from its line's start on.
    size = np.diff(np.append(starts, n))
    sums = np.cumsum(gain)
    until = sums - np.repeat(sums[starts] - gain[starts], size)
    line = np.repeat(np.arange(len(starts)) * ((50.0 + max(0.0, float(gain.max()))) * int(size.max()) + 1), size)
    lowest = np.minimum.accumulate(until - gain - line) + line
    highest = np.maximum.accumulate((until - line)[::-1])[::-1] + line
    open_ = highest - lowest > -1e-2 - 8 * np.spacing(line[-1])
    edge = np.zeros(n + 1, dtype=bool)
    edge[starts] = True
    edge[n] = True
    # Stretches of open tokens, cut at line starts.
    begin = np.flatnonzero(open_ & (edge[:-1] | ~np.append(False, open_[:-1])))
    end = np.flatnonzero(open_ & (edge[1:] | ~np.append(open_[1:], False))) + 1
    if not len(begin):
        return labels
    size = end - begin
    own = np.cumsum(size) - size
    places = np.repeat(begin - own, size) + np.arange(size.sum())
    before = np.where(edge[begin][:, None], field.first, field.steps[0])
    after = np.where(edge[end][:, None], 0.0, field.steps[:, 0])
    labels[places] = viterbi(emit[places].astype(np.float64), field.steps, own, before, after)
    return labels


# ---- the labelled table --------------------------------------------------------------------------------------------

# Frames of the labelled lines, {} is the datum, and lines without any.
FRAMES = {
    "email": ["mail me: {}", "write to {} today", "Contact {} for details.", "correo {} gracias", "Schreib an {} bitte", "courriel {} merci", "{}", "her email is {} and more follows", "(see {})", "sent by {}, thanks"],
    "ip": ["host {} is down", "ping {}", "server at {} refused", "from {} to the gate", "the ip {} was seen", "{} answered", "Adresse {} gesperrt", "log: {} GET"],
    "card": ["card {} expires soon", "paid with visa {}", "Karte {} gesperrt", "tarjeta {} de oro", "{}", "the number {} was charged", "carte {} valable"],
    "phone": ["call {} now", "tel {}", "phone: {}", "Reach us at {} or write", "Telefon {} abends", "llame al {} hoy", "appelez {} demain", "{}", "fax {}, room 12", "my cell is {} ok"],
}
PLAIN = [
    "the meeting is at noon in room 12", "prices rose from 120 to 4500 in 2019", "version 10.2.3 of the tool", "pages 12-15 and 200-210", "order 123456789 was shipped", "on 2021-03-04 at 12:30:45 it ended", "we met at the station dot by dot",
    "the ratio was 3.14159 to 2.71828", "la casa de mi madre", "Der Punkt am Ende des Satzes.", "le point de vue", "chapter 3, section 4.5", "0.5 0.25 0.125 0.0625", "a | b | c | 12 | 345 | 6789", "# 1 2 3 4 5", "isbn 978-3-16-148410-0", "He was born in 1984.",
    "score 3-2 after 90 minutes", "total 1,234,567.89 euros", "The quick brown fox", "x = y + 12 * z", "room 101 at the end", "look at this dot", "look at net gains", "the point of it, de facto", "id 9f8e7d6c5b4a", "10 20 30 40 50 60", "123 456", "555 - 777", "sum 1 + 2 + 3 = 6",
    "on 12.05.2020 and 13.05.2020", "1.2.3 and 4.5.6", "section 1.2.3.4.5.6", "2001 2002 2003 2004", "serial 4000 1234 9", "phone the office", "call me at home", "write the mail at once", "card game at ten", "the server is at rest", "100000 people", "98078157628044901234567",
    "and. Of it at the end. De facto, of those of the net", "Then at noon, in it. The es and the de are at work of. Com", "Licensed under the MIT License (c) 2020", "tel aviv at night", "dot matrix", "7 x 24 hours", "12345678901234", "page 1 of 20", "ñoño 12 ça 34 über 56", "the house, the garden. And then?", "\"quoted\" (in brackets) [1] {2}", "A B C D", "it's 5 o'clock",
]


def prose(k: int) -> str:
    """A line of word-like text: sentences with capitals and commas, here and there a cue, a number or a table's bars."""
    random = np.random.default_rng(k)
    syllables, cues = ["the", "an", "er", "ion", "st", "ou", "ei", "la", "qué", "über", "ment", "o"], [c for c in CUES if len(c) <= 5]
    words = []
    for i in range(int(random.integers(4, 40))):
        kind = random.random()
        w = "".join(random.choice(syllables, int(random.integers(1, 5))))
        w = str(random.integers(0, 10 ** int(random.integers(1, 8)))) if kind < 0.04 else str(random.choice(cues)) if kind < 0.1 else "|" if kind < 0.12 else w.upper() if kind < 0.14 else w
        words.append((w.capitalize() if i == 0 or random.random() < 0.15 else w) + str(random.choice(["", "", "", "", "", "", ",", ".", "!", "?"])))
    return " ".join(words)


def examples(each: int = 4, plain: int = 200) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The labelled lines: every frame with ``each`` data made by rule in the ways people write them, and lines without data,
    ``plain`` of them made by rule.
    """
    names, hosts, tops = ["jane", "bob", "Li", "marie", "k", "Otto"], ["example", "mail", "acme", "uni", "Host"], ["com", "org", "net", "de", "fr", "es", "io"]
    digits = lambda k, n: str((k * 7919 + 104729) * 48271 % 10**n).zfill(n)

    def datum(kind: str, k: int) -> str:
        a, h, t = names[k % len(names)], hosts[k % len(hosts)], tops[k % len(tops)]
        d = digits(k, 16)
        o = [str((k * m + m) % 256) for m in (37, 11, 71, 53)]
        ways = {
            "email": [f"{a} at {h} dot {t}", f"{a}(at){h}.{t}", f"{a} [at] {h} [dot] {t}", f"{a}@{h}.{t}", f"{a}.{h} AT {h} DOT {t}", f"{a} (at) {h} (dot) {t}", f"{a}{k}@{h}{k}.{t}.{t}", f"{a} arroba {h} punto {t}"],
            "ip": [".".join(o), "[.]".join(o), " dot ".join(o), "(.)".join(o)],
            "card": [f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", f"{d[:4]}-{d[4:8]}-{d[8:12]}-{d[12:]}", f"{d[:4]}.{d[4:8]}.{d[8:12]}.{d[12:]}", d, f"{d[:4]}/{d[4:8]}/{d[8:12]}/{d[12:]}"],
            "phone": [f"{d[:3]}-{d[3:6]}-{d[6:10]}", f"({d[:3]}) {d[3:6]}-{d[6:10]}", f"{d[:3]} {d[3:6]} {d[6:10]}", f"+{1 + k % 9} {d[:3]} {d[3:6]} {d[6:10]}", f"{d[:3]}.{d[3:6]}.{d[6:10]}", f"+{1 + k % 9} ({d[:3]}) {d[3:6]}-{d[6:10]}", f"0{d[:3]}/{d[3:9]}", f"1-{d[:3]}-{d[3:6]}-{d[6:10]}"],
        }[kind]
        return ways[k % len(ways)]

    out: list[tuple[str, list[tuple[int, int, str]]]] = [(p, []) for p in PLAIN] + [(prose(k), []) for k in range(plain)]
    k = 0
    for kind, frames in FRAMES.items():
        for f in frames:
            for _ in range(each):
                x, s = datum(kind, k), f.index("{}")
                out.append((f.replace("{}", x), [(s, s + len(x), kind)]))
                k += 1
    return out


def labelled(rows: DataFrame, text: str = "text", spans: str = "spans") -> list[tuple[str, list[tuple[int, int, str]]]]:
    """One's own labelled table (text, spans: array of (start, end, kind)) for :func:`train`: at most LINES of its rows, by hash."""
    some = rows.where(F.col(text).isNotNull()).orderBy(F.xxhash64(text)).limit(LINES).select(text, spans).collect()
    return [(r[0], [(int(s[0]), int(s[1]), s[2]) for s in r[1] or []]) for r in some]


# ---- documents -----------------------------------------------------------------------------------------------------


#: An address written out: a sign or its word, then labels parted by dots or their word; the words alone only with each other.
SIGNS = re.compile(r"[A-Za-z0-9._%+-]+(?:(?P<at> (?:at|arroba) )| ?[(\[] ?(?:at|arroba|@) ?[)\]] ?|@)[A-Za-z0-9-]+(?P<dots>(?: (?:dot|punto|punkt|point) | ?[(\[] ?(?:dot|punto|punkt|point|\.) ?[)\]] ?|\.)[A-Za-z0-9-]+)+", re.I)


def believable(kind: int, found: str) -> bool:
    """Whether a span that the field marks can be what it says: its digits are as many as the kind has, an address is whole."""
    digits = "".join(DIGITS.findall(found))
    if kind == 0:
        m = SIGNS.fullmatch(found)
        return bool(m) and CUES.get(re.split("[^A-Za-z]+", found)[-1].lower()) == "top" and not (m["at"] and m["dots"].startswith("."))
    if kind == 1:
        parts = re.findall("[0-9]+", found)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def added(text: str, tokens: list[str], labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the labelled stretches that can be what they say and touch no span of ``base``."""
    ends = np.cumsum([0, *map(len, tokens)])
    out = []
    for i in np.flatnonzero(labels % 2 == 1):
        j, kind = i + 1, int(labels[i]) // 2
        while j < len(labels) and labels[j] == labels[i] + 1:
            j += 1
        start, end = int(ends[i] + len(tokens[i]) - len(tokens[i].lstrip())), int(ends[j])
        if believable(kind, text[start:end]) and not any(s < end and start < e for s, _, e in base):
            out.append((start, kind, end))
    return out


def personal_data(docs: DataFrame, field: Field | None = None, doc_id: str = "doc_id", text: str | Column = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, spans (kind, start, end, base), by start and then kind as KINDS has them.

    ``base`` is true for what the patterns find, false for what the field adds; what it adds overlaps no base span. Places are
    code points from 0, the end is exclusive. Null and empty texts have no spans; a text of any length is read whole, and a
    line is one sequence of the field. Repeated rows and null ids are kept, an empty table gives no rows, other columns are not
    read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or train(examples()))
    kinds = np.array(KINDS)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, shapes = shared.value, Shapes()
        table = crf.table(shapes)
        schema = pa.schema([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])

        def spans_of(texts: list[str]) -> Iterator[list[tuple[int, int, int, bool]]]:
            nonlocal table
            classes, starts, first, tokens = lines(texts, shapes)
            table = crf.table(shapes, table)
            labels = decode(crf, classes, starts, table)
            at = 0
            for t, own in zip(texts, tokens, strict=True):
                base, mine = base_spans(t), labels[at : at + len(own)]
                at += len(own)
                more = added(t, own, mine, base) if mine.any() else []
                yield sorted([(*s, True) for s in base] + [(*s, False) for s in more])

        for batch in batches:
            texts = batch.column("text").to_pylist()
            found: list[list[tuple[int, int, int, bool]]] = []
            i = 0
            while i < len(texts):
                j, size = i + 1, len(texts[i])
                while j < len(texts) and size + len(texts[j]) <= 4 * AT_ONCE:
                    size += len(texts[j])
                    j += 1
                found.extend(spans_of(texts[i:j]))
                i = j
            flat = [s for f in found for s in f]
            cols = [pa.array(kinds[[s[1] for s in flat]].tolist() if flat else [], pa.string()), pa.array([s[0] for s in flat], pa.int64()), pa.array([s[2] for s in flat], pa.int64()), pa.array([s[3] for s in flat], pa.bool_())]
            offsets = np.cumsum([0, *map(len, found)])
            spans = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(cols, fields=list(schema)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), spans], names=["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    return rows.mapInArrow(scan, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")
