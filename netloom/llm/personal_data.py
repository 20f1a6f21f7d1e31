"""Personal data by patterns and by a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field sees each word as a few shape features, with those of its
neighbours, and labels words as the first or a further word of an e-mail address, IP address, card or phone number
that no pattern describes ("ann at mail dot example dot org", "(030) 555-0199"); its labels alone decide what is added. It is
trained from a small labelled table and decoded by Viterbi, in numpy, for all words of a slice at once.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import coded_words, ship, text_column, text_slices

KINDS = ("email", "ip", "card", "phone")
#: A find's first word, its further words, and all other words.
LABELS = ("other", *(f"{mark}-{kind}" for kind in KINDS for mark in ("begin", "inside")))

# The base patterns. Each is anchored so that a run of its characters is tried once.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = "[0-9]|@"
TOKEN = re.compile(r"[^\x20\x09-\x0d]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, from each @ to both sides."""
    out, done = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        end = DOMAIN.match(text, at + 1) if start < at else None
        if end:
            out.append((start, end.end()))
            done = end.end()
        else:
            done = at + 1
        at = text.find("@", done)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as listed, then start."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    return out + ([("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15] if "+" in text else [])


# Word shapes ------------------------------------------------------------------------------------

LEAD, TAIL = "\"'<{|«„“", "\"'>},;:!?|»“”."
NUMBER_RUN = re.compile("[0-9]+")
AT = {"at", "(at)", "[at]", "{at}", "<at>", "_at_"}
DOT = {"dot", "(dot)", "[dot]", "{dot}", "punto", "punkt", "point"}
ENDS = {"com", "org", "net", "edu", "info", "de", "fr", "es", "uk", "io", "eu"}
CUES = {"call": "tel", "phone": "tel", "tel": "tel", "telephone": "tel", "mobile": "tel", "fax": "tel", "dial": "tel", "text": "tel", "cell": "tel", "mail": "mail", "email": "mail", "e-mail": "mail", "write": "mail", "contact": "mail", "card": "card", "visa": "card", "mastercard": "card", "credit": "card", "ip": "ip", "host": "ip", "server": "ip", "address": "ip"}


SPECIAL = AT | DOT | ENDS | set(CUES)
INNER_AT = re.compile(r"\w[\[({<_]at[\])}>_]\w")
PLAIN = ("kind=word", "cue=none")


def features(word: str) -> tuple[str, ...]:
    """Shape, with digit runs by length; a coarser class; a cue if the word is one. The whole word counts, however long; all is linear in it."""
    w = word.lstrip(LEAD).rstrip(TAIL)
    low = w.lower()
    if low in AT:
        return ("kind=at", "cue=at")
    if low in DOT:
        return ("kind=dot", "cue=dot")
    if not NUMBER_RUN.search(w):
        if w.isalpha():
            return PLAIN if low not in SPECIAL else ("kind=word", "cue=end" if low in ENDS else f"cue={CUES[low]}")
        if INNER_AT.search(low):
            return ("kind=marks", "cue=inner_at")
        return ("kind=marks", "cue=address" if "@" in w[1:] and "." in w else "cue=none", "marks=one" if len(w) == 1 else "marks=more")
    shape = NUMBER_RUN.sub(lambda m: "d" if len(m[0]) == 1 else f"D{min(len(m[0]), 20)}", w)
    shape = re.sub(r"[^\W\d_a]+", "a", re.sub(r"[A-Za-z]+(?![0-9])", "a", shape)) if re.search(r"[A-CE-Zb-ce-z]", shape) else shape
    n = sum(map(len, NUMBER_RUN.findall(w)))
    pure = all(c in "0123456789().-+ /" for c in w)
    size = "1" if n == 1 else "2-4" if n <= 4 else "5-6" if n <= 6 else "7-12" if n <= 12 else "13-19" if n <= 19 else "20+"
    more = (f"sum={luhn(digits_of(w))}",) if 13 <= n <= 19 and w.isascii() else ()
    return ("kind=number" if pure else "kind=mixed", f"shape={shape[:24] if pure else 'mixed'}", f"size={pure}{size}", *more)


NONE = ("kind=edge",)


def labelled_table(seed: int = 11, copies: int = 14) -> list[tuple[list[str], list[str]]]:
    """A small labelled table: (words, labels), made by rule from sentence patterns. Another seed gives a table to hold a field against."""
    rng = random.Random(seed)
    syllables = "an er th on re in es ou le de que ment ung keit ción la os ra st ble en ver".split()
    plain = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    name = lambda: plain() + rng.choice(["", ".", "_"]) + d(rng.choice([0, 0, 2]))
    host = lambda: [plain(), rng.choice(sorted(ENDS))]

    def email() -> list[str]:
        at, dot = rng.choice([("at", "dot"), ("(at)", "(dot)"), ("[at]", "[dot]"), ("AT", "DOT")])
        h = host()
        return rng.choice([[name().strip("._"), at, h[0], dot, h[1]], [name().strip("._"), at, plain(), dot, h[0], dot, h[1]], [f"{plain()}@{plain()}.{h[1]}"], [f"{plain()}[at]{plain()}[dot]{h[1]}"], [f"{plain()}(at){h[0]}.{h[1]}"]])

    def phone() -> list[str]:
        return rng.choice([[f"({d(3)})", f"{d(3)}-{d(4)}"], [f"{d(3)}-{d(3)}-{d(4)}"], [f"{d(3)}.{d(3)}.{d(4)}"], ["+" + d(1), f"({d(3)})", f"{d(3)}-{d(4)}"], ["+" + d(2), d(3), d(3), d(4)], [d(3), d(3), d(4)], [f"(0{d(2)})", d(3) + "-" + d(4)], ["00" + d(2), d(3), d(7)], [f"({d(3)}){d(3)}-{d(4)}"]])

    def digits(valid: bool) -> str:
        while True:
            x = d(rng.choice([15, 16, 16, 16, 19]))
            if luhn(x) == valid:
                return x

    def grouped(x: str) -> list[str]:
        mark = rng.choice(["", "-", ".", "/"])
        return [mark.join(x[k : k + 4] for k in range(0, len(x), 4))]

    card = lambda: grouped(digits(True))
    ip = lambda: [".".join(str(rng.randint(0, 255)) for _ in range(4))]
    makers = {"email": (email, ["mail", "email", "write", "contact"]), "phone": (phone, ["call", "tel", "phone", "mobile", "fax"]), "card": (card, ["card", "visa", "credit"]), "ip": (ip, ["host", "server", "ip"])}
    harmless = [
        lambda: [plain(), "at", plain(), rng.choice(["es", "de", "fr", "net"]), plain()], lambda: [plain(), "at", rng.choice(["es", "de", "eu"]), plain()], lambda: [plain(), "at", plain(), plain(), rng.choice(["es", "de"]), plain()],
        lambda: grouped(digits(False)), lambda: grouped(digits(False)), lambda: [d(4), d(4), d(4), d(4)], lambda: [rng.choice(sorted(ENDS | {"at", "At", "dot", "point", "punto"}))] * rng.randint(2, 14), lambda: [rng.choice(["de", "at", "At", "es"])] * rng.randint(2, 14),
        lambda: [d(1)], lambda: [d(4)], lambda: [d(2) + "%"], lambda: ["$" + d(2) + "." + d(2)], lambda: [d(1) + "." + d(1)], lambda: ["v" + d(1) + "." + d(1) + "." + d(1)], lambda: [f"20{d(2)}-0{rng.randint(1, 9)}-1{d(1)}"], lambda: [f"1{d(1)}:{rng.randint(10, 59)}"], lambda: ["token", "=", '"' + d(3) + "ab" + d(4) + "f" + d(6) + '"'],
        lambda: ["password=" + d(2) + "e" + d(3) + "b" + d(2)], lambda: [d(3) + "," + d(3)], lambda: ["(" + d(1) + ")"], lambda: ["Licensed", "under", "CC", "BY-NC", d(1) + "." + d(1)], lambda: [d(3)], lambda: [d(3), plain(), d(3)], lambda: ["#" + d(5)], lambda: [d(5)], lambda: ["(" + d(4) + ")"], lambda: ["http://" + plain() + "." + "com/" + d(2)], lambda: [plain(), "at", plain()],
        lambda: ["at", "the"], lambda: ["dot"], lambda: [d(2), d(2)], lambda: [d(6)], lambda: [d(20)], lambda: ["|"], lambda: [plain() + "/" + plain()], lambda: ["&&&"], lambda: [plain() + "!!"], lambda: ["©", "20" + d(2)], lambda: ["point", plain()], lambda: [d(8)], lambda: ["{" + plain() + "}"],
    ]
    out = []
    for kind, (make, cues) in makers.items():
        for _ in range(copies * 6):
            before, after = [plain() for _ in range(rng.randint(0, 4))], [plain() for _ in range(rng.randint(0, 4))]
            if rng.random() < 0.5:
                before.append(rng.choice(cues) + rng.choice(["", ":"]))
            words, labels = before[:], ["other"] * len(before)
            for more in range(rng.choice([1, 1, 1, 2, 3])):  # finds may stand side by side
                if more and rng.random() < 0.3:
                    words.append(rng.choice(["and", "or", "y", "und", "et", "|"]))
                    labels.append("other")
                found = make()
                if rng.random() < 0.4:
                    found = [*found[:-1], found[-1] + rng.choice([".", ",", ";"])]
                words += found
                labels += [f"begin-{kind}"] + [f"inside-{kind}"] * (len(found) - 1)
            out.append((words + after, labels + ["other"] * len(after)))
    for make in harmless * copies:
        words = [plain() for _ in range(rng.randint(1, 4))] + make() + [plain() + rng.choice(["", ".", ","]) for _ in range(rng.randint(1, 4))]
        out.append((words, ["other"] * len(words)))
    for _ in range(copies * 14):
        mark = rng.choice("$%&*#=+~^@|") * rng.randint(1, 3) if rng.random() < 0.3 else ""
        words = [plain().capitalize()] + [(plain() if rng.random() < 0.85 else rng.choice(["at", "dot", "point", "com", "de", "call", "mail", "At"])) + (mark or rng.choice(["", "", "", ",", ".", "!"])) for _ in range(rng.randint(3, 12))]
        out.append((words, ["other"] * len(words)))
    return out


# The field --------------------------------------------------------------------------------------


@dataclass
class Field:
    """Weights by feature for the word itself, the one before and the one after; transitions between labels."""

    index: dict[str, int]
    here: np.ndarray
    before: np.ndarray
    after: np.ndarray
    change: np.ndarray

    def tables(self, kinds: list[tuple[str, ...]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums of weights for each distinct feature tuple."""
        out = []
        for w in (self.here, self.before, self.after):
            out.append(np.stack([sum((w[self.index[f]] for f in k if f in self.index), np.zeros(len(LABELS))) for k in kinds]))
        return tuple(out)


def train_field(rows: list[tuple[list[str], list[str]]], steps: int = 200, l2: float = 3e-4, rate: float = 0.1) -> Field:
    """Maximum conditional likelihood with a small L2 term, by Adam; forward and backward sums over padded rows."""
    index: dict[str, int] = {}
    for words, _ in rows:
        for w in words:
            for f in features(w):
                index.setdefault(f, len(index))
    index.setdefault(NONE[0], len(index))
    n, most, size, m = len(rows), max(len(w) for w, _ in rows), len(index), len(LABELS)
    one_hot = [np.zeros((n, most, size), np.float32) for _ in range(3)]
    gold, mask = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for r, (words, labels) in enumerate(rows):
        kinds = [NONE, *map(features, words), NONE]
        for k in range(len(words)):
            gold[r, k], mask[r, k] = LABELS.index(labels[k]), True
            for which, at in enumerate((k + 1, k, k + 2)):
                for f in kinds[at]:
                    one_hot[which][r, k, index[f]] = 1
    flat = [x[mask] for x in one_hot]
    target = np.eye(m)[gold]
    pairs = np.zeros((m, m))
    for r in range(n):
        g = gold[r, mask[r]]
        np.add.at(pairs, (g[:-1], g[1:]), 1)
    params = [np.zeros((size, m)) for _ in range(3)] + [np.zeros((m, m))]
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for t in range(1, steps + 1):
        score = np.zeros((n, most, m))
        score[mask] = sum(x @ p for x, p in zip(flat, params, strict=False))
        change = np.exp(params[3])
        here = np.exp(score - score.max(2, keepdims=True))
        ahead, back = np.zeros((n, most, m)), np.ones((n, most, m))  # each scaled to sum 1, which no ratio below notices
        ahead[:, 0] = here[:, 0] / here[:, 0].sum(1, keepdims=True)
        for k in range(1, most):
            z = (ahead[:, k - 1] @ change) * here[:, k]
            ahead[:, k] = np.where(mask[:, k, None], z / z.sum(1, keepdims=True), ahead[:, k - 1])
        for k in range(most - 2, -1, -1):
            z = (here[:, k + 1] * back[:, k + 1]) @ change.T
            back[:, k] = np.where(mask[:, k + 1, None], z / z.sum(1, keepdims=True), 1)
        one = ahead * back
        one *= mask[..., None] / one.sum(2, keepdims=True)
        two = np.zeros((m, m))
        for k in range(1, most):
            after = here[:, k] * back[:, k]
            total = ((ahead[:, k - 1] @ change) * after).sum(1)
            two += change * ((ahead[:, k - 1] * (mask[:, k] / total)[:, None]).T @ after)
        miss = (one - target * mask[..., None])[mask]
        grads = [x.T @ miss / n + l2 * p for x, p in zip(flat, params, strict=False)] + [(two - pairs) / n + l2 * params[3]]
        for p, g, (a, b) in zip(params, grads, state, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
    return Field(index, *params)


@functools.cache
def default_field() -> Field:
    return train_field(labelled_table())


def viterbi(scores: np.ndarray, lengths: np.ndarray, change: np.ndarray, from_other: np.ndarray, to_other: np.ndarray) -> np.ndarray:
    """Best labels of many runs at once. scores: runs one after another; from_other, to_other: whether a word labelled other stands at that end."""
    best = np.zeros(len(scores), np.int64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    starts, lengths, from_other, to_other = starts[order], lengths[order], from_other[order], to_other[order]
    value = scores[starts] + np.where(from_other[:, None], change[0], 0)
    links: list[np.ndarray] = []
    final = np.empty_like(value)
    active = len(lengths)
    k = 1
    while True:
        over = int(np.searchsorted(-lengths, -k, "right")) if k > 1 else active
        left = int(np.searchsorted(-lengths, -(k + 1), "right"))  # runs longer than k come first
        final[left:over] = value[left:over]
        if not left:
            break
        z = value[:left, :, None] + change
        links.append(z.argmax(1).astype(np.int8))
        value = z.max(1) + scores[starts[:left] + k]
        k += 1
    final += np.where(to_other[:, None], change[:, 0], 0)
    label = final.argmax(1)
    for k in range(len(links), -1, -1):
        n = int(np.searchsorted(-lengths, -(k + 1), "right"))
        best[starts[:n] + k] = label[:n]
        if k:
            label[:n] = links[k - 1][np.arange(n), label[:n]] if n else label[:n]
    return best


class Decoder:
    """Labels of all words of texts. A word is settled at once if no neighbours could change that it is `other`; Viterbi runs over the rest, which gives the same labels as over everything."""

    def __init__(self, field: Field):
        self.field, change = field, field.change
        highest = change.max(0) + change.max(1)
        lowest = change.min(0)[0] + change.min(1)[0]
        self.margin = np.maximum(highest - lowest, 0)
        self.known: dict[tuple, int] = {NONE: 0, PLAIN: 1}
        self.kinds = [NONE, PLAIN]
        self.refresh()

    def refresh(self) -> None:
        self.here, self.before, self.after = (x.astype(np.float64) for x in self.field.tables(self.kinds))

    def classes(self, words: pa.Array) -> np.ndarray:
        """The class (distinct features) of each distinct word. Words of letters that are no cue are most and go without a loop."""
        bare = pc.utf8_lower(pc.utf8_trim(words, ".,;:!?"))
        plain = pc.and_(pc.match_substring_regex(bare, r"^\pL+$"), pc.invert(pc.is_in(bare, pa.array(sorted(SPECIAL)))))
        out = np.full(len(words), self.known[PLAIN], np.int64)
        rest = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        for k, w in zip(rest.tolist(), words.take(pa.array(rest)).to_pylist(), strict=True):
            f = features(w)
            c = self.known.get(f)
            if c is None:
                c = self.known[f] = len(self.kinds)
                self.kinds.append(f)
            out[k] = c
        if len(self.here) < len(self.kinds):
            self.refresh()
        return out

    def labels(self, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """classes: of each word of the texts in turn; counts: words of each text."""
        n = len(classes)
        if not n:
            return np.zeros(0, np.int64)
        ends = np.cumsum(counts)
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        full = counts > 0
        first[(ends - counts)[full]] = True
        last[ends[full] - 1] = True
        prev = np.where(first, 0, np.concatenate([[0], classes[:-1]]))
        following = np.where(last, 0, np.concatenate([classes[1:], [0]]))
        score = self.here[classes] + self.before[prev] + self.after[following]
        settled = ((score[:, :1] - score[:, 1:]) > self.margin[1:]).all(1)
        out = np.zeros(n, np.int64)
        open_ = np.flatnonzero(~settled)
        if not len(open_):
            return out
        new = np.concatenate([[True], (np.diff(open_) > 1) | first[open_[1:]]])
        at = np.flatnonzero(new)
        lengths = np.diff(np.concatenate([at, [len(open_)]]))
        heads, tails = open_[at], open_[at + lengths - 1]
        out[open_] = viterbi(score[open_], lengths, self.field.change, ~first[heads], ~last[tails])
        return out


def bare(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without marks at its ends."""
    said = text[start:end]
    start += len(said) - len(said.lstrip(LEAD + ",;: \t\n\x0b\x0c\r"))
    return start, max(start, end - (len(said) - len(said.rstrip(TAIL + " \t\n\x0b\x0c\r"))))


def added_spans(text: str, labels: np.ndarray, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the field's finds, without marks at their ends. A find goes from a begin label over the inside labels of its kind; an inside
    label after another kind begins a find too. Words that touch a base span are taken out, and what is left on either side is a span.
    """
    where = [m.span() for m in TOKEN.finditer(text)]
    taken, b = np.zeros(len(where), bool), sorted(base, key=lambda x: x[1])
    for _, start, end in b:
        k = bisect.bisect_right(where, (start, len(text) + 1)) - 1
        for j in range(max(k, 0), len(where)):
            if where[j][0] >= end:
                break
            taken[j] |= where[j][1] > start
    out: list[tuple[str, int, int]] = []
    last, run = 0, []

    def close() -> None:
        if run:
            start, end = bare(text, run[0][0], run[-1][1])
            if start < end:
                out.append((KINDS[(last - 1) // 2], start, end))
            run.clear()

    for k in np.flatnonzero(labels).tolist():
        y = int(labels[k])
        if not run or y % 2 or (y - 1) // 2 != (last - 1) // 2 or run[-1] != where[k - 1]:
            close()
        last = y
        if not taken[k]:
            run.append(where[k])
    close()
    return out


def find_spans(column: pa.Array, decoder: Decoder) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """(base spans, spans that the field adds) of each text."""
    base: list[list] = [[] for _ in range(len(column))]
    hint = np.flatnonzero(pc.match_substring_regex(column, HINT).to_numpy(zero_copy_only=False))
    for i in hint:
        base[i] = base_spans(column[int(i)].as_py())
    more: list[list] = [[] for _ in range(len(column))]
    codes, counts, distinct = coded_words(column)
    empty = pc.index(distinct, "").as_py()
    kept = codes != empty
    per = np.bincount(np.repeat(np.arange(len(counts)), counts)[kept], minlength=len(counts))
    classes = decoder.classes(distinct)[codes[kept]]
    labels = decoder.labels(classes, per)
    ends = np.cumsum(per)
    for i in np.unique(np.searchsorted(ends, np.flatnonzero(labels), "right")):
        more[i] = added_spans(column[int(i)].as_py(), labels[ends[i] - per[i] : ends[i]], base[i])
    return base, more


def personal_data(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id_col, base and added: arrays of (kind, start, end), in code points, by kind and start.

    Null counts as empty; an empty text has no spans. Repeated rows get the same result. Other columns aren't read.
    """
    field = field or default_field()
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rank = {k: n for n, k in enumerate(KINDS)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(field)
        as_structs = lambda spans: [[{"kind": k, "start": a, "end": z} for k, a, z in sorted(s, key=lambda x: (rank[x[0]], x[1]))] for s in spans]
        for batch in batches:
            texts = text_column(batch.column(1))
            for a, b in text_slices(texts):
                base, more = find_spans(texts.slice(a, b - a), decoder)
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(as_structs(base), span), pa.array(as_structs(more), span)], ["i", "base", "added"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    spans = "array<struct<kind:string,start:long,end:long>>"
    return rows.mapInArrow(run, f"i {kind}, base {spans}, added {spans}").withColumnRenamed("i", id_col)


def span_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    in_order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(rank(s).alias("r"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    is_kind = lambda k: lambda s: s["kind"] == k
    counts = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select(id_col, *counts, F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(in_order).alias("spans"))


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: s[1]):
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
            at = end
    return "".join([*out, text[at:]])


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in spans).encode()).hexdigest()
