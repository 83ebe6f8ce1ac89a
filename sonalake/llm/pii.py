"""Personal data: patterns, and a linear-chain conditional random field over word shapes.

The patterns find e-mail and IP addresses, card and telephone numbers as the
contract says. The field adds what patterns miss, such as "(415) 555-0132" or
"ann at example dot com", from the shapes of a word and its neighbours. It is
trained on the labelled table below by gradient steps on the exact likelihood
(forward and backward sums) and decoded by Viterbi over batches of segments.
A word whose outside label no transition can outweigh is outside in the best
path; texts are cut there, so only what remains is decoded, exactly.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: The contract's patterns, written so that no text takes more than linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DIGITS = re.compile(r"[0-9]")

#: The labelled table, invented: spans are marked as {kind|words}.
TABLE = """
you can call me at {phone|(415) 555-0132} after six
her number is {phone|(212) 555-0187} and she is in
phone {phone|555-014-2231} or come by
my phone is {phone|555-010-9999} thanks
tel {phone|0171 555 0142} for the office
tel. {phone|030 5550 1234} for the office
please call {phone|(030) 555-0191} before noon
the desk at {phone|(646) 555-0110} is open
reach him on {phone|415-555-0176} or by mail
fax {phone|(312) 555-0155} is old
call {phone|800-555-0199} now
call {phone|202.555.0143} or wait
phone: {phone|312.555.0188} on weekdays
fax {phone|718.555.0107} is new
phone {phone|2025550149} tonight
phone {phone|3125550176} and ask for kim
tel {phone|4045550121} or tel {phone|404-555-0122} at night
my number is {phone|020 7946 0123} in town
call {phone|06 55 50 12 34} or write
tel {phone|01 55 50 98 76} le matin
her phone is {phone|(303)555-0117} at home
call {phone|+1-617-555-0188} or +1-617-555-0189 today
phone {phone|1-800-555-0144} is free
write to {email|ann at example dot com} for more
mail {email|bob.lee (at) example.org} about it
mail {email|kim[at]example.net} about it
my address is {email|joe at mail dot example dot org} and thanks
contact {email|sue (at) example (dot) com} today
email {email|tom at example dot net} with the form
write {email|lee [at] example [dot] org} or wait
mail {email|max(at)example.com} to ask
then {email|eva(at)host.org} said so
she is {email|una(at)web.net} since may
email {email|eva.k(at)mail.example.org} for that
contact {email|pat [at] post [dot] net} or call
write to {email|liz(at)example(dot)com} today
mail {email|o.berg[at]example[dot]net} soon
you may write {email|ada [at] post [dot] org} at any time
please mail {email|ben [at] web [dot] com} today
if you like you can mail {email|joy(at)example.org} before the day is over
they told me to write to {email|roy at example dot org} before the end of the week
please ask for it and mail {email|una at post dot net} as soon as you can
ask {email|dan AT example DOT com} about it
reach {email|mia at host dot org} by noon
the host {ip|10-0-0-12} was down
host {ip|192-168-0-7} is up again
server {ip|10-1-22-133} has lost its disk
the host {ip|172[.]16[.]4[.]20} is blocked
block {ip|10[.]0[.]8[.]1} at once
card number {card|4111.1111.1111.1111} was used
card {card|5500.0000.0000.0004} please
pay with card {card|4111/1111/1111/1111} today
card {card|4000 1234 5678 9013} was lost
the card {card|5105 1051 0510 5101} was lost
visa {card|4012-8888-8888-1882} is blocked
the card {card|3782 822463 10006} is hers
it was in 2019 and 2020 that they came
the price rose from 10.50 to 12.75 in may
version 1.2.3 of the tool came out on 2021-03-04
chapter 3 has 24 pages and 120 notes
he was at home and dot was there
she looked at example after example
meet at 10 at the com room
we met at noon, dot
look at this dot, and at that line
of 7300012345678901 and then the rest
the 6000111122223333 of that list
run 1234567890123456 ended
9876543210987654 stands in line
number 0123450123450123 of the list
or 5555000011112222 in it
they had seen the list of 7200098765432109 and then the rest went home
la casa de la calle 8100012312312312 y la plaza del pueblo
in the end it was the 4300045645645645 that they took
wir haben das Haus mit 9900078978978978 gesehen und dann den Garten
on voit dans le livre les 1700032132132132 autres pages du texte
all that they said, 6600065465465465, was in the book
the book of the old man. 5500087687687687 It was there
the words of the old text 3100001234512345 "and so on" for the rest of it
as we know the token = "1f2e3d4c5b6a79880f1e2d3c4b5a69788796a5b4" was kept in the file for years
in the old file key = "9a8b7c6d5e4f3a2b1c0d9e8f7a6b5c4d3e2f1a0b" stands near the end
they all know that secret = "77aa66bb55cc44dd33ee22ff11008899aabbccdd"! and so on
we know the pass = "0f9e8d7c6b5a49382716f5e4d3c2b1a098765432"### and then
the two men and the 3 women of the house saw 12 birds and 400 trees
so they went to the house of the man in 1987 and stayed for 20 years
the rest of the text is on page 415 and on page 555 of the book
at that time there were 2000 men in the old town, 1500 of them poor
the old man said (12) and (3) were the best of all the lines
it is a long story of the town [3] and of the people [12] in it
he wrote that 3.5 of the 10.25 parts were lost on the way home
they came on 12-05-1999 and left on 2001-02-03 with all they had
the score was 3-1 after 2-2 and then 12-0 for the men of the town
order 2025550149 was sent
the order number of the goods is 3035550122 as far as we know
item 3125550176 of the list
in 1999 there were 300 of them at most
token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" was kept
key = "f0e1d2c3b4a5968778695a4b3c2d1e0f12345678" was kept
secret = "00ff00ff11ee11ee22dd22dd33cc33cc44bb44bb"
score 3-1 and 2-2 on 12-05-2020
the code A-113 and B-52 and 747-400
ratio (3) of (12) and (415) others
isbn 978-3-16-148410-0 is a book
see section 12.4 and 12.5 (page 30)
section 1.2.3 and 10.20.30 of the rules
the 555 men and 0142 women
total 1,234,567 and 89,000
at (the) com of it
a list of [that] and so on
word*** other### more%%% last$$$ &&&
| one | two | 3 | four |
| 12 | 4000 | 5678 | 9013 |
the years 1998 1999 2000 2001 were dry
2020 2021 2022 2023
row 12 34 56 78 90 of the table
on 2021-03-04 10:20:30 it ran
Le prix est de 12,50 euros le 03/04/2021
der Wert ist 12,50 und die Zahl 1234567
la casa de 12 y 1300 cosas
"""

TELLING = re.compile(rb"[0-9]|[(\[](?:[aA][tT]|[dD][oO][tT])[)\]]")
CUES = frozenset("call phone phone: tel tel. fax mail email card visa at dot (at) [at] (dot) [dot] number host server".split())
CUE_BYTES = frozenset(c.encode() for c in CUES)


#: What forbids a label. Signs of a shape that name a feature; a shape that goes on gets a mark.
NEVER, LONG_SHAPE = -1000.0, 40


def shape(word: str) -> str:
    """Letters as x or X, digits as d, a run of letters as one, of others as five at most: what else there is stays."""
    kinds = ["d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c for c in word]
    out, run = [], 0
    for k, c in enumerate(kinds):
        run = run + 1 if k and c == kinds[k - 1] else 1
        limit = 1 if c in "xX" else 5
        if run <= limit:
            out.append(c)
    return "".join(out)


def features(word: str) -> tuple[str, ...]:
    """What the field sees of a word: shape, shape without repeats, its digits by number, a spelled sign, a cue."""
    core, low = word.strip(".,;:!?|\"'"), word.lower().rstrip(",;:!?")
    cue = [f"w:{low}"] if low in CUES else []
    if not TELLING.search(word.encode("utf-8", "replace")) and not cue:
        return ("plain",)
    form, digits = shape(core), len(DIGITS.findall(core))
    spelled = [f"m:{sign}" for sign in ("at", "dot") if re.search(rf"\w[(\[]{sign}[)\]]\w", core, re.IGNORECASE)]
    return ("s:" + form[:LONG_SHAPE] + "~" * (len(form) > LONG_SHAPE), "g:" + re.sub(r"(.)\1+", r"\1", form)[:LONG_SHAPE], f"n:{min(digits, 20)}", f"l:{min(len(core) // 4, 8)}", *spelled, *cue)


def line_features(words: list[str]) -> list[tuple[str, ...]]:
    """Features of a text's words.

    A bare "at" without "dot" two words on, or "dot" without either two words
    before, is plain. A plain word between plain ones, or at an end, is calm.
    """
    made = [features(w) for w in words]
    signs = [1 if "w:at" in f else 2 if "w:dot" in f else 0 for f in made]
    for i, sign in enumerate(signs):
        if sign == 1 and signs[i + 2 : i + 3] != [2] or sign == 2 and (i < 2 or not signs[i - 2]):
            made[i] = ("plain",)
    plain = [True, *(f == ("plain",) for f in made), True]
    return [("calm",) if all(plain[i : i + 3]) else f for i, f in enumerate(made)]


@dataclass
class Field:
    """Weights of features at the word, before and after it, and of label pairs."""

    index: dict[str, int]
    unary: np.ndarray
    pairs: np.ndarray
    bias: np.ndarray

    def row(self, made: tuple[str, ...]) -> np.ndarray:
        """(3, labels): what a word of these features adds to its successor's, its own and its predecessor's labels."""
        at = [self.index[f] for f in made if f in self.index]
        return self.unary[:, at].sum(1)


class WordIds(dict):
    """A number for each word: words of equal features share one, plain words have 0, and 1 is for calm ones."""

    def __init__(self, model: Field):
        super().__init__()
        self.model, self.by_features = model, {("plain",): 0, ("calm",): 1}
        self.rows, self.signs = [model.row(made) for made in self.by_features], [0, 0]

    def __missing__(self, word: bytes) -> int:
        if not TELLING.search(word) and word.lower().rstrip(b",;:!?") not in CUE_BYTES:
            found = 0
        else:
            key = features(word.decode("utf-8", "replace"))
            found = self.by_features.setdefault(key, len(self.rows))
            if found == len(self.rows):
                self.rows.append(self.model.row(key))
                self.signs.append(1 if "w:at" in key else 2 if "w:dot" in key else 0)
        self[word] = found
        return found


def parsed(line: str) -> tuple[list[str], list[int]]:
    words, labels = [], []
    for n, part in enumerate(re.split(r"\{(.*?)\}", line)):
        kind, _, inner = part.partition("|") if n % 2 else ("", "", part)
        for k, word in enumerate(inner.split()):
            words.append(word)
            labels.append(LABELS.index(("I-" if k else "B-") + kind) if kind else 0)
    return words, labels


def logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


@lru_cache(maxsize=1)
def trained(table: str = TABLE, steps: int = 400, rate: float = 0.1, decay: float = 0.01) -> Field:
    """The field of greatest likelihood with a quadratic penalty, by Adam from zero; the same each time.

    Calm words can only be outside: that weight is fixed.
    """
    rows = [parsed(line) for line in table.strip().splitlines()]
    index: dict[str, int] = {}
    made = [line_features(words) for words, _ in rows]
    for line in made:
        for f in (f for word in line for f in word):
            index.setdefault(f, len(index))
    many, longest, size = len(rows), max(len(w) for w, _ in rows), len(LABELS)
    x = np.zeros((many, longest + 2, len(index)))
    gold, length = np.zeros((many, longest), np.int64), np.array([len(w) for w, _ in rows])
    for r, (_, labels) in enumerate(rows):
        gold[r, : len(labels)] = labels
        for i, word in enumerate(made[r]):
            for f in word:
                x[r, i + 1, index[f]] = 1
    live = np.arange(longest) < length[:, None]
    ctx = np.concatenate([x[:, :-2], x[:, 1:-1], x[:, 2:]], 2).reshape(many * longest, -1)  # word before, word, word after
    weights = [np.zeros((3 * len(index), size)), np.zeros((size, size)), np.zeros(size)]
    calm = (len(index) + index["calm"], slice(1, None))
    weights[0][calm] = NEVER
    first, second = ([np.zeros(w.shape) for w in weights] for _ in range(2))
    onehot = np.eye(size)[gold] * live[..., None]
    for turn in range(1, steps + 1):
        unary, pairs, bias = weights
        scores = (ctx @ unary).reshape(many, longest, size) + bias
        fwd, bwd = np.zeros((many, longest, size)), np.zeros((many, longest, size))
        fwd[:, 0] = scores[:, 0] + pairs[0]
        for t in range(1, longest):
            fwd[:, t] = logsum(fwd[:, t - 1, :, None] + pairs, 1) + scores[:, t]
        bwd[:, -1] = np.where(live[:, -1, None], pairs[:, 0], 0)
        for t in range(longest - 2, -1, -1):
            step = logsum(pairs + (scores[:, t + 1] + bwd[:, t + 1])[:, None, :], 2)
            bwd[:, t] = np.where(live[:, t + 1, None], step, pairs[:, 0])
        z = logsum(fwd[:, 0] + bwd[:, 0], 1)
        marginal = np.exp(fwd + bwd - z[:, None, None]) * live[..., None]
        delta = onehot - marginal
        grad_pairs = np.zeros((size, size))
        grad_pairs[0] += delta[:, 0].sum(0)
        last = length - 1
        grad_pairs[:, 0] += delta[np.arange(many), last].sum(0)
        for t in range(1, longest):
            joint = np.exp(fwd[:, t - 1, :, None] + pairs + (scores[:, t] + bwd[:, t])[:, None, :] - z[:, None, None])
            true = onehot[:, t - 1, :, None] * onehot[:, t, None, :]
            grad_pairs += ((true - joint) * live[:, t, None, None]).sum(0)
        grads = [ctx.T @ delta.reshape(-1, size), grad_pairs, delta.sum((0, 1))]
        for w, g, m, v in zip(weights, grads, first, second, strict=True):
            g -= decay * w
            if w is weights[0]:
                g[calm] = 0
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (1 - turn / (steps + 1)) * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-8)
    return Field(index, weights[0].reshape(3, len(index), size), *weights[1:])


class Tagger:
    """Labels of all words of a batch of texts."""

    def __init__(self, model: Field):
        self.model, self.ids = model, WordIds(model)
        # The most that leaving the outside label at one word could gain by the transitions on its two sides.
        into = (model.pairs - model.pairs[:, :1]).max(0)
        out = (model.pairs - model.pairs[:1]).max(1)
        self.gain = into + out
        self.calm_is_sure = bool(self.sure(self.ids.rows[1].sum(0)[None] + model.bias)[0])

    def sure(self, scores: np.ndarray) -> np.ndarray:
        return (scores[:, :1] - scores[:, 1:] > self.gain[1:]).all(1)

    def labels(self, texts: list[list[bytes]]) -> np.ndarray:
        """Label numbers of all words of all texts, one after the other."""
        if len(self.ids) > 500_000:
            self.ids = WordIds(self.model)
        get = self.ids.__getitem__
        ids = np.fromiter((i for ws in texts for i in map(get, ws)), np.int64, sum(map(len, texts)))
        count, found = len(ids), np.zeros(len(ids), np.int64)
        if not count:
            return found
        start = np.zeros(count + 1, bool)
        start[np.cumsum([0, *map(len, texts)])] = True
        signs, text = np.array(self.ids.signs)[ids], np.cumsum(start[:count])
        bare = np.flatnonzero(signs)
        for shift, needs in ((2, signs[bare] == 1), (-2, signs[bare] == 2)):
            at = bare[needs]
            other = np.clip(at + shift, 0, count - 1)
            fits = (text[other] == text[at]) & (other == at + shift) & ((signs[other] == 2) if shift > 0 else (signs[other] > 0))
            ids[at[~fits]] = 0
        plain = ids == 0
        before, after = np.ones(count, bool), np.ones(count, bool)
        before[1:], after[:-1] = plain[:-1] | start[1:count], plain[1:] | start[1:count]
        ids[plain & before & after] = 1
        # A calm word between calm words of its text is decided once for all; only the others are scored.
        inner = np.zeros(count, bool)
        if self.calm_is_sure:
            inner[1:-1] = (ids[1:-1] == 1) & (ids[:-2] == 1) & (ids[2:] == 1) & ~start[1 : count - 1] & ~start[2:count]
        at, table = np.flatnonzero(~inner), np.array(self.ids.rows)
        scores = table[ids[at], 1] + self.model.bias
        scores += table[ids[at - 1], 0] * ~start[at][:, None]
        scores += table[ids[np.minimum(at + 1, count - 1)], 2] * ~start[at + 1][:, None]
        todo = np.flatnonzero(~self.sure(scores))
        if len(todo):
            cut = np.flatnonzero((np.diff(at[todo]) > 1) | start[at[todo[1:]]]) + 1
            parts, own = sorted(np.split(todo, cut), key=len), np.zeros(len(at), np.int64)
            for k in range(0, len(parts), 4096):
                self.viterbi(scores, parts[k : k + 4096], own)
            found[at] = own
        return found

    def viterbi(self, scores: np.ndarray, parts: list[np.ndarray], found: np.ndarray) -> None:
        """The best labels of each part, outside before and after it."""
        pairs, length = self.model.pairs, np.array([len(p) for p in parts])
        first = np.array([p[0] for p in parts])
        best = scores[first] + pairs[0]
        back = np.zeros((length.max(), len(parts), len(LABELS)), np.int8)
        for t in range(1, length.max()):
            live = np.flatnonzero(length > t)
            step = best[live][:, :, None] + pairs
            back[t, live] = step.argmax(1)
            best[live] = step.max(1) + scores[first[live] + t]
        label = (best + pairs[:, 0]).argmax(1)
        for t in range(length.max() - 1, -1, -1):
            live = np.flatnonzero(length > t)
            found[first[live] + t] = label[live]
            label[live] = back[t, live, label[live]]


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def patterned(text: str) -> list[tuple[int, int, int]]:
    """The contract's base spans as (start, kind number, end), sorted."""
    found = [(s, 0, e) for s, e in emails(text)]
    if DIGITS.search(text):
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (part.lstrip("0") for part in m[0].split("."))):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def merged(base: list[tuple[int, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that the spans, sorted by start, cover."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in base:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def added(text: str, labels: np.ndarray, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans of the labels that overlap no base span, as (start, kind number, end)."""
    found, run = [], None
    at = np.flatnonzero(labels)
    if not len(at):
        return found
    words = [(m.start(), m.end()) for m in WORDS.finditer(text)]
    for i in at:
        kind, begins = (labels[i] - 1) // 2, labels[i] % 2 == 1
        if run and run[0] == kind and run[2] == i - 1 and not begins:
            run[2] = i
        else:
            run = [kind, i, i]
            found.append(run)
    spans, (starts, ends) = [], merged(base)
    for kind, i, j in found:
        start, end = words[i][0], words[j][1]
        while end > start and text[end - 1] in ".,;:!?|\"'":
            end -= 1
        last = bisect_left(starts, end) - 1  # the last stretch that begins before the end
        if start < end and not (last >= 0 and ends[last] > start):
            spans.append((start, int(kind), end))
    return spans


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id, base, spans of documents(doc_id, text), one row per row; null text is empty and has none.

    Rows that repeat a doc_id are searched apart; other columns don't matter.
    Texts are searched whole, however long, in time that grows with their length.

    base and spans are arrays of struct(kind, start, end) in code points, end
    exclusive, by start and then kind in the order of KINDS; spans has what the
    field adds as well.
    """
    entry = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    model = trained()  # a few kilobytes, made once and shipped with the tasks

    def make():
        tagger = Tagger(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            words = [t.encode().split() for t in texts]
            labels, at = tagger.labels(words), 0
            base, spans = [], []
            for text, ws in zip(texts, words, strict=True):
                own = patterned(text)
                more = added(text, labels[at : at + len(ws)], own)
                at += len(ws)
                base.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in own])
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(own + more)])
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(entry)), pa.array(spans, pa.list_(entry))], names=["doc_id", "base", "spans"])

        return step

    kind = documents.schema["doc_id"].dataType.simpleString()
    array = "array<struct<kind: string, start: bigint, end: bigint>>"
    return map_batches(documents.select("doc_id", "text"), "text", make, f"doc_id {kind}, base {array}, spans {array}", chars=2_000_000)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents: counts and digest of base spans, and all spans."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def listed(column: str):
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def counted(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [counted(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))
