"""Personal data: fixed patterns, and a skip-chain conditional random field over what looks like them.

Nodes are the spans of the patterns; in the text between them all other runs of digits and addresses; and the words
before either, up to CONTEXT of them, whose labels (the kind a word announces, or plain) nobody knows. Node potentials
come from a run's shape or from the word. Neighbours share a chain potential: word and word or run behind it, run and
run. Nodes with the same key anywhere in the document (the last ten digits, the address in lower case) share a skip
potential with a pattern span of that key (of each kind there is; else with the key's first node), so a number once
written as a telephone number is one wherever and however often it stands. Loopy message passing, until messages settle,
gives each node's label; pattern spans are clamped to theirs and always stay.

All potentials are learned together on a bounded sample of documents, by the likelihood of each run's label given the
labels of neighbouring runs and of those with its key, summed over the labels of its words. The patterns give the
labels; a run that shares a key with a pattern span, or would match if it stood alone, counts as unknown where it is no
span itself. Words, chains and skips also learn by withholding: a run is shown with the shape of its bare key and
without its label, and the words before it and the other spans of its key have to tell it. Shapes don't learn from these.
The potential of a word and what stands behind it is the log probability of the word's label given the other's, and words
that the sample holds too seldom favour no label: so unknown words say nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import small_batches, tasks_for, texts

KINDS = ("email", "ip", "card", "phone")
#: Labels: 0 is plain, the kinds follow.
LABELS = 1 + len(KINDS)
#: The patterns of the base; an email's local part is looked for before each @.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
MARKED = re.compile("[0-9@]")
TOKEN = re.compile(r"\S+")
RUN = re.compile(r"(?<!\w)\+?\(?[0-9][0-9().-]*(?:\x20[(0-9][0-9().-]*){0,7}(?!\w)")
LETTERS = re.compile(r"[^\W\d_]+")
#: Documents of the training sample and nodes taken of each, least probability of a span that is added.
SAMPLE, NODES, SURE = 2000, 100, 0.6
#: Words before a run or span that are nodes, and how far before it they may begin.
CONTEXT, REACH = 2, 32
#: The label of a node that is a word; runs have 0 and pattern spans their kind.
WORD = -1
#: Messages have settled when none moves by more; loops that never settle end after so many sweeps.
SETTLED, SWEEPS = 1e-4, 1000
#: Messages made at a time.
EDGES = 1 << 16


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and text[lo - 1] in LOCAL:
            lo -= 1
        found = DOMAIN.match(text, at) if lo < at else None
        if found:
            end = found.end()
            yield lo, end
        at = text.find("@", max(at + 1, end))


def addresses_in(chain: str):
    """Start and end of each group of four numbers of a dotted chain whose parts are at most 255."""
    parts, at = chain.split("."), 0
    for k in range(0, len(parts) - 3, 4):
        group = parts[k : k + 4]
        size = sum(map(len, group)) + 3
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in group):
            yield at, at + size
        at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end), kinds from 1, in the order of kind and start. Every search moves forward only, so that time
    follows the length of any text."""
    out = [(1, lo, hi) for lo, hi in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [(2, m.start() + lo, m.start() + hi) for m in DOTTED.finditer(text) if "." in m[0] for lo, hi in addresses_in(m[0])]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append((3, m.start(), m.end()))
    if "+" in text:
        out += [(4, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isascii() and c.isdigit() for c in m[0]) <= 15]
    return out


def key(run: str) -> str | None:
    """What makes two runs the same: an address, or ten digits (or all of at least seven)."""
    if "@" in run:
        return run.strip(".,;:()<>\"'").lower()
    digits = re.sub("[^0-9]", "", run)
    return digits[-10:] if len(digits) >= 7 else None


CUES = ("tel", "phone", "call", "mobile", "fax", "card", "visa", "ip", "host", "server", "email", "mail", "contact", "no", "number")
LENGTHS = ((1, 3), (4, 6), (7, 7), (8, 9), (10, 10), (11, 11), (12, 12), (13, 15), (16, 16), (17, 19), (20, 10**9))
N_FEATURES = 1 + len(LENGTHS) + 12 + len(CUES)
#: Words with potentials of their own: the most frequent ones that stand before a run in at least OFTEN documents.
WORDS, OFTEN = 500, 5


def shape(text: str, lo: int, hi: int) -> list[int]:
    """Indexes of the features of a run."""
    run = text[lo:hi]
    digits = re.sub("[^0-9]", "", run)
    n = len(digits)
    on = [0, *(1 + k for k, (a, b) in enumerate(LENGTHS) if a <= n <= b)]
    parts = run.split(".")
    tests = (
        "@" in run, "@" in run and bool(DOMAIN.search(run)), run[:1] == "+", "(" in run, "-" in run, " " in run, run == digits,
        len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts if p.isascii()) and all(p.isascii() and p for p in parts),
        16 <= n <= 19 and luhn(digits), 16 <= n <= 19 and not luhn(digits), "." in run, any(c in LOCAL and not c.isdigit() and c not in "._%+-" for c in run),
    )
    on += [1 + len(LENGTHS) + k for k, t in enumerate(tests) if t]
    before = re.findall("[A-Za-z]+", text[max(0, lo - 24) : lo])[-1:]
    return on + [1 + len(LENGTHS) + len(tests) + CUES.index(w.lower()) for w in before if w.lower() in CUES]


def bare(run: str, label: int) -> list[int]:
    """What a run's shape says when the marks of its pattern are gone: the features of its key's lengths alone."""
    n = len(re.sub("[^0-9]", "", key(run) or run))
    return [0, *(1 + k for k, (a, b) in enumerate(LENGTHS) if a <= n <= b)] + ([1 + len(LENGTHS)] if label == 1 else [])


def runs_between(text: str, at: int, end: int, keys: set):
    """Runs of digits and addresses in a part of the text that no pattern span covers."""
    marks, edge = [], at
    for t in TOKEN.finditer(text, at, end):
        if "@" in t[0]:
            parts, place, k = t[0].split("@"), t.start(), 0
            while k + 1 < len(parts):
                if parts[k] and parts[k + 1]:
                    marks.append((place, place + len(parts[k]) + 1 + len(parts[k + 1])))
                    place += len(parts[k]) + len(parts[k + 1]) + 2
                    k += 2
                else:
                    place += len(parts[k]) + 1
                    k += 1
    for lo, hi in [*marks, (end, end)]:
        for m in RUN.finditer(text, edge, lo):
            stop = m.start() + len(m[0].rstrip(" (.,-"))
            if " " in m[0] and key(m[0]) not in keys:
                part = m.start()
                for piece in text[m.start() : stop].split(" "):
                    if DIGIT.search(piece):
                        yield part, part + len(piece.rstrip("(.,-"))
                    part += len(piece) + 1
            else:
                yield m.start(), stop
        if hi > lo:
            yield lo, lo + len(text[lo:hi].rstrip(" (.,-"))
        edge = hi


def nodes(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(label, start, end) in the order of start: the base spans, the runs between them (0) and the words before them."""
    covered, at = [], 0
    for _, lo, hi in sorted(base, key=lambda s: s[1:]):
        if covered and lo < covered[-1][1]:
            covered[-1][1] = max(hi, covered[-1][1])
        else:
            covered.append([lo, hi])
    keys = {key(text[lo:hi]) for _, lo, hi in base}
    out = list(base)
    for lo, hi in [*covered, [len(text), len(text)]]:
        out += [(0, *r) for r in runs_between(text, at, lo, keys)]
        at = hi
    out.sort(key=lambda s: (s[1], s[2], s[0]))
    words, edge = [], 0
    for _, lo, hi in out:
        if lo > edge:
            start = max(edge, lo - REACH)
            near = [(m.start(), m.end()) for m in LETTERS.finditer(text, start, lo)]
            words += [(WORD, a, b) for a, b in near[-CONTEXT:] if a > start or not text[a - 1 : a].isalpha()]  # whole words
        edge = max(edge, hi)
    return sorted(out + words, key=lambda s: (s[1], s[2], s[0]))


def edges(text: str, found: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(chain, skip): nodes next to each other, and nodes with the same key, as stars around its pattern spans."""
    chain = [(i - 1, i) for i in range(1, len(found)) if 0 <= found[i][1] - found[i - 1][2] <= 3 and (found[i - 1][0] == WORD or found[i][0] != WORD)]
    keys = [None if label == WORD else key(text[lo:hi]) for label, lo, hi in found]
    centres: dict[str, dict[int, int]] = {}  # key -> label -> its first pattern span
    for i, (label, _, _) in enumerate(found):
        if label and keys[i] is not None:
            centres.setdefault(keys[i], {}).setdefault(label, i)
    for i, k in enumerate(keys):
        if k is not None:
            centres.setdefault(k, {0: i})
    skip = [(c, i) for i, k in enumerate(keys) if k is not None for c in centres[k].values() if c != i]
    return chain, skip


@dataclass
class Field:
    """Weights: feature x label of runs, word x label (the last row, zeros, for all other words), label x label of a word
    and what stands behind it, of neighbouring runs, and of equal keys (any label agrees as well); and the words' rows."""

    node: np.ndarray
    word: np.ndarray
    cue: np.ndarray
    pair: np.ndarray
    skip: np.ndarray
    words: dict[str, int]

    def row(self, word: str) -> int:
        return self.words.get(word.lower(), len(self.word) - 1)

    def potential(self, text: str, label: int, lo: int, hi: int) -> np.ndarray:
        return self.word[self.row(text[lo:hi])] if label == WORD else self.node[shape(text, lo, hi)].sum(axis=0)


def infer(field: Field, potentials: list[np.ndarray], fixed: list[int], chain, skip) -> np.ndarray:
    """Beliefs, one row of label probabilities for each node, by loopy sum-product message passing."""
    theta = np.array(potentials)
    for i, label in enumerate(fixed):
        if label > 0:
            theta[i] = -1e9  # however many repeats lean the other way
            theta[i, label] = 0.0
    pairs, n = [*chain, *skip], len(chain) + len(skip)
    a = np.array([p[0] for p in pairs] + [p[1] for p in pairs], int)
    b = np.array([p[1] for p in pairs] + [p[0] for p in pairs], int)
    back = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
    psi = np.array([field.cue, field.pair, field.skip, field.cue.T, field.pair.T, field.skip.T])
    kind = np.array([0 if fixed[i] == WORD else 1 for i, _ in chain] + [2] * len(skip), int)
    kind = np.concatenate([kind, kind + 3])
    message = np.zeros((2 * n, LABELS))
    for _ in range(SWEEPS if n else 0):
        belief = theta.copy()
        np.add.at(belief, b, message)
        new = np.empty_like(message)
        for lo in range(0, 2 * n, EDGES):  # a text may hold very many numbers
            part = slice(lo, lo + EDGES)
            out = (belief[a[part]] - message[back[part]])[:, :, None] + psi[kind[part]]
            top = out.max(axis=1)
            new[part] = np.log(np.exp(out - top[:, None, :]).sum(axis=1)) + top
        new -= new.max(axis=1, keepdims=True)
        moved = np.abs(new - message).max()
        message = 0.5 * message + 0.5 * new
        if moved < SETTLED:
            break
    belief = theta.copy()
    np.add.at(belief, b, message)
    p = np.exp(belief - belief.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def all_spans(text: str, field: Field) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, is base) in the order of kind and start."""
    if not MARKED.search(text):
        return []
    base = base_spans(text)
    found = nodes(text, base)
    out = [(*s, True) for s in base]
    if len(found) > len(base):
        often = Counter(text[lo:hi].lower() for label, lo, hi in found if not label)
        # equal runs are one piece of evidence, however often they stand
        theta = [field.potential(text, *s) / (1 if s[0] else often[text[s[1] : s[2]].lower()]) for s in found]
        belief = infer(field, theta, [s[0] for s in found], *edges(text, found))
        for (label, lo, hi), p in zip(found, belief, strict=True):
            best = int(p.argmax())
            if not label and best and p[best] >= SURE:
                out.append((best, lo, hi, False))
    return sorted(out)


def examples(text: str) -> list[tuple]:
    """Training rows of a text: (features, label, words, labels of the runs before, behind, of those with the key, withheld).

    Runs whose label is unknown are no rows and no neighbours. words: what stands before the run, as far as one is
    chained to the next, nearest last. Each gives a withheld row too, with the label of another span of its key if it has
    one.
    """
    base = base_spans(text)
    found = nodes(text, base)
    own = {key(text[lo:hi]) for _, lo, hi in base} - {None}
    label = [s[0] if s[0] else -2 if key(text[s[1] : s[2]]) in own or base_spans(text[s[1] : s[2]]) else 0 for s in found]
    chain, skip = edges(text, found)
    left = {b: a for a, b in chain}
    right = {a: b for a, b in chain}
    same: dict[int, int] = {}
    for c, i in skip:
        if label[c] == label[i] >= 0:
            same[i], same[c] = label[c], label[i]
    out = []
    for i, (y, (_, lo, hi)) in enumerate(zip(label, found, strict=True)):
        if y < 0:
            continue
        words, at = [], i
        while at in left and label[left[at]] == WORD:
            at = left[at]
            words.insert(0, text[found[at][1] : found[at][2]].lower())
        before = [label[left[i]]] if i in left and label[left[i]] >= 0 else []
        behind = [label[right[i]]] if i in right and label[right[i]] >= 0 else []
        out.append((shape(text, lo, hi), y, words[-CONTEXT:], before, behind, [], False))
        out.append((bare(text[lo:hi], y), y, words[-CONTEXT:], before, behind, [same[i]] if i in same else [], True))
        if len(out) >= NODES:
            break
    return out


FIELDS = ("on", "y", "words", "before", "behind", "same", "withheld")


def node_rows(batches):
    ints = pa.list_(pa.int32())
    kinds = pa.list_(pa.struct([("on", ints), ("y", pa.int32()), ("words", pa.list_(pa.string())), ("before", ints), ("behind", ints), ("same", ints), ("withheld", pa.bool_())]))
    for b in batches:
        made = [[dict(zip(FIELDS, x, strict=True)) for x in examples(t)] for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, kinds)], ["doc_id", "rows"])


#: What no sample may show: spans of each kind, plain numbers, and a repeat of each kind.
PRIOR = [("+1 (555) 555-0100", 4), ("192.168.0.1", 2), ("4111111111111111", 3), ("a.b@example.com", 1)]
PRIOR_PLAIN = ("1", "12", "2024", "3.14", "123456", "1234567", "12345678", "1234567890", "12345678901", "123456789012", "12345678901234", "1.2.3", "4111111111111112", "12-34", "2024-01-15", "12-345-678-90", "978-3-16-148410-0")
#: Shares of the withheld and of the prior rows in the fit, steps, rate, weight of the squares.
WITHHELD, PRIOR_SHARE, STEPS, RATE, RIDGE = 0.3, 0.1, 500, 2.0, 1e-4


def through(a: np.ndarray, psi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The message log sum over y of exp(a[y] + psi[y, k]) for each row, and its derivative by a[y] at each k."""
    z = a[:, :, None] + psi
    top = z.max(axis=1, keepdims=True)
    e = np.exp(z - top)
    total = e.sum(axis=1, keepdims=True)
    return (np.log(total) + top)[:, 0, :], e / total


def normed(free: np.ndarray) -> np.ndarray:
    """Log probabilities in each column."""
    e = np.exp(free - free.max(axis=0))
    return np.log(e / e.sum(axis=0))


def fit(documents: list[list[tuple]]) -> Field:
    """Gradient descent on the rows of all documents."""
    held_by = Counter(w for rows in documents for w in {w for r in rows for w in r[2]})
    words = {w: k for k, (w, n) in enumerate(sorted(held_by.items(), key=lambda x: (-x[1], x[0]))[:WORDS]) if n >= OFTEN}
    prior = [(shape(x, 0, len(x)), k, [], [], [], [], False) for x, k in PRIOR * 2] + [(shape(x, 0, len(x)), 0, [], [], [], [], False) for x in PRIOR_PLAIN]
    rows = [*prior, *[r for rs in documents for r in rs], *[(bare(x, k), k, [], [], [], [k], True) for x, k in PRIOR]]
    at, on = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows]), np.array([f for r in rows for f in r[0]], int)
    target = np.eye(LABELS)[[r[1] for r in rows]]
    before, behind, same = (np.array([np.bincount(r[k], minlength=LABELS) for r in rows], float) for k in (3, 4, 5))
    withheld = np.array([r[6] for r in rows])
    kind = np.where(withheld, 1, np.where(np.arange(len(rows)) < len(prior), 2, 0))
    weight = (np.array([1 - WITHHELD - PRIOR_SHARE, WITHHELD, PRIOR_SHARE]) / np.maximum(1, np.bincount(kind, minlength=3)))[kind][:, None]
    near = [np.array([words.get(r[2][-k], len(words)) if len(r[2]) >= k else -1 for r in rows], int) for k in (1, 2)]
    has = [np.flatnonzero(x >= 0) for x in near]
    node, word, free, pair, skip = np.zeros((N_FEATURES, LABELS)), np.zeros((len(words) + 1, LABELS)), 2 * np.eye(LABELS), np.zeros((LABELS, LABELS)), 0.0
    for _ in range(STEPS):
        cue = normed(free)
        z = before @ pair + behind @ pair.T + same * skip
        np.add.at(z, at, node[on])
        far, d_far = through(word[near[1][has[1]]], cue)
        own = np.zeros_like(z)
        own[has[0]] = word[near[0][has[0]]]
        own[has[1]] += far
        out, d_out = through(own[has[0]], cue)
        z[has[0]] += out
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = weight * (p / p.sum(axis=1, keepdims=True) - target)
        by_shape = np.zeros_like(node)
        np.add.at(by_shape, on, (g * ~withheld[:, None])[at])
        by_own = np.zeros_like(z)
        by_own[has[0]] = np.einsum("iyk,ik->iy", d_out, g[has[0]])
        by_cue = np.einsum("iyk,ik->yk", d_out, g[has[0]]) + np.einsum("iyk,ik->yk", d_far, by_own[has[1]])
        by_word = np.zeros_like(word)
        np.add.at(by_word, near[0][has[0]], by_own[has[0]])
        np.add.at(by_word, near[1][has[1]], np.einsum("iyk,ik->iy", d_far, by_own[has[1]]))
        node -= RATE * (by_shape + RIDGE * node)
        by_word[-1] = 0
        word -= RATE * (by_word + RIDGE * word)
        free -= RATE * (by_cue - np.exp(cue) * by_cue.sum(axis=0) + RIDGE * free)
        pair -= RATE * (before.T @ g + g.T @ behind + RIDGE * pair)
        skip -= RATE * ((same * g).sum() + RIDGE * skip)
    return Field(node, word, normed(free), pair, skip * np.eye(LABELS), words)


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fits the field on at most `sample` documents with a digit or an @, in the order of a hash of doc_id, of which the
    first NODES nodes are taken; of rows that share a doc_id, the text with the least hash."""
    small_batches(docs.sparkSession)
    marked = texts(docs).filter(F.col("text").rlike("[0-9@]"))
    picked = marked.select("doc_id").filter("doc_id is not null").distinct().orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(sample)
    one = marked.join(F.broadcast(picked), "doc_id", "left_semi").repartition(tasks_for(docs.sparkSession), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    kind = one.schema["doc_id"].dataType.simpleString()
    made = one.mapInArrow(node_rows, f"doc_id {kind}, rows array<struct<on: array<int>, y: int, words: array<string>, before: array<int>, behind: array<int>, same: array<int>, withheld: boolean>>")
    rows = sorted(made.collect(), key=lambda x: x["doc_id"])  # of at most `sample` documents, about NODES rows each
    return fit([[tuple(r[f] for f in FIELDS) for r in x["rows"]] for x in rows])


SPANS = "array<struct<kind: string, start: long, end: long, base: boolean>>"


def find_pii(docs: DataFrame, field: Field) -> DataFrame:
    """One row for each row of `docs`: doc_id, spans (kind, start, end in code points, base) by kind and start.

    Null and empty texts have no spans; null doc_ids and repeated rows stay; very long texts are searched in time that
    follows their length; an empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            spans = [[{"kind": KINDS[k - 1], "start": lo, "end": hi, "base": own} for k, lo, hi, own in all_spans(t, sent.value)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    rows = texts(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """`docs`, column by column, with each span of the text replaced by its kind in brackets.

    A null text stays null and an empty one empty; null doc_ids and repeated rows stay; very long texts are searched in
    time that follows their length; columns of any name stay as they are; an empty table stays empty.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(field)
    at = docs.columns.index("text")

    def clean(text: str | None) -> str | None:
        if text is None:
            return None
        out, end = [], 0
        for k, lo, hi, _ in sorted(all_spans(text, sent.value), key=lambda s: (s[1], -s[2])):
            if lo >= end:
                out += [text[end:lo], f"[{KINDS[k - 1].upper()}]"]
            end = max(end, hi)
        return "".join([*out, text[end:]]) if out else text

    def run(batches):
        for b in batches:
            row = b.column("row")
            new = pa.array([clean(t) for t in row.field(at).to_pylist()], pa.string())
            fields = [new if k == at else row.field(k) for k in range(row.type.num_fields)]
            kinds = [pa.field(f.name, new.type if k == at else f.type, f.nullable) for k, f in enumerate(row.type)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=kinds)], ["row"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, rows.schema).select("row.*")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
