import hashlib
import random
import re

import numpy as np
import pytest

from tests.llm import cases
from tidelog.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            d = [int(c) for c in re.findall("[0-9]", m[0])]
            odd = [x * 2 - 9 * (x > 4) for x in d[-2::-2]]
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                "card": 16 <= len(d) <= 19 and (sum(odd) + sum(d[-1::-2])) % 10 == 0,
                "phone": 8 <= len(d) <= 15,
            }[kind]
            if ok:
                out.append((k + 1, m.start(), m.end()))
    return out


def test_base_patterns(sf, spark):
    plain, _ = cases.sample(spark, sf)
    made = ["a@b@c.d", "x@y", "é.a@b-c.de.fg, a@b.c@d.e", "1.2.3.4.5.6.7.8 300.1.1.1 0255.000001.2.3", "+1 (2) 3 4 5 6 7 8-9 +12", "4111 1111-1111 1111 5", "4111-1111-1111-1111", "+491234567890123456", "@a.b a..@c.d"]
    for text in [t or "" for _, t in plain] + made + [x[1] or "" for x in cases.rows()]:
        assert pii.base_spans(text) == brute(text)


@pytest.fixture(scope="module")
def field(spark):
    return pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def added(text, field):
    return {text[lo:hi] for _, lo, hi, own in pii.all_spans(text, field) if not own}


def test_distant_repeats_take_the_label(field):
    once = "Call +1 (366) 555-9807 today. " + "plain words " * 200
    assert added(once + "or write to 366-555-9807 soon", field) == {"366-555-9807"}
    assert added("some words or write to 366-555-9807 soon", field) == set()
    assert added("in 2024 there were 12345 of 17 items, 3.14 each", field) == set()
    assert added("card 4111111111111111 4111111111111111 ok", field) == {"4111111111111111"}
    assert added("token 2321bac4111111111111111d15ec8f90 ok", field) == set()


def test_many_repeats_take_the_label(field):
    for n in (5, 12, 40):
        text = "Call +1 (366) 555-9807 today. " + "plain words and 366-555-9807 again, " * n
        spans = pii.all_spans(text, field)
        assert [text[lo:hi] for kind, lo, hi, own in spans if kind == 4 and not own] == ["366-555-9807"] * n
        assert pii.all_spans("plain words and 366-555-9807 again, " * n, field) == []


def made_field(**parts):
    """A field with zero weights but for the given parts."""
    zero = {"node": (pii.N_FEATURES, pii.LABELS), "word": (1, pii.LABELS), "cue": (pii.LABELS,) * 2, "pair": (pii.LABELS,) * 2, "skip": (pii.LABELS,) * 2}
    return pii.Field(**({k: np.zeros(v) for k, v in zero.items()} | {"words": {}} | parts))


def test_repeats_that_lean_to_plain_take_the_label():
    for lean in (0.5, 1, 2, 3):
        plain = np.zeros(pii.LABELS)
        plain[0] = lean
        f = made_field(skip=10 * np.eye(pii.LABELS))
        for n in (5, 12, 40, 1000):
            text = "+1 (366) 555-9807" + " or 366-555-9807" * n
            found = pii.nodes(text, pii.base_spans(text))
            assert sum(s[0] != pii.WORD for s in found) == n + 1
            belief = pii.infer(f, [np.zeros(pii.LABELS) if s[0] else plain for s in found], [s[0] for s in found], *pii.edges(text, found))
            runs = belief[[k for k, s in enumerate(found) if not s[0]]]
            assert (runs.argmax(axis=1) == 4).all() and (runs[:, 4] >= pii.SURE).all()


def test_message_passing_is_exact_on_a_chain():
    r = np.random.default_rng(1)
    f = made_field(cue=r.normal(size=(pii.LABELS,) * 2), pair=r.normal(size=(pii.LABELS,) * 2))
    theta = r.normal(size=(3, pii.LABELS))  # a word, a run, a run
    p = np.zeros((3, pii.LABELS))
    for y in np.ndindex(*(pii.LABELS,) * 3):
        s = np.exp(sum(theta[i, y[i]] for i in range(3)) + f.cue[y[0], y[1]] + f.pair[y[1], y[2]])
        for i in range(3):
            p[i, y[i]] += s
    got = pii.infer(f, list(theta), [pii.WORD, 0, 0], [(0, 1), (1, 2)], [])
    assert np.allclose(got, p / p.sum(axis=1, keepdims=True), atol=0.01)


def numbers_in_context(n, seed):
    """Texts whose bare ten-digit numbers are telephone numbers after some words and order numbers after others."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    out = []
    for _ in range(n):
        a, b, c = digits(3), digits(3), digits(4)
        full = f"+1 ({a}) {b}-{c}"
        out.append(f"{r.choice(['reach me at', 'dial', 'please ring'])} {full} . then {r.choice(['order', 'invoice', 'parcel'])} {digits(10)} came" + (f" and again dial {full} ok" if r.random() < 0.4 else ""))
    return out


def loss(field, texts):
    """Mean log loss on runs whose marks and label are withheld, all others of their text as they are."""
    total = []
    for text in texts:
        base = pii.base_spans(text)
        found = pii.nodes(text, base)
        for i, (label, lo, hi) in enumerate(found):
            if label == pii.WORD:
                continue
            theta = [field.potential(text, *s) for s in found]
            theta[i] = field.node[pii.bare(text[lo:hi], label)].sum(axis=0)
            fixed = [0 if k == i else s[0] for k, s in enumerate(found)]
            hidden = [(0, *s[1:]) if k == i else s for k, s in enumerate(found)]
            total.append(-np.log(pii.infer(field, theta, fixed, *pii.edges(text, hidden))[i, max(label, 0)]))
    return float(np.mean(total))


def test_learned_weights_beat_constants_on_held_out_texts():
    learned = pii.fit([pii.examples(t) for t in numbers_in_context(300, 1)])
    held_out = numbers_in_context(150, 2)
    constants = pii.Field(learned.node, learned.word, np.zeros_like(learned.cue), np.zeros_like(learned.pair), 6.0 * np.eye(pii.LABELS), learned.words)
    no_skip = pii.Field(learned.node, learned.word, learned.cue, learned.pair, np.zeros_like(learned.skip), learned.words)
    got = loss(learned, held_out)
    print("log loss held out:", got, "constants:", loss(constants, held_out), "without skips:", loss(no_skip, held_out))
    assert got < 0.6 * loss(constants, held_out) and got < loss(no_skip, held_out)


def test_very_long_texts_take_time_by_their_length(field):
    import time

    n = 1_000_000
    for text in ("1" * n, "a1" * (n // 2), "1." * (n // 2), "(1" * (n // 2), "a" * n + "@", "+1" + "(" * n, "a@" * (n // 20), "1 " * (n // 10), "x" * n + " a.b@c.de"):
        began = time.time()
        pii.all_spans(text, field)
        assert time.time() - began < 20
    assert pii.base_spans("9" * n + ".1.2.3 4.3.2.1") == [(2, n + 7, n + 14)]


def test_query_rows(spark, sf):
    out = queries.op3_personal_data(spark, sf).collect()
    text = {x.doc_id: x.text for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert len(out) == len(text)
    for x in out:
        base = brute(text[x.doc_id])
        line = ",".join(f"{pii.KINDS[k - 1]}:{lo}:{hi}" for k, lo, hi in base)
        assert x.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(b[0] == k for b in base) for k in (1, 2, 3, 4)]
        assert set(filter(None, line.split(","))) <= set(x.spans.split(","))


def test_odd_rows_and_redaction(spark, field):
    assert pii.find_pii(cases.frame(spark), field).count() == len(cases.rows())
    assert pii.train(cases.empty(spark)).node.shape == (pii.N_FEATURES, pii.LABELS)
    df = spark.createDataFrame([(1, "mail a.b@c.de or +1 (366) 555-9807, ok", 3), (2, None, 4)], "doc_id long, text string, n_chars long")
    assert pii.redact(df, field).collect() == [(1, "mail [EMAIL] or [PHONE], ok", 3), (2, None, 4)]
