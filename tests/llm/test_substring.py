import hashlib

import numpy as np

from tests.llm import cases
from tests.llm.test_rows import words
from tidelog.llm import substring
from tidelog.llm.substring import drop_repeats, pack, unpack


def brute(rows, width=20):
    first = {}
    rank = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - width + 1):
            k = tuple(w[s : s + width])
            first[k] = min(first.get(k, (rank(i), s)), (rank(i), s))
    out = []
    for i, t in rows:
        w = words(t)
        gone = set()
        for s in range(len(w) - width + 1):
            if first[tuple(w[s : s + width])] != (rank(i), s):
                gone |= set(range(s, s + width))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, left.decode(), len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


def test_gaps():
    x = np.unique(np.random.default_rng(1).integers(0, 1 << 24, 300))
    assert (unpack(pack(x)) == x).all() and len(unpack(pack(x[:0]))) == 0
    assert (unpack(pack(np.array([0, 0, 65535, 65535, 131070]))) == [0, 0, 65535, 65535, 131070]).all()


def test_against_brute_force(spark, sf):
    plain, df = cases.sample(spark, sf)
    got = cases.collected(drop_repeats(df), *substring.DONE.names)
    assert got == brute(plain)
    assert sum(x[3] for x in got) > 0


def test_crowded_sketch_loses_nothing(spark, sf, monkeypatch):
    plain, df = cases.sample(spark, sf, 60)
    small = drop_repeats(df, width=4, chunk_bytes=20_000, block_windows=500)
    assert cases.collected(small, *substring.DONE.names) == brute(plain, 4)


def test_odd_rows(spark):
    rows = [(x[0], x[1]) for x in cases.rows()]
    assert cases.collected(drop_repeats(cases.frame(spark)), *substring.DONE.names) == brute(rows)
    assert drop_repeats(cases.empty(spark)).count() == 0
