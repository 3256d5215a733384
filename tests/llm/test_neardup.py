import random

import numpy as np

from tests.llm import cases
from tests.llm.test_rows import words
from tidelog.llm.components import components
from tidelog.llm.neardup import banding, consensus, near_duplicates, open_pairs, sketches


def brute(rows, k, num, den):
    lower = lambda t: [x.lower() for x in words(t)]  # noqa: E731  (bytes: A-Z only)
    sets = []
    for _, t in rows:
        w = lower(t)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                up[root(i)] = root(j)
    rank = lambda i: -(2**63) if i is None else i
    least = {}
    for n, (i, _) in enumerate(rows):
        least[root(n)] = min(least.get(root(n), rank(i)), rank(i))
    out = []
    for n, (i, _) in enumerate(rows):
        c = least[root(n)] if sets[n] else rank(i)
        out.append((i, len(sets[n]), None if c == -(2**63) else c, rank(i) == c))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_shingles", "component_id", "kept")


def test_bands_miss_little():
    for t in (0.8, 0.85):
        bands, rows = banding(t)
        assert (1 - t**rows) ** bands <= 1e-6 and bands * rows <= 160


def test_sketch_agreement_is_similarity():
    r = np.random.default_rng(3)
    base = np.unique(r.integers(0, 1 << 62, 400).astype(np.uint64))
    a, b = base[:300], base[60:360]
    v = sketches([a, b, a[:1], a[:0]], 500)
    assert abs((v[0] == v[1]).mean() - 240 / 360) < 0.08
    assert (v[2] != np.iinfo(np.uint64).max).all()


def test_ordinary_documents(spark, sf):
    plain, df = cases.sample(spark, sf)
    for k, num in ((3, 85), (5, 80)):
        assert cases.collected(near_duplicates(df, k, num, 100), *NAMES) == brute(plain, k, num, 100)


def test_circle_of_near_copies(spark):
    r = random.Random(2)
    base = [f"w{r.randint(0, 900)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 7)):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[], [w[at] + "x"], [f"n{r.randint(0, 3)}"], [w[at], "more"]])
        rows.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = cases.collected(near_duplicates(df, 3, 85, 100), *NAMES)
    assert got == brute(rows, 3, 85, 100)
    assert 1 < len({x[2] for x in got}) < 150


def test_bounds_leave_every_link_open(spark):
    r = random.Random(4)
    circles, sets = [], {}
    for hub, size in (("a", 500), ("b", 1000), ("c", 1700), ("d", 3000)):
        core = [r.getrandbits(62) for _ in range(size)]
        passages = [[r.getrandbits(62) for _ in range(r.randint(2, size // 60))] for _ in range(20)]
        for i in range(60):
            own = set(core[: r.randint(size * 88 // 100, size * 96 // 100)])  # nested, so that the bounds are met
            common = len(own)
            for p in r.sample(passages, 2):
                own |= set(p)
            own |= {r.getrandbits(62) for _ in range(r.randint(size * 4 // 100, size * 11 // 100))}
            node = f"{hub}{i:02}"
            sets[node] = own
            circles.append((hub, node, node, len(own), common, sorted(own - set(core))))
    members, extras = consensus(spark.createDataFrame(circles, "hub string, node string, label string, s long, common long, extra array<long>"))
    for num in (80, 85):
        found = {frozenset(x) for x in open_pairs(members, extras, num, 100).collect()}
        linked = lambda a, b: 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])  # noqa: E731, B023
        want = {frozenset((a, b)) for a in sets for b in sets if a < b and a[0] == b[0] and linked(a, b)}
        assert want <= found and 50 < len(want) and len(found) < 4 * 60 * 59 // 2, (num, len(want), len(found), len(want - found))


def test_odd_rows(spark):
    rows = [(x[0], x[1]) for x in cases.rows()]
    assert cases.collected(near_duplicates(cases.frame(spark), 3, 85, 100), *NAMES) == brute(rows, 3, 85, 100)
    assert near_duplicates(cases.empty(spark)).count() == 0


def test_components(spark):
    e = [(1, 2), (2, 3), (3, 1), (9, 8), (8, 7), (7, 6), (6, 5), (20, 20)] + [(100 + i, 101 + i) for i in range(30)]
    got = dict(map(tuple, components(spark.createDataFrame(e, "a long, b long")).collect()))
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5} | {100 + i: 100 for i in range(31)}
