import hashlib
import re

import pytest

from tests.llm import cases
from tidelog.llm.fingerprint import edited, edits, fingerprint_edits, fingerprints, likeness, parse, trees

NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


M = 2**64 - 1


def mixed(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ x >> 27) * 0x94D049BB133111EB & M
    return x ^ x >> 31


TABLE = [mixed((b + 1) * 0x9E3779B97F4A7C15 + 0x51ED & M) for b in range(256)]


def word_hash(word):
    return mixed(sum(TABLE[c] * pow(0x9E3779B97F4A7C15, k, 2**64) for k, c in enumerate(word)) + len(word) & M)


def written(text):
    """The fingerprint of a text, word by word: root:section/section, digest=paragraph,paragraph, digest-pieces."""
    sections, own = [], []
    for line in text.split("\n"):
        pieces, piece = [], []
        for w in re.findall(rb"[^\x20\x09-\x0D]+", line.encode()):
            h = word_hash(w)
            piece.append(mixed(h + mixed(len(piece) + 1) & M))
            if h % 4 == 0:
                pieces, piece = [*pieces, piece], []
        pieces += [piece] if piece else []
        digest = hashlib.blake2b(line.encode(), digest_size=8).hexdigest()
        own.append((digest, "".join(f"{mixed(sum(p) & M) >> 32:08x}" for p in pieces)))
        if int(digest, 16) >> 48 & 3 == 0:
            sections, own = [*sections, own], []
    sections += [own] if own else []
    digests = [hashlib.blake2b("".join(d for d, _ in ps).encode(), digest_size=8).hexdigest() for ps in sections]
    root = hashlib.blake2b("".join(digests).encode(), digest_size=16).hexdigest()
    return root + ":" + "/".join(d + "=" + ",".join(f"{p}-{x}" for p, x in ps) for d, ps in zip(digests, sections, strict=True))


def alike(a, b):
    """Likeness of two written fingerprints: pieces in common branches, taken away level by level, over all pieces."""
    if a.split(":")[0] == b.split(":")[0]:
        return 1.0
    split = lambda f: [(d, [tuple(p.split("-")) for p in ps.split(",")]) for s in f.split(":")[1].split("/") for d, ps in [s.split("=")]]
    weight = lambda ps: sum(max(1, len(x) // 8) for _, x in ps)
    left, right = split(a), split(b)
    total, same = sum(weight(ps) for _, ps in left + right), 0

    def without(x, y):
        """What both lists of (digest, ...) have in common, and what is left of each."""
        x, y, common = list(x), list(y), []
        for e in list(x):
            k = next((i for i, f in enumerate(y) if f[0] == e[0]), None)
            if k is not None:
                common.append(e)
                x.remove(e)
                y.pop(k)
        return common, x, y

    common, left, right = without(left, right)
    same += sum(weight(ps) for _, ps in common)
    common, left, right = without([p for _, ps in left for p in ps], [p for _, ps in right for p in ps])
    same += weight(common)
    cut = lambda ps: [(x[i : i + 8],) for _, x in ps for i in range(0, len(x), 8)]
    same += len(without(cut(left), cut(right))[0])
    return min(2 * same / total, 1.0 - 1e-9)


def brute(rows):
    order = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows), key=lambda x: (-x[0], x[1]))
    out = []
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        new = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = written(t), written(new), written(following)
        out.append((None if i == -(2**63) else i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, alike(a, b), alike(a, c)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("runs", [1, 7, 60])
def test_neighbours_and_edits(spark, sf, runs):
    plain, df = cases.sample(spark, sf)
    got = cases.collected(fingerprint_edits(df.repartition(3), runs), *NAMES)
    assert got == brute(plain)
    inner = [(x[5], x[6]) for x in got if x[1] > 400]
    assert sum(a > b for a, b in inner) > 0.9 * len(inner)


def test_odd_rows(spark):
    assert cases.collected(fingerprint_edits(cases.frame(spark), 5), *NAMES) == brute([(x[0], x[1]) for x in cases.rows()])
    assert fingerprint_edits(cases.empty(spark)).count() == 0
    one = spark.createDataFrame([(4, "abcd")], "doc_id long, text string")
    assert fingerprint_edits(one).first()["near_next"] == 1.0
    assert fingerprints(one).first()["fingerprint"] == trees(["abcd"])[0].text()


def test_trees_tell_equality_and_place_edits():
    a = "\n".join(f"paragraph {i} has some words of number {i * i}" for i in range(40))
    b = a.replace("paragraph 7 has", "paragraph 7 had").replace("number 900", "number 901")
    x, y = trees([a, b])
    assert parse(x.text()) == x and x.root != y.root and x.root == trees([a])[0].root
    assert edits(x, y) == [7, 30] and 0.8 < likeness(x, y) < 1
    assert likeness(*trees(["a b", "a  b"])) < 1 and likeness(*trees(["", ""])) == 1 and likeness(*trees(["", "x"])) == 0
    assert edited("abcde", "xy") == "abcxy" and edited("abcdef", "x") == "abcx"
