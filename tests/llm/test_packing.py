import zlib
from array import array
from collections import Counter, defaultdict

from tests.llm import cases
from tidelog.llm.packing import pack, plan


def ids_of(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    if not hasattr(ids_of, "t"):
        ids_of.t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [*ids_of.t.encode(text or "", add_special_tokens=False).ids, 0]


def check(out, want, capacity=2048):
    """want: (doc_id, ids) in any order; every document is there in pieces that cover it, and sequences have no gap."""
    pieces = []
    for i, ids in want:
        n, lo = len(ids), 0
        for p in range(-(-n // capacity)):
            hi = (n % capacity or capacity) + p * capacity
            pieces.append((i, p, lo, hi - lo, zlib.crc32(array("I", ids[lo:hi]).tobytes())))
            lo = hi
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out) == Counter(pieces)
    by = defaultdict(list)
    for x in out:
        by[x.sequence_id].append((x.offset, x.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by), sum(p[3] for p in pieces)


def test_ordinary_documents(spark, sf):
    plain, df = cases.sample(spark, sf)
    n, total = check(pack(df).collect(), [(i, ids_of(t)) for i, t in plain])
    assert n <= -(-total // 2048) * 1.02 + 1


def test_odd_rows(spark):
    check(pack(cases.frame(spark)).collect(), [(x[0], ids_of(x[1])) for x in cases.rows()])
    assert pack(cases.empty(spark)).count() == 0


def best_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, f in enumerate(free) if f >= n]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= n
        else:
            free.append(capacity - n)
    return len(free)


def test_plan_is_best_fit():
    import random

    r = random.Random(4)
    for _ in range(30):
        lengths = [r.randint(1, 50) for _ in range(r.randint(1, 300))]
        steps = plan(dict(Counter(lengths)), 50)
        assert len({s for _, lo, hi, first, _ in steps for s in range(first, first + hi - lo)}) == best_fit(lengths, 50)
    assert len(plan({n: 10**9 + 7 * n for n in range(1, 2049)}, 2048)) < 20_000
