import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidelog.llm import kernel
from tidelog.llm.substring import pack, unpack

TEXT = st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab A\t\n\x0b\x1c\xa0é漢🙂.,"), max_size=40)), max_size=12)
WORDS = re.compile(rb"[^\x20\x09-\x0D]+")


@settings(max_examples=200, deadline=None)
@given(TEXT, st.integers(1, 60), st.integers(1, 4))
def test_words_and_windows_are_those_of_each_row(values, block, k):
    old, kernel.BLOCK = kernel.BLOCK, block
    try:
        column = pa.array(["skipped", *values], pa.string()).slice(1)
        seen, by_hash, by_words = 0, {}, {}
        for x in kernel.blocks(column):
            starts, ends, before = x.words()
            h = x.word_hashes(starts, ends, lower=True)
            w, first = kernel.windows(h, before, k)
            row_of = np.searchsorted(before, first, "right") - 1
            for r in range(x.hi - x.lo):
                want = WORDS.findall((values[x.lo + r] or "").encode())
                assert [bytes(x.bytes[a:b]) for a, b in zip(starts[before[r] : before[r + 1]], ends[before[r] : before[r + 1]], strict=True)] == want
                low = [v.lower() for v in want]
                got = [(int(f - before[r]), int(v)) for f, v, q in zip(first, w, row_of, strict=True) if q == r]
                assert [f for f, _ in got] == list(range(max(0, len(want) - k + 1)))
                for f, v in got:
                    key = tuple(low[f : f + k])
                    assert by_hash.setdefault(v, key) == key and by_words.setdefault(key, v) == v
            seen = x.hi
        assert seen == len(values)
    finally:
        kernel.BLOCK = old


@given(st.lists(st.integers(0, (1 << 24) - 1), max_size=50))
def test_gaps_round_trip(values):
    x = np.sort(np.array(values, np.int64))
    assert (unpack(pack(x)) == x).all()


def test_prefixes_and_long_words():
    x = next(kernel.blocks(pa.array(["abcdef abcxyz " + "q" * 9000 + " " + "q" * 9001])))
    starts, ends, _ = x.words()
    whole, three = x.word_hashes(starts, ends), x.word_hashes(starts, ends, prefix=3)
    assert len(set(whole.tolist())) == 4 and three[0] == three[1] and three[2] == three[3]
