"""Token counts by a public byte-level BPE vocabulary, in Arrow functions that return lengths only.

``encode`` gives exactly the ids of the library's own ``encode(text, add_special_tokens=False)``:

* A long text is cut into segments at safe boundaries: a single space between two characters that are no white
  space. The vocabulary's pattern lets a piece begin, never end, with one space, so no piece crosses such a place.
* Inside a segment the same boundaries give chunks (a word with its marks and its leading space). For counts, the
  chunks of a batch that are new to the worker are encoded together, and their lengths are remembered in a bounded
  table; so each is encoded once per worker and not once per occurrence.
* For ids, chunks of characters below U+0250 go to the rank file of the same vocabulary, which is the faster of the
  two libraries; all others, and any chunk that holds a special string, go to the library of the ``.json`` file.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import small_batches

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Characters in a segment of a long text, characters in a remembered chunk, chunks remembered, bytes in a batch.
SEGMENT, LONGEST, REMEMBERED, BATCH_BYTES = 1 << 18, 48, 400_000, 1 << 22
SAFE = re.compile(r"(?<=\S) (?=\S)")
DOUBLE = re.compile(r"\s\s").search
PLAIN = re.compile("[\x00-ɏ]*").fullmatch


class Encoder(dict):
    """Chunk -> its ids as little-endian 32-bit bytes. As a mapping it holds chunks without their leading space."""

    def __init__(self, vocabulary: str = VOCABULARY, ranks: str | None = RANKS):
        import base64

        import public_tokenizers
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks:
            import tiktoken

            with open(public_tokenizers.path(ranks), "rb") as lines:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    def plain(self, chunk: str) -> bytes:
        if self.fast is not None and PLAIN(chunk) and not any(s in chunk for s in self.special):
            return array("I", self.fast.encode_ordinary(chunk)).tobytes()
        return array("I", self.library.encode(chunk, add_special_tokens=False).ids).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        ids = self.plain(" " + chunk)
        if len(chunk) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    def segments(self, text: str) -> Iterator[list[str]]:
        """Lists of chunks; joined by one space each, and the lists by one space, they are the text."""
        at, n = 0, len(text)
        while True:
            found = SAFE.search(text, at + SEGMENT) if n - at > SEGMENT else None
            part = text[at : found.start()] if found else text[at:]
            yield SAFE.split(part) if DOUBLE(part) else part.split(" ") if part[:1] != " " and part[-1:] != " " else SAFE.split(part)
            if not found:
                return
            at = found.end()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out, look = [], self.__getitem__
        for k, chunks in enumerate(self.segments(text)):
            out.append(look(chunks[0]) if k else self.plain(chunks[0]))
            out.extend(map(look, chunks[1:]))
        return b"".join(out)


class Lengths:
    """Numbers of tokens of whole batches of texts.

    A batch is cut into chunks at safe boundaries; the chunks that no batch before had are encoded in one call of the
    library, and only their lengths are remembered.
    """

    def __init__(self, coder: Encoder):
        self.coder, self.inner, self.heads = coder, {}, {}  # chunks behind a space, and chunks that begin a text

    def learn(self, memory: dict[str, int], chunks: set[str], lead: str) -> None:
        new = list(chunks)
        made = self.coder.library.encode_batch_fast([lead + c for c in new], add_special_tokens=False)
        memory.update(zip(new, map(len, made), strict=True))

    def __call__(self, values: list[str]) -> list[int]:
        if len(self.inner) + len(self.heads) > REMEMBERED:
            self.inner, self.heads = {}, {}
        cut = [[chunks for chunks in self.coder.segments(text)] if text else [] for text in values]
        inner = {c for segments in cut for k, chunks in enumerate(segments) for c in (chunks if k else chunks[1:])}
        self.learn(self.inner, inner - self.inner.keys(), " ")
        self.learn(self.heads, {segments[0][0] for segments in cut if segments} - self.heads.keys(), "")
        look, out = self.inner.__getitem__, []
        for segments in cut:
            n = self.heads[segments[0][0]] if segments else 0
            for k, chunks in enumerate(segments):
                n += sum(map(look, chunks if k else chunks[1:]))
            out.append(n)
        return out


_ENCODERS: dict[tuple, Encoder] = {}
_LENGTHS: dict[str, Lengths] = {}


def encoder(vocabulary: str = VOCABULARY, ranks: str | None = RANKS) -> Encoder:
    """One for each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task is one thread
    key = (vocabulary, ranks)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(vocabulary, ranks)
    return _ENCODERS[key]


def lengths(vocabulary: str = VOCABULARY) -> Lengths:
    """One for each Python worker."""
    if vocabulary not in _LENGTHS:
        _LENGTHS[vocabulary] = Lengths(encoder(vocabulary, None))
    return _LENGTHS[vocabulary]


def by_bytes(batch: pa.RecordBatch, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `limit` bytes of text each, so that memory follows bytes and not rows."""
    lengths = pc.binary_length(batch.column("text")).to_pylist()
    lo = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(lo, i - lo)
            lo, size = i, 0
        size += n or 0
    yield batch.slice(lo)


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = 1024) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty (0 bytes, 0 tokens); a null doc_id stays null; repeated rows each give a row; other
    columns of `docs` are neither read nor returned. Very long texts are encoded segment by segment.
    """
    small_batches(docs.sparkSession)

    def count(batches):
        count_all = lengths(vocabulary)
        for whole in batches:
            for b in by_bytes(whole):
                n = pa.array(count_all(b.column("text").to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), n], ["doc_id", "n_tokens"]).append_column("n_bytes", pc.binary_length(b.column("text").cast(pa.large_binary())).cast(pa.int64()))

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    out = rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, n_bytes long")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
