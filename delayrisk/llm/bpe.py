"""Byte-level BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoding reads a text in blocks.  The splitting pattern looks at most two
characters past a match, so matches that end earlier are final.  Inside one
(possibly endless) word the merge list itself bounds how far unread
bytes can still change tokens: ``lookahead`` computes that bound once, and every token that
ends at least so many bytes before what has been read is emitted.  Memory is
one block, the lookahead and a cache of words of fixed size.  Decoding turns
ids into bytes and these, by an incremental UTF-8 state machine, into text.

Why the bound holds: let two continuations follow the same read bytes, and
call the left end of what differs between their token sequences the frontier;
it starts at the last read byte.  Merges apply in rank order, so each rank
moves the frontier at most once, by the left token of its merge, and only if the token that
begins at the frontier is the merge's right part.  ``lookahead`` takes the
largest sum over all ranks, keeping for each token how far left a frontier
that begins with it can have come.

Defined cases: a null or empty text has no ids and decodes to the empty
text; added tokens of the vocabulary's file are matched in the text first, as
the library does; ids that make no valid UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .buffers import slices
from .common import arrow_map, fresh

# Fixed value: the pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of plain characters only (no "_", no digits or spaces beyond ASCII),
#: for which the standard library's classes agree and are faster.
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|\s+(?!\S)|\s+")
ODD = re.compile("[^\t-\r -^`-~¡-©«-±´¶-¸»¿-ɏ]")
FULL = regex.compile(PATTERN)
BLOCK = 1 << 16    # characters read at a time
EDGE = 3           # characters at a block's end that matches may still depend on
WORDS = 1 << 18    # words kept in the cache
SLICE = 1 << 20    # bytes of texts that are held as Python's at once, if no text is longer
LONG = 256         # bytes of a word beyond which it is neither cached nor read at once


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies.

    Printable Latin-1 characters stand for themselves, all other bytes for the
    code points from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes after a token that suffice to make it final."""
    reach: dict[bytes, int] = {bytes([b]): 0 for b in range(256)}
    for a, b in merges:
        ab = a + b
        come = reach.get(b)
        here = reach.get(a)
        if come is not None:      # the frontier moves over a; with or without the merge, a or ab begins there
            moved = come + len(a)
            reach[a] = max(reach.get(a, 0), moved)
            reach[ab] = max(reach.get(ab, 0), moved)
        if here is not None:      # the frontier stays, the token at it grows
            reach[ab] = max(reach.get(ab, 0), here)
    return max(reach.values(), default=0) + max((len(a) + len(b) for a, b in merges), default=1)


@dataclass
class Vocabulary:
    ids: dict[bytes, int]
    rank: dict[tuple[int, int], int]   # pair of ids -> rank
    merged: list[int]                  # id that the merge of a rank makes
    added: list[tuple[str, int]]
    ahead: int

    def __post_init__(self):
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.added}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.special = re.compile("|".join(re.escape(t) for t, _ in sorted(self.added, key=lambda x: -len(x[0])))) \
            if self.added else None
        self.added_ids = dict(self.added)
        self.cache: dict[str, bytes] = {}

    def merge(self, ids: list[int]) -> list[int]:
        """Apply the merges to a sequence of ids, lowest rank first, leftmost first."""
        rank, none = self.rank.get, len(self.merged)
        ids = list(ids)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            k = ranks.index(best)
            ids[k:k + 2] = (self.merged[best],)
            del ranks[k]
            # Only the neighbours of the new token have other pairs than before.
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), none)
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), none)
        return ids

    def long_word(self, data: bytes) -> Iterator[int]:
        """Ids of a long word: read in steps, emitting tokens once they are final."""
        step = max(4 * self.ahead, LONG)
        at, n = 0, len(data)
        while at < n:
            end = min(at + step + self.ahead, n)
            got = self.merge([self.single[b] for b in data[at:end]])
            if end == n:
                yield from got
                return
            last = end - self.ahead
            for i in got:
                size = len(self.bytes_of[i])
                if at + size > last:
                    break
                at += size
                yield i

    def word(self, text: str) -> bytes:
        """Ids of one word, as little-endian unsigned 32-bit integers."""
        data = text.encode()
        if len(data) > LONG:
            return np.fromiter(self.long_word(data), "<u4").tobytes()
        whole = self.ids.get(data)
        ids = self.merge([self.single[b] for b in data]) if whole is None or len(data) > 1 else [whole]
        return np.array(ids, "<u4").tobytes()

    def known(self, text: str) -> bytes:
        got = self.cache.get(text)
        if got is None:
            got = self.word(text)
            if len(text) <= LONG:
                if len(self.cache) >= WORDS:
                    self.cache.clear()
                self.cache[text] = got
        return got

    def plain(self, text: str) -> Iterator[bytes]:
        """Ids of a text without added tokens, block by block."""
        at, n, size = 0, len(text), BLOCK
        while at < n:
            block = text[at:at + size]
            final = at + size >= n
            find = FULL if ODD.search(block) else PLAIN
            if final:
                yield b"".join(map(self.known, find.findall(block)))
                return
            end, words = 0, []
            for m in find.finditer(block):
                if m.end() > len(block) - EDGE:
                    break
                words.append(m[0])
                end = m.end()
            if not end:
                size *= 2     # one word longer than the block: read on
                continue
            yield b"".join(map(self.known, words))
            at, size = at + end, BLOCK

    def encode(self, text: str | None) -> Iterator[bytes]:
        """Ids of a whole text, in pieces of little-endian unsigned 32-bit integers."""
        text = text or ""
        if self.special is None or not self.special.search(text):
            yield from self.plain(text)
            return
        at = 0
        for m in self.special.finditer(text):
            yield from self.plain(text[at:m.start()])
            yield np.array([self.added_ids[m[0]]], "<u4").tobytes()
            at = m.end()
        yield from self.plain(text[at:])

    def decode(self, pieces: Iterable[bytes]) -> Iterator[str]:
        """Text of ids given in pieces, by an incremental UTF-8 decoder."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for piece in pieces:
            for k in range(0, len(piece), 1 << 18):
                ids = np.frombuffer(piece, "<u4", offset=k, count=min(1 << 16, (len(piece) - k) // 4)).tolist()
                yield machine.decode(b"".join(map(self.bytes_of.__getitem__, ids)))
        yield machine.decode(b"", True)


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    """Read a byte-level BPE vocabulary (tokenizers' JSON file); a worker keeps it."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = byte_letters()
    raw = lambda token: bytes(letters[c] for c in token)
    added = [(t["content"], t["id"]) for t in spec.get("added_tokens", [])]
    names = {t for t, _ in added}
    ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in names}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    merges = [(raw(a), raw(b)) for a, b in pairs]
    rank: dict[tuple[int, int], int] = {}
    for r, (a, b) in enumerate(merges):
        rank.setdefault((ids[a], ids[b]), r)
    return Vocabulary(ids, rank, [ids[a + b] for a, b in merges], added, lookahead(merges))


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Replace the text column by ``out``, the array of its ids."""
    kept = [c for c in docs.columns if c != text]
    name = fresh(docs, out)

    def apply(batches):
        v = load(path)
        for b in (part for batch in batches for part in slices(batch, text, SLICE)):
            parts = [b"".join(v.encode(t)) for t in b.column(text).to_pylist()]
            ends = np.cumsum([0] + [len(p) // 4 for p in parts]).astype(np.int32)
            flat = np.frombuffer(b"".join(parts), "<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept),
                                              pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*kept, name])
    return arrow_map(docs, apply, StructType([docs.schema[c] for c in kept] + [StructField(name, ArrayType(IntegerType()))]))


def decode(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Replace the ids column by ``out``, their text; null ids count as none."""
    kept = [c for c in rows.columns if c != ids]
    name = fresh(rows.drop(ids), out)

    def apply(batches):
        v = load(path)
        for b in batches:
            texts = ["".join(v.decode([np.array(x or [], "<u4").tobytes()])) for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(texts, pa.string())], names=[*kept, name])
    return arrow_map(rows, apply, StructType([rows.schema[c] for c in kept] + [StructField(name, StringType())]))


def round_trip(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass over blocks: other columns, n_tokens, ids_sha256, decoded_sha256.

    Neither the ids nor the decoded text of a document are ever held whole.
    """
    kept = [c for c in docs.columns if c != text]

    def digests(v, t):
        count, ids, back = 0, hashlib.sha256(), hashlib.sha256()

        def pieces():
            nonlocal count
            for p in v.encode(t):
                count += len(p) // 4
                ids.update(p)
                yield p
        for s in v.decode(pieces()):
            back.update(s.encode())
        return count, ids.hexdigest(), back.hexdigest()

    def apply(batches):
        v = load(path)
        for b in (part for batch in batches for part in slices(batch, text, SLICE)):
            got = [digests(v, t) for t in b.column(text).to_pylist()]
            n, i, d = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(n, pa.int64()), pa.array(i, pa.string()),
                                              pa.array(d, pa.string())], names=[*kept, "n_tokens", "ids_sha256", "decoded_sha256"])
    fields = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    return arrow_map(docs, apply, StructType([docs.schema[c] for c in kept] + fields))
