"""Operator 1: byte-level BPE encoding and decoding by backtracking over longest matches.

A piece of text is its UTF-8 bytes, seen as Latin-1 so that pyahocorasick can search it.  An
Aho-Corasick automaton gives the longest vocabulary entry that starts at every byte.  The
encoder takes the longest entry that is compatible with the one before it, falls back to
shorter prefixes, and steps back when none is left; a byte position that proved a dead end is
never tried again, so the work is linear in the piece.  Two adjacent entries are compatible
when undoing their merges never meets a merge of lower rank across the border; the answers
are memoised.  The result equals merging pairs by rank.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_groups

# Fixed value: the split pattern of the vocabulary (as in the vocabulary's own README).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Fixed value: white space as the split pattern sees it (Unicode White_Space).
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
# No match of PATTERN holds white space after a non-space, so a text may be cut there.
SEGMENT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

#: A worker's memory for ids of segments and of pieces, each, with so many bytes for an entry besides its text and ids.
CACHE_BYTES, ENTRY_BYTES = 48 << 20, 250
CACHE_CHARS = 48
PAIR_ENTRIES = 300_000
#: Texts are taken from Arrow memory in groups of up to so many characters.
GROUP_CHARS = 1 << 22


class Vocabulary:
    """Tokens by rank; ``merge`` maps a pair of ids to the id that they make."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.ids = {t: i for i, t in enumerate(tokens)}
        self.lengths = [len(t) for t in tokens]
        self.longest = ahocorasick.Automaton()
        for i, t in enumerate(tokens):
            self.longest.add_word(t.decode("latin-1"), (i, len(t)))
        self.longest.make_automaton()
        self.shorter = [self._prefix(t) for t in tokens]
        self.merge: dict[tuple[int, int], int] = {}
        self.split: list[tuple[int, int]] = []
        self.pairs: dict[tuple[int, int], bool] = {}
        for i, t in enumerate(tokens):
            left, found = self.shorter[i], (i, i)
            while left >= 0:
                right = self.ids.get(t[len(tokens[left]):], -1)
                if 0 <= right < i and left < i and self._compatible(left, right):
                    found = (left, right)
                    self.merge[found] = i
                    break
                left = self.shorter[left]
            self.split.append(found)
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.room = {id(self.pieces): CACHE_BYTES, id(self.words): CACHE_BYTES}
        self.find = regex.compile(PATTERN).findall

    def _prefix(self, token: bytes) -> int:
        for n in range(len(token) - 1, 0, -1):
            if (i := self.ids.get(token[:n], -1)) >= 0:
                return i
        return -1

    def _compatible(self, left: int, right: int) -> bool:
        """Would merging by rank leave the border between these two tokens alone?"""
        bound = len(self.tokens) + 1
        while True:
            if self.merge.get((left, right), bound) < bound:
                return False
            # undo the later of the two merges: the parts next to the border remain
            for side in ((0, 1) if left > right else (1, 0)):
                if side == 0:
                    inner = self.split[left][1] if left < len(self.split) else left
                    if inner != left:
                        bound, left = left, inner
                        break
                else:
                    inner = self.split[right][0] if right < len(self.split) else right
                    if inner != right:
                        bound, right = right + 1, inner
                        break
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            known = self.pairs[left, right] = self._compatible(left, right)
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ids.get(data)
        if whole is not None:
            return [whole]
        n, lengths, shorter, pairs = len(data), self.lengths, self.shorter, self.pairs
        longest = [-1] * n + [-1]
        for end, (i, size) in self.longest.iter(data.decode("latin-1")):
            longest[end + 1 - size] = i  # ends only grow, so the last one is the longest
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        last, at, token = -1, 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + lengths[token]
                if alive[end]:
                    fits = last < 0 or pairs.get((last, token))
                    if fits or (fits is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                last, at, token = token, end, longest[end]
            else:
                if not out:
                    raise ValueError("the vocabulary lacks a byte of the text")
                alive[at] = 0
                token = out.pop()
                at -= lengths[token]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.pieces.get
        for s in SEGMENT.findall(text):
            ids += known(s) or self.segment(s)
        return ids

    def _keep(self, cache: dict[str, tuple[int, ...]], text: str, ids: tuple[int, ...]) -> None:
        if len(text) <= CACHE_CHARS:
            room = self.room[id(cache)] - ENTRY_BYTES - 2 * len(text) - 8 * len(ids)
            if room < 0:
                cache.clear()
                room = CACHE_BYTES
            self.room[id(cache)] = room
            cache[text] = ids

    def segment(self, segment: str) -> tuple[int, ...]:
        known = self.pieces.get(segment)
        if known is None:
            known = tuple(i for p in self.find(segment) for i in self.known_piece(p))
            self._keep(self.pieces, segment, known)
        return known

    def known_piece(self, piece: str) -> tuple[int, ...]:
        known = self.words.get(piece)
        if known is None:
            known = tuple(self.piece(piece.encode()))
            self._keep(self.words, piece, known)
        return known

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def load_vocabulary(path: str) -> Vocabulary:
    """From a rank file: base64 of the token, blank, rank; ranks run from 0 without gaps."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return Vocabulary([ranks[i] for i in range(len(ranks))])


def bpe_encode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, ids array<int>`` for every row of ``df``; null or empty text: no ids.  Repeated
    rows stay repeated; other columns of ``df`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load_vocabulary(vocab_path)
        for b in batches:
            for lo, texts in text_groups(b.column(1), GROUP_CHARS):
                ids = pa.array([v.encode(t or "") for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(texts)), ids], names=[id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def bpe_decode(df: DataFrame, vocab_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``id_col, bytes binary`` for every row; null or empty ids: no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load_vocabulary(vocab_path)
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                out = pa.array([v.decode(x or []) for x in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=[id_col, "bytes"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, bytes binary")


def bpe_round_trip(df: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass and returns digests of both, so that neither
    ids nor bytes leave the Python worker: ``id_col, n_tokens long, ids_sha256 string,
    decoded_sha256 string``.  Null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load_vocabulary(vocab_path)
        numeral = [str(i) for i in range(len(v.tokens))]
        for b in batches:
            counts, digests, back = [], [], []
            for t in (t for _, texts in text_groups(b.column(1), GROUP_CHARS) for t in texts):
                ids = v.encode(t or "")
                counts.append(len(ids))
                digests.append(hashlib.sha256(" ".join(map(numeral.__getitem__, ids)).encode()).hexdigest())
                back.append(hashlib.sha256(v.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(back, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
