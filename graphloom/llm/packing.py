"""Operator 9: bulk-synchronous best-fit packing of token sequences.

Documents (pieces of up to ``capacity`` tokens) and gaps (what is left of open sequences) are range-sorted together by falling
size, a gap before the pieces that just fit it.  A sweep matches every piece with its successor, the smallest gap that holds it and that no
larger piece took: like closing brackets with opening ones.  Each range is swept for itself, and gaps come back with what is left of them as far as
the range goes.  What a range leaves over, pieces
without a gap and gaps without a piece, meets by rank: the running difference of both numbers them so that equal numbers belong together,
and conflicts between ranges never gather in one place.  Then the gaps shrink and the next round begins.

Pieces that are larger than every gap open sequences, class by class: those over a half of the capacity one each, those over a
third two, and so on; where all that is left fits one range, its sweep opens them.  Small pieces, up to a 32nd of the capacity, are first bundled in the order of their length, so that the number of rounds depends
on the capacity and not on the number of pieces.
"""

from __future__ import annotations

import heapq
import re
import string
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, sums_before, text_groups
from graphloom.operators.iterate import Rounds

#: A worker's memory for ids of chunks, counted with so many bytes for each entry besides its chunk and ids.
CACHE_BYTES, ENTRY_BYTES = 96 << 20, 230
#: Rows of a range, and bundles that a sequence holds at least.
ROWS, BUNDLES = 1_000_000, 32
#: Items of over a half, a third ... of the capacity open sequences together.
CLASSES = (2, 3, 4, 5, 7, 10, 16, 33, 1 << 62)
#: Texts are tokenised in groups of up to so many characters.
GROUP_CHARS = 1 << 21
# Fixed value: how the tokenizer file cuts text, after composing (NFC) and lower-casing it.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
# Fixed value: the tokenizer's visible stand-ins of bytes; printable Latin-1 stays, the others move up in order.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
VISIBLE = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
# str.split() also cuts at these four, which the tokenizer doesn't see as white space
ODD = "\x1c\x1d\x1e\x1f"
# ASCII characters that are neither letters, digits nor white space
PUNCTUATION = string.punctuation
# str.lower() looks at the neighbours of sigma, the tokenizer doesn't; beyond the first plane, and where Python has no
# character, the two know different versions of Unicode
UNKNOWN = "".join(c for c in map(chr, range(0x80, 0x10000)) if unicodedata.category(c) == "Cn")
OTHER = re.compile(f"[\u03a3\U00010000-\U0010ffff{UNKNOWN}]")


class Chunks(dict[str, bytes]):
    """Ids of chunks between blanks, as bytes; a chunk that is not there comes from ``before`` or is made by ``merge``, a
    piece's ids, and stays.  ``room`` falls by the bytes that come in.

    Tokens never span white space nor two pieces, so the ids of a chunk are those of its pieces, each a chunk of its own.
    Punctuation behind a letter or digit always is a piece."""

    def __init__(self, merge: Callable[[str], bytes], room: int, before: dict[str, bytes]):
        super().__init__()
        self.merge, self.room, self.before = merge, room, before

    def __missing__(self, chunk: str) -> bytes:
        ids = self.before.pop(chunk, None)
        if ids is None:
            word = chunk.rstrip(PUNCTUATION)
            if len(word) < len(chunk) and word[-1:].isalnum():
                ids = self[word] + self[chunk[len(word) :]]
            elif chunk.isalpha() or (pieces := PIECES.findall(chunk)) == [chunk]:
                ids = self.merge(chunk)
            else:
                ids = b"".join([self[p] for p in pieces])
        self[chunk] = ids
        self.room -= 2 * len(chunk) + len(ids) + ENTRY_BYTES
        return ids


class WordTokenizer:
    """Ids as the tokenizer file gives them, as bytes of little-endian 32-bit numbers.

    A chunk of a text goes through the tokenizer's merges once and its ids are kept.  When half of ``CACHE_BYTES`` is full,
    the chunks in it wait to be met again while the other half fills, so frequent ones stay and rare ones go."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.names = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.chunks = self._empty({})

    def plain(self, text: str) -> bytes:
        """By the tokenizer alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def simple(self, text: str) -> bool:
        """Is the text cut and lower-cased by the tokenizer just as ``split`` and ``lower`` do?"""
        if not text.isascii() and (OTHER.search(text) or not unicodedata.is_normalized("NFC", text)):
            return False
        return not ("<|" in text and any(s in text for s in self.special) or any(c in text for c in ODD))

    def ids(self, texts: list[str]) -> list[bytes]:
        return list(map(self.of, texts))

    def of(self, text: str) -> bytes:
        if not self.simple(text):
            return self.plain(text)
        known = self.chunks
        ids = b"".join(map(known.__getitem__, text.lower().split()))
        if known.room < 0:
            known.before = {}
            # what a single long text has brought may be too much to keep
            self.chunks = self._empty({} if known.room < -CACHE_BYTES // 2 else known)
        return ids

    def _empty(self, before: dict[str, bytes]) -> Chunks:
        merge, name = self.tokenizer.model.tokenize, self.names.__getitem__

        def ids(piece: str) -> bytes:
            visible = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(VISIBLE)
            return b"".join([name(t.id) for t in merge(visible)])

        return Chunks(ids, CACHE_BYTES // 2, before)


@lru_cache(maxsize=2)
def load_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def token_pieces(df: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, piece int, start long, length long, ids_crc32 long, ids binary``: every text's
    ids with ``end_id`` behind, cut into ``capacity`` tokens if it is longer.  Null text: the
    end id alone."""
    kind = df.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = load_tokenizer(vocab_path)
        for b in batches:
            for lo, texts in text_groups(b.column(1), GROUP_CHARS):
                rows, pieces, starts, data = [], [], [], []
                for i, ids in enumerate(tokenizer.ids([t or "" for t in texts]), lo):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        rows.append(i)
                        pieces.append(k)
                        starts.append(at // 4)
                        data.append(ids[at : at + 4 * capacity])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows)),
                        pa.array(pieces, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array([len(x) // 4 for x in data], pa.int64()),
                        pa.array([zlib.crc32(x) for x in data], pa.int64()),
                        pa.array(data, pa.binary()),
                    ],
                    names=[id_col, "piece", "start", "length", "ids_crc32", "ids"],
                )

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, ids binary"
    )


def _bundled(pieces: DataFrame, unit: int) -> DataFrame:
    """The rows with ``__bundle`` (id of its first piece) and ``__inner`` (place in it): neighbours in the order of length until a
    bundle reaches ``unit``."""
    schema = pieces.schema.add("__bundle", "long").add("__inner", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, leader, begin = 0, -1, 0
        for b in batches:
            if b.num_rows:
                size, ids = b.column("__length").to_numpy(), b.column("__id").to_numpy()
                at = total + np.cumsum(size) - size
                group = at // unit
                first = np.flatnonzero(np.diff(group, prepend=-1 if leader < 0 else begin // unit))
                names, starts = np.concatenate([[leader], ids[first]]), np.concatenate([[begin], at[first]])
                of = np.searchsorted(first, np.arange(len(at)), side="right")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[of]), pa.array(at - starts[of])], names=[*b.schema.names, "__bundle", "__inner"])
                total, leader, begin = int(at[-1] + size[-1]), int(names[-1]), int(starts[-1])

    return _sorted(pieces, "__length", "__id").mapInArrow(run, schema)


def _sorted(rows: DataFrame, size: str, *then: str, ranges: int | None = None) -> DataFrame:
    """Range-sorted by falling size, in so many ranges as the rows need."""
    order = [F.col(size).desc(), *then]
    ranges = ranges or _ranges(rows)
    return (rows.coalesce(1) if ranges == 1 else rows.repartitionByRange(ranges, *order)).sortWithinPartitions(*order)


def _ranges(rows: DataFrame) -> int:
    return max(1, -(-rows.count() // ROWS))


def _opened(items: DataFrame, capacity: int, ranges: int | None = None) -> DataFrame:
    """``id, size, seq, at, free``: items fill new sequences in the order of their size, each named by its first item; ``free`` is
    what the last item of a sequence leaves, null for the others.  Where there are several ranges, what would hold another item at the
    end of one is left as it is (``seq`` null) for a round with fewer ranges."""
    ranges = ranges or _ranges(items)
    ordered, several = _sorted(items, "size", "id", ranges=ranges), ranges > 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free, held = 0, []
        for b in batches:
            out = []
            for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n > free:
                    out += held
                    free, held = capacity, []
                held.append((i, n, held[0][0] if held else i, capacity - free, free - n))
                if len(held) > 1:
                    held[-2] = (*held[-2][:4], None)
                free -= n
            yield _rows(out, "id", "size", "seq", "at", "free")
        if held and several and free >= held[-1][1]:
            held = [(i, n, None, None, None) for i, n, *_ in held]
        yield _rows(held, "id", "size", "seq", "at", "free")

    return ordered.select("id", "size").mapInArrow(run, "id long, size long, seq long, at long, free long")


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(names))], names=list(names))


def _swept(items: DataFrame, gaps: DataFrame, capacity: int) -> DataFrame:
    """``id, size, seq, at, free``: items that found a place (``id, seq, at``), items that didn't (``id, size``), and what is left
    of every gap (``seq, free``).  In a single range, an item that finds no gap opens a sequence at once."""
    events = items.select("size", F.lit(1).alias("kind"), "id").union(gaps.select("free", F.lit(0), "seq"))
    ranges = _ranges(events)
    alone = ranges == 1

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Gaps wait on a stack, the smallest on top.  What an item leaves of a gap comes back when the sweep gets to its size."""
        gaps, later, left, out = [], [], [], []
        for b in batches:
            for size, kind, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                while later and -later[0][0] >= size:
                    free, seq = heapq.heappop(later)
                    gaps.append((seq, -free))
                if not kind:
                    gaps.append((key, size))
                elif gaps:
                    seq, free = gaps.pop()
                    out.append((key, None, seq, capacity - free, None, None))
                    heapq.heappush(later, (size - free, seq))
                elif alone:
                    out.append((key, None, key, 0, None, None))
                    heapq.heappush(later, (size - capacity, key))
                else:
                    left.append((key, size, None, None, None, -len(left)))
            yield _rows(out, "id", "size", "seq", "at", "free", "level")
            out = []
        # what is left meets that of other ranges: items close levels downwards, gaps open them upwards from there; gaps
        # that are smaller than the range wait for the next round
        out = left + [(None, None, seq, None, free, 1 - len(left) + i) for i, (seq, free) in enumerate(gaps)]
        yield _rows(out + [(None, None, seq, None, -free, None) for free, seq in later], "id", "size", "seq", "at", "free", "level")

    names = "id long, size long, seq long, at long, free long, level long"
    found = cut(_sorted(events, "size", "kind", "id", ranges=ranges).mapInArrow(sweep, names).withColumn("part", F.spark_partition_id().cast("long")))
    if alone:
        return found.select("id", "size", "seq", "at", "free")
    rest = found.where("level is not null")
    change = rest.groupBy("part").agg(F.sum(F.when(F.col("id").isNull(), 1).otherwise(-1)).cast("long").alias("n"))
    levelled = rest.join(sums_before(change, "part"), "part").withColumn("level", F.col("level") + F.col("before"))
    # on a level, gaps and items take turns: an item behind a gap gets it
    order = Window.partitionBy("level").orderBy("part", F.col("id").isNull())
    gap, item = F.col("id").isNull(), F.col("id").isNotNull()
    beside = levelled.select("*", F.lag("seq").over(order).alias("to"), F.lag("free").over(order).alias("room"), F.lead("id").over(order).alias("by"), F.lead("size").over(order).alias("takes"))
    settled = beside.select(
        "id",
        F.when(F.col("to").isNull(), F.col("size")).alias("size"),
        F.when(gap, F.col("seq")).otherwise(F.col("to")).alias("seq"),
        F.when(item, capacity - F.col("room")).alias("at"),
        F.when(gap, F.col("free") - F.coalesce(F.when(F.col("by").isNotNull(), F.col("takes")), F.lit(0))).alias("free"),
    )
    return found.where("level is null").select("id", "size", "seq", "at", "free").union(settled)


def pack(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id") -> DataFrame:
    """Adds ``sequence_id long, offset long`` to rows with ``length`` (1 to ``capacity``; others raise); columns of these names are
    replaced.  A sequence's number is that of one of its rows, in no order.

    Ids may be null and rows may repeat: each is packed.  Any number of rows may have one length: they are told apart by a number of
    their own, so a hot length is spread over many ranges.  No rows, no sequences."""
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    rows = cut(pieces.select(F.monotonically_increasing_id().alias("__id"), F.col("length").cast("long").alias("__length"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row")))
    bad = rows.where((F.col("__length") < 1) | (F.col("__length") > capacity) | F.col("__length").isNull())
    if not bad.isEmpty():
        raise ValueError(f"lengths must be 1 to {capacity}")
    unit = max(1, capacity // BUNDLES)
    large = rows.where(F.col("__length") > unit).withColumns({"__bundle": F.col("__id"), "__inner": F.lit(0).cast("long")})
    rows = cut(large.unionByName(_bundled(rows.where(F.col("__length") <= unit), unit)))
    items = rows.groupBy("__bundle").agg(F.sum("__length").alias("size")).select(F.col("__bundle").alias("id"), "size")
    items = cut(items)
    gaps = items.limit(0).select(F.col("id").alias("seq"), F.col("size").alias("free"))
    placed = Rounds(items.limit(0).select("id", F.col("id").alias("seq"), F.col("size").alias("at")))
    again = False
    while True:
        most, least = items.agg(F.max("size"), F.min("size")).first()
        if most is None:
            break
        room = gaps.agg(F.max("free")).first()[0] or 0
        if room < most and _ranges(items.select("id").union(gaps.select("seq"))) > 1:  # what no gap holds opens sequences: the largest class of it, in one round or two
            floor = capacity // next(k for k in CLASSES if k > capacity // most)
            large = items.where(F.col("size") > (floor if again else max(room, floor)))
            new = cut(_opened(large, capacity))
            if new.where("seq is not null").isEmpty():
                new = cut(_opened(large, capacity, ranges=1))  # no more than a few items in each of many ranges
            placed.add(new.where("seq is not null").select("id", "seq", "at"))
            items = items.join(new.where("seq is not null").select("id"), "id", "left_anti")
            gaps = gaps.union(new.where(F.col("free") >= least).select("seq", "free"))
        again = room < most
        swept = cut(_swept(items, gaps, capacity))
        placed.add(swept.where("id is not null and seq is not null").select("id", "seq", "at"))
        items = swept.where("id is not null and seq is null").select("id", "size")
        gaps = swept.where(F.col("id").isNull() & (F.col("free") >= least)).select("seq", "free")
    found = rows.join(placed.all().select(F.col("id").alias("__bundle"), "seq", "at"), "__bundle")
    return found.select("__row.*", F.col("seq").alias("sequence_id"), (F.col("at") + F.col("__inner")).alias("offset"))


def pack_documents(df: DataFrame, vocab_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenises, cuts and packs every row of ``df`` (see ``token_pieces`` and ``pack``), without
    the ids themselves: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``."""
    pieces = cut(token_pieces(df, vocab_path, capacity, end_id, id_col, text_col).drop("ids"))
    return pack(pieces, capacity, id_col).select(
        id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
