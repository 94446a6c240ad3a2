"""Operator 3: secret scans over recursively decoded layers.

The text itself is the first layer.  A worklist unwraps each layer: percent escapes, Unicode
and HTML escapes, base64 runs (of one line or wrapped, from each of the four alignments) and, inside
those, gzip, zlib or bzip2 data, until nothing new appears; a layer of the same text from the same
place is not taken again, so cycles end, but every copy of an encoded text counts.  Every layer is
scanned with the same patterns and keeps, for each of its characters, the span of the original
text that it came from.  Compressed data come from their run as a whole, so they are inflated in
pieces, to their end, and only the kinds of secrets in them are kept.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_groups

# The kinds of secrets, in this order, their patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE = 8
#: Texts are taken from Arrow memory in groups of up to so many characters.
GROUP_CHARS = 1 << 22

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|(?:\\u[0-9A-Fa-f]{4})+|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
BREAKS = re.compile(r"[\r\n \t=]+")
LEAST_RUN = 12
PACKED = re.compile(rb"\x1f\x8b\x08|BZh[1-9]1AY&SY|\x78[\x01\x5e\x9c\xda]")
QUICK = re.compile(r"[:=]")
#: Inflated data pass in pieces of so many bytes; those of up to KEPT_BYTES are kept to be inflated further.
PIECE_BYTES, KEPT_BYTES = 1 << 18, 1 << 24
#: Behind these, text can be cut: no secret, escape or run goes across them, nor does one in a layer decoded from the text.
CUT = re.compile(r"[,!?()<>|*@$^~`\[\]]|[g-zG-Z]\x20(?=[A-Za-z])")

Layer = tuple[str, list[tuple[int, int]] | None]


def scan(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of every secret in one layer, leftmost and non-overlapping for
    each kind."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE] if QUICK.search(text) else []
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def _origin(spans: list[tuple[int, int]] | None, start: int, end: int) -> tuple[int, int]:
    """Where characters start to end of a layer come from."""
    if spans is None:
        return start, end
    part = spans[start:end]
    return min(a for a, _ in part), max(b for _, b in part)


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of the pattern decoded in place, or nothing to decode."""
    text, spans = layer
    out, where, at, changed = [], [], 0, False
    own = spans if spans is not None else None

    def keep(a: int, b: int) -> None:
        out.append(text[a:b])
        where.extend(own[a:b] if own is not None else ((i, i + 1) for i in range(a, b)))

    for m in pattern.finditer(text):
        new = decode(m)
        if new is None:
            continue
        changed = True
        keep(at, m.start())
        for piece, a, b in new:
            out.append(piece)
            where.extend([_origin(spans, m.start() + a, m.start() + b)] * len(piece))
        at = m.end()
    if not changed:
        return None
    keep(at, len(text))
    return "".join(out), where


def _percent(m: re.Match) -> list[tuple[str, int, int]] | None:
    data = bytes.fromhex(m[0].replace("%", ""))
    out, at = [], 0
    try:
        for c in data.decode():
            n = len(c.encode())
            out.append((c, 3 * at, 3 * (at + n)))
            at += n
    except UnicodeDecodeError:
        out = [(chr(x), 3 * i, 3 * i + 3) for i, x in enumerate(data)]
    return out


def _escape(m: re.Match) -> list[tuple[str, int, int]] | None:
    s = m[0]
    if s.startswith("\\u") and not m[1]:
        units = bytes.fromhex("".join(s[i + 2 : i + 6] for i in range(0, len(s), 6)))
        out, at = [], 0
        for c in units.decode("utf-16-be", "replace"):
            n = 2 if ord(c) > 0xFFFF else 1
            out.append((c, 6 * at, min(len(s), 6 * (at + n))))
            at += n
        return out
    code = int(m[5]) if m[5] else int(m[1] or m[2] or m[3] or m[4], 16)
    return None if code > 0x10FFFF or 0xD800 <= code < 0xE000 else [(chr(code), 0, len(s))]


def _decoder(head: bytes):
    """What inflates data that begin so, or None."""
    if head[:2] == b"\x1f\x8b" or (len(head) > 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0):
        return zlib.decompressobj(47)
    return bz2.BZ2Decompressor() if head[:3] == b"BZh" else None


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """In pieces, what the compressed data hold, with all members that follow each other; ends where
    the data end or break."""
    data = b""
    while True:
        while len(data) < 3 and (more := next(chunks, b"")):
            data = (data + more).lstrip(b"\0")
        stream = _decoder(data)
        if stream is None:
            return
        try:
            while not stream.eof:
                out = stream.decompress(data, PIECE_BYTES)
                data = getattr(stream, "unconsumed_tail", b"")
                if out:
                    yield out
                elif not stream.eof and not data and not (data := next(chunks, b"")):
                    return
        except (zlib.error, OSError, ValueError, EOFError):
            return
        data = stream.unused_data.lstrip(b"\0")


def _pieces(chunks: Iterator[bytes]) -> Iterator[str]:
    """The text of the data in pieces that no match goes across."""
    decoder, parts = codecs.getincrementaldecoder("utf-8")("surrogateescape"), []
    for chunk in chunks:
        text = decoder.decode(chunk)
        for size in (256, 8192, len(text)):
            if cuts := [m.end() for m in CUT.finditer(text, max(0, len(text) - size))]:
                yield "".join([*parts, text[: cuts[-1]]])
                parts, text = [], text[cuts[-1] :]
                break
        parts.append(text)
    yield "".join([*parts, decoder.decode(b"", True)])


def _kinds(data: bytes, memo: dict[bytes, set[int]]) -> set[int]:
    """The kinds of secrets in compressed data and in what these hold in turn."""
    key = hashlib.blake2b(data, digest_size=16).digest()
    if key in memo:
        return memo[key]
    found = memo[key] = set()
    source, seen = lambda: (data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)), {key}
    while True:
        level, head, size, kept = hashlib.blake2b(digest_size=16), b"", 0, []

        def passing(chunks: Iterator[bytes]) -> Iterator[bytes]:
            nonlocal head, size
            for chunk in chunks:
                level.update(chunk)
                head, size = head + chunk[: 3 - len(head)] if len(head) < 3 else head, size + len(chunk)
                kept.append(chunk) if size <= KEPT_BYTES else kept.clear()
                yield chunk

        inner = lambda outer=source: _inflated(iter(outer()))
        for text in _pieces(passing(inner())):
            found.update(kind for _, _, kind in scan(text))
            found.update(kind for _, _, kind in _decoded(text, memo))
            if len(found) == len(KINDS):
                return found
        if level.digest() in seen or _decoder(head) is None:
            return found
        seen.add(level.digest())
        source = (lambda whole=kept: whole) if size <= KEPT_BYTES else inner


def _unpacked(layer: Layer, memo: dict[bytes, set[int]], secrets: set[tuple[int, int, int]]) -> Iterator[Layer]:
    """The layers that base64 runs hold; secrets in compressed data are added to ``secrets``."""
    text, spans = layer
    for m in (m for pattern in (BASE64, WRAPPED) for m in pattern.finditer(text)):
        body = BREAKS.sub("", m[0]).replace("-", "+").replace("_", "/")
        if len(body) < LEAST_RUN:
            continue
        place = range(m.start(), m.end()) if m.re is BASE64 else [i for i in range(m.start(), m.end()) if text[i] not in "\r\n \t="]
        for k in range(4):
            size = len(body) - k - ((len(body) - k) % 4 == 1)
            data = base64.b64decode(body[k : k + size] + "=" * (-size % 4))
            starts = [x.start() for x in PACKED.finditer(data)]
            for at in starts if _decoder(data) is None or 0 in starts else [0, *starts]:
                if kinds := _kinds(data[at:] if at else data, memo):
                    secrets.update((*_origin(spans, place[k + at * 8 // 6], m.end()), kind) for kind in kinds)
            inner = data.decode("utf-8", "surrogateescape")
            if not (scan(inner) or any(p.search(inner) for p in (PERCENT, ESCAPE, BASE64, WRAPPED))):
                continue
            where, at = [], 0
            for c in inner:
                n = 1 if "\udc80" <= c <= "\udcff" else len(c.encode())
                where.append(_origin(spans, place[k + at * 8 // 6], place[k - (-(at + n) * 8 // 6) - 1] + 1))
                at += n
            yield inner, where


def _key(layer: Layer) -> bytes:
    """A digest of a layer's text and of where its characters come from."""
    h = hashlib.blake2b(layer[0].encode("utf-8", "surrogatepass"), digest_size=16)
    h.update(b"\xff" + array("q", [x for span in layer[1] for x in span]).tobytes())
    return h.digest()


def _decoded(text: str, memo: dict[bytes, set[int]]) -> set[tuple[int, int, int]]:
    """Secrets of all decoded layers under the text, without those of the text itself."""
    secrets: set[tuple[int, int, int]] = set()
    seen, work = set(), [(text, None)]
    while work:
        layer = work.pop()
        found = []
        if "%" in layer[0] and (new := _replaced(layer, PERCENT, _percent)):
            found.append(new)
        if ("\\" in layer[0] or "&#" in layer[0]) and (new := _replaced(layer, ESCAPE, _escape)):
            found.append(new)
        found.extend(_unpacked(layer, memo, secrets))
        for new in found:
            if (key := _key(new)) not in seen:
                seen.add(key)
                work.append(new)
                secrets.update((*_origin(new[1], a, b), kind) for a, b, kind in scan(new[0]))
    return secrets


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the text itself, and those together with what the decoded layers add."""
    base = scan(text)
    return base, sorted({*base, *_decoded(text, {})}, key=lambda s: (s[0], s[2], s[1]))


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every stretch that a span covers replaced by ``mark``; spans that overlap
    give one mark."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_assign, n_access, n_hex, base_sha256, spans`` for every row; counts and digest
    are of the text itself, ``spans`` also holds those of decoded layers, as
    ``kind:start:end`` in code points of the text, end exclusive, by start and kind.  Null
    text counts as empty; repeated rows repeat."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find_secrets(t or "") for _, texts in text_groups(b.column(1), GROUP_CHARS) for t in texts]
            counts = [pa.array([sum(s[2] == k for s in base) for base, _ in found], pa.int64()) for k in range(3)]
            digests = [hashlib.sha256(spans_text(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array(digests, pa.string()), pa.array([spans_text(x) for _, x in found], pa.string())],
                names=[id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(
        run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def redact_secrets(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with all secrets in ``text_col`` replaced by ``mark``; null stays null, every other
    column and every row stays as it is."""

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None or not (s := find_secrets(t)[1]) else redact(t, s, mark))

    return df.withColumn(text_col, clean(F.col(text_col).cast("string")))
