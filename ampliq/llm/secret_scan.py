"""Secret scans with a worklist of decoded layers.

A text is the first layer. Every layer is searched for the base patterns and for encodings: percent codes and character escapes give a layer of the
whole text with those decoded, base64 runs give a layer each, also where they begin after other letters, and compressed bytes in base64, percent codes
or escapes are unpacked. New layers go onto the worklist until
none is left; a layer seen before at the same place is not taken up again, so cycles end. Each layer knows for every character the stretch of the original text it came
from, and what is found in it is reported there.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import html
import lzma
import re
import zlib
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import pieces

#: Kinds in the order in which they are listed, with the least length and the group it holds for.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
_ORDER = {kind: k for k, kind in enumerate(KINDS)}
_KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Lines of base64 letters one right under the other, or one line of 16 or more.
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{4,}+\r?\n)+[A-Za-z0-9+/_-]++={0,2}|[A-Za-z0-9+/_-]{16,}={0,2}")
_LINE = re.compile(r"([A-Za-z0-9+/_-]+)(=*)(?:\r?\n)?")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{[0-9A-Fa-f]{1,6}\}|(?:\\u[0-9A-Fa-f]{4})+|(?:\\x[0-9A-Fa-f]{2})+|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};|&(?:quot|apos|amp|lt|gt|colon|equals|lowbar|nbsp|sol|period|hyphen|plus);")
_BETWEEN = re.compile(r"[/+_-]+")
#: How streams open in percent codes and in escapes, and what can follow.
_CODED_URL = re.compile(r"(?:%1[Ff]%8[Bb]|(?:x|%78)%(?:01|5[Ee]|9[Cc]|[Dd][Aa])|(?:x|%78)\^|(?:BZh|%42%5[Aa]%68)(?=[1-9%])|%[Ff][Dd](?:7zXZ|%37%7[Aa]%58%5[Aa])%00|(?:\(|%28)%[Bb]5(?:/|%2[Ff])%[Ff][Dd])(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~()!*'+/-])*")
_CODED_HEX = re.compile(r"""(?:\\x1[Ff]\\x8[Bb]|(?:x|\\x78)\\x(?:01|5[Ee]|9[Cc]|[Dd][Aa])|(?:BZh|\\x42\\x5[Aa]\\x68)|\\x[Ff][Dd](?:7zXZ|\\x37\\x7[Aa]\\x58\\x5[Aa])\\x00|(?:\(|\\x28)\\x[Bb]5(?:/|\\x2[Ff])\\x[Ff][Dd])(?:\\x[0-9A-Fa-f]{2}|\\[nrt0\\'"]|[^\\"'\x00-\x1f])*""")
_HEX_ESCAPE = re.compile(rb"\\x([0-9A-Fa-f]{2})|\\([nrt0\\'\"])")
_LETTER_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"0": b"\0"}
#: What compressed bytes are unpacked to at once, and what is looked at to tell a stream that holds itself.
CHUNK, HEAD = 1 << 20, 1 << 16
#: Streams inside each other that are read as one; what is deeper is unpacked whole and read on from there, to any depth.
DEEP = 50
#: Bytes of one layer at most: what is unpacked comes in parts, and those without a place to cut overlap.
LAYER_BYTES = 16 << 20
#: Characters that are in no pattern and no encoding, and are left as they are by every decoding; a line that is empty ends what is before it too.
_BREAK = re.compile(rb"[,()<>!?@$*\[\]|~^`\t]\0?|\n\n")


class Layer:
    """A decoded text; ``low`` and ``high`` hold for each character where its original stretch begins and ends (None: the text itself)."""

    def __init__(self, text: str, low: np.ndarray | None = None, high: np.ndarray | None = None, new: np.ndarray | None = None, via: str = ""):
        self.text, self.low, self.high, self.new, self.via = text, low, high, new, via

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.low is None else (int(self.low[start:end].min()), int(self.high[start:end].max()))

    def key(self) -> tuple[bytes, int, int]:
        """What tells layers apart: the text (as a digest) and the stretch it came from, for equal texts at two places are two layers."""
        digest = hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        return digest, *self.span(0, len(self.text))

    def child(self, text: str, start: np.ndarray, end: np.ndarray, new: np.ndarray | None, how: str) -> Layer:
        """A layer whose characters came from the stretches start..end of this one."""
        low = start if self.low is None else self.low[start]
        high = end if self.high is None else self.high[end - 1]
        if new is not None and self.new is not None:
            new = new | self.new[start]
        return Layer(text, low, high, new, f"{self.via}>{how}" if self.via else how)


def matches(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns, leftmost and not overlapping within a kind."""
    low = text.lower()
    for kind, (pattern, group, least) in KINDS.items():
        if kind == "assign" and not any(k in low for k in _KEYS) or kind == "access" and "AKIA" not in text:
            continue
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


def _from_percent(code: str) -> str:
    return _bytes_text(bytes.fromhex(code.replace("%", "")))


def _from_escape(code: str) -> str | None:
    try:
        if code.startswith("\\x"):
            return _bytes_text(bytes.fromhex(code.replace("\\x", "")))
        if code.startswith("\\u{"):
            return chr(int(code[3:-1], 16)).encode().decode()
        if code.startswith("\\u"):
            return bytes.fromhex(code.replace("\\u", "")).decode("utf-16-be", "replace")
        return html.unescape(code)
    except (ValueError, UnicodeError):
        return None


def _bytes_text(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return raw.decode("latin-1")


def _replaced(layer: Layer, pattern: re.Pattern, decode, how: str) -> Layer | None:
    """The whole layer with every decodable code replaced; the characters of one code share its stretch."""
    text, start, end, new, at = [], [], [], [], 0
    for m in pattern.finditer(layer.text):
        made = decode(m.group())
        if made is None or not made or made == m.group():
            continue
        kept = np.arange(at, m.start())
        text += [layer.text[at : m.start()], made]
        # Codes of one size each give one character; else all share the run.
        if m.end() - m.start() == 3 * len(made) if how == "url" else (m.end() - m.start()) % len(made) == 0 and max(made) < "\U00010000":
            step = (m.end() - m.start()) // len(made)
            low = m.start() + step * np.arange(len(made))
            high = low + step
        else:
            low, high = np.full(len(made), m.start()), np.full(len(made), m.end())
        start += [kept, low]
        end += [kept + 1, high]
        new += [np.zeros(len(kept), bool), np.ones(len(made), bool)]
        at = m.end()
    if not at:
        return None
    kept = np.arange(at, len(layer.text))
    return layer.child("".join([*text, layer.text[at:]]), np.concatenate([*start, kept]), np.concatenate([*end, kept + 1]), np.concatenate([*new, np.zeros(len(kept), bool)]), how)


class _Source:
    """Bytes that come in chunks, with a look at the next ones and a way to give some back."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at, self.refused = chunks, b"", 0, False

    def peek(self, n: int) -> bytes:
        while len(self.held) - self.at < n and (more := next(self.chunks, None)) is not None:
            self.held, self.at = self.held[self.at :] + more, 0
        return self.held[self.at : self.at + n]

    def read(self, n: int) -> bytes:
        got = self.peek(1) and self.held[self.at : self.at + n]
        self.at += len(got)
        return got

    def back(self, raw: bytes) -> None:
        self.held, self.at = raw + self.held[self.at :], 0


def _opener(head: bytes) -> str | None:
    """The format of compressed bytes by their first ones."""
    if head[:2] == b"\x1f\x8b":
        return "gzip"
    if head[:4] == b"\x28\xb5\x2f\xfd" or head[1:4] == b"\x2a\x4d\x18" and head[0] >> 4 == 5:  # a frame, or one to be skipped
        return "zstd"
    if head[:3] == b"BZh":
        return "bz2"
    if head[:6] == b"\xfd7zXZ\0":
        return "xz"
    return "zlib" if len(head) > 2 and head[0] == 0x78 and (head[0] * 256 + head[1]) % 31 == 0 else None


def _member(source: _Source, form: str) -> Iterator[bytes]:
    """The bytes of one compressed stream, in chunks; ``source`` then stands behind it. A damaged stream ends where the damage is.

    What opens like a stream but is none is put back whole, and ``source.refused`` is set.
    """
    source.refused = False
    one = {
        "gzip": lambda: zlib.decompressobj(31),
        "zlib": zlib.decompressobj,
        "bz2": bz2.BZ2Decompressor,
        "xz": lambda: lzma.LZMADecompressor(lzma.FORMAT_XZ),
        "zstd": lambda: zstandard.ZstdDecompressor().decompressobj(),
    }[form]()
    given, read = False, b""
    try:
        while not one.eof and (raw := source.read(256 if form == "zstd" else CHUNK)):  # zstd has no limit to what it gives for its input
            if not given:
                read += raw
            while True:
                out = one.decompress(raw) if form == "zstd" else one.decompress(raw, CHUNK)
                if out:
                    given = True
                    yield out
                raw = getattr(one, "unconsumed_tail", b"")
                if one.eof or not (raw or len(out) == CHUNK and form != "zstd" or form in ("bz2", "xz") and not one.needs_input):
                    break
        if one.eof:
            source.back(one.unused_data)
            return
    except (zlib.error, OSError, EOFError, lzma.LZMAError, zstandard.ZstdError, ValueError):
        pass
    if not given:
        source.back(read)
        source.refused = True


def _cuts(source: _Source, most: int) -> Iterator[bytes]:
    """The rest of the bytes in parts, cut where nothing that is searched for can go on; without such a place in ``most`` bytes, parts overlap by a quarter."""
    held = b""
    while more := source.read(CHUNK):
        held += more
        while len(held) >= min(2 * CHUNK, most):
            at = max((m.end() for m in _BREAK.finditer(held, max(0, len(held) - CHUNK))), default=0)
            if at:
                yield held[:at]
                held = held[at:]
            elif len(held) >= most:
                yield held[:most]
                held = held[most - most // 4 :]
            else:
                break
    if held:
        yield held


def unpack(raw: bytes, most: int = LAYER_BYTES) -> Iterator[tuple[str, bytes]]:
    """(way, bytes) of all that is in ``raw``: streams one after the other and inside each other unpacked to their ends, and what is around them.

    The way is empty for bytes that are not compressed, else such as >gzip>xz.
    """

    later: list[tuple[bytes, str, tuple[bytes, ...]]] = [(raw, "", ())]

    def inside(source: _Source, way: str, heads: tuple[bytes, ...]) -> Iterator[tuple[str, bytes]]:
        while head := source.peek(HEAD):
            form = _opener(head[:6])
            # A stream that holds itself is not followed on.
            if form is not None and head not in heads:
                member = _member(source, form)
                if len(heads) % DEEP < DEEP - 1:
                    yield from inside(_Source(member), f"{way}>{form}", (*heads, head))
                elif whole := b"".join(member):
                    later.append((whole, f"{way}>{form}", (*heads, head)))
                if not source.refused:
                    while (zeros := source.peek(HEAD)) and zeros[:1] == b"\0":  # padding
                        source.read(len(zeros) - len(zeros.lstrip(b"\0")))
                    continue
            yield from ((way, part) for part in _cuts(source, most))

    while later:
        whole, way, heads = later.pop()
        yield from inside(_Source(iter((whole,))), way, heads)


def _views(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(text, offset, bytes a character) of bytes as text: UTF-8 (0: by character) or else Latin-1, and UTF-16 if there are NULs.

    Only ASCII is searched for, so UTF-16 units beyond it all become one character; both places of a unit's first byte, hence both byte orders, are tried.
    """
    try:
        text = raw.decode()
        yield text, 0, 1 if text.isascii() else 0
    except UnicodeDecodeError:
        yield raw.decode("latin-1"), 0, 1
    if b"\0" in raw:
        for offset in (0, 1):
            units = np.frombuffer(raw, "<u2", (len(raw) - offset) // 2, offset)
            if (units < 128).any():
                yield np.where(units < 128, units, 0xFFFD).astype("<u2").tobytes().decode("utf-16-le"), offset, 2


def runs(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of 16 or more base64 letters: lines of one length, any multiple of four, and a last one that may be shorter."""
    for m in _LINES.finditer(text):
        low = high = width = letters = 0
        joins, plain, safe = False, False, False  # whether a next line can follow; + or / so far, - or _ so far
        for x in _LINE.finditer(text, m.start(), m.end()):
            n = len(x[1])
            own_plain, own_safe = "+" in x[1] or "/" in x[1], "-" in x[1] or "_" in x[1]
            if joins and n <= width and not ((plain or own_plain) and (safe or own_safe)):
                high, letters = x.end(2), letters + n
                joins = n == width and not x[2]
                plain, safe = plain or own_plain, safe or own_safe
                continue
            if letters >= 16:
                yield low, high
            low, high, width, letters, joins = x.start(), x.end(2), n, n, n % 4 == 0 and not x[2]
            plain, safe = own_plain, own_safe
        if letters >= 16:
            yield low, high


def _from_base64(layer: Layer, low: int, high: int, most: int) -> Iterator[Layer]:
    """The texts inside one run of base64 letters, unpacked if it is compressed."""
    run = layer.text[low:high]
    letters = run.translate({10: None, 13: None, 61: None}).translate({45: 43, 95: 47})
    if len(letters) % 4 == 1:  # the last letter alone holds no byte
        letters = letters[:-1]
    try:
        raw = base64.b64decode(letters + "=" * (-len(letters) % 4))
    except (binascii.Error, ValueError):
        return
    # Lines of one length may be values of their own: a stream can begin with any line that no stream before it has taken.
    line = run.find("\n")
    width = len(run[:line].rstrip("\r")) if line >= 0 else len(letters)
    at = low + np.flatnonzero(~np.isin(np.frombuffer(run.encode(), np.uint8), (10, 13, 61)))[: len(letters)]
    begins, done = False, 0
    for k in range(0, len(letters), width):
        place = k // 4 * 3
        if place < done or _opener(raw[place : place + 6]) is None:
            continue
        found, left = False, 0
        for way, part in unpack(raw[place:], most):
            if not way and not found:  # no stream after all
                break
            found, begins = True, begins or not place
            left += 0 if way else len(part)
            if way or begins:
                a, b = layer.span(int(at[k]), high)
                for text, _, _ in _views(part):
                    yield Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)), None, f"{layer.via}>base64{way}" if layer.via else f"base64{way}")
        done = len(raw) - left if found else done
    for text, offset, width in _views(raw) if not begins else ():
        # Three bytes come from four letters; a character begins with its first byte.
        size = np.full(len(text), width) if width else np.array([len(c.encode()) for c in text], np.int64)
        first = offset + np.cumsum(size) - size
        start = at[np.minimum(first * 8 // 6, len(at) - 1)]
        end = at[np.minimum(((first + size) * 8 - 1) // 6, len(at) - 1)] + 1
        yield layer.child(text, start, end, None, "base64")


def _bytes_of(letters: str) -> bytes:
    """The bytes of base64 letters, of whole groups of four."""
    n = len(letters) // 4 * 4
    return base64.b64decode(letters[:n].translate({45: 43, 95: 47}))


def _shifted(layer: Layer, low: int, high: int, most: int) -> Iterator[Layer]:
    """The texts inside a run that begins after letters of something else: from the second to the fourth letter on, and after each of ``/ + - _``.

    Only a beginning from which the end of the run reads as text, or that opens
    a compressed stream, is followed.
    """
    run = layer.text[low:high].rstrip("=")
    line = run.split("\n", 1)[0].rstrip("\r")
    starts = {m.end() for m in _BETWEEN.finditer(line)} | {1, 2, 3}
    for k in sorted(starts):
        if len(run) - k < 16 or k >= len(line):
            continue
        n = (len(line) - k) // 4 * 4
        tail = _bytes_of(line[max(k, k + n - 64) : k + n]) if k < 4 else b""
        plain = sum(32 <= c < 127 or c in (9, 10, 13) for c in tail)
        if tail and plain >= 0.9 * len(tail) or _opener(_bytes_of(line[k : k + 8])) is not None:
            yield from _from_base64(layer, low + k, high, most)


def _from_coded(layer: Layer, most: int) -> Iterator[Layer]:
    """The texts of compressed bytes that are written in percent codes or as escapes, the letters among them as they are."""
    for pattern, decode, how in ((_CODED_URL, unquote_to_bytes, "url"), (_CODED_HEX, _unescaped, "unicode")):
        for m in pattern.finditer(layer.text):
            raw = decode(m.group())
            if _opener(raw[:6]) is None:
                continue
            for way, part in unpack(raw, most):
                if way:
                    a, b = layer.span(m.start(), m.end())
                    for text, _, _ in _views(part):
                        yield Layer(text, np.broadcast_to(np.int64(a), len(text)), np.broadcast_to(np.int64(b), len(text)), None, f"{layer.via}>{how}{way}" if layer.via else f"{how}{way}")


def _unescaped(code: str) -> bytes:
    """The bytes of a text with hexadecimal and the usual one-letter escapes."""
    return _HEX_ESCAPE.sub(lambda m: bytes.fromhex(m[1].decode()) if m[1] else _LETTER_ESCAPES.get(m[2], m[2]), code.encode("latin-1", "replace"))


def scan_text(text: str, most: int = LAYER_BYTES) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, via): base spans with via = "" first found, then those of decoded layers, by start, kind and end; code points, end exclusive."""
    found: dict[tuple[int, int, int], str] = {}
    root = Layer(text)
    todo, seen = [iter((root,))], set()
    while todo:
        # Layers are made one at a time: many may come out of one run.
        if (layer := next(todo[-1], None)) is None:
            todo.pop()
            continue
        if not layer.text or (key := layer.key()) in seen:
            continue
        seen.add(key)
        for kind, a, b in matches(layer.text):
            if layer.new is None or layer.new[a:b].any():
                start, end = layer.span(a, b)
                found.setdefault((start, _ORDER[kind], end), layer.via)
        made: list[Layer | None] = []
        if "%" in layer.text:
            made.append(_replaced(layer, _PERCENT, _from_percent, "url"))
        if "\\" in layer.text or "&" in layer.text:
            made.append(_replaced(layer, _ESCAPE, _from_escape, "unicode"))
        todo += [iter((x,)) for x in made if x is not None]
        if "%" in layer.text or "\\x" in layer.text:
            todo.append(_from_coded(layer, most))
        for low, high in runs(layer.text):
            if layer.new is None or layer.new[low:high].any():
                todo.append(_from_base64(layer, low, high, most))
                todo.append(_shifted(layer, low, high, most))
    kinds = list(KINDS)
    return [(kinds[k], a, b, via) for (a, k, b), via in sorted(found.items())]


def redact_text(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """``text`` with every maximal stretch under the spans replaced by ``mark``."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPAN = T.StructType().add("kind", T.StringType()).add("start", T.LongType()).add("end", T.LongType()).add("via", T.StringType())
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("via", pa.string())]))


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, redact: str | None = None) -> DataFrame:
    """The columns ``keep`` (by default all) with ``secrets``: an array of (kind, start, end, via) by start, kind and end.

    ``via`` is empty for a base span, else the way through the layers, such as url>base64>gzip. With ``redact`` the column ``text`` comes back
    with every stretch under a span replaced by that mark. A null text has no secrets and stays null, an empty one has none; repeated rows each get
    theirs; a column named secrets is replaced.
    """
    keep = [c for c in (keep if keep is not None else docs.columns) if c != "secrets"]
    names = [*keep, "secrets"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "_text"):
                texts = piece.column("_text").to_pylist()
                found = [scan_text(t) if t else [] for t in texts]
                columns = {c: piece.column(c) for c in keep}
                if redact is not None:
                    columns[text] = pa.array([redact_text(t, [s[1:3] for s in f], redact) if f else t for t, f in zip(texts, found)], pa.string())
                flat = list(chain.from_iterable(found))
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32))
                parts = [pa.array([s[k] for s in flat], kind) for k, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))]
                made = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=list(_ARROW.value_type)))
                yield pa.RecordBatch.from_arrays([*columns.values(), made], names)

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in keep] + [T.StructField("secrets", T.ArrayType(_SPAN))]))
