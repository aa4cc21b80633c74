"""Secret scans (operator 2): a recursive decoding worklist.

Three kinds of secret are matched in a text: assignments (assign), access keys (access) and long hexadecimal runs
(hex). A text can also hold layers: percent codes (plus signs read as they are, and as spaces), %u codes, \\\\u, \\\\U and \\\\x
escapes, base64 (a run, or runs joined over line breaks) and, in the bytes of any of these, UTF-16 text of twelve letters or more, gzip,
zlib, bzip2, xz or zstd data at any place, one in another and member after member, and raw deflate data where base64 begins or
goes on behind one of the characters /, -, _ and +. A base64 run is read from its first character and, as paths and names are
made of characters of base64, also from behind these four where text or compressed data begins there.
Percent codes and escapes give the whole text with its codes decoded, so key and value of a secret can lie
on two sides of a quote or space; bytes that are not UTF-8 become U+FFFD. The worklist starts with the text; each layer
joins it, is scanned in turn and searched for further layers, until no new layer appears; `layers` counts those that are
printable text. Base64 over line breaks is read from the first line of each alignment, and each line also by itself. A
layer with the text and the original ranges of an earlier one is not taken up again, so encodings that give themselves
back end; the same encoded run at another place is another layer, for which only the matches of its text are remembered.

A layer keeps, for each of its characters, the range of the original text that it came from; a match inside a layer
is reported as the span of the original text that covers it. Compressed data has no such ranges: all of its matches
cover the encoded run. Spans are in code points, end exclusive.

Scale: a map over rows, no shuffle; memory follows the longest text. Content of compressed data longer than WINDOW bytes
is scanned in overlapping windows and counted in `oversized`; a window grows with an unbroken run of characters of
encodings at its end, so memory also follows the longest such run. Data that is cut or broken is scanned as far as it
goes. Defined results: a null or empty text has no spans; rows that repeat are scanned by themselves and come out once each;
a null doc_id stays null. Spans that begin together are ordered by kind, then end. An empty table gives an empty result;
columns other than doc_id and text are ignored, whatever their names. Base64 runs under 16 characters are not decoded: the
shortest secret has twelve characters.
"""

from __future__ import annotations

import base64
import bz2
import codecs
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from urllib.parse import unquote_to_bytes

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.memory import release
from quillon.llm.shared import ship, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
FORM = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|\\U([0-9A-Fa-f]{8})|%u([0-9A-Fa-f]{4})")
#: Bytes that texts are made of mostly, in UTF-16 too.
TEXT = bytes([0, 9, 10, 13, *range(0x20, 0x7F)])
#: Twelve letters or more of UTF-16 text, with the lower byte first and last.
ZEROS = re.compile(rb"\x00[\t\n\r\x20-\x7e]\x00[\t\n\r\x20-\x7e]\x00")
UTF16 = re.compile(rb"(?:[\t\n\r\x20-\x7e]\x00){12,}"), re.compile(rb"(?:\x00[\t\n\r\x20-\x7e]){12,}")
BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Characters of base64 that part the words of paths and names too; how many behind one tell whether data begins there.
PARTING, TOLD = re.compile(r"[+/_-]"), 24
LINE = re.compile(r"[A-Za-z0-9+/_-]++")
LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
MAGIC = re.compile(rb"\x1f\x8b\x08|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd|\x78[\x01\x5e\x9c\xda]|\A[\x08\x18\x28\x38\x48\x58\x68][\x00-\xff]")
#: Bytes of content in a window and by which windows overlap at least; bytes given to a decompressor and taken from it at once.
WINDOW, OVERLAP, STEP, TAKEN = 1 << 23, 1 << 19, 256, 1 << 20
#: Characters of encodings: no window begins within a run of them that ends the last one.
ENCODED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=%\\{}.~- \t\r\n"

Span = tuple[str, int, int]


def matches(text: str) -> list[Span]:
    """The matches in one layer, in its own offsets: leftmost and non-overlapping for each kind."""
    found: list[Span] = []
    low = text.lower()
    if any(word in low for word in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def _printable(text: str) -> bool:
    if len(text) >= 4 and text.isascii() and text.isprintable():
        return True
    if text.count("\ufffd") > 0.05 * len(text):
        return False
    return len(text) >= 4 and sum(c.isprintable() and c != "\ufffd" or c in "\t\r\n" for c in text) >= 0.95 * len(text)


Offsets = np.ndarray | int


class Layer:
    """A text or bytes with the original range of each character or byte. starts is None for the original itself, and a
    number if all have one range. close is where the encoded run ends, with its padding; more gives the bytes that follow."""

    def __init__(self, data: str | bytes, starts: Offsets | None = None, ends: Offsets | None = None, close: int | None = None) -> None:
        self.data, self.starts, self.ends, self.close = data, starts, ends, close
        self.raw_at: list[int] = []  # where raw deflate data may begin
        self.more: Callable[[], Iterator[bytes]] = lambda: iter(())

    @property
    def single(self) -> bool:
        return isinstance(self.starts, int)

    def span(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        if self.single:
            return self.starts, self.ends
        return int(self.starts[start]), int(self.ends[end - 1])

    def key(self) -> tuple[bytes, bytes]:
        """Digests of the data and of its ranges."""
        data = self.data.encode("utf-8", "surrogatepass") + b"t" if isinstance(self.data, str) else self.data + b"b"
        places = f"{self.starts} {self.ends}".encode() if self.starts is None or self.single else self.starts.tobytes() + self.ends.tobytes()
        return hashlib.blake2b(data, digest_size=16).digest(), hashlib.blake2b(places, digest_size=16).digest()

    def part(self, data: str | bytes, starts: np.ndarray, ends: np.ndarray, close: int | None = None) -> Layer:
        """A layer below this one, from ranges in this one's offsets."""
        if self.single:
            return Layer(data, self.starts, self.ends)
        close = None if close is None else self.span(close - 1, close)[1]
        if self.starts is None:
            return Layer(data, starts, ends, close)
        return Layer(data, self.starts[starts], self.ends[ends - 1], close)


def _by_bytes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[str, np.ndarray, np.ndarray]:
    """Bytes with a range each, read as UTF-8: the text and a range for each character. A byte that is not UTF-8 is U+FFFD."""
    text = raw.decode("utf-8", "surrogateescape")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
    bad = (codes >= 0xDC80) & (codes <= 0xDCFF)
    width[bad] = 1
    if bad.any():
        text = re.sub("[\udc80-\udcff]", "\ufffd", text)
    last = np.cumsum(width) - 1
    return text, starts[last - width + 1], ends[last]


def _text(layer: Layer, start: int, end: int) -> Layer:
    """The text of a part of bytes."""
    if layer.single:
        return Layer(layer.data[start:end].decode("utf-8", "replace"), layer.starts, layer.ends)
    return Layer(*_by_bytes(layer.data[start:end], layer.starts[start:end], layer.ends[start:end]))


def _whole(layer: Layer, runs: Iterable[tuple[int, int, bytes, int]]) -> Iterator[Layer]:
    """The bytes of the layer's whole text with its runs of codes (from, to, bytes, length of the code of a byte or 0 for all) decoded, if it has any."""
    text, runs = layer.data, list(runs)
    if not runs:
        return
    plain = text.encode("utf-8", "replace")
    char_of, byte_of = None, None
    if len(plain) != len(text):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
        width[(codes >= 0xD800) & (codes <= 0xDFFF)] = 1
        char_of, byte_of = np.repeat(np.arange(len(text)), width), np.append(0, np.cumsum(width)).tolist()
    # codes are ASCII, so all places are those of bytes until the end: pieces of bytes, the first place of each and its steps
    out, first, step, size, k = [], [], [], [], 0

    def add(piece: bytes, at: int, by: int) -> None:
        out.append(piece)
        first.append(at)
        step.append(by)
        size.append(len(piece))

    until: list[int] = []
    for a, b, raw, width in runs:
        a, b = (a, b) if byte_of is None else (byte_of[a], byte_of[b])
        if k < a:
            add(plain[k:a], k, 1)
            until.append(0)
        add(raw, a, width)
        until.append(b)
        k = b
    if k < len(plain):
        add(plain[k:], k, 1)
        until.append(0)
    if layer.single:
        yield layer.part(b"".join(out), None, None)
        return
    n, by = np.array(size), np.repeat(step, size)
    starts = np.repeat(first, n) + by * (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    ends = np.where(by > 0, starts + by, np.repeat(until, n))
    if char_of is not None:
        starts, ends = char_of[starts], char_of[ends - 1] + 1
    yield layer.part(b"".join(out), starts, ends)


def _percent(layer: Layer) -> Iterator[Layer]:
    if "%" not in layer.data:
        return
    yield from _whole(layer, ((*m.span(), unquote_to_bytes(m.group()), 3) for m in PERCENT.finditer(layer.data)))
    if "+" in layer.data and PERCENT.search(layer.data):  # sent from a form: a plus sign is a space
        runs = ((*m.span(), m.group()) for m in FORM.finditer(layer.data))
        yield from _whole(layer, ((a, b, b" " if code == "+" else unquote_to_bytes(code), 1 if code == "+" else 3) for a, b, code in runs))


def _escapes(layer: Layer) -> Iterator[Layer]:
    """Codes as characters, and if some are those of upper bytes also as bytes."""
    if "\\" not in layer.data and "%u" not in layer.data:
        return
    codes = [(*m.span(), int(m.group(m.lastindex), 16)) for m in ESCAPE.finditer(layer.data)]
    char = lambda code: (chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else "\ufffd").encode()
    yield from _whole(layer, ((a, b, char(code), 0) for a, b, code in codes))
    if any(0x80 <= code < 0x100 for _, _, code in codes):
        yield from _whole(layer, ((a, b, bytes([code]) if code < 0x100 else char(code), 0) for a, b, code in codes))


def _decoded(run: str) -> bytes:
    run = run[: len(run) - (len(run) % 4 == 1)]
    return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4))


def _starts(text: str, start: int, end: int) -> Iterator[int]:
    """Where encoded data may begin within a run, behind characters that part words: for each step of four the first place at which
    text, compressed data or UTF-16 begins. What begins later in the same step is part of what is read from there."""
    known: set[int] = set()
    for m in PARTING.finditer(text, start, end):
        at = m.end()
        if at % 4 in known or end - at < 16:
            continue
        head = _decoded(text[at : min(end, at + TOLD)].rstrip("="))
        kind = _kind(head)
        if _is_text(head) or kind not in (None, "zlib") or _may_inflate(_decoded(text[at : min(end, at + 4 * STEP // 3)].rstrip("="))[2 if kind else 0 :]):
            known.add(at % 4)
            yield at


def _base64(layer: Layer) -> Iterator[Layer]:
    text = layer.data
    runs = [([(start, m.end())], m.end()) for m in BASE64.finditer(text) for start in (m.start(), *_starts(text, *m.span()))]
    for m in LINES.finditer(text) if "\n" in text else ():
        lines = [line.span() for line in LINE.finditer(text, *m.span())]
        before, aligned = 0, set()
        for k, (a, b) in enumerate(lines):
            if before % 4 not in aligned and k + 1 < len(lines):
                aligned.add(before % 4)
                runs.append((lines[k:], m.end()))
            before += b - a
    for lines, close in runs:
        run = "".join(text[a:b] for a, b in lines).rstrip("=")
        run = run[: len(run) - (len(run) % 4 == 1)]
        if len(run) < 16:
            continue
        raw = _decoded(run)
        begins = [0, *(m.end() for m in PARTING.finditer(run) if not m.end() % 4)]
        if layer.single:
            below = Layer(raw, layer.starts, layer.ends)
        else:
            place = np.concatenate([np.arange(a, b) for a, b in lines])
            at = np.arange(len(raw), dtype=np.int64)
            below = layer.part(raw, place[at * 8 // 6], place[(at * 8 + 7) // 6] + 1, close)
        below.raw_at = [k // 4 * 3 for k in begins]
        yield below


def _kind(head: bytes) -> str | None:
    if head[:3] == b"\x1f\x8b\x08":
        return "gzip"
    for kind, magic in (("bzip2", b"BZh"), ("xz", b"\xfd7zXZ\x00"), ("zstd", b"\x28\xb5\x2f\xfd")):
        if head.startswith(magic):
            return kind
    return "zlib" if len(head) > 1 and head[0] & 15 == 8 and head[0] < 0x80 and (head[0] * 256 + head[1]) % 31 == 0 else None


MACHINES = {"deflate": lambda: zlib.decompressobj(-15), "gzip": lambda: zlib.decompressobj(31), "zlib": zlib.decompressobj, "bzip2": bz2.BZ2Decompressor, "xz": lzma.LZMADecompressor, "zstd": lambda: zstandard.ZstdDecompressor().decompressobj()}


def _taken(kind: str, machine, piece: bytes) -> Iterator[bytes]:
    """What a decompressor gives for a piece, in parts of bounded size."""
    if kind == "zstd":
        yield machine.decompress(piece)
        return
    while True:
        got = machine.decompress(piece, TAKEN)
        yield got
        if kind in ("deflate", "gzip", "zlib"):
            piece = machine.unconsumed_tail
            if machine.eof or not piece and len(got) < TAKEN:
                return
        else:
            piece = b""
            if machine.eof or machine.needs_input:
                return


def _may_inflate(piece: bytes) -> bool:
    """Whether raw deflate data can begin like this: it gives text, or something that is compressed again."""
    try:
        found = zlib.decompressobj(-15).decompress(piece, 64)
    except zlib.error:
        return False
    return len(found) >= 12 and (_is_text(found) or _kind(found) not in (None, "zlib"))


def _is_text(head: bytes) -> bool:
    """Whether bytes, which may end within a letter, look like text: nearly all ASCII, UTF-16 too, or UTF-8."""
    body = head[2:] if head[:2] in (b"\xff\xfe", b"\xfe\xff") else head
    if 16 * len(body.translate(None, TEXT)) <= len(body):
        return True
    try:
        return codecs.getincrementaldecoder("utf-8")().decode(head).isprintable()
    except UnicodeDecodeError:
        return False


def _inflated(chunks: Iterator[bytes], used: list[int | bool], forced: str | None = None) -> Iterator[bytes]:
    """The content of the compressed members of one kind that chunks begin with, or of one member of a kind without a mark; used
    becomes the bytes of the members and whether they end in an error."""
    left, first = b"", None
    used[:] = 0, False
    while True:
        gap = 0
        while True:  # zero bytes can pad members
            gap, left = (gap + len(left) - len(left.lstrip(b"\0")), left.lstrip(b"\0")) if first else (0, left)
            if len(left) >= 6 or (more := next(chunks, None)) is None:
                break
            left += more
        kind = forced if forced and first is None else _kind(left)
        if kind is None or first not in (None, kind):
            return
        first = kind
        machine, view, at, read = MACHINES[kind](), memoryview(left), 0, 0
        try:
            while not machine.eof:
                if at == len(view):
                    if (more := next(chunks, None)) is None:
                        used[0] += gap + read
                        if kind in ("deflate", "gzip", "zlib"):
                            yield machine.flush()
                        return
                    view, at = memoryview(more), 0
                piece = bytes(view[at : at + STEP])
                at += len(piece)
                read += len(piece)
                yield from _taken(kind, machine, piece)
        except (zlib.error, lzma.LZMAError, OSError, EOFError, ValueError, zstandard.ZstdError):
            used[:] = used[0] + gap + read, True
            return
        used[0] += gap + read - len(machine.unused_data)
        left = machine.unused_data + bytes(view[at:])


def _skip(chunks: Iterator[bytes], n: int) -> Iterator[bytes]:
    for chunk in chunks:
        if n < len(chunk):
            yield chunk[n:]
        n = max(0, n - len(chunk))


def _windows(chunks: Iterator[bytes]) -> Iterator[tuple[int, bytes]]:
    """Where a window begins, and its bytes."""
    buffer, at, limit = bytearray(), 0, WINDOW
    for chunk in chunks:
        buffer += chunk
        if len(buffer) >= limit:
            cut = min(len(buffer) - OVERLAP, len(buffer.rstrip(ENCODED)))
            if cut > 0:
                yield at, bytes(buffer)
                del buffer[:cut]
                at += cut
            limit = max(WINDOW, 2 * len(buffer))
    if buffer:
        yield at, bytes(buffer)


def _packed(layer: Layer, oversized: set[tuple]) -> Iterator[Layer]:
    """The contents of compressed data in bytes, and the text of what is between them."""
    raw, at, done = layer.data, 0, 0
    if ZEROS.search(raw):
        read = 0
        for a, b, step in sorted((*m.span(), step) for step, pattern in enumerate(UTF16) for m in pattern.finditer(raw)):
            if a >= read:  # what begins first is in step; the other order of bytes fits it too, but for its ends
                read, text = b, raw[a + step : b : 2].decode("ascii")
                yield Layer(text, layer.starts, layer.ends) if layer.single else Layer(text, layer.starts[a:b:2], layer.ends[a + 1 : b : 2])
    bare = iter(layer.raw_at)
    while (m := MAGIC.search(raw, at)) or (unmarked := next(bare, None)) is not None:
        begin, used, forced = (m.start(), [0, False], None) if m else (unmarked, [0, False], "deflate")
        at = begin + 1 if m else len(raw)
        if not m and not _may_inflate(raw[begin : begin + STEP]):
            continue

        def content(used: list[int | bool], begin: int = begin, forced: str | None = forced) -> Iterator[bytes]:
            here = (raw[k : k + TAKEN] for k in range(begin, len(raw), TAKEN))
            return _inflated(chain(here, (chunk for get in (layer.more,) for chunk in get())), used, forced)

        size, kept = 0, []
        for chunk in content(used):
            size += len(chunk)
            if size <= WINDOW:
                kept.append(chunk)
        if not size or forced and (size < 12 or used[1] and not _printable(b"".join(kept).decode("utf-8", "replace"))):
            continue
        last = min(begin + used[0], len(raw))
        if not used[1] and not forced:
            if done < begin:
                yield _text(layer, done, begin)
            at = done = max(at, last)
        start, end = layer.span(begin, last)
        if last == len(raw) and layer.close is not None:
            end = layer.close
        if size <= WINDOW:
            yield Layer(b"".join(kept), start, end)
            continue
        kept.clear()
        oversized.add((layer.key(), begin))
        for offset, window in _windows(content([0, False])):
            below = Layer(window, start, end)
            below.more = lambda skip=offset + len(window), content=content: _skip(content([0, False]), skip)
            yield below
    if done < len(raw):
        yield _text(layer, done, len(raw))


def _unwrap(layer: Layer, oversized: set[tuple]) -> Iterator[Layer]:
    if isinstance(layer.data, bytes):
        yield from _packed(layer, oversized)
    else:
        for unwrap in (_percent, _escapes, _base64):
            yield from unwrap(layer)


def scan(text: str | None) -> tuple[list[Span], list[Span], int, int]:
    """Base spans, all spans (both in order), the number of layers below the text and of those scanned in windows."""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(matches(text or ""), key=order)
    top = Layer(text or "")
    spans, seen, known, layers, oversized = set(base), {top.key()}, {}, 0, set()
    todo = [_unwrap(top, oversized)]
    while todo:
        if (below := next(todo[-1], None)) is None:
            todo.pop()
            continue
        if (key := below.key()) in seen:
            continue
        seen.add(key)
        if isinstance(below.data, str):
            layers += _printable(below.data)
            if key[0] not in known:
                known[key[0]] = matches(below.data)
            spans.update((kind, *below.span(start, end)) for kind, start, end in known[key[0]])
        todo.append(_unwrap(below, oversized))
    return base, sorted(spans, key=order), layers, len(oversized)


def find_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end), layers and oversized of every document."""
    ship(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    record = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            found = [scan(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([record(f[0]) for f in found], kind),
                    pa.array([record(f[1]) for f in found], kind),
                    pa.array([f[2] for f in found], pa.int32()),
                    pa.array([f[3] for f in found], pa.int32()),
                ],
                ["doc_id", "base", "spans", "layers", "oversized"],
            )

    spans = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, f"doc_id long, base {spans}, spans {spans}, layers int, oversized int"
    )


def digest(spans: list[Span]) -> str:
    """The spans as the text that base_sha256 is taken of."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS],
        F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"),
        joined("spans").alias("spans"),
        "layers",
        "oversized",
    )
