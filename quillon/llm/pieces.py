"""SentencePiece encoding and decoding (operator 8) by a weighted finite-state transducer.

Machines are compiled from a model file (byte-pair or unigram pieces):

* the normaliser: the model's own table of replacements (the longest match from the left), its handling of extra spaces, the
  mark U+2581 for each space, and a mark before the text, as the model's flags say;
* the pieces: a trie that reads characters and writes a piece, with an arc of weight -score for each piece. A character
  outside the vocabulary reads as the bytes of its UTF-8 form (byte fallback), or as the unknown piece;
* the acceptor of neighbours, for byte-pair models: its states are pieces, and the arc from piece a to piece b has weight
  zero where merging the text ab gives just a and b, and infinite weight otherwise. Arcs are made when first asked for,
  and kept. Merging is local: a sequence of pieces is what the merges make of their text if and only if each two
  neighbours are. A unigram model accepts all neighbours, with one state.

The machines are composed with an input, and the path of least weight in the tropical semiring (weights add along a path, the
least of all paths counts) is found in one pass over the states (position, state of the acceptor) in the order of
positions. For byte-pair models this gives the model's own encoding, which a path over piece scores alone would not.

Texts are cut where all paths have one state: before marks, if no piece has one after another character, beside
characters that no piece joins to others, and in long runs between characters that no piece has side by side. The paths of
many different segments are searched side by side in numpy, and one that was found is used again where its segment
recurs; a worker remembers MEMORY bytes of them.

Decoding reads ids back: pieces are joined, runs of byte pieces are decoded as UTF-8, marks become spaces and the space put
before the text goes. It gives back each text exactly where the model's normaliser changes nothing but spaces, and the
text has no mark of its own and no lone surrogates.

Models with words or characters as pieces, pieces of a user, or marks behind words are refused with an error.

Scale: a map over rows; no shuffle. The model file is read on the driver from `model_file` and sent to the tasks; its
size is fixed. Defined results: a null or empty text has no pieces; rows are independent of each other, so rows that
repeat get equal results and a null doc_id stays null; an empty table gives an empty result; columns other than doc_id
and text are ignored. Memory follows the longest text, and the longest run of characters without a cut.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.memory import Recent, held
from quillon.llm.shared import ship, table

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
FAR = float("inf")
#: Bytes of paths that a worker remembers; slots (as a power of two, of eight bytes each) for the arcs of neighbours, and
#: pieces whose merges it remembers.
MEMORY, ARCS, TRACES = 24 << 20, 21, 5_000
#: Rows that are encoded together; characters whose paths are searched together; the least length of a segment that is cut.
ROWS, TOGETHER, LONG = 256, 1 << 14, 48
#: Numbers of the model format: kinds of models and of pieces.
UNIGRAM, BPE = 1, 2
PLAIN, UNKNOWN, CONTROL, USER_DEFINED, BYTE = 1, 2, 3, 4, 6
#: What an unknown piece is read back as.
READ_UNKNOWN = " \u2047 "
#: What a unigram model adds to its least score for an unknown character.
UNKNOWN_PENALTY = 10.0


@dataclass(frozen=True)
class Model:
    """What a model file says. pieces: (text, score, kind) by id; charsmap: the packed table of replacements."""

    pieces: list[tuple[str, float, int]]
    kind: int = BPE
    charsmap: bytes = b""
    prefix: bool = True
    trim: bool = False
    escape: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a message in the wire format of protocol buffers."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while at < len(data):
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
            continue
        size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
        yield number, data[at : at + size]
        at += size


def read_model(model_file: str = MODEL_FILE) -> Model:
    """Reads a model file; one that the machines cannot express is an error."""
    with open(model_file, "rb") as f:
        return parse_model(f.read())


def parse_model(data: bytes) -> Model:
    pieces, kind, flags = [], UNIGRAM, {3: True, 4: True, 5: True}
    charsmap, suffix = b"", False
    for number, value in _fields(data):
        if number == 1:
            of = dict(_fields(value))
            pieces.append((of[1].decode(), struct.unpack("<f", of.get(2, b"\0\0\0\0"))[0], of.get(3, PLAIN)))
        elif number == 2:
            of = dict(_fields(value))
            kind, suffix = of.get(3, UNIGRAM), bool(of.get(24, 0))
        elif number == 3:
            of = dict(_fields(value))
            charsmap = of.get(2, b"")
            flags |= {k: bool(of[k]) for k in flags if k in of}
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and byte-pair models can be compiled")
    if suffix or any(k == USER_DEFINED for _, _, k in pieces):
        raise ValueError("models with marks behind words or with pieces of a user cannot be compiled")
    return Model(pieces, kind, charsmap, flags[3], flags[4], flags[5])


def replacements(charsmap: bytes) -> dict[str, str]:
    """The table of replacements: a double-array trie over UTF-8 bytes, and texts that end in a zero byte."""
    if not charsmap:
        return {}
    (size,) = struct.unpack("<I", charsmap[:4])
    units = np.frombuffer(charsmap[4 : 4 + size], np.uint32).astype(np.int64)
    texts, found = charsmap[4 + size :], {}
    offset = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
    labels, letters = units & 0x800000FF, np.arange(1, 256)
    todo = [(b"", int(offset(units[0])))]
    while todo:
        key, base = todo.pop()
        places = base ^ letters
        for at in places[(places < len(units)) & (labels[np.minimum(places, len(units) - 1)] == letters)].tolist():
            unit, longer = int(units[at]), key + bytes([base ^ at])
            below = at ^ offset(unit)
            if unit >> 8 & 1:
                begin = int(units[below]) & 0x7FFFFFFF
                found[longer.decode()] = texts[begin : texts.index(b"\0", begin)].decode()
            todo.append((longer, below))
    return found


class Normaliser:
    """The machine that a text passes first."""

    def __init__(self, model: Model) -> None:
        self.prefix, self.trim = model.prefix, model.trim
        self.mark = MARK if model.escape else " "
        self.rules = replacements(model.charsmap)
        firsts: dict[str, set[int]] = {}
        for source in self.rules:
            firsts.setdefault(source[0], set()).add(len(source))
        self.lengths = {char: sorted(sizes, reverse=True) for char, sizes in firsts.items()}
        self.may = re.compile("[" + "".join(map(re.escape, sorted(firsts))) + "]") if firsts else None

    def replaced(self, text: str) -> str:
        out, done, at = [], 0, 0
        while (m := self.may.search(text, at)) is not None:
            at = m.start()
            for size in self.lengths[text[at]]:
                if (to := self.rules.get(text[at : at + size])) is not None:
                    out += (text[done:at], to)
                    done = at = at + size
                    break
            else:
                at += 1
        return "".join(out) + text[done:] if out else text

    def __call__(self, text: str) -> str:
        if self.may is not None:
            text = self.replaced(text)
        if self.trim:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return text
        return (self.mark if self.prefix else "") + text.replace(" ", self.mark)


class Numbers:
    """A fixed map from numbers to numbers from 1 on, 0 for all others: tables of slots, each for what collides before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.tables: list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]] = []
        factor = 0x9E3779B97F4A7C15
        while len(keys):
            bits = len(keys).bit_length() + 3
            factor = factor * 0xBF58476D1CE4E5B9 % (1 << 64) | 1
            slot = keys.astype(np.uint64) * np.uint64(factor) >> np.uint64(64 - bits)
            _, first = np.unique(slot, return_index=True)
            own, to = np.full(1 << bits, -1), np.zeros(1 << bits, np.int32)
            own[slot[first]], to[slot[first]] = keys[first], values[first]
            self.tables.append((np.uint64(factor), np.uint64(64 - bits), own, to))
            keys, values = np.delete(keys, first), np.delete(values, first)

    def of(self, keys: np.ndarray) -> np.ndarray:
        out, todo = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for factor, shift, own, to in self.tables:
            slot = keys[todo].astype(np.uint64) * factor >> shift
            there = own[slot]
            hit = there == keys[todo]
            out[todo[hit]] = to[slot[hit]]
            todo = todo[~hit & (there >= 0)]
            if not len(todo):
                break
        return out


class Lately:
    """A yes or no for each of many numbers, by a function of one number; a number's answer stays in its slot until another number
    takes the slot."""

    def __init__(self, function: Callable[[int], bool], bits: int = ARCS) -> None:
        self.function, self.shift = function, np.uint64(64 - bits)
        self.slots = np.full(1 << bits, -1)  # twice the number, and its answer

    def of(self, keys: np.ndarray) -> np.ndarray:
        slot = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift
        held = self.slots[slot]
        new = np.flatnonzero(held >> 1 != keys)
        if len(new):
            asked, first, of = np.unique(keys[new], return_index=True, return_inverse=True)
            answers = 2 * asked + np.fromiter(map(self.function, asked.tolist()), np.int64, len(asked))
            self.slots[slot[new[first]]] = answers
            held[new] = answers[of]
        return (held & 1).astype(bool)


class Transducer:
    """The composed machines of a model."""

    def __init__(self, model: Model) -> None:
        pieces = model.pieces
        self.normalise, self.merges, self.prefix = Normaliser(model), model.kind == BPE, model.prefix
        self.texts = [text for text, _, _ in pieces]
        self.unknown = next((i for i, (_, _, kind) in enumerate(pieces) if kind == UNKNOWN), 0)
        self.ids = {text: i for i, (text, _, kind) in enumerate(pieces) if kind == PLAIN}
        self.bytes = {int(text[3:5], 16): i for i, (text, _, kind) in enumerate(pieces) if kind == BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        #: What an id is read back as, and whether it is a byte that only means something beside others.
        plain = {CONTROL: "", UNKNOWN: READ_UNKNOWN}
        self.read_as = [chr(self.byte_of[i]) if i in self.byte_of else plain.get(kind, text) for i, (text, _, kind) in enumerate(pieces)]
        self.partial = np.array([self.byte_of.get(i, 0) >= 0x80 for i in range(len(pieces))])
        #: Weights of the pieces, and last that of a character aside from the vocabulary.
        self.other = len(pieces)
        least = [-score for text, score, kind in pieces if kind == PLAIN]
        self.cost = np.array([*(-score for _, score, _ in pieces), max(least, default=0.0) + UNKNOWN_PENALTY])
        self.traces: dict[int, tuple] = {}
        self.arcs = Lately(lambda key: self.arc(*divmod(key, self.other + 1)))
        self._compile_pieces()
        self._compile_cuts()
        self.paths = Recent(self.paths_of, MEMORY)

    def _compile_pieces(self) -> None:
        """The trie: nodes are numbered from 0 on, edges.of(node * letters + letter) is the next node."""
        letters = sorted({c for text in self.ids for c in text} - {"\0"})
        self.letters = len(letters) + 1
        self.number = np.zeros(0x110000, np.uint16 if self.letters < 1 << 16 else np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, self.letters)
        nodes, keys = {"": 0}, []
        piece_of = [-1]
        for text, piece in self.ids.items():
            if self.merges and len(text) > 1 and not self.trace(piece)[3]:
                continue  # no merges make it
            for k in range(1, len(text) + 1):
                if text[:k] not in nodes:
                    nodes[text[:k]] = len(nodes)
                    keys.append(nodes[text[: k - 1]] * self.letters + int(self.number[ord(text[k - 1])]))
                    piece_of.append(-1)
            piece_of[nodes[text]] = piece
        self.edges, self.piece_of = Numbers(np.array(keys, np.int64), np.arange(1, len(nodes))), np.array(piece_of)
        self.traces.clear()

    def _compile_cuts(self) -> None:
        mark = self.normalise.mark
        joined = {c for text in self.ids if len(text) > 1 for c in text}
        inside = "".join(sorted(re.escape(c) for c in joined - {mark}))
        # marks and what follows them, or a run without marks, or one character that joins no other
        alone = any(mark in text.lstrip(mark) for text in self.ids)
        runs = f"[{inside}{mark}]+|." if alone else f"{mark}+[{inside}]*|[{inside}]+|."
        self.segment = re.compile(runs if inside else f"{mark}+|.", re.DOTALL)
        #: Neighbours that some piece has.
        self.beside = {text[k : k + 2] for text in self.ids for k in range(len(text) - 1)}

    def trace(self, piece: int) -> tuple[list[float], list[str], list[str], bool]:
        """How the merges build a piece's text alone: the weight of each merge, the last and the first part before each
        merge and at the end, and whether the piece comes out. The best-scored neighbours merge first, of equals the
        leftmost."""
        if (known := self.traces.get(piece)) is not None:
            return known
        parts, ids, cost = list(self.texts[piece]), self.ids, self.cost
        weights, lasts, firsts = [], [parts[-1]], [parts[0]]
        while True:
            best, at = FAR, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and cost[i] < best:
                    best, at = cost[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            weights.append(best)
            lasts.append(parts[-1])
            firsts.append(parts[0])
        if len(self.traces) > TRACES:
            self.traces.clear()
        known = self.traces[piece] = ([*weights, FAR], lasts, firsts, len(parts) == 1)
        return known

    def arc(self, a: int, b: int) -> bool:
        """Whether the text of a and b merges to a and b: both are built side by side, in the order of their weights,
        and at no time the parts that meet make a piece that would be merged first."""
        apart, i, j = True, 0, 0
        if a != self.other and b != self.other:
            left, lasts, _, _ = self.trace(a)
            right, _, firsts, _ = self.trace(b)
            last = first = ""
            while True:
                if lasts[i] is not last or firsts[j] is not first:
                    last, first = lasts[i], firsts[j]
                    piece = self.ids.get(last + first)
                    across = FAR if piece is None else self.cost[piece]
                if across < left[i] and across <= right[j]:
                    apart = False
                    break
                if left[i] <= right[j]:
                    if left[i] == FAR:
                        break
                    i += 1
                else:
                    j += 1
        return apart

    def follows(self, before: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Which pieces may stand behind those before them."""
        return self.arcs.of(before * (self.other + 1) + pieces)

    def fallback(self, char: str) -> tuple[int, ...]:
        raw = char.encode("utf-8", "replace")
        return tuple(self.bytes[b] for b in raw) if len(self.bytes) == 256 else (self.unknown,)

    def pieces_at(self, codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arcs of the pieces machine over numbered characters (0: none of the vocabulary): start, end and piece."""
        at, node, depth, found = np.flatnonzero(inside), 0, 0, []
        ahead = np.concatenate([codes, [0]])
        while len(at):
            letter = ahead[np.minimum(at + depth, len(codes))]
            node = np.where(letter > 0, self.edges.of(node * self.letters + letter), 0)
            at, node, depth = at[node > 0], node[node > 0], depth + 1
            hit = self.piece_of[node] >= 0
            found.append((at[hit], at[hit] + depth, self.piece_of[node[hit]]))
        aside = inside.copy()
        if found:
            aside[found[0][0]] = False  # what a piece of one character reads
        aside = np.flatnonzero(aside)
        found.append((aside, aside + 1, np.full(len(aside), self.other)))
        return tuple(np.concatenate([f[k] for f in found]) for k in range(3))

    def shortest(self, segments: list[str]) -> list[bytes]:
        """For each segment the ids (as int32 in bytes) on the path of least weight.

        Segments stand one behind another, each with an end mark, and are gone through side by side: in turn k come the
        arcs that begin at the k-th position of each. A position has one state of the acceptor: a unigram acceptor has no
        other, and what merges make of a text up to there is one sequence. `weight` is the least of the paths to a
        position, `last` its acceptor's state, `back` where its last arc begins.
        """
        sizes = np.fromiter(map(len, segments), np.int64, len(segments)) + 1
        begins = np.cumsum(sizes) - sizes
        text = np.frombuffer(("\0".join(segments) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.ones(len(text), bool)
        inside[begins + sizes - 1] = False
        codes = np.where(inside, self.number[text], 0).astype(np.int64)
        start, end, piece = self.pieces_at(codes, inside)
        turn = start - np.repeat(begins, sizes)[start]
        order = np.argsort(turn, kind="stable")
        start, end, piece, turn = start[order], end[order], piece[order], turn[order]
        turns = np.searchsorted(turn, np.arange(sizes.max())).tolist()
        weight, last, back = np.full(len(text), FAR), np.full(len(text), self.other), np.full(len(text), -1)
        weight[begins] = 0.0
        for a, b in zip(turns, turns[1:], strict=False):
            s, e, p = start[a:b], end[a:b], piece[a:b]
            if self.merges:
                fits = self.follows(last[s], p)
                s, e, p = s[fits], e[fits], p[fits]
            w = weight[s] + self.cost[p]
            less = w < weight[e]  # of equal paths the one whose last piece begins first
            np.minimum.at(weight, e, w)
            least = less & (w == weight[e])
            last[e[least]], back[e[least]] = p[least], s[least]
        steps, at, of = [], begins + sizes - 1, np.arange(len(segments))
        while len(at):
            at, of, ids = back[at], of, last[at]
            steps.append((of, ids, text[at]))
            more = at > begins[of]
            at, of = at[more], of[more]
        of, ids, chars = (np.concatenate([x[k] for x in reversed(steps)]) for k in range(3))
        order = np.argsort(of, kind="stable")
        of, ids, chars = of[order], ids[order], chars[order]
        if (ids == self.other).any():
            raw = [self.fallback(chr(c)) if i == self.other else (i,) for i, c in zip(ids.tolist(), chars.tolist(), strict=True)]
            of, ids = np.repeat(of, list(map(len, raw))), np.array([i for r in raw for i in r])
        data, ends = ids.astype(np.int32).tobytes(), (4 * np.cumsum(np.bincount(of, minlength=len(segments)))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def cut(self, segment: str) -> list[str]:
        """A segment in parts: cut where no piece has the two neighbours side by side."""
        cuts = [0, *(k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in self.beside), len(segment)]
        return [segment[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def paths_of(self, segments: list[str]) -> list[bytes]:
        """The shortest path of each segment; long ones are cut first."""
        parts = {s: self.cut(s) for s in segments if len(s) > LONG}
        todo = list({*(s for s in segments if s not in parts), *chain(*parts.values())}) if parts else segments
        found: dict[str, bytes] = {}
        at = size = 0
        for k, s in enumerate(todo):
            size += len(s) + 1
            if size >= TOGETHER or k + 1 == len(todo):
                found |= zip(todo[at : k + 1], self.shortest(todo[at : k + 1]), strict=True)
                at, size = k + 1, 0
        return [b"".join(map(found.__getitem__, parts[s])) if s in parts else found[s] for s in segments]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = [self.segment.findall(self.normalise(text or "")) for text in texts]
        paths = self.paths.of(set(chain(*parts)))
        out = [np.frombuffer(b"".join(map(paths.__getitem__, of)), dtype=np.int32) for of in parts]
        if len(self.bytes) < 256:  # neighbouring unknown characters are one unknown piece
            out = [ids[np.concatenate([[True], (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)])] if len(ids) else ids for ids in out]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        if not self.partial[ids].any():
            out = "".join(map(self.read_as.__getitem__, ids.tolist()))
        else:
            raw = bytearray()
            for i in ids.tolist():
                if (b := self.byte_of.get(i)) is None:
                    raw += self.read_as[i].encode("utf-8", "replace")
                else:
                    raw.append(b)
            out = raw.decode("utf-8", "replace")
        out = out.replace(MARK, " ")
        return out.removeprefix(" ") if self.prefix else out


def _machine(model) -> Transducer:
    key, data = model.value
    return held(key, lambda: Transducer(parse_model(data)))


def _sent(spark: SparkSession, model_file: str):
    """The bytes of a model file, for all tasks; a model that cannot be compiled is an error here."""
    with open(model_file, "rb") as f:
        data = f.read()
    parse_model(data)
    return spark.sparkContext.broadcast((("pieces", hash(data)), data))


def encode_documents(docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, piece_ids, n_pieces and round_trip (decoding gives the text back) of every document."""
    model = _sent(ship(docs.sparkSession), model_file)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(1).to_pylist()
                ids = machine.encode_all(texts)
                counts = list(map(len, ids))
                same = [machine.decode(found) == (text or "") for found, text in zip(ids, texts, strict=True)]
                ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists, pa.array(counts, pa.int32()), pa.array(same)], ["doc_id", "piece_ids", "n_pieces", "round_trip"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id long, piece_ids array<int>, n_pieces int, round_trip boolean"
    )


def decode_documents(encoded: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id and text of rows with doc_id and piece_ids; null ids give an empty text."""
    model = _sent(ship(encoded.sparkSession), model_file)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model)
        for batch in batches:
            texts = [machine.decode(np.array(ids.as_py() or [], dtype=np.int32)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "piece_ids").mapInArrow(rows, "doc_id long, text string")


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
