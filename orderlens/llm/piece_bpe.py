"""SentencePiece encoding and decoding, exact for merge-type models, by backtracking.

A merge-type (BPE) model defines the pieces of a text as the outcome of greedy merging. A sequence of pieces
is that outcome exactly if every piece, and every pair of neighbours, comes back unchanged from merging its
own characters again. So the encoder walks the text from left to right: the Aho-Corasick automaton of the
vocabulary gives the longest piece at a position, shorter pieces follow along a chain of prefixes, a candidate
counts if it is compatible with the piece before it, and if none is, the piece before is taken back and its end
is marked in a bitfield of failed positions, so no position is tried twice.

Words are independent where no piece spans a word's end (checked on the vocabulary), so finished words
are looked up in a bounded cache; a text with new words only still goes through the automaton.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
#: Stands for a byte over 127; no text has it, as it is half a surrogate pair.
HIGH = "\ud800"


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message; nested messages stay bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[at : at + size]
        at += size


class PieceModel:
    """Encoder and decoder of one model file's bytes."""

    def __init__(self, data: bytes, cached_words: int = 150_000):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        trainer = normalizer = {}
        for number, value in fields(data):
            if number == 1:
                piece = {1: b"", 2: struct.pack("<f", 0), 3: NORMAL} | dict(fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(struct.unpack("<f", piece[2])[0])
                self.kinds.append(piece[3])
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or normalizer.get(2, b"") or normalizer.get(4, 1) or USER in self.kinds:
            raise ValueError("this encoder takes merge-type models with byte fallback, identity normalisation and no user-defined pieces")
        self.prefix = SPACE if normalizer.get(3, 1) else ""
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == NORMAL}
        self.byte_ids = [0] * 256
        for i, p in enumerate(self.pieces):
            if self.kinds[i] == BYTE:
                self.byte_ids[int(p[3:5], 16)] = i
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.shorter = [self._prefix_of(p) if self.kinds[i] == NORMAL else -1 for i, p in enumerate(self.pieces)]
        self.lengths = [len(p) for p in self.pieces]
        # Caches of two generations: a full one becomes the older, whose entries come back when they are asked for, so that frequent ones stay.
        self.pairs: dict[int, bool] = {}
        self.older_pairs: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        self.cached_words = cached_words
        self.known = set("".join(self.ids))
        # What each id adds to a text; a byte that isn't a character by itself sends the text to decode().
        self.shown = ["" if k == CONTROL else " ⁇ " if k == UNKNOWN else p if k != BYTE else chr(self.byte_of[i]) if self.byte_of[i] < 128 else HIGH for i, (p, k) in enumerate(zip(self.pieces, self.kinds))]
        # A word ends where white space starts, if no piece has white space after another character; a line feed stands alone, if no piece has one.
        apart = all(SPACE not in p.lstrip(SPACE) for p in self.ids)
        lines = "\n" not in self.known
        self.cut = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if apart and lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else "(?s).+")

    def _prefix_of(self, piece: str) -> int:
        """The longest other piece that piece starts with."""
        return next((self.ids[piece[:n]] for n in range(len(piece) - 1, 0, -1) if piece[:n] in self.ids), -1)

    def remerge(self, text: str) -> list[int]:
        """Greedy merging as the model defines it: best score first, then the leftmost pair. Only for a piece or two."""
        parts = list(text)
        while len(parts) > 1:
            best = None
            for i in range(len(parts) - 1):
                found = self.ids.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or self.scores[found] > best[0]):
                    best = (self.scores[found], i)
            if best is None:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ids[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """Do the two pieces (left: -1 for none) come back from merging their characters?"""
        key = left << 32 | right
        found = self.pairs.get(key)
        if found is None:
            found = self.older_pairs.get(key)
            if found is None:
                text = (self.pieces[left] if left >= 0 else "") + self.pieces[right]
                found = self.remerge(text) == ([left, right] if left >= 0 else [right])
            if len(self.pairs) >= self.cached_words:
                self.older_pairs, self.pairs = self.pairs, {}
            self.pairs[key] = found
        return found

    def backtrack(self, text: str) -> list[int]:
        """The pieces of a text of known characters."""
        lengths, shorter, known, iter_long, size = self.lengths, self.shorter, self.pairs.get, self.automaton.iter_long, len(text)
        failed: bytearray | None = None  # made at the first failure, as most stretches have none
        out: list[int] = []
        at, before, candidate = 0, -1, next(iter_long(text, 0))[1]
        while True:
            while candidate >= 0:
                end = at + lengths[candidate]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    fits = known(before << 32 | candidate)
                    if fits or fits is None and self.compatible(before, candidate):
                        break
                candidate = shorter[candidate]
            if candidate >= 0:
                out.append(candidate)
                if end == size:
                    return out
                at, before, candidate = end, candidate, next(iter_long(text, end))[1]
            else:
                failed = bytearray(size // 8 + 1) if failed is None else failed
                failed[at >> 3] |= 1 << (at & 7)
                taken = out.pop()
                at -= lengths[taken]
                before, candidate = out[-1] if out else -1, shorter[taken]

    def encode_word(self, word: str) -> bytes:
        """Packed ids of a stretch that the newer cache lacks. Characters outside the vocabulary become bytes; nothing merges across them."""
        packed = self.older_words.get(word)
        if packed is None:
            packed = self.packed_word(word)
        if len(word) <= 64:
            if len(self.words) >= self.cached_words // 2:
                self.older_words, self.words = self.words, {}
            self.words[word] = packed
        return packed

    def packed_word(self, word: str) -> bytes:
        if self.known.issuperset(word):
            ids = self.backtrack(word)
            return struct.pack(f"<{len(ids)}I", *ids)
        ids: list[int] = []
        start = 0
        for i, ch in enumerate(word):
            if ch not in self.known:
                ids += self.backtrack(word[start:i]) if i > start else []
                ids += [self.byte_ids[b] for b in ch.encode()]
                start = i + 1
        ids += self.backtrack(word[start:]) if start < len(word) else []
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_packed(self, text: str) -> tuple[bytes, int]:
        """Ids with begin and end as little-endian unsigned 32-bit integers, and their number."""
        stretches = self.cut.findall(self.prefix + text.replace(" ", SPACE)) if text else []
        held, new = self.words.get, self.encode_word
        packed = b"".join([struct.pack("<I", self.begin), *[held(w) or new(w) for w in stretches], struct.pack("<I", self.end)])
        return packed, len(packed) // 4

    def encode(self, text: str) -> list[int]:
        packed, n = self.encode_packed(text)
        return list(struct.unpack(f"<{n}I", packed))

    def decode(self, ids: list[int]) -> str:
        """The text: control pieces vanish, runs of byte pieces are UTF-8 (a broken byte reads U+FFFD), the first white space goes if encoding added one."""
        out: list[str] = []
        raw = bytearray()
        first = bool(self.prefix)
        for i in ids:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                first = False
                continue
            if raw:
                out.append(utf8(raw))
                raw.clear()
            if self.kinds[i] == CONTROL:
                continue
            piece = " ⁇ " if self.kinds[i] == UNKNOWN else self.pieces[i]
            out.append(piece[1:] if first and piece.startswith(SPACE) else piece)
            first = False
        if raw:
            out.append(utf8(raw))
        return "".join(out).replace(SPACE, " ")

    def decode_packed(self, packed: bytes) -> str:
        """decode() for packed ids: a join over a table of pieces, unless the text has byte pieces of several bytes."""
        ids = memoryview(packed).cast("I")
        text = "".join(map(self.shown.__getitem__, ids))
        if HIGH in text:
            return self.decode(ids.tolist())
        return (text[1:] if self.prefix and text.startswith(SPACE) else text).replace(SPACE, " ")


def utf8(raw: bytearray) -> str:
    """Decode bytes; each byte that starts no whole character reads U+FFFD on its own."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_models: dict[tuple[str, int], PieceModel] = {}


def model_of(data: bytes) -> PieceModel:
    """One model per Python worker, so that its caches outlive a task."""
    key = hashlib.sha256(data).hexdigest(), len(data)
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(data)
    return _models[key]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """id_col, n_tokens, ids (packed, little-endian unsigned 32-bit, with begin and end), decoded; a null text is the empty one.

    The model file (half a megabyte, whatever the input) is read by the driver and broadcast. No shuffle. with_text=False leaves
    out ids and decoded and gives only their digests. Repeated rows give repeated results; a null id stays null; an empty text has the begin
    and the end id; an empty table gives an empty result; other columns, whatever their names, are ignored.
    """
    with open(model_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(shared.value)
        for batch in batches:
            packed = [model.encode_packed(text)[0] for text in batch.column("text").to_pylist()]
            decoded = [model.decode_packed(p) for p in packed]
            out = {
                "id": batch.column("id"),
                "n_tokens": pa.array(np.array([len(p) // 4 for p in packed], np.int64)),
                "ids_sha256": pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded], pa.string()),
            }
            yield pa.RecordBatch.from_pydict(out | {"ids": pa.array(packed, pa.binary()), "decoded": pa.array(decoded, pa.string())} if with_text else out)

    return docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
