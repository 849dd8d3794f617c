"""Whole texts to token ids with the tokenizers library, on Arrow batches.

The byte-level tokenizer cuts a text before each space that follows a non-space, around other white space
and at the end of each run of letters, so the ids of a text are the joined ids of such pieces. Pieces repeat:
each worker remembers the ids of the pieces it has met (a bounded table) and has the library encode new ones.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeframe.llm.stored import in_batches
from wakeframe.llm.words import U, blocks, hashes, per_process, stream

END = 0
# Pieces that a worker remembers, some 40 bytes each, and how many new ones are sorted in at a time.
KNOWN_PIECES = 1_000_000
FRESH_PIECES = 200_000
# Text that is cut up and looked up at a time.
ENCODE_BYTES = 1 << 20
# Latin letters (fixed values), with the space before them.
_WORD = re.compile(" ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")


def _byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    odd = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(odd)}


# Classes of UTF-8 bytes: space, other white space, parts of Latin letters, other ASCII signs, and the rest.
SPACE, WHITE, LETTER, SIGN, OTHER = range(5)


def _classes() -> np.ndarray:
    t = np.full(256, OTHER, np.uint8)
    t[0x21:0x7F] = SIGN
    t[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0xC0), *range(0xC3, 0xCA)]] = LETTER
    t[0x20], t[0x09:0x0E] = SPACE, WHITE
    return t


def piece_starts(kind: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces begin in consecutive documents without bytes of class OTHER.

    ``kind`` holds the bytes' classes and ``at`` the documents' places. A piece is a run of letters with the
    space before it; the rest of a run of non-spaces, with the space before it if no letters come first; or
    the white space before that, of which a last sign other than a space is one by itself.
    """
    n = len(kind)
    opens = np.zeros(n + 1, bool)
    opens[at] = True
    dark = kind > WHITE
    before = np.zeros(n, bool)
    before[1:] = dark[:-1]
    fresh = opens[:n]
    cut = fresh | (dark != before)  # both kinds of runs
    first = np.flatnonzero(dark & (fresh | ~before))  # of a run of non-spaces
    inner = first[~fresh[first]]
    cut[inner - 1] = True  # the space that goes with it, or a last white space of its own
    joined = inner[kind[inner - 1] == SPACE]
    cut[joined] = False
    letter = kind == LETTER
    was = np.zeros(n, bool)
    was[1:] = letter[:-1]
    turn = np.flatnonzero(dark & ~letter & was & ~fresh)  # where a run of letters ends before a sign
    run = first[np.searchsorted(first, turn, "right") - 1] if len(turn) else turn
    change = np.flatnonzero(letter & ~(was & ~fresh))  # where a run of letters begins
    cut[turn[change[np.searchsorted(change, turn, "right") - 1] == run]] = True
    return np.flatnonzero(cut)


class _Table:
    """Sorted piece hashes, and where the ids of each piece are."""

    def __init__(self, keys=None, at=None, n=None):
        self.keys = np.empty(0, U) if keys is None else keys
        self.at = np.empty(0, np.int64) if at is None else at
        self.n = np.empty(0, np.int32) if n is None else n

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, whether they hold the key) of sorted keys."""
        place = np.searchsorted(self.keys, keys)
        place[place == len(self.keys)] = 0
        return place, (self.keys[place] == keys) if len(self.keys) else np.zeros(len(keys), bool)

    def merged(self, other: _Table) -> _Table:
        keys = np.concatenate([self.keys, other.keys])
        order = np.argsort(keys, kind="stable")
        return _Table(keys[order], np.concatenate([self.at, other.at])[order], np.concatenate([self.n, other.n])[order])


class Encoder:
    """Ids of texts as unsigned 32-bit integers."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.byte_level = _is_byte_level(self.tokenizer)
        self.classes, self.table = _classes(), stream(31, 256)
        self._forget()

    def _forget(self) -> None:
        self.known, self.fresh = _Table(), _Table()
        self.ids, self.used = np.empty(1 << 16, np.uint32), 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [struct.pack(f"<{len(x.ids)}I", *x.ids) for x in got]

    def _encoded(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces. One run of letters is one unit of the vocabulary's merges; others take the library's whole way."""
        letters, merge, word = self.letters, self.tokenizer.model.tokenize, _WORD.fullmatch
        out, rest = [], []
        for k, piece in enumerate(pieces):
            text = piece.decode()
            if word(text):
                out.append([t.id for t in merge(piece.decode("latin-1").translate(letters))])
            else:
                out.append([])
                rest.append((k, text))
        if rest:
            for (k, _), got in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)):
                out[k] = got.ids
        return out

    def _places(self, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``self.ids`` each piece's ids begin, and how many they are; new pieces are encoded."""
        if len(self.known.keys) + len(self.fresh.keys) > KNOWN_PIECES:
            self._forget()
        place, old = self.known.find(keys)
        place_fresh, recent = self.fresh.find(keys)
        new = np.flatnonzero(~old & ~recent)
        if len(new):
            got = self._encoded([raw[a:z] for a, z in zip(starts[new].tolist(), ends[new].tolist())])
            n = np.fromiter(map(len, got), np.int32, len(got))
            total = int(n.sum())
            if self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(max(total, len(self.ids)), np.uint32)])
            self.ids[self.used : self.used + total] = np.fromiter((i for g in got for i in g), np.uint32, total)
            self.fresh = self.fresh.merged(_Table(keys[new], self.used + np.cumsum(n, dtype=np.int64) - n, n))
            self.used += total
            place_fresh, recent = self.fresh.find(keys)
        at, n = np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
        for table, spot, own in ((self.known, place, old), (self.fresh, place_fresh, recent)):
            at[own], n[own] = table.at[spot[own]], table.n[spot[own]]
        if len(self.fresh.keys) > FRESH_PIECES:
            self.known, self.fresh = self.known.merged(self.fresh), _Table()
        return at, n

    def encode(self, data: np.ndarray, at: np.ndarray) -> list[bytes]:
        """Little-endian ids of consecutive documents (UTF-8 bytes and their places).

        Texts with a special token's string, with characters other than ASCII and Latin letters, or for
        another kind of tokenizer, go whole to the library.
        """
        n = len(at) - 1
        kind = self.classes[data]
        signs = (kind == LETTER) & (data == 0xC3) & np.append(np.isin(data[1:], (0x97, 0xB7)), False)  # no letters: times, divided by
        odd = np.flatnonzero((kind == OTHER) | signs)
        slow = np.zeros(n, bool)
        slow[np.searchsorted(at, odd, "right") - 1] = True
        raw = data.tobytes()
        if not self.byte_level:
            slow[:] = True
        elif any(s in raw for s in self.special):
            slow |= [any(s in raw[a:z] for s in self.special) for a, z in zip(at.tolist(), at[1:].tolist())]
        out: list[bytes] = [b""] * n
        some = np.flatnonzero(slow)
        for d, ids in zip(some.tolist(), self._whole([raw[at[d] : at[d + 1]].decode() for d in some])):
            out[d] = ids
        plain = np.flatnonzero(~slow)
        if len(some):
            kept = np.repeat(~slow, np.diff(at))
            data, kind = data[kept], kind[kept]
            at = np.concatenate([[0], np.cumsum(np.diff(at)[plain])])
        if not len(data):
            return out
        starts = piece_starts(kind, at)
        ends = np.append(starts[1:], len(data))
        keys, where, inverse = np.unique(hashes(data, starts, ends, self.table), return_index=True, return_inverse=True)
        first, size = self._places(keys, starts[where], ends[where], data.tobytes())
        own = size[inverse]
        stop = np.cumsum(own)
        ids = self.ids[np.repeat(first[inverse] - (stop - own), own) + np.arange(stop[-1])].astype("<u4").tobytes()
        piece = np.searchsorted(starts, at)
        edge = 4 * np.append(0, stop)[piece]
        for d, a, z in zip(plain.tolist(), edge.tolist(), edge[1:].tolist()):
            out[d] = ids[a:z]
        return out


def _is_byte_level(tokenizer) -> bool:
    """Whether pieces may be encoded alone: byte-level cuts, no prefix space, no normaliser, plain merges."""
    import json

    made = json.loads(tokenizer.to_str())
    cut, model = made.get("pre_tokenizer") or {}, made["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("unk_token"):
        return False
    return cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True) and not made.get("normalizer")


def encoder(path: str) -> Encoder:
    return per_process(("encoder", path), lambda: Encoder(path))


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


def encoded(path: str, column: pa.Array, end: int | None = END) -> Iterator[tuple[int, bytes]]:
    """(row, little-endian ids with ``end`` appended) of each text of an Arrow column; a null is an empty text."""
    tail = b"" if end is None else struct.pack("<I", end)
    encode = encoder(path).encode
    for lo, _, text, at in blocks(column, ENCODE_BYTES):
        for k, data in enumerate(encode(text, at), lo):
            yield k, data + tail


def tokenize(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = END, max_length: int | None = None) -> DataFrame:
    """(doc_id, piece INT, start BIGINT, length BIGINT, ids BINARY): ids of whole texts, ``end`` appended.

    Without ``max_length`` a document is one piece. With it a longer document is cut into pieces of that
    length, of which only the first may be shorter. ``ids`` holds little-endian unsigned 32-bit integers.
    A null text is empty; an empty text has only its end id (no row if ``end`` is None). Rows that repeat
    an id, and rows without one, are documents of their own. Other columns are not read.
    """
    def run(batches):
        for batch in batches:
            ids, made, size = batch.column(0), [], 0
            for k, data in encoded(path, batch.column(1), end):
                n, at, piece = len(data) // 4, 0, 0
                while at < n:
                    stop = n if not max_length else at + ((n - at - 1) % max_length + 1)
                    made.append((k, piece, at, stop - at, data[4 * at : 4 * stop]))
                    at, piece = stop, piece + 1
                size += len(data)
                if size >= 4 << 20:
                    yield _pieces(ids, made)
                    made, size = [], 0
            if made:
                yield _pieces(ids, made)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return in_batches(rows, run, f"doc_id {kind}, piece int, start bigint, length bigint, ids binary")


def _pieces(ids: pa.Array, made: list[tuple]) -> pa.RecordBatch:
    rows, piece, start, length, data = zip(*made)
    return pa.RecordBatch.from_arrays(
        [
            ids.take(pa.array(rows, pa.int32())),
            pa.array(piece, pa.int32()),
            pa.array(start, pa.int64()),
            pa.array(length, pa.int64()),
            pa.array(data, pa.binary()),
        ],
        ["doc_id", "piece", "start", "length", "ids"],
    )


def unpack_le(data: bytes) -> np.ndarray:
    """Ids of a piece."""
    return np.frombuffer(data, "<u4")
