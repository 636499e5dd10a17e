"""SentencePiece encoding that keeps byte offsets, and decoding.

Normalisation is done here: longest-prefix matches through the model's compiled character map (a
double-array trie of UTF-8 prefixes and their replacements), white-space rules and the word-begin prefix,
recording for each normalised byte the bytes of the original it stands for. Places at which no prefix can begin are
passed over in one sweep, whatever the map. The model's own segmentation is
then applied to the normalised text, with the model's normaliser overridden by the identity, and every piece
is projected to a span of original bytes. Models with user-defined symbols are refused: their symbols pass the
normaliser unchanged, which the identity could not tell.

Defined results: null and empty texts have no pieces and decode to an empty text. Whole texts are encoded.
Repeated rows are encoded one by one; extra columns are kept, and columns of docs named like a result are
replaced.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veldspar.llm._shared import carried

#: U+2581, which stands for a space in pieces.
MARK = "▁".encode()


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = message[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(message):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, message[at : at + n]
            at += n


class CharacterMap:
    """A compiled character map: a size, a double array of 32-bit units, and zero-ended replacements."""

    def __init__(self, compiled: bytes):
        size = struct.unpack("<I", compiled[:4])[0] if compiled else 0
        self.units = np.frombuffer(compiled[4 : 4 + size], "<u4").tolist()
        self.texts = compiled[4 + size :]
        root = self._offset(self.units[0]) if self.units else 0
        #: Finds the bytes with which a prefix can begin; None if there are none.
        leads = [b for b in range(1, 256) if (at := root ^ b) < len(self.units) and (self.units[at] & 0x800000FF) == b]
        self.leads = re.compile(b"[" + b"".join(re.escape(bytes([b])) for b in leads) + b"]") if leads else None

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes of the longest prefix at a place that the map replaces, and its replacement."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._offset(units[0])
        for n in range(at, len(data)):
            node ^= data[n]
            if node >= len(units) or (units[node] & 0x800000FF) != data[n]:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                found = (n + 1 - at, self.texts[value : self.texts.index(b"\0", value)])
        return found


class Normaliser:
    """The rules of a model's normaliser, with alignment."""

    def __init__(self, spec: bytes = b""):
        given = dict(_fields(spec))
        self.map = CharacterMap(bytes(given.get(2, b"")))
        self.prefix, self.squeeze, self.escape = (bool(given.get(k, 1)) for k in (3, 4, 5))

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the original byte it starts at."""
        text, starts = self._mapped(data)
        end = len(data)
        if self.squeeze:
            last = len(text)
            while last and text[last - 1] == 32:
                last -= 1
                end = int(starts[last])
            text, starts = text[:last], starts[:last]
        grown = np.ones(len(text), np.int64)
        if self.escape:
            grown[text == 32] = len(MARK)
        space = MARK if self.escape else b" "
        front = len(space) if self.prefix and len(text) else 0
        first = int(starts[0]) if len(starts) else 0
        out = text.tobytes().replace(b" ", space)
        return (space if front else b"") + out, np.concatenate((np.full(front, first, np.int64), np.repeat(starts, grown), [end]))

    def _mapped(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The text with prefixes replaced and, if the model squeezes white space, without spaces after a space or in
        front, and the original byte of each byte."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        at, blank = 0, True

        def copied(upto: int) -> None:
            """What no prefix replaces, each byte as it is."""
            nonlocal blank
            if upto == at:
                return
            text, starts = np.frombuffer(data, np.uint8, upto - at, at), np.arange(at, upto)
            if self.squeeze:
                spaces = text == 32
                stays = ~(spaces & np.concatenate(([blank], spaces[:-1])))
                blank = bool(spaces[-1])
                text, starts = text[stays], starts[stays]
            parts.append((text, starts))

        while self.map.leads is not None and (lead := self.map.leads.search(data, at)) is not None:
            place = lead.start()
            # From one possible place to the next, until a prefix is found.
            while (found := self.map.longest(data, place)) is None:
                step = self.map.leads.search(data, place + 1)
                if step is None:
                    break
                place = step.start()
            if found is None:
                break
            copied(place)
            n, new = found
            if self.squeeze and blank:
                new = new.lstrip(b" ")
            if new:
                parts.append((np.frombuffer(new, np.uint8), np.full(len(new), place)))
                blank = new.endswith(b" ")
            at = place + n
        copied(len(data))
        if not parts:
            return np.zeros(0, np.uint8), np.zeros(0, np.int64)
        return np.concatenate([t for t, _ in parts]), np.concatenate([p for _, p in parts])


class PieceModel:
    """A sentencepiece model whose normaliser runs here."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:
            model = f.read()
        fields = list(_fields(model))
        self.normalise = Normaliser(b"".join(v for k, v in fields if k == 3))
        self.full = sentencepiece.SentencePieceProcessor(model_proto=model)
        # A later field overrides: no map (2), no prefix (3), no squeezing (4), no escaping (5).
        identity = bytes([2 << 3 | 2, 0, 3 << 3, 0, 4 << 3, 0, 5 << 3, 0])
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([3 << 3 | 2, len(identity)]) + identity)
        n = self.full.vocab_size()
        if any(kind == 4 for k, v in fields if k == 1 for number, kind in _fields(v) if number == 3):
            raise ValueError("models with user-defined symbols are not supported")
        self.sizes = np.array([1 if self.full.is_byte(i) else len(self.full.id_to_piece(i).encode()) for i in range(n)], np.int64)
        self.unknown = self.full.unk_id()

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and the first and last-plus-one original byte of each piece."""
        data = (text or "").encode("utf-8", "surrogatepass")
        normal, starts = self.normalise(data)
        ids = np.array(self.inner.encode(normal.decode("utf-8", "surrogatepass")), np.int32)
        if (ids == self.unknown).any():
            found = self.inner.encode(normal.decode(), out_type="immutable_proto").pieces
            sizes = np.array([len(p.surface.encode()) for p in found], np.int64)
        else:
            sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        return ids, starts[ends - sizes].astype(np.int32), starts[ends].astype(np.int32)

    def decode(self, ids: list[int]) -> str:
        return self.full.decode(ids)


def encode(docs: DataFrame, model_path: str, text_col: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """docs with ids, decoded, and the spans of the pieces: begins and ends (bytes), or, without spans,
    the number of original bytes that they cover alone."""
    new = {"ids": T.ArrayType(T.IntegerType()), "decoded": T.StringType(), "covered_bytes": T.LongType()}
    if spans:
        new |= {"begins": T.ArrayType(T.IntegerType()), "ends": T.ArrayType(T.IntegerType())}
    kept = carried(docs, keep, new)
    # A text that is carried along goes to Python once.
    place = kept.index(text_col) if text_col in kept else len(kept)
    source = docs.select(*kept) if place < len(kept) else docs.select(*kept, docs[text_col].alias("__text"))
    schema = T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(n, t) for n, t in new.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel(model_path)

        def lists(arrays: list[np.ndarray]) -> pa.Array:
            offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
            return pa.ListArray.from_arrays(offsets, np.concatenate(arrays) if arrays else np.zeros(0, np.int32))

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [model.encode(t.as_py()) for t in part.column(place)]
                decoded = [model.decode(ids.tolist()) if len(ids) else "" for ids, _, _ in found]
                columns = [lists([x[0] for x in found]), pa.array(decoded, pa.string()), pa.array([int((e - b).sum()) for _, b, e in found], pa.int64())]
                if spans:
                    columns += [lists([x[1] for x in found]), lists([x[2] for x in found])]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *columns], names=[*kept, *new])

    return source.mapInArrow(run, schema)
