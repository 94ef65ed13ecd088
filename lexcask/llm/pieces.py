"""SentencePiece encoding that keeps every piece's place in the original bytes.

The model's compiled character map (a double array of byte transitions, then the
replacements) is read here: at each place the longest prefix it holds is
replaced, or one character is kept, and each normalized byte remembers the
original byte it came from.  White space is then handled as the model says, and
pieces of the normalized text project to spans of original bytes.

No piece of such models joins a word to the marker after it, so normalized text
is cut before single markers and words are encoded once and remembered (the
memory is bounded).  A model that has such pieces is used on whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import core

MARK = "▁"
MEMORY = 200_000
TEXTS = 64

_CUT = re.compile(f"(?<!{MARK}){MARK}(?=[^{MARK}])", re.S)


class CharsMap:
    """The compiled character map; an empty one keeps all."""

    def __init__(self, blob: bytes):
        self.units: list[int] = []
        self.text = b""
        if blob:
            n = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob, "<u4", n // 4, 4).tolist()
            self.text = blob[4 + n :]

    def longest(self, b: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes that the longest known prefix at this place takes, and what replaces them."""
        units, best = self.units, None
        if not units:
            return None
        node = self._offset(units[0])
        for i in range(at, len(b)):
            node ^= b[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != b[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = units[node] & 0x7FFFFFFF
                best = (i + 1 - at, value)
        if best is None:
            return None
        return best[0], self.text[best[1] : self.text.index(b"\0", best[1])]

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)


class Encoder:
    """Ids, spans and decoded text of whole texts, as the sentencepiece library gives them."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(path, "rb") as f:
            blob = f.read()
        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(blob)
        spec = model.normalizer_spec
        self.map = CharsMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.suffix = model.trainer_spec.treat_whitespace_as_suffix
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=blob)
        # The same pieces on text that is normalized already.
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.bare = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.size = np.array([1 if p.type == p.BYTE else len(p.piece.encode()) for p in model.pieces], np.int64)
        self.unknown = {i for i, p in enumerate(model.pieces) if p.type == p.UNKNOWN}
        self.cuts = self.escape and not self.suffix and not any(MARK in p.piece.lstrip(MARK) for p in model.pieces if p.type != p.CONTROL) and not any(p.type == p.USER_DEFINED for p in model.pieces)
        self.known: dict[str, np.ndarray] = {}
        self.odd: dict[str, str] = {}

    def normalize(self, text: str) -> tuple[str, np.ndarray | None]:
        """Normalized text; for each of its bytes (and its end) the original byte, or None where plain rules give it."""
        if not self.map.units and not self.squeeze:
            lead = MARK if self.prefix and text and self.escape and not self.suffix else " " if self.prefix and text and not self.suffix else ""
            tail = (MARK if self.escape else " ") if self.prefix and text and self.suffix else ""
            return lead + (text.replace(" ", MARK) if self.escape else text) + tail, None
        b = text.encode()
        out, back, at = bytearray(), [], 0
        while at < len(b):
            hit = self.map.longest(b, at)
            if hit is None:
                k = 1
                while at + k < len(b) and b[at + k] & 0xC0 == 0x80:
                    k += 1
                hit = k, b[at : at + k]
            out += hit[1]
            back += [at] * len(hit[1])
            at += hit[0]
        back.append(len(b))
        chars = list(bytes(out))
        if self.squeeze:
            keep, last = [], 32
            for i, c in enumerate(chars):
                if c != 32 or last != 32:
                    keep.append(i)
                last = c
            while keep and chars[keep[-1]] == 32:
                keep.pop()
            end = back[keep[-1] + 1] if keep else len(b)
            chars, back = [chars[i] for i in keep], [*(back[i] for i in keep), end]
        if self.prefix and chars:
            if self.suffix:
                chars, back = [*chars, 32], [*back, back[-1]]
            else:
                chars, back = [32, *chars], [back[0], *back]
        if self.escape:
            mark = MARK.encode()
            new, where = bytearray(), []
            for c, o in zip(chars, back):
                new += mark if c == 32 else bytes([c])
                where += [o] * (3 if c == 32 else 1)
            return new.decode("utf-8", "replace"), np.array([*where, back[-1]], np.int64)
        return bytes(chars).decode("utf-8", "replace"), np.array(back, np.int64)

    def _plain_places(self, text: str) -> np.ndarray:
        """As normalize gives it, where only spaces become markers."""
        raw = np.frombuffer(text.encode(), np.uint8)
        width = np.where((raw == 32) & self.escape, 3, 1)
        places = np.repeat(np.arange(len(raw)), width)
        lead = np.zeros(3 if self.escape else 1, np.int64) if self.prefix and text and not self.suffix else np.zeros(0, np.int64)
        tail = np.full(3 if self.escape else 1, len(raw)) if self.prefix and text and self.suffix else np.zeros(0, np.int64)
        return np.concatenate([lead, places, tail, [len(raw)]])

    def _learn(self, parts: list[list[str]]) -> None:
        new = set().union(*[p[1:] for p in parts]).difference(self.known)
        if len(self.known) + len(new) > MEMORY:
            self.known.clear()
            self.odd.clear()
            new = set().union(*[p[1:] for p in parts])
        new = list(new)
        found = self.bare.encode([MARK + p for p in new], num_threads=1) if new else []
        for p, ids, back in zip(new, found, self.lib.decode(found) if new else []):
            self.known[p] = np.array(ids, "<i4").tobytes()
            if back != p:
                self.odd[p] = back

    def encode(self, texts: list[str | None], spans: bool = True) -> list[tuple[bytes, np.ndarray | None, str]]:
        """(ids as 32-bit bytes, ends of the pieces in original bytes, decoded text) of each text; a null one is empty."""
        out = []
        for lo in range(0, len(texts), TEXTS):
            group = [t or "" for t in texts[lo : lo + TEXTS]]
            normal = [self.normalize(t) for t in group]
            parts = [_CUT.split(n) if self.cuts else [n] for n, _ in normal]
            self._learn(parts)
            heads = self.bare.encode([p[0] for p in parts], num_threads=1)
            get, odd = self.known.__getitem__, self.odd
            for text, (norm, places), part, head in zip(group, normal, parts, heads):
                ids = np.array(head, "<i4").tobytes() + b"".join(map(get, part[1:]))
                if len(part) == 1:
                    decoded = self.lib.decode(head)
                else:
                    rest = [odd.get(p, p) for p in part[1:]] if odd else part[1:]
                    decoded = " ".join(rest)
                    if part[0]:
                        decoded = self.lib.decode(head) + " " + decoded
                ends = self._ends(text, norm, places, np.frombuffer(ids, "<i4")) if spans else None
                out.append((ids, ends, decoded))
        return out

    def _ends(self, text: str, norm: str, places: np.ndarray | None, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        if self.unknown and np.isin(ids, list(self.unknown)).any():
            size = np.array([len(p.surface.encode()) for p in self.bare.encode(norm, return_type="proto").pieces], np.int64)
        if places is None:
            if self.escape and self.prefix and not self.suffix:
                # Each marker but the first stands for one byte where it has three.
                at = np.cumsum(size)
                marks = np.cumsum(np.frombuffer(norm.encode(), np.uint8) == 0xE2) if MARK in text else None
                if marks is None:
                    raw = np.frombuffer(norm.encode(), np.uint8)
                    lead = np.zeros(len(raw) + 1, np.int64)
                    is_mark = (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81) if len(raw) > 2 else np.zeros(0, bool)
                    lead[1 : 1 + len(is_mark)] = is_mark
                    return np.maximum(at - 2 * np.cumsum(lead)[at] - 1, 0)
            places = self._plain_places(text)
        return places[np.cumsum(size)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder, which remembers words from one task to the next."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


SCHEMA = "id {}, ids array<int>, ends array<int>, decoded string"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                done = coder.encode(part.column("text").to_pylist())
                sizes = np.array([0, *[len(i) // 4 for i, _, _ in done]])
                at = pa.array(np.cumsum(sizes), pa.int32())
                ids = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(i for i, _, _ in done))])
                ends = pa.array(np.concatenate([e for _, e, _ in done]).astype(np.int32) if done else [], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(at, ids), pa.ListArray.from_arrays(at, ends), pa.array([d for _, _, d in done], pa.string())], ["id", "ids", "ends", "decoded"])

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """id_col, ids, ends (a piece's span runs from the end before, or 0, to its own, in original bytes), decoded.

    Ids are the library's, without begin or end ids; decoded is its decode(ids).

    Nulls: a null text is empty and has no ids; a null id stays null.  Repeated
    rows are encoded as often as they occur.  An empty table gives none; a text of any
    length is encoded whole.  Other columns are not read, whatever their names.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(_encode(model or piece_path()), SCHEMA.format(dict(rows.dtypes)["id"])).withColumnRenamed("id", id_col)


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10(spark, sf_dir):
    out = encode(core.table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_bytes"),
    )
