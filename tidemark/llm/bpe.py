"""Byte-level BPE encoding and decoding through a sentencepiece model built from a rank file.

The rank file is turned into a sentencepiece BPE model by writing its protobuf
fields directly: byte b becomes the character U+0100 + b, a token becomes the
string of its bytes' characters, and its score is minus its rank, so that the
best-scored merge is the merge of lowest rank. Normalisation is the identity.
Each match of the pre-token pattern is encoded by itself; pieces keep the ids of
the rank file. Decoding joins the bytes of the pieces.

Whole pre-tokens that are in the vocabulary keep their own id, as the rank
libraries do. Encoded pre-tokens are kept in bounded tables per Python worker,
which changes nothing but the speed.

A null text is encoded as the empty text: no ids. Any other column passes
through; ``ids`` and ``decoded`` replace columns of these names.
"""

from __future__ import annotations

import base64
import contextlib
import hashlib
import struct
from array import array
from collections.abc import Iterator
from itertools import chain

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType

#: Pre-token pattern of the public byte-level rank files (a fixed value; public_tokenizers.PATTERN is the same).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: \s of the rank libraries is the Unicode property White_Space; Python's also has U+001C to U+001F.
WHITE, NOT_WHITE = r"\p{White_Space}", r"\P{White_Space}"
CACHE = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a .tiktoken file (base64, space, rank on each line)."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def as_characters(token: bytes) -> str:
    return "".join(chr(0x100 + b) for b in token)


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(number: int, n: int) -> bytes:
    return _varint(number << 3) + _varint(n)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces in rank order, then the unknown piece."""
    tokens = sorted(ranks, key=ranks.get)
    if [ranks[t] for t in tokens] != list(range(len(tokens))):
        raise ValueError("ranks must run from 0 without gaps")
    piece = lambda text, score, kind: _field(1, _field(1, text.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", score) + _number(3, kind))
    pieces = b"".join(piece(as_characters(t), -float(r), 1) for r, t in enumerate(tokens)) + piece("<unk>", 0.0, 2)
    trainer = _number(3, 2) + _number(4, len(tokens) + 1) + _number(40, len(tokens))  # BPE, vocabulary size, unk id
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return pieces + _field(2, trainer) + _field(3, normaliser)


def pretoken_pattern(pattern: str = PATTERN) -> str:
    """The pattern with \\s and \\S written as the White_Space property."""
    return pattern.replace(r"[^\s", rf"[^{WHITE}").replace(r"\s", WHITE).replace(r"\S", NOT_WHITE)


class Encoder:
    """Encodes texts to packed little-endian 32-bit ids.

    A single space between two visible characters always begins a pre-token, so
    a text is cut there and the ids of each part (with its space) are kept in a
    bounded table. A text with a part that is empty or begins or ends with white
    space is matched as a whole. Both tables are emptied when they are full.
    """

    def __init__(self, ranks: dict[bytes, int], model: bytes, pattern: str, limit: int = CACHE):
        import regex
        import sentencepiece

        self.limit, self.parts, self.odd = limit, {}, set()
        self.whole = {}  # pre-tokens that are tokens
        for token, rank in ranks.items():
            with contextlib.suppress(UnicodeDecodeError):
                self.whole[token.decode()] = rank.to_bytes(4, "little")
        self.tokens = dict(self.whole)
        self.split = regex.compile(pretoken_pattern(pattern)).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.table = {b: chr(0x100 + b) for b in range(256)}

    def pretokens(self, tokens: set[str]) -> dict[str, bytes]:
        """Learn new pre-tokens; the table of all known ones."""
        if rest := list(tokens.difference(self.tokens)):
            mapped = "\n".join(rest).encode().decode("latin-1").translate(self.table).split(self.table[10])
            if len(mapped) != len(rest):  # a pre-token holds a line feed
                mapped = [t.encode().decode("latin-1").translate(self.table) for t in rest]
            ids = self.model.encode(mapped, num_threads=1)
            self.tokens.update(zip(rest, [array("i", x).tobytes() for x in ids], strict=True))
        return self.tokens

    def learn(self, fresh: set[str]) -> None:
        odd = {p for p in fresh if not p or p[0].isspace() or p[-1].isspace()}
        self.odd |= odd
        self.parts.update(dict.fromkeys(odd, b""))
        cut = {p: self.split(" " + p) for p in fresh - odd}
        ids = self.pretokens(set(chain.from_iterable(cut.values()))).__getitem__
        self.parts.update({p: b"".join(map(ids, tokens)) for p, tokens in cut.items()})

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        if len(self.parts) > self.limit:
            self.parts, self.odd = {}, set()
        if len(self.tokens) > self.limit:
            self.tokens = dict(self.whole)
        cut = [t.split(" ") if t else [] for t in texts]
        if fresh := set(chain.from_iterable(cut)).difference(self.parts):
            self.learn(fresh)
        out = []
        for text, parts in zip(texts, cut, strict=True):
            if not parts:
                out.append(b"")
                continue
            plain = self.odd.isdisjoint(parts)
            tokens = self.split(parts[0] if plain else text)
            head = b"".join(map(self.pretokens(set(tokens)).__getitem__, tokens))
            out.append(head + b"".join(map(self.parts.__getitem__, parts[1:])) if plain else head)
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(key: str, shared, pattern: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*shared.value, pattern)
    return _encoders[key]


def _add(schema, name: str, kind):
    out = type(schema)([f for f in schema.fields if f.name != name])
    return out.add(name, kind, False)


def encode(df: DataFrame, path: str, *, pattern: str = PATTERN, text: str = "text") -> DataFrame:
    """Add ``ids`` (array of int), the byte-level BPE ids of ``text``."""
    spark: SparkSession = df.sparkSession
    ranks = read_ranks(path)
    model = serialise(ranks)
    key = hashlib.sha256(model + pattern.encode()).hexdigest()
    shared = spark.sparkContext.broadcast((ranks, model))  # bounded by the vocabulary

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        encoder = encoder_of(key, shared, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # few texts at a time bound the memory of a batch
                part = batch.slice(start, 256)
                packed = encoder.encode_all(part.column(text).to_pylist())
                ends = [0]
                for p in packed:
                    ends.append(ends[-1] + len(p) // 4)
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(packed))])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                keep = [i for i, n in enumerate(part.schema.names) if n != "ids"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), ids], [*(part.schema.names[i] for i in keep), "ids"])

    return df.mapInArrow(run, _add(df.schema, "ids", ArrayType(IntegerType(), False)))


def decode(df: DataFrame, path: str, *, ids: str = "ids") -> DataFrame:
    """Add ``decoded`` (binary), the bytes of the tokens of ``ids``."""
    ranks = read_ranks(path)
    shared = df.sparkSession.sparkContext.broadcast(sorted(ranks, key=ranks.get))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        token = shared.value.__getitem__
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                column = part.column(ids)
                out = pa.array([b"".join(map(token, x.values.to_pylist() if x.is_valid else ())) for x in column], pa.binary())
                keep = [i for i, n in enumerate(part.schema.names) if n != "decoded"]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in keep), out], [*(part.schema.names[i] for i in keep), "decoded"])

    return df.mapInArrow(run, _add(df.schema, "decoded", BinaryType()))


def digests(df: DataFrame) -> DataFrame:
    """Columns derived from ids and decoded: n_tokens, ids_sha256, decoded_sha256."""
    return df.withColumns(
        {
            "n_tokens": F.size("ids").cast("long"),
            "ids_sha256": F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256),
            "decoded_sha256": F.sha2("decoded", 256),
        }
    )
