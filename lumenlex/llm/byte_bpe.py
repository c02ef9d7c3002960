"""Byte-level BPE encoding and decoding.

The rank file of a byte-level vocabulary is turned into a sentencepiece BPE model: every token's bytes are mapped to
printable characters, its score is its negative rank, and normalisation is the identity. sentencepiece then merges the
adjacent pair of highest score (the lowest rank) first, leftmost on ties, which is what byte-pair encoding by ranks does.
Texts are cut by the vocabulary's pattern and each distinct piece of a text is encoded once, or not at all if it is
remembered. Decoding maps the pieces' characters back to bytes; it works id by id, so a piece is decoded when it is
encoded, and what is remembered is whether that gave anything but the piece.

Defined results: null and empty texts have no tokens (n_tokens 0, the digests are those of empty bytes); rows are
independent, so repeated rows and repeated doc_id give repeated results and a null doc_id stays null; an empty table
gives an empty table; other columns of the input are ignored, whatever their names. Texts of any length are encoded
whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from lumenlex.llm.common import map_arrow, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters of distinct pieces, and of their ids in decimals, that a worker remembers; the memory starts anew beyond it.
REMEMBERED = 3_000_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """A printable character for every byte: itself where it is printable Latin-1, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, more = [], 0x100
    for byte in range(256):
        out.append(chr(byte if byte in own else more))
        more += byte not in own
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One protobuf field: varint, 32-bit float or length-delimited."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    value = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """The sentencepiece ModelProto of a rank table; a piece's place is its place in rank order, <unk> stands last."""
    normal, unknown, bpe, absent = 1, 2, 2, -1
    characters = byte_characters()
    out = bytearray()
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        out += _field(1, _field(1, "".join(characters[b] for b in token)) + _field(2, float(-rank)) + _field(3, normal))
    out += _field(1, _field(1, "<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_field(n, absent) for n in (41, 42, 43))
    normalizer = _field(1, "identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return bytes(out) + _field(2, trainer) + _field(3, normalizer)


def _members(escape: str) -> str:
    """The code points below U+10000 of a Unicode escape, as the inside of a character class."""
    every = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x10000))))
    runs = (x[0] for x in regex.finditer(f"(?:{escape})+?(?=(?!{escape})|\ue000|$)", every))
    return "".join(f"\\u{ord(x[0]):04x}-\\u{ord(x[-1]):04x}" for x in runs)


def splitter(pattern: str):
    """A function that cuts a text into the pattern's matches.

    Python's own engine is several times faster than ``regex`` but lacks its escapes. They become explicit classes of
    the code points below U+10000; a text with others is cut by ``regex``.
    """
    classes = {escape: _members(escape) for escape in (r"\p{L}", r"\p{N}", r"\s")}
    out, inside, at = [], False, 0
    while at < len(pattern):
        escape = next((e for e in classes if pattern.startswith(e, at)), None)
        if escape:
            out.append(classes[escape] if inside else f"[{classes[escape]}]")
            at += len(escape)
        elif pattern.startswith(r"\S", at) and not inside:
            out.append(f"[^{classes[chr(92) + 's']}]")
            at += 2
        else:
            inside = pattern[at] == "[" or inside and pattern[at] != "]"
            out.append(pattern[at])
            at += 1
    quick, whole, beyond = re.compile("".join(out)).findall, regex.compile(pattern).findall, re.compile("[\U00010000-\U0010ffff]").search
    return lambda text: whole(text) if beyond(text) else quick(text)


class ByteBpe:
    """Encodes and decodes texts by a rank file."""

    def __init__(self, path: str = VOCABULARY, pattern: str = public_tokenizers.PATTERN):
        self.ranks = load_ranks(path)
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        self.cut = splitter(pattern)
        rank_of = sorted(self.ranks.values())
        self.rank_of = rank_of if rank_of != list(range(len(rank_of))) else None
        characters = byte_characters()
        self.to_characters = dict(enumerate(characters))
        to_byte = {c: b for b, c in enumerate(characters)}
        self.bytes_of = {rank: bytes(to_byte[c] for c in self.processor.id_to_piece(at)) for at, rank in enumerate(rank_of)}
        #: piece -> the decimals of its ids, joined by commas
        self.known: dict[str, str] = {}
        #: piece -> what its ids decode to, where that is anything but the piece
        self.other: dict[str, bytes] = {}
        self.size = 0

    def mapped(self, piece: str) -> str:
        if piece.isascii() and piece.isprintable():
            return piece.replace(" ", self.to_characters[32])
        return piece.encode().decode("latin-1").translate(self.to_characters)

    def learn(self, pieces: set[str]) -> None:
        """Encode pieces that are not remembered. A piece that is itself a token is that token."""
        whole = {piece: rank for piece in pieces if (rank := self.ranks.get(piece.encode())) is not None}
        rest = [piece for piece in pieces if piece not in whole]
        encoded = self.processor.encode([*map(self.mapped, rest)], out_type=int, num_threads=1)
        for piece, ids in chain(((p, [r]) for p, r in whole.items()), zip(rest, encoded, strict=True)):
            if self.rank_of and piece not in whole:
                ids = [*map(self.rank_of.__getitem__, ids)]
            self.known[piece] = text = ",".join(map(str, ids))
            self.size += len(piece) + len(text)
            if (decoded := self.decode(ids)) != piece.encode():
                self.other[piece] = decoded

    def pieces(self, text: str) -> tuple[str, bytes]:
        """The ids of a text, joined by commas, and the bytes that they decode to."""
        cut = self.cut(text)
        found = set(cut).difference(self.known)
        if found:
            if self.size > REMEMBERED:
                self.known, self.other, self.size, found = {}, {}, 0, set(cut)
            self.learn(found)
        ids = ",".join([self.known[piece] for piece in cut])
        if not self.other:
            return ids, "".join(cut).encode()
        return ids, b"".join([self.other.get(piece) or piece.encode() for piece in cut])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[*map(int, ids.split(","))] if ids else [] for ids, _ in map(self.pieces, texts)]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_coders: dict[str, ByteBpe] = {}


def coder(path: str) -> ByteBpe:
    """One coder for each vocabulary and worker process."""
    if path not in _coders:
        _coders[path] = ByteBpe(path)
    return _coders[path]


def encode_documents(docs: DataFrame, path: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    Returns doc_id, n_tokens, the SHA-256 of the comma-joined ids and of the decoded bytes and, ``with_ids``, the ids
    themselves as token_ids. ``path`` is the rank file; it must be readable at that path by every executor.
    """

    def batch_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = coder(path)
        counts, ids_digest, decoded_digest, kept = [], [], [], []
        for value in batch.column(1):
            ids, decoded = bpe.pieces(value.as_py() or "")
            counts.append(ids.count(",") + 1 if ids else 0)
            ids_digest.append(hashlib.sha256(ids.encode()).hexdigest())
            decoded_digest.append(hashlib.sha256(decoded).hexdigest())
            if with_ids:
                kept.append(np.fromstring(ids, np.int32, sep=",") if ids else np.zeros(0, np.int32))
        columns = {"doc_id": batch.column(0), "n_tokens": pa.array(counts, pa.int64()), "ids_sha256": ids_digest, "decoded_sha256": decoded_digest}
        if with_ids:
            ends = pa.array(np.cumsum([0, *counts]), pa.int32())
            columns["token_ids"] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(kept)))
        return pa.RecordBatch.from_pydict(columns)

    return map_arrow(docs.select(docs["doc_id"].cast("bigint"), docs["text"]), batch_of, SCHEMA + (", token_ids array<int>" if with_ids else ""), 100)


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, encoded and decoded: one row per document."""
    return encode_documents(table(spark, sf_dir, "documents"), with_ids=False)
