"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The tokenizer is built from a rank file alone: a token's merge is the pair that the ranks below its own leave of it. Inside
the library every byte is one character (printable ones stand for themselves, the others for those from 256 on); decoding
reverses that table, and joins the bytes of characters that tokens split before it reads them as UTF-8.

Merges never cross the matches of PATTERN, so each distinct match of a slice of documents goes to the library once, and a
document's ids and offsets are put together from those of its matches.

Defined results: null text counts as empty and has no tokens. Strings like <|endoftext|> are ordinary text. Texts of any
length are encoded whole. Repeated rows give repeated rows; an empty table an empty one; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinara.llm.common import slices

KNOWN = 300_000  # matches whose ids a task remembers between slices
ENCODED = "doc_id long, ids array<int>, starts array<int>, ends array<int>, byte_starts array<int>"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> list[str]:
    """The character that stands for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


@lru_cache(2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def last_merge(token: bytes, rank: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts of token that its own merge joins."""
    parts, own = [token[i : i + 1] for i in range(len(token))], rank[token]
    while len(parts) > 2:
        best, at = min((rank.get(a + b, own), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best >= own:
            raise ValueError(f"no merges make the token of rank {own}")
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts[0], parts[1]


@lru_cache(2)
def tokenizer_json(path: str) -> str:
    """The rank file as a definition for the tokenizers library; its size is that of the vocabulary."""
    rank, chars = ranks(path), byte_characters()
    spell = lambda token: "".join(chars[b] for b in token)
    merges = [[spell(part) for part in last_merge(token, rank)] for token in sorted(rank, key=rank.get) if len(token) > 1]
    return json.dumps(
        {
            "version": "1.0",
            "added_tokens": [],
            "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False},
            "model": {"type": "BPE", "vocab": {spell(token): i for token, i in rank.items()}, "merges": merges},
        }
    )


class Encoding(NamedTuple):
    ids: list[int]
    offsets: list[tuple[int, int]]


class Codec:
    """Encodes texts and decodes ids."""

    def __init__(self, definition: str, pattern: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.split = regex.compile(pattern).findall
        to_byte = {char: byte for byte, char in enumerate(byte_characters())}
        vocab = self.tokenizer.get_vocab()
        self.bytes = {i: bytes(to_byte[c] for c in token) for token, i in vocab.items()}
        self.text = {i: b"%d" % i for i in vocab.values()}
        self.known: dict[str, list[int]] = {}
        self.written: dict[str, bytes] = {}  # the ids of a match in decimal
        self.decoded: dict[str, bytes] = {}  # the bytes that the ids of a match decode to

    def pieces(self, texts: list[str]) -> list[list[str]]:
        """The matches of each text; self.known has the ids of all of them afterwards."""
        found = [self.split(text) for text in texts]
        if len(self.known) > KNOWN:
            for cache in (self.known, self.written, self.decoded):
                cache.clear()
        new = list(set().union(*found) - self.known.keys())
        for at in range(0, len(new), 1 << 14):
            part = new[at : at + (1 << 14)]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            self.known.update(zip(part, ids))
            self.written.update(zip(part, (b" ".join(map(self.text.__getitem__, x)) for x in ids)))
            self.decoded.update(zip(part, map(self.decode_bytes, ids)))
        return found

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [list(chain.from_iterable(map(self.known.__getitem__, pieces))) for pieces in self.pieces(texts)]

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, SHA-256 of the ids in decimal joined by spaces, SHA-256 of the bytes they decode to."""
        out = []
        for pieces in self.pieces(texts):
            written, decoded = b" ".join(map(self.written.__getitem__, pieces)), b"".join(map(self.decoded.__getitem__, pieces))
            n = written.count(b" ") + 1 if pieces else 0  # a match has a token at least
            out.append((n, hashlib.sha256(written).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out

    def encode(self, texts: list[str]) -> list[Encoding]:
        """Ids, and offsets in characters; a token with part of a character has the offsets of the whole."""
        out = []
        for pieces in self.pieces(texts):
            ids, offsets, at = [], [], 0
            spans = {p: self.tokenizer.encode(p, add_special_tokens=False) for p in set(pieces)}
            for piece in pieces:
                ids += spans[piece].ids
                offsets += [(at + a, at + b) for a, b in spans[piece].offsets]
                at += len(piece)
            out.append(Encoding(ids, offsets))
        return out

    def byte_starts(self, ids: list[int]) -> list[int]:
        at, out = 0, []
        for i in ids:
            out.append(at)
            at += len(self.bytes[i])
        return out

    def decode_bytes(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """Text; bytes that end or begin amid a character come out as replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


@lru_cache(1)
def codec(definition: str, pattern: str) -> Codec:
    return Codec(definition, pattern)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    for batch in batches:
        for rows in slices(batch, 1):
            yield rows.column(0).to_pylist(), [text or "" for text in rows.column(1).to_pylist()]


def _encode(batches: Iterator[pa.RecordBatch], definition: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(definition, pattern)
    for doc_ids, texts in _texts(batches):
        found = own.encode(texts)
        columns = [[e.ids for e in found], [[a for a, _ in e.offsets] for e in found], [[b for _, b in e.offsets] for e in found], [own.byte_starts(e.ids) for e in found]]
        yield pa.record_batch([pa.array(doc_ids, pa.int64()), *(pa.array(c, pa.list_(pa.int32())) for c in columns)], names=["doc_id", "ids", "starts", "ends", "byte_starts"])


def _decode(batches: Iterator[pa.RecordBatch], definition: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(definition, pattern)
    for batch in batches:
        texts = [own.decode(ids or []) for ids in batch.column(1).to_pylist()]
        yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])


def _digests(batches: Iterator[pa.RecordBatch], definition: str, pattern: str) -> Iterator[pa.RecordBatch]:
    own = codec(definition, pattern)
    for doc_ids, texts in _texts(batches):
        columns = [doc_ids, *zip(*own.digests(texts))]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _input(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document its token ids, their offsets in characters (starts, ends) and in bytes (byte_starts)."""
    return _input(docs).mapInArrow(partial(_encode, definition=tokenizer_json(path), pattern=pattern), ENCODED)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids, ...)."""
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode, definition=tokenizer_json(path), pattern=pattern), "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes decoded from them, without moving either."""
    return _input(docs).mapInArrow(partial(_digests, definition=tokenizer_json(path), pattern=pattern), DIGESTS)
