"""Encoding of a corpus by a public byte-level BPE vocabulary through sentencepiece (problem 8).

A sentencepiece BPE model is written directly from the rank file: every token becomes a piece over byte-mapped characters with
the negative of its rank as score, so that the best-scored merge is the one of lowest rank; normalisation is the identity.
Texts are cut into pre-tokens by the vocabulary's pattern, each is encoded on its own, and decoding maps pieces back to bytes.
"""

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The pattern by which the byte-level BPE vocabularies split text; a fixed value published with them.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens a worker remembers; past that it forgets all, which costs time only.
MEMO = 300_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Place of a rank file in the installed package of public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(None)
def byte_characters() -> str:
    """One printable character per byte: bytes that print as themselves in Latin-1, the others from U+0100 upwards in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {b: chr(b) for b in own}
    for b in range(256):
        table.setdefault(b, chr(256 + sum(x not in own for x in range(b))))
    return "".join(table[b] for b in range(256))


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def _field(number: int, value: int | bytes | float) -> bytes:
    """One protocol-buffer field: an integer, a float or bytes."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model of a rank file. Piece i is the token of rank i; one more, never used, stands for unknown input.

    Field numbers are those of sentencepiece's published model format: pieces 1 (text 1, score 2, type 3), trainer 2 (model type 3,
    vocabulary size 4, unk, bos, eos and pad ids 40 to 43), normaliser 3 (name 1, dummy prefix 3, extra white space 4, escaping 5).
    """
    chars = byte_characters()
    by_rank = sorted((r, t) for t, r in ranks.items())
    if [r for r, _ in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be consecutive from 0")
    out = []
    for rank, token in by_rank:
        text = "".join(chars[b] for b in token).encode()
        out.append(_field(1, _field(1, text) + _field(2, -float(rank)) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unk>") + _field(2, -1e9) + _field(3, 2)))
    none = (1 << 64) - 1  # -1
    out.append(_field(2, _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + _field(41, none) + _field(42, none) + _field(43, none)))
    out.append(_field(3, _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)))
    return b"".join(out)


class Encoder:
    """Encoder and decoder of one rank file, with a memory of pre-tokens."""

    def __init__(self, path: str | None = None) -> None:
        import sentencepiece

        with open(path or vocabulary_path(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.split = regex.compile(PATTERN).findall
        self.table = dict(enumerate(byte_characters()))
        self.memo: dict[str, list[int]] = {}

    def learn(self, pretokens: set[str]) -> None:
        if len(self.memo) + len(pretokens) > MEMO:
            self.memo.clear()
        new = [p for p in pretokens if p not in self.memo]
        mapped = [p.encode("utf-8").decode("latin-1").translate(self.table) for p in new]
        self.memo.update(zip(new, self.model.encode(mapped, out_type=int, num_threads=1)))

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts have none. Strings that look like special tokens are plain text."""
        cut = [self.split(t) if t else [] for t in texts]
        self.learn({p for ps in cut for p in ps})
        memo = self.memo
        return [[i for p in ps for i in memo[p]] for ps in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by the inverse of the byte mapping."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


@lru_cache(4)
def encoder(path: str | None = None) -> Encoder:
    """The encoder of a rank file, built once per worker."""
    return Encoder(path)


def _batches(texts: pd.Series, chars: int = 4_000_000) -> Iterator[list[str | None]]:
    """A series in lists of bounded size in characters."""
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t or "")
        if n > chars:
            yield part
            part, n = [], 0
    yield part


def token_ids(text: Column, path: str | None = None) -> Column:
    """Array of ids of a text column; empty for null and empty texts."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for s in batches:
            yield pd.Series([i for part in _batches(s) for i in e.encode_all(part)], dtype=object)

    return ids(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of ids of a text column; 0 for null and empty texts."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for s in batches:
            yield pd.Series([len(i) for part in _batches(s) for i in e.encode_all(part)], dtype="int64")

    return count(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """Text of an array of ids; null for null."""

    @F.pandas_udf("string")
    def back(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        e = encoder(path)
        for s in batches:
            yield pd.Series([None if i is None else e.decode(list(i)) for i in s], dtype=object)

    return back(ids)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of ``docs`` (doc_id, text), one row per row; no shuffle."""
    return docs.select("doc_id", token_ids(F.col("text"), path).alias("ids"))
