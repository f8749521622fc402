"""Encoding of a whole corpus with a public byte-level BPE vocabulary, by sentencepiece.

The vocabulary (a file of base64 tokens and ranks) is turned into a sentencepiece BPE model without any training: each
token becomes a piece of byte-mapped characters scored by its negative rank, with identity normalisation. Texts are
cut into pre-tokens by the tokenizer's pattern; each distinct pre-token is encoded once a batch and
remembered. Decoding maps pieces back to bytes.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 200_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


@cache
def byte_chars() -> list[str]:
    """A printable character for each byte: itself if it is a visible Latin-1 character, else from 256 upwards."""
    seen = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in seen else next(spare)) for b in range(256)]


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a vocabulary file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, f))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks have gaps")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _field(number: int, value: bytes | str | int | float) -> bytes:
    """One field in protocol-buffer wire format."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    raw = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


NORMAL, UNKNOWN, BPE = 1, 2, 2


def piece_model(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model whose piece r + 1 is token r; piece 0 is the unknown piece and never occurs."""
    chars = byte_chars()
    pieces = ["".join(chars[b] for b in t) for t in tokens]
    unknown = "<unk>"
    while unknown in set(pieces):
        unknown = f"<{unknown}>"
    out = [_field(1, _field(1, unknown) + _field(2, 0.0) + _field(3, UNKNOWN))]
    out += [_field(1, _field(1, p) + _field(2, float(-r)) + _field(3, NORMAL)) for r, p in enumerate(pieces)]
    trainer = _field(3, BPE) + _field(4, len(pieces) + 1) + _field(35, 0) + _field(40, 0) + _field(41, (1 << 64) - 1) + _field(42, (1 << 64) - 1) + _field(43, (1 << 64) - 1) + _field(45, unknown)
    normal = _field(1, "identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normal)


class Encoder:
    """Texts to ids and back, from a serialised model and a pre-token pattern."""

    def __init__(self, model: bytes, pattern: str):
        import regex
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cut = regex.compile(pattern).findall
        self.chars = byte_chars()
        self.table = {b: c for b, c in enumerate(self.chars)}
        self.known: dict[str, list[int]] = {}

    def _learn(self, fresh: list[str]) -> None:
        mapped = [t.encode("utf-8", "replace").decode("latin-1").translate(self.table) for t in fresh]
        for t, ids in zip(fresh, self.sp.encode(mapped, out_type=int, num_threads=1)):
            self.known[t] = [i - 1 for i in ids]

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of each text; none for an empty or null one."""
        cut = [self.cut(t) if t else [] for t in texts]
        fresh = list({t for ts in cut for t in ts if t not in self.known})
        self._learn(fresh)
        known = self.known
        out = [[i for t in ts for i in known[t]] for ts in cut]
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        back = {c: b for b, c in enumerate(self.chars)}
        return bytes(back[c] for i in ids for c in self.sp.id_to_piece(int(i) + 1)).decode("utf-8", "replace")


def _shared(df: DataFrame, vocabulary: str | None, pattern: str | None):
    """The model, which has the fixed size of the vocabulary, for every executor."""
    return df.sparkSession.sparkContext.broadcast((piece_model(read_ranks(vocabulary or default_vocabulary())), pattern or default_pattern()))


def _mapped(shared, column: int, make, field: pa.Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = pa.array(make(encoder, part.column(column).to_pylist()), field.type)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(part.num_columns) if i != column], made], [*[n for i, n in enumerate(part.schema.names) if i != column], field.name])

    return run


def _types(df: DataFrame, drop: str) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != drop)


def encode(df: DataFrame, text: str = "text", ids: str = "ids", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the ids of its text column in place of it; other columns stay.

    Null and empty texts have an empty list. No special tokens: their strings are ordinary text. Whole texts are
    encoded, of any length; repeated texts give the same ids. A column named like `ids` is an error.
    """
    if ids in df.columns and ids != text:
        raise ValueError(f"there is a column {ids} already")
    run = _mapped(_shared(df, vocabulary, pattern), df.columns.index(text), lambda e, x: e.encode(x), pa.field(ids, pa.list_(pa.int32())))
    return df.mapInArrow(run, f"{_types(df, text)}, `{ids}` array<int>".lstrip(", "))


def count_tokens(df: DataFrame, text: str = "text", tokens: str = "tokens", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the number of tokens (0 for null) of its text column in place of it."""
    run = _mapped(_shared(df, vocabulary, pattern), df.columns.index(text), lambda e, x: [len(i) for i in e.encode(x)], pa.field(tokens, pa.int64()))
    return df.mapInArrow(run, f"{_types(df, text)}, `{tokens}` bigint".lstrip(", "))


def decode(df: DataFrame, ids: str = "ids", text: str = "text", vocabulary: str | None = None, pattern: str | None = None) -> DataFrame:
    """df with the text of its ids column in place of it; null ids give null."""
    run = _mapped(_shared(df, vocabulary, pattern), df.columns.index(ids), lambda e, x: [None if i is None else e.decode(i) for i in x], pa.field(text, pa.string()))
    return df.mapInArrow(run, f"{_types(df, ids)}, `{text}` string".lstrip(", "))


def round_trip(df: DataFrame, key: str, text: str, vocabulary: str | None = None) -> DataFrame:
    """(key, n_tokens, same): whether decoding the ids of each text gives the text again (null as empty)."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("was"), F.col(text).alias("text"))
    back = decode(encode(rows, "text", "ids", vocabulary).select("key", "was", F.size("ids").alias("n_tokens"), "ids"), "ids", "back", vocabulary)
    return back.select(F.col("key").alias(key), "n_tokens", (F.col("was") == F.col("back")).alias("same"))
