"""Byte-level BPE: packed token ids by a local rank file, and decoding to raw bytes."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import table

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Characters after which a text is cut at the next safe boundary.
CUT_CHARS = 1 << 16
#: White space in a row that is taken out before the library sees the text: its pattern recurses once a character there.
LONG_RUN = 1000
#: Rows turned into Python strings at once.
SLICE_ROWS = 256

# fixed values: white space as the pattern's \s has it
_SPACE = r"\t\n\v\f\r \x85\xa0  -     　"
_RUN = re.compile(f"[{_SPACE}]{{{LONG_RUN},}}")
# no match of the pattern holds white space after another character, so one always ends here
_BOUNDARY = re.compile(r"(?<=\S)[ \n]")

_built: dict[tuple, tuple[tiktoken.Encoding, tiktoken.Encoding]] = {}


class Vocabulary:
    """Ranks and pattern of a byte-level BPE; a worker builds the library's encoder once from the file's bytes."""

    def __init__(self, ranks: bytes, pattern: str = public_tokenizers.PATTERN):
        self.ranks, self.pattern = ranks, pattern
        self.key = (hashlib.sha256(ranks).hexdigest(), pattern)

    @classmethod
    def load(cls, path: str = RANKS, pattern: str = public_tokenizers.PATTERN) -> Vocabulary:
        with open(path, "rb") as f:
            found = cls(f.read(), pattern)
        found.encoders()
        return found

    def encoders(self) -> tuple[tiktoken.Encoding, tiktoken.Encoding]:
        """The encoder, and one that takes its whole input for one match."""
        if self.key not in _built:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, self.ranks.splitlines())}
            if any(bytes([b]) not in ranks for b in range(256)):
                raise ValueError("a vocabulary without every byte can't encode without loss")
            _built[self.key] = tuple(
                tiktoken.Encoding(name, pat_str=p, mergeable_ranks=ranks, special_tokens={})
                for name, p in (("texts", self.pattern), ("match", "(?s).+")))
        return _built[self.key]

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as little-endian unsigned 32-bit integers; equal to those of the uncut text."""
        whole, match = self.encoders()
        if len(text) < LONG_RUN or self.pattern != public_tokenizers.PATTERN:
            return np.array(whole.encode_ordinary(text), "<u4")
        found = []
        for part, single in _parts(text):
            found.append(np.array((match if single else whole).encode_ordinary(part), "<u4"))
        return np.concatenate(found)

    def decode(self, ids: np.ndarray) -> bytes | None:
        """Raw bytes of ids, whole characters or not; null if an id is none of the vocabulary's."""
        whole, _ = self.encoders()
        try:
            return b"".join(whole.decode_bytes(ids[i : i + CUT_CHARS].tolist()) for i in range(0, len(ids), CUT_CHARS))
        except KeyError:
            return None


def _parts(text: str) -> Iterator[tuple[str, bool]]:
    """Parts of a text that the pattern matches independently; True marks a long white-space match.

    Of a run of white space before another character the pattern takes all but the last one as one match; at the end
    of the text it takes all.
    """
    at = 0
    for run in _RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        yield from ((p, False) for p in _cut(text, at, run.start()))
        yield text[run.start() : end], True
        at = end
    yield from ((p, False) for p in _cut(text, at, len(text)))


def _cut(text: str, at: int, stop: int) -> Iterator[str]:
    while stop - at > CUT_CHARS:
        safe = _BOUNDARY.search(text, at + CUT_CHARS, stop)
        if safe is None:
            break
        yield text[at : safe.start()]
        at = safe.start()
    if at < stop:
        yield text[at:stop]


def encode(text: Column, vocabulary: Vocabulary) -> Column:
    """Token ids of each text packed as little-endian unsigned 32-bit integers; null for null, no byte for an empty text."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((None if t is None else vocabulary.encode(t).tobytes() for t in _values(batch)), pa.binary(), size=len(batch))

    return run(text.cast("string"))


def decode(ids: Column, vocabulary: Vocabulary) -> Column:
    """Raw bytes of packed ids; null for null, for a broken packing and for ids the vocabulary lacks."""

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((None if v is None or len(v) % 4 else vocabulary.decode(np.frombuffer(v, "<u4"))
                            for v in _values(batch)), pa.binary(), size=len(batch))

    return run(ids)


def encode_decoded(text: Column, vocabulary: Vocabulary) -> Column:
    """``struct(ids, raw)``: the packed ids of each text, and the bytes they decode to, from one visit of a worker."""

    @F.arrow_udf("struct<ids binary, raw binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            slices = []
            for i in range(0, len(batch), SLICE_ROWS):
                ids = [None if t is None else vocabulary.encode(t) for t in batch.slice(i, SLICE_ROWS).to_pylist()]
                packed = pa.array((None if v is None else v.tobytes() for v in ids), pa.binary(), size=len(ids))
                raw = pa.array((None if v is None else vocabulary.decode(v) for v in ids), pa.binary(), size=len(ids))
                slices.append(pa.StructArray.from_arrays([packed, raw], ["ids", "raw"]))
            yield pa.concat_arrays(slices) if slices else pa.array([], pa.struct([("ids", pa.binary()), ("raw", pa.binary())]))

    return run(text.cast("string"))


def unpack(ids: Column) -> Column:
    """Packed ids as an array of numbers."""

    @F.arrow_udf("array<bigint>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array((None if v is None else np.frombuffer(v[: len(v) // 4 * 4], "<u4").astype(np.int64) for v in _values(batch)),
                           pa.list_(pa.int64()), size=len(batch))

    return run(ids)


def _values(batch: pa.Array) -> Iterator:
    for i in range(0, len(batch), SLICE_ROWS):
        yield from batch.slice(i, SLICE_ROWS).to_pylist()


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document.

    A null text counts as empty: no id, digests of no byte.  Every row gives one row, repeated and null ids too.
    """
    coded = encode_decoded(F.coalesce("text", F.lit("")), Vocabulary.load())
    decoded = table(spark, sf_dir, "documents").select("doc_id", coded.alias("coded")).select("doc_id", "coded.*")
    return decoded.select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))
