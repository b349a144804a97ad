"""Byte-level BPE through a sentencepiece model that is serialised from a rank file.

The rank file lists byte strings with their merge ranks. Each byte becomes one character (U+0100 + byte), so
every entry is an ordinary sentencepiece piece; its score is the negative rank, and a BPE model merges the
best-scored pair first, which is the merge order of the ranks. Normalisation is the identity. A pre-token that
is itself an entry is its own id; any other is merged by sentencepiece. Decoding maps ids to byte strings.

Null and empty text give no ids; ids decode to bytes; null ids decode to empty bytes. Columns named like the
output are replaced, all others pass through. Repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
import codecs
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.pretokens import PATTERN, BatchEncoder, slices

BYTE_BASE = 0x100


def read_ranks(vocab: str) -> dict[bytes, int]:
    with open(vocab, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_CHARS = "".join(chr(BYTE_BASE + b) for b in range(256))


def as_piece(raw: bytes) -> str:
    return codecs.charmap_decode(raw, "strict", _CHARS)[0]


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: piece k is the entry of rank k; the unknown piece, never produced, comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    by_rank = sorted(ranks, key=ranks.get)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    for raw in by_rank:
        model.pieces.add(piece=as_piece(raw), score=-float(ranks[raw]), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type = pb.TrainerSpec.BPE
    spec.vocab_size = len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(by_rank), -1, -1, -1
    norm = model.normalizer_spec
    norm.name, norm.precompiled_charsmap = "identity", b""
    norm.add_dummy_prefix = norm.remove_extra_whitespaces = norm.escape_whitespaces = False
    return model.SerializeToString()


class Codec:
    def __init__(self, vocab: str, pattern: str):
        import sentencepiece

        self.ranks = read_ranks(vocab)
        table = sorted(self.ranks, key=self.ranks.get)
        self.bytes, self.sizes = np.frombuffer(b"".join(table), np.uint8), np.array([len(x) for x in table], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise_model(self.ranks))
        if pattern == PATTERN:
            self.encode = BatchEncoder(self.encode_tokens)
        else:
            import regex

            self.find = regex.compile(pattern).findall
            self.encode = self._encode_each

    def _encode_each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [[i for ids in self.encode_tokens(self.find(x)) for i in ids] for x in texts]
        return np.array([i for x in rows for i in x], np.int32), np.cumsum([0, *map(len, rows)])

    def encode_tokens(self, tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token, merged on its own."""
        raws = [x.encode() for x in tokens]
        found = list(map(self.ranks.get, raws))
        merge = [k for k, x in enumerate(found) if x is None]
        pieces, ends = as_piece(b"".join([raws[k] for k in merge])), list(accumulate([len(raws[k]) for k in merge], initial=0))
        out = [[x] for x in found]
        for k, ids in zip(merge, self.model.encode([pieces[i:j] for i, j in pairwise(ends)], num_threads=1), strict=True):
            out[k] = ids
        return out

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes of all ids in a row, and where those of ids[bounds[k] : bounds[k + 1]] start, with the total at the end."""
        size = self.sizes[ids]
        upto = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        source = np.repeat(self.at[ids] - upto[:-1], size) + np.arange(upto[-1])
        return self.bytes[source].tobytes(), upto[bounds]


@lru_cache(maxsize=2)
def codec(vocab: str, pattern: str) -> Codec:
    """One codec a worker process."""
    return Codec(vocab, pattern)


def _with(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*[f for f in schema if f.name != name], T.StructField(name, kind)])


def encode(df: DataFrame, vocab: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds the ids of each text as array<int>. Rows go through Python some megabytes at a time, however long a batch is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_batch = codec(vocab, pattern).encode
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(text))
            sizes = pc.fill_null(pc.binary_length(source), 0).to_pylist()
            for a, b in slices(sizes):
                part = batch.slice(a, b - a)
                ids, bounds = encode_batch(pc.fill_null(source.slice(a, b - a), "").to_pylist())
                yield _append(part, out, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids)))

    return df.mapInArrow(run, _with(df.schema, out, T.ArrayType(T.IntegerType())))


def _append(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != name} | {name: column}
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def _binary(data: bytes, bounds: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def decode(df: DataFrame, vocab: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_bytes = codec(vocab, pattern).decode
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(ids))
            sizes = pc.fill_null(pc.list_value_length(source), 0).to_pylist()
            for a, b in slices(sizes):
                part = source.slice(a, b - a)
                upto = np.concatenate(([0], np.cumsum(sizes[a:b], dtype=np.int64)))
                yield _append(batch.slice(a, b - a), out, _binary(*to_bytes(part.flatten().to_numpy(), upto)))

    return df.mapInArrow(run, _with(df.schema, out, T.BinaryType()))


def round_trip(df: DataFrame, vocab: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """encode and decode in one worker: both columns, from one pass of the rows through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocab, pattern)
        for batch in batches:
            source = batch.column(batch.schema.get_field_index(text))
            for a, b in slices(pc.fill_null(pc.binary_length(source), 0).to_pylist()):
                found, bounds = c.encode(pc.fill_null(source.slice(a, b - a), "").to_pylist())
                part = _append(batch.slice(a, b - a), ids, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found)))
                yield _append(part, decoded, _binary(*c.decode(found, bounds)))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, _with(_with(df.schema, ids, T.ArrayType(T.IntegerType())), decoded, T.BinaryType()))


def ids_sha256(ids: Column) -> Column:
    """Lower-case hex of the decimal ids joined by one space."""
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)
