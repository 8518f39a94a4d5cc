"""Packing along a space-filling curve.

Each document is tokenised, its hashed bag of tokens is projected to a few dimensions and the cell
there gets a Hilbert key. Documents are range-sorted by that key, so neighbours on the curve share
sequences, and each range is cut into sequences of a fixed length without gaps: only the last
sequence of a range needs padding.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import small_batches, stored, table

SEQUENCE = 1024
#: Id that ends each document.
END_ID = 0
#: Size of the hashed vectors, and dimensions and bits a dimension of the curve.
HASHED, DIMENSIONS, BITS = 1024, 3, 10
#: Documents vectorised at a time.
ROWS = 256
#: Least tokens of a range, so that its padded end is little.
RANGE_TOKENS = 1 << 19


@cache
def encoder(path: str):
    """A function from a text to the ids that the byte-level BPE file of tokenizers gives it, added tokens included, by a tiktoken encoding, which is four times as fast."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocabulary, added = whole["model"]["vocab"], whole["added_tokens"]
    if whole["normalizer"] or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        raise ValueError(f"{path}: normalisers and added tokens that take more than their own characters are not supported")
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = dict(zip(plain, plain, strict=True)) | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in plain)}
    to_byte = {chr(c): b for b, c in shown.items()}
    own = {t["content"]: t["id"] for t in added}  # cut out of a text before it is split into words
    ranks = {bytes(to_byte[c] for c in token): i for token, i in vocabulary.items() if all(c in to_byte for c in token) and token not in own}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=own)
    return lambda text: encoding.encode(text, allowed_special="all")


@cache
def projection(seed: int = 0) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((HASHED, DIMENSIONS))


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position on the Hilbert curve of each row of integer coordinates, after Skilling's transform of 2004."""
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | x[i] >> bit & 1
    return key


def tokenise(path: str):
    """Batches of (doc_id, text) to (doc_id, n, key, ids); ids are little-endian 16-bit (larger ones fail), the last is END_ID."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            ids = [np.asarray([*encode(t.as_py() or ""), END_ID], "<u2") for t in batch.column(1)]
            bags = np.zeros((len(ids), HASHED))
            for row, own in zip(bags, ids, strict=True):
                row += np.bincount(own % HASHED, minlength=HASHED)
            bags = np.log1p(bags)
            bags /= np.maximum(np.linalg.norm(bags, axis=1, keepdims=True), 1e-9)
            cells = np.clip((bags @ projection() / 8 + 0.5) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(map(len, ids), pa.int64()), pa.array(hilbert(cells), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "n", "key", "ids"])

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cut(size: int, with_ids: bool):
    """Batches of one range, in order, to pieces; sequences are numbered from the range's number times 2**40."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence, offset = TaskContext.get().partitionId() << 40, 0
        for batch in (b.slice(i, ROWS) for b in batches for i in range(0, b.num_rows, ROWS)):
            rows, held = [], []
            for doc_id, n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                wide = np.frombuffer(ids.as_buffer(), "<u2").astype("<u4")
                start = 0
                while start < n:
                    length = min(n - start, size - offset)
                    piece = wide[start : start + length]
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, sequence, offset))
                    if with_ids:
                        held.append(piece.astype(np.int32))
                    start, offset = start + length, offset + length
                    if offset == size:
                        sequence, offset = sequence + 1, 0
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                ends = np.cumsum([0, *map(len, held)])
                columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held) if held else np.zeros(0, np.int32))))
                names.append("ids")
            yield pa.record_batch(columns, names=names)

    return run


def pack(documents: DataFrame, tokenizer_path: str | None = None, size: int = SEQUENCE, with_ids: bool = True) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of all rows of documents(doc_id, text).

    Each row is a document of its own, also where rows repeat; a null text is empty and has the end
    id alone; a long one is cut over as many sequences as it needs; ties on the curve go by doc_id; a doc_id
    that is no whole number fails, or is null where spark.sql.ansi.enabled is false;
    other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    small_batches(spark)
    path = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = stored(rows.mapInArrow(tokenise(str(path)), "doc_id long, n long, key long, ids binary"), "tokens")
    total = tokens.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), total // RANGE_TOKENS))
    if total > ranges * 64 * RANGE_TOKENS:
        ranges = total // (64 * RANGE_TOKENS)
    ordered = tokens.repartitionByRange(ranges, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return ordered.select("doc_id", "n", "ids").mapInArrow(cut(size, with_ids), PIECES + (", ids array<int>" if with_ids else ""))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
