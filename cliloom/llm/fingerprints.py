"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed into phrases, phrases into longer ones, and so
on.  At each level runs of one symbol become one symbol; then deterministic coin
tossing replaces each symbol, over and over, by the place and value of the
lowest bit in which it differs from the one before, until six labels are left;
a phrase begins at each label larger than both its neighbours.  Whether a phrase
begins at a place depends on a few symbols around it only, so equal substrings
get equal phrases but for a few at their edges, whatever their offset.  A
phrase's name is a 64-bit hash of its symbols.

A fingerprint holds 128 registers of 8 bits: for each of 128 hash functions the
least value over the names of the phrases of levels 3 and 4 (some 25 and 75
bytes long; of short texts the highest level there is), in hexadecimal.  The
likeness of two fingerprints is the share of equal registers, corrected for
chance: an estimate of the Jaccard similarity of the phrase sets.

Nulls: a null text is empty and has an empty fingerprint; two empty ones are
alike, an empty and another are not.  A null id ranks before all others; rows of
equal or of null ids are in one range of ids, so in one task, and follow each other in the order of their texts, and equal rows are
neighbours.  Empty tables give empty results.  Only id and text are used, so
columns with clashing names don't matter.  A task holds a few texts at a time;
its memory grows with the longest text (some 60 bytes for each of its bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

LEVELS, FROM_LEVEL, REGISTERS = 4, 3, 128
_NO_ID = -(1 << 63)
_rng = np.random.Generator(np.random.PCG64(4001))
_FACTORS = _rng.integers(1, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_RUN, _STEP = (_rng.integers(1, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)).tolist()
_POWERS = np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(255, _STEP, np.uint64))))


def _coin(symbols: int) -> np.ndarray:
    """A toss of two symbols, for alphabets of so many: [before * symbols + now]."""
    before, now = np.divmod(np.arange(symbols * symbols), symbols)
    apart = before ^ now
    bit = np.zeros(len(apart), np.int64)
    bit[apart > 0] = np.bitwise_count((apart & -apart) - 1)[apart > 0]
    return (2 * bit + (now >> bit & 1)).astype(np.uint8)


_COIN = {n: _coin(n) for n in (256, 128, 16, 8)}


def _toss(labels: np.ndarray, size: int, heads: np.ndarray) -> np.ndarray:
    """heads: where documents begin; their labels are 0, so nothing is seen of the document before."""
    out = np.zeros(len(labels), np.uint8)
    out[1:] = _COIN[size][labels[:-1].astype(np.uint16 if size <= 256 else np.int64) * np.uint16(size) + labels[1:]]
    out[heads] = 0
    return out


def _phrases(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases, and the first of each document (and at last their number). symbols: bytes or names."""
    n = len(symbols)
    head = np.zeros(n + 1, bool)
    head[first] = True  # a document's start, and the end
    head = head[:n]
    keep = head.copy()
    keep[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(keep)
    run = np.diff(np.append(at, n))
    symbols, head = symbols[at], head[at]
    heads = np.flatnonzero(head)
    if symbols.dtype == np.uint8:
        labels = _toss(_toss(_toss(symbols, 256, heads), 16, heads), 8, heads)
        names = _BYTE[symbols]
    else:
        apart = symbols[1:] ^ symbols[:-1]
        bit = np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1))
        labels = np.zeros(len(symbols), np.uint8)
        labels[1:] = 2 * np.minimum(bit, 63) + ((symbols[1:] >> np.minimum(bit, 63).astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
        labels[heads] = 0
        labels = _toss(_toss(_toss(labels, 128, heads), 16, heads), 8, heads)
        names = symbols
    long = run > 1
    if long.any():
        names = names.copy() if names is symbols else names
        names[long] = K.mix(names[long] + run[long].astype(np.uint64) * np.uint64(_RUN))
    begins = head.copy()
    begins[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:])
    begins[heads[1:] - 1] = head[heads[1:] - 1]  # a document's last symbol has nothing behind it
    starts = np.flatnonzero(begins)
    length = np.diff(np.append(starts, len(names)))
    place = np.arange(len(names)) - np.repeat(starts, length)
    total = np.add.reduceat(names * _POWERS[np.minimum(place, 255)], starts)
    return K.mix(total + length.astype(np.uint64) * np.uint64(_RUN)), np.searchsorted(starts, np.searchsorted(at, first))


def _blank_free(first: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(first))


def registers(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The registers of each document, a row each; of empty ones all zero."""
    out = np.zeros((len(offsets) - 1, REGISTERS), np.uint8)
    full = _blank_free(offsets)
    if not len(full):
        return out
    symbols, first = data, np.append(offsets[full], offsets[-1])
    held = []
    for level in range(1, LEVELS + 1):
        symbols, first = _phrases(symbols, first)
        if level >= FROM_LEVEL:
            held.append((symbols, np.repeat(np.arange(len(full)), np.diff(first)), level))
    names = np.concatenate([K.mix(s + np.uint64(level)) for s, _, level in held])
    owner = np.concatenate([o for _, o, _ in held])
    names = names[np.argsort(owner, kind="stable")]
    first = np.searchsorted(np.sort(owner, kind="stable"), np.arange(len(full)))
    for i, factor in enumerate(_FACTORS):
        least = np.minimum.reduceat(names * factor, first)
        out[full, i] = (K.mix(least) >> np.uint64(56)).astype(np.uint8)
    return out


def likeness(a: np.ndarray, b: np.ndarray, a_full: np.ndarray, b_full: np.ndarray) -> np.ndarray:
    """Row by row; equal fingerprints give 1."""
    chance = 1 / 256
    share = ((a == b).mean(1) - chance) / (1 - chance)
    return np.where(a_full & b_full, np.clip(share, 0, 1), (a_full == b_full).astype(float))


def fingerprint(registers_row: np.ndarray, full: bool) -> str:
    return registers_row.tobytes().hex() if full else ""


def _flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with `fingerprint`, without a shuffle."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(1)):
                found = registers(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([fingerprint(x, n > 0) for x, n in zip(found, np.diff(offsets), strict=True)], pa.string())], ["doc_id", "fingerprint"])

    return rows.mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _edited(now: str, then: str) -> str:
    half = len(now) // 2
    return now[: len(now) - half] + then[:half]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket, copies last: each row against its edited text and the row behind it."""

    def report(rows: list[tuple[int, str]], last: str) -> pa.RecordBatch:
        texts = [t for _, t in rows] + [last]
        edits = [_edited(x, y).encode() for x, y in zip(texts, texts[1:], strict=False)]
        data, offsets = _flat([t.encode() for t in texts])
        own, full = registers(data, offsets), np.diff(offsets) > 0
        data, offsets = _flat(edits)
        new, new_full = registers(data, offsets), np.diff(offsets) > 0
        columns = [
            pa.array([None if i == _NO_ID else i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array([hashlib.sha256(e).hexdigest() for e in edits], pa.string()),
            pa.array([fingerprint(x, y) for x, y in zip(own[:-1], full[:-1], strict=True)], pa.string()), pa.array([fingerprint(x, y) for x, y in zip(new, new_full, strict=True)], pa.string()),
            pa.array(likeness(own[:-1], new, full[:-1], new_full)), pa.array(likeness(own[:-1], own[1:], full[:-1], full[1:])),
        ]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    held: list[tuple[int, str]] = []
    size, now, closed = 0, None, False
    for batch in batches:
        for bucket, copy, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), K.string_rows(batch.column(3)), strict=True):
            if bucket != now:
                now, closed = bucket, False
            if copy:
                if not closed and held:
                    yield report(held, text)
                    held, size = [], 0
                closed = True
                continue
            if size > K.BLOCK_BYTES // 2:
                yield report(held, text)
                held, size = [], 0
            held.append((doc, text))
            size += len(text)


def fingerprint_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint, its edited text's, and the likenesses to that and to the next document.

    Documents are dealt to ranges of ids; each range also gets the document that follows its last one.
    The driver sees one number for each range.
    """
    spark = documents.sparkSession
    docs = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.unique(np.array(docs.where(F.col("doc_id") != _NO_ID).approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.1 / ranges), np.float64)).astype(np.int64)

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts, ids.to_numpy(), "left").astype(np.int32))

    firsts = sorted((r["bucket"], r["least"]) for r in docs.select("doc_id").withColumn("bucket", bucket_of("doc_id")).groupBy("bucket").agg(F.min("doc_id").alias("least")).collect())
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    follow = [(firsts[i - 1][0], firsts[i][1]) for i in range(len(firsts))]  # the first also follows the last
    follow = spark.createDataFrame(follow, "bucket int, doc_id long")
    rows = docs.withColumn("bucket", bucket_of("doc_id")).select("bucket", F.lit(0).alias("copy"), "doc_id", "text")
    copies = docs.join(F.broadcast(follow), "doc_id").select("bucket", F.lit(1).alias("copy"), "doc_id", "text")  # a row for each range
    dealt = rows.unionByName(copies).repartition("bucket").sortWithinPartitions("bucket", "copy", "doc_id", "text")
    return dealt.mapInArrow(_compared, schema)
