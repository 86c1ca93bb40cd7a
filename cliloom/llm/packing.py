"""Bounded-space online best-fit packing of token sequences.

`token_pieces` encodes whole texts and cuts what is longer than a sequence;
`pack` places the pieces.  Placing needs only lengths, so token ids are not
shuffled: a piece is a row of a few numbers.

Packing works on groups of about `group_size` pieces dealt by a hash of the row
(so no source or document makes a group large), each an independent stream in the
order of the input: a piece is placed for good before the next one is seen.  A
stream keeps at most `open_bins` open sequences.  A bitset with one bit for each
amount of free space finds the fullest sequence that a piece fits into; where none
fits, a new one opens, and if too many are open the fullest closes first.  Of a
stream only the open sequences are held in memory.

Nulls: a null text is empty and becomes one piece holding the end id alone; a
null id is packed as any other.  Repeated rows are packed each time.  Empty
tables give empty results.  A very long text is encoded whole, in one task, and
cut into pieces.  Of the input only id and text are used, so columns
with clashing names don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import written
from .wordids import lower_word_ids, lower_word_memo

#: Sequences open at once in a stream, and pieces of a stream.
OPEN_BINS, GROUP = 64, 32_768


def token_pieces(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and an end id, cut at `capacity` where longer."""
    df = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = lower_word_memo(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(1)):
                rows: list[tuple[int, int, int, int, int]] = []
                found, first = lower_word_ids(memo, data, offsets)
                found = found.astype("<u4")
                for row in range(b - a):
                    ids = found[first[row] : first[row + 1]].tobytes() + end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        rows.append((a + row, piece, at // 4, len(part) // 4, zlib.crc32(part)))
                owner, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """A fixed number of open sequences, found by their free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.free, self.held, self.open, self.made, self.closed = capacity, most, 0, {}, 0, 0, 0

    def _take(self, space: int) -> int:
        bins = self.held[space]
        out = bins.pop()
        if not bins:
            self.free &= ~(1 << space)
        self.open -= 1
        return out

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) of a piece of this length."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            sequence = self._take(space)
        else:
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
                self.closed += 1
            space, sequence = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.held.setdefault(left, []).append(sequence)
            self.free |= 1 << left
            self.open += 1
        return sequence, self.capacity - space


def pack(pieces: DataFrame, capacity: int = 4096, open_bins: int = OPEN_BINS, group_size: int = GROUP) -> DataFrame:
    """The pieces (a written table or another input that gives the same rows each time) with sequence_id and offset."""
    groups = max(1, -(-pieces.count() // group_size))
    names = pieces.columns
    dealt = pieces.withColumn("_place", F.monotonically_increasing_id()).withColumn("_group", F.pmod(F.xxhash64("_place"), F.lit(groups)))
    at = names.index("length")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bins = None, None
        for batch in batches:
            group, length = batch.column("_group").to_numpy(), batch.column(at).to_numpy()
            sequence, offset = np.empty(len(group), np.int64), np.empty(len(group), np.int64)
            for i, (g, n) in enumerate(zip(group.tolist(), length.tolist(), strict=True)):
                if g != now:
                    now, bins = g, OpenBins(capacity, open_bins)
                s, offset[i] = bins.place(n)
                sequence[i] = (g << 32) + s
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return dealt.repartition("_group").sortWithinPartitions("_group", "_place").mapInArrow(run, schema)


def pack_documents(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of all documents with their places; the pieces are written to the shared folder, so texts are encoded once."""
    return pack(written(token_pieces(documents, tokenizer_path, id_col, text_col, capacity, end_id), "pieces"), capacity)
