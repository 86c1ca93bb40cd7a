"""Token counts of a text's sections from one encoding of the whole text.

A text is encoded once as a whole; the ids' byte lengths, added up, are the
tokens' spans.  Spans are interval-joined with the sections by binary search in
sorted bounds.  Rule for a token that crosses a boundary: it counts for the
section that holds most of its bytes, of equal shares for the earlier one
(`rule="most"`), or for the section it begins in (`rule="first"`) or ends in
(`rule="last"`).  So the sections' counts add up to the text's.

Sections are the lines of a text, each with the newline behind it.

Nulls: a null text is empty; an empty text is one section without tokens.  Rows
are counted one by one, so repeated rows, ties and null ids are nothing special.  A
text of any length is encoded whole, in one task, which holds its bytes and ids; so
are runs of one character, white space included.  Empty tables give empty results.  Only id and text are used, so columns with clashing
names don't matter.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Fixed value: the pre-tokenizer's pattern of the 50k byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[tuple[str, str], tuple] = {}


def load(path: str, pattern: str = PATTERN) -> tuple:
    """(encoding, bytes of each id's token)."""
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            length[rank] = len(token)
        _loaded[path, pattern] = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), length
    return _loaded[path, pattern]


#: White space as the pattern's ``\\s`` has it; runs over 1000 go past the pattern, whose look-ahead keeps a stack entry for each character.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def encode(encoding, text: str) -> list[int]:
    """The ids of encode_ordinary, for runs of white space of any length.

    `PATTERN` makes one piece of a run but for its last character, which begins the
    piece behind it, or of the whole run at the end of the text; so texts can be
    parted there.
    """
    if encoding._pat_str != PATTERN:
        return encoding.encode_ordinary(text)
    ids, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += encoding.encode_ordinary(text[at : run.start()])
        ids += encoding._encode_single_piece(text[run.start() : end])
        at = end
    return ids + encoding.encode_ordinary(text[at:])


def allot(token_ends: np.ndarray, section_starts: np.ndarray, rule: str = "most") -> np.ndarray:
    """The section of each token; spans are in bytes, the first section starts at 0."""
    starts = np.concatenate((np.zeros(1, np.int64), token_ends[:-1]))
    first = np.searchsorted(section_starts, starts, "right") - 1
    last = np.searchsorted(section_starts, token_ends - 1, "right") - 1
    if rule == "first":
        return first
    if rule == "last":
        return last
    for i in np.flatnonzero(first != last):
        bounds = np.concatenate(([starts[i]], section_starts[first[i] + 1 : last[i] + 1], [token_ends[i]]))
        first[i] += int(np.argmax(np.diff(bounds)))
    return first


def section_tokens(documents: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", rule: str = "most", pattern: str = PATTERN) -> DataFrame:
    """doc_id, section, start and n_chars (code points), n_tokens, n_crossing (tokens allotted here that cross a boundary), doc_tokens."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing", "doc_tokens"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, length = load(tokenizer_path, pattern)
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(1)):
                held: list[list[np.ndarray]] = []
                for i in range(b - a):
                    body = data[offsets[i] : offsets[i + 1]]
                    starts = np.concatenate((np.zeros(1, np.int64), np.flatnonzero(body == 10) + 1))
                    if len(starts) > 1 and starts[-1] == len(body):
                        starts = starts[:-1]
                    points = np.concatenate((np.zeros(1, np.int64), np.cumsum((body & 0xC0) != 0x80)))
                    ids = encode(encoding, body.tobytes().decode("utf-8", "replace")) if len(body) else []
                    ends = np.cumsum(length[np.array(ids, np.int64)])
                    section = allot(ends, starts, rule) if len(ids) else np.zeros(0, np.int64)
                    n = np.bincount(section, minlength=len(starts))
                    before = np.concatenate((np.zeros(1, np.int64), ends[:-1])) if len(ids) else ends
                    crossing = np.searchsorted(starts, ends - 1, "right") != np.searchsorted(starts, before, "right")
                    at = points[starts]
                    held.append([np.full(len(starts), a + i), np.arange(len(starts)), at, np.diff(np.append(at, points[-1])), n, np.bincount(section[crossing], minlength=len(starts)), np.full(len(starts), len(ids))])
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(columns[0])), pa.array(columns[1].astype(np.int32)), *(pa.array(c.astype(np.int64)) for c in columns[2:])], names)

    return rows.mapInArrow(run, f"doc_id {kind}, section int, start long, n_chars long, n_tokens long, n_crossing long, doc_tokens long")
