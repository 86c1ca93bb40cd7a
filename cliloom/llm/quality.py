"""Quality rules, line first: judge each line, remove what fails, reject documents that lose too much.

A line with words fails if any of these holds (all lines are judged on the
input text; lines without words are neither judged nor counted):

* punctuation: its last byte is no terminal mark (``. ! ? : ; " ' ) ]`` or one of
  the typographic marks in `TERMINAL_TAILS`);
* navigation: at least two of its words are lone separators (``|``, ``>``, ``/``,
  ``-``, ``*``, ``»``, ``·``), or more than 30 % of them;
* symbols: at least 30 % of its words hold one of ``# * $ % & | < >``;
* shouting: it has three words or more, and over 70 % of its ASCII letters are upper case;
* boilerplate: it holds one of `BOILERPLATE`, lower-cased.

A document is rejected if its base fails (under 50 words, or over half of its
words lie in 3-word windows that it repeats) or if the lines removed hold more
than `most_lost` of the code points of its words.

Nulls: a null text counts as empty, has no words and is rejected, as is an empty one.
Rows are judged one by one: equal rows get equal verdicts, there are no ties, other
columns pass through, whatever their names.  A very long text is judged whole, in one
task, which holds some 30 bytes for each of its words.  Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import numbered_columns

#: Phrases that mark a line as boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy", "use of cookies",
    "click here", "sign up for our", "subscribe to our", "enable javascript", "released under the", "licensed under the",
    "copyright (c)", "skip to content", "back to top", "lorem ipsum",
)
#: Multi-byte terminal marks (ellipsis, closing quotes, ideographic stops).
TERMINAL_TAILS = ("…", "”", "’", "»", "。", "！", "？")
_TERMINAL = np.zeros(256, bool)
_TERMINAL[list(b".!?:;\"')]")] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_LONE = np.zeros(256, bool)
_LONE[list(b"|>/-*")] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_ADDED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_failed_lines long, lost_chars long, base_failed boolean, kept boolean, cleaned string"


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs twice or more."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later_equals(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands before."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:][keys[order][1:] == keys[order][:-1]]] = True
    return out


def _owned(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    return K.mix(keys ^ (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def measure(data: np.ndarray, offsets: np.ndarray, most_lost: float) -> dict:
    """The measures of a block of documents, and which of its bytes stay after the lines that fail are gone."""
    n = len(offsets) - 1
    starts, ends, first = K.words(data, offsets)
    count = np.diff(first)
    inside = ~K.SPACE[data]
    points = inside & ((data & 0xC0) != 0x80)
    symbol = _SYMBOL[data]
    total = np.concatenate(([0], np.cumsum(points)))

    hashes = K.span_hashes(data, starts, ends)
    grams = K.gram_hashes(hashes, 3)
    owner, whole = K.gram_owner(first, 3, len(grams))
    covered = np.zeros(len(starts), bool)
    where = np.flatnonzero(whole)
    hit = where[_repeats(_owned(grams[where], owner[where]))]
    for j in range(3):
        covered[hit + j] = True

    # Lines: a document of b newlines has b + 1.
    breaks = np.flatnonzero(data == 10)
    line_starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    line_ends = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")
    line_owner = np.repeat(np.arange(n), np.diff(np.searchsorted(breaks, offsets)) + 1)
    word_at = np.searchsorted(starts, line_starts), np.searchsorted(starts, line_ends)
    line_words = word_at[1] - word_at[0]
    has = line_words > 0
    s, e, o = line_starts[has], line_ends[has], line_owner[has]
    dup = _later_equals(_owned(K.span_hashes(data, s, e), o))

    fails = np.zeros(len(s), bool)
    if len(s):
        a, b, many = word_at[0][has], word_at[1][has], line_words[has]
        last = ends[b - 1] - 1
        closed = _TERMINAL[data[last]]
        for tail in TERMINAL_TAILS:
            mark = np.frombuffer(tail.encode(), np.uint8)
            at = last - len(mark) + 1
            same = at >= starts[b - 1]
            for j, x in enumerate(mark):
                same &= data[np.maximum(at + j, 0)] == x
            closed |= same
        long = ends - starts
        lone = (long == 1) & _LONE[data[starts]]
        for tail in ("»", "·"):
            x, y = tail.encode()
            lone |= (long == 2) & (data[starts] == x) & (data[np.minimum(starts + 1, len(data) - 1)] == y)
        marked = np.concatenate(([0], np.cumsum(symbol)))
        marked = marked[ends] > marked[starts]
        in_line = lambda mask: (c := np.concatenate(([0], np.cumsum(mask))))[b] - c[a]
        lones, marks = in_line(lone), in_line(marked)
        upper, lower = ((data >= x) & (data < x + 26) for x in (65, 97))
        uppers, lowers = (np.concatenate(([0], np.cumsum(x))) for x in (upper, lower))
        uppers, lowers = uppers[e] - uppers[s], lowers[e] - lowers[s]
        fails = ~closed | (lones >= 2) | (10 * lones > 3 * many) | (10 * marks >= 3 * many) | ((many >= 3) & (10 * uppers > 7 * (uppers + lowers)) & (uppers > 0))
        small = K.LOWER[data].tobytes()
        for phrase in BOILERPLATE:
            x, at = phrase.encode(), -1
            while (at := small.find(x, at + 1)) >= 0:
                k = int(np.searchsorted(s, at, "right")) - 1
                if k >= 0 and at + len(x) <= e[k]:
                    fails[k] = True
    lost = np.bincount(o[fails], weights=(total[e] - total[s])[fails], minlength=n).astype(np.int64)
    chars = total[offsets[1:]] - total[offsets[:-1]]
    repeat = np.diff(np.concatenate(([0], np.cumsum(covered)))[first])
    base = (count < 50) | (100 * repeat > 50 * count)
    # What stays: all but the lines that fail, each with the newline behind it (the last one's is the one before it).
    edge = np.zeros(len(data) + 2, np.int64)
    np.add.at(edge, s[fails], 1)
    np.add.at(edge, np.minimum(e[fails] + 1, offsets[1:][o[fails]]), -1)
    stays = np.cumsum(edge)[: len(data)] == 0
    return {
        "n_words": count, "word_chars": chars, "n_symbols": K.per_document(symbol, offsets), "n_dup_lines": np.bincount(o[dup], minlength=n),
        "n_repeat_words": repeat, "n_lines": np.bincount(o, minlength=n), "n_failed_lines": np.bincount(o[fails], minlength=n), "lost_chars": lost,
        "base_failed": base, "kept": ~base & (lost <= most_lost * chars), "stays": stays,
    }


def line_first(df: DataFrame, text_col: str = "text", most_lost: float = 0.5, cleaned: bool = True) -> DataFrame:
    """The rows with the measures, the verdict and, if asked for, the cleaned text, as one struct column `_quality`."""
    keep = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField("_quality", T._parse_datatype_string(_ADDED))])
    fields = schema["_quality"].dataType
    at = keep.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(at)):
                m = measure(data, offsets, most_lost)
                kept_text = pa.nulls(b - a, pa.string())
                if cleaned:
                    left = data[m["stays"]].tobytes()
                    ends = np.concatenate(([0], np.cumsum(K.per_document(m["stays"], offsets))))
                    kept_text = pa.array([left[x:y].decode("utf-8", "replace").removesuffix("\n") if y - x < z else left[x:y].decode("utf-8", "replace") for x, y, z in zip(ends, ends[1:], np.diff(offsets), strict=False)], pa.string())
                columns = [kept_text if f.name == "cleaned" else pa.array(m[f.name], pa.bool_() if f.name in ("base_failed", "kept") else pa.int64()) for f in fields]
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.StructArray.from_arrays(columns, [f.name for f in fields])], [*keep, "_quality"])

    return df.mapInArrow(run, schema)


def quality_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_lost: float = 0.5) -> DataFrame:
    """Id, measures and verdict of each document."""
    judged = line_first(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), most_lost=most_lost, cleaned=False)
    return judged.select("doc_id", *(F.col(f"_quality.{c}").alias(c) for c in (*MEASURES, "n_lines", "n_failed_lines", "lost_chars", "base_failed", "kept")))


def clean_documents(documents: DataFrame, text_col: str = "text", most_lost: float = 0.5) -> DataFrame:
    """The documents that are kept, without the lines that fail; the columns stay as they are."""
    plain, (text,) = numbered_columns(documents, text_col)
    judged = line_first(plain, text, most_lost).where("_quality.kept")
    return judged.select(*(F.col("_quality.cleaned").alias(c) if c == text else F.col(c) for c in plain.columns)).toDF(*documents.columns)
