"""Substring deduplication with a log-structured fingerprint index.

A window is `window` consecutive words of one document.  A word is removed if a
window that covers it has a word sequence that also starts in a document with a
smaller id; windows are judged on the input.

Index.  Of each window only its fingerprint is kept: the least hash among its
4-word grams.  Equal windows have equal fingerprints, so no equal pair of
windows is lost, and a text has few distinct ones (about a sixth of its words).
`ingest` sorts a batch's (fingerprint, text class) pairs into a new immutable run
and merge-joins it with each run of earlier batches; what comes out are hits, pairs
whose fingerprint stands in two different texts.  Beyond `fan_in` runs, `compact`
merges them into one.  Runs are tables bucketed by a hash of the fingerprint and
sorted within a bucket: joining and compacting them shuffles nothing, and within a
bucket sorted arrays are merged, not sorted anew.

Verification.  `resolve` goes back to the texts: windows under a hit meet by a
64-bit hash, and those of one hash are compared word by word with the one of the
smallest document id.  Their words travel as stretches that neighbouring windows
share.  Texts of equal words form a class (128-bit hash of the words); its smallest
id stands for it, the others are wholly covered.

Everything moves in buckets of a fixed number of text bytes, as packed numbers
and compressed texts, so a task's memory doesn't grow with the corpus.  What a
task settles by itself doesn't go through a key's bucket: equal texts move
once, of the texts that share a fingerprint two, of those that share a window
the one with the smallest id.  Buckets of windows that still grow large are
first settled in parts (`PART_BYTES`).  Texts are shuffled once, into a bucketed
table that both later steps read.  All tables lie in the shared folder: a lost
executor costs a task.

Nulls: a null text has no words; null ids rank before all others.  Rows of one
id are one document and don't count against each other; where their texts
differ, places found in one are removed in all.  Of equal windows of several ids the
smallest id keeps its own, so ties can't arise.  A very long text is split into words and
windows by one task, which holds its bytes and some 40 bytes for each of its words.  Empty
tables give empty results.  Only id
and text are used, so columns with clashing names don't matter.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import delete, new_path, written

WINDOW, GRAM = 13, 4
#: Bytes of text for each bucket, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 12 << 20, 32
#: Entries that a task gathers before it deals them out; bytes of windows that one task compares at once; most files of a table.
ENTRIES, PART_BYTES, MOST_FILES = 1_000_000, 64 << 20, 65_536
#: Batches of `remove_repeats`: more than the runs that an index keeps, so that it compacts.
BATCHES = 6
_NO_ID = -(1 << 63)
_PAIRS = "bucket int, kind int, a binary, b binary"
_TEXTS = "bucket int, kind int, a binary, b binary, c binary, d binary, e binary"


def _classes(hashes: np.ndarray, first: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each document's word sequence."""
    n = np.diff(first)
    place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(first[:-1], n).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(hashes + (place + np.uint64(1)) * K._PLACE[seed][63]), dtype=np.uint64)))
    return K.mix(total[first[1:]] - total[first[:-1]] + n.astype(np.uint64) * K._PLACE[seed][62])


class _Block:
    """Words, class hashes and fingerprints of a block of documents."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, buckets: int):
        self.data, self.offsets = data, offsets
        self.starts, self.ends, self.first = K.words(data, offsets)
        self.h = [K.span_hashes(data, self.starts, self.ends, seed) for seed in (0, 1)]
        self.buckets = buckets

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        return _classes(self.h[0], self.first, 0), _classes(self.h[1], self.first, 1)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window: the place of its first word, and its key: bucket in the upper, hash in the lower 32 bits."""
        n = len(self.starts) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        grams = K.gram_hashes(self.h[0], GRAM)
        least = grams[:n].copy()
        for j in range(1, WINDOW - GRAM + 1):
            np.minimum(least, grams[j : n + j], out=least)
        self.owner, whole = K.gram_owner(self.first, WINDOW, n)
        where = np.flatnonzero(whole)
        least = K.mix(least[where])
        return where, ((least >> np.uint64(32)) % np.uint64(self.buckets)) << np.uint64(32) | least & np.uint64(0xFFFFFFFF)


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _slices(keys: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(key, from, to) of the runs of equal sorted keys."""
    if len(keys):
        edges = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))
        for a, b in zip(edges, edges[1:], strict=False):
            yield int(keys[a]), int(a), int(b)


def _rows(schema_names: list[str], rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32() if c in ("bucket", "kind") else pa.binary() for c in schema_names]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], schema_names)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """A bucket's rows at a time, from rows sorted by bucket and kind."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now:
                if held:
                    yield now, held
                now, held = row["bucket"], []
            held.append(row)
    if held:
        yield now, held


def _joined(rows: list[dict], column: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def _entries(buckets: int):
    """Kind 1: fingerprints and classes by the fingerprints' buckets; kind 3: hits, by the buckets of the texts."""

    def dealt(keys: list[np.ndarray], tags: list[np.ndarray]) -> pa.RecordBatch | None:
        key, tag = np.concatenate(keys), np.concatenate(tags)
        order = np.lexsort((tag, key))
        key, tag = key[order], tag[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])
        key, tag = key[new], tag[new]
        # Two texts settle that a fingerprint is shared; the others with it are hits at once.
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        third = np.arange(len(key)) - np.repeat(heads, np.diff(np.append(heads, len(key)))) >= 2
        rows = _hits(key[third], tag[third], buckets, 3)
        key, tag = key[~third], tag[~third]
        low = key.astype(np.uint32)
        rows += [(b, 1, low[x:y].tobytes(), tag[x:y].tobytes()) for b, x, y in _slices(key >> np.uint64(32))]
        return _rows(["bucket", "kind", "a", "b"], rows) if rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, tags = [], []
        for batch in batches:
            for _, _, data, offsets in K.blocks(batch.column(1)):
                block = _Block(data, offsets, buckets)
                where, key = block.fingerprints()
                if len(where):
                    tag = block.classes()[0][block.owner[where]]
                    new = np.concatenate(([True], (key[1:] != key[:-1]) | (tag[1:] != tag[:-1])))
                    keys.append(key[new])
                    tags.append(tag[new])
                if sum(map(len, keys)) > ENTRIES:
                    if (out := dealt(keys, tags)) is not None:
                        yield out
                    keys, tags = [], []
        if keys and (out := dealt(keys, tags)) is not None:
            yield out

    return run


def _hits(key: np.ndarray, tag: np.ndarray, buckets: int, kind: int = 1) -> list[tuple]:
    to = tag % np.uint64(buckets)
    order = np.argsort(to, kind="stable")
    key, tag = key[order], tag[order]
    return [(b, kind, key[x:y].tobytes(), tag[x:y].tobytes()) for b, x, y in _slices(to[order])]


def _pair_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_rows(["bucket", "kind", "a", "b"], rows)])


def _merged(lows: list[np.ndarray], tags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted sequences as one, without repetitions: a stable merge by fingerprint, then by class where fingerprints are equal."""
    low, tag = np.concatenate(lows), np.concatenate(tags)
    order = np.argsort(low, kind="stable")
    low, tag = low[order], tag[order]
    same = np.concatenate(([False], low[1:] == low[:-1]))
    tied = np.flatnonzero(same | np.append(same[1:], False))
    tag[tied] = tag[tied][np.lexsort((tag[tied], low[tied]))]
    new = np.ones(len(low), bool)
    new[1:] = ~same[1:] | (tag[1:] != tag[:-1])
    return low[new], tag[new]


def _sorted(buckets: int):
    """A bucket's new entries as a run (kind 0), and its hits: those among themselves and those that came (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        bucket, rows = table.column("bucket")[0].as_py(), table.to_pylist()
        came = [(bucket, 1, r["a"], r["b"]) for r in rows if r["kind"] == 3]
        rows = [r for r in rows if r["kind"] == 1]
        if not rows:
            return _pair_table(came)
        low, tag = _merged([np.frombuffer(r["a"], "<u4") for r in rows], [np.frombuffer(r["b"], "<u8") for r in rows])
        same = low[1:] == low[:-1]
        hit = np.concatenate(([False], same)) | np.concatenate((same, [False]))
        key = low[hit].astype(np.uint64) | np.uint64(bucket) << np.uint64(32)
        return _pair_table([(bucket, 0, low.tobytes(), tag.tobytes()), *came, *_hits(key, tag[hit], buckets)])

    return run


def _joined_runs(buckets: int):
    """The hits (kind 1) between two runs of a bucket: a merge join."""

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        if not len(new) or not len(old):
            return _pair_table([])
        bucket, sides = new.column("bucket")[0].as_py(), [(_joined(t.to_pylist(), "a", "<u4"), _joined(t.to_pylist(), "b", "<u8")) for t in (new, old)]
        hits = []
        for (low, tag), (other, their) in (sides, sides[::-1]):
            first = np.searchsorted(other, low, "left")
            many = np.searchsorted(other, low, "right") - first
            hit = many > 1  # at most one of them is of the same class
            one = np.flatnonzero(many == 1)
            hit[one] = their[first[one]] != tag[one]
            hits += _hits(low[hit].astype(np.uint64) | np.uint64(bucket) << np.uint64(32), tag[hit], buckets)
        return _pair_table(hits)

    return run


def _compacted(left: pa.Table, right: pa.Table) -> pa.Table:
    rows = [r for t in (left, right) for r in t.to_pylist()]
    low, tag = _merged([np.frombuffer(r["a"], "<u4") for r in rows], [np.frombuffer(r["b"], "<u8") for r in rows])
    return _pair_table([(rows[0]["bucket"], 0, low.tobytes(), tag.tobytes())])


def _texts(buckets: int):
    """Distinct texts of a block, compressed, with class hashes, lengths and the ids of each: a (class hashes), b (lengths), c (ids for each), d (ids), e (texts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids = _ids(batch.column(0))
            for a, b, data, offsets in K.blocks(batch.column(1)):
                one, two = _Block(data, offsets, buckets).classes()
                order = np.lexsort((ids[a:b], two, one, one % np.uint64(buckets)))
                one, two, own = one[order], two[order], ids[a:b][order]
                head = np.ones(len(order), bool)
                head[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
                heads = np.flatnonzero(head)
                each = np.diff(np.append(heads, len(order)))
                at = order[heads]
                rows = []
                for bucket, x, y in _slices(one[heads] % np.uint64(buckets)):
                    blob = b"".join(data[offsets[i] : offsets[i + 1]].tobytes() for i in at[x:y])
                    p, q = heads[x], heads[y] if y < len(heads) else len(order)
                    rows.append((bucket, 2, np.stack((one[heads[x:y]], two[heads[x:y]]), 1).tobytes(), (offsets[at[x:y] + 1] - offsets[at[x:y]]).astype(np.int32).tobytes(), each[x:y].astype(np.int32).tobytes(), own[p:q].tobytes(), packer.compress(blob)))
                if rows:
                    yield _rows(["bucket", "kind", "a", "b", "c", "d", "e"], rows)

    return run


def _unpacked(rows: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """(bytes, offsets, first class hashes, ids of each text, ascending) for blocks of a bucket's distinct texts."""
    classes = _joined(rows, "a", "<u8").reshape(-1, 2)
    length, each, ids = _joined(rows, "b", "<i4").astype(np.int64), _joined(rows, "c", "<i4"), _joined(rows, "d", "<i8")
    row = np.repeat(np.arange(len(rows)), [len(r["b"]) // 4 for r in rows])
    order = np.lexsort((classes[:, 1], classes[:, 0]))
    ids_end = np.cumsum(each)
    chosen, members = [], {}
    sorted_classes = classes[order]
    edge = np.ones(len(order), bool)
    edge[1:] = (sorted_classes[1:] != sorted_classes[:-1]).any(1)
    for head, tail in zip(np.flatnonzero(edge), np.append(np.flatnonzero(edge)[1:], len(order)), strict=True):
        own = [ids[ids_end[i] - each[i] : ids_end[i]] for i in order[head:tail]]
        chosen.append(int(order[head:tail].min()))
        members[chosen[-1]] = np.sort(np.concatenate(own)) if len(own) > 1 else own[0]
    unpacker = zstandard.ZstdDecompressor()
    part, part_size, now, body, ends = [], 0, -1, b"", None
    bounds = np.cumsum(length)

    def done(part: list[tuple[int, bytes]]):
        text = b"".join(t for _, t in part)
        return np.frombuffer(text, np.uint8), np.concatenate(([0], np.cumsum([len(t) for _, t in part]))), classes[[i for i, _ in part], 0], [members[i] for i, _ in part]

    for i in sorted(chosen):
        if row[i] != now:
            now = row[i]
            body = unpacker.decompress(rows[now]["e"]) if rows[now]["e"] else b""
            base = bounds[np.searchsorted(row, now)] - length[np.searchsorted(row, now)]
        text = body[bounds[i] - length[i] - base : bounds[i] - base]
        if part and part_size + len(text) > K.BLOCK_BYTES:
            yield done(part)
            part, part_size = [], 0
        part.append((i, text))
        part_size += len(text)
    if part:
        yield done(part)


def _seen_before(hashes: np.ndarray, ids: np.ndarray, start: np.ndarray, length: np.ndarray, body: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Of windows whose words are body[start : start + length]: which have equal words in a smaller id, and which of the others come first for their words (or share the first's id)."""
    order = np.lexsort((ids, hashes))
    h, own = hashes[order], ids[order]
    heads = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    ends = np.append(heads[1:], len(h))
    later = np.zeros(len(h), bool)
    several = ends - heads > 1
    a, n = start[order].tolist(), length[order].tolist()
    for lo, hi in zip(heads[several].tolist(), ends[several].tolist(), strict=True):
        least = own[lo]
        text = body[a[lo] : a[lo] + n[lo]]
        firsts = None
        for k in range(lo + 1, hi):
            if body[a[k] : a[k] + n[k]] == text:
                later[k] = own[k] > least
            else:  # other words of the same hash
                firsts = firsts if firsts is not None else {}
                later[k] = own[k] > firsts.setdefault(body[a[k] : a[k] + n[k]], own[k])
    out = np.zeros(len(h), bool)
    out[order] = later
    return out, ~out


def _windows(buckets: int):
    """Of a bucket's hits and its distinct texts: the windows under a hit.

    Kind -1: settled here, as they start in a smaller id of the same bucket too; a (ids), b (places), for the texts' own bucket.
    Others go by their fingerprints: kind (the texts' bucket), a (hashes), b (ids), c (places), d (start and length of the words in e), e (words, compressed).
    """

    def run(hits: pa.Table, texts: pa.Table) -> pa.Table:
        names = ["bucket", "kind", "a", "b", "c", "d", "e"]
        out = [(0, 0, b"", b"", b"", b"", b"")][:0]
        if not len(hits) or not len(texts):
            return pa.Table.from_batches([_rows(names, out)])
        bucket, rows = hits.column("bucket")[0].as_py(), hits.to_pylist()
        wanted = np.unique(K.mix(_joined(rows, "a", "<u8") * K._BASE[0] + _joined(rows, "b", "<u8")))
        packer, found = zstandard.ZstdCompressor(level=1), []
        size = 0

        def settle() -> None:
            hashes, ids, place, key, start, length = (np.concatenate(x) for x in list(zip(*found, strict=True))[:6])
            body = b"".join(x[6] for x in found)
            base = np.repeat(np.cumsum([0] + [len(x[6]) for x in found])[:-1], [len(x[0]) for x in found])
            start = start + base
            before, on = _seen_before(hashes, ids, start, length, body)
            if before.any():
                out.append((bucket, -1, ids[before].tobytes(), place[before].tobytes(), None, None, None))
            hashes, ids, place, key, start, length = (x[on] for x in (hashes, ids, place, key, start, length))
            to = (key >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((place, ids, to))
            hashes, ids, place, to, start, length = (x[order] for x in (hashes, ids, place, to, start, length))
            for f, x, y in _slices(to):
                # Neighbouring windows overlap: a stretch of words is sent once.
                s, e = start[x:y], start[x:y] + length[x:y]
                cut = np.concatenate(([True], (s[1:] > e[:-1]) | (s[1:] < s[:-1])))
                first = np.flatnonzero(cut)
                last = np.append(first[1:], y - x) - 1
                at = np.concatenate(([0], np.cumsum(e[last] - s[first])[:-1]))
                stretch = np.cumsum(cut) - 1
                where = np.stack((s - s[first][stretch] + at[stretch], length[x:y]), 1).astype(np.int32)
                blob = b"".join(body[p:q] for p, q in zip(s[first].tolist(), e[last].tolist(), strict=True))
                out.append((f, bucket, hashes[x:y].tobytes(), ids[x:y].tobytes(), place[x:y].tobytes(), where.tobytes(), packer.compress(blob)))
            found.clear()

        for data, offsets, tags, ids in _unpacked(texts.to_pylist()):
            block = _Block(data, offsets, buckets)
            where, key = block.fingerprints()
            if not len(where):
                continue
            owner = block.owner[where]
            code = K.mix(key * K._BASE[0] + tags[owner])
            at = np.searchsorted(wanted, code)
            under = wanted[np.minimum(at, len(wanted) - 1)] == code
            where, owner, key = where[under], owner[under], key[under]
            if not len(where):
                continue
            # The block's words, with one space behind each.
            long = block.ends - block.starts
            body = np.full(int(long.sum()) + len(long), 32, np.uint8)
            body[np.arange(int(long.sum())) + np.repeat(np.arange(len(long)), long)] = data[~K.SPACE[data]]
            start = np.cumsum(long) - long + np.arange(len(long))
            found.append((K.gram_hashes(block.h[0], WINDOW)[where], np.array([x[0] for x in ids], np.int64)[owner], (where - block.first[owner]).astype(np.int32), key, start[where], start[where + WINDOW - 1] + long[where + WINDOW - 1] - start[where], body.tobytes()))
            size += len(body)
            if size > 4 * K.BLOCK_BYTES:
                settle()
                size = 0
        if found:
            settle()
        return pa.Table.from_batches([_rows(names, out)])

    return run


def _later(part: bool):
    """The windows that also start in a document with a smaller id, for the buckets of their texts (kind -1): a (ids), b (places); from a part of a bucket, also those that go on."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        unpacker = zstandard.ZstdDecompressor()
        bodies = [unpacker.decompress(r["e"]) if len(r["e"]) else b"" for r in rows]
        many = [len(r["a"]) // 8 for r in rows]
        base = np.repeat(np.cumsum([0] + [len(b) for b in bodies])[:-1], many)
        where = _joined(rows, "d", "<i4").reshape(-1, 2).astype(np.int64)
        ids, place = _joined(rows, "b", "<i8"), _joined(rows, "c", "<i4")
        home = np.repeat(np.array([r["kind"] for r in rows], np.int64), many)
        before, on = _seen_before(_joined(rows, "a", "<u8"), ids, where[:, 0] + base, where[:, 1], b"".join(bodies))
        at = np.flatnonzero(before)
        at = at[np.argsort(home[at], kind="stable")]
        out = [(b, -1, ids[at[x:y]].tobytes(), place[at[x:y]].tobytes(), None, None, None) for b, x, y in _slices(home[at])]
        if part:
            edges = np.cumsum([0, *many])
            for r, lo, hi in zip(rows, edges, edges[1:], strict=False):
                k = np.flatnonzero(on[lo:hi])
                if len(k):
                    pick = lambda c, kind, r=r, k=k: np.frombuffer(r[c], kind)[k].tobytes()
                    out.append((r["bucket"], r["kind"], pick("a", "<u8"), pick("b", "<i8"), pick("c", "<i4"), np.frombuffer(r["d"], "<i4").reshape(-1, 2)[k].tobytes(), r["e"]))
        return pa.Table.from_batches([_rows(["bucket", "kind", "a", "b", "c", "d", "e"], out)])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string()), ("kept_sha256", pa.string())])


def _kept(later: pa.Table, texts: pa.Table) -> pa.Table:
    """Of each row: id, number of words, words removed, and the kept words joined by one space."""
    gone_rows = later.to_pylist()
    ids, place = _joined(gone_rows, "a", "<i8"), _joined(gone_rows, "b", "<i4")
    order = np.argsort(ids, kind="stable")
    ids, place = ids[order], place[order]
    batches = []
    for data, offsets, _, members in _unpacked(texts.to_pylist()) if len(texts) else ():
        out: list[tuple[int, int, int, bytes]] = []
        for i, own in enumerate(members):
            found = data[offsets[i] : offsets[i + 1]].tobytes().split()
            a, b = np.searchsorted(ids, own[0], "left"), np.searchsorted(ids, own[0], "right")
            gone = np.zeros(len(found) + 1, np.int64)
            at = place[a:b]
            at = at[at <= len(found) - WINDOW]
            np.add.at(gone, at, 1)
            np.add.at(gone, at + WINDOW, -1)
            stay = np.cumsum(gone)[:-1] == 0
            left = b" ".join(found) if stay.all() else b" ".join([found[j] for j in np.flatnonzero(stay)])
            out.append((own[0], len(found), int(len(found) - stay.sum()), left))
            whole = len(found) >= WINDOW
            for x in own[1:].tolist():
                out.append((x, *out[-1][1:]) if x == out[-1][0] else (x, len(found), len(found) if whole else 0, b"" if whole else b" ".join(found)))
        batches.append(
            pa.RecordBatch.from_arrays(
                [pa.array([None if r[0] == _NO_ID else r[0] for r in out], pa.int64()), *(pa.array([r[i] for r in out], pa.int64()) for i in (1, 2)), pa.array([r[3].decode("utf-8", "replace") for r in out], pa.string()), pa.array([hashlib.sha256(r[3]).hexdigest() for r in out], pa.string())],
                schema=_OUT,
            )
        )
    return pa.Table.from_batches(batches, _OUT)


class FingerprintIndex:
    """Runs and hits in a folder of the shared store; batches may come in any order."""

    def __init__(self, spark: SparkSession, buckets: int, folder: str | None = None, fan_in: int = 4):
        self.spark, self.buckets, self.fan_in = spark, buckets, fan_in
        self.folder = folder or new_path(spark, "fingerprints")
        self.runs: list[tuple[DataFrame, int]] = []  # and the number of its folder
        self.hits: list[DataFrame] = []
        self.made = self.compactions = 0
        self.names: list[str] = []

    def _table(self, rows: DataFrame) -> DataFrame:
        """The rows as a table that is bucketed by `bucket`, which joins and groups of it need not shuffle; a folder for each kind."""
        self.made += 1
        name = f"cliloom_{uuid.uuid4().hex}"
        self.names.append(name)
        rows.write.partitionBy("kind").bucketBy(min(self.buckets, MOST_FILES), "bucket").sortBy("bucket").option("path", f"{self.folder}/{self.made}").saveAsTable(name)
        return self.spark.table(name).select(*rows.columns)

    def _written(self, rows: DataFrame) -> DataFrame:
        self.made += 1
        rows.write.parquet(f"{self.folder}/{self.made}")
        return self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{self.made}")

    def ingest(self, batch: DataFrame) -> None:
        """doc_id, text: becomes a run, which is merge-joined with the earlier ones."""
        table = self._table(batch.select("doc_id", "text").mapInArrow(_entries(self.buckets), _PAIRS).groupBy("bucket").applyInArrow(_sorted(self.buckets), _PAIRS))
        run = table.where("kind = 0")
        self.hits.append(table.where("kind = 1"))
        for old, _ in self.runs:
            self.hits.append(self._written(run.groupBy("bucket").cogroup(old.groupBy("bucket")).applyInArrow(_joined_runs(self.buckets), _PAIRS)))
        self.runs.append((run, self.made - len(self.runs)))
        if len(self.runs) > self.fan_in:
            self.compact()

    def compact(self) -> None:
        """The runs become one, the smallest first; those merged are deleted, their hits stay."""
        while len(self.runs) > 1:
            (left, a), (right, b) = self.runs.pop(), self.runs.pop()
            merged = self._table(left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(_compacted, _PAIRS))
            self.runs.append((merged, self.made))
            for made in (a, b):
                delete(self.spark, f"{self.folder}/{made}/kind=0")
        self.compactions += 1

    def close(self) -> None:
        """Takes the index's tables from the catalog and deletes their files; nothing that reads them works any more."""
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []
        delete(self.spark, self.folder)

    def resolve(self, documents: DataFrame) -> DataFrame:
        """doc_id, n_words, n_removed, kept_text, kept_sha256 of documents (doc_id, text) that hold all that was ingested."""
        texts = self._table(documents.select("doc_id", "text").mapInArrow(_texts(self.buckets), _TEXTS).repartition(min(self.buckets, MOST_FILES), "bucket"))
        hits = self.hits[0]
        for more in self.hits[1:]:
            hits = hits.unionByName(more)
        found = self._written(hits.groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(_windows(self.buckets), _TEXTS))
        settled, open_ = found.where("kind < 0"), found.where("kind >= 0")
        parts = open_.groupBy("bucket").agg(F.ceil(F.sum(F.length("a") * 4 + F.length("e") * 4) / PART_BYTES).cast("int").alias("parts")).where("parts > 1")
        if not parts.isEmpty():
            salted = open_.join(parts, "bucket").withColumn("part", F.pmod("kind", "parts")).drop("parts")
            first = self._written(salted.groupBy("bucket", "part").applyInArrow(_later(True), _TEXTS))
            settled, open_ = settled.unionByName(first.where("kind < 0")), open_.join(parts, "bucket", "left_anti").unionByName(first.where("kind >= 0"))
        later = settled.unionByName(open_.groupBy("bucket").applyInArrow(_later(False), _TEXTS))
        return later.select("bucket", "a", "b").groupBy("bucket").cogroup(texts.groupBy("bucket")).applyInArrow(_kept, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (if `texts`) and kept_sha256 of each row, from an index that takes the documents in batches by id.

    The rows are written; the index and its tables are gone by then.
    """
    df = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = df.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    index = FingerprintIndex(df.sparkSession, max(LEAST_BUCKETS, size // BUCKET_BYTES))
    cuts = df.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.001) if batches > 1 else []
    edges = [None, *sorted({int(x) for x in cuts}), None]
    for low, high in zip(edges, edges[1:], strict=False):
        batch = df
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where((F.col("doc_id") <= high) | F.col("doc_id").isNull() if low is None else F.col("doc_id") <= high)
        index.ingest(batch)
    found = index.resolve(df)
    out = written(found if texts else found.drop("kept_text"), "kept")
    index.close()
    return out
