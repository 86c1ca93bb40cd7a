"""Near-duplicate components: MinHash bands, odd sketches, exact confirmation.

A document's set holds the hashes of its distinct `k`-word shingles (lower-cased
A-Z; a shorter text is one shingle; none without words).  Documents with equal
sets form a class, of which only the smallest id goes on.  Two classes are linked
if ``den * |intersection| >= num * |union|``, always confirmed on the full sets.

Candidates share a band of `BAND_ROWS` MinHash values; there are as many bands
as leave a pair at the threshold unfound once in ten million.  The samples are
also folded into an odd sketch, a parity bitmap; the population count of two
sketches' XOR tells how alike a candidate pair is.  A pair goes no further if
more bits differ than a pair at the threshold has once in ten million times, by
the exact distribution of both MinHash and parity.

A group of n near copies has n(n-1)/2 links, but components don't need them:

1. in each band bucket, members are paired with the smallest id only, each member
   keeps the partner that looks most alike, and these pairs are confirmed;
2. buckets that still hold several components are compared pair by pair, in cells
   of a bounded number of members, by the sketch and then by a finer one of
   `FINE_SAMPLES` samples; of each cell only the members that look alike with one
   of another component go on, each once;
3. those meet again, in cells of a bounded number of shingles, with their full
   sets.  Pairs are confirmed inside the cell, in the bucket of the first band that
   they share, and components that a link joins are one from there on: what leaves
   a cell is a forest of confirmed links, fewer than it has members.

So every candidate pair is within one component already or was tested, and no
step writes more rows than members times cells.
Hubs with many members are dealt over several tasks by a salt.

Nulls: a null text has no words and is linked with nothing; a null id ranks
before all others.  Rows of one id are one document, linked by any of its texts.
A very long text is one set, in one task; cells
are bounded by shingles.  Empty tables give empty results.  Only id and text are used, so columns with
clashing names don't matter.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import numbered_columns, written

BAND_ROWS, UNFOUND = 5, 1e-7
SKETCH_BITS = 256
#: The finer odd sketch of those that are still apart.
FINE_SAMPLES, FINE_BITS = 1024, 2048
#: Members for each part of a bucket, members of a hub for each task.
CELL, HUB_MEMBERS = 2048, 512
#: Shingles for each part of a bucket whose full sets are compared; what a member counts besides its shingles.
CELL_SETS, SET_COST = 1 << 19, 256
#: Pairs of a cell that are looked at together.
PAIRS = 500_000
#: Ids are broadcast up to so many (8 bytes each and a hash table's overhead), else joined by a shuffle.
BROADCAST_IDS = 1_000_000
_NO_ID = -(1 << 63)
_rng = np.random.Generator(np.random.PCG64(77))
_SEEDS = _rng.integers(1, 2**63, (2, 512), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_count(num: int, den: int) -> int:
    return math.ceil(math.log(UNFOUND) / math.log(1 - (num / den) ** BAND_ROWS))


@functools.cache
def most_apart(num: int, den: int, samples: int, bits: int) -> int:
    """The differing bits of two odd sketches that a pair at the threshold exceeds with a probability of `UNFOUND` at most."""
    t = num / den
    odd = np.zeros(bits + 1)  # the probability of each number of odd bits after some flips
    odd[0] = 1
    up, down = 1 - np.arange(bits) / bits, np.arange(1, bits + 1) / bits
    total = np.zeros(bits + 1)
    for differ in range(samples + 1):  # each sample that differs flips a bit of either sketch
        log = math.lgamma(samples + 1) - math.lgamma(differ + 1) - math.lgamma(samples - differ + 1)
        chance = math.exp(log + differ * math.log(1 - t) + (samples - differ) * math.log(t)) if 0 < t < 1 else float(differ == (0 if t else samples))
        total += chance * odd
        for _ in range(2):
            new = np.zeros(bits + 1)
            new[1:] += odd[:-1] * up
            new[:-1] += odd[1:] * down
            odd = new
    beyond = np.cumsum(total[::-1])[::-1]  # so many or more
    return int(np.flatnonzero(beyond > UNFOUND)[-1])


def _class_hashes(grams: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each document's set."""
    out = []
    for seed in (0, 1):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(K.mix(grams * _SEEDS[seed][511]), dtype=np.uint64)))
        out.append((total[first[1:]] - total[first[:-1]]).view(np.int64))
    return out


def _sets(k: int, fine: bool):
    """id, one and the document's fine odd sketch or its full set."""
    factors = np.random.Generator(np.random.PCG64(78)).integers(1, 2**63, (2, FINE_SAMPLES), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(1)):
                grams, first = _shingles(data, offsets, k)
                one = _class_hashes(grams, first)[0]
                if fine:
                    full = np.flatnonzero(np.diff(first))
                    odd = np.zeros((b - a, FINE_BITS), np.uint8)
                    for x, y in zip(factors[0], factors[1], strict=True):
                        if len(full):
                            bit = K.mix(np.minimum.reduceat(grams * x, first[full]) + y) % np.uint64(FINE_BITS)
                            odd[full, bit.astype(np.int64)] ^= 1
                    held = [x.tobytes() for x in np.packbits(odd, axis=1)]
                else:
                    held = [grams[x:y].tobytes() for x, y in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(one), pa.array(held, pa.binary())], ["id", "one", "fine" if fine else "grams"])

    return run


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each document in a row, first of each document and at last their number)."""
    data = K.LOWER[data]
    starts, ends, first = K.words(data, offsets)
    hashes = K.span_hashes(data, starts, ends)
    grams = K.gram_hashes(hashes, k)
    owner, whole = K.gram_owner(first, k, len(grams))
    grams, owner = grams[whole], owner[whole]
    few = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    if len(few):
        alone = np.array([K.gram_hashes(hashes[first[i] : first[i + 1]], int(first[i + 1] - first[i]))[0] for i in few], np.uint64) ^ np.diff(first)[few].astype(np.uint64)
        grams, owner = np.concatenate((grams, alone)), np.concatenate((owner, few))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    return grams[new], np.searchsorted(owner[new], np.arange(len(offsets)))


def _features(k: int, bands: int):
    samples = bands * BAND_ROWS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in K.blocks(batch.column(1)):
                grams, first = _shingles(data, offsets, k)
                n = np.diff(first)
                full = np.flatnonzero(n)
                sums = _class_hashes(grams, first)
                least = np.zeros((samples, len(n)), np.uint64)
                for i in range(samples if len(full) else 0):
                    least[i, full] = np.minimum.reduceat(grams * _SEEDS[0][i], first[full])
                keys = np.zeros((bands, len(n)), np.uint64)
                for j in range(bands):
                    key = np.full(len(n), j, np.uint64)
                    for row in least[j * BAND_ROWS : (j + 1) * BAND_ROWS]:
                        key = K.mix(key * K._BASE[0] + row)
                    keys[j] = key
                odd = np.zeros((len(n), SKETCH_BITS), np.uint8)
                for i in range(samples):
                    bit = (K.mix(least[i] + _SEEDS[1][i]) % np.uint64(SKETCH_BITS)).astype(np.int64)
                    odd[np.arange(len(n)), bit] ^= 1
                sketch = np.packbits(odd, axis=1).view("<i8")
                body = np.ascontiguousarray(keys.T)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n.astype(np.int64)), *map(pa.array, sums), *(pa.array(np.ascontiguousarray(sketch[:, j])) for j in range(4)), pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * bands), pa.array(body.ravel().view(np.int64)))],
                    ["id", "n", "one", "two", "s0", "s1", "s2", "s3", "bands"],
                )

    return run


def _binary(batch: pa.RecordBatch, name: str) -> bytes:
    return b"".join(batch.column(name).to_pylist())


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows sorted by key and cell, as runs of whole cells of up to `PAIRS` pairs (or one cell), and the bounds of the cells."""
    rest: list[pa.RecordBatch] = []
    for batch in _with_end(batches):
        if batch is not None:
            rest.append(batch)
        held = pa.Table.from_batches(rest).combine_chunks().to_batches() if rest else []
        if not held:
            continue
        held = held[0]
        key, cell = held.column("key").to_numpy(), held.column("cell").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (cell[1:] != cell[:-1]), [True])))
        ready, at = len(edges) - (1 if batch is None else 2), 0
        many = np.diff(edges)
        while at < ready:
            to = min(ready, at + max(1, int(np.searchsorted(np.cumsum(many[at:ready] * (many[at:ready] - 1) // 2), PAIRS))))
            yield held.slice(edges[at], edges[to] - edges[at]), edges[at : to + 1] - edges[at]
            at = to
        rest = [held.slice(edges[ready])] if edges[ready] < len(held) else []


def _alike(rows: pa.RecordBatch, edges: np.ndarray, label: np.ndarray, num: int, den: int, bands: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of a cell, in chunks, that have different labels and that both sketches let pass, each in the bucket of the first band that it shares."""
    most, fine_most = most_apart(num, den, bands * BAND_ROWS, SKETCH_BITS), most_apart(num, den, FINE_SAMPLES, FINE_BITS)
    n, side, cell, key = (rows.column(c).to_numpy() for c in ("n", "side", "cell", "key"))
    sketch = np.stack([rows.column(f"s{i}").to_numpy() for i in range(4)], 1).view(np.uint64)
    fine = np.frombuffer(_binary(rows, "fine"), np.uint64).reshape(-1, FINE_BITS // 64)
    keys = rows.column("bands").flatten().to_numpy().reshape(-1, bands)
    cross = cell % (1 << 20) != cell >> 20
    each = np.diff(edges) * (np.diff(edges) - 1) // 2
    ends = np.cumsum(each)
    for low in range(0, int(ends[-1]), PAIRS):
        place = np.arange(low, min(low + PAIRS, int(ends[-1])))
        group = np.searchsorted(ends, place, "right")
        place -= (ends - each)[group]
        # The pair of a cell's members (i < j) at a place: j(j-1)/2 + i.
        j = ((1 + np.sqrt(1 + 8 * place.astype(np.float64))) / 2).astype(np.int64)
        j -= j * (j - 1) // 2 > place
        j += (j + 1) * j // 2 <= place
        x, y = edges[group] + place - j * (j - 1) // 2, edges[group] + j
        ok = (label[x] != label[y]) & (~cross[x] | (side[x] != side[y])) & (den * np.minimum(n[x], n[y]) >= num * np.maximum(n[x], n[y]))
        x, y = x[ok], y[ok]
        ok = np.bitwise_count(sketch[x] ^ sketch[y]).sum(1, dtype=np.int64) <= most
        x, y = x[ok], y[ok]
        for c in range(0, len(x), 50_000):
            p, q = x[c : c + 50_000], y[c : c + 50_000]
            ok = np.bitwise_count(fine[p] ^ fine[q]).sum(1, dtype=np.int64) <= fine_most
            p, q = p[ok], q[ok]
            ok = (keys[p] == keys[q]).argmax(1) == (keys[p] == key[p, None]).argmax(1)
            if ok.any():
                yield p[ok], q[ok]


def _partnered(num: int, den: int, bands: int):
    """The members of each cell that look alike with one of another component: key, id, one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in _whole_cells(batches):
            mark = np.zeros(len(rows), bool)
            for x, y in _alike(rows, edges, rows.column("comp").to_numpy(), num, den, bands):
                mark[x], mark[y] = True, True
            if mark.any():
                yield rows.select(["key", "id", "one"]).filter(pa.array(mark))

    return run


def _links(num: int, den: int, bands: int):
    """The links between components that the full sets of a cell's members confirm: a forest, as components that are linked within the cell are one from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, edges in _whole_cells(batches):
            ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
            # A component's label holds within one cell; each cell has labels of its own.
            cell = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            _, label = np.unique(np.stack((cell, rows.column("comp").to_numpy())), axis=1, return_inverse=True)
            label = label.ravel()
            grams = np.frombuffer(_binary(rows, "grams"), np.uint64)
            first = np.concatenate(([0], np.cumsum(n)))
            out: list[tuple[int, int]] = []
            for left, right in _alike(rows, edges, label, num, den, bands):
                order = np.lexsort((left, right))
                left, right = left[order], right[order]
                for lo, hi in zip(*_heads(right), strict=True):
                    y = int(right[lo])
                    x = left[lo:hi]
                    x = x[label[x] != label[y]]
                    if not len(x):
                        continue
                    own = grams[first[y] : first[y + 1]]
                    other = grams[np.repeat(first[x], n[x]) + np.arange(n[x].sum()) - np.repeat(np.cumsum(n[x]) - n[x], n[x])]
                    hit = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                    both = np.add.reduceat(hit.astype(np.int64), np.cumsum(n[x]) - n[x])
                    for z in x[den * both >= num * (n[x] + n[y] - both)].tolist():
                        if label[z] != label[y]:
                            out.append((min(ids[z], ids[y]), max(ids[z], ids[y])))
                            label[label == label[z]] = label[y]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _heads(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(from, to) of the runs of equal values."""
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return starts, np.append(starts[1:], len(values))


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _confirmed(num: int, den: int, k: int):
    """From rows sorted by hub: the pairs of a hub and a member that the full sets confirm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sets = None, []
        for batch in batches:
            names = batch.schema.names
            hub, salt, role, member = (batch.column(names.index(c)).to_numpy().tolist() for c in ("hub", "salt", "role", "member"))
            out = []
            for a, _, data, offsets in K.blocks(batch.column(names.index("text"))):
                grams, first = _shingles(data, offsets, k)
                for i, own in enumerate(np.split(grams, first[1:-1])):
                    at = a + i
                    if (hub[at], salt[at]) != now:
                        now, sets = (hub[at], salt[at]), []
                    if role[at] == 0:
                        sets.append(own.copy())
                        continue
                    for other in sets:
                        if len(own) and len(other) and den * min(len(own), len(other)) >= num * max(len(own), len(other)):
                            place = np.minimum(np.searchsorted(other, own), len(other) - 1)
                            both = int((other[place] == own).sum())
                            if den * both >= num * (len(own) + len(other) - both):
                                out.append((hub[at], member[at]))
                                break
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _needed(documents: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents with these ids."""
    ids = written(ids, "ids")
    return documents.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi")


def confirm(pairs: DataFrame, documents: DataFrame, num: int, den: int, k: int) -> DataFrame:
    """Of the pairs (a, b) of ids, a written table, those whose full sets are alike enough."""
    salts = pairs.groupBy(F.col("a").alias("hub")).agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("salts"))
    members = pairs.select(F.col("a").alias("hub"), F.col("b").alias("member"))
    texts = written(_needed(documents, pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), "texts")
    left = salts.join(texts, F.col("hub") == F.col("id")).select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("role"), F.col("id").alias("member"), "text")
    right = members.join(salts, "hub").join(texts, F.col("member") == F.col("id")).select("hub", F.pmod(F.xxhash64("member"), "salts").cast("int").alias("salt"), F.lit(1).alias("role"), "member", "text")
    rows = left.unionByName(right).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "role")
    return rows.mapInArrow(_confirmed(num, den, k), "a long, b long")


def _in_cells(members: DataFrame, weights: DataFrame, size: int) -> DataFrame:
    """The members (key, id, one, comp) of the buckets that `weights` has, once for each cell that they are in, with cell and side.

    A bucket's members are dealt to parts of about `size` of its weight; a cell holds a part, or two whose members are compared across.
    """
    dealt = members.join(weights.select("key", F.ceil(F.col("weight") / size).cast("int").alias("parts")), "key").withColumn("part", F.pmod(F.xxhash64("id", "one"), "parts").cast("long"))
    each = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return each.select("key", (F.least("part", "other") * (1 << 20) + F.greatest("part", "other")).alias("cell"), F.col("part").alias("side"), "id", "one", "comp")


def near_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, k: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable) and kept (whether that is the document itself)."""
    bands = band_count(num, den)
    docs = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = written(docs.mapInArrow(_features(k, bands), "id long, n long, one long, two long, s0 long, s1 long, s2 long, s3 long, bands array<bigint>"), "features")
    sketch = ["s0", "s1", "s2", "s3"]
    classes = seen.where("n > 0").groupBy("one", "two").agg(F.min("id").alias("rep"))
    heads = seen.where("n > 0").select("id", "n", "bands", *sketch, "one", "two").join(classes, ["one", "two"]).where("id = rep").dropDuplicates(["id", "one", "two"]).drop("rep", "two")
    heads = written(heads, "heads")
    # Keys of two members or more, each with its smallest; a key's rows are combined before the shuffle, and the join splits hot ones.
    keyed = heads.select("id", "one", F.explode("bands").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    groups = written(keyed.join(hubs, "key"), "groups")
    of = lambda c, s: heads.select(F.col("id").alias(c), F.col("n").alias(f"n{s}"), *(F.col(x).alias(f"{x}{s}") for x in sketch))

    # 1. Each member and the hub that looks most alike.
    apart = sum((F.bit_count(F.col(f"{x}_a").bitwiseXOR(F.col(f"{x}_b"))) for x in sketch), F.lit(0))
    most = most_apart(num, den, bands * BAND_ROWS, SKETCH_BITS)
    stars = groups.where("id > hub").select("id", "hub").distinct().join(of("hub", "_a"), "hub").join(of("id", "_b"), "id")
    stars = stars.withColumn("apart", apart).where((F.col("apart") <= most) & (den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")))
    pairs = written(stars.groupBy(F.col("id").alias("b")).agg(F.min_by("hub", F.struct("apart", "hub")).alias("a")), "pairs")
    links = written(confirm(pairs, docs, num, den, k), "links")

    # 2. Buckets that hold several components: members that look alike with one of another component, then their full sets.
    comp = components(links).withColumnRenamed("id", "_i")
    members = written(groups.join(comp, F.col("id") == F.col("_i"), "left").select("key", "id", "one", F.coalesce("component", "id").alias("comp")), "members")
    split = members.groupBy("key").agg(F.min("comp").alias("_l"), F.max("comp").alias("_h"), F.count("*").alias("weight")).where("_l < _h").select("key", "weight")
    mixed = members.select("key", "id", "one").join(split.select("key"), "key", "left_semi").select("id", "one").distinct()
    fine = _needed(docs, mixed.select("id").distinct()).mapInArrow(_sets(k, True), "id long, one long, fine binary").dropDuplicates(["id", "one"])
    looks = written(heads.join(fine, ["id", "one"]), "looks")
    cells = _in_cells(members, split, CELL).join(looks, ["id", "one"]).repartition("key", "cell").sortWithinPartitions("key", "cell")
    alike = written(cells.mapInArrow(_partnered(num, den, bands), "key long, id long, one long").distinct(), "alike")
    sets = _needed(docs, alike.select("id").distinct()).mapInArrow(_sets(k, False), "id long, one long, grams binary").dropDuplicates(["id", "one"])
    weight = alike.join(heads.select("id", "one", "n"), ["id", "one"]).groupBy("key").agg(F.sum(F.col("n") + SET_COST).alias("weight"))
    cells = _in_cells(alike.join(members, ["key", "id", "one"]), weight, CELL_SETS).join(looks, ["id", "one"]).join(sets, ["id", "one"]).repartition("key", "cell").sortWithinPartitions("key", "cell")
    links = written(links.unionByName(cells.mapInArrow(_links(num, den, bands), "a long, b long")), "links")

    comp = components(links)
    rep = classes.join(comp, F.col("rep") == F.col("id"), "left").select("one", "two", F.coalesce("component", "rep").alias("component"))
    rows = seen.select("id", "n", "one", "two").join(rep, ["one", "two"], "left").select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
    null = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return rows.select(null("id").alias("doc_id"), F.col("n").alias("n_shingles"), null("component").alias("component_id"), (F.col("id") == F.col("component")).alias("kept"))


def drop_near_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = 80, den: int = 100, k: int = 5) -> DataFrame:
    """The documents whose id is the smallest of their component; of rows with equal ids, all or none stay."""
    gone = near_components(documents, id_col, text_col, num, den, k).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    plain, (own,) = numbered_columns(documents, id_col)
    return plain.join(gone, F.col(own) == F.col("_gone"), "left_anti").toDF(*documents.columns)
