"""A trie of conversations' prefixes, by distributed MSD radix partitioning.

A turn (role and text) is told by the SHA-256 of both and gets a number from a
dictionary of the distinct turns, so a conversation is a short array of numbers.
Equal sequences become one class first, with its count and its smallest id, so
copies of a conversation, however many, are one row from there on.

Classes are partitioned by their next number, the most significant first: a bucket
is a node's classes with one next turn.  Buckets of up to `LOCAL_TURNS` turns are
local: they are dealt to tasks, and multikey quicksort finishes each, three-way
partitions by one number at a time, where each middle part is a node of the trie
that the recursion emits.  Larger buckets go into another round of partitioning
behind the longest prefix that all of their classes share (that of the least and
the greatest sequence), so rounds follow branchings, not turns.  Their few nodes are
summed up from the rounds below.

Nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
n_leaves, saved_tokens, ends_sha256.

Turns are ordered by `turn`, nulls first, ties by role, then by the digest of role and
text; repeated rows are repeated turns.  Nulls: a null role or text is empty; rows
with a null conversation id belong to none and are left out.  Texts of any length
count by their code points only.  An empty table has no members and gives no rows.
Only the named columns are read, so others may clash.

Scale: whole texts are digested where they are read and don't move.  A turn that a
third of all rows share is a hot key of one join with the dictionary, a sequence
that a third of all conversations share one of the join with its class; adaptive
execution splits both.  A digest of many ids (ends_sha256) is one sequential hash by
its definition: ids are sorted and joined to strings in blocks of `BLOCK_IDS` in
parallel, and a task streams those strings.  One conversation's numbers (12 bytes
a turn) are one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Turns of the classes that one task finishes at a time.
LOCAL_TURNS = 500_000
#: Ids are joined to one string by blocks of this width.
BLOCK_IDS = 100_000
_NO_IDS = hashlib.sha256(b"").hexdigest()


def encoded(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, ids (numbers of the turns in a dictionary) and chars (code points of their texts)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    told = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    rows = conversations.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), told.alias("told"), F.length(text).alias("chars"))
    turns = written(rows, "turns")
    dictionary = written(turns.select("told").distinct().select(F.col("told").alias("entry"), F.monotonically_increasing_id().alias("id")), "dictionary")
    numbered = turns.join(dictionary, F.col("told") == F.col("entry"))
    whole = numbered.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "told", "id", "chars"))).alias("turns"))
    return whole.select("conv_id", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))


def rebranched(sequences: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """Each conversation c with its first h turns, h = crc32(c) mod `most`, replaced by the first h of conversation c - c mod `group`."""
    own = written(sequences, "sequences")
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("head_id"), *(F.slice(c, 1, most).alias(f"head_{c}") for c in ("ids", "chars")))
    both = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")).join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("head_id"), "left")

    def part(c: str) -> Column:
        kind = own.schema[c].dataType
        return F.concat(F.coalesce(F.slice(f"head_{c}", F.lit(1), F.col("h")), F.array().cast(kind)), F.slice(c, F.col("h") + 1, F.greatest(F.size(c) - F.col("h"), F.lit(0)))).alias(c)

    return both.select("conv_id", part("ids"), part("chars"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's strings, joined by commas, from rows in order."""
    now, digest = None, None
    for batch in batches:
        keys, ends = [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key == now:
                digest.update(b"," + text.encode())
                continue
            if digest is not None:
                keys.append(now)
                ends.append(digest.hexdigest())
            now, digest = key, hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["key", "ends"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["key", "ends"])


def classes(sequences: DataFrame) -> DataFrame:
    """Distinct sequences: ids, chars, n, top (smallest conversation), ends (digest of all conversations' ids)."""
    key = F.unhex(F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256))
    rows = written(sequences.withColumn("key", key), "keyed")
    one = rows.groupBy("key").agg(F.any_value("ids").alias("ids"), F.any_value("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("top"))
    one = written(one, "classes")
    shared = one.where("n > 1").select(F.col("key").alias("held"))
    members = rows.join(shared, F.col("key") == F.col("held")).select("key", "conv_id", F.floor(F.col("conv_id") / BLOCK_IDS).alias("block"))
    blocks = members.groupBy("key", "block").agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("text"))
    digests = blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_hashed, "key binary, ends string")
    alone = F.sha2(F.col("top").cast("string").cast("binary"), 256)
    return one.join(digests, "key", "left").select("ids", "chars", "n", "top", F.coalesce("ends", alone).alias("ends"))


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NODE_NAMES = [f.split()[0] for f in _NODE.split(", ")]


def bucket_nodes(rows: list[tuple], depth: int, parent: int | None) -> list[list]:
    """Nodes below and including the one at `depth` that all rows (ids, chars, n, top, ends) share, by multikey quicksort."""
    nodes: list[list] = []  # as in _NODE, and the place of the node above
    stack = [(rows, depth, -1)]
    while stack:
        rows, d, up = stack.pop()
        n = sum(r[2] for r in rows)
        top = min(r[3] for r in rows)
        saved = (n - 1) * rows[0][1][d - 1] if d else 0
        at = len(nodes)
        nodes.append([top, d, nodes[up][0] if up >= 0 else parent, n, 0, 0, saved, _NO_IDS, up])
        longer = []
        for r in rows:
            if len(r[0]) > d:
                longer.append(r)
            else:
                nodes[at][7] = r[4]
        parts = [longer] if longer else []
        while parts:
            part = parts.pop()
            pivot = part[len(part) // 2][0][d]
            less, same, more = [], [], []
            for r in part:
                x = r[0][d]
                (same if x == pivot else less if x < pivot else more).append(r)
            stack.append((same, d + 1, at))
            parts += [p for p in (less, more) if p]
    for node in reversed(nodes):  # what is below a node stands behind it
        node[5] = node[5] or 1
        if (up := node.pop()) >= 0:
            above = nodes[up]
            above[4] += 1
            above[5] += node[5]
            above[6] += node[6]
    return nodes


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of local buckets, whose rows follow each other."""
    schema = pa.schema([("up_depth", pa.int64())] + [(n, pa.string() if n == "ends_sha256" else pa.int64()) for n in _NODE_NAMES])
    now, held, out = None, [], []

    def finish() -> None:
        conv, depth, _ = now
        out.extend([depth, *node] for node in bucket_nodes(held, depth + 1, conv))

    def flush() -> pa.RecordBatch:
        rows, out[:] = list(out), []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    for batch in batches:
        node_conv, node_depth, follows, *rest = (c.to_pylist() for c in batch.columns)
        for bucket, row in zip(zip(node_conv, node_depth, follows, strict=True), zip(*rest, strict=True), strict=True):
            if bucket != now:
                if held:
                    finish()
                    held = []
                    if len(out) > 20_000:
                        yield flush()
                now = bucket
            held.append(row)
    if held:
        finish()
    if out:
        yield flush()


_BUCKET = ["node_conv", "node_depth", "follows"]


def _large(rows: DataFrame, most: int) -> DataFrame:
    """Buckets over `most` turns that hold more than one class: _BUCKET, n, top."""
    sums = rows.groupBy(*_BUCKET).agg(F.count("*").alias("many"), F.sum(F.size("ids").cast("long")).alias("turns"), F.sum("n").alias("sum_n"), F.min("top").alias("sum_top"))
    return sums.where((F.col("many") > 1) & (F.col("turns") > most)).select(*_BUCKET, "sum_n", "sum_top")


def _chains(rows: DataFrame) -> DataFrame:
    """The nodes of large buckets down to where they branch: of rows with _BUCKET, sum_n and sum_top, one row a bucket."""
    one = rows.groupBy(*_BUCKET, "sum_n", "sum_top").agg(F.min("ids").alias("low"), F.max("ids").alias("high"), F.min_by("chars", "ids").alias("chars"), F.min_by("ends", "ids").alias("ends"))
    least = F.least(F.size("low"), F.size("high"))
    bottom = F.expr("array_min(filter(sequence(0, least(size(low), size(high))), i -> not coalesce(get(low, i) = get(high, i), false)))")
    one = one.withColumn("bottom", F.coalesce(bottom, least).cast("long"))
    ends = F.when(F.size("low") == F.col("bottom"), F.col("ends")).otherwise(F.lit(_NO_IDS))
    return one.select("node_conv", "node_depth", "follows", "sum_n", "sum_top", "bottom", F.slice("chars", F.lit(1), F.col("bottom").cast("int")).alias("chars"), ends.alias("ends"))


def prefix_trie(sequences: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The trie's nodes, from conv_id, ids and chars."""
    rows = classes(sequences)
    # The root is a large bucket of its own, above all: depth -1 has no node.
    rows = written(rows.select(F.lit(None).cast("long").alias("node_conv"), F.lit(-1).cast("long").alias("node_depth"), F.lit(0).cast("long").alias("follows"), "*"), "root")
    large, chains, local = rows.groupBy(*_BUCKET).agg(F.sum("n").alias("sum_n"), F.min("top").alias("sum_top")), [], []
    while True:
        large = written(large, "large")
        if large.isEmpty():
            local.append(rows)
            break
        same = [F.col(f"_{c}").eqNullSafe(F.col(c)) for c in _BUCKET]
        marked = rows.join(large.select(*(F.col(c).alias(f"_{c}") for c in _BUCKET), "sum_n", "sum_top"), same, "left").drop(*(f"_{c}" for c in _BUCKET))
        if chains:  # at the root all rows are in the large bucket
            local.append(marked.where("sum_n is null").select(rows.columns))
        inside = marked.where("sum_n is not null")
        chain = written(_chains(inside), "chains")
        chains.append(chain)
        at = chain.select(*(F.col(c).alias(f"_{c}") for c in _BUCKET), "bottom")
        below = inside.join(at, same).where(F.size("ids") > F.col("bottom"))
        rows = written(below.select(F.col("sum_top").alias("node_conv"), F.col("bottom").alias("node_depth"), F.expr("ids[int(bottom)]").alias("follows"), "ids", "chars", "n", "top", "ends"), "buckets")
        large = _large(rows, local_turns)
    leaves = local[0]
    for more in local[1:]:
        leaves = leaves.unionByName(more)
    finished = leaves.repartition(*_BUCKET).sortWithinPartitions(*_BUCKET).mapInArrow(_finished, "up_depth long, " + _NODE)
    nodes = written(finished, "nodes")
    tops = nodes.where("depth = up_depth + 1").groupBy("parent_conv_id", "up_depth").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("kid_leaves"), F.sum("saved_tokens").alias("kid_saved"))
    tops = tops.select(F.col("parent_conv_id").alias("up_conv"), "up_depth", "kids", "kid_leaves", "kid_saved")
    out = nodes.select(_NODE_NAMES)
    for chain in reversed(chains):
        summed = chain.join(tops.groupBy("up_conv", "up_depth").agg(*(F.sum(c).alias(c) for c in ("kids", "kid_leaves", "kid_saved"))), [F.col("sum_top") == F.col("up_conv"), F.col("bottom") == F.col("up_depth")], "left")
        count = F.coalesce("kid_leaves", F.lit(1))
        # saved_tokens of each node of the chain: its own and all below.
        lower = F.expr("aggregate(slice(chars, int(depth), int(bottom - depth + 1)), 0L, (a, x) -> a + x)")
        each = summed.select("*", F.explode(F.sequence(F.col("node_depth") + 1, F.col("bottom"))).alias("depth"))
        each = each.withColumn("own_saved", F.when(F.col("depth") > 0, (F.col("sum_n") - 1) * lower).otherwise((F.col("sum_n") - 1) * F.expr("aggregate(chars, 0L, (a, x) -> a + x)")))
        ends = F.when(F.col("depth") == F.col("bottom"), F.col("ends")).otherwise(F.lit(_NO_IDS))
        each = written(
            each.select(
                F.col("sum_top").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("node_depth") + 1, F.col("node_conv")).otherwise(F.col("sum_top")).alias("parent_conv_id"), F.col("sum_n").alias("n_convs"),
                F.when(F.col("depth") == F.col("bottom"), F.coalesce("kids", F.lit(0))).otherwise(1).cast("long").alias("n_children"), count.cast("long").alias("n_leaves"),
                (F.col("own_saved") + F.coalesce("kid_saved", F.lit(0))).alias("saved_tokens"), ends.alias("ends_sha256"), "node_depth",
            ),
            "upper",
        )
        heads = each.where("depth = node_depth + 1 and depth > 0").select(F.col("parent_conv_id").alias("up_conv"), F.col("node_depth").alias("up_depth"), F.lit(1).cast("long").alias("kids"), F.col("n_leaves").alias("kid_leaves"), F.col("saved_tokens").alias("kid_saved"))
        tops = tops.unionByName(heads)
        out = out.unionByName(each.select(_NODE_NAMES))
    return out


def conversation_trie(conversations: DataFrame) -> DataFrame:
    return prefix_trie(rebranched(encoded(conversations)))
