"""Filter audit, prefix trie and WARC against brute force, on odd rows and empty tables."""

import gzip
import hashlib
import random
import zlib
from itertools import permutations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliloom.llm import filteraudit, trie, warc

from . import cases

# --- filter interaction audit


def failures(rows):
    """(part, good, toxic, failing letters) of each row, from the rules."""
    docs, labels = rows
    out = []
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    for i, t, lang, *_ in docs:
        t, f = t or "", set()
        w = cases.words(t)
        if len(w) < 100:
            f.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            f.add("B")
        if 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t):
            f.add("C")
        if set(t) & set("#$%&*|"):
            f.add("D")
        if i is not None and i > first[t]:
            f.add("E")
        own = [x for x in labels if x[0] == i and i is not None]
        out.append((lang or "", any(x[1] == 1 for x in own), any(x[2] == 1 for x in own), f))
    return out


def audited(rows):
    docs = failures(rows)
    out, total = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                gone = lambda d: bool(d[3] & set(order[:k]))  # noqa: B023, E731
                here = [d for d in own if x in d[3] and not gone(d)]
                out[part, order, k + 1] = [
                    sum(not d[3] & set(order[: k + 1]) for d in own), len(here), sum(x in d[3] and gone(d) for d in own), sum(d[3] == {x} for d in own), sum(d[1] for d in here), sum(d[2] for d in here),
                ]
                total[part, x] = total.get((part, x), 0) + len(here)
    return {k: (*v, total[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LABELS = "doc_id long, quality int, toxic int"


def audit_rows():
    docs = [(i, t, [None, "", "en", "de"][n % 4], s, n) for n, (i, t, _, s, _) in enumerate(cases.documents())]
    docs += [docs[3], docs[3], (None, docs[5][1], "en", None, None), (None, None, None, None, None), (9001, docs[3][1], "fr", "x", 1), (9002, "A " * 150, "fr", "x", 1), (9003, "x y " * 50_000, "fr", "x", 1)]
    labels = [(i, n % 3, n % 2) for n, (i, *_) in enumerate(docs[::2])] + [(docs[0][0], 1, None), (docs[2][0], None, 1), (None, 1, 1), (123456, 1, 1)]
    return docs, labels


METRICS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit(spark):
    rows = audit_rows()
    docs = spark.createDataFrame(rows[0], cases.SCHEMA).repartition(3)
    labels = spark.createDataFrame(rows[1], LABELS)
    got = filteraudit.filter_audit(docs, labels)
    assert [t for _, t in got.select(METRICS).dtypes] == ["bigint"] * 7
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in METRICS) for r in got.collect()}
    assert len(got) == 600 * 4
    assert got == audited(rows)


def test_audit_of_other_columns_orders_and_nothing(spark):
    rows = audit_rows()
    docs = spark.createDataFrame(rows[0], cases.SCHEMA).withColumns({c: F.lit(1) for c in ("own", "part", "digest", "first_id", "held", "mask", "n")})
    labels = spark.createDataFrame(rows[1], LABELS).withColumn("labelled", F.lit("x"))
    masks = filteraudit.failure_masks(docs, labels)
    some = filteraudit.audit(masks, orders=["EDCBA", "ABCDE"]).collect()
    assert {r["filter_order"] for r in some} == {"EDCBA", "ABCDE"} and len(some) == 10 * 4
    assert filteraudit.filter_audit(docs.limit(0), labels).count() == 0
    assert filteraudit.filter_audit(docs, labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# --- conversation prefix trie


def rebuilt(rows):
    by = {}
    for c, t, r, x in rows:
        if c is not None:
            by.setdefault(c, []).append((t is not None, t or 0, r or "", hashlib.sha256(f"{len((r or '').encode())}:{r or ''}{x or ''}".encode()).digest(), x or ""))
    by = {c: [(r, x) for _, _, r, _, x in sorted(v)] for c, v in by.items()}
    out = {}
    for c, turns in by.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = tuple(by.get(c - c % 100, [])[:h] + turns[h:])
    return out


def trie_nodes(members):
    nodes, kids, leaves, saved, out = {}, {}, {}, {}, []
    for c, t in members.items():
        for d in range(len(t) + 1):
            nodes.setdefault(t[:d], []).append(c)
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    ends = {}
    for c, t in sorted(members.items()):
        ends.setdefault(t, []).append(str(c))
    for p in sorted(nodes, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(saved[k] for k in below)
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(below), leaves[p], saved[p], hashlib.sha256(",".join(ends.get(p, [])).encode()).hexdigest()))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string"


def conversations():
    rng = random.Random(4)
    rows = []
    for c in range(60):
        conv = [0, 100, 200, 3000][c % 4] + c // 4
        rows += [(conv, t, ["user", "assistant"][t % 2], rng.choice(["ok", "yes", "é ü", "no " * 30])) for t in range(rng.randint(1, 7))]
    rows += [(500 + c, t, "user", f"same {t}") for c in range(0, 40, 2) for t in range(9)]  # copies
    rows += [(700, None, None, None), (700, 1, None, "x"), (700, 1, "user", None), (700, 1, "user", "tie"), (700, 1, "user", "tie"), (701, 0, "", ""), (None, 1, "user", "lost"), (2**40, 5, "user", "far")]
    rows += [(900, t, "user", f"t{t}") for t in range(600)] + [(901, t, "user", f"t{t}") for t in range(601)]  # long, one a prefix of the other
    return rows


@pytest.mark.parametrize("most", [trie.LOCAL_TURNS, 100, 1])
def test_trie(spark, most):
    rows = conversations()
    df = spark.createDataFrame(rows, CONV).repartition(3).withColumns({c: F.lit(1) for c in ("ids", "chars", "told", "node_conv", "n", "h")})
    got = trie.prefix_trie(trie.rebranched(trie.encoded(df)), local_turns=most)
    assert [t for _, t in got.dtypes] == ["bigint"] * 7 + ["string"]
    assert sorted(map(tuple, got.collect()), key=str) == trie_nodes(rebuilt(rows))


@pytest.mark.parametrize("most", [trie.LOCAL_TURNS, 1])
def test_trie_of_one_sequence_and_of_nothing(spark, most):
    df = spark.createDataFrame([(c, t, "user", str(t)) for c in (3, 4, 5) for t in range(4)], CONV)
    got = trie.prefix_trie(trie.encoded(df), local_turns=most)
    assert sorted(map(tuple, got.collect()), key=str) == trie_nodes({c: tuple(("user", str(t)) for t in range(4)) for c in (3, 4, 5)})
    assert trie.prefix_trie(trie.encoded(df.limit(0)), local_turns=most).count() == 0


@given(st.lists(st.lists(st.integers(0, 2), max_size=5).map(tuple), min_size=1, max_size=25, unique=True))
def test_multikey_quicksort_emits_each_prefix_once(seqs):
    rows = [(list(s), [x + 1 for x in s], k % 3 + 1, k, f"e{k}") for k, s in enumerate(seqs)]
    nodes = trie.bucket_nodes(rows, 0, None)
    prefixes = {s[:d] for s in seqs for d in range(len(s) + 1)}
    assert len(nodes) == len(prefixes)
    want = sorted((min(k for k, s in enumerate(seqs) if s[: len(p)] == p), len(p), sum(k % 3 + 1 for k, s in enumerate(seqs) if s[: len(p)] == p), len({s[: len(p) + 1] for s in seqs if s[: len(p)] == p} - {p})) for p in prefixes)
    assert sorted((n[0], n[1], n[3], n[4]) for n in nodes) == want
    assert nodes[0][5] == sum(n[4] == 0 for n in nodes)


def test_sequences_of_many_ids_are_hashed_in_blocks(spark):
    ids = [*range(-150, 250, 3), 10**12, 10**12 + 1]
    df = spark.createDataFrame([(c, [1, 2], [5, 6]) for c in ids], "conv_id long, ids array<long>, chars array<int>").repartition(5)
    old, trie.BLOCK_IDS = trie.BLOCK_IDS, 7
    try:
        (row,) = trie.classes(df).collect()
    finally:
        trie.BLOCK_IDS = old
    assert (row["n"], row["top"], row["ends"]) == (len(ids), -150, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


# --- WARC

PAGES = "page_id long, url string, html string"


def pages():
    fake = "p\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    return [
        (1, "http://a.b/x y?q#f", fake), (2, None, ""), (3, "u", None), (4, "http://h", fake), (5, "http://h?q\r\nX: y", "\r\n\r\n\r\n\r\n"), (None, "z", ""), (None, "z", "alone"), (6, "u", "\r\n\r"), (6, "u", "\r\n\r"), (6, "u", "other"),
        (7, "u", "é\x00ü"), (8, "http://long", "long \r\n\r\n text " * 200_000), (9, "u", "\n"), *((100 + i, f"http://s/{i}", "<p>same</p>") for i in range(50)),
    ]


def expected(rows, least=0):
    last, out = {}, set()
    for i, _, html in rows:
        last[html or ""] = max(last.get(html or "", i), i, key=lambda x: (x is not None, x or 0))
    for i, _, html in rows:
        data = (html or "").encode()
        first = i == last[html or ""] or len(data) < least
        out.add((i, len(data), warc.digest_of(data), "response" if first else "revisit", None if first else last[html or ""]))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 5])
def test_pages_come_back_from_archives(spark, least):
    df = spark.createDataFrame(pages(), PAGES).repartition(3).withColumns({c: F.lit(1) for c in ("payload", "digest", "held", "last_id", "record_id")})
    got = warc.page_captures(df, least)
    assert got.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert sorted(map(tuple, got.collect()), key=str) == expected(pages(), least)
    assert warc.page_captures(df.limit(0)).count() == 0


def test_base32_of_sha1(spark):
    texts = ["", "abc", "é", *map(str, range(50))]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", warc.base32_sha1(F.col("t").cast("binary")).alias("d")).collect()
    assert all(r["d"] == warc.digest_of(r["t"].encode()) for r in got)


def test_captures_are_nested_and_hold_payloads(spark):
    records = warc.read_records(spark, warc.write_archives(spark.createDataFrame(pages()[:5], PAGES)))
    rows = {r["metadata"]["fields"]["page-id"]: r for r in warc.captures(records).collect()}
    one, four = rows["1"], rows["4"]
    assert bytes(four["payload"]).decode() == pages()[3][2]
    assert one["capture"]["record_type"] == "revisit" and one["original"]["payload_digest"] == four["capture"]["payload_digest"]
    assert one["capture"]["refers_to"] == four["capture_id"] and one["n_requests"] == one["n_metadata"] == 1
    assert bytes(one["payload"]) == b"" and one["request"]["payload_bytes"] == 0 and one["request"]["concurrent_to"] == [one["capture_id"]]


def record(kind, name, block, *more):
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", "2020-01-01T00:00:00Z"), *more, ("Content-Length", str(len(block)))]
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, tmp_path):
    """One gzip member a record, a capture that names its request, several metadata records, some of nothing."""
    http = ("Content-Type", "application/http; msgtype=response")
    body = [
        record("warcinfo", "<i>", b"software: x\r\n", ("Content-Type", "application/warc-fields")),
        record("response", "<r>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody\r\n\r\nmore", http, ("WARC-Concurrent-To", "<q>")),
        record("request", "<q>", b"GET / HTTP/1.1\r\n\r\n", ("Content-Type", "application/http; msgtype=request")),
        record("metadata", "<m2>", b"b: 2\r\n", ("WARC-Concurrent-To", "<r>"), ("Content-Type", "application/warc-fields")),
        record("metadata", "<m1>", b"a: 1\r\nc: 3\r\n", ("WARC-Concurrent-To", "<r>"), ("Content-Type", "application/warc-fields")),
        record("metadata", "<m3>", b"lost: 1\r\n", ("WARC-Concurrent-To", "<none>"), ("Content-Type", "application/warc-fields")),
        record("resource", "<s>", b"\xff\x00\r\n\r\n"),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, body)))
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("resource", "<t>", b"")))
    records = warc.read_records(spark, str(tmp_path))
    assert records.count() == 8
    rows = {r["capture_id"]: r for r in warc.captures(records).collect()}
    assert set(rows) == {"<r>", "<s>", "<t>"}
    assert bytes(rows["<r>"]["payload"]) == b"body\r\n\r\nmore" and rows["<r>"]["request"]["record_id"] == "<q>"
    assert rows["<r>"]["metadata"]["fields"] == {"a": "1", "c": "3"} and rows["<r>"]["n_metadata"] == 2
    assert bytes(rows["<s>"]["payload"]) == b"\xff\x00\r\n\r\n" and rows["<t>"]["request"] is None


@given(st.lists(st.binary(max_size=40).map(lambda b: b.replace(b"a", b"\r\n")), max_size=5))
def test_pieces_are_joined_again(blocks):
    data = b"".join(record("resource", f"<{i}>", b) for i, b in enumerate(blocks))
    pieces = data.split(b"\r\n\r\n")
    rows = list(warc._records(("f", p) for p in pieces))
    assert [r["payload"] for r in rows] == blocks


def test_damaged_archives_are_errors():
    good = record("resource", "<a>", b"text", ("WARC-Block-Digest", "sha1:" + warc.digest_of(b"text")))
    read = lambda data: list(warc._records(("f", p) for p in data.split(b"\r\n\r\n")))
    assert len(read(good)) == 1
    with pytest.raises(ValueError, match="warc-block-digest"):
        read(good.replace(b"text", b"tent"))
    with pytest.raises(ValueError, match="ends within"):
        read(record("resource", "<a>", b"a block of some length")[:-20])
    with pytest.raises(ValueError, match="no record begins"):
        read(b"junk\r\n\r\n" + good)
