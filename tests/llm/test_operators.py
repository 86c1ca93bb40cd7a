"""Each operator against a brute-force version, on odd documents and on empty tables."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliloom.llm import chat, kernels, tokencount
from cliloom.llm.components import components
from cliloom.llm.fingerprints import fingerprint_report
from cliloom.llm.linededup import dedup_documents, dedup_lines, line_dedup_report
from cliloom.llm.lm import lm_scores
from cliloom.llm.mixing import mixed_documents, mixed_report
from cliloom.llm.neardup import drop_near_copies, near_components
from cliloom.llm.packing import OpenBins, pack_documents
from cliloom.llm.quality import clean_documents, quality_report
from cliloom.llm.queries import HOSTILE, tokenizer_path
from cliloom.llm.substrings import FingerprintIndex, remove_repeats
from cliloom.llm.tokencount import section_tokens

from . import cases


@pytest.fixture(scope="module")
def rows():
    return cases.documents()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(rows, cases.SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], cases.SCHEMA)


def by_id(df, *names):
    return {r["doc_id"]: tuple(r[n] for n in names) if len(names) != 1 else r[names[0]] for r in df.collect()}


def test_words_and_hashes_are_the_words():
    texts = [t or "" for _, t, *_ in cases.documents()]
    import pyarrow as pa

    for a, b, data, offsets in kernels.blocks(pa.array(texts), 3000):
        starts, ends, first = kernels.words(data, offsets)
        hashes = kernels.span_hashes(data, starts, ends)
        for i in range(b - a):
            found = [data[x:y].tobytes().decode() for x, y in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]], strict=True)]
            assert found == cases.words(texts[a + i])
        seen = {}
        for x, y, h in zip(starts, ends, hashes, strict=True):
            assert seen.setdefault(int(h), data[x:y].tobytes()) == data[x:y].tobytes()


def test_fingerprints(docs, none, rows):
    found = by_id(fingerprint_report(docs), "n_chars", "edited_sha256", "fingerprint", "near_edited", "near_next")
    texts = [t or "" for _, t, *_ in rows]
    assert len(found) == len(rows)
    prints = {}
    for k, (i, *_) in enumerate(rows):
        now, then = texts[k], texts[(k + 1) % len(rows)]
        half = len(now) // 2
        edited = now[: len(now) - half] + then[:half]
        assert found[i][:2] == (len(now), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(now, found[i][2]) == found[i][2]
        if now == then:
            assert found[i][4] == 1.0
        assert all(0 <= x <= 1 for x in found[i][3:])
        if len(now) > 1000 and len(set(now)) > 5 and now[:200] != then[:200]:
            assert 0.1 < found[i][3] < 0.7
    assert fingerprint_report(none).count() == 0


def test_fingerprints_share_interior_phrases_at_any_offset(docs, rows):
    from cliloom.llm.fingerprints import likeness, registers

    text = rows[64][1].encode()
    data, offsets = np.frombuffer(text + b"some words before " + text, np.uint8), np.array([0, len(text), 2 * len(text) + 18])
    found = registers(data, offsets)
    assert likeness(found[:1], found[1:], np.array([True]), np.array([True]))[0] > 0.95


def test_packing(docs, none, rows):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    found = pack_documents(docs, path, capacity=512).collect()
    pieces = {}
    for i, t, *_ in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for k, at in enumerate(range(0, len(ids), 512)):
            part = ids[at : at + 512]
            pieces[i, k] = (at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == pieces
    places = {}
    for r in found:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    assert len(places) <= -(-sum(n for _, n, _ in pieces.values()) // 512) * 1.05 + 1
    assert pack_documents(none, path).count() == 0


def test_packing_is_online_and_bounded(spark):
    """In the order of the input, with at most 64 open sequences, of which full ones are closed by force; still close to the least number of sequences."""
    from cliloom.llm.packing import OPEN_BINS, pack

    rng = np.random.default_rng(3)
    lengths = np.minimum(4096, 1 + rng.lognormal(5.5, 1.3, 20_000).astype(int))
    bins, placed = OpenBins(4096, OPEN_BINS), []
    for n in lengths.tolist():
        placed.append(bins.place(n))
        assert bins.open <= OPEN_BINS == 64
    assert bins.closed > 100
    assert bins.made < 1.01 * lengths.sum() / 4096 + 64
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long").coalesce(1)
    found = {r.doc_id: (r.sequence_id, r.offset) for r in pack(df).collect()}
    assert [found[i] for i in range(len(lengths))] == placed


def test_fullest_bin_closes_first():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 5)] == [(0, 0), (1, 0)]
    assert bins.place(7) == (2, 0)  # closes the bin with 4 left
    assert bins.place(5) == (1, 5)
    assert bins.place(3) == (2, 7)
    assert bins.open == 0


def test_chat(spark, none):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "\\</s> yes"), (1, 3, "user", "and?"), (1, 4, "assistant", ""), (1, 5, "user", "bye"), (2, 0, "user", None), (3, 0, None, "a"), (3, 0, None, "a"), (3, 1, "tool [TEXT] x", "b <s>"), (3, 2, "assistant", "é\nü"), (None, 0, "assistant", "x"), *HOSTILE]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    conversations = {}
    for c, t, r, x in sorted(turns, key=lambda z: (z[0] is not None, z[0] or 0, z[1])):
        conversations.setdefault(c, []).append((r or "", x or ""))
    examples = chat.expand(df).collect()
    for c, own in conversations.items():
        mine = sorted((e for e in examples if e.conv_id == c), key=lambda e: e.example)
        assert chat.parsed(mine[-1].text) == own
        assert [chat.unescape(e.text[e.loss_start : e.loss_end]) for e in mine if e.loss_start is not None] == [x for r, x in own if r == "assistant"]
        answers = [k for k, (r, _) in enumerate(own) if r == "assistant"]
        for e, k in zip(mine, answers, strict=False):
            assert chat.parsed(e.text) == own[: k + 1]
    found = {r.conv_id: r for r in chat.chat_report(df).collect()}
    for c, own in conversations.items():
        assert found[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in own).encode()).hexdigest()
        assert found[c].loss_chars == sum(len(x) for r, x in own if r == "assistant")
        assert found[c].n_turns == len(own)
    assert chat.chat_report(df.where("1 = 0")).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "\\\\<s>", "<s></s>[SYS][/SYS]", "<\\s>", "[INST", "<<s>>", "[ROLE] [TEXT] [/ROLE]\\"])
def test_escape_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


def test_mixing(docs, none, rows):
    found = {r.doc_id: r for r in mixed_report(docs).collect()}
    sizes = {i: len(cases.words(t)) for i, t, *_ in rows}
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(sizes[r[0]] for r in rows if r[3] == s) for s in sources}
    left, budget, target = list(sources), 1.5 * sum(total.values()), {}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    while left:
        level = budget / sum(weight[s] for s in left)
        over = [s for s in left if weight[s] * level > 2 * total[s]]
        if not over:
            target |= {s: weight[s] * level for s in left}
            break
        for s in over:
            target[s] = 2 * total[s]
            budget -= 2 * total[s]
            left.remove(s)
    for i, t, _, s, _ in rows:
        r = found[i]
        assert (r.size, r.source_size) == (sizes[i], total[s])
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
    for s in sources:
        taken = sum(found[r[0]].taken for r in rows if r[3] == s)
        assert abs(taken - target[s]) <= max(sizes[r[0]] for r in rows if r[3] == s) / 2 + 1
    assert {i: r.taken for i, r in found.items()} == by_id(mixed_report(docs), "taken")
    assert mixed_report(none).count() == 0
    copies = Counter(r.doc_id for r in mixed_documents(docs).collect())
    assert all(copies[i] == r.copies for i, r in found.items())


@pytest.mark.parametrize(("num", "den", "k"), [(85, 100, 3), (80, 100, 5)])
def test_near_duplicates(docs, none, rows, num, den, k):
    component, n = cases.near(rows, num, den, k)
    found = by_id(near_components(docs, num=num, den=den, k=k), "n_shingles", "component_id", "kept")
    assert found == {i: (n[i], component[i], component[i] == i) for i, *_ in rows}
    assert near_components(none).count() == 0


def test_near_duplicates_of_repeated_and_null_ids(spark):
    text = "some words that stand here more than once in all of these rows"
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (5, None)], "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in near_components(df).collect()), key=str)
    assert found == sorted([(None, None, True), (4, None, False), (4, None, False), (5, 5, True)], key=str)
    assert [r.doc_id for r in drop_near_copies(df).collect() if r.doc_id is not None] == [5]


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    """Cells of a few members give the components that whole buckets give."""
    import random

    from cliloom.llm import neardup

    monkeypatch.setattr(neardup, "CELL", 8)
    monkeypatch.setattr(neardup, "CELL_SETS", 2000)
    monkeypatch.setattr(neardup, "PAIRS", 100)
    rng = random.Random(2)
    base, rows = cases.prose(rng, 120).split(), []
    for i in range(150):
        words = list(base)
        for _ in range(rng.choice([1, 1, 3, 9])):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    component, _ = cases.near(rows, 85, 100, 3)
    assert len(set(component.values())) > 5
    assert by_id(near_components(spark.createDataFrame(rows, "doc_id long, text string"), num=85, k=3), "component_id") == component


def test_near_duplicates_just_under_and_at_the_threshold(spark, monkeypatch):
    """One bucket of 2000 texts that all look alike: what leaves a cell grows with its members, not with its pairs; a chain at the threshold is found whole."""
    from cliloom.llm import neardup

    base = [f"word{j}" for j in range(200)]
    rows = []
    for i in range(2000):  # 6 words of their own: any two have 164 shingles of 198 + 198 - 164 in common, 71 of 100
        own = list(base)
        for j in range(6):
            own[33 * j + 5 + i % 20] = f"own{i}x{j}"
        rows.append((i, " ".join(own)))
    at = [w if j % 2 else f"other{j}" for j, w in enumerate(base)]
    for i in range(50):  # each has 8 further shingles replaced: 182 of 214 or 85.05 of 100 in common with the one before
        rows.append((5000 + i, " ".join(at)))
        for j in range(5):
            at[(i * 41 + 37 * j + 7) % 199] = f"chain{i}x{j}"
    leaving, links = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda e: (leaving.append(e.count()), links(e))[1])
    found = by_id(near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), num=85, k=3), "component_id")
    sets = {i: cases.shingles(t, 3) for i, t in rows}
    chain, expected = [5000], {i: i for i in range(2000)}
    for i in range(5000, 5050):
        if i > 5000 and 100 * len(sets[i] & sets[i - 1]) < 85 * len(sets[i] | sets[i - 1]):
            chain.append(i)
        expected[i] = chain[-1]
    assert found == expected
    assert max(leaving) < 2 * len(rows)


@pytest.mark.parametrize("num, k", [(85, 3), (80, 5)])
def test_recall_at_the_threshold(spark, num, k):
    """500 pairs whose likeness is the least that links them: all are found."""
    import random

    rng, rows, n = random.Random(num), [], 0
    while n < 1000:
        a = [f"p{n}w{j}" for j in range(rng.randint(60, 260))]
        size = len(a) - k + 1
        both = -(-2 * num * size // (100 + num))  # the least intersection of two sets of this size
        b = a[: both + k - 1] + [f"q{n}w{j}" for j in range(size - both)]
        rows += [(n, " ".join(a)), (n + 1, " ".join(b))]
        n += 2
    found = by_id(near_components(spark.createDataFrame(rows, "doc_id long, text string"), num=num, k=k), "component_id")
    assert found == {i: i - i % 2 for i in range(1000)}


@pytest.mark.parametrize("num, fine", [(85, False), (80, False), (85, True), (80, True)])
def test_sketches_keep_pairs_at_the_threshold(num, fine):
    """Simulated pairs: samples differ at random, and each that does flips a bit of either sketch."""
    from cliloom.llm import neardup as N

    samples, bits = (N.FINE_SAMPLES, N.FINE_BITS) if fine else (N.band_count(num, 100) * N.BAND_ROWS, N.SKETCH_BITS)
    rng, apart, pairs = np.random.default_rng(5), [], 4000
    for _ in range(5 if fine else 15):
        flips = 2 * rng.binomial(samples, 1 - num / 100, pairs)
        place = np.repeat(np.arange(pairs), flips) * bits + rng.integers(0, bits, flips.sum())
        apart.append((np.bincount(place, minlength=pairs * bits) % 2).reshape(pairs, bits).sum(1))
    apart, most = np.concatenate(apart), N.most_apart(num, 100, samples, bits)
    assert (apart > most).sum() == 0
    assert 4.5 < (most - apart.mean()) / apart.std() < 6.5  # and no wider than a loss of 1e-7 takes


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40) if i % 10] + [(100, 60), (60, 80), (80, 3), (7, 7)]
    found = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 1 + (i - 1) // 10 * 10 for i in range(1, 41)} | {100: 1, 60: 1, 80: 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("rule", ["most", "first", "last"])
def test_token_counts(docs, none, rows, rule):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encoding, _ = tokencount.load(path)
    found = {}
    for r in section_tokens(docs, path, rule=rule).collect():
        found.setdefault(r.doc_id, {})[r.section] = r
    for i, t, *_ in rows:
        t = t or ""
        lines = t.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        bounds, tokens = np.cumsum([len(x.encode()) for x in lines]), Counter()
        at = 0
        for token in encoding.encode_ordinary(t):
            n = len(encoding.decode_single_token_bytes(token))
            share = Counter(int(np.searchsorted(bounds, b, "right")) for b in range(at, at + n))
            tokens[min(share) if rule == "first" else max(share) if rule == "last" else max(sorted(share), key=share.get)] += 1
            at += n
        assert [(found[i][k].n_tokens, found[i][k].n_chars) for k in range(len(lines))] == [(tokens[k], len(x)) for k, x in enumerate(lines)]
        assert len(found[i]) == len(lines)
    assert section_tokens(none, path).count() == 0


def test_lm(docs, none, rows):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    found = by_id(lm_scores(docs, path), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, *_ in rows}
    tokens = {i: cases.words((t or "").translate(cases.LOWER)) for i, t, *_ in rows}
    counts = Counter(w for i, x in tokens.items() if not held[i] for w in [*x, None])
    total, distinct = sum(counts.values()), len(counts)
    for i, x in tokens.items():
        base = sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in [*x, None])
        assert found[i][:4] == (held[i], len(x) + 1, sum(counts[w] > 0 for w in [*x, None]), total)
        assert found[i][4] == pytest.approx(base)
        assert found[i][5] < 0
    same = [i for i, t, *_ in rows if t == rows[0][1]]
    assert len({round(found[i][5], 3) for i in same}) == 1
    again = by_id(lm_scores(docs, path), "score")
    assert all(again[i] == pytest.approx(found[i][5], rel=1e-4) for i in again)
    assert lm_scores(none, path).count() == 0


def test_lm_learns_from_all_training_documents(docs, rows, monkeypatch):
    from cliloom.llm import lm

    fit, learnt = lm.fit, Counter()

    def counted(samples, *rest):
        for r in samples.collect():
            lengths = np.frombuffer(r.b, "<i4")
            assert lengths.sum() * 2 == len(r.a)
            learnt["documents"] += len(lengths)
            learnt["ids"] += int(lengths.sum())
        learnt["counted"] = int(rest[0].sum() - rest[0][lm.END])
        return fit(samples, *rest)

    monkeypatch.setattr(lm, "fit", counted)
    monkeypatch.setattr(lm, "SHARD_IDS", 500)
    assert lm_scores(docs, tokenizer_path("byte_bpe_50k.tiktoken")).count() == len(rows)
    assert learnt["documents"] == sum(zlib.crc32(str(i).encode()) % 7 != 2 for i, *_ in rows)
    assert learnt["ids"] == learnt["counted"] > 1000


def test_each_shard_is_in_one_task_and_the_shards_in_several(docs, monkeypatch):
    from cliloom.llm import lm

    seen, fit = [], lm.fit

    def looked(samples, counts, shards, *rest):
        seen.extend(samples.select("bucket", F.spark_partition_id().alias("task")).distinct().collect())
        assert "Exchange" not in samples._jdf.queryExecution().executedPlan().toString()  # nothing is dealt again in a round
        return fit(samples, counts, shards, *rest)

    monkeypatch.setattr(lm, "fit", looked)
    monkeypatch.setattr(lm, "SHARD_IDS", 500)
    assert lm_scores(docs, tokenizer_path("byte_bpe_50k.tiktoken")).count() > 0
    assert len({r.bucket for r in seen}) == len(seen) > 3
    assert len({r.task for r in seen}) > 1


def test_every_document_is_learnt_from_in_each_epoch(monkeypatch):
    import pyarrow as pa

    from cliloom.llm import lm

    counts = np.zeros(lm.END + 1, np.int64)
    counts[:200] = 5
    texts = [np.arange(k, k + 3, dtype="<u2") for k in range(0, 90, 3)]
    rows = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([b"".join(x.tobytes() for x in texts)]), pa.array([np.full(30, 3, "<i4").tobytes()])], ["bucket", "a", "b"])
    seen = []
    monkeypatch.setattr(lm, "train", lambda model, ids, first, vocabulary, done, until, *rest: seen.append((ids.tolist(), done, until)))
    start = lm.initial(lm.Vocabulary(counts)).vector()
    weights = [out.column("weight")[0].as_py() for turn in range(4) for out in lm._trained(start, counts, turn, 2, 2, 1e-3, 8)(iter([rows]))]
    assert [(a, b) for _, a, b in seen] == [(0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1)]
    assert sorted(seen[0][0] + seen[1][0]) == sorted(seen[2][0] + seen[3][0]) == list(range(90))
    assert sum(weights) == 2 * (90 + 30)


def test_lm_beats_word_counts_on_held_out_text_and_agrees_with_a_plain_forward_pass(spark, monkeypatch):
    import random

    from cliloom.llm import lm
    from cliloom.llm.attention import STRIDE, WINDOW

    rng = random.Random(8)
    names = ["river", "stone", "candle", "market", "winter", "letter", "garden", "mirror", "bridge", "forest", "pocket", "silver", "thunder", "window", "yellow", "basket"]
    follow = {w: rng.sample(names, 3) for w in names}
    rows = []
    for i in range(700):
        w = rng.choice(names)
        text = [w]
        for _ in range(rng.randint(3, 120)):
            w = rng.choice(follow[w])
            text.append(w)
        rows.append((i, " ".join(text)))
    held = {}

    def kept(*given):
        held["vector"], held["counts"] = fit(*given), given[1]
        return held["vector"]

    fit = lm.fit
    monkeypatch.setattr(lm, "fit", kept)
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    found = {r.doc_id: r for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), path).collect()}
    out = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in out) > 0.75 * sum(r.base_score for r in out)  # log probabilities: by a quarter less
    assert np.mean([r.score > r.base_score for r in out]) > 0.9

    # One document after the other, one place after the other, attention as plain sums.
    encoding, _ = tokencount.load(path)
    vocabulary = lm.Vocabulary(held["counts"])
    model = lm.initial(vocabulary).load(held["vector"])
    p, d = {k: v.astype(np.float64) for k, v in model.p.items()}, model.p["out"].shape[0]
    for i, text in [rows[3], rows[10], (-1, "")]:
        ids = [x for w in cases.words(text) for x in encoding.encode_ordinary(" " + w)] + [lm.END]
        tokens = [int(vocabulary.token[x]) for x in ids]
        before = lambda k, tokens=tokens: tokens[k] if k >= 0 else int(vocabulary.token[lm.END])
        total, start = 0.0, 0
        while True:
            x = np.array([p["e0"][before(k - 1)] + p["e1"][before(k - 2)] + p["e2"][before(k - 3)] + p["place"][k - start] for k in range(start, min(start + WINDOW, len(ids)))])
            for k in range(start if start == 0 else start + WINDOW - STRIDE, min(start + WINDOW, len(ids))):
                n = k - start + 1
                q, key, value = np.split(x[:n] @ p["qkv"], 3, axis=1)
                weight = np.exp(q[-1] @ key.T / np.sqrt(d))
                state = x[n - 1] + weight / weight.sum() @ value @ p["out"]
                state = state + np.maximum(state @ p["up"] + p["up_b"], 0) @ p["down"]
                cls, sub = divmod(tokens[k], lm.CLASS_SIZE)
                for z, own in ((state @ p["class"] + p["class_b"], cls), (state @ p["word"][cls] + p["word_b"][cls], sub)):
                    total += z[own] - np.log(np.exp(z).sum())
                total += vocabulary.other[ids[k]] if tokens[k] == lm.CLASSES * lm.CLASS_SIZE - 1 else 0
            if start + WINDOW >= len(ids):
                break
            start += STRIDE
        if i >= 0:
            assert found[i].score == pytest.approx(total / np.log(10), rel=1e-4)
        else:
            assert lm.log_probabilities(model, vocabulary, np.zeros(0, np.int32), np.array([0, 0]))[0] == pytest.approx(total / np.log(10), rel=1e-4)


def test_attention_model_is_causal_and_normalised():
    from cliloom.llm.attention import WINDOW, Model

    model, rng = Model(4, 4), np.random.default_rng(0)
    t = rng.integers(0, 16, (1, WINDOW))
    every = [model.score(t, t, t, np.full_like(t, y), np.ones_like(t, bool)) for y in range(16)]
    assert np.exp(every).sum(0) == pytest.approx(np.ones(WINDOW), abs=1e-4)
    other = t.copy()
    other[0, 20:] = (other[0, 20:] + 1) % 16
    again = model.score(other, other, other, np.full_like(t, 3), np.ones_like(t, bool))
    assert again[:20] == pytest.approx(every[3][:20], abs=1e-5)
    y = rng.integers(0, 16, t.shape)
    _, g = model.gradient(t, t, t, y, np.ones_like(t, bool))
    for name in ("qkv", "up", "word", "class", "e1", "place"):
        where = np.unravel_index(np.abs(g[name]).argmax(), g[name].shape)
        losses = []
        for step in (1e-2, -1e-2):
            model.p[name][where] += np.float32(step)
            losses.append(-model.score(t, t, t, y, np.ones_like(t, bool)).mean())
            model.p[name][where] -= np.float32(step)
        assert (losses[0] - losses[1]) / 2e-2 == pytest.approx(g[name][where], rel=0.05, abs=1e-3)


def test_gradients_of_all_parameters_where_some_places_are_left_out():
    from cliloom.llm.attention import WINDOW, Model

    model, rng = Model(5, 6), np.random.default_rng(3)
    t0, t1, t2, y = (rng.integers(0, 30, (7, WINDOW)) for _ in range(4))
    valid = np.arange(WINDOW) < np.array([1, 5, 32, 17, 32, 2, 9])[:, None]
    model.gradient(t1, t0, y, t2, np.ones_like(valid))  # its arrays are written again by the next
    loss, g = model.gradient(t0, t1, t2, y, valid)
    assert loss == pytest.approx(-model.score(t0, t1, t2, y, valid).mean(), rel=1e-5)
    g = {name: x.copy() for name, x in g.items()}
    assert sum(x.size for x in g.values()) == model.vector().size
    for name, slope in g.items():
        along, kept, losses = rng.standard_normal(slope.shape).astype(np.float32), model.p[name].copy(), []
        along += slope / np.abs(slope).max()
        for step in (3e-3, -3e-3):
            model.p[name][...] = kept + np.float32(step) * along
            losses.append(-model.score(t0, t1, t2, y, valid).astype(np.float64).mean())
        model.p[name][...] = kept
        assert (losses[0] - losses[1]) / 6e-3 == pytest.approx(float((slope * along).sum()), rel=0.02, abs=2e-4), name


def test_adam_agrees_with_its_formula():
    from cliloom.llm.attention import WINDOW, Adam, Model

    model, rng = Model(4, 4), np.random.default_rng(1)
    adam, p = Adam(model, 1e-2), model.vector().astype(np.float64)
    m, v = np.zeros_like(p), np.zeros_like(p)
    for i in range(1, 6):
        t, y = rng.integers(0, 16, (2, 3, WINDOW))
        model.gradient(t, t, t, y, np.ones_like(t, bool))
        slope = model.slope.astype(np.float64) * (1 if i < 3 else 20)  # the later ones are clipped
        model.slope[...] = slope
        adam.step(0.5)
        slope *= min(1, 1 / np.sqrt(slope @ slope))
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        p -= 0.5e-2 * np.sqrt(1 - 0.99**i) / (1 - 0.9**i) * m / (np.sqrt(v) + 1e-8)
        assert model.vector() == pytest.approx(p, abs=2e-5)


def test_a_training_step_writes_into_the_arrays_of_the_step_before():
    import tracemalloc

    from cliloom.llm import lm

    counts = np.zeros(lm.END + 1, np.int64)
    counts[:4000] = np.arange(4000, 0, -1)
    vocabulary, rng, peaks = lm.Vocabulary(counts), np.random.default_rng(2), []
    ids = (4000 * rng.random(40_000) ** 3).astype(np.int32)
    model, inner = lm.initial(vocabulary), lm.Adam.step

    def step(self, *given):
        inner(self, *given)
        peaks.append(tracemalloc.get_traced_memory()[1] - tracemalloc.get_traced_memory()[0])
        tracemalloc.reset_peak()

    before = model.vector()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(lm.Adam, "step", step)
        tracemalloc.start()
        lm.train(model, ids, np.array([0, 15_000, 40_000]), vocabulary, 0.0, 0.25, 0)
        tracemalloc.stop()
    assert len(peaks) > 40
    assert max(peaks[2:-1]) < before.nbytes  # not one more array as large as the parameters
    assert np.abs(model.vector() - before).max() > 0.01


def test_line_dedup(docs, none, rows):
    expected = cases.line_dedup(rows)
    assert sum(n for _, n in expected.values()) > 20
    assert by_id(dedup_lines(docs), "text", "_n_removed") == expected
    assert by_id(line_dedup_report(docs), "n_removed") == {i: n for i, (_, n) in expected.items()}
    assert dedup_documents(docs).columns == docs.columns
    assert line_dedup_report(none).count() == 0


def test_line_dedup_passages(spark):
    """Passages of several lines, at any offset: each is removed whole or, if it is short, now and then not at all; a line that others share stays."""
    import random

    rng, rows, inside = random.Random(4), [], {}
    line = lambda: " ".join(f"w{rng.randrange(10**9)}" for _ in range(8))
    for i in range(0, 400, 2):
        n = (3, 4, 6, 10)[i // 2 % 4]
        passage = [line() for _ in range(n)]
        for k in range(2):
            before, after = ([line() for _ in range(rng.randint(0, 5))] for _ in range(2))
            rows.append((i + k, "\n".join([*before, "a line in all of them", *passage, *after])))
        inside[i + 1] = n + 1  # the common line before the passage is the same too
    found = by_id(dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")), "_n_removed")
    assert all(found[i] == 0 for i in found if i % 2 == 0)
    assert {found[i] for i in inside} <= {0, *inside.values()}
    share = {n: np.mean([found[i] > 0 for i in inside if inside[i] == n + 1]) for n in (3, 4, 6, 10)}
    assert share[10] > 0.95 and share[6] > 0.85 and share[4] > 0.6 and share[3] > 0.4, share
    assert {i: n for i, (_, n) in cases.line_dedup(rows).items()} == found


def test_line_boundaries_depend_on_the_line_before(spark):
    from cliloom.llm.linededup import _chunks

    rows = [(k, f"before {k}\nthe line\nand more\nand still more") for k in range(40)]
    df = spark.createDataFrame(rows, "_row long, text string").withColumn("doc_id", F.col("_row"))
    ends = [Counter() for _ in rows]
    for r in _chunks(df, "text", "doc_id", 2).collect():
        ends[r._row][r._to] += 1
    assert len({e[1] for e in ends}) > 1  # how many phases end a chunk after one line depends on the line before it
    assert len({e[2] for e in ends}) == 1  # and on no other


def test_substrings(docs, none, rows):
    expected = cases.repeats(rows)
    for batches in (1, 2):
        assert by_id(remove_repeats(docs, batches=batches), "n_words", "n_removed", "kept_text") == expected
    assert remove_repeats(none).count() == 0


def test_index_runs_are_compacted(spark, docs, rows):
    index = FingerprintIndex(spark, 5, fan_in=2)
    df = docs.select("doc_id", "text")
    for a in range(0, 800, 150):
        index.ingest(df.where(f"doc_id >= {a} and doc_id < {a + 150}"))
    assert len(index.runs) <= 2 and index.compactions == 2
    for run, _ in index.runs:  # one sorted sequence for each bucket
        for r in run.collect():
            low = np.frombuffer(r.a, "<u4").astype(np.int64)
            assert (np.diff(low) >= 0).all()
        assert run.count() == run.select("bucket").distinct().count()
    assert by_id(index.resolve(df), "n_words", "n_removed", "kept_text") == cases.repeats(rows)


def test_runs_are_joined_without_a_shuffle(spark, docs):
    from cliloom.llm import substrings as S

    index = FingerprintIndex(spark, 5)
    df = docs.select("doc_id", "text")
    index.ingest(df.where("doc_id < 300"))
    index.ingest(df.where("doc_id >= 300"))
    (left, _), (right, _) = index.runs
    plan = left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(S._joined_runs(5), S._PAIRS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_the_registered_index_compacts(docs, rows, monkeypatch):
    from cliloom.llm import substrings as S

    done = []
    compact = FingerprintIndex.compact
    monkeypatch.setattr(FingerprintIndex, "compact", lambda self: (done.append(len(self.runs)), compact(self)))
    monkeypatch.setattr(S, "PART_BYTES", 2000)  # buckets of windows are settled in parts first
    monkeypatch.setattr(S, "ENTRIES", 200)
    assert by_id(remove_repeats(docs), "n_words", "n_removed", "kept_text") == cases.repeats(rows)
    assert done == [5]


def test_windows_of_one_hash_are_told_apart_by_their_words():
    from cliloom.llm.substrings import _seen_before

    body = b"aabbaaccbbdd"
    before, on = _seen_before(np.zeros(6, np.uint64), np.array([3, 1, 5, 9, 1, 2]), np.arange(0, 12, 2), np.full(6, 2), body)
    assert before.tolist() == [False, False, True, False, False, False]  # only the second aa: bb stands twice in one document
    assert (before != on).all()


def test_quality(docs, none, rows):
    found = by_id(quality_report(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    for i, t, *_ in rows:
        w = cases.words(t)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        many, covered, seen, dup = Counter(grams), set(), set(), 0
        for k, g in enumerate(grams):
            if many[g] > 1:
                covered |= {k, k + 1, k + 2}
        for line in (t or "").split("\n"):
            if cases.words(line):
                dup += line in seen
                seen.add(line)
        base = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        assert found[i][:6] == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(covered), base)
        assert not (base and found[i][6])
    assert quality_report(none).count() == 0
    assert {i for i, v in found.items() if v[6]} == {r.doc_id for r in clean_documents(docs).collect()}


def test_lines_that_fail_are_removed(spark):
    lines = [" ".join(f"word{k}{chr(97 + j)}" for j in range(16)) + f" ends {k}." for k in range(4)]
    bad = ["Home | About | Contact.", "WE SHOUT AND SHOUT AND SHOUT!", "no mark at the end", "$$$ %%% &&& words.", "Please read our Privacy Policy today."]
    text = "\n".join([lines[0], bad[0], lines[1], bad[1], bad[2], lines[2], bad[3], lines[3], bad[4]])
    df = spark.createDataFrame([(1, text, 2), (2, "\n".join(bad * 12), 3)], "doc_id long, text string, n_words int")
    rows = clean_documents(df).collect()
    assert [(r.doc_id, r.text, r.n_words) for r in rows] == [(1, "\n".join(lines), 2)]


def test_extra_columns_with_clashing_names(spark, rows):
    extra = spark.createDataFrame([r[:2] + ("s", 1, 2, 3) for r in rows if r[1]][:20], "doc_id long, text string, source string, id int, bucket int, score int")
    extra = extra.withColumn("n", F.lit(1)).withColumn("kept", F.lit(0)).withColumn("key", F.lit("k"))
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    for out in (fingerprint_report(extra), mixed_report(extra), near_components(extra), section_tokens(extra, path), lm_scores(extra, path), line_dedup_report(extra), remove_repeats(extra), quality_report(extra), pack_documents(extra, tokenizer_path("word_bpe_49k.json"))):
        assert out.count() >= 20
    for out in (clean_documents(extra), mixed_documents(extra), drop_near_copies(extra), dedup_documents(extra)):
        assert out.columns == extra.columns
        out.collect()


def test_extra_columns_named_like_our_own(spark, rows):
    own = ["_row", "_gone", "_split", "_quality", "_size", "_id", "_copies", "_lines", "_n_removed", "_left", "_text", "c0", "c1"]
    extra = spark.createDataFrame([r[:2] + ("s",) for r in rows if r[1]][::3], "doc_id long, text string, source string")
    plain = {f: sorted((r.doc_id, r.text) for r in f(extra).collect()) for f in (clean_documents, mixed_documents, drop_near_copies, dedup_documents)}
    for k, name in enumerate(own):
        extra = extra.withColumn(name, F.lit(k))
    for f, expected in plain.items():
        found = f(extra)
        assert found.columns == extra.columns
        found = found.collect()
        assert sorted((r.doc_id, r.text) for r in found) == expected
        assert all(r[c] == k for r in found for k, c in enumerate(own))
    assert dedup_lines(extra).columns[-2:] == ["_n_lines", "__n_removed"]


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() > 20
    assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_shared_tables_can_be_cleared(spark):
    from cliloom.llm.shared import clear, new_path, written

    clear(spark)
    table = written(spark.range(3), "some")
    path = table.inputFiles()[0]
    assert table.count() == 3
    assert new_path(spark, "other").rsplit("/", 1)[0] in path
    assert clear(spark) == 2
    assert clear(spark) == 0


def test_stages_on_empty_tables_and_repeated_rows(spark, none):
    for stage in (clean_documents, dedup_documents, drop_near_copies, mixed_documents):
        assert stage(none).count() == 0
        assert stage(none).columns == none.columns
    text = cases.prose(__import__("random").Random(1), 90)
    same = spark.createDataFrame([(None, text, None, None, None)] * 4 + [(7, text, "en", "s", 1)] * 3, cases.SCHEMA).coalesce(1)
    assert clean_documents(same).count() == 7
    assert [r.near_next for r in fingerprint_report(same).collect()] == [1.0] * 7
    assert near_components(same).where("kept").count() == 4
    assert {r.n_removed for r in remove_repeats(same).where("doc_id = 7").collect()} == {len(cases.words(text))}
    assert sum(r._n_removed == 0 for r in dedup_lines(same).collect()) == 1
    taken = {(r.doc_id, r.copies) for r in mixed_report(same).collect()}
    assert len(taken) == 2  # equal rows are drawn together


@pytest.mark.parametrize("run", [" " * 5_000_000, "\n" * 5_000_000, "　" * 1_200_000, " \t\r\n　" * 1000])
def test_runs_of_white_space_of_any_length(run):
    encoding, _ = tokencount.load(tokenizer_path("byte_bpe_50k.tiktoken"))
    for before, after in (("", ""), ("a b", ""), ("", "x"), ("it's", " 12 x"), ("a", "é")):
        ids = tokencount.encode(encoding, before + run + after)
        assert encoding.decode(ids) == before + run + after
        short = run[:1200]  # the pattern still takes this by itself
        assert tokencount.encode(encoding, before + short + after) == encoding.encode_ordinary(before + short + after)


def test_long_white_space_is_counted_and_scored(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a" + " " * 1_000_000, "　" * 400_000 + "b", "plain words", None] * 3)], "doc_id long, text string")
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    assert {r["doc_id"]: r["n_chars"] for r in section_tokens(df, path).collect()}[0] == 1_000_001
    assert lm_scores(df, path).count() == 12


def test_line_dedup_is_linear_in_equal_lines(spark):
    df = spark.createDataFrame([(1, "\n".join(["the same line"] * 40_000)), (2, "alone")], "doc_id long, text string")
    assert by_id(line_dedup_report(df), "n_lines", "n_removed") == {1: (40_000, 39_999), 2: (1, 0)}
