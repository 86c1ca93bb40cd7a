"""Fingerprints against a plain parser, and every operator on texts that take several blocks of the kernels."""

import hashlib
import random

import numpy as np
import pytest

from cliloom.llm import chat, kernels, tokencount
from cliloom.llm import fingerprints as P
from cliloom.llm.linededup import line_dedup_report
from cliloom.llm.lm import lm_scores
from cliloom.llm.mixing import mixed_report
from cliloom.llm.neardup import near_components
from cliloom.llm.packing import pack_documents
from cliloom.llm.quality import quality_report
from cliloom.llm.queries import tokenizer_path
from cliloom.llm.substrings import remove_repeats
from cliloom.llm.tokencount import section_tokens

from . import cases

MASK = (1 << 64) - 1


def mix(x):
    return int(kernels.mix(np.array([x & MASK], np.uint64))[0])


def coin(before, now):
    apart = before ^ now
    bit = (apart & -apart).bit_length() - 1 if apart else 0
    return 2 * bit + (now >> bit & 1)


def tossed(labels):
    return [0] + [coin(a, b) for a, b in zip(labels, labels[1:], strict=False)]


def plain_phrases(symbols, is_bytes):
    """Names of the phrases of one document, symbol by symbol."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    first = [s for s, _ in runs]
    labels = first
    for _ in range(3 if is_bytes else 4):
        labels = tossed(labels)
    names = [int(P._BYTE[s]) if is_bytes else s for s, _ in runs]
    names = [mix(x + n * P._RUN) if n > 1 else x for x, (_, n) in zip(names, runs, strict=True)]
    starts = [i for i in range(len(names)) if i == 0 or i < len(names) - 1 and labels[i] > labels[i - 1] and labels[i] > labels[i + 1]]
    out = []
    for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
        total = sum(x * pow(P._STEP, min(k, 255), 1 << 64) for k, x in enumerate(names[a:b]))
        out.append(mix(total + (b - a) * P._RUN))
    return out


def plain_registers(text):
    data = text.encode()
    if not data:
        return None
    symbols, held = list(data), []
    for level in range(1, P.LEVELS + 1):
        symbols = plain_phrases(symbols, level == 1)
        if level >= P.FROM_LEVEL:
            held += [mix(s + level) for s in symbols]
    return [mix(min(x * int(f) & MASK for x in held)) >> 56 for f in P._FACTORS]


def plain_likeness(a, b):
    if a is None or b is None:
        return float(a is b)
    share = sum(x == y for x, y in zip(a, b, strict=True)) / len(a)
    return min(1.0, max(0.0, (share - 1 / 256) / (1 - 1 / 256)))


def test_fingerprints_are_those_of_a_plain_parser(spark):
    rows = [(i, t[:1500] if t else t, *more) for i, t, *more in cases.documents()]
    rng = random.Random(2)
    rows += [(100_000 + k, "".join(rng.choice("ab \n") for _ in range(n)), None, None, None) for k, n in enumerate((1, 2, 3, 4, 9, 30, 200))]
    texts = [t or "" for _, t, *_ in rows]
    prints = [plain_registers(t) for t in texts]
    got = {r["doc_id"]: r for r in P.fingerprint_report(spark.createDataFrame(rows, cases.SCHEMA).repartition(3)).collect()}
    hexed = lambda x: "" if x is None else bytes(x).hex()
    for k, (i, *_) in enumerate(rows):
        now, then = texts[k], texts[(k + 1) % len(rows)]
        half = len(now) // 2
        edited = plain_registers(now[: len(now) - half] + then[:half])
        r = got[i]
        assert (r["fingerprint"], r["edited_fingerprint"]) == (hexed(prints[k]), hexed(edited))
        assert r["near_edited"] == pytest.approx(plain_likeness(prints[k], edited)) and r["near_next"] == pytest.approx(plain_likeness(prints[k], prints[(k + 1) % len(rows)]))


def test_equal_substrings_share_phrases_whatever_their_offset():
    rng = random.Random(9)
    shared = bytes(rng.randrange(97, 123) for _ in range(3000))
    sets = [set(plain_phrases(list(bytes(rng.randrange(97, 123) for _ in range(n)) + shared), True)) for n in (0, 1, 7, 100)]
    inner = len(set(plain_phrases(list(shared), True)))
    assert all(len(sets[0] & s) > 0.97 * inner for s in sets[1:])


@pytest.fixture(scope="module")
def long(spark):
    """Texts of over a block: one, its copy, one that differs in a few words, and one without a blank."""
    rng = random.Random(6)
    text = cases.prose(rng, 260_000)
    assert len(text) > kernels.BLOCK_BYTES
    near = text.replace(" an ", " different ", 20)
    return [(1, text), (2, text), (3, near), (4, "x" * (2 * kernels.BLOCK_BYTES + 7)), (5, "short. one"), (6, None)]


@pytest.fixture(scope="module")
def long_docs(spark, long, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("long") / "documents.parquet")
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in long], cases.SCHEMA).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_texts_of_several_blocks(spark, long, long_docs):
    words = {i: cases.words(t) for i, t in long}
    quality = rows_of(quality_report(long_docs))
    assert all(quality[i]["n_words"] == len(w) and quality[i]["word_chars"] == sum(map(len, w)) for i, w in words.items())
    mixed = rows_of(mixed_report(long_docs))
    assert all(mixed[i]["size"] == len(w) for i, w in words.items())
    found = rows_of(near_components(long_docs, num=85, den=100, k=3))
    assert [found[i]["component_id"] for i in (1, 2, 3, 4)] == [1, 1, 1, 4]
    assert all(found[i]["n_shingles"] == len(cases.shingles(t, 3)) for i, t in long)
    gone = rows_of(remove_repeats(long_docs))
    want = cases.repeats(long)
    assert all((gone[i]["n_words"], gone[i]["n_removed"], gone[i]["kept_sha256"]) == (want[i][0], want[i][1], hashlib.sha256(want[i][2].encode()).hexdigest()) for i, _ in long)
    lines = rows_of(line_dedup_report(long_docs))
    want = cases.line_dedup(long)
    assert all(lines[i]["n_removed"] == want[i][1] for i, _ in long)
    prints = rows_of(P.fingerprints(long_docs))
    assert prints[1]["fingerprint"] == prints[2]["fingerprint"] != prints[5]["fingerprint"]


def test_long_texts_are_tokenized_whole(spark, long, long_docs):
    path = tokenizer_path("byte_bpe_50k.tiktoken")
    encoding, _ = tokencount.load(path)
    sections = section_tokens(long_docs.where("doc_id <> 4"), path).groupBy("doc_id").sum("n_tokens").collect()
    assert {r[0]: r[1] for r in sections} == {i: len(encoding.encode_ordinary(t or "")) for i, t in long if i != 4}
    packed = pack_documents(long_docs.where("doc_id in (1, 2, 5, 6)"), tokenizer_path("word_bpe_49k.json")).collect()
    size = {i: sum(r["length"] for r in packed if r["doc_id"] == i) for i in (1, 2, 5, 6)}
    assert size[1] == size[2] > 260_000 and size[6] == 1 and all(r["length"] <= 4096 for r in packed)
    scores = rows_of(lm_scores(long_docs.where("doc_id in (1, 3, 5, 6)"), path))
    assert all(scores[i]["n_tokens"] == len(cases.words(dict(long)[i])) + 1 for i in (1, 3, 5, 6))
    turns = spark.createDataFrame([(9, 0, "user", "q"), (9, 1, "assistant", long[0][1])], "conv_id long, turn long, role string, text string")
    assert chat.chat_report(turns).first()["loss_chars"] == len(long[0][1])
