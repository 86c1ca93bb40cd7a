"""The pipeline, stage by stage, against plain Python; each stage on what the one before it kept."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from cliloom.llm.quality import BOILERPLATE
from cliloom.llm.queries import tokenizer_path

from . import cases

TERMINAL = tuple(".!?:;\"')]…”’»。！？")


def line_fails(line):
    w = cases.words(line)
    lone = sum(x in ("|", ">", "/", "-", "*", "»", "·") for x in w)
    marked = sum(any(c in "#*$%&|<>" for c in x) for x in w)
    upper, lower = sum("A" <= c <= "Z" for c in line), sum("a" <= c <= "z" for c in line)
    shouts = len(w) >= 3 and upper and 10 * upper > 7 * (upper + lower)
    low = line.translate(cases.LOWER)
    return not w[-1].endswith(TERMINAL) or lone >= 2 or 10 * lone > 3 * len(w) or 10 * marked >= 3 * len(w) or shouts or any(p in low for p in BOILERPLATE)


def quality(docs):
    out = []
    for i, text, lang, source, _ in docs:
        text = text or ""
        w = cases.words(text)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        many = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if many[g] > 1 for j in range(3)}
        lines = text.split("\n")
        bad = [bool(cases.words(x)) and line_fails(x) for x in lines]
        lost = sum(sum(map(len, cases.words(x))) for x, b in zip(lines, bad, strict=True) if b)
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and 2 * lost <= sum(map(len, w)):
            kept = "\n".join(x for x, b in zip(lines, bad, strict=True) if not b)
            out.append((i, kept, lang, source, len(kept)))
    return out


def line_dedup(docs):
    kept = cases.line_dedup(docs)
    return [(i, kept[i][0], lang, source, len(kept[i][0])) for i, _, lang, source, _ in sorted(docs) if cases.words(kept[i][0])]


def near_dedup(docs):
    component, _ = cases.near(docs, 80, 100, 5)
    return [d for d in docs if component[d[0]] == d[0]]


def mix(docs):
    """Copies of each document."""
    sizes = {d[0]: len(cases.words(d[1])) for d in docs}
    sources = sorted({d[3] for d in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(sizes[d[0]] for d in docs if d[3] == s) for s in sources}
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sources)}
    open_, budget, target = list(sources), 1.5 * sum(total.values()), {}
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = [s for s in open_ if 2 * total[s] <= weight[s] * level]
        target |= {s: 2.0 * total[s] for s in over} if over else {s: weight[s] * level for s in open_}
        budget -= sum(2 * total[s] for s in over)
        open_ = [s for s in open_ if s not in over] if over else []
    copies = Counter()
    for s in sources:
        ratio = target[s] / total[s]
        whole, part = int(ratio), ratio - int(ratio)
        draw, used = target[s] - whole * total[s], 0
        ranked = []
        for d in docs:
            if d[3] == s:
                copies[d[0]] += whole
                u = (int(hashlib.md5(f"mix{d[0]}".encode()).hexdigest()[:12], 16) + 0.5) / 16**12
                ranked.append((u / (1 - u), d[0]))
        if part <= 0:
            continue
        rest = []
        for _, i in sorted(ranked):
            if not rest and used + sizes[i] <= draw:
                used += sizes[i]
                copies[i] += 1
            else:
                rest.append(i)
        if rest:
            best = min(rest, key=lambda i: abs(sizes[i] - (draw - used)))
            if abs(sizes[best] - (draw - used)) < abs(draw - used):
                copies[best] += 1
    return copies


def rows_of(df):
    return sorted(tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect())


@pytest.fixture(scope="module")
def texts():
    docs = cases.documents()
    junk = [(2000 + i, "\n".join(["Home | About | More", "BUY NOW AND SAVE!"] * 12 + [f"One good line of words to keep, number {i}."]), "en", "s1", None) for i in range(3)]
    listed = [(3000 + i, docs[i][1] + "\nReleased under the Some License.\nMenu > Sub > Page", "de", None, 1) for i in range(5)]
    return [*docs, *junk, *listed]


def test_stages(spark, texts, tmp_path):
    spark.createDataFrame(texts, cases.SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    expected, names = texts, dict(corpus_pipeline.STAGES)

    def stage(name, df):
        out = names[name](spark, df, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    for name, plain in (("quality_rules", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup)):
        docs, before, expected = stage(name, docs), len(expected), plain(expected)
        assert len(expected) < before or name == "line_dedup"
        assert rows_of(docs) == sorted(expected)
    docs, copies = stage("mix_sources", docs), mix(expected)
    assert Counter(r[0] for r in rows_of(docs)) == +copies
    packed = stage("pack_sequences", docs).collect()

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    tokenizer.encode_special_tokens = True
    pieces = Counter()
    for i, text, *_ in expected:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            pieces[i, at // 4096, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += copies[i]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == +pieces
    assert Counter((r.doc_id, r.piece, r.length) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == Counter((r.doc_id, r.piece, r.length) for r in packed)
