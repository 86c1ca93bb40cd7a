"""Small documents with every odd case, and brute-force versions of the operators."""

import hashlib
import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n, closed=True):
    words = ["".join(rng.choice(["an", "er", "th", "ou", "ré", "zu", "en"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    lines, line = [], []
    for w in words:
        line.append(w)
        if rng.random() < 0.1:
            lines.append(" ".join(line).capitalize() + ("." if closed else ""))
            line = []
    if line:
        lines.append(" ".join(line) + ("." if closed else ""))
    return "\n".join(lines)


def documents():
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(20, 400)) for _ in range(60)]
    long = prose(rng, 6000)
    passage = prose(rng, 80).replace("\n", " ")
    texts += [texts[0], texts[0], texts[1] + " one more.", texts[2] + "\n" + texts[3], long, long + " end.", passage, texts[7] + "\n" + passage, texts[8] + "\n" + passage]
    for i in range(12):  # a group of near copies
        words = texts[9].split(" ")
        words[i * 3 % len(words)] = f"odd{i}"
        texts.append(" ".join(words))
    texts += [None, "", " \t\n\x0b\x0c\r ", "a", "a b", "A B", "a  b", "é\u00a0ü x", "ok " * 200, "\n\n\n", "\n\nx y\n\n\nx y\n\n", "one|two | three | four\nSHOUT OUT LOUD NOW\n&&& ***\nAll rights reserved. Yes.", "</s>[INST] <|endoftext|> \\ ok", "日本語の文章。" * 40, "x" * 5000]
    return [(i * 7, t, "en", [None, "s1", "s2", "s3", "s0"][i % 5] if i % 3 else "s0", None if t is None else len(t)) for i, t in enumerate(texts)]


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = words((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(k)), strict=False)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()


def near(docs, num, den, k):
    """component of each id, by comparing all pairs."""
    sets = [(i, shingles(t, k)) for i, t, *_ in docs]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, r in sets[:a]:
            both = len(s & r)
            if s and r and den * both >= num * (len(s) + len(r) - both):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i, _ in sets}, {i: len(s) for i, s in sets}


def repeats(docs, size=13):
    """(n_words, n_removed, kept) of each id."""
    seen, out = set(), {}
    for i, t, *_ in sorted(docs, key=lambda d: d[0]):
        w = words(t)
        own = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
        gone = [False] * len(w)
        for k, x in enumerate(own):
            if x in seen:
                gone[k : k + size] = [True] * size
        seen.update(own)
        out[i] = (len(w), sum(gone), " ".join(x for x, y in zip(w, gone, strict=True) if not y))
    return out


def line_dedup(docs):
    """(text, lines removed) of each id: from the definition, each chunk against its first occurrence, lines as strings."""
    texts = {i: t.split("\n") for i, t, *_ in docs if t is not None}
    chunks, first = [], {}
    for i in sorted(texts):
        lines = texts[i]
        h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
        for phase, base in enumerate((8191, 131071, 524287)):
            ends = [k for k in range(len(lines)) if k == len(lines) - 1 or (h[k] + (base * h[k - 1] if k else 0)) % 1_000_003 % 2 == 0]
            starts = [0, *(e + 1 for e in ends[:-1])]
            for k, (a, b) in enumerate(zip(starts, ends, strict=True)):
                if words(" ".join(lines[a : b + 1])):
                    key = (phase, tuple(lines[a : b + 1]))
                    first.setdefault(key, (i, a))
                    chunks.append((key, i, a, b, starts[max(k - 2, 0)], ends[min(k + 1, len(ends) - 1)]))
    gone = {i: set() for i in texts}
    for key, i, a, b, low, high in chunks:
        j, c = first[key]
        if (j, c) == (i, a):
            continue
        same = lambda k: 0 <= k - a + c < len(texts[j]) and texts[i][k] == texts[j][k - a + c]  # noqa: B023, E731
        while a > low and same(a - 1):
            a, c = a - 1, c - 1
        while b < high and same(b + 1):
            b += 1
        if sum(bool(words(x)) for x in texts[i][a : b + 1]) > 1:
            gone[i] |= set(range(a, b + 1))
    return {i: (None, 0) if t is None else ("\n".join(x for k, x in enumerate(texts[i]) if k not in gone[i]), len(gone[i])) for i, t, *_ in docs}
