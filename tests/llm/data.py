"""Small tables that hold every awkward case, and brute-force versions of what the operators promise."""

import random
import re
from collections import Counter, defaultdict

#: Column names that also occur inside operators.
SCHEMA = "doc_id long, text string, lang string, source string, shard string, size string, node string, h string, band string, key string"


def rows_of(texts):
    """Rows of (doc_id, text, lang, source) with clashing extra columns."""
    return [(i, t, lang, src, "s", "z", "n", "h", "b", "k") for i, t, lang, src in texts]


def frame(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA)


def awkward():
    """Nulls in any column, empty, blank and very long texts, ties and repeated rows."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7)))
    base = [word() for _ in range(80)]
    near = base.copy()
    near[40] = "changed"
    line = "this line stands in many of the documents of the table"
    out = [
        (1, None, "en", "a"), (2, "", None, "a"), (3, " \n\t ", "en", None), (4, "one two", "en", "b"), (5, "One\ttwo", "en", "b"),
        (6, " ".join(base), "en", "a"), (7, " ".join(base).upper(), "en", "a"), (8, "\n".join(near), "de", "b"), (9, " ".join(base[:45]), "en", "c"),
        (10, " ".join(word() for _ in range(30_000)), "en", "c"), (11, "x" * 50_000, "en", None), (None, " ".join(base), "en", "a"), (None, None, None, None),
        (12, "same row", "en", "a"), (12, "same row", "en", "a"), (13, "é ü 中文 ＡＢ license", "fr", "b"),
    ]
    for i in range(20, 30):
        out.append((i, f"{line}\n{word()} {word()}\n  {line.upper()} \n{' '.join(word() for _ in range(60))}", "en", rng.choice("abc")))
    return out


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def components(texts):
    """doc_id to smallest linked doc_id, comparing all pairs."""
    sets = defaultdict(list)
    for i, t, *_ in texts:
        if i is not None:
            sets[i].append(shingle_set(t))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= 75 * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in sets}


def repeats(words):
    seen = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = set()
    for i in range(len(words) - 2):
        if seen[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    return len(covered)


def words(text):
    return re.findall(r"[^ \t-\r]+", text or "")
