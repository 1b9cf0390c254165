"""Slow, plain versions of the operators, and awkward tables."""

import hashlib
import re
from itertools import combinations

from pyspark.sql import types as T

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 7919}x" for i in range(20_000))
EXTRA = ["n", "token", "anchor", "bucket", "marks", "path", "component_id", "label", "value", "features", "z", "runs", "sequence_id", "_row", "start"]


def documents(spark, rows):
    """doc_id, text, lang, source, n_chars and columns whose names the operators use too."""
    shape = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                          T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
                         + [T.StructField(c, T.StringType()) for c in EXTRA])
    return spark.createDataFrame([(i, t, lang, None if i == 3 else "src0", None) + ("x",) * len(EXTRA) for i, t, lang in rows], shape)


def awkward(spark):
    """Null, empty, blank, very long, repeated and id-less rows."""
    rows = [(1, None, "en"), (2, "", None), (3, " \n\t ", "en"), (4, LONG, "en"), (5, LONG, "de"), (6, "one two", None), (6, "one two", None),
            (7, "7 77 777 %%%", "en"), (None, "no id", "en"), (8, "a" * 3000, "en"), (9, "one TWO", "fr")]
    return documents(spark, rows)


def empty(spark):
    return documents(spark, [])


def once(rows):
    """One row per id, as the operators define it."""
    least = {}
    for i, t in rows:
        if i is not None and (i not in least or (t or "") < (least[i] or "")):
            least[i] = t
    return least


def repeated_bytes(rows, window=100):
    seen, out = set(), {}
    for i, t in sorted(once(rows).items()):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            s = b[k:k + window]
            if s in seen:
                gone[k:k + window] = b"\1" * window
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeated_words(rows, window=50):
    seen, out = {}, {}
    for i, t in sorted(once(rows).items()):
        u = WORDS.findall(t or "")
        gone = [0] * len(u)
        for k in range(len(u) - window + 1):
            if seen.setdefault(tuple(u[k:k + window]), i) < i:
                gone[k:k + window] = [1] * window
        kept = " ".join(x for x, g in zip(u, gone) if not g)
        out[i] = (len(u), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def shingle_components(rows, size=4, percent=85):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in once(rows).items():
        w = WORDS.findall((t or "").translate(lower))
        sets[i] = {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                a, b = sorted((find(a), find(b)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}
