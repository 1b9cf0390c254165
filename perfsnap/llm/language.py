"""Language of a text: the family first, then its languages against each other.

Texts are counts of hashed three-byte pieces of their letters. Linear support
vector machines tell the families apart, two at a time, and then the languages
within the chosen family, two at a time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perfsnap.llm.common import rows_by_id, ship
from perfsnap.session import written

ship(sys.modules[__name__])

SIZE = 4096
UNDETERMINED = "und"


def has_letter(text: str) -> bool:
    """Whether any sign is a letter; number signs such as ½ or Ⅷ are none."""
    return any(map(str.isalpha, text))


# Families by language code; other codes are a family each.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb yi fy",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "indic": "hi bn mr ne pa gu ur",
    "semitic": "ar he mt am",
    "turkic": "tr az kk uz ky",
    "celtic": "ga cy gd br",
}
FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
# Letters as they are (lower case), all other ASCII as a blank.
BLANKS = np.array([c if chr(c).isalpha() or c >= 128 else 32 for c in range(256)], np.uint8)


def features(text: str) -> np.ndarray:
    """Square roots of the counts of hashed three-byte pieces, at length 1."""
    b = BLANKS[np.frombuffer(text.lower().encode(errors="replace"), np.uint8)]
    b = np.concatenate(([32], b, [32])).astype(np.uint32)
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[(b[1:-1] != 32)]
    v = np.sqrt(np.bincount((code * np.uint32(2654435761)) >> np.uint32(20), minlength=SIZE).astype(np.float32))
    return v / max(float(np.linalg.norm(v)), 1e-9)


def sparse(v: np.ndarray) -> bytes:
    """The places and values that are not zero, a few bytes each."""
    at = np.flatnonzero(v)
    return at.astype("<u2").tobytes() + v[at].astype("<f2").tobytes()


def dense(rows: list[bytes]) -> np.ndarray:
    """Feature rows with a constant last column."""
    x = np.zeros((len(rows), SIZE + 1), np.float32)
    x[:, -1] = 1
    for i, r in enumerate(rows):
        half = len(r) // 2
        x[i, np.frombuffer(r[:half], "<u2")] = np.frombuffer(r[half:], "<f2")
    return x


def train_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a linear support vector machine (dual coordinate descent);
    ``y`` is +1 or -1. The smaller side weighs more."""
    share = {s: len(y) / 2 / max((y == s).sum(), 1) for s in (1, -1)}
    bound = np.array([c * share[int(s)] for s in y])
    alpha, w, q = np.zeros(len(y)), np.zeros(x.shape[1], np.float64), np.einsum("ij,ij->i", x, x)
    order = np.random.default_rng(1)
    for _ in range(rounds):
        for i in order.permutation(len(y)):
            g = y[i] * (x[i] @ w) - 1
            new = min(max(alpha[i] - g / q[i], 0.0), bound[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def one_against_one(rows: list[bytes], names: list[str]) -> dict[tuple[str, str], np.ndarray]:
    """A machine for every two names; only their rows are held as a matrix."""
    out = {}
    for a, b in combinations(sorted(set(names)), 2):
        at = [i for i, n in enumerate(names) if n in (a, b)]
        out[a, b] = train_svm(dense([rows[i] for i in at]), np.array([1 if names[i] == a else -1 for i in at]))
    return out


def vote(pairs: dict[tuple[str, str], np.ndarray], names: list[str], v: np.ndarray) -> tuple[str, float]:
    """The name that wins most duels (equal: the smaller), and the chance of its closest one."""
    if len(names) == 1:
        return names[0], 1.0
    won, least = dict.fromkeys(names, 0), dict.fromkeys(names, 1.0)
    for (a, b), w in pairs.items():
        chance = 1 / (1 + float(np.exp(-min(30.0, max(-30.0, 3 * (v @ w[:-1] + w[-1]))))))
        won[a if chance >= 0.5 else b] += 1
        least[a], least[b] = min(least[a], chance), min(least[b], 1 - chance)
    best = min(names, key=lambda n: (-won[n], n))
    return best, least[best]


class Model:
    """Families, and languages within each; learned from feature rows and names."""

    def __init__(self, rows: list[bytes], names: list[str]):
        families = [FAMILY.get(n, n) for n in names]
        self.families = sorted(set(families))
        self.first = one_against_one(rows, families)
        self.within = {}
        for f in self.families:
            at = [i for i, g in enumerate(families) if g == f]
            own = [names[i] for i in at]
            self.within[f] = (sorted(set(own)), one_against_one([rows[i] for i in at], own))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.families or text is None or not has_letter(text):
            return UNDETERMINED, 0.0
        v = features(text)
        family, sure = vote(self.first, self.families, v)
        names, pairs = self.within[family]
        name, surer = vote(pairs, names, v)
        return name, sure * surer


def fit(labelled: DataFrame, max_rows: int = 3000) -> Model:
    """Train on at most ``max_rows`` rows of (doc_id, text, lang) with a language
    and a letter: as many of each language, chosen by a hash of the id.

    Ids are chosen first; only the chosen texts are read for features, which are
    made in tasks. The driver gets ``max_rows`` sparse feature rows of 16 kB at most.
    """
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    # One row a language, as the model itself has.
    sizes = written(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("_size")), "sizes")
    n = sizes.count()
    if not n:
        return Model([], [])
    most = max(1, max_rows // n)
    # The smallest hashes are looked for below a bound that twice as many rows and some
    # more are expected under, so that a language of any size sends few rows to its task.
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    few = rows.select("doc_id", "lang").join(F.broadcast(sizes), "lang").where(place * F.col("_size") < 2 * most + 100)
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = few.select("doc_id", "lang").withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= most)
    chosen = rows.join(F.broadcast(ids.select("doc_id")), "doc_id", "left_semi")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[[has_letter(t) for t in f["text"]]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang": f["lang"], "v": [sparse(features(t)) for t in f["text"]]})

    got = chosen.select("doc_id", "lang", "text").mapInPandas(count, "doc_id long, lang string, v binary").collect()
    got.sort(key=lambda r: r.doc_id)
    return Model([bytes(r.v) for r in got], [r.lang for r in got])


def held_out(doc_id: str = "doc_id"):
    """Documents kept from training: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every document, from its whole text alone.

    Null texts and texts without a letter are ``und`` with score 0, as is every
    text if nothing was learned. The score is the product of the closest duels
    of the family and the language, 0 to 1.
    """
    def predict(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = [model.predict(t if isinstance(t, str) else None) for t in f["text"]]
            yield pd.DataFrame({"doc_id": f["doc_id"], "lang_pred": [n for n, _ in out], "score": [float(s) for _, s in out]})

    rows = rows_by_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInPandas(predict, "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows whose text has a language, with all their columns. Rejected are
    null texts, texts without a letter and, if nothing was learned, all."""

    @F.pandas_udf("string")
    def language(texts: pd.Series) -> pd.Series:
        return pd.Series([model.predict(t if isinstance(t, str) else None)[0] for t in texts], dtype=object)

    return docs.where(language(F.col("text").cast("string")) != UNDETERMINED)
