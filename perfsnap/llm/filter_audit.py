"""What each of several filters removes, in any order and in fair shares.

Every document gets one bit per filter that it fails. Counts per part and bit
set are all that is kept; from them the documents that each coalition of filters
would remove are tabulated, 2^n numbers a part. The steps of any order are
differences between coalitions. Fair shares (Shapley values) are the solution of
the least squares problem over all coalitions, weighted by the Shapley kernel
and constrained so that shares add up to what all filters remove together; its
normal equations are solved in rationals, so shares are exact.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfsnap.llm.common import rows_by_id, ship
from perfsnap.session import written

ship(sys.modules[__name__])

BLANKS = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEP_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def text_failures(text: Column) -> dict[str, Column]:
    """Filters that judge a text by itself: few words (A), repeated words (B),
    many capitals (C), signs of markup (D)."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    return {
        "A": F.size(words) < 50,
        "B": 100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        "C": 100 * capitals.cast("long") > 5 * F.length(text).cast("long"),
        "D": F.regexp_like(text, F.lit(r"[#$%&*|]")),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, mask, n, n_good, n_toxic): documents per set of failed filters.

    Bit i of ``mask`` stands for the i-th filter, A to E. E fails texts that a
    smaller doc_id has, anywhere in the table: of each text all documents are
    counted, and the one with the smallest id is told apart by one aggregate
    that combines before its shuffle, so copies never meet in one task. A label
    counts if any row of its document has it.
    """
    text = F.coalesce("text", F.lit(""))
    rows = rows_by_id(docs, "doc_id", "text", part)
    bits = sum((fails.cast("int") * 2**i for i, fails in enumerate(text_failures(text).values())), F.lit(0))
    flagged = rows.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"))
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int")).alias("toxic"))
    flagged = written(flagged.join(known, "doc_id", "left").na.fill(0, ["good", "toxic"]), "failures")
    firsts = flagged.groupBy("digest").agg(F.min(F.struct("doc_id", "part", "mask", "good", "toxic")).alias("f")).select("f.*")
    kind = ["part", "mask", "good", "toxic"]
    every = flagged.groupBy(*kind).agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.lit(False))
    counted = every.unionByName(firsts.groupBy(*kind).agg(F.count(F.lit(1)).alias("n")).withColumn("first", F.lit(True)))
    # a first document keeps its mask, all others of its text fail E as well
    n = F.col("n")
    moved = counted.select("part", "good", "toxic", F.explode(F.when(F.col("first"), F.array(
        F.struct("mask", n.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (-n).alias("n")))).otherwise(F.array(F.struct((F.col("mask") + 16).alias("mask"), n.alias("n"))))).alias("m"))
    return moved.groupBy("part", "m.mask").agg(F.sum("m.n").alias("n"), F.sum(F.col("good") * F.col("m.n")).alias("n_good"), F.sum(F.col("toxic") * F.col("m.n")).alias("n_toxic"))


def coalition_removals(counts: DataFrame, n_filters: int) -> DataFrame:
    """(part, n_docs, removed, good, toxic): arrays over all coalitions, each coalition
    at the position whose bits name its filters."""
    each = counts.select("*", F.explode(F.sequence(F.lit(0), F.lit(2**n_filters - 1))).alias("coalition"))
    hit = F.col("mask").bitwiseAND(F.col("coalition")) != 0
    sums = each.groupBy("part", "coalition").agg(F.sum("n").alias("n_docs"), *[
        F.sum(F.when(hit, F.col(c)).otherwise(0)).alias(name) for c, name in (("n", "removed"), ("n_good", "good"), ("n_toxic", "toxic"))])
    rows = F.sort_array(F.collect_list(F.struct("coalition", "removed", "good", "toxic")))
    table = sums.groupBy("part").agg(F.max("n_docs").alias("n_docs"), rows.alias("r"))
    return table.select("part", "n_docs", *[F.col("r")[c].alias(c) for c in ("removed", "good", "toxic")])


def fair_shares(value: Sequence[int], n: int) -> list[Fraction]:
    """Shapley values of a game given as the worth of each coalition, the empty one worth 0.

    Least squares over all coalitions but the empty and the whole one, each with
    the weight (n - 1) / (C(n, s) s (n - s)); the whole one is the constraint.
    """
    if n == 1:
        return [Fraction(value[1])]
    weight = [Fraction(n - 1, comb(n, s) * s * (n - s)) if 0 < s < n else Fraction(0) for s in map(int.bit_count, range(2**n))]
    inside = [[c for c in range(2**n) if c >> i & 1] for i in range(n)]
    rows = [[sum((weight[c] for c in inside[i] if c >> j & 1), Fraction(0)) for j in range(n)] + [Fraction(1), sum((weight[c] * value[c] for c in inside[i]), Fraction(0))] for i in range(n)]
    rows.append([Fraction(1)] * n + [Fraction(0), Fraction(value[-1])])
    return solve(rows)[:n]


def solve(rows: list[list[Fraction]]) -> list[Fraction]:
    """Solution of linear equations, each row ending with its right-hand side."""
    for k in range(len(rows)):
        p = next(i for i in range(k, len(rows)) if rows[i][k])
        rows[k], rows[p] = rows[p], rows[k]
        rows[k] = [x / rows[k][k] for x in rows[k]]
        for i, row in enumerate(rows):
            if i != k and row[k]:
                rows[i] = [x - row[k] * y for x, y in zip(row, rows[k])]
    return [row[-1] for row in rows]


def order_steps(coalitions: DataFrame, names: str) -> DataFrame:
    """One row per part, order of the filters and step; see ``audit``."""
    n = len(names)

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                out: dict[str, list] = {c: [] for c in ("part", "filter_order", "step", *STEP_COLUMNS)}
                removed, whole = r["removed"], 2**n - 1
                shares = [int(s * factorial(n)) for s in fair_shares(removed, n)]
                for order in permutations(range(n)):
                    before = 0
                    for step, i in enumerate(order, 1):
                        after = before | 1 << i
                        gain = removed[after] - removed[before]
                        values = (r["part"], "".join(names[k] for k in order), step, r["n_docs"] - removed[after], gain, removed[1 << i] - gain,
                                  removed[whole] - removed[whole ^ 1 << i], r["good"][after] - r["good"][before], r["toxic"][after] - r["toxic"][before], shares[i])
                        for c, v in zip(out, values):
                            out[c].append(v)
                        before = after
                yield pa.RecordBatch.from_pydict(out, pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(c, pa.int64()) for c in STEP_COLUMNS]]))

    return coalitions.mapInArrow(steps, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in STEP_COLUMNS))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley): for every part and order of the filters A to E, what each
    step does.

    ``redundant`` fail the step's filter but went before, ``unique_fails`` fail no
    other; ``shapley`` is what the filter removes summed over all orders. Null
    texts are empty, null parts are the part ''. Documents without labels count
    as neither good nor toxic. Rows that repeat an id, rows without one and other
    columns: see ``rows_by_id``. Without documents there is no row. Work per
    document is one pass over its text; ties in ids cannot occur.
    """
    return order_steps(coalition_removals(mask_counts(docs, labels, part), 5), "ABCDE")
