"""Documents whose shingle sets overlap: an exact Jaccard join over a token-group matrix.

1. Equal sets are one class, whatever the number of copies.
2. Sets that cannot have a partner leave early. Tokens are ordered by hash, and
   linked sets share a known number of the first ones; a set with fewer shared
   tokens than that has no link. What stays is counted on all tokens: a link
   needs 85 % of a set's tokens elsewhere.
3. The rest is partitioned into groups of similar sets: a few rounds link sets
   with equal smallest tokens, in chunks of bounded size, and go on with one
   set of each linked group, so that thousands of near copies shrink fast.
4. The token-group matrix holds the union of each group's tokens, a row for each
   token and group. A set asks it with so many of its rarest tokens that every
   partner must have one. Groups found that way are opened in blocks: first the
   overlap with the block's token union bounds what any member can reach, and
   only blocks that pass are compared member by member, up to the first link.

Groups are connected, so one link to a group is all that components need.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfsnap.llm.common import connected, rows_by_id, ship, short_batches
from perfsnap.session import written

ship(sys.modules[__name__])

FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
ROUNDS = 3
BLOCK = 256


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of ``size`` words: A-Z in
    lower case, words ``[^\\x20\\x09-\\x0D]+``; fewer words are one shingle."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    n = len(h) - size + 1
    g = h[:n] * FACTORS[0]
    for k in range(1, size):
        g = (g ^ (g >> np.uint64(29))) * FACTORS[1 + k % 4] + h[k:k + n]
    g = (g ^ (g >> np.uint64(32))) * FACTORS[0]
    return np.unique(g ^ (g >> np.uint64(29)))


class Measure:
    """What a link of at least ``percent`` % asks of sets of n tokens."""

    def __init__(self, percent: int):
        self.percent = percent

    def needed(self, n):
        """Least overlap with any partner."""
        return (self.percent * n + 99) // 100

    def extra(self, n):
        return 1 + 7 * n // 100

    def head(self, n):
        """So many first tokens, in any order common to all sets ..."""
        return n - self.needed(n) + self.extra(n)

    def shared(self, n):
        """... hold so many in common with any partner's first ones."""
        return self.extra(self.needed(n))

    def column(self, rule: str, n: str):
        """The same rules as columns."""
        need = lambda c: f"((({self.percent} * {c}) + 99) div 100)"
        return F.expr(need(n) if rule == "needed" else f"1 + (7 * {need(n)}) div 100")

    def linked(self, a: np.ndarray, b: np.ndarray) -> bool:
        small, large = sorted((len(a), len(b)))
        if 100 * small < self.percent * large:
            return False
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)


def _batches(rows: Iterator[tuple], types: list, names: list[str], size: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += size(r)
        if n > 4 << 20:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, n = [], 0
    if held:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def class_heads(docs: DataFrame, size: int, measure: Measure) -> DataFrame:
    """(doc_id, n, class, head): set size, digest of the set, first tokens by hash."""
    types, names = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())], ["doc_id", "n", "class", "head"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                    s = shingles(text.as_py(), size)
                    yield doc, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), s[:measure.head(len(s))].view(np.int64)

        yield from _batches(rows(), types, names, lambda r: 8 * len(r[3]) + 64)

    return docs.mapInArrow(build, "doc_id long, n long, class binary, head array<long>")


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """(rep, n, tokens, keys): whole sorted sets as packed 64-bit numbers, and the
    smallest token under each round's order; ``docs`` is (doc_id, text)."""
    types, names = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())], ["rep", "n", "tokens", "keys"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    s = shingles(text.as_py(), size)
                    keys = np.array([(s * f ^ (s * f >> np.uint64(31))).min() for f in FACTORS[:ROUNDS]])
                    yield doc, len(s), s.tobytes(), keys.view(np.int64)

        yield from _batches(rows(), types, names, lambda r: len(r[2]) + 64)

    return docs.mapInArrow(build, "rep long, n long, tokens binary, keys array<long>")


def exploded(sets: DataFrame) -> DataFrame:
    """(token, rep, n) of whole sets."""
    names = ["token", "rep", "n"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, size = [], 0
            for rep, n, tokens in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                held.append((np.frombuffer(tokens.as_py(), np.int64), np.full(n, rep), np.full(n, n)))
                size += n
                if size > 100_000:
                    yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)
                    held, size = [], 0
            if held:
                yield pa.record_batch([pa.array(np.concatenate(c)) for c in zip(*held)], names=names)

    return sets.select("rep", "n", "tokens").mapInArrow(spread, "token long, rep long, n long")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """Adds ``df``, the sets that have a token, and keeps tokens of two or more."""
    df = written(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
    return tokens.join(df, "token")


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[Iterator[dict]]:
    """Rows of sorted batches, group by group, one at a time; few at once as Python values."""
    from itertools import groupby

    rows = (r for b in batches for at in range(0, b.num_rows, 256) for r in b.slice(at, 256).to_pylist())
    for _, group in groupby(rows, lambda r: r[key]):
        yield group


def link_round(leaders: DataFrame, number: int, measure: Measure) -> DataFrame:
    """Links (a, b) of sets to earlier ones with the same smallest token, chunk by chunk.

    Sets with the fewest tokens of their own come first: in a group of near
    copies these are closest to the text that all were made from, so most link to one."""
    keyed = leaders.withColumn("key", F.col("keys")[number])
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    chunk = F.xxhash64("key", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK).cast("long")))
    dealt = keyed.join(written(sizes, "sizes"), "key").select(chunk.alias("chunk"), "own", "rep", "tokens")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "chunk"):
            kept, links = [], []
            for r in group:
                s = np.frombuffer(r["tokens"], np.uint64)
                to = next((rep for rep, t in kept if measure.linked(s, t)), None)
                if to is None:
                    kept.append((r["rep"], s))
                else:
                    links.append((r["rep"], to))
            if links:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    return dealt.repartition("chunk").sortWithinPartitions("chunk", "own", "rep").mapInArrow(link, "a long, b long")


def open_groups(asked: DataFrame, members: DataFrame, sets: DataFrame, measure: Measure) -> DataFrame:
    """Links (a, b) between sets and the groups they asked for.

    ``asked`` is (rep, grp), ``members`` (rep, grp, block). A block that many sets
    ask for is copied, once for each ``BLOCK`` of them, so a task holds at most one
    block and compares as many sets with it."""
    blocks = members.select("grp", "block").distinct()
    tokens = sets.select("rep", "tokens")
    asks = written(asked.join(blocks, "grp").select("block", "rep"), "asks")
    copies = written(asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("copies")), "copies")
    queries = asks.join(copies, "block").select(F.xxhash64("block", F.pmod(F.xxhash64("rep"), "copies")).alias("chunk"), "rep")
    queries = queries.join(tokens, "rep").select("chunk", F.lit(1).alias("asks"), "rep", "tokens")
    opened = members.join(copies, "block").select("block", "rep", F.explode(F.expr("sequence(0L, copies - 1)")).alias("copy"))
    opened = opened.select(F.xxhash64("block", "copy").alias("chunk"), "rep").join(tokens, "rep").select("chunk", F.lit(0).alias("asks"), "rep", "tokens")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, "chunk"):
            own, union, links = [], None, []
            for r in group:
                s = np.frombuffer(r["tokens"], np.uint64)
                if not r["asks"]:
                    own.append((r["rep"], s))
                    continue
                if union is None:
                    union = np.unique(np.concatenate([t for _, t in own]))
                # the overlap with the union bounds that with any member
                if len(np.intersect1d(s, union, assume_unique=True)) < measure.needed(len(s)):
                    continue
                to = next((rep for rep, t in own if measure.linked(s, t)), None)
                if to is not None:
                    links.append((r["rep"], to))
            if links:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*links)], names=["a", "b"])

    rows = opened.unionAll(queries).repartition("chunk").sortWithinPartitions("chunk", "asks", "rep")
    return rows.mapInArrow(compare, "a long, b long")


def near_components(docs: DataFrame, size: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id): documents link when their sets of
    ``size``-word shingles have a Jaccard similarity of ``percent`` % or more;
    the component is named by the smallest id that links reach.

    Documents without words are linked with nothing. All links count; hot tokens
    and groups of copies lose none. Rows that repeat an id, rows without one and
    other columns: see ``rows_by_id``.
    """
    with short_batches(docs.sparkSession):
        measure = Measure(percent)
        rows = rows_by_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        heads = written(class_heads(rows, size, measure), "heads")
        classes = written(heads.where("n > 0").groupBy("class", "n").agg(F.min("doc_id").alias("rep"), F.any_value("head").alias("head")), "classes")
        first = classes.select("rep", "n", F.explode("head").alias("token"))
        seen = shared_tokens(first).groupBy("rep", "n").agg(F.count(F.lit(1)).alias("s"))
        near = written(seen.where(F.col("s") >= measure.column("shared", "n")).select(F.col("rep").alias("doc_id")), "near")
        sets = written(full_sets(rows.join(near, "doc_id", "left_semi"), size), "sets")
        tokens = written(shared_tokens(exploded(sets)), "tokens")
        enough = tokens.groupBy("rep", "n").agg(F.count(F.lit(1)).alias("s")).where(F.col("s") >= measure.column("needed", "n"))
        enough = written(enough.select("rep", "s", (F.col("n") - F.col("s")).alias("own")), "enough")
        sets = sets.join(enough.select("rep", "own"), "rep")

        links, leaders = [], sets
        groups = enough.select("rep", F.col("rep").alias("grp"))
        for number in range(ROUNDS):
            found = written(link_round(leaders, number, measure), "links")
            links.append(found)
            groups = groups.join(found.select(F.col("a").alias("grp"), F.col("b").alias("to")), "grp", "left").select("rep", F.coalesce("to", "grp").alias("grp"))
            leaders = leaders.join(found.select(F.col("a").alias("rep")), "rep", "left_anti")
        sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
        block = F.xxhash64("grp", F.pmod(F.xxhash64("rep"), F.ceil(F.col("size") / BLOCK).cast("long")))
        members = written(groups.join(sizes, "grp").select("rep", "grp", block.alias("block")), "groups")

        # Sets in one order of tokens, rarest first. Of linked sets with an overlap of t
        # tokens, s of them shared at all, the first s - t + 1 on both sides meet.
        mine = tokens.join(members.select("rep", "grp"), "rep").join(enough.select("rep", "s"), "rep")
        ordered = mine.groupBy("rep", "n", "s", "grp").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
        rarest = F.slice("t", F.lit(1), (F.col("s") - measure.column("needed", "n") + 1).cast("int"))
        heads_of = ordered.select("rep", "n", "s", "grp", F.posexplode(rarest).alias("pos", "t"))
        firsts = written(heads_of.select("rep", "n", "grp", "t.token", (F.col("s") - F.col("pos")).alias("reach")), "firsts")
        matrix = written(firsts.groupBy("token", F.col("grp").alias("to")).agg(
            F.min("n").alias("least"), F.max("n").alias("most"), F.max("reach").alias("their_reach")), "matrix")
        overlap = F.ceil((F.col("n") + F.greatest("least", measure.column("needed", "n"))) * percent / (100 + percent))
        asked = firsts.join(matrix, "token").where(
            F.expr(f"to < grp and 100 * n >= {percent} * least and 100 * most >= {percent} * n") & (F.least("reach", "their_reach") >= overlap)
        ).select("rep", F.col("to").alias("grp")).distinct()
        links.append(written(open_groups(written(asked, "asked"), members, sets, measure), "links"))

    roots = connected(reduce(DataFrame.unionAll, links))
    named = classes.join(roots, F.col("rep") == F.col("node"), "left").select("class", F.coalesce("root", "rep").alias("root"))
    return heads.select("doc_id", "n", "class").join(written(named, "roots"), "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
