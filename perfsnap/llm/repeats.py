"""Windows of a fixed length that occur more than once in a corpus.

Byte and word windows share this frame; they differ in how a shard of candidate
windows is settled (``prefix_free`` and ``fm_index``).

* The *anchor* of a window is its smallest short gram by a rolling hash (the
  first of equal ones). It depends on the window's content alone, so equal
  windows have equal anchors, and neighbouring windows mostly share one. The
  text of all windows that one anchor holds is its *context*.
* Anchors are counted with one small row each. A window whose anchor occurs once
  is unique. Of equal contexts all but the first are removed whole. What is left
  to look at are the firsts of anchors with several contexts.
* Those contexts are dealt to shards by anchor. An anchor with very many
  contexts is dealt to several shards of limited size; what is first within its
  shard then meets the firsts of the others by a digest of the window. Equal
  contexts of one document are looked at once.

Hot anchors never meet in one task: equal contexts are combined before the
shuffle, and an anchor with many contexts in one batch is dealt by context, with
a single row that tells the anchor's other places of it. Texts travel compressed.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfsnap.llm.common import packed, ship, unpacked
from perfsnap.session import written

ship(sys.modules[__name__])

#: hashes of the grams of a list of units, one per gram
Grams = Callable[[object], np.ndarray]
LOW = np.uint64(0xFFFFFFFF)
digest = xxhash.xxh3_64_intdigest


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def window_anchors(grams: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``span`` grams with one anchor: (anchor, first window,
    number of windows), all as positions among the grams."""
    m = len(grams) - span + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    least = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[:m], least[span - width:span - width + m])
    chosen = (least & LOW).astype(np.int64)
    first = np.concatenate(([0], np.flatnonzero(np.diff(chosen)) + 1))
    return chosen[first], first, np.diff(np.append(first, m))


def group_starts(*columns: np.ndarray) -> np.ndarray:
    """First row of each run of equal values in sorted columns."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.flatnonzero(new)


def spread_over(starts: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """A value per group as a value per row."""
    return np.repeat(values, np.diff(np.append(starts, n)))


ONE, COPY, HOT, TELL = range(4)  # kinds of anchor rows, in the last bits of their place


def found_anchors(docs: DataFrame, units: Callable, grams: Grams, span: int, window: int, context: Callable,
                  other_document: bool, hot: int, segment: int) -> DataFrame:
    """(anchor, ctx, doc_id, place, like): every anchor of every document.

    ``place`` packs the first window, the anchor's distance from it, the number
    of windows and the kind of row. Within a batch later copies of a context are
    marked COPY, and anchors with ``hot`` contexts or more HOT, with a TELL row each.
    With ``other_document`` equal contexts of one document share one verdict:
    all but the first of a batch are COPY and ``like`` is the place of the first."""

    def parts(n_units: int) -> Iterator[tuple[int, int]]:
        for s in range(0, max(0, n_units - window + 1), segment):
            yield s, min(n_units, s + segment + window - 1)

    def settle_batch(held: list) -> pa.RecordBatch:
        anchor, ctx, doc, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((place, doc, ctx, anchor))
        anchor, ctx, doc, place = (c[order] for c in (anchor, ctx, doc, place))
        same = group_starts(anchor, ctx)
        copy = np.ones(len(anchor), bool)
        if other_document:
            copy = doc > spread_over(same, doc[same], len(doc))
            each = group_starts(anchor, ctx, doc)
            like = spread_over(each, place[each], len(doc))
            again = ~copy & (like != place)
            copy |= again
        else:
            like, again = place, np.zeros(len(anchor), bool)
            copy[same] = False
        by_anchor = group_starts(anchor)
        contexts = np.add.reduceat(np.isin(np.arange(len(anchor)), same).astype(np.int64), by_anchor)
        busy = contexts >= hot
        kind = np.where(copy, COPY, np.where(spread_over(by_anchor, busy, len(anchor)), HOT, ONE))
        tell = by_anchor[busy]
        return pa.record_batch([pa.array(np.concatenate(c)) for c in (
            (anchor, anchor[tell]), (ctx, ctx[tell]), (doc, doc[tell]), (place << 2 | kind, place[tell] << 2 | TELL))]
            + [pa.array(np.append(like, like[tell]), mask=np.append(~again, np.ones(len(tell), bool)))],
            names=["anchor", "ctx", "doc_id", "place", "like"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                u = units(text.as_py())
                for s, e in parts(len(u)):
                    g = grams(u[s:e])
                    at, first, n = window_anchors(g, span)
                    ctx = [digest(context(u, f, f + k - 1 + window)) for f, k in zip((first + s).tolist(), n.tolist())]
                    place = (first + s) << 16 | (at - first) << 8 | n
                    held.append((g[at].view(np.int64), np.array(ctx, np.uint64).view(np.int64), np.full(len(at), doc, np.int64), place))
                    size += len(at)
                    if size > 200_000:
                        yield settle_batch(held)
                        held, size = [], 0
        if size:
            yield settle_batch(held)

    return docs.mapInArrow(find, "anchor long, ctx long, doc_id long, place long, like long")


def candidates(found: DataFrame, other_document: bool, shard_rows: int) -> DataFrame:
    """(doc_id, place, bucket, split, like): places to look at have a bucket, of at
    most about ``shard_rows`` rows; those with ``like`` share the verdict of that
    place; at the others all windows are removed."""
    kind = F.col("place").bitwiseAND(3)
    deal = F.when(kind == COPY, F.xxhash64("doc_id", "place")).when(kind == HOT, F.xxhash64("anchor", "ctx")).otherwise(F.col("anchor"))
    names = ["doc_id", "place", "bucket", "split", "like"]

    def whole_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            like = b.column(4)
            held.append([c.to_numpy() for c in b.columns[:4]] + [like.fill_null(-1).to_numpy()])
            size += b.num_rows
            if size >= 200_000:
                rows = [np.concatenate(c) for c in zip(*held)]
                cut = int(group_starts(rows[0])[-1])
                if cut:
                    yield [c[:cut] for c in rows]
                    held, size = [[c[cut:] for c in rows]], size - cut
        if size:
            yield [np.concatenate(c) for c in zip(*held)]

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for anchor, ctx, doc, place, like in whole_anchors(batches):
            kind = place & 3
            at = np.flatnonzero(kind == COPY)
            yield pa.record_batch([pa.array(c) for c in (doc[at], place[at] >> 2)] + [pa.nulls(len(at), pa.int64()), pa.array(np.zeros(len(at), bool)), pa.array(like[at], mask=like[at] < 0)], names=names)
            # copies are settled by their context alone; what follows needs an anchor's other contexts
            at = np.flatnonzero(kind != COPY)
            anchor, ctx, doc, place, kind = (c[at] for c in (anchor, ctx, doc, place, kind))
            if not len(at):
                continue
            n = len(anchor)
            by_anchor = group_starts(anchor)
            told = spread_over(by_anchor, np.add.reduceat((kind >= HOT).astype(np.int64), by_anchor) > 0, n)
            rows = spread_over(by_anchor, np.diff(np.append(by_anchor, n)), n)
            one_doc = spread_over(by_anchor, np.minimum.reduceat(doc, by_anchor) == np.maximum.reduceat(doc, by_anchor), n)
            same = group_starts(anchor, ctx)
            first = np.zeros(n, bool)
            first[same] = True
            several = spread_over(by_anchor, np.add.reduceat(first.astype(np.int64), by_anchor) > 1, n)
            own = kind != TELL
            if other_document:
                # a TELL row may be the first of its context only beside the row it stands for
                later = doc > spread_over(same, np.minimum.reduceat(doc, same), n)
                look = own & ~later & (told | several & ~one_doc)
            else:
                least = spread_over(same, lowest(doc, place >> 2, own, same), n)
                later = own & (np.arange(n) != least)
                look = own & ~later & (told | several)
            split = told | (rows > shard_rows)
            # the parts of a split anchor meet by window digests, so that any rows may share a bucket
            bucket, at = anchor.copy(), np.flatnonzero(look & split)
            if len(at):
                own_anchor = group_starts(anchor[at])
                rank = np.arange(len(at)) - spread_over(own_anchor, own_anchor, len(at))
                chunk = np.flatnonzero(rank % shard_rows == 0)
                key = mixed(ctx[at][chunk].view(np.uint64)) ^ mixed((doc[at][chunk] << 20 ^ place[at][chunk]).view(np.uint64))
                bucket[at] = mixed(anchor[at].view(np.uint64) ^ spread_over(chunk, key, len(at))).view(np.int64)
            gone = np.flatnonzero(own & later)
            yield pa.record_batch([pa.array(doc[gone]), pa.array(place[gone] >> 2), pa.nulls(len(gone), pa.int64()), pa.array(np.zeros(len(gone), bool)), pa.nulls(len(gone), pa.int64())], names=names)
            yield pa.record_batch([pa.array(c[look]) for c in (doc, place >> 2, bucket, split)] + [pa.nulls(int(look.sum()), pa.int64())], names=names)

    dealt = found.repartition(deal).sortWithinPartitions("anchor", "ctx", "doc_id", "place")
    return dealt.mapInArrow(choose, "doc_id long, place long, bucket long, split boolean, like long")


def lowest(doc: np.ndarray, place: np.ndarray, own: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Row of the first own (document, place) of each group of rows sorted by both."""
    n = len(doc)
    rows = np.where(own, np.arange(n), n)
    return np.minimum.reduceat(rows, starts)


def repeated_windows(docs: DataFrame, units: Callable, grams: Grams, span: int, context: Callable,
                     settle: Callable, other_document: bool, shard_rows: int, hot: int, segment: int) -> DataFrame:
    """Runs of window starts that occurred before: (doc_id, runs array<long>), a
    run being ``start * 65536 + number of windows``.

    ``docs`` is (doc_id, text), one row per id. ``units(text)`` gives what
    windows count, ``context(units, first, end)`` the bytes of a stretch of them
    and ``grams`` the hashes of the anchors' grams. ``settle(contexts, ...)``
    returns, for each window of each context, whether it is removed. Documents
    are read in segments of ``segment`` windows. With ``other_document`` only
    repeats of smaller ids count, else also earlier ones in the same document.
    """
    window = settle.window
    found = found_anchors(docs, units, grams, span, window, context, other_document, hot, segment)
    chosen = written(candidates(found, other_document, shard_rows), "candidates")
    marks = chosen.where("bucket is not null").groupBy("doc_id").agg(F.collect_list(F.struct("place", "bucket", "split")).alias("marks"))

    shape = "bucket long, split boolean, doc_id long, first long, off int, n int, context binary"
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    names = [c.split()[0] for c in shape.split(", ")]

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for b in batches:
            for doc, z, marked in zip(b.column("doc_id").to_pylist(), b.column("z"), b.column("marks")):
                u = units(unpacked(z))
                for m in marked.as_py():
                    p = m["place"]
                    first, off, n = p >> 16, p >> 8 & 255, p & 255
                    c = context(u, first, first + n - 1 + window)
                    rows.append((m["bucket"], m["split"], doc, first, off, n, c))
                    held += len(c) + 64
                    if held > 4 << 20:
                        yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)
                        rows, held = [], 0
        if rows:
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), types)], names=names)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Whole buckets, about ``shard_rows`` rows at a time."""
        rest: list[pa.RecordBatch] = []
        for b in batches:
            t = pa.Table.from_batches([*rest, b]).combine_chunks()
            starts, at = group_starts(t["bucket"].to_numpy()), 0
            while (k := int(np.searchsorted(starts, at + shard_rows))) < len(starts):
                yield t.slice(at, int(starts[k]) - at)
                at = int(starts[k])
            rest = t.slice(at).to_batches()
        if rest:
            yield pa.Table.from_batches(rest)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = ["doc_id", "first", "run", "window"]
        for t in shards(batches):
            t = t.sort_by([("doc_id", "ascending"), ("first", "ascending")])
            texts = t["context"].to_pylist()
            off, n, doc, first = (t[c].to_numpy().astype(np.int64) for c in ("off", "n", "doc_id", "first"))
            split = np.asarray(t["split"].to_pylist(), bool)
            removed, valid = settle(texts, off, n, doc)
            # runs of removed windows, row by row
            edge = np.diff(np.pad(removed & valid, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            (r, s), (_, e) = np.nonzero(edge == 1), np.nonzero(edge == -1)
            yield pa.record_batch([pa.array(doc[r]), pa.array(first[r]), pa.array(first[r] + s << 16 | e - s), pa.nulls(len(r), pa.binary())], names=out)
            r, k = np.nonzero(valid & ~removed & split[:, None])
            if len(r):
                keys = [hashlib.blake2b(settle.cut(texts[i], j), digest_size=16).digest() for i, j in zip(r.tolist(), k.tolist())]
                yield pa.record_batch([pa.array(doc[r]), pa.array(first[r]), pa.array(first[r] + k << 16 | 1), pa.array(keys, pa.binary())], names=out)

    near = packed(docs).join(marks, "doc_id").mapInArrow(contexts, shape)
    settled = written(near.repartition("bucket").sortWithinPartitions("bucket")
                      .mapInArrow(decide, "doc_id long, first long, run long, window binary"), "repeats")
    open_ = settled.where("window is not null")
    firsts = open_.groupBy("window").agg(F.min(F.struct("doc_id", "run")).alias("least"))
    here = F.struct("doc_id", "run")
    later = F.col("doc_id") > F.col("least.doc_id") if other_document else here > F.col("least")
    columns = ["doc_id", "first", "run"]
    whole = chosen.where("bucket is null and like is null").select(
        "doc_id", F.expr("shiftright(place, 16)").alias("first"), F.expr("shiftleft(shiftright(place, 16), 16) | (place & 255)").alias("run"))
    removed = whole.unionAll(settled.where("window is null").select(columns)).unionAll(open_.join(firsts, "window").where(later).select(columns))
    if other_document:
        removed = written(removed, "removed")
        alike = chosen.where("like is not null").selectExpr("doc_id", "shiftright(like, 16) AS first", "shiftright(place, 16) AS here")
        moved = alike.join(removed, ["doc_id", "first"]).select("doc_id", "first", (F.col("run") + F.expr("shiftleft(here - first, 16)")).alias("run"))
        removed = removed.unionAll(moved)
    return removed.groupBy("doc_id").agg(F.collect_list("run").alias("runs"))


def covered(runs: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of ``n`` units lie in a removed window."""
    step = np.zeros(n + 1, np.int64)
    if len(runs):
        start, count = runs >> 16, runs & 0xFFFF
        np.add.at(step, start, 1)
        np.add.at(step, start + count - 1 + window, -1)
    return np.cumsum(step[:-1]) > 0
