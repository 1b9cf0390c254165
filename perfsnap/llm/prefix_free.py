"""Repeated byte strings by prefix-free parsing.

A rolling hash over 32 bytes triggers phrases: each document is cut at its
triggers, and neighbouring phrases overlap in one. A dictionary phrase's proper
suffixes end in a trigger and none is the start of another, so the order of the
corpus follows from two small orders: the one of the dictionary's phrase ends
(here read backwards from the trigger) and the one of what the parse goes on
with. Both are sorted once per shard; a string of the corpus then is a pair of
ranks, and strings equal to the wanted depth are neighbours in corpus order.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfsnap.llm.common import packed, rows_by_id, ship, unpacked
from perfsnap.llm.repeats import covered, mixed, repeated_windows

ship(sys.modules[__name__])

TRIGGER = 32
BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
FACTORS = [np.uint64(f) for f in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def byte_units(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def byte_grams(b: np.ndarray) -> np.ndarray:
    """Rolling hash of every 32 bytes, put together from halves."""
    h, width = BYTE[b], 1
    for f in FACTORS:
        h = h[:-width] * f + h[width:] if len(h) > width else h[:0]
        width *= 2
    return mixed(h)


def byte_context(b: np.ndarray, first: int, end: int) -> bytes:
    return b[first:end].tobytes()


def common_start(rows: np.ndarray) -> np.ndarray:
    """Length of the common start of each row with the one before (the first: 0)."""
    same = rows[1:] == rows[:-1]
    n = np.where(same.all(1), rows.shape[1], same.argmin(1))
    return np.concatenate(([0], n))


class Settle:
    """Which windows of a shard's contexts equal an earlier one of the shard."""

    def __init__(self, window: int):
        self.window = window

    def cut(self, context: bytes, k: int) -> bytes:
        return context[k:k + self.window]

    def __call__(self, texts: list[bytes], off: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, rows = self.window, len(texts)
        deep = w - TRIGGER + 1
        size = np.array([len(t) for t in texts])
        at = np.concatenate(([0], np.cumsum(size)[:-1])) + off
        joined = np.concatenate((np.frombuffer(b"".join(texts), np.uint8), [0])).astype(np.uint8)
        ahead = np.arange(w)
        right = np.where(ahead < (size - off)[:, None], joined[np.minimum(at[:, None] + ahead, len(joined) - 1)], 0).astype(np.uint8)
        back = np.arange(1, deep)
        left = np.where(back <= off[:, None], joined[np.maximum(at[:, None] - back, 0)], 0).astype(np.uint8)
        # order of what the parse goes on with from each trigger
        by_right = np.argsort(np.ascontiguousarray(right).view(f"S{w}").ravel(), kind="stable")
        right_common = common_start(right[by_right])
        trigger = np.empty(rows, np.int64)
        trigger[by_right] = np.cumsum(right_common < TRIGGER)
        # order of the dictionary's phrase ends, backwards from their triggers
        number = trigger.astype(">u4").view(np.uint8).reshape(rows, 4)
        ends = np.ascontiguousarray(np.hstack((number, left)))
        by_left = np.argsort(ends.view(f"S{ends.shape[1]}").ravel(), kind="stable")
        left_common = common_start(ends[by_left])
        removed = np.zeros((rows, deep), bool)
        k = np.arange(deep)
        valid = k < n[:, None]
        rank = np.empty(rows, np.int64)
        for d in range(int(off.max()) + 1 if rows else 0):
            here = np.flatnonzero((d <= off) & (d > off - n))
            if not len(here):
                continue
            rank[by_left] = np.cumsum(left_common < 4 + d)
            key = rank[here] * (rows + 1)
            rank[by_right] = np.cumsum(right_common < w - d)
            _, first = np.unique(key + rank[here], return_index=True)
            later = np.ones(len(here), bool)
            later[first] = False
            removed[here[later], off[here[later]] - d] = True
        return removed, valid


def remove_repeats(docs: DataFrame, window: int = 100, shard_rows: int = 20_000, hot: int = 500) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): every byte of a document that lies in a
    string of ``window`` bytes which also starts earlier (in a smaller id, or
    earlier in the same document) is removed; ``spans`` are the maximal removed
    runs (start, end) and ``kept`` the other bytes.

    Null text is empty; texts shorter than ``window`` are kept whole. Rows that
    repeat an id, rows without one and other columns: see ``rows_by_id``.
    Windows are judged on the input. Equal contexts are known by their anchor and
    a 64-bit digest, windows of hot anchors across shards by a 128-bit digest;
    all other contexts are compared byte by byte.
    """
    rows = rows_by_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    runs = repeated_windows(rows, byte_units, byte_grams, window - TRIGGER + 1, byte_context,
                            Settle(window), False, shard_rows, hot, 1 << 20)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    types = [pa.int64(), pa.int64(), spans_type, pa.binary()]
    names = ["doc_id", "n_bytes", "spans", "kept"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for doc, text, r in zip(b.column("doc_id").to_pylist(), b.column("z"), b.column("runs")):
                u = byte_units(unpacked(text))
                gone = covered(r.values.to_numpy() if r.is_valid else np.zeros(0, np.int64), window, len(u))
                edge = np.diff(np.pad(gone, 1).astype(np.int8))
                spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
                out.append((doc, len(u), spans, u[~gone].tobytes()))
                held += len(u) + 64
                if held > 4 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return packed(rows).join(runs, "doc_id", "left").mapInArrow(apply, "doc_id long, n_bytes long, spans array<struct<start long, end long>>, kept binary")
