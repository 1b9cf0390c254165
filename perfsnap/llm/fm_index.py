"""Repeated word windows by backward search in compressed FM-indexes.

Each shard of candidate contexts gets an FM-index: the Burrows-Wheeler
transform of its words in a wavelet matrix, one bit per word and level. The
shard's documents are streamed through it from their ends; the state is the
range of suffixes that begin with the words read, cut to the window's length.
Wherever the matched length reaches the window, the range holds all documents
with that window, and the smallest of them decides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfsnap.llm.common import packed, rows_by_id, ship, unpacked
from perfsnap.llm.repeats import covered, mixed, repeated_windows

ship(sys.modules[__name__])

ANCHOR = 12


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the whole text, as UTF-8."""
    return (text or "").encode().split()


def word_grams(words: list[bytes]) -> np.ndarray:
    """Hash of every 12 words."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < ANCHOR:
        return h[:0]
    two = h[:-1] * np.uint64(0xA0761D6478BD642F) + h[1:]
    four = two[:-2] * np.uint64(0xE7037ED1A0B428DB) + two[2:]
    return mixed((four[:-8] * np.uint64(0x8EBC6AF09C88C6E3) + four[4:-4]) * np.uint64(0x589965CC75374CC3) + four[8:])


def word_context(words: list[bytes], first: int, end: int) -> bytes:
    return b" ".join(words[first:end])


class WaveletMatrix:
    """Ranks of symbols in a text, with one bit vector per bit of a symbol."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for shift in range(bits - 1, -1, -1):
            bit = (symbols >> shift) & 1
            ones = np.concatenate(([0], np.cumsum(bit))).astype(np.int32)
            zeros = len(symbols) - int(ones[-1])
            self.levels.append((shift, ones, zeros))
            symbols = np.concatenate((symbols[bit == 0], symbols[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        start = np.zeros_like(end)
        for shift, ones, zeros in self.levels:
            bit = ((symbol >> shift) & 1).astype(bool)
            s, e = ones[start], ones[end]
            start = np.where(bit, zeros + s, start - s)
            end = np.where(bit, zeros + e, end - e)
        return end - start


class Index:
    """FM-index of word sequences for patterns of at most ``window`` words.

    ``symbols`` are the sequences one after another, each followed by a 0.
    Suffixes are sorted by doubling to a depth of at least ``window`` words,
    which is all that such patterns need."""

    def __init__(self, symbols: np.ndarray, owner: np.ndarray, window: int):
        n, ranks, depth = len(symbols), symbols.astype(np.int64), 1
        steps = {1: symbols}
        while depth < window:
            after = np.concatenate((ranks[depth:], np.zeros(min(depth, n), np.int64)))[:n]
            _, ranks = np.unique(ranks * (int(ranks.max()) + 1) + after, return_inverse=True)
            depth *= 2
            steps = {d: s for d, s in steps.items() if 2 * d >= depth} | {depth: ranks.astype(np.int32)}
        order = np.argsort(ranks, kind="stable")
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(symbols)))).astype(np.int32)
        self.matrix = WaveletMatrix(symbols[order - 1], max(1, int(symbols.max()).bit_length()))
        self.run_start, self.run_end = self._runs(steps, order, window - 1)
        full, _ = self._runs(steps, order, window)
        firsts = np.unique(full)
        self.least = np.repeat(np.minimum.reduceat(owner[order], firsts), np.diff(np.append(firsts, n)))
        self.size = n

    @staticmethod
    def _runs(steps: dict[int, np.ndarray], order: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last row of the suffixes that share ``depth`` words with each row."""
        half = max(d for d in steps if d <= depth)
        a = steps[half]
        b = np.concatenate((a[depth - half:], np.full(depth - half, -1)))[:len(a)]
        a, b = a[order], b[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        return first[run].astype(np.int32), np.append(first[1:], len(a))[run].astype(np.int32)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges after one more word in front."""
        base = self.starts[symbol]
        return base + self.matrix.rank(symbol, low), base + self.matrix.rank(symbol, high)


class Settle:
    """Which windows of a shard's contexts occur in a smaller document of the shard."""

    def __init__(self, window: int):
        self.window = window

    def cut(self, context: bytes, k: int) -> bytes:
        return b" ".join(context.split(b" ")[k:k + self.window])

    def __call__(self, texts: list[bytes], off: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, number = self.window, {}
        symbols, size = [], n - 1 + w
        for t in texts:
            symbols += [number.setdefault(word, len(number) + 1) for word in t.split(b" ")]
            symbols.append(0)
        text = np.array(symbols, np.int32)
        end = np.cumsum(size + 1) - 1  # where each context's 0 stands
        index = Index(text, np.repeat(doc, size + 1), w)
        wide = int(n.max())
        removed = np.zeros((len(texts), wide), bool)
        low, high = np.zeros(len(texts), np.int32), np.full(len(texts), index.size, np.int32)
        active = np.arange(len(texts))
        for step in range(1, int(size.max()) + 1):
            keep = size[active] >= step
            active, low, high = active[keep], low[keep], high[keep]
            if step > w:  # drop the last word of the match
                low, high = index.run_start[low], index.run_end[low]
            low, high = index.extend(text[end[active] - step], low, high)
            if step >= w:
                removed[active, size[active] - step] = index.least[low] < doc[active]
        return removed, np.arange(wide) < n[:, None]


def remove_repeats(docs: DataFrame, window: int = 50, shard_rows: int = 3_000, hot: int = 500) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept): every word that lies in a
    window of ``window`` words which also starts in a document with a smaller id
    is removed; ``spans`` are the maximal removed runs (start, end) in words and
    ``kept`` the other words, joined by one space.

    Null text has no words; texts with fewer words than a window stay whole.
    Repeats within one document stay. Rows that repeat an id, rows without one
    and other columns: see ``rows_by_id``. Windows are judged on the input.
    """
    rows = rows_by_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    runs = repeated_windows(rows, words_of, word_grams, window - ANCHOR + 1, word_context,
                            Settle(window), True, shard_rows, hot, 1 << 18)
    types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
    names = ["doc_id", "n_words", "n_removed", "spans", "kept"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, held = [], 0
            for doc, text, r in zip(b.column("doc_id").to_pylist(), b.column("z"), b.column("runs")):
                u = words_of(unpacked(text))
                kept, spans, n = u, [], len(u)
                if r.is_valid:
                    gone = covered(r.values.to_numpy(), window, n)
                    edge = np.diff(np.pad(gone, 1).astype(np.int8))
                    spans = [{"start": s, "end": e} for s, e in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())]
                    kept = [u[i] for i in np.flatnonzero(~gone).tolist()]
                kept_text = b" ".join(kept)
                out.append((doc, n, n - len(kept), spans, kept_text.decode()))
                held += len(kept_text) + 64
                if held > 4 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out, held = [], 0
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return packed(rows).join(runs, "doc_id", "left").mapInArrow(
        apply, "doc_id long, n_words long, n_removed long, spans array<struct<start long, end long>>, kept string")
