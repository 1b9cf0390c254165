"""Documents as token ids, packed into sequences of bounded length.

Documents are cut into whole sequences and one rest each. The rests are dealt
at random into groups of a bounded number of documents, and each group packs
its rests on its own: first fit, longest first, with the free room of all bins
in a tournament tree.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfsnap.llm.common import rows_by_id, ship

ship(sys.modules[__name__])

END_ID = 1
CACHED_WORDS = 200_000

# Fixed value: how the byte-level vocabulary splits text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# A space beside other white space, or at an end, does not start a word of its own.
UNEVEN = re.compile(r"\s |[ ]\s|\A |[ ]\Z")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: visible Latin-1
    characters stand for themselves, all others for 256 and up."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Ids of a byte-level vocabulary file as packed little-endian bytes.

    The ids are those the ``tokenizers`` library gives for the file. Words
    between single spaces never merge with each other, so their ids are kept in
    a bounded table; the merges themselves are done by ``tiktoken`` with the
    vocabulary of the same file. Texts that spell a special token go through
    ``tokenizers`` whole.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.library = Tokenizer.from_file(path)
        letters = byte_alphabet()
        ranks = {
            bytes(letters[c] for c in token): i
            for token, i in spec["model"]["vocab"].items() if token not in self.special
        }
        self.merges = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.words: dict[str, bytes] = {}

    def _ids(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.merges.encode_ordinary(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        import numpy as np

        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if UNEVEN.search(text):
            return self._ids(text)
        words, out = self.words, []
        first, *rest = text.split(" ")
        if len(words) > CACHED_WORDS:
            words.clear()
        for w in rest:
            got = words.get(w)
            if got is None:
                got = self._ids(" " + w)
                if len(w) < 64:
                    words[w] = got
            out.append(got)
        return self._ids(first) + b"".join(out)


PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = END_ID) -> DataFrame:
    """Every document's ids with the closing id, cut into pieces of at most
    ``capacity``: (doc_id, start, length, doc_tokens, ids as little-endian bytes).

    Null text is empty and gives the closing id alone. Repeated and id-less rows
    as in ``rows_by_id``. An empty table gives no rows.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                            ("doc_tokens", pa.int64()), ("ids", pa.binary())])
        encoder, step, end = None, 4 * capacity, end_id.to_bytes(4, "little")
        for batch in batches:
            encoder = encoder or Encoder(tokenizer)
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                ids = encoder.encode(text.as_py() or "") + end
                n, doc = len(ids) // 4, doc.as_py()
                rows += [(doc, i // 4, len(ids[i:i + step]) // 4, n, ids[i:i + step]) for i in range(0, len(ids), step)]
                held += len(ids)
                if held > 8 << 20:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    rows = rows_by_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, PIECES)


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """Bin and offset of each length, placed in the order given into the first
    bin with room. The tree's leaves hold the free room of bins, its inner nodes
    the larger of their children, so a walk from the root finds the leftmost bin."""
    size = 1
    while size < len(lengths):
        size *= 2
    tree = [capacity] * (2 * size)
    placed = []
    for need in lengths:
        node = 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        placed.append((node - size, capacity - tree[node]))
        tree[node] -= need
        while node > 1:
            node //= 2
            tree[node] = max(tree[2 * node], tree[2 * node + 1])
    return placed


def pack(pieces: DataFrame, groups: int, capacity: int = 2048, seed: int = 7) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces (doc_id, start, length, ...).

    A piece as long as a sequence is one by itself. The others are packed in
    ``groups`` groups, to which documents are dealt by a seeded hash of their
    id; equal lengths are placed by id. Sequence ids are the group times 2^32
    plus the number within it. Other columns are carried along.
    """
    place = "_group int"

    def fill(table: pa.Table) -> pa.Table:
        g = table["_group"][0].as_py()
        length, doc, start = (table[c].to_pylist() for c in ("length", "doc_id", "start"))
        rests = sorted((i for i, n in enumerate(length) if n < capacity), key=lambda i: (-length[i], doc[i], start[i]))
        spots = first_fit([length[i] for i in rests], capacity)
        bins = [0] * len(length)
        offset = [0] * len(length)
        for i, (b, o) in zip(rests, spots):
            bins[i], offset[i] = b, o
        n = 1 + max((b for b, _ in spots), default=-1)
        for i in sorted((i for i, k in enumerate(length) if k >= capacity), key=lambda i: (doc[i], start[i])):
            bins[i], n = n, n + 1
        return (table.drop_columns(["_group"])
                .append_column("sequence_id", pa.array([(g << 32) + b for b in bins], pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    dealt = pieces.withColumn(place.split()[0], F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(groups)).cast("int"))
    out = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("_group").applyInArrow(fill, out)


def group_count(docs: DataFrame, group_docs: int) -> int:
    """Groups of about ``group_docs`` documents each."""
    return max(1, -(-docs.count() // group_docs))
