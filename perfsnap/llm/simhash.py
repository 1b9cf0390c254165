"""SimHash fingerprints: 64 bits that weighted term hashes vote on.

DataFrame functions only. Terms are words in lower case; a word votes with the
square of its length (16 letters at most), so that common short words say
little. Each bit's votes are summed over the exploded words.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfsnap.llm.common import rows_by_id
from perfsnap.session import written

BITS = 64
LONGEST = 16


def fingerprints(texts: DataFrame, key: list[str], text: str) -> DataFrame:
    """(*key, fingerprint): bit i is set if the words whose hash has bit i weigh
    more than the others. Null texts and texts without words have fingerprint 0.
    Rows that are already dealt by a column of the key are not shuffled again.

    Two bits share a sum (its halves); words are counted in pieces of a
    document, so that halves never overflow, whatever a text's length."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+")
    terms = texts.select(*key, F.posexplode_outer(words).alias("pos", "word"))
    w = F.least(F.length("word"), F.lit(LONGEST)).cast("long")
    terms = terms.select(*key, F.shiftright("pos", 20).alias("piece"), F.xxhash64("word").alias("h"), (w * w).alias("w"))
    bit = lambda i: F.shiftright("h", i).bitwiseAND(F.lit(1))
    half = BITS // 2
    pairs = [F.sum((bit(i) + F.shiftleft(bit(i + half), 32)) * F.col("w")).alias(f"s{i}") for i in range(half)]
    pieces = terms.groupBy(*key, "piece").agg(F.sum("w").alias("w"), *pairs)
    low = lambda i: F.sum(F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"b{i}")
    high = lambda i: F.sum(F.shiftright(f"s{i}", 32)).alias(f"b{i + half}")
    votes = pieces.groupBy(*key).agg(F.sum("w").alias("w"), *[f(i) for i in range(half) for f in (low, high)])
    set_bits = [F.when(F.col(f"b{i}") * 2 > F.col("w"), F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)).cast("long") for i in range(BITS)]
    return votes.select(*key, reduce(Column.bitwiseOR, set_bits).alias("fingerprint"))


def distance(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column | str, b: Column | str) -> Column:
    """Share of equal bits, 0 to 1."""
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def as_text(fingerprint: str) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), 16, "0")


def block_masks(radius: int, blocks: int) -> list[int]:
    """The bits that each table compares, as signed numbers.

    The bits are cut into ``blocks``. Fingerprints within the radius agree in at
    least ``blocks - radius`` of them, so each choice of that many blocks is a
    table whose key is the permuted start of the fingerprint, and every pair
    meets in one."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("0 <= radius < blocks <= 64")
    edge = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (e - s)) - 1) << s for s, e in zip(edge, edge[1:])]
    signed = lambda m: m - (1 << BITS) if m >> (BITS - 1) else m
    return [signed(sum(parts[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]


def block_tables(prints: DataFrame, masks: list[int]) -> DataFrame:
    """The rows of ``prints`` once a table, with ``t`` and the hash ``k`` of table
    and key."""
    keys = [F.xxhash64(F.lit(t), F.col("fingerprint").bitwiseAND(F.lit(m).cast("long"))) for t, m in enumerate(masks)]
    return prints.select("*", F.posexplode(F.array(*keys)).alias("t", "k"))


def meeting(a: str, b: str, t: str, masks: list[int], radius: int) -> Column:
    """Whether two fingerprints are within the radius and ``t`` is the first table
    in which they meet, so that each pair counts in one table."""
    apart = F.col(a).bitwiseXOR(F.col(b))
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(i)) for i, m in enumerate(masks)])
    return (F.bit_count(apart) <= radius) & (first == F.col(t))


def near_fingerprints(prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """Pairs (a, b, distance) of different fingerprints at most ``radius`` bits
    apart, a < b; ``prints`` has a column ``fingerprint``.

    Equal fingerprints are one row, null ones none; nothing is capped. A fingerprint
    has at most as many partners as there are numbers within the radius.
    """
    masks = block_masks(radius, blocks)
    one = prints.select("fingerprint").where("fingerprint is not null").distinct()
    rows = written(block_tables(one, masks), "blocks")
    left = rows.select(F.col("fingerprint").alias("a"), "t", "k")
    right = rows.select(F.col("fingerprint").alias("b"), "t", "k")
    near = left.join(right, ["t", "k"]).where(F.col("a") < F.col("b")).where(meeting("a", "b", "t", masks, radius))
    return near.select("a", "b", distance("a", "b").cast("int").alias("distance"))


def near_documents(prints: DataFrame, asks: Column, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(doc_id, near_documents, near_id) for the rows of ``prints`` (doc_id,
    fingerprint) that ``asks`` is true for: how many other rows have a fingerprint
    at most ``radius`` bits away, and the smallest id among these and its own.

    Every fingerprint is in the tables, in as many rows as it has tables, whatever
    the number of its copies: equal ones are counted first. Sums combine before the
    shuffle and pairs are never stored. Rows without a fingerprint have no answer;
    rows that repeat an id count as often as they occur, and are answered as often.
    """
    masks = block_masks(radius, blocks)
    asked = F.coalesce(asks, F.lit(False))
    known = prints.where("fingerprint is not null")
    one = written(known.groupBy("fingerprint").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least"), F.max(asked).alias("asks")), "kinds")
    queries = block_tables(one.where("asks").select("fingerprint"), masks).withColumnRenamed("fingerprint", "a")
    near = queries.join(block_tables(one.drop("asks"), masks), ["t", "k"]).where(meeting("a", "fingerprint", "t", masks, radius))
    found = near.groupBy("a").agg((F.sum("n") - 1).alias("near_documents"), F.min("least").alias("near_id"))
    return known.where(asked).select("doc_id", F.col("fingerprint").alias("a")).join(found, "a").drop("a")


def next_ids(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) by ascending id; the last is followed by the first.

    Ids are dealt to ranges once; each range is numbered on its own and its last
    row takes the first id of the next range, from a table of one row a range."""
    ranged = written(ids.select("doc_id").repartitionByRange("doc_id").select("doc_id", F.spark_partition_id().alias("part")), "ranges")
    firsts = ranged.groupBy("part").agg(F.min("doc_id").alias("first"))
    order = Window.orderBy("part")
    follow = firsts.select("part", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("then"))
    own = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("n", own).join(follow, "part").select("doc_id", F.coalesce("n", "then").alias("next_id"))


def edited_by_next(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, n_chars, text, edited): the last half of each text (its
    length in code points, rounded down) replaced by the first as many (or all)
    of the next document. ``docs`` is (doc_id, text) with one row per id."""
    follow = written(next_ids(docs), "next")
    wants = docs.select("doc_id", F.length("text").alias("n")).join(follow, "doc_id").select(
        F.col("doc_id").alias("of"), F.col("next_id").alias("doc_id"), F.shiftright("n", 1).alias("k"))
    pieces = docs.join(wants, "doc_id").select(F.col("of").alias("doc_id"), F.col("doc_id").alias("next_id"), F.expr("substring(text, 1, k)").alias("piece"))
    n = F.length("text")
    kept = F.expr("substring(text, 1, length(text) - shiftright(length(text), 1))")
    return docs.join(pieces, "doc_id").select("doc_id", "next_id", n.cast("long").alias("n_chars"), "text", F.concat(kept, "piece").alias("edited"))


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edits, and how alike they are:
    (doc_id, next_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next).

    Null text is empty. Rows that repeat an id, rows without one and other
    columns: see ``rows_by_id``. A single document is its own next one.
    """
    rows = rows_by_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    both = edited_by_next(rows)
    version = lambda name, own: F.struct(F.lit(own).alias("own"), F.col(name).alias("body"))
    doc = ["doc_id", "next_id", "n_chars", "sha"]
    texts = both.withColumn("sha", F.sha2(F.col("edited").cast("binary"), 256)).select(
        *doc, F.explode(F.array(version("text", True), version("edited", False))).alias("v"))
    prints = fingerprints(texts.select(*doc, "v.own", "v.body"), [*doc, "own"], "body")
    value = lambda own: F.max(F.when(F.col("own") == own, F.col("fingerprint")))
    wide = written(prints.groupBy(*doc).agg(value(True).alias("f"), value(False).alias("e")), "prints")
    after = wide.select(F.col("doc_id").alias("next_id"), F.col("f").alias("g"))
    return wide.join(after, "next_id").select(
        "doc_id", "next_id", "n_chars", F.col("sha").alias("edited_sha256"), F.col("f").alias("fingerprint"), F.col("e").alias("edited_fingerprint"),
        likeness("f", "e").alias("near_edited"), likeness("f", "g").alias("near_next"))
