"""Prefix-free parsing, FM-index and token groups against plain versions."""

import hashlib
import random

import brute
import duckdb
import numpy as np
import pytest
from perfsnap.llm import common, fm_index, prefix_free, repeats, token_groups
from perfsnap.llm import registry

SF = "/root/testdata/sf0.001"


def table_rows():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def digest(kept):
    return hashlib.sha256(kept.encode() if isinstance(kept, str) else bytes(kept)).hexdigest()


@pytest.mark.parametrize("name, plain", [("op2_prefix_free_parsing", brute.repeated_bytes), ("op3_fm_index", brute.repeated_words)])
def test_queries(spark, name, plain):
    got = {r[0]: tuple(r)[1:] for r in registry.QUERIES[name](spark, SF).collect()}
    assert got == plain(table_rows())


@pytest.mark.parametrize("module, plain, shard", [(prefix_free, brute.repeated_bytes, 300), (fm_index, brute.repeated_words, 40)])
def test_hot_anchors_in_many_shards(spark, module, plain, shard):
    docs = spark.createDataFrame(table_rows(), "doc_id long, text string").repartition(5)
    got = {r.doc_id: digest(r.kept) for r in module.remove_repeats(docs, shard_rows=shard, hot=3).collect()}
    assert got == {i: r[-1] for i, r in plain(table_rows()).items()}


@pytest.mark.parametrize("module, plain", [(prefix_free, brute.repeated_bytes), (fm_index, brute.repeated_words)])
def test_runs_and_overlaps(spark, module, plain):
    rng = random.Random(3)
    line = " ".join(rng.choice(["ab", "cde", "f", "éß", "\x00z"]) for _ in range(80))
    other = " ".join(rng.choice(["ab", "cde", "f", "éß"]) for _ in range(70))
    texts = [line, "x " * 300, line + other, other + line + other, "aaa" * 200, "x " * 120, line[20:-30], other[:99], "q" + line[:100] + "q" + line[1:101]]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: digest(r.kept) for r in module.remove_repeats(docs).collect()}
    assert got == {i: r[-1] for i, r in plain(rows).items()}


@pytest.mark.parametrize("module, plain", [(prefix_free, brute.repeated_bytes), (fm_index, brute.repeated_words)])
def test_awkward_rows(spark, module, plain):
    docs = brute.awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: digest(r.kept) for r in module.remove_repeats(docs).collect()}
    assert got == {i: r[-1] for i, r in plain(rows).items()}
    assert module.remove_repeats(brute.empty(spark)).count() == 0


def test_a_long_run_of_one_word_is_looked_at_in_small_buckets(spark):
    rows = [(0, "q " + "0 " * 55 + "r"), (1, "a " + "0 " * 3000 + "b"), (2, "c " + "0 " * 2000 + "d"), (3, "0 " * 40 + "e " + "0 " * 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = repeats.found_anchors(docs, fm_index.words_of, fm_index.word_grams, 50 - fm_index.ANCHOR + 1, 50, fm_index.word_context, True, 500, 1 << 18)
    looked = repeats.candidates(found, True, 20).where("bucket is not null").groupBy("bucket").count().collect()
    assert looked and max(r["count"] for r in looked) <= 40 and sum(r["count"] for r in looked) < 400
    got = {r.doc_id: digest(r.kept) for r in fm_index.remove_repeats(docs, shard_rows=20).collect()}
    assert got == {i: r[-1] for i, r in brute.repeated_words(rows).items()}


def test_window_anchors_cover_all_windows():
    g = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64) << np.uint64(32)
    at, first, n = repeats.window_anchors(g, 30)
    assert n.sum() == 371 and first[0] == 0
    for a, f, k in zip(at, first, n):
        for i in range(f, f + k):
            assert a == i + int(np.argmin(g[i:i + 30]))


def test_wavelet_matrix_ranks():
    s = np.random.default_rng(2).integers(0, 37, 500)
    m = fm_index.WaveletMatrix(s, 6)
    symbol, end = np.repeat(np.arange(37), 3), np.tile([0, 250, 500], 37)
    assert m.rank(symbol, end).tolist() == [int((s[:e] == c).sum()) for c, e in zip(symbol, end)]


def test_token_groups_awkward_rows(spark):
    docs = brute.awkward(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in token_groups.near_components(docs).collect()}
    assert got == brute.shingle_components(rows)
    assert token_groups.near_components(brute.empty(spark)).count() == 0


@pytest.mark.parametrize("size, percent, edits, block", [(4, 85, 6, 256), (5, 80, 9, 3)])
def test_token_groups_near_copies(spark, monkeypatch, size, percent, edits, block):
    """Chains of near copies, a hot passage in all documents, sizes around the limit;
    blocks that more sets ask for than a copy of the block serves."""
    monkeypatch.setattr(token_groups, "BLOCK", block)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, base = [word() for _ in range(40)], [word() for _ in range(150)]
    rows, chain = [], base
    for i in range(60):
        w = list(base) if i % 2 else list(chain)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = word()
        chain = w if i % 2 == 0 else chain
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(passage + [word() for _ in range(rng.randrange(12))])) for i in range(60)]
    rows += [(200 + i, " ".join([word() for _ in range(1 + i % 9)])) for i in range(30)] + [(300, rows[3][1].upper()), (301, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in token_groups.near_components(docs, size, percent).collect()}
    want = brute.shingle_components(rows, size, percent)
    assert got == want
    assert len({c for _, c in want.values()}) < len(rows) - 40


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (200, 201)]
    got = {r.node: r.root for r in common.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 1 for i in range(1, 41)} | {100: 90, 95: 90, 90: 90, 200: 200, 201: 200}
    assert {k: v for k, v in got.items()} == want
