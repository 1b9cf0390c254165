"""The corpus pipeline, and the library without it."""

import re
import subprocess
import sys

import brute
import corpus_pipeline
import duckdb
import numpy as np
from perfsnap.llm import registry
from perfsnap.session import written

SF = "/root/testdata/sf0.01"


def stages(spark, docs, sf_dir):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage")
        out.append(docs)
    return out


def test_stages_against_plain_versions(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    language, near, clean, masked, packed = stages(spark, docs, SF)
    assert all(s.columns == docs.columns for s in (language, near, clean, masked))
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {i for i, t in texts.items() if t and re.search(r"[^\W\d_]", t)}
    assert {r.doc_id for r in language.collect()} == kept
    roots = brute.shingle_components([(i, texts[i]) for i in kept], 5, 80)
    kept = {i for i, (_, root) in roots.items() if root == i}
    assert {r.doc_id for r in near.collect()} == kept
    letters = lambda t: " ".join(re.findall(r"[^\W\d_]+", (t or "").lower()))
    items = [letters(t) for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/benchmark.parquet'").fetchall()]
    kept = {i for i in kept if not any(b in letters(texts[i]) for b in items)}
    assert {r.doc_id for r in clean.collect()} == kept
    mask = lambda t: re.sub(r'(?i)(token = ")[0-9a-f]{40}(")', r"\1<secret>\2", t)
    want = {i: mask(texts[i]) for i in kept}
    assert {r.doc_id: (r.text, r.n_chars) for r in masked.collect()} == {i: (t, len(t)) for i, t in want.items()}
    library = Tokenizer.from_file(registry.tokenizer_path())
    ids = {}
    for r in sorted(packed.collect(), key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert ids == {i: library.encode(t, add_special_tokens=False).ids + [1] for i, t in want.items()}


def test_awkward_tables(spark):
    docs = brute.awkward(spark)
    out = stages(spark, docs, SF)
    assert all(s.columns == docs.columns for s in out[:4])
    assert {r.doc_id for r in out[3].collect()} == {4, 6, 8}
    assert [s.count() for s in stages(spark, brute.empty(spark), SF)] == [0] * 5


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_library_stands_without_this_package(folder):
    """The entry module imports where the package and the pipeline are missing."""
    import os
    import shutil

    root = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
    shutil.copytree(os.path.join(root, "perfsnap"), f"{folder}/perfsnap", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), folder)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op1_') or n == 'pipeline' for n in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=folder, check=True, timeout=120)
