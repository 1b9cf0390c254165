"""URL verdicts from rules, and from the words of host and path where no rule holds."""

from __future__ import annotations

import math
import re
import sys
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perfsnap.llm.common import rows_by_id, ship
from perfsnap.session import written

ship(sys.modules[__name__])

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LONGEST_WORD = 24
# Labelled examples of host and path words, as a filter list would name them.
BLOCK_EXAMPLES = """cheap pills, online casino, free bets, ads track, spam farm, viagra shop, adult cams, payday loans,
replica watches, slots jackpot, poker bonus, click tracker, banner ads, popup ads, malware download, phishing login,
crack keygen, warez torrent, porn video, escort dating, weight loss pills, bitcoin doubler, lottery winner, link farm,
casino win, win prizes, hot singles, free gift cards"""
ALLOW_EXAMPLES = """news article, blog post, wiki encyclopedia, docs library, science journal, school university,
city council, weather report, recipe kitchen, museum history, health clinic, travel guide, music review, sports results,
open source, public records, book store, local radio, garden club, family photos, help center, developer forum,
research institute, language course, www index page, mobile site, example home, about contact, archive year, tag topic"""


def url_parts(pages: DataFrame) -> DataFrame:
    """(page_id, host, path): the host follows the first ``://`` and is lower-cased
    (A-Z); the path ends before ``?`` or ``#``. Null or no ``://``: both empty."""
    rows = rows_by_id(pages, "page_id", "url")
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    part = lambda i: F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)([^?#]*)", i)
    return rows.select("page_id", F.translate(part(1), UPPER, LOWER).alias("host"), part(2).alias("path"))


def matching_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, rule, verdict) of the longest rule that holds for each url.

    ``rules`` has host, path and verdict. A rule holds for its host and all
    subdomains if the path starts with its path; equal lengths: the smaller
    rule, and allow before block. Hosts are matched by a join over their
    suffixes, so the list of rules may be long.
    """
    labels = F.split("host", r"\.", -1)
    suffix = F.expr("transform(sequence(1, size(_l)), i -> array_join(slice(_l, i, size(_l)), '.'))")
    ends = urls.withColumn("_l", labels).select("page_id", "path", F.explode(suffix).alias("_host"))
    r = rules.select(F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("verdict").alias("_verdict"))
    held = ends.join(r, "_host").where(F.startswith("path", "_path"))
    rule = F.concat("_host", "_path")
    best = held.groupBy("page_id").agg(F.min(F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), F.col("_verdict").alias("verdict"))).alias("b"))
    return best.select("page_id", "b.rule", "b.verdict")


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(w, n): counts of all words (letters of any script, at most 24) over whole
    texts without their tags."""
    plain = F.lower(F.regexp_replace(F.col(column).cast("string"), r"<[^<>]*>", " "))
    words = texts.select(F.explode_outer(F.split(plain, r"[^\p{L}]+")).alias("w"))
    return words.where(f"w <> '' and length(w) <= {LONGEST_WORD}").groupBy("w").agg(F.count(F.lit(1)).alias("n"))


class Segmenter:
    """Splits a run of letters into the likeliest words of a unigram model.

    Letters outside the model cost as much as a rare word of their length, so
    unknown runs stay whole rather than fall into letters."""

    def __init__(self, counts: dict[str, int], total: int | None = None):
        """``total`` is the sum of all counts if ``counts`` are a part of them."""
        weight = math.log(total or sum(counts.values()) or 1)
        self.cost = {w: weight - math.log(n) for w, n in counts.items()}
        self.unknown = weight + math.log(10)
        self.seen: dict[str, list[str]] = {}

    def words(self, run: str) -> list[str]:
        got = self.seen.get(run)
        if got is None:
            got = self.split(run)
            if len(self.seen) < 100_000 and len(run) <= 256:
                self.seen[run] = got
        return got

    def split(self, run: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(run) + 1):
            options = []
            for start in range(max(0, end - LONGEST_WORD), end):
                w = run[start:end]
                options.append((best[start] + self.cost.get(w, self.unknown + 2.0 * len(w)), -start))
            cost, start = min(options)
            best.append(cost)
            back.append(-start)
        out, end = [], len(run)
        while end:
            out.append(run[back[end]:end])
            end = back[end]
        return out[::-1]


def letter_runs(urls: DataFrame) -> DataFrame:
    """(page_id, at, run, key): runs of letters of the host (without its last
    label) and of the path, with a digest as key."""
    host = F.regexp_extract("host", r"(?s)\A(.*)\.", 1)
    runs = F.regexp_extract_all(F.lower(F.concat(host, F.lit(" "), "path")), F.lit(r"\p{L}+"), 0)
    return urls.select("page_id", F.posexplode_outer(runs).alias("at", "run")).where("run is not null").withColumn("key", F.unhex(F.md5("run")))


def parts_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, w): the distinct parts of up to 24 letters of each run."""
    for f in frames:
        out: list[tuple[bytes, str]] = []
        for key, run in zip(f["key"], f["run"]):
            # parts of a stretch at a time; the join's result is made distinct later
            for s in range(0, len(run), 2048):
                ends = {run[i:k] for i in range(s, min(s + 2048, len(run))) for k in range(i + 1, min(i + LONGEST_WORD, len(run)) + 1)}
                out += [(key, w) for w in ends]
                if len(out) > 100_000:
                    yield pd.DataFrame(out, columns=["key", "w"])
                    out = []
        if out:
            yield pd.DataFrame(out, columns=["key", "w"])


def examples(text: str) -> list[list[str]]:
    return [e.split() for e in re.split(r",\s*", text)]


class WordModel:
    """Multinomial naive Bayes over URL words.

    Block counts come from the block examples. Allow counts come from the allow
    examples and from the corpus' own words, scaled to the weight of the block
    words, so that a word never seen speaks for neither side. Of the corpus only
    the sum ``total`` and the number of distinct words beside the examples,
    ``others``, are needed; each word's count is given with the word."""

    def __init__(self, total: int, others: int, block: list[list[str]], allow: list[list[str]], smooth: float = 0.05):
        self.blocked, self.allowed, self.smooth = Counter(w for e in block for w in e), Counter(w for e in allow for w in e), smooth
        weight = sum(self.blocked.values())
        self.scale = weight / (total or 1)
        size = smooth * (len(self.blocked | self.allowed) + others)
        self.shift = math.log((total * self.scale + sum(self.allowed.values()) + size) / (weight + size))
        self.prior = math.log(len(block) / len(allow))

    def odds(self, w: str, n: int) -> float:
        if not n and w not in self.blocked and w not in self.allowed:
            return 0.0
        return math.log((self.blocked[w] + self.smooth) / (n * self.scale + self.allowed[w] + self.smooth)) + self.shift

    def score(self, odds: float) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.prior + odds))))


def judge(urls: DataFrame, rules: DataFrame, texts: DataFrame, text_column: str,
          block: str = BLOCK_EXAMPLES, allow: str = ALLOW_EXAMPLES) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for rows of ``url_parts``.

    Where a rule holds its verdict counts. Otherwise hosts and paths are split
    into words (Viterbi over unigram counts of all words in ``texts``) and
    naive Bayes decides; even odds allow. The counts stay a table: each distinct
    run of letters is joined to those of its own parts. An empty table of texts
    leaves the examples alone.
    """
    bad, good = examples(block), examples(allow)
    named = sorted({w for e in bad + good for w in e})
    counts = written(word_counts(texts, text_column), "words")
    n_words, total = counts.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    present = {r.w for r in counts.where(F.col("w").isin(named)).collect()}
    usual = max(1, total // max(1, n_words))
    weight = total + usual * (len(named) - len(present))
    model = WordModel(total, n_words - len(present), bad, good)

    def run_odds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for run, known in zip(f["run"], f["known"]):
                own = {k["w"]: int(k["n"]) for k in known} if known is not None else {}
                words = Segmenter({w: usual for w in named if w not in present} | own, weight).split(run)
                out.append(sum(model.odds(w, own.get(w, 0)) for w in words if len(w) > 2))
            yield pd.DataFrame({"key": f["key"], "odds": out})

    def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            chance = [model.score(x) for x in f["_odds"]]
            found = [v if isinstance(v, str) else "block" if x > 0.5 else "allow" for v, x in zip(f["_ruled"], chance)]
            yield pd.DataFrame({"page_id": f["page_id"], "host": f["host"], "path": f["path"], "rule": f["rule"], "verdict": found, "block_score": chance})

    at = letter_runs(urls)
    runs = written(at.groupBy("key").agg(F.first("run").alias("run")), "runs")
    known = runs.mapInPandas(parts_of, "key binary, w string").join(counts, "w").groupBy("key").agg(F.collect_set(F.struct("w", "n")).alias("known"))
    odds = written(runs.join(known, "key", "left").select("key", "run", "known").mapInPandas(run_odds, "key binary, odds double"), "odds")
    # summed in the order of the runs, so that equal urls score alike
    sums = at.select("page_id", "at", "key").join(odds, "key").groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("at", "odds"))).alias("o"))
    sums = sums.select("page_id", F.expr("aggregate(o, 0D, (a, x) -> a + x.odds)").alias("_odds"))
    ruled = urls.join(matching_rules(urls, rules), "page_id", "left").withColumnRenamed("verdict", "_ruled")
    ready = ruled.join(sums, "page_id", "left").na.fill(0.0, ["_odds"]).select("page_id", "host", "path", "rule", "_ruled", "_odds")
    return ready.mapInPandas(score, "page_id long, host string, path string, rule string, verdict string, block_score double")
