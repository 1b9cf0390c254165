"""How likely a text is abusive, by a learned lexicon, misspellings and context.

Labelled texts give the lexicon: words, and stems that take many endings, whose
surroundings are nearly all in toxic texts. The lexicon is a trie. A word of a
text is read letter by letter by the Levenshtein automata of all terms at once:
a state is the set of trie nodes with the edits spent so far, and states that
were met before are remembered, so that nearly every word costs a few look-ups.
What is around a hit decides between abuse and talk about it: quotation marks,
reporting words and address, with weights that the labelled texts move.
"""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perfsnap.llm.common import rows_by_id, ship
from perfsnap.session import written

ship(sys.modules[__name__])

# A word may hold signs that stand for letters, but neither begins nor ends with one.
WORD = re.compile(r"[^\W_](?:[\w@$!*'’-]*[^\W_])?")
STEM, LONGEST = (4, 5, 6, 7, 8), 40
AROUND = 6
# Words that report what someone said, and words of address, in the languages of the texts.
REPORTING = frozenset("said says say saying called calls call quote quoted quotes word words term terms wrote writes insult insults slur slurs meaning means "
                      "sagte sagt nannte nennt wort wörter zitat beleidigung dit disait appelé mot mots insulte citation dijo dice llamó palabra palabras insulto cita".split())
ADDRESS = frozenset("you your yours you're youre u ur du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti eres usted vosotros".split())
OPENING, CLOSING = "\"“„«‘", "\"”“»’"
# What context is worth before labelled texts are seen, in log-odds, and how many hits outweigh it.
PRIOR = {"\u0001quoted": -6.0, "\u0001reported": -6.0, "\u0001address": 2.0}
PRIOR_HITS = 10.0
# How often a spelling with so many edits is meant as the term, before labelled texts are seen.
UNSEEN = (0.9, 0.6, 0.4)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0


# ---- automaton ------------------------------------------------------------


def edits_allowed(term: str, is_stem: bool) -> int:
    """Short terms must be spelled right, since too many words are near them."""
    n = len(term) - 2 * is_stem
    return 0 if n < 5 else 1 if n < 9 else 2


class Automaton:
    """All terms' Levenshtein automata, run along their trie as one."""

    def __init__(self, terms: Iterable[tuple[str, bool]], most_states: int = 200_000):
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, bool, int]]] = [[]]
        self.reach = [0]  # the most edits that any term below a node allows
        for term, is_stem in terms:
            allowed, at = edits_allowed(term, is_stem), 0
            self.reach[0] = max(self.reach[0], allowed)
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.reach.append(0)
                at = self.next[at][c]
                self.reach[at] = max(self.reach[at], allowed)
            self.ends[at].append((term, is_stem, allowed))
        self.most_states = most_states
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.whole: list[tuple[str, int] | None] = []
        self.begun: list[tuple[str, int] | None] = []
        self.start = self.number({0: 0})

    def number(self, nodes: dict[int, int]) -> int:
        """The state that holds these nodes and all that missing letters lead to."""
        todo = list(nodes)
        while todo:
            at = todo.pop()
            if nodes[at] < self.reach[at]:
                for to in self.next[at].values():
                    if nodes[at] + 1 <= self.reach[to] and nodes[at] + 1 < nodes.get(to, 99):
                        nodes[to] = nodes[at] + 1
                        todo.append(to)
        state = frozenset(nodes.items())
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.steps.append({})
            best = lambda stems: min(((d, -len(t), t) for at, d in state for t, s, most in self.ends[at] if s == stems and d <= most), default=None)
            self.whole.append(best(False))
            self.begun.append(best(True))
        return self.numbers[state]

    def step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, d: int) -> None:
            if d <= self.reach[node] and d < after.get(node, 99):
                after[node] = d

        for node, d in self.states[state]:
            for letter, to in self.next[node].items():
                reach(to, d + (letter != c))
            reach(node, d + 1)
        self.steps[state][c] = to = self.number(after) if after else -1
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The nearest term, as (term, edits): of the whole word, else the stem it
        begins with, shown with a ``*``; the longest, then the first, of equally near ones."""
        if len(self.states) > self.most_states:
            self.forget()
        state, begun = self.start, None
        for c in word:
            to = self.steps[state].get(c)
            state = self.step(state, c) if to is None else to
            if state < 0:
                break
            if self.begun[state] and (begun is None or self.begun[state] < begun):
                begun = self.begun[state]
        found = (self.whole[state] if state >= 0 else None) or begun
        return found and (found[2] + "*" * (found is begun), found[0])


# ---- hits -----------------------------------------------------------------


def quoted_spans(text: str) -> list[tuple[int, int]]:
    """Stretches in quotation marks of at most 200 signs within one line; an
    apostrophe within a word is none."""
    return [m.span() for m in re.finditer(r"[\"“„«][^\"“”„«»\n]{1,200}[\"”“»]|(?<!\w)['‘](?!\s)[^'‘’\n]{1,200}['’](?!\w)", text)]


def words_of(text: str) -> Iterator[re.Match]:
    return WORD.finditer(text)


def hits_of(text: str, automaton: Automaton, seen: dict) -> list[tuple[str, int, str, frozenset]]:
    """(term, edits, word as written, cues) of every word that is near a term.

    Cues are the words within ``AROUND`` of it and the signs of talk about a word."""
    low = text.lower()
    spots, words, at = [], [], 0
    for m in words_of(low):
        w = m.group()
        if len(w) <= LONGEST:
            found = seen.get(w, 0)
            if found == 0:
                if len(seen) > 1_000_000:
                    seen.clear()
                found = seen[w] = automaton.match(w)
            if found:
                spots.append((at, m.start(), m.end(), w, found))
        words.append(w)
        at += 1
    if not spots:
        return []
    quotes, q, out = quoted_spans(low), 0, []
    terms = {i for i, *_ in spots}
    for i, start, end, w, (term, edits) in spots:
        cues = {words[j] for j in range(max(0, i - AROUND), min(len(words), i + AROUND + 1)) if j not in terms and len(words[j]) <= LONGEST}
        while q < len(quotes) and quotes[q][1] <= start:
            q += 1
        signs = {"\u0001quoted"} if q < len(quotes) and quotes[q][0] <= start and end <= quotes[q][1] else set()
        signs |= {"\u0001reported"} if cues & REPORTING else set()
        signs |= {"\u0001address"} if cues & ADDRESS else set()
        out.append((term, edits, w, frozenset(cues | signs)))
    return out


# ---- model ----------------------------------------------------------------


@dataclass
class Model:
    """All that scoring needs; its size is bounded by the limits of ``fit``."""

    terms: list[tuple[str, bool]] = field(default_factory=list)
    by_word: dict[str, float] = field(default_factory=dict)  # log-odds of a spelling
    by_kind: dict[tuple[str, int], float] = field(default_factory=dict)  # of spellings of a term with so many edits that were hardly seen
    cues: dict[str, float] = field(default_factory=dict)
    base: float = 0.0  # how often texts without a hit are toxic

    def hit_chance(self, term: str, edits: int, word: str, cues: frozenset) -> float:
        odds = self.by_word.get(word)
        if odds is None:
            odds = self.by_kind.get((term, edits), log_odds(0, 0, UNSEEN[edits], 1))
        signs = sum(self.cues.get(c, PRIOR.get(c, 0.0)) for c in cues if c[0] == "\u0001")
        # what other words say was learned of terms spelled right; near spellings differ by language
        rest = 0.0 if edits else sum(self.cues.get(c, 0.0) for c in cues if c[0] != "\u0001")
        return 1 / (1 + math.exp(-(odds + signs + max(-2.0, min(0.5, rest)))))

    def chance(self, hits: list[tuple[str, int, str, frozenset]]) -> float:
        """Of a text: its most abusive hit decides, above what texts without one have."""
        return 1 - (1 - self.base) * (1 - max((self.hit_chance(*h) for h in hits), default=0.0))


def log_odds(toxic: float, clean: float, rate: float, weight: float) -> float:
    """Of counts, pulled to ``rate`` with the weight of so many observations."""
    return max(-5.0, min(5.0, math.log((toxic + weight * rate) / (clean + weight * (1 - rate)))))


def term_counts(rows: DataFrame) -> DataFrame:
    """(term, is_stem, toxic, clean, n_words, top): in how many surroundings, one word to
    the left and right, each word and each stem stands in toxic and in clean texts.

    Surroundings count once, so that copies and near copies of a text weigh no
    more than one. ``n_words`` is the number of words of a stem, ``top`` the
    surroundings of its most frequent one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, around, toxic = [], [], []
            for text, label in zip(b.column(0), b.column(1)):
                ws = ["", *[w for m in words_of(text.as_py().lower()) if len(w := m.group()) <= LONGEST], ""]
                for i in range(1, len(ws) - 1):
                    words.append(ws[i])
                    around.append(f"{ws[i - 1]} {ws[i + 1]}")
                toxic += [label.as_py()] * (len(ws) - 2)
            for at in range(0, len(words), 50_000):
                to = at + 50_000
                yield pa.record_batch([pa.array(words[at:to], pa.string()), pa.array(around[at:to], pa.string()), pa.array(toxic[at:to], pa.int32())], names=["word", "around", "toxic"])

    placed = rows.select("text", "toxic").mapInArrow(cut, "word string, around string, toxic int")
    places = placed.groupBy("word", F.xxhash64("around").alias("a")).agg(F.min("toxic").alias("toxic"))
    words = written(places.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")), "words")
    whole = words.select(F.col("word").alias("term"), F.lit(False).alias("is_stem"), "toxic", "clean", F.lit(1).cast("long").alias("n_words"), F.col("toxic").alias("top"))
    stems = words.select(F.explode(F.array(*[F.when(F.length("word") >= n, F.left("word", F.lit(n))) for n in STEM])).alias("term"), "toxic", "clean").where("term is not null")
    stems = stems.groupBy("term").agg(F.lit(True).alias("is_stem"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.count(F.lit(1)).alias("n_words"), F.max("toxic").alias("top"))
    return whole.unionByName(stems.select(*whole.columns))


def lexicon(rows: DataFrame, max_terms: int) -> list[tuple[str, bool]]:
    """Words and stems (term, is_stem) that stand almost only in toxic texts, by far
    more often than chance gives any of all terms; at most ``max_terms``.

    A stem needs five words or more none of which makes up half of it. Of stems
    within each other the longest counts that has nine tenths of the shorter one's
    places; words that a stem covers are left out."""
    counted = written(term_counts(rows), "terms")
    n, toxic, clean = counted.where("not is_stem").agg(F.count(F.lit(1)), F.sum("toxic"), F.sum("clean")).first()
    if not toxic or not clean:
        return []
    rate = toxic / (toxic + clean)
    # chance of so many toxic places or more: at most rate^toxic times the ways to choose them
    few = F.exp(F.col("toxic") * math.log(rate) + F.col("clean") * F.log(F.col("toxic") + F.col("clean")))
    good = counted.where((F.col("toxic") >= 3) & (F.col("toxic") >= 19 * F.col("clean")) & (few * (10.0 * n) < 1))
    good = good.where("not is_stem or (n_words >= 5 and 2 * top <= toxic)")
    best = [tuple(r) for r in good.orderBy(F.desc("toxic"), "term", "is_stem").limit(max_terms).select("term", "is_stem", "toxic").collect()]
    stems = {t: c for t, s, c in best if s}
    kept = {t for t, c in stems.items() if not any(o != t and o.startswith(t) and 10 * d >= 9 * c for o, d in stems.items())}
    kept = {t for t in kept if not any(t != o and t.startswith(o) for o in kept)}
    return [(t, True) for t in sorted(kept)] + [(t, False) for t, s, _ in best if not s and not any(t.startswith(o) for o in kept)]


def fit(rows: DataFrame, max_rows: int = 20_000, max_terms: int = 2_000, max_cues: int = 5_000) -> Model:
    """A model from labelled texts (doc_id, text, toxic).

    The lexicon comes from at most ``max_rows`` of them, chosen by a hash of the
    id; hits, spellings and context are then counted in all of them, and the
    ``max_cues`` most frequent spellings and context words of hits are kept.
    Without labelled texts of both kinds no term is known.
    """
    sample = written(rows.join(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).select("doc_id"), "doc_id", "left_semi"), "sample")
    model = Model(lexicon(sample, max_terms))
    terms = model.terms

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Automaton(terms), {}
        for b in batches:
            out: list[tuple] = []
            for text, label in zip(b.column(0), b.column(1)):
                hits, y = hits_of(text.as_py(), automaton, seen), label.as_py()
                out.append(("texts", "hit" if hits else "none", 0, y))
                out += {("word", f"{w} {t}", d, y) for t, d, w, _ in hits}
                # a text's kind says something about the context of a term spelled right once
                places = {(w, cues) for _, d, w, cues in hits if d == 0}
                out += [("cue", c, 0, y) for _, cues in places for c in cues] + [("cues", "", 0, y)] * len(places)
            for at in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 50_000]), (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["what", "name", "edits", "toxic"])

    found = rows.select("text", "toxic").mapInArrow(find, "what string, name string, edits int, toxic int")
    counts = written(found.groupBy("what", "name", "edits").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")), "hits")
    largest = lambda what, n: [(r["name"], r["edits"], r["toxic"], r["clean"]) for r in counts.where(F.col("what") == what).orderBy(F.desc(F.col("toxic") + F.col("clean")), "name", "edits").limit(n).collect()]
    for name, _, toxic, clean in largest("texts", 2):
        if name == "none":
            model.base = min(toxic / (toxic + clean), 0.49)
    # what spellings that one labelled text has turn out to be is the best guess for those that none has
    term = F.substring_index("name", " ", -1).alias("term")
    rare = counts.where((F.col("what") == "word") & (F.col("toxic") + F.col("clean") == 1)).groupBy(term, "edits").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    for r in rare.collect():  # at most three rows for each term
        model.by_kind[r["term"], r["edits"]] = log_odds(r["t"], r["c"], UNSEEN[r["edits"]], 2)
    for name, edits, toxic, clean in largest("word", max_cues):
        word, of = name.split(" ")
        kind = model.by_kind.get((of, edits), log_odds(0, 0, UNSEEN[edits], 1))
        model.by_word[word] = log_odds(toxic, clean, 1 / (1 + math.exp(-kind)), 2)
    total = [(t, c) for _, _, t, c in largest("cues", 1)]
    if total:
        (toxic, clean), = total
        rate = (toxic + 1) / (toxic + clean + 2)
        for cue, _, t, c in largest("cue", max_cues) + [(p, 0, 0, 0) for p in PRIOR]:
            if cue not in model.cues:
                learned = log_odds(t, c, rate, 5) - log_odds(toxic, clean, rate, 5)
                weight = (t + c) / (t + c + PRIOR_HITS)
                model.cues[cue] = weight * learned + (1 - weight) * PRIOR.get(cue, 0.0)
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted, n_hits, terms): every text's chance to be toxic, 1 from
    0.5, and the terms found, each once, misspelled ones with their spelling.

    Null texts are empty. Rows that repeat an id, rows without one and other
    columns: see ``rows_by_id``. Texts without a hit, empty ones too, have the
    share of toxic texts among such labelled ones. Texts are read whole, in time
    linear in their length; words beyond ``LONGEST`` letters are no misspelling.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, seen = Automaton(model.terms), {}
        for b in batches:
            rows = []
            for text in b.column(1):
                hits = hits_of(text.as_py() or "", automaton, seen)
                p = model.chance(hits)
                rows.append((p, int(p >= 0.5), len(hits), sorted({t if d == 0 else f"{t}~{w}" for t, d, w, _ in hits})))
            columns = list(zip(*rows)) or [(), (), (), ()]
            yield pa.record_batch([b.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.float64(), pa.int32(), pa.int64(), pa.list_(pa.string())))]], names=["doc_id", "score", "predicted", "n_hits", "terms"])

    texts = rows_by_id(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, "doc_id long, score double, predicted int, n_hits long, terms array<string>")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, toxic): texts that are labelled 0 or 1; of several labels the largest."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return rows_by_id(docs, "doc_id", "text").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(known, "doc_id")
