"""Benchmark passages in a corpus, also with other numbers, names and units.

DataFrame functions only. Texts become templates: numbers, capitalised names
and units after a number are typed placeholders, all else is
lower-case words. Windows of a benchmark item's template are joined with those
of all documents by hash; where enough of an item's windows occur in a document,
the values behind the placeholders must map consistently, so that a
re-parameterised question is told from a text that shares its wording by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perfsnap.llm.common import rows_by_id
from perfsnap.session import written

WINDOW = 5
# Units that follow a number.
UNITS = ("km|kg|cm|mm|mg|ml|kb|mb|gb|tb|hz|khz|mhz|ghz|kw|kwh|mph|kmh|m|g|l|s|h|v|w|a|t|min|mins|sec|secs|hr|hrs|day|days|week|weeks|month|months|"
         "year|years|hour|hours|minute|minutes|second|seconds|meter|meters|metre|metres|kilometer|kilometers|mile|miles|gram|grams|kilogram|"
         "kilograms|liter|liters|litre|litres|dollar|dollars|euro|euros|pound|pounds|cent|cents|percent|degree|degrees|foot|feet|inch|inches")
# Scripts without spaces between words: each letter is a token.
UNSPACED = "\\u0E00-\\u0EFF\\u1000-\\u109F\\u1780-\\u17FF\\u3041-\\u30FF\\u3400-\\u4DBF\\u4E00-\\u9FFF\\uF900-\\uFAFF\\x{20000}-\\x{323AF}"
JOINED = rf"[\p{{L}}\p{{N}}&&[^{UNSPACED}]]"
# Patterns repeat single characters only: a repeated group would recurse once for each word of a long run.
# Parts of a number or of a name of several words are found one by one and joined afterwards.
NUMBER = rf"\p{{Nd}}(?<!{JOINED}.)\p{{Nd}}*+(?!{JOINED})"
NAME = rf"(?:['’]\p{{Lu}})?\p{{Ll}}[\p{{Ll}}\p{{Lu}}]*+(?!{JOINED})"
# Names within a sentence, and all capitalised words, those at the start of a sentence, line or quotation included.
NAMES = rf"\p{{Lu}}(?<=[\p{{L}},;:] .){NAME}"
CAPITALS = rf"\p{{Lu}}(?<!{JOINED}.){NAME}"
UNIT = rf"( ?)([%€$£]|(?i:{UNITS})(?!\p{{L}}))"
# Placeholders are private signs while a text is cut, so that no text can spell one.
SIGNS = "[\u0001-\u0006]"
# Forms of a text: names within sentences as slots, words and numbers as they are, all capitalised words as slots.
INNER, VERBATIM, ALL = 0, 1, 2


def joined(marked: Column, between: str, mark: str) -> Column:
    """Marks of parts, which end with ``\\u0002``, made one where only ``between`` parts them."""
    return F.replace(marked, F.lit(f"\u0002{between}{mark}"), F.lit(""))


def template(text: Column, names: str = NAMES) -> Column:
    """The tokens of a text's template: words in lower case, ``\\u0001n`` for a
    number, ``\\u0001m`` for a number with its unit and ``\\u0001p`` for a name."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), SIGNS, " ")
    marked = joined(F.regexp_replace(plain, names, "\u0001p\u0002"), " ", "\u0001p")
    marked = F.regexp_replace(marked, NUMBER, "\u0001n\u0002")
    for sign in ".,:":
        marked = joined(marked, sign, "\u0001n")
    marked = F.regexp_replace(marked, f"\u0001n\u0002{UNIT}", "\u0001m ")
    return words(marked, "\\p{L}\u0001", text)


def words(text: Column, signs: str, given: Column) -> Column:
    """Runs of ``signs`` in lower case; letters of unspaced scripts one by one, which
    texts do not have if one byte a letter is enough for what was ``given``."""
    low = F.lower(text)
    apart = F.when(F.octet_length(given) > F.length(given), F.regexp_replace(low, f"([{UNSPACED}])", " $1 ")).otherwise(low)
    return F.filter(F.split(apart, f"[^{signs}]+"), lambda w: w != "")


def verbatim(text: Column) -> Column:
    """Words and numbers as they are, for items of placeholders alone: without a
    word of its own such a template would occur in any text with as many numbers."""
    return words(F.coalesce(text, F.lit("")), "\\p{L}\\p{N}", text)


def hashes(tokens: Column, size: int, form: int) -> Column:
    """Hashes of all windows of ``size`` tokens; empty if there are fewer. Those of
    verbatim tokens must not meet those of templates."""
    seed = F.lit(int(form == VERBATIM))
    each = F.transform(tokens, lambda w: F.xxhash64(w))
    window = lambda one, i: F.xxhash64(seed, F.lit(size), *[F.get(one, i + k) for k in range(size)])
    every = F.get(F.transform(F.array(each), lambda one: F.transform(F.sequence(F.lit(0), F.size(one) - size), lambda i: window(one, i))), F.lit(0))
    return F.when(F.size(tokens) >= size, every).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, form, n, at, h): where each window of ``n`` tokens of an item begins.

    Items of fewer than ``size`` tokens are one window of all of them. Windows of
    placeholders alone are left out: they would be found anywhere."""
    text = F.col("text").cast("string")
    cut = rows_by_id(benchmark, "item_id", "text").select("item_id", template(text).alias("t"), verbatim(text).alias("v"), template(text, CAPITALS).alias("c"))
    worded = lambda t: F.exists(t, lambda w: ~F.startswith(w, F.lit("\u0001")))
    form = lambda k, t: F.struct(F.lit(k).alias("form"), F.col(t).alias("t"))
    forms = F.array(F.when(worded("t"), form(INNER, "t")).otherwise(form(VERBATIM, "v")), F.when(worded("c") & (F.col("c") != F.col("t")), form(ALL, "c")))
    tokens = cut.select("item_id", F.explode(forms).alias("f")).where("f is not null").select("item_id", "f.form", "f.t")
    tokens = tokens.withColumn("n", F.least(F.size("t"), F.lit(size))).where("n > 0")
    hs = F.coalesce(*[F.when((F.col("n") == n) & ((F.col("form") == VERBATIM) == (f == VERBATIM)), hashes(F.col("t"), n, f)) for n in range(1, size + 1) for f in (INNER, VERBATIM)])
    each = tokens.select("item_id", "form", "n", "t", F.posexplode_outer(hs).alias("at", "h")).where("h is not null")
    return each.where((F.col("form") == VERBATIM) | worded(F.slice("t", F.col("at") + 1, F.col("n")))).drop("t")


def windows(rows: DataFrame, key: str, sizes: dict[int, list[int]]) -> DataFrame:
    """(key, view, pos, h): hashes of all windows of each text in the forms of
    ``sizes``, which names the window sizes of each form.

    The explodes are outer ones: plain ones would make the optimizer test the
    array's size below, with the tokens cut anew for every window."""
    text = F.col("text").cast("string")
    cut = {INNER: lambda: template(text), VERBATIM: lambda: verbatim(text), ALL: lambda: template(text, CAPITALS)}
    tokens = rows.select(key, *[cut[f]().alias(f"t{f}") for f in sizes])
    every = F.array(*[F.struct(F.lit(f).alias("view"), hashes(F.col(f"t{f}"), n, f).alias("hs")) for f in sizes for n in sizes[f]])
    each = tokens.select(key, F.explode_outer(every).alias("e"))
    return each.select(key, F.col("e.view").alias("view"), F.posexplode_outer("e.hs").alias("pos", "h")).where("h is not null")


def bracketed(text: Column, names: str) -> Column:
    """The text with its names, numbers and units in brackets of private signs, cut as ``template`` cuts it."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), SIGNS, " ")
    marked = F.regexp_replace(plain, names, "\u0002$0\u0003")
    marked = F.regexp_replace(marked, "\u0003 \u0002", " ")
    marked = F.regexp_replace(marked, NUMBER, "\u0004$0\u0005")
    marked = F.regexp_replace(marked, "\u0005([.,:])\u0004", "$1")
    return F.regexp_replace(marked, f"\u0005{UNIT}", "\u0006$2\u0005")


def slots(rows: DataFrame, key: str, form: str) -> DataFrame:
    """(key, form, place, kind, value, first): the value behind each placeholder and the
    token it is, in both template forms; the column's name is ``form``. A number and
    its unit are two values of one place, so ``kind`` tells names (p), numbers (n)
    and units (u) apart. ``first`` is the first word of a value that only its place
    may have capitalised.

    Values are read from the text in the order in which their placeholders stand."""
    places = F.expr("filter(transform(t, (w, i) -> IF(startswith(w, '\u0001'), i, -1)), i -> i >= 0)")

    def of(k: int, names: str) -> DataFrame:
        text = F.col("text").cast("string")
        values = F.regexp_extract_all(bracketed(text, names), F.lit("[\u0002\u0004][^\u0003\u0005]*+"), 0)
        out = rows.select(key, values.alias("v"), template(text, names).alias("t")).select(key, "v", places.alias("p"))
        each = out.select(key, F.explode(F.arrays_zip("p", "v")).alias("s")).where("s.p is not null")
        value = F.lower(F.expr("substring(s.v, 2)"))
        named = F.startswith("s.v", F.lit("\u0002"))
        both = F.when(named, F.array(F.struct(F.lit("p").alias("kind"), value.alias("value")))).otherwise(F.filter(
            F.array(F.struct(F.lit("n").alias("kind"), F.substring_index(value, "\u0006", 1).alias("value")), F.struct(F.lit("u").alias("kind"), F.get(F.split(value, "\u0006"), F.lit(1)).alias("value"))), lambda s: s["value"].isNotNull()))
        return each.select(key, F.lit(k).alias(form), F.col("s.p").alias("place"), F.inline(both))

    text = F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SIGNS, " ")
    # capitalised within a sentence: the first words of these are names wherever they stand
    inner = rows.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(NAMES), 0))).alias("head")).select(key, F.lower("head").alias("head"), F.lit(True).alias("_inner")).distinct()
    every = of(ALL, CAPITALS).withColumn("head", F.when(F.col("kind") == "p", F.substring_index("value", " ", 1))).join(inner, [key, "head"], "left")
    first = F.when(F.col("_inner").isNull(), F.col("head")).alias("first")
    return of(INNER, NAMES).withColumn("first", F.lit(None).cast("string")).unionAll(every.select(key, form, "place", "kind", "value", first))


# Entries of a table of fixed size that tells most words apart from those looked for.
BITS = 1 << 16


def common_words(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(first): those of ``words`` that the texts also write in lower case.

    Texts are looked through for words whose hash is in a table of fixed size,
    so few others leave them; the join settles the rest."""
    table = bytearray(BITS)
    for r in words.select(F.pmod(F.xxhash64("first"), F.lit(BITS)).alias("at")).distinct().collect():  # at most BITS rows
        table[r["at"]] = 1
    held = F.expr(f"X'{table.hex()}'")
    known = lambda w: F.substr(held, F.pmod(F.xxhash64(w), F.lit(BITS)).cast("int") + 1, F.lit(1)) == F.lit(b"\x01")
    found = F.array_distinct(F.filter(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"\p{Ll}(?<![\p{L}\p{N}'’].)[\p{L}'’]*+"), 0), known))
    return texts.select(F.explode(found).alias("first")).join(words, "first", "left_semi").distinct()


def split_first(rows: DataFrame, common: DataFrame, plain: str, name: str) -> DataFrame:
    """Slots whose ``value`` is split into a common first word, if any, and a name."""
    joined = rows.join(common.withColumn("_common", F.lit(True)), "first", "left")
    known = F.col("_common").isNotNull()
    return joined.withColumns({plain: F.when(known, F.col("first")), name: F.when(known, F.expr("substring(value, length(first) + 2)")).otherwise(F.col("value"))}).drop("first", "value", "_common")


def find_leaks(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, coverage: float = 0.6, agreement: float = 1.0) -> DataFrame:
    """(doc_id, item_id, n_windows, n_found, coverage, n_slots, n_agreed): the
    items that occur in each document.

    An item occurs if at least ``coverage`` of the windows of its template do,
    and at least ``agreement`` of its slots agree: each value of the item stands
    for one value of the document, and each of those for one of the item, wherever
    both are aligned. Numbers, units and names are slots; windows of placeholders
    alone do not count. One place that
    holds ``coverage`` of the windows and agrees is enough; without such a place
    the one that holds them, else the one with the most agreeing slots, counts. Items without slots agree.

    Capitalised words at the start of a sentence, line or quotation are words in
    one form of a text and names in another; an item may occur in either. As
    names they agree with other names, but those the texts also write in lower
    case only with themselves, unless their own text has them capitalised
    within a sentence.

    Items shorter than a window are one window of their own size, items of
    placeholders alone are looked for as they are written. Null and empty texts
    have no windows; an item without words and numbers occurs nowhere. Rows that
    repeat an id, rows without one and other columns: see ``rows_by_id``.
    """
    items = written(item_windows(benchmark, size), "items")
    sizes: dict[int, list[int]] = {}
    for r in items.select("form", "n").distinct().orderBy("form", "n").collect():
        for f in (VERBATIM,) if r.form == VERBATIM else (INNER, ALL):
            sizes[f] = sorted({*sizes.get(f, []), r.n})
    totals = items.groupBy("item_id", "form").agg(F.count(F.lit(1)).alias("n_windows"))
    texts, asking = rows_by_id(docs, "doc_id", "text"), rows_by_id(benchmark, "item_id", "text")
    placed = windows(texts, "doc_id", sizes or {INNER: [size]})
    hits = written(placed.join(items.drop("n"), "h").select("doc_id", "item_id", "form", "at", "view", (F.col("pos") - F.col("at")).alias("shift")), "hits")
    pair = ["doc_id", "item_id", "form"]
    found = hits.groupBy(*pair, "at").agg(F.count(F.lit(1)).alias("times")).groupBy(*pair).agg(F.count(F.lit(1)).alias("n_found"))
    likely = written(found.join(totals, ["item_id", "form"]).where(F.col("n_found") >= F.lit(coverage) * F.col("n_windows")), "likely")

    asked = written(slots(asking, "item_id", "form"), "slots")
    # values are looked up only in documents that hold an item with slots
    pairs = written(likely.join(asked.select("item_id", "form").distinct(), ["item_id", "form"], "left_semi").select(*pair, "n_windows"), "pairs")
    given = slots(texts.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", "view")
    near = hits.join(pairs, pair)
    spots = near.join(asked, ["item_id", "form"]).where(f"place between at and at + {size - 1}")
    spots = spots.select(*pair, "view", "shift", "kind", F.col("place").alias("spot"), (F.col("place") + F.col("shift")).alias("place"), F.col("value").alias("theirs"), F.col("first").alias("their_first")).distinct()
    met = written(spots.join(given, ["doc_id", "view", "place", "kind"]), "met")
    firsts = written(met.select("first").unionAll(met.select("their_first")).where("first is not null").distinct(), "firsts")
    common = written(common_words(texts.select("text").unionAll(asking.select("text")), firsts), "common")
    met = split_first(met, common, "plain", "name").select("*", F.col("theirs").alias("value"), F.col("their_first").alias("first"))
    met = split_first(met, common, "their_plain", "their_name")
    alike = F.col("plain").eqNullSafe(F.col("their_plain")) & ((F.col("name") == "") == (F.col("their_name") == ""))
    place = [*pair, "view", "shift"]
    # of each pair of values how often it stands, then each value's partners on either side
    paired = met.groupBy(*place, "kind", "their_name", "name").agg(F.countDistinct("spot").alias("spots"), F.countDistinct(F.when(alike, F.col("spot"))).alias("alike"))
    one = lambda side: F.count(F.lit(1)).over(Window.partitionBy(*place, "kind", side)) == 1
    paired = paired.withColumns({"theirs_once": one("their_name"), "ours_once": one("name")})
    by_place = paired.groupBy(*place).agg(F.sum("spots").alias("n_slots"), F.sum(F.when(F.col("theirs_once") & F.col("ours_once"), F.col("alike")).otherwise(0)).alias("n_agreed"))
    whole = near.groupBy(*place).agg((F.countDistinct("at") >= F.lit(coverage) * F.max("n_windows")).alias("whole"))
    scored = whole.join(by_place, place, "left").where("whole or n_slots is not null").na.fill(0, ["n_slots", "n_agreed"])
    enough = F.col("n_agreed") >= F.lit(agreement) * F.col("n_slots")
    best = scored.groupBy(*pair).agg(F.max(F.struct((F.col("whole") & enough).alias("agrees"), "whole", "n_agreed", (-F.col("n_slots")).alias("less"))).alias("b"))
    best = best.select(*pair, (-F.col("b.less")).alias("n_slots"), "b.n_agreed")
    out = likely.join(best, pair, "left").withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_slots", "n_agreed")}).where(enough)
    # of the forms that occur the first counts
    names = ["n_windows", "n_found", "n_slots", "n_agreed"]
    out = out.groupBy("doc_id", "item_id").agg(F.min(F.struct("form", *names)).alias("o")).select("doc_id", "item_id", *[F.col(f"o.{c}").alias(c) for c in names])
    return out.select("doc_id", "item_id", "n_windows", "n_found", (F.col("n_found") / F.col("n_windows")).alias("coverage"), "n_slots", "n_agreed")
