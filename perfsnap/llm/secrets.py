"""Secrets in texts: candidates by pattern, false positives removed by a random forest.

DataFrame functions and Spark's own forest only. The forest learns from labelled
findings (a value with the text around it and its path) and judges a candidate
by its length, the changes between kinds of characters, how much of it is
dictionary words, its path and the words beside it.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from perfsnap.llm.common import rows_by_id
from perfsnap.session import written

# Candidates, by what stands before or by their own form. Single characters repeat,
# never groups, so that long runs take no stack; the cheapest test comes first.
SIGNS = "A-Za-z0-9_+/-"
PLAIN = r"[^\s\"'`<>]"
NAMES = ("pass|passw(?:or)?d|passphrase|passwort|kennwort|contraseña|mot de passe|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|"
         "signing[_ -]?key|auth|credentials?")
SAID = r"[:=]|[:=][\"'` ]|[:=] [\"'`]| (?:is|was|ist|es|est) [\"'`]?"
ASSIGNED = rf"(?<=[:=\"'` ])(?<={SAID})(?<=(?i:{NAMES})\w{{0,16}}[\"'`]? {{0,2}}(?:{SAID}))(?!//){PLAIN}{{5,}}(?<=[^.,;:)\]}}])"
IN_URL = r"(?<=:)(?<=://[^\s/:@]{0,128}:)[^\s/@]{3,}+(?=@)"
BLOCK = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
DOTTED = r"(?<![A-Za-z0-9_.-])[A-Za-z0-9_-]{16,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{16,}+"
RUN = rf"(?<![{SIGNS}])(?=[{SIGNS}]{{16}})(?=[{SIGNS}]*?(?:[0-9]|[a-z][A-Z]))[{SIGNS}]{{16,}}+={{0,2}}"
CANDIDATE = "|".join((BLOCK, ASSIGNED, IN_URL, DOTTED, RUN))
BEFORE, AFTER = 48, 24
MASK = "<secret>"
# Words that a value may be made of, and words beside it that speak for or against a secret.
DICTIONARY = ("example|sample|placeholder|dummy|changeme|replace|insert|your|here|test|demo|fake|token|secret|password|passwd|apikey|api|key|value|"
              "version|release|beta|alpha|build|file|image|photo|video|page|index|article|news|report|order|invoice|ticket|chapter|section|"
              "user|admin|name|data|table|column|static|assets|content|archive|download|backup|final|draft|copy|north|south|the|and|with|from|"
              "none|null|true|false|undefined|required|optional|string|hidden|empty|unknown|default|environ|getenv|config|process|self|settings|params|"
              "request|response|account|module|service|client|server|common|access|handler|parse|load|find|create|update|http|html|json|com|org|net|www")
SECRET_WORDS = r"(?i)(token|secret|pass|kennwort|contrase|pwd|api.?key|access.?key|private.?key|credential|bearer|auth|signing.?key)[^.!?]{0,24}$"
HASH_WORDS = r"(?i)(commit|sha-?\d|sha|md5|checksum|digest|revision|etag|uuid|guid|hash|fingerprint|blob|tree|build|order|invoice|isbn|iban|phone|card|id)\W{0,4}$"
ISSUERS = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|glpat-|npm_|eyJ|ya29)"
CODE = r"^[$%*{\[(]|[({\[].*[)}\]]|\*{3}|(?i)env\b|^(self|this|config|settings|process|os)\."
PATH_WORDS = r"(?i)(test|example|sample|fixture|docs?|readme|mock|demo)"


def features() -> dict[str, Column]:
    """Numbers the forest sees, from the columns value, before, after and path."""
    v, n = F.col("value"), F.length("value").cast("double")
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)).cast("double")
    flag = lambda c, pattern: F.regexp_like(F.col(c), F.lit(pattern)).cast("double")
    return {
        "f_length": F.least(n, F.lit(200.0)),
        "f_digits": count("[0-9]") / n,
        "f_upper": count("[A-Z]") / n,
        "f_lower": count("[a-z]") / n,
        "f_signs": count("[_+/=-]") / n,
        "f_other": count("[^A-Za-z0-9_+/=-]") / n,
        "f_dots": F.least(count(r"\."), F.lit(5.0)),
        "f_slashes": count("/") / n,
        "f_letter_digit": count("[A-Za-z](?=[0-9])") / n,
        "f_digit_letter": count("[0-9](?=[A-Za-z])") / n,
        "f_case": (count("[a-z](?=[A-Z])") + count("[A-Z](?=[a-z])")) / n,
        "f_same": count(r"(.)(?=\1)") / n,
        "f_kinds": F.size(F.array_distinct(F.split(v, ""))) / F.least(n, F.lit(40.0)),
        "f_vowels": count("[AEIOUaeiou]") / n,
        "f_hex": flag("value", "^([0-9a-f]+|[0-9A-F]+)$"),
        "f_issuer": flag("value", ISSUERS),
        "f_words": F.lit(1.0) - F.length(F.regexp_replace(F.lower(v), DICTIONARY, "")) / n,
        "f_near_secret": flag("before", SECRET_WORDS),
        "f_near_hash": flag("before", HASH_WORDS),
        "f_assigned": flag("before", r"[=:]\s*[\"'`]?$"),
        "f_quoted": flag("before", r"[\"'`]$") + flag("after", r"^[\"'`]"),
        "f_in_path": flag("before", r"(://|/|www\.|[.@])\S*$"),
        "f_in_url": flag("before", r"://[^\s/:@]*:$"),
        "f_block": flag("value", "^-----BEGIN"),
        "f_code": flag("value", CODE),
        "f_path": flag("path", PATH_WORDS),
    }


def labelled_findings(spark: SparkSession, rows: int = 8000) -> DataFrame:
    """Findings with their labels, ``rows`` in all, made from templates as review
    teams label them: (value, before, after, path, label). Half are secrets: keys,
    passwords of any length and signs, passwords in URLs, dotted tokens, key
    blocks. The others are digests, paths, numbers, placeholders, code that
    fetches a secret, plain words after a secret's name, dotted names and
    identifiers."""
    hexed = "sha1(concat('s', id))"
    coded = lambda salt: f"translate(base64(unhex(sha2(concat('{salt}', id), 256))), '+/=', 'xyz')"
    base = coded("b")
    listed = lambda texts, salt=5: "element_at(array(" + ", ".join(f"'{t}'" for t in texts) + f"), cast(pmod(xxhash64(id, {salt}), {len(texts)}) as int) + 1)"
    pick = lambda texts, salt=5: listed([t.replace("'", "\\'") for t in texts], salt)
    holders = pick(['token = "', 'TOKEN = "', "api_key: ", 'SECRET="', "password = '", "Authorization: Bearer ", 'access_token":"', "aws_secret_access_key = ",
                    "the secret key is ", "export API_KEY=", "private_key: ", 'auth_token = "', "client_secret=", "my password: ", "credentials: "])
    names = pick(["password: ", 'password = "', "PASSWORD=", "pwd=", "secret: ", 'secret = "', "db_pass: ", "passwd: ", "the password is ", "Passwort: ", "token: ", 'api_key="'])
    hashes = pick(["commit ", "sha1 ", "md5: ", "checksum ", "see revision ", "etag ", "uuid ", "in build ", "digest: ", "the blob ", "hash "])
    plain = pick(["go to https://www.example.org/", "the file ", "photo ", "see ", "and then ", "order ", "invoice ", "call ", "card ", "page ", "as in "])
    syllables = ["ma", "ter", "no", "li", "ver", "sto", "ren", "pa", "chi", "der", "lon", "ge", "mi", "sun", "ra", "tion"]
    said = lambda n: "concat(" + ", ".join(listed(syllables, 20 + i) for i in range(n)) + ")"
    letters = f"regexp_replace(lower(concat({coded('l')}, {coded('k')})), '[0-9]', '')"
    secret = f"""CASE pmod(id, 6) WHEN 0 THEN {hexed} WHEN 1 THEN upper({hexed}) WHEN 2 THEN substr({base}, 1, 20 + cast(pmod(id, 24) as int))
      WHEN 3 THEN concat('ghp_', substr({base}, 1, 36)) WHEN 4 THEN concat('AKIA', upper(substr(md5(concat('a', id)), 1, 16))) ELSE md5(concat('m', id)) END"""
    password = f"""CASE pmod(id, 6) WHEN 0 THEN concat({said(2)}, pmod(id * 37, 97), {pick(["!", "#", "$", "", "?", "%"], 6)})
      WHEN 1 THEN concat(substr({base}, 1, 5), {pick(["!", "@", "#", "&", "^"], 7)}, substr({base}, 8, 6), {pick(["$", "%", "*", "+"], 8)}, substr({base}, 20, 3 + cast(pmod(id, 9) as int)))
      WHEN 2 THEN substr({base}, 1, 7 + cast(pmod(id, 9) as int)) WHEN 3 THEN substr({letters}, 1, 14 + cast(pmod(id, 16) as int))
      WHEN 4 THEN concat(initcap({said(2)}), {pick(["_", "-", "!", "@"], 9)}, pmod(id * 89, 9973)) ELSE upper(substr({letters}, 1, 14 + cast(pmod(id, 12) as int))) END"""
    dotted = f"concat('eyJ', substr({base}, 1, 17 + cast(pmod(id, 15) as int)), '.', substr({coded('j')}, 1, 20 + cast(pmod(id, 22) as int)), '.', {coded('g')})"
    part = f"concat(substr({coded('o')}, 1, 24), '.', substr({coded('p')}, 1, 6), '.', substr({coded('q')}, 1, 27))"
    block = f"concat('-----BEGIN ', {pick(['', 'RSA ', 'EC ', 'OPENSSH '], 10)}, 'PRIVATE KEY----- ', {base}, ' ', {coded('r')}, ' -----END PRIVATE KEY-----')"
    other = """CASE pmod(id, 6) WHEN 0 THEN concat('articles/', 1990 + pmod(id, 40), '/news-of-the-day-', id)
      WHEN 1 THEN concat('IMG_', 20000000 + id, '_', lpad(id * 37, 9, '0')) WHEN 2 THEN concat('version-', pmod(id, 9), '-release-build-', id)
      WHEN 3 THEN concat(lpad(id * 7919, 8, '4'), '-', lpad(id * 104729, 8, '1')) WHEN 4 THEN concat('chapter_', id, '_final_draft_copy') ELSE lpad(id * 15485863, 18, '0') END"""
    filler = """CASE pmod(id, 4) WHEN 0 THEN concat('your_token_here_', id) WHEN 1 THEN concat('example_secret_key_', id)
      WHEN 2 THEN concat(repeat('x', 16), id) ELSE concat('replace-with-password-', id) END"""
    code = f"""CASE pmod(id, 8) WHEN 0 THEN concat('${{', upper({said(2)}), '_PASSWORD}}') WHEN 1 THEN concat('os.environ[', {said(2)}, ']') WHEN 2 THEN concat('process.env.', upper({said(2)}))
      WHEN 3 THEN repeat('*', 6 + cast(pmod(id, 9) as int)) WHEN 4 THEN concat('get', initcap({said(2)}), '(user)') WHEN 5 THEN concat('config.', {said(3)}) WHEN 6 THEN concat('{{{{', {said(2)}, '}}}}')
      ELSE {pick(["required", "undefined", "optional", "hidden", "string", "changeme", "[hidden]", "unknown"], 12)} END"""
    words = f"CASE pmod(id, 3) WHEN 0 THEN {said(2)} WHEN 1 THEN {said(3)} ELSE {said(4)} END"
    dots = f"""CASE pmod(id, 3) WHEN 0 THEN concat('static-', {said(4)}, '-content.', {said(3)}, '.', {said(4)}, '-service-', pmod(id, 9))
      ELSE concat({said(4)}, '-', {said(4)}, '.', {said(3)}, '.', {said(4)}, '_', {said(4)}) END"""
    named = f"CASE pmod(id, 2) WHEN 0 THEN concat('get', initcap({said(3)}), initcap({said(3)}), 'ById') ELSE concat(initcap({said(4)}), initcap({said(3)}), 'Handler', pmod(id, 9)) END"
    digest = f"CASE pmod(id, 3) WHEN 0 THEN {hexed} WHEN 1 THEN md5(concat('h', id)) ELSE regexp_replace(md5(concat('u', id)), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})', '$1-$2-$3-$4-') END"
    path = pick(["src0", "src1", "src/main.py", "config/app.yaml", "notes.txt", "web"])
    quiet = pick(["tests/fixtures.py", "docs/readme.md", "src0", "src1", "example.py", "web"])
    opened = pick(["postgres://admin:", "mysql://root:", "see amqp://svc-mail:", "redis://:", "https://deploy:", "ftp://backup.user:"])
    value = f"""CASE WHEN kind < 5 THEN {secret} WHEN kind < 7 THEN {password} WHEN kind = 7 THEN CASE pmod(id, 2) WHEN 0 THEN substr({base}, 1, 6 + cast(pmod(id, 20) as int)) ELSE {password.replace('@', '~')} END
      WHEN kind = 8 THEN CASE pmod(id, 3) WHEN 0 THEN {part} ELSE {dotted} END WHEN kind = 9 THEN {block}
      WHEN kind < 12 THEN {digest} WHEN kind < 14 THEN {other} WHEN kind < 16 THEN {filler} WHEN kind = 16 THEN {code} WHEN kind = 17 THEN {words} WHEN kind = 18 THEN {dots} ELSE {named} END"""
    before = f"""CASE WHEN kind < 5 OR kind IN (14, 15) OR kind = 8 AND pmod(id, 5) < 3 THEN {holders} WHEN kind IN (5, 6, 16, 17) THEN {names} WHEN kind = 7 THEN {opened}
      WHEN kind IN (10, 11) THEN {hashes} ELSE {plain} END"""
    ids = spark.range(rows).withColumn("kind", F.expr("pmod(id, 20)")).withColumn("id", F.expr("id div 20"))
    return ids.selectExpr(
        f"{value} AS value", f"{before} AS before",
        "CASE WHEN kind = 7 THEN '@db.internal:5432/app' ELSE CASE pmod(xxhash64(id, 9), 4) WHEN 0 THEN '\"' WHEN 1 THEN ' ' WHEN 2 THEN '\" and' ELSE '\"' END END AS after",
        f"CASE WHEN kind < 10 THEN {path} ELSE {quiet} END AS path",
        "cast(kind < 10 as double) AS label",
    )


def train(findings: DataFrame, trees: int = 40, depth: int = 8, seed: int = 11) -> RandomForestClassificationModel:
    """A forest over labelled findings (value, before, after, path, label)."""
    rows = findings.select("label", *[c.alias(k) for k, c in features().items()])
    ready = VectorAssembler(inputCols=list(features()), outputCol="features").transform(rows).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features").fit(ready)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, number, start, value, before, after, path): every candidate of every
    whole text, numbered from 0; ``start`` counts code points from 0, ``path`` is the
    source column. A text is cut once; places are running sums over its candidates,
    so the work stays linear in texts with very many of them."""
    rows = rows_by_id(docs, "doc_id", "text", "source").select("doc_id", F.col("text").cast("string"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"))
    cut = rows.select("doc_id", "path", F.regexp_extract_all("text", F.lit(CANDIDATE), 0).alias("found"), F.split("text", CANDIDATE, -1).alias("parts"))
    each = cut.select("doc_id", "path", F.inline(F.expr(
        f"transform(found, (v, i) -> struct(i AS number, v AS value, length(parts[i]) AS gap, right(parts[i], {BEFORE}) AS before, left(parts[i + 1], {AFTER}) AS after))")))
    up_to = Window.partitionBy("doc_id").orderBy("number")
    ends = F.sum(F.col("gap").cast("long") + F.length("value")).over(up_to)
    return each.select("doc_id", "number", (ends - F.length("value")).alias("start"), "value", "before", "after", "path")


def scan(docs: DataFrame, forest: RandomForestClassificationModel, least: float = 0.5) -> DataFrame:
    """(doc_id, number, start, length, value, chance, secret): all candidates, judged.

    Null and empty texts have none; a null source is an empty path. Rows that
    repeat an id, rows without one and other columns: see ``rows_by_id``.
    """
    rows = candidates(docs).select("doc_id", "number", "start", "value", *[c.alias(k) for k, c in features().items()])
    ready = VectorAssembler(inputCols=list(features()), outputCol="features").transform(rows).select("doc_id", "number", "start", "value", "features")
    judged = PipelineModel([forest]).transform(ready)
    chance = vector_to_array("probability")[1]
    return judged.select("doc_id", "number", "start", F.length("value").cast("long").alias("length"), "value", chance.alias("chance"), (chance >= least).alias("secret"))


def redact(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """All documents with their columns; secrets in their texts are masked.

    ``findings`` is what ``scan`` found in the same documents, one row per id.
    A text is cut at its candidates again and joined with masks in their places,
    so the work is linear in its length.
    """
    judged = findings.groupBy("doc_id").agg(F.max("secret").alias("_any"), F.sort_array(F.collect_list(F.struct("number", "secret"))).alias("_judged"))
    judged = written(judged.where("_any").select("doc_id", F.col("_judged.secret").alias("_secret")), "spans")
    pattern = F.lit(CANDIDATE)
    cut = docs.join(judged, "doc_id", "left").withColumns({
        "_found": F.when(F.col("_secret").isNotNull(), F.regexp_extract_all("text", pattern, 0)),
        "_parts": F.when(F.col("_secret").isNotNull(), F.split("text", CANDIDATE, -1))})
    masked = F.expr(f"array_join(transform(_parts, (p, i) -> concat(p, CASE WHEN i >= size(_found) THEN '' WHEN _secret[i] THEN '{MASK}' ELSE _found[i] END)), '')")
    clean = cut.withColumn("text", F.when(F.col("_secret").isNotNull(), masked).otherwise(F.col("text")))
    return clean.select(*docs.columns)
