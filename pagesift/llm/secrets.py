"""Secret scans: candidates judged by a random forest (DataFrame functions only).

A candidate is a value assigned to a name of a secret (``password = "..."``,
``API_KEY=...``, ``?access_token=...``) of 4 or more characters, or else a run of
16 or more characters of ``[A-Za-z0-9+/_-]`` with a digit, with its ``=`` padding.
Most candidates are no secrets: numbers, names of files, parts of addresses,
identifiers, plain words. A random forest on the candidate's length, character
transitions and classes, dictionary coverage, path marks and neighbouring
words, trained from labelled findings, removes these.

Labelled findings are of two kinds: candidates of the documents that their
context makes plain, and ``EXAMPLES`` written ones of every usual form, made by a
rule, so that the forest knows forms that a corpus lacks (and is defined for a
corpus without any).

The forest is fitted by Spark ML on a bounded sample of labelled findings and
then written out as a column expression (the vote of each tree), so texts are
scanned, judged and redacted in one projection, without a shuffle and without
Python on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesift.session import stage

SAMPLE = 20_000           # labelled findings to fit on, at most
EXAMPLES = 4_000          # written findings
# A word of the dictionary is in at least two documents and this share of them.
DICTIONARY_SHARE = 1e-4
TREES, TREE_DEPTH = 25, 6
CONTEXT = 64              # characters on either side that are looked at
MASK = "[SECRET]"

RUN = "A-Za-z0-9+/_-"
NAMES = "token|secret|passw|passwd|pwd|credential|api.?key|access.?key|private.?key|auth(?!or)|bearer"
SECRET_WORDS = f"(?i)({NAMES})"
# Ahead of a value: the name of a secret with its ending, a quote, a sign, a quote.
NAMED = rf"(?i:{NAMES})[\w-]{{0,24}}[\"'`]?\s{{0,3}}[:=]\s{{0,3}}[\"'`]?"
# A value in quotes ends with them, any other with a mark that parts values too.
# The short look-behinds come first, so that the long one is tried behind a sign
# only and a word after a blank costs two steps.
VALUE = (rf"(?<=[:=\s\"'`])(?<![^:=\s]\s)(?<=[:=]\s{{0,3}}[\"'`]?)(?<={NAMED})(?:(?<=[\"'`])[^\s\"'`]{{4,}}+|(?<![\"'`])[^\s\"'`&,;<>()\[\]{{}}]{{4,}}+)")
# A run starts where no run character stands before it and is never given back,
# so the search is linear in the text.
LONG = rf"(?<![{RUN}])(?=[A-Za-z+/_-]*+[0-9])[{RUN}]{{16,}}+(?:={{1,2}}+(?![={RUN}]))?+"
CANDIDATE = f"(?:{VALUE})|(?:{LONG})"
OTHER_WORDS = r"(?i)(sha\d|md5|checksum|digest|commit|revision|uuid|guid|build|version|isbn|phone|card|order|invoice)"
ASSIGNED = r"[:=]\s*[\"'`]?$"


def finds(text: Column) -> tuple[Column, Column]:
    """The candidates of a text, and the pieces between them (one more)."""
    return F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)


def described(cands: Column, pieces: Column, dictionary: list[str]) -> Column:
    """An array of (before, cand, near, f): the piece before, the candidate, the
    text around it and its features."""
    n = F.size(cands)

    def count(c: Column, pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)).cast("double")

    def flag(c: Column) -> Column:
        return c.cast("double")

    def one(cand: Column, piece: Column, after: Column) -> Column:
        before, after = F.substring(piece, -CONTEXT, CONTEXT), F.substring(after, 1, CONTEXT)
        length = F.length(cand).cast("double")
        letters = F.regexp_extract_all(F.lower(cand), F.lit("[a-z]{3,}"), F.lit(0))
        covered = F.aggregate(letters, F.lit(0), lambda acc, w: acc + F.when(w.isin(*dictionary), F.length(w)).otherwise(0) if dictionary else acc)
        f = [
            length,
            count(cand, "(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])") / length,  # transitions
            count(cand, "[0-9]") / length,
            count(cand, "[A-Z]") / length,
            count(cand, "[g-zG-Z]") / length,
            F.size(F.array_distinct(F.split(cand, ""))).cast("double") / length,
            count(cand, "[a-zA-Z]{5,}"),
            covered.cast("double") / length,                                   # dictionary coverage
            count(cand, "/"),                                                  # path
            flag(before.rlike(r"(?i)(://|www\.|/|\\)[^\s\"']{0,64}$")),
            flag(after.rlike(r"^\.[A-Za-z]{2,5}\b")),
            flag(before.rlike(SECRET_WORDS)),                                  # neighbouring words
            flag(F.substring(before, -24, 24).rlike(SECRET_WORDS)),
            flag(before.rlike(OTHER_WORDS)),
            flag(before.rlike(ASSIGNED)),
            flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
            flag(before.rlike(NAMED + "$")),
            flag(cand.rlike("^[A-Z]?[a-z]+$|^[A-Z]+$")),                       # a plain word
            count(cand, "[^A-Za-z0-9+/_=-]"),
        ]
        return F.struct(piece.alias("before"), cand.alias("cand"), before.alias("left"), after.alias("right"), F.array(*f).alias("f"))

    pairs = F.zip_with(cands, F.slice(pieces, 1, n), lambda c, b: F.struct(c.alias("c"), b.alias("b")))
    return F.zip_with(pairs, F.slice(pieces, 2, n), lambda x, after: one(x["c"], x["b"], after))


FEATURES = 19


def scanned(docs: DataFrame, text_col: str, words: list[str]) -> DataFrame:
    """``docs`` with the columns __d (described candidates) and __last (the piece
    behind the last one)."""
    cands, pieces = finds(F.coalesce(F.col(text_col), F.lit("")))
    return (docs.withColumns({"__c": cands, "__p": pieces})
            .withColumns({"__d": described(F.col("__c"), F.col("__p"), words), "__last": F.element_at("__p", -1)})
            .drop("__c", "__p"))


def labelled_by_context(docs: DataFrame, words: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled findings (tie, f, label) by what a reviewer goes by where it is
    plain: a mixed value of 8 or more characters assigned to a name of a secret is
    one; plain words, pure numbers, parts of addresses and names of files, and runs
    named as something else are not. All other candidates stay unlabelled."""
    def judged(d: Column, at: Column) -> Column:
        cand, left, right = d["cand"], d["left"], d["right"]
        mixed = cand.rlike("[A-Za-z]") & cand.rlike("[0-9]") & (F.length(cand) >= 8)
        named = left.rlike(NAMED + "$")
        other = (cand.rlike("^[0-9]+$|^[A-Z]?[a-z]+$") | left.rlike(r"(?i)(://|www\.)[^\s]{0,64}$") | right.rlike(r"^\.[A-Za-z]{2,5}\b")
                 | left.rlike(OTHER_WORDS + r"\W{0,4}$"))
        return F.struct(F.xxhash64("id", at, cand).alias("tie"), d["f"].alias("f"), F.when(named & mixed, 1.0).when(other, 0.0).alias("label"))

    rows = scanned(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", words)
    return rows.select(F.inline(F.filter(F.transform("__d", judged), lambda x: x["label"].isNotNull())))


def tree_votes(debug: str) -> list[str]:
    """SQL over x.f of each tree of a fitted forest, from its printed form."""
    def walk(lines: list[str], i: int) -> tuple[str, int]:
        if m := re.match(r"Predict: ([\d.]+)", lines[i]):
            return str(int(float(m[1]))), i + 1
        m = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", lines[i])
        yes, i = walk(lines, i + 1)
        no, i = walk(lines, i + 1)   # i is at the line "Else (...)"
        return f"CASE WHEN x.f[{m[1]}] <= {m[2]}D THEN {yes} ELSE {no} END", i

    parts = re.split(r"Tree \d+ \(weight [\d.]+\):", debug)[1:]
    return [walk([x.strip() for x in p.strip().splitlines()], 0)[0] for p in parts]


def written_findings(spark: SparkSession, words: list[str]) -> DataFrame:
    """``EXAMPLES`` labelled findings (tie, f, label) of usual forms, with values from
    hashes of their numbers."""
    i = F.col("id")

    def text(kind: str) -> Column:
        return F.sha2(F.concat(F.lit(f"example {kind} "), i.cast("string")), 256)

    def pick(kind: str, *of) -> Column:
        return F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in of]), (F.pmod(F.xxhash64(F.lit(kind), i), F.lit(len(of))) + 1).cast("int"))

    code = F.translate(F.base64(F.unhex(text("code"))), "=", "")   # 43 characters
    number = F.substring(F.translate(text("digits"), "abcdef", "123456"), 1, 16)
    letters = F.translate(code, "0123456789+/", "qWeRtYuIoPaS")
    word, second = (pick(k, "river", "garden", "window", "Summer", "number", "default", "required", "example") for k in ("w", "v"))
    name = pick("name", "token", "secret", "password", "passwd", "pwd", "API_KEY", "api_key", "access_token", "client_secret", "auth", "private-key", "DB_PASSWORD")
    sign = pick("sign", "=", " = ", ": ", "=", ":")
    quote = pick("quote", "\"", "'", "", "")
    secret = pick("secret", F.substring(text("hex"), 1, 32), F.substring(text("hex"), 1, 40), code, F.substring(code, 1, 20), F.substring(letters, 1, 20),
                  F.concat(word, F.substring(number, 1, 1), F.lit("-"), F.substring(code, 1, 5), F.lit("!")), F.concat(F.substring(code, 1, 6), F.lit("#"), F.substring(number, 1, 3), second))
    plain = pick("plain", word, F.lit("true"), F.lit("null"), F.lit("none"), F.substring(number, 1, 4), number, F.concat(F.lower("w"), F.lit("-"), F.lower("v")),
                 F.concat(F.lit("${"), F.lit("NAME"), F.lit("}")), F.concat(F.lower("w"), F.lit(".json")))
    loose = pick("loose", F.substring(text("hex"), 1, 40), number, F.concat(F.lower("w"), F.lit("_"), F.lower("v"), F.lit("_2024_"), F.substring(number, 1, 4)),
                 F.concat(F.lower("w"), F.lit("/"), F.lower("v"), F.lit("/2024-01-"), F.substring(number, 1, 2)))
    ahead = pick("ahead", "commit ", "sha256: ", "order ", "version ", "md5 = ", "see https://host.example/", "build ", "phone ")
    bare = pick("bare", "Bearer ", "use the token ", "my secret is ", "the api key ")
    form = F.pmod(i, F.lit(8))
    rows = spark.range(EXAMPLES).withColumns({"w": word, "v": second}).select(
        "id",
        F.when(form < 3, F.concat(name, sign, quote)).when(form == 3, bare).when(form < 6, F.concat(name, sign, quote)).otherwise(ahead).alias("ahead"),
        F.when(form < 3, secret).when(form == 3, code).when(form < 6, plain).otherwise(loose).alias("value"),
        F.when(form.isin(0, 1, 2, 4, 5), quote).otherwise(F.lit("")).alias("behind"), (form < 4).cast("double").alias("label"))
    rows = rows.withColumn("text", F.concat(F.lit("some words before "), "ahead", "value", "behind", F.lit(" and some after")))
    found = scanned(rows, "text", words).select("id", "value", "label", F.explode("__d").alias("d"))
    return found.filter(F.col("d.cand") == F.col("value")).select(F.xxhash64("id").alias("tie"), F.col("d.f").alias("f"), "label")


def dictionary(docs: DataFrame, *, text_col: str = "text") -> list[str]:
    """Words of 3 to 15 letters in at least two documents and ``DICTIONARY_SHARE`` of
    all, as far as a candidate of the documents holds them. All documents are
    counted; the words are at most as many as 1 / ``DICTIONARY_SHARE`` times the
    distinct words of a mean document."""
    texts = docs.select(F.col(text_col).alias("text"))
    least = max(2.0, DICTIONARY_SHARE * texts.count())
    each = texts.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("(?<![a-z])[a-z]{3,15}+(?![a-z])"), F.lit(0)))).alias("w"))
    common = each.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    used = (texts.select(F.explode(finds(F.coalesce("text", F.lit("")))[0]).alias("c"))
            .select(F.explode(F.regexp_extract_all(F.lower("c"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w")).distinct())
    return sorted(r["w"] for r in common.join(used, "w", "left_semi").select("w").collect())


def train(findings: DataFrame, written: DataFrame | None = None, *, seed: int = 7) -> list[str]:
    """The votes of a forest fitted on at most ``SAMPLE`` labelled findings (tie, f,
    label), the first in the order of ``tie``, and on all ``written`` ones. With one
    label only, a single constant vote for it; with none, a vote that no candidate
    is a secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    sample = findings.select("tie", "f", "label").orderBy("tie", "f", "label").limit(SAMPLE)
    sample = stage(sample if written is None else sample.unionByName(written), "findings")
    seen = sorted(r["label"] for r in sample.select("label").distinct().collect())
    if len(seen) < 2:
        return [str(int(seen[0])) if seen else "0"]
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=seed, featuresCol="v", labelCol="label", minInstancesPerNode=2)
    rows = sample.orderBy("tie", "f", "label").select(array_to_vector("f").alias("v"), "label").coalesce(1)
    return tree_votes(forest.fit(rows).toDebugString)


def _judged(rows: DataFrame, words: list[str], votes: list[str]) -> tuple[DataFrame, Column, Column]:
    """``rows`` (with __text) and the judged candidates __j; whether one of them is
    a secret (of a lambda); the masked text."""
    rows = scanned(rows, "__text", words)
    rows = rows.withColumn("__j", F.expr(
        f"transform(__d, x -> named_struct('before', x.before, 'candidate', x.cand, 'votes', {' + '.join(votes)}))"))
    masked = F.transform("__j", lambda x: F.concat(x["before"], F.when(_secret(x, votes), F.lit(MASK)).otherwise(x["candidate"])))
    n_secrets = F.size(F.filter("__j", lambda x: _secret(x, votes)))
    return rows, n_secrets, F.when(F.col("__text").isNotNull(), F.concat(F.array_join(masked, ""), F.col("__last")))


def _secret(x: Column, votes: list[str]) -> Column:
    return x["votes"] * 2 > len(votes)


def scan(df: DataFrame, words: list[str], votes: list[str], *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge all candidates of every whole text and mask the secrets.

    Returns (id, n_candidates, n_secrets, findings, redacted), one row per input
    row: ``findings`` lists (candidate, votes, secret) in text order; a candidate
    is a secret if more than half of the trees say so; ``redacted`` has ``MASK`` in
    place of secrets.

    Defined cases: null texts have no findings and stay null; empty texts stay
    empty; null or repeated ids are passed through; an empty table gives no
    rows; other columns are ignored.
    """
    rows, n_secrets, masked = _judged(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), words, votes)
    found = F.transform("__j", lambda x: F.struct(x["candidate"].alias("candidate"), x["votes"].alias("votes"), _secret(x, votes).alias("secret")))
    return rows.select(F.col("__id").alias(id_col), F.size("__j").alias("n_candidates"), n_secrets.alias("n_secrets"),
                       found.alias("findings"), masked.alias("redacted"))


def mask(df: DataFrame, words: list[str], votes: list[str], *, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``df`` with the secrets of its texts masked; ``length_col`` (if there) follows
    a changed text."""
    rows = df.select(F.col(text_col).alias("__text"), F.struct(*[c for c in df.columns if c != text_col], F.lit(0).alias("__")).alias("__row"))
    rows, n_secrets, masked = _judged(rows, words, votes)
    rows = rows.select("__row", n_secrets.alias("__n"), masked.alias("__text"))
    length = F.when(F.col("__n") > 0, F.length("__text")).otherwise(F.col(f"__row.`{length_col}`")) if length_col in df.columns else None
    new = {text_col: F.col("__text"), length_col: length}
    return rows.select(*[(new[c] if c in new else F.col(f"__row.`{c}`")).alias(c) for c in df.columns])
