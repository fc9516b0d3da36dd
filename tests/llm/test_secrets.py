import re

from pagesift.llm import queries, secrets
from pyspark.sql import functions as F

from .edge import SCHEMA, SF, both, collect, edge

NAME = re.compile(r"(token|secret|passw|passwd|pwd|credential|api.?key|access.?key|private.?key|auth(?!or)|bearer)[\w-]{0,24}[\"'`]?\s{0,3}[:=]\s{0,3}[\"'`]?",
                  re.I | re.A)
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]+")


def spans(text):
    """Candidates by hand: walk the text, values of names first."""
    named = set()
    for i in range(len(text)):
        if NAME.match(text, i):
            named.update(end for end in range(i + 4, min(len(text), i + 60) + 1) if NAME.fullmatch(text, i, end))
    at = 0
    while at < len(text):
        m = None
        if at in named:
            quoted = at and text[at - 1] in "\"'`"
            m = re.compile("[^\\s\"'`]{4,}" if quoted else "[^\\s\"'`&,;<>()\\[\\]{}]{4,}", re.A).match(text, at)
        if not m:
            m = RUN.match(text, at)
            if m and (len(m[0]) < 16 or not re.search("[0-9]", m[0])):
                m = None
            if m and (pad := re.compile(r"={1,2}(?![A-Za-z0-9+/_=-])").match(text, m.end())):
                yield m.start(), pad.end()
                at = pad.end()
                continue
        if m:
            yield m.span()
            at = m.end()
        else:
            at += 1
SF01 = "/root/testdata/sf0.01"


def test_candidates_and_masking_equal_brute_force(spark):
    df = both(spark)
    words, votes = queries.secret_forest(queries.documents(spark, SF01))
    texts = {}
    for r in collect(df):
        texts.setdefault(str(r["doc_id"]), []).append(r["text"])
    for r in collect(secrets.scan(df, words, votes)):
        options = texts[str(r["doc_id"])]
        found = [f["candidate"] for f in r["findings"]]
        assert found in [[t[a:b] for a, b in spans(t)] if t else [] for t in options]
        def masked(text, found):
            out, at = "", 0
            for (a, b), f in zip(spans(text), found):
                out, at = out + text[at:a] + (secrets.MASK if f["secret"] else text[a:b]), b
            return out + text[at:]
        assert r["redacted"] in [t if t is None else masked(t, r["findings"]) for t in options]
        assert (r["n_candidates"], r["n_secrets"]) == (len(found), sum(f["secret"] for f in r["findings"]))


def test_planted_secrets_and_false_positives(spark):
    words, votes = queries.secret_forest(queries.documents(spark, SF01))
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    cases = [(f'some words token = "{key}" more', True), ("pay with 4716253846571234 or 4716253846571235 now", False),
             (f'x secret: "{key[:32]}" y', True), ("call 1234567890123456789", False)]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, (t, _) in enumerate(cases)], SCHEMA)
    out = {r["doc_id"]: r for r in collect(secrets.scan(df, words, votes))}
    for i, (t, secret) in enumerate(cases):
        assert bool(out[i]["n_secrets"]) == secret and (out[i]["redacted"] != t) == secret, t


def test_forms_of_secrets(spark):
    key, code = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b", "Zx8Qw3+LmN0pRt/UvY1aBcDe"
    secret = [(f"API_KEY={key}", key), (f"https://x.example/p?access_token={key}&x=1", key), ('password = "hunter2-Xy9!pq"', "hunter2-Xy9!pq"),
              ('token: "abcdefGHIJKLmnopQRST"', "abcdefGHIJKLmnopQRST"), (f"export DB_PASSWORD='{code}=='", code + "=="), (f'"client_secret": "{code}"', code)]
    plain = ["the author: Johnson wrote", "password: required", "token = null", "secret: garden", f"commit {key}", "order 4716253846571234",
             "https://x.example/garden/river/2024-01-17/index", "see window_number_2024_0117.csv", "auth: none", "passwd = ${NAME}"]
    for docs in (queries.documents(spark, SF01), spark.createDataFrame([], SCHEMA)):
        words, votes = queries.secret_forest(docs)
        texts = [f"some words {t} and more" for t in [x for x, _ in secret] + plain]
        out = {r["doc_id"]: r for r in collect(secrets.scan(spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA), words, votes))}
        for i, t in enumerate(texts):
            want = t.replace(secret[i][1], secrets.MASK) if i < len(secret) else t
            assert out[i]["redacted"] == want, out[i]


def test_dictionary_counts_all_documents(spark):
    texts = ["the river x_river_2024_0117_ab", "river bank bank bank", "solo_2024_0117_abcde", None, "", "bank-1234567890123456"]
    df = spark.createDataFrame([(i, t, "", "", 0) for i, t in enumerate(texts)], SCHEMA)
    assert secrets.dictionary(df) == ["bank", "river"]
    many = df.unionByName(spark.range(100, 40_000).selectExpr("id doc_id", "'bank' text", "'' lang", "'' source", "0 n_chars"))
    assert secrets.dictionary(many) == ["bank"]   # river is in 3 of 39,906: below the share


def test_all_assigned_tokens_of_the_table_are_masked(spark):
    out = collect(queries.op5_secret_forest(spark, SF01))
    docs = {r["doc_id"]: r["text"] for r in collect(queries.documents(spark, SF01))}
    assigned = re.compile(r'token = "([0-9a-f]{40})"')
    assert len(out) == len(docs)
    for r in out:
        found = {f["candidate"] for f in r["findings"] if f["secret"]}
        assert set(assigned.findall(docs[r["doc_id"]])) == found


def votes_by_hand(sql, f):
    tokens = sql.replace("CASE WHEN ", "( ").split()
    def walk(i):
        if tokens[i] != "(":
            return int(tokens[i]), i + 1
        at, limit = int(tokens[i + 1][4:-1]), float(tokens[i + 3].rstrip("D"))
        yes, j = walk(i + 5)
        no, j = walk(j + 1)
        return (yes if f[at] <= limit else no), j + 1
    return walk(0)[0]


def test_the_written_out_forest_votes_like_the_fitted_one(spark):
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = spark.range(600).select(
        F.array(*[(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)) / 100.0) for k in range(secrets.FEATURES)]).alias("f"))
    rows = rows.withColumn("label", ((F.col("f")[0] * F.col("f")[3] > 20) != (F.col("f")[5] > 7)).cast("double")).withColumn("v", array_to_vector("f"))
    forest = RandomForestClassifier(numTrees=9, maxDepth=4, seed=1, featuresCol="v", labelCol="label").fit(rows)
    votes = secrets.tree_votes(forest.toDebugString)
    assert len(votes) == 9
    some = collect(rows.select("f", F.expr(f"transform(array(struct(f)), x -> {' + '.join(votes)})[0]").alias("n"), "v").limit(50))
    for r in some:
        each = [t.predict(r["v"]) for t in forest.trees]
        assert r["n"] == sum(each) == sum(votes_by_hand(v, r["f"]) for v in votes)


def test_edge_rows_and_constant_votes(spark):
    e = edge(spark, clash=("findings", "redacted", "f", "votes"))
    for votes in (["1"], ["0"]):
        out = collect(secrets.scan(e, [], votes))
        assert len(out) == 15 and sum(r["redacted"] is None for r in out) == 2
        assert all(r["n_secrets"] == (r["n_candidates"] if votes == ["1"] else 0) for r in out)
    empty = spark.createDataFrame([], SCHEMA)
    words, votes = queries.secret_forest(empty)   # from the written findings alone
    assert words == [] and len(votes) == secrets.TREES
    assert secrets.train(spark.createDataFrame([], "tie long, f array<double>, label double")) == ["0"]
    assert collect(secrets.scan(empty, [], ["1"])) == []
    one = spark.createDataFrame([(1, [0.0] * secrets.FEATURES, 0.0)], "tie long, f array<double>, label double")
    assert secrets.train(one) == ["0"]


def test_long_runs_are_linear(spark):
    long = "a" * 300_000 + " " + "1" * 300_000 + " " + "-=" * 100_000
    df = spark.createDataFrame([(1, long, "", "", 0)], SCHEMA)
    r = collect(secrets.scan(df, [], ["1"]))[0]
    assert r["n_candidates"] == 1 and r["redacted"] == "a" * 300_000 + " [SECRET] " + "-=" * 100_000


def test_native_plan(spark):
    docs = queries.documents(spark, SF)
    plan = secrets.scan(docs, ["the"], ["1"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
