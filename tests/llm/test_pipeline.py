import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pagesift.llm import queries

import corpus_pipeline as cp

from .edge import SCHEMA, SF, WORDS, collect, edge
from .test_apportion import targets_by_hand
from .test_order_minhash import groups_by_hand

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows after each stage, written and read again as the driver does."""
    top = tmp_path_factory.mktemp("pipeline")
    docs, out = queries.documents(spark, SF01), {"input": collect(queries.documents(spark, SF01))}
    for name, step in cp.STAGES:
        step(spark, docs, SF01).write.parquet(str(top / name))
        docs = spark.read.parquet(str(top / name))
        out[name] = collect(docs)
    return out


def test_columns_and_order(steps):
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "encode"]
    for name in ("quality", "near_duplicates", "secrets", "mix"):
        assert list(steps[name][0]) == SCHEMA.names


def test_quality_drops_rejected_documents_only(spark, steps):
    kept = {r["doc_id"] for r in collect(queries.op8_ordinal_quality(spark, SF01)) if r["kept"]}
    assert {r["doc_id"] for r in steps["quality"]} == kept
    rated = {r["doc_id"]: r["grade"] for r in collect(queries.ratings(spark, SF01))}
    good = [d for d, g in rated.items() if g == 2]
    toxic = [d for d, g in rated.items() if g == 0]
    assert sum(d in kept for d in good) > 0.95 * len(good) and sum(d in kept for d in toxic) < 0.3 * len(toxic)


def test_one_document_of_each_group_stays(steps):
    want = groups_by_hand([(r["doc_id"], r["text"]) for r in steps["quality"]])
    assert sorted(r["doc_id"] for r in steps["near_duplicates"]) == sorted({g for _, g in want.values()})


def test_secrets_are_masked_and_nothing_else(steps):
    before = {r["doc_id"]: r for r in steps["near_duplicates"]}
    assigned = re.compile(r'token = "([0-9a-f]{40})"')
    changed = 0
    for r in steps["secrets"]:
        old = before.pop(r["doc_id"])
        text = assigned.sub('token = "[SECRET]"', old["text"])
        assert r["text"] == text and (r["lang"], r["source"]) == (old["lang"], old["source"])
        assert r["n_chars"] == (len(text) if text != old["text"] else old["n_chars"])
        changed += text != old["text"]
    assert not before and changed


def test_mix_meets_its_targets(steps):
    size, taken = defaultdict(int), defaultdict(int)
    for r in steps["secrets"]:
        size[r["source"]] += len(WORDS.findall(r["text"]))
    for r in steps["mix"]:
        taken[r["source"]] += len(WORDS.findall(r["text"]))
    target = targets_by_hand(size)
    assert max(Counter(r["doc_id"] for r in steps["mix"]).values()) <= 3
    assert abs(sum(taken.values()) - sum(size.values())) < 0.15 * sum(size.values())
    # Whole documents: some of a source's largest ones more or less.
    top = {s: max(len(WORDS.findall(r["text"])) for r in steps["secrets"] if r["source"] == s) for s in target}
    assert all(abs(taken[s] - target[s]) < 0.3 * target[s] + 2 * top[s] for s in target)


def test_encoded_texts(steps):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    ids = {r["doc_id"]: library.encode(r["text"], add_special_tokens=False).ids for r in steps["mix"]}
    text = {r["doc_id"]: r["text"] for r in steps["mix"]}
    assert Counter(r["doc_id"] for r in steps["encode"]) == Counter(r["doc_id"] for r in steps["mix"])
    for r in steps["encode"]:
        assert r["ids"] == ids[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["decoded_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()


def test_run_equals_the_stages(spark, steps):
    assert Counter(r["ids_sha256"] for r in collect(cp.run(spark, SF01))) == Counter(r["ids_sha256"] for r in steps["encode"])


def test_edge_rows_through_every_stage(spark):
    for name, step in cp.STAGES:
        e = edge(spark, clash=("id", "kept", "fp", "row", "copy", "redacted"))
        out = step(spark, e, SF)
        if name != "encode":
            assert out.columns == e.columns
        assert len(collect(out)) <= 45
        assert collect(step(spark, spark.createDataFrame([], SCHEMA), SF)) == []
