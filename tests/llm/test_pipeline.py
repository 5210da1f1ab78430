"""The corpus pipeline stage by stage against brute force, on nulls, repeated rows, copies and empty tables."""

import random

import pytest

import corpus_pipeline
from ragscope.llm.mixing import curriculum_mix

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, n):
    return " ".join("".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(11)
    item = prose(rng, 16)
    rows = [(i, prose(rng, rng.randrange(60, 120)), "en", rng.choice(["a", "a", "b", None]), 9) for i in range(60)]
    copies = [(100 + i, rows[i][1] + " end" * (i % 3), "en", "b", None) for i in range(10)]
    leaks = [(200 + i, prose(rng, 40) + " " + item + " " + prose(rng, 40), None, "a", 1) for i in range(3)]
    odd = [(300, None, None, None, None), (301, "", "en", "b", 0), (302, "few words", "en", "a", 9), (303, "again and " * 60, "en", "a", 2)]
    d = str(tmp_path_factory.mktemp("tables"))
    docs = rows + copies + leaks + odd + rows[:2]
    spark.createDataFrame(docs, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0), 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, prose(rng, 20))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """Each stage's rows, written and read again as the next one's input, and what the last one returns."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, sf_dir)
        path = str(tmp_path_factory.mktemp("stage") / name)
        made.write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def keyed(df):
    return sorted((r["doc_id"], r["text"] or "", r["source"] or "") for r in df.collect())


def test_quality_drops_by_the_fixed_rules_at_least(stages):
    before, after = stages["quality_rules"]
    assert after.columns == before.columns
    kept = {r["doc_id"] for r in after.collect()}
    assert not kept & {300, 301, 302, 303} and len(kept) > 40 and set(keyed(after)) <= set(keyed(before))


def test_one_document_of_each_group_stays(stages):
    before, after = stages["near_dedup"]
    rows = before.collect()
    sets = {}
    for r in rows:
        w = r["text"].lower().split()
        sets[r["doc_id"]] = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    parent = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for i in sets:
            for j in sets:
                if parent[i] != parent[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                    parent[i] = parent[j] = min(parent[i], parent[j])
                    changed = True
    keep = {i for i in sets if parent[i] == i}
    assert keyed(after) == sorted((r["doc_id"], r["text"], r["source"] or "") for r in rows if r["doc_id"] in keep)
    assert len(keep) < len(sets)


def test_passages_of_the_benchmark_go(stages):
    before, after = stages["decontamination"]
    assert {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()} == {200, 201, 202} & {r["doc_id"] for r in before.collect()}


def test_mix_repeats_documents_in_training_order(stages):
    before, after = stages["source_mixing"]
    assert after.columns == before.columns
    want = sorted((p, r["doc_id"]) for r in curriculum_mix(before, keep=["doc_id"]).collect() for p in r["positions"])
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(i for _, i in want)
    # The token files hold the documents in the order of their training positions.
    files = sorted(stages["token_output"][1].collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in files] == [i for _, i in want]
    at = 0
    for r in files:
        assert r["start"] == at
        at += r["n_tokens"]


def test_run_and_empty_tables(spark, sf_dir, stages, tmp_path):
    want = sorted(map(tuple, stages["token_output"][1].collect()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect())) == want
    for name, kind in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
