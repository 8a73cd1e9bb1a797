import importlib.util
import os

import corpus_pipeline

from tokentide.llm import bpe, pseudonyms
from tokentide.llm.queries import PII_KEY, vocabulary


def brute(name):
    """The brute-force functions of a neighbouring test module."""
    path = os.path.join(os.path.dirname(__file__), f"test_{name}.py")
    spec = importlib.util.spec_from_file_location(f"brute_{name}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def write(spark, folder, docs, items):
    docs.write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_run_against_brute_force(spark, docs, corpus, tmp_path):
    texts = {i: t for i, t, _ in corpus}
    victim = next(i for i, t, _ in corpus if t and 60 < len(t.split()) < 150 and "Shared" not in t)
    items = [(1, " ".join(texts[victim].split()[5:45]))]
    more = spark.createDataFrame(
        [(400, "call +1 (988) 555-2485 " + " ".join(f"w{k}" for k in range(50)), "en", "h1", 0, 1.0, "k", 1, True)], docs.schema
    )
    folder = write(spark, tmp_path, docs.unionByName(more), spark.createDataFrame(items, "item_id long, text string"))

    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}

    rows = [*corpus, (400, "call +1 (988) 555-2485 " + " ".join(f"w{k}" for k in range(50)), "h1")]
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality_rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).collect()}
    assert set(kept) == {i for i, v in brute("quality").brute(rows).items() if v[6]}
    groups = brute("jaccard").brute(list(kept.items()))
    left = [(i, kept[i]) for i, n, c in groups if i == c or n == 0]
    assert len(left) < len(kept)
    leaks = {i for i, _ in brute("decontaminate").brute(left, items)}
    assert leaks
    want = {i: t for i, t in left if i not in leaks}
    assert set(got) == set(want)
    codec = bpe.codec(*vocabulary())
    named = spark.createDataFrame(list(want.items()), "doc_id long, text string")
    for r in pseudonyms.replaced(named, PII_KEY).collect():
        assert got[r.doc_id].text == r.text and got[r.doc_id].ids == codec.encode(r.text) and got[r.doc_id].round_trip
        assert got[r.doc_id].n_tokens == len(got[r.doc_id].ids)
    assert "988" not in got[400].text.split(" w0")[0] and victim not in got


def test_stages_keep_the_columns(spark, docs, null_rows, tmp_path):
    folder = write(spark, tmp_path, docs, spark.createDataFrame([(1, "not there")], "item_id long, text string"))
    more = null_rows.selectExpr("*", "1 AS hash", "'a' AS v_id", "2 AS n_replaced")
    for _, step in corpus_pipeline.STAGES[:-1]:
        found = step(spark, more, folder)
        assert found.columns == more.columns and found.count() <= 6
    assert corpus_pipeline.token_ids(spark, null_rows, folder).where("doc_id = 5").first().ids == []


def test_empty_tables(spark, no_docs, tmp_path):
    folder = write(spark, tmp_path, no_docs, spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, folder).collect() == []
