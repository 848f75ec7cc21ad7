import corpus_pipeline
import edge_rows
import pytest
import test_suffix_dedup
import test_word_sets

import __spark_entry__ as entry
from checks.compare import compare, connect
from tidepanel.llm import queries
from tidepanel.llm.common import stored

DIR = "/root/testdata/sf0.001"
BENCH_WORDS = 10


def plain_words(text):
    out, word = [], []
    for c in text:
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if ord(c) > 127 or c.isascii() and c.isalnum():
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out + (["".join(word)] if word else [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_against_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, DIR), connect(DIR), queries.ORACLES[name]) == ""


def test_stages_against_brute_force(spark):
    """Each stage on what the one before kept, with plain Python beside it."""
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = [plain_words(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    windows = {tuple(b[i : i + BENCH_WORDS]) for b in bench for i in range(max(1, len(b) - BENCH_WORDS + 1))}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DIR), name)
        rows = {r.doc_id: r for r in docs.collect()}
        ids, texts = list(before), list(before.values())
        if name == "quality_rules":
            verdict = {r.doc_id: r.kept for r in queries.QUERIES["op6_quality_rules"](spark, DIR).collect()}
            want = {i: t for i, t in before.items() if verdict[i]}
        elif name == "simhash_near_dedup":
            label = test_word_sets.groups(texts)
            first = {k: min(i for i, x in zip(ids, label) if x == k) for k in set(label)}
            want = {i: before[i] for i in first.values()}
        elif name == "suffix_array_dedup":
            want = {i: c[3].decode(errors="ignore") for i, c in zip(ids, test_suffix_dedup.cut(texts, 200))}
        elif name == "benchmark_decontamination":
            hit = lambda t: any(tuple(w[i : i + BENCH_WORDS]) in windows for w in [plain_words(t)] for i in range(len(w)))
            want = {i: t for i, t in before.items() if not hit(t)}
        else:
            assert set(rows) == set(before) and all(r.round_trip for r in rows.values())
            break
        assert {i: r.text for i, r in rows.items()} == want
        before = want
    ran = corpus_pipeline.run(spark, DIR).collect()
    assert sorted((r.doc_id, tuple(r.tokens)) for r in ran) == sorted((r.doc_id, tuple(r.tokens)) for r in rows.values())


def test_stages_on_edges(spark):
    for docs in (edge_rows.table(spark), edge_rows.empty(spark)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, DIR), name)
            assert out.count() <= n
            if name != "sentencepiece_encoding":
                assert out.schema.simpleString() == docs.schema.simpleString()


def test_near_duplicates_leave_one_row(spark):
    docs = edge_rows.table(spark)
    rows = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, DIR).collect()
    assert len(rows) == len(set(test_word_sets.groups([r[1] for r in edge_rows.rows()])))


def test_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert len(corpus_pipeline.STAGES) in (4, 5)


def test_one_row_per_document(spark):
    n = spark.read.parquet(f"{DIR}/documents.parquet").count()
    # Phrases and components are no documents.
    for name in queries.QUERIES.keys() - {"op11_collocations", "op13_embedding_whitening"}:
        rows = queries.QUERIES[name](spark, DIR).select("doc_id")
        assert rows.count() == n and rows.distinct().count() == n, name


