import edge_rows
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import quality_classifier, toxicity

DIR = "/root/testdata/sf0.1"


@pytest.mark.parametrize("op,label,least,wrong", [(quality_classifier, "quality", 0.9, 0.02), (toxicity, "toxic", 0.55, 0.01)])
def test_held_out_accuracy(spark, op, label, least, wrong):
    """Some labels are noise, so toxic recall has a ceiling of about nine tenths."""
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    rows = op.score(docs, op.fit(docs, labels)).where("held_out").join(labels, "doc_id").groupBy(label, "predicted").count().collect()
    n = {(r[label], r.predicted): r["count"] for r in rows}
    rare = 0 if label == "quality" else 1
    found = n.get((rare, rare), 0) / sum(v for k, v in n.items() if k[0] == rare)
    false = n.get((1 - rare, rare), 0) / sum(v for k, v in n.items() if k[0] != rare)
    assert found >= least and false <= wrong


@pytest.mark.parametrize("op,label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_held_out_labels_are_never_read(spark, op, label):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = op.remainder(F.col("doc_id"), op.FOLDS) == op.HELD_OUT
    other = labels.withColumn(label, F.when(held, 1 - F.col(label)).otherwise(F.col(label)))
    score = lambda y: [tuple(r) for r in op.score(docs, op.fit(docs, y)).orderBy("doc_id").collect()]
    assert score(labels) == score(other)


@pytest.mark.parametrize("op,label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_edges(spark, op, label):
    docs = edge_rows.table(spark)
    labels = spark.createDataFrame([(4, 1), (7, 0), (8, None), (None, 1), (99, 1)], f"doc_id long, {label} int")
    rows = op.score(docs, op.fit(docs, labels)).collect()
    assert len(rows) == len(edge_rows.rows()) and all(0 <= r.score <= 1 for r in rows)
    bare = op.score(docs, op.fit(docs, labels.limit(0))).collect()
    assert {r.score for r in bare} == {0.5}
    assert op.score(edge_rows.empty(spark), op.fit(edge_rows.empty(spark), labels)).collect() == []
