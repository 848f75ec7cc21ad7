import itertools
import random

import edge_rows
import pytest
import xxhash

from tidepanel.llm import simhash


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def groups(fps):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            label[root(i)] = root(j)
    return [root(i) for i in range(len(fps))]


def test_any_five_positions_hold_a_set():
    for width in range(1, 6):
        sets = simhash.position_sets(width)
        assert all(any(set(s) <= set(five) for s in sets) for five in itertools.combinations(range(8), 5))


@pytest.mark.parametrize("width,block", [(2, 4096), (3, 4), (4, 4096), (5, 2)])
def test_links_join_all_near_fingerprints(spark, monkeypatch, width, block):
    rng = random.Random(width)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for fp in list(fps)[:25]:
        for _ in range(4):
            fps.add(fp := fp ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4]))))
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "list_width", lambda n, bits=3: width)
    table = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    got = {frozenset((r.a & (2**64 - 1), r.b & (2**64 - 1))) for r in simhash.links(table, block=block).collect()}
    assert all((a ^ b).bit_count() <= 3 for a, b in map(tuple, got))
    label = {f: f for f in fps}
    for _ in fps:
        for pair in got:
            a, b = pair
            label[a] = label[b] = min(label[a], label[b])
    want = groups(fps)
    for i, j in itertools.combinations(range(len(fps)), 2):
        assert (want[i] == want[j]) == (label[fps[i]] == label[fps[j]])


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").unionAll(
        edge_rows.table(spark).select(edge_rows_id(), "text")
    )
    rows = docs.collect()
    fps = [plain_fingerprint(r.text) for r in rows]
    label = groups(fps)
    least = {}
    for r, k in zip(rows, label):
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = sorted((repr(r.doc_id), f"{f:016x}", least.get(k)) for r, f, k in zip(rows, fps, label))
    got = sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want


def edge_rows_id():
    from pyspark.sql import functions as F

    return (F.col("doc_id") + 100000).alias("doc_id")


def test_empty_table(spark):
    assert simhash.near_duplicates(edge_rows.empty(spark)).collect() == []
