import collections
import random

import edge_rows
import pytest

from tidepanel.llm import suffix_dedup


def cut(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(d)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(b for b, g in zip(d, gone) if not g)))
    return out


def made(seed):
    rng = random.Random(seed)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [text(rng.randint(40, 400)) for _ in range(6)]
    texts = ["".join(rng.choice([text(rng.randint(0, 90)), rng.choice(shared)]) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    near = text(900)
    for _ in range(12):  # many contexts of the same sampled strings
        at = rng.randrange(len(near))
        texts.append(near[:at] + rng.choice("xyz") + near[at + 1 :])
    return texts + ["a" * 700, "ab" * 300, texts[0], texts[-1], None, ""]


@pytest.mark.parametrize("seed,length,batches,group", [(1, 60, 1, 4096), (2, 60, 5, 1), (3, 200, 2, 4096), (4, 90, 4, 3)])
def test_against_brute_force(spark, monkeypatch, seed, length, batches, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    texts = made(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = suffix_dedup.remove_repeats(docs, length=length, batches=batches).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows}
    assert got == dict(enumerate(cut(texts, length)))


def test_long_texts_are_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 300)
    texts = made(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = suffix_dedup.remove_repeats(docs, length=80).collect()
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in rows} == {i: (c[1], c[3]) for i, c in enumerate(cut(texts, 80))}


def test_levels_merge_as_a_binary_counter(spark):
    family = suffix_dedup.IndexFamily(spark, 200)
    docs = spark.createDataFrame([(i, f"{i} {edge_rows.PASSAGE}") for i in range(6)], "text_hash long, text string")
    taken = []
    for k in range(6):
        family.add(docs.where(f"text_hash = {k}"))
        taken.append([level is not None for level in family.levels])
    assert taken == [[True], [False, True], [True, True], [False, False, True], [True, False, True], [False, True, True]]


def test_edges(spark):
    rows = edge_rows.rows()
    got = suffix_dedup.remove_repeats(edge_rows.table(spark), carry=["doc_id"]).collect()
    want = cut([r[1] for r in rows], 200)
    assert sorted((repr(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == sorted(
        (repr(r[0]), *w) for r, w in zip(rows, want)
    )
    assert suffix_dedup.remove_repeats(edge_rows.empty(spark)).collect() == []
