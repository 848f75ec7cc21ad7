import random
import textwrap

import edge_rows
import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidepanel.llm import decontamination, licenses, masked_lm, quality_rules, sharding
from tidepanel.llm import sentencepiece_codec as codec


def brute_rules(text, least):
    words = (text or "").encode().split()
    n = len(words)
    longest = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i] = max(longest[i], k)
    inside = lambda m: len({p for i in range(n) if longest[i] >= m for p in range(i, i + longest[i])})
    return n, inside(3), inside(least), max(longest, default=0)


def test_rules_against_brute_force(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(0, 120))) for _ in range(60)] + [None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: (r.n_words, r.n_repeat_words, r.covered_words, r.longest_repeat) for r in quality_rules.quality_rules(docs, min_repeat=5).collect()}
    assert got == {i: brute_rules(t, 5) for i, t in enumerate(texts)}


def test_rules_on_edges(spark):
    rows = {repr(r.doc_id) + str(r.n_words): r for r in quality_rules.quality_rules(edge_rows.table(spark)).collect()}
    assert len(quality_rules.quality_rules(edge_rows.table(spark)).collect()) == len(edge_rows.rows())
    assert rows["10"].base_failed and not rows["10"].kept and rows["10"].word_chars == 0
    assert quality_rules.quality_rules(edge_rows.empty(spark)).collect() == []
    with pytest.raises(ValueError):
        quality_rules.quality_rules(edge_rows.table(spark), carry=["doc_id", "kept"])


def test_phrases_and_proximity(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "x One two, THREE four five six y"), (2, "six five four three two one"), (3, None), (4, ""), (1, "x One two, THREE four five six y"), (None, "two three four")],
        "doc_id long, text string",
    )
    bench = spark.createDataFrame([(7, "one two three four five six"), (8, "zzz"), (9, None), (None, "one"), (10, "three four")], "item_id long, text string")
    for size in (16 << 20, 10):  # in one block and in several
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = sorted((repr(r.doc_id), r.n_words, tuple(r.hits), tuple(r["items"])) for r in decontamination.search(docs, bench, 4).collect())
        assert got == sorted(2 * [("1", 8, (1, 2, 3, 4, 5, 6), (7, 10))] + [("2", 6, (), ()), ("3", 0, (), ()), ("4", 0, (), ()), ("None", 3, (1, 2), (10,))])
    near = {r.doc_id: (tuple(r.hits), tuple(r["items"])) for r in decontamination.search(docs, bench, 4, span=4).collect()}
    assert near[2] == ((0, 1, 2, 3, 4, 5), (7, 10))
    assert decontamination.decontaminate(docs.limit(0), bench).collect() == []
    assert {r.contaminated for r in decontamination.decontaminate(docs, bench.limit(0)).collect()} == {False}
    assert len(decontamination.decontaminate(edge_rows.table(spark), bench).collect()) == len(edge_rows.rows())


def test_ring_walk_and_balance(spark):
    owners = sharding.ring_owners(8)
    rng = random.Random(2)
    counts = {a: rng.randint(0, 9) for a in range(len(owners))}
    total = sum(counts.values())
    plan = sharding.plan_arcs(counts, owners, sharding.capacities(total, 8, 0.0))
    room, waiting, walked = sharding.capacities(total, 8, 0.0), [], {}
    for turn in range(2 * len(owners)):  # one key at a time
        arc = turn % len(owners)
        if turn < len(owners):
            waiting += [(arc, r) for r in range(counts[arc])]
        while waiting and room[owners[arc]]:
            walked[waiting.pop(0)] = owners[arc]
            room[owners[arc]] -= 1
    assert {(a, r): s for a, lo, hi, s, _ in plan for r in range(lo, hi)} == walked
    placed = sharding.ring_shards(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    sizes = [sorted(r.slot for r in placed if r.shard == k) for k in range(8)]
    assert all(s == list(range(125)) for s in sizes)


def test_ring_moves_little_with_slack():
    rng = random.Random(3)
    counts = {a: rng.randint(20, 60) for a in range(1 << sharding.RING_BITS)}
    total = sum(counts.values())

    def placed(n):
        plan = sharding.plan_arcs(counts, sharding.ring_owners(n), sharding.capacities(total, n, 0.25))
        return {(a, r): s for a, lo, hi, s, _ in plan for r in range(lo, hi)}

    before, after = placed(8), placed(9)
    assert len(before) == len(after) == total
    assert sum(before[k] != after[k] for k in before) < 0.35 * total


def test_ring_edges(spark):
    rows = sharding.ring_shards(edge_rows.table(spark), 3).collect()
    assert len(rows) == len(edge_rows.rows()) and {r.shard for r in rows} == {0, 1, 2}
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id == 1} == {(1, 0)}
    assert sharding.ring_shards(edge_rows.empty(spark)).collect() == []


def test_codec_agrees_with_the_library_and_round_trips():
    vocabulary = codec.load_pieces()
    sp = sentencepiece.SentencePieceProcessor(model_file=codec.MODEL)
    texts = ["", " ", "  two  blanks ", "the\r\n\x00x", "日本語 🤗 é é", "a" * 300, "ordinary words, and\nlines\n\n", "unbelievable " * 30]
    plain = codec.Codec(*vocabulary, 0.0, 1)
    assert [x.tolist() for x in plain.encode(texts, range(9))] == [sp.encode(t) for t in texts]
    varied = codec.Codec(*vocabulary, 0.3, 1)
    texts += ["the meta symbol ▁ itself"]
    once = [x.tolist() for x in varied.encode(texts, range(9))]
    assert once == [x.tolist() for x in varied.encode(texts, range(9))]
    assert [varied.decode(x) for x in once] == texts
    units = [(u, v) for t in texts for u in set(varied.split(" " + t)) for v in range(4)]
    units = list(dict.fromkeys(units))
    ids, counts = varied.encode_units(units)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [varied.agenda(*u) for u in units]
    assert len({tuple(varied.agenda(" unbelievable", v)) for v in range(16)}) > 1


def test_codec_on_edges(spark):
    made = codec.encode(edge_rows.table(spark).drop("tokens"), carry=["doc_id", "text"])
    rows = codec.decode(made, out="back").collect()
    assert len(rows) == len(edge_rows.rows())
    assert all(r.back == r.text and r.round_trip in (True, None) for r in rows)
    assert {(r.n_tokens, r.tokens is None) for r in rows if r.text is None} == {(None, True)}
    assert codec.encode(edge_rows.empty(spark)).collect() == []


def test_licences(spark):
    mit = "\n\n".join(licenses.TEXTS["MIT"][0])
    texts = [
        mit, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace("AND/OR", "and or"), "Some code.\n\n" + mit + "\n\nmore",
        "words\nReleased under the MIT Licence\nwords", licenses.TEXTS["MIT"][0][0], "not a licence", None, "", "SPDX-License-Identifier: GPL-3.0",
        "x\nlicensed under CC BY-NC 4.0.\nThis work is licensed under the GNU General Public License, version 3.",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.licenses, r.whole_text) for r in licenses.scan(docs).collect()}
    assert got == {
        0: ("MIT", True), 1: ("MIT", True), 2: ("MIT", False), 3: ("MIT", False), 4: ("", False), 5: ("", False), 6: ("", False), 7: ("", False),
        8: ("GPL-3.0", True), 9: ("CC-BY-NC-4.0,GPL-3.0", False),
    }
    assert len(licenses.scan(edge_rows.table(spark)).collect()) == len(edge_rows.rows())
    assert licenses.scan(edge_rows.empty(spark)).collect() == []


def test_network_is_a_distribution_and_learns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    vocab = masked_lm.vocabulary(docs)
    assert 0 < len(vocab) <= masked_lm.PAD - masked_lm.SHARED and vocab == exact_vocabulary(docs)
    known, flat = masked_lm.numbers(vocab), masked_lm.initial(vocab)
    assert len(set(known.values())) == len(known)
    w = masked_lm.unpack(flat)
    ids, _ = masked_lm.encode(["the first text of all", "and another one"], known)
    total = 0.0
    for k in range(masked_lm.PAD):
        ids[masked_lm.SIDE + 2] = k
        total += np.exp(masked_lm.log_probabilities(w, ids)[2])
    assert abs(total - 1) < 1e-3
    model = masked_lm.fit(docs)
    mean = lambda m: masked_lm.score(docs, m).agg(F.sum("log_likelihood") / F.sum("n_tokens")).first()[0]
    assert mean(model) > mean((known, flat)) + 0.1
    rows = masked_lm.score(edge_rows.table(spark), model).collect()
    assert len(rows) == len(edge_rows.rows())
    assert {(r.log_likelihood, r.mean_log_likelihood) for r in rows if r.n_tokens == 0} == {(0.0, None)}
    one = masked_lm.score(spark.createDataFrame([(1, "the of and")], "doc_id int, text string"), model).first()
    ids, _ = masked_lm.encode(["the of and"], model[0])
    assert one.log_likelihood == pytest.approx(sum(brute_log_probability(model[1], ids, i) for i in range(3, 6)), abs=1e-3)


def brute_log_probability(flat, ids, i):
    w = masked_lm.unpack(flat)
    side = masked_lm.SIDE
    around = [ids[i + d] for d in range(-side, side + 1) if d]
    h = np.tanh(sum(w["embed"][k].astype(float) * w["place"][j] for j, k in enumerate(around)) + w["shift"])
    kind, member = divmod(int(ids[i]), masked_lm.MEMBERS)
    a, b = np.r_[h, 1] @ w["kind"], np.r_[h, 1] @ w["word"][kind]
    return a[kind] - np.log(np.exp(a).sum()) + b[member] - np.log(np.exp(b).sum())


def test_training_on_an_empty_table(spark):
    known, flat = masked_lm.fit(edge_rows.empty(spark))
    assert known == {} and np.isfinite(flat).all()


def exact_vocabulary(docs):
    import collections

    count = collections.Counter(w for r in docs.select("text").collect() for w in masked_lm.words(r.text))
    return sorted(count.items(), key=lambda r: (-r[1], r[0]))[: masked_lm.PAD - masked_lm.SHARED]


def test_whole_licence_texts(spark):
    """Every wording counts alone, wrapped with Windows line ends inside a document, and not without a paragraph."""
    assert set(licenses.NAMES) <= set(licenses.TEXTS)
    rows, want = [], {}
    for name, wordings in licenses.TEXTS.items():
        for paragraphs in wordings:
            wrapped = "\r\n\r\n".join("\r\n".join(textwrap.wrap(p, 60)) for p in paragraphs)
            title = f"{licenses.NAMES.get(name, [''])[0]}\n\nCopyright (c) 2020 Someone\n\n"
            parts = [paragraphs[:i] + paragraphs[i + 1 :] for i in range(len(paragraphs)) if len(paragraphs) > 1]
            cut = ["\n\n".join(p) for p in parts if p not in wordings]
            for text, found, whole in (
                ("\n\n".join(paragraphs), True, True), (title + "\n\n".join(paragraphs), True, True),
                (f"Read this.\r\n\r\n{wrapped}\r\n\r\nThe end.", True, False), *[(f"Words.\n\n{c}", False, False) for c in cut],
            ):
                want[len(rows)] = (name, found, whole)
                rows.append((len(rows), text))
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, (name, found, whole) in want.items():
        names = got[i].licenses.split(",") if got[i].licenses else []
        assert got[i].whole_text == whole, rows[i]
        if found:
            assert names == [name], rows[i]
        else:
            assert name not in names, rows[i]


def test_copyright_lines(spark):
    """Lines of a name and a year go; wrapped lines of terms that begin with the same words stay."""
    gone = ["Copyright (c) 2020 A", "copyright 1999-2003 by B", "(C) 2001 C", "\u00a9 D", "Copyright The E Authors", "Copyright: (c) F", "All rights reserved."]
    stay = ["COPYRIGHT HOLDERS BE LIABLE", "copyright notice, this list of conditions", "(c) You must retain all notices"]
    rows = spark.createDataFrame([(x,) for x in gone + stay], "text string").select("text", licenses.canonical(F.col("text")).alias("form"))
    assert {r.text for r in rows.collect() if r.form} == set(stay)
