import itertools
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepanel.llm import masked_lm


def test_border_of_the_vocabulary_is_filled_in_byte_order(spark):
    rare = [f"w{i:05}" for i in range(9000)]
    docs = spark.createDataFrame(list(enumerate([("the of and " * 5000).strip(), *rare])), "doc_id long, text string")
    vocab = masked_lm.vocabulary(docs)
    room = masked_lm.PAD - masked_lm.SHARED
    assert vocab == [(b"and", 5000), (b"of", 5000), (b"the", 5000), *((w.encode(), 1) for w in rare[: room - 3])]


def test_words_of_many_texts_are_those_of_each():
    texts = [None, "", " \t", "The THE  İstanbul ΣΑΣ\n", "a\x1fb c\x0b\x0cd\r", "\u00a0x\u2003y", "one", "\x00 \U0001f600 ß"]
    sizes, row = masked_lm.split(texts)
    assert sizes.tolist() == [len(masked_lm.words(t)) for t in texts]
    assert row.cast("binary").to_pylist() == [w for t in texts for w in masked_lm.words(t)]
    known = {b"the": 130, b"x": 3}
    ids, _ = masked_lm.encode(texts, known)
    gap = [masked_lm.PAD] * masked_lm.SIDE
    assert ids.tolist() == gap + [i for t in texts for i in [*(known.get(w, masked_lm.shared_number(w[0])) for w in masked_lm.words(t)), *gap]]
    assert masked_lm.encode([], known)[0].tolist() == gap and masked_lm.encode(texts, {})[0].max() == masked_lm.PAD


def test_texts_are_split_once_for_training_and_scoring(spark):
    """One reading counts the words, one gives their numbers; a third would split the texts again."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    texts = ["the zebra of " * 30, "the and", "", None, "yak  the"]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    once = rows.withColumn("text", F.udf(read, "string")("text"))
    got = masked_lm.fit_and_score(once, carry=["doc_id", "ids"])
    assert got.columns == ["doc_id", "ids", *masked_lm.SCORED.names]
    got = {r.doc_id: r for r in got.collect()}
    assert seen.value == 2 * len(texts)
    assert masked_lm.fit_and_score(rows, carry=["text"]).where("text is null").first().n_tokens == 0
    counted = masked_lm.word_counts(rows)
    vocab = masked_lm.vocabulary(rows, counted=counted)
    pairs, shared = masked_lm.spelling(counted, vocab)
    want = masked_lm.score(rows, masked_lm.fit(rows, vocab=vocab, shared=shared), pairs=pairs)
    for r in want.collect():
        assert got[r.doc_id].n_tokens == r.n_tokens == len(masked_lm.words(texts[r.doc_id])) and got[r.doc_id].ids == "x"
        assert got[r.doc_id].log_likelihood == pytest.approx(r.log_likelihood, abs=0.02)
    with pytest.raises(ValueError):
        masked_lm.fit_and_score(rows.withColumnRenamed("ids", "n_tokens"), carry=["n_tokens"])


def test_byte_pairs_against_counting(spark):
    words = {b"ab": 3, b"a": 2, b"abc": 1, "é".encode(): 4}
    counted = spark.createDataFrame([(bytearray(w), n) for w, n in [*words.items(), (b"often", 50)]], "word binary, n long")
    pairs, first = masked_lm.spelling(counted, [(b"often", 50)])
    assert [(b, n) for b, n in enumerate(first) if n] == [(97, 6), (0xC3, 4)]
    after_a = np.ones(257)
    after_a[[98, 256]] += [4, 2]
    assert np.allclose(pairs[97], np.log(after_a / after_a.sum()))
    assert np.allclose(np.exp(pairs).sum(axis=1), 1)


def test_all_words_sum_to_one():
    """Of three letters and all lengths up to six, with the rest of the mass on longer words and other bytes."""
    rng = np.random.default_rng(0)
    pairs = np.full((256, 257), -np.inf)
    letters = [97, 98, 99]
    for b in letters:
        share = rng.dirichlet([1, 1, 1, 4])
        pairs[b, [*letters, 256]] = np.log(share)
    total = {k: np.exp(masked_lm.spelt([bytes((97, *rest)) for n in range(k) for rest in itertools.product(letters, repeat=n)], pairs)).sum() for k in (1, 4, 9)}
    assert total[1] < total[4] < total[9] <= 1 + 1e-12 and total[9] > 0.95


def plain_spelling(word, pairs):
    return sum(pairs[a, b] for a, b in zip(word, [*word[1:], 256]))


def test_scores_of_rare_words(spark):
    docs = spark.createDataFrame(list(enumerate(["the of and the of and"] * 40 + ["zebra zeal the", "yak"])), "doc_id long, text string")
    counted = masked_lm.word_counts(docs)
    vocab = masked_lm.vocabulary(docs, counted=counted)[:3]
    pairs, shared = masked_lm.spelling(counted, vocab)
    assert shared[ord("z")] == 2 and shared[ord("y")] == 1 and sum(shared) == 3
    model = masked_lm.numbers(vocab), masked_lm.initial(vocab, shared)
    rows = spark.createDataFrame([(1, "zebra the zorro"), (2, "the"), (3, None), (4, "")], "doc_id long, text string")
    plain = {r.doc_id: r for r in masked_lm.score(rows, model).collect()}
    got = {r.doc_id: r for r in masked_lm.score(rows, model, pairs=pairs).collect()}
    assert got[1].log_likelihood == pytest.approx(plain[1].log_likelihood + sum(plain_spelling(x, pairs) for x in (b"zebra", b"zorro")))
    assert got[2].log_likelihood == pytest.approx(plain[2].log_likelihood)
    assert got[3].n_tokens == 0 and got[4].mean_log_likelihood is None
    clash = spark.createDataFrame([(1, "the", "x", 7)], "doc_id long, text string, row string, n long")
    assert masked_lm.score(clash, model, carry=["doc_id", "row", "n"], pairs=pairs).first()["n"] == 7
    with pytest.raises(ValueError):
        masked_lm.score(clash.withColumnRenamed("row", "n_tokens"), model, carry=["n_tokens"])


def loss(flat, ids):
    return -masked_lm.log_probabilities(masked_lm.unpack(flat), ids).mean()


def test_gradient_against_differences(monkeypatch):
    """One step moves each weight by the rate times g / sqrt(0.01 + g * g); g is taken from differences of the loss."""
    monkeypatch.setattr(masked_lm, "WIDTH", 3)
    vocab = [(bytes([97 + i]), 30 - i) for i in range(20)]
    rng = np.random.default_rng(5)
    start = masked_lm.initial(vocab, [0] * 256)
    known = masked_lm.numbers(vocab)
    ids, _ = masked_lm.encode([" ".join(chr(97 + i) for i in rng.integers(0, 22, 40)), "", "a", "b c"], known)
    trainer = masked_lm.Trainer(start, rate=1.0)
    trainer.step(ids)
    moved = start - trainer.flat
    assert loss(trainer.flat, ids) < loss(start, ids)
    for at in np.r_[rng.choice(np.flatnonzero(np.abs(moved) > 1e-2), 25, replace=False)]:
        up, down = start.copy().astype(np.float64), start.copy().astype(np.float64)
        up[at] += 1e-3
        down[at] -= 1e-3
        g = 32 * (loss(up, ids) - loss(down, ids)) / 2e-3
        assert moved[at] == pytest.approx(g / np.sqrt(0.01 + g * g), abs=2e-2)


def plain_step(w, seen, ids, rate):
    """Token by token in double precision."""
    side, grad = masked_lm.SIDE, {k: np.zeros_like(v) for k, v in w.items()}
    tokens = [t for t in range(side, len(ids) - side) if ids[t] != masked_lm.PAD]
    for t in tokens:
        around = [int(ids[t + o]) for o in range(-side, side + 1) if o]
        h = np.tanh((w["embed"][around] * w["place"]).sum(axis=0) + w["shift"])
        kind, member = divmod(int(ids[t]), masked_lm.MEMBERS)
        back = 0
        for matrix, of, target in ((w["kind"], grad["kind"], kind), (w["word"][kind], grad["word"][kind], member)):
            p = np.exp(np.r_[h, 1] @ matrix)
            p /= p.sum()
            p[target] -= 1
            p *= 32 / len(tokens)
            of += np.outer(np.r_[h, 1], p)
            back = back + matrix[:-1] @ p
        back = back * (1 - h * h)
        grad["shift"] += back
        grad["place"] += back * w["embed"][around]
        np.add.at(grad["embed"], around, back * w["place"])
    for k in w:
        seen[k] += grad[k] ** 2
        w[k] -= rate * grad[k] / np.sqrt(seen[k])


def test_steps_of_all_lengths_against_plain_ones(monkeypatch):
    """A step on arrays of longer and shorter ones before it gives what a step on arrays of its own does."""
    monkeypatch.setattr(masked_lm, "WIDTH", 5)
    rng = np.random.default_rng(7)
    trainer = masked_lm.Trainer(masked_lm.initial([], [0] * 256), rate=0.1)
    w = {k: v.astype(np.float64) for k, v in trainer.w.items()}
    seen = {k: np.full(v.shape, 1e-2) for k, v in w.items()}
    for n in (90, 1, 15, 16, 17, 0, 40, 33):
        ids = rng.choice(rng.integers(0, masked_lm.PAD, 12), n + 2 * masked_lm.SIDE).astype(masked_lm.KIND)
        ids[rng.random(len(ids)) < 0.1] = masked_lm.PAD
        room = masked_lm.Room()
        assert np.array_equal(masked_lm.log_probabilities(trainer.w, ids, trainer.room), masked_lm.log_probabilities(trainer.w, ids, room))
        trainer.step(ids)
        plain_step(w, seen, ids, 0.1)
        for k in w:
            assert np.allclose(trainer.w[k], w[k], atol=2e-5), (n, k)


def test_steps_take_no_new_memory():
    """Arrays are taken once: the pages of new ones were most of what a step cost."""
    rng = np.random.default_rng(3)
    ids = (rng.zipf(1.3, masked_lm.BATCH + 2 * masked_lm.SIDE) % masked_lm.PAD).astype(masked_lm.KIND)
    trainer = masked_lm.Trainer(masked_lm.initial([], [0] * 256))
    peaks = []
    for work in (trainer.step, lambda ids: masked_lm.log_probabilities(trainer.w, ids, trainer.room)):
        work(ids)
        tracemalloc.start()
        work(ids)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert max(peaks) < 1 << 20


def plain_fit(texts, vocab, shared):
    """Stretch by stretch, one text list after the other, without Spark."""
    known = masked_lm.numbers(vocab)
    trainer = masked_lm.Trainer(masked_lm.initial(vocab, shared))
    ids, _ = masked_lm.encode(texts, known)
    for lo in range(0, len(ids) - 2 * masked_lm.SIDE, masked_lm.BATCH):
        trainer.step(ids[lo : lo + masked_lm.BATCH + 2 * masked_lm.SIDE])
    return trainer.flat


def test_fit_against_a_plain_trainer(spark):
    rng = np.random.default_rng(2)
    parts = [[" ".join(f"w{k}" for k in rng.zipf(1.4, 200) % 50) for _ in range(30)] for _ in range(3)]
    parts = [[t for t in p] for p in parts]
    docs = spark.sparkContext.parallelize([(i, t) for i, p in enumerate(parts) for t in p], 3).toDF("doc_id long, text string")
    counted = masked_lm.word_counts(docs)
    vocab = masked_lm.vocabulary(docs, counted=counted)
    shared = masked_lm.spelling(counted, vocab)[1]
    weights = [plain_fit(p, vocab, shared).astype(np.float64) for p in parts]
    n = [sum(len(t.split()) for t in p) for p in parts]
    want = sum(w * k for w, k in zip(weights, n)) / sum(n)
    assert np.allclose(masked_lm.fit(docs, counted=counted)[1], want, atol=1e-5)


def test_every_document_is_trained_on(spark):
    docs = spark.createDataFrame([(1, "one small text of a few words"), (2, "")], "doc_id long, text string")
    for i in (1, 2):
        one = docs.where(f"doc_id = {i}")
        counted = masked_lm.word_counts(one)
        vocab = masked_lm.vocabulary(one, counted=counted)
        start = masked_lm.initial(vocab, masked_lm.spelling(counted, vocab)[1])
        assert np.array_equal(masked_lm.fit(one)[1], start) == (i == 2)
