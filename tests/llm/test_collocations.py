import random
import re
import sys
from collections import Counter

import edge_rows
import numpy as np
import pyarrow as pa
import pytest

from tidepanel.llm import collocations


def plain(rows, least, most, top):
    """All counts by hand, in Python's whole numbers."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, most + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    around = Counter()
    for (of, x), b in found.items():
        for i in range(len(x)):
            for j in range(i + 2, len(x) + (i > 0)):
                around[of, x[i:j]] = max(around[of, x[i:j]], b)
    out = []
    for lang in n:
        kept = []
        for (of, w), a in found.items():
            if of != lang:
                continue
            if 100 * around[of, w] >= 50 * a:
                continue
            cuts = [(10**6 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            kept.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1)]
    return sorted(out)


def run(spark, rows, **how):
    docs = spark.createDataFrame([(x, t, "z", 7) for x, t in rows], "lang string, text string, phrase string, n int")
    return sorted(map(tuple, collocations.mine(docs, **how).collect()))


@pytest.mark.parametrize("most, every, seed", [(3, 24, 1), (3, 1, 2), (2, 5, 3), (4, 3, 4)])
def test_against_counting_by_hand(spark, monkeypatch, most, every, seed):
    monkeypatch.setattr(collocations, "BLOCK_BYTES", 4000)  # several blocks
    rng = random.Random(seed)
    words = [*"abcdefgh", "Ä", "x y", "É", "NEW", "new", "\x1f"]
    marks = [" ", "  ", "\t", ". ", ",", "\n", "\r\n", " ; "]
    make = lambda: "".join(rng.choice(words) + rng.choice(marks[: rng.randint(1, len(marks))]) for _ in range(rng.randint(0, 150)))
    rows = [(rng.choice(["en", "de", None, "und"]), make()) for _ in range(80)]
    copied = make() + " a b c d e f"
    rows += [("en", copied)] * 40 + [("en", None), ("fr", ""), (None, " . "), ("en", "lone")]
    want = plain(rows, 3, most, 25)
    assert want and run(spark, rows, min_count=3, max_words=most, every=every, top=25) == want


def test_chunks_start_each_gram_once():
    """Whatever the residue, the grams before the closing windows of all chunks are those of the text."""
    rng = random.Random(9)
    for width in (1, 2, 3):
        for every in (1, 2, 7, 1000):
            text = " ".join(rng.choice(["a", "b", "c.", "d"]) for _ in range(200))
            row = collocations.tokens(text) + [collocations.SEPARATOR] * width
            got = [tuple(c.split(b" ")[i : i + width + 1]) for c in collocations.parse(text, width, every, collocations.Hashes()) for i in range(len(c.split(b" ")) - width)]
            assert got == [tuple(row[i : i + width + 1]) for i in range(len(row) - width)]


def test_chunks_of_many_texts_are_those_of_each():
    rng = random.Random(5)
    for width, every in ((1, 1), (1, 24), (2, 3), (2, 24), (3, 2), (3, 1000)):
        texts = [None, "", " \t ", ".", "one", "Ä.B c", "a\x1fb\u00a0c\x85d"]
        texts += ["".join(rng.choice(["a", "B", "é", "\U0001f600"]) + rng.choice([" ", "  ", "\t", ". ", "\r\n"]) for _ in range(rng.randint(0, 60))) for _ in range(40)]
        rng.shuffle(texts)
        want = [(i, c) for i, t in enumerate(texts) for c in collocations.parse(t, width, every, collocations.Hashes())]
        of, got = collocations.parse_all(texts, width, every)
        assert list(zip(of.tolist(), got)) == want
        assert collocations.parse_all([None, ""], width, every)[1] == []


def calls(work, column_rows, names):
    """Calls of functions, Python's and C's, while a task's work runs over one batch."""
    batch, seen = pa.record_batch([pa.array(c) for c in zip(*column_rows)], names=names), Counter()
    sys.setprofile(lambda frame, event, arg: seen.update([event]))
    try:
        out = list(work(iter([batch])))
    finally:
        sys.setprofile(None)
    assert sum(map(len, out))
    return seen["call"] + seen["c_call"]


def test_work_of_a_task_does_not_call_for_each_word():
    """Of as many texts with ten times the words, all different, the calls stay as they are but for those of more chunks."""
    few, many = ([("en", " ".join(f"w{i}x{k}" for k in range(n))) for i in range(20)] for n in (100, 1000))
    assert calls(collocations._parsed(2, 10**9), many, ["lang", "text"]) < 1.5 * calls(collocations._parsed(2, 10**9), few, ["lang", "text"])
    full = np.full(16, -1).astype(np.uint64)
    for words, table in ((1, None), (2, full), (3, full)):
        chunked = [[(lang, t.encode() + b" \xff \xff", 1) for lang, t in rows] for rows in (few, many)]
        one, ten = (calls(collocations._counted(words, 2, table), rows, ["lang", "chunk", "n"]) for rows in chunked)
        assert ten < 1.5 * one


def test_equal_passages_give_equal_chunks():
    rng = random.Random(2)
    shared = " ".join(f"w{rng.randrange(500)}" for _ in range(400))
    a, b = (set(collocations.parse(head + shared, 2, 8, collocations.Hashes())) for head in ("one two three ", "other words lead here "))
    assert len(a & b) > 0.9 * len(a)


def test_counts_beyond_64_bits_of_product_and_ties(spark):
    big = 3_000_000_000_000
    frequent = {
        1: spark.createDataFrame([("en", w, big) for w in ("a", "b", "c")], "lang string, phrase string, n long"),
        2: spark.createDataFrame([("en", "a b", big - 1), ("en", "b c", 10), ("en", "c a", 10)], "lang string, phrase string, n long"),
    }
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    got = collocations.ranked(frequent, totals, 2).orderBy("rank").collect()
    assert [(r.phrase, r.score) for r in got] == [("a b", 10**6 * (big - 1) ** 2 // big**2), ("b c", 0)]


def test_a_full_bit_table_changes_nothing(spark, monkeypatch):
    rows = [("en", " ".join("abcd"[i * i % 4] for i in range(k))) for k in range(60)]
    want = run(spark, rows, min_count=2)
    monkeypatch.setattr(collocations, "bit_table", lambda frequent: np.full(16, -1).astype(np.uint64))
    assert run(spark, rows, min_count=2) == want == plain(rows, 2, 3, 2000)


def test_languages_by_any_name(spark):
    """An empty one, one with a blank, one told apart by case, and null, whose rows count as und."""
    rows = [(lang, "a b c. b c d\ta B") for lang in ("", "a b", "EN", "en", None, "und")] * 3
    assert run(spark, rows, min_count=2) == plain(rows, 2, 3, 2000)


def test_edges(spark):
    got = sorted(map(tuple, collocations.mine(edge_rows.table(spark), min_count=2).collect()))
    assert got == plain([(None, r[1]) for r in edge_rows.rows()], 2, 3, 2000)
    assert collocations.mine(edge_rows.empty(spark)).collect() == []
    assert collocations.mine(spark.createDataFrame([(None, None)], "text string, lang string")).collect() == []
    with pytest.raises(ValueError):
        collocations.mine(edge_rows.table(spark), max_words=1)
