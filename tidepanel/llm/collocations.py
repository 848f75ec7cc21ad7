"""Phrase mining over a prefix-free parse.

Texts become words and separators. Where the hash of a window of ``max_words - 1`` words hits a residue, a chunk ends
and the next one starts; the window belongs to both, so equal passages give equal chunks wherever they stand. Chunks are
collected in a dictionary with their frequency in the parse, and n-grams are counted inside distinct chunks, weighted by
that frequency. An n-gram is counted by the chunk in which it starts before the closing window, hence once.

Counting goes by length: an n-gram can only be frequent if both its (n-1)-grams are. Those found so far travel to the
next pass as a bit table. A false hit costs a row of the shuffle and nothing else, so counts stay exact at any size.

Words are split, told apart and joined in Arrow for many texts or chunks at once, and hashed once for each distinct word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import chunks, fields, laid_out, stored

MIN_COUNT, MAX_WORDS, TOP = 10, 3, 2000
#: Share of a phrase's own count (in percent) from which a longer candidate around it replaces it.
COVERED_PERCENT = 50
#: Mean words of a chunk, closing window aside.
EVERY = 24
#: Bytes of text parsed at once.
PARSE_BYTES = 4 << 20
#: Bytes of distinct chunks counted at once.
BLOCK_BYTES = 12 << 20
#: The bit table: bits a phrase, and the most bits in all (32 MB). Beyond, false hits become more frequent.
BITS_A_PHRASE, MOST_BITS = 16, 1 << 28
#: Groups of phrases of a language that are ranked on their own before the last ranking.
RANK_GROUPS = 64

#: No byte of UTF-8: the end of a piece, and the end of a text.
SEPARATOR, END = b"\xff", b"\xfe"
_TRANSLATED = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + SEPARATOR * 10)

PARSED = fields(lang="string", chunk="binary", n="long")
GRAMS = fields(lang="string", phrase="string", n="long")
SLOTS = fields(slot="int", bits="long")
_MULTIPLIER, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words with a separator at each end of a piece."""
    return text.encode().translate(_TRANSLATED).replace(SEPARATOR, b" " + SEPARATOR + b" ").split() if text else []


def _mixed(parts: list[np.ndarray]) -> np.ndarray:
    """Hash of neighbouring words from the hashes of the words."""
    out = np.zeros(len(parts[0]), dtype=np.uint64)
    for part in parts:
        out = (out ^ part) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def word_hashes(words: pa.Array) -> np.ndarray:
    """Hashes of words of a byte or more: sums over the bytes with their places."""
    flat, bounds = laid_out(words)
    if not len(flat):
        return np.empty(0, dtype=np.uint64)
    place = np.arange(len(flat)) - np.repeat(bounds[:-1], np.diff(bounds))
    out = (place * 256 + flat + 1).astype(np.uint64) * _MULTIPLIER
    out ^= out >> np.uint64(29)
    out *= _SECOND
    out ^= out >> np.uint64(32)
    return np.add.reduceat(out, bounds[:-1])


class Hashes(dict):
    """Hashes of words, each made once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = made = int(word_hashes(pa.array([word], pa.binary()))[0])
        return made


def parse(text: str | None, width: int, every: int, known: Hashes) -> list[bytes]:
    """The chunks of a text, each with its closing window of ``width`` words; a text ends with a window of separators."""
    row = tokens(text)
    if not row:
        return []
    row += [SEPARATOR] * max(width, 1)
    last = len(row) - max(width, 1)
    if width:
        hashes = np.fromiter(map(known.__getitem__, row), dtype=np.uint64, count=len(row))
        window = _mixed([hashes[i : len(row) - width + 1 + i] for i in range(width)])
        cuts = np.flatnonzero(window[1:last] % np.uint64(every) == 0) + 1
    else:
        cuts = np.arange(every, last, every)
    at = [0, *cuts.tolist(), last]
    return [b" ".join(row[a : b + width]) for a, b in zip(at, at[1:])]


def _row(joined: bytes) -> pa.Array:
    """Words of a translated text."""
    pieces = pc.split_pattern(pa.array([joined], pa.binary()), pattern=b" ").flatten()
    return pieces.filter(pc.greater(pc.binary_length(pieces), 0))


def parse_all(texts: list[str | None], width: int, every: int) -> tuple[np.ndarray, list[bytes]]:
    """Of all texts the chunks that ``parse`` gives, and the number of the text of each; width 1 or more."""
    closed = b" ".join([b"", *[SEPARATOR] * width, END, b""])
    joined = END.join([*(t.encode() if t else b"" for t in texts), b""]).translate(_TRANSLATED).replace(b"\t", b" ")
    row = _row(joined.replace(SEPARATOR, b" " + SEPARATOR + b" ").replace(END, closed))
    told = row.dictionary_encode()
    ids, end = told.indices.to_numpy(), pc.index(told.dictionary, END).as_py()
    hashes = word_hashes(told.dictionary)[ids]
    ends = np.flatnonzero(ids == end)
    first = np.r_[0, ends[:-1] + 1]
    window = _mixed([hashes[i : len(hashes) - width + 1 + i] for i in range(width)])
    starts = np.zeros(len(ids) + 1, dtype=bool)
    starts[: len(window)] = window % np.uint64(every) == 0
    # No chunk starts at the separators that close a text, one does where a text starts.
    starts[ends[:, None] - np.arange(width + 1)] = False
    starts[first[ends - first > width]] = True
    starts = np.flatnonzero(starts)
    of = np.searchsorted(ends, starts)
    stops = np.where(np.r_[of[1:] == of[:-1], np.zeros(len(of[:1]), dtype=bool)], np.r_[starts[1:], starts[:1]], ends[of] - width)
    flat = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row), b" ")[0].as_py()
    place = laid_out(row)[1] + np.arange(len(row) + 1)
    return of, [flat[a:b] for a, b in zip(place[starts].tolist(), (place[stops + width] - 1).tolist())]


def _by_language(batches: list[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """Rows of each language in one piece; the language is the first column."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    for lang in pc.unique(rows.column(0)):
        yield lang.as_py(), rows.filter(pc.equal(rows.column(0), lang)).combine_chunks()


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _parsed(width: int, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, rows in _by_language(held):
                made = pc.value_counts(_whole(rows.column(1)))
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(made)), made.field(0), made.field(1)], names=PARSED.names)
            held.clear()

        for batch in batches:
            done = 0
            for part in chunks(batch.column(1), PARSE_BYTES):
                of, made = parse_all(part.to_pylist(), width, every)
                lang = batch.column(0).slice(done, len(part)).take(pa.array(of))
                held.append(pa.RecordBatch.from_arrays([lang, pa.array(made, pa.binary())], names=PARSED.names[:2]))
                done, size = done + len(part), size + held[-1].nbytes
                if size > BLOCK_BYTES:
                    yield from emptied()
                    size = 0
        if held:
            yield from emptied()

    return run


def parsed(docs: DataFrame, text: str = "text", lang: str | None = "lang", max_words: int = MAX_WORDS, every: int = EVERY) -> DataFrame:
    """lang, chunk, n: the dictionary of distinct chunks with their frequencies in the parse."""
    language = F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")) if lang else F.lit("und")
    rows = docs.select(language.alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    return stored(rows.mapInArrow(_parsed(max_words - 1, every), PARSED).groupBy("lang", "chunk").agg(F.sum("n").alias("n")), "chunks")


def _slots(hashes: np.ndarray, lang: str, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit places of each phrase hash in the table."""
    own = _mixed([hashes ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), 42))])
    return own & np.uint64(n_bits - 1), (own >> np.uint64(32)) & np.uint64(n_bits - 1)


def _has(table: np.ndarray, place: np.ndarray) -> np.ndarray:
    return table[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0


def bit_table(frequent: DataFrame) -> np.ndarray:
    """Bits of the phrases of ``frequent`` (lang, phrase, all of equally many words) for ``_has``; at most MOST_BITS, whatever their number."""
    n_bits = 1 << max(10, min(MOST_BITS.bit_length() - 1, (frequent.count() * BITS_A_PHRASE).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(n_bits // 64, dtype=np.uint64)
        for batch in batches:
            for lang, rows in _by_language([batch]) if batch.num_rows else ():
                hashes = word_hashes(pc.split_pattern(_whole(rows.column(1)), pattern=" ").flatten()).reshape(len(rows), -1)
                for place in _slots(_mixed(list(hashes.T)), lang, n_bits):
                    np.bitwise_or.at(table, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(table[used].view(np.int64))], names=SLOTS.names)

    slots = frequent.select("lang", "phrase").mapInArrow(run, SLOTS).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    out = np.zeros(n_bits // 64, dtype=np.uint64)
    got = slots.toArrow()
    out[got.column("slot").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def _grams(lang: str, rows: pa.Array, n: np.ndarray, words: int, width: int, table: np.ndarray | None) -> pa.RecordBatch:
    """Weighted counts of the n-grams of distinct chunks of one language."""
    lists = pc.split_pattern(rows, pattern=b" ")
    told = lists.flatten().dictionary_encode()
    ids, spelt, bounds = told.indices.to_numpy(), told.dictionary, lists.offsets.to_numpy()
    is_word = ids != pc.index(spelt, SEPARATOR).as_py()
    # Starts of n-grams of words that belong to their chunk: those before its closing window.
    fits = is_word.copy()
    fits[bounds[1:, None] - 1 - np.arange(max(width, 1))] = False
    for i in range(1, words):
        fits[:-i] &= is_word[i:]
    at = np.flatnonzero(fits)
    if table is not None and words > 1:
        hashes = word_hashes(spelt)
        if words > 2:
            hashes = hashes[ids]
            hashes = [hashes[i : len(hashes) - words + 2 + i] for i in range(words - 1)]
        one, two = _slots(_mixed(hashes if words > 2 else [hashes]), lang, len(table) * 64)
        passed = _has(table, one) & _has(table, two)
        passed = passed if words > 2 else passed[ids]
        at = at[passed[at] & passed[at + 1]]
    if not len(at):
        return pa.RecordBatch.from_arrays([pa.array([], f) for f in (pa.string(), pa.string(), pa.int64())], names=GRAMS.names)
    key = ids[at].astype(np.int64)
    for i in range(1, words):
        key = np.unique(key, return_inverse=True)[1] * len(spelt) + ids[at + i] if i > 1 else key * len(spelt) + ids[at + i]
    order = np.argsort(key)
    starts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    chunk = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(bounds))[at]
    total = np.add.reduceat(n[chunk[order]], starts)
    where = at[order[starts]]
    joined = pc.binary_join_element_wise(*[spelt.take(pa.array(ids[where + i])) for i in range(words)], b" ")
    return pa.RecordBatch.from_arrays([pa.repeat(lang, len(total)), joined.cast(pa.string()), pa.array(total)], names=GRAMS.names)


def _counted(words: int, width: int, table: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, rows in _by_language(held):
                yield _grams(lang, _whole(rows.column(1)), _whole(rows.column(2)).to_numpy(), words, width, table)
            held.clear()

        for batch in batches:
            done = 0
            for part in chunks(batch.column(1), BLOCK_BYTES):
                held.append(batch.slice(done, len(part)))
                done, size = done + len(part), size + part.nbytes
                if size > BLOCK_BYTES:
                    yield from emptied()
                    size = 0
        if held:
            yield from emptied()

    return run


def _byte_order(name: str) -> Column:
    return F.encode(F.col(name), "UTF-8")


def counts(dictionary: DataFrame, words: int, width: int, table: np.ndarray | None) -> DataFrame:
    """lang, phrase, n of the n-grams of ``words`` words that the bit table lets through."""
    return dictionary.mapInArrow(_counted(words, width, table), GRAMS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def mine(
    docs: DataFrame,
    text: str = "text",
    lang: str | None = "lang",
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    top: int | None = TOP,
    every: int = EVERY,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language (all for None).

    A phrase of 2 to ``max_words`` words that occurs a >= ``min_count`` times is cut in two, at every place; a cut
    scores floor(10**6 * a * a / (l * r)) with the counts of its parts, and the least score (of equal ones that of the
    shortest first part) counts. Phrases inside a longer candidate with half their count or more are dropped. Ties of
    score and count are ranked by the bytes of the phrase.

    A null language is ``und``; a null or empty text has no words. Repeated rows count each time. An empty table gives
    an empty result. Very long texts are parsed whole. Columns other than the two named are not read, so any names may
    stand beside them. A language of many words is ranked in RANK_GROUPS groups first.
    """
    if max_words < 2 or min_count < 1 or every < 1:
        raise ValueError("max_words must be 2 or more, min_count and every 1 or more")
    width = max_words - 1
    dictionary = parsed(docs, text, lang, max_words, every)
    single = stored(counts(dictionary, 1, width, None), "words")
    totals = single.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = {1: single.where(F.col("n") >= min_count)}
    for words in range(2, max_words + 1):
        found = counts(dictionary, words, width, bit_table(frequent[words - 1]))
        frequent[words] = stored(found.where(F.col("n") >= min_count), "phrases")
    return ranked(frequent, totals, top)


def ranked(frequent: dict[int, DataFrame], totals: DataFrame, top: int | None) -> DataFrame:
    """Scores, suppression and ranks; ``frequent`` has lang, phrase and n by number of words."""
    known = None
    for words, rows in frequent.items():
        rows = rows.select("lang", "phrase", "n", F.lit(words).alias("words"))
        known = rows if known is None else known.unionAll(rows)
    longest = max(frequent)
    spelt = known.where("words > 1").withColumn("w", F.split("phrase", " "))
    part = lambda a, b: F.array_join(F.slice("w", a, b), " ")
    cuts = spelt.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "words", F.col("n").alias("a"), "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("words") - F.col("k")).alias("tail"))
    counted = known.select("lang", "phrase", "n")
    for side, name in (("head", "l"), ("tail", "r")):
        cuts = cuts.join(counted.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side])
    score = F.expr("cast((cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as bigint)")
    worst = F.min(F.struct("score", "k", "l", "r"))
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(worst.alias("w")).select("lang", "phrase", "words", "a", "w.l", "w.r", "w.score")
    if longest > 2:
        # Shorter phrases inside each longer candidate, with the largest count around them.
        spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
            F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
        around = spelt.where("words > 2").select("lang", F.explode(spans).alias("phrase"), F.col("n").alias("around"))
        around = around.groupBy("lang", "phrase").agg(F.max("around").alias("around"))
        scored = scored.join(around, ["lang", "phrase"], "left").where(
            F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * COVERED_PERCENT)
        )
    order = [F.desc("score"), F.desc("a"), _byte_order("phrase")]
    if top is not None:
        group = F.pmod(F.xxhash64("phrase"), F.lit(RANK_GROUPS))
        scored = scored.withColumn("__group", group).withColumn("__rank", F.row_number().over(Window.partitionBy("lang", "__group").orderBy(*order)))
        scored = scored.where(F.col("__rank") <= top)
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    # Totals: one row for each language.
    return out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
