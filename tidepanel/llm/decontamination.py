"""Benchmark decontamination with a distributed positional inverted index.

The index is sharded by document: each segment (one Arrow chunk of texts) stores, for every benchmark term it
holds, the ascending positions of the term, documents laid end to end with a gap. Test windows run against
every segment: the terms of a window are taken from the segment's rarest on, each list is shifted by the
term's offset in the window and intersected with what is left. Documents never leave their segment, so a
passage that a third of all documents share costs its occurrences and nothing more.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import chunks, fields, stored

WINDOW = 10
#: Benchmark text that one pass over the index carries to the executors; a larger benchmark takes several.
BLOCK_BYTES = 16 << 20
#: Text of one index segment.
SEGMENT_BYTES = 4 << 20

#: Fixed by the word pattern [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z became a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

SEGMENT = fields(
    segment="string", doc_ids="array<long>", n_words="array<long>", starts="array<int>", terms="array<binary>", ends="array<int>",
    postings="array<int>",
)
MATCH = fields(segment="string", place="int", doc_id="long", n_words="long", hits="array<int>", items="array<long>")


def words(text: str | None) -> list[bytes]:
    """Words as UTF-8 bytes; a null text has none."""
    return text.encode().translate(_FOLD).split() if text else []


def windows(tokens: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    """Runs of ``window`` words; a shorter item that has words is one run."""
    if len(tokens) <= window:
        return [tuple(tokens)] if tokens else []
    return [tuple(tokens[i : i + window]) for i in range(len(tokens) - window + 1)]


def _segments(vocabulary: dict[bytes, int] | None, least_run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, made = to_arrow_schema(SEGMENT), 0
        for batch in batches:
            done = 0
            for part in chunks(batch.column(1), SEGMENT_BYTES):
                ids: list[int] = []
                n_words, starts, at = [], [], 0
                names = dict(vocabulary) if vocabulary is not None else {}
                for text in part.to_pylist():
                    tokens = words(text)
                    n_words.append(len(tokens))
                    starts.append(len(ids))
                    ids += map(names.get, tokens, [-1] * len(tokens)) if vocabulary is not None else [names.setdefault(t, len(names)) for t in tokens]
                    ids.append(-1)  # a gap, so no run crosses documents
                number = np.asarray(ids, dtype=np.int32)
                keep = number >= 0
                if vocabulary is not None and least_run > 1:
                    # A phrase needs that many words of the vocabulary in a row.
                    edge = np.flatnonzero(np.diff(np.r_[False, keep, False]))
                    short = (edge[1::2] - edge[::2]) < least_run
                    for lo, hi in zip(edge[::2][short], edge[1::2][short]):
                        keep[lo:hi] = False
                where = np.flatnonzero(keep).astype(np.int32)
                order = np.argsort(number[where], kind="stable")
                where = where[order]
                used, count = np.unique(number[where], return_counts=True)
                spelled = list(names)
                row = {
                    "segment": f"{TaskContext.get().partitionId()}-{made}", "doc_ids": batch.column(0).slice(done, len(part)).to_pylist(), "n_words": n_words, "starts": starts,
                    "terms": [spelled[i] for i in used], "ends": np.cumsum(count), "postings": where,
                }
                done, made = done + len(part), made + 1
                yield pa.RecordBatch.from_arrays([pa.array([row[f.name]], type=f.type) for f in schema], schema=schema)

    return run


def build_index(docs: DataFrame, vocabulary: set[bytes] | None = None, least_run: int = 1) -> DataFrame:
    """Store the positional index of ``doc_id``, ``text`` in the shared folder.

    ``vocabulary`` keeps only these terms; ``least_run`` further drops terms that do not lie in that many
    vocabulary words in a row, which no phrase of that length can need.
    """
    names = None if vocabulary is None else {w: i for i, w in enumerate(sorted(vocabulary))}
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(_segments(names, least_run), SEGMENT), "postings")


def phrase_starts(lists: dict[bytes, np.ndarray], phrase: tuple[bytes, ...]) -> np.ndarray:
    """Positions where the phrase starts: offset-adjusted lists intersected from the rarest term on."""
    try:
        order = sorted(range(len(phrase)), key=lambda i: len(lists[phrase[i]]))
    except KeyError:
        return np.empty(0, dtype=np.int64)
    left = lists[phrase[order[0]]] - order[0]
    for i in order[1:]:
        if not len(left):
            break
        other, want = lists[phrase[i]], left + i
        slot = np.minimum(np.searchsorted(other, want), len(other) - 1)
        left = left[other[slot] == want]
    return left


def proximity_ends(lists: dict[bytes, np.ndarray], terms: tuple[bytes, ...], span: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the shortest stretches of at most ``span`` words that end at a term and hold all terms."""
    if any(t not in lists for t in terms):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    rare = lists[min(terms, key=lambda t: len(lists[t]))]
    ends = np.unique(np.concatenate([lists[t] for t in set(terms)]))
    near = np.searchsorted(rare, ends, side="right")
    ends = ends[(near > 0) & (ends - rare[np.maximum(near - 1, 0)] < span)]
    starts = ends.copy()
    for t in set(terms):
        slot = np.searchsorted(lists[t], ends, side="right") - 1
        starts = np.minimum(starts, np.where(slot >= 0, lists[t][np.maximum(slot, 0)], -span))
    ok = (starts >= 0) & (ends - starts < span)
    return starts[ok], ends[ok]


def _search(queries: dict[tuple[bytes, ...], list[int]], span: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(MATCH)
        for batch in batches:
            for row in batch.to_pylist():
                postings, starts = np.asarray(row["postings"], dtype=np.int64), np.asarray(row["starts"], dtype=np.int64)
                cut = np.split(postings, row["ends"][:-1]) if row["terms"] else []
                lists = dict(zip(row["terms"], cut))
                hit, items = [], [set() for _ in starts]
                for phrase, owners in queries.items():
                    if span is None:
                        first = phrase_starts(lists, phrase)
                        last = first + len(phrase) - 1
                    else:
                        first, last = proximity_ends(lists, phrase, span)
                        doc_of = lambda x: np.searchsorted(starts, x, side="right")
                        inside = doc_of(first) == doc_of(last)
                        first, last = first[inside], last[inside]
                    if len(first):
                        hit.append((first, last))
                        for d in np.unique(np.searchsorted(starts, first, side="right") - 1):
                            items[d].update(owners)
                total = int(starts[-1]) + row["n_words"][-1] + 1
                edge = np.zeros(total + 1, dtype=np.int64)
                for first, last in hit:
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + 1, -1)
                where = np.flatnonzero(np.cumsum(edge[:total]))
                doc = np.searchsorted(starts, where, side="right") - 1
                cuts = np.searchsorted(doc, np.arange(1, len(starts)))
                local = np.split((where - starts[doc]).astype(np.int32) if len(where) else where.astype(np.int32), cuts)
                n = len(starts)
                made = [[row["segment"]] * n, range(n), row["doc_ids"], row["n_words"], local, [sorted(x) for x in items]]
                yield pa.RecordBatch.from_arrays([pa.array(v, type=f.type) for v, f in zip(made, schema)], schema=schema)

    return run


def search(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, span: int | None = None) -> DataFrame:
    """``MATCH`` rows, one per document: its words, word positions hit and items found, by number.

    ``span`` None asks for exact phrases of ``window`` words; a number asks for all terms of a window within
    so many words, in any order. The benchmark's size is measured first. Up to ``BLOCK_BYTES`` only postings that
    its phrases can need are stored; beyond, all postings are, and blocks of items are searched in turn. Null and
    empty texts have no words; null item ids are ignored; repeated documents are each searched and returned.
    """
    items = benchmark.where("item_id IS NOT NULL").select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + int(total) // BLOCK_BYTES
    index = build_index(docs) if n_blocks > 1 else None
    found = None
    for block in range(n_blocks):
        queries: dict[tuple[bytes, ...], list[int]] = {}
        part = items if n_blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == block)
        for item_id, text in part.collect():  # about BLOCK_BYTES of text
            for w in windows(words(text), window):
                owners = queries.setdefault(w, [])
                if item_id not in owners:
                    owners.append(item_id)
        if n_blocks == 1:
            least = min(map(len, queries), default=1) if span is None else 1
            index = build_index(docs, {t for q in queries for t in q}, least)
        rows = index.mapInArrow(_search(queries, span), MATCH)
        found = rows if found is None else found.unionAll(rows)
    if n_blocks == 1:
        return found
    return found.groupBy("segment", "place").agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return search(docs, benchmark, window).select(
        "doc_id", "n_words", F.size("hits").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )
