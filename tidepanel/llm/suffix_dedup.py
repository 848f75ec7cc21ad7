"""Repeated byte strings, found with a logarithmic family of sampled suffix arrays.

A suffix is sampled where the bytes themselves say so: every ``length``-byte string picks the ``GRAM``-byte
string in it with the least digest, so equal strings pick equal places. About one suffix in 77 is kept, and
each stands for the run of string starts that picked it. A suffix array entry is the suffix's first bytes,
the digest of its first ``GRAM`` bytes, the digest of all bytes its run reaches, and the place. Entries are
sorted over the cluster by range.

New batches are sorted into an array of their own level. Levels that are full are taken along in the same
sort, as in a binary counter, so equal-sized levels merge geometrically; larger levels are merge-scanned
with the batch and stay as they are. In a scan only neighbours are compared: equal neighbours repeat their
whole run, neighbours that share the sampled ``GRAM`` bytes only are looked at string by string, once per
different context. Long runs of equal entries spread over ranges, and the first and last entry of each range are
matched in a table of two rows per range. The contexts of one sampled string are compared in a task up to
``GROUP`` of them; beyond that each string of a context is a row of its own, matched by its digest in sort order.

Texts are compressed for the two shuffles that carry them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.common import fields, map_texts, stored

LENGTH = 200
GRAM = 48
BATCHES = 2
#: Bytes whose digests are computed together.
PIECE = 1 << 19
#: Most contexts of one sampled string that one task compares.
GROUP = 4096

#: Flags of an entry after a scan.
WHOLE, PARTLY, EDGE = 1, 2, 4

ENTRY = fields(head="int", gram="int", context="long", text_hash="long", place="long")
KEYS = ENTRY.names
SCANNED = fields(head="int", gram="int", context="long", text_hash="long", place="long", flags="int")
SLICE = fields(key="long", single="boolean", text_hash="long", first="int", part="binary")
SPAN = fields(text_hash="long", lo="int", hi="int")
CLEANED = fields(n_bytes="long", n_removed="long", n_spans="long", kept="binary")
CLEANED_TEXT = fields(n_bytes="long", n_removed="long", n_spans="long", kept="string")

_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)


def _digests(data: np.ndarray, n: int) -> np.ndarray:
    """Polynomial digest of the ``n`` bytes from each position, by doubling."""
    power, size, part, out, done = _BASE, 1, _TABLE[data], None, 0
    while True:
        if n & size:
            if out is None:
                out = part
            else:  # what is done so far is followed by this part
                out = out[: len(part) - done] * np.uint64(power) + part[done : done + len(out)]
            done += size
        if done == n:
            return out[: len(data) - n + 1]
        part = part[:-size] * np.uint64(power) + part[size:]
        power, size = power * power % 2**64, size * 2


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Bytes to sample together and, for each text part in them, (text, its offset, begin, end)."""
    held: list[bytes] = []
    spans: list[tuple[int, int, int, int]] = []
    total = 0
    for i, data in enumerate(texts):
        if len(data) < length:
            continue
        for at in range(0, len(data) - length + 1, PIECE):
            part = data[at : at + PIECE + length - 1] if len(data) > PIECE else data
            if total and total + len(part) > PIECE + length:
                yield b"".join(held), spans
                held, spans, total = [], [], 0
            held.append(part)
            spans.append((i, at, total, total + len(part)))
            total += len(part)
            if len(data) <= PIECE:
                break
    if held:
        yield b"".join(held), spans


def _runs(data: np.ndarray, spans: list[tuple[int, int, int, int]], length: int) -> tuple[np.ndarray, ...]:
    """(span number, first start, last start, sampled position) of each run of starts with one sample."""
    mixed = _digests(data, GRAM)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    least = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(mixed), dtype=np.uint64)
    width, size = length - GRAM + 1, 1
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if width > size:
        least = np.minimum(least[: -(width - size)], least[width - size :])
    sample = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    owner = np.full(len(sample), -1, dtype=np.int64)
    for k, (_, _, begin, end) in enumerate(spans):
        owner[begin : end - length + 1] = k
    first = np.flatnonzero(np.r_[True, (sample[1:] != sample[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[first[1:] - 1, len(sample) - 1]
    real = owner[first] >= 0
    first, last = first[real], last[real]
    return owner[first], first, last, sample[first]


def _sampled(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # a text's copies in this task have the same entries; copies are counted elsewhere
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            hashes, texts = [], []
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if h not in seen:
                    seen.add(h)
                    hashes.append(h)
                    texts.append(text)
            for joined, spans in _pieces(texts, length):
                data = np.frombuffer(joined, dtype=np.uint8)
                owner, first, last, at = _runs(data, spans, length)
                head = np.zeros(len(at), dtype=np.uint32)
                for k in range(4):
                    head = (head << np.uint32(8)) | data[at + k]
                gram = [digest(joined[a : a + GRAM]) for a in at.tolist()]
                context = [digest(joined[a : b + length], c) for a, b, c in zip(first.tolist(), last.tolist(), (at - first).tolist())]
                text = np.asarray([hashes[s[0]] for s in spans], dtype=np.int64)[owner]
                moved = np.asarray([s[1] - s[2] for s in spans], dtype=np.int64)[owner]
                place = ((first + moved) << 16) | ((last - first) << 8) | (at - first)
                yield pa.RecordBatch.from_arrays([
                    pa.array((head ^ np.uint32(1 << 31)).view(np.int32)),  # keeps the order of the bytes
                    pa.array((np.asarray(gram, dtype=np.uint64) >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    pa.array(np.asarray(context, dtype=np.uint64).view(np.int64)), pa.array(text), pa.array(place),
                ], names=KEYS)

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries in sorted order with flags from comparing neighbours; pairs of old entries were compared before."""
    names = SCANNED.names
    held: list[np.ndarray] | None = None  # the last entry of what came before, with its flags

    def table(columns: list[np.ndarray], flags: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(flags.astype(np.int32))], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        flags = np.zeros(batch.num_rows, dtype=np.int64)
        if held is None:
            flags[0] = EDGE
        else:
            columns = [np.concatenate([h, c]) for h, c in zip(held, columns)]
            flags = np.concatenate([held[-1], flags])
        head, gram, context, fresh = columns[0], columns[1], columns[2], columns[5].astype(bool)
        near = (head[1:] == head[:-1]) & (gram[1:] == gram[:-1]) & (fresh[1:] | fresh[:-1])
        pair = near * np.where(context[1:] == context[:-1], WHOLE, PARTLY)
        flags[1:] |= pair
        flags[:-1] |= pair
        held = [c[-1:] for c in columns] + [flags[-1:]]
        if len(flags) > 1:
            yield table([c[:-1] for c in columns[:5]], flags[:-1])
    if held is not None:
        yield table(held[:5], held[-1] | EDGE)


class IndexFamily:
    """Suffix arrays of geometric levels; ``add`` sorts a batch in and keeps the matches it makes."""

    def __init__(self, spark: SparkSession, length: int = LENGTH) -> None:
        if length < GRAM + 8 or length - GRAM > 255:
            raise ValueError(f"length must lie between {GRAM + 8} and {GRAM + 255} bytes")
        self.spark, self.length = spark, length
        self.levels: list[DataFrame | None] = []
        self.scans: list[DataFrame] = []

    def _scanned(self, fresh: DataFrame, old: list[DataFrame]) -> DataFrame:
        parts = [fresh.withColumn("fresh", F.lit(1)), *[x.select(*KEYS).withColumn("fresh", F.lit(0)) for x in old]]
        rows = reduce(DataFrame.unionAll, parts)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartitionByRange(n, *KEYS).sortWithinPartitions(*KEYS).mapInArrow(_scan, SCANNED)

    def add(self, texts: DataFrame) -> None:
        """``texts``: columns text_hash and text."""
        fresh = texts.select("text_hash", F.encode("text", "UTF-8")).mapInArrow(_sampled(self.length), ENTRY)
        full = []
        while len(full) < len(self.levels) and self.levels[len(full)] is not None:
            full.append(self.levels[len(full)])
        if len(full) == len(self.levels):
            self.levels.append(None)
        merged = stored(self._scanned(fresh, full), "suffixes")
        found = [merged.where("flags > 0")]
        for larger in self.levels[len(full) + 1 :]:
            if larger is not None:
                found.append(stored(self._scanned(fresh, [larger]).where("flags > 0"), "matches"))
        self.levels[: len(full)] = [None] * len(full)
        self.levels[len(full)] = merged
        self.scans += found

    def matches(self) -> tuple[DataFrame, DataFrame]:
        """Entries whose whole run repeats, and those that share their sampled bytes with another context."""
        whole, partly = [], []
        for scan in self.scans:
            edges = scan.where(F.col("flags").bitwiseAND(EDGE) > 0)
            group = Window.partitionBy("head", "gram")
            edges = edges.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("head", "gram", "context")))
            edges = edges.withColumn("mixed", F.min("context").over(group) != F.max("context").over(group))
            whole += [scan.where(F.col("flags").bitwiseAND(WHOLE) > 0).select(*KEYS), edges.where("n > 1").select(*KEYS)]
            partly += [scan.where(F.col("flags").bitwiseAND(PARTLY) > 0).select(*KEYS), edges.where("mixed").select(*KEYS)]
        return reduce(DataFrame.unionAll, whole), reduce(DataFrame.unionAll, partly)


def _slices(length: int):
    """The bytes of each run asked for; for the contexts of a large group, a row per string instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, seen, unpack = to_arrow_schema(SLICE), set(), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for h, packed, runs in zip(*(c.to_pylist() for c in batch.columns)):
                if h in seen:
                    continue
                seen.add(h)
                data = unpack(packed)
                for r in runs:
                    lo, n = r["place"] >> 16, ((r["place"] >> 8) & 255) + 1
                    part = data[lo : lo + n + length - 1]
                    if r["n"] <= GROUP:
                        rows.append((r["key"], False, h, lo, part))
                    else:
                        rows += [
                            (xxhash.xxh64_intdigest(part[i : i + length], r["key"] & 0xFFFF) - (1 << 63), True, h, lo + i, None)
                            for i in range(n)
                        ]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), type=f.type) for v, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return run


def _equal_strings(keys: np.ndarray, hashes: np.ndarray, first: np.ndarray, parts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Spans of the strings that lie in two parts of one key; equal strings of a part's key have equal starts."""
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    begin = np.cumsum(sizes) - sizes
    digests = _digests(np.frombuffer(b"".join(parts), dtype=np.uint8), length)
    owner = np.repeat(np.arange(len(parts)), sizes)[: len(digests)]
    at = np.flatnonzero(np.arange(len(digests)) + length <= (begin + sizes)[owner])
    owner = owner[at]
    mixed = (digests[at] ^ keys.view(np.uint64)[owner]) * np.uint64(0xBF58476D1CE4E5B9)
    _, inverse, count = np.unique(mixed, return_inverse=True, return_counts=True)
    again = count[inverse] > 1
    owner, start = owner[again], (at - begin[owner] + first[owner])[again]
    new = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]) if len(owner) else np.empty(0, dtype=np.int64)
    last = np.r_[new[1:] - 1, len(owner) - 1] if len(owner) else new
    return hashes[owner[new]], start[new], start[last] + length


def _compare(length: int):
    """Spans of repeated strings, from slices sorted by key; holds no more than the groups of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, held, single = to_arrow_schema(SPAN), [], None

        def spans(hashes: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
            made = [np.asarray(hashes, dtype=np.int64), np.asarray(lo, dtype=np.int32), np.asarray(hi, dtype=np.int32)]
            return pa.RecordBatch.from_arrays(list(map(pa.array, made)), schema=schema)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            keys, hashes, first, parts = zip(*rows)
            return spans(*_equal_strings(np.asarray(keys, dtype=np.int64), np.asarray(hashes, dtype=np.int64), np.asarray(first, dtype=np.int64), list(parts), length))

        for batch in batches:
            alone, rows = [], []
            for key, one, h, first, part in zip(*(c.to_pylist() for c in batch.columns)):
                if not one:
                    rows.append((key, h, first, part))
                    continue
                if single is not None and single[0] == key:
                    alone += [(h, first), single[1:]]
                single = (key, h, first)
            if alone:
                h, first = map(np.asarray, zip(*alone))
                yield spans(h, first, first + length)
            held += rows
            if held and len(held) >= 2000:
                cut = next((i for i in range(len(held) - 1, 0, -1) if held[i][0] != held[i - 1][0]), 0)
                if cut:
                    yield flush(held[:cut])
                    held = held[cut:]
        if held:
            yield flush(held)

    return run


def _pack(docs: DataFrame, carry: list[str]) -> DataFrame:
    """Carried columns and the compressed UTF-8 bytes of column ``text``."""

    def prepare():
        pack = zstandard.ZstdCompressor(level=6).compress
        return lambda texts: [[pack(t.encode()) for t in texts]]

    return map_texts(docs, "text", fields(packed="binary"), prepare, carry)


def repeated_spans(texts: DataFrame, length: int = LENGTH, batches: int = BATCHES) -> DataFrame:
    """text_hash and spans (array of first and end byte) of ``texts`` (text_hash, text) that repeat a string."""
    spark = texts.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    family = IndexFamily(spark, length)
    for k in range(batches):
        family.add(texts if batches == 1 else texts.where(F.pmod("text_hash", F.lit(batches)) == k))
    whole, partly = family.matches()
    first = F.shiftrightunsigned("place", 16).cast("int")
    count = F.shiftrightunsigned("place", 8).bitwiseAND(F.lit(255)).cast("int")
    spans = whole.select("text_hash", first.alias("lo"), (first + count + length).alias("hi"))
    # One entry stands for a context; contexts with several entries repeat wholly anyway.
    one = stored(partly.groupBy("head", "gram", "context").agg(F.min(F.struct("text_hash", "place")).alias("e")), "contexts")
    sizes = one.groupBy("head", "gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = one.join(sizes, ["head", "gram"])
    asked = F.struct(F.xxhash64("head", "gram").alias("key"), "e.place", "n")
    wanted = sized.groupBy("e.text_hash").agg(F.collect_list(asked).alias("runs"))
    slices = _pack(texts, ["text_hash"]).join(wanted, "text_hash").mapInArrow(_slices(length), SLICE)
    placed = slices.repartition(n, "key").sortWithinPartitions("key")
    again = placed.mapInArrow(_compare(length), SPAN)
    # A text that occurs twice repeats as a whole.
    copies = texts.groupBy("text_hash").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("text")).alias("hi"))
    copied = copies.where(f"n > 1 AND hi >= {length}").select("text_hash", F.lit(0).alias("lo"), "hi")
    union = spans.unionAll(again).unionAll(copied)
    return union.groupBy("text_hash").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def _cut(n_carry: int, result: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        new, unpack = list(to_arrow_schema(result)), zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for packed, spans in zip(batch.column(n_carry).to_pylist(), batch.column(n_carry + 1).to_pylist()):
                data = unpack(packed)
                if not spans:
                    rows.append((len(data), 0, 0, data))
                    continue
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                at = np.asarray([(s["lo"], s["hi"]) for s in spans])
                np.add.at(edge, at[:, 0], 1)
                np.add.at(edge, at[:, 1], -1)
                gone = np.cumsum(edge[:-1]) > 0
                n_spans = int(np.count_nonzero(np.diff(np.r_[False, gone].astype(np.int8)) == 1))
                rows.append((len(data), int(gone.sum()), n_spans, np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()))
            if result["kept"].dataType.simpleString() == "string":
                rows = [(*r[:3], r[3].decode(errors="ignore")) for r in rows]
            held = list(batch.columns[:n_carry])
            made = [pa.array(list(v), type=f.type) for v, f in zip(zip(*rows), new)] if rows else [pa.array([], type=f.type) for f in new]
            yield pa.RecordBatch.from_arrays([*held, *made], schema=pa.schema([*list(batch.schema)[:n_carry], *new]))

    return run


def remove_repeats(
    docs: DataFrame,
    text: str = "text",
    carry: list[str] | None = None,
    length: int = LENGTH,
    batches: int = BATCHES,
    as_text: bool = False,
) -> DataFrame:
    """Carried columns (default ``doc_id``), n_bytes, n_removed, n_spans and kept of every row.

    Every byte of a ``length``-byte string that also starts elsewhere goes, judged on the input; strings do not
    cross texts. A null text is empty; texts under ``length`` bytes stay whole. Repeated rows repeat each other.
    ``kept`` is the bytes left, which may begin or end inside a character; ``as_text`` gives a string without
    such broken characters instead. An empty table gives an empty result.
    """
    names = ["doc_id"] if carry is None else carry
    result = CLEANED_TEXT if as_text else CLEANED
    raw = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    hashed = docs.select(F.xxhash64(raw).alias("text_hash"), raw.alias("text")).where(F.octet_length("text") >= length)
    spans = stored(repeated_spans(hashed, length, batches), "spans")
    kept = [f"__c{i}" for i in range(len(names))]
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(names, kept)], F.xxhash64(raw).alias("text_hash"), raw.alias("text"))
    joined = _pack(rows, [*kept, "text_hash"]).join(spans, "text_hash", "left")
    narrow = joined.select(*kept, "packed", "spans")
    schema = T.StructType([*narrow.schema.fields[: len(names)], *result.fields])
    cut = narrow.mapInArrow(_cut(len(names), result), schema)
    return cut.select(*[F.col(k).alias(c) for c, k in zip(names, kept)], *result.names)
