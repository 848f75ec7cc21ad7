"""SimHash near-duplicates over a byte-position inverted index with count filtering.

Fingerprints within ``BITS`` differing bits share at least ``8 - BITS`` of their eight bytes at the same
positions. The index posts each distinct fingerprint under the values of a few byte positions taken together;
the position sets are chosen so that any ``8 - BITS`` shared positions contain one of them, so no pair is
missed, and the more fingerprints there are the more positions a set has, which keeps the lists short. Within
a list the shared positional bytes of a pair are tallied, pairs below the guaranteed minimum go, and the rest
are verified bit by bit. A list reports links that span its groups, at most one per fingerprint, not all
pairs; a list longer than ``BLOCK`` is cut in blocks and every two blocks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepanel.llm.common import fields, map_texts, stored
from tidepanel.llm.components import connected_components

SHINGLE = 3
SEED = 42
BITS = 3
#: Fingerprints of one block of a posting list.
BLOCK = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles' XXH64; 0 without words. A bit is set if it is in over half the hashes."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-shingle].tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())), dtype=">u8", count=len(starts)
    )
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        votes += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", carry: list[str] | None = None, shingle: int = SHINGLE) -> DataFrame:
    """Carried columns and ``fp``, the fingerprint as a signed long."""

    def prepare():
        return lambda texts: [[(f := fingerprint(t, shingle)) - (f >> 63 << 64) for t in texts]]

    return map_texts(docs, text, fields(fp="long"), prepare, ["doc_id"] if carry is None else carry)


def position_sets(width: int, shared: int = 8 - BITS) -> list[tuple[int, ...]]:
    """Sets of ``width`` byte positions such that any ``shared`` of the eight contain one of them (greedy cover)."""
    left, sets = set(combinations(range(8), shared)), []
    while left:
        best = max(combinations(range(8), width), key=lambda s: sum(set(s) <= set(x) for x in left))
        sets.append(best)
        left = {x for x in left if not set(best) <= set(x)}
    return sets


def list_width(n: int, bits: int = BITS) -> int:
    """Positions in a set: enough that a list of random fingerprints would hold few."""
    return next((w for w in range(2, 8 - bits) if n <= 256**w // 16), 8 - bits)


def _spanning(fp: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the fingerprints within ``bits``."""
    links, waiting = [], fp
    while len(waiting):
        front, waiting = [waiting[0]], waiting[1:]
        while front and len(waiting):
            one = front.pop()
            apart = waiting ^ one
            tally = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = tally >= 8 - bits
            near[near] = np.bitwise_count(apart[near]) <= bits
            front += list(waiting[near])
            links += [(int(one), int(x)) for x in waiting[near]]
            waiting = waiting[~near]
    return links


def _verify(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for values in batch.column(0):
                links += _spanning(np.asarray(values.values.to_numpy(), dtype=np.int64).view(np.uint64), bits)
            signed = np.asarray(links, dtype=np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], names=["a", "b"])

    return run


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Columns a, b: links that connect every two fingerprints of column ``fp`` (distinct) within ``bits``."""
    n = fps.count()
    byte = lambda i: F.shiftrightunsigned("fp", 8 * (7 - i)).bitwiseAND(F.lit(255))
    keys = []
    for k, chosen in enumerate(position_sets(list_width(n, bits), 8 - bits)):
        value = F.lit(0).cast("long")
        for i in chosen:
            value = value * 256 + byte(i)
        keys.append(F.struct(F.lit(k).alias("set"), value.alias("value")))
    posted = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.set", "key.value")
    whole = Window.partitionBy("set", "value")
    sized = posted.withColumn("n", F.count(F.lit(1)).over(whole)).where("n > 1")
    # A list of n postings has ceil(n / block) blocks; a posting goes to the pairs of its own block.
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("fp"), blocks.cast("long")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "own").alias("i"), F.greatest(o, "own").alias("j"))
    )
    placed = sized.withColumn("blocks", blocks).withColumn("own", own).select("set", "value", "fp", F.explode(pairs).alias("p"))
    lists = placed.groupBy("set", "value", "p").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    schema = T.StructType().add("a", T.LongType()).add("b", T.LongType())
    return lists.select("fps").mapInArrow(_verify(bits), schema)


def near_duplicates(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Carried columns, fingerprint (16 hex digits), component_id (the smallest ``doc_id`` reachable) and
    component (the least fingerprint reachable, as a signed long, which tells groups apart where ids repeat).

    Null and empty texts have fingerprint zero and link like any other. Rows with equal fingerprints are one
    node. A null ``doc_id`` takes part but is never a component_id unless all of its component are null.
    """
    names = carry or ["doc_id"]
    marked = stored(fingerprints(docs, text, names), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    labels = connected_components(links(nodes.select("fp")))
    labelled = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    best = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    found = labelled.join(best, "label").select("fp", "component_id", F.col("label").alias("component"))
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return marked.join(found, "fp").select(*[F.col(f"`{c}`") for c in names], shown, "component_id", "component")
