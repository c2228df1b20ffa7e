"""SimHash near-duplicate documents by one-wildcard segment variants.

A text's words (runs of non-space, A-Z lower-cased) give 3-word shingles, repeats included; fewer words are one shingle.
A fingerprint bit is 1 if it is set in over half of the shingles' hashes (XXH64, seed 42). Texts without words, and null,
have fingerprint zero, which links like any other. Fingerprints that differ in at most WITHIN = 2 bits link.

Two segments of 32 bits hold at most two differing bits between them, so at least one segment differs by at most one:
either a segment is equal, or both differ by exactly one bit. Distinct fingerprints are indexed by both whole segments and
by the 32 variants of the first one with a bit taken out (the bit goes along, and only unequal bits meet). Keys that one
fingerprint alone has are dropped by counts. Pairs that share a key are joined and verified. A key that over SMALL
fingerprints share is not joined: its members go to an exact rest, in which each is listed under itself and its 64
neighbours at one bit. Two fingerprints are within two bits if and only if they share such a place, and all that share one
are within two bits of each other, so linking each to the smallest of its place keeps every component; no place has over 65
members. No step emits the pairs of a large group.

Copies of a text, however many, are one fingerprint; documents get their component by a join on it with both sides written,
so that Spark can split hot fingerprints.

Null doc_ids: such rows are fingerprinted like others, but a null names a component only if it has no other id. Repeated
rows are reported one by one. An empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .near_dedup import components
from .postings import if_small
from .store import settle
from .tokens import as_bytes

SHINGLE, SEED, WITHIN = 3, 42, 2
HALF = 32
#: fingerprints that share a key and are compared pair by pair
SMALL = 64
#: shingles whose bits are counted at once
BLOCK = 1 << 15
_LOW = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprint(text: bytes, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a whole UTF-8 text."""
    words = text.translate(_LOW).split()  # ASCII white space only
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    start = end - size
    n = max(1, len(words) - width + 1)
    joined, last = b" ".join(words), end[min(width, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    bits = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        spans = zip(start[at : min(n, at + BLOCK)].tolist(), last[at : at + BLOCK].tolist(), strict=True)
        h = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.array([fingerprint(t) for t in as_bytes(batch.column(1))], np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "node"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, node) of every row, node being the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints, "doc_id long, node long")


def _keyed(nodes: DataFrame) -> DataFrame:
    """(kind, segment, bit, node): whole segments (kinds 0 and 1, no bit) and variants of the first (kinds 2 to 33)."""
    low, high = F.col("node").bitwiseAND((1 << HALF) - 1), F.shiftrightunsigned("node", HALF)

    def variant(k: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), k)
        bit = F.when(high.bitwiseAND(mask) != 0, 1).otherwise(0)
        return F.struct((k + 2).alias("kind"), (high - bit * mask).alias("segment"), bit.alias("bit"))

    whole = [F.struct(F.lit(k).alias("kind"), s.alias("segment"), F.lit(None).cast("int").alias("bit")) for k, s in enumerate((low, high))]
    variants = F.transform(F.sequence(F.lit(0), F.lit(HALF - 1)), variant)
    return nodes.select("node", F.explode(F.concat(F.array(*whole), variants)).alias("key")).select("key.*", "node")


def links(nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """Edges (a, b) that give the components of distinct fingerprints within WITHIN bits."""
    key = ["kind", "segment"]
    keyed = _keyed(nodes)
    # a variant matters only if both values of its bit occur
    size = keyed.groupBy(*key).agg(F.count("*").alias("size"), F.min("bit").alias("one"), F.max("bit").alias("other"))
    size = settle(size.filter("size > 1 and (one is null or one < other)").select(*key, "size"))
    members = settle(keyed.join(if_small(size, F.lit("")), key))
    few = members.filter(F.col("size") <= small)
    a, b = few.alias("a"), few.alias("b")
    same = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    apart = F.when(F.col("a.bit").isNull(), F.col("a.node") < F.col("b.node")).otherwise(F.col("a.bit") < F.col("b.bit"))
    near = F.bit_count(F.col("a.node").bitwiseXOR(F.col("b.node"))) <= WITHIN
    pairs = a.join(b, [*same, apart, near]).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    return settle(pairs.distinct().unionByName(_rest(members.filter(F.col("size") > small).select("node").distinct())))


def _rest(nodes: DataFrame) -> DataFrame:
    """Edges among fingerprints of crowded keys, by the places at most one bit away."""
    one = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("node").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    places = settle(nodes.select("node", F.explode(F.concat(F.array("node"), one)).alias("place")))
    least = places.groupBy("place").agg(F.min("node").alias("a"), F.count("*").alias("n")).filter("n > 1")
    return places.join(settle(least.drop("n")), "place").filter("a < node").select("a", F.col("node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row."""
    rows = settle(fingerprints(docs))
    nodes = settle(rows.groupBy("node").agg(F.min("doc_id").alias("doc_id")))
    comp = settle(components(links(nodes.select("node"), small)))
    linked = settle(nodes.join(comp, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp")))
    least = settle(linked.groupBy("comp").agg(F.min("doc_id").alias("component_id")))
    named = settle(linked.join(least, "comp").select("node", "component_id"))
    hexed = F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint")
    return rows.join(if_small(named, F.lit("")), "node").select("doc_id", hexed, "component_id")
