"""Near-duplicate documents by an LSH forest over MinHash signatures, with links confirmed on full sets of shingle hashes.

A document's set holds its distinct 5-word shingles (words are runs of non-space, A-Z lower-cased); a text of fewer
words is one shingle; a text without words (or null) has an empty set and is linked with nothing. Documents link if
100 * |intersection| >= percent * |union|; every bound of the plan follows from `percent`.

Plan: equal sets collapse first, so a group of exact copies is one node. Each node stands in TREES signature orders
(rotations of one signature). Nodes with a common prefix of first_depth() hashes form a region; a region larger than SMALL
is split by longer and longer prefixes, so its candidates are the neighbours with the longest common prefixes. Each
crowded region is also compared with its most typical member (one row per member). What the deep prefixes of crowded
regions may miss is found exactly: their members are joined on the rarest shingles of their sets (prefix and position
filter), only between different components. No step emits the pairs of a group that are already connected.

Shingles stand as 64-bit hashes. Joins on keys that may be hot (regions, shingles, components, sets) read written tables
on both sides and aggregate in a later step, so that Spark can split their large partitions.

Null doc_ids: such rows are judged like others, but a null never names a component. Rows that share a doc_id are
reported one by one; keep_one() lets one row of a group stay. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .postings import BROADCAST_ROWS, if_small, joinable, keyed, row_key
from .store import WORD, settle
from .tokens import as_bytes, batches, mix

HASHES, TREES = 64, 16
DEPTHS = (8, 16, 32, 64)
SMALL = 24
#: Similarity that links documents, in percent: op1's contract.
PERCENT = 85
#: Chance that a pair at the threshold meets in no tree.
MISS = 2e-5
_rng = np.random.default_rng(7)
_MUL = _rng.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 2**32, HASHES, dtype=np.uint32)
_STEP = mix(np.arange(1, 6, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def shingles(words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of the texts in `words`, and per text where they start (one more entry at the end)."""
    n = np.diff(words.at)
    count = np.where(n == 0, 0, np.maximum(1, n - width + 1))
    at = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(n)), count)
    j = words.at[text] + (np.arange(at[-1]) - at[text])
    end = words.at[text + 1]
    h = np.concatenate([words.hash, np.zeros(width, np.uint64)])
    acc = np.zeros(len(j), np.uint64)
    for k in range(width):
        acc += np.where(j + k < end, h[j + k] * _STEP[k], np.uint64(0))
    return mix(acc), at


def distinct_shingles(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, sorted distinct shingle hashes) of each text."""
    for first, words in batches(texts):
        h, at = shingles(words)
        for i in range(len(at) - 1):
            yield first + i, np.unique(h[at[i] : at[i + 1]])


def _key(s: np.ndarray) -> bytes:
    m = mix(s)
    return np.array([m.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix(m + np.uint64(len(s))))]).tobytes()


def _signed(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        ids, n, key, sig = [], [], [], []
        doc = batch.column(0).to_pylist()
        for i, s in distinct_shingles(as_bytes(batch.column(1))):
            ids.append(doc[i])
            n.append(len(s))
            if not len(s):
                key.append(None)
                sig.append(None)
                continue
            key.append(_key(s))
            x = (s >> np.uint64(32)).astype(np.uint32)
            low = np.empty(HASHES, np.uint32)
            for k in range(HASHES):
                low[k] = (x * _MUL[k] + _ADD[k]).min()
            sig.append(low.view(np.int32))
        columns = [pa.array(ids, pa.int64()), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "row", "n_shingles", "node", "sig"])


def _sets(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        node = batch.column(0).to_pylist()
        found = [(node[i], s.view(np.int64)) for i, s in distinct_shingles(as_bytes(batch.column(1))) if len(s) and _key(s) == node[i]]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()), pa.array([s for _, s in found], pa.list_(pa.int64()))], ["node", "items"])


def first_depth(percent: int) -> int:
    """Hashes of the longest prefix in which a pair at the threshold meets in some tree, but for MISS."""
    return max(d for d in range(1, HASHES // TREES + 1) if d == 1 or (1 - (percent / 100) ** d) ** TREES <= MISS)


def least_agreement(percent: int) -> int:
    """Of HASHES equal hashes: what a pair at the threshold expects, less 4.65 standard deviations."""
    p = percent / 100
    return math.floor(HASHES * p - 4.65 * math.sqrt(HASHES * p * (1 - p)))


def _agree(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def _pairs(members: DataFrame, percent: int) -> DataFrame:
    """All pairs within regions of at most SMALL members."""
    a = members.select("region", F.col("node").alias("a"), F.col("sig").alias("sa"))
    b = members.select("region", F.col("node").alias("b"), F.col("sig").alias("sb"))
    return a.join(b, (a.region == b.region) & (F.col("a") < F.col("b")) & (_agree(F.col("sa"), F.col("sb")) >= least_agreement(percent))).select("a", "b")


def _with_size(members: DataFrame, rows: int) -> DataFrame:
    """members (at most `rows`) with the size of their region, if over 1."""
    size = members.groupBy("region").agg(F.count("*").alias("size")).filter("size > 1")
    return members.join(joinable(size, rows), "region")


def candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(candidate pairs a < b of the forest, nodes that stand in a crowded region)."""
    width = HASHES // TREES

    def region(depth: int):
        turned = F.concat(F.slice("sig", F.col("tree") * width + 1, HASHES), F.slice("sig", 1, F.col("tree") * width))
        return F.xxhash64("tree", F.slice(turned, 1, depth))

    trees = nodes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    keyed = trees.select("node", "tree", region(first_depth(percent)).alias("region"))
    first = settle(_with_size(keyed, TREES * nodes.count()))
    small = first.filter(f"size <= {SMALL}").join(nodes.select("node", "sig"), "node")
    pairs = [_pairs(small, percent)]
    crowded = first.filter(f"size > {SMALL}").select("node", "tree", F.col("region").alias("root")).join(nodes.select("node", "sig"), "node")
    crowded = settle(crowded)
    rows = crowded.count()
    if not rows:
        return pairs[0].distinct(), crowded.select("node", "root")
    pairs.append(_typical(crowded, rows))
    members = crowded
    for depth in DEPTHS:
        sized = settle(_with_size(members.withColumn("region", region(depth)), rows))
        pairs.append(_pairs(sized.filter(f"size <= {SMALL}"), percent))
        members = sized.filter(f"size > {SMALL}").drop("region", "size")
    # whole signatures agree: each with the first of its region
    members = members.withColumn("region", region(HASHES))
    first = members.groupBy("region").agg(F.min("node").alias("a"))
    pairs.append(members.select("region", F.col("node").alias("b")).join(joinable(first, rows), "region").filter("a < b").select("a", "b"))
    out = pairs[0]
    for p in pairs[1:]:
        out = out.unionByName(p)
    return out.distinct(), crowded.select("node", "root").distinct()


def _typical(crowded: DataFrame, rows: int) -> DataFrame:
    """Each member with its region's most typical member: the one that has most of the region's commonest next hashes."""
    after = F.slice(F.concat("sig", "sig"), (HASHES // TREES) * (F.col("tree") + 1) + 1, HASHES // TREES)
    cell = crowded.select("root", "node", F.posexplode(after).alias("k", "v"))
    common = cell.groupBy("root", "k", "v").agg(F.count("*").alias("n")).groupBy("root", "k").agg(F.max_by("v", F.struct("n", "v")).alias("v"))
    score = cell.join(joinable(common, rows), ["root", "k", "v"], "left_semi").groupBy("root", "node").agg(F.count("*").alias("n"))
    lead = score.groupBy("root").agg(F.max_by("node", F.struct("n", "node")).alias("lead"))
    both = crowded.select("root", "node").join(joinable(lead, rows), "root").filter("node != lead")
    return both.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets pass the threshold."""
    a = sets.select(F.col("node").alias("a"), F.col("items").alias("xa"))
    b = sets.select(F.col("node").alias("b"), F.col("items").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    return pairs.join(a, "a").join(b, "b").withColumn("common", both).filter(F.col("common") * (100 + percent) >= (F.size("xa") + F.size("xb")) * percent).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of edges (a, b): comp is the smallest node reachable. Large-star and small-star rounds."""
    links = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, n = None, links.count()
    while n:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(joinable(low, 2 * n), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(large) if 2 * n > BROADCAST_ROWS else large
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(joinable(least, n), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        links = settle(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, n = now, now[0]
    return links.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(links.select(F.col("v"), F.col("v"))).distinct()


def exact_rest(crowded: DataFrame, sets: DataFrame, comp: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs between components among the members of crowded regions: rarest-shingle prefixes of full sets.

    Two sets that pass the threshold share a shingle within the first n - ceil(n * percent / 100) + 1 of each, in any one order;
    here rarest first, and the position filter bounds what can still be common after it.
    """
    some = crowded.select("node").distinct()
    items = settle(some.join(sets, "node").select("node", "items"))
    every = items.select("node", F.size("items").alias("n"), F.explode("items").alias("x"))
    seen = settle(every.groupBy("x").agg(F.count("*").alias("df")))
    order = Window.partitionBy("node").orderBy("df", "x")
    head = every.join(seen, "x").withColumn("pos", F.row_number().over(order) - 1)
    head = head.filter((F.col("pos") <= F.col("n") - F.ceil(F.col("n") * percent / 100)) & (F.col("df") > 1))
    head = settle(head.join(comp, "node", "left").select("x", "node", "n", "pos", F.coalesce("comp", "node").alias("comp")))
    # only shingles of several components matter, and a shingle's main component needs no probe of its own: pairs lie
    # between a lesser component's posting and any other
    by_comp = head.groupBy("x", "comp").agg(F.count("*").alias("c"))
    main = by_comp.groupBy("x").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps")).filter("comps > 1")
    main = settle(main.drop("comps"))
    head = settle(head.join(if_small(main, F.lit("")), "x"))
    p, q = head.filter("comp != main").alias("p"), head.alias("q")
    need = F.ceil((F.col("p.n") + F.col("q.n")) * percent / (100 + percent))
    met = p.join(q, (F.col("p.x") == F.col("q.x")) & (F.col("p.comp") != F.col("q.comp")) & (F.least(F.col("p.n"), F.col("q.n")) * 100 >= F.greatest(F.col("p.n"), F.col("q.n")) * percent) & (F.least(F.col("p.n") - F.col("p.pos"), F.col("q.n") - F.col("q.pos")) >= need))
    return met.select(F.least("p.node", "q.node").alias("a"), F.greatest("p.node", "q.node").alias("b")).distinct()


def _linked(docs: DataFrame, percent: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """((doc_id, row, n_shingles, node, sig) per row, (node, sig, doc_id, row) per node, (node, comp) per linked node)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row"))
    signed = settle(rows.mapInArrow(_signed, "doc_id long, row binary, n_shingles long, node binary, sig array<int>"))
    nodes = settle(signed.filter("node is not null").groupBy("node").agg(F.first("sig").alias("sig"), F.min("doc_id").alias("doc_id"), F.min("row").alias("row")))
    pairs, crowded = candidates(nodes, percent)
    pairs, crowded = settle(pairs), settle(crowded)
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(crowded.select("node")).distinct().join(nodes.select("node", "row"), "node")
    sets = rows.select("row", "text").join(wanted, "row").select("node", "text").mapInArrow(_sets, "node binary, items array<long>")
    sets = settle(sets.dropDuplicates(["node"]))  # repeated rows share their key
    edges = settle(confirm(pairs, sets, percent))
    comp = components(edges)
    if not crowded.count():
        return signed, nodes, settle(comp)
    more = confirm(settle(exact_rest(crowded, sets, settle(comp), percent)), sets, percent)
    return signed, nodes, settle(components(settle(edges.unionByName(more))))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable), kept."""
    signed, nodes, comp = _linked(docs, percent)
    named = settle(comp.join(nodes.select("node", "doc_id"), "node"))
    best = settle(named.groupBy("comp").agg(F.min("doc_id").alias("component")))
    alone = nodes.join(comp.select("node"), "node", "left_anti").select("node", F.col("doc_id").alias("component"))
    named = settle(named.join(best, "comp").select("node", "component").unionByName(alone))
    out = signed.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that stay: exactly one row of each group of near duplicates, and all texts without words; all columns.

    Rows are told apart by doc_id and text. A group keeps its smallest doc_id, a null one only if it has no other.
    """
    signed, _, comp = _linked(docs, percent)
    rows = signed.filter("node is not null").groupBy("node", "doc_id", "row").agg(F.count("*").alias("copies"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "copies"))
    by_node = settle(rows.groupBy("node").agg(first.alias("first")))
    group = by_node.join(comp, "node", "left").groupBy(F.coalesce("comp", "node").alias("group"))
    keep = settle(group.agg(F.min("first").alias("first")).select("first.row", "first.copies"))
    whole = keyed(docs)
    once = whole.join(keep.filter("copies = 1"), "row", "left_semi")
    repeated = keep.filter("copies > 1").select("row")
    one = whole.join(if_small(repeated, F.lit("")), "row", "left_semi").dropDuplicates(["row"])
    wordless = whole.filter(~F.coalesce(F.col("doc.text").cast("string"), F.lit("")).rlike(WORD))
    return once.unionByName(one).unionByName(wordless).select("doc.*")
