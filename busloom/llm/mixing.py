"""Mixing sources to target weights.

A document's size is its number of words (runs of non-space; null text: 0). Sources in code-point order, null last,
weigh WEIGHTS in turn and share SHARE of all words by weight; a target stops at CAP times its source's size and the
excess is reshared by weight until no target is above its cap. A source's rate is target / size; each of its documents
is taken floor(rate) times, and once more if a hash-seeded draw falls below the fraction. The draw depends on the seed,
doc_id and text alone, so reruns agree and repeated rows fare alike.

Sources are few rows (one each) and are handled as a table: ranks come from per-partition counts and the water level
from a few sums, so neither documents nor sources pass through one task. A source of words 0 gets target 0.
Empty tables give empty results. Extra columns are kept by the mix itself, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .postings import if_small
from .store import WORD, settle

WEIGHTS = (5, 2, 1)
SHARE, CAP, SEED = 1.5, 2.0, 17


def _ranked(sources: DataFrame) -> DataFrame:
    """sources with `rank` from 0 in code-point order, null last: range partitions, then offsets from their counts."""
    order = [F.col("source").isNull(), F.col("source")]
    dealt = settle(sources.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = dealt.groupBy("part").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("part").orderBy(*order)
    return dealt.join(F.broadcast(offset), "part").withColumn("rank", F.row_number().over(inside) - 1 + F.col("offset")).drop("part", "offset")


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size)."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    table = settle(_ranked(sources).withColumn("weight", weigh))
    total = table.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * CAP
    level = 0.0
    while True:  # the level rises each round; sources whose cap is below it stop there
        capped = cap <= F.col("weight") * level
        fixed, weight = table.agg(F.sum(F.when(capped, cap)), F.sum(F.when(~capped, F.col("weight")))).first()
        if not weight:
            break
        now = (SHARE * total - (fixed or 0.0)) / weight
        if now <= level:
            break
        level = now
    return table.select("source", "source_size", F.least(cap, F.col("weight") * level).alias("target"))


def _taken(docs: DataFrame, seed: int) -> DataFrame:
    """(doc, mix): whole rows of docs, and size, source_size, target, rate, copies and taken of each."""
    text = F.col("doc.text").cast("string")
    sized = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    sized = sized.withColumn("size", F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long"))
    goal = settle(targets(sized.select("doc.source", "size")).withColumnRenamed("source", "of"))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc.doc_id").cast("string"), text), F.lit(1 << 53)) / float(1 << 53)
    out = sized.join(if_small(goal, F.col("of")), sized["doc.source"].eqNullSafe(goal["of"])).withColumn("rate", rate)
    copies = F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)
    out = out.withColumn("copies", copies.cast("int")).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select("doc", F.struct("size", "source_size", "target", "rate", "copies", "taken").alias("mix"))


def mixture(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, rate, copies and taken (= size * copies), one row per document."""
    return _taken(docs, seed).select("doc.doc_id", "doc.source", "mix.*")


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as many times as it is taken, the columns of docs and `copy` (from 0).

    A column `copy` of docs gives way to it.
    """
    out = _taken(docs, seed).filter("mix.copies > 0").select("doc", F.explode(F.sequence(F.lit(0), F.col("mix.copies") - 1)).alias("copy"))
    return out.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c != "copy"], "copy")
