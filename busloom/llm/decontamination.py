"""Benchmark decontamination by a distributed positional index (DataFrame functions only).

Words are the runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. A window is WINDOW consecutive words of
an item; a shorter item with words is one window; an item without words has none. A document word inside any
occurrence of any window is hit. A document is contaminated if it has hits and 20 * n_hit >= n_words.

Proximity matches: an item is near a document if the PICKS rarest terms of one of its windows stand there so that each
one's offset-adjusted start is within SLOP words of the rarest one's (among the terms that the corpus has). They are
reported beside the exact matches and don't make a document contaminated.

Null or empty texts have no words, so no hits. Repeated documents are judged one by one; repeated items count once. Items
without an id hit words but are not listed. Empty tables give no hits; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .postings import bind, every_window, if_small, intersected, keyed, lookups, numbered, tokenised, verified
from .store import alnum_words, settle

WINDOW, SLOP = 13, 4


def _hit_offsets(equal: Column) -> Column:
    """Offsets of a phrase that an occurrence of a window covers."""
    k = F.least(F.lit(WINDOW), F.size(equal))

    def covered(equal: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(equal) - k), lambda s: F.forall(F.slice(equal, s + 1, k), lambda x: x))
        return F.array_distinct(F.flatten(F.transform(starts, lambda s: F.sequence(s, s + k - 1))))

    return bind(equal, covered)


def _judged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """contamination() with the rows' keys."""
    items = benchmark.select(F.col("item_id").cast("string").alias("id"), alnum_words(F.col("text").cast("string")).alias("words")).filter(F.size("words") > 0)
    phrases = numbered(items)
    ids = settle(items.join(phrases, "words").filter("id is not null").select("pid", "id").distinct())
    tokens = tokenised(docs.select("doc_id", "text"))
    exact, near = intersected(tokens, lookups(tokens, phrases, every_window(WINDOW), near=True), SLOP)
    hits = verified(tokens, exact, phrases).select("row", "pid", "at", _hit_offsets(F.col("equal")).alias("offs"))
    hits = settle(hits.filter(F.size("offs") > 0).distinct())
    at = hits.select("row", F.explode("offs").alias("off"), "at").select("row", (F.col("at") + F.col("off")).alias("pos")).distinct()
    at = at.groupBy("row").agg(F.array_sort(F.collect_list("pos")).alias("hit_at"))  # as long as the document at most
    named = if_small(ids, F.col("id"))
    found = hits.select("row", "pid").distinct().join(named, "pid").select("row", "id", F.lit(True).alias("exact"))
    met = near.join(named, "pid").select("row", "id", F.lit(False).alias("exact"))
    item = found.unionByName(met).groupBy("row", "id").agg(F.max("exact").alias("exact"))
    listed = lambda keep: F.array_sort(F.collect_list(F.when(keep, F.col("id"))))
    item = item.groupBy("row").agg(listed(F.col("exact")).alias("item_ids"), listed(~F.col("exact")).alias("near_ids"))
    every = settle(at.join(item, "row", "full"))
    out = tokens.select("row", "doc_id", "n_words").join(if_small(every, F.concat_ws(" ", F.col("hit_at").cast("array<string>"), "item_ids", "near_ids")), "row", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({"hit_at": F.coalesce("hit_at", F.array().cast("array<int>")), "item_ids": F.coalesce("item_ids", none), "near_ids": F.coalesce("near_ids", none)})
    n_hit = F.size("hit_at").cast("long")
    return out.select(
        "row",
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near"),
        "item_ids",
        "near_ids",
        "hit_at",
    )


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near, item_ids, near_ids, hit_at (word positions).

    `near_ids` lists the items with proximity matches alone, without exact ones.
    """
    return _judged(docs, benchmark).drop("row")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns. Documents are told apart by doc_id and text."""
    bad = settle(_judged(docs, benchmark).filter("contaminated").select("row").distinct())
    return keyed(docs).join(if_small(bad, F.lit("")), "row", "left_anti").select("doc.*")
