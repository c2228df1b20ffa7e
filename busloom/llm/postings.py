"""A positional inverted index over documents, queried from the rarest terms: DataFrame functions only.

The corpus is tokenised once into a stored table. A phrase is looked for by its parts (every run of some words, or places
the caller names): each part is looked up by its PICKS rarest terms, those with the fewest postings in the corpus. Only the
postings (row, term, pos) of such terms are stored. A posting at position p of a term at offset o of a phrase says that
the phrase starts at p - o; the offset-adjusted lists of a part's terms are intersected, first by document, then

* exactly: all of them agree on the start, which is a candidate that is verified word by word on the stored tokens;
* by proximity: each agrees with the rarest one's start within `slop` words, so words put in, dropped or moved are allowed.

No step collects postings or phrases of a document into one row: all intersections are aggregations by
(row, phrase, part[, start]) with map-side partial sums, so neither a hot term nor a long text makes a hot task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import alnum_words, settle

#: Tables of at most this many rows and bytes of text are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20
#: rarest terms by which each part is looked up
PICKS = 3


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def if_small(df: DataFrame, text: Column) -> DataFrame:
    """df, broadcast only if its counted rows and bytes of text are within the limits."""
    rows, size = df.agg(F.count("*"), F.sum(F.length(text))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) + 40 * rows <= BROADCAST_BYTES else df


def joinable(df: DataFrame, rows: int) -> DataFrame:
    """A narrow df of at most `rows` rows, for the other side of a join: broadcast if they are few, else written, so that
    Spark can split the large partitions of the join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else settle(df)


def row_key() -> Column:
    """128 bits that tell rows apart by doc_id and text; null differs from every value."""
    part = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in ("doc_id", "text")]
    return F.unhex(F.md5(F.concat(part[0], F.lit("\0"), part[1]).cast("binary")))


def keyed(docs: DataFrame) -> DataFrame:
    """(doc, row): whole rows as a struct, so that no column name of docs clashes with a key."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"), row_key().alias("row"))


def every_window(width: int) -> Column:
    """All runs of `width` words of a phrase, or the whole of a shorter one: array of (first, size)."""
    k = F.least(F.lit(width), F.size("words"))
    return F.transform(F.sequence(F.lit(0), F.size("words") - k), lambda s: F.struct(s.alias("first"), k.alias("size")))


def tokenised(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, words) of each row of docs, stored: texts are tokenised this once."""
    words = docs.select(row_key().alias("row"), "doc_id", alnum_words(F.col("text").cast("string")).alias("words"))
    return settle(words.select("row", "doc_id", F.size("words").cast("long").alias("n_words"), "words"))


def numbered(phrases: DataFrame, *given: str) -> DataFrame:
    """Distinct phrases (words, given columns) with a number `pid`, stored."""
    return settle(phrases.select("words", *given).distinct().withColumn("pid", F.monotonically_increasing_id()))


def lookups(tokens: DataFrame, phrases: DataFrame, parts: Column, near: bool = False) -> DataFrame:
    """(term, pid, part, rank, off, size): by which terms each part of a phrase (pid, words) is looked up, rarest first.

    `parts` is an array of (first, size); parts with equal terms are one. A part with a term that the corpus lacks can't
    stand anywhere and is dropped; with `near`, such terms are passed over instead.
    """
    cells = phrases.select("pid", F.posexplode("words").alias("off", "term"))
    terms = settle(cells.select("term").distinct())
    counts = tokens.select(F.explode("words").alias("term")).join(if_small(terms, F.col("term")), "term").groupBy("term").agg(F.count("*").alias("n"))
    cells = cells.join(settle(counts), "term", "left").fillna(0, ["n"])
    ranked = cells.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("off", "n", "term"))).alias("cells"))  # as long as the phrase

    def rarest(part: Column) -> Column:
        inside = F.slice("cells", part["first"] + 1, part["size"])
        there = F.filter(inside, lambda c: c["n"] > 0)
        picks = F.slice(F.array_sort(F.transform(there, lambda c: F.struct(c["n"], c["term"], c["off"]))), 1, PICKS)
        return picks if near else F.when(F.size(there) == F.size(inside), picks)

    picked = phrases.join(ranked, "pid").select("pid", F.posexplode(F.array_distinct(F.filter(F.transform(parts, rarest), lambda p: p.isNotNull()))).alias("part", "picks"))
    out = picked.select("pid", "part", F.size("picks").alias("size"), F.posexplode("picks").alias("rank", "c"))
    return settle(out.select(F.col("c.term").alias("term"), "pid", "part", "rank", F.col("c.off").alias("off"), "size"))


def intersected(tokens: DataFrame, looked: DataFrame, slop: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(exact candidates (row, pid, at), proximity matches (row, pid) if slop is given), from stored postings."""
    terms = settle(looked.select("term").distinct())
    every = tokens.select("row", F.posexplode("words").alias("pos", "term"))
    postings = settle(every.join(if_small(terms, F.col("term")), "term").distinct())  # repeated rows share their key
    met = postings.join(if_small(looked, F.col("term")), "term").select("row", "pid", "part", "rank", "size", (F.col("pos") - F.col("off")).alias("at"))
    bit = F.expr("shiftleft(1, rank)")
    whole = F.expr("got = shiftleft(1, size) - 1")
    lists = ["row", "pid", "part"]
    both = settle(met.groupBy(*lists, "size").agg(F.bit_or(bit).alias("got")).filter(whole).select(*lists))
    met = settle(met.join(if_small(both, F.lit("")), lists, "left_semi"))
    exact = met.groupBy(*lists, "size", "at").agg(F.bit_or(bit).alias("got")).filter(whole).select("row", "pid", "at").distinct()
    if slop is None:
        return settle(exact), None
    spread = F.when(F.col("rank") == 0, F.array("at")).otherwise(F.sequence(F.col("at") - slop, F.col("at") + slop))
    near = met.select(*lists, "rank", "size", F.explode(spread).alias("at")).groupBy(*lists, "size", "at").agg(F.bit_or(bit).alias("got"))
    return settle(exact), settle(near.filter(whole).select("row", "pid").distinct())


def verified(tokens: DataFrame, exact: DataFrame, phrases: DataFrame) -> DataFrame:
    """(row, pid, at, equal): per candidate and word of its phrase, whether the document has it at its place."""
    found = tokens.select("row", F.col("words").alias("own")).join(if_small(exact, F.lit("")), "row")
    found = found.join(if_small(phrases.select("pid", "words"), F.concat_ws(" ", "words")), "pid")
    equal = F.transform("words", lambda w, i: F.coalesce(F.get("own", F.col("at") + i) == w, F.lit(False)))
    return found.select("row", "pid", "at", equal.alias("equal"))
