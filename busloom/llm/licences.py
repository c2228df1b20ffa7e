"""Licence scan by a positional rare-token index (DataFrame functions only).

Words are the runs of [0-9a-z] and non-ASCII characters after lower-casing A-Z. A wording (a notice or a whole licence
text) counts at a place if its mandatory key phrase stands there word for word and at least COVER of its words are
aligned: going outwards from the key in both directions, a word is aligned at the place that the last aligned one gives
it, or else at the nearest place behind that one and at most SLOP words past the given one, so words may be put in,
dropped or replaced. (A word also counts if it stands at its exact distance from the key.) As the key must stand, a file's licence words of highest inverse document frequency that decide about a wording
are the rarest terms of its key: these are looked up, the template's postings are intersected by relative position, and
what is left is verified on the file's words. The base phrases are wordings of their own: every place where one stands
is reported. The score is the largest part of a wording's words found aligned.

Null or empty texts have no words and no labels; repeated rows are judged one by one; extra columns are ignored; empty
tables give empty results.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import NOTICES, WHOLE
from .postings import if_small, intersected, lookups, numbered, tokenised
from .store import settle

#: phrase and label that are reported as base
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: part of a wording's words that must be aligned, and words that may be put in between two aligned ones
COVER, SLOP = 0.5, 4
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    return [w for w in _GAP.split(text.lower()) if w]


#: label, words of the key phrase, words of the wording that holds it
WORDINGS = tuple((label, words_of(key), words_of(text)) for label, key, text in NOTICES + WHOLE)


def wordings(docs: DataFrame) -> DataFrame:
    """(words, kind, label, first, size): the key phrase is `size` words from `first`."""
    rows = [(p.split(), "base", label, 0, len(p.split())) for p, label in BASE]
    for label, key, words in WORDINGS:
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rows.append((words, "more", label, at, len(key)))
    return docs.sparkSession.createDataFrame(rows, "words array<string>, kind string, label string, first int, size int")


def _aligned(own: Column, words: Column, start: Column) -> Column:
    """Words of `words` after the first that follow it in order in `own`, where the first stands at `start`."""

    def step(s: Column, i: Column) -> Column:
        word = F.get(words, i)
        due = s["at"] + i - s["i"]
        past = F.array_position(F.slice(own, s["at"] + 2, due + SLOP - s["at"]), word)  # from the word behind the last one
        found = F.when(F.get(own, due) == word, due).when(past > 0, s["at"] + past.cast("int"))
        return F.when(found.isNotNull(), F.struct(found.alias("at"), i.alias("i"), (s["n"] + 1).alias("n"))).otherwise(s)

    first = F.struct(start.cast("int").alias("at"), F.lit(0).alias("i"), F.lit(0).alias("n"))
    return F.aggregate(F.slice(F.sequence(F.lit(0), F.size(words)), 2, F.size(words) - 1), first, step, lambda s: s["n"])


def _cover(tokens: DataFrame, exact: DataFrame, phrases: DataFrame) -> DataFrame:
    """(row, pid, at, cover) of the candidates whose key stands. Only the part of a document that the wording may reach is
    looked at."""
    found = tokens.select("row", F.col("words").alias("own")).join(if_small(exact, F.lit("")), "row")
    found = found.join(F.broadcast(phrases.select("pid", "words", "first", "size")), "pid")  # as many as there are wordings
    key = F.col("at") + F.col("first")
    found = found.filter((key >= 0) & (F.slice("own", F.greatest(key, F.lit(0)) + 1, F.col("size")) == F.slice("words", F.col("first") + 1, F.col("size"))))
    reach = F.size("words") * (SLOP + 1)
    # the key's last word and what follows; its first word and what precedes it, backwards
    behind = F.slice("own", key + F.col("size"), reach)
    before = F.reverse(F.slice("own", F.greatest(key + 1 - reach, F.lit(0)) + 1, F.least(key + 1, reach)))
    rest = F.slice("words", F.col("first") + F.col("size"), F.size("words"))
    head = F.reverse(F.slice("words", F.lit(1), F.col("first") + 1))
    found = found.withColumns({"behind": behind, "before": before, "rest": rest, "head": head})
    in_place = F.aggregate(F.transform("words", lambda w, i: F.coalesce(F.get("own", F.col("at") + i) == w, F.lit(False))), F.lit(0), lambda n, x: n + x.cast("int"))
    zero = F.lit(0)
    aligned = F.col("size") + _aligned(F.col("behind"), F.col("rest"), zero) + _aligned(F.col("before"), F.col("head"), zero)
    return found.select("row", "pid", "at", (F.greatest(aligned, in_place) / F.size("words")).alias("cover"))


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places (kind, label, at, cover)."""
    tokens = tokenised(docs.select("doc_id", "text"))
    phrases = numbered(wordings(docs), "kind", "label", "first", "size")
    keys = F.array(F.struct("first", "size"))
    exact, _ = intersected(tokens, lookups(tokens, phrases, keys), None)
    found = _cover(tokens, exact, phrases).filter(F.col("cover") >= COVER)
    found = found.join(F.broadcast(phrases.select("pid", "kind", "label")), "pid")
    found = found.select("row", F.struct("kind", "label", "at", "cover").alias("place")).distinct()
    found = settle(found.groupBy("row").agg(F.array_sort(F.collect_list("place")).alias("places")))  # non-overlapping keys: at most the document's length
    out = tokens.select("row", "doc_id", "n_words").join(if_small(found, F.to_json("places")), "row", "left")
    out = out.withColumn("places", F.coalesce("places", F.array().cast("array<struct<kind:string,label:string,at:int,cover:double>>")))
    base = F.filter("places", lambda h: h["kind"] == "base")
    starts = F.transform(base, lambda h: h["at"].cast("long"))

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda h: h["label"]))), ",")

    return out.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda h: h["cover"])), F.lit(0.0)).alias("score"),
        "places",
    )
