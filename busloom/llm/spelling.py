"""Spelling variant grouping by rolling-hash deletions.

Words: maximal runs of [A-Za-z and U+00C0 to U+00FF] of whole texts, A-Z lower-cased. Where 31 divides the crc32 of
"<doc_id>:<run>", the run loses its code point at crc32 % length. Distinct results of at least LENGTH code points and COUNT
occurrences are the words; n counts occurrences.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Prefix and suffix polynomial
hashes give the hash of a word without its i-th code point for all i at once (numpy, modulo 2^64), so a word of L code
points costs L integers and not L strings. Three kinds of integer keys meet:

* without the i-th code point, with i: words that share one differ by that code point (at most one word for each letter);
* without the i-th code point, once per distinct outcome; and the whole word: where these two meet, one word is the other
  less one code point.

Keys are dealt by their leading bits (radix), sorted inside each partition, and only keys that stand next to an equal one
stay: a word has as many as it has near words' places. Then collisions are verified on strings: the words behind the
surviving keys are joined, and groups are formed by the exact strings. Within a group, counts and the best other word
come from one ordered window over at most an alphabet of words for each place, so no pairs are emitted.

A word's form is its near word of largest n (ties: the smallest in code-point order) if that is at least RATIO times its
own n. Forms grow by RATIO each step, so chains are short; roots follow them by doubling joins.

Null texts have no runs. A null doc_id reads as an empty string. Repeated rows count each time. Runs of any length are
kept whole. An empty table gives no rows; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .postings import joinable
from .store import settle
from .tokens import mix

RUN = re.compile("[A-Za-zÀ-ÿ]+")
FOLD = {i: i + 32 for i in range(65, 91)}
LENGTH, COUNT, RATIO, EVERY = 7, 2, 10, 31
#: leading bits of a key that say where it goes
RADIX = 16
#: distinct words that a task counts before it passes them on
HELD = 200_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
DROPPED, OUTCOME, WHOLE = 0, 1, 2


def spelled(doc_id: int | None, run: str) -> str:
    """What the text's run (lower-cased) counts as."""
    h = zlib.crc32(run.encode(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode()))
    if h % EVERY:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
        total.clear()
        return batch

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for run, n in Counter(RUN.findall((text or "").translate(FOLD))).items():
                if len(run) >= LENGTH:
                    total[spelled(doc_id, run)] += n
            if len(total) >= HELD:
                yield out()
    yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(id, word, n) of the words, stored."""
    runs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_counted, "word string, n long")
    words = runs.filter(F.char_length("word") >= LENGTH).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= COUNT)
    return settle(words.select(F.monotonically_increasing_id().alias("id"), "word", "n"))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def deletions(word: str, power: np.ndarray) -> tuple[np.ndarray, np.uint64, np.ndarray]:
    """(hash without each code point, hash of the whole word, where an outcome stands first)."""
    c = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    n = len(c)
    term = c * power[:n]
    before = np.concatenate([[np.uint64(0)], np.cumsum(term, dtype=np.uint64)])  # prefix hashes: sum of c[i] * B^i
    # a suffix moves down by one power when a code point before it goes
    shifted = c[1:] * power[: n - 1]
    after = np.concatenate([np.cumsum(shifted[::-1], dtype=np.uint64)[::-1], [np.uint64(0)]])
    return before[:n] + after, before[n], np.concatenate([[True], c[1:] != c[:-1]])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(1).to_pylist()
        power = _powers(max(map(len, words), default=0) + 1)
        ids, keys, kinds, places = [], [], [], []

        def out() -> pa.RecordBatch:
            size = [len(k) for k in keys]
            arrays = [np.concatenate(keys).view(np.int64), np.repeat(ids, size), np.repeat(kinds, size).astype(np.int8), np.concatenate(places)]
            for held in (ids, keys, kinds, places):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["key", "id", "kind", "place"])

        held = 0
        for own, word in zip(batch.column(0).to_pylist(), words, strict=True):
            gone, whole, first = deletions(word, power)
            at = np.arange(len(gone), dtype=np.int32)
            length = np.uint64(len(word))
            rows = ((DROPPED, mix(gone + mix(at.astype(np.uint64) + np.uint64(1))), at), (OUTCOME, mix(gone[first] ^ (length - np.uint64(1))), at[first]), (WHOLE, mix(np.array([whole ^ length])), at[:1]))
            for kind, key, place in rows:
                ids.append(own)
                keys.append(key)
                kinds.append(kind)
                places.append(place)
                held += len(key)
            if held >= 1 << 18:
                yield out()
                held = 0
        if keys:
            yield out()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key: those next to a row of the same key. One row is carried from batch to batch."""
    last, met = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
        key = rows.column(0).to_numpy()
        same = key[1:] == key[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        keep[0] |= met
        last, met = rows.slice(rows.num_rows - 1), bool(keep[-1])
        yield rows.slice(0, rows.num_rows - 1).filter(pa.array(keep[:-1]))
    if last is not None and met:
        yield last


def meetings(words: DataFrame) -> DataFrame:
    """(id, kind, place) of the keys that another key equals, stored."""
    schema = "key long, id long, kind byte, place int"
    keys = words.select("id", "word").mapInArrow(_keys, schema)
    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key")
    return settle(dealt.mapInArrow(_met, schema).select("id", "kind", "place"))


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best (n, word)) of each word that has near words."""
    met = meetings(words).join(words, "id")
    rest = F.when(F.col("kind") == WHOLE, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    # replaced letters meet at one place; a whole word meets outcomes of any
    group = [F.when(F.col("kind") == DROPPED, F.col("place")).otherwise(F.lit(-1)).alias("at"), F.md5(rest.cast("binary")).alias("rest")]
    cells = settle(met.select("id", "word", "n", (F.col("kind") == WHOLE).alias("whole"), *group))
    of = Window.partitionBy("at", "rest")  # as many as there are letters, or places of a word and letters
    ordered = of.orderBy(F.desc("n"), "word")
    value = F.struct((-F.col("n")).alias("less"), "word")
    shorter = F.max(F.when(F.col("whole"), value)).over(of)
    longer = F.min(F.when(~F.col("whole"), value)).over(of)
    out = cells.withColumns({"rank": F.row_number().over(ordered), "size": F.count("*").over(of), "first": F.first(value).over(ordered), "next": F.lead(value).over(ordered), "shorter": shorter, "longer": longer})
    replaced, less_one = F.col("at") >= 0, F.col("shorter").isNotNull() & F.col("longer").isNotNull()
    out = out.filter((replaced & (F.col("size") > 1)) | (~replaced & less_one))
    near = F.when(replaced | F.col("whole"), F.col("size") - 1).otherwise(1)
    best = F.when(replaced, F.when(F.col("rank") == 1, F.col("next")).otherwise(F.col("first"))).when(F.col("whole"), F.col("longer")).otherwise(F.col("shorter"))
    return out.groupBy("id").agg(F.sum(near).alias("n_near"), F.min(best).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): forms followed to the last, doubling the steps each round."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        n = now.count()
        on = now.select(F.col("word").alias("root"), F.col("root").alias("then"))
        further = settle(now.join(joinable(on, n), "root", "left").select("word", F.coalesce("then", "root").alias("root"), F.col("then").isNotNull().alias("moved")))
        now = further.select("word", "root")
        if further.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word."""
    words = vocabulary(docs)
    near = settle(words.join(near_words(words), "id", "left"))
    best_n = -F.col("best.less")
    near = near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(best_n >= RATIO * F.col("n"), F.struct(F.col("best.word").alias("form"), best_n.alias("form_n"))).alias("to"))
    near = near.select("word", "n", "n_near", "to.form", "to.form_n")
    root = roots(near.filter("form is not null"))
    return near.join(root, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
