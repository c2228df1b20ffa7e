"""Product-quantised codes of vectors, trained by weighted Lloyd rounds over distinct integer parts.

A vector's components x become integers floor(256 * x) and are cut into PARTS equal consecutive parts. Equal parts at the
same position are one weighted row, so a vector that a third of the table repeats costs one row a position, and each round
reads distinct rows only: every task assigns its rows to the nearest codebook entry (numpy, exact 64-bit integers) and passes
on one sum per entry, so a round gathers PARTS * ENTRIES sums whatever the input. Codes and errors go back to the vectors by
a join on (position, part). Parts that hold at least 1 / HOT of the vectors of a position are at most HOT a position by
that share, so they are looked up from a broadcast table; the rest has no hot key and is joined by shuffle.

Defined cases:
* vectors that are null or hold a null or non-finite component are dropped;
* the width is that of the longest kept vector, rounded up to a multiple of PARTS; shorter vectors end in zeros;
* components beyond +-limit(width) count as that bound, the largest at which no distance overflows (about 2^27 for 64
  components, |x| of about 740,000);
* codebooks start from the smallest ids, nulls last, repeated ids by their components; fewer vectors than ENTRIES
  give fewer entries; an empty table gives no rows;
* repeated rows are coded one by one; columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .postings import if_small
from .store import settle

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: a part is hot if one in so many vectors has it
HOT = 1000
#: rows whose distances to all entries are held at once
BLOCK = 4096


def limit(width: int) -> int:
    """The largest component size at which the squared distance of two vectors of this width fits 63 bits."""
    return max(1, math.isqrt((1 << 63) // max(1, width)) // 2 - 1)


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, label, parts: array<array<int>>) of each kept vector, stored."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False)))
    kept = vectors.filter(F.col("embedding").isNotNull() & finite).select("vec_id", "label", x.alias("x"))
    longest = kept.agg(F.max(F.size("x"))).first()[0] or 0
    size = max(1, -(-longest // PARTS))
    bound = limit(size * PARTS)
    whole = F.transform("x", lambda v: F.greatest(F.lit(-bound), F.least(F.lit(bound), F.floor(F.greatest(F.lit(-2.0**40), F.least(F.lit(2.0**40), v)) * SCALE))).cast("int"))
    padded = F.concat(whole, F.array_repeat(F.lit(0), F.lit(size * PARTS) - F.size("x")))
    return settle(kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", _cut(padded, size).alias("parts")))


def _cut(components: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.slice(components, k * size + 1, size))


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (part, entry) in exact integers."""
    out = np.zeros((len(parts), len(entries)), np.int64)
    for k in range(parts.shape[1]):
        d = parts[:, k, None] - entries[None, :, k]
        out += d * d
    return out


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, ties to the lower; its squared distance) of each part."""
    code, error = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
    for a in range(0, len(parts), BLOCK):
        d = distances(parts[a : a + BLOCK], entries)
        own = d.argmin(axis=1)
        code[a : a + BLOCK], error[a : a + BLOCK] = own, d[np.arange(len(own)), own]
    return code, error


def _by_position(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, row numbers in the batch, their parts) of a batch of (pos, part, ...)."""
    pos = batch.column(0).to_numpy()
    flat = batch.column(1).flatten().to_numpy().reshape(-1, size).astype(np.int64)
    for p in np.unique(pos):
        at = np.flatnonzero(pos == p)
        yield int(p), at, flat[at]


def _summed(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """Per (pos, entry): rows and component sums, weighted, of the parts nearest to it."""
    n, size = books.shape[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, total, seen = np.zeros((PARTS, n), object), np.zeros((PARTS, n, size), object), False
        for batch in batches:
            weight = batch.column(2).to_numpy()
            for p, at, parts in _by_position(batch, size):
                code, _ = nearest(parts, books[p])
                # sums that may pass 63 bits are held as Python integers
                kind = np.int64 if int(weight[at].astype(object).sum()) * (1 + int(np.abs(parts).max())) < 1 << 62 else object
                w, n_here, sum_here = weight[at].astype(kind), np.zeros(n, kind), np.zeros((n, size), kind)
                np.add.at(n_here, code, w)
                np.add.at(sum_here, code, w[:, None] * parts.astype(kind))
                rows[p] += n_here
                total[p] += sum_here
                seen = True
        if seen:
            p, e = np.nonzero(rows)
            text = lambda a: [str(v) for v in a]
            columns = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(text(rows[p, e])), pa.array([text(v) for v in total[p, e]], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["pos", "entry", "n", "total"])

    part = distinct.select("pos", "part", "n").mapInArrow(run, "pos int, entry int, n string, total array<string>")
    big = "decimal(38,0)"
    sums = [F.sum(F.get("total", F.lit(k)).cast(big)).alias(f"s{k}") for k in range(size)]
    return part.groupBy("pos", "entry").agg(F.sum(F.col("n").cast(big)).alias("n"), *sums)


def train(kept: DataFrame, distinct: DataFrame) -> np.ndarray:
    """Codebooks (position, entry, component) after ROUNDS rounds; what is gathered is as large as the codebooks."""
    ids = kept.select("parts", F.col("vec_id").isNull().alias("unnamed"), "vec_id").orderBy("unnamed", "vec_id", "parts").limit(ENTRIES)
    first = [r.parts for r in ids.collect()]
    books = np.array(first, np.int64).transpose(1, 0, 2).copy()
    for _ in range(ROUNDS):
        for r in _summed(distinct, books).collect():
            books[r.pos, r.entry] = [int(r[f"s{k}"]) // int(r.n) for k in range(books.shape[2])]
    return books


def _assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(pos, part, n, code, error) of each distinct part."""
    size = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, at, parts in _by_position(batch, size):
                code[at], error[at] = nearest(parts, books[p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code), pa.array(error)], [*batch.schema.names, "code", "error"])

    return distinct.select("pos", "part", "n").mapInArrow(run, "pos int, part array<int>, n long, code int, error long")


def compressed(vectors: DataFrame) -> DataFrame:
    """vec_id, code (PARTS entry numbers, two hex digits each), error, label_error, codebooks_sha256 of each kept row."""
    kept = integer_vectors(vectors)
    n = kept.count()
    if not n:
        return kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    parts = kept.select("row", F.posexplode("parts").alias("pos", "part"))
    distinct = settle(parts.groupBy("pos", "part").agg(F.count("*").alias("n")))
    books = train(kept, distinct)
    digest = hashlib.sha256(",".join(map(str, books.ravel())).encode()).hexdigest()
    codes = settle(_assigned(distinct, books))
    hot = F.col("n") * HOT >= n
    value = F.struct("pos", "code", "error").alias("value")
    common = F.broadcast(codes.filter(hot).select("pos", "part", value))  # at most HOT a position
    near = settle(parts.join(common, ["pos", "part"], "left"))
    rest = near.filter("value is null").select("row", "pos", "part").join(codes.filter(~hot).select("pos", "part", value), ["pos", "part"])
    cells = near.filter("value is not null").select("row", "value").unionByName(rest.select("row", "value"))
    coded = cells.groupBy("row").agg(F.array_sort(F.collect_list("value")).alias("cells"), F.sum("value.error").alias("error"))  # PARTS a row
    code = F.array_join(F.transform("cells", lambda c: F.lower(F.lpad(F.hex(c["code"]), 2, "0"))), "")
    whole = settle(kept.select("row", "vec_id", "label").join(coded.select("row", code.alias("code"), "error"), "row"))
    of_label = settle(whole.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of_label"))
    out = whole.join(if_small(of_label, F.col("of_label").cast("string")), F.col("label").eqNullSafe(F.col("of_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
