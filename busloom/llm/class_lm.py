"""Language-model scoring with Brown-style class bigrams.

Tokens are the words of a text (runs of non-space, A-Z lower-cased) and one end. Learned from the training rows only:

* the count of every token, summed by Spark over the whole corpus;
* seed classes: bigram counts over the most frequent tokens, the seeds (all others are one unit), are summed by Spark, and
  an exchange clustering gives these tokens classes: each in turn moves to the class that most raises the likelihood of the
  class bigrams, for ROUNDS rounds. Its table of at most (seeds + 1) squared cells is all that the driver holds;
* classes of all other tokens seen twice or more, whatever their number: Spark counts each token's seed neighbours once. A
  round exchanges every such token into the class that most raises the likelihood, to first order in its counts, all at the
  same time; the class tables are then summed over all tokens, seeds too. Rounds go on until the likelihood of class and
  seed class rises by less than RISE of itself (at most PASSES); the best round's tables give the classes;
* class transitions, counted over the whole training corpus under these classes.

Sizes follow the corpus: V tokens seen twice or more give 2 * V ** (1/3) classes and 96 * V ** (1/4) seeds (`sizes`).

A token's probability is P(class | previous class) * P(token | class). Transitions are smoothed with the class
frequencies. Tokens seen once and unknown ones are one more class: emissions there have 0.1 added per token and one share
for unknown ones. So the probabilities of all known tokens and the unknown one sum to one after every token. The first
token follows the end's class.

The HEAD most frequent tokens go to the tasks as a table of bounded size; counts and classes of all others are joined by
shuffle. Null texts are empty: one end token. Repeated rows are scored one by one, extra columns are ignored; empty
tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language_id import held_out
from .store import settle
from .tokens import as_bytes, batches, mix

ROUNDS, PASSES, RISE, HEAD = 4, 6, 1e-3, 65_536
_ADD = 0.1
#: a class in a stored sequence; 2 * V ** (1/3) stays below 65,536 up to 3.5e13 tokens
_CODE = np.dtype("<u2")
END = int(mix(np.array([0xE05], np.uint64)).view(np.int64)[0])


def sizes(words: int) -> tuple[int, int]:
    """(classes, seeds) for a corpus of `words` tokens seen twice or more. One more class, numbered `classes`, holds tokens
    seen once and unknown ones."""
    return max(2, round(2 * words ** (1 / 3))), max(2, round(96 * words**0.25))


def _token_rows(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, token hashes with an end after each text, tokens per text)."""
    for first, w in batches(texts):
        n = np.diff(w.at) + 1
        out = np.empty(int(n.sum()), np.int64)
        ends = np.cumsum(n) - 1
        is_end = np.zeros(len(out), bool)
        is_end[ends] = True
        out[is_end] = END
        out[~is_end] = w.hash[: w.at[-1]].view(np.int64)
        yield first, out, n


def _counts(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        parts = [t for _, t, _ in _token_rows(as_bytes(batch.column(0)))]
        token, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], ["token", "n"])


class Table:
    """Values of some tokens, found by their hash."""

    def __init__(self, token: np.ndarray, *values: np.ndarray):
        by = np.argsort(token)
        self.token, self.values = token[by], [v[by] for v in values]

    def find(self, token: np.ndarray, *missing: int) -> list[np.ndarray]:
        """Per kind of value, those of the tokens; `missing` for others."""
        if not len(self.token):
            return [np.full(len(token), m) for m in missing]
        i = np.minimum(np.searchsorted(self.token, token), len(self.token) - 1)
        hit = self.token[i] == token
        return [np.where(hit, v[i], m) for v, m in zip(self.values, missing, strict=True)]


def _most_frequent(counts: DataFrame, limit: int) -> DataFrame:
    """About `limit` most frequent tokens seen twice or more (all, if there are fewer). Of the count that is left cut in two,
    those tokens stay whose hash is in the share that fits, so ties are split the same way each time."""
    levels = counts.filter("n > 1").groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(limit).collect()
    least, held, split, share = None, 0, None, 0.0
    for level in levels:
        if held + level["words"] > limit:
            split, share = level["n"], (limit - held) / level["words"]
            break
        least, held = level["n"], held + level["words"]
    part = (F.col("n") == F.lit(split)) & (F.pmod(F.xxhash64("token"), F.lit(1 << 20)) < int(share * (1 << 20)))
    return counts.filter(F.coalesce(F.col("n") >= F.lit(least), F.lit(False)) | F.coalesce(part, F.lit(False)))


def _previous(unit: np.ndarray, n: np.ndarray, end_unit: int) -> np.ndarray:
    prev = np.empty_like(unit)
    prev[1:] = unit[:-1]
    prev[np.cumsum(n) - n] = end_unit
    return prev


def exchange(left: np.ndarray, right: np.ndarray, n: np.ndarray, units: int, fixed: np.ndarray, groups: int) -> np.ndarray:
    """Class of each unit, one of `groups`, from bigram counts (left, right, n). Units with fixed >= 0 keep that class."""
    classes = groups + int((fixed >= 0).sum())
    size = np.bincount(left, n, units)
    cls = np.where(fixed >= 0, fixed, np.arange(units) % groups)

    def table(key, other):
        order = np.argsort(key, kind="stable")
        return np.searchsorted(key[order], np.arange(units + 1)), other[order], n[order]

    (ra, ri, rn), (la, li, ln) = table(left, right), table(right, left)
    big = np.bincount(cls[left] * classes + cls[right], n, classes * classes).reshape(classes, classes)
    total = np.bincount(cls, size, classes)
    f = lambda x: x * np.log(np.maximum(x, 1e-300))
    base = f(big)
    diag = np.arange(classes)

    def put(c, left_c, right_c, own, sign):
        big[:, c] += sign * left_c
        big[c, :] += sign * right_c
        big[c, c] += sign * own
        np.maximum(big[:, c], 0, out=big[:, c])
        np.maximum(big[c, :], 0, out=big[c, :])
        base[:, c], base[c, :] = f(big[:, c]), f(big[c, :])

    for _ in range(ROUNDS):
        moved = 0
        for w in np.flatnonzero((fixed < 0) & (size > 0)):
            others, counts = ri[ra[w] : ra[w + 1]], rn[ra[w] : ra[w + 1]]
            own = counts[others == w].sum()
            right_c = np.bincount(cls[others], np.where(others == w, 0, counts), classes)
            others, counts = li[la[w] : la[w + 1]], ln[la[w] : la[w + 1]]
            left_c = np.bincount(cls[others], np.where(others == w, 0, counts), classes)
            a = cls[w]
            put(a, left_c, right_c, own, -1)
            total[a] -= size[w]
            # classes that stand on neither side of w change nothing
            before, after = np.flatnonzero(left_c), np.flatnonzero(right_c)
            into = (f(big[before] + left_c[before, None]) - base[before]).sum(0)
            out_of = (f(big[:, after] + right_c[None, after]) - base[:, after]).sum(1)
            corner, was = big[diag, diag], base[diag, diag]
            both = f(corner + left_c + right_c + own) - f(corner + left_c) - f(corner + right_c) + was
            gain = into + out_of + both - 2 * (f(total + size[w]) - f(total))
            b = int(gain[:groups].argmax())
            if gain[b] <= gain[a] + 1e-9:
                b = a
            moved += a != b
            cls[w] = b
            put(b, left_c, right_c, own, 1)
            total[b] += size[w]
        if not moved:
            break
    return cls


def _neighbours(rows: DataFrame, seeds, units: int) -> DataFrame:
    """(token, slot, n): how often seed u stands before (slot u) or after (slot units + u) a token."""

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(seeds.value.find(np.array([END]), -1)[0][0])
        for batch in batches_:
            for _, token, n in _token_rows(as_bytes(batch.column(0))):
                (unit,) = seeds.value.find(token, -1)
                kind, number = np.unique(token, return_inverse=True)
                before = _previous(unit, n, end)
                after = np.empty_like(unit)
                after[:-1] = unit[1:]
                after[np.cumsum(n) - 1] = -1  # nothing follows an end
                code = np.concatenate([number[x >= 0] * (2 * units) + side * units + x[x >= 0] for side, x in enumerate((before, after))])
                code, times = np.unique(code, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(kind[code // (2 * units)]), pa.array((code % (2 * units)).astype(np.int32)), pa.array(times.astype(np.int32))], ["token", "slot", "n"])

    return rows.select("text").mapInArrow(run, "token long, slot int, n int")


def first_order(tables: np.ndarray) -> np.ndarray:
    """What a neighbour in each slot of `tables` (2 * classes, classes) adds to the likelihood of a token in each class.

    tables[k, c] counts neighbours of class k before tokens of class c, tables[classes + k, c] those after them. Putting a
    token into class c gains, to first order, the sum of log P(k | c) over its neighbours, here smoothed by k's share."""
    sides = tables.reshape(2, -1, tables.shape[1])
    share = (sides.sum(2, keepdims=True) + _ADD) / (sides.sum((1, 2), keepdims=True) + _ADD * sides.shape[1])
    return np.log((sides + share) / (sides.sum(1, keepdims=True) + 1)).reshape(tables.shape)


def likelihood(tables: np.ndarray) -> float:
    """Log-likelihood of neighbour classes given token classes, above that of the classes by themselves."""
    f = lambda x: (x * np.log(np.maximum(x, 1e-300))).sum()
    return sum(f(x) - f(x.sum(0)) - f(x.sum(1)) + f(x.sum()) for x in tables.reshape(2, -1, tables.shape[1]))


def by_class(slot: np.ndarray, n: np.ndarray, row: np.ndarray, rows: int, unit_cls: np.ndarray, classes: int) -> np.ndarray:
    """Counts (rows, 2 * classes) of neighbours (row, slot, n) by their class."""
    units = len(unit_cls)
    by = unit_cls[slot % units] + classes * (slot // units)
    return np.bincount(row * (2 * classes) + by, n, rows * 2 * classes).reshape(rows, 2 * classes)


def best_class(profile: np.ndarray, log: np.ndarray) -> np.ndarray:
    """The class of each profile (rows, 2 * classes) that gains most; of equals the first, so the first of all without any."""
    return np.round(profile @ log, 6).argmax(1)


def _exchanged(batch: pa.RecordBatch, log: np.ndarray, unit_cls: np.ndarray, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(classes, their profiles) of parts of a batch that ends in unit, slots and times: a seed's own, else the best."""
    classes = log.shape[1]
    for first in range(0, batch.num_rows, rows):
        unit, slots, times = (c.slice(first, rows) for c in batch.columns[-3:])
        of = np.repeat(np.arange(len(slots)), slots.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        profile = by_class(slots.flatten().to_numpy(), times.flatten().to_numpy(), of, len(slots), unit_cls, classes)
        unit = unit.fill_null(-1).to_numpy(zero_copy_only=False)
        yield np.where(unit >= 0, unit_cls[unit], best_class(profile, log)), profile


def _summed(packed: DataFrame, log: np.ndarray, unit_cls: np.ndarray) -> np.ndarray:
    """The class tables after every token but the seeds went to its best class."""
    shared = packed.sparkSession.sparkContext.broadcast((log, unit_cls))
    classes = log.shape[1]

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((classes, 2 * classes))
        for batch in batches_:
            for cls, profile in _exchanged(batch, *shared.value):
                order = np.argsort(cls, kind="stable")
                start = np.flatnonzero(np.diff(cls[order], prepend=-1))
                total[cls[order][start]] += np.add.reduceat(profile[order], start, axis=0)
        total = total.T
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total.ravel()[found].astype(np.int64))], ["cell", "n"])

    cells = packed.select("unit", "slots", "times").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    return np.bincount(cells.column("cell").to_numpy(), cells.column("n").to_numpy(), 2 * classes * classes).reshape(2 * classes, classes)


def classes_of(train: DataFrame, counts: DataFrame, words: int) -> DataFrame:
    """(token, n, cls) of every token of the training rows (text); counts (token, n) are theirs, `words` of them over one."""
    spark = train.sparkSession
    classes, limit = sizes(words)
    top = _most_frequent(counts, limit).toArrow()
    token = top.column("token").to_numpy()
    token = token[np.lexsort((token, -top.column("n").to_numpy()))]
    seeds = spark.sparkContext.broadcast(Table(token, np.arange(len(token))))
    units = len(token) + 1

    def bigrams(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(seeds.value.find(np.array([END]), units - 1)[0][0])
        for batch in batches_:
            parts = []
            for _, token, n in _token_rows(as_bytes(batch.column(0))):
                (unit,) = seeds.value.find(token, units - 1)
                parts.append(_previous(unit, n, end).astype(np.int64) * units + unit)
            pair, n = np.unique(np.concatenate(parts) if parts else np.zeros(0, np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], ["pair", "n"])

    pairs = train.select("text").mapInArrow(bigrams, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow().sort_by("pair")
    pair, n = pairs.column("pair").to_numpy(), pairs.column("n").to_numpy().astype(float)
    left, right = pair // units, pair % units
    fixed = np.full(units, -1)
    fixed[-1] = classes
    unit_cls = exchange(left, right, n, units, fixed, classes)[:-1]
    if not len(unit_cls):  # no token is seen twice
        return counts.select("token", "n", F.lit(classes).alias("cls"))
    # neighbours of each token, counted once: at most two numbers a seed and token
    contexts = _neighbours(train, seeds, units - 1).groupBy("token", "slot").agg(F.sum("n").cast("int").alias("n"))
    lists = contexts.groupBy("token").agg(F.collect_list(F.struct("slot", "n")).alias("beside"))
    seed = F.broadcast(spark.createDataFrame(pa.table({"token": token, "unit": np.arange(len(token), dtype=np.int32)})))  # the seeds
    packed = counts.filter("n > 1").join(lists, "token", "left").join(seed, "token", "left")
    packed = settle(packed.select("token", "n", "unit", F.col("beside.slot").alias("slots"), F.col("beside.n").alias("times")))

    inside = (left < units - 1) & (right < units - 1)
    pair = unit_cls[left[inside]] * classes + unit_cls[right[inside]]
    big = np.bincount(pair, n[inside], classes * classes).reshape(classes, classes)
    tables = np.concatenate([big, big.T])
    best, log = -np.inf, first_order(tables)
    for _ in range(PASSES):
        tables = _summed(packed, first_order(tables), unit_cls)
        now = likelihood(tables)
        enough = now < best + RISE * abs(best)
        if now > best:
            best, log = now, first_order(tables)
        if enough:
            break
    shared = spark.sparkContext.broadcast((log, unit_cls))

    def last(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            cls = np.concatenate([np.zeros(0, np.int32), *(cls.astype(np.int32) for cls, _ in _exchanged(batch, *shared.value))])
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cls)], ["token", "n", "cls"])

    kept = packed.mapInArrow(last, "token long, n long, cls int")
    return settle(kept.unionByName(counts.filter("n < 2").select("token", "n", F.lit(classes).alias("cls"))))


def _sequences(rows: DataFrame, classes: DataFrame, tokens: int, known: int, rare_cls: int) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, held_out, n_tokens, n_known, base, emit, seq) per row, stored: log10 probabilities of the tokens by themselves
    and within their classes, and the classes as two bytes each; and the size of each class. rare_cls is the last class."""
    spark = rows.sparkSession
    held = {r["cls"]: (r["n"], r["words"]) for r in classes.groupBy("cls").agg(F.sum("n").alias("n"), F.count("*").alias("words")).collect()}
    size = np.array([held.get(c, (0, 0))[0] for c in range(rare_cls + 1)], float)
    base_log = math.log10(tokens + _ADD * (known + 1))
    log_size = np.log10(np.maximum(size, 1))
    log_size[rare_cls] = math.log10(size[rare_cls] + _ADD * (held.get(rare_cls, (0, 0))[1] + 1))
    top = _most_frequent(classes, HEAD).toArrow()
    shared = spark.sparkContext.broadcast(Table(*(top.column(c).to_numpy() for c in ("token", "n", "cls"))))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            columns: list[list] = [[] for _ in range(7)]
            for _, token, n in _token_rows(as_bytes(batch.column(batch.num_columns - 1))):
                count, cls = shared.value.find(token, 0, -1)
                at = np.cumsum(n) - n
                inside = cls >= 0
                log = np.log10(np.maximum(count, 1))
                seq = cls.astype(_CODE)
                out = np.flatnonzero(~inside)
                cut = np.searchsorted(out, at[1:])
                sums = (n, *(np.add.reduceat(x, at) for x in (inside.astype(np.int64), np.where(inside, np.log10(count + _ADD) - base_log, 0.0), np.where(inside, log - log_size[cls], 0.0))))
                for c, x in zip(columns, sums, strict=False):
                    c += x.tolist()
                columns[4] += [x.tobytes() for x in np.split(seq, at[1:])]
                columns[5] += np.split(out - np.repeat(at, n)[out], cut)
                columns[6] += np.split(token[out], cut)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "emit", "seq", "at", "rest"]
    given = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    part = settle(given.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, emit double, seq binary, at array<int>, rest array<long>"))
    rare = part.select("row", F.inline(F.arrays_zip("at", "rest"))).withColumnRenamed("rest", "token").join(classes, "token", "left")
    rare = rare.select("row", "at", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("cls", F.lit(rare_cls)).alias("cls"))
    log = F.when(F.col("cls") == rare_cls, F.log10(F.col("n") + _ADD)).otherwise(F.log10("n")) - F.get(F.array(*[F.lit(float(x)) for x in log_size]), F.col("cls"))
    rare = rare.groupBy("row").agg(
        F.sum((F.col("n") > 0).cast("long")).alias("more"),
        F.sum(F.log10(F.col("n") + _ADD) - base_log).alias("rare_base"),
        F.sum(log).alias("rare_emit"),
        F.collect_list(F.struct("at", "cls")).alias("put"),  # as long as the text
    )
    out = part.drop("at", "rest").join(rare, "row", "left").fillna(0, ["more"]).fillna(0.0, ["rare_base", "rare_emit"])
    out = out.select("doc_id", "held_out", "n_tokens", F.col("n_known") + F.col("more"), F.col("base") + F.col("rare_base"), F.col("emit") + F.col("rare_emit"), "seq", "put.at", "put.cls")

    def fill(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            seqs = []
            for seq, at, cls in zip(batch.column(6), batch.column(7), batch.column(8), strict=True):
                own = np.frombuffer(seq.as_py(), _CODE)
                if at.is_valid:
                    own = own.copy()
                    own[at.values.to_numpy()] = cls.values.to_numpy()
                seqs.append(own.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(seqs, pa.binary())], ["doc_id", "held_out", "n_tokens", "n_known", "base", "emit", "seq"])

    filled = out.mapInArrow(fill, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, emit double, seq binary")
    return settle(filled), size


def _pairs(seqs: list[bytes], end: int, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class pairs of all tokens, where each sequence starts)."""
    n = np.array([len(s) // _CODE.itemsize for s in seqs], np.int64)
    cls = np.frombuffer(b"".join(seqs), _CODE).astype(np.int64)
    return _previous(cls, n, end) * classes + cls, np.cumsum(n) - n


def transitions(sequences: DataFrame, end: int, classes: int) -> np.ndarray:
    """log10 P(class | previous class) of `classes` classes, learned from the sequences that are not held out."""

    def count(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes**2, np.int64)
        for batch in batches_:
            if batch.num_rows:
                total += np.bincount(_pairs(batch.column(0).to_pylist(), end, classes)[0], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["pair", "n"])

    pairs = sequences.filter("not held_out").select("seq").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    big = np.bincount(pairs.column("pair").to_numpy(), pairs.column("n").to_numpy(), classes**2).reshape(classes, classes)
    prior = (big.sum(0) + _ADD) / (big.sum() + _ADD * classes)
    return np.log10((big + prior) / (big.sum(1, keepdims=True) + 1))


def class_scores(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out(0, 10).alias("held_out"))
    train = rows.filter("not held_out").select("text")
    counts = settle(train.mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    tokens, known, words = (x or 0 for x in counts.agg(F.sum("n"), F.count("*"), F.count_if(F.col("n") > 1)).first())
    rare, _ = sizes(words)
    classes = classes_of(train, counts, words)
    sequences, _ = _sequences(rows, classes, tokens, known, rare)
    ends = classes.filter(F.col("token") == END).first()
    end = ends["cls"] if ends else rare
    shared = docs.sparkSession.sparkContext.broadcast(transitions(sequences, end, rare + 1))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = shared.value.ravel()
        for batch in batches_:
            sums = np.zeros(0)
            if batch.num_rows:
                pair, at = _pairs(batch.column(6).to_pylist(), end, rare + 1)
                sums = np.add.reduceat(step[pair], at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(sums)], ["doc_id", "held_out", "n_tokens", "n_known", "base", "emit", "step"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = sequences.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, emit double, step double")
    score = F.col("emit") + F.col("step")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), score.alias("score"), F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"))
