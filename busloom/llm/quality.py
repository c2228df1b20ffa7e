"""Quality classification by co-training of two views.

The text view holds shapes and frequencies of a text's words; the metadata view holds language, source, lengths, line
layout and markup shares of the page. Both are ridge classifiers (least squares on class marks), which need no more
than sums of products of the features, so that they train on any number of rows in one pass each.

Over ROUNDS rounds every unlabelled document is scored by both views; each view labels all documents that it is sure
of, and these pseudo-labels join the other view's training sums, weighing PSEUDO times the labelled rows of their class.
A view is sure where labelled documents set aside for this show that at least SURE of its labels of that kind are right;
a view that never is teaches nothing, and documents on which sure views disagree teach nothing. Of the labelled
documents three fifths train, one fifth sets these thresholds, and on the last fifth, unseen by both, each view is
calibrated and a small regression on the two calibrated log-odds combines them. All documents are scored.

At most about LABELLED labelled documents, drawn by a hash of doc_id, are used; nothing else is bounded.

Null or empty texts, languages and sources have features of their own; labels that are null are ignored; of several
labels of a document the mean counts. Without labels of both kinds every document scores 0.5 and none is rejected.
Repeated rows are scored one by one; extra columns are ignored; empty tables give empty results. Documents whose score
is below REJECT are rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .postings import if_small, keyed, row_key
from .store import settle
from .tokens import as_bytes, batches

LABELLED, ROUNDS, REJECT = 10_000, 3, 0.5
#: share of right labels, on at least so many documents, from which a view may teach
SURE, SHOWN = 0.98, 10
PSEUDO, RIDGE = 1.0, 5.0
SHAPES, WORDS, GIVEN = 64, 128, 48
STATS, LAYOUT = 8, 10
WIDE = (STATS + SHAPES + WORDS, GIVEN + LAYOUT)  # of the text view and the metadata view
_IN_LINE = np.ones(256, bool)
_IN_LINE[[10, 13]] = False


def _text_view(texts: list[bytes]) -> np.ndarray:
    """Rows of STATS statistics, SHAPES frequencies of word shapes and WORDS frequencies of hashed words."""
    rows = []
    for _, w in batches(texts):
        n = np.diff(w.at)
        text = np.repeat(np.arange(len(n)), n)
        m = len(n)
        plain = np.frombuffer(w.data, np.uint8)
        is_letter = ((plain | 32) >= 97) & ((plain | 32) <= 122) | (plain >= 128)
        is_mark = (plain > 32) & ~is_letter & ~((plain >= 48) & (plain <= 57))
        total = [np.concatenate([[0], np.cumsum(x)]) for x in (is_letter, is_mark)]
        let, mark = (t[w.end] - t[w.start] for t in total)
        size = (w.end - w.start).astype(float)
        ends_mark = is_mark[w.end - 1] if len(size) else np.zeros(0, bool)
        last = w.bytes[w.end - 1].astype(np.int64) if len(size) else np.zeros(0, np.int64)
        shape = (np.minimum(mark, 3) * 16 + np.where(ends_mark, last % 15 + 1, 0)) % SHAPES if len(size) else np.zeros(0, np.int64)
        per = lambda x: np.bincount(text, x, m) / np.maximum(n, 1)
        order = np.lexsort((w.hash[: len(text)], text))
        h, t = w.hash[: len(text)][order], text[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (t[1:] != t[:-1])
        distinct = np.bincount(t[fresh], minlength=m) / np.maximum(n, 1)
        again = np.zeros(len(text), bool)
        if len(text) > 1:
            again[1:] = (w.hash[1 : len(text)] == w.hash[: len(text) - 1]) & (text[1:] == text[:-1])
        stats = np.stack([per(size), per(size**2) / 20, per(mark / np.maximum(size, 1)), distinct, per(again.astype(float)), per(ends_mark.astype(float)), per((let == 0).astype(float)), (n == 0).astype(float)], 1)
        shapes = np.bincount(text * SHAPES + shape, minlength=m * SHAPES).reshape(m, SHAPES)
        words = np.bincount(text * WORDS + (w.hash[: len(text)] % np.uint64(WORDS)).astype(np.int64), minlength=m * WORDS).reshape(m, WORDS)
        rows.append(np.concatenate([stats, shapes / np.maximum(n, 1)[:, None], words / np.maximum(n, 1)[:, None]], 1))
    return np.concatenate(rows) if rows else np.zeros((0, WIDE[0]))


def _layout(texts: list[bytes]) -> np.ndarray:
    """Rows of LAYOUT statistics of lines and markup."""
    rows = []
    for first, w in batches(texts, False, _IN_LINE):
        n = np.diff(w.at)
        m = len(n)
        line = np.repeat(np.arange(m), n)
        ends = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts[first : first + m]])])
        plain = np.frombuffer(w.data, np.uint8)
        of = np.repeat(np.arange(m), np.diff(ends))
        size = np.maximum(np.diff(ends) - 1, 1)
        share = lambda x: np.bincount(of, x, m) / size
        upper, digit = (plain >= 65) & (plain <= 90), (plain >= 48) & (plain <= 57)
        letter = ((plain | 32) >= 97) & ((plain | 32) <= 122) | (plain >= 128)
        mark = (plain > 32) & ~letter & ~digit
        per = lambda x: np.bincount(line, x, m) / np.maximum(n, 1)
        h = w.hash[: len(line)]
        order = np.lexsort((h, line))
        fresh = np.ones(len(line), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (line[order][1:] != line[order][:-1])
        distinct = np.bincount(line[order][fresh], minlength=m) / np.maximum(n, 1)
        length = np.log1p((w.end - w.start).astype(float))[: len(line)]
        last = mark[w.end[: len(line)] - 1].astype(float) if len(line) else np.zeros(0)
        rows.append(np.stack([np.log1p(n) / 5, per(length) / 5, per(length**2) / 25, distinct, per(last), share(mark), share(digit), share(upper), share(plain >= 128), share((plain == 60) | (plain == 124) | (plain == 123))], 1))
    return np.concatenate(rows) if rows else np.zeros((0, LAYOUT))


def _featured(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        texts = as_bytes(batch.column(2))
        given = np.array(batch.column(3).flatten().to_numpy(zero_copy_only=False), np.float32).reshape(len(texts), GIVEN)
        views = (_text_view(texts), np.concatenate([given, _layout(texts)], 1))
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(v.astype(np.float32).ravel()), v.shape[1]).cast(pa.list_(pa.float32())) for v in views]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), *lists], ["row", "doc_id", "y", "text", "meta"])


def _meta_view(docs: DataFrame) -> Column:
    """Hashed indicators of language and source, and logarithmic lengths."""
    slot = lambda c, n, k: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0")), F.lit(k)), F.lit(n)) if c in docs.columns else F.lit(0).cast("long")
    length = F.log1p(F.coalesce(F.length(F.col("text").cast("string")), F.lit(0)).cast("double")) / 10
    said = F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0))) / 10 if "n_chars" in docs.columns else length
    marks = F.transform(F.sequence(F.lit(0), F.lit(GIVEN - 4)), lambda i: F.when((i == slot("lang", 8, 1)) | (i - 8 == slot("source", GIVEN - 11, 2)), 1.0).otherwise(0.0))
    return F.concat(F.array(length, said, length * length), marks).cast("array<float>")


class Logistic:
    """Ridge logistic regression by Newton steps on standardised features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.mean, scale = x.mean(0), x.std(0)
        self.scale = np.where(scale > 1e-6, scale, np.inf)
        z = self._z(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[-1] = 1e-6
        for _ in range(12):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * self.w)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], 1)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._z(x) @ self.w, -30, 30)


def _sure(odds: np.ndarray, right: np.ndarray) -> float:
    """The lowest odds from which at least SURE of the labels are right, or infinity."""
    order = np.argsort(-odds, kind="stable")
    n = np.arange(1, len(order) + 1)
    good = np.flatnonzero((np.cumsum(right[order]) >= SURE * n) & (n >= SHOWN))
    return float(odds[order[good[-1]]]) if len(good) else np.inf


class Ridge:
    """Least squares on class marks -1 and 1, from sums of products of features standardised by the labelled rows."""

    def __init__(self, x: np.ndarray):
        self.mean, scale = x.mean(0), x.std(0)
        self.scale = np.where(scale > 1e-6, scale, np.inf)
        self.w = np.zeros(x.shape[1] + 1)

    def z(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.clip((x - self.mean) / self.scale, -8, 8), np.ones((len(x), 1))], 1)

    def sums(self, x: np.ndarray) -> np.ndarray:
        z = self.z(x)
        return z.T @ z

    def fit(self, bad: np.ndarray, good: np.ndarray) -> None:
        penalty = np.diag(np.append(np.full(len(self.w) - 1, RIDGE), 1e-6))
        self.w = np.linalg.solve(bad + good + penalty, good[-1] - bad[-1])

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.z(x) @ self.w


class Views:
    """Both views' models, what each is sure of, their calibrations and the combination."""

    def __init__(self, models: list[Ridge], sure: list[tuple[float, float]]):
        self.models, self.sure = models, sure
        self.fit: list[Logistic] = []
        self.both: Logistic | None = None

    def taught(self, views: list[np.ndarray]) -> list[np.ndarray]:
        """Per view, what it teaches of each document: 1, 0 or -1 for nothing."""
        out = []
        for model, (up, down), x in zip(self.models, self.sure, views, strict=True):
            odds = model.odds(x)
            out.append(np.where(odds >= up, 1, np.where(odds <= down, 0, -1)))
        at_odds = (out[0] >= 0) & (out[1] >= 0) & (out[0] != out[1])
        return [np.where(at_odds, -1, t) for t in out]

    def scores(self, views: list[np.ndarray]) -> list[np.ndarray]:
        odds = [f.odds(m.odds(x)[:, None]) for f, m, x in zip(self.fit, self.models, views, strict=True)]
        return [1 / (1 + np.exp(-o)) for o in (*odds, self.both.odds(np.stack(odds, 1)))]


def _arrays(batch: pa.RecordBatch, *columns: int) -> list[np.ndarray]:
    return [np.array(batch.column(c).flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1) for c in columns]


def _taught_sums(pool: DataFrame, views: Views) -> list[list[np.ndarray]]:
    """Sums of products by view and class over the documents that the other view labels: one pass, cell by cell."""
    widths = [len(m.w) for m in views.models]
    shared = pool.sparkSession.sparkContext.broadcast(views)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        views = shared.value
        total = [[np.zeros((w, w)) for _ in range(2)] for w in widths]
        for batch in batches_:
            if not batch.num_rows:
                continue
            x = _arrays(batch, 0, 1)
            taught = views.taught(x)
            for k in range(2):
                for c in range(2):
                    total[k][c] += views.models[k].sums(x[k][taught[1 - k] == c])
        flat = np.concatenate([t[np.triu_indices(len(t))] for two in total for t in two])
        found = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(flat[found])], ["cell", "v"])

    cells = pool.select("text", "meta").mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    sizes = [w * (w + 1) // 2 for w in widths for _ in range(2)]
    flat = np.zeros(sum(sizes))
    flat[cells.column("cell").to_numpy()] = cells.column("v").to_numpy()
    out = []
    for part, w in zip(np.split(flat, np.cumsum(sizes)[:-1]), [w for w in widths for _ in range(2)], strict=True):
        upper = np.zeros((w, w))
        upper[np.triu_indices(w)] = part
        out.append(upper + upper.T - np.diag(np.diag(upper)))
    return [out[:2], out[2:]]


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: DataFrame, rounds: int = ROUNDS) -> Views:
    """Views trained on labelled rows (arrays of both views, marks y of 0 and 1) and the unlabelled rows of pool (text, meta)."""
    fold = np.arange(len(y)) % 5
    if any(len(set(y[part])) < 2 for part in (fold < 3, fold == 3, fold == 4)):
        train = teach = judge = np.ones(len(y), bool)
    else:
        train, teach, judge = fold < 3, fold == 3, fold == 4
    models = [Ridge(x[train]) for x in labelled]
    own = [[m.sums(x[train & (y == c)]) for c in range(2)] for m, x in zip(models, labelled, strict=True)]
    views = Views(models, [])
    for r in range(rounds + 1):
        taught = _taught_sums(pool, views) if r else None
        for k, m in enumerate(models):
            sums = own[k]
            if taught is not None:
                weight = [PSEUDO * o[-1, -1] / max(t[-1, -1], PSEUDO * o[-1, -1]) for o, t in zip(own[k], taught[k], strict=True)]
                sums = [o + w * t for o, w, t in zip(own[k], weight, taught[k], strict=True)]
            m.fit(*sums)
        shown = [m.odds(x[teach]) for m, x in zip(models, labelled, strict=True)]
        views.sure = [(_sure(o, y[teach] == 1), -_sure(-o, y[teach] == 0)) for o in shown]
    views.fit = [Logistic(m.odds(x[judge])[:, None], y[judge], 0.1) for m, x in zip(models, labelled, strict=True)]
    both = np.stack([f.odds(m.odds(x[judge])[:, None]) for f, m, x in zip(views.fit, models, labelled, strict=True)], 1)
    views.both = Logistic(both, y[judge], 0.1)
    return views


def _sample(rows: DataFrame, limit: int, total: int) -> DataFrame:
    part = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_003)) / 1_000_003.0
    return rows.filter(part < limit / max(total, 1)) if total > limit else rows


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, doc_id, text_score, meta_score, score, rejected: one row per document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("quality").cast("double").alias("y"))
    known = settle(known)
    rows = docs.select(row_key().alias("row"), "doc_id", F.col("text").cast("string").alias("text"), _meta_view(docs).alias("meta"))
    rows = rows.join(if_small(known, F.lit("")), "doc_id", "left").select("row", "doc_id", "text", "meta", "y")
    features = settle(rows.mapInArrow(_featured, f"row binary, doc_id {kind}, y double, text array<float>, meta array<float>"))
    marked = features.filter("y is not null")
    fit = _sample(marked, LABELLED, marked.count()).toArrow().sort_by([("doc_id", "ascending"), ("row", "ascending")])
    y = (fit.column("y").to_numpy() >= 0.5).astype(float)
    models = None
    if len(set(y)) == 2:
        arrays = _arrays(fit.select(["text", "meta"]).combine_chunks().to_batches()[0], 0, 1)
        models = co_train(arrays, y, features.filter("y is null"))
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches_:
            out = [np.full(batch.num_rows, 0.5)] * 3
            if models is not None and batch.num_rows:
                out = models.scores(_arrays(batch, 2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(o, pa.float64()) for o in out)], ["row", "doc_id", "text_score", "meta_score", "score"])

    scored = features.select("row", "doc_id", "text", "meta").mapInArrow(run, f"row binary, doc_id {kind}, text_score double, meta_score double, score double")
    return scored.withColumn("rejected", F.col("score") < REJECT)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, all columns."""
    bad = settle(quality_scores(docs, labels).filter("rejected").select("row").distinct())
    return keyed(docs).join(if_small(bad, F.lit("")), "row", "left_anti").select("doc.*")
