"""Language identification by rank-order profiles.

Profiles are learned from texts with a language: the PROFILE most frequent letter 1- to 3-grams of each (counts are
summed over all training texts by Spark). A text's own n-grams are ranked by frequency and compared with every profile
by the out-of-place distance: the sum of rank differences, PROFILE for an n-gram the profile lacks. Both rankings use
the n-grams of all profiles. The nearest language wins, ties by name; score is one minus the distance over its largest
possible value.

Letters are the characters of Unicode's letter categories, of every plane, lower-cased; each stands for itself, so
scripts and accents never meet in one n-gram. All other characters are one gap.

Null texts and texts without letters give `und`, 0. Without any learned language all texts do. Repeated rows are judged
one by one, extra columns are ignored, empty tables give empty results. Texts are read whole.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PROFILE = 400
#: texts and characters handled at once; a longer text alone
TEXTS, CHARS = 512, 1 << 20
#: alphabets up to this size are counted in tables, larger ones by sorting
DENSE = 128
_NONE = (1 << 21) - 1


@cache
def _letters() -> np.ndarray:
    """The lower-cased letter of each code point, 0 for non-letters."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            table[i] = ord(c.lower()[0])
    return table


def gram_code(gram: str) -> int:
    """The number of an n-gram of letters and gaps (spaces)."""
    points = [0 if c == " " else ord(c) for c in gram]
    points = [_NONE] * (3 - len(points)) + points
    return points[0] << 42 | points[1] << 21 | points[2]


def _runs(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for i, t in enumerate(texts):
        if i > a and (i - a >= TEXTS or size + len(t or "") > CHARS):
            yield a, i
            a = i
            size = 0
        size += len(t or "")
    if a < len(texts):
        yield a, len(texts)


def folded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(letters, text index) of the texts' characters, each text between gaps."""
    parts = [t or "" for t in texts]
    points = np.frombuffer("".join(f"\n{t}\n" for t in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return _letters()[points], np.repeat(np.arange(len(parts)), [len(t) + 2 for t in parts])


def grams(c: np.ndarray, text: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, code) of every n-gram of characters numbered below base: base + base**2 + base**3 codes."""
    c = c.astype(np.int64)
    x, y, z = c[:-2], c[1:-1], c[2:]
    at = text[1:-1]
    one, two, three = y > 0, ((x > 0) | (y > 0)) & (text[:-2] == at), y > 0
    codes = [y[one], base + x[two] * base + y[two], base + base**2 + (x[three] * base + y[three]) * base + z[three]]
    return np.concatenate([at[one], at[two], at[three]]), np.concatenate(codes)


def whole_codes(code: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """gram_code() of the codes that grams() gives over the alphabet `letters` (letters[0] is the gap)."""
    base = len(letters)
    letters = letters.astype(np.int64)
    none = np.int64(_NONE)
    one, two = code < base, (code >= base) & (code < base + base**2)
    rest = code - np.where(one, 0, np.where(two, base, base + base**2))
    a = np.where(one | two, none, letters[np.where(one | two, 0, rest // base**2)])
    b = np.where(one, none, letters[np.where(one, 0, rest // base % base)])
    return a << np.int64(42) | b << np.int64(21) | letters[rest % base]


def _total(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, its count over the texts)."""
    c, text = folded(texts)
    letters = np.unique(np.concatenate([[0], c]))
    base = len(letters)
    number = np.searchsorted(letters, c)
    code = grams(number, text, base)[1]
    if base <= DENSE:
        n = np.bincount(code, minlength=base + base**2 + base**3)
        found = np.flatnonzero(n)
        return whole_codes(found, letters), n[found]
    found, n = np.unique(code, return_counts=True)
    return whole_codes(found, letters), n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) summed over the texts of each language in an Arrow batch."""
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for lang in sorted(set(langs)):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            parts = [_total(own[a:b]) for a, b in _runs(own)]
            gram, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            n = np.bincount(place, np.concatenate([n for _, n in parts]), len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])


def learn(texts: DataFrame) -> dict[str, list[int]]:
    """Per language its PROFILE most frequent n-grams, from rows (lang, text)."""
    counted = texts.filter("lang is not null and text is not null").mapInArrow(_counted, "lang string, gram long, n long")
    total = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top: dict[str, list[int]] = {}
    for r in total.withColumn("rank", rank).filter(F.col("rank") <= PROFILE).orderBy("lang", "rank").collect():  # PROFILE rows a language
        top.setdefault(r["lang"], []).append(r["gram"])
    return top


class Ranks:
    """The out-of-place comparison against some profiles."""

    def __init__(self, profiles: dict[str, list[int]]):
        self.langs = sorted(profiles)
        vocabulary = np.array(sorted({g for p in profiles.values() for g in p}), np.int64)
        self.size = len(vocabulary)
        self.rank = np.full((len(self.langs), self.size), PROFILE, np.int32)
        for i, lang in enumerate(self.langs):
            self.rank[i, np.searchsorted(vocabulary, profiles[lang])] = np.arange(len(profiles[lang]))
        points = np.concatenate([vocabulary >> 42, (vocabulary >> 21) & _NONE, vocabulary & _NONE])
        known = np.unique(points[(points > 0) & (points < _NONE)])
        self.letters = np.concatenate([[0], known, [_NONE - 1]])  # the last stands for every letter that no profile has
        self.number = np.full(sys.maxunicode + 1, len(known) + 1, np.int32)
        self.number[0] = 0
        self.number[known] = np.arange(1, len(known) + 1)
        self.vocabulary, self.index = vocabulary, None
        base = len(self.letters)
        if base <= DENSE:
            self.index = self._find(np.arange(base + base**2 + base**3))

    def _find(self, code: np.ndarray) -> np.ndarray:
        if not self.size:
            return np.full(len(code), -1)
        whole = whole_codes(code, self.letters)
        i = np.minimum(np.searchsorted(self.vocabulary, whole), self.size - 1)
        return np.where(self.vocabulary[i] == whole, i, -1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        langs, scores = [], []
        for a, b in _runs(texts):
            c, text = folded(texts[a:b])
            letters = np.bincount(text, c > 0, b - a)
            text, code = grams(self.number[c], text, len(self.letters))
            known = self._find(code) if self.index is None else self.index[code]
            text, known = text[known >= 0], known[known >= 0]
            n = np.bincount(text * self.size + known, minlength=(b - a) * self.size).reshape(b - a, self.size) if self.size else np.zeros((b - a, 1), int)
            for i in range(b - a):
                if not letters[i] or not self.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                own = np.flatnonzero(n[i])
                own = own[np.argsort(-n[i, own], kind="stable")][:PROFILE]
                away = np.abs(self.rank[:, own] - np.arange(len(own))).sum(axis=1)
                best = int(away.argmin())
                langs.append(self.langs[best])
                scores.append(float(1 - away[best] / (PROFILE * len(own))) if len(own) else 0.0)
        return langs, scores


def identify(docs: DataFrame, profiles: dict[str, list[int]], *keep: str | Column) -> DataFrame:
    """keep columns, then lang_pred and score, of each row of docs."""
    chosen = docs.select(*keep, F.col("text").cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = Ranks(profiles)
        for batch in batches:
            langs, scores = ranks.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    return chosen.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(remainder: int, of: int) -> Column:
    """Whether crc32(doc_id as text) leaves that remainder; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(of)) == remainder


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the documents that are not held out."""
    profiles = learn(docs.filter(~held_out(2, 4)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")))
    return identify(docs, profiles, "doc_id", held_out(2, 4).alias("held_out"))
