"""Training-text operators against brute-force versions on small fixtures."""

import base64
import hashlib
import html as htmllib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from busloom.llm import class_lm, decontamination, entries, language_id, licences, media, mixing, near_dedup, private_data, quality, token_counts
from busloom.llm.store import settle
from busloom.llm.tokens import batches, word_hash

DATA = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text, pattern=SPACE):
    return pattern.findall((text or "").translate(FOLD))


BODY = " ".join(f"w{i}" for i in range(60))
ITEM = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
MAIL = " ".join(f"note{i} quuxterm ann.lee@mail.example.com zed{i}" for i in range(1))
TEXTS = [
    None,
    "",
    " \t\n",
    "one",
    "One",
    BODY,
    BODY.upper().replace("W", "w"),
    BODY + " tail",
    BODY.replace("w30", "x30"),
    "x " * 3000 + BODY,
    f"before {ITEM} after",
    "beta gamma delta. epsilon zeta eta theta iota kappa lambda mu nu xi omicron " + "filler " * 400,
    "alpha beta gamma delta",
    "This is released under the MIT License. Apache License! general public license",
    "Licensed under the Apache License, Version 2.0.",
    "mail ann.lee@mail.example.com ip 10.0.0.1 and 10.0.0.999 card 4111 1111 1111 1111 phone +1 (386) 555-3733 x@y",
    "a@b.c_x@d.e.f é ann@é.com 1.2.3.4.5.6.7.8 +12345678 4111-1111-1111-1112",
    "ß Éa ñandú 你好 " * 5,
    "9" * 5000,
    f"first {MAIL} q1",
    f"second {MAIL} q2",
    f"third {MAIL} q3",
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, node string, term string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "de", None)[i % 3], ("b", "a", None)[i % 3], None if t is None else len(t), "r", "n", "t") for i, t in enumerate(TEXTS)]
    rows += [rows[5], (None, BODY, None, None, None, "r", "n", "t")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect() if r.doc_id is not None}


def test_word_hashes():
    texts = [(t or "").encode() for t in TEXTS]
    seen = {}
    for first, w in batches(texts):
        for i in range(len(w.at) - 1):
            expect = words(TEXTS[first + i])
            assert [w.word(k).decode() for k in range(w.at[i], w.at[i + 1])] == expect
            for k, x in zip(range(w.at[i], w.at[i + 1]), expect, strict=True):
                assert seen.setdefault(x, w.hash[k]) == w.hash[k]
    assert len(set(seen.values())) == len(seen) and word_hash(["one"])[0] == seen["one"]


def _components(texts, percent=85):
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [len(s) for s in sets], [find(i) for i in range(len(texts))]


def test_near_duplicates(docs, empty):
    got = by_id(near_dedup.near_duplicates(docs))
    sizes, comps = _components(TEXTS)
    assert [(got[i].n_shingles, got[i].component_id, got[i].kept) for i in range(len(TEXTS))] == [(s, c, c == i) for i, (s, c) in enumerate(zip(sizes, comps, strict=True))]
    assert near_dedup.near_duplicates(docs).count() == len(TEXTS) + 2 and near_dedup.near_duplicates(empty).count() == 0


def test_crowded_region(spark):
    """Many near copies of one text, graded: only the exact step can find all links."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for k in range(150):
        w = list(base)
        for p in rng.choice(150, 1 + k % 5, replace=False):
            w[p] = f"e{k}_{p}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(near_dedup.near_duplicates(df))
    assert [got[i].component_id for i in range(len(texts))] == _components(texts)[1]


def test_thresholds(spark):
    """Pairs of similarity between 0.80 and 0.85 link at 80 and don't at 85, alone and in a crowded region."""
    texts = []
    for k, changed in enumerate((1, 2, 3)):
        base = [f"t{k}_{i}" for i in range(104)]
        other = list(base)
        for p in [10, 40, 80][:changed]:
            other[p] = "changed"
        texts += [" ".join(base), " ".join(other)]
    base = [f"c{i}" for i in range(104)]
    for k in range(40):  # 95 / 105 with the first text; 90 / 110 = 0.818 with each other
        texts.append(" ".join(w if not k or i != 2 * k + 10 else f"e{k}" for i, w in enumerate(base)))
    base = [f"d{i}" for i in range(104)]
    for k in range(40):  # 90 / 110 = 0.818 with the first text alone
        texts.append(" ".join(w if not k or i not in (k + 4, k + 55) else f"f{k}" for i, w in enumerate(base)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent in (80, 85):
        got = by_id(near_dedup.near_duplicates(df, percent))
        assert [got[i].component_id for i in range(len(texts))] == _components(texts, percent)[1]
    assert [near_dedup.first_depth(p) for p in (80, 85)] == [3, 4] and [near_dedup.least_agreement(p) for p in (80, 85)] == [36, 41]
    wide = df.filter("doc_id in (2, 3)")
    assert near_dedup.keep_one(wide).count() == 2 and corpus_pipeline.near_dedup_stage(spark, wide, DATA).count() == 1


def test_repeated_rows(spark):
    """Rows that repeat in a crowded region lose no links; null and repeated ids take no other text with them."""
    rng = np.random.default_rng(5)
    base = [f"b{i}" for i in range(150)]
    texts = [" ".join(base)]
    for k in range(150):
        w = list(base)
        for p in rng.choice(150, 1 + k % 5, replace=False):
            w[p] = f"e{k}_{p}"
        texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)) * 5, "doc_id long, text string")
    rows = near_dedup.near_duplicates(df).collect()
    expect = _components(texts)[1]
    assert len(rows) == 5 * len(texts) and all(r.component_id == expect[r.doc_id] for r in rows)
    assert near_dedup.keep_one(df).count() == len(set(expect))

    def text(name):
        return " ".join(f"{name}{i}" for i in range(40))

    rows = [(None, text("a")), (None, text("a") + " tail"), (None, text("b")), (None, text("b")), (5, text("c")), (5, text("d")), (None, text("c")), (None, None), (None, ""), (7, "")]
    df = spark.createDataFrame([(i, t, str(n)) for n, (i, t) in enumerate(rows)], "doc_id long, text string, extra string")
    kept = near_dedup.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id or 0, (r.text or "")[:1]) for r in kept.collect())
    assert got == [(0, ""), (0, ""), (0, "a"), (0, "b"), (5, "c"), (5, "d"), (7, "")]
    bench = spark.createDataFrame([(1, text("b")), (2, text("c"))], "item_id long, text string")
    clean = decontamination.clean_documents(df, bench)
    assert clean.columns == df.columns and sorted(r.extra for r in clean.collect()) == ["0", "1", "5", "7", "8", "9"]


def test_contamination(spark, docs, empty):
    items = [(1, ITEM), (2, "alpha beta gamma delta"), (3, None), (4, "!!"), (11, ITEM)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontamination.contamination(docs, bench))
    for i, t in enumerate(TEXTS):
        w, hit, found = words(t, ALNUM), set(), set()
        for item, text in items:
            x = words(text, ALNUM)
            k = min(13, len(x))
            for s in range(len(x) - k + 1) if k else ():
                for p in range(len(w) - k + 1):
                    if w[p : p + k] == x[s : s + k]:
                        hit.update(range(p, p + k))
                        found.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(w), len(hit), len(found)), i
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == bool(hit and 20 * len(hit) >= len(w))
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.contamination(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity(spark):
    """Items whose rarest terms stand nearly in place are near, also with words put in, dropped or moved."""
    base = [f"item{i}" for i in range(30)]
    put = [w for i, w in enumerate(base) for w in ([w, "new"] if i % 6 == 5 else [w])]
    dropped = [w for i, w in enumerate(base) if i % 7 != 3]
    texts = [" ".join(base), " ".join(put), " ".join(dropped), " ".join(reversed(base)), " ".join(w for i, w in enumerate(base) for w in (w, *["far"] * 6)), "item1 item2 " * 30, "", "common words only", " ".join(base[:4])]
    items = [(1, " ".join(base)), (2, "item1 item2 item3"), (3, "lacking item5"), (4, "common")]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = by_id(decontamination.contamination(df, spark.createDataFrame(items, "item_id long, text string")))
    count = {}
    for t in texts:
        for w in t.split():
            count[w] = count.get(w, 0) + 1
    seen = 0
    for i, t in enumerate(texts):
        w, near, exact = t.split(), set(), set()
        for item, text in items:
            x = text.split()
            k = min(13, len(x))
            for s in range(len(x) - k + 1):
                exact |= {item for p in range(len(w) - k + 1) if w[p : p + k] == x[s : s + k]}
                picks = sorted((count[x[o]], x[o], o) for o in range(s, s + k) if x[o] in count)[:3]
                starts = [[p - o for p, v in enumerate(w) if v == term] for _, term, o in picks]
                near |= {item for a in starts[0] if all(any(abs(b - a) <= decontamination.SLOP for b in other) for other in starts[1:])} if starts else set()
        assert (got[i].item_ids, got[i].near_ids) == (sorted(map(str, exact)), sorted(map(str, near - exact))), i
        seen += len(near - exact)
    assert seen >= 3


def test_licences(docs, empty):
    got = by_id(licences.licence_scan(docs))
    for i, t in enumerate(TEXTS):
        w = words(t, ALNUM)
        places = [(s, label) for p, label in licences.BASE for s in range(len(w)) if w[s : s + len(p.split())] == p.split()]
        r, starts = got[i], [s for s, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(starts, default=None), max(starts, default=None)), i
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and {x for _, x in places} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "apache-2.0" in got[14].labels and licences.licence_scan(empty).count() == 0


def test_repeated_items(spark):
    """Items that repeat with their id, or without one, hit like a single one, also by their last words alone."""
    long = [f"long{i}" for i in range(60)]
    item = " ".join(long)
    texts = ["only " + " ".join(long[40:58]), "start " + " ".join(long[:15]), " ".join(long), "nothing of it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for id_, copies in ((7, 1), (7, 3), (None, 3)):
        bench = spark.createDataFrame([(id_, item)] * copies, "item_id long, text string")
        got = by_id(decontamination.contamination(df, bench))
        assert [(got[i].n_hit, got[i].n_items, got[i].contaminated) for i in range(4)] == [(n, int(n > 0 and id_ is not None), n > 0) for n in (18, 15, 60, 0)]
        assert [r.doc_id for r in decontamination.clean_documents(df, bench).collect()] == [3]


def follows(own, words):
    """Words after the first that are aligned behind own[0]."""
    at, last, n = 0, 0, 0
    for i in range(1, len(words)):
        due = at + i - last
        places = [due] if due < len(own) and own[due] == words[i] else [j for j in range(at + 1, min(len(own), due + licences.SLOP + 1)) if own[j] == words[i]]
        if places:
            at, last, n = places[0], i, n + 1
    return n


def labels_of(w):
    """(labels, score) of a file's words."""
    labels, score = set(), 0.0
    for p, label in licences.BASE:
        if any(w[s : s + len(p.split())] == p.split() for s in range(len(w))):
            labels, score = labels | {label}, 1.0
    for label, key, whole in licences.WORDINGS:
        first = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        for k in [k for k in range(len(w)) if w[k : k + len(key)] == key]:
            last = len(key) - 1
            aligned = len(key) + follows(w[k + last :], whole[first + last :]) + follows(w[: k + 1][::-1], whole[: first + 1][::-1])
            placed = sum(0 <= k - first + i < len(w) and w[k - first + i] == x for i, x in enumerate(whole))
            cover = max(aligned, placed) / len(whole)
            if cover >= licences.COVER:
                labels, score = labels | {label}, max(score, cover)
    return ",".join(sorted(labels)), score


def test_edited_licences(spark):
    """Words put into, dropped from and replaced in a licence text leave its label; real documents equal brute force."""
    texts, must = [], []
    for label, key, whole in licences.WORDINGS:
        first = next(i for i in range(len(whole)) if whole[i : i + len(key)] == key)
        inside = set(range(first + 1, first + len(key)))
        put = lambda every, words, whole=whole, inside=inside: [x for i, w in enumerate(whole) for x in ([*words, w] if i % every == 1 and i not in inside else [w])]
        edits = [whole[:first] + ["extra"] + whole[first:], whole[: first + len(key)] + ["extra"] + whole[first + len(key) :], put(9, ["one", "two"]), put(12, ["a", "b", "c", "d"])]
        edits += [[w for i, w in enumerate(whole) if i in inside | {first} or i % 7 != 3], whole[: first + len(key)] + whole[first + len(key) + 10 :]]
        texts += [" ".join(e) for e in edits]
        must += [label] * 3 + [label if len(whole) > 40 else None] * 3
    real = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()]
    rows = spark.createDataFrame(list(enumerate(texts + real)), "doc_id long, text string").repartition(4)
    got = by_id(licences.licence_scan(rows))
    for i, t in enumerate(texts + real):
        labels, score = labels_of(words(t, ALNUM))
        assert (got[i].labels, got[i].score) == (labels, pytest.approx(score)), (i, t[:80])
        assert i >= len(texts) or must[i] is None or must[i] in labels.split(","), (i, t[:80])


def test_reworded_licences(spark):
    """Every wording is found wherever its key stands and half of its words are in place, whatever else the corpus holds."""
    texts = ["old software released into the public domain", "software released into the public domain", "licensed under CC BY-NC 3.0", "some CC BY-NC", "4 4 and 4"]
    for _, _, w in licences.WORDINGS:
        text = " ".join(w)
        texts += [text, *(" ".join(x if i % 3 != r else f"new{i}" for i, x in enumerate(w)) for r in range(3)), " ".join(w[len(w) // 3 :]), " ".join(w[: -(len(w) // 3)])]
    expect = [labels_of(t.lower().replace("-", " ").replace(".", " ").split())[0] for t in texts]
    assert expect[1] == "unlicense" and expect[2] == "cc-by-nc"
    for some in (range(len(texts)), range(5)):
        rows = spark.createDataFrame([(i, texts[i]) for i in some], "doc_id long, text string")
        got = by_id(licences.licence_scan(rows))
        assert [got[i].labels for i in some] == [expect[i] for i in some]


def test_mixing(docs, empty):
    rows = mixing.mixture(docs).collect()
    again = mixing.mixture(docs.repartition(5)).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    total, sources = sum(r.size for r in rows), {r.source: r for r in rows}
    assert all(r.size == len(words(BODY if r.doc_id is None else TEXTS[r.doc_id])) and r.taken in (0, r.size, 2 * r.size) for r in rows)
    names = ("size", "source_size", "target", "rate", "copies", "taken", "copy", "of", "part", "rank", "doc", "mix", "row", "extra", "words", "copies")
    clash = docs.withColumns({n: F.lit(n) for n in names})
    mix = mixing.mixed_documents(clash)
    assert sorted(mix.columns) == sorted(set(clash.columns)) and mix.filter("size != 'size' or target != 'target'").count() == 0
    assert mix.count() == sum(r.copies for r in rows) == mix.filter("copy in (0, 1)").count()
    order = sorted((s for s in sources if s is not None)) + [None]
    cap = {s: 2.0 * sources[s].source_size for s in order}
    weight = {s: float((5, 2, 1)[i % 3]) for i, s in enumerate(order)}
    want, left, open_ = {}, 1.5 * total, set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if cap[s] < weight[s] * level}
        if not over:
            break
        for s in over:
            want[s] = cap[s]
            left -= cap[s]
        open_ -= over
    want |= {s: weight[s] * level for s in open_}
    assert {s: sources[s].target for s in order} == pytest.approx(want)
    assert mixing.mixed_documents(docs).count() == sum(r.copies for r in rows) and mixing.mixture(empty).count() == 0


def test_language(spark, docs, empty):
    got = by_id(language_id.language_id(docs))
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2, 18))
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= got[i].score <= 1 for i in range(len(TEXTS)))
    assert language_id.language_id(empty).count() == 0
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    out = language_id.language_id(real).join(real.select("doc_id", "lang"), "doc_id").filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert out > 0.95


def test_language_letters():
    """Letters of every plane count, other characters of any plane don't; n-grams equal a plain count of them."""
    texts = ["\U0001d11e \U0001d7ce", "\U0001d7ce12", "\U000e0041", "ab \u00c9\u00e9 \u03b1\u4f60", "\U00010400x", "aab", None]
    code, n = language_id._total(texts)
    expect = {}
    for t in texts:
        c = [" "] + [x.lower() if x.isalpha() else " " for x in t or ""] + [" "]
        c = c + [" "]
        for i in range(1, len(c) - 1):
            if c[i] != " ":
                expect[c[i]] = expect.get(c[i], 0) + 1
                expect["".join(c[i - 1 : i + 2])] = expect.get("".join(c[i - 1 : i + 2]), 0) + 1
            if c[i - 1] != " " or c[i] != " ":
                expect[c[i - 1] + c[i]] = expect.get(c[i - 1] + c[i], 0) + 1
    assert dict(zip(code.tolist(), n.tolist(), strict=True)) == {language_id.gram_code(g): k for g, k in expect.items()}
    ranks = language_id.Ranks({"x": [language_id.gram_code("a"), language_id.gram_code("ab")], "y": [language_id.gram_code("\u03b1")]})
    langs, scores = ranks.predict(texts)
    assert langs == ["und"] * 3 + ["x", "x", "x", "und"] and scores[:3] == [0, 0, 0] and scores[4] == 0
    assert language_id.Ranks({}).predict(["a"]) == (["und"], [0.0])


def test_class_model(spark, empty):
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    real = real.unionByName(spark.createDataFrame([(10**9, None), (10**9 + 1, "")], "doc_id long, text string"), allowMissingColumns=True)
    rows = class_lm.class_scores(real).collect()
    texts = {r.doc_id: words(r.text) + [None] for r in real.collect()}
    counts = {}
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            for w in t:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in texts[r.doc_id])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.n_tokens == len(texts[r.doc_id]) and r.train_tokens == n
        assert r.n_known == sum(w in counts for w in texts[r.doc_id])
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert class_lm.class_scores(empty).count() == 0
    once = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")  # nothing is seen twice
    assert [(r.n_tokens, r.n_known) for r in class_lm.class_scores(once).collect()] == [(4, 4)]


def _likelihood(left, right, n, cls):
    total = {}
    for a, b, k in zip(cls[left], cls[right], n, strict=True):
        total[a, b] = total.get((a, b), 0) + k
    f = lambda x: x * math.log(x) if x else 0.0
    return sum(map(f, total.values())) - 2 * sum(map(f, np.bincount(cls[left], n)))


def test_exchange(monkeypatch):
    """Two alternating groups of words become two classes, and no single move then raises the likelihood."""
    rng = np.random.default_rng(3)
    group = np.arange(12) % 3 == 0
    pairs = [(a, b, int(rng.integers(5, 50))) for a in range(12) for b in range(12) if group[a] != group[b]]
    left, right, n = (np.array(x) for x in zip(*pairs, strict=True))
    cls = class_lm.exchange(left, right, n.astype(float), 12, np.full(12, -1), 2)
    assert len(set(cls[group])) == 1 and len(set(cls[~group])) == 1 and set(cls) == {0, 1}
    rows = [(a, b, int(rng.integers(1, 9))) for a in range(15) for b in range(15) if rng.random() < 0.4]
    left, right, n = (np.array(x) for x in zip(*rows, strict=True))
    n = np.concatenate([n, n]).astype(float)
    left, right = np.concatenate([left, right]), np.concatenate([right, left])  # as many on either side
    monkeypatch.setattr(class_lm, "ROUNDS", 50)
    cls = class_lm.exchange(left, right, n, 15, np.full(15, -1), 2)
    best = _likelihood(left, right, n, cls)
    for w in range(15):
        other = cls.copy()
        other[w] = 1 - cls[w]
        assert _likelihood(left, right, n, other) <= best + 1e-6


def test_assigned():
    """A token goes to the class whose neighbours it shares; of equals, and without neighbours, to the first."""
    classes, unit_cls = 9, np.array([3, 4, 7, 8, 3])
    tables = np.ones((2 * classes, classes))
    tables[3, 5] = tables[classes + 7, 5] = tables[4, 6] = tables[classes + 8, 6] = 1000
    row, slot, n = np.array([0, 0, 1, 1, 2, 2]), np.array([0, 5 + 2, 1, 5 + 3, 1, 4]), np.array([2, 2, 1, 5, 9, 1])
    profile = class_lm.by_class(slot, n, row, 4, unit_cls, classes)
    expect = np.zeros((4, 2 * classes))
    for r, s, k in zip(row, slot, n, strict=True):
        expect[r, unit_cls[s % 5] + classes * (s // 5)] += k
    assert (profile == expect).all()
    assert class_lm.best_class(profile, class_lm.first_order(tables)).tolist() == [5, 6, 6, 0]
    assert class_lm.best_class(profile[:0], class_lm.first_order(tables)).tolist() == []


def test_sizes():
    """Classes and seeds follow the vocabulary."""
    assert class_lm.sizes(0) == (2, 2) and class_lm.sizes(10**6) == (200, 3036) and class_lm.sizes(10**9) == (2000, 17071)


def test_exchange_rounds(spark, monkeypatch):
    """Each round's tables equal plain counts over the corpus, and further rounds raise the likelihood of the classes."""
    real = spark.read.parquet(f"{DATA}/documents.parquet").limit(300)
    train = settle(real.select("text"))
    counts = settle(train.mapInArrow(class_lm._counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    often = counts.filter("n > 1").count()
    seen, summed = [], class_lm._summed

    def watch(packed, log, unit_cls):
        seen.append((log, unit_cls, summed(packed, log, unit_cls)))
        return seen[-1][-1]

    monkeypatch.setattr(class_lm, "_summed", watch)
    found = {r.token: r.cls for r in class_lm.classes_of(train, counts, often).collect()}
    classes, limit = class_lm.sizes(often)
    assert set(found.values()) <= set(range(classes + 1)) and len(found) == counts.count()
    assert 2 <= len(seen) <= class_lm.PASSES
    top = class_lm._most_frequent(counts, limit).toPandas().sort_values(["n", "token"], ascending=[False, True]).token.tolist()
    unit = {t: i for i, t in enumerate(top)}
    beside: dict = {}
    for r in train.collect():
        t = word_hash(words(r.text)).view(np.int64).tolist() + [class_lm.END]
        for a, b in zip([class_lm.END, *t], t, strict=False):
            if a in unit:
                beside.setdefault(b, []).append(unit[a])
        for a, b in zip(t, t[1:], strict=False):
            if b in unit:
                beside.setdefault(a, []).append(len(top) + unit[b])
    once = {r.token for r in counts.filter("n < 2").collect()}
    for log, cls, tables in seen:
        expect = np.zeros((2 * classes, classes))
        for t, slots in beside.items():
            if t not in once:
                own = np.bincount([cls[s % len(top)] + classes * (s // len(top)) for s in slots], minlength=2 * classes)
                expect[:, cls[unit[t]] if t in unit else np.round(own @ log, 6).argmax()] += own
        assert (tables == expect).all()
    assert all(found[t] == cls[u] for t, u in unit.items())
    rise = [class_lm.likelihood(tables) for *_, tables in seen]
    assert max(rise[1:]) > rise[0]


def test_class_score(spark, monkeypatch):
    """`score` equals a plain recomputation from the classes, whose probabilities sum to one after every class."""
    monkeypatch.setattr(class_lm, "HEAD", 100)
    real = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    real = settle(real.unionByName(spark.createDataFrame([(10**9, None)], "doc_id long, text string"), allowMissingColumns=True))
    texts = {r.doc_id: [*words(r.text), None] for r in real.collect()}
    train = real.filter(~language_id.held_out(0, 10)).select(F.col("text"))
    counts = settle(train.mapInArrow(class_lm._counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    often = counts.filter("n > 1").count()
    last, _ = class_lm.sizes(often)
    found = {r.token: (r.n, r.cls) for r in class_lm.classes_of(train, counts, often).collect()}
    assert {c for n, c in found.values() if n < 2} == {last} and len({c for n, c in found.values() if n > 1}) > last * 0.6
    hashes = {w: int(h) for t in texts.values() for w, h in zip(t[:-1], word_hash(t[:-1]).view(np.int64), strict=True)} | {None: class_lm.END}
    cls = lambda w: found.get(hashes[w], (0, last))
    k = last + 1
    big = np.zeros((k, k))
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            for a, b in zip([None, *t], t, strict=False):
                big[cls(a)[1], cls(b)[1]] += 1
    prior = (big.sum(0) + 0.1) / (big.sum() + 0.1 * k)
    step = (big + prior) / (big.sum(1, keepdims=True) + 1)
    size = np.bincount([c for _, c in found.values()], [n for n, _ in found.values()], k)
    rare = size[-1] + 0.1 * (sum(c == last for _, c in found.values()) + 1)
    emit = lambda n, c: n / size[c] if c < last else (n + 0.1) / rare
    every = np.bincount([c for _, c in found.values()], [emit(n, c) for n, c in found.values()], k)
    every[-1] += emit(0, last)
    assert step.sum(1) == pytest.approx(1) and all(every[c] == pytest.approx(1) for c in range(k) if size[c])
    for r in class_lm.class_scores(real).collect():
        t = texts[r.doc_id]
        assert r.score == pytest.approx(sum(math.log10(step[cls(a)[1], cls(b)[1]] * emit(*cls(b))) for a, b in zip([None, *t], t, strict=False)), rel=1e-9)


def test_media(spark, docs, empty):
    got = by_id(media.document_media(docs))
    for i, t in enumerate(TEXTS):
        data = (t or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        stored = media.to_png(payload)
        assert media.from_png(stored) == payload
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256, r.feature, r.caption) == (len(stored), hashlib.sha256(stored).hexdigest(), media.feature(payload), f"{len(data)} bytes")
        first, *rest = (" ".join(line.split()) for line in (t or "").split("\n"))
        rest = " ".join(" ".join(rest).split())
        assert (r.pos, r.n_parts, r.n_text) == (int(first != ""), 1 + (first != "") + (rest != ""), len(first) + len(rest))
    assert media.document_media(docs).count() == len(TEXTS) + 2 and media.document_media(empty).count() == 0
    with pytest.raises(ValueError):
        media.from_png(stored[:40] + b"\0" + stored[41:])


def test_interleaving(spark):
    html = '<p>One <b>two</b></p><script>no</script><figure><img src="sha256:aa"><figcaption>Cap &amp; tion</figcaption></figure>three<img src="x.png" alt="alt"><p>four'
    parts = media.interleave(html)
    assert [(p["pos"], p["kind"], p["text"], p["digest"], p["caption"]) for p in parts] == [(0, "text", "One two", None, None), (1, "media", "sha256:aa", "aa", "Cap & tion"), (2, "text", "three", None, None), (3, "media", "x.png", None, "alt"), (4, "text", "four", None, None)]
    assert media.interleave(None) == [] and media.interleave("") == []
    raw = base64.b64encode(b"pay load").decode()
    html = f'<figure><img src="a.png"><figure><img src="data:image/x;base64,{raw}"><figcaption>inner</figcaption></figure><figcaption>outer</figcaption></figure><picture><source srcset="b.webp 2x"><img srcset="c.png 1x, d.png 2x" alt="pic"></picture><img src="data:;base64,@@"><video src="/v"></video>'
    parts = media.interleave(html, "https://x.example.com/q/r")
    digest = hashlib.sha256(b"pay load").hexdigest()
    assert [(p["text"], p["digest"], p["caption"]) for p in parts] == [("https://x.example.com/q/a.png", None, "outer"), ("data:image/x;base64", digest, "inner"), ("https://x.example.com/q/c.png", None, "pic"), ("data:;base64,@@", None, None), ("https://x.example.com/v", None, None)]
    inline = media.inline_payloads(spark.createDataFrame([(html,), (html,), (None,)], "html string")).collect()
    assert [(r.digest, media.from_png(bytes(r.media))) for r in inline] == [(digest, media.pad(b"pay load"))]
    html = '<p>One <b>two</b></p><script>no</script><figure><img src="sha256:aa"><figcaption>Cap &amp; tion</figcaption></figure>three<img src="x.png" alt="alt"><p>four'
    # the real pages hold no media: their whole visible text, in order
    real = spark.read.parquet(f"{DATA}/pages.parquet").select("html", F.inline(media.sequence_of("html", "url"))).collect()
    assert len(real) == len({r.html for r in real})
    for r in real:
        seen = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>|<(script|style)\b.*?</\1>", "", r.html)
        tag = re.compile(r"</?([a-zA-Z0-9]+)[^>]*>")
        seen = htmllib.unescape(tag.sub(lambda m: " " if m[1].lower() in media.BREAKS else "", seen))
        assert (r.pos, r.kind, r.text) == (0, "text", " ".join(seen.split()))
    pages = spark.createDataFrame([(1, html)], "id long, html string").select("id", media.sequence_of("html", F.lit(None).cast("string")).alias("parts"))
    store = spark.createDataFrame([("aa", bytearray(b"xy")), ("aa", bytearray(b"xy"))], "digest string, media binary")
    out = media.resolved(pages, store).orderBy("pos").collect()
    assert [(r.pos, r.media) for r in out] == [(0, None), (1, bytearray(b"xy")), (2, None), (3, None), (4, None)]


PATTERNS = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def _base(text):
    out = []
    for k, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    more = ["a@b.c@d.e", "@b.c", "..@x.y", "1.2.3.4.5", "001.2.3.004", "+1(((((2", "+123456789", "4 1 1 1", "x" * 5000 + "@" + "y." * 100, "1." * 3000]
    for t in [*TEXTS, *more]:
        assert private_data.base_spans(t or "") == _base(t or ""), (t or "")[:60]


def test_private_data(spark, docs, empty):
    others = spark.range(100, 140).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain text "), F.col("id").cast("string")).alias("text"))
    docs = docs.unionByName(others, allowMissingColumns=True)
    got = by_id(private_data.private_data(docs))
    for i, t in enumerate(TEXTS):
        spans = _base(t or "")
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{PATTERNS[k][0]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(k == n for _, k, _ in spans) for n in range(4)]
    # three distinct texts show the term beside the same address and nowhere else
    place = TEXTS[19].index("quuxterm")
    assert f"reveal:{place}:{place + 8}" in got[19].spans.split(",") and got[19].n_reveal == 3 and got[5].n_reveal == 0
    clean = by_id(private_data.sanitised(docs))
    assert "ann.lee" not in clean[19].text and "quuxterm" not in clean[19].text and clean[5].text == BODY and clean[0].text is None
    assert clean[19].n_chars == len(clean[19].text) and clean[15].text.startswith("mail [EMAIL] ip [IP] and ")
    assert private_data.sanitised(docs).columns == docs.columns and private_data.private_data(empty).count() == 0


def test_quality(spark, docs, empty):
    real, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = quality.quality_scores(real, labels).join(labels, "doc_id")
    assert out.agg(F.avg((F.col("rejected") == (F.col("quality") == 0)).cast("int"))).first()[0] > 0.95
    assert quality.quality_scores(docs, labels.limit(0)).filter("rejected or score != 0.5").count() == 0
    assert quality.accepted(docs, labels.limit(0)).count() == docs.count() and quality.quality_scores(empty, labels).count() == 0


def _auc(score, good):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = good.sum()
    return (rank[good].sum() - n * (n + 1) / 2) / (n * (len(good) - n))


def test_quality_held_out(spark):
    """Labels that the classifier has not seen: both views carry signal of their own, and together they tell junk apart."""
    data = DATA.replace("0.001", "0.01")
    real, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    seen = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    rows = quality.quality_scores(real, labels.filter(seen)).join(labels.filter(~seen), "doc_id").collect()
    good = np.array([r.quality == 1 for r in rows])
    area = {v: _auc(np.array([r[v] for r in rows]), good) for v in ("text_score", "meta_score", "score")}
    assert area["text_score"] > 0.95 and area["meta_score"] > 0.75 and area["score"] > 0.97, area
    assert np.mean([r.rejected != (r.quality == 1) for r in rows]) > 0.93


def test_co_training(spark):
    """Two views that hold half of the signal each: from few labels they teach each other, on all unlabelled rows."""
    rng = np.random.default_rng(11)
    n = 6000
    y = (rng.random(n) < 0.5).astype(float)
    views = [np.concatenate([(2 * y - 1)[:, None] * 1.4 + rng.normal(size=(n, 1)), rng.normal(size=(n, 30))], 1) for _ in range(2)]
    few = slice(0, 250)
    pool = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(views[0][250:5000], views[1][250:5000], strict=True)], "text array<float>, meta array<float>")
    alone = quality.co_train([v[few] for v in views], y[few], pool, 0)
    taught = quality.co_train([v[few] for v in views], y[few], pool)
    sums = quality._taught_sums(pool, taught)
    lessons = taught.taught([v[250:5000] for v in views])
    assert [sums[k][c][-1, -1] for k in range(2) for c in range(2)] == [(lessons[1 - k] == c).sum() for k in range(2) for c in range(2)]
    assert all(s[c][-1, -1] > 50 for s in sums for c in range(2))
    right = [[np.mean((s > 0.5) == (y[5000:] == 1)) for s in v.scores([x[5000:] for x in views])] for v in (alone, taught)]
    assert right[1][0] + right[1][1] > right[0][0] + right[0][1] and right[1][2] > max(right[1][:2]) and right[1][2] >= right[0][2] - 0.005, right


def test_token_counts(docs, empty):
    counter = token_counts.Counter(token_counts.rank_file(token_counts.RANKS))
    rows = docs.filter("doc_id is not null").select("doc_id", "text", token_counts.planned_edits().alias("edits")).collect()
    got = by_id(token_counts.edited_counts(docs, token_counts.planned_edits()))
    for r in rows:
        text = r.text or ""
        before = len(counter.encode(text))
        for e in r.edits:
            text = text[: e.start] + e.text + text[max(e.start, e.end) :]
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_tokens_edited) == (before, len(counter.encode(text)))
    assert token_counts.edited_counts(empty, token_counts.planned_edits()).count() == 0


def test_tree_edits():
    counter, rng = token_counts.Counter(token_counts.rank_file(token_counts.RANKS)), np.random.default_rng(1)
    text = "It's  a tést, 12 and   more\n\n words " * 300
    tree = token_counts.Tree.of(counter, text)
    depth = len(tree.leaves).bit_length()
    for k in range(400):
        a = int(rng.integers(0, len(text) + 3))
        b = a + int(rng.integers(0, 9))
        put = ("", " ", "x", "  ", "'s", "\n", " 7", "word ", "é!")[int(rng.integers(0, 9))]
        text = text[: min(a, len(text))] + put + text[max(min(a, len(text)), min(b, len(text))) :]
        encoded, touched = tree.encoded, tree.touched
        tree.edit(a, b, put)
        assert tree.encoded - encoded <= 16 and tree.touched - touched <= 2 * (depth + 1)
        if k % 20 == 0:
            pieces = counter.split.findall(text)
            assert tree.text == text and tree.tokens[1] == sum(map(counter.count, pieces)) and tree.chars[1] == len(text)
            assert [n for leaf in tree.leaves for n in leaf[0]] == [len(p) for p in pieces]
    assert tree.laid_out <= 2
    for a, b, put in ((0, 10**9, ""), (0, 0, "new words " * 500), (7, 4000, "x"), (3, 3, "y" * 700), (0, 1, "")):
        text = text[:a] + put + text[max(a, min(b, len(text))) :]
        tree.edit(a, b, put)
        pieces = counter.split.findall(text)
        assert tree.text == text and tree.tokens[1] == sum(map(counter.count, pieces)) and [n for leaf in tree.leaves for n in leaf[0]] == [len(p) for p in pieces]
        assert all(len(n) <= 2 * token_counts.BLOCK for n, _ in tree.leaves)


def test_stored_trees(spark):
    """Edits of real documents re-encode and update a few nodes of the stored trees, however long the text."""
    real = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = token_counts.edited_counts(real, token_counts.planned_edits()).collect()
    long = [r for r in rows if r.n_pieces > 2000]
    assert len(rows) == real.count() and long and all(r.n_reencoded <= 60 and r.n_touched <= 3 * 2 * 12 for r in long)


def test_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in entries.QUERIES) == list(range(1, 14))
