"""Spelling variants, SimHash near-duplicates and vector codes against brute-force versions; tables without a named folder."""

import hashlib
import math
import os
import re
import subprocess
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from busloom.llm import entries, simhash, spelling, vector_codes

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, word string, node string, id string, n string, row string"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", "y", "z", "q", "r") for i, t in rows], SCHEMA).repartition(3)


# --- spelling -------------------------------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling_brute(rows):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(FOLD)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 7 and c >= 2}
    near_of = {w: [v for v in n if near(w, v)] for w in n}
    form = {}
    for w, others in near_of.items():
        best = min(others, key=lambda v: (-n[v], v.encode()), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (n[w], len(near_of[w]), form[w], n[form[w]] if form[w] else None, root)
    return out


def spelled_rows(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}


def test_spelling(spark):
    rng = np.random.default_rng(5)
    base = ["language", "éclairage", "aaaaaaaa", "straßenbahn", "Ànnotation"]
    rows = [(None, None), (1, ""), (2, "123 !? ok"), (None, "language Language LANGUAGE " * 40), (3, "a" * 4000 + " " + "a" * 4000), (4, "a" * 4001 + " " + "a" * 4001), (5, "ÿÿÿÿÿÿÿ× ÷ÀÿÀÿÀÿÀ " * 30)]
    for i in range(10, 60):  # chains: every step ten times as frequent, ties of n, insertions, deletions, replacements
        words = []
        for w in base:
            words += [w] * 30
            at = int(rng.integers(0, len(w)))
            words += [w[:at] + w[at + 1 :], w[:at] + "q" + w[at:], w[:at] + "zé"[i % 2] + w[at + 1 :]] * int(rng.integers(1, 3))
        rows.append((i, " ".join(words)))
    rows += [(70, "languagexx " * 2), (71, "languagex " * 25), rows[12], rows[12]]
    got, want = spelled_rows(spelling.variants(frame(spark, rows))), spelling_brute(rows)
    assert got == want and any(v[2] and want[v[2]][2] for v in want.values()), "a chain of two forms"
    assert spelling.variants(frame(spark, [])).count() == 0 and spelling.variants(frame(spark, [(1, "x")])).count() == 0


def test_spelling_collisions(spark, monkeypatch):
    """Equal keys of unlike words change nothing."""
    rows = [(i, "language languages langauge lunguage standard standerd standardd mountain mountains fountain " * 3) for i in range(30)]
    monkeypatch.setattr(spelling, "_BASE", np.uint64(1))  # anagrams collide
    assert spelled_rows(spelling.variants(frame(spark, rows))) == spelling_brute(rows)


def test_deletion_hashes():
    power = spelling._powers(40)
    for word in ("banana", "aabbccdd", "éèêàâ", "x"):
        gone, whole, _ = spelling.deletions(word, power)
        assert whole == spelling.deletions(word, power)[1]
        for i in range(len(word)):
            rest = word[:i] + word[i + 1 :]
            assert gone[i] == (spelling.deletions(rest, power)[1] if rest else 0)


# --- simhash --------------------------------------------------------------------------------------------------------------


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    """Class of each distinct fingerprint by all pairs."""
    distinct, parent = sorted(set(prints)), {}
    for p in distinct:
        parent[p] = p

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= 2:
                parent[find(a)] = find(b)
    return {p: find(p) for p in distinct}


def simhash_brute(rows):
    prints = [fingerprint(t) for _, t in rows]
    group = linked(prints)
    least = {}
    for (doc_id, _), p in zip(rows, prints, strict=True):
        g = group[p]
        if doc_id is not None and (least.get(g) is None or doc_id < least[g]):
            least[g] = doc_id
    return sorted(((i, f"{p:016x}", least.get(group[p])) for (i, _), p in zip(rows, prints, strict=True)), key=repr)


def simhash_rows(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_simhash(spark):
    body = [f"word{i}" for i in range(400)]
    rows = [(None, None), (9, ""), (1, " \t"), (2, "One"), (3, "one"), (4, "one two"), (5, "a " * 70000), (None, "lonely nameless row here"), (6, "ß É   x y z")]
    for i in range(10, 60):
        own = list(body)
        own[(i * 37) % 400] = f"changed{i}"
        rows.append((i, " ".join(own)))
    rows += [rows[20], rows[20], (200, rows[20][1].upper())]
    want = simhash_brute(rows)
    assert simhash_rows(simhash.near_duplicates(frame(spark, rows))) == want
    assert simhash_rows(simhash.near_duplicates(frame(spark, rows), small=1)) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("small", [64, 3])
def test_simhash_links(spark, small):
    """Components of crowded, chained and random fingerprints equal those of all pairs."""
    rng = np.random.default_rng(small)
    prints = set()
    for _ in range(6):
        center = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(150):
            p = center
            for b in rng.integers(0, 64, int(rng.integers(0, 6))):
                p ^= 1 << int(b)
            prints.add(p)
    prints |= {0, 1, 3, 2**64 - 1, 2**63, 2**63 | 2**31, 2**32 - 1}
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    nodes = spark.createDataFrame(signed, "node long").repartition(3)
    got = {r.node % 2**64: r.comp % 2**64 for r in simhash.components(simhash.links(nodes, small)).collect()}
    want = linked(prints)
    classes = lambda of: {frozenset(p for p in prints if of(p) == g) for g in {of(p) for p in prints}}
    assert classes(lambda p: got.get(p, p)) == classes(lambda p: want[p])


# --- vector codes ---------------------------------------------------------------------------------------------------------


def codes_brute(rows):
    kept = [(v, [math.floor(256 * x) for x in e], label) for v, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    width = max(1, -(-max(len(e) for _, e, _ in kept) // 16)) * 16
    size = width // 16
    kept = [(v, e + [0] * (width - len(e)), label) for v, e, label in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:64]
    cut = lambda e, p: e[p * size : (p + 1) * size]
    books = [[cut(e, p) for _, e, _ in order] for p in range(16)]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda part, book: min((apart(part, b), i) for i, b in enumerate(book))
    for _ in range(2):
        for p in range(16):
            own = {}
            for _, e, _ in kept:
                own.setdefault(nearest(cut(e, p), books[p])[1], []).append(cut(e, p))
            for i, parts in own.items():
                books[p][i] = [sum(c) // len(parts) for c in zip(*parts, strict=True)]
    coded = [(v, [nearest(cut(e, p), books[p]) for p in range(16)], label) for v, e, label in kept]
    total = Counter()
    for _, c, label in coded:
        total[label] += sum(d for d, _ in c)
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((v, "".join(f"{i:02x}" for _, i in c), sum(d for d, _ in c), total[label], digest) for v, c, label in coded), key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, pos string, part string, n string, row string, code string"


def code_rows(spark, rows):
    df = spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], VECTORS).repartition(3)
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compressed(df).collect()), key=repr)


@pytest.mark.parametrize("width", [32, 35])
def test_vector_codes(spark, width):
    rng = np.random.default_rng(width)
    some = [np.float32(x).tolist() for x in rng.normal(0, 1, (90, width))]
    rows = [(i, e, None if i % 7 == 0 else i % 3) for i, e in enumerate(some)]
    rows += [(200 + i, some[3], 1) for i in range(200)]  # a hot vector
    rows += [(2, some[2], 2), (2, some[5], 2), (None, some[6], None), (500, None, 1), (501, [None] * width, 1), (502, [float("nan")] * width, 1), (503, [float("inf"), *some[0][1:]], 1), (504, some[0][: width - 3], 2), (505, [], 1), (-5, [-0.001] * width, 9), (506, [40000.0] * width, 4)]
    assert code_rows(spark, rows) == codes_brute(rows)
    assert code_rows(spark, []) == [] and code_rows(spark, [(1, None, 1)]) == []
    assert code_rows(spark, rows[:3]) == codes_brute(rows[:3]), "fewer vectors than entries"


def test_vector_codes_extremes(spark):
    """Components beyond the bound count as the bound, and no distance overflows."""
    bound = vector_codes.limit(16)
    rows = [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.5] * 16, None)]
    got = code_rows(spark, rows)
    assert [r[2] for r in got] == [0, 0, 0] and 16 * (2 * bound) ** 2 < 2**63


# --- queries and tables ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op13_vector_codes"])
def test_against_sql(spark, name):
    got = entries.QUERIES[name](spark, DATA)
    db = duckdb.connect()
    for t in ("documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.execute(entries.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_simhash_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert simhash_rows(entries.QUERIES["op12_simhash_near_dedup"](spark, DATA)) == simhash_brute(rows)


def test_folder_of_its_own(tmp_path):
    """A local session that names no shared folder gets one of its own."""
    code = (
        "from pyspark.sql import SparkSession\n"
        "from busloom.llm import store\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert not s.conf.get('spark.checkpoint.dir', None)\n"
        "df = store.settle(s.range(7))\n"
        "assert store.settle(df).count() == 7 and store.shared_dir(s) == store.shared_dir(s)\n"
        "store.release(s)\n"
    )
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_tied_seeds(spark):
    """Equally frequent tokens are split and not dropped, the same way each time."""
    from busloom.llm import class_lm

    counts = spark.createDataFrame([(i * 7919, 5) for i in range(3000)] + [(-1 - i, 9) for i in range(100)] + [(10**9 + i, 1) for i in range(500)], "token long, n long")
    got = [{r.token for r in class_lm._most_frequent(counts.repartition(k), 1000).collect()} for k in (2, 5)]
    assert got[0] == got[1] and {-1 - i for i in range(100)} <= got[0] and 850 < len(got[0]) < 1150
    assert class_lm._most_frequent(counts, 10**6).count() == 3100 and class_lm._most_frequent(counts.limit(0), 10).count() == 0
    assert 20 < class_lm._most_frequent(counts, 50).count() < 90
