"""The pipeline's stages, one after the other."""

import collections

import corpus_pipeline
from busloom.llm import mixing, private_data, quality
from busloom.llm.store import settle

from .test_llm import ALNUM, BODY, ITEM, _components, words

DATA = "/root/testdata/sf0.001"


def _contaminated(text, windows):
    w, hit = words(text, ALNUM), set()
    for k in {len(x) for x in windows}:
        for p in range(len(w) - k + 1):
            if tuple(w[p : p + k]) in windows:
                hit.update(range(p, p + k))
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages(spark):
    """Each stage on the one before's result, against brute-force decisions."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(settle(stage(spark, seen[-1], DATA)))
        assert seen[-1].columns == [*columns, *(["copy"] if name == "source_mixing" else [])]
    rows = [[(r.doc_id, r.text) for r in df.collect()] for df in seen]
    scores = quality.quality_scores(docs, spark.read.parquet(f"{DATA}/labels.parquet")).collect()
    assert sorted(i for i, _ in rows[1]) == sorted(r.doc_id for r in scores if not r.rejected)
    given = sorted(rows[1])
    sizes, comps = _components([t for _, t in given], 80)
    assert sorted(i for i, _ in rows[2]) == sorted(i for n, (i, _) in enumerate(given) if comps[n] == n or not sizes[n])
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        x = words(r.text, ALNUM)
        windows |= {tuple(x[s : s + 13]) for s in range(max(1, len(x) - 12)) if x}
    assert sorted(i for i, _ in rows[3]) == sorted(i for i, t in rows[2] if not _contaminated(t, windows))
    spans = {r.doc_id: r.spans for r in private_data.private_data(seen[3]).collect()}
    cleaned = dict(rows[4])
    assert set(cleaned) == {i for i, _ in rows[3]}
    for i, text in rows[3]:
        out, at = [], 0
        for start, kind, end in ((int(s), k, int(e)) for k, s, e in (x.split(":") for x in spans[i].split(",") if x)):
            if start >= at:
                out += [text[at:start], "" if kind == "reveal" else f"[{kind.upper()}]"]
            at = max(at, end)
        assert cleaned[i] == "".join([*out, text[at:]])
    taken = {r.doc_id: r.copies for r in mixing.mixture(seen[4]).collect()}
    assert collections.Counter(i for i, _ in rows[5]) == {i: n for i, n in taken.items() if n}


def test_awkward_rows(spark):
    """Nulls, repeats, empty and long texts, extra columns of clashing names: no stage fails or loses a clean row."""
    texts = [None, "", " ", BODY, BODY, f"before {ITEM} after", "long words here " * 3000, "mail ann@mail.example.com", "plain text of its own"]
    rows = [(i if i % 4 else None, t, "en" if i % 2 else None, ("a", None)[i % 2], None) for i, t in enumerate(texts)] * 2
    names = ("row", "doc", "term", "words", "size", "target", "copy", "node", "extra", "y", "mix", "part", "_row")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    wide = docs.selectExpr("*", *(f"'own' AS `{n}`" for n in names))
    out = wide
    for name, stage in corpus_pipeline.STAGES:
        out = settle(stage(spark, out, DATA))
        assert set(out.columns) == set(wide.columns), name
    assert out.filter("`row` != 'own' or size != 'own' or `_row` != 'own'").count() == 0
    kept = collections.Counter(r.text for r in out.filter("copy = 0").collect())
    assert kept[BODY] <= 1 and set(kept) <= {None, "", " ", *texts, "mail [EMAIL]"} and "mail ann@mail.example.com" not in kept
    few = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        few = settle(stage(spark, few, DATA))
    assert few.count() == 0
