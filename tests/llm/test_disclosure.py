"""What terms disclose about entities, against counts by hand."""

import math
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from busloom.llm import private_data as pd
from busloom.llm.tokens import word_hash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _corpus():
    """Texts in which far-off terms go with a mail domain, a network, a repeated card and nothing at all."""
    rng = np.random.default_rng(3)
    common = [f"common{i}" for i in range(300)]
    filler = lambda n: " ".join(rng.choice(common, n))
    texts = [filler(12) for _ in range(1200)]
    for i in range(8):
        texts.append(f"orchid {filler(20)} user{'abcdefgh'[i]}{i}@clinic.example.org {filler(20)} dahlia{i % 2}")
        texts.append(f"{filler(25)} 10.77.{i}.{i + 1} {filler(12)} Tulip")
        texts.append(f"lily {filler(10)} card: 4111 1111 1111 1111, {filler(10)} {'lily' if i < 4 else 'rose'}")
    texts += [f"rose {filler(9)}" for _ in range(3)] + [f"Tulip and orchid {filler(3)}"]
    texts += [texts[1201], texts[1201], None, ""]
    return texts


def _brute(texts):
    """{(what, entity value, term): (both, used, share, gain, out)} of the rules that count whole texts."""
    distinct = list(dict.fromkeys(t or "" for t in texts))
    of_entity, of_term, inside = defaultdict(set), defaultdict(set), defaultdict(set)
    for n, text in enumerate(distinct):
        found = pd.base_spans(text)
        terms = {m[0] for m in WORD.finditer(text.translate(FOLD)) if not any(s <= m.start() < e for s, _, e in found)}
        for m in WORD.finditer(text.translate(FOLD)):
            of_term[m[0]].add(n)
        for s, k, e in found:
            for entity in pd.entities_of(k, text[s:e].lower()):
                of_entity[entity].add(n)
                for t in terms:
                    inside[entity, t].add(n)
    out = {}
    for (entity, term), texts_ in inside.items():
        both, used = len(texts_), len(of_term[term])
        if both < pd.SUPPORT:
            continue
        share = both / used
        gain = math.log2(share * len(distinct) / len(of_entity[entity]))
        if share >= pd.DISCLOSE and gain >= pd.GAIN and both * gain >= pd.EVIDENCE:
            out[pd.GROUPS[entity[0]], entity[1], term] = (both, used, round(share, 9), round(gain, 9), "reveal" if entity[0] == pd.LITERAL and share >= pd.REMOVE else "hint")
    return out


def test_disclosures(spark):
    texts = _corpus()
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, term string").repartition(5)
    want = _brute(texts)
    assert {(w, t) for w, _, t in want} >= {("domain", "orchid"), ("network", "tulip"), ("literal", "lily"), ("literal", "rose"), ("domain", "dahlia0")}
    number = lambda x: np.uint64(__import__("xxhash").xxh64_intdigest(x.encode())).astype(np.int64).item()
    hashed = {(w, number(f"{pd.GROUPS.index(w)}:{v}"), int(word_hash([t]).view(np.int64)[0])): x for (w, v, t), x in want.items()}
    got = {(r.what, r.entity, r.term): (r.both, r.used, round(r.share, 9), round(r.gain, 9), r.outcome) for r in pd.disclosures(docs).filter("not beside").collect()}
    assert got == hashed
    rows = {r.doc_id: r for r in pd.private_data(docs).collect()}
    assert len(rows) == len(texts) and sum(r.n_hint for r in rows.values()) > 10 and sum(r.n_reveal for r in rows.values()) > 10
    best = {}
    for (_, _, term), x in want.items():
        best[term] = "reveal" if "reveal" in (x[4], best.get(term)) else "hint"
    for i, t in enumerate(texts):
        places = {(m.start(), best[m[0]], m.end()) for m in WORD.finditer((t or "").translate(FOLD)) if m[0] in best}
        spans = {(int(s), k, int(e)) for k, s, e in (x.split(":") for x in rows[i].spans.split(",") if x) if k in ("hint", "reveal")}
        assert places <= spans, (i, t)
    clean = {r.doc_id: r.text for r in pd.sanitised(docs).collect()}
    orchid = next(i for i, t in enumerate(texts) if t and t.startswith("orchid"))
    assert clean[orchid].startswith("[HINT] ") and "clinic" not in clean[orchid] and clean[5] == texts[5] and clean[len(texts) - 2] is None
    assert pd.disclosures(docs.limit(0)).count() == 0 and pd.private_data(docs.filter(F.col("doc_id") < 100)).agg(F.sum("n_hint")).first()[0] == 0
