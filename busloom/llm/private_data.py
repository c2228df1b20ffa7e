"""Personal data by patterns, and information-theoretic sanitisation of the terms that reveal it.

Base spans (kinds email, ip, card, phone) come from patterns. Protected entities are every literal value found, what
values have in common (groups: mail domain, name parts of a mailbox, issuer of a card, prefix of a number, network of an
address), and every kind as a whole. Corpus co-occurrence then estimates how strongly a term (a run of letters or digits,
A-Z lower-cased) reveals an entity: disclosure(t, e) = n(e, t) / n(t) over distinct texts, and its gain
log2(disclosure * texts / n(e)). A term is sanitised if its gain is GAIN bits or more and

* beside: at least SUPPORT distinct texts show it within REACH words of the same literal value and its disclosure is
  DISCLOSE or more: at REMOVE or more it is removed (`reveal`), below that generalised (`hint`);
* anywhere: at least SUPPORT distinct texts have both it and the same literal value or group, its disclosure is DISCLOSE or
  more and the gains of all these texts together are EVIDENCE bits or more, which chance does not reach: it is
  generalised (`hint`), or removed (`reveal`) if the entity is a literal value and the disclosure REMOVE or more; or
* of a kind: at least KIND_SUPPORT distinct texts show it within REACH words of values of one kind, its disclosure is
  REMOVE or more and the gains together EVIDENCE bits or more: it is generalised (`hint`).

A term for which both outcomes hold is removed. disclosures() lists who reveals what.

All its places in the corpus become spans. Copies of a text count once, so copying makes no term revealing.

Terms that common usage already rules out are dropped before the corpus is counted: n(t) is at least the number of
texts that have t beside any entity, or anywhere in a text with entities, and to disclose half of its uses a term may be
in at most twice as many texts as the commonest entity. Only entities of SUPPORT texts meet terms, so a text that holds many
values of its own makes no pairs. The rest are counted over all texts, found by a bit table of fixed size and then joined
exactly.

Null texts are empty. Repeated rows are reported one by one; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .postings import if_small, keyed, row_key
from .store import settle
from .tokens import ALNUM, as_bytes, batches

KINDS = ("email", "ip", "card", "phone", "hint", "reveal")
REACH, SUPPORT, DISCLOSE, REMOVE, GAIN = 8, 3, 0.5, 0.9, 3.0
KIND_SUPPORT, EVIDENCE = 5, 24.0
#: what an entity is; kinds follow, one number each
LITERAL, DOMAIN, NAME, ISSUER, PREFIX, NETWORK, OF_KIND = range(7)
GROUPS = ("literal", "domain", "name", "issuer", "prefix", "network", "kind")
#: bits of the table that finds candidate terms
TABLE = 1 << 23

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LETTERS = re.compile("[a-z]{3,}")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) by start, then kind. Times linear in the text's length."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out)


def entities_of(kind: int, value: str) -> list[tuple[int, str]]:
    """(what it is, its value) of the entities that a found value (lower-cased) stands for."""
    out = [(LITERAL, value)]
    if KINDS[kind] == "email":
        local, _, domain = value.partition("@")
        out += [(DOMAIN, domain), *((NAME, p) for p in _LETTERS.findall(local))]
    elif KINDS[kind] == "ip":
        out.append((NETWORK, ".".join(value.split(".")[:2])))
    else:
        digits = _NOT_DIGIT.sub("", value)
        out.append((ISSUER, digits[:6]) if KINDS[kind] == "card" else (PREFIX, digits[:-7]))
    return out


def _points(text: bytes) -> np.ndarray | None:
    """Code point index of each byte; None where they are the same."""
    raw = np.frombuffer(text, np.uint8)
    return None if not len(raw) or raw.max() < 128 else np.cumsum((raw & 0xC0) != 0x80) - 1


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
_NEAR = pa.list_(pa.struct([("entity", pa.int64()), ("term", pa.int64())]))
_HELD = pa.list_(pa.struct([("what", pa.int32()), ("entity", pa.int64())]))


def _scan(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans of each row, the terms beside each entity; and of texts with any, their entities and all other terms."""
    from xxhash import xxh64_intdigest

    number = lambda x: np.uint64(xxh64_intdigest(x.encode())).astype(np.int64).item()

    for batch in batches_:
        texts = [t or "" for t in batch.column(2).to_pylist()]
        spans, near, held, terms = [], [], [], []
        for text in texts:
            found = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            beside = set()
            if found:
                raw = text.encode()
                ((_, words),) = batches([raw], is_word=ALNUM)
                point = _points(raw)
                start = words.start if point is None else point[words.start]
                covered = np.zeros(len(start), bool)
                edges = [(np.searchsorted(start, s), np.searchsorted(start, e)) for s, _, e in found]
                for a, b in edges:
                    covered[a:b] = True
                for (s, k, e), (a, b) in zip(found, edges, strict=True):
                    entity = number(text[s:e].lower())
                    for lo, hi in ((max(0, a - REACH), a), (b, b + REACH)):
                        beside.update((x, t) for t in words.hash[lo:hi][~covered[lo:hi]].view(np.int64).tolist() for x in (entity, k))
            near.append([{"entity": x, "term": t} for x, t in sorted(beside)])
            own = {(what, number(f"{what}:{value}")) for s, k, e in found for what, value in entities_of(k, text[s:e].lower())}
            held.append([{"what": what, "entity": x} for what, x in sorted(own)])
            terms.append(np.unique(words.hash[~covered]).view(np.int64) if found else [])
        columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(spans, _SPANS), pa.array(near, _NEAR), pa.array(held, _HELD), pa.array(terms, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "same", "base", "near", "held", "terms"])


def _slot(term: Column) -> Column:
    return F.pmod(term, F.lit(TABLE))


def _found_terms(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, same, term, start, end) of every place of the given terms: a bit table first, then an exact join."""
    bits = terms.select(_slot(F.col("term")).alias("slot")).groupBy(F.shiftright("slot", 5).alias("cell")).agg(F.bit_or(F.expr("shiftleft(1L, int(slot & 31))")).alias("bits"))
    table = np.zeros(TABLE >> 5, np.int64)
    for r in bits.collect():  # at most TABLE / 32 rows
        table[r["cell"]] = r["bits"]
    shared = docs.sparkSession.sparkContext.broadcast(table.astype(np.uint32))

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches_:
            row, same = batch.column(0), batch.column(2).to_numpy()
            texts = as_bytes(batch.column(1))
            for first, words in batches(texts, is_word=ALNUM):
                term = words.hash.view(np.int64)
                slot = np.mod(term, TABLE)
                hit = np.flatnonzero((table[slot >> 5] >> (slot & 31).astype(np.uint32)) & np.uint32(1))
                if not len(hit):
                    continue
                text = np.searchsorted(words.at, hit, side="right") - 1
                point = np.cumsum((words.bytes & 0xC0) != 0x80) - 1
                sizes = np.fromiter((len(t) + 1 for t in texts[first : first + len(words.at) - 1]), np.int64)
                begin = point[np.cumsum(sizes) - sizes][text]
                start = point[words.start[hit]] - begin
                end = point[words.end[hit]] - begin  # the separator after the word is a code point of its own
                yield pa.RecordBatch.from_arrays([row.take(pa.array(first + text)), pa.array(same[first + text]), pa.array(term[hit]), pa.array(start, pa.int32()), pa.array(end, pa.int32())], ["row", "same", "term", "start", "end"])

    rows = docs.select(row_key().alias("row"), F.col("text").cast("string").alias("text"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("same"))
    places = rows.mapInArrow(run, "row binary, same long, term long, start int, end int")
    return places.join(if_small(terms, F.lit("")), "term")


def _anywhere(scanned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((what, entity, term, both) that may disclose, texts of each (what, entity)), counted over whole distinct texts."""
    whole = settle(scanned.filter(F.size("held") > 0).select("same", "held", "terms").dropDuplicates(["same"]))
    held = whole.select("same", F.inline("held"))
    size = settle(held.groupBy("what", "entity").agg(F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT))
    most = size.agg(F.max("texts")).first()[0] or 0
    terms = whole.select("same", F.explode("terms").alias("term"))
    count = terms.groupBy("term").agg(F.count("*").alias("beside")).filter((F.col("beside") >= SUPPORT) & (F.col("beside") * DISCLOSE <= most))
    terms = settle(terms.join(if_small(settle(count), F.lit("")), "term"))
    own = settle(held.join(if_small(size, F.lit("")), ["what", "entity"]).select("same", "what", "entity", "texts"))
    both = own.join(terms, "same").filter(F.col("texts") >= DISCLOSE * F.col("beside"))
    both = both.groupBy("what", "entity", "term").agg(F.count("*").alias("both"), F.first("beside").alias("beside"))
    return both.filter((F.col("both") >= SUPPORT) & (F.col("both") >= DISCLOSE * F.col("beside"))).select("what", "entity", "term", "both"), size


def _judged(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(scanned rows, places of likely terms, (what, entity, term, both, used, share, gain, out) that disclose)."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = docs.select(row_key().alias("row"), "doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"))
    spans = "array<struct<start:int,kind:int,end:int>>"
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"row binary, doc_id {kind}, same long, base {spans}, near array<struct<entity:long,term:long>>, held array<struct<what:int,entity:long>>, terms array<long>"
    scanned = settle(rows.mapInArrow(_scan, schema))
    near = scanned.select("same", F.inline("near")).distinct()
    of_kind = F.col("entity").between(0, 3)
    together = near.groupBy("entity", "term").agg(F.count("*").alias("both")).filter(F.col("both") >= F.when(of_kind, KIND_SUPPORT).otherwise(SUPPORT))
    beside = near.groupBy("term").agg(F.count_distinct("same").alias("beside"))
    likely = together.join(beside, "term").filter(F.col("both") >= F.when(of_kind, REMOVE).otherwise(DISCLOSE) * F.col("beside"))
    with_entity = near.groupBy("entity").agg(F.count_distinct("same").alias("texts"))
    beside_one = F.when(of_kind, OF_KIND).otherwise(LITERAL).alias("what")
    likely = likely.join(with_entity, "entity").select(F.lit(True).alias("beside"), beside_one, "entity", "term", "both", "texts")
    anywhere, size = _anywhere(scanned)
    likely = settle(likely.unionByName(anywhere.join(if_small(size, F.lit("")), ["what", "entity"]).select(F.lit(False).alias("beside"), "what", "entity", "term", "both", "texts")))
    texts = scanned.select("same").distinct().count()
    places = settle(_found_terms(docs, settle(likely.select("term").distinct())))
    used = places.groupBy("term").agg(F.count_distinct("same").alias("used"))
    share = F.col("both") / F.col("used")
    gain = F.log2(share * texts / F.col("texts"))
    judged = likely.join(used, "term").withColumns({"share": share, "gain": gain}).filter(F.col("gain") >= GAIN)
    evident = F.col("both") * F.col("gain") >= EVIDENCE
    sure = F.when(F.col("what") == OF_KIND, (F.col("share") >= REMOVE) & evident).otherwise((F.col("share") >= DISCLOSE) & (F.col("beside") | evident))
    out = (F.col("what") == LITERAL) & (F.col("share") >= REMOVE)
    return scanned, places, settle(judged.filter(sure).withColumn("out", out).drop("texts"))


def disclosures(docs: DataFrame) -> DataFrame:
    """(what, entity, term, beside, both, used, share, gain, outcome): each term that reveals an entity, both as hashes."""
    _, _, judged = _judged(docs)
    names = F.array(*[F.lit(g) for g in GROUPS])
    return judged.select(F.get(names, "what").alias("what"), "entity", "term", "beside", "both", "used", "share", "gain", F.when(F.col("out"), "reveal").otherwise("hint").alias("outcome"))


def find(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((row, doc_id, base spans) per row, (row, extra spans) for rows with sanitised terms)."""
    scanned, places, judged = _judged(docs)
    worst = judged.groupBy("term").agg(F.max("out").alias("out"))
    number = F.when(F.col("out"), KINDS.index("reveal")).otherwise(KINDS.index("hint"))
    worst = if_small(settle(worst), F.lit(""))
    extra = places.join(worst, "term").select("row", F.struct("start", number.alias("kind"), "end").alias("span"))
    return scanned.select("row", "doc_id", "base"), settle(extra.groupBy("row").agg(F.collect_set("span").alias("extra")))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def private_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_hint, n_reveal."""
    base, extra = find(docs)
    out = base.join(if_small(extra, F.lit("")), "row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("extra", F.array().cast("array<struct<start:int,kind:int,end:int>>"))))
    out = out.withColumn("every", every)

    def counted(k: int) -> Column:
        return F.size(F.filter("every", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    count = [counted(k) for k in range(len(KINDS))]
    return out.select("doc_id", *count[:4], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("every")).alias("spans"), *count[4:])


def _clean(text: str, extra: list[dict]) -> str:
    spans = sorted(base_spans(text) + [(s["start"], s["kind"], s["end"]) for s in extra])
    out, at = [], 0
    for start, kind, end in spans:
        if start < at:  # inside what is replaced already
            if end > at:
                at = end
            continue
        out += [text[at:start], "" if KINDS[kind] == "reveal" else f"[{KINDS[kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with personal data in `text` replaced by its kind and revealing terms generalised or removed."""
    _, extra = find(docs)
    given = keyed(docs).join(if_small(extra, F.lit("")), "row", "left")
    given = given.select("doc", F.col("doc.text").cast("string").alias("text"), "extra")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            texts = [None if t is None else _clean(t, x or []) for t, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc", "text"])

    out = given.mapInArrow(run, T.StructType([given.schema["doc"], T.StructField("text", T.StringType())]))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return out.select(*[new.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
