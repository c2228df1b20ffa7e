"""Media columns: interleaved document sequences with media kept by digest.

HTML becomes an ordered sequence of structs (pos, kind, text, digest, caption): text between media, and one entry per
media reference at its place, with its caption (of the innermost figure around it, else its `alt`). A reference by
`sha256:` carries its digest, a `data:` URI the digest of its decoded bytes; others are resolved against the page's URL
and carry none. Of `srcset` the first candidate counts where `src` is missing; `source` elements of a picture stand for
its img. Payloads live in a media table keyed by the SHA-256 of their bytes, stored losslessly as 8-bit grey PNG images
(WIDTH samples a row); references resolve by a join on the digest.

Texts as payloads are UTF-8 followed by bytes 0 up to a positive multiple of WIDTH. Null texts are empty, so one row of
zeros. Equal payloads have equal stored forms. References to unknown digests stay with null media. Null or empty HTML
gives an empty sequence. Repeated rows are kept one by one, extra columns are ignored, empty tables give empty results.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import unquote_to_bytes, urljoin

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import settle

WIDTH = 64
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: digests that a task remembers as stored
REMEMBER = 1 << 18
#: tags that end a word
BREAKS = ("p", "br", "div", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "td", "th", "table", "article", "section", "nav", "header", "footer", "main", "aside", "blockquote", "pre", "title", "head", "body", "html")
MEDIA_TAGS = ("img", "audio", "video", "source", "embed")
_SEQUENCE = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), *(T.StructField(n, T.StringType()) for n in ("kind", "text", "digest", "caption"))]))


def pad(data: bytes) -> bytes:
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


def to_png(payload: bytes) -> bytes:
    """An 8-bit grey image of WIDTH columns whose samples are the payload."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + chunk(b"IEND", b"")


def from_png(stored: bytes) -> bytes:
    """The samples of an image that to_png made; checks chunk sums and sizes."""
    if stored[:8] != _SIGNATURE:
        raise ValueError("not a PNG image")
    at, parts, shape = 8, [], None
    while at < len(stored):
        (size,), kind = struct.unpack_from(">I", stored, at), stored[at + 4 : at + 8]
        data = stored[at + 8 : at + 8 + size]
        if struct.unpack_from(">I", stored, at + 8 + size)[0] != zlib.crc32(kind + data):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            parts.append(data)
        at += 12 + size
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not 8-bit grey")
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("a filter that to_png does not use")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples and a 16-cell average hash, as text."""
    x = np.frombuffer(payload, np.uint8)
    p = np.bincount(x, minlength=256) / len(x)
    p = p[p > 0]
    cells = np.array([c.mean() if len(c) else 0.0 for c in np.array_split(x, 16)])
    bits = "".join("1" if c > x.mean() else "0" for c in cells)
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};hash={int(bits, 2):04x}"


def data_uri(src: str) -> bytes | None:
    """The bytes of a data: URI, None if it is damaged or something else."""
    head, comma, body = src.partition(",")
    if not comma or not head.lower().startswith("data:"):
        return None
    if not head.lower().endswith(";base64"):
        return unquote_to_bytes(body)
    try:
        return base64.b64decode("".join(body.split()), validate=True)
    except (binascii.Error, ValueError):
        return None


class _Interleave(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.out: list[dict] = []
        self.payloads: list[tuple[str, bytes]] = []
        self.text: list[str] = []
        self.hidden = self.pictures = 0
        self.caption: list[str] | None = None
        self.figures: list[list[int]] = []

    def _flush(self) -> None:
        text = " ".join("".join(self.text).split())
        self.text = []
        if text:
            self.out.append({"pos": len(self.out), "kind": "text", "text": text, "digest": None, "caption": None})

    def _media(self, src: str, alt: str | None) -> None:
        self._flush()
        digest = src[7:] if src.startswith("sha256:") else None
        payload = data_uri(src)
        if payload is not None:
            digest, src = hashlib.sha256(payload).hexdigest(), src[: src.index(",")]
            self.payloads.append((digest, payload))
        elif digest is None:
            src = urljoin(self.base, src)
        self.out.append({"pos": len(self.out), "kind": "media", "text": src, "digest": digest, "caption": alt})
        if self.figures:
            self.figures[-1].append(len(self.out) - 1)

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        if tag in ("script", "style"):
            self.hidden += 1
        elif tag in MEDIA_TAGS:
            src = given.get("src") or ((given.get("srcset") or "").replace(",", " ").split() or [None])[0]
            if src and not (tag == "source" and self.pictures):
                self._media(src, given.get("alt"))
        elif tag == "picture":
            self.pictures += 1
        elif tag == "figure":
            self.figures.append([])
        elif tag == "figcaption":
            self._flush()
            self.caption = []
        elif tag in BREAKS:
            self.text.append(" ")

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.hidden = max(0, self.hidden - 1)
        elif tag == "picture":
            self.pictures = max(0, self.pictures - 1)
        elif tag == "figure" and self.figures:
            self.figures.pop()
        elif tag == "figcaption" and self.caption is not None:
            caption = " ".join("".join(self.caption).split())
            for i in self.figures[-1] if self.figures else ():
                self.out[i]["caption"] = caption
            self.caption = None
        elif tag in BREAKS:
            self.text.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            (self.text if self.caption is None else self.caption).append(data)


def _parsed(html: str | None, base: str | None = None) -> _Interleave:
    parser = _Interleave(base or "")
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser


def interleave(html: str | None, base: str | None = None) -> list[dict]:
    return _parsed(html, base).out


@F.pandas_udf(_SEQUENCE)
def sequence_of(html, base):
    """Column of HTML, and its URL, to its interleaved sequence."""
    return html.combine(base, interleave)


def inline_payloads(pages: DataFrame) -> DataFrame:
    """(digest, media) of every payload that pages (html) hold as data: URIs, each digest once, in its stored form."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {d: to_png(pad(p)) for h in batch.column(0).to_pylist() for d, p in _parsed(h).payloads}
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.binary())], ["digest", "media"])

    return pages.select("html").mapInArrow(run, "digest string, media binary").dropDuplicates(["digest"])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads and their stored forms; a task stores a payload once while it remembers the digest."""
    seen: set[bytes] = set()
    for batch in batches:
        digests, media = [], []
        for t in batch.column(0).cast(pa.binary()).to_pylist():
            payload = pad(t or b"")
            digest = hashlib.sha256(payload)
            if digest.digest() in seen:
                continue
            if len(seen) >= REMEMBER:
                seen.clear()
            seen.add(digest.digest())
            digests.append(digest.hexdigest())
            media.append(to_png(payload))
        yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(media, pa.binary())], ["digest", "media"])


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["digest", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    for batch in batches:
        rows = []
        for digest, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            payload = from_png(media)
            rows.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(payload)))
        yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*rows, strict=True)] if rows else [pa.array([], t) for t in (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())], names)


def store_texts(docs: DataFrame) -> DataFrame:
    """(digest, media): the texts' payloads in their stored form, written to the shared folder. A payload that several
    tasks meet is stored by each of them, in the same bytes."""
    return settle(docs.select(F.col("text").cast("string")).mapInArrow(_stored, "digest string, media binary"))


def describe(store: DataFrame) -> DataFrame:
    """One row per digest, from the bytes read back: sizes, sums and features."""
    read = store.select("digest", "media").mapInArrow(_described, "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
    return read.dropDuplicates(["digest"])


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def page_of(text: Column) -> Column:
    """The page of a text: its first line, a figure that refers to the text's payload, and the other lines."""
    data = F.encode(text, "utf-8")
    size = F.octet_length(data)
    short = F.greatest(F.pmod(-size, F.lit(WIDTH)), F.when(size == 0, WIDTH).otherwise(0))
    digest = F.sha2(F.concat(data, F.unhex(F.repeat(F.lit("00"), short))), 256)
    figure = F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), size.cast("string"), F.lit(" bytes</figcaption></figure>"))
    line = F.concat(F.lit("<p>"), F.substring_index(_escaped(text), "\n", 1), F.lit("</p>"))
    rest = F.substr(text, F.length(F.substring_index(text, "\n", 1)) + 2)
    return F.concat(F.lit("<article>"), line, figure, F.lit("<p>"), F.replace(_escaped(rest), F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article>"))


def references(pages: DataFrame, *keep: str) -> DataFrame:
    """keep columns and one row per media reference of pages (html): pos, digest, caption, n_parts, n_text (characters of text)."""
    chosen = pages.select(*keep, "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, html in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                parts = interleave(html)
                chars = sum(len(p["text"]) for p in parts if p["kind"] == "text")
                for p in parts:
                    if p["kind"] == "media":
                        row.append(i)
                        found.append({"pos": p["pos"], "digest": p["digest"], "caption": p["caption"], "n_parts": len(parts), "n_text": chars})
            kept = batch.take(pa.array(row, pa.int64()))
            out = pa.StructArray.from_arrays([pa.array([f[n] for f in found], t) for n, t in kinds.items()], list(kinds))
            yield pa.RecordBatch.from_arrays([*kept.columns[:-1], *out.flatten()], [*kept.schema.names[:-1], *kinds])

    kinds = {"pos": pa.int32(), "digest": pa.string(), "caption": pa.string(), "n_parts": pa.int64(), "n_text": pa.int64()}
    fields = [*chosen.schema.fields[:-1], *(T.StructField(n, {"pos": T.IntegerType(), "digest": T.StringType(), "caption": T.StringType()}.get(n, T.LongType())) for n in kinds)]
    return chosen.mapInArrow(run, T.StructType(fields))


def document_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pos, caption, n_parts, n_text.

    Each document becomes a page of its lines with a figure that refers to its payload (page_of); the reference is parsed
    out of the page, with its place between the text parts, and resolved by its digest.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    known = settle(describe(store_texts(docs)))
    pages = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), page_of(text).alias("html"))
    out = references(pages, "doc_id", "n_bytes").join(known, "digest", "left")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "n_parts", "n_text")


def resolved(sequences: DataFrame, store: DataFrame) -> DataFrame:
    """sequences (id, parts) with each media part's stored bytes: one row per part, in (id, pos) alignment."""
    parts = sequences.select("id", F.inline("parts"))
    known = store.select("digest", "media").dropDuplicates(["digest"])
    return parts.join(known, "digest", "left").select("id", "pos", "kind", "text", "digest", "caption", "media")
