"""Edit-aware token counting: a stored segment tree of pre-token counts per document.

A text splits into pre-tokens by the tokenizer's pattern; merges never cross them, so a text's tokens are the sum over
its pre-tokens. with_trees() keeps, beside each document, the lengths and token counts of its pre-tokens, cut into
leaves of BLOCK, and a binary tree with the characters and tokens below every node. Lengths are relative, so what stands
after an edit never changes.

edited() loads the stored trees and applies edits (start, end, replacement in code points). The tree is descended by
characters to the last pre-token that ends two or more characters before the edit (the pattern looks at no more than two
characters past a match); from there pre-tokens are encoded until a boundary after the edit meets an old one. The new
pre-tokens take the places of the old in their leaves, and the sums on the paths above those leaves are updated. A leaf
that outgrows twice BLOCK is split; the tree of sums is laid out anew only when a split finds no empty leaf beside it.

Edits apply in the order given, each to the text the ones before left; positions beyond the text's end stop there.
Null texts are empty. Repeated rows are counted one by one; extra columns are ignored; empty tables give empty results.
Texts are handled whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import settle

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 64
#: pre-tokens whose counts a worker remembers
REMEMBER = 300_000


class Counter:
    """Tokens of pre-tokens under a rank file's content."""

    def __init__(self, ranks: bytes):
        import regex
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.split = regex.compile(PATTERN)
        self.seen: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.seen.get(piece)
        if n is None:
            if len(self.seen) >= REMEMBER:
                self.seen.clear()
            n = self.seen[piece] = len(self.encode(piece))
        return n


@cache
def _counter(ranks: bytes) -> Counter:
    return Counter(ranks)


def rank_file(path: str) -> bytes:
    """The content of a rank file of the driver, to be shipped with the job (about half a megabyte)."""
    with open(path, "rb") as ranks:
        return ranks.read()


class Tree:
    """Leaves of pre-tokens (lengths, counts) under a binary tree of sums; chars[1] and tokens[1] are the totals."""

    def __init__(self, counter: Counter, text: str, lens, counts, sizes, chars=None, tokens=None):
        self.counter, self.text = counter, text
        at = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))]).tolist()
        self.leaves = [(lens[a:b], counts[a:b]) for a, b in pairwise(at)]
        self.chars, self.tokens = chars, tokens
        self.encoded = self.touched = self.laid_out = 0
        if chars is None:
            self._lay_out()

    @classmethod
    def of(cls, counter: Counter, text: str) -> Tree:
        pieces = counter.split.findall(text)
        lens, counts = [len(p) for p in pieces], [counter.count(p) for p in pieces]
        return cls(counter, text, lens, counts, [len(lens[i : i + BLOCK]) for i in range(0, len(lens), BLOCK)])

    def _lay_out(self) -> None:
        self.leaves = [leaf for leaf in self.leaves if len(leaf[0])] or [([], [])]
        size = 1 << (len(self.leaves) - 1).bit_length()
        self.leaves += [([], [])] * (size - len(self.leaves))
        self.chars = [0] * size + [int(sum(n)) for n, _ in self.leaves]
        self.tokens = [0] * size + [int(sum(c)) for _, c in self.leaves]
        for sums in (self.chars, self.tokens):
            for i in range(size - 1, 0, -1):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    @property
    def pieces(self) -> int:
        return sum(len(n) for n, _ in self.leaves)

    def _put(self, i: int, lens: list[int], counts: list[int]) -> None:
        """Leaf i anew, and the sums on its path."""
        self.leaves[i] = (lens, counts)
        i += len(self.leaves)
        self.chars[i], self.tokens[i] = sum(lens), sum(counts)
        while i > 1:
            i //= 2
            self.touched += 1
            for sums in (self.chars, self.tokens):
                sums[i] = sums[2 * i] + sums[2 * i + 1]

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """(leaf with that character, characters before it); the last leaf beyond the end."""
        i, before, size = 1, 0, len(self.leaves)
        while i < size:
            i *= 2
            if position - before >= self.chars[i] and self.chars[i + 1]:
                before += self.chars[i]
                i += 1
        return i - size, before

    def edit(self, start: int, end: int, replacement: str) -> None:
        start = min(start, len(self.text))
        end = max(start, min(end, len(self.text)))
        shift = len(replacement) - (end - start)
        self.text = text = self.text[:start] + replacement + self.text[end:]
        first, at = self._leaf_at(max(0, start - 2))
        own, own_counts = (list(map(int, x)) for x in self.leaves[first])
        keep = 0
        while keep < len(own) and at + own[keep] <= start - 2:
            at += own[keep]
            keep += 1
        new, new_counts, last, old, lens, k = [], [], first, at, own, keep  # old: the old boundary before piece k of leaf `last`
        for m in self.counter.split.finditer(text, at):
            new.append(m.end() - m.start())
            new_counts.append(self.counter.count(m[0]))
            self.encoded += 1
            met = m.end() - shift
            while old < met and (k < len(lens) or last + 1 < len(self.leaves)):
                if k == len(lens):
                    last, k = last + 1, 0
                    lens = self.leaves[last][0]
                else:
                    old += int(lens[k])
                    k += 1
            if m.end() >= start + len(replacement) and met >= end and old == met:
                break
        else:  # nothing of the old text is left after the edit
            last, k = len(self.leaves) - 1, len(self.leaves[-1][0])
        rest = ([int(x) for x in part[k:]] for part in self.leaves[last])
        lens, counts = own[:keep] + new, own_counts[:keep] + new_counts
        lens += next(rest)
        counts += next(rest)
        room = last - first + 1
        step = max(1, -(-len(lens) // room)) if len(lens) <= 2 * BLOCK * room else BLOCK
        parts = [(lens[i : i + step], counts[i : i + step]) for i in range(0, len(lens), step)] or [([], [])]
        if len(parts) <= room:
            for i in range(room):
                if i < len(parts) or len(self.leaves[first + i][0]):
                    self._put(first + i, *(parts[i] if i < len(parts) else ([], [])))
        else:
            self.leaves[first : last + 1] = parts
            self.laid_out += 1
            self._lay_out()


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


_TREE = "n_pieces long, lens array<int>, counts array<int>, sizes array<int>, chars array<int>, tokens array<int>"


def with_trees(docs: DataFrame, ranks: bytes, *keep: Column) -> DataFrame:
    """doc_id, text, keep columns and the tree of each document, stored."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        ints = pa.list_(pa.int32())
        for batch in _parts(batches):
            trees = [Tree.of(counter, t or "") for t in batch.column(1).to_pylist()]
            flat = lambda k: pa.array([[x for leaf in t.leaves for x in leaf[k]] for t in trees], ints)
            columns = [pa.array([t.pieces for t in trees], pa.int64()), flat(0), flat(1), pa.array([[len(n) for n, _ in t.leaves] for t in trees], ints), pa.array([t.chars for t in trees], ints), pa.array([t.tokens for t in trees], ints)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "n_pieces", "lens", "counts", "sizes", "chars", "tokens"])

    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields)
    return settle(chosen.mapInArrow(run, f"{fields}, {_TREE}"))


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column as views of one array."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return [flat[a:b] for a, b in pairwise(at.tolist())]


def edited(trees: DataFrame, ranks: bytes) -> DataFrame:
    """doc_id, n_pieces, n_tokens, n_tokens_edited, n_reencoded, n_touched from stored trees with a column `edits` of
    (start, end, text): counts before and after, pre-tokens encoded and nodes of the tree updated."""
    kind = trees.schema["doc_id"].dataType.simpleString()
    shared = trees.sparkSession.sparkContext.broadcast(ranks)
    names = ["n_pieces", "n_tokens", "n_tokens_edited", "n_reencoded", "n_touched"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(shared.value)
        for batch in _parts(batches):
            rows = []
            lists = [_lists(batch.column(i)) for i in range(4, 9)]
            for text, given, n, lens, counts, sizes, chars, tokens in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), *lists, strict=True):
                tree = Tree(counter, text or "", lens, counts, sizes, chars.tolist(), tokens.tolist())
                before = tree.tokens[1]
                for e in given or []:
                    tree.edit(e["start"], e["end"], e["text"] or "")
                rows.append((n, before, tree.tokens[1], tree.encoded, tree.touched))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), pa.int64()) for c in columns)], ["doc_id", *names])

    chosen = trees.select("doc_id", "text", "edits", "n_pieces", "lens", "counts", "sizes", "chars", "tokens")
    return chosen.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))


_EDITS = "array<struct<start:int,end:int,text:string>>"


def edited_counts(docs: DataFrame, edits: Column, ranks: str = RANKS) -> DataFrame:
    """Trees of docs, stored, then their counts before and after edits (start, end, text); `ranks` is a path of the driver."""
    content = rank_file(ranks)
    return edited(with_trees(docs, content, edits.cast(_EDITS).alias("edits")), content)


def planned_edits() -> Column:
    """Three edits of each text at places drawn from its id: a word put in, a span taken out, a word put in its stead."""
    size = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    spot = [F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(k)), F.greatest(size, F.lit(1)).cast("long")).cast("int") for k in range(3)]
    edit = lambda a, n, t: F.struct(a.alias("start"), (a + n).alias("end"), F.lit(t).alias("text"))
    return F.array(edit(spot[0], 0, " edited"), edit(spot[1], 12, ""), edit(spot[2], 5, "word"))
