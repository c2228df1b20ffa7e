"""Filter predicates: a JSON tree becomes one Column, with a rewrite to arbitration ids where the schema allows it.

Shapes: {"all": [...]}, {"any": [...]}, {"bus": b}, {"id_range": [lo, hi]}, {"id_list": [...]}, {"name_regex": p},
{"signal_equals": {"name": n, "value": x}}. Anything else matches nothing and is never an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.decode import decode_frames
from .catalog import Catalog

Key = tuple[int, bool]
_INVALID = ("invalid", None)


def _is_id(x: object) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 1 << 32


def _valid(kind: str, arg: object) -> bool:
    if kind in ("all", "any"):
        return isinstance(arg, list)
    if kind in ("bus", "name_regex"):
        return isinstance(arg, str)
    if kind == "id_range":
        return isinstance(arg, list) and len(arg) == 2 and all(map(_is_id, arg))
    if kind == "id_list":
        return isinstance(arg, list) and all(map(_is_id, arg))
    if kind == "signal_equals":
        return isinstance(arg, dict) and isinstance(arg.get("name"), str) and isinstance(arg.get("value"), int | float) and not isinstance(arg.get("value"), bool)
    return False


def node(tree: object) -> tuple[str, object]:
    """(shape, argument) of a tree's root; ("invalid", None) for anything unknown."""
    if isinstance(tree, str):
        try:
            tree = json.loads(tree)
        except ValueError:
            return _INVALID
    if isinstance(tree, dict) and len(tree) == 1:
        (kind, arg), *_ = tree.items()
        if _valid(kind, arg):
            return kind, arg
    return _INVALID


def compiled(pattern: str) -> re.Pattern | None:
    """The pattern, or None if it is bad. Look-around and back-references are outside the filter dialect."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        return None
    try:
        return re.compile(pattern)
    except re.error:
        return None


def to_column(tree: object) -> Column:
    """The predicate over frames with `message` and `signals` of decode_frames. Never null."""
    kind, arg = node(tree)
    if kind == "all":
        return reduce(lambda a, b: a & b, [to_column(c) for c in arg], F.lit(True))
    if kind == "any":
        return reduce(lambda a, b: a | b, [to_column(c) for c in arg], F.lit(False))
    if kind == "bus":
        return F.col("bus_id").eqNullSafe(F.lit(arg))
    if kind == "id_range":
        return F.coalesce(F.col("id").between(*arg), F.lit(False))
    if kind == "id_list":
        return F.coalesce(F.col("id").isin(arg), F.lit(False)) if arg else F.lit(False)
    if kind == "signal_equals":
        near = lambda s: (s["name"] == arg["name"]) & (F.abs(s["value"] - F.lit(float(arg["value"]))) < 1e-9)
        return F.coalesce(F.exists("signals", near), F.lit(False))
    if kind == "name_regex" and (pattern := compiled(arg)):
        return F.coalesce(F.col("message").rlike(pattern.pattern), F.lit(False))
    return F.lit(False)


@dataclass(frozen=True)
class Candidates:
    """A superset of the (id, extended) keys that can match (None: unbounded), and whether being one is the match."""

    keys: frozenset[Key] | None
    exact: bool


def candidates(tree: object, catalog: Catalog) -> Candidates:
    kind, arg = node(tree)
    known = {(m.id, m.extended) for x in catalog.loaded for m in x.database.messages}
    if kind == "all":
        parts = [candidates(c, catalog) for c in arg]
        bounded = [p.keys for p in parts if p.keys is not None]
        keys = frozenset.intersection(*bounded) if bounded else None
        return Candidates(keys, bool(parts) and all(p.exact for p in parts))
    if kind == "any":
        parts = [candidates(c, catalog) for c in arg]
        if any(p.keys is None for p in parts):
            return Candidates(None, False)
        return Candidates(frozenset().union(*(p.keys for p in parts)), all(p.exact for p in parts))
    if kind == "id_list":
        return Candidates(frozenset((i, e) for i in arg for e in (False, True)), True)
    if kind == "id_range" and arg[1] - arg[0] < 4096:
        return Candidates(frozenset((i, e) for i in range(arg[0], arg[1] + 1) for e in (False, True)), True)
    if kind == "name_regex":
        pattern = compiled(arg)
        hit = {(m.id, m.extended) for x in catalog.loaded for m in x.database.messages if pattern and pattern.search(m.name)}
        return Candidates(frozenset(hit), False)
    if kind == "signal_equals":
        hit = {(m.id, m.extended) for x in catalog.loaded for m in x.database.messages if m.signal(arg["name"])}
        return Candidates(frozenset(hit & known), False)
    if kind == "invalid":
        return Candidates(frozenset(), True)
    return Candidates(None, False)


def needs_decode(tree: object) -> bool:
    kind, arg = node(tree)
    return any(map(needs_decode, arg)) if kind in ("all", "any") else kind in ("name_regex", "signal_equals")


def without_decode(tree: object) -> Column:
    """A necessary condition on raw columns alone: decode-dependent leaves count as true."""
    kind, arg = node(tree)
    if kind in ("all", "any"):
        join = (lambda a, b: a & b) if kind == "all" else (lambda a, b: a | b)
        return reduce(join, [without_decode(c) for c in arg], F.lit(kind == "all"))
    return F.lit(True) if kind in ("name_regex", "signal_equals") else to_column(tree)


def filter_frames(frames: DataFrame, tree: object, catalog: Catalog, decoded: bool = False) -> DataFrame:
    """The frames that match. Ids that can match and conditions on raw columns reach the scan; only then are frames
    decoded, and only if a leaf needs it. With decoded=True the result carries message and signals."""
    found = candidates(tree, catalog)
    out = frames
    if found.keys is not None:
        if not found.keys:
            out = out.filter(F.lit(False))
        else:
            both = sorted({i for i, e in found.keys if (i, not e) in found.keys})
            sides = [F.col("id").isin(both)] if both else []
            for e in (False, True):
                one = sorted(i for i, x in found.keys if x == e and i not in set(both))
                if one:
                    sides.append(F.col("id").isin(one) & (F.col("extended") == e))
            out = out.filter(reduce(lambda a, b: a | b, sides))
    out = out.filter(without_decode(tree))
    if decoded or needs_decode(tree):
        full = decode_frames(out, catalog)
        full = full.filter(to_column(tree)) if needs_decode(tree) else full
        return full if decoded else full.select(*frames.columns)
    return out


def sink_predicate(sources: list[str], elements: dict[str, dict]) -> object:
    """The predicate of a sink wired to sources: none matches nothing; `*` any bus; buses are OR-ed; an upstream filter
    element {"predicate": p, "sources": [...]} is AND-ed with what it is wired to, and cycles match nothing."""

    def of(given: list[str], seen: frozenset[str]) -> object:
        parts: list[object] = []
        for s in given:
            if s == "*":
                parts.append({"all": []})
            elif s in elements:
                if s not in seen:
                    parts.append({"all": [elements[s].get("predicate", {"all": []}), of(elements[s].get("sources", []), seen | {s})]})
            else:
                parts.append({"bus": s})
        return {"any": parts}

    return of(sources, frozenset())


def select_descriptors(rows: list[dict], keys: list[dict] | None = None, patterns: list[str] | None = None, buses: list[str] | None = None, bus_names: dict[str, str] | None = None) -> list[dict]:
    """Catalogue rows chosen by key or by any pattern on their path (buses by name); a bad pattern is an error here."""
    names, chosen = bus_names or {}, []
    tests = [re.compile(p) for p in patterns or []]
    wanted = {(k.get("bus_id"), k["id"], k["extended"], k["signal"]) for k in keys or []}
    for r in rows:
        if buses is not None and r["bus_id"] not in buses:
            continue
        path = "/".join([names.get(r["bus_id"], r["bus_id"] or ""), r["ecu"] or "", r["message"] or "", r["signal"]])
        if (r["bus_id"], r["id"], r["extended"], r["signal"]) in wanted or any(t.search(path) for t in tests):
            chosen.append(r)
    return chosen


def resolve_patterns(patterns: list[str], paths: list[str]) -> list[dict]:
    """Per pattern: whether it compiles and which paths it matches."""
    out = []
    for p in patterns:
        try:
            test: Callable | None = re.compile(p).search
        except re.error:
            test = None
        out.append({"pattern": p, "valid": test is not None, "matches": [x for x in paths if test and test(x)]})
    return out
