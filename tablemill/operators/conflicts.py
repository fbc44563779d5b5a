"""Entries of a decision table that contradict each other, without comparing all pairs.

Two entries can contradict only if a row can meet both. Entries are grouped by mask (which keys are
given as a value, empty or any); for two masks that can meet, entries are joined on the values of the
keys that both give. Inside such a group each dependent column says by itself which of its
constraints exclude each other: by kind, by value, by the values of lists, or by a sweep over sorted
bounds. What is looked at is what the result holds, and what shares a key.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import combinations_with_replacement, product

Pair = tuple[int, int]
Side = list[tuple[int, dict]]
RANGES = ("numberRange", "stringLength", "dateRange")


def typed(x: object) -> str:
    """Text that is equal for values of equal kind and value."""
    if isinstance(x, (int, float)) and not isinstance(x, bool):
        x = float(x) + 0.0
    return json.dumps([type(x).__name__, x], ensure_ascii=False)


def masks(keys: list[str], entries: list[dict]) -> dict[tuple[str, ...], list[tuple[int, tuple]]]:
    """Entries (place and keys given as values, others None) by mask. One that lacks a condition meets no row."""
    out: dict[tuple[str, ...], list[tuple[int, tuple]]] = defaultdict(list)
    for i, e in enumerate(entries):
        nodes = [e["conditions"].get(c) for c in keys]
        if all(nodes):
            out[tuple(n["operator"] for n in nodes)].append((i, tuple(typed(n["value"]) if n["operator"] == "equals" else None for n in nodes)))
    return out


def meeting(keys: list[str], entries: list[dict]) -> Iterator[tuple[list[int], list[int]]]:
    """Groups of entries of two masks that can all meet the same row; both are the same group where the masks are."""
    found = masks(keys, entries)
    for a, b in combinations_with_replacement(found, 2):
        if any({x, y} == {"equals", "empty"} for x, y in zip(a, b)):
            continue
        shared = [k for k, (x, y) in enumerate(zip(a, b)) if x == y == "equals"]
        by = lambda rows: grouped((tuple(v[k] for k in shared), i) for i, v in rows)  # noqa: E731, B023
        left = by(found[a])
        right = left if a == b else by(found[b])
        yield from ((left[v], right[v]) for v in left.keys() & right.keys())


def grouped(rows: Iterable[tuple]) -> dict:
    out = defaultdict(list)
    for key, x in rows:
        out[key].append(x)
    return out


def excluded(left: Side, right: Side) -> Iterator[Pair]:
    """Pairs of constraints of one column that no value satisfies both, as far as that can be told; once or
    more. With left and right the same, pairs come both ways."""
    a, b = (grouped((x["type"], (i, x)) for i, x in side if x["type"] != "any") for side in (left, right))
    places = lambda rows: [i for i, _ in rows]
    for x, y in product(a, b):
        if x != y:
            if {x, y} == {"empty", "required"} or {x, y} & {"empty", "equals"}:
                yield from product(places(a[x]), places(b[y]))
        elif x in ("equals", "type"):
            yield from unlike(a[x], b[x], lambda c: typed(c["value"]) if c["type"] == "equals" else c["valueType"])
        elif x == "allowed":
            yield from disjoint(a[x], b[x])
        elif x in RANGES:
            yield from apart(a[x], b[x])


def unlike(left: Side, right: Side, value) -> Iterator[Pair]:
    a, b = (grouped((value(c), i) for i, c in side) for side in (left, right))
    for x, y in product(a, b):
        if x != y:
            yield from product(a[x], b[y])


def disjoint(left: Side, right: Side) -> Iterator[Pair]:
    """Lists without a common value. Equal lists are looked at once, and lists that hold the values that most
    others hold are told from the few that do not."""
    a, b = (grouped((frozenset(map(typed, c["allowedValues"])), i) for i, c in side) for side in (left, right))
    counts: dict[str, int] = defaultdict(int)
    for values in b:
        for v in values:
            counts[v] += 1
    common = max(counts, key=counts.__getitem__, default=None)
    others = [y for y in b if common not in y]
    for x in a:
        for y in others if common in x else b:
            if not x & y:
                yield from product(a[x], b[y])


def apart(left: Side, right: Side) -> Iterator[Pair]:
    """Ranges without a common value: the greater lower bound is above the smaller upper one. Ranges are
    sorted by lower bound, so that for an upper bound those that start above it are one stretch."""
    for one, other, turned in ((left, right, False), (right, left, True)):
        lows = sorted((c["min"], i) for i, c in other if c.get("min") is not None)
        starts = [low for low, _ in lows]
        for i, c in one:
            high = c.get("max")
            if high is not None:
                yield from ((j, i) if turned else (i, j) for _, j in lows[bisect_right(starts, high) :])
    # a range that is empty by itself excludes all others of its kind
    for one, other, turned in ((left, right, False), (right, left, True)):
        for i, c in one:
            if c.get("min") is not None and c.get("max") is not None and c["min"] > c["max"]:
                yield from ((j, i) if turned else (i, j) for j, _ in other)


def conflicts(rule: dict) -> list[Pair]:
    """Places of entries that can meet the same row and ask a dependent column for what no value
    satisfies, in order."""
    entries, out = rule["entries"], set()
    for left, right in meeting(rule["keyColumnIds"], entries):
        for c in dict.fromkeys(c for i in left for c in entries[i]["constraints"]):
            a, b = ([(i, entries[i]["constraints"][c]) for i in side if c in entries[i]["constraints"]] for side in (left, right))
            if a and b:
                out.update((min(p), max(p)) for p in excluded(a, b) if p[0] != p[1])
    return sorted(out)
