"""Matching source columns to destination columns by their headers (driver-side: columns, not rows),
and what the reviewed mappings make of both sides' rows."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from tablemill.frame import ROW_ID, ROW_NUM, FrameError, PreparedFrame
from tablemill.functions.normalized import normalize_text
from tablemill.functions.values import Value, unified

#: Weights of both likenesses, the least score of a suggestion, and of a high one.
NAME_WEIGHT, TOKEN_WEIGHT, LEAST, HIGH = 0.65, 0.35, 0.55, 0.85


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    left, places = [], []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                left.append(c)
                places.append(j)
                break
    m = len(left)
    if not m:
        return 0.0
    swapped = sum(c != b[j] for c, j in zip(left, sorted(places))) / 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    same = 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return jaro + same * 0.1 * (1 - jaro)


def token_dice(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    return 2 * len(x & y) / (len(x) + len(y)) if x or y else 0.0


def similarity(a: str, b: str) -> float:
    """Of normalised headers, to four places."""
    raw = NAME_WEIGHT * jaro_winkler(a, b) + TOKEN_WEIGHT * token_dice(a, b)
    return float(Decimal(raw).quantize(Decimal("0.0001"), ROUND_HALF_UP))


def confidence(score: float) -> str:
    return "exact" if score == 1 else "high" if score >= HIGH else "medium" if score >= LEAST else "low"


@dataclass(frozen=True)
class Mapping:
    source: str
    destination: str | None
    confidence: str
    score: float
    status: str = "review-required"
    #: Set for a fixed value, which needs no source.
    value: object = None


def suggest(sources: list, destinations: list) -> list[Mapping]:
    """A suggestion for each source column (objects with id and header). A header that stands
    once on either side and is equal after normalisation is exact; else the likeliest
    destination is taken, the first of equals, if it is likely enough."""
    there = [(d.id, normalize_text(d.header)) for d in destinations]
    once = Counter(normalize_text(s.header) for s in sources)
    out = []
    for s in sources:
        name = normalize_text(s.header)
        equal = [i for i, n in there if n == name] if name and once[name] == 1 else []
        if len(equal) == 1:
            out.append(Mapping(s.id, equal[0], "exact", 1.0))
            continue
        best, score = max(((i, similarity(name, n)) for i, n in there), key=lambda x: x[1], default=(None, 0.0)) if name else (None, 0.0)
        out.append(Mapping(s.id, best, confidence(score), score) if score >= LEAST else Mapping(s.id, None, "low", 0.0))
    return out


def accept_all(mappings: list[Mapping]) -> list[Mapping]:
    return [replace(m, status="accepted" if m.destination else "ignored") for m in mappings]


def ignore_all(mappings: list[Mapping]) -> list[Mapping]:
    return [replace(m, status="ignored", destination=None) for m in mappings]


def review(mappings: list[Mapping], source: str, action: str, destination: str | None = None, value: object = None) -> list[Mapping]:
    """action: map (to destination), ignore, or fixed (value for destination)."""
    status = {"map": "accepted", "ignore": "ignored", "fixed": "fixed"}[action]
    to = None if action == "ignore" else destination
    return [replace(m, status=status, destination=to, value=value) if m.source == source else m for m in mappings]


def duplicate_destinations(mappings: list[Mapping]) -> list[str]:
    return [d for d, n in Counter(m.destination for m in mappings if m.status != "ignored" and m.destination).items() if n > 1]


def reconcile(mappings: list[Mapping], sources: list, destinations: list) -> list[Mapping]:
    """After a change of columns: reviewed mappings of columns that are still there stay, the
    others are suggested anew."""
    known, ids = {m.source: m for m in mappings if m.status != "review-required"}, {d.id for d in destinations}
    kept = {s: m for s, m in known.items() if m.destination is None or m.destination in ids}
    return [kept.get(m.source, m) for m in suggest(sources, destinations)]


def identity(columns: list) -> list[Mapping]:
    return [Mapping(c.id, c.id, "exact", 1.0, "accepted") for c in columns]


def with_fixed_values(frame: PreparedFrame, mappings: list[Mapping]) -> PreparedFrame:
    """Fixed mappings override what their source column holds, before validation and planning."""
    fixed = {m.source: unified([Value.of(m.value)])[1][0] for m in mappings if m.status == "fixed"}
    for c in fixed:
        frame.info(c)
    return frame.set(fixed) if fixed else frame


def projected(existing: PreparedFrame, source: PreparedFrame, mappings: list[Mapping]) -> PreparedFrame:
    """Existing rows in the source's columns: each takes its mapped destination column, or nulls; a
    plan can then compare both sides."""
    to = {m.source: m.destination for m in mappings if m.status != "ignored" and m.destination}
    none = lambda c: F.lit(None).cast(source.df.schema[c].dataType)
    cells = [(F.col(f"`{to[c]}`") if to.get(c) in existing.ids else none(c)).alias(c) for c in source.ids]
    return replace(existing, df=existing.df.select(*cells, *existing.hidden), columns=source.columns)


def in_destination_columns(frame: PreparedFrame, mappings: list[Mapping], destinations: tuple) -> PreparedFrame:
    """Incoming rows in the destination's columns, as they are written: fixed values applied, mapped
    columns renamed, destinations without a source null."""
    twice = duplicate_destinations(mappings)
    if twice:
        raise FrameError(f"Coluna de destino duplicada: {twice[0]}")
    frame = with_fixed_values(frame, mappings)
    of = {m.destination: m.source for m in mappings if m.status in ("accepted", "fixed") and m.destination}
    cells = [(F.col(f"`{of[d.id]}`") if d.id in of else F.lit(None).cast("string")).alias(d.id) for d in destinations]
    order = [n for n, _ in frame.order]
    return replace(frame, df=frame.df.select(*cells, ROW_ID, ROW_NUM, *order), columns=tuple(destinations))
