"""Personal data by weak supervision.

Candidates are the base spans (fixed patterns with their checks), the base matches that failed
their check, and looser forms (national phone numbers, e-mail addresses written with (at), and
secrets: what is assigned to a name, or stands alone as a long mix of letters and digits).
Five labelers vote yes, no or abstain on each candidate: its pattern, a gazetteer (top-level
domains, card issuers, calling codes, reserved addresses, names of secrets and of other numbers),
the words before it, what it touches, and the shape of its characters. Expectation-maximisation
over the counts of vote patterns estimates how reliable each labeler is (Dawid and Skene's
model, one for each kind) from how they agree, without any of them being taken for the truth; its
posteriors train the final classifier, a logistic regression over votes, kind and length. Base
spans always stay; other candidates are added where the classifier is sure, and a card that fails its check
never unless gazetteer and context say more yes than no. `report` counts what is added and rejected.

Vote patterns are counted over all documents with partial counts in each task, so what reaches
the driver is bounded by the number of patterns (a few thousand), whatever the input. Texts are
scanned where they lie, in linear time; there is no shuffle of texts.

Defined cases: null and empty texts have no spans; positions are code points, ends exclusive;
candidates that overlap a base span are dropped; repeated rows are scanned each on its own; an
empty table trains nothing and adds nothing; other columns are ignored unless named in `keep`, which
may not name a result column.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Kinds that base spans have; a secret is never one.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
VOTES, SURE, ROUNDS = 5, 0.95, 60
#: How labelers are thought to vote (no, abstain, yes) on what is not and what is personal data, and
#: the weight of that against the candidates themselves.
FAIR, BELIEF = np.array([[0.7, 0.2, 0.1], [0.1, 0.2, 0.7]]), 0.2
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Digits are read from the start of a run, so a failed run is not tried again at each digit.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT, LETTER = re.compile(r"[0-9]"), re.compile(r"[A-Za-z]")
NATIONAL = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])")
WRITTEN_AT = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[]at[)\]] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]{1,63}){1,8}")
#: A value after a name and = or :, and a long run of letters and digits.
ASSIGNED = re.compile(r"(?<![\w-])(?P<name>[A-Za-z][A-Za-z_-]{1,30})[\"']? ?[=:] ?[\"']?(?P<value>[A-Za-z0-9_+/.-]{6,256})(?![\w+/-])")
BARE = re.compile(r"(?<![A-Za-z0-9_+/=.-])[A-Za-z0-9]{16,256}(?![A-Za-z0-9_+/=.-])")
#: Fixed lists of the gazetteer and of context words.
#: Documented forms of access key ids and tokens.
KEY_FORMS = re.compile(r"(AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,}|AIza[0-9A-Za-z_-]{35}")
SECRET_NAMES = re.compile(r"(?i)pass(word|wd|phrase)?$|pwd$|token$|secret$|(api|access|private|auth)[_-]?key$|credentials?$")
OTHER_NAMES = re.compile(r"(?i)(id|sku|isbn|issn|doi|date|time|url|http|https|ref|no|version|commit|sha|md5|hash|serial|order|part|code)$")
TOP_LEVEL = frozenset("com org net edu gov mil int info io co de fr es it uk us eu nl ch at be pl pt br ru cn jp in au ca".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "52", "54", "55", "61", "62", "64", "65", "81", "82", "86", "90", "91")
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38")
#: English, German, French and Spanish.
YES_WORDS = {
    "email": frozenset("email e-mail mail contact write reply kontakt schreiben courriel contacter correo contacto escribir".split()),
    "ip": frozenset("ip host server address addr from peer client adresse serveur dirección servidor".split()),
    "card": frozenset("card visa mastercard amex credit debit payment pay karte kreditkarte zahlung carte paiement tarjeta crédito pago".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax whatsapp sms telefon handy anruf téléphone portable appelez teléfono móvil llame".split()),
    "secret": frozenset("password passwd pwd token secret key credential credentials login auth passwort kennwort schlüssel passe jeton contraseña clave secreto".split()),
}
NO_WORDS = frozenset(
    "version release isbn order invoice serial item part section chapter id sku tracking commit checksum hash revision model bestellung rechnung artikel kapitel seriennummer "
    "commande facture article chapitre série pedido factura artículo capítulo serie".split()
)
NAME_BEFORE = re.compile(r"([A-Za-z][A-Za-z_-]*)[\"']? ?[=:]? ?[\"']?$")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping: the local part is what of it reaches back from the @."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at + 1)
        if m:
            start = at
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return out


def digits_of(s: str) -> str:
    return "".join(DIGIT.findall(s))


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, form): form 0 is a base span, 1 a base match that failed its check,
    2 a looser form, 3 one without a name; all but the first only where no base span lies."""
    base: list[tuple[int, int, int, int]] = []
    if "@" in text:
        base += [(s, e, 0, 0) for s, e in emails(text)]
    more: list[tuple[int, int, int, int]] = []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            good = all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) < 256 for x in m[0].split("."))
            (base if good else more).append((m.start(), m.end(), 1, 0 if good else 1))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                d = digits_of(m[0])
                if 12 <= len(d) <= 19:
                    good = luhn(d)
                    (base if good else more).append((m.start(), m.end(), 2, 0 if good else 1))
        if "+" in text:
            for m in PHONE.finditer(text):
                good = 9 <= len(digits_of(m[0])) <= 15
                (base if good else more).append((m.start(), m.end(), 3, 0 if good else 1))
        more += [(m.start(), m.end(), 3, 2) for m in NATIONAL.finditer(text)]
        more += [(m.start(), m.end(), 4, 3) for m in BARE.finditer(text) if mixed_shape(m[0])]
    if "(at)" in text or "[at]" in text:
        more += [(m.start(), m.end(), 0, 2) for m in WRITTEN_AT.finditer(text)]
    if "=" in text or ":" in text:
        more += [(m.start("value"), m.end("value"), 4, 2) for m in ASSIGNED.finditer(text) if mixed_shape(m["value"])]
    base.sort(key=lambda c: (c[0], c[2]))
    return base + apart(more, base)


def mixed_shape(s: str) -> bool:
    """Letters and digits both."""
    return DIGIT.search(s) is not None and LETTER.search(s) is not None


def apart(more: list, base: list) -> list:
    """Of more, those that touch no base span nor each other; the first goes first."""
    out: list = []
    edges = sorted((s, e) for s, e, _, _ in base)
    k, reach, last = 0, -1, -1
    for c in sorted(more):
        while k < len(edges) and edges[k][0] < c[1]:
            reach = max(reach, edges[k][1])
            k += 1
        if c[0] >= max(reach, last):
            out.append(c)
            last = c[1]
    return out


def votes(text: str, c: tuple[int, int, int, int]) -> tuple[int, ...]:
    """Each labeler's vote: 1 yes, -1 no, 0 abstains."""
    start, end, kind, form = c
    span = text[start:end]
    d = digits_of(span)
    before = [w.lower() for w in WORD.findall(text[max(0, start - 40) : start])][-4:]
    if kind == 0:
        listed = 1 if re.split(r"[.)\] ]+", span)[-1].lower() in TOP_LEVEL else -1
    elif kind == 1:
        listed = -1 if span.startswith(("0.", "127.", "255.")) or form else 1
    elif kind == 2:
        listed = 1 if ISSUERS.match(d) else -1
    elif kind == 4:
        name = NAME_BEFORE.search(text[max(0, start - 40) : start])
        form = 2 if KEY_FORMS.fullmatch(span) else form
        listed = 1 if KEY_FORMS.fullmatch(span) else 0 if not name else 1 if SECRET_NAMES.search(name[1]) else -1 if OTHER_NAMES.search(name[1]) else 0
    else:
        listed = 1 if span[0] != "+" or d.startswith(CALLING) else -1
    context = 1 if YES_WORDS[ALL_KINDS[kind]].intersection(before) else -1 if NO_WORDS.intersection(before) else 0
    around = text[max(0, start - 1) : start] + text[end : end + 1]
    # a run of digits between spaces is no sign of either
    touches = -1 if any(x.isalnum() or x in "_@/" for x in around) else 0 if kind in (1, 2) else 1
    if kind == 4:  # how often letters and digits turn into each other: often in what is random
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
        shape = 1 if 5 * turns >= len(span) else -1
    else:
        shape = -1 if kind and len(set(d)) <= 2 else 1 if kind == 3 else 0
    pattern = (1, -1, 1 if kind == 4 else 0, 0)[form]
    return (pattern, listed, context, touches, shape)


def pattern(text: str, c: tuple[int, int, int, int]) -> tuple[int, ...]:
    """What the models see: kind, votes and a step of length."""
    return (c[2], *votes(text, c), min(5, (c[1] - c[0]) // 6))


def decoy(text: str, c: tuple[int, int, int, int]) -> tuple[int, ...] | None:
    """What the models would see of random digits as long as a card: what is no personal data for sure. The
    digits follow from the candidate's own."""
    if ALL_KINDS[c[2]] != "card":
        return None
    d = digits_of(text[c[0] : c[1]])
    drawn = str(zlib.crc32(d.encode()) * zlib.crc32(d[::-1].encode()) + 1).zfill(len(d))[-len(d) :]
    return pattern(drawn, (0, len(drawn), c[2], 0 if luhn(drawn) else 1))


def estimated(patterns: np.ndarray, counts: np.ndarray, decoys: np.ndarray) -> np.ndarray:
    """Posterior of 'personal data' for each pattern, by expectation-maximisation for each
    kind; decoys, random runs by pattern, are known to be none and tell how labelers vote on such. Matches that pass or fail a check start near 1 or 0, the rest at their mean vote; then
    nothing is held fixed: a labeler is as reliable as it agrees with what all of them say, and
    a little as is thought of it beforehand (FAIR)."""
    post = np.zeros(len(patterns))
    for kind in range(len(ALL_KINDS)):
        own = patterns[:, 0] == kind
        if not own.any():
            continue
        v, n, none = patterns[own, 1 : 1 + VOTES] + 1, counts[own].astype(float), decoys[own].astype(float)
        # a pattern with a check starts it off, then is a labeler like the others
        start = 0.5 + (v - 1).mean(axis=1) / 2
        q = np.clip(np.where(v[:, 0] == 0, 0.05, np.where((v[:, 0] == 2) & (kind != 4), 0.95, start)), 0.05, 0.95)
        for _ in range(ROUNDS):
            logs = np.zeros((2, len(v)))
            for z, w in ((1, n * q), (0, n * (1 - q))):
                prior = (w.sum() + 1) / (n.sum() + 2)
                logs[z] += np.log(prior)
                seen = w if z else w + none
                for j in range(VOTES):
                    p = np.bincount(v[:, j], weights=seen, minlength=3) + 1.0 + BELIEF * n.sum() * FAIR[z]
                    logs[z] += np.log(p / p.sum())[v[:, j]]
            q = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40)))
        post[own] = q
    return post


def design(patterns: np.ndarray) -> np.ndarray:
    """One-hot kind, votes and length, and a constant."""
    parts = [np.ones((len(patterns), 1)), np.eye(len(ALL_KINDS))[patterns[:, 0]]]
    parts += [np.eye(3)[patterns[:, 1 + j] + 1] for j in range(VOTES)]
    return np.hstack([*parts, np.eye(6)[patterns[:, 1 + VOTES]]])


def classifier(patterns: np.ndarray, counts: np.ndarray, decoys: np.ndarray, post: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels, those of decoys being 0, by Newton steps."""
    x = design(patterns)
    w = np.zeros(x.shape[1])
    n = (counts + decoys).astype(float)
    post = post * counts / np.maximum(n, 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - post)) + l2 * w
        hess = (x * (n * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, text: str = "text") -> dict[tuple[int, ...], float]:
    """The classifier's probability for every pattern that occurs in docs, or among their decoys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for c in candidates(t) if t else ():
                    counts[0, *pattern(t, c)] += 1
                    drawn = decoy(t, c)
                    if drawn:
                        counts[1, *drawn] += 1
        keys = [list(k) for k in counts]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.list_(pa.int32())), pa.array(list(counts.values()), pa.int64())], ["p", "n"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(run, "p array<int>, n long").groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()
    if not rows:
        return {}
    found: list[dict[tuple, int]] = [{tuple(r.p[1:]): r.n for r in rows if r.p[0] == k} for k in (0, 1)]
    patterns = np.array(sorted(found[0].keys() | found[1].keys()))
    counts, decoys = (np.array([own.get(tuple(p), 0) for p in patterns.tolist()]) for own in found)
    w = classifier(patterns, counts, decoys, estimated(patterns, counts, decoys))
    scores = 1 / (1 + np.exp(-np.clip(design(patterns) @ w, -30, 30)))
    return {tuple(p): float(s) for p, s in zip(patterns.tolist(), scores)}


def added(p: tuple[int, ...], score: float, sure: float) -> bool:
    """Whether a candidate that is no base span is taken; a card that fails its check, only if its issuer and its
    context say more yes than no."""
    return score >= sure and (ALL_KINDS[p[0]] != "card" or p[1] >= 0 or p[2] + p[3] > 0)


def spans_of(text: str | None, model: dict, sure: float = SURE) -> list[dict]:
    out = []
    for c in candidates(text) if text else ():
        p = pattern(text, c)
        score = model.get(p, 0.0)
        if c[3] == 0 or added(p, score, sure):
            out.append({"kind": ALL_KINDS[c[2]], "start": c[0], "end": c[1], "base": c[3] == 0, "score": score})
    return sorted(out, key=lambda s: (s["start"], ALL_KINDS.index(s["kind"])))


def report(docs: DataFrame, model: dict, text: str = "text", sure: float = SURE) -> DataFrame:
    """kind and how many candidates are `base` spans, `added` and `rejected`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((len(ALL_KINDS), 3), np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for c in candidates(t) if t else ():
                    p = pattern(t, c)
                    n[c[2], 0 if c[3] == 0 else 1 if added(p, shared.value.get(p, 0.0), sure) else 2] += 1
        yield pa.RecordBatch.from_arrays([pa.array(ALL_KINDS), *map(pa.array, n.T)], ["kind", "base", "added", "rejected"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(run, "kind string, base long, added long, rejected long")
    return rows.groupBy("kind").agg(*[F.sum(c).alias(c) for c in ("base", "added", "rejected")])


SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("base", "boolean").add("score", "double"))
SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("score", pa.float64())]))


def find(docs: DataFrame, model: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",), redact: bool = False, sure: float = SURE) -> DataFrame:
    """keep columns and `spans` (by start, then kind) for every row; with redact also `redacted`,
    the text with each span replaced by its kind in square brackets (null stays null)."""
    if {"spans", "redacted"} & set(keep):
        raise ValueError("keep names a result column")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(*keep, F.col(text).alias("__text"))
    schema = source.drop("__text").schema.add("spans", SPANS)
    schema = schema.add("redacted", "string") if redact else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                texts = part.column(len(keep)).to_pylist()
                found = [spans_of(t, known, sure) for t in texts]
                more = [pa.array(found, SPAN)]
                if redact:
                    more.append(pa.array([replaced(t, s) for t, s in zip(texts, found)], pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *more], schema.names)

    return source.mapInArrow(run, schema)


def replaced(text: str | None, spans: list[dict]) -> str | None:
    if not spans:
        return text
    out, at = [], 0
    for s in spans:
        if s["end"] > at:
            out.append(text[at : max(at, s["start"])])
            if s["start"] >= at:
                out.append(f"[{s['kind'].upper()}]")
            at = s["end"]
    return "".join(out) + text[at:]
