"""The operators that SQL cannot express, against plain definitions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DATA, SMALL, docs_of, lower, odd_texts, prose, words_of

from tablemill.llm import contamination, nearcopies, passages, personal, pieces, queries, scoring
from tablemill.llm.common import table
from tablemill.llm.wordhash import WordHashes

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def personal_spans(text: str | None) -> list[tuple[int, str, int]]:
    text, out = text or "", []
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    checks = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(x) <= 255 for x in m[0].split("."))),
        "card": (CARD, lambda m: 12 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (PHONE, lambda m: 9 <= len(digits(m)) <= 15),
    }
    for kind, (pattern, good) in checks.items():
        out += [(m.start(), kind, m.end()) for m in pattern.finditer(text) if good(m)]
    order = list(checks)
    return sorted(out, key=lambda s: (s[0], order.index(s[1])))


@pytest.mark.parametrize("text", ["a@b@c.d", "x..y@z.co.uk!", "1.2.3.4.5.6.7.8", "999.1.1.1", "4111-1111 1111 1111 4", "+1 (555) 123-4567.", "é@a.b ü4111111111111111", "a@b.c@d.e", "+12", "0000 0000 0000"])
def test_base_spans_of_odd_texts(text):
    got = [(s["start"], s["kind"], s["end"]) for s in personal.spans_of(text, {}) if s["base"]]
    assert got == personal_spans(text)


def test_personal_base(spark):
    docs = table(spark, SMALL, "documents")
    rows = {r.doc_id: r for r in queries.op1_personal(spark, SMALL).collect()}
    assert len(rows) == docs.count()
    for d in docs.select("doc_id", "text").collect():
        want, r = personal_spans(d.text), rows[d.doc_id]
        text = ",".join(f"{k}:{s}:{e}" for s, k, e in want)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in want) for x in personal.KINDS]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_weak_labels_are_learnt(spark):
    """Written-out addresses that agree with their context are added; order numbers are not."""
    texts = [f"please mail bob{i}(at)site.com today, ip 10.0.0.{i % 200}, mail bob{i}@site.com" for i in range(200)] + [f"order 4111 1111 1111 {1000 + i} was sent" for i in range(200)]
    docs = docs_of(spark, texts, null_id=False)
    found = personal.find(docs, personal.train(docs)).collect()
    extra = Counter(s.kind for r in found for s in r.spans if not s.base)
    assert extra["email"] >= 200 and extra["card"] == 0


def test_failing_cards_of_the_documents_are_rejected(spark):
    """`documents` holds secrets, and 16-digit runs that fail the check of cards."""
    docs = table(spark, f"{DATA}/sf0.01", "documents")
    model = personal.train(docs)
    n = {r.kind: r for r in personal.report(docs, model).collect()}
    assert n["card"].base > 0 and n["card"].rejected > 0 and n["card"].added == 0
    assert n["secret"].added > 0 and all(r.base + r.added + r.rejected >= 0 for r in n.values())
    for r in personal.find(docs, model, keep=("doc_id", "text")).collect():
        own = [s for s in r.spans if s.kind == "card"]
        assert all(personal.luhn(personal.digits_of(r.text[s.start : s.end])) for s in own)


def test_context_of_four_languages(spark):
    said = ["card", "Karte", "carte", "tarjeta"]
    for w in said:
        text = f"{w} 4111 1111 1111 1112"
        (c,) = personal.candidates(text)
        assert personal.votes(text, c)[2] == 1
    text = "die Bestellung 4111 1111 1111 1112"
    assert personal.votes(text, personal.candidates(text)[0])[2] == -1


def test_added_spans_on_held_out_documents(spark):
    """Secrets in several forms, national numbers and written-out addresses among codes, checksums,
    versions and failing cards: what is added on documents that trained nothing."""
    import random

    r = random.Random(9)
    run = lambda n, letters="0123456789abcdef": "".join(r.choice(letters) for _ in range(n))
    yes = [
        lambda: ("password=", run(16), ""), lambda: ('token = "', run(40), '"'), lambda: ("API_KEY: ", run(24, "ABCDEFGHJK0123456789"), ""), lambda: ("the secret ", run(32), ""),
        lambda: ("call ", f"({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}", ""), lambda: ("mail ", f"ann{r.randint(1, 99)}(at)site.com", ""),
    ]
    no = [
        lambda: ("sku=", f"AB{r.randint(10_000, 99_999)}", ""), lambda: ("commit ", run(40), ""), lambda: ("version=", f"1.{r.randint(0, 9)}.{r.randint(0, 9)}b4", ""), lambda: ("order id: ", f"A{r.randint(100_000, 999_999)}", ""),
        lambda: ("order ", f"4111 1111 1111 {r.choice(['1112', '2111', '9999'])}", ""), lambda: ("checksum md5=", run(32), ""),
    ]
    texts, truth = [], {}
    for i in range(600):
        parts, at, spans = [], 0, set()
        for _ in range(3):  # some base spans besides
            good = r.random() < 0.5
            before, value, after = r.choice(yes if good else no)()
            before = f"{prose(r.randint(0, 9999), 6)} {before}"
            if good:
                spans.add((at + len(before), at + len(before) + len(value)))
            parts.append(before + value + after + " ")
            at += len(parts[-1])
        texts.append("".join(parts) + (f"reply to bob{i}@site.org" if i % 4 < 2 else ""))
        truth[i + 1] = spans
    docs = docs_of(spark, texts, null_id=False).distinct()
    model = personal.train(docs.where("doc_id % 2 = 0"))
    got = {d.doc_id: {(s.start, s.end) for s in d.spans if not s.base} for d in personal.find(docs.where("doc_id % 2 = 1"), model).collect()}
    right = sum(len(s & truth[i]) for i, s in got.items())
    precision, recall = right / sum(map(len, got.values())), right / sum(len(truth[i]) for i in got)
    print("held-out precision", precision, "recall", recall)
    assert precision >= 0.9 and recall >= 0.9


def item_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def test_contamination(spark):
    docs, bench = table(spark, SMALL, "documents").collect(), table(spark, SMALL, "benchmark").collect()
    windows: dict[tuple, set] = {}
    for b in bench:
        w = item_words(b.text)
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(str(b.item_id))
    sizes = {len(w) for w in windows}
    got = {r.doc_id: r for r in queries.op5_decontaminate(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d in docs:
        w, hit, items = item_words(d.text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        r = got[d.doc_id]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(items), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def contaminated(docs: list[tuple[int, str | None]], bench: list[tuple[int | None, str | None]], size: int = 10) -> dict[int, tuple]:
    windows: dict[tuple, set] = {}
    for i, t in bench:
        w = item_words(t)
        for k in range(max(1, len(w) - size + 1)) if w and i is not None else ():
            windows.setdefault(tuple(w[k : k + size]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w, hit, items = item_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                found = windows.get(tuple(w[i : i + n]))
                if found:
                    hit.update(range(i, i + n))
                    items |= found
        out[d] = (hit, sorted(items))
    return out


@pytest.mark.parametrize("filter_bits", [1 << 15, 1 << 23])
def test_contamination_by_many_items_and_a_hot_token(spark, monkeypatch, filter_bits):
    """600 items, so that a small filter passes most words; windows of one word over and over, whose
    rarest token stands in every document; short items; windows at both ends of a text."""
    monkeypatch.setattr(contamination, "FILTER_BITS", filter_bits)
    bench = [(i, prose(i, 14 + i % 5, 5_000)) for i in range(600)] + [(700, "hot " * 12), (701, "hot"), (702, "hot cold"), (703, None), (704, " ,;"), (None, "hot hot"), (705, prose(5, 30, 5_000))]
    texts = [f"{prose(5, 19, 5_000)} {'hot ' * (9 + i % 4)}{prose(i, 40, 5_000)}" for i in range(120)] + [bench[7][1], "x " + bench[8][1], bench[9][1] + " y", None, "", "cold hot"]
    docs = docs_of(spark, texts, null_id=False).distinct()
    items = spark.createDataFrame(bench, "item_id long, text string")
    want = contaminated(list(enumerate(texts, 1)), bench)
    for r in contamination.find(docs, items).collect():
        got = {k for s in r.spans for k in range(s.start, s.end)}
        assert (got, r.items) == want[r.doc_id], r.doc_id
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_contamination_names_no_result_column(spark):
    with pytest.raises(ValueError):
        contamination.find(docs_of(spark, ["a"]), table(spark, SMALL, "benchmark"), keep=("items",))


def removed_words(docs: list[tuple[int, list[str]]], size: int = 20) -> dict[int, tuple[int, str]]:
    first: dict[tuple, tuple[int, int]] = {}
    for i, w in sorted(docs):
        for s in range(len(w) - size + 1):
            first.setdefault(tuple(w[s : s + size]), (i, s))
    out = {}
    for i, w in docs:
        gone = set()
        for s in range(len(w) - size + 1):
            if first[tuple(w[s : s + size])] < (i, s):
                gone.update(range(s, s + size))
        out[i] = (len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def test_passages(spark):
    docs = [(r.doc_id, words_of(r.text)) for r in table(spark, SMALL, "documents").collect()]
    want = removed_words(docs)
    got = {r.doc_id: r for r in queries.op6_passages(spark, SMALL).collect()}
    assert len(got) == len(docs)
    for i, w in docs:
        assert (got[i].n_words, got[i].n_removed) == (len(w), want[i][0])
        assert got[i].kept_sha256 == hashlib.sha256(want[i][1].encode()).hexdigest()


def test_passages_that_repeat_inside_a_text_and_at_shifted_places(spark):
    base = [f"a{i}" for i in range(60)]
    texts = [base + base, base[7:40] + ["x"] + base[30:], ["z"] * 50, base[1:21], ["q", *base[1:20]], ["a", "b"] * 40]
    texts = [" ".join(t) for t in texts]
    docs = docs_of(spark, texts, null_id=False).limit(len(texts))
    want = removed_words([(i, words_of(t)) for i, t in enumerate(texts, 1)])
    words = {i: words_of(t) for i, t in enumerate(texts, 1)}
    for r in passages.find(docs).collect():
        assert r.kept == want[r.doc_id][1], r.doc_id
        for f in r.factors:
            assert words[r.doc_id][f.start : f.end] == words[f.source][f["at"] : f["at"] + f.end - f.start], r
            assert (f.source, f["at"]) < (r.doc_id, f.start)
        assert all(a.end <= b.start for a, b in zip(r.factors, r.factors[1:]))


def removed_of_rows(rows: list[tuple[int, list[str]]], size: int = 20) -> list[tuple[int, str]]:
    """As above, for rows that may share ids: (id, kept words) of each row."""
    first: dict[tuple, tuple[int, int]] = {}
    for i, w in rows:
        for s in range(len(w) - size + 1):
            window = tuple(w[s : s + size])
            first[window] = min(first.get(window, (i, s)), (i, s))
    out = []
    for i, w in rows:
        gone = {k for s in range(len(w) - size + 1) if first[tuple(w[s : s + size])] < (i, s) for k in range(s, s + size)}
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def shared_ids() -> list[list[tuple[int, list[str]]]]:
    a, b, c = ([f"{x}{i}" for i in range(n)] for x, n in (("a", 60), ("b", 80), ("c", 40)))
    r = random.Random(4)
    parts = [[f"p{k}x{i}" for i in range(r.randrange(10, 60))] for k in range(6)]
    mixed = [(r.randrange(4), [w for p in r.choices(parts, k=r.randrange(1, 6)) for w in p[r.randrange(5) :]]) for _ in range(60)]
    return [
        [(1, a), (2, ["q", *a[:30], "r", "r", "r"]), (2, "short text only".split()), (2, b)],
        [(1, a), (2, a), (2, b)],
        [(2, a), (2, a), (2, [*a[:40], *c]), (2, ["x", *a]), (3, c), (1, a[5:30])],
        [(1, [*a[:25], "x", *b]), (2, [*a, *b]), (2, [*a, *c]), (2, a[:30]), (1, a[:30])],
        mixed,
    ]


@pytest.mark.parametrize("rows", shared_ids(), ids=range(5))
def test_passages_of_rows_that_share_ids(spark, rows):
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(4)
    got = passages.find(docs).collect()
    assert sorted((r.doc_id, r.kept) for r in got) == removed_of_rows(rows)


def test_a_factor_runs_through_blocks_and_is_the_furthest(spark):
    base = [f"a{i}" for i in range(400)]
    texts = [" ".join(t) for t in (base, base[:150], [*base[100:300], "new", *base[90:120]])]
    docs = docs_of(spark, texts, null_id=False).distinct()
    got = {r.doc_id: [tuple(f) for f in r.factors] for r in passages.find(docs).collect()}
    assert got == {1: [], 2: [(0, 150, 1, 0)], 3: [(0, 200, 1, 100), (201, 231, 1, 90)]}


def shingles(text: str | None) -> set:
    w = words_of(lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_components(docs: dict[int, set], at_least: int = 85) -> dict[int, int]:
    root = {i: i for i in docs}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    holders: dict[tuple, list[int]] = {}
    for i in sorted(docs):
        shared = Counter(j for s in docs[i] for j in holders.get(s, ()))
        for j, n in shared.items():
            if 100 * n >= at_least * (len(docs[i]) + len(docs[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in docs[i]:
            holders.setdefault(s, []).append(i)
    return {i: find(i) for i in docs}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_near_copies(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    docs = {r.doc_id: shingles(r.text) for r in table(spark, sf_dir, "documents").collect()}
    want = near_components(docs)
    got = queries.op7_near_copies(spark, sf_dir).collect()
    assert len(got) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(s), want[i], want[i] == i) for i, s in docs.items()}


def test_near_copies_of_many_variants(spark):
    """A large group whose members are mostly under the threshold of each other goes through the
    blocks; long chains are followed."""
    base = [f"b{i}" for i in range(80)]
    texts = []
    for i in range(150):
        w = list(base)
        w[(7 * i) % 80], w[(11 * i + 3) % 80] = f"x{i}", f"y{i % 9}"
        texts.append(" ".join(w))
    chain = [" ".join(f"c{j}" for j in range(3 * i, 3 * i + 100)) for i in range(40)]
    docs = docs_of(spark, texts + chain, null_id=False).distinct()
    want = near_components({i: shingles(t) for i, t in enumerate(texts + chain, 1)})
    assert {r.doc_id: r.component for r in nearcopies.find(docs, few=1).collect()} == want


def test_near_copies_of_documents_with_several_texts(spark):
    """An id with two unlike texts is one document: links of either text are its own."""
    a, b = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    rows = [(5, a), (5, b), (2, [*b, "z"]), (3, [*a, "z"]), (7, a), (8, [f"c{i}" for i in range(9)]), (9, []), (9, [*a, "y"])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {(r.doc_id, r.n_shingles): r.component for r in nearcopies.find(docs).collect()}
    assert got == {(5, 96): 2, (2, 97): 2, (3, 97): 2, (7, 96): 2, (8, 5): 8, (9, 0): 9, (9, 97): 2}


@pytest.mark.parametrize("part_rows", [3, 1_000])
def test_near_copies_of_one_text_in_parts(spark, monkeypatch, part_rows):
    """Many variants of one text, whose buckets and pivots are dealt in parts."""
    monkeypatch.setattr(nearcopies, "PART_ROWS", part_rows)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join([*base[: i % 120], f"x{i}", *base[i % 120 :]]) for i in range(60)]
    docs = docs_of(spark, texts, null_id=False).distinct()
    want = near_components({i: shingles(t) for i, t in enumerate(texts, 1)})
    assert {r.doc_id: r.component for r in nearcopies.find(docs).collect()} == want


def language_model(docs: list[tuple[int, str | None]]) -> dict[int, tuple]:
    texts = {i: [*words_of(lower(t)), "</s>"] for i, t in docs}
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for i in train for w in texts[i])
    n, v = sum(c.values()), len(c)
    z = n + v + 1
    name = lambda w: w if w in c else None
    two, three = Counter(), Counter()
    for i in train:
        x = ["<s>", *map(name, texts[i])]
        two.update(zip(x, x[1:]))
        three.update(zip(x, x[1:], x[2:]))
    out = {}
    for i, t in texts.items():
        base = score = 0.0
        x = ["<s>", *map(name, t)]
        for k, w in enumerate(t, 1):
            single = (c[w] + 1) / z
            before = len(train) if k == 1 else c[x[k - 1]]
            p = (two[x[k - 1], x[k]] + scoring.K2 * single) / (before + scoring.K2)
            if k > 1:
                p = (three[x[k - 2], x[k - 1], x[k]] + scoring.K3 * p) / (two[x[k - 2], x[k - 1]] + scoring.K3)
            base, score = base + math.log10(single), score + math.log10(p)
        out[i] = (i not in train, len(t), sum(c[w] > 0 for w in t), n, base, score)
    return out


def test_language_model(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    want = language_model(docs)
    got = queries.op8_language_model(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9)
        assert r.score == pytest.approx(w[5], rel=1e-9)
        assert r.score <= 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("block_bytes", [300, 5_000, 4_000_000])
def test_language_model_of_long_texts_in_any_blocks(spark, block_bytes):
    """Texts of many lanes, texts of one token, words unknown to the training texts."""
    texts = [prose(i, n, 300) for i, n in enumerate((0, 1, 2, 255, 256, 257, 600, 3_000, 40, 40, 512))] + [prose(3, 700, 90) + " never seen"]
    docs = docs_of(spark, [None, *texts], null_id=False).distinct()
    want = language_model(list(enumerate([None, *texts], 1)))
    for r in scoring.score(docs, learn=~queries.held_out(2, 7), block_bytes=block_bytes).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][1:4]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][4:], rel=1e-9)


def test_language_model_adds_to_one_after_every_state():
    """Over all words and the unknown one, whatever failure arcs a state needs. (Nothing follows
    the end of a text.)"""
    hashes, texts = WordHashes(), [b"a b c a b d", b"b a c", b"x y"]
    learn = np.array([True, True, False])
    words = [hashes.of(t.split()) for t in texts]
    keys = np.unique(np.concatenate([*words, [scoring.END]]))
    tokens = np.concatenate([np.searchsorted(keys, [*w, scoring.END]) for w in words])
    taught = np.bincount(tokens[: 7 + 4], minlength=len(keys))
    asked = scoring.packed(7, 7, keys, taught, 6)
    rows = pa.table(
        {
            "home": [7] * (1 + len(asked["part"])),
            "block": [7] * (1 + len(asked["part"])),
            "kind": [scoring.TEXTS] + [scoring.ASKED] * len(asked["part"]),
            "docs": [[1, 2, 3]] + [None] * len(asked["part"]),
            "sizes": [scoring.pressed(np.array([7, 4, 3], "<u4"))] + [None] * len(asked["part"]),
            "learn": [learn.tobytes()] + [None] * len(asked["part"]),
            "tokens": [scoring.pressed(tokens.astype("<u4"))] + [None] * len(asked["part"]),
            "part": [None, *asked["part"]],
            "keys": [None, *asked["keys"]],
        }
    )
    block = scoring.Block(rows, pa.table({"level": [1], "part": [0], "totals": [scoring.pressed(2 * taught.astype("<u8"))]}))
    block.learn2(), block.learn3()
    automaton = scoring.Automaton(block, scoring.Totals(11, int((taught > 0).sum()), 2))
    every = np.flatnonzero(np.append(taught > 0, True))
    ends = np.concatenate([np.flatnonzero(block.hashes == scoring.END), block.m + np.flatnonzero(block.hashes[block.two % block.m] == scoring.END)])
    for state in set(range(automaton.root + 1)) - set(ends.tolist()):
        targets, weights = automaton.step(np.full(len(every), state), every)
        assert (10**weights).sum() == pytest.approx(1)
        assert all(t == automaton.root or t < automaton.root for t in targets)


def test_language_model_keeps_pairs_of_rare_words(spark):
    """Words seen three times among 40,000 tokens still have bigrams of their own."""
    texts = ["left1 right1", "left1 right2"] + ["left1 right1 left2 right2"] * 3 + [" ".join(f"f{(i * j) % 97}" for j in range(200)) for i in range(1, 201)]
    docs = docs_of(spark, texts, null_id=False).distinct()
    got = {r.doc_id: r for r in scoring.score(docs, learn=docs.doc_id > 2).where("doc_id < 3").collect()}
    assert got[1].base_score == pytest.approx(got[2].base_score, rel=1e-12)
    assert got[1].score > got[2].score + 0.5


def test_pieces_equal_the_library(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.piece_model())
    texts = [t for t in odd_texts() if t is None or len(t) < 150_000] + ["  two  spaces   ", " " * 100 + "x", "▁already ▁marked", "a\nb\r\n\tc", "naïve café 日本語 🙂🙂 \u0000 ﻿", "1234567890" * 20, "aaaaaaaaaaaaaaaaaaaaaaaaaaa", "....----====", "Hello,world;good:bye", "<s> </s> <unk> <0x41>"]
    texts += [r.text for r in table(spark, SMALL, "documents").collect()]
    docs = docs_of(spark, texts)
    out = pieces.encode(docs, queries.piece_model(), keep=("doc_id", "text"), decode=True).withColumnRenamed("decoded", "said")
    for r in pieces.decode(out, queries.piece_model(), keep=("text", "ids", "said")).collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        assert bytes(r.ids) == b"".join(i.to_bytes(4, "little") for i in ids), r.text
        assert r.decoded == r.said == sp.decode(ids)


def test_decoding_of_any_ids_equals_the_library(spark):
    """Control, unknown and byte pieces anywhere, bytes that are no UTF-8, spaces in front."""
    import random

    import sentencepiece

    model = queries.piece_model()
    sp, r = sentencepiece.SentencePieceProcessor(model_file=model), random.Random(4)
    n = sp.get_piece_size()
    special = [i for i in range(n) if sp.is_control(i) or sp.is_unknown(i)]
    data = [i for i in range(n) if sp.is_byte(i)]
    spaces = [i for i in range(n) if set(sp.id_to_piece(i)) == {"▁"}]
    rows = [[], special, data, spaces[::-1], [data[-1], *spaces], sp.encode("é 日本 🙂")]
    rows += [[r.choice(r.choice((special, data, data, spaces, range(n)))) for _ in range(r.randint(1, 12))] for _ in range(400)]
    packed = [(i, b"".join(x.to_bytes(4, "little") for x in ids)) for i, ids in enumerate(rows)]
    df = spark.createDataFrame([*packed, (-1, None), (-2, (n + 5).to_bytes(4, "little"))], "doc_id long, ids binary")
    got = {x.doc_id: x.decoded for x in pieces.decode(df, model).collect()}
    assert got.pop(-1) == got.pop(-2) == ""
    for i, ids in enumerate(rows):
        assert got[i] == sp.decode(ids), ids
