"""Clustering, word encoding and ranked search: against their SQL, the library and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest
from fixtures import CLASHES, SMALL, docs_of, odd_texts
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemill.llm import audio, centroids, lexical, queries, wordbpe
from tablemill.llm.common import table

# --- clustering


def brute_clusters(rows: list[tuple], k: int, rounds: int) -> list[tuple]:
    """(key, cluster, distance) of kept rows, by plain integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    cs = [v for _, v in start]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups: dict[int, list] = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cs = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(cs)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept]


VECTORS = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType()))


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, VECTORS).select("*", *[F.lit(1).alias(c) for c in (*CLASHES, "key", "v", "cluster", "distance")])


@pytest.mark.parametrize("scale", [0.02, 0.3, 40_000.0])
def test_clusters_by_plain_integers(spark, scale):
    r = random.Random(3)
    base = [[r.gauss(0, scale) for _ in range(64)] for _ in range(9)]
    rows = [(i, [float(np.float32(x + r.gauss(0, scale / 3))) for x in base[r.randrange(9)]]) for i in range(160)]
    odd = [(500, None), (501, []), (502, [1.0] * 63), (503, [None] * 64), (504, [float("nan")] * 64), (505, [0.0] * 63 + [float("inf")]), (506, [0.0] * 64), (None, rows[0][1])]
    rows += odd + [rows[1]] * 120 + [(1, rows[2][1])]
    got = centroids.cluster(vectors_of(spark, rows), k=12, rounds=3).collect()
    want = brute_clusters(rows, 12, 3)
    assert sorted(map(repr, ((x.vec_id, x.cluster, x.distance) for x in got))) == sorted(map(repr, want))
    for x in got:
        assert x.cluster_inertia == sum(d for _, c, d in want if c == x.cluster) and x.inertia == sum(d for *_, d in want)


def test_clusters_of_few_and_no_vectors(spark):
    assert centroids.cluster(vectors_of(spark, [])).count() == 0
    assert centroids.cluster(vectors_of(spark, [(1, None)])).count() == 0
    got = centroids.cluster(vectors_of(spark, [(1, [0.5] * 64), (2, [0.5] * 64), (3, [1.0] * 64)])).collect()
    assert {(x.vec_id, x.distance) for x in got} == {(1, 0), (2, 0), (3, 0)} and len({x.cluster for x in got}) == 2


def test_vectors_too_large_raise(spark):
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(vectors_of(spark, [(1, [1e30] * 64)])).count()


def test_screening_never_loses_the_nearest_and_saves_work():
    r = np.random.default_rng(5)
    for spread in (1, 30, 2**27):
        v = np.clip(r.normal(size=(500, 64)) * spread, -(2**27), 2**27).astype(np.int64)
        c = v[:40] + r.integers(-1, 2, (40, 64))
        best, distance, exact = centroids.nearest(v, centroids.Compressed.of(v), c)
        apart = v[:, None, :] - c[None]
        whole = np.einsum("ijk,ijk->ij", apart, apart)
        assert (best == whole.argmin(axis=1)).all() and (distance == whole.min(axis=1)).all()
        _, bound = centroids.Compressed.of(v).bounds(c)
        assert (bound <= whole).all() and (spread == 1 or exact < 0.5 * whole.size)


# --- word encoding


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.word_vocabulary())


ODD = [
    "Hello, World's  don't  x'Sy '' 's 3.14 ²½", "<|endoftext|>a<|startoftext|><|", "é<|endoftext|>́e", "aaa aaaa aaaaa", "a\x1cb\x85c\xa0d\x1fe f​g",
    "ΣΑΣ İstanbul É é 가 각", "x" * 5000, "ab" * 3000, "Ⱥ Ⱦ ẞ ŉ ǰ", "日本語 😀👍🏽 \x00 �", "'ll'Ve", " \n", "1234567890 ١٢٣",
]


def test_words_equal_the_library_both_ways(spark, library):
    r = random.Random(1)
    texts = odd_texts() + ODD + ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x300), r.randrange(0x3000)])) for _ in range(80)) for _ in range(300)]
    docs = docs_of(spark, texts)
    got = wordbpe.encode(docs, queries.word_vocabulary(), keep=("doc_id", "text"), decode=True)
    for x in got.collect():
        want = library.encode(x.text or "", add_special_tokens=False).ids
        assert x.ids == want and x.decoded == library.decode(want, skip_special_tokens=False)
    again = wordbpe.decode(got.select("doc_id", "ids", F.col("decoded").alias("before")), queries.word_vocabulary(), keep=("before",)).collect()
    assert len(again) == len(texts) + 2 and all(x.before == x.decoded for x in again)


def test_words_of_every_character_below_the_limit(library):
    encoder = wordbpe.Encoder(wordbpe.vocabulary(queries.word_vocabulary()))
    texts = [f"a{chr(c)}1{chr(c)}#{chr(c)} {chr(c)}'s" for c in range(0x400)]
    assert [list(np.frombuffer(x, "<i4")) for x in encoder.encode(texts)] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_decoding_any_ids(spark, library):
    ids = [None, [], [None, 320, -1, 10**6, 49407, 49406, 0, 256], [5] * 1000]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], "doc_id long, ids array<int>")
    got = {x.doc_id: x.decoded for x in wordbpe.decode(rows, queries.word_vocabulary()).collect()}
    plain = [[x for x in own or [] if x is not None and 0 <= x < 10**6] for own in ids]
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(plain)}
    assert wordbpe.encode(rows.limit(0).withColumn("text", F.lit("x")), queries.word_vocabulary()).count() == 0


def by_definition(symbols: list[int], pairs: dict) -> list[int]:
    """One merge at a time: the lowest rank, the leftmost of it."""
    while True:
        found = min(((pairs[p][0], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in pairs), default=None)
        if found is None:
            return symbols
        i = found[1]
        symbols = [*symbols[:i], pairs[symbols[i], symbols[i + 1]][1], *symbols[i + 2 :]]


@pytest.mark.parametrize("seed", range(6))
def test_merge_rounds_by_definition(seed):
    """Random merge lists, also ones in which a product may merge earlier than its parts' pair."""
    r = random.Random(seed)
    vocab = {c: i for i, c in enumerate("abc")}
    listed = []
    while len(listed) < 12:
        a, b = r.choice(list(vocab)), r.choice(list(vocab))
        if (a, b) not in listed and len(a + b) < 7:
            listed.append((a, b))
            vocab.setdefault(a + b, len(vocab))
    if seed % 2:
        r.shuffle(listed)
    merges = wordbpe.merges_of(vocab, listed)
    pairs = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(listed)}
    words = [[r.randrange(3) for _ in range(r.randrange(1, 30))] for _ in range(200)] + [[0] * k for k in range(1, 12)]
    flat, n = wordbpe.merge_rounds(np.array([x for w in words for x in w], np.int64), np.array(list(map(len, words))), merges)
    ends = np.cumsum(n)
    assert [flat[e - k : e].tolist() for e, k in zip(ends, n)] == [by_definition(w, pairs) for w in words]


def test_words_query(spark, library):
    got = {x.doc_id: x for x in queries.op12_words(spark, SMALL).collect()}
    rows = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for x in rows:
        ids = library.encode(x.text or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        assert tuple(got[x.doc_id]) == (x.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest())


# --- ranked search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_search(docs: list[tuple], items: list[tuple], best: int = 10) -> list[tuple]:
    lower = lambda t: (t or "").encode().lower().decode()
    held = [(d, TERM.findall(lower(t))) for d, t in docs]
    held = [(d, w) for d, w in held if w]
    n, total = len(held), sum(len(w) for _, w in held)
    df: dict[str, int] = {}
    counts = []
    for _, w in held:
        tf: dict[str, int] = {}
        for x in w:
            tf[x] = tf.get(x, 0) + 1
        counts.append(tf)
        for x in tf:
            df[x] = df.get(x, 0) + 1
    out = []
    for item, t in items:
        scored = []
        for (d, w), tf in zip(held, counts):
            m = 100 - 90 + 90 * len(w) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1_000_000_000 * tf[x] // (1000 * tf[x] + 8 * m)) for x in set(TERM.findall(lower(t))) if x in tf)
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, i, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=repr)


def found(spark, docs, items, **kw) -> list[tuple]:
    n, total = lexical.statistics(docs)
    lists = lexical.materialize(lexical.index(docs, n, total), "index")
    return sorted((tuple(x) for x in lexical.search(lists, items, n, total, **kw).select("item_id", "rank", "doc", "score").collect()), key=repr)


def some_docs(seed: int, n: int) -> list[tuple]:
    r = random.Random(seed)
    texts = [" ".join(f"W{int(500 * r.random() ** 3)}" for _ in range(int(5 + 200 * r.random() ** 3))) for _ in range(n)]
    texts += texts[:3] * 20 + odd_texts()
    return [(r.randrange(4 * n) if r.random() < 0.95 else None, t) for t in texts]


@pytest.mark.parametrize("sizes", [(32 << 20, 1 << 16, 128), (20_000, 50, 4), (1, 1, 1)])
def test_search_by_brute_force(spark, sizes, monkeypatch):
    """Shards and blocks of any size, ties, repeats, null ids and texts, items of all kinds."""
    for name, v in zip(("SHARD_BYTES", "SHARD_DOCS", "BLOCK"), sizes):
        monkeypatch.setattr(lexical, name, v)
    docs = some_docs(7, 300 if sizes[0] > 1 else 40)
    r = random.Random(8)
    items = [(i, " ".join(f"w{int(500 * r.random() ** 2)}" for _ in range(r.randrange(1, 40)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "!!"), (103, "nowhere"), (104, "w0"), (104, "w0"), (None, "w1 w1 W1"), (105, docs[0][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").select("*", *[F.lit(1).alias(c) for c in (*CLASHES, "term", "shard")]).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("row", F.lit(1)).withColumn("block", F.lit(1))
    assert found(spark, df, asked) == brute_search(docs, items)


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 3)
    docs, items = some_docs(9, 60), [(i, f"w{i} w{2 * i} w0") for i in range(10)]
    got = found(spark, spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string").coalesce(1), best=4)
    assert got == brute_search(docs, items, 4)


def test_search_of_empty_tables(spark):
    docs, items = docs_of(spark, ["a b"], null_id=False), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert found(spark, docs.limit(0), items) == found(spark, docs, items.limit(0)) == []
    assert len(found(spark, docs, items)) == 1


def test_blocks_below_the_threshold_stay_closed():
    """A document that holds all terms ten times over closes the blocks of common terms."""
    docs = [(i, b"common filler text" + b" pad" * (i % 40)) for i in range(20_000)] + [(20_000 + i, b"rare common " * 3) for i in range(12)]
    n, total = len(docs), sum(len(lexical.terms_of(t)) for _, t in docs)
    batches = list(lexical.shard_rows(0, docs, n, total))
    rows = [r for b in batches for r in b.to_pylist()]
    shard = lexical.Shard(rows[0], n, total)
    for r in rows[1:]:
        shard.lists[r["term"]] = lexical.Postings(lexical.weight_of(n, r["n"]), *(r[c] for c in ("n", "last", "tops", "ends", "data")))
    best = lexical.Best(10)
    shard.search(["common", "rare"], best)
    assert [d for _, d in best.found] == list(range(20_000, 20_010))
    assert shard.lists["common"].open.sum() <= 4 < len(shard.lists["common"].open)


def test_numbers_pack_and_unpack():
    r = np.random.default_rng(1)
    values = np.concatenate([r.integers(0, 2**k, 200) for k in range(1, 40)] + [[0, 127, 128, 2**32]])
    data, place = lexical.packed(values)
    assert (lexical.unpacked(data) == values).all() and (np.diff(np.append(place, len(data))) >= 1).all()


# --- recordings


def test_damaged_and_long_recordings(spark):
    """Odd bytes at the end, no rate, no channels, cut headers; and half an hour in bounded memory."""
    import tracemalloc

    good = audio.wav([0.1, -0.2, 0.3, 0.2] * 8, 4000, 256)
    at = good.index(b"fmt ") + 8
    no_rate, no_channels = bytearray(good), bytearray(good)
    no_rate[at + 4 : at + 8] = no_channels[at + 2 : at + 4] = bytes(4)[:4]
    no_channels = bytearray(good)
    no_channels[at + 2 : at + 4] = bytes(2)
    cases = [good, good + b"x", good[:-1], bytes(no_rate), bytes(no_channels), good[:20], good[:50], b"RIFF", None, b""]
    rows = spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(cases)], "vec_id long, audio binary")
    got = {r.vec_id: r.prints for r in audio.fingerprints(rows, "vec_id", "audio").collect()}
    assert got[0] and got[1] == got[0] and got[2] and all(got[i] is None for i in range(3, 10))
    stored = np.tile(audio.pcm(good)[0], (4_900, 1))[: 22_050 * 1_800]
    tracemalloc.start()
    image = audio.chroma(stored, 22_050)
    assert tracemalloc.get_traced_memory()[1] < 250e6 and len(image) == (len(stored) - audio.FRAME) // audio.HOP + 1
    tracemalloc.stop()
    whole = np.concatenate([audio.chroma(stored[: 5_000 * audio.HOP + audio.FRAME], 22_050)])
    assert np.allclose(whole, image[: len(whole)])
