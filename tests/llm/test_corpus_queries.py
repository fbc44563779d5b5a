"""Corpus queries against their SQL, models on held-out rows, edge cases and the pipeline."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from compare import same_rows
from fixtures import CLASHES, SMALL, docs_of, odd_texts
from pyspark.sql import functions as F

import corpus_pipeline
from tablemill.llm import audio, contamination, hosts, nearcopies, passages, personal, pieces, quality, queries, replies, scoring, stages
from tablemill.llm.common import table


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_its_sql(spark, name):
    same_rows(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), queries.ORACLE_SQL[name], "sf0.01")


def test_registered(spark):
    import __spark_entry__ as e

    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(e.queries())


# --- quality classifier


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op4_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").select("doc_id", "score", "predicted", "quality").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in scored)
    good, bad = np.array([r.score for r in scored if r.quality == 1]), np.array([r.score for r in scored if r.quality == 0])
    order = np.argsort(np.argsort(np.concatenate([good, bad])))
    auc = (order[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))
    print("held-out AUC", auc, "accuracy", np.mean([r.predicted == r.quality for r in scored]))
    assert auc > 0.85
    assert np.mean(good >= queries.LEAST_QUALITY) > 0.9


def test_quality_query_scores_by_definition(spark):
    """Every row of the query against the sum over all pairs of a text's features."""
    docs = table(spark, SMALL, "documents")
    m = quality.train(docs, table(spark, SMALL, "labels"), learn=~queries.held_out(0, 5))
    got = {r.doc_id: r for r in queries.op4_quality(spark, SMALL).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for d in rows:
        i, x = quality.Features().of((d.text or "").encode())
        pairs = m.v[i] @ m.v[i].T * np.outer(x, x)
        raw = m.w0 + m.w[i] @ x + np.triu(pairs, 1).sum()
        r = got[d.doc_id]
        assert r.score == pytest.approx(1 / (1 + np.exp(-raw)), abs=1e-9)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 5 == 0)


def test_pairwise_sum_identity():
    m = quality.Machine(0.3)
    m.w = np.random.default_rng(1).normal(size=m.w.shape)
    m.v = np.random.default_rng(2).normal(size=m.v.shape)
    i, x = quality.Features().of("Some words, some WORDS!\nAnd a line 12".encode())
    pairs = sum(m.v[i[a]] @ m.v[i[b]] * x[a] * x[b] for a in range(len(i)) for b in range(a))
    assert m.raw(i, x, np.array([0]))[0] == pytest.approx(0.3 + m.w[i] @ x + pairs)


def test_quality_without_labels(spark):
    docs = docs_of(spark, odd_texts())
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(docs, quality.train(docs, none)).collect()} == {0.5}


# --- hosts


def test_hosts_of_odd_urls(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET:80/en/x?q#f", "x://://y/", "https://example.org", "http://sub.example.com/de/a", "http://org/fr/", "ftp://net", "http://u@b.co.uk/a?b/c", "http://é.com#x/y", "a\nb://h\n/p"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("n", F.lit(0))
    labels = spark.createDataFrame([(3, 1), (3, 1), (None, 0), (5, None)], "doc_id long, quality int")
    got = {r.page_id: r for r in hosts.judge(pages, labels).collect()}

    def split(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
        return host.encode().lower().decode(), tail[:end]

    assert {i: (r.host, r.path) for i, r in got.items()} == {i: split(u) for i, u in enumerate(urls)}
    assert [got[i].rule for i in (3, 5, 6, 7, 8)] == [None, None, "example.com/de/", "org/fr/", None]
    assert got[7].verdict == "allow" and got[6].verdict == "block"


def test_domains_and_suffixes(spark):
    urls = ["http://a.b.co.uk:80/", "http://u@x.y.org/", "http://10.0.0.1:8080/", "http://10.0.0.2/", "http://single/", "http:///"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    got = [tuple(r) for r in df.orderBy("i").select(*hosts.parts_of(hosts.host_of(F.col("url")))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("y.org", "org"), ("10.0.0.1", ""), ("10.0.0.2", ""), ("single", "single"), ("", "")]


def test_a_bad_host_is_blocked_and_a_good_one_is_not(spark):
    pages = spark.range(400).selectExpr("id AS page_id", "concat('http://', CASE WHEN id % 2 = 0 THEN 'good.com' ELSE 'bad.com' END, '/') AS url")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(CASE WHEN id % 2 = 0 THEN id % 20 <> 0 ELSE id % 10 = 1 END AS INT) AS quality")
    verdicts = {(r.host, r.verdict) for r in hosts.judge(pages, labels).collect()}
    assert verdicts == {("good.com", "allow"), ("bad.com", "block")}


def test_hosts_take_empty_tables_repeats_and_long_urls(spark):
    schema = "page_id long, url string"
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert hosts.judge(spark.createDataFrame([], schema), none).count() == 0
    long = "http://" + "a." * 50_000 + "org/fr/" + "x" * 100_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, "http://org/fr/"), (2, "http://net/"), (None, "http://a.net/")], schema)
    for labels in (none, spark.createDataFrame([(1, 0), (1, 0), (2, 1)], none.schema)):
        got = hosts.judge(pages, labels).collect()
        assert len(got) == 5 and sorted((r.rule, r.verdict) for r in got) == [("net/", "block")] * 2 + [("org/fr/", "allow")] * 3


# --- replies

TALK = [
    (1, 0, "user", "Good morning to all of you\nsecond line here"),
    (1, 1, "bot", "> Good morning to all of you\nmy own answer"),
    (1, 2, "user", ">> good   MORNING to all of you\n> my own answer\nthanks a lot"),
    (1, 4, "user", "after a gap"),
    (2, 0, "user", "> thanks a lot\nfrom another talk"),
    (3, 0, None, None),
    (3, 1, "bot", ""),
    (None, 0, "bot", "> my own answer"),
    (3, 1, "bot", ""),
]


def test_threads(spark):
    messages = spark.createDataFrame(TALK, "conv_id long, turn long, role string, text string").select("*", *[F.lit(1).alias(c) for c in CLASHES])
    got = {(r.conv_id, r.turn): r for r in replies.threads(messages).collect()}
    assert got[1, 2].own_text == "thanks a lot" and got[1, 2].n_quoted == 2 and got[1, 2].n_linked == 2 and got[1, 2].max_level == 2
    assert (got[1, 1].parent_conv, got[1, 1].parent_turn) == (1, 0)
    assert (got[1, 2].parent_turn, got[1, 2].root_turn, got[1, 2].depth) == (1, 0, 2)
    assert got[1, 4].parent_conv is None and got[1, 4].depth == 0
    assert (got[2, 0].parent_conv, got[2, 0].parent_turn, got[2, 0].root_conv, got[2, 0].depth) == (1, 2, 1, 3)
    assert got[3, 0].own_text is None and got[3, 1].own_text == "" and got[3, 1].depth == 1
    assert got[None, 0].n_quoted == 1 and got[None, 0].depth == 0
    assert replies.threads(messages).count() == len(TALK)
    assert replies.threads(messages.limit(0)).count() == 0


def test_threads_link_short_lines_and_passages(spark):
    talk = [(1, 0, "u", "Yes.\nx = 1"), (1, 1, "u", "roses\nred\n\nviolets"), (1, 2, "u", "red"), (1, 3, "u", "> x = 1\n>\nok"), (1, 4, "u", "> roses\n> red\n"), (1, 5, "u", "\u4eca\u65e5\u306f")]
    talk += [(1, 6, "u", "a\n> \u4eca\u65e5\u306f"), (2, 0, "u", "> Yes.\nhot stranger"), (3, 0, "u", "> Roses\n> red\nfrom elsewhere")]
    got = {(r.conv_id, r.turn): r for r in replies.threads(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string")).collect()}
    assert [(got[1, t].n_linked, got[1, t].parent_turn, got[1, t].depth) for t in (3, 4, 6)] == [(1, 0, 1), (2, 1, 2), (1, 5, 4)]
    assert (got[2, 0].n_linked, got[2, 0].parent_conv) == (0, None)
    assert (got[3, 0].n_linked, got[3, 0].parent_conv, got[3, 0].parent_turn) == (2, 1, 1)


def test_replies_use_no_python(spark):
    plan = replies.threads(table(spark, SMALL, "conversations"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan


# --- audio


def tune(seed: int, n: int = 64) -> list[float]:
    return np.random.default_rng(seed).uniform(-0.5, 0.5, n).tolist()


def test_audio_finds_cut_and_noisy_copies(spark):
    tunes = {i: tune(i) for i in range(40)}
    vectors = [(i, v) for i, v in tunes.items()]
    vectors += [(100 + i, tunes[i][8:]) for i in range(0, 40, 4)] + [(200 + i, tunes[i]) for i in range(0, 40, 8)]
    vectors += [(900, None), (901, []), (902, [0.1])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("prints", F.lit("clash"))
    prints = audio.fingerprints(audio.rendered(df), "vec_id", "audio")
    assert {r.vec_id for r in prints.where("prints is null").collect()} == {900, 901, 902}
    found = {(r.query, r.match): r for r in audio.search(prints, prints.where("vec_id < 40"), "vec_id").collect()}
    for i in range(0, 40, 4):
        assert (i, 100 + i) in found and found[i, 100 + i].error < 0.05
        assert found[i, 100 + i].offset == -8 * 256 // audio.HOP
    assert all(m % 100 == q for q, m in found)
    assert {r.rep for r in audio.classes(prints, "vec_id").collect()} == {*range(40), *range(100, 140, 4)}


def test_audio_query_equals_brute_force(spark, tmp_path):
    """Cut and noisy copies of all vectors of a table beside them: every pair of the query with at most MOST_ERRORS
    at an offset that leaves half of the shorter recording."""
    random = np.random.default_rng(8)
    vectors = [(r.vec_id, np.array(r.embedding, float)) for r in table(spark, SMALL, "embeddings").orderBy("vec_id").limit(60).collect()]
    # a tenth of the notes another one, four notes fewer
    rows = [(i, v.tolist()) for i, v in vectors]
    for i, v in vectors:
        noisy = np.where(random.random(len(v)) < 0.1, random.uniform(-0.5, 0.5, len(v)), v)
        rows.append((i + 1000, noisy[i % 5 :].tolist()))
    path = f"file://{tmp_path}"
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    df.write.parquet(f"{path}/embeddings.parquet")
    prints = {r.vec_id: np.frombuffer(r.prints, "<u4") for r in audio.fingerprints(audio.rendered(df), "vec_id", "audio").collect()}
    got = {(r.vec_id, r.match_id) for r in queries.op10_audio(spark, path).collect() if r.match_id is not None}
    want = set()
    for q in [i for i in prints if i % 20 == 0]:
        for m in prints:
            x, y = prints[q], prints[m]
            whole = min(len(x), len(y))
            near = [(e, n) for e, n in (audio.errors(x, y, o) for o in range(-len(x) + 1, len(y))) if 2 * n >= whole and e <= audio.MOST_ERRORS]
            if q != m and near:
                want.add((q, m))
    assert len(want) >= 5 and len(got & want) >= 0.9 * len(want)
    for q, m in got:
        assert min(audio.errors(prints[q], prints[m], o)[0] for o in range(-len(prints[q]) + 1, len(prints[m]))) <= audio.MOST_ERRORS


def test_audio_query_returns_every_match_and_all_members(spark, tmp_path):
    """20 and 33 are equal, 40 is equal to 7 and has two cut copies."""
    vectors = [(20, tune(1)), (33, tune(1)), (7, tune(2)), (40, tune(2)), (41, tune(2)[8:]), (42, tune(2)[:56]), (60, tune(3)), (61, None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    rows = queries.op10_audio(spark, f"file://{tmp_path}").collect()
    assert {(r.vec_id, r.class_id) for r in rows} == {(20, 20), (33, 20), (7, 7), (40, 7), (41, 41), (42, 42), (60, 60), (61, None)}
    matches = {(r.vec_id, r.match_id): r for r in rows if r.match_id is not None}
    assert set(matches) == {(20, 20), (40, 7), (40, 41), (40, 42)} and len(rows) == 10
    assert matches[20, 20].bit_error == 0 and matches[40, 41].match_offset == -16 and matches[40, 42].match_offset == 0
    assert {r.vec_id: r.n_matches for r in rows} == {20: 1, 33: 0, 7: 0, 40: 3, 41: 0, 42: 0, 60: 0, 61: 0}


def test_audio_takes_empty_tables_and_repeats(spark):
    """No recordings; a row twice; an id with two recordings; one note for a long time."""
    schema = "vec_id long, embedding array<double>"
    none = audio.fingerprints(audio.rendered(spark.createDataFrame([], schema)), "vec_id", "audio")
    assert none.count() == 0 and audio.search(none, none, "vec_id").count() == 0
    rows = [(1, tune(1)), (1, tune(1)), (2, tune(2)), (2, tune(3)), (3, tune(3)[8:]), (4, [0.1] * 600), (5, [0.1] * 500), (None, tune(1))]
    prints = audio.fingerprints(audio.rendered(spark.createDataFrame(rows, schema)), "vec_id", "audio")
    assert prints.count() == len(rows)
    found = {(r.query, r.match) for r in audio.search(prints, prints.where("vec_id in (2, 5)"), "vec_id").collect()}
    assert (2, 3) in found and (5, 4) in found and not {(1, 2), (2, 4)} & found


def test_audio_recall_at_most_errors(spark):
    """Copies with some notes changed and cut at the front, against brute force over all offsets that leave half
    of the shorter recording: in each band of errors up to MOST_ERRORS, and up to 0.3 by thorough landmarks."""
    random = np.random.default_rng(5)
    vectors = []
    for i in range(120):
        copy = np.array(tune(i))
        changed = random.random(64) < (0.02, 0.05, 0.1, 0.15, 0.2, 0.3)[i % 6]
        copy[changed] = random.uniform(-0.5, 0.5, changed.sum())
        vectors += [(i, tune(i)), (1000 + i, copy[i % 5 :].tolist())]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    rows = audio.fingerprints(audio.rendered(df), "vec_id", "audio").collect()
    bits = {r.vec_id: np.unpackbits(np.frombuffer(r.prints, np.uint8)).reshape(-1, 32) * np.float32(2) - 1 for r in rows}
    prints = spark.createDataFrame(rows, "vec_id long, prints binary")
    want, others = {}, sorted(bits)
    for q in range(120):
        for m in others[120:]:
            a, b = bits[q], bits[m]
            for o in range(-len(a) + 1, len(b)):
                lo, hi = max(0, -o), min(len(a), len(b) - o)
                if 2 * (hi - lo) >= min(len(a), len(b)):
                    error = (1 - np.vdot(a[lo:hi], b[lo + o : hi + o]) / (32 * (hi - lo))) / 2
                    if error <= 0.3:
                        want[q, m] = min(error, want.get((q, m), 1))
    bands = ((0, 0.1), (0.1, 0.2), (0.2, 0.25), (0.25, 0.3))
    for marks, most in ((audio.APART, audio.MOST_ERRORS), (audio.THOROUGH, 0.3)):
        found = {(r.query, r.match) for r in audio.search(prints, prints.where("vec_id < 1000"), "vec_id", most, marks=marks).collect()}
        for low, high in bands:
            some = [p for p, e in want.items() if low < e <= high]
            print("errors", low, high, "pairs", len(some), "found", sum(p in found for p in some))
            assert high > most or sum(p in found for p in some) >= 0.9 * len(some)
        print("matches beside", len(found - set(want)))
    assert len(want) >= 80


# --- edge cases of all operators


def operators(spark, docs):
    labels = spark.createDataFrame([(1, 0), (1, 1), (6, 1), (None, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, None), (2, ""), (3, "one"), (None, "a b"), (4, "A, b c D")], "item_id long, text string").withColumn("i", F.lit(0))
    return {
        "personal": personal.find(docs, personal.train(docs)),
        "quality": quality.score(docs, quality.train(docs, labels)),
        "contamination": contamination.find(docs, bench),
        "passages": passages.find(docs),
        "nearcopies": nearcopies.find(docs),
        "scoring": scoring.score(docs, learn=~queries.held_out(2, 7)),
        "pieces": pieces.encode(docs, queries.piece_model()),
    }


def test_operators_take_odd_rows(spark):
    docs = docs_of(spark, odd_texts())
    n = docs.count()
    for name, out in operators(spark, docs).items():
        assert out.count() == n, name
    found = {r.doc_id: r for r in operators(spark, docs)["contamination"].collect()}
    assert found[4].items == ["3"] and found[5].items == ["4"] and found[1].items == []
    near = {r.doc_id: r for r in nearcopies.find(docs).collect()}
    assert near[7].component == 6 and near[1].component == 1 and near[None].component is None and near[None].kept
    assert near[11].component == 10


def test_operators_take_empty_tables(spark):
    docs = docs_of(spark, odd_texts()).limit(0)
    for name, out in operators(spark, docs).items():
        assert out.count() == 0, name


def test_stages_take_odd_rows_and_clashing_names(spark):
    docs = docs_of(spark, odd_texts())
    for name, stage in corpus_pipeline.STAGES:
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, SMALL)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == df.columns, name
            assert out.count() <= df.count()


# --- the pipeline, stage by stage


def test_pipeline_stages_do_what_they_say(spark, tmp_path):
    docs = table(spark, SMALL, "documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"file://{tmp_path}/{name.replace(' ', '-')}")
        kept[name] = (docs, spark.read.parquet(f"file://{tmp_path}/{name.replace(' ', '-')}"))
        docs = kept[name][1]
    before, after = kept["quality classifier"]
    machine = quality.train(before, table(spark, SMALL, "labels"), learn=~queries.held_out(0, 5))
    want = {r.doc_id for r in quality.score(before, machine).where(F.col("score") >= queries.LEAST_QUALITY).collect()}
    assert {r.doc_id for r in after.collect()} == want
    before, after = kept["MinHash near-dedup"]
    from test_against_brute_force import near_components, personal_spans, shingles

    roots = near_components({r.doc_id: shingles(r.text) for r in before.collect()}, 80)
    assert {r.doc_id for r in after.collect()} == set(roots.values())
    before, after = kept["benchmark decontamination"]
    clean = {r.doc_id for r in contamination.find(before, table(spark, SMALL, "benchmark")).where(F.size("spans") == 0).collect()}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = kept["PII"]
    assert before.count() == after.count()
    assert not any(personal_spans(r.text) for r in after.collect())
    before, after = kept["SentencePiece encoding and decoding"]
    assert after.count() == before.count() and after.where("not exact").count() == 0
    whole = corpus_pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.n_tokens) for r in whole.collect()) == sorted((r.doc_id, r.n_tokens) for r in after.collect())
    assert stages.LEAST_QUALITY == 0.3
