"""Quotation linking, on DataFrame functions alone.

A line's quote level is the number of > marks before it. Quoted lines are normalised (A-Z in
lower case, white space collapsed) and hashed, and joined to the messages that wrote the same
line themselves: to the first earlier turn of the same conversation, else to the first message
of all, by (conversation, turn), if that is earlier. Lines under MIN_CHARS characters join only
their own conversation by themselves; elsewhere they join as part of their passage (a run of lines
of one level without blank ones), if that has MIN_CHARS, and in both cases the message that wrote
the whole passage goes before one that wrote the line. A message answers the latest message that
it quotes at its lowest linked level; without a link it answers the turn before it. Following
answers upwards by pointer jumping gives each message its thread (the root) and its depth, so
rows ordered by (root, depth, conversation, turn) are the conversations in reply order, without
quotes.

Originals are reduced to their first place in each task before the shuffle, so a line that a
third of all messages hold joins as one row; quoting rows of a hot line or of a hot message meet
one row each, and Spark splits them where they are skewed. A conversation is never gathered.

Defined cases: null and empty texts hold no lines and stay as they are; blank
quoted lines are dropped but not linked; rows that share (conversation, turn) are one
message and get equal results; rows with a null key are their own threads of depth 0; gaps in
turns start a new thread; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemill.llm.common import ascii_lower, materialize

MIN_CHARS = 8
MARKS = r"^((?:[ \t]*>)*)"
#: A passage among lines written as line end, level, tab and normalised line.
PASSAGE = r"\n([0-9]+)\t[^\n]++(?:\n\1\t[^\n]++)*+"


def level_of(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def normal(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"[ \t\r\n\f\x0B]+", " ")
    return ascii_lower(F.trim(bare))


def without_quotes(text: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: level_of(x) == 0), "\n")


def threads(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", keep: tuple[str, ...] = ("role",), min_chars: int = MIN_CHARS) -> DataFrame:
    """conv, turn and keep columns, `own_text`, `n_quoted` lines, `n_linked` of them, `max_level`,
    `parent_conv`, `parent_turn`, `root_conv`, `root_turn` and `depth` for every row."""
    source = messages.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(text).alias("x"), *keep)
    coded = F.transform(F.split("x", "\n"), lambda x: F.concat(F.lit("\n"), level_of(x).cast("string"), F.lit("\t"), normal(x)))
    runs = source.where("c is not null and t is not null").select("c", "t", F.explode(F.regexp_extract_all(F.array_join(coded, ""), F.lit(PASSAGE), F.lit(0))).alias("run"))
    passage = F.regexp_replace(F.regexp_replace("run", r"\n[0-9]+\t", "\n"), r"^\n", "")
    runs = runs.select("c", "t", F.regexp_extract("run", r"^\n([0-9]+)\t", 1).cast("int").alias("level"), passage.alias("passage"))
    each = F.split("passage", "\n")
    own = runs.where("level = 0").select("c", "t", F.explode(F.array_distinct(F.concat(F.array("passage"), each))).alias("u")).select("c", "t", F.md5("u").alias("key"))
    quoted = runs.where("level > 0").select("c", "t", "level", F.md5("passage").alias("p"), (F.length("passage") >= min_chars).alias("wide"), F.explode(each).alias("line"))
    quoted = quoted.select("c", "t", "level", "p", "wide", F.md5("line").alias("h"), (F.length("line") >= min_chars).alias("long"))
    quoted = quoted.groupBy("c", "t", "h", "p", "wide", "long").agg(F.min("level").alias("level"), F.count(F.lit(1)).alias("k"))
    alone = F.struct(F.lit(0).alias("whole"), F.col("h").alias("key"), F.col("long").alias("far"))
    among = F.struct(F.lit(1).alias("whole"), F.col("p").alias("key"), F.col("wide").alias("far"))
    asked = quoted.select("c", "t", "h", "p", "level", "k", F.explode(F.when(F.col("long") | (F.col("h") == F.col("p")), F.array(alone)).otherwise(F.array(alone, among))).alias("a"))
    # what may not leave its conversation gets a key that no line has, unlike for each message
    asked = asked.select("c", "t", "h", "p", "level", "k", "a.whole", "a.key", F.when(F.col("a.far"), F.col("a.key")).otherwise(F.concat_ws(" ", "a.key", "c", "t")).alias("far"))
    inside = own.groupBy("key", "c").agg(F.min("t").alias("ti"))
    anywhere = own.groupBy(F.col("key").alias("far")).agg(F.min(F.struct("c", "t")).alias("first"))
    found = asked.join(inside, ["key", "c"], "left").join(anywhere, "far", "left")
    here = F.struct("c", "t")
    origin = F.when(F.col("ti") < F.col("t"), F.struct("c", F.col("ti").alias("t"))).when(F.col("first") < here, F.col("first"))
    found = found.withColumn("origin", origin).where("origin is not null")
    found = found.groupBy("c", "t", "h", "p", "level", "k").agg(F.max(F.struct("whole", "origin")).alias("o")).select("c", "t", "level", "k", "o.origin")
    linked = found.groupBy("c", "t").agg(F.sum("k").alias("n_linked"), F.max(F.struct(-F.col("level"), F.col("origin"))).alias("best"))
    links = linked.select("c", "t", "n_linked", F.col("best.origin").alias("origin"))

    nodes = source.select("c", "t").where("c is not null and t is not null").distinct()
    before = nodes.select("c", (F.col("t") + 1).alias("t"), F.col("t").alias("prior"))
    parents = nodes.join(links, ["c", "t"], "left").join(before, ["c", "t"], "left")
    pc = F.coalesce("origin.c", F.when(F.col("prior").isNotNull(), F.col("c")))
    parents = materialize(parents.select("c", "t", "n_linked", pc.alias("pc"), F.coalesce("origin.t", "prior").alias("pt")), "parents")
    up = parents.select("c", "t", F.coalesce("pc", "c").alias("rc"), F.coalesce("pt", "t").alias("rt"), F.col("pc").isNotNull().cast("long").alias("depth"))
    done, open_ = up.where("depth = 0"), up.where("depth > 0")
    while True:
        now = done.unionByName(open_)
        far = now.select(F.col("c").alias("rc"), F.col("t").alias("rt"), F.col("rc").alias("fc"), F.col("rt").alias("ft"), F.col("depth").alias("more"))
        step = open_.join(far, ["rc", "rt"]).select("c", "t", F.col("fc").alias("rc"), F.col("ft").alias("rt"), (F.col("depth") + F.col("more")).alias("depth"), "more")
        step = materialize(step, "threads")
        done, open_ = done.unionByName(step.where("more = 0").drop("more")), step.where("more > 0").drop("more")
        if open_.limit(1).isEmpty():
            break
    up = done
    out = source.join(parents, ["c", "t"], "left").join(up, ["c", "t"], "left")
    levels = F.transform(F.split("x", "\n"), level_of)
    return out.select(
        F.col("c").alias(conv),
        F.col("t").alias(turn),
        *keep,
        without_quotes(F.col("x")).alias("own_text"),
        F.coalesce(F.size(F.filter(levels, lambda n: n > 0)), F.lit(0)).cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        F.coalesce(F.array_max(levels), F.lit(0)).cast("long").alias("max_level"),
        F.col("pc").alias("parent_conv"),
        F.col("pt").alias("parent_turn"),
        F.coalesce("rc", "c").alias("root_conv"),
        F.coalesce("rt", "t").alias("root_turn"),
        F.coalesce("depth", F.lit(0)).alias("depth"),
    )


#: Conversations made by `quoting` have ids moved by this.
MOVED = 1_000_000_000


def quoting(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", keep: tuple[str, ...] = ("role",)) -> DataFrame:
    """Mail-like conversations from messages that quote nothing: under moved ids, each message quotes
    the two turns before it, at levels 1 and 2, above its own text; one without a turn before it
    quotes its original, from the other conversation. Rows with a null key are left out."""
    rows = messages.select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.col(text).alias("x"), *keep).where("c is not null and t is not null")
    text_of = rows.groupBy("c", "t").agg(F.min("x").alias("y"))
    one = text_of.select("c", (F.col("t") + 1).alias("t"), F.col("y").alias("y1"), F.lit(True).alias("has1"))
    two = text_of.select("c", (F.col("t") + 2).alias("t"), F.col("y").alias("y2"))
    joined = rows.join(one, ["c", "t"], "left").join(two, ["c", "t"], "left")
    marked = lambda y, mark: F.concat(F.lit(mark), F.replace(y, F.lit("\n"), F.lit("\n" + mark)))
    whole = F.when(F.col("has1"), F.concat_ws("\n", marked(F.col("y2"), ">> "), marked(F.col("y1"), "> "), "x")).otherwise(marked(F.col("x"), "> "))
    return joined.select((F.col("c") + MOVED).alias(conv), F.col("t").alias(turn), *keep, whole.alias(text))


SQL = r"""
WITH RECURSIVE
k0 AS (SELECT conv_id AS c, turn AS t, text AS x, role FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
k1 AS (SELECT c, t, min(x) AS y FROM k0 GROUP BY ALL),
made AS (SELECT k0.c + 1000000000 AS conv_id, k0.t AS turn, role,
           CASE WHEN a.c IS NOT NULL THEN concat_ws(chr(10), '>> ' || replace(b.y, chr(10), chr(10) || '>> '), '> ' || replace(a.y, chr(10), chr(10) || '> '), x) ELSE '> ' || replace(x, chr(10), chr(10) || '> ') END AS text
         FROM k0 LEFT JOIN k1 a ON a.c = k0.c AND a.t = k0.t - 1 LEFT JOIN k1 b ON b.c = k0.c AND b.t = k0.t - 2),
talk AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT conv_id, turn, role, text FROM made),
m AS (SELECT *, string_split(text, chr(10)) AS ls, row_number() OVER () AS rid FROM talk),
li AS (SELECT rid, conv_id AS c, turn AS t, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM m WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
lv AS (SELECT rid, c, t, i, length(regexp_replace(regexp_extract(line, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')) AS level,
         translate(trim(regexp_replace(regexp_replace(line, '^((?:[ \t]*>)*)', ''), '[ \t\r\n\f\x0B]+', ' ', 'g'), ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM li),
nb AS (SELECT *, i - row_number() OVER (PARTITION BY rid, level ORDER BY i) AS island FROM lv WHERE norm <> ''),
ps AS (SELECT *, string_agg(norm, chr(10)) OVER (PARTITION BY rid, level, island ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS passage FROM nb),
own AS (SELECT c, t, norm AS u FROM ps WHERE level = 0 UNION SELECT c, t, passage FROM ps WHERE level = 0),
q AS (SELECT c, t, norm AS h, passage AS p, min(level) AS level, count(*) AS k FROM ps WHERE level > 0 GROUP BY ALL),
asked AS (SELECT *, 0 AS whole, h AS key, length(h) >= 8 AS far FROM q UNION ALL SELECT *, 1, p, length(p) >= 8 FROM q WHERE length(h) < 8 AND h <> p),
inside AS (SELECT u, c, min(t) AS ti FROM own GROUP BY ALL),
anyw AS (SELECT u, min((c, t)) AS f FROM own GROUP BY ALL),
fo AS (SELECT asked.*, CASE WHEN ti < asked.t THEN (asked.c, ti) WHEN far AND f < (asked.c, asked.t) THEN f END AS o
       FROM asked LEFT JOIN inside ON inside.u = key AND inside.c = asked.c LEFT JOIN anyw ON anyw.u = key),
gr AS (SELECT c, t, h, p, level, k, max((whole, o)) AS b FROM fo WHERE o IS NOT NULL GROUP BY ALL),
lk AS (SELECT c, t, sum(k)::BIGINT AS n_linked, max((-level, b[2])) AS best FROM gr GROUP BY ALL),
n AS (SELECT DISTINCT conv_id AS c, turn AS t FROM talk WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
pa AS (SELECT n.c, n.t, n_linked, coalesce(best[2][1], b.c) AS pc, coalesce(best[2][2], b.t) AS pt
       FROM n LEFT JOIN lk ON lk.c = n.c AND lk.t = n.t LEFT JOIN n b ON b.c = n.c AND b.t = n.t - 1),
up AS (SELECT c, t, c AS rc, t AS rt, 0 AS depth FROM pa WHERE pc IS NULL
       UNION ALL SELECT pa.c, pa.t, up.rc, up.rt, up.depth + 1 FROM pa JOIN up ON pa.pc = up.c AND pa.pt = up.t)
SELECT conv_id, turn, role,
  sha256(coalesce(array_to_string(list_filter(ls, lambda x: NOT starts_with(ltrim(x, ' ' || chr(9)), '>')), chr(10)), '')) AS own_sha256,
  coalesce(len(list_filter(ls, lambda x: starts_with(ltrim(x, ' ' || chr(9)), '>'))), 0)::BIGINT AS n_quoted,
  coalesce(n_linked, 0)::BIGINT AS n_linked,
  coalesce(list_max(list_transform(ls, lambda x: length(regexp_replace(regexp_extract(x, '^((?:[ \t]*>)*)', 1), '[^>]', '', 'g')))), 0)::BIGINT AS max_level,
  pc AS parent_conv, pt AS parent_turn, coalesce(rc, conv_id) AS root_conv, coalesce(rt, turn) AS root_turn, coalesce(depth, 0)::BIGINT AS depth
FROM m LEFT JOIN pa ON pa.c = conv_id AND pa.t = turn LEFT JOIN up ON up.c = conv_id AND up.t = turn
"""
