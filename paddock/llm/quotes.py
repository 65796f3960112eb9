"""Quotation linking: reply-ordered conversations without their quotes.

A line's quote level is the number of ``>`` before its text. Runs of lines of one level make passages (blank lines part
them); a passage's text, lower-cased and with runs of white space as one blank, is hashed, as is each of its lines. A
quoted passage links to the latest earlier message of its conversation that holds an own (level 0) passage or line of
the same hash. The message that most characters of the level 1 quotes link to is the parent (of equals the latest).
Messages without a linked quote begin threads. Cleaned texts have neither quotes nor the attribution line before one.

Lines may hold any number of levels. Equal messages of one turn each get their row; an empty table gives an empty result.
Order: conversation, thread (turn of its first message), turn; a parent always stands before its replies. Null texts
give null; rows with the same conversation and turn are told apart and reply to none of each other; null conversations or turns
link to nothing. Extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Possessive, so that lines of any number of levels are matched without a stack.
_PREFIX = r"^((?:[ \t]{0,3}>)++)[ \t]?"
_ENDS = r"^\s++|(?<!\s)\s++$"
_ATTRIBUTION = r"(?i)^.{0,200}\b(wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
#: Earlier own passages of one hash are looked up in blocks of so many turns, so that a frequent one is split.
BLOCK_TURNS = 4096


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 1), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def cleaned(text: Column) -> Column:
    """The own lines of a text, without the attribution lines that come right before a quote."""
    lines = F.split(text, r"\r?\n", -1)

    def own(lines: Column) -> Column:
        def keeps(line: Column, i: Column) -> Column:
            quote_next = F.coalesce(level(F.try_element_at(lines, i + 2)) > 0, F.lit(False))
            return (level(line) == 0) & ~(line.rlike(_ATTRIBUTION) & quote_next)

        return F.filter(lines, keeps)

    return F.when(text.contains(">"), F.regexp_replace(F.array_join(F.transform(F.array(lines), own)[0], "\n"), _ENDS, "")).otherwise(F.regexp_replace(text, _ENDS, ""))


def passages(messages: DataFrame) -> DataFrame:
    """conv_id, turn, mid, level, hash, size of all passages and lines. messages: conv_id, turn, mid, text."""
    lines = messages.select("conv_id", "turn", "mid", F.posexplode(F.split("text", r"\r?\n", -1)).alias("pos", "line"))
    parsed = lines.select("conv_id", "turn", "mid", "pos", level(F.col("line")).alias("level"), normal(F.regexp_replace("line", _PREFIX, "")).alias("body"))
    by = Window.partitionBy("mid").orderBy("pos")
    state = F.when(F.col("body") == "", -1).otherwise(F.col("level"))
    runs = parsed.withColumn("state", state).withColumn("new", F.coalesce((F.col("state") != F.lag("state").over(by)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(by)).filter("state >= 0")
    whole = runs.groupBy("conv_id", "turn", "mid", "level", "run").agg(F.sort_array(F.collect_list(F.struct("pos", "body"))).alias("parts"))
    joined = whole.select("conv_id", "turn", "mid", "level", F.array_join("parts.body", " ").alias("body"))
    both = joined.unionByName(runs.select("conv_id", "turn", "mid", "level", "body"))
    return both.select("conv_id", "turn", "mid", "level", F.xxhash64("body").alias("hash"), F.length("body").alias("size"))


def sources(units: DataFrame) -> DataFrame:
    """mid, level, size, source: for each quoted unit the turn of the latest earlier message with an own unit of its hash."""
    keyed = units.filter("conv_id is not null and turn is not null").withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    quoted = keyed.filter("level > 0").select("conv_id", "hash", "block", "turn", "mid", "level", "size").distinct()
    asked = quoted.select("conv_id", "hash").distinct()
    own = keyed.filter("level = 0").join(asked, ["conv_id", "hash"], "left_semi").select("conv_id", "hash", "block", "turn").distinct()
    # what earlier blocks hold: one row for each block, then a running maximum
    key = ["conv_id", "hash"]
    ends = own.groupBy(*key, "block").agg(F.max("turn").alias("end")).unionByName(quoted.select(*key, "block").distinct().withColumn("end", F.lit(None).cast(dict(own.dtypes)["turn"])))
    ends = ends.groupBy(*key, "block").agg(F.max("end").alias("end"))
    carried = ends.select(*key, "block", F.max("end").over(Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    within = quoted.withColumn("own", F.lit(None).cast(dict(own.dtypes)["turn"])).unionByName(own.withColumn("own", F.col("turn")), allowMissingColumns=True)
    last = F.max("own").over(Window.partitionBy(*key, "block").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    return within.withColumn("last", last).filter("mid is not null").join(carried, [*key, "block"]).select("conv_id", "mid", "level", "size", F.coalesce("last", "carried").alias("source")).filter("source is not null")


def parents(links: DataFrame, messages: DataFrame) -> DataFrame:
    """mid, parent (a mid) and parent_turn of the messages that reply to one."""
    votes = links.filter("level = 1").groupBy("conv_id", "mid", "source").agg(F.sum("size").alias("size"))
    best = votes.groupBy("conv_id", "mid").agg(F.max(F.struct("size", "source")).alias("best")).select("conv_id", "mid", F.col("best.source").alias("parent_turn"))
    first = messages.select("conv_id", F.col("turn").alias("parent_turn"), F.col("mid").alias("parent"))
    asked = first.join(best.select("conv_id", "parent_turn").distinct(), ["conv_id", "parent_turn"], "left_semi").groupBy("conv_id", "parent_turn").agg(F.min("parent").alias("parent"))
    return best.join(asked, ["conv_id", "parent_turn"]).select("mid", "parent", "parent_turn")


def threads(replies: DataFrame) -> DataFrame:
    """mid, root (a mid), depth of all replies, by doubling: each round a message looks to where its ancestor looks."""
    state = written(replies.select("mid", F.col("parent").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    while True:
        above = state.select(F.col("mid").alias("root"), F.col("root").alias("up"), F.col("depth").alias("more"))
        new = written(state.join(above, "root", "left").select("mid", F.coalesce("up", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("up").isNotNull().alias("moved")), "threads")
        state = new.drop("moved")
        if new.filter("moved").isEmpty():
            return state


def link_quotes(conversations: DataFrame) -> DataFrame:
    """The conversations' columns with text cleaned, and parent_turn, root_turn, depth, n_quotes, n_linked; in reply order."""
    added = ("mid", "parent_turn", "root_turn", "depth", "n_quotes", "n_linked")
    messages = written(conversations.drop(*added).withColumn("mid", F.monotonically_increasing_id()), "messages")
    units = written(passages(messages.select("conv_id", "turn", "mid", "text").filter(F.col("text").isNotNull())), "passages")
    links = written(sources(units), "quote-links")
    replies = written(parents(links, messages), "replies")
    roots = threads(replies)
    root_turns = messages.select(F.col("mid").alias("root"), F.col("turn").alias("root_turn")).join(roots.select("root").distinct(), "root", "left_semi")
    placed = roots.join(root_turns, "root").join(replies, "mid").select("mid", "parent_turn", "root_turn", "depth")
    counts = units.filter("level > 0").select("mid", "level", "hash").distinct().groupBy("mid").agg(F.count("*").alias("n_quotes"))
    met = links.groupBy("mid").agg(F.count("*").alias("n_linked"))
    out = messages.join(placed, "mid", "left").join(counts, "mid", "left").join(met, "mid", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    kept = [cleaned(F.col("text")).alias("text") if c == "text" else F.col(c) for c in messages.columns if c != "mid"]
    return out.select(*kept, "parent_turn", F.coalesce("root_turn", "turn").alias("root_turn"), zero("depth"), zero("n_quotes"), zero("n_linked")).orderBy("conv_id", "root_turn", "turn")


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH RECURSIVE msgs AS (SELECT row_number() OVER () AS mid, * FROM conversations),
lines AS (SELECT mid, conv_id, turn, i AS pos, ls[i] AS line, ls[i + 1] AS following FROM (SELECT mid, conv_id, turn, string_split_regex(text, '\r?\n') AS ls FROM msgs WHERE text IS NOT NULL), range(1, len(ls) + 1) t(i)),
parsed AS (SELECT mid, conv_id, turn, pos, line, len(regexp_replace(regexp_extract(line, '^((?:[ \t]{0,3}>)+)', 1), '[^>]', '', 'g')) AS level, following,
  trim(regexp_replace(lower(regexp_replace(line, '^((?:[ \t]{0,3}>)+)[ \t]?', '')), '\s+', ' ', 'g')) AS body FROM lines),
stated AS (SELECT *, CASE WHEN body = '' THEN -1 ELSE level END AS state FROM parsed),
stepped AS (SELECT *, lag(state) OVER (PARTITION BY mid ORDER BY pos) AS before FROM stated),
runs AS (SELECT *, sum((before IS NULL OR before <> state)::INT) OVER (PARTITION BY mid ORDER BY pos) AS run FROM stepped),
units AS (SELECT DISTINCT conv_id, turn, mid, level, body FROM (SELECT conv_id, turn, mid, level, string_agg(body, ' ' ORDER BY pos) AS body FROM runs WHERE state >= 0 GROUP BY conv_id, turn, mid, level, run UNION ALL SELECT conv_id, turn, mid, level, body FROM runs WHERE state >= 0)),
links AS (SELECT q.conv_id, q.mid, q.level, length(q.body) AS size, max(o.turn) AS source FROM units q JOIN units o ON o.conv_id = q.conv_id AND o.body = q.body AND o.level = 0 AND o.turn < q.turn WHERE q.level > 0 GROUP BY q.conv_id, q.mid, q.level, q.body),
votes AS (SELECT conv_id, mid, source, sum(size) AS size FROM links WHERE level = 1 GROUP BY 1, 2, 3),
best AS (SELECT conv_id, mid, arg_max(source, (size, source)) AS parent_turn FROM votes GROUP BY 1, 2),
replies AS (SELECT b.mid, b.parent_turn, min(m.mid) AS parent FROM best b JOIN msgs m ON m.conv_id = b.conv_id AND m.turn = b.parent_turn GROUP BY 1, 2),
climb AS (SELECT mid, parent AS root, 1 AS depth FROM replies UNION ALL SELECT c.mid, r.parent, c.depth + 1 FROM climb c JOIN replies r ON r.mid = c.root),
roots AS (SELECT mid, arg_max(root, depth) AS root, max(depth) AS depth FROM climb GROUP BY 1),
clean AS (SELECT mid, regexp_replace(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE level = 0 AND NOT (regexp_matches(line, '(?i)^.{0,200}\b(wrote|writes|said|schrieb|a écrit|escribió)[ \t]*:[ \t]*$') AND coalesce(regexp_matches(following, '^[ \t]{0,3}>'), false))), '^\s+|\s+$', '', 'g') AS text FROM parsed GROUP BY 1)
SELECT m.conv_id, m.turn, m.role, CASE WHEN m.text IS NULL THEN NULL WHEN contains(m.text, '>') THEN coalesce(c.text, '') ELSE regexp_replace(m.text, '^\s+|\s+$', '', 'g') END AS text, p.parent_turn, coalesce(t.turn, m.turn) AS root_turn,
  coalesce(r.depth, 0)::BIGINT AS depth, coalesce(q.n, 0)::BIGINT AS n_quotes, coalesce(l.n, 0)::BIGINT AS n_linked
FROM msgs m LEFT JOIN clean c USING (mid) LEFT JOIN replies p USING (mid) LEFT JOIN roots r USING (mid) LEFT JOIN msgs t ON t.mid = r.root
LEFT JOIN (SELECT mid, count(*) AS n FROM units WHERE level > 0 GROUP BY 1) q ON q.mid = m.mid LEFT JOIN (SELECT mid, count(*) AS n FROM links GROUP BY 1) l ON l.mid = m.mid
"""
