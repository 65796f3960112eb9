"""Benchmark decontamination over a distributed positional inverted index.

The index is a written table of postings (row, pos, term) of the training documents, for the terms that the test items
have. An item gives windows of ten consecutive words (a shorter item is one window). A window's terms are ranked by the
number of their postings; the list of the rarest gives candidate starts (position less offset), and the lists of the
others, adjusted by their offsets, are intersected with these. With ``slop`` > 0 each other term may stand up to so many
words from its place: a proximity match.

A posting is also written for the end of each document (term END at the position behind the last word), so the table
holds every document's length. Null texts have no words; rows that share a doc_id are told apart; an empty benchmark
gives no hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, numbered, table, written

WORD, WINDOW = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", 10
END = -1
#: A side with at most so many narrow rows is broadcast (some tens of MB); beyond it the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: Over so many tasks the rows of one key are spread where a side is too large for a broadcast.
SALTS = 32


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 0)


def is_small(df: DataFrame) -> bool:
    """Whether the counted rows, and the bytes of their texts, are few enough for a broadcast."""
    texts = [F.octet_length(c) for c, kind in df.dtypes if kind == "string"]
    size = df.agg(F.count("*").alias("n"), F.sum(sum(texts, F.lit(0))).alias("bytes")).first()
    return size.n <= BROADCAST_ROWS and (size.bytes or 0) <= BROADCAST_BYTES


def meet(big: DataFrame, little: DataFrame, key: str, spread: Column) -> DataFrame:
    """The inner join on a key that may be hot in ``big``: ``little`` is broadcast if it is small, else it is copied SALTS times
    and the rows of a key in ``big`` are dealt over the copies."""
    if is_small(little):
        return big.join(F.broadcast(little), key)
    copies = little.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return big.withColumn("_salt", F.pmod(F.hash(spread), F.lit(SALTS))).join(copies, [key, "_salt"]).drop("_salt")


def item_windows(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct windows (w, phrase: array of words) and which items have them (w, item_id)."""
    w = items.select("item_id", words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - WINDOW, F.lit(0)))
    phrases = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i + 1, WINDOW))).alias("phrase"))
    distinct = written(phrases.select("phrase").distinct().withColumn("w", F.monotonically_increasing_id()), "windows")
    owners = written(phrases.join(distinct, "phrase").select("w", "item_id").distinct(), "window-items")
    return distinct, owners


def index(docs: DataFrame, windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written postings (row, doc_id, pos, term) and the terms of the windows (w, off, term)."""
    terms = windows.select("w", F.posexplode("phrase").alias("off", "word"))
    vocabulary = written(terms.select("word").distinct().withColumn("term", F.monotonically_increasing_id()), "vocabulary")
    marked = (vocabulary.unionByName(docs.sparkSession.range(1).select(F.lit("\x00").alias("word"), F.lit(END).cast("long").alias("term"))))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("words"))
    tokens = rows.select("row", "doc_id", F.posexplode(F.concat("words", F.array(F.lit("\x00")))).alias("pos", "word"))
    postings = written(meet(tokens, marked, "word", F.struct("row", "pos")).select("row", "doc_id", "pos", "term"), "postings")
    return postings, written(terms.join(vocabulary, "word").select("w", "off", "term"), "window-terms")


def ranked(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """The terms of the windows that can occur, by rank from the rarest: w, off, term, rank, n (the window's words)."""
    counts = written(postings.groupBy("term").agg(F.count("*").alias("df")), "term-counts")
    by = Window.partitionBy("w")
    found = terms.join(F.broadcast(counts) if is_small(counts) else counts, "term", "left").select("w", "off", "term", F.row_number().over(by.orderBy("df", "off")).alias("rank"), F.count("*").over(by).alias("n"), F.count("df").over(by).alias("met"))
    return written(found.filter("met = n").drop("met"), "ranked-terms")


def met_at(postings: DataFrame, starts: DataFrame, ranks: DataFrame, slop: int) -> DataFrame:
    """row, w, start, n, off: which of the ranked terms stand at their places behind the starts (or up to ``slop`` words beside them).
    Only the lists of these terms, in rows that have a start, are shuffled."""
    places = F.explode(F.array(*[F.col("start") + F.col("off") + d for d in range(-slop, slop + 1)])).alias("pos")
    need = meet(starts, ranks, "w", F.struct("row", "start")).select("row", "w", "start", "n", "off", "term", places)
    lists = postings.select("row", "pos", "term")
    for key, having in (("term", ranks.select("term").distinct()), ("row", starts.select("row").distinct())):
        lists = lists.join(F.broadcast(having) if is_small(having) else having, key, "left_semi")
    met = need.join(lists, ["row", "pos", "term"]).select("row", "w", "start", "n", "off")
    return met.distinct() if slop else met


def matches(postings: DataFrame, ranks: DataFrame, slop: int = 0) -> DataFrame:
    """row, w, start, n: where the windows occur, exactly or with each word at most ``slop`` words from its place.

    The list of the rarest term gives the starts, that of the next one leaves few of them, and these meet all other lists at once."""
    by_rank = lambda which: ranks.filter(which).select("term", "w", "off")
    rarest = ranks.filter("rank = 1").select("term", "w", "off", "n")
    starts = written(meet(postings, rarest, "term", F.struct("row", "pos")).filter("pos >= off").select("row", "w", "n", (F.col("pos") - F.col("off")).alias("start")), "candidates")
    several = starts.filter("n > 1")
    left = written(met_at(postings, several, by_rank("rank = 2"), slop).select("row", "w", "start", "n"), "candidates-2")
    met = met_at(postings, left.filter("n > 2"), by_rank("rank > 2"), slop)
    whole = met.groupBy("row", "w", "start", "n").agg(F.count("*").alias("met")).filter("met = n - 2").drop("met")
    done = starts.filter("n = 1").select("row", "w", "start", "n").unionByName(left.filter("n = 2"))
    return whole.unionByName(done)


def contamination(docs: DataFrame, items: DataFrame, slop: int = 0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs."""
    windows, owners = item_windows(items)
    postings, terms = index(docs, windows)
    found = written(matches(postings, ranked(postings, terms), slop), "matches")
    before = F.max("stop").over(Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    spans = found.select("row", "start", (F.col("start") + F.col("n")).alias("stop")).distinct()
    fresh = F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(before, F.lit(0))))
    hits = spans.withColumn("fresh", fresh).groupBy("row").agg(F.sum("fresh").alias("hit"))
    has = meet(found.select("row", "w").distinct(), owners, "w", F.col("row")).groupBy("row").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    whole = postings.filter(F.col("term") == END).select("row", "doc_id", F.col("pos").cast("long").alias("n_words"))
    return whole.join(hits, "row", "left").join(has, "row", "left").select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"), (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that hold a window; rows with null or repeated doc_ids are decided one by one."""
    rows, row = numbered(docs, "decontaminate-rows")
    bad = contamination(rows.select(F.col(row).alias("doc_id"), "text"), items).filter("contaminated").select(F.col("doc_id").alias(row))
    return rows.join(bad, row, "left_anti").select(*docs.columns)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, list_slice(ws, i + 1, i + {WINDOW}) AS phrase FROM b, range(0, greatest(len(ws) - {WINDOW}, 0) + 1) t(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT len(phrase) AS n FROM win),
dw AS (SELECT doc_id, i AS start, n, list_slice(ws, i + 1, i + n) AS phrase FROM d, sizes, range(0, len(ws) - n + 1) t(i)),
m AS (SELECT doc_id, start, n, item_id FROM dw JOIN win USING (phrase)),
hit AS (SELECT doc_id, count(DISTINCT start + k) AS n_hit FROM m, range(0, n) t(k) GROUP BY doc_id),
has AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN has USING (doc_id)
"""
