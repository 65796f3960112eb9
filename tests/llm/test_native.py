"""Quotation linking, histogram sort, pseudonyms and decontamination against brute force, with odd inputs."""

import datetime as dt
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from paddock.llm import decontaminate, histogram_sort, pii, quotes
from paddock.llm.pii import TEST_KEY as KEY

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, extra=""):
    rows = [(i, t, "en", "s", len(t or "")) + (("x",) if extra else ()) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + extra)


# --- quotation linking


def test_quotes_nest_link_and_go(spark):
    rows = [
        (1, 0, "user", "Hello all.\nHow do I sort?\n\nThanks"), (1, 1, "assistant", "On Monday user wrote:\n> How do I  SORT?\n\nUse orderBy."),
        (1, 2, "user", "> > How do I sort?\n> Use orderBy.\nIt works!"), (1, 3, "x", "Unrelated"), (1, 4, "assistant", "Bob wrote:\n> unrelated\nIndeed\n> nothing like it"),
        (2, 0, "user", None), (2, 1, "user", ""), (None, 1, "user", "> x"), (1, None, "user", "> Unrelated\ny"), (1, 2, "copy", "> Use orderBy.\nYes"), (3, 5, "u", "> later\na"), (3, 6, "u", "later"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("line", F.lit(1))
    out = {(r.conv_id, r.turn, r.role): r for r in quotes.link_quotes(df).collect()}
    assert len(out) == len(rows)
    assert out[1, 1, "assistant"].text == "Use orderBy." and out[1, 1, "assistant"].parent_turn == 0
    assert (out[1, 2, "user"].parent_turn, out[1, 2, "user"].root_turn, out[1, 2, "user"].depth, out[1, 2, "user"].text) == (1, 0, 2, "It works!")
    assert out[1, 2, "copy"].parent_turn == 1
    assert (out[1, 4, "assistant"].parent_turn, out[1, 4, "assistant"].text) == (3, "Indeed")
    assert out[2, 0, "user"].text is None and out[2, 1, "user"].text == "" and out[1, None, "user"].parent_turn is None
    assert out[3, 5, "u"].parent_turn is None, "a quote of a later message links to nothing"
    order = [(r.conv_id, r.root_turn, r.turn) for r in quotes.link_quotes(df).collect() if r.conv_id == 1 and r.turn is not None]
    assert order == sorted(order)
    assert quotes.link_quotes(df.limit(0)).count() == 0


def test_quotes_equal_the_sql(spark):
    import duckdb

    rng = random.Random(8)
    said = ["Yes.", "How  do I sort?", "Use orderBy", "No", "A user wrote:", "see > here", ""]
    rows = []
    for t in range(60):
        lines = [rng.choice(["", "", "> ", ">> ", "> > ", "  >"]) + rng.choice(said) for _ in range(rng.randrange(5))]
        rows.append((t % 3, t // 3, rng.choice("ab"), "\n".join(lines) if t % 13 else None))
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    want = con.execute(quotes.OP1_SQL)
    names = [c[0] for c in want.description]
    got = quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_long_reply_chains(spark):
    rows = [(1, t, "u", (f"> line {t - 1}\n" if t else "") + f"line {t}") for t in range(40)]
    out = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(out[t].depth == t and out[t].root_turn == 0 and out[t].text == f"line {t}" for t in range(40))


def test_a_frequent_line_links_to_the_latest_before(spark):
    rows = [(7, 5000 * t, "u", "same" if t % 2 == 0 else "> same\nreply") for t in range(10)]
    out = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(out[5000 * t].parent_turn == 5000 * (t - 1) for t in range(1, 10, 2))


def test_lines_of_very_many_levels(spark):
    deep, blank = ">" * 1_000_000, "a" + " " * 300_000 + "b"
    rows = [(1, 0, "u", "hello"), (1, 1, "u", deep + " hello\nown"), (1, 2, "u", "> hello\nyes\n" + "> " * 200_000 + "x"), (1, 3, "u", blank + " > \n")]
    out = {r.turn: r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert [out[t].text for t in range(4)] == ["hello", "own", "yes", blank + " >"]
    assert out[1].n_quotes == 1 and out[1].n_linked == 1 and out[1].parent_turn is None and out[2].parent_turn == 0


# --- histogram sort


def brute_shards(sizes, shards):
    total, below, out = sum(sizes), 0, []
    for s in sizes:
        out.append(below * shards // total)
        below += s
    return out


@pytest.mark.parametrize("n, seed", [(1, 1), (5, 2), (500, 3)])
def test_shards_equal_brute_force(spark, n, seed):
    rng = random.Random(seed)
    texts = [rng.choice([None, "", "é" * rng.randrange(50), "x" * rng.randrange(3000)]) for _ in range(n)]
    df = docs(spark, texts, ", shard string").orderBy(F.desc("doc_id")).repartition(3)
    got = sorted(histogram_sort.histogram_sort(df).collect(), key=lambda r: r.doc_id)
    sizes = [len((t or "").encode()) + 1 for t in texts]
    assert [r.shard for r in got] == brute_shards(sizes, 16) and [r.size for r in got] == sizes
    assert [r.text_crc32 for r in got] == [zlib.crc32((t or "").encode()) for t in texts]
    for s in {r.shard for r in got}:
        assert [r.slot for r in got if r.shard == s] == list(range(sum(r.shard == s for r in got)))


def test_a_hot_key_is_cut(spark):
    df = spark.createDataFrame([(7, "x" * 99)] * 320 + [(None, "y" * 99)] * 4 + [(8, "")], "doc_id long, text string").repartition(4)
    got = histogram_sort.histogram_sort(df).collect()
    loads = [sum(r.size for r in got if r.shard == s) for s in range(16)]
    assert len(got) == 325 and max(loads) - min(loads) <= 200
    assert histogram_sort.histogram_sort(df.limit(0)).count() == 0


def test_all_64_bit_ids_and_tiny_parts(spark):
    """The slots are those of one sorted list, for any number of parts; the plan is the same but for its literals."""
    rng = random.Random(5)
    ids = [None, None, -(2**63), -(2**63) + 1, 2**63 - 1, 2**63 - 2, *[rng.randrange(-(2**63), 2**63) for _ in range(300)], *range(50), *[7] * 40]
    texts = {i: "x" * rng.randrange(200) for i in ids}
    rng.shuffle(ids)
    df = spark.createDataFrame([(i, texts[i]) for i in ids], "doc_id long, text string").repartition(3)
    order = sorted(ids, key=lambda i: -(2**64) if i is None else i)
    want, seen = [], {}
    for i, s in zip(order, brute_shards([len(texts[i]) + 1 for i in order], 16)):
        want.append((i, s, seen.setdefault(s, 0)))
        seen[s] += 1
    plans = []
    for part_bytes in (1 << 30, 40):
        out = histogram_sort.histogram_sort(df, part_bytes=part_bytes)
        assert sorted(((r.doc_id, r.shard, r.slot) for r in out.collect()), key=str) == sorted(want, key=str)
        plans.append(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
    assert plans[0] == plans[1]


def test_a_tolerance_ends_earlier_within_it(spark):
    df = docs(spark, ["x" * 99] * 1000)
    got = histogram_sort.histogram_sort(df, shards=4, tolerance=2000).collect()
    assert all(abs(sum(r.size for r in got if r.shard == s) - 25_000) <= 4000 for s in range(4))


# --- pseudonyms


def luhn(s):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


TEXTS = [
    "call +1 (988) 555-2485, (212) 555-0100. card 4041894974608795 or 4041-8949-7460-8795; bad 4041894974608796", "ip 70.123.182.155, v1.2.3.4.5, 999.1.1.1", "123-45-6789 000-12-3456",
    "2024-02-29 2023-02-29 31.12.1999 12/31/2020", "Bob.Smith42@mail8.example.com!", None, "", "no values here", "again +1 (988) 555-2485 4041894974608795", "7536784127813050 4845168114407329", "x" * 200_000 + " 4041894974608795",
]


def test_pseudonyms_keep_the_format_and_link(spark):
    out = {r.doc_id: r for r in pii.pseudonymised(docs(spark, TEXTS, ", pii_found string"), KEY).collect()}
    values = {p.old: p for r in out.values() for p in r.pii_found or []}
    for old, kind in {"+1 (988) 555-2485": "phone", "4041894974608795": "card", "70.123.182.155": "ip", "123-45-6789": "ssn", "2024-02-29": "date", "31.12.1999": "date", "12/31/2020": "date", "Bob.Smith42@mail8.example.com": "email"}.items():
        p = values[old]
        assert p.kind == kind and p.new != old and re.sub("[0-9]", "9", p.new if kind != "ip" else "") == re.sub("[0-9]", "9", old if kind != "ip" else "") or kind == "email"
    assert luhn(values["4041894974608795"].new) and values["4041-8949-7460-8795"].new.replace("-", "") == values["4041894974608795"].new
    assert values["+1 (988) 555-2485"].new.startswith("+1 (") and values["Bob.Smith42@mail8.example.com"].new.endswith("@mail8.example.com")
    assert all(int(x) < 256 for x in values["70.123.182.155"].new.split("."))
    for old in ("4041894974608796", "999.1.1.1", "000-12-3456", "2023-02-29"):
        assert values[old].new == old and values[old].kind is None
    assert values["+1 (988) 555-2485"].new in out[0].text and values["+1 (988) 555-2485"].new in out[8].text
    assert out[5].text is None and out[6].text == "" and out[7].text == "no values here" and len(out[10].text) == 200_017
    assert "1.2.3.4.5" in out[1].text and out[9].text.count(" ") == 1
    assert pii.rewrite(docs(spark, TEXTS), KEY).columns == DOCS.replace(" long", "").replace(" string", "").split(", ")
    assert pii.pseudonymised(docs(spark, []), KEY).count() == 0


def test_timestamps_all_years_and_split_cards(spark):
    texts = ["at 2024-05-06T10:00:00Z and 2024-05-06 10:00, 2024-05-06Txx", "card 3782-822463-10005, 3782 822463 10005, 378282246310005, bad 3782 822463 10006, mixed 3782 822463-10005, 3056 930902 5904"]
    edges = ["0001-01-01", "1799-12-31", "1800-01-01", "2199-12-31", "2200-01-01", "9999-12-31", "0000-01-01", "1900-02-29"]
    out = {r.doc_id: r for r in pii.pseudonymised(docs(spark, [*texts, " ".join(edges)]), KEY).collect()}
    day = {p.old: p.new for p in out[0].pii_found}["2024-05-06"]
    assert day != "2024-05-06" and out[0].text == f"at {day}T10:00:00Z and {day} 10:00, 2024-05-06Txx"
    new = {p.old: p.new for p in out[1].pii_found if p.kind == "card"}
    assert set(new) == {"3782-822463-10005", "3782 822463 10005", "378282246310005", "3056 930902 5904"}
    assert len({re.sub("[ -]", "", new[k]) for k in new if k.startswith("3782")}) == 1 and all(luhn(re.sub("[ -]", "", n)) and re.sub("[0-9]", "9", n) == re.sub("[0-9]", "9", o) and n != o for o, n in new.items())
    assert "bad 3782 822463 10006, mixed 3782 822463-10005" in out[1].text
    found = {p.old: (p.kind, p.new) for p in out[2].pii_found}
    near = lambda d: "1800" <= d < "2200"
    assert all(found[d][0] == "date" and found[d][1] != d and near(found[d][1]) == near(d) for d in edges[:6]) and all(found[d] == (None, d) for d in edges[6:])


def test_days_of_other_years_are_permuted_one_to_one(spark):
    n = pii.OTHER_RADICES[0] * pii.OTHER_RADICES[1]
    first, last = (dt.date(1800, 1, 1) - dt.date(1, 1, 1)).days, (dt.date(9999, 12, 31) - dt.date(1, 1, 1)).days
    assert first == pii.DAYS_BEFORE and n == last + 1 - pii.DATE_RADICES[0] * pii.DATE_RADICES[1]
    days = spark.range(4000).select(F.date_format(F.expr("date_add(date'1795-01-01', cast(id as int))"), "yyyy-MM-dd").alias("d"))
    rows = days.select("d", pii.pseudonym(F.col("d"), KEY).new.alias("new")).collect()
    assert len({r.new for r in rows}) == 4000 and all(("1800" <= r.d < "2200") == ("1800" <= r.new < "2200") and dt.date.fromisoformat(r.new) for r in rows)


def test_the_permutations_are_one_to_one(spark):
    n = 27 * 50
    pairs = spark.range(n).select(pii.feistel(F.col("id") % 27, F.floor(F.col("id") / 27), F.lit(27), F.lit(50), "k", "t").alias("o")).select("o.*").distinct()
    assert pairs.count() == n and pairs.filter("l between 0 and 26 and r between 0 and 49").count() == n
    three = spark.range(1000).select(pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "t").alias("d")).distinct()
    assert three.count() == 1000 and three.filter("length(d) = 3").count() == 1000
    other = spark.range(50).select((pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "a", "t") == pii.permute_digits(F.lpad(F.col("id").cast("string"), 3, "0"), "b", "t")).alias("same"))
    assert other.filter("same").count() < 10


def feistel_by_hand(left, right, n_left, n_right, key, kind):
    for turn in range(pii.ROUNDS):
        half = right if turn % 2 == 0 else left
        seen = int(hashlib.sha256(f"{key}:{kind}:{turn}:{half}".encode()).hexdigest()[:15], 16)
        left, right = ((left + seen) % n_left, right) if turn % 2 == 0 else (left, (right + seen) % n_right)
    return left, right


def test_the_network_equals_plain_python(spark):
    got = spark.range(1).select(pii.feistel(F.lit(5), F.lit(77), F.lit(1000), F.lit(10**8), KEY, "card").alias("o")).first().o
    assert (got.l, got.r) == feistel_by_hand(5, 77, 1000, 10**8, KEY, "card")


# --- decontamination


def brute(texts, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: word.findall((t or "").translate({c: c + 32 for c in range(65, 91)}))
    wins = [(i, tuple(w[s : s + 10])) for i, w in ((i, low(t)) for i, t in items) if w for s in range(max(len(w) - 10, 0) + 1)]
    out = []
    for t in texts:
        w, hit, ids = low(t), set(), set()
        for i, p in wins:
            for s in range(len(w) - len(p) + 1):
                if tuple(w[s : s + len(p)]) == p:
                    hit |= set(range(s, s + len(p)))
                    ids.add(str(i))
        out.append((len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(5)
    pool = ["the", "of", "and", "Éa", "zeta9", "k7", "mu", "nu"]
    items = [(i, " ".join(rng.choice(pool) for _ in range(n))) for i, n in enumerate([14, 10, 3, 1, 25, 0])] + [(6, None), (7, "lone")] + [(8, "lone")]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(30)] + [f"x {t}, y" for _, t in items if t] + [None, "", "!!", "the " * 3000, items[0][1] * 1]
    df = docs(spark, [*texts, texts[30]], ", row string").repartition(3)
    got = sorted(decontaminate.contamination(df, spark.createDataFrame(items, "item_id long, text string").withColumn("w", F.lit(1))).collect(), key=lambda r: r.doc_id)
    want = brute([*texts, texts[30]], items)
    assert [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got] == want


def test_proximity_repeats_and_empty_tables(spark):
    item = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    df = spark.createDataFrame([(1, "alpha beta so gamma delta"), (2, "alpha one two three beta gamma delta"), (3, "alpha beta gamma delta"), (3, "alpha beta gamma delta"), (None, "alpha beta gamma delta")], "doc_id long, text string")
    exact = decontaminate.contamination(df, item).collect()
    assert len(exact) == 5 and sum(r.contaminated for r in exact) == 3
    near = {r.doc_id: r.contaminated for r in decontaminate.contamination(df, item, slop=1).collect()}
    assert near[1] and not near[2] and near[3]
    assert decontaminate.contamination(df.limit(0), item).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(df, item.limit(0)).collect())
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(df.filter("doc_id is not null"), item).collect()) == [1, 2]
