"""Runs of periodic words against their definition, and the query against its SQL."""

import hashlib
import random
import zlib

import duckdb
import pytest
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

from paddock.llm import periodic


def by_definition(words, least=6, repeats=4):
    """Every maximal stretch of each period, without those whose period is not the smallest."""
    n, found = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            m = j - i + q
            smaller = any(q % p == 0 and all(words[k] == words[k + p] for k in range(i, i + m - p)) for p in range(1, q))
            if j > i and m >= max(least, repeats * q) and not smaller:
                found.append((i, m, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def digests(doc_id, text):
    """The contract's row of a document, from the definition."""
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text or "").split(" ") if w]
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = by_definition(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None, None, None))
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha(told), sha(kept))


def test_runs_by_definition():
    rng = random.Random(5)
    for _ in range(1500):
        words = [rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randrange(70))]
        for _ in range(rng.randrange(3)):
            if len(words) > 4:
                a = rng.randrange(len(words))
                p = 1 + (len(words) - a) // rng.randrange(3, 11)
                stop = len(words) - rng.randrange(4)
                for i in range(a, stop):
                    words[i] = words[a + (i - a) % p]
        want = by_definition(words)
        assert periodic.runs_of(words) == want
        assert periodic.runs_of_words([b"%d" % w for w in words]) == want
        assert periodic.runs_of(words, 2, 2) == by_definition(words, 2, 2)
        assert periodic.runs_of_words([b"%d" % w for w in words], 5, 3) == by_definition(words, 5, 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(1, 9)), max_size=12))
def test_any_words(parts):
    words = [w for w, times in parts for _ in range(times)]
    assert periodic.runs_of(words, 2, 2) == by_definition(words, 2, 2)


@pytest.mark.parametrize("n", [5000, 60_000])
def test_long_texts_of_one_word_and_of_long_periods(n):
    assert periodic.runs_of([0] * n) == [(0, n, 1)]
    q = n // 5
    assert periodic.runs_of_words([b"%d" % (i % q) for i in range(n)]) == [(0, n, q)]
    mixed = [b"%d" % (i * i % 7919) for i in range(n)] + [b"a", b"b"] * 4 + [b"c"] * 6
    assert periodic.runs_of_words(mixed)[-2:] == [(n, 8, 2), (n + 8, 6, 1)]


def test_blocks_of_end_positions():
    rng, some = random.Random(3), sorted(random.Random(4).sample(range(100_000), 9000))
    order = some[1:]
    rng.shuffle(order)
    ends = periodic.Ends(some[0])
    for x in order:
        ends.add(x)
    assert list(ends) == some and len(ends.blocks) > 3 and ends.size == len(some)
    for k in (0, 1, 1023, 1024, 1025, 5000, len(some) - 1):
        assert ends.around(some[k]) == (some[k - 1] if k else -1, some[k + 1] if k + 1 < len(some) else -1)


def test_odd_rows_and_columns(spark):
    rows = [(1, None, "x"), (1, "", "x"), (None, " \t\n", None), (2, "a a a a a a a", "y"), (2, "a a a a a a a", "y"), (3, "é\xa0é é\xa0é " * 6, "z"), (4, "one two", None), (5, "x y " * 5000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    out = periodic.find_runs(docs).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.text): (r.runs, r.collapsed) for r in out}
    assert got[1, None] == got[1, ""] == got[None, " \t\n"] == ([], "")
    assert got[2, "a a a a a a a"] == ([(0, 7, 1)], "a") and got[3, rows[5][1]] == ([(0, 12, 1)], "é\xa0é")
    assert got[4, "one two"] == ([], "one two") and got[5, rows[7][1]] == ([(0, 10000, 2)], "x y")
    empty = periodic.find_runs(docs.limit(0))
    assert empty.collect() == [] and empty.columns == ["doc_id", "text", "runs", "collapsed"]


def test_query_over_odd_ids(spark, tmp_path):
    text = " ".join(f"w{i * i % 97}" for i in range(120))
    rows = [(i, text) for i in range(60)] + [(None, "a b " * 6), (7, None), (50, ""), (61, " one\ttwo\ntwo  three"), (-3, "z " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, periodic.op11_periodic_runs(spark, str(tmp_path)).collect()), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(60)) > 3
    assert [g for g in got if g[0] is not None] == sorted((digests(*r) for r in rows if r[0] is not None), key=str)
    assert [g[1:5] for g in got if g[0] is None] == [(1, 0, 12, 2)]


def test_query_against_sql_and_definition(spark):
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    out = periodic.op11_periodic_runs(spark, DATA)
    assert out.columns == names
    got = sorted(map(tuple, out.collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    assert got == sorted(db.execute(periodic.OP11_SQL).fetchall())
    short = db.execute("SELECT doc_id, text FROM documents WHERE strlen(text) < 2000").fetchall()
    assert len(short) > 50 and {digests(*r) for r in short} <= set(got)
    assert any(r[1] for r in got)
