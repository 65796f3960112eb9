"""Alignment of two tokenizers against plain Python, with hot ids and small blocks, over odd texts and tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paddock.llm import token_alignment as ta

ODD = [None, "", " ", "a", "  two  blanks ", "tab\tand\nlines\r\n\n", "▁ meta", "é ü ß ñ", "日本語のテキスト", "😀😀 👩‍👩‍👧", "<|endoftext|> <s> </s> <unk> <0x41>", "\x00\x01", "aaaaaaaaaaaaaaaaaaaaaaa " * 30, "don't we'll I'VE 12345 3.14", " \xa0  x", "end "]


@pytest.fixture(scope="module")
def sides():
    spec, model = ta.side_a(), ta.side_b()
    a = Tokenizer.from_str(spec)
    a.encode_special_tokens = True
    return ta.Aligner(spec, model), a, sentencepiece.SentencePieceProcessor(model_proto=model)


def by_hand(text, sides):
    """Groups of (A ids, B ids) of a text, from the libraries and the vocabularies' own words."""
    _, lib, model = sides
    if not text:
        return []
    letters = {v: k for k, v in ta.byte_of_letter().items()}
    back = {c: b for b, c in letters.items()}
    a, b = lib.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
    a_bytes = [bytes(back[c] for c in lib.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if b"".join(a_bytes) != b" " + text.encode() or b"".join(b_bytes) != b" " + text.encode():
        return []
    groups, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if at_a <= at_b and i < len(a):
            groups[-1][0].append(a[i])
            at_a += len(a_bytes[i])
            i += 1
        else:
            groups[-1][1].append(b[j])
            at_b += len(b_bytes[j])
            j += 1
        if at_a == at_b and groups[-1][1]:
            groups.append(([], []))
    return groups[:-1]


def table_by_hand(rows, sides):
    every = [by_hand(t, sides) for _, t in rows]
    linked = [Counter((x, y) for g in groups for x in g[0] for y in g[1]) for groups in every]
    count = Counter(p for c in linked for p in c)
    best = {}
    for (x, _), c in count.items():
        best[x] = max(best.get(x, 0), c)
    out = []
    for (doc_id, _), groups, c in zip(rows, every, linked):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((
            doc_id, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(c.values()), sum(m for p, m in c.items() if count[p] == best[p[0]]),
            sum(m * count[p] for p, m in c.items()), hashlib.sha256(told.encode()).hexdigest() if told else "",
        ))
    return sorted(out, key=str)


def some_texts(n, seed):
    rng = random.Random(seed)
    words = ["the", "tokenizer", "Größe", "naïve", "12,5", "日本", "😀", "don't", "__init__", "aaaaaa", "\n", "  ", "<s>", "x"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


def test_groups_of_odd_texts(sides):
    texts = ODD + some_texts(40, 1)
    numbers, told, pairs = sides[0](texts)
    for k, text in enumerate(texts):
        groups = by_hand(text, sides)
        assert told[k] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), repr(text)
        mine = Counter({(a, b): m for d, a, b, m in zip(*(p.tolist() for p in pairs)) if d == k})
        assert mine == Counter((x, y) for g in groups for x in g[0] for y in g[1])
        assert [int(n[k]) for n in numbers] == [sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(mine.values())]
    assert told[texts.index("▁ meta")] == "" and told[texts.index("<|endoftext|> <s> </s> <unk> <0x41>")] != ""


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    aligner = _held()
    side, library = aligner.a, aligner.a.library
    assert side.quick is not None and side.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids
    a, b = aligner.tokens(text)
    if len(a):
        assert b"".join(side.bytes[i] for i in a) == b"".join(aligner.b.bytes[i] for i in b) == b" " + text.encode()


_KEPT = []


def _held():
    if not _KEPT:
        _KEPT.append(ta.Aligner(ta.side_a(), ta.side_b()))
    return _KEPT[0]


def test_very_long_texts(sides):
    """A million blanks is beyond the quick pattern; links within groups of many equal tokens are counted, not listed."""
    for text in (" " * 300_000, "a" * 300_000, "ab cd\n" * 40_000):
        numbers, told, pairs = sides[0]([text])
        assert numbers[0][0] > 0 and pairs[3].sum() == numbers[3][0] and told[0].count(";") == numbers[2][0] - 1
        assert len(pairs[0]) < 200


def test_words_and_whole_texts_agree(sides, monkeypatch):
    """What is kept of words, and how many are joined, changes nothing; nor does aligning whole texts."""
    texts = [*ODD, *some_texts(60, 4), "a \nb", "a\n b", "\nab cd", "ab cd\n", "x" * 100 + " y", "one ▁two three", "' 's 't 're"] * 2
    assert sides[0].by_word and ta.words_apart(ta.side_b())
    whole = ta.Aligner(ta.side_a(), ta.side_b())
    whole.by_word = False
    want = whole(texts)
    for units, joined in ((120_000, 2000), (30, 3), (1, 1)):
        monkeypatch.setattr(ta, "CACHE_UNITS", units)
        monkeypatch.setattr(ta, "JOINED", joined)
        own = ta.Aligner(ta.side_a(), ta.side_b())
        for size in (len(texts), 7):
            done = 0
            for k in range(0, len(texts), size):
                numbers, told, pairs = own(texts[k : k + size])
                assert told == want[1][k : k + size]
                for x, y in zip(numbers, want[0]):
                    assert x.tolist() == y[k : k + size].tolist()
                got = list(zip(*(p.tolist() for p in pairs)))
                assert [(d + k, *r) for d, *r in got] == [r for r in zip(*(p.tolist() for p in want[2])) if k <= r[0] < k + size]
                done += len(told)
            assert done == len(texts)


def test_expansion_in_parts(sides, monkeypatch):
    texts = some_texts(30, 7) * 2
    want = sides[0](texts)[2]
    monkeypatch.setattr(ta, "EXPAND", 11)
    for x, y in zip(want, sides[0](texts)[2]):
        assert np.array_equal(x, y)


@pytest.mark.parametrize(("block", "hot"), [(ta.BLOCK, ta.HOT), (40, 25), (300, 1)])
def test_counts_of_hot_and_other_ids(spark, sides, block, hot):
    rows = [(i, t) for i, t in enumerate(ODD + some_texts(80, 3))] + [(3, "a"), (3, "the same"), (None, "the same"), (None, "the same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = ta.align(docs, block_size=block, hot_size=hot)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == table_by_hand(rows, sides)


def test_groups_across_batches(monkeypatch):
    """Counts don't depend on how the sorted rows fall into batches and segments."""
    rng = random.Random(1)
    schema = pa.schema([("a", pa.int32()), ("shard", pa.int32()), ("base", pa.int64()), ("bs", pa.list_(pa.int32())), ("docs", pa.list_(pa.int32())), ("ms", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])
    rows = []
    for a in range(12):
        for base in (0, 1000, 2000):
            pairs = sorted({(rng.randrange(4), rng.randrange(9)) for _ in range(rng.randrange(1, 12))})
            rows.append((a, 0, base, [b for b, _ in pairs], [d for _, d in pairs], [rng.randrange(1, 4) for _ in pairs], None))
    heads = {a: Counter(b for r in rows if r[0] == a for b in r[3]) for a in (3, 7)}
    dealt = sorted([(r[0], r[2] % 2 if r[0] in heads else 0, *r[2:]) for r in rows] + [(a, s, None, list(c), None, None, [c[b] for b in c]) for a, c in heads.items() for s in (0, 1)], key=lambda r: (r[0], r[1], rng.random()))
    want = {}
    for a, _, base, bs, docs, ms, _ in rows:
        count = Counter(b for r in rows if r[0] == a for b in r[3])
        for b, d, m in zip(bs, docs, ms):
            s, t = want.get(base + d, (0, 0))
            want[base + d] = (s + m * count[b], t + (m if count[b] == max(count.values()) else 0))
    for size, piece in ((1, 1), (2, 5), (3, 1), (7, 20), (100, 3), (100, 10**6)):
        monkeypatch.setattr(ta, "PIECE", piece)
        batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in dealt[k : k + size]], schema) for k in range(0, len(dealt), size)]
        got = {}
        for out in ta._contributions(iter([schema.empty_table().to_batches()[0] if schema.empty_table().to_batches() else pa.RecordBatch.from_pylist([], schema), *batches])):
            for r in out.to_pylist():
                s, t = got.get(r["row"], (0, 0))
                got[r["row"]] = (s + r["count_sum"], t + r["n_best"])
        assert got == want


def test_empty_tables_and_other_columns(spark, sides):
    docs = spark.createDataFrame([(1, "one two", "x")], "doc_id int, text string, row string")
    assert [tuple(r) for r in ta.align(docs).collect()] == table_by_hand([(1, "one two")], sides)
    assert ta.align(docs.limit(0)).collect() == [] and ta.align(docs.withColumn("text", ta.F.lit(None).cast("string"))).first().groups_sha256 == ""


def test_query(spark, sides, tmp_path):
    some = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    some.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, ta.op12_cross_tokenizer_alignment(spark, str(tmp_path)).collect()), key=str) == table_by_hand(rows, sides)
