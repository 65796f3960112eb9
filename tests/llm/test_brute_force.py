"""Whole texts of pseudonyms and scores of toxicity against plain Python; every stage of the pipeline over odd tables."""

import datetime as dt
import hashlib
import math
import random
import re

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_native import feistel_by_hand, luhn

import corpus_pipeline
from paddock.llm import pii, toxicity
from paddock.llm.pii import TEST_KEY as KEY

# --- pseudonyms


def digits_moved(digits, kind):
    a = len(digits) // 2
    b = len(digits) - a
    left, right = feistel_by_hand(int(digits[:a]), int(digits[a:]), 10**a, 10**b, KEY, kind)
    return f"{left:0{a}d}{right:0{b}d}"


def put(form, digits):
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def date_moved(value):
    day0 = dt.date(1800, 1, 1)
    for like, java, form in ((r"\d{4}-", "yyyy-MM-dd", "%Y-%m-%d"), (r"\d{4}/", "yyyy/MM/dd", "%Y/%m/%d"), (r"\d{2}\.", "dd.MM.yyyy", "%d.%m.%Y"), (r"\d{2}/", "dd/MM/yyyy", "%d/%m/%Y"), (r"\d{2}/", "MM/dd/yyyy", "%m/%d/%Y")):
        if not re.match(like, value):
            continue
        try:
            day = (dt.datetime.strptime(value, form).date() - day0).days
        except ValueError:
            continue
        inner = pii.DATE_RADICES[0] * pii.DATE_RADICES[1]
        near = 0 <= day < inner
        place = day if near else day + pii.DAYS_BEFORE - (0 if day < 0 else inner)
        a, b = pii.DATE_RADICES if near else pii.OTHER_RADICES
        left, right = feistel_by_hand(place % a, place // a, a, b, KEY, f"date:{java}")
        new = right * a + left
        if not near:
            new = new - pii.DAYS_BEFORE + (0 if new < pii.DAYS_BEFORE else inner)
        day = day0 + dt.timedelta(new)
        return java.replace("yyyy", f"{day.year:04d}").replace("MM", f"{day.month:02d}").replace("dd", f"{day.day:02d}")
    return None


def email_moved(value):
    name, host = value.split("@")
    left, right = name[: len(name) // 2], name[len(name) // 2 :]

    def shifted(text, other, turn):
        stream, out = hashlib.sha256(f"{KEY}:email:{turn}:{len(text)}:{other}".encode()).digest(), ""
        for c, step in zip(text, stream):
            kind = next((k for k in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789") if c in k), None)
            out += kind[(kind.index(c) + step) % len(kind)] if kind else c
        return out

    for turn in range(pii.ROUNDS):
        left, right = (shifted(left, right, turn), right) if turn % 2 == 0 else (left, shifted(right, left, turn))
    return f"{left}{right}@{host}"


def moved(value):
    """The pseudonym by hand, or None if the value isn't valid."""
    kind, digits = next(k for k, p in pii.PATTERNS.items() if re.fullmatch(p, value)), re.sub("[^0-9]", "", value)
    if kind == "email":
        return email_moved(value)
    if kind == "phone":
        return put(value, digits[:-10] + digits_moved(digits[-10:], "phone"))
    if kind == "card":
        if not luhn(digits):
            return None
        paid = digits_moved(digits[:-1], "card")
        return put(value, next(paid + c for c in "0123456789" if luhn(paid + c)))
    if kind == "ssn":
        area, group, serial = map(int, value.split("-"))
        if not (1 <= area <= 899 and area != 666 and group and serial):
            return None
        left, right = feistel_by_hand((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, KEY, "ssn")
        area = left // 99 + 1
        return f"{area + (area >= 666):03d}-{left % 99 + 1:02d}-{right + 1:04d}"
    if kind == "date":
        return date_moved(value)
    parts = value.split(".")
    if any(int(p) > 255 or (p[0] == "0" and len(p) > 1) for p in parts):
        return None
    a, b, c, d = map(int, parts)
    left, right = feistel_by_hand(a * 256 + b, c * 256 + d, 65536, 65536, KEY, "ip")
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


def test_rewritten_texts_equal_plain_python(spark):
    rng, digit = random.Random(2), lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    def some():
        return rng.choice([
            lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", lambda: f"+{digit(1)} ({digit(3)}) {digit(3)}-{digit(4)}", lambda: f"({digit(3)}) {digit(3)}-{digit(4)}", lambda: digit(16),
            lambda: next(c for c in iter(lambda: digit(rng.randrange(13, 20)), "") if luhn(c)), lambda: ".".join(str(rng.randrange(280)) for _ in range(4)), lambda: f"{rng.randrange(1, 2600):04d}-{rng.randrange(14):02d}-{rng.randrange(33):02d}",
            lambda: f"{rng.randrange(32):02d}.{rng.randrange(13):02d}.{rng.randrange(1700, 2300)}", lambda: f"{rng.randrange(32):02d}/{rng.randrange(32):02d}/{rng.randrange(1900, 2100)}",
            lambda: f"{rng.choice('abXY9')}{''.join(rng.choice('ab.C_-7') for _ in range(rng.randrange(9)))}@{rng.choice(['a.b', 'x-y.com', 'm.co.uk', '-bad.org', 'a-.b'])}", lambda: rng.choice(["word", "v1.2", "2024", "x@", "--", "日本", "\n"]),
        ])()

    texts = [rng.choice(" ,;\n").join(some() for _ in range(rng.randrange(12))) for _ in range(250)]
    got = {r.doc_id: r.text for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    for i, text in enumerate(texts):
        assert got[i] == re.sub(pii.ANY, lambda m: moved(m.group()) or m.group(), text), text


def test_hosts_of_very_many_labels(spark):
    """Hosts of many labels, many hyphens and one long label are found without a stack."""
    texts = ["a@" + "b." * 200_000 + "c", "a@" + "b-" * 100_000 + "c.d", "a@" + "b" * 300_000 + ".d", "a" * 300_000, "a@" * 50_000, "1" * 300_000]
    out = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), KEY).collect()}
    assert [len(out[i].text) for i in range(6)] == [len(t) for t in texts]
    assert all(out[i].pii_found[0].kind == "email" and out[i].text[1:] == texts[i][1:] for i in range(3))


# --- toxicity


def test_scores_equal_plain_python():
    """A document's score: over half overlapping windows, the sigmoid of the greatest mean of its words' mean n-gram logits."""
    rng = random.Random(6)
    words = ["moron", "kind", "a", "weather", "m0ron", "stupid!", "(rain)", "élan", "日本語"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(40))) for _ in range(80)]
    model = toxicity.train(texts, [int("moron" in t) for t in texts])

    def bucket(points, n):
        h = 0
        for c in points:
            h = (h * 1_000_003 + c) % 2**64
        return ((h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % toxicity.BUCKETS

    def logit(word):
        points = [ord(c) for c in f"<{word}>"]
        whole = sum(c * pow(1_000_033, k, 2**64) for k, c in enumerate(points)) % 2**64
        ids = [(whole * 0x9E3779B97F4A7C15 % 2**64 >> 40) % toxicity.BUCKETS]
        ids += [bucket(points[i : i + n], n) for n in toxicity.GRAMS for i in range(len(points) - n + 1)]
        return sum(model.gram_logit[i] for i in ids) / len(ids)

    def score(text):
        values = [logit(toxicity.normal(t)) for t in text.lower().split()]
        counted = [0.0 if k and v == values[k - 1] else v for k, v in enumerate(values)]
        half = toxicity.WINDOW // 2
        means = [sum(counted[s : s + 2 * half]) / toxicity.WINDOW for s in range(0, len(values), half)]
        return 1 / (1 + math.exp(-max(-40, min(40, (max(means) if means else 0.0) + model.bias))))

    got = toxicity.Scorer(model)([*texts, None, ""])
    assert np.allclose(got, [*map(score, texts), score(""), score("")])


# --- the pipeline's stages over odd tables


@pytest.fixture(scope="module")
def odd(spark):
    text = lambda seed: " ".join(f"w{(seed * 7919 + i * i) % 997}" for i in range(60))
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(1, None), (None, text(1)), (2, ""), (2, ""), (3, " \n\t"), (None, None), (4, text(2)), (4, text(2)), (5, "long " * 100_000 + text(3)), (6, "mail bob@x.org " + text(4)), (7, item + " " + text(5)), (None, item), (8, "日本語 🎉 \x00 " + text(6)), (9, ">" * 5000)]
    df = spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "own") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, label string")
    for name in ("_row", "fp", "toxicity", "ids", "row", "pii_found", "term"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


def test_every_stage_handles_odd_rows(spark, odd):
    kept, sizes = odd, []
    for name, stage in corpus_pipeline.STAGES:
        if name == "sentencepiece_wfst":
            kept = kept.drop("ids")
        before, kept = kept, stage(spark, kept, DATA).cache()
        sizes.append(kept.count())
        assert kept.columns[: len(before.columns)] == before.columns and kept.filter("label is null or label <> 'own'").isEmpty()
    # toxicity keeps all; one of the texts without a word, one of each pair of copies stays; both rows with the item go
    assert sizes[0] == 14 and sizes[2:] == [sizes[1] - 2] * 3 and sizes[1] == 9
    assert kept.filter("not round_trip").isEmpty() and not kept.filter("doc_id is null").isEmpty()
    assert kept.filter("doc_id = 6 and text like 'mail bob@x.org%'").isEmpty() and not kept.filter("doc_id = 6").isEmpty()


def test_every_stage_handles_an_empty_table(spark, odd):
    for name, stage in corpus_pipeline.STAGES:
        rows = odd.drop("ids") if name == "sentencepiece_wfst" else odd
        assert stage(spark, rows.limit(0), DATA).count() == 0
