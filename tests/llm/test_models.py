"""The operators that run Python in tasks: exact round trips, brute force and held-out accuracy, with odd inputs."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import DATA
from pyspark.sql import functions as F

from paddock.llm import flac, language_id, rans_tokens, sentencepiece_wfst, simhash, toxicity
from paddock.llm import queries as corpus

ODD = [None, "", " ", "a", "héllo\n\nwörld  ", "日本語テキスト 🎉🎉 x", "   a  b", "\t8spaces        and more", "it's 12345 <|endoftext|> don't", "a\x00b", "word " * 30_000, "x" * 50_000]


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "e") for i, t in enumerate(texts)], "doc_id long, text string, media string").repartition(2)


# --- SentencePiece


def test_ids_equal_the_library_and_decode(spark):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [*ODD, *[r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]]
    model = sentencepiece_wfst.model_bytes()
    rows = sentencepiece_wfst.decode(sentencepiece_wfst.encode(docs(spark, texts).withColumn("ids", F.lit(1)), model), model)
    for r in rows.collect():
        assert r.ids == library.encode(r.text or ""), repr(r.text)[:60]
        assert r.decoded == (r.text or "")
    assert sentencepiece_wfst.encode(docs(spark, texts).limit(0), model).count() == 0


def test_unigram_paths_are_the_lightest():
    pieces, rng = ["<unk>", "▁", "a", "b", "ab", "ba", "aba", "▁a", "bab"], random.Random(3)
    fst = sentencepiece_wfst.Transducer(pieces, [0, -2.0, -3.0, -3.1, -4.0, -4.4, -6.5, -3.5, -7.7], [2] + [1] * 8, sentencepiece_wfst.UNIGRAM)

    def lightest(text):
        best = {0: 0.0}
        for i in range(1, len(text) + 1):
            best[i] = min(best[j] - fst.scores[fst.ids[text[j:i]]] for j in range(i) if text[j:i] in fst.ids)
        return best[len(text)]

    for _ in range(200):
        text = "▁" + "".join(rng.choice("ab") for _ in range(rng.randrange(1, 12)))
        path = fst.shortest_path(text)
        assert "".join(path) == text and sum(-fst.scores[fst.ids[p]] for p in path) == pytest.approx(lightest(text))


def message(number, data):
    """A length-delimited protobuf field."""
    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    return varint(number << 3 | 2) + varint(len(data)) + data


@pytest.mark.parametrize("rule", ["identity", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix, squeeze, user", [(0, 0, 1), (0, 1, 0), (1, 0, 0), (1, 1, 1)])
def test_normalisers_equal_the_library(rule, prefix, squeeze, user):
    import sentencepiece

    fields = sentencepiece_wfst._fields
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    blob = dict(fields(dict(fields(own))[3])).get(2, b"")
    spec = (message(2, blob) if blob else b"") + bytes([3 << 3, prefix, 4 << 3, squeeze, 5 << 3, 1])
    model = b"".join(message(n, v) for n, v in fields(sentencepiece_wfst.model_bytes()) if n != 3) + message(3, spec)
    if user:
        model += message(1, message(1, b"<sep>") + bytes([3 << 3, sentencepiece_wfst.USER_DEFINED]))
    rng, alphabet = random.Random(1), [*"abc  \n\tＡｆﬁ①²éÅ½日🎉▁.,<>\u200b\u00a0", "<sep>", "<sep", " the ", "ing"]
    texts = ["", "   ", "▁▁a", "ＡＢＣ　x  y ﬁ", *("".join(rng.choice(alphabet) for _ in range(rng.randrange(30))) for _ in range(400))]
    library, codec = sentencepiece.SentencePieceProcessor(model_proto=model), sentencepiece_wfst.Codec(model)
    assert [x.tolist() for x in codec.encode_all(texts)] == [library.encode(t) for t in texts]
    for text in texts:
        assert codec.encode(text).tolist() == library.encode(text), text
        assert codec.decode(codec.encode(text)) == library.decode(library.encode(text)), text


def test_bpe_paths_are_those_of_merging():
    rng = random.Random(4)
    pieces = ["<unk>", "a", "b", "c", "ab", "bc", "ca", "abc", "bca", "abab", "cc"]
    fst = sentencepiece_wfst.Transducer(pieces, [0.0, *[-float(k) for k in range(1, 11)]], [2] + [1] * 10, sentencepiece_wfst.BPE)
    for _ in range(300):
        text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 14)))
        assert fst.shortest_path(text) == fst.merged(text)
        if "d" not in text:
            assert fst.in_step([text, "ab"])[text] == np.array(fst.path_ids(text), np.uint32).tobytes()


# --- FLAC


def test_flac_round_trips():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 5, 16, 63, 64, 100, 4096, 4097, 8192, 10_000):
        some = [rng.integers(-128, 128, n), np.zeros(n, int), (100 * np.sin(np.arange(n) / 7)).astype(int)]
        back = flac.decode_all(flac.encode_all([x.astype(np.int8) for x in some]))
        for x, (pcm, blocks) in zip(some, back):
            assert (pcm[0] == x).all() and [a for a, _ in blocks] == list(range(0, n, flac.BLOCK))
    wide = rng.integers(-30_000, 30_000, 5000)
    assert (flac.decode_all(flac.encode_all([wide], 16))[0][0][0] == wide).all()


def test_flac_damage_is_found_and_seek_tables_are_optional():
    x = (90 * np.sin(np.arange(9000) / 9)).astype(np.int8)
    stream = flac.encode_all([x])[0]
    for place in (70 + 60, len(stream) // 2, len(stream) - 1):
        bad = bytearray(stream)
        bad[place] ^= 4
        with pytest.raises(ValueError):
            flac.decode_all([bytes(bad)])
    size = int.from_bytes(stream[43:46], "big")
    bare = stream[:4] + b"\x80" + stream[5:42] + stream[46 + size :]
    assert (flac.decode_all([bare])[0][0][0] == x).all()


def test_flac_special_subframes():
    """A frame written by hand: constant and verbatim subframes of two channels, wasted bits, side channel."""
    def frame(layout, subframes):
        bits = "".join(subframes)
        body = int(bits + "0" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
        head = bytes([0xFF, 0xF8, 0x60, layout << 4 | 0x02, 0x00, 3])
        data = head + bytes([flac.crc8(head)]) + body
        return data + int(flac.crc16_runs(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0]).to_bytes(2, "big")

    info = bytes([0, 16, 0, 16]) + bytes(6) + (8000 << 44 | 1 << 41 | 7 << 36 | 4).to_bytes(8, "big") + bytes(16)
    head = b"fLaC\x80" + len(info).to_bytes(3, "big") + info
    verbatim = "0" + "000001" + "0" + "".join(f"{v & 0xFF:08b}" for v in (1, -2, 3, 100))
    wasted = "0" + "000000" + "1" + "01" + f"{20 & 0x3F:06b}"  # two wasted bits: 20 << 2
    pcm, _ = flac.decode_all([head + frame(1, [verbatim, wasted])])[0]
    assert pcm.tolist() == [[1, -2, 3, 100], [80] * 4]
    side = "0" + "000000" + "0" + f"{5:09b}"
    pcm, _ = flac.decode_all([head + frame(8, [verbatim, side])])[0]
    assert pcm.tolist() == [[1, -2, 3, 100], [-4, -7, -2, 95]]


def test_media_columns(spark):
    import hashlib

    stored = flac.store(docs(spark, ODD).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")))
    for r in flac.features(flac.decoded(stored)).collect():
        data = flac.payload(ODD[r.doc_id])
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    blocks = flac.pcm_blocks(stored).filter("doc_id = 10").orderBy("sample_offset").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == flac.payload(ODD[10]) and [b.sample_offset for b in blocks] == list(range(0, len(flac.payload(ODD[10])), flac.BLOCK))
    assert flac.features(flac.decoded(stored.limit(0))).count() == 0
    lost = flac.decoded(stored.filter("doc_id in (0, 3)").withColumn("media", F.when(F.col("doc_id") == 3, F.col("media")))).orderBy("doc_id").collect()
    assert (lost[0].blocks, lost[0].media_bytes) == (None, None) and bytes(lost[1].blocks[0].pcm) == flac.payload(ODD[3])


# --- toxicity


def test_toxic_documents_are_found_and_clean_ones_stay(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "he", "in", "ed"]) for _ in range(rng.randrange(1, 4)))
    def text(bad, n=60):
        words = [word() for _ in range(n)]
        for _ in range(3 * bad):
            words[rng.randrange(n)] = rng.choice(["moron", "stupid", "trash", "idiot"])
        return " ".join(words)

    rows = [(i, text(i % 2), i % 2) for i in range(400)]
    model = toxicity.train([t for _, t, _ in rows[:300]], [y for *_, y in rows[:300]])
    scores = toxicity.Scorer(model)([t for _, t, _ in rows[300:]])
    assert np.mean((scores >= 0.5) == np.array([y for *_, y in rows[300:]])) > 0.97
    long = " ".join([text(0, 4000), "you stupid moron", text(0, 4000)])
    clean, misspelt, found = toxicity.Scorer(model)([text(0, 8000), text(0) + " stupidd morons", long])
    assert clean < 0.5 < found and misspelt > clean
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "you stupid moron", "c"), (3, "you stupid moron", "c")], "doc_id long, text string, toxicity string")
    assert sorted((r.doc_id, r.toxicity >= 0.5) for r in toxicity.score(df, model).collect()) == [(1, False), (2, False), (3, True), (3, True)]


def test_labels_of_one_class_or_none():
    assert toxicity.Scorer(toxicity.train([], []))(["x"])[0] < 0.5
    assert toxicity.Scorer(toxicity.train(["a b"], [1]))(["x"])[0] > 0.5


def test_held_out_labels_are_not_read(spark):
    d = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(200)] + [(None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    used = {int(r.text.split()[1]) for r in toxicity.training_sample(d, labels).collect()}
    assert used == {i for i in range(200) if zlib.crc32(str(i).encode()) % 5}


# --- token files


def test_rans_round_trips_and_damage():
    rng = np.random.default_rng(1)
    for n in (1, 5, 32, 33, 1000, rans_tokens.BLOCK, rans_tokens.BLOCK + 1, 100_000):
        ids = (rng.zipf(1.3, n) % 50_257).astype(np.uint16)
        chunk = rans_tokens.encode(ids)
        assert (rans_tokens.decode(chunk) == ids).all()
    b = rans_tokens.BLOCK
    assert (rans_tokens.decode(chunk, range(2, 4)) == ids[2 * b : 4 * b]).all()
    for place in (-5, 20):
        bad = bytearray(chunk)
        bad[place] ^= 1
        with pytest.raises(ValueError):
            rans_tokens.decode(bytes(bad))
    wide = rng.integers(0, 50_257, 300_000).astype(np.uint16)
    assert (rans_tokens.decode(rans_tokens.encode(wide)) == wide).all()


def test_token_files_equal_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(rans_tokens, "CHUNK_IDS", 20_000)
    library = Tokenizer.from_str(rans_tokens.tokenizer_spec())
    texts = [*ODD, *[r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()]]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, "none", "e"), (3, "b", "e")], "doc_id long, text string, media string"))
    chunks = rans_tokens.write_tokens(df, rans_tokens.tokenizer_spec())
    got = sorted(rans_tokens.read_tokens(chunks).collect(), key=lambda r: r.start)
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == sorted([*range(len(texts)), 3, -1])
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
        if r.doc_id is not None and r.doc_id != 3:
            ids = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0]
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert rans_tokens.read_tokens(rans_tokens.write_tokens(df.limit(0), rans_tokens.tokenizer_spec())).count() == 0


# --- language


def test_automaton_has_all_substrings_and_no_other():
    rng = random.Random(2)
    text = [rng.randrange(3) for _ in range(40)]
    to = language_id.suffix_automaton(text)

    def has(part):
        state = 0
        for c in part:
            if c not in to[state]:
                return False
            state = to[state][c]
        return True

    inside = {tuple(text[i:j]) for i in range(40) for j in range(i, 41)}
    assert all(has(p) for p in inside)
    for _ in range(300):
        part = tuple(rng.randrange(3) for _ in range(rng.randrange(1, 8)))
        assert has(part) == (part in inside)


def test_phrases_equal_greedy_parsing():
    samples = {"a": "the cat sat on the mat " * 3, "b": "le chat est sur le tapis"}
    parser = language_id.Parser(samples)
    for text in ("the cat", "le chat sat", "zzz the", "x" * 1000 + " mat"):
        for k, language in enumerate(parser.languages):
            inside = "".join(chr(c) for c in parser.codes(samples[language])[0])
            n, codes = 0, "".join(chr(c) for c in parser.codes(text)[0])
            for w in range(0, len(codes), language_id.WINDOW):
                part, at = codes[w : w + language_id.WINDOW], 0
                while at < len(part):
                    size = 1
                    while at + size < len(part) and part[at : at + size + 1] in inside:
                        size += 1
                    at, n = at + (size if part[at] in inside else 1), n + 1
            assert abs(parser.phrases([text])[0][0, k] - n) <= sum(c == chr(1) or c not in inside for c in codes), (text, language)


def test_languages_are_told_apart(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = corpus.QUERIES["op8_language_id"](spark, DATA).join(df.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.9
    odd = language_id.identify(spark.createDataFrame([(1, None, "x"), (2, "12 34", "x"), (3, "", "x"), (4, "the and of", "x"), (5, "🎉", "x")], "doc_id long, text string, lang_pred string"), {"en": "the and of it", "de": "der die das"})
    assert {r.doc_id: r.lang_pred for r in odd.collect()} == {1: "und", 2: "und", 3: "und", 4: "en", 5: "und"}
    assert language_id.fit(df.limit(0)) == {} and {r.lang_pred for r in language_id.identify(df, {}).collect()} == {"und"}


def test_each_script_keeps_its_letters():
    rng = random.Random(4)
    scripts = {"el": (0x3B1, 24), "en": (0x61, 26), "hi": (0x915, 36), "ja": (0x4E00, 1500), "ko": (0xAC00, 1500), "ru": (0x430, 32), "zh": (0x20000, 1500)}

    def text(language, words):
        first, n = scripts[language]
        return " ".join("".join(chr(first + rng.randrange(n)) for _ in range(rng.randrange(2, 7))) for _ in range(words))

    samples = {k: text(k, 3000)[: language_id.SAMPLE_LETTERS] for k in scripts}
    samples["xx"] = "tiny"
    parser = language_id.Parser(samples)
    asked = [k for k in scripts for _ in range(20)]
    assert parser.predict([text(k, 40) for k in asked])[0] == asked
    for (cells, start), language in zip(parser.tables, parser.languages):
        assert len(cells) < 12 * language_id.SAMPLE_LETTERS
        codes = parser.codes(samples[language])[0].tolist()
        for _ in range(20):
            at = rng.randrange(len(codes))
            state = 0
            for c in codes[at : at + 300]:
                assert cells[state + c] >> 32 == state
                state = cells[state + c] & 0xFFFFFFFF


def test_every_labelled_language_is_learnt(spark):
    names = [f"l{i:03}" for i in range(130)]
    rows = [(4 * i, f"{n} " + chr(0x4E00 + 50 * i) * 3, n) for i, n in enumerate(names)]
    rows += [(10_000 + i, "long " * 2000, "long") for i in range(8)] + [(20_000 + i, t, "both") for i in range(8) for t in ("short", "whole " * 60)] + [(1, "12 34", "none"), (2, None, "none"), (3, "", "none")]
    samples = language_id.fit(spark.createDataFrame([(10 * i, t, n) for i, t, n in rows] + [(10 * i + 3, t, n) for i, t, n in rows], "doc_id long, text string, lang string").repartition(5))
    held = {f"l{i:03}" for i in range(130) if all(zlib.crc32(str(d).encode()) % 4 == 2 for d in (40 * i, 40 * i + 3))}
    assert set(samples) == set(names) - held | {"long", "both"} and len(samples) > 102
    assert "short" not in samples["both"] and len(samples["long"]) == language_id.SAMPLE_LETTERS


# --- SimHash


def fingerprint(text):
    words = (text or "").encode().translate(simhash._FOLD).split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_and_components_equal_brute_force(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice(["Alpha", "beta", "gamma", "delta", "eta", "mu"]) for _ in range(rng.choice([1, 2, 3, 40, 300]))) for _ in range(60)]
    texts = [*ODD[:9], *base, *base[:10], *[t + " x" for t in base], *[t.replace("beta", "BETA") for t in base[:5]]]
    df = docs(spark, texts).withColumn("fp", F.lit(1)).withColumn("component_id", F.lit(1))
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    prints = [fingerprint(t) for t in texts]
    assert [int(got[i].fingerprint, 16) for i in range(len(texts))] == prints
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(len(texts)):
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[j] < label[i]:
                    label[i], changed = label[j], True
    assert [got[i].component_id for i in range(len(texts))] == label
    assert sorted(r.doc_id for r in simhash.keep_first(df).collect()) == sorted(set(label))
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_no_pair_within_three_bits_is_pruned(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(60):
        a = rng.getrandbits(64)
        prints.add(a)
        for n in (1, 2, 3, 4):
            prints.add(a ^ sum(1 << b for b in rng.sample(range(64), n)))
    prints = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    want = {(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = [tuple(r) for r in simhash.links(spark.createDataFrame([(p, 0) for p in prints], "fp long, label long")).collect()]
    assert Counter(got) == Counter(want)


def test_long_chains_are_one_component(spark):
    n = 70
    nodes = spark.createDataFrame([(i * 3 % n, i * 3 % n) for i in range(n)], "node long, label long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(n - 1) if i != 30], "a long, b long")
    assert {r.node: r.label for r in simhash.components(nodes, edges).collect()} == {i: 0 if i <= 30 else 31 for i in range(n)}
