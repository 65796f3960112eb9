"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a sample of its labelled texts. A text is cross-parsed greedily: from
each phrase's start the automaton gives the longest match, then the next phrase begins; a letter that the sample lacks
is a phrase. A phrase costs log2 of the sample's size (a pointer into it), so phrases are comparable between samples of
different sizes; a sample of under LEAST_SIZE letters counts as one of so many, and a letter that a sample lacks costs as
much as a pointer into the largest one, else the smallest samples would take what they don't know. The language with the least cost wins, the first in order of the alphabet of equal ones.

Every labelled language with a document outside the held-out fold has an automaton over all letters of its sample. Arcs
are laid into one another in a sparse table, so memory goes with the arcs, not with states times letters.

Phrases end at the borders of windows of WINDOW letters, so that the windows of all texts of a batch are parsed in step
with each other, one table lookup for a letter; the whole text is parsed. This departs from one parse of the whole text by at most
a phrase a window and language (its effect is in the README). Text is lower-cased; all that is no letter
counts as a blank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fold_of, held, pieces, table

WINDOW, LEAST_SIZE = 512, 256
#: The bound of the training sample of a language: letters, from documents of so many bytes (of any size where a language
#: has none of these), by hash of the id.
SAMPLE_LETTERS, SAMPLE_DOCS, DOC_BYTES = 24_000, 60, (200, 8192)
#: The first documents of a language are picked in so many groups of tasks, then among those.
GROUPS = 32
UNKNOWN = "und"


def suffix_automaton(text: list[int]) -> list[dict[int, int]]:
    """The transitions of the minimal automaton of all substrings; state 0 is the start."""
    to, link, size, last = [{}], [-1], [0], 0
    for c in text:
        new = len(to)
        to.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                copy = len(to)
                to.append(dict(to[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = copy
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = copy
                    p = link[p]
        last = new
    return to


def laid(to: list[dict[int, int]]) -> np.ndarray:
    """The arcs in one table. A state is known by its place, a number of its own (0: the start); cell place + symbol holds
    the place whose arc it is, times 2^32, and the place the arc leads to; -1 is an empty cell."""
    place, taken, cells, at = {0: 0}, {0}, dict.fromkeys(to[0], 0), 1
    wide = sorted((s for s in range(1, len(to)) if len(to[s]) > 1), key=lambda s: (-len(to[s]), s))
    for s in wide:
        while at in taken or any(at + c in cells for c in to[s]):
            at += 1
        place[s] = at
        taken.add(at)
        cells.update((at + c, s) for c in to[s])
    # states with one arc fill the gaps
    at = 0
    for s in sorted((s for s in range(1, len(to)) if len(to[s]) == 1), key=lambda s: (*to[s], s)):
        (c,) = to[s]
        while at in cells or at <= c or at - c in taken:
            at += 1
        place[s] = at - c
        taken.add(at - c)
        cells[at] = s
    end = max(taken) + 1
    for s in range(1, len(to)):
        if not to[s]:
            place[s] = end
            end += 1
    out = np.full(end + max(cells, default=0) + 1, -1, np.int64)
    for cell, s in cells.items():
        out[cell] = place[s] << 32 | place[to[s][cell - place[s]]]
    return out


class Parser:
    """The laid-out automata of all languages over one numbering of the letters of all samples."""

    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        self.is_letter = np.array([chr(c).isalpha() for c in range(0x110000)])
        letters = sorted({c for t in samples.values() for c in t.lower() if c.isalpha()})
        # symbol 0: a blank, 1: a letter that no sample has
        self.symbol = self.is_letter.astype(np.int32)
        self.symbol[[ord(c) for c in letters]] = np.arange(len(letters)) + 2
        self.tables, self.bits, self.lacks = [], [], []
        for language in self.languages:
            codes, _ = self.codes(samples[language])
            to = suffix_automaton(codes.tolist())
            cells = laid(to)
            # behind the cells is a place without arcs, where each window begins and a letter that the sample lacks leads
            start = np.full(len(letters) + 2, len(cells), np.int64)
            start[list(to[0])] = cells[list(to[0])] & 0xFFFFFFFF
            self.tables.append((np.concatenate([cells, np.full(len(letters) + 2, -1)]), start))
            self.lacks.append(~np.isin(np.arange(len(letters) + 2), list(to[0])))
            self.bits.append(np.log2(max(LEAST_SIZE, len(codes))))

    def codes(self, text: str) -> tuple[np.ndarray, int]:
        """Symbols of the text and its number of letters."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        return self.symbol[points], int(self.is_letter[points].sum())

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases (texts x languages), the letters of each text, and the symbols that a language's sample, if it isn't of
        the largest, lacks (texts x languages)."""
        coded = [self.codes(t or "") for t in texts]
        letters = np.array([n for _, n in coded])
        sizes = np.array([len(c) for c, _ in coded])
        parts = -(-sizes // WINDOW)
        owner = np.repeat(np.arange(len(texts)), parts)
        flat = np.concatenate([*[c for c, _ in coded], np.zeros(WINDOW, np.int32)])
        at = (np.cumsum(sizes) - sizes)[owner] + WINDOW * (np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts))
        width = np.minimum(WINDOW, (np.cumsum(sizes)[owner] - at))
        order = np.argsort(-width, kind="stable")
        owner, at, width = owner[order], at[order], width[order]
        # how many windows still have a letter at each step
        active = np.searchsorted(-width, -np.arange(1, WINDOW + 1), side="right")
        out = np.zeros((len(texts), len(self.languages)))
        symbols = [flat[at[:n] + i].astype(np.int64) for i, n in enumerate(active.tolist()) if n]
        for k, (cells, start) in enumerate(self.tables):
            state, count = np.full(len(owner), start[1]), np.zeros(len(owner), np.int32)
            for s in symbols:
                n = len(s)
                own = state[:n]
                v = cells[own + s]
                on = v >> 32 == own
                count[:n] += ~on
                state[:n] = np.where(on, v & 0xFFFFFFFF, start[s])
            out[:, k] = np.bincount(owner, count, len(texts))
        lacking, text_of = np.zeros_like(out), np.repeat(np.arange(len(texts)), sizes)
        for k, lacks in enumerate(self.lacks):
            if self.bits[k] < max(self.bits):
                lacking[:, k] = np.bincount(text_of, lacks[flat[: len(text_of)]], len(texts))
        return out, letters, lacking

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The languages and a score: the share by which the second best costs more than the best."""
        phrases, letters, lacking = self.phrases(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        bits = np.array(self.bits)
        cost = phrases * bits + lacking * (bits.max() - bits)
        best = cost.argmin(1)
        two = np.partition(cost, 1, axis=1)[:, :2] if cost.shape[1] > 1 else np.repeat(cost, 2, axis=1)
        score = np.where(letters > 0, 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9), 0.0)
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, letters)], np.clip(score, 0, 1)


def fit(docs: DataFrame) -> dict[str, str]:
    """The bounded sample text of each language, of documents outside the held-out fold. Null and empty labels don't count,
    nor do texts without a letter. Only a language with no document of DOC_BYTES takes others."""
    usable = docs.filter((F.col("lang") != "") & F.col("text").rlike(r"\p{L}") & (F.coalesce(fold_of(F.col("doc_id"), 4), F.lit(0)) != 2))
    rows = usable.select("lang", F.left("text", F.lit(SAMPLE_LETTERS)).alias("text"), "doc_id", (~F.octet_length("text").between(*DOC_BYTES)).alias("odd"), (F.spark_partition_id() % GROUPS).alias("group"))
    order = ["odd", F.xxhash64("doc_id"), "doc_id", "text"]
    for key in (["lang", "group"], ["lang"]):
        rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter(F.col("n") <= SAMPLE_DOCS)
    by = Window.partitionBy("lang")
    before = F.coalesce(F.sum(F.length("text") + 1).over(by.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("least", F.min("odd").over(by)).filter((F.col("odd") == F.col("least")) & (F.col("before") < SAMPLE_LETTERS))
    out: dict[str, str] = {}
    for r in sorted(rows.select("lang", "n", "text").collect(), key=lambda r: (r.lang, r.n)):
        out[r.lang] = (out.get(r.lang, "") + "\n" + r.text)[:SAMPLE_LETTERS]
    return out


def identify(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """docs with lang_pred and lang_score; ``und`` and 0 if the text is null or has no letter, or nothing was learnt. Rows are judged one
    by one: repeated rows get equal values, extra columns stay, columns of these names are replaced, an empty table stays empty."""
    shared, key = docs.sparkSession.sparkContext.broadcast(samples), ("language", hash(tuple(sorted(samples.items()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = held(key, lambda: Parser(shared.value))
        for batch in pieces(batches):
            names, scores = parser.predict(batch.column(text_at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], schema=pa.schema([*batch.schema, pa.field("lang_pred", pa.string()), pa.field("lang_score", pa.float64())]))

    plain = docs.drop("lang_pred", "lang_score")
    text_at = plain.columns.index("text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{fields}, lang_pred string, lang_score double")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("doc_id", (fold_of(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
