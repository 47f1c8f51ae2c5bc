"""Language identification by words first, and by ever shorter character n-grams for words not seen."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import UNITS_BYTES, Lists, chunks, flat, ids_and_texts, unit_cuts

UNKNOWN = "und"
#: Words are runs of letters (Unicode category L), in fitting and in scoring alike.
LETTERS = regex.compile(r"\p{L}+")
#: Fixed value: the n-grams that are held against the background; a word of one letter has one.
BACKGROUND = 3
#: Parts by hashed id that the rows of a language are counted in.
PARTS = 1024


@dataclass(frozen=True)
class LanguageModel:
    """Log frequency by language of known words, and of n-grams of words with their ends marked.

    letters: log frequency of characters in all languages, the background; unseen: log
    frequency by language of an n-gram of BACKGROUND characters that is not known.
    """

    languages: tuple[str, ...]
    words: dict[str, tuple[float, ...]]
    grams: dict[str, tuple[float, ...]]
    sizes: tuple[int, ...]
    letters: dict[str, float]
    unseen: tuple[float, ...]

    def word(self, word: str) -> tuple[float, ...]:
        """Scores by language: a known word's, else the mean over its longest n-grams of which any is known."""
        if (known := self.words.get(word)) is not None:
            return known
        marked = f"^{word}$"
        for n in self.sizes:
            found = [x for k in range(len(marked) - n + 1) if (x := self.grams.get(marked[k : k + n])) is not None]
            if found:
                return tuple(sum(x) / len(found) for x in zip(*found))
        return (0.0,) * len(self.languages)

    def token(self, token: str) -> tuple[float, ...] | None:
        """The sum over the token's words; None if it has no letter."""
        words = LETTERS.findall(token)
        return tuple(map(sum, zip(*map(self.word, words)))) if words else None

    def beyond_letters(self, token: str) -> tuple[float, ...]:
        """By how much each language makes the token's n-grams of BACKGROUND characters likelier than their letters by chance do."""
        rare, chance, grams = -math.log(len(self.letters) + 1), 0.0, []
        for word in LETTERS.findall(token):
            marked = f"^{word}$"
            alone = [max(self.letters.get(c, rare), rare) for c in marked]
            for k in range(len(marked) - BACKGROUND + 1):
                grams.append(self.grams.get(marked[k : k + BACKGROUND], self.unseen))
                chance += sum(alone[k : k + BACKGROUND])
        return tuple(sum(x) - chance for x in zip(*grams)) if grams else (0.0,) * len(self.languages)


def fit(docs: DataFrame, docs_per_language: int = 1500, max_words: int = 20_000, max_grams: int = 12_000, sizes: tuple[int, ...] = (5, 4, 3, 2, 1), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learns from docs that have a text and a language.

    The sample is bounded: docs_per_language whole documents of each language, those
    with the lowest hashes of id and text, equal ones once.  Every language of the sample
    that has a word is learned.  Of each language's words the max_words most frequent are
    known, ties in alphabetical order, and of its n-grams of each size as many as
    max_grams.  Without labelled rows, or without a letter in them, the model has no language.
    """
    named = docs.select(F.xxhash64(id_col, text_col).alias("h"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    # counts by part say which parts hold the lowest; only their rows are put in order
    placed = named.select("h", "lang", F.pmod("h", F.lit(PARTS)).alias("part"))
    before = F.sum("n").over(Window.partitionBy("lang").orderBy("part")) - F.col("n")
    lowest = placed.groupBy("lang", "part").agg(F.count("*").alias("n")).withColumn("before", before).where(F.col("before") < docs_per_language).select("lang", "part")
    place = F.dense_rank().over(Window.partitionBy("lang").orderBy("part", "h"))
    picked = placed.join(lowest, ["lang", "part"], "left_semi").withColumn("place", place).where(F.col("place") <= docs_per_language).select("lang", "h").distinct()
    sample = named.join(F.broadcast(picked), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])  # at most docs_per_language rows a language
    words = sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word != ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    most = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word")) <= max_words
    by_word = words.withColumn("most", most).groupBy("word").agg(F.max("most").alias("most"), F.collect_list(F.struct("lang", "n")).alias("by"))
    top = by_word.where("most").orderBy("word").collect()  # max_words a language
    languages = tuple(sorted({x["lang"] for row in top for x in row["by"]}))
    at = {x: k for k, x in enumerate(languages)}
    known = {row["word"]: {at[x["lang"]]: x["n"] for x in row["by"]} for row in top}

    def logs(counts: dict[str, dict[int, float]]) -> dict[str, tuple[float, ...]]:
        sums = [sum(c.get(k, 0) for c in counts.values()) for k in range(len(languages))]
        return {w: tuple(math.log((c.get(k, 0) + 0.5) / (sums[k] + 0.5 * len(counts))) for k in range(len(languages))) for w, c in counts.items()}

    def frequent(counts: dict[str, dict[int, float]]) -> dict[str, dict[int, float]]:
        """Those that are among the max_grams most frequent of a language."""
        out: set[str] = set()
        for k in range(len(languages)):
            out.update(sorted((g for g, c in counts.items() if k in c), key=lambda g: (-counts[g][k], g))[:max_grams])
        return {g: counts[g] for g in sorted(out)}

    grams: dict[str, tuple[float, ...]] = {}
    unseen: tuple[float, ...] = (0.0,) * len(languages)
    letters: Counter = Counter()
    for word, by in known.items():
        for c in f"^{word}$":
            letters[c] += sum(by.values())
    for n in sizes:
        counts: dict[str, dict[int, float]] = {}
        for word, by in known.items():
            marked = f"^{word}$"
            for gram, times in Counter(marked[k : k + n] for k in range(len(marked) - n + 1)).items():
                own = counts.setdefault(gram, {})
                for k, c in by.items():
                    own[k] = own.get(k, 0) + c * times
        kept = frequent(counts)
        grams |= logs(kept)
        if n == BACKGROUND:
            unseen = tuple(math.log(0.5 / (sum(c.get(k, 0) for c in kept.values()) + 0.5 * max(1, len(kept)))) for k in range(len(languages)))
    return LanguageModel(languages, logs(known), grams, tuple(sizes), {c: math.log(x / letters.total()) for c, x in letters.items()}, unseen)


class _Scorer:
    """Sums up scores by text; those of tokens are kept from chunk to chunk.  A token without a letter has none.

    background: what beyond_letters() says follows the scores.
    """

    def __init__(self, model: LanguageModel, background: bool = False):
        self.model, self.background = model, background
        self.width = len(model.languages) * (1 + background)
        self.tokens = Lists(self._scores, 300_000, np.float64)

    def _scores(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        out, size = [], np.zeros(len(tokens), np.int64)
        for k, t in enumerate(x.decode().lower() for x in tokens):
            if (score := self.model.token(t)) is not None:
                out += score + self.model.beyond_letters(t) if self.background else score
                size[k] = self.width
        return np.array(out), size

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text the summed scores, and whether it has a letter."""
        data, at = flat(texts)
        n = len(at) - 1
        if not self.width:  # no language was learned
            return np.zeros((n, 0)), np.array([LETTERS.search(x or "") is not None for x in texts.to_pylist()], bool)
        cuts = unit_cuts(data, at)
        scores, size = self.tokens(data, cuts)
        owner = (np.searchsorted(at, cuts[:-1], side="right") - 1)[size > 0]
        scores = scores.reshape(-1, self.width)
        sums = np.column_stack([np.bincount(owner, scores[:, k], n) for k in range(self.width)])
        return sums, np.bincount(owner, minlength=n) > 0


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: the likeliest learned language of each whole text and its posterior, all languages being equally likely before.

    A null or empty text and one without a letter have UNKNOWN and 0.0, as have all
    texts if no language was learned; an empty table gives no rows, and very long texts are
    read whole.  Ties go to the first in alphabetical order.
    One row for each row in; only the text has a say in it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by fit()'s max_words and max_grams a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            for part in chunks(batch, limit=UNITS_BYTES):
                scorer = scorer or _Scorer(shared.value)
                names = scorer.model.languages
                sums, lettered = scorer(part.column("text"))
                if not names:
                    lettered[:] = False
                    best, score = np.zeros(len(sums), int), np.zeros(len(sums))
                else:
                    best = sums.argmax(1)
                    score = 1 / np.exp(np.maximum(sums - sums.max(1, keepdims=True), -700)).sum(1)
                said = [names[b] if x else UNKNOWN for b, x in zip(best.tolist(), lettered.tolist())]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(said, pa.string()), pa.array(np.where(lettered, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id", folds: int = 5):
    """Whether the CRC-32 of the id as text leaves 0 when divided by folds; a null id is never held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == 0, F.lit(False))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, learned from the documents that are not held out."""
    model = fit(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The rows whose language is found with a score of at least min_score, with docs' columns.

    docs has a column lang; without it Spark says that there is none.  The scores of the
    learned languages say which of them it is, and are near 1 for any
    long text; so the language found must also make the text's n-grams likelier than the
    letters by chance do, which foreign and random texts fail.  A row without lang gets
    the one found.  The model is learned from docs themselves; if none outside the
    held-out fold has a lang, no language can be told, and all rows are kept unchanged
    whose text has a letter.
    """
    model = fit(docs.where(~held_out()))
    shared, schema = docs.sparkSession.sparkContext.broadcast(model), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            for part in chunks(batch, limit=UNITS_BYTES):
                scorer = scorer or _Scorer(shared.value, background=True)
                names = scorer.model.languages
                both, lettered = scorer(part.column("text"))
                if not names:
                    yield part.filter(pa.array(lettered))
                    continue
                sums, beyond = both[:, : len(names)], both[:, len(names) :]
                best = sums.argmax(1)
                score = 1 / np.exp(np.maximum(sums - sums.max(1, keepdims=True), -700)).sum(1)
                sure = lettered & (score >= min_score) & (beyond[np.arange(len(best)), best] >= 0)
                kept = part.filter(pa.array(sure))
                lang = [x if x is not None else names[b] for x, b in zip(kept.column("lang").to_pylist(), best[sure].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(lang, f.type) if f.name == "lang" else kept.column(f.name) for f in kept.schema], schema=kept.schema)

    return docs.mapInArrow(run, schema)
