"""Quality rules under weak supervision.

Each rule votes good or bad or abstains.  Expectation-maximisation over all
documents estimates how often each rule votes what for good and for bad ones,
and a document is kept by its posterior probability of being good.  Documents
with the same votes are alike to the model, so it needs the count of each of the
3 ** len(RULES) vote patterns only, however many documents there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import WHITE, chunks, flat, ids_and_texts, mixed, span_hashes, stored, windows, word_spans

#: Fixed value: the characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_shouts", "n_distinct")
#: A rule: what is measured against n_words (or what else is named), the share up to which
#: it votes good, and the share beyond which it votes bad.  Between them it abstains.
RULES = {
    "symbols": ("n_symbols", "n_words", 0.02, 0.15),
    "upper": ("n_upper", "n_letters", 0.20, 0.50),
    "shouts": ("n_shouts", "n_words", 0.02, 0.15),
    "dup_lines": ("n_dup_lines", "n_lines", 0.05, 0.30),
    "repeats": ("n_repeat_words", "n_words", 0.05, 0.20),
    "word_length": ("word_chars", "n_words", 10.0, 14.0),
    "sameness": ("n_same", "n_words", 0.70, 0.85),
}
#: Fixed value: the least share of a rule's bad votes that are right.
RIGHT = 0.8


def _per_text(values: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(text, weights=values, minlength=n).astype(np.int64)


def measured(texts: pa.Array) -> dict[str, np.ndarray]:
    """METRICS of each whole text; null counts as empty.

    A line counts as a duplicate if it has a word and equals an earlier line of its
    text; a word is repeated if a window of five words around it is found twice.
    """
    data, at = flat(texts)
    n = len(at) - 1
    zero = np.zeros(n, np.int64)
    if not len(data):
        return dict.fromkeys(METRICS, zero)
    total = lambda flags: np.diff(np.append(0, np.cumsum(flags))[at])
    starts, ends, text = word_spans(data, at)
    words = span_hashes(data, starts, ends)
    upper = (data >= ord("A")) & (data <= ord("Z"))
    letters = upper | ((data >= ord("a")) & (data <= ord("z"))) | (data >= 0xC0)
    point = (data & 0xC0) != 0x80
    # lines: spans between line feeds and ends of texts
    breaks = np.flatnonzero(data == 0x0A)
    full = np.flatnonzero(np.diff(at) > 0)
    line_start = np.sort(np.concatenate([at[full], breaks + 1]))
    line_end = np.sort(np.concatenate([at[full + 1], breaks]))
    line_text = np.sort(np.concatenate([full, np.searchsorted(at, breaks, side="right") - 1]))
    black = np.append(0, np.cumsum(~WHITE[data]))
    inked = black[line_end] > black[line_start]
    line_start, line_end, line_text = line_start[inked], line_end[inked], line_text[inked]
    apart = lambda h, t: mixed(h ^ (t.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    first = np.unique(apart(span_hashes(data, line_start, line_end), line_text), return_index=True)[1]
    n_lines = np.bincount(line_text, minlength=n)
    # words within windows that are found twice
    hashes, begin = windows(words, text, 5)
    _, back, times = np.unique(apart(hashes, text[begin]), return_inverse=True, return_counts=True)
    again = begin[times[back] > 1]
    cover = np.zeros(len(words) + 6, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + 5, -1)
    repeated = np.cumsum(cover)[: len(words)] > 0
    distinct = text[np.unique(apart(words, text), return_index=True)[1]]
    return {
        "n_words": np.bincount(text, minlength=n),
        "word_chars": total(point & ~WHITE[data]),
        "n_symbols": total(_SYMBOL[data]),
        "n_dup_lines": n_lines - np.bincount(line_text[first], minlength=n),
        "n_repeat_words": _per_text(repeated, text, n),
        "n_lines": n_lines,
        "n_upper": total(upper),
        "n_letters": total(letters),
        "n_shouts": total(data == ord("!")),
        "n_distinct": np.bincount(distinct, minlength=n),
    }


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and METRICS as longs: one row for each row in, from its whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = measured(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(found[c].astype(np.int64)) for c in METRICS)], ["doc_id", *METRICS])

    return ids_and_texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in METRICS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def pattern() -> Column:
    """The votes of all rules as the digits of a number of base 3: 0 bad, 1 abstains, 2 good.  Without words all abstain."""
    named = {"n_same": F.col("n_words") - F.col("n_distinct")}
    out = F.lit(0)
    for what, of, good, bad in RULES.values():
        value, whole = named.get(what, F.col(what)), F.col(of)
        out = out * 3 + F.when(whole == 0, 1).when(value <= good * whole, 2).when(value > bad * whole, 0).otherwise(1)
    return out


def _held(score: np.ndarray, weight: np.ndarray, against: np.ndarray, lowered: np.ndarray) -> np.ndarray:
    """The probabilities of being good, from log odds, closest to them (least relative entropy) so that each rule's bad votes are RIGHT.

    against: which pattern has which rule's bad vote; lowered: how far such a vote lowers the
    log odds, the last round's values to begin with and this one's afterwards.
    """
    chance = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for _ in range(20):
        before = lowered.copy()
        for k in np.flatnonzero(against.any(0)):
            has = against[:, k]
            rest, w = score[has] - against[has] @ lowered + lowered[k], weight[has]
            most = (1 - RIGHT) * w.sum()
            low, high = 0.0, max(0.0, rest.max() + 2)
            if w @ chance(rest) <= most:
                high = 0.0
            while high - low > 1e-10:
                mid = (low + high) / 2
                low, high = (mid, high) if w @ chance(rest - mid) > most else (low, mid)
            lowered[k] = high
        if np.abs(lowered - before).max() < 1e-9:
            break
    return chance(score - against @ lowered)


def posteriors(counts: dict[int, int], rounds: int = 100) -> dict[int, float]:
    """The probability of being good for each vote pattern, by expectation-maximisation.

    counts: how many documents have which pattern.  It begins from rules that are
    right four times out of five when they vote; one smoothing count an outcome
    keeps every probability above 0.  Which class is which kind of junk the votes
    alone leave open, so in every round at least the share RIGHT of the documents that
    a rule votes bad on are bad, however many there are (posterior regularisation),
    and no bad vote counts for good nor a good one for bad.
    """
    if not counts:
        return {}
    codes = np.array(sorted(counts))
    weight = np.array([counts[c] for c in codes.tolist()], float)
    votes = np.array([codes // 3**k % 3 for k in range(len(RULES))]).T
    against, lowered = votes == 0, np.zeros(len(RULES))
    odds = ((votes == 2).sum(1) - against.sum(1)) * np.log(4) + np.log(4)
    good = _held(odds, weight, against, lowered)
    for _ in range(rounds):
        share = (weight @ good + 1) / (weight.sum() + 2)
        score = np.log(share) - np.log1p(-share)
        for k in range(votes.shape[1]):
            tables = [np.bincount(votes[:, k], weights=weight * p, minlength=3) + 1 for p in (good, 1 - good)]
            logs = [np.log(t / t.sum()) for t in tables]
            gain = logs[0] - logs[1]
            score = score + np.array([min(gain[0], 0.0), gain[1], max(gain[2], 0.0)])[votes[:, k]]
        new = _held(score, weight, against, lowered)
        if np.abs(new - good).max() < 1e-9:
            break
        good = new
    return dict(zip(codes.tolist(), good.tolist()))


def judge(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, METRICS, base_failed, posterior, kept.

    kept: the base rule passes and the posterior is at least threshold.  A text
    without words (null, empty, white space) has counts of 0 and fails the base rule.
    The model is fitted to all documents; an empty table gives no rows.  Very long texts
    are measured whole.
    """
    found = stored(measure(docs, id_col, text_col).withColumn("pattern", pattern()), "quality")
    counts = {r["pattern"]: r["n"] for r in found.groupBy("pattern").agg(F.count("*").alias("n")).collect()}  # at most 3 ** len(RULES) rows
    model = docs.sparkSession.createDataFrame([*posteriors(counts).items()], "pattern int, posterior double")
    return found.join(F.broadcast(model), "pattern").select("doc_id", *METRICS, base_failed().alias("base_failed"), "posterior", (~base_failed() & (F.col("posterior") >= threshold)).alias("kept"))


def accepted(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' columns; each row is judged for itself, repeated ids included.  docs has no columns called __ and the name of a metric."""
    schema = docs.schema
    metrics = [f"__{c}" for c in METRICS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                found = measured(part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c].astype(np.int64)) for c in METRICS)], [*part.schema.names, *metrics])

    wide = docs.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema] + [f"{c} long" for c in metrics]))
    plain = wide.select(F.struct(*schema.names).alias("__row"), *(F.col(m).alias(c) for m, c in zip(metrics, METRICS)))
    judged = stored(plain.select("__row", base_failed().alias("__failed"), pattern().alias("__pattern")), "judged")  # texts are measured once
    counts = {r["__pattern"]: r["n"] for r in judged.groupBy("__pattern").agg(F.count("*").alias("n")).collect()}  # at most 3 ** len(RULES) rows
    model = docs.sparkSession.createDataFrame([*posteriors(counts).items()], "__pattern int, __posterior double")
    return judged.where("not __failed").join(F.broadcast(model), "__pattern").where(F.col("__posterior") >= threshold).select("__row.*")
