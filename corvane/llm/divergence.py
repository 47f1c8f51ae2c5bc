"""How the sources of a language differ in the terms that they use.

Two passes over the texts: the first counts in how many documents of its language
each term is, exactly.  Terms that are kept become an Aho-Corasick automaton, each
between two delimiters, and the second pass recounts their occurrences in every
(language, source) group.  The counts above zero are sparse postings by term, from
which all pairs of sources and the terms of each source are ranked.

All arithmetic is on integers.  A group's share of a kept term with c occurrences is
1 + 1e9 * (c + 2) // (N + 2 * V), and two shares p, q diverge by (p - q)^2 // (p + q).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, UNITS_BYTES, Sums, chunks, flat, runs_of, stored

#: What a share of one is, and what is added to every count.
UNIT, ADDED = 1_000_000_000, 2
#: Characters of the terms that one automaton holds, about 40 bytes each; more terms take further scans.
AUTOMATON_CHARS = 4_000_000
#: Counts that a task of the second pass holds before they leave it, and so many terms go together in a row.
HELD, WIDTH = 1 << 20, 1 << 10
#: Bytes of the terms' numbers whose counts are summed at once, two each.
COUNTS_BYTES = 1 << 18
#: Pairs of postings that a task looks at together.
PAIRS = 1 << 20

#: Bytes of terms: letters, and all of code points beyond ASCII.
TERM = np.zeros(256, bool)
TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Lower case, and a space for what is in no term.
PADDED = np.where(TERM, LOWER, np.uint8(0x20))


def _named(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))


def document_frequencies(texts: DataFrame) -> DataFrame:
    """lang, term, documents: in how many of texts (lang, text) each term is; partial counts leave the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums(["lang", "term"], "documents")
        for batch in batches:
            for part in chunks(batch, limit=UNITS_BYTES):
                data, at = flat(part.column("text"))
                starts, ends, text = runs_of(TERM[data], at)
                if not len(starts):
                    continue
                cuts = np.column_stack([starts, ends]).ravel()[:-1]  # terms, and between them what parts them
                where = pa.py_buffer(np.append(cuts, ends[-1]))
                coded = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, where, pa.py_buffer(LOWER[data])]).dictionary_encode()
                n = len(coded.dictionary)
                lang = part.column("lang").dictionary_encode()
                each = np.sort(text * n + coded.indices.to_numpy()[::2])  # sorting is quicker than np.unique's hashing
                each = each[np.append(True, each[1:] != each[:-1])]  # a term once a text
                found, times = np.unique(lang.indices.to_numpy()[each // n].astype(np.int64) * n + each % n, return_counts=True)
                yield from sums.add(pa.table({"lang": lang.dictionary.take(pa.array(found // n)), "term": coded.dictionary.take(pa.array(found % n)).cast(pa.large_string()).cast(pa.string()), "documents": times.astype(np.int64)}))
        yield from sums.rest()

    return texts.select("lang", "text").mapInArrow(run, "lang string, term string, documents long").groupBy("lang", "term").agg(F.sum("documents").alias("documents"))


def _added(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, and the sum of each one's counts."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    starts = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else np.zeros(0, np.int64)
    return codes[starts], np.add.reduceat(counts[order], starts) if len(codes) else counts


def _rows(x: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The numbers from each start up to the next as bytes."""
    x = np.ascontiguousarray(x)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(x)) * x.itemsize), pa.py_buffer(x)]).cast(pa.binary())


class _Groups:
    """Counts of the terms of each (lang, source) within a task, by numbers: group << 32 | place of the term."""

    def __init__(self, langs: list[str], kept: np.ndarray):
        self.langs, self.kept = {x: k for k, x in enumerate(langs)}, kept
        self.number: dict[tuple[str, str], int] = {}
        self.new: list[np.ndarray] = []
        self.waiting = 0
        self.codes = self.counts = np.zeros(0, np.int64)

    def add(self, group: tuple[str, str], places: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Yields what leaves the task."""
        self.new.append((self.number.setdefault(group, len(self.number)) << 32) + places)
        self.waiting += len(places)
        if self.waiting > HELD:
            self._sum()
            if len(self.codes) > HELD:
                yield from self.rest()

    def _sum(self) -> None:
        if self.new:
            new = np.sort(np.concatenate(self.new))
            starts = np.flatnonzero(np.append(True, new[1:] != new[:-1])) if len(new) else np.zeros(0, np.int64)
            times = np.diff(np.append(starts, len(new)))
            self.codes, self.counts = _added(np.concatenate([self.codes, new[starts]]), np.concatenate([self.counts, times]))
        self.new, self.waiting = [], 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        """lang, source, part, places, counts: a row for WIDTH terms of a group, of those that its language keeps."""
        self._sum()
        names = [*self.number]
        lang = np.array([self.langs.get(x, -1) for x, _ in names], np.int64)
        wanted = (lang[self.codes >> 32] << 32) + (self.codes & 0xFFFFFFFF)
        at = np.searchsorted(self.kept, wanted)
        known = self.kept[np.minimum(at, len(self.kept) - 1)] == wanted
        codes, counts = self.codes[known], self.counts[known]
        if len(codes):
            row = codes // WIDTH
            starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            group = pa.array(codes[starts] >> 32)
            columns = [pa.array([x for x, _ in names], pa.string()).take(group), pa.array([x for _, x in names], pa.string()).take(group), pa.array((codes[starts] & 0xFFFFFFFF) // WIDTH), _rows((codes % WIDTH).astype(np.uint16), starts), _rows(counts, starts)]
            yield from pa.table(columns, names=["lang", "source", "part", "places", "counts"]).to_batches(max_chunksize=2000)
        self.number, self.codes, self.counts = {}, self.codes[:0], self.counts[:0]
        pa.default_memory_pool().release_unused()


def _recounted(texts: DataFrame, kept: pa.Table) -> DataFrame:
    """lang, source, term, n: counts of these terms, by an automaton over each task's texts.

    kept: term and the languages that keep it.  Counts travel by the terms' numbers,
    those of up to WIDTH terms of a group in a row, and only sums are given names.
    """
    kept = kept.combine_chunks()
    of = kept["langs"].chunk(0)
    lang, place = of.flatten().dictionary_encode(), np.repeat(np.arange(len(kept)), of.value_lengths().to_numpy())
    pairs = np.sort((lang.indices.to_numpy().astype(np.int64) << 32) + place)
    shared = texts.sparkSession.sparkContext.broadcast((kept["term"].to_pylist(), lang.dictionary.to_pylist(), pairs))  # bounded by AUTOMATON_CHARS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        terms, langs, pairs = shared.value
        scan, sums = ahocorasick.Automaton(), _Groups(langs, pairs)
        for k, term in enumerate(terms):
            scan.add_word(f" {term} ", k)
        scan.make_automaton()
        for batch in batches:
            for part in chunks(batch):
                data, at = flat(part.column("text"))
                data = PADDED[data]
                lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
                group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
                for g in np.unique(group).tolist():
                    joined = b" ".join([b"", *(data[at[k] : at[k + 1]].tobytes() for k in np.flatnonzero(group == g).tolist()), b""]).decode()
                    found = np.fromiter(map(itemgetter(1), scan.iter(joined)), np.int64)
                    if len(found):
                        yield from sums.add((lang.dictionary[g // len(source.dictionary)].as_py(), source.dictionary[g % len(source.dictionary)].as_py()), found)
        yield from sums.rest()

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, rest = pa.array(shared.value[0], pa.string()), None

        def named(t: pa.Table, codes: np.ndarray, counts: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
            row = first[codes // WIDTH]
            place = t["part"].to_numpy()[row] * WIDTH + codes % WIDTH
            return pa.RecordBatch.from_arrays([t[c].combine_chunks().take(pa.array(row)) for c in ("lang", "source")] + [names.take(pa.array(place)), pa.array(counts)], ["lang", "source", "term", "n"])

        for batch in batches:
            for part in chunks(batch, "places", COUNTS_BYTES):
                t = pa.Table.from_batches([part])
                t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
                places, at = flat(t["places"])
                first = np.flatnonzero(_new_run(t, ("lang", "source", "part")))
                run_of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(t))))
                codes = np.repeat(run_of, np.diff(at) // 2) * WIDTH + np.frombuffer(places.tobytes(), np.uint16)
                codes, counts = _added(codes, np.frombuffer(flat(t["counts"])[0].tobytes(), np.int64))
                open_ = int(np.searchsorted(codes, (len(first) - 1) * WIDTH))  # the last row's terms may go on
                if open_:
                    yield named(t, codes[:open_], counts[:open_], first)
                rest = t.slice(int(first[-1]), 1).select(["lang", "source", "part"])
                for name, x in (("places", (codes[open_:] % WIDTH).astype(np.uint16)), ("counts", counts[open_:])):
                    rest = rest.append_column(name, _rows(x, np.zeros(1, np.int64)))
        if rest is not None:
            yield named(rest, np.frombuffer(rest["places"][0].as_py(), np.uint16).astype(np.int64), np.frombuffer(rest["counts"][0].as_py(), np.int64), np.zeros(1, np.int64))

    rows = texts.mapInArrow(run, "lang string, source string, part long, places binary, counts binary")
    dealt = rows.repartition("lang", "source", "part").sortWithinPartitions("lang", "source", "part")
    return dealt.mapInArrow(summed, "lang string, source string, term string, n long")


def scans_of(sizes: dict[str, int], limit: int) -> list[tuple[list[str], int]]:
    """Languages that are scanned for together, and in how many scans: those above the limit alone, others as many as fit."""
    out, room = [], 0
    for lang, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        if size > limit:
            out.append(([lang], -(-size // limit)))
        elif size <= room:
            out[-1][0].append(lang)
            room -= size
        else:
            out.append(([lang], 1))
            room = limit - size
    return out


def occurrences(texts: DataFrame, kept: DataFrame, automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """lang, source, term, n above 0 of all kept (lang, term) in texts (lang, source, text).

    Terms beyond automaton_chars, or whose languages' names have more characters than that,
    take further scans, each over the texts of its languages only.
    """

    def by_term(some: DataFrame) -> DataFrame:
        return some.groupBy("term").agg(F.collect_list("lang").alias("langs"), F.sum(F.length("lang") + 1).alias("names"))

    size = by_term(kept).agg(F.greatest(F.sum(F.length("term") + 2), F.sum("names")).alias("n")).first()["n"] or 0
    if not size:
        return texts.select("lang", "source", F.lit("").alias("term"), F.lit(0).cast("long").alias("n")).limit(0)
    parts = []
    if size <= automaton_chars:
        parts.append((texts, kept))
    else:
        sizes = kept.groupBy("lang").agg(F.sum(F.greatest(F.length("term") + 2, F.length("lang") + 1)).alias("n"))
        for langs, scans in scans_of({r["lang"]: r["n"] for r in sizes.collect()}, automaton_chars):
            its = F.col("lang").isin(langs)
            parts += [(texts.where(its), kept.where(its & (F.pmod(F.xxhash64("term"), F.lit(scans)) == k))) for k in range(scans)]
    counted = []
    for some, its in parts:
        terms = by_term(its).select("term", "langs").toArrow()  # bounded by the division into scans
        if terms.num_rows:
            counted.append(_recounted(some, terms))
    return reduce(DataFrame.unionByName, counted)


def share(count: Column, total: Column, kept: Column) -> Column:
    """Integers beyond 64 bits on the way, as counts may be large."""
    return F.lit(1) + F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * (count + ADDED).cast("decimal(20,0)"), (total + ADDED * kept).cast("decimal(20,0)"))


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _numpy_divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def shared_terms(postings: DataFrame) -> DataFrame:
    """lang, a, b, value: for sources that share terms, by how much these move the sum over terms that a or b has alone.

    postings: lang, term, source, p, zero (the share without an occurrence).  A term's
    postings meet in one task, which sums up over its terms; each pair of sources is
    there one way round.  No pair of postings leaves the task.
    """

    def pairs(t: pa.Table, sums: Sums) -> Iterator[pa.RecordBatch]:
        lang, source = (t[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
        la, so = (x.indices.to_numpy().astype(np.int64) for x in (lang, source))
        p, zero = t["p"].to_numpy(), t["zero"].to_numpy()
        ends = np.append(np.flatnonzero(_new_run(t)[1:]) + 1, len(t))
        partners = ends[np.searchsorted(ends, np.arange(len(t)), side="right")] - np.arange(len(t)) - 1
        upto, first, n = np.cumsum(partners), 0, len(source.dictionary)
        while first < len(t):
            last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + PAIRS, side="right")))
            count = partners[first:last]
            i = np.repeat(np.arange(first, last), count)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)
            first = last
            if not len(i):
                continue
            i, j = np.where(so[i] < so[j], i, j), np.where(so[i] < so[j], j, i)
            f = _numpy_divergence
            moved = f(p[i], p[j]) - f(p[i], zero[j]) - f(zero[i], p[j]) + f(zero[i], zero[j])
            code = (la[i] * n + so[i]) * n + so[j]
            order = np.argsort(code, kind="stable")
            code, starts = np.unique(code[order], return_index=True)
            take = lambda d, k: d.dictionary.take(pa.array(k))
            yield from sums.add(pa.table({"lang": take(lang, code // n // n), "a": take(source, code // n % n), "b": take(source, code % n), "value": np.add.reduceat(moved[order], starts)}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, sums = None, Sums(["lang", "a", "b"], "value")
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = (pa.concat_tables([rest, t]) if rest is not None else t).combine_chunks()
            begins = np.flatnonzero(_new_run(t))
            whole, rest = t.slice(0, int(begins[-1])), t.slice(int(begins[-1]))  # the last term may go on
            if whole.num_rows:
                yield from pairs(whole, sums)
        if rest is not None:
            yield from pairs(rest, sums)
        yield from sums.rest()

    dealt = postings.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = dealt.mapInArrow(run, "lang string, a string, b string, value long")
    # which of two sources comes first is up to a task's own numbering
    return both.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _new_run(t: pa.Table, keys: tuple[str, ...] = ("lang", "term")) -> np.ndarray:
    """Where another combination of the keys begins."""
    out = np.zeros(len(t), bool)
    out[:1] = True
    for c in keys:
        x = t[c].combine_chunks().dictionary_encode().indices.to_numpy()
        out[1:] |= x[1:] != x[:-1]
    return out


def audit(docs: DataFrame, min_documents: int = 10, top_terms: int = 10, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", automaton_chars: int = AUTOMATON_CHARS) -> DataFrame:
    """lang, source, part, item, value, rank of every (lang, source) group.

    Part pair: item is each other source of the language, value their divergence summed
    over all kept terms of the language, every rank.  Part term: item is a kept term of
    which the group has a greater share than its language, value that divergence, the
    first top_terms ranks.  Greater values come first, then items in the order of their
    UTF-8 bytes.

    Null texts, languages and sources count as empty strings; groups without kept terms
    have pairs all the same, all 0 where the language keeps no term.  Repeated rows
    count as often as they are there, texts of any length are read whole, other columns
    are not looked at.  No rows give none.
    """
    texts = _named(docs, text_col, lang_col, source_col)
    kept = stored(document_frequencies(texts).where(F.col("documents") >= min_documents), "terms")
    counts = stored(occurrences(texts, kept, automaton_chars), "postings")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = texts.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left")
    # a language without kept terms has no share; 1 stands for it, and all its sums are of no terms
    some = groups.select("lang", "source", F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("total", F.lit(0)).alias("total"))
    groups = stored(some.withColumn("zero", F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.greatest("kept", F.lit(1)))).otherwise(1)), "groups")
    postings = counts.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    postings = stored(postings, "shares")

    whole = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    languages = groups.groupBy("lang").agg(F.first("kept").alias("kept"), F.sum("total").alias("total"))
    q = whole.join(languages, "lang").select("lang", "term", share(F.col("n"), F.col("total"), F.col("kept")).alias("q"))
    above = postings.join(q, ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)

    # the sum over all kept terms is that of terms neither has, moved by those that one has, and by those that both have
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("item_zero"))
    neither = groups.join(other, "lang").where("source != item").select("lang", "source", "item", (F.col("kept") * divergence(F.col("zero"), F.col("item_zero"))).alias("value"))
    alike = postings.groupBy("lang", "source", "zero", "p").agg(F.count("*").alias("terms"))  # equal shares once
    moved = F.col("terms") * (divergence(F.col("p"), F.col("item_zero")) - divergence(F.col("zero"), F.col("item_zero")))
    alone = alike.join(other, "lang").where("source != item").groupBy("lang", "source", "item").agg(F.sum(moved).alias("value"))
    both = shared_terms(postings).select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value")
    turned = lambda df: df.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    summed = reduce(DataFrame.unionByName, (neither, alone, turned(alone), both, turned(both))).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(terms)
