"""The divergence audit beside a plain one over every kept term of every group."""

import random
import re
from collections import Counter, defaultdict


from corvane.llm import divergence


def plain(rows, least, top=10):
    """rows: (lang, source, text)."""
    docs = [(a or "", b or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for a, b, t in rows]
    frequency, counts, langs = Counter(), defaultdict(Counter), defaultdict(set)
    for lang, source, words in docs:
        langs[lang].add(source)
        counts[lang, source].update(words)
        frequency.update((lang, w) for w in set(words))
    out = []
    for lang, sources in langs.items():
        kept = sorted(w for (a, w), n in frequency.items() if a == lang and n >= least)

        def shares(count):
            total = sum(count[w] for w in kept)
            return {w: 1 + 10**9 * (count[w] + 2) // (total + 2 * len(kept)) for w in kept}

        p = {s: shares(counts[lang, s]) for s in sources}
        q = shares(sum((counts[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = sorted(((sum(f(p[s][w], p[t][w]) for w in kept), t) for t in sources if t != s), key=lambda x: (-x[0], x[1].encode()))
            terms = sorted(((f(p[s][w], q[w]), w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]), key=lambda x: (-x[0], x[1].encode()))[:top]
            out += [(lang, s, part, item, value, k) for part, found in (("pair", pairs), ("term", terms)) for k, (value, item) in enumerate(found, 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, "lang string, source string, text string")


def audited(spark, rows, **kw):
    found = divergence.audit(table(spark, rows), **kw).select("lang", "source", "part", "item", "value", "rank").collect()
    return sorted(tuple(r) for r in found)


def corpus(n=300, seed=1):
    rng = random.Random(seed)
    words = ["Straße", "naïve", "日本", "a", "B", "ab", "the", "x1y", "İ", "É", "zz-top", *(f"w{chr(97 + k)}{chr(97 + j)}" for k in range(9) for j in range(9))]
    sources = ["s1", "s2", "s10", "é", "", None]
    return [(rng.choice(["en", "xx", None]), rng.choice(sources), rng.choice([" ", ", ", "\n", "7"]).join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 40)))) for _ in range(n)]


def test_agrees_with_a_plain_audit(spark):
    rows = corpus() + [("en", "s1", None), ("en", "long", "the the ab " * 30_000), ("yy", "alone", "rare"), ("yy", "too", None)] + [("en", "s1", "again again")] * 20
    assert audited(spark, rows) == plain(rows, 10)


def test_terms_beyond_one_automaton_take_further_scans(spark):
    rows = corpus(120, 2)
    assert audited(spark, rows, min_documents=3, automaton_chars=64) == plain(rows, 3)


def test_no_kept_term_and_no_rows(spark):
    rows = [("en", "a", "one two"), ("en", "b", "one"), (None, None, None)]
    assert audited(spark, rows) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]
    assert audited(spark, []) == []


def test_other_columns_do_not_matter(spark):
    rows = corpus(80, 3)
    df = table(spark, rows).selectExpr("*", "1 as term", "2 as n", "'x' as item", "3 as value", "4 as rank", "5 as total", "6 as kept")
    assert sorted(tuple(r) for r in divergence.audit(df, min_documents=3).collect()) == plain(rows, 3)
