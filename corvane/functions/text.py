"""Text expressions as columns."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: white space as Python's str.split() has it.  Single characters below 256 are one look-up in a bit set, and the inner range spares most others the rest.
SPACE = r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x20\x85\xa0[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]+"
#: Fixed value: what a model is told before the context.
SYSTEM_PROMPT = "You answer questions using only the numbered context passages. Cite passages as [n]. If the context is insufficient, say so."


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE), "")


def jaccard(a: Column, b: Column) -> Column:
    """Shared elements of two arrays among all; 0 if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / every)


def _normalised(df: DataFrame, parts: list[str], into: str) -> DataFrame:
    """df with the array of parts over their norm instead of parts.  The norm is a column of its own, so that it is made once a row."""
    df = df.withColumn("__norm", F.sqrt(reduce(add, (F.col(c) * F.col(c) for c in parts))))
    whole = F.array(*(F.col(c) / F.when(F.col("__norm") == 0, 1.0).otherwise(F.col("__norm")) for c in parts))
    return df.withColumn(into, whole).drop("__norm", *parts)


def token_vectors(tokens_: DataFrame, dim: int, into: str = "v") -> DataFrame:
    """tokens_ (token) with a unit vector from the token's SHA-256: bytes over 127.5, less 1, repeated to dim."""
    raw = {f"__{k}": F.get("__bytes", F.lit(k % 32)) for k in range(dim)}
    digest = tokens_.withColumn("__digest", F.sha2("token", 256))
    bytes_ = F.transform(F.sequence(F.lit(0), F.lit(min(dim, 32) - 1)), lambda k: F.conv(F.substring(F.col("__digest"), 2 * k + 1, F.lit(2)), 16, 10).cast("double") / 127.5 - 1.0)
    return _normalised(digest.withColumn("__bytes", bytes_).withColumns(raw).drop("__digest", "__bytes"), [*raw], into)


def bag_embeddings(texts: DataFrame, key: str, text_col: str = "text", dim: int = 16) -> DataFrame:
    """key, embedding: the sum of a text's token vectors, normalised; a text without tokens has the token <empty>.

    Vectors are made once for each distinct token, then summed by text.  keys are unique.
    """
    cut = texts.select(key, tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("__found"))  # a column of its own, so that texts are cut once
    each = cut.select(key, F.explode(F.when(F.size("__found") > 0, F.col("__found")).otherwise(F.array(F.lit("<empty>")))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("n"))
    vectors = token_vectors(each.select("token").distinct(), dim)
    sums = each.join(vectors, "token").groupBy(key).agg(*(F.sum(F.col("n") * F.get("v", F.lit(k))).alias(f"v{k}") for k in range(dim)))
    return _normalised(sums, [f"v{k}" for k in range(dim)], "embedding")


def context(passages: Column) -> Column:
    """Numbered lines of an array of texts."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n")


def user_message(question: Column, passages: Column) -> Column:
    return F.concat(F.lit("Context:\n"), context(passages), F.lit("\n\nQuestion: "), question)


def messages(question: Column, passages: Column) -> Column:
    """What a model is sent: array<struct<role, content>>, the system's message first."""
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")), F.struct(F.lit("user").alias("role"), user_message(question, passages).alias("content")))


def echo_answer(message: Column) -> Column:
    """What the stand-in for a language model says."""
    return F.concat(F.lit("[fake-llm] "), F.substring(message, 1, 200))


def filled(template: Column, **slots: Column) -> Column:
    """The template with {name} replaced."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template
