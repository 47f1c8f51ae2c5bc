"""Questions to answers: retrieve, rerank, and assemble, as one chain of DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as tx
from corvane.operators import search
from corvane.operators.engine import Timings, merged_metadata

#: Stages in their order.
STAGES = ("embed", "retrieve", "rerank", "generate")


def retrieve(questions: DataFrame, passages: DataFrame, retrieved: int = search.RETRIEVED, reranked: int = search.RERANKED, scored: Column | None = None, digits: int | None = None) -> DataFrame:
    """question_id, passage_id, rank, retrieval_rank, score, rerank_score, text and question.

    questions: question_id, question, q_embedding; passages: passage_id, text, embedding.
    Retrieval is by the product of the embeddings, as matrices and rounded to digits, or by
    scored, pair by pair; reranking is by shared tokens.
    """
    found = candidates(questions, passages, retrieved, scored, digits)
    near = tx.jaccard(F.array_distinct(tx.tokens(F.col("question"))), F.array_distinct(tx.tokens(F.col("text"))))
    best = search.rerank(found, F.round(near, 9), reranked, by=["question_id"])
    return best.select("question_id", "question", "passage_id", "text", "rank", "retrieval_rank", "score", "rerank_score")


def candidates(questions: DataFrame, passages: DataFrame, k: int, scored: Column | None = None, digits: int | None = None) -> DataFrame:
    """The k best passages of each question, with its text."""
    if scored is not None:
        return search.search_batch(passages, questions, scored, "question_id", k, tie=["passage_id"])
    found = search.product_topk(passages, questions, "question_id", "embedding", "q_embedding", k, tie=["passage_id"], digits=digits)
    return found.join(questions.drop("q_embedding"), "question_id")


def answer(hits: DataFrame, mode: str = "query") -> DataFrame:
    """question_id, mode, answer, passages: one row a question; in mode retrieve there is no answer."""
    if mode not in ("query", "retrieve"):
        raise ValueError("mode is query or retrieve")
    rows = hits.groupBy("question_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(F.struct("rank", "passage_id", "text"))).alias("passages"))  # few rows each
    said = tx.echo_answer(tx.user_message(F.col("question"), F.transform("passages", lambda p: p["text"])))
    return rows.select("question_id", F.lit(mode).alias("mode"), (said if mode == "query" else F.lit(None).cast("string")).alias("answer"), F.transform("passages", lambda p: p["passage_id"]).alias("passages"))


def workflow(questions: DataFrame, passages: DataFrame, mode: str, folder: str, embed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, dict[str, float]]:
    """answer() of retrieve(), stage by stage, with the milliseconds that each took.

    questions: question_id, question, and q_embedding, which embed() adds if it is given.
    A stage's rows are written to folder, so that its time is its own.  All STAGES are
    told, 0.0 for one that did not run, as generate in mode retrieve, and total, their sum.
    """
    spark, timings = questions.sparkSession, Timings({})

    def staged(df: DataFrame, stage: str) -> DataFrame:
        with timings.measure(stage):
            df.write.mode("overwrite").parquet(f"{folder}/{stage}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{stage}")

    asked = staged(embed(questions) if embed else questions, "embed")
    found = staged(candidates(asked, passages, search.RETRIEVED), "retrieve")
    near = tx.jaccard(F.array_distinct(tx.tokens(F.col("question"))), F.array_distinct(tx.tokens(F.col("text"))))
    best = staged(search.rerank(found, F.round(near, 9), search.RERANKED, by=["question_id"]), "rerank")
    answers = answer(best, mode)
    if mode == "query":
        answers = staged(answers, "generate")
    told = {stage: timings.stages.get(stage, 0.0) for stage in STAGES}
    return answers, {**told, "total": sum(told.values())}


def merged_timings(left: Column, right: Column) -> Column:
    """Both maps; the right one wins."""
    return merged_metadata(left, right)


def parsed_timings(body: Column) -> Column:
    """timings_ms of a JSON body as numbers; an empty map if any is not one, or if there are none."""
    raw = F.from_json(F.get_json_object(body, "$.timings_ms"), "map<string,string>")
    numbers = F.transform_values(raw, lambda k, v: v.try_cast("double"))
    bad = F.size(F.map_filter(numbers, lambda k, v: v.isNull())) > 0
    nothing = F.create_map().cast("map<string,double>")
    return F.when(raw.isNull() | bad, nothing).otherwise(numbers)


def stage_events(df: DataFrame, endpoint: str, timings: str, keep: list[str]) -> DataFrame:
    """keep, place, name, ms: stages that took time, in their order."""
    pairs = F.array(*(F.struct(F.lit(k).alias("place"), F.concat(F.col(endpoint), F.lit(f":{s}")).alias("name"), F.col(timings)[s].alias("ms")) for k, s in enumerate(STAGES)))
    return df.select(*keep, F.explode(F.filter(pairs, lambda x: x["ms"] > 0)).alias("x")).select(*keep, "x.*")


#: Turns that are put together before conversations are.
SEGMENT = 1024


def history(turns: DataFrame, roles: tuple[str, ...] = ("user",)) -> DataFrame:
    """conv_id, history: the texts of a conversation's queries in order, joined by line feeds; null texts are passed over.

    Texts are sorted and joined in segments of turns, then these, so that no task sorts a
    whole long conversation.
    """
    rows = turns.where(F.col("role").isin(*roles)).withColumn("__segment", F.floor(F.col("turn") / SEGMENT))

    def joined(df: DataFrame, by: list[str], order: list[str], text: str) -> DataFrame:
        found = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("x"))
        texts = F.array_compact(F.transform("x", lambda t: t[text]))
        return found.select(*by, texts.alias("x"))

    parts = joined(rows, ["conv_id", "__segment"], ["turn"], "text").select("conv_id", "__segment", F.when(F.size("x") > 0, F.array_join("x", "\n")).alias("part"))
    return joined(parts, ["conv_id"], ["__segment"], "part").select("conv_id", F.array_join("x", "\n").alias("history"))


def last_turn(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the last turn."""
    return turns.groupBy("conv_id").agg(F.max(F.struct("turn", "role", "text")).alias("x")).select("conv_id", "x.*")


def first_turns(turns: DataFrame, n: int = 1) -> DataFrame:
    """The first n rows of each conversation, by turn; those of one turn by role and text."""
    return turns.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).where(F.col("k") <= n).drop("k")
