"""The data side of runners: what is pending, what a model is sent, what is recorded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.constants import lookup

from ..functions.text import with_sources
from ..sources.constants import PAGE_WORD, SOURCES_HEADING


#: Examples that a prompt holds at most.
SHOTS = 200


def pending(questions: DataFrame, done: DataFrame) -> DataFrame:
    """Questions without an answer in the log. A failed call has an answer too, an empty one, and isn't asked again."""
    return questions.join(done.select("id").distinct(), "id", "left_anti")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def example_messages(examples: DataFrame) -> DataFrame:
    """One row: user and assistant messages of all examples in order. A prompt holds few examples."""
    cites = F.col("citations") if "citations" in examples.columns else F.lit(None).cast("array<struct<file:string,page:int>>")
    pair = F.array(message("user", F.col("question")), message("assistant", with_sources(F.col("answer"), cites, SOURCES_HEADING, PAGE_WORD)))
    return examples.select("pos", pair.alias("pair")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "pair"))), lambda x: x["pair"])).alias("shots"))


def build_messages(questions: DataFrame, examples: DataFrame, system: str) -> DataFrame:
    """For each question the system's message, the examples', and the question. The examples are one broadcast row, made
    of ``SHOTS`` examples at most."""
    if len(examples.take(SHOTS + 1)) > SHOTS:
        raise ValueError(f"more than {SHOTS} examples")
    shots = F.broadcast(example_messages(examples))
    whole = F.concat(F.array(message("system", F.lit(system))), F.col("shots"), F.array(message("user", F.col("question"))))
    return questions.join(shots).withColumn("messages", whole).drop("shots")


def ordered_messages(turns: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The turns of each conversation as a list, in their order."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(role).alias("role"), F.col(text).alias("content"))))
    return turns.groupBy(key).agg(F.transform(listed, lambda m: F.struct(m["role"], m["content"])).alias("messages"))


def answer_record(preset: str | None, examples_file: str | None, shots: int | None) -> list[Column]:
    """Columns of an answer's record besides id, answer, citations, latency and tokens."""
    return [F.lit(shots).cast("int").alias("few_shot_examples"), F.lit(examples_file).alias("examples_file"), F.lit(preset).alias("preset")]


def failed_record(question: DataFrame, error: Column) -> DataFrame:
    """What is recorded for a failed call: an empty answer and the error."""
    return question.select("id", F.lit("").alias("answer"), error.alias("endpoint_error"))


def prompt_specs(presets: dict[str, str], runner: str, examples: dict[str, str], shots: dict[str, int] | None = None) -> list[dict]:
    """Prompt, examples' file and number of messages (system, two for each example, question) for each preset; presets
    without examples have none. A few driver-side values."""
    size = lambda k: 2 + 2 * (shots or {}).get(k, 0)
    return [{"preset": k, "runner": runner, "prompt": v, "examples_file": examples.get(k), "message_count": size(k)} for k, v in presets.items()]


def model_name(model: str, provider: str) -> str:
    """The model's id behind its provider's prefix, which it may have already."""
    return model if model.startswith(f"{provider}/") else f"{provider}/{model}"


def endpoint(base: str, path: str) -> str:
    """C23."""
    return f"{base.rstrip('/')}/{path.lstrip('/')}"


def spec_columns(preset: Column, prompts: dict[str, str], examples: dict[str, str], shots: dict[str, int]) -> dict[str, Column]:
    """As ``prompt_specs`` for presets in a column; unknown ones have no prompt and no examples."""
    none = F.lit(None).cast("string")
    count = F.lit(2) + 2 * F.coalesce(lookup(preset, shots, F.lit(0)), F.lit(0)) if shots else F.lit(2)
    return {"prompt": lookup(preset, prompts, none), "examples_file": lookup(preset, examples, none), "message_count": count.cast("bigint")}


def model_column(model: Column, provider: str) -> Column:
    """C19, for a column."""
    return F.when(F.startswith(model, F.lit(f"{provider}/")), model).otherwise(F.concat(F.lit(f"{provider}/"), model))


def endpoint_column(base: Column, path: str) -> Column:
    """C23, for a column."""
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/" + path.lstrip("/")))
