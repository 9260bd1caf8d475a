"""Raw model responses to typed rows, and a hook for the caller's own analyser."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = "struct<id:string,llm_score:string,content_type:string,title:string,start_line:string,end_line:string>"


def json_body(response: Column) -> Column:
    """The JSON of a response: thoughts in <think> tags dropped (an unclosed one cuts the rest), one code
    fence stripped; if that is no JSON, what lies between the first { or [ and the last } or ]."""
    t = F.regexp_replace(response, r"(?s)<think>.*?</think>", "")
    t = F.trim(F.regexp_replace(t, r"(?s)<think>.*$", ""))
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(t, r"(?s)([{\[].*[}\]])", 1)
    return F.when(F.try_parse_json(t).isNotNull(), t).otherwise(inner)


def normalise_answers(responses: DataFrame, item: str = ITEM) -> DataFrame:
    """responses (key columns, response) -> a row for each item with its number, or one with an error.

    A list is taken as it is; of an object the list under segments, chapters or results."""
    keys = [c for c in responses.columns if c != "response"]
    body = json_body(F.col("response"))
    listed = F.from_json(F.when(body.startswith("["), body), f"array<{item}>")
    named = F.from_json(F.when(body.startswith("{"), body), f"segments array<{item}>, chapters array<{item}>, results array<{item}>")
    items = F.coalesce(listed, named["segments"], named["chapters"], named["results"])
    rows = responses.select(*keys, items.alias("_i"))
    good = rows.where("_i is not null").select(*keys, F.posexplode("_i").alias("item_no", "_x")).select(*keys, "item_no", "_x.*", F.lit(None).cast("string").alias("error"))
    bad = rows.where("_i is null").select(*keys, F.lit(None).cast("int").alias("item_no"))
    for field in good.columns[len(keys) + 1 : -1]:
        bad = bad.withColumn(field, F.lit(None).cast("string"))
    return good.union(bad.withColumn("error", F.lit("no list of answers")))


def analyse(prompts: DataFrame, analyser: Callable[[list[str]], list[str]]) -> DataFrame:
    """prompts (key columns, prompt) with response and error: the caller's function sees the prompts of an
    Arrow batch at a time; what it raises becomes the error of the batch's rows."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("response", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                yield b.assign(response=analyser(b["prompt"].tolist()), error=None)
            except Exception as e:  # noqa: BLE001  the caller's function may fail in any way
                yield b.assign(response=None, error=str(e))

    return prompts.mapInPandas(run, schema)
