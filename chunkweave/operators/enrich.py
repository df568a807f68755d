"""Model-backed steps: batched calls of pluggable functions, and the parsing of what models answer.

A model is any function from a list of texts to a list of answers, registered by name. Calls run in Arrow
batches on the executors; a failed batch gives nulls and its failure, never a failed job.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chunkweave.functions.text import strip
from chunkweave.operators.merge import first_of

Model = Callable[[Sequence[str]], Sequence]
_MODELS: dict[str, Model] = {}

# Words by which a passage leans on text elsewhere, and spoken verdicts.
FRAGMENT_WORDS = "如上所述|如前所述|见图|参见|如图所示|上述|前述|以上内容|下面将|如下所示|详见|其中[，,]|该[方法算法模型公式]|此[方法处理操作]"
VERDICTS = [(1, "丢弃|删除|无价值|discard|drop|reject"), (5, "保留|优质|高质量|keep|retain|accept")]

ENTITY = "struct<name:string,type:string,aliases:array<string>>"
TRIPLE = "struct<s:string,p:string,o:string,confidence:double>"


def register_model(name: str, model: Model) -> None:
    _MODELS[name] = model


def call_model(df: DataFrame, text: Column | str, model: str | Model, kind: str = "string", batch: int = 64) -> DataFrame:
    """Add ``answer`` (of type ``kind``) and ``failure``; blank texts aren't sent and get null."""
    run = _MODELS[model] if isinstance(model, str) else model
    asked = df.withColumn("__asked", F.col(text) if isinstance(text, str) else text)

    def calls(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            answers: list = [None] * len(pdf)
            failures: list = [None] * len(pdf)
            send = [k for k, t in enumerate(pdf["__asked"]) if isinstance(t, str) and t.strip()]
            for begin in range(0, len(send), batch):
                own = send[begin : begin + batch]
                try:
                    got = list(run([pdf["__asked"].iloc[k] for k in own]))
                    if len(got) != len(own):
                        raise ValueError(f"{len(got)} answers for {len(own)} texts")
                    for k, a in zip(own, got):
                        answers[k] = a
                except Exception as e:  # noqa: BLE001 - whatever a model raises
                    for k in own:
                        failures[k] = f"{type(e).__name__}: {e}"
            yield pdf.drop(columns="__asked").assign(answer=answers, failure=failures)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return asked.mapInPandas(calls, f"{fields}, answer {kind}, failure string")


def enhancement_kind(chunks: DataFrame) -> Column:
    """Which enhancement a child needs: image, table, fragment (short or leaning on other text) or text."""
    text = F.coalesce(F.col("content"), F.lit(""))
    leaning = F.left(text, F.lit(400)).rlike(FRAGMENT_WORDS)
    return F.when(F.col("is_image_chunk"), "image").when(F.col("is_table_chunk"), "table").when((F.length(text) < 80) | leaning, "fragment").otherwise("text")


def json_body(answer: Column | str) -> Column:
    """The JSON in an answer: fenced or bare, with trailing commas removed."""
    col = F.col(answer) if isinstance(answer, str) else answer
    fenced = F.regexp_extract(col, r"(?s)```(?:json)?\s*(.*?)```", 1)
    bare = F.regexp_extract(col, r"(?s)([{\[].*[}\]])", 1)
    body = F.coalesce(F.nullif(strip(fenced), F.lit("")), F.nullif(bare, F.lit("")))
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def parse_enhanced(answer: Column | str, summary_chars: int = 300, fallback_chars: int = 200) -> Column:
    """``summary, entities, triples`` of an answer; text that isn't JSON becomes the summary.

    Entities without a name and triples with a missing part are dropped; confidence defaults to .7 and stays within 0..1.
    """
    col = F.col(answer) if isinstance(answer, str) else answer
    parsed = F.from_json(json_body(col), f"summary string, entities array<{ENTITY}>, triples array<{TRIPLE}>")
    solid = lambda x: F.coalesce(strip(x), F.lit("")) != ""
    entities = F.filter(parsed["entities"], lambda e: solid(e["name"]))
    triples = F.filter(parsed["triples"], lambda t: solid(t["s"]) & solid(t["p"]) & solid(t["o"]))
    bounded = F.transform(
        triples, lambda t: F.struct(t["s"].alias("s"), t["p"].alias("p"), t["o"].alias("o"), F.least(F.greatest(F.coalesce(t["confidence"], F.lit(0.7)), F.lit(0.0)), F.lit(1.0)).alias("confidence"))
    )
    known = parsed["summary"].isNotNull() | parsed["entities"].isNotNull() | parsed["triples"].isNotNull()
    summary = F.when(known, F.left(F.coalesce(parsed["summary"], F.lit("")), F.lit(summary_chars))).otherwise(F.left(strip(F.coalesce(col, F.lit(""))), F.lit(fallback_chars)))
    none = lambda kind: F.from_json(F.lit("[]"), f"array<{kind}>")
    return F.struct(summary.alias("summary"), F.coalesce(entities, none(ENTITY)).alias("entities"), F.coalesce(bounded, none(TRIPLE)).alias("triples"))


def parse_scores(text: str | None, count: int) -> list[int]:
    """Scores 1..5 of ``count`` items from a model's answer: JSON in its usual shapes, else spoken verdicts; default 3."""
    scores = [3] * count

    def number(value) -> int | None:
        if isinstance(value, dict):
            for key in ("score", "quality", "rating", "value"):
                if key in value:
                    return number(value[key])
            return number(str(value.get("decision", value.get("action", ""))))
        try:
            return min(5, max(1, round(float(value))))
        except (TypeError, ValueError):
            return next((s for s, words in VERDICTS if re.search(words, str(value), re.I)), None)

    body = re.search(r"```(?:json)?\s*(.*?)```", text or "", re.S)
    raw = re.sub(r",\s*([}\]])", r"\1", (body[1] if body else text or "").strip())
    try:
        data = json.loads(raw)
    except ValueError:
        lines = [line for line in (text or "").split("\n") if line.strip()]
        for k, line in enumerate(lines[:count]):
            m = re.search(r"\b([1-5])\b\s*(?:分|/5|$)", line)
            own = number(m[1]) if m else number(line)
            scores[k] = own if own is not None else 3
        return scores
    if isinstance(data, dict):
        listed = next((data[k] for k in ("scores", "results", "items") if isinstance(data.get(k), list)), None)
        if listed is None:
            for key, value in data.items():
                if str(key).isdigit() and int(key) < count and number(value) is not None:
                    scores[int(key)] = number(value)
            return scores
        data = listed
    for k, item in enumerate(data if isinstance(data, list) else [data]):
        at = item.get("index", k) if isinstance(item, dict) else k
        own = number(item)
        if isinstance(at, int) and 0 <= at < count and own is not None:
            scores[at] = own
    return scores


def apply_cleaning(blocks: DataFrame, actions: DataFrame) -> DataFrame:
    """Blocks after a model's cleaning: ``actions`` has ``doc_id, block_pos, action, text`` (keep, fix or discard).

    Blocks without an action and tables stay; of several actions the first in the alphabet counts; a fix without text keeps the old text.
    """
    given = first_of(actions.select("doc_id", "block_pos", F.col("action").alias("__action"), F.col("text").alias("__text")), ["doc_id", "block_pos"])
    joined = blocks.join(given, ["doc_id", "block_pos"], "left")
    table = F.coalesce("is_table", F.lit(False))
    fixed = F.when(~table & (F.col("__action") == "fix"), F.coalesce(F.nullif(strip(F.col("__text")), F.lit("")), F.col("text"))).otherwise(F.col("text"))
    return joined.filter(table | F.coalesce(F.col("__action") != "discard", F.lit(True))).withColumn("text", fixed).drop("__action", "__text")


def rerank(candidates: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """The best ``n`` per query by the external score (``query_id, id, rerank_score``) where there is one, else by their own."""
    from pyspark.sql import Window

    joined = candidates.join(scores, ["query_id", "id"], "left").withColumn("final", F.coalesce("rerank_score", "score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "id")
    return joined.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def merge_shards(blocks: DataFrame, shards: DataFrame) -> DataFrame:
    """Blocks of separately parsed page ranges as one document: pages shifted, order by page, shard and position.

    ``blocks``: ``doc_id, shard_no, block_pos, page_idx, ...``; ``shards``: ``doc_id, shard_no, start_page``.
    """
    from pyspark.sql import Window

    moved = blocks.join(shards.select("doc_id", "shard_no", "start_page"), ["doc_id", "shard_no"]).withColumn("page_idx", F.col("page_idx") + F.col("start_page")).drop("start_page")
    order = Window.partitionBy("doc_id").orderBy("page_idx", "shard_no", "block_pos")
    return moved.withColumn("block_pos", F.row_number().over(order) - 1)


def page_routes(pages: DataFrame, least_chars: int = 80, most_images: int = 2, most_drawings: int = 20) -> DataFrame:
    """Add ``route`` and ``reason``: pages a local parser can read, pages for the cloud, and uncertain ones.

    ``pages``: ``text_chars, image_count, drawing_count, likely_scanned``. The first rule that holds decides.
    """
    reason = (
        F.when(F.col("likely_scanned"), "scanned")
        .when(F.col("text_chars") < least_chars, "little_text")
        .when(F.col("image_count") > most_images, "many_images")
        .when(F.col("drawing_count") > most_drawings, "many_drawings")
        .otherwise("plain_text")
    )
    route = F.when(reason.isin("scanned", "many_images"), "cloud").when(reason == "plain_text", "local").otherwise("uncertain")
    return pages.withColumn("reason", reason).withColumn("route", route)


def route_summary(routed: DataFrame) -> DataFrame:
    """Per document: pages of each route, the local share and what to do."""
    share = F.count_if(F.col("route") == "local") / F.count("*")
    return routed.groupBy("doc_id").agg(
        F.count_if(F.col("route") == "local").alias("local_pages"), F.count_if(F.col("route") == "cloud").alias("cloud_pages"), F.count_if(F.col("route") == "uncertain").alias("uncertain_pages"),
        F.round(share, 4).alias("local_share"), F.when(share >= 0.5, "hybrid").when(share >= 0.2, "trial").otherwise("cloud").alias("advice"),
    )


def recall_channels(candidates: DataFrame) -> DataFrame:
    """Per query: candidates found by vectors, by words and by relation only."""
    return candidates.groupBy("query_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("dense_score") > 0).alias("dense"), F.count_if(F.coalesce("dense_score", F.lit(0.0)) == 0).alias("other"), F.count_if(F.col("score") <= 0.3).alias("related")
    )


def triples_of(chunks: DataFrame) -> DataFrame:
    """Triples of enhanced chunks, owned by the chunk they enhance: ``kb_id, s, p, o, confidence, source_chunk``."""
    own = chunks.filter("layer = 'enhanced'").select("kb_id", F.coalesce("parent_id", "id").alias("source_chunk"), F.explode("triples").alias("t"))
    return own.select("kb_id", "t.s", "t.p", "t.o", "t.confidence", "source_chunk")
