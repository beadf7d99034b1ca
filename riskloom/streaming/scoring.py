"""Score requests as they arrive; the same projection as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.fixed import RESEARCH_NOTE
from riskloom.operators.learning import Bundle
from riskloom.operators.scoring import (
    Field,
    clinical_contributions,
    clinical_note,
    either,
    map_fields,
    model_scores,
    research_contributions,
    research_score,
    response,
    translated,
)
from riskloom.sources.requests import parse_requests, quarantined, usable

Score = Callable[[Field], Column]


def score_requests(
    requests: DataFrame,
    body: str,
    keys: list[str],
    is_base64: str | None = None,
    score: Score = research_score,
    version: str = "scorecard",
) -> DataFrame:
    """Responses of both routes. Stateless, so it runs on a stream or a table.

    Each request is read and parsed once; its mode picks the branch. The
    clinical route scores the translated research view of its inputs.
    """
    parsed = usable(parse_requests(requests, body, is_base64))
    field = map_fields("inputs")
    clinical = F.col("mode") == "clinical"
    return response(
        parsed,
        F.when(clinical, score(translated(field))).otherwise(score(field)),
        F.when(clinical, clinical_contributions(field)).otherwise(research_contributions(field)),
        F.when(clinical, clinical_note(field)).otherwise(RESEARCH_NOTE),
        version,
        F.col("mode"),
        keys,
    )


def model_score_requests(
    requests: DataFrame, body: str, keys: list[str], bundle: Bundle, is_base64: str | None = None
) -> DataFrame:
    """Responses of both routes by a fitted model, in one stateless pass over a stream or a table.

    Both routes go through the model once: the clinical route as the research
    view of its inputs. A missing or unknown word and a missing number are what
    the model's own imputation and codes make of them.
    """
    parsed = usable(parse_requests(requests, body, is_base64)).select(*keys, "mode", "inputs")
    clinical = F.col("mode") == "clinical"
    scored = model_scores(parsed, either(clinical, map_fields("inputs")), bundle)
    field = map_fields("inputs")
    return response(
        scored,
        F.col("_score"),
        F.when(clinical, clinical_contributions(field)).otherwise(research_contributions(field)),
        F.when(clinical, clinical_note(field)).otherwise(RESEARCH_NOTE),
        bundle.version,
        F.col("mode"),
        keys,
    )


def rejected_requests(requests: DataFrame, body: str, keys: list[str], is_base64: str | None = None) -> DataFrame:
    return quarantined(parse_requests(requests, body, is_base64)).select(*keys, "mode", "rejection", "rejected_field")


def start_scoring(scored: DataFrame, path: str, checkpoint: str):
    """Append scored rows to files; `availableNow` drains what is there and ends."""
    return (
        scored.withColumn("explanation", F.to_json("explanation"))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
