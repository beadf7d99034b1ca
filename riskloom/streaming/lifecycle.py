"""Keep the model registry up to date from a stream of life-cycle events."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from riskloom.operators.lifecycle import merge_facts, model_facts, state_of
from riskloom.streaming.versions import before, newest, replace


def registry_sink(path: str, registry: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """Batch writer: merge the facts of new events into the facts of the batch before.

    A batch reads what its predecessor left and writes the other of two folders, so a repeated batch changes nothing, and
    its work and room depend on the number of models and not on the length of the log.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        facts, known = model_facts(batch, registry), before(batch.sparkSession, path, batch_id)
        replace(facts if known is None else merge_facts(known, facts, registry), path, batch_id)

    return write


def read_registry(spark: SparkSession, path: str, registry: Sequence[str] = ()) -> DataFrame:
    """Newest registry state."""
    facts = newest(spark, path)
    if facts is None:
        raise FileNotFoundError(f"No batch has written a registry to {path}.")
    return state_of(facts, registry)


def start_registry(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    return (
        events.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
