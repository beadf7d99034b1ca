"""Model life cycle: state by event replay, transition audit, roll-back target and registry updates.

Events have (registry keys), `event_type`, `model_id` and an order: a numeric
time and a tie-break column. A log of one registry may be most of the data, so
"what was true just before this event" is a running last value over time
ranges, not a window over the whole log.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.contracts import require_empty, status_violations, unknown_active
from riskloom.operators.keys import join_groups
from riskloom.operators.ranking import range_cuts, running_last

ACTIVATIONS = ("promoted", "rolled_back")
TIME, TIE = "event_time", "event_id"


def event_row(event_type: Column, model: Column, actor: Column, reason: Column, time: Column) -> list[Column]:
    """Columns of a new event; its id joins stamp, type and model."""
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return [
        F.concat_ws("::", stamp, event_type, model).alias("event_id"),
        stamp.alias("timestamp"),
        event_type.alias("event_type"),
        model.alias("model_id"),
        actor.alias("actor"),
        reason.alias("reason"),
    ]


def is_activation(event_type: Column | None = None) -> Column:
    return (F.col("event_type") if event_type is None else event_type).isin(*ACTIVATIONS)


def model_facts(events: DataFrame, registry: Sequence[str] = ()) -> DataFrame:
    """What the log says about each model: its last event, approval and activation.

    All columns are maxima or counts, so facts of two parts of a log can be merged.
    """
    place = F.struct(TIME, TIE)

    def newest(condition: Column | None = None) -> Column:
        return F.max(place if condition is None else F.when(condition, place))

    return events.groupBy(*registry, "model_id").agg(
        F.max(F.struct(TIME, TIE, "event_type")).alias("last"),
        newest(F.col("event_type") == "approved").alias("approval"),
        newest(is_activation()).alias("activation"),
        F.count(F.lit(1)).alias("event_count"),
    )


def merge_facts(one: DataFrame, other: DataFrame, registry: Sequence[str] = ()) -> DataFrame:
    return (
        one.unionByName(other)
        .groupBy(*registry, "model_id")
        .agg(*[F.max(c).alias(c) for c in ("last", "approval", "activation")], F.sum("event_count").alias("event_count"))
    )


def state_of(facts: DataFrame, registry: Sequence[str] = ()) -> DataFrame:
    """Status of every model from its facts, with the active model of its registry."""
    active = facts.groupBy(*registry).agg(F.max_by("model_id", "activation").alias("active_model_id"))
    if registry:
        joined = join_groups(facts, active, registry)
    else:
        joined = facts.withColumn("active_model_id", active.select("active_model_id").scalar())
    last_event = F.col("last.event_type")
    return joined.select(
        *registry,
        "model_id",
        last_event.alias("last_event"),
        F.col(f"last.{TIME}").alias("last_time"),
        "event_count",
        F.coalesce(f"approval.{TIME}", f"activation.{TIME}").alias("approved_time"),
        F.col(f"activation.{TIME}").alias("promoted_time"),
        "active_model_id",
        status_of(last_event, F.col("model_id") == F.col("active_model_id")).alias("status"),
    )


def model_state(events: DataFrame, registry: Sequence[str] = ()) -> DataFrame:
    """Status of every model after the log.

    Equal times are ordered by the tie-break column, so replaying a log in any
    order gives the same state.
    """
    return state_of(model_facts(events, registry), registry)


def active_models(events: DataFrame, registry: Sequence[str] = ()) -> DataFrame:
    """Model of the last activation, per registry."""
    chosen = F.when(is_activation(), F.struct(TIME, TIE))
    return events.groupBy(*registry).agg(F.max_by("model_id", chosen).alias("active_model_id"))


def status_of(last_event: Column, is_active: Column) -> Column:
    """Status a model has after its last own event; an activation lasts until another model is activated."""
    return (
        F.when(last_event == "registered", "candidate")
        .when(last_event == "approved", "approved")
        .when(last_event == "retired", "retired")
        .when(last_event.isin(*ACTIVATIONS) & F.coalesce(is_active, F.lit(False)), "active")
        .when(last_event.isin(*ACTIVATIONS), "approved")
    )


def with_history(events: DataFrame, registry: Sequence[str] = ()) -> DataFrame:
    """Add what held just before each event: the model's status and the active model."""
    cuts = range_cuts(events, TIME)
    order = [TIME, TIE]
    staged = events.withColumn("_activated", F.when(is_activation(), F.col("model_id")))
    staged = running_last(staged, registry, order, "_activated", "previous_active", cuts)
    staged = running_last(staged, [*registry, "model_id"], order, "event_type", "previous_event", cuts)
    before = status_of(F.col("previous_event"), F.col("model_id") == F.col("previous_active"))
    return staged.withColumn("previous_status", before).drop("_activated")


def violation(previous_status: Column, previous_active: Column, model: Column, event_type: Column) -> Column:
    """Why an event should have been refused; missing when it was allowed.

    The log is taken at its word: an event that should have been refused still
    counts for the events after it.
    """
    current = F.coalesce(model == previous_active, F.lit(False))
    return (
        F.when((event_type == "approved") & (previous_status == "retired"), "retired_cannot_be_approved")
        .when((event_type == "approved") & (previous_status == "active"), "active_is_already_approved")
        .when(
            (event_type == "promoted") & ~F.coalesce(previous_status.isin("approved", "active"), F.lit(False)),
            "only_approved_can_be_promoted",
        )
        .when((event_type == "promoted") & current, "already_active")
        .when((event_type == "rolled_back") & previous_active.isNull(), "no_active_model_to_roll_back_from")
        .when(
            (event_type == "rolled_back") & ~F.coalesce(previous_status.isin("approved", "active"), F.lit(False)),
            "rollback_target_not_approved",
        )
        .when((event_type == "rolled_back") & current, "rollback_target_is_current")
    )


def transition_audit(events: DataFrame, registry: Sequence[str] = ()) -> DataFrame:
    """Every event that breaks a transition rule, with the reason."""
    history = with_history(events, registry)
    why = violation(F.col("previous_status"), F.col("previous_active"), F.col("model_id"), F.col("event_type"))
    return history.withColumn("violation", why).filter("violation is not null")


def rollback_targets(events: DataFrame, registry: Sequence[str] = ()) -> DataFrame:
    """Where a roll-back without a named target would go, per registry.

    The newest activation whose previous active model is another one than the
    current, and still approved or active.
    """
    cuts = range_cuts(events, TIME)
    staged = events.withColumn("_activated", F.when(is_activation(), F.col("model_id")))
    staged = running_last(staged, registry, [TIME, TIE], "_activated", "previous_active", cuts)
    steps = staged.filter(is_activation() & F.col("previous_active").isNotNull())
    state = model_state(events, registry).filter(
        F.col("status").isin("approved", "active") & ~F.col("model_id").eqNullSafe(F.col("active_model_id"))
    )
    usable = steps.join(
        state.select(*registry, F.col("model_id").alias("previous_active"), "active_model_id"),
        [*registry, "previous_active"],
    )
    return usable.groupBy(*registry).agg(
        F.max_by("previous_active", F.struct(TIME, TIE)).alias("rollback_model_id"),
        F.max("active_model_id").alias("active_model_id"),
    )


def resolve_active(models: DataFrame, registries: DataFrame, registry: Sequence[str]) -> DataFrame:
    """Active model per registry: the named one, else the only active row, else the only row.

    `resolution` is missing where none of these decides.
    """
    facts = models.groupBy(*registry).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.count_if(F.col("status") == "active").alias("_active"),
        F.max(F.when(F.col("status") == "active", F.col("model_id"))).alias("_active_id"),
        F.max("model_id").alias("_any_id"),
    )
    named = registries.select(*registry, F.col("active_model_id").alias("_named"))
    joined = facts.join(named, list(registry), "left")
    how = (
        F.when(F.col("_named").isNotNull(), "named")
        .when(F.col("_active") == 1, "only_active")
        .when(F.col("_rows") == 1, "only_model")
    )
    chosen = F.when(how == "named", F.col("_named")).when(how == "only_active", F.col("_active_id"))
    return joined.select(
        *registry, how.alias("resolution"), chosen.when(how == "only_model", F.col("_any_id")).alias("active_model_id")
    )


def require_active(models: DataFrame, registries: DataFrame, registry: Sequence[str]) -> DataFrame:
    resolved = resolve_active(models, registries, registry)
    require_empty(resolved.filter("resolution is null"), "No active model can be resolved")
    return resolved


def upsert(models: DataFrame, entries: DataFrame, keys: Sequence[str], activate: bool, registry: Sequence[str] = ()) -> DataFrame:
    """Replace or add registry rows; activating an entry demotes the other active rows of its registry."""
    kept = models.join(entries.select(*keys), list(keys), "left_anti")
    if activate:
        if registry:
            touched = entries.select(*registry, F.lit(True).alias("_touched")).distinct()
            kept = kept.join(touched, list(registry), "left")
            demote = (F.col("status") == "active") & F.coalesce("_touched", F.lit(False))
        else:
            demote = F.col("status") == "active"
        kept = kept.withColumn("status", F.when(demote, "approved").otherwise(F.col("status"))).select(*models.columns)
        entries = entries.withColumn("status", F.lit("active"))
    return kept.unionByName(entries.select(*models.columns))


def consistency(models: DataFrame, active: DataFrame, keys: Sequence[str] = ("model_id",)) -> None:
    """Fail on unknown statuses, missing fields, or an active id without a registry row."""
    require_empty(status_violations(models), "Registry rows are invalid")
    require_empty(unknown_active(active, models, keys), "The active model is not in the registry")
