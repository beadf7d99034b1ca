"""Scorecards, contribution lists, bands and request checks as column expressions.

All functions work on a table with one column per input field. A field that the
table lacks counts as missing. Nothing here shuffles: a whole scored table is
one projection over the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.fixed import (
    BINARY_TRANSLATION,
    CLINICAL_BASE,
    CLINICAL_FALLBACK,
    CLINICAL_FLAGS,
    CLINICAL_NOTE,
    CLINICAL_RANGES,
    CLINICAL_TERMS,
    CLINICAL_SCORECARD,
    CONTRIBUTION_LIMIT,
    DEFAULT_MESSAGE,
    DEFAULT_RESPONSE_NOTE,
    FALLBACK_CONTRIBUTIONS,
    FEATURES,
    HIGH_RISK,
    LAST_FALLBACK_CONTRIBUTION,
    MESSAGE_LIMIT,
    MODERATE_RISK,
    NUMERIC_TRANSLATION,
    PROTECTIVE_WORDS,
    RESEARCH_BASE,
    RESEARCH_FALLBACK,
    RESEARCH_FLAGS,
    RESEARCH_NOTE,
    RESEARCH_TERMS,
    RESEARCH_SCORECARD,
    SCORECARD_BOUNDS,
    SCORECARD_DIGITS,
    TRANSLATION_NOTES,
    Flag,
    Points,
    Term,
    Word,
)
from riskloom.operators.learning import Bundle
from riskloom.functions.text import exact_round, let, number, reasons, strip, yes_no

Field = Callable[[str], Column]
ITEM = "array<struct<feature:string,message:string,contribution:double>>"


def fields(df: DataFrame) -> Field:
    """Column of an input field, or a missing text when the table has no such column."""
    present = set(df.columns)
    return lambda name: F.col(f"`{name}`") if name in present else F.lit(None).cast("string")


def map_fields(inputs: str | Column) -> Field:
    """Field look-up in a map column of texts."""
    column = F.col(inputs) if isinstance(inputs, str) else inputs
    return lambda name: F.try_element_at(column, F.lit(name))


def clip(value: Column, low: float | None, high: float | None) -> Column:
    """Limit a value; a missing value stays missing."""
    limited = value
    if low is not None:
        limited = F.greatest(limited, F.lit(low))
    if high is not None:
        limited = F.least(limited, F.lit(high))
    return F.when(value.isNotNull(), limited)


def probability(value: Column) -> Column:
    return clip(value.cast("double"), 0.0, 1.0)


def squash(decision: Column) -> Column:
    """Logistic function of a decision value."""
    return 1.0 / (1.0 + F.exp(-decision))


def band(score: Column, names: Sequence[str] = ("high_risk", "moderate_risk", "lower_risk")) -> Column:
    return F.when(score >= HIGH_RISK, names[0]).when(score >= MODERATE_RISK, names[1]).otherwise(names[2])


def contributions(field: Field, terms: Sequence[Term], flags: Sequence[Flag], fallback: Flag) -> Column:
    """Non-zero contribution items, largest first, at most six.

    A flag that waits for a word other than `yes` is compared with the raw text:
    the yes/no vocabulary would hide the word.
    """
    entries = []
    for place, term in enumerate(terms):
        x = number(field(term.feature))
        value = clip((x - term.centre) / term.scale, term.low, term.high) * term.sign
        entries.append((place, term.feature, term.message, value, value != 0))
    for place, flag in enumerate(flags, start=len(terms)):
        raw = field(flag.feature)
        said = yes_no(raw) == "yes" if flag.word == "yes" else F.lower(strip(raw.cast("string"))) == flag.word
        entries.append((place, flag.feature, flag.message, F.lit(flag.weight), said))

    def item(place: int, feature: str, message: str, value: Column) -> Column:
        return F.struct(
            F.lit(place).alias("place"),
            F.lit(feature).alias("feature"),
            F.lit(message).alias("message"),
            value.alias("contribution"),
        )

    found = F.array_compact(F.array(*[F.when(keep, item(p, f, m, v)) for p, f, m, v, keep in entries]))
    default = F.array(item(0, fallback.feature, fallback.message, F.lit(fallback.weight)))

    def ranked(i: Column) -> Column:
        shown = exact_round(i["contribution"], 4)
        return F.struct(
            (-F.abs(shown)).alias("order"),
            i["place"].alias("place"),
            i["feature"].alias("feature"),
            i["message"].alias("message"),
            shown.alias("contribution"),
        )

    either = let(found, lambda items: F.when(F.size(items) > 0, items).otherwise(default))
    best = F.slice(F.array_sort(F.transform(either, ranked)), 1, CONTRIBUTION_LIMIT)
    return F.transform(
        best,
        lambda i: F.struct(
            i["feature"].alias("feature"), i["message"].alias("message"), i["contribution"].alias("contribution")
        ),
    )


def research_contributions(field: Field) -> Column:
    return contributions(field, RESEARCH_TERMS, RESEARCH_FLAGS, RESEARCH_FALLBACK)


def clinical_contributions(field: Field) -> Column:
    return contributions(field, CLINICAL_TERMS, CLINICAL_FLAGS, CLINICAL_FALLBACK)


def scorecard(field: Field, base: float, items: Sequence[Points | Word]) -> Column:
    """Additive score, rounded and limited; a missing input adds nothing."""
    total = F.lit(base)
    for item in items:
        if isinstance(item, Word):
            said = F.coalesce(field(item.feature).cast("string") == item.word, F.lit(False))
            total = total + F.when(said, F.lit(item.weight)).otherwise(F.lit(0.0))
        else:
            value = (number(field(item.feature)) - item.centre) * item.factor / item.divisor
            total = total + F.coalesce(clip(value, item.low, item.high) * item.sign, F.lit(0.0))
    low, high = SCORECARD_BOUNDS
    return let(
        total, lambda t: F.least(F.greatest(exact_round(t, SCORECARD_DIGITS, half_up=True), F.lit(low)), F.lit(high))
    )


def clinical_score(field: Field) -> Column:
    return scorecard(field, CLINICAL_BASE, CLINICAL_SCORECARD)


def research_score(field: Field) -> Column:
    return scorecard(field, RESEARCH_BASE, RESEARCH_SCORECARD)


def threshold_messages(field: Field, rules: Sequence[tuple], limit: int = MESSAGE_LIMIT) -> Column:
    """The first few messages whose threshold is met."""
    compare = {
        "<": lambda x, b: number(x) < b,
        "<=": lambda x, b: number(x) <= b,
        ">": lambda x, b: number(x) > b,
        ">=": lambda x, b: number(x) >= b,
        "=": lambda x, b: x.cast("string") == b,
    }
    entries = [
        (
            compare[sign](field(feature), bound),
            F.struct(
                F.lit(name).alias("feature"), F.lit(text).alias("message"), F.lit(float(weight)).alias("contribution")
            ),
        )
        for feature, sign, bound, name, text, weight in rules
    ]
    return F.slice(reasons(*entries), 1, limit)


def feature_columns(field: Field, features: Sequence[str] = FEATURES, numeric: Sequence[str] = ()) -> list[Column]:
    """Inputs in a stored feature order; absent ones are missing. Those in `numeric` are read as numbers."""
    return [(number(field(f)) if f in numeric else field(f)).alias(f) for f in features]


def translated(field: Field, features: Sequence[str] = FEATURES) -> Field:
    """Research view of clinical inputs: only fields with the same meaning are carried over."""
    known = {target: number(field(source)).cast("string") for source, target in NUMERIC_TRANSLATION.items()}
    known |= {target: yes_no(field(source)) for source, target in BINARY_TRANSLATION.items()}
    return lambda name: known.get(name, F.lit(None).cast("string"))


def translation_notes(field: Field) -> Column:
    return reasons(*[(field(name).isNotNull(), text) for name, text in TRANSLATION_NOTES.items()])


def clinical_note(field: Field) -> Column:
    return F.concat_ws(" ", F.lit(CLINICAL_NOTE), translation_notes(field))


def encoded(raw: Column, codes: Mapping[str, int], unknown: str = "unknown") -> Column:
    """Stored category code; a category never seen gets the `unknown` code when there is one."""
    pairs = [x for text, code in codes.items() for x in (F.lit(text), F.lit(code))]
    found = F.try_element_at(F.create_map(*pairs), raw)
    return F.when(raw.isNull(), None).otherwise(F.coalesce(found, F.lit(codes.get(unknown)))).cast("double")


def range_states(
    df: DataFrame, keys: Sequence[str], ranges: Mapping[str, tuple[float, float]] = CLINICAL_RANGES
) -> DataFrame:
    """State of every ranged field of every row: blank, in_range or out_of_range."""
    field = fields(df)
    entries = []
    for name, (low, high) in ranges.items():
        value = number(field(name))
        state = (
            F.when(value.isNull(), "blank").when((value < low) | (value > high), "out_of_range").otherwise("in_range")
        )
        entries.append(F.struct(F.lit(name).alias("field"), value.alias("value"), state.alias("state")))
    return df.select(*keys, F.inline(F.array(*entries)))


def completeness(field: Field, names: Sequence[str]) -> tuple[Column, Column]:
    """Filled fields and the state empty / partial / complete."""
    filled = sum(
        (F.when(F.nullif(strip(field(n).cast("string")), F.lit("")).isNotNull(), 1).otherwise(0) for n in names),
        F.lit(0),
    )
    state = F.when(filled == 0, "empty").when(filled >= len(names), "complete").otherwise("partial")
    return filled, state


def normalized_items(items: Column) -> Column:
    """Explanation items of any model response: defaults, position-based values and a direction."""

    def one(item: Column, i: Column) -> Column:
        message = F.coalesce(item["message"], F.lit(DEFAULT_MESSAGE))
        protective = F.lower(message).rlike("|".join(PROTECTIVE_WORDS))
        by_place = F.coalesce(
            F.get(F.array(*[F.lit(v) for v in FALLBACK_CONTRIBUTIONS]), i), F.lit(LAST_FALLBACK_CONTRIBUTION)
        )
        value = F.coalesce(number(item["contribution"]), F.when(protective, -by_place).otherwise(by_place))
        return F.struct(
            F.coalesce(item["feature"], F.concat(F.lit("feature_"), (i + 1).cast("string"))).alias("feature"),
            message.alias("message"),
            value.alias("contribution"),
            F.when(value >= 0, "positive").otherwise("negative").alias("direction"),
        )

    return F.transform(F.slice(items, 1, CONTRIBUTION_LIMIT), one)


def normalized_response(body: Column) -> list[Column]:
    """Response fields under one set of names, whatever names a model server used."""

    def first(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object(body, f"$.{n}") for n in names])

    raw = F.from_json(
        F.get_json_object(body, "$.explanation"), "array<struct<feature:string,message:string,contribution:string>>"
    )
    items = F.coalesce(raw, F.from_json(F.lit("[]"), "array<struct<feature:string,message:string,contribution:string>>"))
    return [
        F.coalesce(number(first("risk_score", "score", "probability")), F.lit(0.0)).alias("risk_score"),
        F.coalesce(first("prediction_label", "label"), F.lit("unknown")).alias("prediction_label"),
        F.coalesce(first("model_version", "version"), F.lit("unknown")).alias("model_version"),
        F.coalesce(first("timestamp"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("timestamp"),
        F.coalesce(first("notes"), F.lit(DEFAULT_RESPONSE_NOTE)).alias("notes"),
        normalized_items(items).alias("explanation"),
    ]


def stamped(df: DataFrame, version: str, route: Column) -> DataFrame:
    """Model version, route and UTC stamp of every scored row."""
    return df.withColumns(
        {
            "model_version": F.concat(F.lit(f"{version}::"), route),
            "serving_route": F.concat(F.lit("/predict/"), route),
            "timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        }
    )


def response(
    df: DataFrame,
    score: Column,
    explanation: Column,
    notes: Column,
    version: str,
    route: str | Column,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Score, label, explanation and stamps of every row, as one chain of projections."""
    scored = df.select(
        *keep,
        score.cast("double").alias("_score"),
        explanation.alias("explanation"),
        notes.alias("notes"),
        (F.lit(route) if isinstance(route, str) else route).alias("_route"),
    ).withColumn("risk_score", probability(F.col("_score")))
    labelled = scored.withColumn("prediction_label", band(F.col("risk_score")))
    return stamped(labelled, version, F.col("_route")).select(
        *keep, "risk_score", "prediction_label", "model_version", "serving_route", "timestamp", "notes", "explanation"
    )


def either(clinical: Column, field: Field) -> Field:
    """Research view of inputs of both routes: clinical ones are translated."""
    view = translated(field)
    return lambda name: F.when(clinical, view(name)).otherwise(field(name).cast("string"))


def model_scores(df: DataFrame, field: Field, bundle: Bundle, score: str = "_score") -> DataFrame:
    """`df` with the model's probability of the positive class.

    The inputs are brought into the stored feature order as columns of their
    own names, so the stages of the model see what they were fitted on; they go
    again afterwards, and columns of the same names in `df` come back. One
    projection chain without a shuffle, for a table or a stream.
    """
    own = df.withColumn("_row", F.struct(*[F.col(f"`{c}`") for c in df.columns]))
    aligned = own.select("_row", *feature_columns(field, bundle.features, bundle.numeric))
    scored = bundle.model.transform(aligned)
    return scored.select("_row.*", vector_to_array(F.col("probability"))[1].alias(score))


def research_response(df: DataFrame, score: Column, field: Field, version: str, keep: Sequence[str] = ()) -> DataFrame:
    """Responses of the research route for inputs with their score."""
    return response(df, score, research_contributions(field), F.lit(RESEARCH_NOTE), version, "research", keep)


def clinical_response(df: DataFrame, score: Column, field: Field, version: str, keep: Sequence[str] = ()) -> DataFrame:
    """Responses of the clinical route for clinical inputs with the score of their translation."""
    return response(df, score, clinical_contributions(field), clinical_note(field), version, "clinical", keep)


def model_responses(df: DataFrame, bundle: Bundle, route: str, keep: Sequence[str] = ()) -> DataFrame:
    """Responses for a table with one column per input field, scored by a fitted model on one route."""
    field = fields(df)
    if route == "clinical":
        scored = model_scores(df, translated(field), bundle)
        return clinical_response(scored, F.col("_score"), fields(scored), bundle.version, keep)
    scored = model_scores(df, field, bundle)
    return research_response(scored, F.col("_score"), fields(scored), bundle.version, keep)
