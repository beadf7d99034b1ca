"""Request bodies: text or base64 JSON with an inputs object."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.fixed import CLINICAL_NUMBERS, RESEARCH_NUMBERS
from riskloom.functions.text import number, strip

INPUTS, CONTEXT = "map<string,string>", "struct<case_id:string,patient_name:string,clinical_note:string>"
RESERVED = ("mode", "context")
MODES = ("research", "clinical")


def decoded(body: Column, is_base64: Column | None = None) -> Column:
    text = body.cast("string")
    if is_base64 is None:
        return text
    return F.when(F.coalesce(is_base64, F.lit(False)), F.try_to_binary(text, F.lit("base64")).cast("string")).otherwise(text)


def parse_requests(df: DataFrame, body: str, is_base64: str | None = None) -> DataFrame:
    """Add mode, inputs, context, rejection and rejected_field.

    The inputs are the `inputs` object, else the first other object in the body;
    text that looks like one is none. A body is one JSON object with nothing
    behind it. A number field of the route that holds something else is refused
    with its name. `rejection` is missing for a usable request.

    A body is parsed once; its parts are read from the parsed value.
    """
    text = decoded(F.col(body), F.col(is_base64) if is_base64 else None)
    text = F.coalesce(F.nullif(text, F.lit("")), F.lit("{}"))
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))  # text behind an object spoils the list
    staged = df.select("*", once(text.alias("_text"), listed.alias("_listed")))
    alone = F.try_variant_get("_listed", "$[1]", "variant").isNull()
    whole = F.when(alone, F.try_variant_get("_listed", "$[0]", "map<string,variant>"))
    staged = staged.select("*", once(whole.alias("_body"), F.try_variant_get("_listed", "$[0].inputs", INPUTS).alias("_named")))
    others = F.filter(F.json_object_keys("_text"), lambda k: ~k.isin(*RESERVED))  # in the order of the text
    objects = F.transform(others, lambda k: F.try_variant_get(F.try_element_at("_body", k), "$", INPUTS))
    chosen = F.coalesce("_named", F.get(F.filter(objects, lambda o: o.isNotNull()), F.lit(0)))
    said = F.try_variant_get("_listed", "$[0].mode", "string")
    mode = F.when(F.map_contains_key("_body", "mode"), F.lower(strip(F.coalesce(said, F.lit("none"))))).otherwise("research")
    parsed = staged.select(
        *df.columns,
        once(
            F.when(F.col("_body").isNotNull(), mode).alias("mode"),
            F.when(F.col("_body").isNotNull(), chosen).alias("inputs"),
            F.when(F.col("_body").isNotNull(), F.try_variant_get("_listed", "$[0].context", CONTEXT)).alias("context"),
            F.col("_body").isNull().alias("_broken"),
        ),
    )
    odd = F.when(F.col("mode") == "clinical", not_numbers(CLINICAL_NUMBERS)).when(F.col("mode") == "research", not_numbers(RESEARCH_NUMBERS))
    rejection = (
        F.when(F.col("_broken"), "invalid_json")
        .when(F.col("inputs").isNull(), "missing_inputs")
        .when(~F.col("mode").isin(*MODES), "unsupported_mode")
        .when(F.col("rejected_field").isNotNull(), "invalid_number")
    )
    return parsed.select("*", once(odd.alias("rejected_field"))).withColumn("rejection", rejection).drop("_broken")


def not_numbers(names: Sequence[str]) -> Column:
    """The first of the input fields whose text is there, not empty and no number."""
    cases = [F.try_element_at("inputs", F.lit(n)) for n in names]
    return F.coalesce(*[F.when((c != "") & number(c).isNull(), n) for n, c in zip(names, cases)])


def once(*columns: Column) -> Column:
    """Columns that later filters and projections use as they are.

    A filter on a plain projection is pushed below it and would parse the body
    again for each use of a parsed value.
    """
    return F.inline(F.array(F.struct(*columns)))


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("rejection").isNull())


def routed(parsed: DataFrame, mode: str) -> DataFrame:
    """Requests of one route."""
    return usable(parsed).filter(F.col("mode") == mode)


def quarantined(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("rejection").isNotNull())
