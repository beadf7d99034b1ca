"""Harmonise two sources: align, audit, propose rules, repair what is safe, ask about the rest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.fixed import FeatureGroups
from riskloom.operators import align, audit


@dataclass
class Harmonised:
    """Tables of one harmonisation run; all are lazy."""

    aligned_a: DataFrame
    aligned_b: DataFrame
    value_audit: DataFrame
    representation_audit: DataFrame
    rules: DataFrame
    repaired_b: DataFrame
    repair_report: DataFrame
    unresolved: DataFrame
    direction_audit: DataFrame


def harmonise(
    source_a: DataFrame,
    source_b: DataFrame,
    mapping: DataFrame,
    row_key: str,
    label: str,
    labels_a: Mapping[str, int],
    labels_b: Mapping[str, int],
    groups: FeatureGroups = FeatureGroups(),
    names: tuple[str, str] = ("a", "b"),
) -> Harmonised:
    """Both sources carry the row key and the raw label; the mapping has been reviewed."""
    rows = align.confirmed(mapping)
    key = (row_key, row_key, row_key)
    a = align.aligned_source(source_a, [key, *rows], 0, label, labels_a)
    b = align.aligned_source(source_b, [key, *rows], 1, label, labels_b)
    features = [unified for _, _, unified in rows]

    def token_table(df: DataFrame) -> DataFrame:
        return audit.tokens(audit.long_cells(df, features, row_key), row_key=True)

    tokens_a, tokens_b = token_table(a), token_table(b)
    strict = audit.representation_audit(tokens_a, tokens_b, groups)
    rules = audit.propose_rules(strict, groups, names)
    chosen = [r["feature_name"] for r in audit.safe_rules(rules).select("feature_name").collect()]
    codes = audit.bin_codes(tokens_b)
    binary: Sequence[str] = [f for f in (*groups.low_risk_binary, *groups.mapped_binary) if f in features]
    return Harmonised(
        aligned_a=a,
        aligned_b=b,
        value_audit=audit.value_audit(tokens_a, tokens_b, groups, names),
        representation_audit=strict,
        rules=rules,
        repaired_b=audit.apply_repairs(b, row_key, chosen, codes),
        repair_report=audit.repair_report(rules, codes.filter(F.col("code").isNotNull())),
        unresolved=audit.unresolved_report(rules),
        direction_audit=audit.direction_audit(a, b, binary, "target", row_key, groups, names),
    )
