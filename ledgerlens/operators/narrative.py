"""Narrative data: low-signal guard, JSON parsing with rejects, versioned
defaults.  (Generating narratives is an external service and not built.)"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.rules import LOW_SIGNAL_PHRASES

CURRENT_NARRATIVE_VERSION = 1


INSIGHTS = "array<struct<headline: string, detail: string>>"


def _low_signal(headline: Column, detail: Column, phrases: Sequence[str]) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(headline, F.lit("")), F.coalesce(detail, F.lit(""))))
    arr = F.array(*[F.lit(p.lower()) for p in phrases]) if phrases else F.array().cast("array<string>")
    return F.exists(arr, lambda p: F.instr(text, p) > 0)


def quality_guard(df: DataFrame, headline: str = "headline", detail: str = "detail",
                  phrases: Sequence[str] = LOW_SIGNAL_PHRASES, out: str = "suppressed") -> DataFrame:
    """Mark an insight suppressed when lower(headline + ' ' + detail) contains
    any of ``phrases`` (a native ``exists`` over a literal array)."""
    return df.withColumn(out, _low_signal(F.col(headline), F.col(detail), phrases))


def guard_insights(df: DataFrame, col: str = "insights", phrases: Sequence[str] = LOW_SIGNAL_PHRASES,
                   kept: str = "insights", suppressed: str = "suppressed_insights") -> DataFrame:
    """Split an array of (headline, detail) into the insights kept and those
    that :func:`quality_guard` would suppress, both in their order."""
    low = lambda x: _low_signal(x["headline"], x["detail"], phrases)
    return df.withColumns({kept: F.filter(col, lambda x: ~low(x)), suppressed: F.filter(col, low)})


def _field(j: Column, path: str) -> Column:
    return F.get_json_object(j, path)


def parse_narratives(df: DataFrame, col: str = "narrative_json") -> DataFrame:
    """Parse narrative JSON: ``valid`` marks a well-formed JSON object; the
    fields are NULL for malformed rows (those form the reject set).
    ``insights`` holds the (headline, detail) of a list, NULL for other values."""
    j = F.col(col)
    valid = F.try_parse_json(j).isNotNull() & F.regexp_like(j, F.lit(r"^\s*\{"))
    ins = _field(j, "$.insights")
    return df.withColumns({
        "valid": F.coalesce(valid, F.lit(False)),
        "schema_version": F.when(valid, _field(j, "$.schema_version").try_cast("int")),
        "tldr": F.when(valid, _field(j, "$.tldr")),
        "n_insights": F.when(valid, F.json_array_length(ins)),
        # Entries that are no objects have null fields.
        "insights": F.when(valid, F.transform(F.from_json(F.when(F.json_array_length(ins).isNotNull(), ins), "array<string>"), lambda x: F.struct(
            _field(x, "$.headline").alias("headline"), _field(x, "$.detail").alias("detail")))),
        "next_steps": F.when(valid, _field(j, "$.next_steps")),
        "generated_at": F.when(valid, _field(j, "$.generated_at")),
    })


def migrate_narratives(parsed: DataFrame) -> DataFrame:
    """Version defaults: missing/0 -> version 0 with '' text fields and no
    insights when insights is not a list; 1 -> as is; newer -> as is, flagged."""
    v = F.coalesce(F.col("schema_version"), F.lit(0))
    legacy = v == 0
    none = F.array().cast(INSIGHTS)
    more = {"insights": F.when(legacy, F.coalesce("insights", none)).otherwise(F.col("insights"))} if "insights" in parsed.columns else {}
    return parsed.withColumns(more | {
        "schema_version": v,
        "tldr": F.when(legacy, F.coalesce("tldr", F.lit(""))).otherwise(F.col("tldr")),
        "n_insights": F.when(legacy, F.coalesce("n_insights", F.lit(0))).otherwise(F.col("n_insights")),
        "next_steps": F.when(legacy, F.coalesce("next_steps", F.lit(""))).otherwise(F.col("next_steps")),
        "generated_at": F.when(legacy, F.coalesce("generated_at", F.lit(""))).otherwise(F.col("generated_at")),
        "newer_than_supported": v > CURRENT_NARRATIVE_VERSION,
    })
