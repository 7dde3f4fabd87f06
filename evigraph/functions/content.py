"""Validation of typed memory content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Required and optional fields per memory type.
CONTENT_FIELDS = {
    "bugfix": (("summary",), ("root_cause", "fix", "verified", "verification_evidence", "extensions")),
    "decision": (("decision", "rationale"), ("alternatives", "extensions")),
    "preference": (("subject", "preference"), ("context", "extensions")),
    "procedure": (("name",), ("steps", "prerequisites", "extensions")),
    "research": (("question", "finding"), ("sources", "extensions")),
    "trading": (("instrument", "thesis"), ("risk", "timeframe", "extensions")),
    "learning": (("topic", "lesson"), ("application", "extensions")),
    "fact": (("value",), ("subject", "unit", "extensions")),
    "custom": ((), ()),
}
# Fields that must be non-empty text (required ones, bar the untyped fact value).
TEXT_FIELDS = {t: tuple(f for f in required if t != "fact") for t, (required, _) in CONTENT_FIELDS.items()}
SUMMARY_LIMIT = 20000
STEP_LIMIT = 100


def content_error(memory_type: Column, content_json: Column) -> Column:
    """First rule a typed content object breaks, else null."""
    doc = F.try_parse_json(content_json)
    keys = F.coalesce(F.json_object_keys(content_json), F.array().cast("array<string>"))

    def text(field: str) -> Column:
        return F.when(F.schema_of_variant(F.variant_get(doc, f"$.{field}", "variant")) == "STRING",
                      F.try_variant_get(doc, f"$.{field}", "string"))

    def value_type(field: str) -> Column:
        return F.schema_of_variant(F.variant_get(doc, f"$.{field}", "variant"))

    error = F.lit(None).cast("string")
    for name, (required, optional) in CONTENT_FIELDS.items():
        if name == "custom":
            rule = F.when(F.size(keys) == 0, F.lit("empty content"))
        else:
            checks = [
                F.when(~F.array_contains(keys, f), F.lit(f"missing {f}")) for f in required
            ]
            unknown = F.array_except(keys, F.array(*[F.lit(f) for f in required + optional]))
            checks.append(F.when(F.size(unknown) > 0, F.concat(F.lit("unknown "), F.element_at(unknown, 1))))
            for f in TEXT_FIELDS[name]:
                bad = F.coalesce(F.length(text(f)), F.lit(0)) == 0
                if f == "summary":
                    bad = bad | (F.length(text(f)) > SUMMARY_LIMIT)
                checks.append(F.when(bad, F.lit(f"invalid {f}")))
            if name == "fact":
                checks.append(F.when(F.is_variant_null(F.variant_get(doc, "$.value", "variant")), F.lit("invalid value")))
            if name == "procedure":
                steps = F.try_variant_get(doc, "$.steps", "array<variant>")
                checks.append(F.when(
                    F.array_contains(keys, "steps") & ~F.coalesce(F.size(steps).between(1, STEP_LIMIT), F.lit(False)),
                    F.lit("invalid steps")))
            if name == "bugfix":
                has = F.array_contains(keys, "verified")
                checks.append(F.when(has & (value_type("verified") != "BOOLEAN"), F.lit("invalid verified")))
                proof = F.coalesce(F.try_variant_get(doc, "$.verification_evidence", "string"), F.lit(""))
                checks.append(F.when(
                    has & F.coalesce(F.try_variant_get(doc, "$.verified", "boolean"), F.lit(False)) & (proof == ""),
                    F.lit("verified without evidence")))
            rule = F.coalesce(*checks)
        error = F.when(memory_type == name, rule).otherwise(error)
    known = memory_type.isin(*CONTENT_FIELDS)
    return F.when(~known, F.lit("unknown type")).otherwise(error)
