"""Column expressions: months, ratios, flags, unit and number text, labels, keys.  No Python runs per row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

TOTAL_CODE = "000TOTAL"
#: Caveats that every finding of a family carries.
UNIVERSAL_CAVEATS = {
    "mirror_gap": ("cif_fob", "currency_timing", "general_vs_special_trade", "transshipment", "eurostat_stat_procedure_mix", "multi_partner_sum"),
    "mirror_gap_zscore": ("cif_fob", "currency_timing", "general_vs_special_trade", "transshipment", "eurostat_stat_procedure_mix", "multi_partner_sum", "aggregate_composition_drift"),
    "hs_group_yoy": ("cif_fob", "currency_timing", "classification_drift", "eurostat_stat_procedure_mix", "multi_partner_sum", "cn8_revision"),
    "hs_group_trajectory": ("cif_fob", "currency_timing", "classification_drift", "eurostat_stat_procedure_mix", "multi_partner_sum", "cn8_revision"),
    "narrative_hs_group": ("llm_drafted",),
    "partner_share": ("cif_fob", "currency_timing", "classification_drift", "eurostat_stat_procedure_mix", "multi_partner_sum", "cn8_revision", "extra_eu_definitional_drift"),
}
SCOPES = {"_uk": "uk", "_combined": "eu_27_plus_uk"}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_idx(date: Column | str) -> Column:
    """Months since year 0 of a date."""
    return (F.year(col(date)) * 12 + F.month(col(date)) - 1).cast("int")


def month_start(idx: Column | str) -> Column:
    """The first day of a month index."""
    i = col(idx)
    return F.make_date(F.floor(i / 12).cast("int"), (i % 12 + 1).cast("int"), F.lit(1))


def yoy(current: Column | str, prior: Column | str) -> Column:
    """(c - p) / |p|; null where p is 0 or null."""
    c, p = col(current), col(prior)
    return F.when(p != 0, (c - p) / F.abs(p))


def days_in_window(first_idx: Column | str, last_idx: Column | str) -> Column:
    return F.datediff(F.last_day(month_start(last_idx)), month_start(first_idx)) + 1


def per_day(value: Column | str, first_idx: Column | str, last_idx: Column | str) -> Column:
    return col(value) / days_in_window(first_idx, last_idx)


def kg_coverage(value_with_kg: Column | str, value: Column | str) -> Column:
    """Share of value that has a weight; 0 where there is no value."""
    return F.when(col(value) == 0, F.lit(0.0)).otherwise(col(value_with_kg) / col(value))


def unit_price(value: Column | str, kg: Column | str, coverage: Column | str, least: float = 0.80) -> Column:
    """Value per kg; null under the least coverage."""
    return F.when((col(coverage) >= least) & (col(kg) > 0), col(value) / col(kg))


def driver_label(kg_yoy: Column | str, value_yoy: Column | str) -> Column:
    """Whether volume or price drives a change."""
    k, v = col(kg_yoy), col(value_yoy)
    return F.when(k.isNull() | v.isNull() | (v == 0), F.lit(None).cast("string")).when(F.abs(k / v) > 0.5, "volume").otherwise("price")


def low_base(current: Column | str, prior: Column | str, threshold: float) -> Column:
    return F.least(col(current), col(prior)) < threshold


def fragile(current: Column | str, prior: Column | str, threshold: float, factor: float = 1.5) -> Column:
    """The smaller window is near the low-base threshold on either side."""
    least = F.least(col(current), col(prior))
    return (least > threshold / factor) & (least < threshold * factor)


def starts_with_any(code: Column | str, prefixes: list[str]) -> Column:
    """An OR of prefixes and not the total row; an empty list matches nothing."""
    if not prefixes:
        return F.lit(False)
    return reduce(or_, (col(code).startswith(p.rstrip("%")) for p in prefixes)) & (col(code) != TOTAL_CODE)


def is_detail_code(code: Column | str) -> Column:
    """A genuine 8-digit code: no total row, no masked stub."""
    return col(code).rlike("^[0-9]{8}$")


def in_envelope(partner: Column | str, partners: tuple[str, ...]) -> Column:
    return col(partner).isin(*partners)


def unit_scale(unit: Column | str) -> Column:
    """struct(multiplier, currency) of texts like `CNY 100 Million`.

    Missing: (1, null).  Not recognised: null, so that the row is skipped rather than read as 1.
    """
    u = F.upper(F.trim(col(unit)))
    shape = r"^([A-Z]{3})\s*([0-9,]*)\s*(MILLION|BILLION|THOUSAND)?$"
    number = F.regexp_replace(F.regexp_extract(u, shape, 2), ",", "")
    word = F.regexp_extract(u, shape, 3)
    factor = F.when(word == "MILLION", 1e6).when(word == "BILLION", 1e9).when(word == "THOUSAND", 1e3).otherwise(1.0)
    made = F.struct((F.when(number == "", 1.0).otherwise(number.cast("double")) * factor).alias("multiplier"), F.regexp_extract(u, shape, 1).alias("currency"))
    plain = F.struct(F.lit(1.0).alias("multiplier"), F.lit(None).cast("string").alias("currency"))
    return F.when(col(unit).isNull() | (u == ""), plain).when(u.rlike(shape), made)


def parse_number(text: Column | str) -> Column:
    """No-break spaces and commas removed; empty or `-` is null, other text too (see number_rejected)."""
    t = F.trim(F.regexp_replace(col(text), "[\u00a0,]", ""))
    return F.when(t.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), t.cast("double"))


def number_rejected(text: Column | str) -> Column:
    t = F.trim(F.regexp_replace(col(text), "[\u00a0,]", ""))
    return F.coalesce((t != "") & (t != "-") & parse_number(text).isNull(), F.lit(False))


def partner_label(text: Column | str) -> Column:
    """struct(label, indent, is_subset) of a partner cell: indent counts leading no-break spaces."""
    t = F.regexp_replace(col(text), r"^[ \t\r\n\f\x0B]+|[ \t\r\n\f\x0B]+$", "")
    indent = F.length(F.regexp_extract(t, "^(\u00a0*)", 1))
    inner = F.trim(F.regexp_replace(F.regexp_replace(t, "\u00a0", " "), r"\s+", " "))
    subset = F.lower(inner).startswith("of which:")
    return F.struct(F.when(subset, F.trim(F.substring(inner, 10, 1000))).otherwise(inner).alias("label"), indent.alias("indent"), subset.alias("is_subset"))


def short_label(text: Column | str) -> Column:
    """The text before the first `(`, then before the first `;` or `,`."""
    return F.trim(F.split(F.trim(F.split(col(text), r"\(", 2)[0]), "[;,]", 2)[0])


def slug(text: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(col(text)), r"[^a-z0-9\s_-]", ""), r"[\s_]+", "-"), F.lit("-"))


def format_scaled(value: Column | str, unit: str = "€", before: bool = True) -> Column:
    """1.2B, 3.4M, 5.6k or plain, with a unit."""
    v = col(value)
    a = F.abs(v)
    text = (
        F.when(a >= 1e9, F.format_string("%.2fB", v / 1e9)).when(a >= 1e6, F.format_string("%.1fM", v / 1e6))
        .when(a >= 1e3, F.format_string("%.1fk", v / 1e3)).otherwise(F.format_string("%.0f", v))
    )
    return F.when(v.isNotNull(), F.concat(F.lit(unit), text) if before else F.concat(text, F.lit(unit)))


def format_pct(value: Column | str) -> Column:
    return F.when(col(value).isNotNull(), F.format_string("%+.1f%%", col(value) * 100))


def decode_subkind(subkind: Column | str) -> Column:
    """struct(family, scope, flow)."""
    s = col(subkind)
    export = s.endswith("_export")
    base = F.regexp_replace(s, "_export$", "")
    scope = F.lit("eu_27")
    for suffix, name in SCOPES.items():
        scope = F.when(base.endswith(suffix), name).otherwise(scope)
    family = F.regexp_replace(base, "(" + "|".join(SCOPES) + ")$", "")
    return F.struct(family.alias("family"), scope.alias("scope"), F.when(export, 2).otherwise(1).alias("flow"))


def universal_caveats(subkind: Column | str) -> Column:
    """The caveats of the subkind's family."""
    family = decode_subkind(subkind)["family"]
    none = F.array().cast("array<string>")
    return reduce(lambda rest, kv: F.when(family == kv[0], F.array(*map(F.lit, kv[1]))).otherwise(rest), UNIVERSAL_CAVEATS.items(), none)


def nk_hash(subkind: Column | str, *keys: Column | str) -> Column:
    """32 hex digits of the natural key."""
    parts = F.concat_ws("\x1f", F.coalesce(col(subkind).cast("string"), F.lit("")), *(F.coalesce(col(k).cast("string"), F.lit("\x00")) for k in keys))
    return F.substring(F.sha2(parts, 256), 1, 32)


def value_signature(method: str, *values: Column | str) -> Column:
    """A hash of the method tag and rounded values; nulls count."""
    parts = [F.coalesce(F.round(col(v).cast("double"), 6).cast("string"), F.lit("\x00")) for v in values]
    return F.sha2(F.concat_ws("\x1f", F.lit(method), *parts), 256)
