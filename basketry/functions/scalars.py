"""Small Column helpers shared by every operator. All are native expressions (no UDF)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def as_col(value) -> Column:
    """Column for a column name or a Column."""
    return value if isinstance(value, Column) else F.col(value)


def clamp(value, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), as_col(value)))


def safe_div(num, den) -> Column:
    """num / den, and 0 where the denominator is 0 or null."""
    return F.when(as_col(den) != 0, as_col(num) / as_col(den)).otherwise(F.lit(0.0))


def tier(value, cuts: Sequence[tuple[float, str]], default: str, strict: bool = False) -> Column:
    """First label whose cut is reached (``>=``, or ``>`` when strict), cuts given high to low."""
    value = as_col(value)
    out = None
    for cut, label in cuts:
        reached = value > cut if strict else value >= cut
        out = F.when(reached, label) if out is None else out.when(reached, label)
    return out.otherwise(default)


def pair_key(a, b) -> Column:
    """Unordered pair as a struct with the smaller value first."""
    return F.struct(F.least(as_col(a), as_col(b)).alias("a"), F.greatest(as_col(a), as_col(b)).alias("b"))


def normal_cdf(x) -> Column:
    """Standard normal CDF by the Abramowitz-Stegun 7.1.26 erf polynomial (absolute error below 1.5e-7)."""
    x = as_col(x)
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * z)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1.0 + erf)).otherwise(0.5 * (1.0 - erf))


def two_sided_p(z) -> Column:
    return 2.0 * (1.0 - normal_cdf(F.abs(as_col(z))))


def parse_dose(raw, unit_factors: dict[str, float] | None = None) -> Column:
    """Number in a dosage string: digits and dots kept, null when that is no number.

    The unit is ignored unless ``unit_factors`` maps a unit substring to a factor.
    """
    raw = as_col(raw).cast("string")
    value = F.regexp_replace(raw, "[^0-9.]", "").try_cast("double")
    for unit, factor in (unit_factors or {}).items():
        value = F.when(raw.contains(unit), value * factor).otherwise(value)
    return value


def split_terms(raw, delimiters: str = ",") -> Column:
    """Split on any of the delimiter characters, trim, drop empty terms."""
    parts = F.split(as_col(raw), "[" + delimiters + "]")
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def conjunction(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for cond in conditions:
        out = out & cond
    return out


def map_get(mapping, key, default) -> Column:
    return F.coalesce(F.try_element_at(as_col(mapping), as_col(key)), F.lit(default))


def literal_map(values: dict) -> Column:
    """MAP literal from a small Python dict."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed exactly once per row.

    A filter or projection on a plain computed column is rewritten in terms of its expression, so a chain of
    expensive columns would be repeated many times over. Generate is a boundary that is not crossed.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def one_row(df: DataFrame) -> Column:
    """A one-row table as a struct value (scalar subquery), to put several of them side by side without a join."""
    return df.select(F.struct("*").alias("row")).scalar()
