"""Values, units and scores as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from seamlode.functions.arrow import arrow

# Unit in lower case without blanks -> (canonical unit, factor, shift).
UNITS = {
    "°c": ("K", 1.0, 273.15), "с": ("K", 1.0, 273.15), "c": ("K", 1.0, 273.15), "к": ("K", 1.0, 0.0), "k": ("K", 1.0, 0.0),
    "мпа": ("MPa", 1.0, 0.0), "mpa": ("MPa", 1.0, 0.0), "гпа": ("MPa", 1000.0, 0.0), "gpa": ("MPa", 1000.0, 0.0), "па": ("Pa", 1.0, 0.0), "pa": ("Pa", 1.0, 0.0),
    "%": ("%", 1.0, 0.0), "проц": ("%", 1.0, 0.0), "г/л": ("g/l", 1.0, 0.0), "g/l": ("g/l", 1.0, 0.0),
    "мг/л": ("mg/l", 1.0, 0.0), "mg/l": ("mg/l", 1.0, 0.0), "мг/дм3": ("mg/l", 1.0, 0.0), "мг/дм³": ("mg/l", 1.0, 0.0),
    "м3/ч": ("m3/h", 1.0, 0.0), "м³/ч": ("m3/h", 1.0, 0.0), "m3/h": ("m3/h", 1.0, 0.0), "м/ч": ("m/h", 1.0, 0.0), "m/h": ("m/h", 1.0, 0.0),
    "квт·ч/т": ("kWh/t", 1.0, 0.0), "квтч/т": ("kWh/t", 1.0, 0.0), "kwh/t": ("kWh/t", 1.0, 0.0),
    "в": ("V", 1.0, 0.0), "v": ("V", 1.0, 0.0), "мв": ("V", 0.001, 0.0), "а/м2": ("A/m2", 1.0, 0.0), "а/м²": ("A/m2", 1.0, 0.0), "a/m2": ("A/m2", 1.0, 0.0),
    "мин": ("s", 60.0, 0.0), "min": ("s", 60.0, 0.0), "ч": ("h", 1.0, 0.0), "h": ("h", 1.0, 0.0),
    "мкм": ("um", 1.0, 0.0), "um": ("um", 1.0, 0.0), "µм": ("um", 1.0, 0.0), "г/т": ("g/t", 1.0, 0.0), "g/t": ("g/t", 1.0, 0.0),
}
HARDNESS = ["HV", "HV30", "HRC", "HRB", "HB", "HK"]
# Unit -> what it measures.
DIMENSIONS = {
    "MPa": "pressure", "GPa": "pressure", "Pa": "pressure", "kPa": "pressure", "°C": "temperature", "K": "temperature", "%": "ratio", "min": "time", "h": "time", "s": "time",
    "μm": "length", "um": "length", "nm": "length", "mm": "length", "V": "voltage", "mV": "voltage", "A/cm2": "current_density",
}
# Quantity -> (its unit, factor of each unit as written).
MEASURED = {
    "temperature": ("K", {"k": 1.0, "": 1.0}),
    "concentration": ("g/l", {"g/l": 1.0, "g/л": 1.0, "г/л": 1.0, "g/dm3": 1.0, "g/dm³": 1.0, "г/дм³": 1.0, "mg/l": 0.001, "мг/л": 0.001, "mg/dm3": 0.001, "мг/дм³": 0.001, "": 1.0}),
    "recovery_degree": ("%", {"%": 1.0, "": 1.0}),
    "element_content": ("%", {"%": 1.0, "% масс.": 1.0, "": 1.0}),
    "current_density": ("A/m2", {"a/m2": 1.0, "a/m²": 1.0, "а/м²": 1.0, "": 1.0}),
    "particle_size": ("µm", {"um": 1.0, "µm": 1.0, "мкм": 1.0, "": 1.0}),
    "ph": ("", {"": 1.0}),
}
# The pattern of a number, the signs of a range, and words for "at least".
_NUMBER = r"([-+]?\d+(?:[.,]\d+)?)"
_SPREAD, _SPAN = rf"{_NUMBER}\s*±\s*{_NUMBER}", rf"{_NUMBER}\s*[–\-−…]\s*{_NUMBER}"
_MOST, _LEAST = rf"[≤<]\s*=?\s*{_NUMBER}", rf"(?:[≥>]\s*=?|более|не менее|свыше)\s*{_NUMBER}"


def lookup(table: dict, key: Column) -> Column:
    """Value of a literal table, or null."""
    return F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v)))[key]


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.replace(F.nullif(F.regexp_extract(text, pattern, group), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def parse_value(text: Column) -> Column:
    """struct(low, nominal, high, deviation) of the first a±b, else range, else bound, else number anywhere in the text; null fields where it says nothing."""
    none = F.lit(None).cast("double")

    def made(low: Column, nominal: Column, high: Column, deviation: Column) -> Column:
        return F.struct(low.alias("low"), nominal.alias("nominal"), high.alias("high"), deviation.alias("deviation"))

    a, b = _number(text, _SPAN, 1), _number(text, _SPAN, 2)
    return (
        F.when(text.rlike(_SPREAD), made(none, _number(text, _SPREAD, 1), none, _number(text, _SPREAD, 2)))
        .when(text.rlike(_SPAN), made(F.least(a, b), none, F.greatest(a, b), none))
        .when(text.rlike(_MOST), made(none, none, _number(text, _MOST, 1), none))
        .when(text.rlike(_LEAST), made(_number(text, _LEAST, 1), none, none, none))
        .otherwise(made(none, _number(text, _NUMBER, 1), none, none))
    )


def unit_key(unit: Column) -> Column:
    """Lower case without blanks; the words for no unit are empty."""
    key = F.replace(F.lower(F.trim(F.coalesce(unit, F.lit("")))), F.lit(" "), F.lit(""))
    return F.when(key.isin("null", "none", "-", "—", "n/a"), "").otherwise(key)


def scale(unit: Column) -> Column:
    """The hardness scale that the unit names, else none."""
    return F.coalesce(lookup({h.lower(): h for h in HARDNESS}, unit_key(unit)), F.lit("none"))


def canonical(value: Column, unit: Column) -> Column:
    """struct(value, unit, scale) in the canonical unit; hardness is never converted, a unit that isn't known stays, as does its value."""
    key = unit_key(unit)
    known = key.isin(*UNITS) & value.isNotNull()
    factor, shift = (lookup({k: v[i] for k, v in UNITS.items()}, key) for i in (1, 2))
    plain = F.when(key == "", "").otherwise(F.trim(unit))
    return F.struct(
        F.when(known, value * factor + shift).otherwise(value).alias("value"),
        F.when(known, lookup({k: v[0] for k, v in UNITS.items()}, key)).otherwise(plain).alias("unit"), scale(unit).alias("scale"),
    )


def canonical_range(v: Column, unit: Column) -> Column:
    """struct(low, nominal, high, unit, scale) of a parsed value in the canonical unit."""
    parts = [canonical(v[c], unit) for c in ("low", "nominal", "high")]
    names = F.coalesce(*(F.when(v[c].isNotNull(), p["unit"]) for c, p in zip(("low", "nominal", "high"), parts)), parts[0]["unit"])
    return F.struct(*(p["value"].alias(c) for c, p in zip(("low", "nominal", "high"), parts)), names.alias("unit"), scale(unit).alias("scale"))


def point(v: Column) -> Column:
    """The nominal value, else the middle of the range, else the bound."""
    return F.coalesce(v["nominal"], (v["low"] + v["high"]) / 2, v["low"], v["high"])


def bounded(v: Column, op: str, bound: float) -> Column:
    """Whether the nominal value, else the upper, else the lower bound is <= or >= a bound; any other operator asks nothing."""
    value = F.coalesce(v["nominal"], v["high"], v["low"])
    return value <= bound if op == "<=" else value >= bound if op == ">=" else F.lit(True)


@arrow("string")
def general(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A number with six digits at most and no needless zeros."""
    for v in values:
        yield v.map(lambda x: None if pd.isna(x) else f"{x:g}")


def shown(v: Column) -> Column:
    """A parsed value as text: number, range, bound or a question mark."""
    low, nominal, high = (general(v[c]) for c in ("low", "nominal", "high"))
    return F.coalesce(nominal, F.concat(low, F.lit("–"), high), F.concat(F.lit(">"), low), F.concat(F.lit("<"), high), F.lit("?"))


def dimension(unit: Column) -> Column:
    """What a unit measures, or the unit itself in lower case."""
    u = F.trim(F.coalesce(unit, F.lit("")))
    return F.coalesce(lookup(DIMENSIONS, u), F.lower(u))


def temperature_class(kelvin: Column) -> Column:
    """room below 50 °C or unknown, else the hundreds of °C."""
    hundreds = (F.floor((kelvin - 273.15) / 100) * 100).cast("string")
    return F.when(kelvin.isNull() | (kelvin < 323.15), "room").otherwise(F.concat(F.lit(">"), hundreds, F.lit("C")))


def regime_class(kelvin: Column) -> Column:
    """low, medium or high by 673.15 and 1073.15 K; null for unknown."""
    return F.when(kelvin < 673.15, "low").when(kelvin < 1073.15, "medium").when(kelvin.isNotNull(), "high")


def flat_regime_class(temperature: Column) -> Column:
    """low under 400, medium up to 800, high above; null for unknown."""
    return F.when(temperature < 400, "low").when(temperature <= 800, "medium").when(temperature.isNotNull(), "high")


def highest_temperature(steps: Column) -> Column:
    """Largest of the bounds and nominal temperatures of regime steps; zeros count as absent."""
    of = lambda s: F.array(s["temperature"]["min"], s["temperature"]["nominal"], s["temperature"]["max"])
    return F.array_max(F.filter(F.flatten(F.transform(steps, of)), lambda x: x.isNotNull() & (x != 0)))


def state_name(steps: Column) -> Column:
    """Process types of the steps in order, joined by +; a step without one is a question mark."""
    return F.array_join(F.transform(steps, lambda s: F.coalesce(s["process_type"], F.lit("?"))), "+")


def kelvin(celsius: Column) -> Column:
    return celsius + 273.15


def measured(value: Column, unit: Column, quantity: str) -> Column:
    """A value in the unit of its quantity; null for a unit that can't be converted; other quantities stay."""
    if quantity not in MEASURED:
        return value
    return value * lookup(MEASURED[quantity][1], F.lower(F.trim(F.coalesce(unit, F.lit("")))))


def tolerant(value: Column, want: Column, tolerance: Column | float | None = None) -> Column:
    """Whether the value is within the tolerance of the wanted one; without one within 0.5 or 2 %, whichever is more."""
    own = F.greatest(F.lit(0.5), F.abs(want) * 0.02)
    allowed = own if tolerance is None else F.when(F.lit(tolerance) > 0, F.lit(tolerance)).otherwise(own)
    return F.abs(value - want) <= allowed


def any_tolerant(numbers: Column, want: Column, tolerance: Column | float | None = None) -> Column:
    return F.exists(numbers, lambda n: tolerant(n, want, tolerance))


def any_in_range(numbers: Column, a: Column, b: Column, tolerance: Column | float | None = None) -> Column:
    """Whether a number lies in the range and 2 % of its span about it, or both ends are named."""
    low, high = F.least(a, b), F.greatest(a, b)
    slack = (high - low) * 0.02
    inside = F.exists(numbers, lambda n: (n >= low - slack) & (n <= high + slack))
    return inside | (any_tolerant(numbers, low, tolerance) & any_tolerant(numbers, high))


def in_any_form(text: Column, word: str) -> Column:
    """Whether the text has the word, or it without its last 2 (of over 5) or 3 (of over 7) letters."""
    word = word.strip().lower()
    if not word:
        return F.lit(False)
    forms = [word, *([word[:-2]] if len(word) > 5 else []), *([word[:-3]] if len(word) > 7 else [])]
    return F.greatest(F.lit(False), *(F.contains(F.lower(text), F.lit(f)) for f in forms))


def latency_score(seconds: Column, target: float) -> Column:
    """1 up to the target, 0.5 up to twice that, then falling to 0."""
    return F.when(seconds <= target, 1.0).when(seconds <= 2 * target, 0.5).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - (seconds - target) / (3 * target)))


def unit_length(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(F.transform(v, lambda x: x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 if one has no length."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def similarity(distance: Column) -> Column:
    """Score of a cosine distance."""
    return 1.0 - distance


def vector_text(v: Column) -> Column:
    """A vector as [x,y,...] with six decimals."""
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: F.format_string("%.6f", x.cast("double"))), ","), F.lit("]"))


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def progress(done: Column, local: Column, total: Column) -> Column:
    """Progress of a run of parts, at most 1."""
    return F.least(F.lit(1.0), F.coalesce(F.try_divide(done + local, total), F.lit(0.0)))
