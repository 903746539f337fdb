"""Units and exchange rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Units by category with their factor to the base unit.
UNITS = {
    "distance": {"m": 1.0, "km": 1000.0, "cm": 0.01, "mm": 0.001, "ft": 0.3048, "in": 0.0254, "yd": 0.9144, "mi": 1609.344, "nmi": 1852.0},
    "time": {"s": 1.0, "ms": 0.001, "min": 60.0, "h": 3600.0, "d": 86400.0, "w": 604800.0, "y": 31557600.0},
    "mass": {"g": 1.0, "kg": 1000.0, "mg": 0.001, "lb": 453.592, "oz": 28.3495, "t": 1000000.0},
    "volume": {"l": 1.0, "ml": 0.001, "gal": 3.78541, "qt": 0.946353, "pt": 0.473176, "cup": 0.236588, "fl_oz": 0.0295735},
    "area": {"m2": 1.0, "km2": 1000000.0, "cm2": 0.0001, "ft2": 0.092903, "in2": 0.00064516, "acre": 4046.86, "ha": 10000.0},
    "temperature": {"C": 1.0, "F": 1.0, "K": 1.0},
}
#: Other names of units.
ALIASES = {
    "degree_celsius": "C", "degree_fahrenheit": "F", "kelvin": "K", "degrees_c": "C", "degrees_f": "F", "meter": "m", "metre": "m",
    "kilometer": "km", "kilometre": "km", "centimeter": "cm", "centimetre": "cm", "millimeter": "mm", "millimetre": "mm", "foot": "ft",
    "feet": "ft", "inch": "in", "inches": "in", "yard": "yd", "yards": "yd", "mile": "mi", "miles": "mi", "second": "s", "seconds": "s",
    "minute": "min", "minutes": "min", "hour": "h", "hours": "h", "day": "d", "days": "d", "gram": "g", "grams": "g", "kilogram": "kg",
    "kilograms": "kg", "pound": "lb", "pounds": "lb", "ounce": "oz", "ounces": "oz",
}


class Catalog:
    """Units by name; custom units are added to a copy of the built-in ones."""

    def __init__(self):
        self.units = {u: (c, f) for c, us in UNITS.items() for u, f in us.items()}
        self.aliases = dict(ALIASES)

    def add(self, unit: str, category: str, factor: float, *aliases: str) -> None:
        self.units[unit] = (category, factor)
        self.aliases.update({a.lower(): unit for a in aliases})

    def resolve(self, name: str) -> str:
        """The exact name, then the upper-case one, then an alias."""
        found = next((n for n in (name, name.upper(), self.aliases.get(name.lower()), name.lower()) if n in self.units), None)
        if found is None:
            raise ValueError(f"unknown unit {name}")
        return found

    def names(self, category: str | None = None) -> list[str]:
        return [u for u, (c, _) in self.units.items() if category in (None, c)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """unit, name, category, factor: a small dimension with a row per spelling."""
        rows = [(u, u, c, f) for u, (c, f) in self.units.items()]
        rows += [(u, a, *self.units[u]) for a, u in self.aliases.items()]
        return spark.createDataFrame(rows, "unit string, name string, category string, factor double")


def temperature(value: Column, source: str, target: str) -> Column:
    """Between C, F and K, by way of C."""
    celsius = {"C": value, "F": (value - 32) * 5 / 9, "K": value - 273.15}[source]
    return {"C": celsius, "F": celsius * 9 / 5 + 32, "K": celsius + 273.15}[target]


def convert(value: Column, source: str, target: str, catalog: Catalog | None = None) -> Column:
    """value in another unit of the same category; other categories are an error."""
    units = catalog or Catalog()
    a, b = units.resolve(source), units.resolve(target)
    if a == b:
        return value
    (ca, fa), (cb, fb) = units.units[a], units.units[b]
    if ca != cb:
        raise ValueError(f"{source} is {ca}, {target} is {cb}")
    return temperature(value, a, b) if ca == "temperature" else value * fa / fb


def convert_rows(df: DataFrame, value: str, source: str, target: str, catalog: Catalog | None = None) -> DataFrame:
    """df with converted and error, for units that differ by row: two joins with the catalog.

    The catalog has one row per spelling of a built-in or custom unit, which bounds its size.
    """
    units = (catalog or Catalog()).frame(df.sparkSession)
    side = lambda p: F.broadcast(units.select(F.col("name").alias(f"__{p}n"), F.col("unit").alias(f"__{p}u"), F.col("category").alias(f"__{p}c"), F.col("factor").alias(f"__{p}f")))
    joined = df.join(side("a"), F.col(f"`{source}`") == F.col("__an"), "left").join(side("b"), F.col(f"`{target}`") == F.col("__bn"), "left")
    v = F.col(f"`{value}`").cast("double")
    heat = F.lit(None).cast("double")
    for a in "CFK":
        for b in "CFK":
            heat = F.when((F.col("__au") == a) & (F.col("__bu") == b), temperature(v, a, b)).otherwise(heat)
    same = F.col("__ac") == F.col("__bc")
    made = F.when(F.col("__au") == F.col("__bu"), v).when(same & (F.col("__ac") == "temperature"), heat).when(same, v * F.col("__af") / F.col("__bf"))
    error = F.when(F.col("__au").isNull() | F.col("__bu").isNull(), "unknown unit").when(~same, "different categories")
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), made.alias("converted"), error.alias("error"))


# --- exchange rates ---------------------------------------------------------

#: Rates to fall back on where a table has none.
FALLBACK_RATES = {
    ("USD", "EUR"): 0.85, ("USD", "GBP"): 0.75, ("USD", "JPY"): 110.0, ("USD", "CAD"): 1.25, ("USD", "AUD"): 1.35, ("USD", "CHF"): 0.92,
    ("USD", "CNY"): 6.45, ("USD", "SEK"): 8.5, ("USD", "NOK"): 8.8, ("EUR", "GBP"): 0.88, ("EUR", "JPY"): 129.0,
}


def fallback_rate(source: str, target: str) -> float:
    if source == target:
        return 1.0
    if (source, target) in FALLBACK_RATES:
        return FALLBACK_RATES[source, target]
    if (target, source) in FALLBACK_RATES:
        return 1 / FALLBACK_RATES[target, source]
    raise ValueError(f"no rate from {source} to {target}")


def with_inverses(rates: DataFrame) -> DataFrame:
    """from_ccy, to_ccy, rate, ts with a row for the other direction of each; given rows win."""
    turned = rates.select(F.col("to_ccy").alias("from_ccy"), F.col("from_ccy").alias("to_ccy"), (1 / F.col("rate")).alias("rate"), "ts")
    given = rates.select("from_ccy", "to_ccy", "ts").distinct()
    return rates.select("from_ccy", "to_ccy", "rate", "ts").unionByName(turned.join(given, ["from_ccy", "to_ccy", "ts"], "left_anti"))


def fx_as_of(df: DataFrame, ts: str, amount: str, source: str, target: str, rates: DataFrame, max_age_days: float | None = None) -> DataFrame:
    """df with rate, rate_ts, stale and converted: the latest rate at or before each row's time.

    Rates become intervals [ts, next ts) cut at days, so the join is an equi-join on
    currencies and day and not a range join over a pair's whole history.
    """
    pair = Window.partitionBy("from_ccy", "to_ccy").orderBy("ts")
    spans = rates.select("from_ccy", "to_ccy", "rate", "ts", F.lead("ts").over(pair).alias("till"))
    last = df.agg(F.max(ts).alias("last"))
    spans = spans.join(F.broadcast(last)).withColumn("end", F.least(F.coalesce("till", "last"), F.greatest("last", "ts")))
    spans = spans.select("from_ccy", "to_ccy", "rate", "ts", "till", F.explode(F.sequence(F.to_date("ts"), F.to_date("end"))).alias("day"))
    t = F.col(f"`{ts}`")
    spans = spans.toDF("__f", "__t", "rate", "rate_ts", "__till", "__day")
    hit = (F.col(f"`{source}`") == F.col("__f")) & (F.col(f"`{target}`") == F.col("__t")) & (F.to_date(t) == F.col("__day")) & (t >= F.col("rate_ts")) & (F.col("__till").isNull() | (t < F.col("__till")))
    joined = df.join(spans, hit, "left")
    same = F.col(f"`{source}`") == F.col(f"`{target}`")
    rate = F.when(same, 1.0).otherwise(F.col("rate"))
    age = (F.unix_micros(t.cast("timestamp")) - F.unix_micros(F.col("rate_ts").cast("timestamp"))) / 86400e6
    stale = F.coalesce(age > max_age_days, F.lit(False)) if max_age_days is not None else F.lit(False)
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), rate.alias("rate"), "rate_ts", stale.alias("stale"), (F.col(f"`{amount}`") * rate).alias("converted"))


#: Where a rate may come from: the table only, the table and then the fallback, or the fallback where a rate is stale.
MODES = ("strict", "table_first", "fresh")


def fx_convert(df: DataFrame, ts: str, amount: str, source: str, target: str, rates: DataFrame, mode: str = "table_first", max_age_days: float = 1.0) -> DataFrame:
    """fx_as_of() with rate_source ('table', 'fallback' or null) and confidence, filled by the mode.

    A fresh rate of the table counts 0.95, a stale one 0.7, a fallback 0.5.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {MODES}")
    found = fx_as_of(df, ts, amount, source, target, with_inverses(rates), max_age_days)
    pairs = {f"{a}_{b}": r for (a, b), r in FALLBACK_RATES.items()} | {f"{b}_{a}": 1 / r for (a, b), r in FALLBACK_RATES.items()}
    spare = F.try_element_at(F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv)), F.concat_ws("_", F.col(f"`{source}`"), F.col(f"`{target}`")))
    lacking = F.col("rate").isNull() if mode != "fresh" else F.col("rate").isNull() | F.col("stale")
    use = lacking & spare.isNotNull() if mode != "strict" else F.lit(False)
    rate = F.when(use, spare).otherwise(F.col("rate"))
    origin = F.when(use, "fallback").when(F.col("rate").isNotNull(), "table")
    sure = F.when(use, 0.5).when(F.col("rate").isNull(), 0.0).when(F.col("stale"), 0.7).otherwise(0.95)
    return found.select(*(F.col(f"`{c}`") for c in df.columns), rate.alias("rate"), origin.alias("rate_source"), sure.alias("confidence"), "stale", (F.col(f"`{amount}`") * rate).alias("converted"))
