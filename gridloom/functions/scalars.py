"""Scalar expressions: hashes, display of numbers, templates, weights, draws, and number tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def hash_mod(hex32: Column, modulus: int = 100_000_000) -> Column:
    """A 128-bit hex digest modulo a number below 2**31, folded over its four 32-bit parts."""
    parts = [F.conv(F.substring(hex32, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    total = F.lit(0).cast("long")
    for part in parts:
        total = F.pmod(total * F.lit(4294967296 % modulus) + part % modulus, F.lit(modulus))
    return total


def display_double(x: Column) -> Column:
    """A float for names: exponents stay as they are, more than two decimals are cut to two (half to even), .0 goes."""
    plain = F.regexp_replace(F.regexp_replace(x.cast("string"), r"E(-?)(\d)$", r"e$10$2"), r"^(-?\d+)\.0e", "$1e")
    two = F.format_string("%.2f", F.bround(x, 2))
    decimals = F.length(F.element_at(F.split(x.cast("string"), r"\."), 2))
    short = F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.when(x.cast("string").contains("E"), F.lower(plain)).when(decimals > 2, two).otherwise(short)


def fill(template: str, columns: dict[str, Column]) -> Column:
    """A brace template with columns for its names; unknown names raise KeyError."""
    parts: list[Column] = []
    at = 0
    for found in re.finditer(r"\{([^{}]*)\}", template):
        parts += [F.lit(template[at : found.start()]), columns[found[1]].cast("string")]
        at = found.end()
    return F.concat(*parts, F.lit(template[at:]))


def join_present(*parts: Column, sep: str = "_") -> Column:
    """Parts joined where they are neither null nor the text None."""
    return F.concat_ws(sep, *[F.nullif(p.cast("string"), F.lit("None")) for p in parts])


def tags(*parts: Column) -> Column:
    return F.concat_ws("-", F.array_sort(F.array(*[p.cast("string") for p in parts])))


def guess_type(text: Column) -> Column:
    """'int', 'float' or 'str', tried in that order."""
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), "int").when(text.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), "float").otherwise("str")


def last_part(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def measure_spec(text: Column) -> tuple[Column, Column]:
    """name and map of options of ``name@k=v&k2=v2``."""
    parts = F.split(text, "@", 2)
    return F.element_at(parts, 1), F.when(F.size(parts) > 1, F.str_to_map(F.element_at(parts, 2), F.lit("&"), F.lit("="))).otherwise(F.expr("map()").cast("map<string,string>"))


def colour(level: Column, low: float, high: float) -> Column:
    """Blue to red over [low, high], as #rrggbb."""
    x = F.least(F.greatest((level - low) / F.lit(float(high - low)), F.lit(0.0)), F.lit(1.0))
    channel = lambda c: F.lpad(F.hex(F.floor(c * 255).cast("long")), 2, "0")
    return F.lower(F.concat(F.lit("#"), channel(x), F.lit("00"), channel(1 - x)))


#: Weight changes by name.
WEIGHTS = {
    "ceil10": lambda w: F.ceil(w * 10),
    "shift": lambda w, by=1: w + by,
    "linear": lambda w, by=1, times=1: w * times + by,
    "exp2": lambda w: F.least(F.pow(F.lit(2.0), w), F.lit(300.0)),
}


def uniform(*key: Column, seed: int = 0) -> Column:
    """A draw in (0, 1) that depends on the key alone (an md5), the same on any engine and however the data are split."""
    text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key])
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long").cast("double") + 0.5) / float(1 << 52)


def draw_bernoulli(p: Column, u: Column) -> Column:
    return (u < p).cast("int")


def draw_categorical(probabilities: Column, u: Column) -> Column:
    """Position of the first cumulative probability above u."""
    cumulative = F.transform(F.sequence(F.lit(1), F.size(probabilities)), lambda i: F.aggregate(F.slice(probabilities, F.lit(1), i), F.lit(0.0), lambda a, x: a + x))
    return F.least(F.size(F.filter(cumulative, lambda c: c <= u)), F.size(probabilities) - 1)


def draw_powerlaw(alpha: Column, low: Column, u: Column) -> Column:
    return F.floor((low - 0.5) * F.pow(1 - u, -1 / (alpha - 1)) + 0.5)


def sticks(cuts: Column) -> Column:
    """Stick lengths of the nonstandard rule: each cut times the product of the cuts before it."""
    return F.transform(cuts, lambda c, i: F.aggregate(F.slice(cuts, F.lit(1), i), c, lambda a, x: a * x))


def softmax(x: Column, *partition: Column) -> Column:
    from pyspark.sql import Window

    w = Window.partitionBy(*partition)
    top = F.max(x).over(w)
    return F.exp(x - top) / F.sum(F.exp(x - top)).over(w)


def log_softmax(x: Column, *partition: Column) -> Column:
    """The same by way of the logarithm of the sum: exp(x - log sum exp x)."""
    from pyspark.sql import Window

    w = Window.partitionBy(*partition)
    top = F.max(x).over(w)
    return F.exp(x - (top + F.log(F.sum(F.exp(x - top)).over(w))))


def log_stirling(spark: SparkSession, n: int) -> DataFrame:
    """(n, m, value): logs of unsigned Stirling numbers of the first kind, for 1 <= m <= n, by the recurrence s(n+1, m) = s(n, m-1) + n s(n, m).

    One row per n is folded into the next; the table is a constant of its size, not of data.
    """
    start = F.array(F.lit(0.0))
    fold = F.expr(
        f"""aggregate(sequence(1, {int(n) - 1}), array(cast(array(0.0D) as array<double>)), (rows, k) ->
          concat(rows, array(transform(sequence(1, k + 1), m ->
            case when m = 1 then ln(cast(k as double)) + element_at(element_at(rows, k), 1)
                 when m = k + 1 then element_at(element_at(rows, k), k)
                 else greatest(element_at(element_at(rows, k), m - 1), ln(cast(k as double)) + element_at(element_at(rows, k), m))
                   + ln(1 + exp(-abs(element_at(element_at(rows, k), m - 1) - ln(cast(k as double)) - element_at(element_at(rows, k), m)))) end))))"""
    )
    rows = spark.range(1).select((F.array(start) if n < 2 else fold).alias("rows"))
    return rows.select(F.posexplode("rows").alias("i", "row")).select((F.col("i") + 1).alias("n"), F.posexplode("row").alias("j", "value")).select("n", (F.col("j") + 1).alias("m"), "value")
