"""Scalar functions on names, states, units and colours: all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def worm_id(text: Column) -> Column:
    """First w and digits in either case, else NoWORM."""
    return F.coalesce(_found(text, r"(?i)(w\d+)"), F.lit("NoWORM"))


def sheet_parts(text: Column) -> Column:
    """Struct of animal and part of a sheet name w1 or w1_2, nulls for other names."""
    p = r"^(w\d+)(?:_(\d+))?$"
    return F.struct(_found(text, p, 1).alias("worm"), F.when(text.rlike(p), F.coalesce(_found(text, p, 2).cast("int"), F.lit(0))).alias("part"))


def folder_month(text: Column, fallback: str = "202510") -> Column:
    """Month of w1_2025-10-22_10-21-21 as YYYYMM, else the fallback."""
    day = F.try_to_date(F.get(F.split(text, "_"), F.lit(1)), "yyyy-MM-dd")
    return F.coalesce(F.date_format(day, "yyyyMM"), F.lit(fallback))


def prefix_token(text: Column) -> Column:
    """Struct of name and prefix: a last word of one letter is the prefix."""
    p = r"^(.*\S)\s+([A-Za-z])$"
    cleaned = F.trim(text)
    return F.struct(F.coalesce(_found(cleaned, p, 1), cleaned).alias("name"), F.lower(_found(cleaned, p, 2)).alias("prefix"))


def stimulus_id(text: Column) -> Column:
    """Struct of prefix, batch and index of an id like c1_2, null for other forms."""
    p = r"^([A-Za-z])(\d+)_(\d+)$"
    return F.when(text.rlike(p), F.struct(F.lower(F.regexp_extract(text, p, 1)).alias("prefix"), F.regexp_extract(text, p, 2).cast("int").alias("batch"), F.regexp_extract(text, p, 3).cast("int").alias("index")))


def format_id(prefix: Column, batch: Column, index: Column) -> Column:
    return F.format_string("%s%d_%d", F.lower(prefix), batch, index)


def is_stimulus_channel(meaning: Column, excluded: tuple[str, ...]) -> Column:
    """No excluded word within the meaning, in either case."""
    hit = F.lit(False)
    for w in excluded:
        hit = hit | F.lower(meaning).contains(w)
    return ~hit


def bits(value: Column, n: int) -> Column:
    """The low n bits, lowest first."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda b: F.call_function("shiftright", value, b).bitwiseAND(F.lit(1)).cast("int"))


def key_number(text: Column) -> Column:
    """A decimal, else hexadecimal, key."""
    return F.coalesce(F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int")), F.when(text.rlike(r"^[0-9A-Fa-f]+$"), F.conv(text, 16, 10).try_cast("int")))


def state_text(values: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(values, lambda v: v.cast("string")), ", "), F.lit("]"))


def concentration(text: Column) -> Column:
    """Struct (prio, value): per cent 0, uM 1, mM 2, E-number 3 with its sign turned; null without any."""
    found = [(_found(text, r"([\d.]+)\s*%"), 0, 1), (_found(text, r"(?i)([\d.]+)\s*uM"), 1, 1), (_found(text, r"(?i)([\d.]+)\s*mM"), 2, 1), (_found(text, r"(?i)E(-?\d+)"), 3, -1)]
    out = F.lit(None).cast("struct<prio:int,value:double>")
    for number, prio, sign in reversed(found):
        out = F.when(number.isNotNull(), F.struct(F.lit(prio).alias("prio"), (number.cast("double") * sign).alias("value"))).otherwise(out)
    return out


def split_name(text: Column) -> Column:
    """Struct (group, variant): the variant is the shortest run of last words that holds a concentration, else the last word."""
    clean = F.trim(text)
    words = F.split(clean, r"\s+")
    n = F.size(words)

    def suffix(i: Column) -> Column:
        return F.array_join(F.slice(words, i, n - i + 1), " ")

    starts = F.filter(F.reverse(F.sequence(F.lit(1), n)), lambda i: concentration(suffix(i)).isNotNull())
    at = F.coalesce(F.get(starts, F.lit(0)), n)
    group = F.array_join(F.slice(words, 1, F.greatest(at - 1, F.lit(0))), " ")
    one = n == 1
    name = F.when(one | (group == ""), clean).otherwise(group)
    return F.struct(name.alias("group"), F.when(one, F.lit("")).otherwise(suffix(at)).alias("variant"))


def dilution_to_um(weight: Column, mg_per_ml: Column, factor: Column) -> Column:
    """Micromolar after dilution of a stock given in mg/mL."""
    return mg_per_ml / weight / factor * 1e6


def mass_ratio_to_um(weight: Column, solute_mg: Column, water_g: Column) -> Column:
    """Micromolar of so many mg in so many g of water."""
    return (solute_mg / 1000 / weight) / (water_g / 1000) * 1e6


def format_um(um: Column) -> Column:
    """With the unit that fits."""
    return F.when(um >= 1000, F.format_string("%.2f mM", um / 1000)).when(um >= 1, F.format_string("%.2f µM", um)).otherwise(F.format_string("%.2f nM", um * 1000))


def hue_colour(hue: Column, saturation: float = 0.55, value: float = 0.92) -> Column:
    """#rrggbb of a hue in [0, 1)."""
    h = (hue - F.floor(hue)) * 6
    sector, f = F.floor(h).cast("int"), h - F.floor(h)
    p, q, t = F.lit(value * (1 - saturation)), value * (1 - saturation * f), value * (1 - saturation * (1 - f))
    v = F.lit(value)

    def channel(*six: Column) -> Column:
        out = six[5]
        for k in range(4, -1, -1):
            out = F.when(sector == k, six[k]).otherwise(out)
        return F.lpad(F.lower(F.hex(F.floor(out * 255).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(v, q, p, p, t, v), channel(t, v, v, q, p, p), channel(p, p, t, v, v, q))


def name_colour(name: Column) -> Column:
    """A colour from the name's md5."""
    return F.concat(F.lit("#"), F.substring(F.md5(name), 1, 6))


def short_label(name: Column, code: Column) -> Column:
    """The part from " E" on, else the last of several words (cut to three characters and a full stop), else the code."""
    exponent = F.concat(F.lit("E"), F.get(F.split(name, " E"), F.lit(1)))
    words = F.split(F.trim(name), r"\s+")
    last = F.element_at(words, -1)
    last = F.when(F.size(words) > 1, last).otherwise(code)
    cut = F.when(F.length(last) > 3, F.concat(F.substring(last, 1, 3), F.lit("."))).otherwise(last)
    return F.when(name.contains(" E"), exponent).otherwise(cut)


def safe_file_name(text: Column) -> Column:
    """Slashes and blanks become underscores."""
    return F.regexp_replace(text, r"[/\\ ]", "_")
