"""Stimulus registry: identifiers, state maps and whole configurations.

The registry is a few dozen names kept by hand, so it is plain Python on the driver, with a DataFrame form of the
state map for joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .names import state_text

#: Words that mark control and buffer channels, the prefixes of valve states, and the defaults: fixed values.
CONTROL_WORDS = ("control",)
BUFFER_WORDS = ("buffer",)
BUFFER_PREFIXES = ((1, 1, 1), (1, 0, 1), (0, 1, 1))
STIMULUS_PREFIXES = ((0, 1, 1),)
STATE_LENGTH = 8
SLICES = 20

_ID = re.compile(r"([A-Za-z])(\d+)_(\d+)")
_UNITS = ((re.compile(r"([\d.]+)\s*%"), 0, 1), (re.compile(r"([\d.]+)\s*uM", re.I), 1, 1), (re.compile(r"([\d.]+)\s*mM", re.I), 2, 1), (re.compile(r"E(-?\d+)", re.I), 3, -1))


class ConfigError(ValueError):
    """A channel, key or prefix that can't be used."""


def parse_id(identifier: str) -> tuple[str, int, int]:
    m = _ID.fullmatch(identifier)
    if not m:
        raise ConfigError(f"not an identifier: {identifier!r}")
    return m[1].lower(), int(m[2]), int(m[3])


def concentration(text: str) -> tuple[int, float] | None:
    """N08."""
    for pattern, rank, sign in _UNITS:
        if m := pattern.search(text):
            return rank, sign * float(m[1])
    return None


def split_name(name: str) -> tuple[str, str]:
    """N09."""
    words = name.split()
    if len(words) < 2:
        return name.strip(), ""
    at = next((i for i in reversed(range(len(words))) if concentration(" ".join(words[i:]))), len(words) - 1)
    return " ".join(words[:at]) or name.strip(), " ".join(words[at:])


def _code_rank(code: str) -> tuple:
    for kind, base in ((0, 10), (1, 16)):
        try:
            return kind, int(code, base), ""
        except ValueError:
            pass
    number = re.search(r"\d+", code)
    return (2, int(number[0]), "") if number else (3, 0, code)


def sorted_names(names: Mapping[str, str]) -> list[tuple[str, list[str]]]:
    """(group, codes) with codes by concentration, then by code."""
    groups: dict[str, list[str]] = {}
    for code, name in names.items():
        groups.setdefault(split_name(name)[0] or name, []).append(code)

    def rank(code: str) -> tuple:
        c = concentration(names[code])
        return (0, *c, ()) if c else (1, 0, 0.0, (*_code_rank(code), split_name(names[code])[1]))

    return [(g, sorted(groups[g], key=rank)) for g in sorted(groups)]


def assign_ids(stimuli: Mapping[str, str], registry: Mapping[str, str], prefixes: Mapping[str, str] | None = None, default: str = "c") -> tuple[dict[str, str], dict[str, str]]:
    """(channel to id, the registry with the new names, ordered).

    A known name keeps its id. A new one takes the prefix asked for, else the group's first prefix in order, else the
    default; within its group and prefix the lowest free index, or a new batch, one above the prefix's largest.
    """
    known = {name: i for i, name in registry.items()}
    out, ids, top = {}, dict(registry), {}
    batches: dict[str, dict[str, int]] = {}
    used: dict[tuple[str, str], set[int]] = {}
    for identifier, name in registry.items():
        prefix, batch, index = parse_id(identifier)
        group = split_name(name)[0] or name
        top[prefix] = max(top.get(prefix, 0), batch)
        mine = batches.setdefault(group, {})
        mine[prefix] = min(batch, mine.get(prefix, batch))
        used.setdefault((group, prefix), set()).add(index)
    for group, codes in sorted_names(stimuli):
        for code in codes:
            name = stimuli[code]
            if name not in known:
                mine = batches.setdefault(group, {})
                prefix = ((prefixes or {}).get(code) or (min(mine) if mine else default)).lower()
                if len(prefix) != 1 or not prefix.isalpha():
                    raise ConfigError(f"not a prefix: {prefix!r}")
                if prefix not in mine:
                    mine[prefix] = top[prefix] = top.get(prefix, 0) + 1
                taken = used.setdefault((group, prefix), set())
                index = next(i for i in range(len(taken) + 1) if i not in taken)
                taken.add(index)
                known[name] = f"{prefix}{mine[prefix]}_{index}"
                ids[known[name]] = name
            out[code] = known[name]
    return out, dict(sorted(ids.items(), key=lambda x: parse_id(x[0])))


def is_stimulus(meaning: str) -> bool:
    """N06."""
    return not any(w in meaning.lower() for w in CONTROL_WORDS + BUFFER_WORDS)


def key_number(key: str) -> int:
    """Decimal, else hexadecimal."""
    for base in (10, 16):
        try:
            return int(key, base)
        except ValueError:
            pass
    raise ConfigError(f"neither decimal nor hexadecimal: {key!r}")


def valve_patterns(channels: Mapping[str, str], five_bit: bool) -> dict[tuple[int, ...], str]:
    """Valve bits of each stimulus channel: one valve open (five_bit), or the key's four bits, lowest first."""
    keys = [k for k, m in channels.items() if is_stimulus(m)]
    if not five_bit:
        numbers = {k: key_number(k) for k in keys}
        if any(not 0 <= n < 16 for n in numbers.values()):
            raise ConfigError("keys must lie between 0 and 15")
        return {tuple(n >> b & 1 for b in range(4)): k for k, n in sorted(numbers.items(), key=lambda x: x[1])}
    try:
        numbers = {k: int(k) for k in keys}
    except ValueError as e:
        raise ConfigError("channels must be whole numbers") from e
    if not numbers:
        raise ConfigError("no stimulus channel")
    low, high = min(numbers.values()), max(numbers.values())
    return {tuple(int(n - low == b) for b in range(high - low + 1)): k for k, n in numbers.items()}


def state_map(channels: Mapping[str, str], ids: Mapping[str, str], five_bit: bool = True, length: int = STATE_LENGTH, buffer_prefixes: Iterable[tuple] = BUFFER_PREFIXES, stimulus_prefixes: Iterable[tuple] = STIMULUS_PREFIXES) -> dict[str, str]:
    """State text to id, Buffer or All Off. A prefix of both kinds counts as a stimulus prefix."""
    valves = valve_patterns(channels, five_bit)
    width = len(next(iter(valves))) if valves else 4
    if 3 + width > length:
        raise ConfigError("states are too short for the valves")
    out = {str([0] * length): "All Off"}
    for prefixes, names in ((buffer_prefixes, {}), (stimulus_prefixes, valves)):
        for prefix in prefixes:
            for n in range(1 << width):
                pattern = tuple(n >> b & 1 for b in reversed(range(width)))
                state = [*prefix, *pattern, *[0] * (length - 3 - width)]
                out[str(state)] = ids[names[pattern]] if pattern in names else "Buffer"
    return out


def generate_config(channels: Mapping[str, str], registry: Mapping[str, str], five_bit: bool = True, default: str = "c") -> dict:
    """Channel meanings to ids, state map and the registry. Names may end in a prefix letter of their own."""
    names, prefixes = {}, {}
    for key, meaning in channels.items():
        m = re.fullmatch(r"(.*\S)\s+([A-Za-z])", meaning.strip())
        names[str(key)] = m[1] if m else meaning.strip()
        if m:
            prefixes[str(key)] = m[2]
    stimuli = {k: v for k, v in names.items() if is_stimulus(v)}
    ids, known = assign_ids(stimuli, registry, prefixes, default)
    return {"channel_meanings": names, "state_mapping": state_map(names, ids, five_bit), "slice_number": SLICES, "stimuli": ids, "registry": known}


def state_map_frame(spark: SparkSession, width: int, names: DataFrame) -> DataFrame:
    """M02 as a query: (state, name) over all bit patterns and prefixes, the later rule first. names: pattern (text of bits), name."""
    n = 1 << width
    patterns = spark.range(n).selectExpr(f"transform(sequence({width - 1}, 0, -1), b -> int(shiftright(id, b) & 1)) AS p")
    rows = None
    for rank, prefixes in ((1, BUFFER_PREFIXES), (2, STIMULUS_PREFIXES)):
        for prefix in prefixes:
            one = patterns.select(F.lit(rank).alias("rank"), "p", F.concat(F.array(*map(F.lit, prefix)), "p", F.array_repeat(F.lit(0), STATE_LENGTH - 3 - width)).alias("bits"))
            rows = one if rows is None else rows.unionByName(one)
    named = rows.withColumn("pattern", F.array_join(F.transform("p", lambda b: b.cast("string")), "")).join(names, "pattern", "left")
    named = named.select(state_text(F.col("bits")).alias("state"), "rank", F.when(F.col("rank") == 2, F.coalesce("name", F.lit("Buffer"))).otherwise(F.lit("Buffer")).alias("name"))
    off = spark.range(1).select(state_text(F.array_repeat(F.lit(0), STATE_LENGTH)).alias("state"), F.lit(0).alias("rank"), F.lit("All Off").alias("name"))
    return named.unionByName(off).groupBy("state").agg(F.max_by("name", "rank").alias("name"))
