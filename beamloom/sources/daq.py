"""Decoded sub-events of a data-acquisition run as hits. The vendor's binary format itself is out of scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamloom.functions import scan


#: Fixed values of the digitiser's offset DAC and of its codes.
DAC_STEPS, DAC_CENTRE, ZERO_CODE, CODES_PER_VOLT = 65535.0, 0.5, 2048.0, 4096.0


def skip_producers(sub: DataFrame, skipped: list[str]) -> DataFrame:
    return sub.filter(~F.col("producer").isin(skipped)) if skipped else sub


def channel_of(aux: Column) -> Column:
    """The channel in `<name>:CH<n>:col..:row..`; -1 if no part behind the name is one."""
    parts = F.split(aux, ":")
    named = F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: p.startswith("CH"))
    return F.coalesce(F.substring(F.get(named, F.lit(0)), 3, 9).try_cast("int"), F.lit(-1))


def dac_offsets(text: Column) -> Column:
    """Map of channel to volts from entries `CH<n>: <dac>`; what is no entry is passed over, and of equal channels the last counts."""
    parts = F.split(text, "CH")
    pieces = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.split(p, ":"))
    entry = lambda p: F.struct(F.rtrim(p[0]).try_cast("int").alias("key"), volts(F.split(F.ltrim(F.get(p, F.lit(1))), "[^0-9]")[0].try_cast("double")).alias("value"))
    read = F.filter(F.transform(pieces, entry), lambda e: e["key"].isNotNull() & e["value"].isNotNull())
    last = F.filter(read, lambda e, i: ~F.exists(F.slice(read, i + 2, F.size(read)), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)


def with_offsets(sub: DataFrame, text: Column, name: str = "offsets") -> DataFrame:
    """sub with the `dac_offsets` of a text. A run has few different texts (one, as a rule): each is read once, not once a row, and the
    maps are broadcast."""
    named = sub.withColumn("__text", text)
    texts = named.select("__text").distinct()
    read = texts.select(F.col("__text").alias("__known"), dac_offsets(F.col("__text")).alias(name))
    return named.join(F.broadcast(read), F.col("__text").eqNullSafe(F.col("__known")), "left").drop("__text", "__known")


def volts(dac: Column) -> Column:
    return dac / DAC_STEPS - DAC_CENTRE


def dc_offset(offsets: Column, channel: Column, default_dac: int = 32768) -> Column:
    return F.coalesce(F.try_element_at(offsets, channel), volts(F.lit(float(default_dac))))


def sensor_name(c: Column) -> Column:
    return F.regexp_replace(c, r"\s", "")


def timestamp_ns(pixel_ps: Column, kind: Column, event_number: Column, begin: Column, end: Column, synthetic: tuple[str, ...] = ()) -> Column:
    """The pixel's time in ps as ns; else, for some kinds, one made from the event number; else the middle of the window in ps."""
    made = (event_number - 0.2) / 1000.0
    window = (begin + end) / 2000.0
    other = F.when(kind.isin(list(synthetic)), made).otherwise(window) if synthetic else window
    return F.when(pixel_ps > 0, pixel_ps / 1000.0).otherwise(other)


def adc_codes(volts: Column, dc: Column, length: int = 1024) -> Column:
    """16-bit codes round((v - dc) * 4096 + 2048), padded with zeros or cut to `length`."""
    codes = F.transform(volts, lambda v: F.round((v - dc) * CODES_PER_VOLT + ZERO_CODE).cast("short"))
    zeros = F.array_repeat(F.lit(0).cast("short"), F.greatest(F.lit(0), F.lit(length) - F.size(volts)))
    return F.slice(F.concat(codes, zeros), 1, length)


def number_windows(events: DataFrame) -> DataFrame:
    """event_id without gaps for hardware event numbers: how many lower ones there are."""
    ranked = scan.running(events.select("event_number").distinct(), (), ("event_number",), {"event_id": ("sum", F.lit(1))}, inclusive=False)
    return ranked.select(F.coalesce("event_id", F.lit(0)).alias("event_id"), "event_number")
