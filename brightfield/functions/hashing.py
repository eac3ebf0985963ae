"""Deterministic hash splits and choices: the same in any run, partition and session."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(*parts: Column, separator: str = ":") -> Column:
    return F.sha2(F.concat_ws(separator, *parts), 256)


def hex_number(hexdigits: Column) -> Column:
    """Unsigned value of up to 16 hexadecimal digits."""
    return F.conv(hexdigits, 16, 10).cast("decimal(20,0)")


def in_modulus_split(group: Column, parts: int = 10, digits: int = 8) -> Column:
    """Held out: the first digits of the digest, as a number, divide by ``parts``."""
    return (hex_number(F.substring(F.sha2(group, 256), 1, digits)) % parts) == 0


def unit_interval(key: Column) -> Column:
    """The first 64 bits of the digest as a fraction of 2**64."""
    return (hex_number(F.substring(F.sha2(key, 256), 1, 16)) / F.lit(float(2**64))).cast("double")


def in_fraction_split(key: Column, fraction: float) -> Column:
    return hex_number(F.substring(F.sha2(key, 256), 1, 16)).cast("double") / float(2**64) < fraction


def choose(key: Column, options: list[str], offset: int = 0) -> Column:
    """One of the options by hash of the key."""
    at = ((hex_number(F.substring(F.sha2(key, 256), 1, 16)) + offset) % len(options)).cast("int")
    return F.element_at(F.array(*map(F.lit, options)), at + 1)


def base_seed(key: Column, offset: int = 0) -> Column:
    """Digest modulo 2**31, plus an offset: the last eight digits decide."""
    return (hex_number(F.substring(F.sha2(key, 256), 57, 8)) % (2**31)).cast("long") + offset


def canonical_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x1e", *parts), 256), 1, 16)


def sample_order(key: Column, seed: int | str) -> Column:
    """Order of a reproducible shuffle."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def envelope_hash(mode: Column, fields: dict[str, list[Column]]) -> Column:
    """Digest over the fields that count in a row's mode; null in a mode that is not named."""
    out = F.lit(None).cast("string")
    for name, parts in fields.items():
        text = F.concat_ws("\x1f", F.lit(name), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
        out = F.when(mode == name, F.sha2(text, 256)).otherwise(out)
    return out
