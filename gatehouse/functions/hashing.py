"""Keyed hashes: reproducible splits and orders that survive recomputation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_modulus(text: Column, modulus: int) -> Column:
    """md5(text) as a 128-bit integer, modulo a small number.

    ``conv`` is limited to 64 bits, so the two halves are reduced separately.
    """
    return digest_modulus(F.md5(F.encode(text, "UTF-8")), modulus)


def digest_modulus(digest: Column, modulus: int) -> Column:
    """A digest of 32 hex digits as an integer, modulo a small number."""
    def half(start: int) -> Column:
        value = F.conv(F.substr(digest, F.lit(start), F.lit(16)), 16, 10).cast("decimal(20,0)")
        return F.pmod(value, F.lit(modulus).cast("decimal(20,0)")).cast("bigint")

    shift = pow(2, 64, modulus)
    return F.pmod(half(1) * shift + half(17), F.lit(modulus)).cast("bigint")


def is_held_out(text: Column, modulus: int = 7) -> Column:
    """One prompt in ``modulus`` is held out, by content alone."""
    return md5_modulus(text, modulus) == 0


def seeded(seed: int, *keys: Column) -> Column:
    """A 64-bit order key that depends on the seed and the keys only."""
    return F.xxhash64(*[F.concat_ws("\x1f", F.lit(str(seed)), *[k.cast("string") for k in keys])])


def seeded_md5(seed: int, *keys: Column) -> Column:
    """Like :func:`seeded`, as hex text that any SQL engine can reproduce."""
    return F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]), "UTF-8"))
