"""Bus frame payloads: bit fields to physical values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bit_field(octets: Column, start: Column, length: Column, big_endian: Column,
              signed: Column) -> Column:
    """Raw whole number of a signal.

    Little-endian signals start at their lowest bit; big-endian ones at their
    highest, and run towards lower bits and later bytes. ``octets`` are the
    payload bytes as whole numbers. Bits are added one by one, so no 64-bit
    word has to hold the whole payload.
    """
    def bit(k: Column) -> Column:
        low = start + k
        high = F.floor(start / 8) * 8 + 7 - F.pmod(start, F.lit(8)) + k
        at = F.when(big_endian, high).otherwise(low)
        inside = F.pmod(at, F.lit(8))
        shift = F.when(big_endian, 7 - inside).otherwise(inside).cast("int")
        octet = F.get(octets, F.floor(at / 8).cast("int"))
        one = F.pmod(F.floor(octet / F.pow(F.lit(2.0), shift)), F.lit(2))
        weight = F.when(big_endian, length - 1 - k).otherwise(k)
        return (one * F.pow(F.lit(2.0), weight)).cast("bigint")

    raw = F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0).cast("bigint"), lambda a, k: a + bit(k))
    span = F.pow(F.lit(2.0), length).cast("bigint")
    negative = signed & (raw >= F.pow(F.lit(2.0), length - 1).cast("bigint"))
    return F.when(negative, raw - span).otherwise(raw)


def physical(raw: Column, factor: Column, offset: Column) -> Column:
    return raw * factor + offset
