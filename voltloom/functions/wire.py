"""Wire lines: checksum, encoding and decoding as column expressions.

A line is ``<sentinel> <kind> <body>[*HH]``: kind HELLO (a JSON header), D (a
sample, JSON or ``k=v`` tokens) or S (status text). The sentinel is whatever
the devices send; pass theirs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTINEL = "BATLOG1"
SCHEMA_ID = "battery-log/1"


@dataclass(frozen=True)
class WireField:
    name: str
    channel: str
    unit: str
    low: float
    high: float


# Wire name, channel, unit and accepted range.
WIRE_FIELDS = (
    WireField("t", "test_time_s", "s", 0.0, 1e9),
    WireField("v", "voltage_v", "V", 0.0, 1000.0),
    WireField("i", "current_a", "A", -2000.0, 2000.0),
    WireField("tc", "temperature_c", "degC", -40.0, 150.0),
    WireField("soc", "soc", "%", 0.0, 100.0),
)
CHANNELS = tuple(f.channel for f in WIRE_FIELDS)
UNITS = ("cell", "module", "pack")
MIN_CAPACITY_AH, MAX_CAPACITY_AH = 0.01, 500.0

_MARK = r"\*([0-9A-Fa-f]{2})\s*$"


def byte_values(data: Column) -> Column:
    """The bytes of a binary column as whole numbers."""
    return F.transform(F.sequence(F.lit(1), F.length(data)), lambda p: F.conv(
        F.hex(F.substring(data, p, F.lit(1))), 16, 10).cast("int"))


#: Bytes taken at once: as many as a signed number of 64 bits holds.
_WORD = 7


def xor_checksum(text: Column) -> Column:
    """XOR of the UTF-8 bytes as two upper-case hex digits."""
    raw = F.encode(text, "UTF-8")

    def folded(total: Column) -> Column:
        # Each step halves the bytes that are left; one number passed on, never an expression pasted twice.
        halves = F.array(F.lit(32), F.lit(16), F.lit(8))
        return F.aggregate(halves, total, lambda x, by: x.bitwiseXOR(F.call_function("shiftright", x, by))).bitwiseAND(F.lit(255))

    words = F.sequence(F.lit(1), F.length(raw), F.lit(_WORD))
    total = F.when(F.length(raw) == 0, F.lit(0)).otherwise(F.aggregate(
        words, F.lit(0).cast("bigint"), lambda a, p: a.bitwiseXOR(
            F.conv(F.hex(F.substring(raw, p, F.lit(_WORD))), 16, 10).cast("bigint")), folded))
    return F.lpad(F.hex(total), 2, "0")


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def short_number(x: Column) -> Column:
    """Six significant digits without trailing zeros."""
    size = F.when(x == 0, F.lit(0)).otherwise(F.floor(F.log10(F.abs(x))))
    places = F.greatest(F.lit(0), 5 - size).cast("int").cast("string")
    plain = F.call_function("format_string", F.concat(F.lit("%."), places, F.lit("f")), x)
    trimmed = F.when(F.instr(plain, ".") > 0, F.regexp_replace(plain, r"\.?0+$", "")).otherwise(plain)
    power = F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e")
    return F.when(x.isNotNull(), F.when((size < -4) | (size >= 6), power).otherwise(trimmed))


def framed(kind: str, body: Column, checksum: bool = True, sentinel: str = SENTINEL) -> Column:
    line = F.concat(F.lit(f"{sentinel} {kind} "), body)
    return F.concat(line, F.lit("*"), xor_checksum(body)) if checksum else line


def encode_record(compact: bool = False, checksum: bool = True, sentinel: str = SENTINEL) -> Column:
    """A data line from the channel columns; absent values are left out."""
    if compact:
        body = F.concat_ws(" ", *[F.concat(F.lit(f"{f.name}="), short_number(F.col(f.channel)))
                                  for f in WIRE_FIELDS])
    else:
        body = F.to_json(F.struct(*[F.col(f.channel).alias(f.name) for f in WIRE_FIELDS]))
    return framed("D", body, checksum, sentinel)


def encode_hello(cell_id: Column, fields: tuple[str, ...] = tuple(f.name for f in WIRE_FIELDS),
                 capacity_ah: Column | None = None, unit: str | None = None,
                 schema_id: str = SCHEMA_ID, sentinel: str = SENTINEL) -> Column:
    body = F.to_json(F.struct(
        *([capacity_ah.alias("capacity_ah")] if capacity_ah is not None else []),
        cell_id.alias("cell_id"), F.array(*[F.lit(f) for f in fields]).alias("fields"),
        F.lit(schema_id).alias("schema"), *([F.lit(unit).alias("unit")] if unit else [])))
    return framed("HELLO", body, True, sentinel)


def encode_status(text: Column, sentinel: str = SENTINEL) -> Column:
    return framed("S", _stripped(text), True, sentinel)


def split_line(line: Column, sentinel: str = SENTINEL) -> dict[str, Column]:
    """has_sentinel, kind, body (without checksum) and carried checksum."""
    whole = _stripped(line)
    start = F.instr(whole, sentinel)
    rest = _stripped(F.substring(whole, start + len(sentinel), F.length(whole)))
    kind = F.substring_index(rest, " ", 1)
    body = _stripped(F.substring(rest, F.length(kind) + 1, F.length(rest)))
    return {
        "has_sentinel": F.coalesce(start > 0, F.lit(False)),
        "record_kind": kind,
        "carried": F.upper(F.regexp_extract(body, _MARK, 1)),
        "body": F.regexp_replace(body, _MARK, ""),
    }


_RAW = "t STRING, v STRING, i STRING, tc STRING, soc STRING, _bad STRING"


def raw_values(body: Column) -> dict[str, Column]:
    """Field texts, and what is wrong with the body's form.

    Both codecs are read with built-in parsers: JSON by one ``from_json``, and
    ``k=v`` tokens by one pattern per field (the last token of a name counts).
    """
    text = _stripped(body)
    is_json = text.startswith("{")
    out = {
        "json": F.when(is_json, F.from_json(text, _RAW, {
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})),
        "keys": F.when(is_json, F.json_object_keys(text)),
        "is_json": is_json,
        "bad_token": F.nullif(F.regexp_extract(F.when(~is_json, text), r"(?:^|\s)([^\s=]+)(?=\s|$)", 1),
                              F.lit("")),
    }
    for f in WIRE_FIELDS:
        pattern = rf"(?:^|.*\s){f.name}=(\S*)"
        out[f"kv_{f.name}"] = F.when(F.regexp_like(text, F.lit(pattern)),
                                     F.regexp_extract(text, pattern, 1))
    return out


def field_text(f: WireField) -> Column:
    """The text of one field from the columns of ``raw_values`` (prefixed ``_``)."""
    quoted = F.when(F.array_contains("_keys", f.name), F.coalesce(F.col(f"_json.{f.name}"), F.lit("None")))
    return F.when(F.col("_is_json"), quoted).otherwise(F.col(f"_kv_{f.name}"))


def field_problem(f: WireField, text: Column, x: Column) -> tuple[Column, Column]:
    """(no-number text, range text) of one field; x is the text as a number."""
    no_number = F.when(text.isNotNull() & x.isNull(), F.concat(
        F.lit(f"field {f.name}='"), text, F.lit("' is not numeric")))
    finite = ~F.isnan(x) & (F.abs(x) < float("inf"))
    bad = F.when(~finite, F.concat(F.lit(f"{f.name}="), text, F.lit(" is not a finite number"))).when(
        ~x.between(f.low, f.high), F.concat(
            F.lit(f"{f.name}="), text,
            F.lit(f" {f.unit} is outside the declared range [{f.low:g}, {f.high:g}] {f.unit}")))
    return no_number, bad


_HELLO = ("schema STRING, fields ARRAY<STRING>, cell_id STRING, period_ms STRING, device STRING, "
          "firmware STRING, capacity_ah STRING, unit STRING")


def hello_problem(h: Column, body: Column) -> Column:
    cap = h["capacity_ah"].try_cast("double")
    unit = F.lower(_stripped(F.coalesce(h["unit"], F.lit(""))))
    return (
        F.when(F.json_object_keys(_stripped(body)).isNull(), "malformed JSON: not an object")
        .when(_stripped(F.coalesce(h["schema"], F.lit(""))) == "", "HELLO does not declare a schema id")
        .when(F.coalesce(F.size(h["fields"]), F.lit(0)) <= 0, "HELLO does not declare a non-empty fields list")
        .when(h["capacity_ah"].isNotNull() & cap.isNull(), "HELLO declares a capacity_ah that is not numeric")
        .when(~cap.between(MIN_CAPACITY_AH, MAX_CAPACITY_AH),
              "HELLO declares capacity_ah outside the plausible range [0.01, 500] Ah")
        .when((unit != "") & ~unit.isin(*UNITS), "HELLO declares a unit that is not cell, module or pack"))


def hello_header(h: Column) -> Column:
    unit = F.lower(_stripped(F.coalesce(h["unit"], F.lit(""))))
    return F.struct(
        h["schema"].alias("schema_id"), h["fields"].alias("fields"), h["cell_id"].alias("cell_id"),
        h["period_ms"].try_cast("double").alias("period_ms"), h["device"].alias("device"),
        h["firmware"].alias("firmware"), h["capacity_ah"].try_cast("double").alias("capacity_ah"),
        F.when(unit == "", "cell").otherwise(unit).alias("unit"))
