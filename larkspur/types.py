"""Column types: a Spark type, how a Python value becomes a literal, and how a result is checked.

Four sets share one class; a type's set only matters to strict mode and to schema definitions.
"""

from __future__ import annotations

import datetime as dt
import json as _json
import math
import uuid as _uuid
from collections.abc import Callable
from dataclasses import dataclass, replace
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import types as T

from larkspur.errors import InvalidLiteral


@dataclass(frozen=True)
class ColType:
    name: str
    spark: T.DataType
    encode: Callable[[Any], Any]
    decode: Callable[[Any], Any]
    is_nullable: bool = False
    element: ColType | None = None
    merge: str | None = None
    metadata: tuple = ()

    def literal(self, value: Any) -> Any:
        """The value as a literal of this type; refuses what the type does not hold."""
        if value is None:
            if self.is_nullable:
                return None
            raise InvalidLiteral(f"null is no {self.name}")
        try:
            return self.encode(value)
        except InvalidLiteral:
            raise
        except (TypeError, ValueError, OverflowError, InvalidOperation) as error:
            raise InvalidLiteral(f"{value!r} is no {self.name}: {error}") from error

    def read(self, value: Any) -> Any:
        if value is None:
            if self.is_nullable:
                return None
            raise ValueError(f"null is no {self.name}")
        return self.decode(value)

    def field(self, name: str) -> T.StructField:
        meta = {"type": self.name} | ({"merge_fn": self.merge} if self.merge else {}) | dict(self.metadata)
        return T.StructField(name, self.spark, self.is_nullable, meta)


def _same(value: Any) -> Any:
    return value


def _text(value: Any) -> str:
    if not isinstance(value, str):
        raise InvalidLiteral(f"{value!r} is no text")
    return value


def _whole(lo: int, hi: int) -> Callable[[Any], int]:
    def check(value: Any) -> int:
        if isinstance(value, bool) or not isinstance(value, (int, float, str, Decimal)):
            raise InvalidLiteral(f"{value!r} is no number")
        n = int(value) if not isinstance(value, str) else int(value, 10)
        if isinstance(value, (float, Decimal)) and n != value:
            raise InvalidLiteral(f"{value!r} is no whole number")
        if not lo <= n <= hi:
            raise InvalidLiteral(f"{value!r} is not within {lo} and {hi}")
        return n

    return check


def _number(value: Any) -> float:
    if isinstance(value, bool) or not isinstance(value, (int, float, Decimal)):
        raise InvalidLiteral(f"{value!r} is no number")
    return float(value)


def _float_result(value: Any) -> float:
    return math.nan if value is None else float(value)


def _flag(value: Any) -> bool:
    if value in (True, False, 0, 1) and isinstance(value, (bool, int)):
        return bool(value)
    raise InvalidLiteral(f"{value!r} is no truth value")


def _moment(seconds_only: bool) -> Callable[[Any], dt.datetime]:
    def check(value: Any) -> dt.datetime:
        if isinstance(value, str):
            text = value.replace("T", " ").removesuffix("Z")
            value = dt.datetime.fromisoformat(text)
        elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
            value = dt.datetime(value.year, value.month, value.day)
        if not isinstance(value, dt.datetime):
            raise InvalidLiteral(f"{value!r} is no moment")
        if value.tzinfo is not None:
            value = value.astimezone(dt.UTC).replace(tzinfo=None)
        if seconds_only and value.microsecond:
            raise InvalidLiteral(f"{value!r} has a fraction of a second")
        return value

    return check


def _day(value: Any) -> dt.date:
    if isinstance(value, str):
        return dt.date.fromisoformat(value)
    if isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        return value
    raise InvalidLiteral(f"{value!r} is no date")


def _blob(value: Any) -> bytearray:
    if not isinstance(value, (bytes, bytearray)):
        raise InvalidLiteral(f"{value!r} is no bytes")
    return bytearray(value)


def _decimal(value: Any) -> Decimal:
    if isinstance(value, bool):
        raise InvalidLiteral(f"{value!r} is no number")
    return Decimal(str(value))


def _type(name: str, spark: T.DataType, encode=_same, decode=None) -> ColType:
    return ColType(name, spark, encode, decode or encode)


# Columnar set.
string = _type("String", T.StringType(), _text)
uint8 = _type("UInt8", T.ShortType(), _whole(0, 2**8 - 1))
uint16 = _type("UInt16", T.IntegerType(), _whole(0, 2**16 - 1))
uint32 = _type("UInt32", T.LongType(), _whole(0, 2**32 - 1))
uint64 = _type("UInt64", T.LongType(), _whole(0, 2**63 - 1))
uint64_wide = _type("UInt64", T.DecimalType(20, 0), lambda v: Decimal(_whole(0, 2**64 - 1)(v)), int)
int32 = _type("Int32", T.IntegerType(), _whole(-(2**31), 2**31 - 1))
int64 = _type("Int64", T.LongType(), _whole(-(2**63), 2**63 - 1))
float64 = _type("Float64", T.DoubleType(), _number, _float_result)
boolean = _type("Bool", T.BooleanType(), _flag)
date_time = _type("DateTime", T.TimestampNTZType(), _moment(True))
date_time64 = _type("DateTime64", T.TimestampNTZType(), _moment(False))
date_time_string = replace(date_time, decode=lambda v: v.strftime("%Y-%m-%d %H:%M:%S") if isinstance(v, dt.datetime) else str(v))
date_time64_string = replace(date_time64, decode=lambda v: v.strftime("%Y-%m-%d %H:%M:%S.%f")[:-3] if isinstance(v, dt.datetime) else str(v))
# Server set.
text = _type("text", T.StringType(), _text)
uuid = _type("uuid", T.StringType(), lambda v: str(_uuid.UUID(str(v))))
int2 = _type("int2", T.ShortType(), _whole(-(2**15), 2**15 - 1))
int4 = replace(int32, name="int4")
int8 = replace(int64, name="int8")
float4 = _type("float4", T.FloatType(), _number)
float8 = replace(float64, name="float8")
numeric = _type("numeric", T.DecimalType(38, 18), _decimal, float)
timestamptz = _type("timestamptz", T.TimestampType(), lambda v: _moment(False)(v).replace(tzinfo=dt.UTC), _same)
timestamptz_millis = _type("timestamptz", T.LongType(), _whole(-(2**63), 2**63 - 1))
# File set.
integer = _type("integer", T.LongType(), _whole(-(2**53) + 1, 2**53 - 1))
real = replace(float64, name="real")
timestamp_text = _type("timestamp", T.StringType(), lambda v: v if isinstance(v, str) else _moment(False)(v).isoformat(sep=" "))
blob = _type("blob", T.BinaryType(), _blob, bytes)
# Row-store set.
longtext = replace(text, name="longtext")
tinyint = _type("tinyint", T.ByteType(), _whole(-128, 127))
smallint = replace(int2, name="smallint")
int_ = replace(int32, name="int")
int_unsigned = replace(uint32, name="int unsigned")
bigint = replace(int64, name="bigint")
double = replace(float64, name="double")
datetime = replace(date_time64, name="datetime")
date = _type("date", T.DateType(), _day)


def varchar(n: int) -> ColType:
    def check(value: Any) -> str:
        if len(_text(value)) > n:
            raise InvalidLiteral(f"text of {len(value)} characters in varchar({n})")
        return value

    return _type(f"varchar({n})", T.StringType(), check)


def varbinary(n: int) -> ColType:
    def check(value: Any) -> bytearray:
        if len(_blob(value)) > n:
            raise InvalidLiteral(f"{len(value)} bytes in varbinary({n})")
        return bytearray(value)

    return _type(f"varbinary({n})", T.BinaryType(), check, bytes)


def decimal(p: int, s: int) -> ColType:
    def check(value: Any) -> Decimal:
        d = _decimal(value)
        if len(d.as_tuple().digits) - max(0, -d.as_tuple().exponent) > p - s:
            raise InvalidLiteral(f"{value!r} is out of decimal({p},{s})")
        return d.quantize(Decimal(1).scaleb(-s))

    return _type(f"decimal({p},{s})", T.DecimalType(p, s), check, _same)


def enum(name: str, values: tuple[str, ...]) -> ColType:
    def check(value: Any) -> str:
        if value not in values:
            raise InvalidLiteral(f"{value!r} is not one of {values}")
        return value

    return _type(name, T.StringType(), check)


def nullable(of: ColType) -> ColType:
    return of if of.is_nullable else replace(of, is_nullable=True)


def array(of: ColType) -> ColType:
    return ColType(f"Array({of.name})", T.ArrayType(of.spark, of.is_nullable), lambda v: [of.literal(x) for x in v], lambda v: [of.read(x) for x in v], element=of)


def map_(key: ColType, value: ColType) -> ColType:
    return ColType(f"Map({key.name}, {value.name})", T.MapType(key.spark, value.spark), lambda v: {key.literal(k): value.literal(x) for k, x in v.items()}, lambda v: {key.read(k): value.read(x) for k, x in v.items()}, element=value)


def low_cardinality(of: ColType) -> ColType:
    return replace(of, name=f"LowCardinality({of.name})")


def simple_aggregate(fn: str, of: ColType) -> ColType:
    """Stored as the type itself; ``fn`` merges rows of one key when a view is compacted."""
    return replace(of, name=f"SimpleAggregateFunction({fn}, {of.name})", merge=fn)


def aggregate_state(fn: str, by: ColType, value: ColType) -> ColType:
    """argMax and argMin states: the deciding value first, so that max and min of states merge them."""
    spark = T.StructType([T.StructField("by", by.spark), T.StructField("value", value.spark)])
    return ColType(f"AggregateFunction({fn}, {value.name}, {by.name})", spark, _same, _same, is_nullable=True, element=value, merge=fn)


def precision(of: ColType, digits: int) -> ColType:
    if not 0 <= digits <= 9:
        raise InvalidLiteral("precision is 0 to 9 digits")
    if digits > 6:  # Spark's timestamps hold microseconds; finer ones are whole nanoseconds
        return replace(int64, name=f"{of.name}({digits})", metadata=(("unit", "ns"),))
    return replace(of, name=f"{of.name}({digits})", metadata=(("precision", digits),))


def brand(of: ColType, check: Callable[[Any], bool], name: str) -> ColType:
    """A refinement: literals, params and rows have to pass the check."""

    def guard(inner: Callable[[Any], Any], fail: type[Exception]) -> Callable[[Any], Any]:
        def run(value: Any) -> Any:
            out = inner(value)
            if not check(out):
                raise fail(f"{value!r} is no {name}")
            return out

        return run

    return replace(of, name=name, encode=guard(of.encode, InvalidLiteral), decode=guard(of.decode, ValueError))


def json(schema: T.DataType | None = None) -> ColType:
    """JSON text; with a schema, paths are typed."""
    return ColType("json", T.StringType(), lambda v: v if isinstance(v, str) else _json.dumps(v), lambda v: _json.loads(v) if isinstance(v, str) else v, metadata=(("json", schema.json()),) if schema else ())


def custom(name: str, spark: T.DataType, encode=_same, decode=_same) -> ColType:
    return ColType(name, spark, encode, decode)


def untyped(name: str = "untyped", spark: T.DataType | None = None) -> ColType:
    return ColType(name, spark or T.StringType(), _same, _same, is_nullable=True)


def of_spark(kind: T.DataType) -> ColType:
    """The closest type of a Spark type, nullable."""
    for known in (string, int64, int32, float64, boolean, date_time64, timestamptz, date, blob, tinyint, int2, float4):
        if known.spark == kind:
            return nullable(known)
    if isinstance(kind, T.ArrayType):
        return nullable(array(of_spark(kind.elementType)))
    if isinstance(kind, T.MapType):
        return nullable(map_(of_spark(kind.keyType), of_spark(kind.valueType)))
    return nullable(custom(kind.simpleString(), kind))
