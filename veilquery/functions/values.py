"""Filter expressions as typed Spark columns.

Filters are written as Python expressions over :class:`Fields`; each operation yields a
Column with the semantics of the private-query filter language, so Catalyst can fold,
push down and compile it.

Rules.  Equality is null-safe and ``<>`` its negation; an ordering with a null is false.
Arithmetic with an integral operand converts both sides to long first (5.9 + 1 is 6,
7 / 2 is 3); comparisons are by long only if both sides are integral.  A float literal with an
integral value is a long.  Concatenation writes null as "null".  MATCHES is a full match.
IN is membership for lists and containment for strings.  Mixed types raise TypeError
when the expression is built.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_SPARK = {"long": "bigint", "double": "double", "string": "string", "bool": "boolean", "time": "timestamp"}


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.ArrayType):
        return f"list {_kind(data_type.elementType)}"
    for kind, types in (
        ("long", _INTEGRAL), ("double", (T.FloatType, T.DoubleType, T.DecimalType)), ("string", (T.StringType,)), ("bool", (T.BooleanType,)),
        ("time", (T.TimestampType, T.TimestampNTZType, T.DateType)), ("bytes", (T.BinaryType,)),
    ):
        if isinstance(data_type, types):
            return kind
    raise TypeError(f"no filter type for {data_type.simpleString()}")


class Value:
    """A column with its filter type: long, double, string, bool, time, bytes, null, or list of one."""

    __hash__ = None

    def __init__(self, column: Column, kind: str):
        self.column, self.kind = column, kind

    @property
    def number(self) -> bool:
        return self.kind in ("long", "double", "null")

    def _cast(self, kind: str) -> Column:
        return self.column.cast(_SPARK[kind])

    # arithmetic
    def _math(self, other, by: Callable[[Column, Column], Column], whole: Callable[[Column, Column], Column] | None = None) -> Value:
        other = value(other)
        if not (self.number and other.number):
            raise TypeError(f"arithmetic on {self.kind} and {other.kind}")
        kind = "long" if "long" in (self.kind, other.kind) else "double"
        return Value((whole or by if kind == "long" else by)(self._cast(kind), other._cast(kind)), kind)

    def __add__(self, other) -> Value:
        return self._math(other, lambda a, b: a + b)

    def __sub__(self, other) -> Value:
        return self._math(other, lambda a, b: a - b)

    def __mul__(self, other) -> Value:
        return self._math(other, lambda a, b: a * b)

    def __truediv__(self, other) -> Value:
        def floating(a: Column, b: Column) -> Column:
            by_zero = F.when(a == 0, F.lit(float("nan"))).when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
            return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))

        return self._math(other, floating, lambda a, b: F.call_function("div", a, b))

    def __mod__(self, other) -> Value:
        return self._math(other, lambda a, b: a % b)

    # comparison
    def _pair(self, other) -> tuple[Column, Column]:
        other = value(other)
        if self.number and other.number:
            kind = "long" if {self.kind, other.kind} <= {"long", "null"} else "double"
            return self._cast(kind), other._cast(kind)
        if "null" in (self.kind, other.kind):
            kind = other.kind if self.kind == "null" else self.kind
            return (self.column.cast(_SPARK[kind]) if self.kind == "null" and kind in _SPARK else self.column), (
                other.column.cast(_SPARK[kind]) if other.kind == "null" and kind in _SPARK else other.column
            )
        if self.kind != other.kind:
            raise TypeError(f"{self.kind} is compared with {other.kind}")
        return (self._cast("time"), other._cast("time")) if self.kind == "time" else (self.column, other.column)

    def _order(self, other, by: Callable[[Column, Column], Column]) -> Value:
        return Value(F.coalesce(by(*self._pair(other)), F.lit(False)), "bool")

    def __gt__(self, other) -> Value:
        return self._order(other, lambda a, b: a > b)

    def __ge__(self, other) -> Value:
        return self._order(other, lambda a, b: a >= b)

    def __lt__(self, other) -> Value:
        return self._order(other, lambda a, b: a < b)

    def __le__(self, other) -> Value:
        return self._order(other, lambda a, b: a <= b)

    def __eq__(self, other) -> Value:
        if value(other).kind == "null":
            return Value(self.column.isNull(), "bool")
        a, b = self._pair(other)
        return Value(a.eqNullSafe(b), "bool")

    def __ne__(self, other) -> Value:
        return ~(self == other)

    # predicates
    def truth(self) -> Column:
        """As a bare predicate: a true boolean, a number that is not 0, a non-empty string or list, a time that is there."""
        c = self.column
        if self.kind == "bool":
            test = c
        elif self.kind in ("long", "double"):
            test = c != 0
        elif self.kind == "string":
            test = c != ""
        elif self.kind.startswith("list"):
            test = F.size(c) > 0
        else:
            test = c.isNotNull()
        return F.coalesce(test, F.lit(False))

    def __and__(self, other) -> Value:
        return Value(self.truth() & value(other).truth(), "bool")

    def __or__(self, other) -> Value:
        return Value(self.truth() | value(other).truth(), "bool")

    def __invert__(self) -> Value:
        return Value(~self.truth(), "bool")

    def is_empty(self) -> Value:
        if self.kind == "string":
            return Value(F.coalesce(self.column == "", F.lit(True)), "bool")
        if self.kind.startswith("list") or self.kind == "null":
            return Value(F.coalesce(F.size(self.column) == 0, F.lit(True)) if self.kind != "null" else F.lit(True), "bool")
        raise TypeError(f"IS EMPTY on {self.kind}")

    def is_not_empty(self) -> Value:
        return ~self.is_empty()

    def matches(self, pattern: str) -> Value:
        """Full match of a Java regular expression; null does not match."""
        return Value(F.coalesce(self.column.rlike(rf"\A(?:{pattern})\z"), F.lit(False)), "bool")

    def is_in(self, other) -> Value:
        """Membership in a list, or containment in a string."""
        other = value(other)
        if other.kind == "string":
            return Value(F.coalesce(F.contains(other.column, self.column), F.lit(False)), "bool")
        if not other.kind.startswith("list"):
            raise TypeError(f"IN on {other.kind}")
        inner = other.kind.removeprefix("list ")
        if "double" in (inner, self.kind) and inner != self.kind:
            return Value(F.exists(other.column, lambda x: x.cast("double").eqNullSafe(self.column.cast("double"))), "bool")
        return Value(F.coalesce(F.exists(other.column, lambda x: x.eqNullSafe(self.column)), F.lit(False)), "bool")

    # strings
    def concat(self, other) -> Value:
        text = lambda v: F.coalesce(v.column.cast("string"), F.lit("null"))
        return Value(F.concat(text(self), text(value(other))), "string")

    def char_length(self) -> Value:
        return Value(F.char_length(self.column).cast("bigint"), "long")

    def sqrt(self) -> Value:
        return Value(F.sqrt(self._cast("double")), "double")


def value(x) -> Value:
    """A literal, list or Value as a Value."""
    if isinstance(x, Value):
        return x
    if x is None:
        return Value(F.lit(None), "null")
    if isinstance(x, bool):
        return Value(F.lit(x), "bool")
    if isinstance(x, float) and x.is_integer() and abs(x) < 1 << 63:
        x = int(x)
    if isinstance(x, int):
        return Value(F.lit(x).cast("bigint"), "long")
    if isinstance(x, float):
        return Value(F.lit(x), "double")
    if isinstance(x, str):
        return Value(F.lit(x), "string")
    if isinstance(x, (dt.datetime, dt.date)):
        return Value(F.lit(x).cast("timestamp"), "time")
    if isinstance(x, (list, tuple)):
        items = [value(i) for i in x]
        kinds = {i.kind for i in items} - {"null"}
        kind = "double" if kinds == {"long", "double"} else next(iter(kinds), "string")
        if kinds - {"long", "double"} and len(kinds) > 1:
            raise TypeError(f"a list of {sorted(kinds)}")
        return Value(F.array(*(i.column.cast(_SPARK[kind]) for i in items)).cast(f"array<{_SPARK[kind]}>"), f"list {kind}")
    raise TypeError(f"no filter value from {type(x).__name__}")


def now() -> Value:
    """The current time, captured once when the filter is built."""
    return value(dt.datetime.now(dt.timezone.utc))


def today() -> Value:
    """The first instant of the current day in UTC, captured once when the filter is built."""
    return value(dt.datetime.now(dt.timezone.utc).replace(hour=0, minute=0, second=0, microsecond=0))


class Fields:
    """The fields of a schema as Values; unknown names raise KeyError."""

    def __init__(self, schema: T.StructType):
        self.schema = schema

    def __getitem__(self, name: str) -> Value:
        return Value(F.col(f"`{name.replace('`', '``')}`"), _kind(self.schema[name].dataType))


def _step(step: Callable[[Value, Value], Value], kind: str, inner: str) -> Callable[[Column, Column], Column]:
    return lambda acc, x: step(Value(acc, kind), Value(x, inner))._cast(kind)


def _fold(values, step: Callable[[Value, Value], Value]) -> Value:
    total: Value | None = None
    for v in map(value, values):
        if not v.kind.startswith("list"):
            total = v if total is None else step(total, v)
            continue
        inner = v.kind.removeprefix("list ")
        rest, start = v.column, total
        if start is None:
            start, rest = Value(F.get(v.column, F.lit(0)), inner), F.slice(v.column, F.lit(2), F.greatest(F.size(v.column) - 1, F.lit(0)))
        kind = step(start, Value(F.lit(None), inner)).kind
        total = Value(F.aggregate(rest, start._cast(kind), _step(step, kind, inner)), kind)
    if total is None:
        raise TypeError("an aggregate of nothing")
    return total


def sum_of(*values) -> Value:
    """Row-level sum over scalars and lists, left to right."""
    return _fold(values, lambda a, b: a + b)


def _pick(by: Callable[..., Column]) -> Callable[[Value, Value], Value]:
    return lambda a, b: a._math(b, lambda x, y: by(x, y))


def min_of(*values) -> Value:
    return _fold(values, _pick(F.least))


def max_of(*values) -> Value:
    return _fold(values, _pick(F.greatest))


def count_of(*values) -> Value:
    sizes = [F.size(v.column) if v.kind.startswith("list") else F.lit(1) for v in map(value, values)]
    total = sizes[0]
    for s in sizes[1:]:
        total = total + s
    return Value(total.cast("bigint"), "long")


def avg_of(*values) -> Value:
    return sum_of(*values) / count_of(*values)
