"""Data schemas, query schemas and field types of private queries."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from dataclasses import dataclass

from pyspark.sql import types as T

#: The scalar field types and the Spark type of each; "<name>_list" is an array of it.
FIELD_TYPES: dict[str, T.DataType] = {
    "byte": T.ByteType(), "boolean": T.BooleanType(), "short": T.ShortType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(),
    "double": T.DoubleType(), "char": T.StringType(), "string": T.StringType(), "byteArray": T.BinaryType(), "ip4": T.StringType(), "ip6": T.StringType(),
    "ISO8601Date": T.TimestampType(),
}
#: What a null becomes in an answer; booleans keep their nulls.
NULL_DEFAULTS = {
    "byte": 0, "short": 0, "int": 0, "long": 0, "float": 0.0, "double": 0.0, "char": "\0", "string": "", "byteArray": b"", "ip4": "127.0.0.1", "ip6": "::1",
}


def field_type(name: str) -> tuple[str, bool]:
    """Canonical scalar name and whether it is a list; names are case-insensitive."""
    wanted = name.lower()
    for scalar in FIELD_TYPES:
        if wanted == scalar.lower():
            return scalar, False
        if wanted == f"{scalar.lower()}_list":
            return scalar, True
    raise ValueError(f"unknown field type {name!r}")


def children(e: ET.Element, name: str) -> list[ET.Element]:
    """Child elements of a local name, in whatever namespace."""
    return [x for x in e if isinstance(x.tag, str) and x.tag.rpartition("}")[2] == name]


def child_text(e: ET.Element, name: str) -> str:
    """The trimmed text of the first such child; empty without one."""
    return next(((x.text or "").strip() for x in children(e, name)), "")


@dataclass(frozen=True)
class DataField:
    name: str
    type: str
    position: int


@dataclass(frozen=True)
class DataSchema:
    """Named, positioned fields; names and positions are unique."""

    name: str
    fields: tuple[DataField, ...]

    def __post_init__(self) -> None:
        if not self.name.strip() or not self.fields:
            raise ValueError("a data schema has a name and at least one field")
        for what in ("name", "position"):
            values = [getattr(f, what) for f in self.fields]
            if len(set(values)) < len(values):
                raise ValueError(f"duplicate field {what} in data schema {self.name!r}")
        for f in self.fields:
            field_type(f.type)

    def __getitem__(self, name: str) -> DataField:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def struct(self) -> T.StructType:
        out = T.StructType()
        for f in sorted(self.fields, key=lambda f: f.position):
            scalar, is_list = field_type(f.type)
            kind = FIELD_TYPES[scalar]
            out.add(f.name, T.ArrayType(kind) if is_list else kind, True, {"position": f.position})
        return out

    @staticmethod
    def from_xml(text: str) -> DataSchema:
        return DataSchema.from_element(ET.fromstring(text))

    @staticmethod
    def from_element(root: ET.Element) -> DataSchema:
        return DataSchema(
            child_text(root, "name"), tuple(DataField(child_text(e, "name"), child_text(e, "dataType"), int(child_text(e, "position") or 0)) for e in children(root, "field"))
        )


@dataclass(frozen=True)
class QueryField:
    """A selected field: ``size`` cuts strings and byte arrays (also inside lists), ``max_elements`` cuts lists."""

    name: str
    size: int | None = None
    max_elements: int | None = None


@dataclass(frozen=True)
class QuerySchema:
    name: str
    data: DataSchema
    selector: str
    fields: tuple[QueryField, ...]

    def __post_init__(self) -> None:
        names = [f.name for f in self.fields]
        if len(set(names)) < len(names):
            raise ValueError(f"duplicate field in query schema {self.name!r}")
        if self.selector not in names:
            raise ValueError(f"the selector field {self.selector!r} is not selected")
        for f in self.fields:
            scalar, _ = field_type(self.data[f.name].type)
            if f.size is not None and (f.size < 1 or scalar not in ("string", "byteArray")):
                raise ValueError(f"size of field {f.name!r}")

    @staticmethod
    def from_xml(text: str) -> QuerySchema:
        return QuerySchema.from_element(ET.fromstring(text))

    @staticmethod
    def from_element(root: ET.Element) -> QuerySchema:
        """A query schema holds the data schema it selects from."""
        data = children(root, "dataSchema")
        if len(data) != 1:
            raise ValueError("a query schema has one data schema")
        number = lambda e, name: int(child_text(e, name)) if child_text(e, name) else None
        fields = tuple(QueryField(child_text(e, "name"), number(e, "size"), number(e, "maxArrayElements")) for e in children(root, "field"))
        return QuerySchema(child_text(root, "name"), DataSchema.from_element(data[0]), child_text(root, "selectorField"), fields)
