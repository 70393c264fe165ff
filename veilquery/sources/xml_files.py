"""Queries, responses and clear-text answers as XML files.

A query is small (2**hash_bits elements) and made or read as one text.  Responses and
answers are as large as their tables: each task writes lines of its own, and the part files
of a folder, in the order of their names, are one document.  An element that
repeats is one line, so reading is parallel too.

Namespaces are not looked at when reading.  Writing takes them as ``xmlns``, a mapping from
the parts query, query_schema, data_schema, response and clear_text to addresses; parts
without one have none.  A filter is Python here and stands in no file.  Characters that XML
cannot hold become U+FFFD.
"""

from __future__ import annotations

import base64
import xml.etree.ElementTree as ET
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilquery.operators.cipher import NullScheme, PaillierScheme
from veilquery.plans.private import PrivateQuery, Scheme
from veilquery.schema import QuerySchema, child_text, children

_VERSION = "2.0"
_NOT_IN_XML = "[^\\x09\\x0A\\x0D\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]"
_HITS = "`_selectorValue` string, hit array<struct<field: array<struct<name: string, value: string>>>>"


def _sub(parent: ET.Element, name: str, text: object = None, xmlns: str | None = None) -> ET.Element:
    e = ET.SubElement(parent, name, {"xmlns": xmlns} if xmlns else {})
    if text is not None:
        e.text = str(text)
    return e


def _bytes(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8 or 1, "big")


def _text64(n: int) -> str:
    return base64.b64encode(_bytes(n)).decode()


def _base64(c: Column) -> Column:
    return F.translate(F.base64(c), "\r\n", "")  # Spark may break the line after 76 characters


def _add_schema(parent: ET.Element, schema: QuerySchema, xmlns: Mapping[str, str]) -> None:
    own = _sub(parent, "querySchema", xmlns=xmlns.get("query_schema"))
    _sub(own, "name", schema.name)
    _sub(own, "selectorField", schema.selector)
    for f in schema.fields:
        e = _sub(own, "field")
        _sub(e, "name", f.name)
        if f.size is not None:
            _sub(e, "size", f.size)
        if f.max_elements is not None:
            _sub(e, "maxArrayElements", f.max_elements)
    data = _sub(own, "dataSchema", xmlns=xmlns.get("data_schema"))
    _sub(data, "name", schema.data.name)
    for f in schema.data.fields:
        e = _sub(data, "field")
        for name, value in (("name", f.name), ("dataType", f.type), ("position", f.position)):
            _sub(e, name, value)


def _add_info(root: ET.Element, query: PrivateQuery, query_id: str, query_name: str, selectors: int | None, xmlns: Mapping[str, str]) -> None:
    info = _sub(root, "queryInfo")
    modulus = query.scheme.n if isinstance(query.scheme, PaillierScheme) else 0
    values = {
        "queryId": query_id, "queryName": query_name, "cryptoSchemeId": query.scheme.name, "publicKey": _text64(modulus), "numSelectors": selectors,
        "hashBitSize": query.hash_bits, "hashKey": query.hash_key, "dataChunkSize": query.chunk_size,
    }
    for name, value in values.items():
        if value is not None:
            _sub(info, name, value, xmlns.get("query"))
    _add_schema(info, query.schema, xmlns)


def query_to_xml(query: PrivateQuery, query_id: str, query_name: str = "", *, selectors: int | None = None, xmlns: Mapping[str, str] | None = None) -> str:
    """The public part of a query: what the responding side gets.  ``selectors``: their number, if it may be told."""
    names = xmlns or {}
    root = ET.Element("query", ({"xmlns": names["query"]} if "query" in names else {}) | {"schemaVersion": _VERSION})
    _add_info(root, query, query_id, query_name, selectors, names)
    elements = _sub(root, "queryElements")
    for key, value in sorted(query.elements.items()):
        ET.SubElement(elements, "entry", {"key": str(key), "value": _text64(value)})
    return ET.tostring(root, encoding="unicode")


def _number(text: str) -> int:
    return int.from_bytes(base64.b64decode(text), "big")


def _scheme(name: str, public_key: int) -> Scheme:
    if name == NullScheme.name:
        return NullScheme()
    if name == PaillierScheme.name:
        return PaillierScheme(public_key)
    raise ValueError(f"no scheme {name!r}")


def query_from_xml(text: str) -> PrivateQuery:
    """The query of such a text; it must have an element for every hash bucket."""
    root = ET.fromstring(text)
    if root.get("schemaVersion") != _VERSION:
        raise ValueError(f"query files have version {_VERSION}")
    info, elements = children(root, "queryInfo"), children(root, "queryElements")
    if len(info) != 1 or len(elements) != 1 or len(children(info[0], "querySchema")) != 1:
        raise ValueError("a query file has one queryInfo with a querySchema, and one queryElements")
    bits = int(child_text(info[0], "hashBitSize"))
    found = {int(e.attrib["key"]): _number(e.attrib["value"]) for e in children(elements[0], "entry")}
    if set(found) != set(range(1 << bits)):
        raise ValueError("a query file has an element for every hash bucket")
    return PrivateQuery(
        QuerySchema.from_element(children(info[0], "querySchema")[0]), child_text(info[0], "hashKey"), bits, int(child_text(info[0], "dataChunkSize")),
        _scheme(child_text(info[0], "cryptoSchemeId"), _number(child_text(info[0], "publicKey"))), found,
    )


def response_lines(response: DataFrame, query: PrivateQuery, query_id: str, query_name: str = "", *, xmlns: Mapping[str, str] | None = None) -> DataFrame:
    """result_set, line: the lines of one document for each result set, its head in an earlier partition than its results,
    its end in a later one.  A result set with only a null column (an empty window) is a document without results."""
    names = xmlns or {}
    root = ET.Element("response", ({"xmlns": names["response"]} if "response" in names else {}) | {"schemaVersion": _VERSION})
    _add_info(root, query, query_id, query_name, None, names)
    head = ET.tostring(root, encoding="unicode").removesuffix("</response>") + "<resultSet>"
    sets = response.select("result_set").distinct()
    results = response.where("column is not null").select(
        "result_set", F.concat(F.lit('<result column="'), F.col("column").cast("string"), F.lit('" value="'), _base64(F.col("value")), F.lit('"/>')).alias("line")
    )
    edge = lambda text: sets.select("result_set", F.lit(text).alias("line")).coalesce(1)
    return edge(head).union(results).union(edge("</resultSet></response>"))


def write_response_xml(response: DataFrame, query: PrivateQuery, path: str, query_id: str, query_name: str = "", **options) -> None:
    """A folder result_set=<number> for each result set; its part files in the order of their names are one document."""
    response_lines(response, query, query_id, query_name, **options).write.partitionBy("result_set").text(path)


def _elements(spark: SparkSession, path: str, tag: str, schema: str, documents: bool) -> DataFrame:
    """One row per element of a local name: from lines of their own, or from whole documents of any layout."""
    options = {"ignoreSurroundingSpaces": "false", "mode": "FAILFAST"}
    if documents:
        return spark.read.format("xml").schema(schema).options(rowTag=tag, **options).load(path)
    lines = spark.read.text(path).where(F.col("value").startswith(f"<{tag} "))
    return lines.select(F.from_xml("value", schema, options).alias("e"), *(c for c in lines.columns if c != "value")).select("e.*", *(c for c in lines.columns if c != "value"))


def read_response_xml(spark: SparkSession, path: str, *, documents: bool = False) -> DataFrame:
    """result_set, column and value of a folder of :func:`write_response_xml`, or with ``documents`` of whole response
    files, whose results all make result set 0 (one file for each result set, then)."""
    rows = _elements(spark, path, "result", "`_column` long, `_value` string", documents)
    number = F.col("result_set").cast("long") if "result_set" in rows.columns else F.lit(0).cast("long")
    return rows.select(number.alias("result_set"), F.col("_column").alias("column"), F.unbase64("_value").alias("value"))


def _shown(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return _base64(c) if isinstance(kind, T.BinaryType) else F.regexp_replace(c.cast("string"), _NOT_IN_XML, "�")


def hit_fields(answer: DataFrame) -> Column:
    """The fields of a hit as an array of name and value texts: a list gives one entry an element, nulls none."""
    def entry(name: str, kind: T.DataType):
        return lambda x: F.struct(F.lit(name).alias("name"), _shown(x, kind).alias("value"))

    parts = []
    for f in answer.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.ArrayType):
            parts.append(F.transform(F.coalesce(c, F.array().cast(f.dataType)), entry(f.name, f.dataType.elementType)))
        elif f.name != "selector":
            parts.append(F.array(entry(f.name, f.dataType)(c)))
    none = F.array().cast("array<struct<name: string, value: string>>")
    return F.filter(F.concat(none, *parts), lambda x: x["value"].isNotNull())


def clear_text_lines(answer: DataFrame) -> DataFrame:
    """line: every hit as an element ``hits`` of its selector value, so that a selector with many hits is no group."""
    selector = F.regexp_replace("selector", _NOT_IN_XML, "�")
    hit = F.struct(selector.alias("_selectorValue"), F.array(F.struct(hit_fields(answer).alias("field"))).alias("hit"))
    text = F.regexp_replace(F.to_xml(hit, {"rowTag": "hits", "indent": ""}), r"\s+\z", "")
    return answer.select(F.replace(F.replace(text, F.lit("\r"), F.lit("&#13;")), F.lit("\n"), F.lit("&#10;")).alias("line"))


def write_clear_text_xml(answer: DataFrame, schema: QuerySchema, path: str, query_id: str, query_name: str = "", *, xmlns: Mapping[str, str] | None = None) -> None:
    """A folder whose part files, in the order of their names, are one clear-text answer."""
    root = ET.Element("clearTextResponse", {"xmlns": xmlns["clear_text"]} if xmlns and "clear_text" in xmlns else {})
    _sub(root, "queryName", query_name)
    _sub(root, "queryId", query_id)
    own = ET.SubElement(root, "selector", {"selectorName": schema.selector})
    own.text = ""
    head = ET.tostring(root, encoding="unicode").removesuffix("</clearTextResponse>").removesuffix(" />").removesuffix("</selector>")
    head = head if head.endswith(">") else head + ">"
    edge = lambda text: answer.sparkSession.createDataFrame([(text,)], "line string").coalesce(1)
    edge(head).union(clear_text_lines(answer)).union(edge("</selector></clearTextResponse>")).write.text(path)


def clear_text_hits(lines: DataFrame) -> DataFrame:
    """selector and fields (name and value texts) of lines of :func:`clear_text_lines`."""
    kept = {"ignoreSurroundingSpaces": "false", "mode": "FAILFAST"}
    return _hits(lines.select(F.from_xml("line", _HITS, kept).alias("h")).select("h.*"))


def read_clear_text_xml(spark: SparkSession, path: str, *, documents: bool = False) -> DataFrame:
    """selector and fields (name and value texts) of every hit in a folder of :func:`write_clear_text_xml`, or with
    ``documents`` in whole clear-text files."""
    return _hits(_elements(spark, path, "hits", _HITS, documents))


def _hits(rows: DataFrame) -> DataFrame:
    every = rows.select(F.col("_selectorValue").alias("selector"), F.explode("hit").alias("hit"))
    none = F.array().cast("array<struct<name: string, value: string>>")
    return every.select("selector", F.coalesce("hit.field", none).alias("fields"))
