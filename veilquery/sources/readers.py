"""JSON lines, JDBC and Kafka as typed rows of a data schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilquery.schema import FIELD_TYPES, DataSchema, field_type

#: Forms of an ISO 8601 date; no offset means UTC, a date alone means its first instant.
_MINUTES = r"^(\d{4}-\d{2}-\d{2})T(\d{2}:\d{2})(Z|[+-]\d{2}(?::?\d{2})?)?$"


def iso_timestamp(c: Column) -> Column:
    full = F.regexp_replace(c, r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00Z")
    full = F.regexp_replace(full, r"^(\d{4}-\d{2}-\d{2})T(\d{2})(Z|[+-].*)?$", "$1T$2:00:00$3")
    full = F.regexp_replace(full, _MINUTES, "$1T$2:00$3")
    full = F.when(full.rlike(r"(Z|[+-]\d{2}(:?\d{2})?)$"), full).otherwise(F.concat(full, F.lit("Z")))
    return F.regexp_replace(full, r"([+-]\d{2})(\d{2})$", "$1:$2").try_cast("timestamp")


def _path(name: str) -> str:
    return "$" + "".join(f"['{part}']" for part in name.split("|"))


def _leaf(text: Column, scalar: str) -> Column:
    if scalar == "ISO8601Date":
        return iso_timestamp(text)
    if scalar == "boolean":
        return F.when(text.isNotNull(), F.lower(text) == "true")
    if scalar == "byteArray":
        return text.cast("binary")
    return text.try_cast(FIELD_TYPES[scalar])


def _each(scalar: str):
    return lambda text: _leaf(text, scalar)


def json_fields(line: Column, schema: DataSchema) -> list[Column]:
    """The declared fields of a JSON text; nested ones are addressed by a path with ``|``, objects become JSON text."""
    out = []
    for f in schema.fields:
        scalar, is_list = field_type(f.type)
        raw = F.get_json_object(line, _path(f.name))
        if is_list:
            items = F.transform(F.from_json(F.concat(F.lit('{"a":'), raw, F.lit("}")), "a array<string>")["a"], _each(scalar))
            out.append(items.alias(f.name))
        else:
            out.append(_leaf(raw, scalar).alias(f.name))
    return out


def _bad(line: Column, schema: DataSchema) -> Column:
    """A line that is not a JSON object, or has a field that cannot become its type."""
    broken = F.try_parse_json(line).isNull() | ~F.ltrim(line).startswith("{")
    for f in schema.fields:
        scalar, is_list = field_type(f.type)
        raw = F.get_json_object(line, _path(f.name))
        if not is_list and scalar not in ("string", "char", "byteArray", "boolean"):
            broken = broken | (raw.isNotNull() & _leaf(raw, scalar).isNull())
    return F.coalesce(broken, F.lit(True))


def parsed_json(lines: DataFrame, schema: DataSchema, *, column: str = "value", on_error: str = "skip") -> DataFrame:
    """Typed rows of JSON texts.  Malformed records are skipped, or with ``on_error="fail"`` fail the query."""
    line = F.col(column)
    if on_error == "fail":
        lines = lines.withColumn(column, F.when(_bad(line, schema), F.raise_error(F.concat(F.lit("malformed record: "), line))).otherwise(line))
    else:
        lines = lines.where(~_bad(line, schema))
    return lines.select(*json_fields(line, schema), *(c for c in lines.columns if c != column))


def read_json_lines(spark: SparkSession, path: str, schema: DataSchema, **options) -> DataFrame:
    """A file, folder or pattern with one record a line; ``_file`` tells where a row is from."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"))
    return parsed_json(lines, schema, **options)


def read_jdbc(spark: SparkSession, url: str, query: str, schema: DataSchema, *, properties: dict[str, str] | None = None, **partitioning) -> DataFrame:
    """The result of an SQL query, its columns bound by position.  ``partitioning``: Spark's partitionColumn,
    lowerBound, upperBound and numPartitions, for a read in parallel."""
    options = {"url": url, **(properties or {})}
    if partitioning:
        options |= {"dbtable": f"({query}) q", **partitioning}
    else:
        options["query"] = query
    return bound_by_position(spark.read.format("jdbc").options(**options).load(), schema)


def bound_by_position(rows: DataFrame, schema: DataSchema) -> DataFrame:
    """Field with position k takes the k-th column."""
    columns = rows.columns
    out = []
    for f in schema.fields:
        scalar, _ = field_type(f.type)
        c = F.col(f"`{columns[f.position]}`")
        out.append((iso_timestamp(c.cast("string")) if scalar == "ISO8601Date" else c.cast(FIELD_TYPES[scalar])).alias(f.name))
    return rows.select(*out)


def read_kafka(spark: SparkSession, servers: str, topic: str, schema: DataSchema, *, start: str = "earliest", most_per_trigger: int | None = None) -> DataFrame:
    """A stream of JSON records with the broker's timestamp as ``_time``.  start: earliest or latest; a restart
    goes on from the query's checkpoint."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", start)
    if most_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", most_per_trigger)
    return parsed_json(reader.load().select(F.col("value").cast("string").alias("value"), F.col("timestamp").alias("_time")), schema)
