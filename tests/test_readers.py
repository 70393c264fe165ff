"""JSON lines, dates and schemas from XML."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from veilquery.schema import DataField, DataSchema
from veilquery.sources.readers import iso_timestamp, read_json_lines

SCHEMA = DataSchema("t", (DataField("a|b.c", "int", 0), DataField("name", "string", 1), DataField("kids", "string_list", 2), DataField("a", "string", 3), DataField("when", "ISO8601Date", 4)))


def test_json_lines(spark, tmp_path):
    lines = ['{"a": {"b.c": "7"}, "name": "x", "kids": ["p", "q"], "when": "2001-07-04T14:23Z", "extra": 1}', '{"a": {"b.c": null}, "name": 5}', "not json", '{"a": {"b.c": "seven"}}', "[1]"]
    (tmp_path / "f.json").write_text("\n".join(lines))
    rows = read_json_lines(spark, str(tmp_path), SCHEMA).drop("_file").collect()
    assert [tuple(r) for r in rows] == [(7, "x", ["p", "q"], '{"b.c":"7"}', dt.datetime(2001, 7, 4, 14, 23)), (None, "5", None, '{"b.c":null}', None)]
    with pytest.raises(Exception, match="malformed record"):
        read_json_lines(spark, str(tmp_path), SCHEMA, on_error="fail").collect()


@pytest.mark.parametrize(
    ("text", "hour"),
    [("2001-07-04", 0), ("2001-07-04T14", 14), ("2001-07-04T14:23", 14), ("2001-07-04T14:23Z", 14), ("2001-07-04T14:23:31.250Z", 14), ("2001-07-04T14:23:31+05", 9), ("2001-07-04T14:23+0130", 12), ("2001-07-04T14:23:31-05:00", 19), ("4 July", None)],
)
def test_iso_dates(spark, text, hour):
    got = spark.range(1).select(iso_timestamp(F.lit(text)).alias("t")).first()["t"]
    assert (got and got.hour) == hour


def test_schema_from_xml():
    xml = '<s:dataSchema xmlns:s="urn:x"><s:name>p</s:name><s:field><s:name>a</s:name><s:dataType>INT</s:dataType><s:position>0</s:position></s:field></s:dataSchema>'
    assert DataSchema.from_xml(xml).struct().simpleString() == "struct<a:int>"
