"""Query, response and clear-text files in XML, there and back."""

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from veilquery.operators.cipher import NullScheme, PaillierScheme
from veilquery.plans import answer, private
from veilquery.schema import DataField, DataSchema, QueryField, QuerySchema
from veilquery.sources import xml_files

DATA = DataSchema("d", (DataField("who", "string", 0), DataField("n", "long", 1), DataField("tags", "string_list", 2)))
SCHEMA = QuerySchema("q", DATA, "who", (QueryField("who"), QueryField("n"), QueryField("tags", 3, 2)))
NAMES = {"query": "urn:q", "query_schema": "urn:s", "data_schema": "urn:d", "response": "urn:r", "clear_text": "urn:c"}


def table(spark, n=40):
    return spark.createDataFrame([("abc"[k % 3], k, ["x", f"long{k}"][: k % 3]) for k in range(n)], "who string, n long, tags array<string>")


def document(folder):
    """The part files of a folder, joined."""
    return ET.fromstring("".join(p.read_text() for p in sorted(folder.glob("part-*"))))


@pytest.mark.parametrize("scheme", [NullScheme(), PaillierScheme.generate(256)], ids=["null", "paillier"])
@pytest.mark.parametrize("names", [{}, NAMES], ids=["plain", "namespaces"])
def test_query_and_response(spark, tmp_path, scheme, names):
    rows = table(spark)
    made, key = private.encrypt_query(spark, SCHEMA, ["a", "b"], scheme, hash_bits=4, chunk_size=3)
    query = xml_files.query_from_xml(xml_files.query_to_xml(made, "7", "a & b", selectors=2, xmlns=names))
    assert query == made
    response = private.respond(rows, query, "n", result_set=F.floor(F.col("n") / 16))
    folder = tmp_path / "r"
    xml_files.write_response_xml(response, query, str(folder), "7", xmlns=names)
    for part in range(3):
        root = document(folder / f"result_set={part}")
        assert root.get("schemaVersion") == "2.0" and [e.tag.rpartition("}")[2] for e in root] == ["queryInfo", "resultSet"] and len(root[1])
        assert not names or root[0][0].tag == "{urn:q}queryId" and root[1][0].tag == "{urn:r}result"
    back = xml_files.read_response_xml(spark, str(folder))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, response.select(back.columns).collect()))
    got = private.decrypt(back, key).drop("result_set").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, answer.answer(rows, SCHEMA, ["a", "b"]).collect())))


def test_whole_response_document_and_empty_window(spark, tmp_path):
    query, _ = private.encrypt_query(spark, SCHEMA, ["a"], NullScheme(), hash_bits=3)
    response = spark.createDataFrame([(4, 0, b"\x01\xff"), (4, 9, b"\x05"), (5, None, None)], "result_set long, column long, value binary")
    xml_files.write_response_xml(response, query, str(tmp_path / "r"), "1")
    assert len(document(tmp_path / "r" / "result_set=5")[1]) == 0
    (tmp_path / "one.xml").write_bytes(ET.tostring(document(tmp_path / "r" / "result_set=4")))
    back = xml_files.read_response_xml(spark, str(tmp_path / "one.xml"), documents=True).collect()
    assert sorted(map(tuple, back)) == [(0, 0, b"\x01\xff"), (0, 9, b"\x05")]


def test_bad_query_files(spark):
    query, _ = private.encrypt_query(spark, SCHEMA, ["a"], NullScheme(), hash_bits=2)
    text = xml_files.query_to_xml(query, "1")
    for bad in (text.replace('"2.0"', '"1.0"'), text.replace(">null<", ">other<"), text.replace('key="3"', 'key="2"'), text.replace("queryElements", "elements"), text.replace("dataSchema", "data")):
        with pytest.raises(ValueError):
            xml_files.query_from_xml(bad)


def test_clear_text(spark, tmp_path):
    rows = spark.sql(
        "select 'a' as selector, 1L as n, ' x <&> ' as s, array('p', null, 'q\\u0001') as l, timestamp'2001-01-01 00:00:00' as t, cast('ab' as binary) as b, '' as e, 'two\\r\\nlines' as m "
        "union all select 'é \"', null, null, null, null, null, null, null union all select 'a', 2L, null, array(), null, null, null, null"
    )
    want = [
        ("a", [("n", "1"), ("s", " x <&> "), ("l", "p"), ("l", "q�"), ("t", "2001-01-01T00:00:00.000Z"), ("b", "YWI="), ("e", ""), ("m", "two\r\nlines")]), ("a", [("n", "2")]), ('é "', []),
    ]
    for names in ({}, NAMES):
        folder = tmp_path / f"c{len(names)}"
        xml_files.write_clear_text_xml(rows, SCHEMA, str(folder), "7", "name", xmlns=names)
        root = document(folder)
        assert [e.tag.rpartition("}")[2] for e in root] == ["queryName", "queryId", "selector"] and root[2].get("selectorName") == "who" and len(root[2]) == 3
        (tmp_path / f"{len(names)}.xml").write_bytes(b"".join(p.read_bytes() for p in sorted(folder.glob("part-*"))))
        for path, documents in ((folder, False), (tmp_path / f"{len(names)}.xml", True)):
            got = xml_files.read_clear_text_xml(spark, str(path), documents=documents).collect()
            assert sorted((r.selector, [tuple(f) for f in r.fields]) for r in got) == sorted(want), (names, documents)
    xml_files.write_clear_text_xml(rows.limit(0), SCHEMA, str(tmp_path / "none"), "7")
    assert len(document(tmp_path / "none")[2]) == 0 and xml_files.read_clear_text_xml(spark, str(tmp_path / "none")).count() == 0


def test_query_schema_from_xml():
    text = (
        "<s:querySchema xmlns:s='urn:s' xmlns:d='urn:d'><s:name> q </s:name><s:selectorField>who</s:selectorField><s:field><s:name>who</s:name></s:field><!-- none --><s:field><s:name>tags</s:name>"
        "<s:size>3</s:size><s:maxArrayElements>2</s:maxArrayElements></s:field><d:dataSchema><d:name>d</d:name><d:field><d:name>who</d:name><d:dataType>string</d:dataType><d:position>0</d:position></d:field>"
        "<d:field><d:name>tags</d:name><d:dataType>STRING_list</d:dataType><d:position>1</d:position></d:field></d:dataSchema></s:querySchema>"
    )
    schema = QuerySchema.from_xml(text)
    assert schema.name == "q" and schema.selector == "who" and schema.fields == (QueryField("who"), QueryField("tags", 3, 2)) and schema.data.struct().simpleString() == "struct<who:string,tags:array<string>>"
    with pytest.raises(ValueError):
        QuerySchema.from_xml(text.replace("<s:selectorField>who", "<s:selectorField>n"))
