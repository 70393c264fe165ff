"""Codecs, schemes and the master property: a private run returns the plain answer."""

import datetime as dt
import random

import pytest

from veilquery.functions.values import Fields
from veilquery.operators.cipher import NullScheme, PaillierScheme, scheme_named
from veilquery.operators.records import decode_records, encode_record, read_varint, varint
from veilquery.plans import answer, private
from veilquery.schema import NULL_DEFAULTS, DataField, DataSchema, QueryField, QuerySchema
from veilquery.streaming import windows

DATA = DataSchema("t", tuple(DataField(n, t, k) for k, (n, t) in enumerate([("who", "string"), ("n", "int"), ("tags", "string_list"), ("at", "ISO8601Date"), ("ok", "boolean"), ("ord", "long")])))
SCHEMA = QuerySchema("q", DATA, "who", (QueryField("who"), QueryField("n"), QueryField("tags", 3, 2), QueryField("at"), QueryField("ok")))


def table(spark, n=60):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "c", "", None, "é"]), r.choice([None, 0, -5, 1 << 30]), r.choice([None, [], ["xyzzy", "q", "r"]]), dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), r.choice([True, False, None]), i) for i in range(n)]
    return spark.createDataFrame(rows, "who string, n int, tags array<string>, at timestamp, ok boolean, ord long")


def test_varint():
    for n in (0, 1, 127, 128, 300, 1 << 40):
        assert read_varint(varint(n), 0) == (n, len(varint(n)))


def test_record_round_trip_skips_gaps_and_other_selectors():
    fields = [("n", "long", False, None, None), ("s", "string", False, 4, None), ("l", "int", True, None, 2)]
    data = encode_record(fields, 7, [-3, "abcdef", [1, 2, 3]]) + b"\0\0\0" + encode_record(fields, 8, [1, "x", []]) + encode_record(fields, 7, [None, None, None])
    assert list(decode_records(fields, 7, data)) == [[-3, "abcd", [1, 2]], [0, "", []]]


def test_paillier_sums():
    scheme = PaillierScheme.generate(256)
    public = scheme.public()
    total = public.add(public.times(public.element(5), 7), public.times(public.element(0), 9))
    assert scheme.decrypt(public.add(total, public.element(4))) == 39
    with pytest.raises(ValueError):
        public.decrypt(total)


@pytest.mark.parametrize("scheme", [NullScheme(), PaillierScheme.generate(256)], ids=["null", "paillier"])
def test_private_run_returns_the_plain_answer(spark, scheme):
    rows = table(spark)
    query, key = private.encrypt_query(spark, SCHEMA, ["a", "é", "zz"], scheme, hash_bits=5, chunk_size=3)
    got = private.decrypt(private.respond(rows, query, "ord"), key).drop("result_set").collect()
    want = answer.answer(rows, SCHEMA, ["a", "é", "zz"]).collect()
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, (tuple(r) for r in want))) and want


def test_chunks_may_only_be_lowered(spark):
    rows = table(spark)
    query, key = private.encrypt_query(spark, SCHEMA, ["a", "b"], NullScheme(), hash_bits=5, chunk_size=6)
    got = private.decrypt(private.respond(rows, query, "ord", chunk_size=4), key, chunk_size=4).drop("result_set").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, map(tuple, answer.answer(rows, SCHEMA, ["a", "b"]).collect())))
    with pytest.raises(ValueError):
        private.respond(rows, query, "ord", chunk_size=7)
    for scheme, selectors, size in ((NullScheme(), ["a"], 17), (PaillierScheme.generate(256), list("abcdefgh"), 4)):
        with pytest.raises(ValueError):
            private.encrypt_query(spark, SCHEMA, selectors, scheme, hash_bits=8, chunk_size=size)
    assert scheme_named("null") == NullScheme() and scheme_named("paillier", bits=128).n.bit_length() in (127, 128)
    with pytest.raises(ValueError):
        scheme_named("none")


def test_every_type_is_encoded():
    values = {
        "byte": -7, "short": -300, "int": -(1 << 31), "long": (1 << 62) + 1, "float": 1.5, "double": -2.25, "boolean": True, "char": "é", "string": "üx", "byteArray": b"\x00\x01",
        "ip4": "10.0.0.255", "ip6": "fe80::1", "ISO8601Date": dt.datetime(2001, 7, 4, 14, 23, 31, 250000),
    }
    fields = [(k, k, False, None, None) for k in values] + [(f"{k}_l", k, True, None, 2) for k in values]
    data = encode_record(fields, 5, [*values.values(), *([v, v, v] for v in values.values())])
    assert list(decode_records(fields, 5, data)) == [[*values.values(), *([v, v] for v in values.values())]]
    nulls = [(k, k, False, None, None) for k in values if k != "ISO8601Date"]
    assert list(decode_records(nulls, 5, encode_record(nulls, 5, [None] * len(nulls)))) == [[NULL_DEFAULTS.get(k[0]) for k in nulls]]
    cut = [("b", "byteArray", False, 1, None), ("l", "string", True, 2, 1)]
    assert list(decode_records(cut, 5, encode_record(cut, 5, [b"xyz", ["abc", "d"]]))) == [[b"x", ["ab"]]]


def test_counters(spark):
    rows = table(spark)
    got = answer.run_counters(rows, SCHEMA, where=Fields(rows.schema)["n"] >= 0, most_hits=3, hash_bits=20).first().asDict()
    seen = rows.collect()
    passed = [r.who for r in seen if r.n is not None and r.n >= 0]
    full = {w: passed.count(w) for w in passed if w}
    over = sum(max(0, k - 3) for k in full.values())
    assert got == {
        "n_read": 60, "n_filtered": 60 - len(passed), "n_null_selectors": sum(not w for w in passed), "n_overflowed": over, "n_buckets_overflowed": sum(k > 3 for k in full.values()),
        "n_processed": sum(full.values()) - over,
    }
    assert set(answer.run_counters(rows.limit(0), SCHEMA).first()) == {0}


def test_hit_limit_is_per_bucket_and_needs_an_order(spark):
    rows = table(spark)
    got = answer.answer(rows, SCHEMA, ["a", "b"], most_hits=2, order_by=["ord"], hash_bits=20)
    assert sorted(r["count"] for r in got.groupBy("selector").count().collect()) == [2, 2]
    with pytest.raises(ValueError):
        answer.answer(rows, SCHEMA, ["a"], most_hits=2)


def test_schemas_are_checked():
    for bad in (
        lambda: DataSchema("x", (DataField("a", "int", 0), DataField("a", "int", 1))), lambda: DataSchema("x", (DataField("a", "int", 0), DataField("b", "int", 0))),
        lambda: QuerySchema("q", DATA, "who", (QueryField("n"),)), lambda: QuerySchema("q", DATA, "who", (QueryField("who"), QueryField("n", 3))),
    ):
        with pytest.raises(ValueError):
            bad()


def test_stream_lands_and_closed_windows_answer(spark, tmp_path):
    source = str(tmp_path / "in")
    table(spark).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    windows.land(stream, "at", 7200, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    landed = spark.read.parquet(str(tmp_path / "out"))
    assert landed.count() == 60 and landed.select("window_number").distinct().count() == 30
    query, key = private.encrypt_query(spark, SCHEMA, ["a"], NullScheme(), hash_bits=5)
    last = landed.agg({"window_number": "max"}).first()[0]
    got = private.decrypt(windows.respond_to_closed(landed, query, "ord", closed_before=last), key)
    assert got.count() == landed.where(f"who = 'a' and window_number < {last}").count()
    # windows whose records all fail the filter are there with an empty response, and each has its dated folder
    response = windows.respond_to_closed(landed, query, "ord", closed_before=last, where=Fields(landed.schema)["n"] > 1 << 31)
    every = windows.with_empty_windows(response, landed, closed_before=last)
    assert response.count() == 0 and every.count() == 29 and every.where("value is null").count() == 29
    windows.write_windows(every, 7200, str(tmp_path / "dated"))
    assert (tmp_path / "dated" / "year=2020" / "month=1" / "day=1" / "span=220000-000000").exists() is False
    assert (tmp_path / "dated" / "year=2020" / "month=1" / "day=2" / "span=220000-000000").exists()


def test_stream_runs_for_a_time(spark, tmp_path):
    stream = spark.readStream.format("rate").load()
    started = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).start()
    assert windows.run_for(started, 2) is False and not started.isActive


def test_sums_do_not_depend_on_the_columns_of_a_group(spark, monkeypatch):
    """Groups hold many columns, as a group costs far more than a chunk, but a bounded number of chunks."""
    from pyspark.sql import functions as F

    from veilquery import catalog

    assert private.columns_of_group(9) == 1024 and all(private.columns_of_group(b) << b <= max(1 << 19, 1 << b) for b in range(1, 21))
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    query, _ = private.encrypt_query(spark, catalog.ORDERS, catalog.WANTED, NullScheme(), hash_bits=9, chunk_size=5)
    sums = []
    for columns in (64, private.columns_of_group(9)):
        monkeypatch.setattr(private, "columns_of_group", lambda bits, n=columns: n)
        response = private.respond(orders, query, "o_orderkey", result_set=F.floor(F.col("o_orderkey") / 16384))
        sums.append(sorted((r[0], r[1], bytes(r[2])) for r in response.collect()))
    assert sums[0] == sums[1] and len(sums[0]) > 64
