"""The registered queries of the private-selector engine and their plain SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilquery.functions.values import Fields, Value, avg_of, count_of, max_of, min_of, now, sum_of, today, value
from veilquery.operators.cipher import NullScheme, PaillierScheme
from veilquery.operators.columns import first_hits, number_columns
from veilquery.operators.hashing import aux_hash, row_hash
from veilquery.plans import answer as plain
from veilquery.plans import private
from veilquery.schema import DataField, DataSchema, QueryField, QuerySchema
from veilquery.sources.readers import bound_by_position, iso_timestamp, parsed_json
from veilquery.sources.xml_files import clear_text_hits, clear_text_lines, query_from_xml, query_to_xml
from veilquery.streaming.windows import window_hits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def _schema(name: str, selector: str, **fields: str | tuple) -> QuerySchema:
    """fields: type, or (type, size, most elements)."""
    data = DataSchema(name, tuple(DataField(f, t if isinstance(t, str) else t[0], k) for k, (f, t) in enumerate(fields.items())))
    return QuerySchema(name, data, selector, tuple(QueryField(f, *(() if isinstance(t, str) else t[1:])) for f, t in fields.items()))


ORDERS = _schema("orders", "o_orderpriority", o_orderpriority="string", o_orderkey="long", o_totalprice="double", o_orderstatus=("string", 1), o_orderdate="ISO8601Date")
WANTED = ["1-URGENT", "2-HIGH"]
_ORDER_COLUMNS = "o_orderpriority as selector, o_orderkey, o_totalprice, left(o_orderstatus, 1) as o_orderstatus, o_orderdate"
_WANTED_SQL = "('1-URGENT', '2-HIGH')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _filter(name: str, table: str, keys: str, condition: Callable[[Fields], Value], where: str) -> None:
    """Registers the rows of a table that pass a filter."""
    columns = keys.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table)
        return rows.where(condition(Fields(rows.schema)).truth()).select(*columns)

    _query(name, f"select {', '.join(columns)} from {table} where {where}")(run)


def _compute(name: str, table: str, keys: str, made: Callable[[Fields], Value], sql: str) -> None:
    """Registers a value computed for every row."""
    columns = keys.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _table(spark, sf_dir, table)
        return rows.select(*columns, made(Fields(rows.schema)).column.alias("result"))

    _query(name, f"select {', '.join(columns)}, {sql} as result from {table}")(run)


@_query("flagship", f"select {_ORDER_COLUMNS} from orders where o_orderpriority in {_WANTED_SQL} and o_totalprice > 100000")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return plain.answer(orders, ORDERS, WANTED, where=Fields(orders.schema)["o_totalprice"] > 100000)


@_query("sel_semi_join", f"select {_ORDER_COLUMNS} from orders where o_orderpriority in {_WANTED_SQL}")
def sel_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.answer(_table(spark, sf_dir, "orders"), ORDERS, WANTED)


@_query(
    "sel_left_outer_counts",
    "select s as selector, count(o_orderkey) as n_hits from (values ('1-URGENT'), ('2-HIGH'), ('9-NONE')) v(s) left join orders on o_orderpriority = s group by s",
)
def sel_left_outer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.hit_counts(_table(spark, sf_dir, "orders"), ORDERS, [*WANTED, "9-NONE"])


_LINE = "l_orderkey l_linenumber"
_filter(
    "flt_and_or_not", "lineitem", _LINE,
    lambda f: (f["l_quantity"] > 45) & ~(f["l_returnflag"] == "R") | (f["l_discount"] >= 0.09) & (f["l_tax"] < 0.02),
    "(l_quantity > 45 and not l_returnflag = 'R') or (l_discount >= 0.09 and l_tax < 0.02)",
)
_filter("flt_compare_num", "lineitem", _LINE, lambda f: (f["l_quantity"] >= 10) & (f["l_quantity"] <= 12) & (f["l_extendedprice"] > f["l_quantity"] * 1500.5), "l_quantity >= 10 and l_quantity <= 12 and l_extendedprice > l_quantity::double * 1500.5")
_filter("flt_compare_str", "part", "p_partkey p_brand", lambda f: f["p_brand"] > "Brand#3", "p_brand > 'Brand#3'")
_filter("flt_compare_ts", "orders", "o_orderkey", lambda f: (f["o_orderdate"] >= dt.datetime(1995, 1, 1)) & (f["o_orderdate"] < dt.datetime(1996, 7, 4, 14, 23)), "o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-07-04 14:23:00'")
_filter("flt_not_equal", "orders", "o_orderkey", lambda f: f["o_orderstatus"] != "P", "o_orderstatus is distinct from 'P'")
_filter("flt_empty", "documents", "doc_id", lambda f: f["text"].is_empty() | (f["lang"] == "es"), "text = '' or text is null or lang = 'es'")
_filter("flt_not_empty", "embeddings", "vec_id", lambda f: f["embedding"].is_not_empty() & (f["label"] == 3), "len(embedding) > 0 and label = 3")
_filter("flt_matches", "part", "p_partkey p_name", lambda f: f["p_name"].matches("[a-m].*[0-9]*"), "regexp_full_match(p_name, '[a-m].*[0-9]*')")
_filter("flt_in_list", "orders", "o_orderkey", lambda f: f["o_orderpriority"].is_in(["1-URGENT", "5-LOW"]), "o_orderpriority in ('1-URGENT', '5-LOW')")
_filter("flt_in_substring", "documents", "doc_id", lambda f: value("Licensed").is_in(f["text"]), "contains(text, 'Licensed')")
_filter("flt_in_list_field", "embeddings", "vec_id", lambda f: f["label"].is_in([f["vec_id"] % 7, 3]), "label in (vec_id % 7, 3)")
_filter("flt_truthy_number", "supplier", "s_suppkey", lambda f: f["s_nationkey"] & f["s_name"], "s_nationkey <> 0 and s_name <> ''")

_filter("flt_current_time", "events", "event_id", lambda f: (f["ts"] < now()) & ~(f["ts"] >= today()) & (f["value"] > 50), "ts < now()::timestamp and ts < current_date and value > 50")


def _with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").withColumn("status", F.expr("nullif(o_orderstatus, 'P')"))


_NULLS_SQL = "select o_orderkey from (select *, nullif(o_orderstatus, 'P') as status from orders) where "


@_query("flt_eq_null", _NULLS_SQL + "status is null")
def flt_eq_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_nulls(spark, sf_dir)
    return rows.where((Fields(rows.schema)["status"] == None).truth()).select("o_orderkey")  # noqa: E711


@_query("flt_is_not_null", _NULLS_SQL + "status is not null")
def flt_is_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_nulls(spark, sf_dir)
    return rows.where((Fields(rows.schema)["status"] != None).truth()).select("o_orderkey")  # noqa: E711


@_query("flt_null_compare", _NULLS_SQL + "status is distinct from 'F' and not coalesce(status > 'F', false)")
def flt_null_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_nulls(spark, sf_dir)
    status = Fields(rows.schema)["status"]
    return rows.where(((status != "F") & ~(status > "F")).truth()).select("o_orderkey")


def _price_by_discount(f: Fields) -> Value:
    """Over zero every price counts as a positive one, as in the SQL: null, zero and negative prices give infinity too."""
    by = f["l_discount"] - 0.05
    return Value(F.when((by == 0).truth(), (value(0.5) / by).column).otherwise((f["l_extendedprice"] / by).column), "double")


_compute("math_operators", "lineitem", _LINE, lambda f: f["l_extendedprice"] * 0.5 - f["l_tax"] / 0.25, "l_extendedprice * 0.5::double - l_tax / 0.25::double")
_compute("math_integral_contagion", "lineitem", _LINE, lambda f: f["l_extendedprice"] + f["l_orderkey"], "trunc(l_extendedprice)::bigint + l_orderkey")
_compute("math_divide_integral", "lineitem", _LINE, lambda f: (f["l_orderkey"] / 7) + (f["l_partkey"] % 5), "l_orderkey // 7 + l_partkey % 5")
_compute("math_divide_by_zero", "lineitem", _LINE, _price_by_discount, "case when l_discount = 0.05 then 'Infinity'::double else l_extendedprice / (l_discount - 0.05::double) end")
_compute("sqrt", "customer", "c_custkey", lambda f: f["c_custkey"].sqrt(), "sqrt(c_custkey::double)")
_compute("concat_null", "orders", "o_orderkey", lambda f: f["o_orderpriority"].concat("/").concat(f["o_orderkey"]).concat(None), "o_orderpriority || '/' || o_orderkey::varchar || 'null'")
_compute("char_length", "documents", "doc_id", lambda f: f["text"].char_length(), "length(text)")
_compute("list_count", "embeddings", "vec_id", lambda f: count_of(f["embedding"], 5, [1, 2]), "len(embedding) + 3")
_compute("list_max", "embeddings", "vec_id", lambda f: max_of(f["embedding"]), "list_max(embedding)::double")
_compute("list_min", "embeddings", "vec_id", lambda f: min_of(f["embedding"]), "list_min(embedding)::double")
_compute("list_sum", "lineitem", _LINE, lambda f: sum_of([1, 2], f["l_orderkey"], f["l_extendedprice"]), "3 + l_orderkey + trunc(l_extendedprice)::bigint")
_compute("list_avg", "lineitem", _LINE, lambda f: avg_of(f["l_orderkey"], f["l_partkey"], 4), "(l_orderkey + l_partkey + 4) // 3")

DOCS = _schema("documents", "lang", lang="string", doc_id="long", text=("string", 20), source="string")
VECTORS = _schema("embeddings", "label", label="int", vec_id="long", embedding=("float_list", None, 3))
CUSTOMERS = _schema("customer", "c_mktsegment", c_mktsegment="string", c_custkey="long", c_name=("string", 12), c_nationkey="int", c_acctbal="double")


@_query("proj_truncate", "select lang as selector, doc_id, left(text, 20) as text, source from documents where lang in ('fr', 'de')")
def proj_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.answer(_table(spark, sf_dir, "documents"), DOCS, ["fr", "de"])


@_query("proj_list_cap", "select '3' as selector, vec_id, embedding[1:3] as embedding from embeddings where label = 3")
def proj_list_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain.answer(_table(spark, sf_dir, "embeddings"), VECTORS, ["3"])


@_query(
    "proj_null_defaults",
    "select c_mktsegment as selector, c_custkey, left(coalesce(nullif(c_name, 'Customer#000000007'), ''), 12) as c_name, coalesce(nullif(c_nationkey, 3), 0) as c_nationkey, c_acctbal "
    "from customer where c_mktsegment = 'BUILDING'",
)
def proj_null_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").withColumns({"c_name": F.expr("nullif(c_name, 'Customer#000000007')"), "c_nationkey": F.expr("nullif(c_nationkey, 3)")})
    return plain.answer(rows, CUSTOMERS, ["BUILDING"])


_BUCKET = "(('0x' || substr(md5('k1' || o_orderpriority), 1, 8))::bigint & 511)::int"


@_query("row_hash", "select c_custkey, (('0x' || substr(md5('k1' || c_name), 1, 8))::bigint & 4095)::int as row_hash from customer")
def row_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", row_hash("k1", 12, F.col("c_name")).alias("row_hash"))


@_query("aux_hash", "select c_custkey, (case when h >= 2147483648 then h - 4294967296 else h end)::int as aux from (select c_custkey, ('0x' || substr(md5('aux' || c_name), 1, 8))::bigint as h from customer)")
def aux_hash_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "customer").select("c_custkey", aux_hash(F.col("c_name")).alias("aux"))


@_query("max_hits_per_bucket", f"select o_orderkey from (select o_orderkey, row_number() over (partition by {_BUCKET} order by o_orderkey) as r from orders) where r <= 50")
def max_hits_per_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").withColumn("b", row_hash("k1", 9, F.col("o_orderpriority")))
    return first_hits(rows, 50, "b", ["o_orderkey"]).select("o_orderkey")


_CHUNKS_SQL = (
    "select o_orderkey, s, b, n, coalesce(sum(n) over (partition by s, b order by o_orderkey rows between unbounded preceding and 1 preceding), 0)::bigint as first_column "
    f"from (select o_orderkey, o_orderkey // 8192 as s, {_BUCKET} as b, (length(o_orderpriority) + 4) // 5 as n from orders)"
)


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-byte chunks of the priority, numbered within blocks of the order key."""
    rows = _table(spark, sf_dir, "orders").select(
        "o_orderkey", F.floor(F.col("o_orderkey") / 8192).alias("s"), row_hash("k1", 9, F.col("o_orderpriority")).alias("b"),
        F.ceil(F.octet_length("o_orderpriority") / 5).alias("n"),
    )
    return number_columns(rows, F.col("n"), "b", ["o_orderkey"], within=("s",))


@_query("column_numbering", f"select o_orderkey, first_column from ({_CHUNKS_SQL})")
def column_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _numbered(spark, sf_dir).select("o_orderkey", "first_column")


@_query("column_load", f'select s, c as "column", count(*) as n_cells from (select s, unnest(range(first_column, first_column + n)) as c from ({_CHUNKS_SQL})) group by s, c')
def column_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _numbered(spark, sf_dir).select("s", F.explode(F.sequence("first_column", F.col("first_column") + F.col("n") - 1)).alias("column"))
    return cells.groupBy("s", "column").agg(F.count("*").alias("n_cells"))


@_query("pir_null_roundtrip", f"select {_ORDER_COLUMNS} from orders where o_orderpriority in {_WANTED_SQL} and o_totalprice > 100000")
def pir_null_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    query, key = private.encrypt_query(spark, ORDERS, WANTED, NullScheme(), hash_bits=9, chunk_size=5)
    response = private.respond(orders, query, "o_orderkey", where=Fields(orders.schema)["o_totalprice"] > 100000, result_set=F.floor(F.col("o_orderkey") / 16384))
    return private.decrypt(response, key).drop("result_set")


NATIONS = _schema("nation", "n_regionkey", n_regionkey="int", n_nationkey="int", n_name="string")


@_query("pir_paillier_roundtrip", "select n_regionkey::varchar as selector, n_nationkey, n_name from nation where n_regionkey in (1, 3)")
def pir_paillier_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    query, key = private.encrypt_query(spark, NATIONS, ["1", "3"], PaillierScheme.generate(384), hash_bits=6, chunk_size=4)
    return private.decrypt(private.respond(_table(spark, sf_dir, "nation"), query, "n_nationkey"), key).drop("result_set")


@_query("query_xml_roundtrip", "select n_nationkey::varchar as selector, n_regionkey, n_name from nation where n_nationkey in (3, 7, 24)")
def query_xml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = _schema("nation", "n_nationkey", n_nationkey="int", n_regionkey="int", n_name="string")
    query, key = private.encrypt_query(spark, schema, ["3", "7", "24"], PaillierScheme.generate(384), hash_bits=7, chunk_size=4)
    read = query_from_xml(query_to_xml(query, "1", "nations"))
    return private.decrypt(private.respond(_table(spark, sf_dir, "nation"), read, "n_nationkey"), key).drop("result_set")


@_query(
    "clear_text_xml",
    "select c_mktsegment as selector, c_custkey::varchar as c_custkey, left(c_name, 12) as c_name, c_nationkey::varchar as c_nationkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')",
)
def clear_text_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = clear_text_lines(plain.answer(_table(spark, sf_dir, "customer"), CUSTOMERS, ["BUILDING", "MACHINERY"]))
    fields = F.map_from_entries("fields")
    return clear_text_hits(lines).select("selector", *(fields[c].alias(c) for c in ("c_custkey", "c_name", "c_nationkey")))


@_query("json_flatten", "select event_id, json_extract_string(props, '$.k')::int as k from events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = DataSchema("props", (DataField("k", "int", 0),))
    return parsed_json(_table(spark, sf_dir, "events").select("event_id", "props"), schema, column="props").select("event_id", "k")


@_query("iso_dates", "select o_orderkey, o_orderdate as minute_form, date_trunc('day', o_orderdate) as day_form from orders")
def iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders")
    shown = lambda form: iso_timestamp(F.date_format("o_orderdate", form))
    return rows.select("o_orderkey", shown("yyyy-MM-dd'T'HH:mm:ss'Z'").alias("minute_form"), shown("yyyy-MM-dd").alias("day_form"))


@_query("bound_by_position", "select n_nationkey::bigint as id, n_name as label from nation")
def positional(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = DataSchema("nation", (DataField("id", "long", 0), DataField("label", "string", 1)))
    return bound_by_position(_table(spark, sf_dir, "nation"), schema)


@_query(
    "tumbling_window_hits",
    "select time_bucket(interval '60 seconds', ts) as window_start, time_bucket(interval '60 seconds', ts) + interval '60 seconds' as window_end, count(*) as n_records, "
    "count(*) filter (event_type in ('click', 'error') and value > 10) as n_hits from events group by all",
)
def tumbling_window_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return window_hits(rows, "ts", 60, "event_type", ["click", "error"], where=Fields(rows.schema)["value"] > 10)


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return plain.merged(*(plain.answer(orders.where(F.col("o_orderkey") % 2 == k), ORDERS, WANTED) for k in (0, 1)))


@_query(
    "run_counters",
    f"select sum(n)::bigint as n_read, sum(f)::bigint as n_filtered, 0::bigint as n_null_selectors, sum(over)::bigint as n_overflowed, count(*) filter (over > 0) as n_buckets_overflowed, "
    f"sum(n - f - over)::bigint as n_processed from (select {_BUCKET} as b, count(*) as n, count(*) filter (o_totalprice <= 100000) as f, "
    f"greatest(count(*) filter (o_totalprice > 100000) - 120, 0) as over from orders group by 1)",
)
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = _table(spark, sf_dir, "orders")
    return plain.run_counters(orders, ORDERS, where=Fields(orders.schema)["o_totalprice"] > 100000, most_hits=120, hash_key="k1", hash_bits=9)


@_query("response_merge", f"select o_orderpriority as selector, count(*) as n_hits from orders where o_orderpriority in {_WANTED_SQL} group by 1")
def response_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir).select("selector", "n_hits").distinct()


@_query("response_merge_hits", f"select {_ORDER_COLUMNS}, count(*) over (partition by o_orderpriority) as n_hits from orders where o_orderpriority in {_WANTED_SQL}")
def response_merge_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _merged(spark, sf_dir)
