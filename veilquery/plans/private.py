"""Private selector queries: encrypt the selectors, respond without learning them, decrypt.

The responding side is one declarative plan: filter, hash bucket, hit limit, record
encoding, chunks, column numbers, and a sum for each column.  A column has at most one
chunk of each bucket, so a column's group is bounded by 2**hash_bits; a result set (a
stream window, or a block of the order key) bounds the windows that number columns and
the groups that are decrypted, however hot a selector is.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilquery.functions.values import Value
from veilquery.operators.cipher import NullScheme, PaillierScheme
from veilquery.operators.columns import chunks, number_columns
from veilquery.operators.hashing import aux_hash, keyed_hash_of, row_hash
from veilquery.operators.records import decode_records, encode_record, layout
from veilquery.plans.answer import matching
from veilquery.schema import FIELD_TYPES, QuerySchema, field_type

Scheme = NullScheme | PaillierScheme


@dataclass(frozen=True)
class PrivateQuery:
    """What the responding side gets.  elements: one ciphertext for each of the 2**hash_bits buckets."""

    schema: QuerySchema
    hash_key: str
    hash_bits: int
    chunk_size: int
    scheme: Scheme
    elements: dict[int, int]


@dataclass(frozen=True)
class QueryKey:
    """What only the querying side has."""

    schema: QuerySchema
    selectors: tuple[str, ...]
    chunk_size: int
    scheme: Scheme


def encrypt_query(
    spark: SparkSession, schema: QuerySchema, selectors: list[str], scheme: Scheme, *, hash_bits: int = 9, chunk_size: int = 5, tries: int = 50
) -> tuple[PrivateQuery, QueryKey]:
    """Finds a hash key under which the selectors have buckets of their own, and encrypts one element a bucket."""
    own = tuple(dict.fromkeys(selectors))
    if not 1 <= len(own) <= 1 << hash_bits:
        raise ValueError("there must be between 1 and 2**hash_bits selectors")
    if not 1 <= chunk_size <= scheme.most_chunk_size(len(own)):
        raise ValueError(f"chunks of {len(own)} selectors have 1 to {scheme.most_chunk_size(len(own))} bytes")
    for _ in range(tries):
        key = secrets.token_hex(10)
        buckets = {keyed_hash_of(key, hash_bits, s): i for i, s in enumerate(own)}
        if len(buckets) == len(own):
            break
    else:
        raise ValueError("selectors collide; use more hash bits")
    public = scheme.public()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [public.element(1 << 8 * chunk_size * buckets[r] if r in buckets else 0) for r in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_bytes(c) for c in cells], pa.binary())], ["row", "element"])

    rows = spark.range(1 << hash_bits).mapInArrow(made, "row long, element binary").collect()  # 2**hash_bits of them
    query = PrivateQuery(schema, key, hash_bits, chunk_size, public, {r["row"]: int.from_bytes(r["element"], "big") for r in rows})
    return query, QueryKey(schema, own, chunk_size, scheme)


def _bytes(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8 or 1, "big")


def _encoded(schema: QuerySchema):
    fields = layout(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            aux = batch.column(batch.schema.get_field_index("_aux")).to_pylist()
            values = [batch.column(batch.schema.get_field_index(f[0])).to_pylist() for f in fields]
            out = [encode_record(fields, a, list(row)) for a, row in zip(aux, zip(*values, strict=True) if values else [()] * len(aux), strict=True)]
            keep = [c for c in batch.schema.names if c.startswith("_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(out, pa.binary())], [*keep, "_record"])

    return run


def cells(
    source: DataFrame, query: PrivateQuery, order_by: str, *, where: Value | None = None, most_hits: int | None = None, result_set: Column | None = None
) -> DataFrame:
    """result_set, column, row (bucket), chunk: everything that a response sums up; chunks of zeros say nothing and are left out."""
    schema = query.schema
    selector = F.col(f"`{schema.selector}`")
    rows = source.withColumn("_set", (result_set if result_set is not None else F.lit(0)).cast("long"))
    rows = matching(rows, schema, where=where, most_hits=most_hits, order_by=[order_by], hash_key=query.hash_key, hash_bits=query.hash_bits, within=("_set",))
    rows = rows.select(
        "_set", row_hash(query.hash_key, query.hash_bits, selector).alias("_row"), F.col(f"`{order_by}`").alias("_order"), aux_hash(selector).alias("_aux"),
        *(F.col(f"`{f[0]}`") for f in layout(schema)),
    )
    kept = T.StructType([f for f in rows.schema.fields if f.name.startswith("_")]).add("_record", T.BinaryType())
    rows = rows.mapInArrow(_encoded(schema), kept).withColumn("_chunks", chunks(F.col("_record"), query.chunk_size))
    rows = number_columns(rows, F.size("_chunks"), "_row", ["_order", "_record"], within=("_set",))
    pieces = rows.select("_set", "_row", "first_column", F.posexplode("_chunks").alias("k", "chunk"))
    return pieces.select(F.col("_set").alias("result_set"), (F.col("first_column") + F.col("k")).alias("column"), F.col("_row").alias("row"), "chunk").where(
        F.col("chunk") != F.lit(bytes(query.chunk_size))
    )


def lowered(query: PrivateQuery, chunk_size: int | None) -> PrivateQuery:
    """The query with smaller chunks; the responding side may only lower them.  The response must be decrypted with the same size."""
    if chunk_size is None:
        return query
    if not 1 <= chunk_size <= query.chunk_size:
        raise ValueError(f"the chunk size may only be lowered, from {query.chunk_size}")
    return replace(query, chunk_size=chunk_size)


def columns_of_group(hash_bits: int) -> int:
    """How many neighbouring columns are summed together: a group's own cost is far above a chunk's, and a group should hold
    at most 2**19 chunks (2**hash_bits where that is more)."""
    return min(1024, max(1, (1 << 19) >> hash_bits))


def respond(source: DataFrame, query: PrivateQuery, order_by: str, *, chunk_size: int | None = None, **options) -> DataFrame:
    """The response: result_set, column, value (the encrypted sum, big-endian)."""
    query = lowered(query, chunk_size)
    scheme = query.scheme
    sent = source.sparkSession.sparkContext.broadcast(query.elements)

    def summed(rows: pd.DataFrame) -> pd.DataFrame:
        totals, elements = {}, sent.value
        for column, row, chunk in zip(rows["column"].tolist(), rows["row"].tolist(), rows["chunk"], strict=True):
            own = scheme.times(elements[row], int.from_bytes(chunk, "big"))
            totals[column] = scheme.add(totals[column], own) if column in totals else own
        return pd.DataFrame({"result_set": [int(rows["result_set"].iloc[0])] * len(totals), "column": list(totals), "value": [_bytes(v) for v in totals.values()]})

    grouped = cells(source, query, order_by, **options).groupBy("result_set", F.floor(F.col("column") / columns_of_group(query.hash_bits)).alias("_block"))
    return grouped.applyInPandas(summed, "result_set long, column long, value binary")


def decrypt(response: DataFrame, key: QueryKey, *, chunk_size: int | None = None) -> DataFrame:
    """result_set, selector and the selected fields of every hit; records of other selectors of a bucket are dropped
    by their auxiliary hash.  Runs where the key may be.  ``chunk_size``: that of the response, if it was lowered."""
    scheme, own, step = key.scheme, key.selectors, key.chunk_size
    size = chunk_size or step
    fields = layout(key.schema)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for s, c, v in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                plain = scheme.decrypt(int.from_bytes(v, "big"))
                for i in range(len(own)):
                    chunk = (plain >> 8 * step * i & (1 << 8 * size) - 1).to_bytes(size, "big")
                    if any(chunk):
                        for column, x in zip(out, (s, i, c, chunk), strict=True):
                            column.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["result_set", "slot", "column", "chunk"]
            )

    def records(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("column")
        data = bytearray(size * (int(rows["column"].iloc[-1]) + 1))
        for c, chunk in zip(rows["column"].tolist(), rows["chunk"], strict=True):
            data[c * size : (c + 1) * size] = chunk
        selector = own[int(rows["slot"].iloc[0])]
        found = list(decode_records(fields, keyed_hash_of("aux", 32, selector), bytes(data)))
        columns = {f[0]: [r[k] for r in found] for k, f in enumerate(fields)}
        return pd.DataFrame({"result_set": [int(rows["result_set"].iloc[0])] * len(found), "selector": [selector] * len(found), **columns})

    schema = T.StructType([T.StructField("result_set", T.LongType()), T.StructField("selector", T.StringType())])
    for name, kind, is_list, _, _ in fields:
        schema.add(name, T.ArrayType(FIELD_TYPES[kind]) if is_list else FIELD_TYPES[kind])
    parts = response.select("result_set", "column", "value").mapInArrow(opened, "result_set long, slot int, column long, chunk binary")
    return parts.groupBy("result_set", "slot").applyInPandas(records, schema)
