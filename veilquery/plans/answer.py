"""The plain answer of a selector query: what a private run of the same query must return."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilquery.functions.values import Value
from veilquery.operators.columns import first_hits
from veilquery.operators.hashing import row_hash, selector_text
from veilquery.schema import FIELD_TYPES, NULL_DEFAULTS, QuerySchema, field_type


def projected(schema: QuerySchema, name: str, *, null_mode: str = "reference") -> Column:
    """A selected field as answers show it: cut to its size and number of elements, nulls replaced
    (``null_mode="preserve"`` keeps them)."""
    field = next(f for f in schema.fields if f.name == name)
    scalar, is_list = field_type(schema.data[name].type)
    c = F.col(f"`{name}`")
    cut = (lambda x: F.substring(x, 1, field.size)) if field.size else (lambda x: x)
    if is_list:
        out = F.slice(c, 1, field.max_elements) if field.max_elements else c
        out = F.transform(out, cut) if field.size else out
        default = F.array().cast(f"array<{FIELD_TYPES[scalar].simpleString()}>")
    else:
        out = cut(c)
        default = F.lit(NULL_DEFAULTS.get(scalar)).cast(FIELD_TYPES[scalar])
    return (out if null_mode == "preserve" else F.coalesce(out, default)).alias(name)


def matching(
    source: DataFrame, schema: QuerySchema, *, where: Value | None = None, most_hits: int | None = None,
    order_by: list[str] | None = None, hash_key: str = "", hash_bits: int = 12, within: tuple[str, ...] = (),
) -> DataFrame:
    """Rows that pass the filter and have a selector, limited to ``most_hits`` a hash bucket in the given order."""
    rows = source if where is None else source.where(where.truth())
    selector = F.col(f"`{schema.selector}`")
    rows = rows.where(F.trim(selector_text(selector)) != "")
    if most_hits is not None:
        if not order_by:
            raise ValueError("a hit limit needs an order")
        rows = first_hits(rows.withColumn("_bucket", row_hash(hash_key, hash_bits, selector)), most_hits, "_bucket", order_by, within=within).drop("_bucket")
    return rows


def run_counters(source: DataFrame, schema: QuerySchema, *, where: Value | None = None, most_hits: int | None = None, hash_key: str = "", hash_bits: int = 12) -> DataFrame:
    """One row on what a run does with its records: n_read, n_filtered (fail the filter), n_null_selectors (pass it, without a
    selector), n_overflowed (beyond ``most_hits`` of their bucket), n_buckets_overflowed, n_processed.  One pass: rows are
    counted by bucket, at most 2**hash_bits groups, before anything is shuffled."""
    selector = F.col(f"`{schema.selector}`")
    passes = where.truth() if where is not None else F.lit(True)
    blank = F.trim(selector_text(selector)) == ""
    bucket = F.when(passes & ~blank, row_hash(hash_key, hash_bits, selector))
    by = source.groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("n"), F.count_if(~passes).alias("filtered"), F.count_if(passes & blank).alias("blank")
    )
    over = F.greatest(F.col("n") - most_hits, F.lit(0)) if most_hits is not None else F.lit(0)
    over = F.when(F.col("bucket").isNotNull(), over).otherwise(0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return by.agg(
        total("n").alias("n_read"), total("filtered").alias("n_filtered"), total("blank").alias("n_null_selectors"), total(over).alias("n_overflowed"),
        F.count_if(over > 0).alias("n_buckets_overflowed"), total(F.when(F.col("bucket").isNotNull(), F.col("n") - over)).alias("n_processed"),
    )


def answer(source: DataFrame, schema: QuerySchema, selectors: list[str], *, null_mode: str = "reference", **options) -> DataFrame:
    """One row per hit: selector and the other selected fields.  The selectors are a query's own short list."""
    rows = matching(source, schema, **options)
    wanted = F.broadcast(source.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(selectors)], "selector string"))
    fields = [projected(schema, f.name, null_mode=null_mode) for f in schema.fields if f.name != schema.selector]
    return rows.join(wanted, selector_text(F.col(f"`{schema.selector}`")) == F.col("selector")).select("selector", *fields)


def hit_counts(source: DataFrame, schema: QuerySchema, selectors: list[str], **options) -> DataFrame:
    """Every selector with its number of hits, 0 included."""
    hits = answer(source, schema, selectors, **options).groupBy("selector").agg(F.count("*").alias("n"))
    wanted = source.sparkSession.createDataFrame([(s,) for s in dict.fromkeys(selectors)], "selector string")
    return wanted.join(hits, "selector", "left").select("selector", F.coalesce("n", F.lit(0)).alias("n_hits"))


def merged(*answers: DataFrame) -> DataFrame:
    """Answers of one query united: every hit with all its fields, and the number of hits of its selector (n_hits).
    The count is joined on, so that a selector with many hits is no group of its own."""
    rows = answers[0]
    for other in answers[1:]:
        rows = rows.unionByName(other)
    return rows.join(F.broadcast(rows.groupBy("selector").agg(F.count("*").alias("n_hits"))), "selector")
