"""Every registered query of the engine against its SQL."""

import duckdb
import pytest

from veilquery import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def canonical(rows):
    def plain(v):
        if isinstance(v, float):
            return int(v) if v.is_integer() else round(v, 6)
        if isinstance(v, (list, tuple)):
            return [plain(x) for x in v]
        return str(v) if hasattr(v, "isoformat") else v

    return sorted(repr([plain(v) for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, name):
    db = duckdb.connect()
    db.execute("set TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DIR)
    found = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(got.columns) == sorted(names)
    assert canonical(got.select(*[f"`{n}`" for n in names]).collect()) == canonical(found.fetchall())


def test_division_by_zero_of_odd_prices(spark, tmp_path):
    """Null, zero, negative and non-finite prices over zero, and null discounts."""
    db = duckdb.connect()
    db.execute(
        "create table lineitem as select row_number() over ()::bigint as l_orderkey, 1::int as l_linenumber, p::double as l_extendedprice, d::double as l_discount "
        "from (values (null), ('0'), ('-7.5'), ('7.5'), ('nan'), ('inf'), ('-inf')) p(p), (values (null), ('0.05'), ('0'), ('0.06'), ('nan')) d(d)"
    )
    db.execute(f"copy lineitem to '{tmp_path}/lineitem.parquet' (format parquet)")
    got = catalog.QUERIES["math_divide_by_zero"](spark, str(tmp_path)).select("l_orderkey", "l_linenumber", "result").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, db.execute(catalog.ORACLE_SQL["math_divide_by_zero"]).fetchall()))
