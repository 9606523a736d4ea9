"""Every query of the subpackage against its SQL; those without SQL against the number of rows they must have."""

import pytest
from pyspark.sql import functions as F

from rangeloom.llm import plans

from ..oracle import assert_same, views

QUERIES, SQL = plans.queries(), plans.oracle_sql()
VALUED = "FROM bed_signal WHERE chrom IS NOT NULL AND val IS NOT NULL AND NOT isnan(val)"
#: SQL for the number of rows.
ROWS = {
    "p6_percentiles": f"SELECT count(*) FROM (SELECT DISTINCT track_id, chrom {VALUED})",
    "p6_chroms": f"SELECT count(DISTINCT chrom) {VALUED}",
    "p6_from_days": f"SELECT count(DISTINCT chrom) {VALUED}",
    "p7_ids": "SELECT count(*) FROM documents",
    "p9_perplexity": "SELECT count(*) FROM documents",
}


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in SQL:
        assert_same(df, con, SQL[name])
    elif name in ROWS:
        assert df.count() == con.execute(ROWS[name]).fetchone()[0]
    else:  # containers, and the documents that take more than one
        long = QUERIES["p7_ids"](spark, data).where(F.size("ids") > 8192).count()
        documents = con.execute("SELECT count(*) FROM documents").fetchone()[0]
        n = df.count()
        assert n == long if name == "p8_found" else n >= documents + long
