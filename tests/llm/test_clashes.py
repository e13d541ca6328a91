"""Operators that return whole rows leave columns alone whose names are like their own."""

from tessera.llm import bytecnn, mixing, pii, simhash
from tessera.llm.queries import ORACLES, QUERIES
from tests.oracle import connect, differ

NAMES = ["_row", "spans", "_spans_email", "_score", "score", "size", "_take", "_copy", "id", "_id", "fp", "component_id", "_kept", "root"]


def test_names_that_clash(spark):
    rows = [(i, f"text number {i} with a@b.c inside " * 3, "s", *[f"{n}{i}" for n in NAMES]) for i in range(6)]
    df = spark.createDataFrame(rows, ["doc_id", "text", "source", *NAMES])
    labels = spark.createDataFrame([(i, 1) for i in range(6)], "doc_id long, quality int")
    for out in (pii.redact(df), mixing.mixed_rows(df), simhash.keep_one(df), bytecnn.keep_good(df, labels)):
        got = out.collect()
        assert out.columns == df.columns and got
        assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in NAMES)


def test_sql_equivalents(spark, sf_dir):
    con = connect(sf_dir)
    for name, sql in ORACLES.items():
        assert differ(QUERIES[name](spark, sf_dir), con, sql) is None, name
