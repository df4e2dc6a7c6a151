"""Queries of this subpackage by name and, where SQL can say the same, the SQL that checks them."""

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def register(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")
