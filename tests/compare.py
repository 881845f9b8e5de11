"""Rows of Spark and DuckDB results in one form."""

import math


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    return str(v)


def rows(found, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in found)


def same(spark_df, relation):
    assert sorted(spark_df.columns) == sorted(relation.columns)
    assert rows([tuple(r) for r in spark_df.collect()], spark_df.columns) == rows(relation.fetchall(), relation.columns)
