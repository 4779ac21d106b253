"""Results as sorted lists of plain rows, for comparison."""

import math


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if hasattr(value, "isoformat"):
        return value.isoformat().removesuffix("T00:00:00")
    return repr(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted([plain(r[n]) for n in names] for r in df.collect())


def duck_rows(connection, sql):
    result = connection.execute(sql)
    order = sorted(range(len(result.description)), key=lambda k: result.description[k][0])
    return [result.description[k][0] for k in order], sorted([plain(r[k]) for k in order] for r in result.fetchall())


def connection(sf_dir):
    import duckdb

    own = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        own.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return own
