"""Compare a query with its DuckDB SQL on the generated tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def _fix(v, digits):
    if v is None or isinstance(v, (str, bool)):
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_fix(x, digits) for x in v)
    try:
        v = float(v)
    except (TypeError, ValueError):
        return str(v)
    return 0.0 if abs(v) < 1e-9 else float(f"{v:.{digits}g}")


def same(df, sql, sf, digits=7):
    names, want = duck(sql, sf)
    got = [tuple(r) for r in df.collect()]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    order = lambda cols: sorted(range(len(cols)), key=lambda i: cols[i])
    norm = lambda rows, cols: sorted((tuple(_fix(r[i], digits) for i in order(cols)) for r in rows), key=str)
    a, b = norm(got, df.columns), norm(want, names)
    assert len(a) == len(b), (len(a), len(b))
    close = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 10.0 ** (2 - digits) * max(abs(x), abs(y), 1e-9))
    bad = [(x, y) for x, y in zip(a, b) if not all(close(p, q) for p, q in zip(x, y))]
    assert not bad, bad[:3]
