"""Compare a query with its DuckDB SQL on the generated tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sql, sf, frames=None):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, frame in (frames or {}).items():
        con.register(f"_{name}", frame)
        con.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM _{name}")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return names, cur.fetchall()


def norm(names, rows, digits=9):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: float(f"{v:.{digits}g}") if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def same(df, sql, sf, frames=None, digits=9):
    names, want = duck(sql, sf, frames)
    assert sorted(names) == sorted(df.columns)
    got = norm(df.columns, [tuple(r) for r in df.collect()], digits)
    want = norm(names, want, digits)
    assert len(got) == len(want), (len(got), len(want))
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, bad[:3]
