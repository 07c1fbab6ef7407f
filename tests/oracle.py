"""Side-by-side comparison with DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd

SMALL = "/root/testdata/sf0.001"


def ask(sql: str, sf_dir: str = SMALL, **frames: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        if path.stem not in frames:
            con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    for name, frame in frames.items():
        con.register(name, frame)
    return con.execute(sql).fetch_df()


def same(left: pd.DataFrame, right: pd.DataFrame) -> None:
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    plain = lambda f: f[columns].astype(object).where(f[columns].notna(), None).sort_values(columns, key=lambda c: c.map(str)).reset_index(drop=True)
    a, b = plain(left), plain(right)
    assert len(a) == len(b)
    for c in columns:
        assert a[c].tolist() == b[c].tolist(), c
