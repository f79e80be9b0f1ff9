"""Small odd copies of the test tables: a row of nulls, repeated rows, further columns with clashing names, empty tables."""

import os

import pyarrow as pa
import pyarrow.parquet as pq

DATA = "/root/testdata/sf0.001"
CLASH = ("key", "unit", "record", "entity", "observation", "k", "n", "at", "there", "born", "gone", "reason", "label", "kind", "start", "found", "runs", "place", "ids", "part", "row", "items", "term", "score", "band", "value", "body_", "fp", "valid", "rec", "form")


def odd_tables(folder: str, rows: int | None) -> str:
    """Writes all tables with ``rows`` rows each (None: no rows) into ``folder``."""
    for f in os.listdir(DATA):
        t = pq.read_table(f"{DATA}/{f}")
        if rows is None:
            t = t.slice(0, 0)
        else:
            t = t.slice(0, rows)
            nulls = pa.table({n: pa.nulls(1, t.schema.field(n).type) for n in t.column_names})
            t = pa.concat_tables([t, nulls, t.slice(0, 3)])
        for c in CLASH:
            if c not in t.column_names:
                t = t.append_column(c, pa.array(["clash"] * len(t), pa.string()))
        pq.write_table(t, f"{folder}/{f}")
    return folder
