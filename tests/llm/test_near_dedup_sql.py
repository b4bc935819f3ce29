"""The query of embedding near-dedup against its SQL on a table that holds links, chains, and vectors without part."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

from lumenfuse.llm.oracles import ORACLES
from lumenfuse.llm.queries import QUERIES


def test_query_equals_sql_with_links(spark, tmp_path):
    r = np.random.default_rng(5)
    rows = [(base + r.normal(size=64) * r.choice([0.0, 0.05, 0.14])).astype(np.float32).tolist() for base in r.normal(size=(60, 64)) for _ in range(r.integers(1, 8))]
    rows += [None, [0.0] * 64, [float("nan")] * 64, [None] * 64]
    label = [int(x) for x in r.integers(0, 2, len(rows))]
    label[3] = None
    pq.write_table(pa.table({"vec_id": pa.array(r.permutation(len(rows)), pa.int64()), "embedding": pa.array(rows, pa.list_(pa.float32())), "label": pa.array(label, pa.int32())}), f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    columns = "vec_id, n_links, component_id, kept"
    want = con.execute(f"select {columns} from ({ORACLES['op7_embedding_near_dedup']}) order by vec_id").fetchall()
    got = QUERIES["op7_embedding_near_dedup"](spark, str(tmp_path)).select(*columns.split(", ")).orderBy("vec_id").collect()
    assert [tuple(x) for x in got] == want
    assert sum(n for _, n, _, _ in want) > 100 and 40 < sum(k for *_, k in want) < len(rows)
