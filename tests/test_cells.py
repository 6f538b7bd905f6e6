import pathlib

import numpy as np
from pyspark.sql import functions as F

from claimcheck.operators import retrieval
from claimcheck.operators.cells import CellIndex


def frames(spark, rng, centers, n):
    """Vectors around a few directions, two sources; queries beside some of them."""
    rows = []
    for k in range(n):
        v = centers[k % len(centers)] + 0.15 * rng.standard_normal(16)
        rows.append(("ab"[k % 7 == 0], k, v.tolist(), f"t{k % 11}"))
    index = spark.createDataFrame(rows, "source string, passage_id long, embedding array<double>, tag string")
    asked = [(k, s, (np.array(v) + 0.05 * rng.standard_normal(16)).tolist(), t) for s, k, v, t in rows if k % 40 == 3]
    return index, spark.createDataFrame(asked, "qid long, source string, qvec array<double>, tag string")


def hits(frame):
    return sorted(tuple(r) for r in frame.select(*retrieval.HIT_COLUMNS).collect())


def test_appended_index_gives_the_hits_of_the_exact_join(spark, tmp_path):
    rng = np.random.default_rng(2)
    index, queries = frames(spark, rng, 3 * rng.standard_normal((12, 16)), 1200)
    kept = CellIndex(spark, f"{tmp_path}/index", cell_rows=60)
    kept.append(index.where("passage_id < 600 AND source = 'a'"), "one")
    kept.append(index.where("passage_id < 900 AND NOT (passage_id < 600 AND source = 'a')"), "two")
    kept.append(index.where("passage_id >= 900"), "three")
    kept.append(index.where("passage_id >= 900"), "three")  # run again
    options = {"k": 4, "threshold": 0.6, "exclude": [("tag", "tag")]}
    want = hits(retrieval.topk_join(queries, index, sources=["a", "b"], **options))
    assert len(want) > 50 and hits(kept.search(queries, **options)) == want
    assert 0 < kept.read <= kept.there


def test_cells_out_of_reach_are_not_read(spark, tmp_path):
    rng = np.random.default_rng(3)
    index, queries = frames(spark, rng, 5 * np.eye(16)[:10], 800)
    kept = CellIndex(spark, f"{tmp_path}/index", cell_rows=20)
    kept.append(index, "one")
    kept.append(index.withColumn("passage_id", F.col("passage_id") + 1000), "two")
    few = queries.where("source = 'a'").orderBy("qid").limit(1)
    options = {"k": 2, "threshold": 0.9}
    found = hits(kept.search(few, **options))
    both = index.union(index.withColumn("passage_id", F.col("passage_id") + 1000))
    assert found == hits(retrieval.topk_join(few, both, sources=["a", "b"], **options))
    assert kept.read < kept.there / 2
    # Files of other cells may be broken without being noticed.
    own = {r.cell for r in kept.rows().where("passage_id IN (%s)" % ",".join(str(x[2]) for x in found)).select("cell").collect()}
    broken = 0
    for path in pathlib.Path(f"{tmp_path}/index/rows").rglob("source=b/cell=*/*.parquet"):
        path.write_bytes(b"broken")
        crc = path.with_name(f".{path.name}.crc")
        crc.unlink(missing_ok=True)
        broken += 1
    assert own and broken and hits(kept.search(few, **options)) == found


def test_no_index_unfinished_batches_and_odd_rows(spark, tmp_path):
    schema = "source string, passage_id long, embedding array<double>, tag string"
    rows = [("a", 1, [1.0, 0.0], "x"), ("a", 2, [0.0, 0.0], "x"), (None, 3, [1.0, 0.0], "x"), ("a", None, [1.0, 0.0], "x"), ("a", 4, None, "x")]
    index = spark.createDataFrame(rows, schema)
    queries = spark.createDataFrame([(1, "a", [1.0, 0.0]), (2, "zzz", [1.0, 0.0]), (3, "a", None), (4, "a", [0.0, 0.0])], "qid long, source string, qvec array<double>")
    kept = CellIndex(spark, f"{tmp_path}/index", cell_rows=1)
    assert kept.search(queries).collect() == []
    kept.append(index, "one")
    (tmp_path / "index" / "ranges" / "batch=half").mkdir()
    found = {(r.qid, r.passage_id): r.score for r in kept.search(queries, 5, None).collect()}
    assert found == {(1, 1): 1.0, (1, 2): 0.0, (4, 1): 0.0, (4, 2): 0.0}
    kept.append(index.limit(0), "empty")
    assert len(kept.search(queries, 5, None).collect()) == 4
