"""The stored vector index: equal to the exact scan, reads a part, recall of probing."""

import glob

import numpy as np
import pyarrow.parquet as pq

from corpusloom.operators import retrieval, vectorindex

SF = "/root/testdata/sf0.1"


def rows_read(df):
    """Rows that the scans of an executed query gave."""
    plan = df._jdf.queryExecution().executedPlan()
    df.collect()
    plan = plan.finalPhysicalPlan() if "Adaptive" in plan.getClass().getSimpleName() else plan
    leaves, total, todo = [], 0, [plan]
    while todo:
        node = todo.pop()
        if "QueryStage" in node.getClass().getSimpleName():
            node = node.plan()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
        if "FileSourceScan" in node.getClass().getSimpleName():
            leaves.append(node)
    for leaf in leaves:
        total += leaf.metrics().apply("numOutputRows").value()
    return total


def clustered(spark, n=6000, dim=24, topics=40):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(topics, dim))
    return spark.createDataFrame([(i, (centers[i % topics] + 0.25 * rng.normal(size=dim)).tolist()) for i in range(n)], "id long, v array<double>").repartition(4), centers


def exact(vectors, key, vector, q, k):
    query = vectors.sparkSession.createDataFrame([(q,)], "q array<double>")
    return [(r[0], round(r[1], 9)) for r in retrieval.nearest(vectors, key, vector, query, k).collect()]


def test_exact_and_reads_a_part(spark, tmp_path):
    vectors, centers = clustered(spark)
    index = vectorindex.write(vectors, "v", f"file://{tmp_path}/index", cells=40, row_group=1 << 14)
    groups = sum(pq.ParquetFile(f).metadata.num_row_groups for f in glob.glob(f"{tmp_path}/index/rows/*.parquet"))
    assert index.rows.count() == 6000 and groups > 20
    rng = np.random.default_rng(5)
    for i in range(4):
        q = (centers[7 * i] + 0.2 * rng.normal(size=24)).tolist()
        want = exact(vectors, "id", "v", q, 10)
        found = vectorindex.search(index, "id", "v", q, 10, probes=2)
        assert [(r[0], round(r[1], 9)) for r in found.collect()] == want
        assert rows_read(vectorindex.search(index, "id", "v", q, 10, probes=2)) < 3000 + 41
        few = vectorindex.probe(index, "id", "v", q, 10, probes=2)
        assert [(r[0], round(r[1], 9)) for r in few.collect()] == want and rows_read(few) < 2000


def test_bounds_hold(spark, tmp_path):
    vectors, centers = clustered(spark, 800)
    index = vectorindex.write(vectors, "v", f"file://{tmp_path}/index", cells=9)
    c = index.centers()
    rows = index.rows.collect()
    for r in rows:
        v = np.array(r.v) / np.linalg.norm(r.v)
        angles = np.arccos(np.clip(c.vectors @ v, -1, 1))
        at = c.numbers.tolist().index(r.cell)
        assert abs(angles[at] - r.angle) < 1e-7 and angles[at] <= angles.min() + 1e-9 and c.least[at] - 1e-12 <= r.angle <= c.most[at] + 1e-12
    q = np.array(rows[0].v) / np.linalg.norm(rows[0].v)
    for reach in (0.1, 0.5, 1.2):
        rings = {cell: (a, b) for cell, a, b in vectorindex.reachable(c, q, reach)}
        for r in rows:
            if np.arccos(min(1, q @ np.array(r.v) / np.linalg.norm(r.v))) <= reach:
                assert rings[r.cell][0] <= r.angle <= rings[r.cell][1]


def test_recall_at_ten(spark, tmp_path):
    """Vectors of the table, every 100th as a query, with the default share of cells."""
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    index = vectorindex.write(vectors, "embedding", f"file://{tmp_path}/index")
    rows = vectors.orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = total = 0
    for i in range(0, len(rows), 100):
        order = np.argsort(-(x @ x[i]), kind="stable")[:10]
        want = {rows[j].vec_id for j in order}
        got = {r.vec_id for r in vectorindex.probe(index, "vec_id", "embedding", [float(a) for a in rows[i].embedding], 10).collect()}
        hit, total = hit + len(want & got), total + 10
    assert hit / total >= 0.9, hit / total


def test_odd_rows(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 0.0]), (5, [-1.0, 0.0])]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    index = vectorindex.write(vectors, "v", f"file://{tmp_path}/a", cells=3)
    for q in ([1.0, 0.0], [0.0, 0.0], [0.3, -1.0]):
        for k in (2, 10):
            assert [(r[0], round(r[1], 9)) for r in vectorindex.search(index, "id", "v", q, k).collect()] == exact(vectors.where("v IS NOT NULL"), "id", "v", q, k)
    none = vectorindex.write(vectors.where("v IS NULL"), "v", f"file://{tmp_path}/b")
    assert vectorindex.search(none, "id", "v", [1.0, 0.0], 3).collect() == []
    flat = vectorindex.write(vectors.where("id = 2"), "v", f"file://{tmp_path}/c")
    assert [tuple(r) for r in vectorindex.search(flat, "id", "v", [1.0, 0.0], 3).collect()] == [(2, 1.0)]
    assert vectorindex.search(index, "id", "v", [1.0, 0.0], 3).columns == ["id", "distance"]
