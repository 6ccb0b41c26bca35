import math

import numpy as np
from pyspark.sql import functions as F

from sheafline.llm import related_splits as P
from sheafline.llm import similar_vectors as V


def clustered(n, seed=0, dims=96):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(n // 6, dims))
    return centers[rng.integers(len(centers), size=n)] + 0.25 * rng.normal(size=(n, dims))


def brute(x, k, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        for j in np.argsort(-s[i], kind="stable")[:k]:
            if s[i, j] >= least:
                out.add((i, int(j)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, vector array<float>").withColumn("cosine", F.lit(1)).withColumn("rank", F.lit("x"))


def test_recall_against_brute_force(spark):
    x = clustered(3000)
    rows = [(f"{i:05d}", v.tolist()) for i, v in enumerate(x)]
    got = {(int(r.id), int(r.other)) for r in V.neighbours(frame(spark, rows), 10, 0.85).collect()}
    want = brute(x.astype(np.float32), 10, 0.85)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


def test_neighbours_of_everything(spark):
    x = clustered(2000, 3)
    rows = [(f"{i:05d}", v.tolist()) for i, v in enumerate(x)]
    near = V.neighbours(frame(spark, rows), 10, probes=16)
    got = {(int(r.id), int(r.other)) for r in near.collect()}
    assert len(got & brute(x.astype(np.float32), 10, -1)) >= 0.9 * 20_000
    assert near.groupBy("id").count().agg(F.max("count")).first()[0] <= 10


def test_bad_equal_and_repeated_vectors(spark):
    x = clustered(60, 1)
    nan, inf = [math.nan] + [1.0] * 95, [math.inf] + [1.0] * 95
    rows = [(f"v{i:02d}", v.tolist()) for i, v in enumerate(x)]
    same = [(f"same{i:02d}", [1.0] * 96) for i in range(40)]
    bad = [("n", None), ("e", []), ("s", [1.0] * 48), ("z", [0.0] * 96), ("nan", nan), ("inf", inf), ("null", [None] + [1.0] * 95), (None, [1.0] * 96), ("long", [3.0] * 96), ("tiny", [1e-30] * 96)]
    near = V.neighbours(frame(spark, rows + same + bad + rows[:5] + same[:3]), 10, 0.85).collect()
    ids = {r.id for r in near} | {r.other for r in near}
    assert not ids & {"n", "e", "s", "z", "nan", "inf", "null", None} and {"same00", "same39", "long", "tiny"} <= ids
    of = [(r.rank, r.other) for r in near if r.id == "same20"]
    assert sorted(r for r, _ in of) == list(range(1, 11)) and len({o for _, o in of}) == 10 and "same20" not in {o for _, o in of}
    assert V.neighbours(frame(spark, [])).count() == 0 and V.neighbours(frame(spark, bad[:7])).count() == 0


def components(rows):
    """Plain union of streams and sources."""
    parent: dict = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for stream, source in rows:
        key = (source or "").strip().lower()
        find(("stream", stream))
        if key:
            parent[find(("stream", stream))] = find(("source", key))
    best: dict = {}
    for kind, name in list(parent):
        if kind == "source":
            root = find((kind, name))
            best[root] = min(best.get(root, name), name)
    return {s: best.get(find(("stream", s)), s) for s, _ in rows}


def test_groups_equal_a_plain_union(spark):
    chain = [(f"c{i}", f"z{i:03d}") for i in range(40)] + [(f"c{i}", f"z{i + 1:03d}") for i in range(40)]
    star = [("hub", f"s{i}") for i in range(30)] + [(f"leaf{i}", f" S{i} ") for i in range(30)]
    rows = chain + star + [("alone", None), ("blank", "  "), ("mixed", None), ("mixed", "Web"), ("web2", "web")] * 2
    df = spark.createDataFrame([(a, i, 1 - i % 2, b) for i, (a, b) in enumerate(rows)], "stream_id string, original_position int, boundary int, source string").withColumn("root", F.lit(1)).withColumn("unit", F.lit(2))
    got = {r.stream_id: r.group_key for r in P.stream_groups(df.unionByName(df.limit(1).withColumn("stream_id", F.lit(None).cast("string")))).collect()}
    assert got == components(rows)
    split = P.balanced_splits(df).collect()
    assert len(split) == len(got) and len({(r.group_key, r.split_name) for r in split}) == len(set(got.values()))


def test_shares_come_near_and_a_hot_group_stays_whole(spark):
    rows = [(f"s{i}", j, int(j == 0), f"src{i % 150}") for i in range(600) for j in range(1 + i % 5)]
    df = spark.createDataFrame(rows, "stream_id string, original_position int, boundary int, source string")
    n = df.join(P.balanced_splits(df), "stream_id").groupBy("split_name").count().toPandas().set_index("split_name")["count"] / len(rows)
    assert abs(n["train"] - 0.8) < 0.01 and abs(n["validation"] - 0.1) < 0.01 and abs(n["test"] - 0.1) < 0.01
    hot = df.withColumn("source", F.when(F.pmod(F.hash("stream_id"), F.lit(3)) == 0, "hot").otherwise(F.col("source")))
    assert P.balanced_splits(hot).where("group_key = 'hot'").select("split_name").distinct().count() == 1
    assert P.balanced_splits(df.limit(0)).count() == 0


def test_an_id_with_two_vectors_and_copies_on_both_sides(spark):
    x = clustered(80, 4)
    near = lambda v: (v + 0.05 * np.random.default_rng(9).normal(size=96)).tolist()
    v1, v2 = x[0].tolist(), x[1].tolist()
    rows = [(f"v{i:02d}", v.tolist()) for i, v in enumerate(x[2:])]
    rows += [("a_rep", v1), ("x_two", v1), ("x_two", v2), ("z_near", near(x[1])), ("y_scaled", (2 * x[0]).tolist())]
    pairs = {(r.id, r.other): r.cosine for r in V.neighbours(frame(spark, rows), 10, 0.85).collect()}
    assert {("x_two", "z_near"), ("z_near", "x_two"), ("x_two", "a_rep"), ("a_rep", "x_two"), ("a_rep", "y_scaled")} <= set(pairs)
    assert not {("a_rep", "z_near"), ("z_near", "a_rep"), ("x_two", "x_two")} & set(pairs)
    assert pairs["a_rep", "x_two"] == 1.0 and pairs["x_two", "z_near"] > 0.99


def test_exact_mode_and_split_tasks_equal_brute_force(spark, monkeypatch):
    x = clustered(1500, 6)
    rows = [(f"{i:05d}", v.tolist()) for i, v in enumerate(x)]
    monkeypatch.setattr(V, "TASK_ROWS", 300)  # several groups, split on both sides
    want = brute(x.astype(np.float32), 10, -1)
    for exact in (True, False):
        got = {(int(r.id), int(r.other)) for r in V.neighbours(frame(spark, rows), 10, exact=exact).collect()}
        assert len(got & want) >= (0.9999 if exact else 0.98) * len(want) and len(got) == len(want)
