"""Nearest neighbours: blocks, ties, exclusions, unusable vectors, a stored index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfstream.operators import retrieval as R


def vectors(spark, name, matrix, first=0):
    return spark.createDataFrame(
        [(first + i, [float(x) for x in row]) for i, row in enumerate(matrix)], f"{name} long, vector array<float>"
    )


def brute(users, items, k, barred=()):
    out = set()
    for u, x in enumerate(users):
        scored = sorted((-float(np.float64(x) @ np.float64(y)), t) for t, y in enumerate(items) if (u, t) not in barred)
        out |= {(u, t, n) for n, (_, t) in enumerate(scored[:k], 1)}
    return out


def positions(found):
    return {(r.user_id, r.token_id, r.position) for r in found.collect()}


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    items = np.round(rng.normal(size=(90, 4)), 1).astype(np.float32)
    items[30:60] = items[30]  # a third of the items are one vector
    return np.round(rng.normal(size=(23, 4)), 1).astype(np.float32), items


@pytest.mark.parametrize("block", [None, 100, 7])
def test_exact_top_k_equals_brute_force(spark, data, monkeypatch, block):
    users, items = data
    monkeypatch.setattr(R, "SCORES_BYTES", 2_000)
    barred = {(u, t) for u in range(23) for t in range(90) if (u * 7 + t) % 5 == 0}
    hidden = spark.createDataFrame(sorted(barred), "user_id long, token_id long")
    u, i = vectors(spark, "user_id", users), vectors(spark, "token_id", items)
    assert positions(R.exact_top_k(u, i, 8, block=block)) == brute(users, items, 8)
    assert positions(R.exact_top_k(u, i, 8, hidden, block)) == brute(users, items, 8, barred)
    # Fewer items than asked for, or none at all.
    all_but_two = spark.range(23).withColumnRenamed("id", "user_id").crossJoin(spark.range(2, 90).withColumnRenamed("id", "token_id"))
    assert positions(R.exact_top_k(u, i, 8, all_but_two, block)) == brute(users, items[:2], 8)
    assert R.exact_top_k(u, i.limit(0), 3, block=block).count() == 0
    assert R.exact_top_k(u.limit(0), i, 3, block=block).count() == 0


@pytest.mark.parametrize("block", [None, 7])
def test_items_of_the_users_own_kind_need_no_list(spark, data, block):
    # A list of pairs was made for them, which grows with the square of the table.
    users, items = data
    kind = lambda key: F.when(F.col(key) % 5 < 4, F.col(key) % 5)
    u = vectors(spark, "user_id", users).withColumn("m", kind("user_id"))
    i = vectors(spark, "token_id", items).withColumn("m", kind("token_id"))
    barred = {(u, t) for u in range(23) for t in range(90) if u % 5 == t % 5 < 4}
    assert positions(R.exact_top_k(u, i, 8, block=block, apart="m")) == brute(users, items, 8, barred)
    hidden = spark.createDataFrame([(u, t) for u in range(23) for t in range(0, 90, 4)], "user_id long, token_id long")
    both = barred | {(u, t) for u in range(23) for t in range(0, 90, 4)}
    assert positions(R.exact_top_k(u, i, 8, hidden, block, "m")) == brute(users, items, 8, both)


def test_only_lists_are_shuffled(spark, data):
    users, items = data
    found = R.exact_top_k(vectors(spark, "user_id", users), vectors(spark, "token_id", items), 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert len(exchanges) == 1 and "hashpartitioning(user_id" in exchanges[0]
    assert "vector" not in exchanges[0] and "MapInPandas" in plan


@pytest.mark.parametrize("way", ["exact", "cells", "index"])
def test_unusable_vectors_take_no_part(spark, data, tmp_path, way):
    users, items = data
    odd = [(900, None), (901, []), (902, [1.0, None, 0.0, 0.0]), (903, [float("nan")] * 4)]
    u = vectors(spark, "user_id", users).unionByName(spark.createDataFrame(odd, "user_id long, vector array<float>"))
    i = vectors(spark, "token_id", items).unionByName(spark.createDataFrame(odd, "token_id long, vector array<float>"))
    if way == "exact":
        found = R.exact_top_k(u, i, 6)
    elif way == "cells":
        found = R.approximate_top_k(u, i, 6, cells=3, probes=3, block=16)
    else:
        found = R.CellIndex(spark, str(tmp_path)).build(i, cells=3).top_k(u, 6, probes=3, block=16)
    assert positions(found) == brute(users, items, 6)


def test_repeated_items_count_once(spark, data):
    users, items = data
    u, i = vectors(spark, "user_id", users), vectors(spark, "token_id", items)
    other = vectors(spark, "token_id", items + 1)
    twice = i.unionByName(i).unionByName(other)
    best = {}
    for n, x in enumerate(users):
        scores = np.maximum(np.float64(x) @ np.float64(items).T, np.float64(x) @ np.float64(items + 1).T)
        best[n] = [t for _, t in sorted((-s, t) for t, s in enumerate(scores))[:4]]
    for block in (None, 20):
        found = R.exact_top_k(u, twice, 4, block=block).orderBy("user_id", "position").collect()
        assert {n: [r.token_id for r in found if r.user_id == n] for n in best} == best


def test_vectors_of_unequal_length_are_refused(spark, data):
    users, items = data
    mixed = vectors(spark, "token_id", items).unionByName(vectors(spark, "token_id", items[:, :3], 500))
    with pytest.raises(ValueError, match="3 to 4"):
        R.exact_top_k(vectors(spark, "user_id", users), mixed, 2)


def test_index_reads_probed_cells_and_takes_new_items(spark, data, tmp_path):
    users, items = data
    u, i = vectors(spark, "user_id", users), vectors(spark, "token_id", items)
    index = R.CellIndex(spark, str(tmp_path)).build(i.filter("token_id % 2 = 0"), cells=6)
    before = index.centers()
    index.append(i.filter("token_id % 2 = 1"))
    again = R.CellIndex(spark, str(tmp_path))
    assert (again.centers() == before).all() and again.items().count() == 90
    assert again.sizes().agg(F.sum("items")).first()[0] == 90
    assert positions(again.top_k(u, 7, probes=6)) == brute(users, items, 7)
    _, read = again.probed(u.filter("user_id = 4"), 2)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    assert len({r.cell for r in read.select("cell").distinct().collect()}) == 2
    few, more = (again.recall(u, 7, probes=n).first().recall for n in (1, 4))
    assert 0 < few < more <= 1
    same = R.approximate_top_k(u, i, 7, probes=2, centers=before)
    assert positions(again.top_k(u, 7, probes=2)) == positions(same)


def test_queries_reach_their_recall(spark, folder):
    from workload import load_all
    from workload.registry import QUERIES

    load_all()
    for name in ("top6_approximate_neighbours", "top6_fitted_cells"):
        assert QUERIES[name](spark, folder).first().recall >= 0.9


@pytest.mark.parametrize("name", ["jn9_pair_scores", "top5_exact_neighbours", "top6_probe_every_cell"])
def test_a_tenth_of_the_vectors_are_queries(spark, folder, name):
    # Half of them were left out: only ids that 20 divides were searched for.
    from workload import load_all
    from workload.registry import QUERIES, oracles

    load_all()
    table = spark.read.parquet(f"{folder}/embeddings.parquet").orderBy("vec_id").collect()
    ids, matrix = [r.vec_id for r in table], np.array([r.embedding for r in table], np.float32)
    asked = [n for n, i in enumerate(ids) if i % 10 == 0]
    assert any(ids[n] % 20 for n in asked) and "vec_id % 20" not in oracles()[name]
    found = QUERIES[name](spark, folder)
    own_class = {(u, t) for u, n in enumerate(asked) for t in range(len(ids)) if ids[t] % 7 == ids[n] % 7}
    barred = own_class if name == "top5_exact_neighbours" else set()
    wanted = {(ids[asked[u]], ids[t]) for u, t, _ in brute(matrix[asked], matrix, 10, barred)}
    assert {(r.user_id, r.token_id) for r in found.collect()} == wanted


def test_recall_is_measured_on_a_tenth_of_the_vectors(spark, folder):
    # It was on half of them, those whose id 20 divides.
    from workload import load_all
    from workload.registry import QUERIES, oracles

    load_all()
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    measured = QUERIES["top7_measured_recall"](spark, folder).first()
    assert measured.queries == table.filter("vec_id % 10 = 0").count() > table.filter("vec_id % 20 = 0").count()
    assert measured.recall == 1 and "vec_id % 20" not in oracles()["top7_measured_recall"]


def test_small_blocks_grow_with_their_cell(spark, data, monkeypatch):
    # A row is copied once per block of the other side: 300 blocks of one row each made 300 copies.
    import pandas as pd

    def sizes(fetch):
        return lambda u, i: pd.DataFrame({"user_id": [len(u)], "token_id": [len(i)], "score": [0.0]})

    monkeypatch.setattr(R, "_local_top", sizes)
    users, items = (
        spark.range(300).select(F.col("id").alias(name), F.array(F.lit(1.0)).alias("vector"), F.lit(0).alias("cell"))
        for name in ("user_id", "token_id")
    )
    found = R._blocked_top(users, items, 2, 1)
    assert 16 <= found.count() <= R.AT_LEAST**2


def test_a_worker_holds_little(spark):
    # Four workers of an executor: two copies of a block while it loads, three of the scores.
    assert 4 * (2 * R.BLOCK_BYTES + 3 * R.SCORES_BYTES) <= 512 << 20


def test_the_best_of_a_block_need_one_copy_of_its_scores():
    # It took two besides a negated one, in each of an executor's workers.
    import tracemalloc

    scores = np.random.default_rng(1).integers(0, 50, (64, 32_768)).astype(np.float64)
    scores[3, 5:] = -np.inf
    scores[4] = -np.inf
    ids = np.arange(scores.shape[1])
    tracemalloc.start()
    rows, columns = R.best_columns(scores, ids, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * scores.nbytes
    for r in range(len(scores)):
        wanted = [c for c in sorted(ids, key=lambda c: (-scores[r, c], c))[:10] if scores[r, c] > -np.inf]
        assert columns[rows == r].tolist() == wanted
    assert R.best_columns(scores[:, :3], ids[:3], 10)[1].size == 3 * 63
    assert R.best_columns(scores[:, :0], ids[:0], 10)[1].size == 0
