"""Plans and results whose cost must grow no faster than the input."""

import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests.test_graph import LOG, SF, live_model
from tidegraph.llm import prefix_hash
from tidegraph.operators import algorithms, edges
from tidegraph.plans import registry
from tidegraph.sources import readers, sinks
from tidegraph.streaming import runners


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_live_edges_look_back_only(spark):
    """A frame that ends with the pair's last row is gone through again for each row: quadratic in the pair's history."""
    assert "unboundedfollowing" not in plan_of(registry.QUERIES["live_edges"](spark, SF))
    rng = random.Random(3)
    rows = [(k, rng.choice([1, 1, -1]), 0, 0, k) for k in range(4000)]
    got = edges.live_edges(spark.createDataFrame(rows, LOG)).select("eid").collect()
    assert sorted(r["eid"] for r in got) == live_model(rows)


def test_live_edges_of_one_offset(spark):
    """Rows of one eid keep one order in both directions: three inserts at -1, then a delete, leave two."""
    log = spark.createDataFrame([(-1, 1, 0, 0, k) for k in range(300)] + [(1, -1, 0, 0, 0)], LOG)
    assert edges.live_edges(log).count() == 299


def test_live_edges_undirected_look_back_only(spark):
    assert "unboundedfollowing" not in plan_of(registry.QUERIES["live_edges_undirected"](spark, SF))
    rng = random.Random(4)
    rows = [(k, rng.choice([1, 1, -1]), *rng.choice([(0, 1), (1, 0)]), k) for k in range(4000)]
    got = edges.live_edges(spark.createDataFrame(rows, LOG), directed=False).select("eid").collect()
    assert sorted(r["eid"] for r in got) == live_model(rows, False)


def test_degree_live_looks_back_only(spark):
    assert "unboundedfollowing" not in plan_of(registry.QUERIES["degree_live"](spark, SF))


def test_edges_with_deletes_look_back_only(spark):
    assert "unboundedfollowing" not in plan_of(registry.QUERIES["edges_with_deletes"](spark, SF))


def test_replay_in_one_scan(spark, tmp_path):
    """One plan serves all batches; the same markers, rows and rests as batch after batch."""
    path, start = str(tmp_path / "log"), 7
    sinks.write_log(spark.range(1000).where("id not between 300 and 420").selectExpr("id as eid", "id * 3 as dst"), path, 0, 1000)
    slow = {}
    sinks.replay(spark, path, lambda e, marker: slow.update({marker: sorted(r["eid"] for r in e.collect())}), 50, start)
    fast = defaultdict(list)
    for r in sinks.replayed(spark, path, 50, start).collect():
        fast[r["marker"]].append(r["eid"])
    assert {m: sorted(x) for m, x in fast.items()} == {m: x for m, x in slow.items() if x}


def test_log_replay_plan_is_of_one_scan(spark, tmp_path):
    spark.range(20000).selectExpr("id as o_orderkey", "id % 9 as o_custkey", "1.0d as o_totalprice", "timestamp'2020-01-01' as o_orderdate").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(9).selectExpr("id as c_custkey").write.parquet(str(tmp_path / "customer.parquet"))
    assert "union" not in plan_of(registry.QUERIES["log_replay"](spark, str(tmp_path)))


def test_csr_places_are_not_broadcast(spark):
    """Few rows with many places look small to the planner."""
    offsets = spark.range(3).selectExpr("id as vid", "array(0L, 3L, 3L)[int(id)] as start", "array(3L, 3L, 5L)[int(id)] as end")
    nbrs = spark.range(3_000_000).selectExpr("id as pos", "10 + id as dst")
    got = readers.csr_edges(offsets, nbrs)
    assert "broadcast" not in got._jdf.queryExecution().sparkPlan().toString().lower()
    assert sorted(map(tuple, got.select("src", "dst").collect())) == [(0, 10), (0, 11), (0, 12), (2, 13), (2, 14)]


def test_a_fed_batch_is_many_files(spark, monkeypatch):
    """One file a batch is written by one task and read by few."""
    monkeypatch.setattr(runners, "FILE_ROWS", 100)
    log = spark.range(1500).selectExpr("id as eid", "id % 40 as src", "id * 7 % 40 as dst")
    path, files = runners.feed(log, 3)
    assert files == 5
    assert spark.read.parquet(path).select(F.input_file_name()).distinct().count() == 15
    got = {tuple(r) for r in runners.Stateful(log, runners.bfs_step(1)).result().collect()}
    assert got == {tuple(r) for r in algorithms.bfs(log, 1, first=0).collect()}


def test_a_large_frontier_stays_off_the_driver(spark, monkeypatch):
    monkeypatch.setattr(algorithms, "SMALL", 0, raising=False)
    plans, stage = [], algorithms.stage
    monkeypatch.setattr(algorithms, "stage", lambda s, df, name, **k: (plans.append(df._jdf.queryExecution().sparkPlan().toString()), stage(s, df, name, **k))[1])
    log = spark.range(1500).selectExpr("id as eid", "id * id % 97 as src", "id * 7 % 97 as dst")
    start = spark.createDataFrame([(1, 0)], "vid long, level int")
    got = {tuple(r) for r in algorithms.relax(stage(spark, start, "start"), stage(spark, log, "log"), start).collect()}
    assert plans and not any("Broadcast" in p for p in plans)
    assert got == {tuple(r) for r in algorithms.bfs(log, 1, first=0).collect()}


def test_views_side_by_side_over_many_files(spark, monkeypatch):
    """Batches of several files give each view the states that batches of one file do."""
    log = spark.range(900).selectExpr("id as eid", "id * id % 97 as src", "id * 7 % 97 as dst")
    steps = {"bfs": runners.bfs_step(1), "wcc": runners.wcc_step, "degree": runners.degree_step}
    found = lambda: {n: {tuple(r) for r in s.collect()} for n, s in runners.concurrent(log, steps, 2).items()}
    one = found()
    monkeypatch.setattr(runners, "FILE_ROWS", 100)
    assert found() == one


def ranks_model(pairs, vids, epsilon=0.0, rounds=200):
    at = {v: k for k, v in enumerate(vids)}
    deg = np.bincount([at[a] for a, _ in pairs], minlength=len(vids))
    s, d = np.array([(at[a], at[b]) for a, b in pairs if b in at]).T
    rank = np.full(len(vids), 1.0 / len(vids))
    for _ in range(rounds):
        rank = 0.15 / len(vids) + 0.85 * np.bincount(d, (rank / np.maximum(deg, 1))[s], len(vids))
    return dict(zip(vids, rank, strict=True))


def test_rank_rounds_ship_no_row_for_each_edge(spark, monkeypatch):
    """Several blocks and tiles, parallel edges, ends that are no vertices; few rounds, and ranks near the limit."""
    monkeypatch.setattr(algorithms, "TILE", 200, raising=False)
    plans, stage = [], algorithms.stage
    monkeypatch.setattr(algorithms, "stage", lambda s, df, name, **k: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if name == "ranks" else None, stage(s, df, name, **k))[1])
    rng = random.Random(5)
    pairs = [(rng.randrange(200), rng.randrange(310)) for _ in range(1500)] + [(7, 8)] * 5
    got = {r["vid"]: r["rank"] for r in algorithms.pagerank_to(spark.range(300).toDF("vid"), spark.createDataFrame(pairs, "src long, dst long")).collect()}
    want = ranks_model(pairs, range(300))
    assert got.keys() == want.keys() and sum(abs(got[v] - want[v]) for v in want) < 1e-8 / 0.15
    assert not any("times" in p and "tile" not in p for p in plans) and len(plans) < 40


def test_rank_warm_start_in_blocks(spark, monkeypatch):
    """A stream's step starts from the ranks of fewer edges and comes to the ranks of all."""
    monkeypatch.setattr(algorithms, "TILE", 200, raising=False)
    rng = random.Random(6)
    pairs = [(rng.randrange(90), rng.randrange(120)) for _ in range(900)]
    log = spark.createDataFrame([(k, *p) for k, p in enumerate(pairs)], "eid long, src long, dst long")
    got = {r["vid"]: r["rank"] for r in runners.Stateful(log, runners.pagerank_step(spark.range(120).toDF("vid")), 2).result().collect()}
    want = ranks_model(pairs, range(120))
    assert got.keys() == want.keys() and sum(abs(got[v] - want[v]) for v in want) < 1e-8 / 0.15


def test_edited_texts_make_no_prefix_arrays(spark):
    """The columns asked for are op10's own, odd rows included."""
    rows = [(3, "abcdef"), (1, "xy"), (None, "lone"), (2, None), (3, "abcdef"), (9, ""), (5, "äöü\U0001f600" * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    columns = ["doc_id", "n_chars", "edited_sha256"]
    got = prefix_hash.edits(docs)
    assert got.columns == columns
    key = lambda df: sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)
    assert key(got) == key(prefix_hash.pair_fingerprints(docs))
