"""Scenarios, golden values, brute-force models, and views that must agree."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidegraph import storage
from tidegraph.catalog import SCHEMAS, Catalog, ingest, register_class
from tidegraph.functions import encoders
from tidegraph.operators import algorithms, dictionary, edges, traverse, views
from tidegraph.plans.tables import Tables
from tidegraph.sources import readers, sinks
from tidegraph.streaming import runners

SF = "/root/testdata/sf0.001"
LOG = "eid long, op int, src long, dst long, weight long"


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, SF)


def vertices(spark, n):
    return spark.range(n).select(F.col("id").alias("vid"))


def live_model(rows, directed=True):
    """A stack for each pair."""
    stacks = defaultdict(list)
    for eid, op, a, b, *_ in rows:
        key = (a, b) if directed else (min(a, b), max(a, b))
        if op > 0:
            stacks[key].append(eid)
        elif stacks[key]:
            stacks[key].pop()
    return sorted(e for s in stacks.values() for e in s)


def test_insert_delete_insert(spark):
    rows = [(0, 1, 0, 1, 102), (1, 1, 0, 2, 103), (2, -1, 0, 2, 0), (3, 1, 0, 2, 1010)]
    want = [{(0, 1): 102, (0, 2): 103, (1, 0): 102, (2, 0): 103}, {(0, 1): 102, (1, 0): 102}, {(0, 1): 102, (0, 2): 1010, (1, 0): 102, (2, 0): 1010}]
    v = views.GraphView(spark.createDataFrame(rows, LOG), vertices(spark, 3), kind="undirected")
    for marker, expected in zip((2, 3, 4), want, strict=True):
        assert {(r["src"], r["dst"]): r["weight"] for r in v.at(marker).edges.collect()} == expected


def test_small_degrees(spark):
    rows = [(0, 1, 1, 10, 0), (1, 1, 10, 1, 0), (2, 1, 2, 4, 0), (3, 1, 3, 4, 0)]
    v = views.GraphView(spark.createDataFrame(rows, LOG), vertices(spark, 11))
    out, into = ({r["vid"]: r["degree"] for r in v.degrees(s).collect()} for s in ("out", "in"))
    assert (out[1], out[2], into[4], into[10], out[4]) == (1, 1, 2, 1, 0)
    with pytest.raises(ValueError):
        views.GraphView(v.log, v.vertices, kind="unidirected").degrees("in")


@pytest.mark.parametrize("directed", [True, False])
def test_deletes_against_stacks(spark, directed):
    rng = random.Random(7)
    rows = [(k, rng.choice([1, 1, -1]), rng.randrange(4), rng.randrange(4), k) for k in range(600)]
    got = edges.live_edges(spark.createDataFrame(rows, LOG), directed).select("eid").collect()
    assert sorted(r["eid"] for r in got) == live_model(rows, directed)
    part = views.GraphView(spark.createDataFrame(rows, LOG), vertices(spark, 4), 100, 400)
    assert sorted(r["eid"] for r in part.edges.collect()) == live_model(rows[100:400])


def test_divisibility_graph(spark):
    n, rng = 33, random.Random(1)
    pairs = [(i, j) for i in range(1, n + 1) for j in range(2 * i, n + 1, i)]
    assert len(pairs) == 90
    rng.shuffle(pairs)
    log = [(k, 1, a, b, 0) for k, (a, b) in enumerate(pairs)]
    half = pairs[:45]
    log += [(90 + k, -1, a, b, 0) for k, (a, b) in enumerate(half)]
    v = views.GraphView(spark.createDataFrame(log, LOG), vertices(spark, n + 1), kind="undirected")
    left = {(r["src"], r["dst"]) for r in v.edges.collect()}
    assert len(left) == 90 and all(b % a == 0 or a % b == 0 for a, b in left)
    log += [(200 + k, -1, a, b, 0) for k, (a, b) in enumerate(pairs[45:])]
    empty = views.GraphView(spark.createDataFrame(log, LOG), v.vertices, kind="undirected")
    assert empty.edges.count() == 0 and empty.degrees().where("degree <> 0").count() == 0


def test_golden_values(t):
    log = t.log()
    assert (log.select("src", "dst").distinct().count(), log.where("src = dst").count()) == (1451, 8)
    levels = lambda e: {r["level"]: r["count"] for r in algorithms.bfs(e, 1).groupBy("level").count().collect()}
    assert levels(log) == {1: 1, 2: 5, 3: 33, 4: 102, 5: 9}
    both = edges.undirected(log.select("eid", "src", "dst"))
    assert levels(both) == {1: 1, 2: 14, 3: 112, 4: 23}
    assert levels(both.where("eid < 300")) == {1: 1, 2: 5, 3: 13, 4: 32, 5: 62, 6: 35, 7: 2}
    parts = algorithms.wcc(log.where("eid < 100"))
    assert (parts.select("component").distinct().count(), parts.count()) == (26, 126)
    r = algorithms.pagerank(t.vertices(), log).agg(F.sum("rank"), F.max("rank"), F.min("rank")).first()
    assert [round(x, 6) for x in r] == [183.277898, 1.635829, 0.937392]
    one = {r["src"]: (r["n"], r["s"]) for r in log.groupBy("src").agg(F.count("*").alias("n"), F.sum("dst").alias("s")).where("src < 3").collect()}
    assert one == {0: (11, 896), 1: (5, 363), 2: (4, 326)}
    two = traverse.hops(t.vertices().where("vid < 3"), log, 2).groupBy("root").agg(F.count("*").alias("n"), F.sum("vid").alias("s"))
    assert {r["root"]: (r["n"], r["s"]) for r in two.collect()} == {0: (120, 9562), 1: (38, 3182), 2: (48, 3592)}


def test_views_of_the_same_edges_agree(spark, t, tmp_path):
    """Log, archive and tail, recovered log and historical view give the same search."""
    log, head = t.log(), t.head()
    v = views.GraphView(log, t.vertices())
    stale = views.static_view(log, t.vertices(), 256, stale=True)
    tail = v.delta(stale.head(), head)
    sinks.write_log(log, str(tmp_path / "log"), 0, 700)
    sinks.write_log(log, str(tmp_path / "log"), 700, head)
    sinks.split(log, 4, str(tmp_path / "parts"))
    sinks.compact(v.edges, str(tmp_path / "compact"))
    forms = [v.edges, stale.edges.unionByName(tail.edges), sinks.read_log(spark, str(tmp_path / "log")), spark.read.parquet(str(tmp_path / "parts")), spark.read.parquet(str(tmp_path / "compact")), v.delta(0, head).edges]
    found = [sorted(map(tuple, algorithms.bfs(f, 1).collect())) for f in forms]
    assert all(f == found[0] for f in found)
    assert sorted(map(tuple, algorithms.bfs(v, 1).collect())) == found[0]  # a view itself will do
    assert sinks.read_log(spark, str(tmp_path / "log"), 10, 20).count() == 10
    assert len(list((tmp_path / "parts").glob("part-*"))) == 4


def test_snapshots_and_export(spark, t, tmp_path):
    marks = views.snapshots(spark, 1000, 256)
    sinks.write_snapshots(marks, str(tmp_path / "snap"))
    assert sorted(map(tuple, sinks.read_snapshots(spark, str(tmp_path / "snap")).collect())) == [(0, 256), (1, 512), (2, 768), (3, 1000)]
    assert views.snapshots(spark, 0).count() == 0 and [views.marker_of(k, 1000, 256) for k in (0, 3, 9)] == [256, 1000, 1000]
    sinks.export_adjacency(edges.csr(t.vertices(), t.log()), t.log(), str(tmp_path / "adj"))
    read = lambda part: [r["value"] for r in spark.read.text(str(tmp_path / "adj" / part)).collect()]
    assert read("0-head") == ["AdjacencyGraph", "150", "1500"] and len(read("1-offsets")) == 150 and len(read("2-neighbours")) == 1500
    assert edges.adjacency(t.log()).agg(F.sum("degree")).first()[0] == 1500


def test_single_valued_sides(spark):
    rows = [(0, 1, 1, 7, 0), (1, 1, 2, 7, 0), (2, 1, 1, 8, 0), (3, 1, 3, 8, 0)]
    log = spark.createDataFrame(rows, LOG)
    assert {tuple(r) for r in edges.many_to_one(log).collect()} == {(1, 8), (2, 7), (3, 8)}
    assert {tuple(r) for r in edges.one_to_one(log).collect()} == {(2, 7), (3, 8)}


def test_streams_end_like_batches(spark, t):
    log = t.log().select("eid", "src", "dst")
    assert {tuple(r) for r in runners.Stateful(log, runners.wcc_step).result().collect()} == {tuple(r) for r in algorithms.wcc(log).collect()}
    got = {tuple(r) for r in runners.Stateful(log, runners.bfs_step(1)).result().collect()}
    assert got == {tuple(r) for r in algorithms.bfs(log, 1, first=0).collect()}


def test_dictionary(spark):
    named = spark.createDataFrame([(0, "b", 5), (0, "a", 9), (0, "b", 2), (1, "a", 1), (0, "c", 5)], "tid int, name string, eid long")
    ids = {(r["tid"], r["name"]): r["vid"] for r in dictionary.build(named, 4).collect()}
    assert ids == {(0, "b"): 0, (0, "c"): 1, (0, "a"): 2, (1, "a"): 0}
    props = spark.createDataFrame([(1, "x", "1", 0), (1, "x", "2", 1), (1, "y", "3", 0)], "vid long, name string, value string, eid long")
    assert dictionary.property_map(props).first()["props"] == {"x": "2", "y": "3"}


def test_parsers(spark, tmp_path):
    text = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string")
    assert {tuple(r) for r in readers.text_edges(text("# c", "% d", "", "1 2", " 3\t 4 ", "x y")).collect()} == {(1, 2), (3, 4)}
    flow = readers.netflow(text("1,2,A,B,6,Port22,80,1,2,3,4", "#", "1,2")).collect()
    assert len(flow) == 1 and (flow[0]["src_port"], flow[0]["dst_port"], flow[0]["src_device"]) == (22, 80, "A")
    assert [tuple(r) for r in readers.triples(text('<a> <p> "x y" .', "# no")).collect()] == [("<a>", "<p>", '"x y"')]
    good = '{"UserName":"u","DomainName":"d","LogHost":"h","LogonID":"7","Time":3,"ProcessID":"9","ParentProcessID":"8"}'
    row = readers.host_events(text(good, "{}", good.replace('"DomainName":"d",', ""), "junk")).collect()
    assert [(r["user"], r["process"], r["parent"]) for r in row] == [("u@d", "9@h@7", "8@h@7")]
    signed = spark.createDataFrame([(0, 1, 2), (1, -1, -2)], "eid long, src long, dst long")
    assert [tuple(r) for r in readers.actions(signed).orderBy("eid").collect()] == [(0, 1, 1, 2), (1, -1, 1, 2)]
    offsets = spark.createDataFrame([(0, 0, 2), (1, 2, 2), (2, 2, 3)], "vid long, start long, end long")
    nbrs = spark.createDataFrame([(0, 5), (1, 6), (2, 7)], "pos long, dst long")
    assert sorted((r["src"], r["dst"]) for r in readers.csr_edges(offsets, nbrs).collect()) == [(0, 5), (0, 6), (2, 7)]
    (tmp_path / "e.bin").write_bytes(b"".join(x.to_bytes(4, "little") for x in (1, 2, 3, 4)))
    assert sorted(map(tuple, readers.binary_edges(spark, str(tmp_path / "e.bin"), wide=False).collect())) == [(1, 2), (3, 4)]
    readers.register("mine", lambda d: d.select(F.length("value").alias("n")))
    assert readers.parse("mine", text("abc")).first()["n"] == 3


def test_property_graph_files(spark, tmp_path):
    (tmp_path / "person.csv").write_text("id|firstName\n1|Ann\n2|Bo\n")
    (tmp_path / "knows.csv").write_text("Person.id|Person.id|creationDate\n1|2|2010-01-01T00:00:00\n")
    conf = "%%vertex%%\nperson.csv person\n%%edge%%\nknows.csv knows person person creationDate\n"
    v, e = readers.property_graph(spark, conf, str(tmp_path))
    assert {r["name"] for r in v["person"].collect()} == {"person1", "person2"}
    assert [tuple(r) for r in e["knows"].collect()] == [("person1", "person2", "2010-01-01T00:00:00")]


def test_encoders(spark):
    d = spark.createDataFrame([("2020-01-02T03:04:05", "7", "1.5", "0xff"), ("x", "y", "z", "w")], "a string, b string, c string, d string")
    use = encoders.encode
    rows = d.select(use("time", F.col("a")).cast("string").alias("a"), use("int64", F.col("b")).alias("b"), use("double", F.col("c")).alias("c")).collect()
    assert tuple(rows[0]) == ("2020-01-02 03:04:05", 7, 1.5) and tuple(rows[1]) == (None, None, None)
    assert d.select(use("hex", F.col("d")).alias("d")).first()["d"] == 255


def test_patterns(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long")
    p = traverse.Pattern({"to": e}).triple("?x", "to", "?y").triple("?y", "to", "?z")
    assert {tuple(r) for r in p.select("?x", "?z").collect()} == {(1, 3), (1, 4), (2, 4)}
    assert {r["x"] for r in traverse.Pattern({"to": e}).triple("?x", "to", 3).select("?x").collect()} == {1, 2}
    bound = spark.createDataFrame([(1,), (1,)], "vid long")
    assert {r["vid"] for r in traverse.transform(bound, e).collect()} == {2, 3}
    assert traverse.transform(spark.createDataFrame([(4,)], "vid long"), e, down=False).first()["vid"] == 3


def test_components_of_long_chains(spark):
    rng = random.Random(2)
    ids = list(range(300))
    rng.shuffle(ids)
    pairs = [(ids[k], ids[k + 1]) for k in range(299) if k % 100 != 99]
    got = defaultdict(set)
    for r in algorithms.wcc(spark.createDataFrame(pairs, "src long, dst long")).collect():
        got[r["component"]].add(r["vid"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(ids[k : k + 100]) for k in (0, 100, 200))
    assert all(min(m) == c for c, m in got.items())


def test_logs_of_one_edge_and_none(spark):
    log = spark.createDataFrame([(0, 1, 1, 2, 0)], LOG)
    assert views.static_view(log, vertices(spark, 3)).edges.count() == 1
    assert views.static_view(log.limit(0), vertices(spark, 3)).edges.count() == 0 and edges.head_of(log.limit(0)) == 0
    assert runners.Stateful(log.select("eid", "src", "dst"), runners.degree_step).result().collect()[0]["degree"] == 1


def test_search_goes_to_the_end_of_a_path(spark):
    e = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    want = {k: k for k in range(41)}
    found = lambda d: {r["vid"]: r["level"] for r in d.collect()}
    assert found(algorithms.bfs(e, 0, first=0)) == want
    assert found(algorithms.bfs(e, 0, first=0, depth=5)) == {k: k for k in range(6)}
    start = spark.createDataFrame([(0, 0)], "vid long, level int")
    assert found(algorithms.relax(start, e, start)) == want
    assert found(algorithms.bfs_tiles(e.where("src < 12"), 12, 2, first=0)) == {12 - k: k for k in range(13)}
    path = algorithms.shortest_path(e.union(e.where("src = 3").withColumn("dst", F.lit(5))), 0, 7).collect()
    assert sorted((r["step"], r["vid"]) for r in path) == list(enumerate([0, 1, 2, 3, 5, 6, 7]))
    assert algorithms.shortest_path(e, 7, 0).count() == 0


def test_rank_settles_below_any_change(spark, t):
    e = t.log().select("src", "dst")
    a, b = ({r["vid"]: r["rank"] for r in algorithms.pagerank_to(t.vertices(), e, eps, block=k).collect()} for eps, k in ((1e-3, 2), (1e-3, 5)))
    assert a == pytest.approx(b, abs=1e-12)  # the first round under epsilon, whatever the blocks


def test_streams_go_on_after_a_restart(spark, t, tmp_path):
    """A new view object, as another driver would make one, takes up state and place from the folder."""
    log = t.log().select("eid", "src", "dst")
    path = str(tmp_path / "log")
    runners.append(log, path, 0, 600, 2)
    runners.StreamView(spark, path, log.schema, runners.wcc_step).start().awaitTermination()
    runners.append(log, path, 600, 1500, 2)
    again = runners.StreamView(spark, path, log.schema, runners.wcc_step)
    again.start()
    assert {tuple(r) for r in again.wait().state().collect()} == {tuple(r) for r in algorithms.wcc(log).collect()}
    # a batch that is run again gives the same version
    batch = spark.read.schema(log.schema).parquet(path).where("eid >= 1050")
    again._advance(batch, 3)
    assert {tuple(r) for r in again.state().collect()} == {tuple(r) for r in algorithms.wcc(log).collect()}
    timed = runners.StreamView(spark, path, log.schema, runners.degree_step, "timed", files=2, every="100 milliseconds")
    timed.start()
    assert timed.wait().state().agg(F.sum("degree")).first()[0] == 1500
    runners.append(log, path, 0, 10)
    assert timed.wait().state().agg(F.sum("degree")).first()[0] == 1510
    timed.unregister()
    assert timed.state() is None and not timed.query.isActive


def test_windows_on_a_stream(spark, tmp_path):
    day = lambda k: f"2024-01-0{k}T10:00:00"
    spark.createDataFrame([(1, day(1), 2.0), (1, day(1), 3.0), (2, day(2), 5.0), (1, day(9), 1.0)], "src long, at string, value double").coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, at string, value double").json(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("at")).select("src", "ts", "value")
    q = runners.windowed(stream).writeStream.format("memory").queryName("windows").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["src"], str(r["start"])[:10]): (r["n"], r["total"]) for r in spark.table("windows").collect()}
    assert got == {(1, "2024-01-01"): (2, 5.0), (2, "2024-01-02"): (1, 5.0), (1, "2024-01-09"): (1, 1.0)}


def test_catalog(spark):
    c = Catalog.from_conf(SCHEMAS["snb"])
    assert (c.types["person"], c.types["organisation"]) == (2, 7) and c.entries["forum_containerOf_post"].cls == "one2many"
    assert c.entries["person_knows_person"].prop == "creationDate" and len(c.relations()) + len(c.properties()) == c.table(spark).count()
    for text in SCHEMAS.values():
        assert Catalog.from_conf(text).relations()
    with pytest.raises(ValueError):
        c.add_relation("person_knows_person")
    with pytest.raises(ValueError):
        c.add_relation("new", "no such class")
    register_class("first", "directed", lambda log: log.groupBy("src").agg(F.min_by("dst", "eid").alias("dst")))
    c.add_relation("mine", "first")
    c.add_edge_property("mine", "since", "int64")
    c.put("mine", spark.createDataFrame([(0, 1, 7), (1, 1, 8), (2, 2, 9)], "eid long, src long, dst long"))
    assert {(r["src"], r["dst"]) for r in c.view("mine", vertices(spark, 3)).edges.collect()} == {(1, 7), (2, 9)}
    assert c.view("mine", vertices(spark, 3), 1).edges.count() == 1 and not c.view("mine", vertices(spark, 3)).is_unidir


def test_binary_graph_and_action_files(spark, tmp_path):
    words = lambda *x: b"".join(k.to_bytes(8, "little", signed=True) for k in x)
    (tmp_path / "g.bin").write_bytes(words(readers.STINGER, 3, 4, 0, 2, 2, 4, 1, 2, 0, 0, 5, 6, 7, 8))
    (tmp_path / "a.bin").write_bytes(words(readers.STINGER, 3, 1, 2, -2, -1, -2, -1))
    load = lambda f: spark.read.format("binaryFile").load(str(tmp_path / f))
    g = readers.stinger_graph(load("g.bin"))
    assert sorted(map(tuple, g.select("src", "dst", "weight").collect())) == [(0, 1, 5), (0, 2, 6), (2, 0, 7), (2, 0, 8)]
    a = readers.stinger_actions(load("a.bin"))
    assert sorted(map(tuple, a.collect())) == [(0, 1, 1, 2), (1, -1, 2, 1), (2, -1, 2, 1)]
    rows = [(k, e["op"], e["src"], e["dst"]) for k, e in enumerate(a.orderBy("eid").collect())]
    whole = g.select("pos", F.lit(1), "src", "dst").union(spark.createDataFrame([(4 + k, op, s, d) for k, op, s, d in rows], "eid long, op int, src long, dst long")).toDF("eid", "op", "src", "dst")
    assert sorted((r["src"], r["dst"]) for r in edges.live_edges(whole).collect()) == [(0, 1), (0, 2), (1, 2), (2, 0), (2, 0)]
    with pytest.raises(Exception, match="no graph file"):
        readers.stinger_graph(load("a.bin").select(F.lit(b"12345678").alias("content"))).collect()
    mine = spark.createDataFrame([((1).to_bytes(4, "little") + (2).to_bytes(8, "little") + b"\x00\x00\xc0\x3f",)], "content binary")
    assert tuple(readers.unpack_records(mine, [("src", "<u4"), ("dst", "<u8"), ("w", "<f4")]).first()) == (1, 2, 1.5)


def test_ingest_keeps_clashing_properties_apart(spark, tmp_path):
    (tmp_path / "tag.csv").write_text("id|name|key\n3|Pop|x\n1|Rock|y\n")
    (tmp_path / "has.csv").write_text("a|b\n1|3\n1|9\n")
    conf = "%%schema%%\nhas directed\nname property\nkey property\n%%vertex%%\ntag.csv tag\n%%edge%%\nhas.csv has tag tag\n"
    c = Catalog.from_conf(conf)
    ids, values, ends = ingest(c, *readers.property_graph(spark, conf, str(tmp_path)))
    assert {r["name"]: r["vid"] for r in ids.collect()} == {"tag1": 0, "tag3": 1}
    assert {(r["sid"], r["name"], r["value"]) for r in values.collect()} == {(0, "name", "Rock"), (0, "key", "y"), (1, "name", "Pop"), (1, "key", "x")}
    assert [tuple(r) for r in ends.collect()] == [("has", 0, 1, None)]  # no file has tag9


def test_hub_of_a_large_component(spark):
    pairs = [(0, k) for k in range(1, 400)] + [(500, 501)]
    got = {r["vid"]: r["component"] for r in algorithms.wcc(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(400), 0), 500: 500, 501: 500}


def test_no_machine_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        storage.shared_dir(Session())
