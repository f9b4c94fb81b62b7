"""Each operator against a brute-force version, a round trip or held-out accuracy, and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidegraph.llm import chat, html_text, mixing, packing, prefix_hash, queries, resharding, simhash, suffix, topk, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, place int"


def docs(spark, texts, ids=None):
    """Documents with columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, None if k % 3 == 2 else f"s{k % 3}", None, "x", 7) for k, (i, t) in enumerate(zip(ids, texts, strict=True))], DOC)


AWKWARD = [None, "", " \t\n", "one", "one two", "One TWO", "a b c", "a b c", "é" * 50, "x " * 6000, "word\x0bword", "a\x00b c d", "😀 " * 30, "a b c d e f", "a b c d e f g"]


def rows(df):
    return [r.asDict() for r in df.collect()]


# 1 ---------------------------------------------------------------------------


def slow_print(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def slow_components(prints):
    """id, fingerprint pairs -> component by id."""
    left, out = dict(prints), {}
    for i in sorted(left):
        if i in out:
            continue
        todo = [i]
        out[i] = i
        while todo:
            a = todo.pop()
            for b in left:
                if b not in out and bin(left[a] ^ left[b]).count("1") <= 3:
                    out[b] = i
                    todo.append(b)
    return out


def test_simhash_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    prints = {r["doc_id"]: slow_print(r["text"]) for r in table}
    want = slow_components(prints)
    got = rows(queries.op1_simhash(spark, SF))
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_simhash_awkward(spark):
    got = rows(simhash.components(docs(spark, AWKWARD)))
    want = slow_components({i: slow_print(t) for i, t in enumerate(AWKWARD)})
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    got = rows(simhash.components(docs(spark, ["a b c"] * 3 + ["z"], [None, 4, 4, None])))
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in got) == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash.components(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [3, 2000])
def test_simhash_links_of_dense_fingerprints(spark, limit):
    rng = random.Random(5)
    centres = [rng.getrandbits(64) for _ in range(5)]
    prints = {centres[rng.randrange(5)] ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(300)}
    nodes = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "f0 long")
    found = simhash.connected_components(simhash.links(nodes, bucket_limit=limit)).collect()
    want = slow_components({p: p for p in prints})
    members: dict = {}
    for p, c in want.items():
        members.setdefault(c, set()).add(f"{p:016x}")
    got: dict = {}
    for r in found:
        got.setdefault(r["component"], set()).add(r["vertex"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(m) for m in members.values() if len(m) > 1)


def test_simhash_thresholds_cover_the_distance():
    cost = np.array([[0, 5, 50, 500], [0, 9, 20, 100], [0, 1, 2, 900], [0, 4, 70, 90]], float)
    gain = np.tile(np.arange(4), (4, 1))
    got = simhash.allocate(cost, gain, 4)
    best = min((sum(cost[i, t + 1] for i, t in enumerate(p)), p) for p in itertools.product(range(-1, 3), repeat=4) if sum(t + 1 for t in p) >= 4)
    assert sum(cost[i, t + 1] for i, t in enumerate(got)) == best[0] and sum(t + 1 for t in got) >= 4


# 2 ---------------------------------------------------------------------------


def check_packing(spark, table, got):
    encode = queries.default_encoder()
    ids = {r["doc_id"]: np.append(encode(r["text"] or ""), 1).astype("<u4") for r in table}
    pieces: dict = {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[i])
            assert r["ids_crc32"] == zlib.crc32(ids[i][at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids[i])
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0


def test_packing(spark):
    check_packing(spark, spark.read.parquet(f"{SF}/documents.parquet").collect(), rows(queries.op2_packing(spark, SF)))
    d = docs(spark, AWKWARD)
    check_packing(spark, d.collect(), rows(packing.pack(d, queries.default_encoder())))
    check_packing(spark, d.collect(), rows(packing.pack(d, queries.default_encoder(), shard_tokens=50)))
    assert packing.pack(docs(spark, []), queries.default_encoder()).count() == 0
    assert packing.pack(docs(spark, ["a", "a"], [None, None]), queries.default_encoder()).count() == 2


def test_packing_ids_are_those_of_tokenizers():
    fast, slow = queries.default_encoder(), packing.Encoder(queries.default_encoder().path)
    for t in [x or "" for x in AWKWARD] + ["it's we'll  two\n\nspaces <|endoftext|> 1234 ünï"]:
        assert fast(t).tolist() == slow(t).tolist()


def test_packing_ids_of_added_tokens():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.default_encoder().path)
    for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "<|endoftext| >"):
        assert queries.default_encoder()(t).tolist() == plain.encode(t, add_special_tokens=False).ids
    assert 50256 in queries.default_encoder()("a <|endoftext|> b").tolist()


def test_packing_prefers_lexical_neighbours():
    a, b = np.arange(100, 160, dtype=np.uint32), np.arange(500, 560, dtype=np.uint32)
    index = packing.Index([a, b, a[:50], b[10:], a[5:]])
    near = index.neighbours(0, np.array([False, True, True, True, True]), 24, 64)
    assert set(near.tolist()) == {2, 4}


def test_packing_ranks_by_all_terms():
    """The whole BM25 ranking of each seed, by a term at a time over all documents."""
    rng = np.random.default_rng(4)
    held = [rng.zipf(1.3, rng.integers(5, 400)).astype(np.uint32) % 3000 for _ in range(150)]
    index, n, size = packing.Index(held), len(held), np.mean([len(d) for d in held])
    df = Counter(t for d in held for t in set(d.tolist()))
    for seed in range(0, n, 10):
        want = np.zeros(n)
        for k, d in enumerate(held):
            c = Counter(d.tolist())
            for t in set(held[seed].tolist()) & set(c) if k != seed else ():
                want[k] += math.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(d) / size))
        got = index.neighbours(seed, np.ones(n, bool))
        assert set(got.tolist()) == set(np.flatnonzero(want).tolist()) and len(got) > 64
        assert np.all(np.diff(want[got]) < 1e-4)


def test_packing_fills_windows_from_the_whole_ranking():
    """A small document far down the ranking fills the window, so that no other is cut."""
    seed = np.arange(100, 160, dtype=np.uint32)
    large = [np.concatenate([seed, np.full(40 + k, 1000 + k, np.uint32)]) for k in range(80)]
    small = np.array([100, 7, 7, 7], np.uint32)
    packer = packing.Packer(0, 64)
    packer.shard([(k, d) for k, d in enumerate([seed, *large, small])])
    assert [r[0] for r in packer.rows if r[5] == 0] == [0, 81]


# 3 ---------------------------------------------------------------------------


def slow_top(vectors, k=5):
    v = {i: [math.floor(256 * float(x)) for x in e] for i, e in vectors if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    out = {}
    for q in v:
        if q % 50 == 0:
            s = sorted((-sum(a * b for a, b in zip(v[q], v[c], strict=True)), c) for c in v if c != q and len(v[c]) == len(v[q]))[:k]
            out.update({(q, n + 1): (c, -x) for n, (x, c) in enumerate(s)})
    return out


def test_top_k(spark):
    table = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = rows(queries.op3_topk(spark, SF))
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == slow_top(table)
    odd = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 1.0]), (6, [-0.001, 0.25]), (7, [3e7, -3e7]), (8, [1.0])]
    df = spark.createDataFrame([(i, e, 1, 2) for i, e in odd], "vec_id long, embedding array<float>, label int, node int")
    for block in (2, 8192):
        got = rows(topk.top_k(df, F.col("vec_id") % 50 == 0, block=block, fan=2))
        assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == slow_top(odd)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_ships_no_tiles(spark):
    """Blocks meet where they are read: what is shuffled are lists of hits, so that disk and memory don't grow with the number of tiles."""
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(300)], "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("vec_id") % 2 == 0, block=8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan[plan.index("MapInArrow") :]
    assert {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in rows(got) if r["query_id"] % 50 == 0} == slow_top([(i, [float(i % 7), 1.0]) for i in range(300)])


def test_top_k_odd_blocks(spark):
    """Ties, copies, rows of one id, several widths and scores from 16 to 63 bits, in blocks of all sizes and in one and many slices."""
    rng = random.Random(3)
    table = [(rng.choice([0, 50, i, i]), [rng.choice([0.0, 0.004, -1.0, 0.5]) for _ in range(rng.choice([0, 1, 3, 3, 3]))]) for i in range(120)]
    table += [(200 + i, [rng.choice([-1, 1]) * 2.0 ** rng.choice([5, 12, 20, 22]), 1.0, -2.0]) for i in range(30)]
    table += [(250, [2.0**22, 1.0, 0.0]), (300, [0.5, -0.25, 0.0]), (301, [-1e30, 0.0, 0.0]), (350, [0.0, 1.0, 1.0])]
    whole = [(i, [min(max(math.floor(256 * x), -(2**63)), 2**63 - 1) for x in e]) for i, e in table if i != 301]
    want = {}
    for q in {i for i, _ in whole if i % 50 == 0}:
        s = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for i, v in whole if i == q for c, w in whole if c != q and len(v) == len(w))
        want |= {(q, n + 1): (c, -x) for n, (x, c) in enumerate(s[:5])}
    held = spark.createDataFrame([x for x in table if x[0] != 301], "vec_id long, embedding array<double>").repartition(3)
    for block in (1, 7, 40, 8192):
        got = rows(topk.top_k(held, F.col("vec_id") % 50 == 0, block=block, fan=3))
        assert len(got) == len(want) and {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in got} == want
    far = spark.createDataFrame([x for x in table if x[0] in (301, 350)] + [(351, [0.0, 0.0, 5.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in rows(topk.top_k(far, F.col("vec_id") == 350))] == [(351, 256 * 1280), (301, 0)]
    best = topk._Best(np.array([9]), np.array([[2**40, 1]]), 2)
    for ids, c in (([1, 2], [[2**40, 1], [-(2**40), 0]]), ([3, 4], [[0, 0], [2**22, 3]])):
        if ids[0] == 1:
            with pytest.raises(OverflowError):
                best.add(np.array([[2**40, 1]]), np.array(ids), np.array(c))
        else:
            best.add(np.array([[2**40, 1]]), np.array(ids), np.array(c))
    assert best.ids[0].tolist() == [4, 3] and best.scores[0].tolist() == [2**62 + 3, 0]


# 4 ---------------------------------------------------------------------------


def test_chat_round_trip(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    said = r"\### Assistant: </turn> ok"
    log: dict = {-7: [(0, "user", said), (1, "assistant", said)]}
    for r in table:
        log.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in rows(queries.op4_chat(spark, SF))}
    assert set(got) == set(log)
    for i, own in log.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        assert got[i]["n_turns"] == len(own)
        assert got[i]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in own).encode()).hexdigest()
        assert (got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_output_and_events(spark):
    odd = ["", "\\", "</turn>", " </turn>\n### user: x", "a: b", "\\\\###", "é\n"]
    df = spark.createDataFrame([(1, k, ["user", "assistant", None, "a: \\"][k % 4], t, 5) for k, t in enumerate([*odd, None])], "conv_id long, turn long, role string, text string, at int")
    out = chat.format_chats(df).collect()[0]
    assert chat.parse_turns(out["output"]) == [(["user", "assistant", "", "a: \\"][k % 4], t or "") for k, t in enumerate([*odd, None])]
    assert [chat.unescape(out["output"][s["start"] : s["end"]]) for s in out["loss"]] == [odd[1], odd[5]]
    log = [(1, 0, "message", 0, "user", "hi"), (1, 1, "message", 1, "assistant", "he"), (1, 2, "delta", 1, "", "llo"), (1, 3, "regenerate", 1, "", ""), (1, 4, "message", 1, "assistant", "yo"), (1, 5, "edit", 0, "", "hey"), (2, 0, "delta", 0, "user", "x")]
    t = chat.turns(spark.createDataFrame(log, "conv_id long, seq long, event string, turn long, role string, text string")).orderBy("conv_id", "at").collect()
    assert [(r["conv_id"], *chat.parse_turns(r["output"])[0]) for r in t] == [(1, "user", "hey"), (1, "assistant", "yo"), (2, "user", "x")]
    assert chat.digest(chat.turns(df.limit(0))).count() == 0
    assert rows(chat.digest(chat.turns(df.withColumn("conv_id", F.lit(None).cast("long")))))[0]["n_turns"] == 8


def slow_fold(events):
    """Events from the oldest, over a list of turns."""
    done = []
    for event, turn, role, text in events:
        if event == "message" or event == "delta" and not done:
            done.append([turn, role, text])
        elif event == "delta":
            done[-1][2] += text
        elif event == "edit":
            for d in done:
                if d[0] == turn:
                    d[2] = text
        else:
            done = [d for d in done if d[0] is None or turn is None or d[0] < turn]
    return [tuple(d) for d in done]


def test_chat_fold_against_brute_force(spark):
    rng = random.Random(6)
    logs, table = {}, []
    for conv in range(400):
        turn = 0
        for seq in range(rng.randrange(1, 14)):
            event = rng.choice(["message", "message", "delta", "delta", "edit", "regenerate"])
            turn = turn + 1 if event == "message" else turn
            named = turn if event == "message" else rng.choice([None, *range(turn + 2)])
            own = (event, named, rng.choice(["user", "assistant"]), f"<{seq}>")
            logs.setdefault(conv, []).append(own)
            table.append((conv, seq, *own))
        assert list(chat.fold(reversed(logs[conv])))[::-1] == slow_fold(logs[conv]), logs[conv]
    t = chat.turns(spark.createDataFrame(table, "conv_id long, seq long, event string, turn long, role string, text string"))
    got = {}
    for r in t.orderBy("conv_id", "at").collect():
        got.setdefault(r["conv_id"], []).extend(chat.parse_turns(r["output"]))
    assert got == {c: own for c, log in logs.items() if (own := [(r, x) for _, r, x in slow_fold(log)])}


# 5 ---------------------------------------------------------------------------


def check_shards(table, got, shards=8):
    assert len(got) == len(table)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in table)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    for k in range(shards):
        assert sorted(r["slot"] for r in got if r["shard"] == k) == list(range(sum(r["shard"] == k for r in got)))


def test_resharding(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = rows(queries.op5_resharding(spark, SF))
    check_shards(table, got)
    sizes = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r["size"] for r in got)
    odd = docs(spark, AWKWARD * 2, [None, *range(2 * len(AWKWARD) - 1)])
    check_shards(odd.collect(), rows(resharding.reshard(odd)))
    assert resharding.reshard(docs(spark, [])).count() == 0


def test_resharding_flow_is_least():
    rng = random.Random(3)
    for _ in range(40):
        old = {k: rng.randrange(200) for k in range(rng.randrange(1, 6))}
        n = rng.randrange(1, 6)
        cuts = resharding.plan(old, n)
        total = sum(old.values())
        capacity = [total // n + (k < total % n) for k in range(n)]
        assert [sum(hi - lo for _, lo, hi, k in cuts if k == j) for j in range(n)] == capacity
        assert all(sum(hi - lo for i, lo, hi, _ in cuts if i == s) == size for s, size in old.items())
        moved = sum(hi - lo for i, lo, hi, k in cuts if i != k)
        assert moved == sum(max(0, size - (capacity[i] if i < n else 0)) for i, size in old.items())


def test_resharding_writes_changed_shards(spark, tmp_path):
    d = docs(spark, [f"text {k}" * (k % 7) for k in range(40)] + ["twice"] * 2, [*range(39), None, 7, 7])
    changed = resharding.rewrite(d, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    want = [(r["doc_id"], r["shard"]) for r in resharding.reshard(d).collect() if r["shard"] in changed]
    assert sorted(map(str, ((r["doc_id"], r["shard"]) for r in back.collect()))) == sorted(map(str, want)) and back.columns == [*d.columns, "shard"]
    settled = resharding.rewrite(d.limit(0), str(tmp_path / "none"))
    assert settled == []


def test_resharding_keeps_copies_of_all_sources_together(spark):
    rng = random.Random(6)
    texts = [rng.randbytes(rng.randrange(20, 120)).hex() for _ in range(4000)]
    table = [(k, t, f"s{rng.randrange(20)}") for k, t in enumerate(texts + [t for t in texts[:60] for _ in range(rng.randrange(1, 4))] + ["hot" * 300] * 80)]
    got = rows(resharding.reshard(spark.createDataFrame(table, "doc_id long, text string, source string")))
    shards, olds = {}, {}
    for r in got:
        shards.setdefault(table[r["doc_id"]][1], set()).add(r["shard"])
        olds.setdefault(table[r["doc_id"]][1], set()).add(r["old_shard"])
    assert sum(len(olds[t]) > 1 for t in texts[:60]) > 30
    assert all(len(shards[t]) == 1 for t in texts)
    sizes = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    assert max(sizes) - min(sizes) < 0.1 * sum(sizes) / 8 and len(shards["hot" * 300]) > 1


# 6 ---------------------------------------------------------------------------


def test_mixing_targets_and_rerun(spark):
    got = rows(queries.op6_mixing(spark, SF))
    again = rows(queries.op6_mixing(spark, SF))
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source[r["doc_id"]]] += r["taken"]
        target[source[r["doc_id"]]] = r["target"]
    assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    assert abs(sum(target.values()) - 1.5 * sum(r["size"] for r in got)) < 1


def test_mixing_awkward(spark):
    d = docs(spark, AWKWARD)
    got = {r["doc_id"]: r for r in rows(mixing.mix(d))}
    assert {i: r["size"] for i, r in got.items()} == {i: len(re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in enumerate(AWKWARD)}
    assert mixing.mix(docs(spark, [])).count() == 0
    assert all(r["taken"] == 0 for r in rows(mixing.mix(docs(spark, [None, ""]))))
    out = rows(mixing.mixed_rows(d))
    words = Counter()
    for r in out:
        words[r["doc_id"]] += len(re.findall("[^\x20\x09-\x0d]+", r["text"]))
    assert {i: r["taken"] for i, r in got.items() if r["taken"]} == {i: n for i, n in words.items()}


# 7 ---------------------------------------------------------------------------


def slow_dedup(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for k in range(len(d) - length + 1):
            if seen[d[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), sum(gone), sum(1 for k, _ in itertools.groupby(gone) if k), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_array():
    rng = random.Random(1)
    for _ in range(400):
        s = bytes(rng.randrange(rng.choice([1, 2, 3, 200])) for _ in range(rng.randrange(60)))
        assert suffix.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_suffix_dedup_against_brute_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(queries.op7_suffix_dedup(spark, SF))}
    assert got == dict(zip([r["doc_id"] for r in table], slow_dedup([r["text"] for r in table], 200), strict=True))


@pytest.mark.parametrize("most", [2, 2000])
def test_suffix_dedup_awkward(spark, most):
    rng = random.Random(9)
    words = [rng.randbytes(4).hex() for _ in range(25)]
    texts = [*AWKWARD, "ab" * 300, "ab" * 90, *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60))]
    texts += texts[10:25]
    for length, k in ((60, 20), (200, 64)):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows(suffix.dedup(docs(spark, texts), length, k=k, most=most))}
        assert [got[i] for i in range(len(texts))] == slow_dedup(texts, length)
    assert suffix.dedup(docs(spark, [])).count() == 0
    assert suffix.dedup(docs(spark, ["x" * 300, "x" * 300], [None, None])).where("n_removed = 300").count() == 2


def test_suffix_cut_texts_keeps_columns(spark):
    out = suffix.cut_texts(docs(spark, [None, "é" * 150 + "tail", "a" + "é" * 150])).orderBy("doc_id").collect()
    assert [r["text"] for r in out] == [None, "tail", "a"] and out[1]["n_chars"] == 4 and out[1]["place"] == 7


def test_suffix_cut_texts_with_clashing_names(spark):
    rows = [(k, f"{k}" + "same " * 60, "u", "d", [k], "x", True) for k in range(3)] + [(9, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, uid string, data string, spans array<long>, `row a` string, _null boolean")
    out = suffix.cut_texts(df)
    assert out.columns == df.columns and out.schema["spans"].dataType == df.schema["spans"].dataType
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[9]["text"] is None and all(got[k]["text"] == str(k) and (got[k]["uid"], got[k]["data"], got[k]["spans"], got[k]["row a"], got[k]["_null"]) == ("u", "d", [k], "x", True) for k in range(3))
    assert suffix.cut_texts(df.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    pos, neg = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert auc > 0.85
    hit = sum(r["predicted"] for r in got if r["toxic"])
    assert hit / max(1, sum(r["predicted"] for r in got)) > 0.8 and hit / len(pos) > 0.8
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)


def test_toxicity_awkward(spark):
    texts = ["bad word. fine", "Fine day", "bad! day", "word fine", None] * 20
    ids = [k for k in range(400) if zlib.crc32(str(k).encode()) % 4 != 2][:100]
    labels = spark.createDataFrame([(i, [1, 0, 1, 0, 0][k % 5]) for k, i in enumerate(ids)] + [(None, 1), (ids[0], None)], "doc_id long, toxic int")
    model = toxicity.train(docs(spark, texts, ids), labels)
    assert model.score("fine day. such a bad day") > 0.5 > model.score("fine word day.")
    assert model.offending("fine day. such a BAD day")[0][0] == "such a bad day"
    got = rows(toxicity.score(docs(spark, [*AWKWARD, "bad"], [None, *range(len(AWKWARD))]), model))
    assert len(got) == len(AWKWARD) + 1 and all(0 <= r["score"] <= 1 for r in got)
    one = toxicity.train(docs(spark, ["a"], [ids[1]]), labels)
    assert one.weights == {} and one.score("x") < 0.3 and one.score(None) == 0
    labels = spark.createDataFrame([(None, 1), (1, None)], "doc_id long, toxic int")
    assert toxicity.train(docs(spark, []), labels).weights == {}
    assert toxicity.score(docs(spark, []), model).count() == 0
    assert sorted(r["text"] or "" for r in toxicity.keep_clean(docs(spark, ["bad", "fine", None, ""]), model).collect()) == ["", "", "fine"]


def test_toxicity_noisy_or_and_gradient():
    """Scores against the product over sentences, the gradient against differences of the loss."""
    rng = np.random.default_rng(5)
    vocab = {f: k for k, f in enumerate(["bad$", "bad", "ill$", "worse$"])}
    texts = [". ".join(" ".join(rng.choice(["bad", "badly", "ill", "worse", "good", "day"], rng.integers(0, 4))) for _ in range(rng.integers(0, 5))) for _ in range(30)]
    theta, bias = rng.normal(0, 1, 4), -1.5
    y = rng.integers(0, 2, 30).astype(float)
    model = toxicity.Model(bias, {f: theta[k] for f, k in vocab.items()})

    def plainly(text, theta, bias):
        quiet = 1.0
        for s in toxicity.sentences(text):
            found = {f for w in s.split() for f in toxicity.features(w) if f in vocab}
            quiet *= 1 - 1 / (1 + np.exp(-bias - sum(theta[vocab[f]] for f in found)))
        return 1 - quiet

    assert all(abs(model.score(t) - plainly(t, theta, bias)) < 1e-12 for t in texts)
    coded = [toxicity.encode(t, vocab) for t in texts]
    sizes = [c[2] for c in coded]
    d_of = np.repeat(np.arange(30), [len(x) for x in sizes])
    s_of = np.repeat(np.arange(len(d_of)), [k for x in sizes for k in x])
    own = np.array([k for c in coded for k in c[1]])
    got = toxicity.gradient(theta, bias, y, np.array([c[0] for c in coded], float), own, s_of, d_of, len(d_of))

    def loss(theta, bias):
        p = np.array([max(plainly(t, theta, bias), 1e-9) for t in texts])
        return -np.mean([np.log(a) if b else np.log(1 - a) for a, b in zip(p, y, strict=True) if b or a < 1])

    shown = [k for k in range(30) if texts[k].replace(".", "").strip()]
    texts, y = [texts[k] for k in shown], y[shown]
    full = 30 / len(shown)
    for k in range(5):
        step = np.eye(5)[k] * 1e-6
        diff = (loss(theta + step[:4], bias + step[4]) - loss(theta - step[:4], bias - step[4])) / 2e-6
        assert abs(diff - got[k] * full) < 1e-6


# 9 ---------------------------------------------------------------------------


def test_html_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var t="</p><article>";</script></head><body class="has-sidebar">
    <header><p>Site</p></header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><div class="cookie-notice">Cookies!</div>
    <main><article><h1>Head &amp; <i>tail</i></h1><p>One\n  two&nbsp;three<br>four<p>Un<b>closed &lt;x&gt; &#8364;</p><div class="ad">Buy</div><aside>side</aside>
    <form><p>mail</p></form><blockquote>Quote</blockquote></article></main><div id="comments"><article><p>nice post</p></article></div><footer>&copy; me</footer></body></html>"""
    inside = '<article><h2 id="discussion">D</h2><p class="legal-notice">n</p><div id="search-results">r</div><div class="post-comments">c</div><p class="ad">a</p><section class="share box">s</section><p>t</p></article>'
    assert [t for z, t in html_text.blocks(inside) if z == "main"] == ["D", "n", "r", "t"]
    line = "the line that all pages of this host have in common"
    free = ["menu of the site", f"own words {line} and a rest", line[:20]]
    at = [len(free[0]) + 1 + len("own words ")]
    spans = [(0, len(free[0]) - 8), (at[0], at[0] + len(line) - 8), (sum(map(len, free[:2])) - 2, sum(map(len, free)) + 2 - 8)]
    assert html_text.unique_runs(free, spans, 8) == ["own words and a rest"]
    assert html_text.unique_runs(["menu", "Story one"], [(0, 3)], 8) == ["Story one"]  # repeated up to the first word
    cut = '<body><nav>m<article><p>text goes on <a href="'
    assert html_text.blocks('<div class="sidebar">s</div><div id="post-content"><p>in</p></div><section class="post-comments">c</section>') == [("noise", "s"), ("main", "in"), ("noise", "c")]
    assert html_text.blocks('<head><title>t</title><body><div id="header">h</div><article><div class="article-header"><h1>T</h1></div><select><p>x <iframe>y</article>') == [("noise", "h"), ("main", "T"), ("main", "x y")]
    df = spark.createDataFrame([(1, "http://a/1", page, "c"), (2, None, None, "c"), (None, "u", "", "c"), (4, "http://a/2", cut, "c"), (4, "http://a/2", "<script>x", "c"), (5, "x", "plain & simple", "c")], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["text"]) for r in rows(html_text.extract(df))}
    assert got == {(1, "Head & tail\n\nOne two three four\n\nUnclosed <x> €\n\nQuote"), (2, ""), (None, ""), (4, "text goes on"), (4, ""), (5, "plain & simple")}
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_host_boilerplate(spark):
    frame = "<div><p>All the sections of our great example site in one long line</p></div>{}<div>Call us any day of the week or write a letter to the office</div>"
    df = spark.createDataFrame([(k, f"http://{'ab'[k % 2]}.example/{k}", frame.format(f"<p>Story number {k} has words of its own: {hashlib.md5(str(k).encode()).hexdigest() * 3}</p>")) for k in range(12)] + [(99, "http://c.example/", frame.format("<p>Alone</p>"))], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in rows(html_text.extract(df))}
    assert all(r["text"].startswith("Story number") and r["decided"] == "host" for i, r in got.items() if i != 99)
    assert got[99]["text"].count("\n\n") == 2


def test_html_tables_articles(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r["page_id"]: r["text"] for r in rows(queries.op9_html(spark, SF))}
    assert set(got) == set(pages)
    for i, page in pages.items():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
        parts = [re.sub(r"\s+", " ", __import__("html").unescape(re.sub(r"<[^>]*>", " " if "br" in p else "", p))).strip() for p in re.split(r"</?(?:p|h1)>", inner)]
        assert got[i] == "\n\n".join(p for p in parts if p)


# 10 --------------------------------------------------------------------------


def test_prefix_hash_spans_and_extensions():
    rng = random.Random(2)
    s, t = ("".join(rng.choice("abé😀") for _ in range(200)) for _ in range(2))
    a, b = prefix_hash.PrefixHash(s), prefix_hash.PrefixHash(t)
    for _ in range(300):
        i, j, n = rng.randrange(190), rng.randrange(190), rng.randrange(1, 5)
        assert (a.span(i, i + n) == b.span(j, j + n)) == (s[i : i + n] == t[j : j + n])
        k = 0
        while i + k < 200 and j + k < 200 and s[i + k] == t[j + k]:
            k += 1
        assert prefix_hash.longest_common_extension(a, i, b, j) == k


def slow_likeness(a, b, span=prefix_hash.SPAN):
    """Common spans as in span_likeness, found by looking at the texts."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    w = max(1, min(span, min(len(a), len(b)) // 2))
    i, in_a, in_b = 0, set(), set()
    while i + w <= len(a):
        j = b.find(a[i : i + w])
        if j < 0:
            i += 1
            continue
        n = w
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        in_a.update(range(i, i + n))
        in_b.update(range(j, j + n))
        i += n - w + 1
    return 2 * min(len(in_a), len(in_b)) / (len(a) + len(b))


def test_prefix_hash_likeness_against_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        alphabet = rng.choice(["ab", "abcdefé😀", "the quick brown fox "])
        a = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 160)))
        b = rng.choice([a, a[rng.randrange(len(a) + 1) :], a[: len(a) // 2] + "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 80))), a[::-1], a * 2])
        got = prefix_hash.span_likeness(prefix_hash.PrefixHash(a), prefix_hash.PrefixHash(b))
        assert abs(got - slow_likeness(a, b)) < 1e-12, (a, b)


def check_pairs(spark, table, got):
    order = sorted(table, key=lambda r: r["doc_id"])
    assert len(got) == len(order)
    by = {r["doc_id"]: r for r in got}
    prints: dict = {}
    for k, r in enumerate(order):
        t, n = r["text"] or "", order[(k + 1) % len(order)]["text"] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        g = by[r["doc_id"]]
        assert (g["n_chars"], g["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        if len(t) + len(n) < 3000:
            assert abs(g["near_edited"] - slow_likeness(t, edited)) + abs(g["near_next"] - slow_likeness(t, n)) < 1e-9
        assert (g["near_next"] == 1) >= (t == n) and (g["fingerprint"] == g["edited_fingerprint"]) == (t == edited)
        prints.setdefault(g["fingerprint"], set()).add(t)
    assert all(len(v) == 1 for v in prints.values()) and len(prints) == len({r["text"] or "" for r in order})


def test_prefix_hash_pairs(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = rows(queries.op10_prefix_hash(spark, SF))
    check_pairs(spark, table, got)
    long = [r for r in got if r["n_chars"] > 500 and r["near_next"] < 0.2]
    assert min(r["near_edited"] for r in long) >= 0.49
    odd = docs(spark, AWKWARD)
    check_pairs(spark, odd.collect(), rows(prefix_hash.pair_fingerprints(odd)))
    assert prefix_hash.pair_fingerprints(docs(spark, [])).count() == 0
    assert rows(prefix_hash.pair_fingerprints(docs(spark, ["solo text"])))[0]["near_next"] == 1.0
    assert prefix_hash.pair_fingerprints(docs(spark, ["a", "b", "b", None], [None, 3, 3, None])).count() == 4
    # one id and no id on many rows: ranges are cut by the texts' hash, the order stays
    ids, texts = [7] * 60 + [None] * 50 + list(range(40)), [f"text {k}" for k in range(150)]
    df = docs(spark, texts, ids).withColumn("tie", F.xxhash64("text"))
    order = [r["text"] for r in df.orderBy(F.col("doc_id").isNull(), "doc_id", "tie").collect()]
    out = prefix_hash.with_next(df, lambda batches: iter([__import__("pyarrow").RecordBatch.from_pylist([{"a": t, "b": n} for _, t, n in prefix_hash.neighbours(batches)], schema=__import__("pyarrow").schema([("a", "string"), ("b", "string")]))]), "a string, b string", 24)
    assert {r["a"]: r["b"] for r in out.collect()} == dict(zip(order, [*order[1:], order[0]], strict=True))
