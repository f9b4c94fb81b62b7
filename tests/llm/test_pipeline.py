"""The pipeline's stages on a small table with planted cases."""

import random

import pytest

import corpus_pipeline
from tidegraph.llm import queries, simhash
from tidegraph.llm.simhash import shingle_hashes

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, docs, SF)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
            docs = spark.createDataFrame(out.collect(), out.schema)
        else:
            assert out.count() >= docs.count()


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9)))
    originals = [[word() for _ in range(rng.randrange(80, 400))] for _ in range(60)]
    rows = [(k, " ".join(w), "en", "s", 0) for k, w in enumerate(originals)]
    for k, w in enumerate(originals[:40]):
        copy = list(w)
        for _ in range(max(1, len(w) // 100)):  # five-word shingles in common: 0.9 or so
            copy[rng.randrange(len(copy))] = word()
        rows.append((1000 + k, " ".join(copy), "en", "s", 0))
    rows += [(2000, rows[50][1], "en", "s", 0), (None, None, None, None, None), (3, rows[3][1], "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, docs, SF).collect() if r["doc_id"] is not None)
    assert [i for i in kept if i < 1000] == list(range(60))
    assert corpus_pipeline.near_copies(spark, docs, SF).where("doc_id is null").count() == 1
    assert 2000 not in kept and len([i for i in kept if 1000 <= i < 2000]) <= 1


def test_quality_weights(spark):
    w = queries.quality_weights(spark, SF)
    assert w.count() == w.select("doc_id").distinct().count()


def similarity(a, b):
    a, b = set(shingle_hashes(a, 5).tolist()), set(shingle_hashes(b, 5).tolist())
    return len(a & b) / len(a | b)


def partner(words, share):
    """Words whose five-word shingles come as close to this similarity as swapping single words of the end gets."""
    common = round(2 * share / (1 + share) * (len(words) - 4))
    return words[: common + 4] + [f"x{k}y{words[k]}" for k in range(common + 4, len(words))]


def test_near_copies_at_similarities(spark):
    rng = random.Random(8)
    base = [[f"w{k}z{rng.randrange(10**6)}" for _ in range(rng.choice([34, 94, 184, 304]))] for k in range(240)]
    texts = [" ".join(w) for w in base]
    for k, w in enumerate(base):
        texts.append(" ".join(partner(w, [0.70, 0.75, 0.80, 0.85][k % 4])))
    got = {r["doc_id"] for r in corpus_pipeline.near_copies(spark, spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"), SF).collect()}
    caught = {}
    for k in range(240):
        assert k in got
        near = similarity(texts[k], texts[240 + k])
        assert 240 + k in got or near >= 0.8, k
        caught.setdefault([0.70, 0.75, 0.80, 0.85][k % 4] if near >= 0.8 else "less", []).append(240 + k not in got)
    print({share: (sum(hit), len(hit)) for share, hit in caught.items()})
    assert sum(caught[0.80]) >= 0.97 * len(caught[0.80]) and sum(caught[0.85]) >= 0.99 * len(caught[0.85])


@pytest.mark.parametrize("limit", [3, 512])
def test_near_copies_with_hot_shingles(spark, limit):
    """A line that all texts hold, chains and a large group, against all pairs."""
    rng = random.Random(3)
    line = [f"line{k}" for k in range(14)]
    texts = [" ".join([rng.choice("abcdef") + str(rng.randrange(40)) for _ in range(rng.randrange(0, 9))] + line[: rng.randrange(9, 15)]) for _ in range(150)]
    chain = [f"c{k}" for k in range(60)]
    for _ in range(40):
        chain = list(chain)
        chain[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(chain))
    texts += [None, "", " ", "one", "One", "one two"]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = (" ".join((texts[k] or "").split()) for k in (i, j))
            if a == b or a and b and similarity(a, b) >= 0.8:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, SF).collect())
    assert got == sorted({top(i) for i in range(len(texts))})
    found = simhash.near_texts(df.select(*simhash.text_keys(df.text), "text"), bucket_limit=limit, block=limit).collect()
    groups: dict = {}
    for i, t in enumerate(texts):
        groups.setdefault(top(i), set()).add(t if (t or "").strip() else None)
    assert len({r["component"] for r in found}) == sum(len(g) > 1 for g in groups.values())


def test_near_copies_of_equal_ids(spark):
    x, y, z = (" ".join(f"{c}{k}" for k in range(60)) for c in "xyz")
    df = spark.createDataFrame([(5, x, "en", "s", 0), (5, y + " more", "en", "s", 0), (3, y, "en", "s", 0), (7, z, "en", "s", 0), (7, x + " end", "en", "s", 0), (9, y, "en", "s", 0), (9, " ".join(f"q{k}" for k in range(60)), "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {(r["doc_id"], r["text"][0]) for r in corpus_pipeline.near_copies(spark, df, SF).collect()}
    assert got == {(5, "x"), (3, "y"), (7, "z"), (9, "q")}


def test_stages_of_an_empty_table_and_of_nulls(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    odd = [(None, None, None, None, None), (1, "", "en", None, 0), (1, None, "en", "s", None), (2, "one two three four five six", None, "s", 27), (2, "one two three four five six", None, "s", 27)]
    for rows, left in (([], 0), (odd, 1)):
        docs = spark.createDataFrame(rows, schema)
        for k, (_, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, docs, str(tmp_path))
            if k < 4:
                docs = spark.createDataFrame(out.collect(), schema)
            assert (out.count() > 0) == (left > 0)
