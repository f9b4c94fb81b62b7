"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each source gets a share of the budget by its weight, at most `max_epochs` times
its own size; what a capped source can't take is dealt out again by weight until
no source is above its cap (water filling, solved in closed form over the
sources sorted by the level at which each is full).  A source takes whole
epochs first and the rest as a weighted sample without replacement: documents
in order of the key -ln(u) / w, with u from a hash of the document and w its
quality weight, are taken until their sizes reach what is left; the document at
the edge is taken in part.

Prefix sums don't need a source in one task: the key is cut into `buckets` even
ranges, sums of the buckets give each its offset, and only rows of one
(source, bucket) are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    """Words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, max_epochs: int = 2, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size), one row per source -> (source, source_size, target).

    Sources go in code point order, a null source last; the weights repeat over
    them.  An empty table gives no rows; if all sources are empty all targets
    are 0.  One row per source is all that the windows here sort.
    """
    order = W.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), F.col("source"))
    pick = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    whole = W.partitionBy(F.lit(1))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    full = W.partitionBy(F.lit(1)).orderBy("level", F.col("source").isNull(), "source")
    before = full.rowsBetween(W.unboundedPreceding, -1)
    d = sizes.withColumn("weight", pick).withColumn("cap", cap).withColumn("level", F.col("cap") / F.col("weight"))
    d = d.withColumn("left", F.least(F.sum("source_size").over(whole) * F.lit(share), F.sum("cap").over(whole)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    d = d.withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    # the water level is the first at which the next source isn't full
    d = d.withColumn("water", F.max(F.when(F.col("left") / F.col("open") < F.col("level"), F.col("left") / F.col("open"))).over(whole))
    return d.select("source", "source_size", F.when(F.col("water").isNull() | (F.col("level") <= F.col("water")), F.col("cap")).otherwise(F.col("weight") * F.col("water")).alias("target"))


def unit(row_key: Column) -> Column:
    """A hash of the key as a number in (0, 1): 48 bits of its MD5."""
    return (F.conv(F.substring(F.md5(row_key), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def _keyed(d: DataFrame, weights_of: DataFrame | None) -> DataFrame:
    """Rows with doc_id, weighed by (doc_id, weight), and their exponential key.  Texts must be gone by now: this join shuffles."""
    if weights_of is not None:
        d = d.join(weights_of.select("doc_id", F.col("weight").cast("double").alias("_w")), "doc_id", "left")
    weight = F.coalesce("_w", F.lit(1.0)) if weights_of is not None else F.lit(1.0)
    key = F.concat_ws("/", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("mix"))
    return d.withColumn("es_key", -F.log(unit(key)) / weight).drop("_w")


def mix(docs: DataFrame, quality: DataFrame | None = None, share: float = 1.5, max_epochs: int = 2, weights: tuple[float, ...] = WEIGHTS, buckets: int = 1024) -> DataFrame:
    """(doc_id, text, source) -> (doc_id, size, source, source_size, target, epochs, taken).

    size: the text's words (null: 0); taken: words the mix takes of the document,
    whole epochs plus its part of the sample, at most max_epochs times its size.
    quality: (doc_id, weight), a positive weight each, one row per doc_id; others
    weigh 1.  Rows with the same doc_id are mixed like others; ties of keys are
    broken by doc_id and then size.  Null sources are one source.  Other columns
    are dropped.
    """
    d = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix_sized(_keyed(d, quality), share, max_epochs, weights, buckets)


def mix_sized(d: DataFrame, share: float, max_epochs: int, weights: tuple[float, ...], buckets: int) -> DataFrame:
    """As mix(), from (doc_id, source, size, es_key) and any further columns, which stay."""
    d = d.withColumn("bucket", F.floor((F.lit(1.0) - F.exp(-F.col("es_key"))) * buckets).cast("int"))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    per = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), share, max_epochs, weights)
    order = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(order), F.lit(0)))
    named = offsets.join(per.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "bucket_start", "source_size", "target")
    inner = W.partitionBy("source", "bucket").orderBy("es_key", "doc_id", "size")
    run = F.coalesce(F.sum("size").over(inner.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = d.withColumn("before", run).join(named, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    # whole epochs, then words of the sample; the last word of the budget is rounded down
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("epochs", epochs)
    rest = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long") - F.col("bucket_start") - F.col("before")
    return rows.withColumn("taken", F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).drop("s", "b", "bucket", "before", "bucket_start", "es_key")


def mixed_rows(docs: DataFrame, quality: DataFrame | None = None, share: float = 1.5, max_epochs: int = 2, weights: tuple[float, ...] = WEIGHTS, buckets: int = 1024) -> DataFrame:
    """docs (doc_id, text, source, n_chars and others) as the mix takes them: a row per epoch, then one with the first words of a part.

    A text's part ends after its last word taken.  n_chars is counted anew.
    Documents without words are in no epoch and go.  Rows that agree in doc_id,
    source and text share what is taken of them evenly.  The mix is made without
    the texts, which are dealt out once, to meet their takes.
    """
    h = F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("source").isNull(), "source", F.coalesce("text", F.lit("")))
    whole = docs.withColumns({"_u": h, "_size": n_words(F.col("text"))})
    units = whole.groupBy("_u", "doc_id", "source", "_size").agg(F.count("*").alias("_m")).withColumn("size", F.col("_size") * F.col("_m"))
    mixed = mix_sized(_keyed(units, quality), share, max_epochs, weights, buckets).where("taken > 0")
    part = (F.floor(F.col("taken") / F.col("_m")) - F.col("epochs") * F.col("_size")).cast("int")
    takes = F.concat(F.array_repeat(F.col("_size").cast("int"), F.col("epochs").cast("int")), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))
    rows = whole.join(mixed.select("_u", "_size", takes.alias("_takes")), ["_u", "_size"]).withColumn("_take", F.explode("_takes"))
    cut = F.expr(r"array_join(slice(regexp_extract_all(text, '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+', 0), 1, _take), '')")
    rows = rows.withColumn("text", F.when(F.col("_take") < F.col("_size"), cut).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)
