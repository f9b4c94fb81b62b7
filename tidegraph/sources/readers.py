"""Scans of the formats that edges come in.  Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parsers of users: name -> (lines as a DataFrame with `value`) -> rows.
PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str, parse: Callable[[DataFrame], DataFrame]) -> None:
    PARSERS[name] = parse


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def data_lines(text: DataFrame) -> DataFrame:
    """Without comments (% or #) and blank lines."""
    return text.where(~F.col("value").rlike(r"^\s*([%#]|$)"))


def parse(name: str, text: DataFrame) -> DataFrame:
    return PARSERS[name](text)


def text_edges(text: DataFrame) -> DataFrame:
    """`src dst`, by spaces or tabs, runs of which count once."""
    p = F.split(F.trim(F.translate("value", "\t", " ")), " +")
    rows = data_lines(text).select(p.getItem(0).try_cast("long").alias("src"), p.getItem(1).try_cast("long").alias("dst"))
    return rows.where("src is not null and dst is not null")


def netflow(text: DataFrame) -> DataFrame:
    """11 comma-separated fields; ports may read PortNNNNN."""
    names = ["time", "duration", "src_device", "dst_device", "protocol", "src_port", "dst_port", "src_packets", "dst_packets", "src_bytes", "dst_bytes"]
    p = F.split("value", ",")
    cols = []
    for k, n in enumerate(names):
        c = p.getItem(k)
        if n.endswith("port"):
            c = F.regexp_replace(c, "^Port", "")
        cols.append((c if n.endswith("device") else c.try_cast("long")).alias(n))
    return data_lines(text).select(*cols).where(F.size(p) == 11)


def triples(text: DataFrame) -> DataFrame:
    """N-Triples: subject predicate object ."""
    m = r"^\s*(\S+)\s+(\S+)\s+(.*?)\s*\.\s*$"
    return data_lines(text).select(*(F.regexp_extract("value", m, k).alias(n) for k, n in ((1, "subject"), (2, "predicate"), (3, "object")))).where("subject <> ''")


def host_events(text: DataFrame) -> DataFrame:
    """JSON lines of host events; rows without process, domain or parent are left out, keys are composed."""
    schema = "UserName string, DomainName string, LogHost string, LogonID string, Time long, EventID int, ProcessID string, ProcessName string, ParentProcessID string, ParentProcessName string"
    j = text.select(F.from_json("value", schema).alias("j")).select("j.*").where("ProcessID is not null and DomainName is not null and ParentProcessID is not null")
    process = lambda c: F.concat_ws("@", c, "LogHost", "LogonID")
    return j.select(F.concat_ws("@", "UserName", "DomainName").alias("user"), process("ProcessID").alias("process"), process("ParentProcessID").alias("parent"), "ProcessName", "ParentProcessName", F.col("Time").alias("time"))


#: What the leading fields of the five logs of a computer network are; others are not used.
LANL15 = {
    "auth": (("user", 1, "user", 2), ("computer", 3, "computer", 4)),
    "proc": (("user", 1, "computer", 2),),
    "flows": (("computer", 1, "computer", 2),),
    "dns": (("computer", 1, "computer", 2),),
    "redteam": (("user", 1, "computer", 2),),
}


def lanl15(text: DataFrame, log: str) -> DataFrame:
    """Comma-separated lines of one of the five logs -> (relation, time, src_type, src_name, dst_type, dst_name).

    A line of `auth` gives an edge of users and one of computers.  Lines without
    a time or with too few fields are left out.
    """
    p = F.split("value", ",")
    edges = F.array(*(F.struct(F.lit(a).alias("src_type"), p.getItem(i).alias("src_name"), F.lit(b).alias("dst_type"), p.getItem(j).alias("dst_name")) for a, i, b, j in LANL15[log]))
    rows = data_lines(text).select(F.lit(log).alias("relation"), p.getItem(0).try_cast("long").alias("time"), F.explode(edges).alias("e")).select("relation", "time", "e.*")
    return rows.where("time is not null and src_name is not null and dst_name is not null")


def dispatch(rows: DataFrame, predicates: dict[str, str], relations: set[str], type_name: str = "type") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Triples by what their predicate is (its IRI -> a short name) -> types (name, type), edges (relation, src_name, dst_name), properties (name, property, value).

    Triples whose predicate has no name are left out.
    """
    short = F.create_map(*(F.lit(x) for kv in predicates.items() for x in kv))
    d = rows.withColumn("p", short[F.col("predicate")]).where("p is not null")
    types = d.where(F.col("p") == type_name).select(F.col("subject").alias("name"), F.col("object").alias("type"))
    edges = d.where(F.col("p").isin(sorted(relations - {type_name}))).select(F.col("p").alias("relation"), F.col("subject").alias("src_name"), F.col("object").alias("dst_name"))
    rest = d.where(~F.col("p").isin(sorted(relations | {type_name})))
    literal = F.regexp_replace("object", r'^"(.*)"(@\S+|\^\^\S+)?$', "$1")
    return types, edges, rest.select(F.col("subject").alias("name"), F.col("p").alias("property"), literal.alias("value"))


def deletes(edges: DataFrame) -> DataFrame:
    """Edges that a file of deletions names: rows to append to their log."""
    return edges.withColumn("op", F.lit(-1))


#: Fixed value: the first word of the two binary files of a streaming benchmark.
STINGER = 0x1234ABCD


def _words(content: pa.Scalar, want: str) -> np.ndarray:
    x = np.frombuffer(content.as_buffer(), "<i8")
    if not len(x) or x[0] != STINGER:
        raise ValueError(f"no {want} file")
    return x


def stinger_graph(files: DataFrame) -> DataFrame:
    """(content) of a compressed-row file (first word, vertices, edges, offsets, neighbours, weights) -> (src, pos, dst, weight).

    A file is one row: 2 GB, some 100 million edges, at most; larger graphs come as several files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                x = _words(content, "graph")
                nv, ne = int(x[1]), int(x[2])
                offsets, nbrs, weights = x[3 : 4 + nv], x[4 + nv : 4 + nv + ne], x[4 + nv + ne : 4 + nv + 2 * ne]
                src = np.repeat(np.arange(nv), np.diff(offsets))
                for at in range(0, ne, 1 << 20):
                    own = slice(at, at + (1 << 20))
                    yield pa.RecordBatch.from_arrays([pa.array(src[own]), pa.array(np.arange(ne)[own]), pa.array(nbrs[own]), pa.array(weights[own])], ["src", "pos", "dst", "weight"])

    return files.select("content").mapInArrow(run, "src long, pos long, dst long, weight long")


def stinger_actions(files: DataFrame) -> DataFrame:
    """(content) of an action file (first word, actions, pairs) -> (eid, op, src, dst); a pair whose first id is negative deletes the pair of opposite signs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                x = _words(content, "action")
                pairs = x[2 : 2 + 2 * int(x[1])].reshape(-1, 2)
                gone = pairs[:, 0] < 0
                ends = np.where(gone[:, None], -pairs, pairs)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs))), pa.array(np.where(gone, -1, 1).astype(np.int32)), pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["eid", "op", "src", "dst"])

    return files.select("content").mapInArrow(run, "eid long, op int, src long, dst long")


def actions(pairs: DataFrame) -> DataFrame:
    """(eid, src, dst) with negative ids for deletes -> (eid, op, src, dst)."""
    return pairs.select("eid", F.when(F.col("src") < 0, -1).otherwise(1).alias("op"), F.abs("src").alias("src"), F.abs("dst").alias("dst"))


def unpack(files: DataFrame, wide: bool = True, weight: str | None = None) -> DataFrame:
    """(content) of packed little-endian records (src, dst[, weight]) -> rows."""
    id_kind = "<u8" if wide else "<u4"
    return unpack_records(files, [("src", id_kind), ("dst", id_kind)] + ([("weight", weight)] if weight else []))


def unpack_records(files: DataFrame, kind: list[tuple[str, str]]) -> DataFrame:
    """(content) of packed records of one's own edge type, fields (name, numpy type) -> rows of long and double."""
    record = np.dtype(kind)
    real = {n: record[n].kind == "f" for n, _ in kind}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                x = np.frombuffer(content.as_buffer(), record)
                yield pa.RecordBatch.from_arrays([pa.array(x[n].astype(np.float64 if real[n] else np.int64)) for n, _ in kind], [n for n, _ in kind])

    return files.select("content").mapInArrow(run, ", ".join(f"{n} {'double' if real[n] else 'long'}" for n, _ in kind))


def binary_edges(spark: SparkSession, path: str, wide: bool = True, weight: str | None = None) -> DataFrame:
    """Packed records of whole files.  A file is one row here: cut inputs into files of a bounded size, or use Parquet."""
    return unpack(spark.read.format("binaryFile").load(path), wide, weight)


def csr_edges(offsets: DataFrame, nbrs: DataFrame) -> DataFrame:
    """Compressed rows (vid, start, end) and (pos, dst[, weight]) -> edges; a range join by exploding each row's places.

    The places are as many as the edges, which their estimated size doesn't tell, so they are kept from a broadcast.
    """
    places = offsets.where(F.col("end") > F.col("start")).select(F.col("vid").alias("src"), F.explode(F.sequence("start", F.col("end") - 1)).alias("pos"))
    return places.hint("merge").join(nbrs, "pos").drop("pos")


def parse_conf(text: str) -> dict[str, list[list[str]]]:
    """Sections `%%name%%` of space-separated fields: ingest and schema files."""
    out: dict[str, list[list[str]]] = {}
    section = ""
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("%%") and line.endswith("%%"):
            section = line.strip("%").strip()
            out.setdefault(section, [])
        elif line and not line.startswith("#"):
            out.setdefault(section, []).append(line.split())
    return out


def property_graph(spark: SparkSession, conf: str, root: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Pipe-separated files with header rows, as a conf lists them -> (vertices by type, edges by relation).

    A vertex's name is its type and id, its `key` the id; edges keep at most one
    property.  catalog.ingest() turns both into ids.
    """
    said = parse_conf(conf)
    read = lambda f: spark.read.option("header", True).option("sep", "|").csv(f"{root}/{f}")
    vertices = {}
    for file, kind in said.get("vertex", []):
        d = read(file)
        own = d.withColumn("_name", F.concat(F.lit(kind), d.columns[0])).withColumn("_key", F.col(d.columns[0]))
        # a property called name stays apart from the vertex's name
        own = own.select(F.col("_name").alias("name"), F.col("_key").alias("key"), *(F.col(c).alias(f"{c}_" if c in ("name", "key") else c) for c in d.columns))
        vertices[kind] = own if kind not in vertices else vertices[kind].unionByName(own, allowMissingColumns=True)
    edges = {}
    for file, relation, a, b, *prop in said.get("edge", []):
        d = read(file)
        d = d.toDF(*[f"c{k}" for k in range(len(d.columns))])
        cols = [F.concat(F.lit(a), "c0").alias("src_name"), F.concat(F.lit(b), "c1").alias("dst_name")]
        edges[relation] = d.select(*cols, *([F.col("c2").alias(prop[0])] if prop else []))
    return vertices, edges
