"""What a graph consists of: vertex types, relations and properties, by name.

A relation has a class, which says what a reader sees of its log:

directed, undirected, unidirected   all live edges (both ways; without in-side)
many2one                            the last destination of each source
one2many                            the last source of each destination
one2one                             both
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import encoders
from tidegraph.operators import edges as ops
from tidegraph.operators.dictionary import build, pack
from tidegraph.operators.views import GraphView
from tidegraph.sources.readers import parse_conf


def _one_to_many(log: DataFrame) -> DataFrame:
    return ops.reverse(ops.many_to_one(ops.reverse(log)))


#: class -> (kind of view, what is left of a log's inserts)
CLASSES: dict[str, tuple[str, Callable[[DataFrame], DataFrame] | None]] = {
    "directed": ("directed", None),
    "undirected": ("undirected", None),
    "unidirected": ("unidirected", None),
    "many2one": ("directed", ops.many_to_one),
    "one2many": ("directed", _one_to_many),
    "one2one": ("directed", ops.one_to_one),
}


def register_class(name: str, kind: str, reduce: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A relation class of one's own: the kind of its views, and a function over its log (eid, src, dst, ...)."""
    CLASSES[name] = (kind, reduce)


@dataclass(frozen=True)
class Entry:
    """A relation (with at most one edge property) or a vertex property."""

    id: int
    name: str
    cls: str
    prop: str | None = None
    encoder: str | None = None


@dataclass
class Catalog:
    """Ids are given in order of declaration: type ids for vertex types, one sequence for relations and properties."""

    types: dict[str, int] = field(default_factory=dict)
    entries: dict[str, Entry] = field(default_factory=dict)
    logs: dict[str, DataFrame] = field(default_factory=dict)

    def add_type(self, name: str) -> int:
        return self.types.setdefault(name, len(self.types))

    def add_relation(self, name: str, cls: str = "directed", prop: str | None = None, encoder: str = "string") -> int:
        if cls not in CLASSES:
            raise ValueError(f"no relation class {cls}")
        return self._add(name, cls, prop, encoder if prop else None)

    def add_property(self, name: str, encoder: str = "string") -> int:
        return self._add(name, "property", None, encoder)

    def add_edge_property(self, relation: str, prop: str, encoder: str = "string") -> None:
        e = self.entries[relation]
        self.entries[relation] = Entry(e.id, e.name, e.cls, prop, encoder)

    def _add(self, name: str, cls: str, prop: str | None, encoder: str | None) -> int:
        if name in self.entries:
            raise ValueError(f"{name} is declared twice")
        if encoder is not None and encoder not in encoders.ENCODERS:
            raise ValueError(f"no encoder {encoder}")
        self.entries[name] = Entry(len(self.entries), name, cls, prop, encoder)
        return len(self.entries) - 1

    def id_of(self, name: str) -> int:
        return self.entries[name].id

    def relations(self) -> list[Entry]:
        return [e for e in self.entries.values() if e.cls != "property"]

    def properties(self) -> list[Entry]:
        return [e for e in self.entries.values() if e.cls == "property"]

    @classmethod
    def from_conf(cls, text: str) -> Catalog:
        """Sections %%type%% (a name a line) and %%schema%% (name class [edge property, encoder]; class `property`: name property [encoder])."""
        said, out = parse_conf(text), cls()
        for (name, *_) in said.get("type", []):
            out.add_type(name)
        for name, kind, *rest in said.get("schema", []):
            if kind == "property":
                out.add_property(name, *rest)
            else:
                out.add_relation(name, kind, *rest)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(e.id, e.name, e.cls, e.prop, e.encoder) for e in self.entries.values()], "id long, name string, cls string, prop string, encoder string")

    def put(self, relation: str, log: DataFrame) -> None:
        """The log (eid, [op,] src, dst, ...) of a declared relation."""
        self.logs[self.entries[relation].name] = log

    def view(self, relation: str, vertices: DataFrame, hi: int | None = None) -> GraphView:
        """A view of a relation's log, as its class has it."""
        kind, reduce = CLASSES[self.entries[relation].cls]
        log = self.logs[relation] if hi is None else self.logs[relation].where(F.col("eid") < hi)
        if reduce is not None:
            live = ops.live_edges(log) if "op" in log.columns else log
            left = reduce(live.select("eid", "src", "dst"))
            log = live.join(left.select("src", "dst"), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.max("eid").alias("eid")).select("eid", "src", "dst")
        return GraphView(log, vertices, 0, hi, kind)


def ingest(catalog: Catalog, vertices: dict[str, DataFrame], edges: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Named vertices (name, key, properties...) by type and named edges (src_name, dst_name[, property]) by relation -> ids.

    Three passes: the dictionary (tid, vid, name), dense in each type by `key`
    and then name; properties (sid, name, value) as text that their encoder can
    read, nulls left out; edges (relation, src, dst, value).  sid packs type and
    vid.  Names that no file of vertices has are left out of the edges.
    """
    named, props = None, None
    for kind, d in vertices.items():
        tid = catalog.add_type(kind)
        own = d.select(F.lit(tid).alias("tid"), F.col("name"), F.coalesce(F.col("key").try_cast("long"), F.lit(0)).alias("eid"))
        named = own if named is None else named.union(own)
        for p in catalog.properties():
            column = f"{p.name}_" if p.name in ("name", "key") else p.name
            if column in d.columns:
                good = d.where(encoders.encode(p.encoder, F.col(column)).isNotNull()).select("name", F.lit(p.name).alias("property"), F.col(column).cast("string").alias("value"))
                props = good if props is None else props.unionByName(good)
    ids = build(named)
    sid = ids.select("name", pack(F.col("tid"), F.col("vid")).alias("sid"))
    values = None if props is None else props.join(sid, "name").groupBy("sid", F.col("property").alias("name")).agg(F.max("value").alias("value"))
    ends = None
    for relation, d in edges.items():
        e = catalog.entries[relation]
        value = F.col(e.prop).cast("string") if e.prop and e.prop in d.columns else F.lit(None).cast("string")
        rows = d.select(F.lit(relation).alias("relation"), "src_name", "dst_name", value.alias("value"))
        ends = rows if ends is None else ends.union(rows)
    out = ends.join(sid.toDF("src_name", "src"), "src_name").join(sid.toDF("dst_name", "dst"), "dst_name")
    return ids, values, out.select("relation", "src", "dst", "value")


#: Schemas of known applications, as conf files have them.
SNB = """%%type%%
comment
forum
person
place
post
tag
tagclass
organisation
%%schema%%
comment_hasCreator_person many2one
comment_isLocatedIn_place many2one
comment_replyOf_comment many2one
comment_replyOf_post directed
comment_hasTag_tag directed
post_hasCreator_person many2one
post_isLocatedIn_place many2one
post_hasTag_tag directed
forum_containerOf_post one2many
forum_hasModerator_person many2one
forum_hasTag_tag directed
forum_hasMember_person directed joinDate time
person_isLocatedIn_place many2one
person_hasInterest_tag directed
person_knows_person undirected creationDate time
person_likes_comment directed creationDate time
person_likes_post directed creationDate time
person_studyAt_organisation many2one classYear int64
person_workAt_organisation directed workFrom int64
organisation_isLocatedIn_place many2one
place_isPartOf_place many2one
tag_hasType_tagclass many2one
tagclass_isSubclassOf_tagclass many2one
creationDate property time
locationIP property
browserUsed property
content property
length property int64
title property
type property
name property
url property
firstName property
lastName property
gender property
birthday property
imageFile property
language property
speaks property
email property
"""
LANL15 = """%%type%%
user
computer
%%schema%%
auth unidirected time int64
proc unidirected time int64
flows unidirected time int64
dns unidirected time int64
redteam unidirected time int64
"""
HOST_EVENTS = """%%type%%
process
user
%%schema%%
proc2parent directed time int64
user2proc directed time int64
userlabel property
proclabel property
"""
LUBM = """%%type%%
entity
%%schema%%
type directed
advisor directed
affiliatedOrganizationOf directed
affiliateOf directed
degreeFrom directed
doctoralDegreeFrom directed
headOf directed
mastersDegreeFrom directed
memberOf directed
publicationAuthor directed
takesCourse directed
teacherOf directed
teachingAssistantOf directed
undergraduateDegreeFrom directed
worksFor directed
subOrganizationOf directed
publicationDate property
softwareVersion property
age property
officeNumber property
researchInterest property
title property
name property
emailAddress property
telephone property
"""
SCHEMAS = {"snb": SNB, "lanl15": LANL15, "host_events": HOST_EVENTS, "lubm": LUBM}
