"""The knowledge graph as an edge table: neighbours, degrees, types, paths between entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import flip, popularity
from ..model import DIFFERENT_FROM, INSTANCE_OF, SUBCLASS_OF, TRANSITIVE, TYPE_PROPERTIES
from ..sources.shared import plain_unions
from ..sources.shared import table as stored

STATEMENT_TAGS = ["NORMAL", "PREFERRED", "DEPRECATED"]
FEW = 1 << 17  # keys that are sent to every task, so that what they are looked up in is not shuffled

Degree = DataFrame | Callable[[DataFrame], DataFrame]


def few(df: DataFrame) -> DataFrame:
    """`df`, which is counted here and so should be cheap to make: sent to every task by the joins that read it if it has
    at most `FEW` rows. Results do not depend on it."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def is_entity(tag: Column) -> Column:
    return tag.isin(STATEMENT_TAGS)


def signed(edges: DataFrame) -> DataFrame:
    """Edges with `pid` as it is written in paths: backward ones begin with (-)."""
    return edges.withColumn("pid", F.when(F.col("backward") & ~F.col("pid").startswith("(-)"), F.concat(F.lit("(-)"), "pid")).otherwise(F.col("pid")))


def mirrored(edges: DataFrame) -> DataFrame:
    """Forward edges and, for those between entities, the same seen from the object."""
    back = edges.where(is_entity(F.col("tag"))).select(F.col("object").alias("subject"), "pid", F.lit(True).alias("backward"), F.col("subject").alias("object"), "tag", "ord")
    return edges.unionByName(back)


def without_property(edges: DataFrame, pid: str = DIFFERENT_FROM) -> DataFrame:
    return edges.where(~F.col("pid").contains(pid))


def subgraph(edges: DataFrame, entities: DataFrame) -> DataFrame:
    return edges.join(entities.select(F.col("entity").alias("subject")).distinct(), "subject", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """(entity, num_edges): objects over all properties, both directions."""
    return edges.groupBy(F.col("subject").alias("entity")).agg(F.count("*").alias("num_edges"))


def degrees_of(nodes: DataFrame, edges: DataFrame, own: DataFrame, complete: DataFrame) -> DataFrame:
    """`degrees` of `nodes` (entity). Of those in `complete` (entity), `own` has all edges; the whole graph is only read
    for others, if there are any."""
    known = degrees(subgraph(own, few(nodes.join(complete, "entity", "left_semi"))))
    rest = stored(nodes.join(complete, "entity", "left_anti"), "nodes")
    return known.unionByName(degrees(subgraph(edges, few(rest)))) if rest.limit(1).count() else known


def label_of(entities: DataFrame, nodes: DataFrame) -> DataFrame:
    """(entity, label): the first label; a fixed text for none; '' for an unknown entity."""
    first = F.when(F.size("labels") > 0, F.element_at("labels", 1)).otherwise("No English Label")
    return entities.select("entity").distinct().join(nodes.select("entity", first.alias("label")), "entity", "left").select("entity", F.coalesce("label", F.lit("")).alias("label"))


def supertypes(edges: DataFrame, subclass_of: str = SUBCLASS_OF) -> DataFrame:
    """(type, supertype)."""
    return edges.where((F.col("pid") == subclass_of) & ~F.col("backward")).select(F.col("subject").alias("type"), F.col("object").alias("supertype")).distinct()


def types_by_level(entities: DataFrame, edges: DataFrame, levels: int = 3, preferred: list[str] | None = None, instance_of: str = INSTANCE_OF, subclass_of: str = SUBCLASS_OF) -> DataFrame:
    """(entity, type, level): level 1 from the preferred properties if the entity has any, else its classes; each
    further level the superclasses of the one before."""
    wanted = [*(preferred or TYPE_PROPERTIES), instance_of]
    mine = stored(subgraph(edges.where(~F.col("backward") & F.col("pid").isin(wanted)), entities), "typed")
    own = mine.where(F.col("pid").isin(preferred or TYPE_PROPERTIES)).select(F.col("subject").alias("entity"), F.col("object").alias("type")).distinct()
    classes = mine.where(F.col("pid") == instance_of).select(F.col("subject").alias("entity"), F.col("object").alias("type")).distinct()
    level = own.unionByName(classes.join(own.select("entity").distinct(), "entity", "left_anti"))
    up = stored(supertypes(edges, subclass_of), "supertypes")
    out = level.withColumn("level", F.lit(1))
    for k in range(2, levels + 1):
        level = level.join(up, "type").select("entity", F.col("supertype").alias("type")).distinct()
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def type_neighbours(types: DataFrame, edges: DataFrame, instance_of: str = INSTANCE_OF) -> DataFrame:
    """(type, neighbour): entity neighbours of types but for their instances."""
    kept = signed(edges).where(is_entity(F.col("tag")) & (F.col("pid") != "(-)" + instance_of))
    return kept.join(types.select(F.col("type").alias("subject")).distinct(), "subject", "left_semi").select(F.col("subject").alias("type"), F.col("object").alias("neighbour")).distinct()


def _entity_edges(edges: DataFrame, ends: DataFrame) -> DataFrame:
    """(s, p, node): the edges between entities of the subjects in `ends`; those of several statements come several times."""
    e = signed(edges).where(is_entity(F.col("tag"))).select(F.col("subject").alias("s"), F.col("pid").alias("p"), F.col("object").alias("node"))
    return e.join(ends, "s", "left_semi")


def direct_paths(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(head, tail, path, prox): properties that link a pair, proximity 1."""
    distinct = pairs.select("head", "tail").distinct()
    return _direct(distinct, _entity_edges(edges, distinct.select(F.col("head").alias("s")).distinct()))


def _direct(pairs: DataFrame, mine: DataFrame) -> DataFrame:
    e = mine.select(F.col("s").alias("head"), F.col("node").alias("tail"), F.col("p").alias("path"))
    return pairs.join(e, ["head", "tail"]).distinct().withColumn("prox", F.lit(1.0))


def two_hop(pairs: DataFrame, mine: DataFrame, degree: Degree, transitive: list[str] | None = None) -> DataFrame:
    """(head, tail, node, path, prox): links of distinct pairs over a shared neighbour, one row for each node and pair
    of edges; `mine` are the edges of the pairs' ends. `degree`: the degrees of all nodes, or what gives those of some.

    Only neighbours that some head and some tail have are of use. Pairs fan out to those of their end that has fewer,
    and meet those of the other by (end, node); all are equi-joins whose skew on hubs the adaptive planner splits. A
    property on both sides (each seen from its own end) in one direction keeps its name and proximity 1 if it is
    transitive; opposite directions weigh 1 / 1.75.
    """
    of = lambda end, p: mine.select(F.col("s").alias(end), F.col("p").alias(p), "node").join(few(pairs.select(end).distinct()), end, "left_semi")
    one, back = of("head", "p1"), of("tail", "q")
    one = stored(one.join(few(stored(back.select("node").distinct(), "nodes")), "node", "left_semi").distinct(), "heads")
    shared = few(stored(one.select("node").distinct(), "nodes"))
    back = stored(back.join(shared, "node", "left_semi").distinct(), "tails")
    degree = stored(degree(shared.withColumnRenamed("node", "entity")), "degree") if callable(degree) else degree
    size = lambda end, df: df.groupBy(end).agg(F.count("*").alias(f"{end}_edges"))
    both = pairs.join(size("head", one), "head").join(size("tail", back), "tail")
    fewer = F.col("head_edges") <= F.col("tail_edges")
    met = both.where(fewer).join(one, "head").join(back, ["tail", "node"])
    met = met.unionByName(both.where(~fewer).join(back, "tail").join(one, ["head", "node"]))
    out = met.join(degree.select(F.col("entity").alias("node"), "num_edges"), "node").withColumn("p2", flip(F.col("q"))).withColumn("pop", popularity(F.col("num_edges")))
    out = out.where("pop > 0")
    same = F.col("p1") == F.col("p2")
    chain = same & F.regexp_replace("p1", r"^\(-\)", "").isin(transitive or TRANSITIVE)
    across = F.col("p1").startswith("(-)") != F.col("p2").startswith("(-)")
    path = F.when(chain, F.col("p1")).otherwise(F.concat_ws("::", "p1", "p2"))
    prox = F.when(chain, 1.0).when(~same & across, F.col("pop") / 1.75).otherwise(F.col("pop"))
    return out.select("head", "tail", "node", path.alias("path"), prox.alias("prox"))


def paths(pairs: DataFrame, edges: DataFrame, degree: Degree, transitive: list[str] | None = None) -> DataFrame:
    """(head, tail, path, prox, best): direct links, or else two-hop ones with the least proximity of each path; `best`
    is the largest proximity over all of a pair's links."""
    plain_unions(edges.sparkSession)
    distinct = stored(pairs.select("head", "tail").distinct(), "pairs")
    ends = few(distinct.select(F.col("head").alias("s")).union(distinct.select(F.col("tail").alias("s"))).distinct())
    # the graph is read once; what follows needs the edges of the ends only
    mine = stored(_entity_edges(edges, ends), "ends")
    direct = stored(_direct(few(distinct), mine), "direct")
    rest = stored(distinct.join(direct.select("head", "tail").distinct(), ["head", "tail"], "left_anti"), "rest")
    hops = two_hop(rest, mine, degree, transitive)
    each = stored(hops.groupBy("head", "tail", "path").agg(F.min("prox").alias("prox"), F.max("prox").alias("most")), "hops")
    best = each.groupBy("head", "tail").agg(F.max("most").alias("best"))
    return direct.withColumn("best", F.lit(1.0)).unionByName(each.drop("most").join(best, ["head", "tail"]))


def rewrite(path: Column, names: Column) -> Column:
    """A path with every property replaced by what the map `names` has for it, hop by hop."""

    def hop(h):
        bare = F.regexp_replace(h, r"^\(-\)", "")
        return F.concat(F.when(h.startswith("(-)"), "(-)").otherwise(""), F.coalesce(F.try_element_at(names, bare), bare))

    return F.array_join(F.transform(F.split(path, "::"), hop), "::")


def unit_symbols(units: DataFrame, edges: DataFrame, nodes: DataFrame, symbol: str, instance_of: str, currency: str) -> DataFrame:
    """(entity, symbol): a currency's label, else the unit's first symbol."""
    money = edges.where((F.col("pid") == instance_of) & (F.col("object") == currency)).select(F.col("subject").alias("entity")).distinct().withColumn("money", F.lit(True))
    signs = edges.where(F.col("pid") == symbol).groupBy(F.col("subject").alias("entity")).agg(F.min_by("object", F.struct("ord", "object")).alias("sign"))
    out = units.select("entity").distinct().join(money, "entity", "left").join(signs, "entity", "left").join(label_of(units, nodes), "entity", "left")
    return out.select("entity", F.when(F.col("money"), F.col("label")).otherwise(F.col("sign")).alias("symbol"))
