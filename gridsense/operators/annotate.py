"""Joint annotation of table collections: cells to entities (CEA), columns to types (CTA), pairs to relations (CPA).

Inputs are `cells` without the header row, `kinds` (table_id, col_idx, kind), lookup candidates and the graph. The four
rounds of refinement are plain function composition; what the rounds share is written to the shared folder between
them, so lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.similarity import textual_similarity
from ..functions.units import quantities
from ..functions.values import date_score, flip, number_similarity, period_score, punctuation_kinds, sigmoid_weight
from ..model import ENTITY_LABELS, PLAIN_NUMBERS, UNIT_LABELS, AnnotateConfig
from ..sources.shared import once, plain_unions
from ..sources.shared import table as stored
from . import graph

CELL = ["table_id", "row_idx", "col_idx"]
CAND = [*CELL, "entity"]
PAIR = ["table_id", "head", "tail"]


def classify_columns(cells: DataFrame, types: DataFrame) -> DataFrame:
    """(table_id, col_idx, kind): entity, date, with_unit, without_unit, index or text; none for a half-hearted date.

    A column is of entities if its entity types weigh over half, and fewer than half of its cells are long (over 150
    characters) or full of signs (over three kinds)."""
    looks = cells.groupBy("table_id", "col_idx").agg(F.avg((F.length("value") > 150).cast("double")).alias("long"), F.avg((punctuation_kinds(F.col("value")) > 3).cast("double")).alias("signs"))
    weigh = lambda labels: F.sum(F.when(F.col("label").isin(labels), F.col("score")).otherwise(0.0))
    first = lambda c: F.max(F.when(F.col("rank") == 0, F.col(c)))
    t = types.groupBy("table_id", "col_idx").agg(weigh(ENTITY_LABELS).alias("e"), weigh(UNIT_LABELS).alias("u"), weigh(PLAIN_NUMBERS).alias("p"), first("label").alias("top"), first("score").alias("top_score"))
    kind = (
        F.when((F.col("e") > 0.5) & (F.col("long") < 0.5) & (F.col("signs") < 0.5), "entity")
        .when(F.col("top") == "DATE", F.when(F.col("top_score") > 0.5, "date"))
        .when((F.col("col_idx") == 0) & (F.col("top") == "ORDINAL"), "index")
        .when(F.col("u") > 0.5, "with_unit")
        .when(F.col("p") > 0.5, "without_unit")
        .otherwise("text")
    )
    return looks.join(t, ["table_id", "col_idx"]).select("table_id", "col_idx", kind.alias("kind"))


def mentions(cells: DataFrame, kinds: DataFrame) -> DataFrame:
    of = cells.join(kinds.where("kind = 'entity'"), ["table_id", "col_idx"])
    return of.select(F.lower("value").alias("mention")).where(F.length("mention") > 1).distinct()


def demote(cells: DataFrame, kinds: DataFrame, answered: DataFrame, least: float = 0.3) -> DataFrame:
    """`kinds` where entity columns of which less than `least` of the cells got an answer are text."""
    got = cells.select("table_id", "col_idx", F.lower("value").alias("mention")).join(answered.select("mention").distinct().withColumn("a", F.lit(1)), "mention", "left")
    share = got.groupBy("table_id", "col_idx").agg(F.avg(F.coalesce("a", F.lit(0)).cast("double")).alias("share"))
    return kinds.join(share, ["table_id", "col_idx"], "left").select("table_id", "col_idx", F.when((F.col("kind") == "entity") & (F.coalesce("share", F.lit(0.0)) < least), "text").otherwise(F.col("kind")).alias("kind"))


def candidates(cells: DataFrame, kinds: DataFrame, ranked: DataFrame, top_k: int = 20) -> DataFrame:
    """(table_id, row_idx, col_idx, entity, rank, sim, len): the first `top_k` answers for each cell of an entity column."""
    of = cells.join(kinds.where("kind = 'entity'").select("table_id", "col_idx"), ["table_id", "col_idx"]).withColumn("mention", F.lower("value"))
    return of.join(ranked.where(F.col("rank") <= top_k).select("mention", "entity", "rank", F.col("score").alias("sim")), "mention").select(*CAND, "rank", "sim", F.length("mention").alias("len"))


@dataclass
class Context:
    """scores: (candidate, ctx_col, score); paths: (candidate, ctx_col, path); links: (table_id, head_key, tail_key, path, prox)."""

    scores: DataFrame
    paths: DataFrame
    links: DataFrame


def entity_pairs(cand: DataFrame, edges: DataFrame, degree: graph.Degree, transitive: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Pairs of candidates of one row, head left of tail, with their scores; and the paths of their entities."""
    h = cand.select("table_id", "row_idx", F.col("col_idx").alias("h_col"), F.col("entity").alias("head"), F.col("sim").alias("h_sim"), F.col("len").alias("h_len"))
    t = cand.select("table_id", "row_idx", F.col("col_idx").alias("t_col"), F.col("entity").alias("tail"), F.col("sim").alias("t_sim"), F.col("len").alias("t_len"))
    pairs = h.join(t, ["table_id", "row_idx"]).where("h_col < t_col and head <> tail")
    paths = stored(graph.paths(pairs, edges, degree, transitive), "paths")
    best = paths.select("head", "tail", "best").distinct()
    need = lambda n: F.when(F.col(n) > 5, 0.7).otherwise(0.9)
    side = lambda sim, n: F.when((F.col("best") > 0) & (F.col(sim) >= need(n)), F.greatest(F.lit(0.1), F.col("best") * F.col(sim))).otherwise(0.1)
    scored = pairs.join(best, ["head", "tail"], "left").withColumn("h_score", side("t_sim", "t_len")).withColumn("t_score", side("h_sim", "h_len"))
    return scored, paths


def literal_matches(cand: DataFrame, cells: DataFrame, kinds: DataFrame, edges: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """(candidate, ctx_col, mention, pid, ord, kind, match): literal edges of candidates that fit a cell of their row.
    Without `units` no quantity fits."""
    lits = cells.join(kinds.where("kind in ('date', 'with_unit', 'text')"), ["table_id", "col_idx"]).select("table_id", "row_idx", F.col("col_idx").alias("ctx_col"), F.col("value").alias("mention"), "kind")
    e = edges.where(~graph.is_entity(F.col("tag")) & ~F.col("backward")).select(F.col("subject").alias("entity"), "pid", F.col("object").alias("literal"), "tag", "ord")
    e = e.withColumn("lk", F.when(F.col("tag").startswith("DateTime"), "date").when(F.col("tag").startswith("String"), "text").when(F.col("tag").startswith("Quantity"), "with_unit"))
    pair = cand.select(*CAND).join(e, "entity").join(lits, (cand["table_id"] == lits["table_id"]) & (cand["row_idx"] == lits["row_idx"]) & (F.col("lk") == F.col("kind")) & (F.col("ctx_col") >= F.col("col_idx"))).drop(lits["table_id"]).drop(lits["row_idx"])
    date = F.when(F.col("tag") == "DateTime-Period", period_score(F.col("literal"), F.col("mention"))).otherwise(date_score(F.col("mention"), F.col("literal")))
    if units is not None:
        # a cell must hold one measure of one base unit; units are a small dimension table
        found = quantities(lits.where("kind = 'with_unit'").select(F.col("mention").alias("value")), units)
        one = found.groupBy(F.col("value").alias("mention")).agg(F.count("*").alias("measures"), F.min("base_unit").alias("mb"), F.min("amount").alias("amount")).where("measures = 1").drop("measures")
        dim = units.select(F.col("name").alias("u_name"), F.col("base_unit").alias("lb"), F.col("factor").alias("lf"))
        m = pair.join(one, "mention", "left").join(F.broadcast(dim), F.regexp_replace("tag", "^Quantity-", "") == F.col("u_name"), "left").drop("u_name")
        quantity = F.when(F.col("mb") == F.col("lb"), number_similarity(F.col("amount"), F.col("literal").try_cast("double") * F.col("lf")))
        dollar = F.col("lb") == "dollar"
    else:
        m, quantity, dollar = pair, F.lit(None).cast("double"), F.lit(False)
    text = m.where("kind = 'text'").withColumn("match", textual_similarity(F.col("mention"), F.col("literal"))).where("match > 0.9")
    other = m.where("kind <> 'text'").withColumn("match", F.when(F.col("kind") == "date", date).otherwise(quantity))
    other = other.where(F.when(F.col("kind") == "date", F.col("match") > 0).otherwise(F.col("match") > F.when(dollar, 0.75).otherwise(0.95)))
    return text.unionByName(other).select(*CAND, "ctx_col", "mention", "pid", "ord", "kind", "match")


def context(cand: DataFrame, cells: DataFrame, kinds: DataFrame, edges: DataFrame, degree: graph.Degree, units: DataFrame | None = None, transitive: list[str] | None = None) -> Context:
    """What the other cells of a row say for each candidate."""
    pairs, paths = entity_pairs(cand, edges, degree, transitive)
    pairs = stored(pairs, "pairs")
    heads = pairs.select("table_id", "row_idx", F.col("h_col").alias("col_idx"), F.col("head").alias("entity"), F.col("t_col").alias("ctx_col"), F.col("h_score").alias("score"))
    tails = pairs.select("table_id", "row_idx", F.col("t_col").alias("col_idx"), F.col("tail").alias("entity"), F.col("h_col").alias("ctx_col"), F.col("t_score").alias("score"))
    others = kinds.where("kind = 'entity'").select("table_id", F.col("col_idx").alias("ctx_col"))
    base = cand.select(*CAND).join(others, "table_id").where("ctx_col <> col_idx").withColumn("score", F.lit(0.1))
    live = pairs.where("greatest(h_score, t_score) > 0.1").join(paths.drop("best"), ["head", "tail"])
    live_paths = live.select("table_id", "row_idx", F.col("h_col").alias("col_idx"), F.col("head").alias("entity"), F.col("t_col").alias("ctx_col"), "path").unionByName(live.select("table_id", "row_idx", F.col("t_col").alias("col_idx"), F.col("tail").alias("entity"), F.col("h_col").alias("ctx_col"), "path"))
    links = live.select("table_id", F.col("head").alias("head_key"), F.col("tail").alias("tail_key"), "path", "prox")
    found = literal_matches(cand, cells, kinds, edges, units)
    lit_cols = kinds.where("kind is not null and kind <> 'entity'").select("table_id", F.col("col_idx").alias("ctx_col"))
    lit_base = cand.select(*CAND).join(lit_cols, "table_id").where("ctx_col >= col_idx").withColumn("score", F.lit(0.1))
    # dates: the last matching statement counts; texts and quantities: the best
    lit = found.groupBy(*CAND, "ctx_col").agg(F.max_by("match", F.struct("ord", "pid")).alias("last"), F.max("match").alias("most"), F.first("kind").alias("kind"))
    lit_scores = lit.select(*CAND, "ctx_col", F.when(F.col("kind") == "date", F.col("last")).otherwise(F.col("most")).alias("score"))
    scores = heads.unionByName(tails).unionByName(base).unionByName(lit_base).unionByName(lit_scores).groupBy(*CAND, "ctx_col").agg(F.max("score").alias("score"))
    all_paths = live_paths.unionByName(found.select(*CAND, "ctx_col", F.col("pid").alias("path"))).distinct()
    lit_links = found.select("table_id", F.col("entity").alias("head_key"), F.col("mention").alias("tail_key"), F.col("pid").alias("path"), F.lit(1.0).alias("prox"))
    return Context(scores, all_paths, links.unionByName(lit_links).distinct())


def first_scores(cand: DataFrame, kinds: DataFrame) -> DataFrame:
    """Candidates with `score`: before any relation is known only a tenth of the similarity counts, unless the table
    has one column."""
    cols = kinds.groupBy("table_id").agg(F.count("*").alias("c"))
    return cand.join(cols, "table_id").select(*CAND, "rank", "sim", F.when(F.col("c") > 1, 0.1 * F.col("sim")).otherwise(F.col("sim")).alias("score"))


def cpa(cea: DataFrame, cells: DataFrame, kinds: DataFrame, links: DataFrame, n_rows: DataFrame, best_only: bool, unrelated: DataFrame | None = None) -> DataFrame:
    """(table_id, head, tail, path, score, coverage, prox, rank): relations between an entity column and another to its
    right (an entity column) or a literal column not to its left."""
    h = cea.select("table_id", "row_idx", F.col("col_idx").alias("head"), F.col("entity").alias("head_key"), F.col("score").alias("hs"))
    lit = cells.join(kinds.where("kind is not null and kind <> 'entity'").select("table_id", "col_idx"), ["table_id", "col_idx"]).select("table_id", "row_idx", F.col("col_idx").alias("tail"), F.col("value").alias("tail_key"), F.lit(0.0).alias("ts"))
    t = cea.select("table_id", "row_idx", F.col("col_idx").alias("tail"), F.col("entity").alias("tail_key"), F.col("score").alias("ts")).unionByName(lit)
    both = h.join(t, ["table_id", "row_idx"]).where("head < tail")
    if unrelated is not None:
        both = both.join(unrelated, PAIR, "left_anti")
    met = both.join(links, ["table_id", "head_key", "tail_key"])
    row = met.groupBy(*PAIR, "row_idx", "path").agg(F.max(F.col("prox") * F.greatest("hs", "ts")).alias("s"), F.min("prox").alias("prox"))
    each = row.groupBy(*PAIR, "path").agg(F.count("*").alias("cnt"), F.sum("s").alias("tot"), F.min("prox").alias("prox"))
    key = F.round(F.col("cnt") * F.col("tot"), 9)
    single, forward = (~F.col("path").contains("::")).cast("int"), (~F.col("path").startswith("(-)")).cast("int")
    by = Window.partitionBy(*PAIR).orderBy(F.desc(key), F.desc("cnt"), F.desc("prox"), F.desc(single), F.desc(forward), "path")
    ranked = each.withColumn("rank", F.row_number().over(by))
    top = Window.partitionBy(*PAIR)
    first = lambda c: F.max(F.when(F.col("rank") == 1, c)).over(top)
    ranked = ranked.withColumn("keep", (key >= first(key)) if best_only else (F.col("cnt") >= first(F.col("cnt")))).where("keep")
    return ranked.join(n_rows, "table_id").select(*PAIR, "path", (F.col("tot") / F.col("n")).alias("score"), (F.col("cnt") / F.col("n")).alias("coverage"), "prox", "rank")


def cta(cea: DataFrame, types: DataFrame, n_rows: DataFrame, best_only: bool, supertypes: DataFrame | None = None, weights: tuple[float, float, float] = (1.0, 0.7, 0.2)) -> DataFrame:
    """(table_id, col_idx, type, score, coverage, rank): types that the rows of a column vote for."""
    w = F.when(F.col("level") == 1, weights[0]).when(F.col("level") == 2, weights[1]).otherwise(weights[2])
    row = cea.join(types, "entity").groupBy(*CELL, "type").agg(F.max(w * F.col("score")).alias("s"))
    each = row.groupBy("table_id", "col_idx", "type").agg(F.count("*").alias("cnt"), F.sum("s").alias("tot"))
    key = F.round(F.col("cnt") * F.col("tot"), 9)
    part = Window.partitionBy("table_id", "col_idx")
    ranked = each.withColumn("rank", F.row_number().over(part.orderBy(F.desc(key), "type"))).withColumn("key", key)
    if best_only:
        tops = ranked.withColumn("top", F.max("key").over(part)).withColumn("first", F.col("key") == F.col("top"))
        kept = tops.where("first")
        if supertypes is not None:
            above = kept.join(supertypes, "type").select("table_id", "col_idx", F.col("supertype").alias("type")).distinct()
            kept = kept.unionByName(tops.where("not first").join(above, ["table_id", "col_idx", "type"], "left_semi"))
        ranked = kept
    else:
        ranked = ranked.withColumn("least", F.max(F.when(F.col("rank") == 1, F.col("cnt"))).over(part)).where("cnt >= least")
    return ranked.join(n_rows, "table_id").select("table_id", "col_idx", "type", (F.col("tot") / F.col("n")).alias("score"), (F.col("cnt") / F.col("n")).alias("coverage"), "rank")


def context_weights(scores: DataFrame, kinds: DataFrame, relations: DataFrame, config: AnnotateConfig) -> DataFrame:
    """Context rows with `head`, `tail` (the pair they belong to), `ctx_entity` and `weight` from the pair's top relation."""
    ents = kinds.where("kind = 'entity'").select("table_id", F.col("col_idx").alias("ctx_col"), F.lit(True).alias("ctx_entity"))
    first = kinds.where("kind = 'entity'").groupBy("table_id").agg(F.min("col_idx").alias("c0"))
    s = scores.join(ents, ["table_id", "ctx_col"], "left").join(first, "table_id").withColumn("ctx_entity", F.coalesce("ctx_entity", F.lit(False)))
    turn = F.col("ctx_entity") & (F.col("ctx_col") < F.col("col_idx"))
    s = s.withColumn("head", F.when(turn, F.col("ctx_col")).otherwise(F.col("col_idx"))).withColumn("tail", F.when(turn, F.col("col_idx")).otherwise(F.col("ctx_col")))
    top = relations.where("rank = 1").select(*PAIR, "coverage", "prox")
    df = 1 / (1 + 4 * F.least(F.abs(F.col("ctx_col") - F.col("c0")), F.abs(F.col("col_idx") - F.col("c0"))))
    gain = F.col("coverage") * F.col("prox") * df
    weight = F.when(F.col("ctx_entity"), F.greatest(F.lit(0.05), config.entity_weight * F.coalesce(gain, F.lit(0.0)))).otherwise(F.greatest(F.lit(0.01), config.literal_weight * F.coalesce(gain, F.lit(0.0))))
    return s.join(top, PAIR, "left").select(*CAND, "ctx_col", "score", "ctx_entity", "head", "tail", weight.alias("weight"))


def rescore(cand: DataFrame, weighted: DataFrame, paths: DataFrame, relations: DataFrame, kinds: DataFrame, config: AnnotateConfig, unrelated: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates with `score`, cells with `contextless`): contexts that the relations found so far confirm."""
    w = weighted.join(relations.select(*PAIR).distinct(), PAIR, "left_semi")
    if unrelated is not None:
        w = w.join(unrelated, PAIR, "left_anti")
    hit = w.select(*CAND, "ctx_col", *PAIR[1:]).join(paths, [*CAND, "ctx_col"]).join(relations.select(*PAIR, "path", "coverage", F.col("prox").alias("r_prox"), "rank"), [*PAIR, "path"])
    f = hit.groupBy(*CAND, "ctx_col").agg(F.min_by(F.col("coverage") * F.col("r_prox"), "rank").alias("f"))
    w = w.join(f, [*CAND, "ctx_col"], "left").withColumn("scaled", F.greatest(F.lit(0.1), F.coalesce("f", F.lit(0.0)) * F.col("score")))
    base = F.when(F.col("ctx_entity"), config.entity_weight).otherwise(config.literal_weight)
    agg = w.groupBy(*CAND).agg(F.sum(F.col("weight") * F.col("scaled")).alias("num"), F.sum(base).alias("den"), F.max("weight").alias("most"), F.max("scaled").alias("scaled"))
    cols = kinds.groupBy("table_id").agg(F.count("*").alias("c"))
    j = cand.join(agg, CAND, "left").join(cols, "table_id")
    ctx = F.coalesce(F.col("num") / F.col("den"), F.lit(0.01))
    score = F.when(F.col("c") <= 1, F.col("sim")).when(F.col("most") > 0.1, ctx * sigmoid_weight(F.col("sim"))).otherwise(0.1 * F.col("sim"))
    scored = j.select(*CAND, "rank", "sim", score.alias("score"), F.coalesce("scaled", F.lit(0.1)).alias("scaled"))
    return scored.drop("scaled"), scored.groupBy(*CELL).agg(F.max("scaled").alias("contextless"))


def potentials(cand: DataFrame, relations: DataFrame, edges: DataFrame) -> DataFrame:
    """(candidate, n_potential, potential): relations of its column whose property the candidate has."""
    pids = graph.signed(edges).select(F.col("subject").alias("entity"), "pid").distinct()
    one = relations.where(~F.col("path").contains("::"))
    need = one.select("table_id", F.col("head").alias("col_idx"), F.col("path").alias("pid"), "coverage").unionByName(one.select("table_id", F.col("tail").alias("col_idx"), flip(F.col("path")).alias("pid"), "coverage"))
    return cand.select(*CAND).join(need, ["table_id", "col_idx"]).join(pids, ["entity", "pid"]).groupBy(*CAND).agg(F.count("*").alias("n_potential"), F.max("coverage").alias("potential"))


def cea(scored: DataFrame, best_only: bool, found_types: DataFrame | None = None, types: DataFrame | None = None, neighbours: DataFrame | None = None, contextless: DataFrame | None = None, potential: DataFrame | None = None, config: AnnotateConfig | None = None) -> DataFrame:
    """(candidate, score, rank): candidates by score, helped by the column's types if those are known. `best_only` keeps
    all ties at the top. Scores are compared rounded."""
    c = config or AnnotateConfig()
    out = scored
    if potential is not None:
        out = out.join(potential, CAND, "left")
    else:
        out = out.withColumn("n_potential", F.lit(0)).withColumn("potential", F.lit(None).cast("double"))
    total = F.col("score")
    if found_types is not None:
        per = out.select(*CAND).join(found_types.select("table_id", "col_idx", "type", F.col("score").alias("c_score")), ["table_id", "col_idx"])
        mine = types.select("entity", F.col("type").alias("own"), "level")
        lv = per.join(mine.withColumnRenamed("own", "type"), ["entity", "type"], "left").groupBy(*CAND, "type", "c_score").agg(F.min("level").alias("level"))
        near = None
        if neighbours is not None:
            beside = neighbours.select(F.col("type").alias("n_type"), F.col("neighbour").alias("own"))
            met = per.join(mine.where("level <= 2"), "entity").join(beside, (F.col("type") == F.col("n_type")) & (mine["own"] == beside["own"]))
            near = met.groupBy(*CAND, "type").agg(F.min("level").alias("n_level"))
        if near is not None:
            lv = lv.join(near, [*CAND, "type"], "left")
        else:
            lv = lv.withColumn("n_level", F.lit(None).cast("int"))
        one, two, three = c.level_weights
        grade = F.when(F.col("level") == 1, one).when((F.col("level") == 2) | (F.col("n_level") == 1), two).when((F.col("level") == 3) | (F.col("n_level") == 2), three).otherwise(0.0)
        g = lv.groupBy(*CAND).agg(F.max(grade * F.col("c_score")).alias("g"))
        w = found_types.groupBy("table_id", "col_idx").agg(F.avg("coverage").alias("w"))
        out = out.join(g, CAND, "left").join(w, ["table_id", "col_idx"], "left")
        if contextless is not None:
            out = out.join(contextless, CELL, "left").withColumn("alone", F.round(F.coalesce("contextless", F.lit(0.1)), 9) == 0.1)
        else:
            out = out.withColumn("alone", F.lit(False))
        k = F.when(F.col("alone"), F.col("w")).otherwise(F.col("w") / 2) if c.soft else F.lit(0.25)
        s0 = F.when(F.col("alone") & F.col("potential").isNotNull(), F.least(F.lit(1.0), F.col("score") * (1 + F.col("potential")))).otherwise(F.col("score"))
        total = F.when(F.col("w").isNotNull(), (s0 + k * F.coalesce("g", F.lit(0.0))) / (1 + k)).otherwise(F.col("score"))
    out = out.withColumn("total", total)
    key = F.round("total", 9)
    by = Window.partitionBy(*CELL).orderBy(F.desc(key), F.desc(F.coalesce("n_potential", F.lit(0))), "rank")
    out = out.select(*CAND, F.col("total").alias("score"), F.row_number().over(by).alias("r"), (key == F.max(key).over(Window.partitionBy(*CELL))).alias("top"))
    if best_only:
        out = out.where("top")
    return out.select(*CAND, "score", F.col("r").alias("rank"))


def unrelated_pairs(kinds: DataFrame, relations: DataFrame) -> DataFrame:
    """Pairs of an entity and a literal column, but for the entity column that covers the literal one best."""
    ent = kinds.where("kind = 'entity'").select("table_id", F.col("col_idx").alias("head"))
    lit = kinds.where("kind is not null and kind <> 'entity'").select("table_id", F.col("col_idx").alias("tail"))
    top = relations.where("rank = 1").select(*PAIR, "coverage")
    best = top.join(lit, ["table_id", "tail"]).withColumn("k", F.row_number().over(Window.partitionBy("table_id", "tail").orderBy(F.desc("coverage"), "head"))).where("k = 1 and coverage > 0").select(*PAIR)
    return ent.join(lit, "table_id").join(best, PAIR, "left_anti").select(*PAIR)


def annotate(cells: DataFrame, kinds: DataFrame, ranked: DataFrame, edges: DataFrame, types: DataFrame, supertypes: DataFrame, neighbours: DataFrame | None = None, units: DataFrame | None = None, config: AnnotateConfig | None = None, transitive: list[str] | None = None) -> dict[str, DataFrame]:
    """The whole annotation: {'cea', 'cta', 'cpa'} of the last round. `neighbours` of types are taken from the graph if
    not given.

    `edges` is read once, as it is given: for all edges of candidates and types, which are written for the rounds. Only
    where candidates share other nodes, it is read again for their degrees. A graph that is costly to make should be
    written before."""
    c = config or AnnotateConfig()
    plain_unions(cells.sparkSession)
    # all rounds read these
    cells, kinds, types, supertypes = (once(df, name) for df, name in ((cells, "cells"), (kinds, "kinds"), (types, "types"), (supertypes, "supertypes")))
    n_rows = stored(cells.groupBy("table_id").agg(F.count_distinct("row_idx").cast("double").alias("n")), "n_rows")
    cand = stored(candidates(cells, kinds, ranked, c.top_k), "candidates")
    asked = stored(cand.select("entity").union(types.select(F.col("type").alias("entity"))).distinct(), "asked")
    whole, edges = edges, stored(graph.subgraph(edges, graph.few(asked)), "edges")
    degree = lambda nodes: graph.degrees_of(nodes, whole, edges, asked)
    neighbours = stored(graph.type_neighbours(types, edges) if neighbours is None else neighbours, "neighbours")
    ctx = context(cand, cells, kinds, edges, degree, units, transitive)
    ctx = Context(stored(ctx.scores, "scores"), stored(ctx.paths, "paths"), stored(ctx.links, "links"))
    relate = lambda e, best, un=None: cpa(e, cells, kinds, ctx.links, n_rows, best, un)
    vote = lambda e, best: cta(e, types, n_rows, best, supertypes, c.level_weights)
    one = stored(relate(cea(first_scores(cand, kinds), False), False), "cpa")
    weighted = stored(context_weights(ctx.scores, kinds, one, c), "weights")
    scored, _ = rescore(cand, weighted, ctx.paths, one, kinds, c)
    scored = stored(scored, "scored")
    kinds_of = stored(vote(cea(scored, False), False), "cta")
    best = stored(cea(scored, True, kinds_of, types, neighbours, config=c), "cea")
    kinds_of, two = stored(vote(best, True), "cta"), stored(relate(best, False), "cpa")
    apart = stored(unrelated_pairs(kinds, two), "apart")
    scored, alone = rescore(cand, weighted, ctx.paths, two, kinds, c, apart)
    last = stored(cea(scored, True, kinds_of, types, neighbours, alone, potentials(cand, two, edges), c), "cea")
    return {"cea": last, "cta": vote(last, True), "cpa": relate(last, True, apart)}
