"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Every shard owns `vnodes` points of a 32-bit ring. A key starts at the arc that its hash falls into, which belongs
to the next point clockwise. A shard's capacity is its even share of the rows (counts at most one apart); keys
that find it full continue clockwise to the next point of a shard with room.

The walk needs only the rows of each arc, not the keys: arc counts are summed by Spark (shards x vnodes rows, a
number that does not grow with the data), the overflow is carried clockwise on the driver, and what each arc
gives to which shard comes back as a table of rank ranges. A key's rank in its arc, by (hash, key, tie columns),
then says its shard and its slot. The order within an arc is the order in which its keys are served.

Ranks are counted in pieces of an arc: by stretches of hashes, and within a stretch by the part of the input that a row
came from, so that no task sorts all rows of one key. What stands before each piece is a sum over the pieces' counts.

Of the three laws a sharding may hold, this one holds `rows`: each row is placed by itself, and rows of a group, such
as equal texts, go where their keys put them. A group of over a shard's share could not stay together under it.
"""

from __future__ import annotations

import bisect
import json
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

RING = 1 << 32
STRETCH = 17  # bits of a stretch of hashes that is ranked by itself
PARTS = 64  # into which the rows of a stretch are told apart by where they were read


def points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """The (position, shard) of every virtual node, clockwise. A shard's points do not depend on the other shards."""
    seen: dict[int, int] = {}
    for s in range(shards):
        for v in range(vnodes):
            seen.setdefault((zlib.crc32(f"{v}|{s}|ring".encode()) * 2654435761 + s) % RING, s)
    return sorted(seen.items())


def carry(counts: list[int], owners: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For every arc the (shard, keys) in order of rank, when keys that find a shard full go on clockwise.

    First each shard serves the keys of its own arcs, clockwise from the ring's start, as far as they fit; what
    is left of each arc then continues clockwise, again from the ring's start. An arc's later keys overflow.
    """
    room = list(capacity)
    out: list[list[tuple[int, int]]] = []
    left: list[int] = []
    for c, s in zip(counts, owners, strict=True):
        own = min(c, room[s])
        room[s] -= own
        out.append([(s, own)] if own else [])
        left.append(c - own)
    n = len(counts)
    # waiting: (arc, keys) that walk; two rounds of the ring meet every shard with room
    waiting: list[list[int]] = []
    for step in range(2 * n):
        arc = step % n
        s = owners[arc]
        while waiting and room[s]:
            take = min(room[s], waiting[0][1])
            room[s] -= take
            out[waiting[0][0]].append((s, take))
            waiting[0][1] -= take
            if not waiting[0][1]:
                waiting.pop(0)
        if step < n and left[arc]:
            waiting.append([arc, left[arc]])
    assert not waiting, "capacity below the number of keys"
    return out


def _ranges(spark, rows: list[dict], schema: str) -> DataFrame:
    """A small table from a literal, without Python or RDD serialisation."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def ring_hash(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(RING))


def shard(df: DataFrame, key: str, shards: int, vnodes: int = 64, ties: list[str] | None = None) -> DataFrame:
    """`df` with `_shard` (int) and `_slot` (long, gapless from 0 within the shard).

    Counts differ by one at most. Rows with equal or null keys start at one point (null hashes as the seed does)
    and are told apart by `ties` (columns that Spark can order), then arbitrarily; repeated rows are rows of their
    own. Empty input gives empty output. `_shard`, `_slot` replace columns of those names. The order of rows in a
    stretch of hashes follows the parts of the input first, so it is that of one table, not of its rows alone.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = df.sparkSession
    ring = points(shards, vnodes)
    positions, owners = [p for p, _ in ring], [s for _, s in ring]
    # a ring of sorted positions: the arc is the number of points before the key, found through a jump table of
    # 2**12 stretches, each with the points inside it (a literal array of shards x vnodes positions in all)
    stretch: list[list[int]] = [[] for _ in range(1 << 12)]
    for p in positions:
        stretch[p >> 20].append(p)
    jump = _ranges(spark, [{"b": b, "p": s, "first": bisect.bisect_left(positions, b << 20)} for b, s in enumerate(stretch)], "b int, p array<bigint>, first int")
    # the row is carried whole, so that no column of its own can clash with those below
    hashed = df.select(F.struct("*").alias("_row"), F.col(key).alias("_key"), *[F.col(c).alias(f"_tie{i}") for i, c in enumerate(ties or [])]).withColumn("_h", ring_hash(F.col("_key")))
    found = hashed.join(F.broadcast(jump), F.shiftrightunsigned("_h", 20).cast("int") == F.col("b"))
    arc = (F.col("first") + F.size(F.filter("p", lambda p: p < F.col("_h")))) % len(ring)
    found = found.withColumn("_arc", arc.cast("int")).drop("b", "p", "first")
    # written, so that a row's part is the same for all that follows, and rows are hashed once
    found = found.withColumn("_stretch", F.shiftrightunsigned("_h", STRETCH).cast("int")).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    found = scratch.table(found, "arcs")
    piece = ["_arc", "_stretch", "_part"]
    pieces = found.groupBy(*piece).agg(F.count("*").alias("_n"))
    counted = {r["_arc"]: r["n"] for r in pieces.groupBy("_arc").agg(F.sum("_n").alias("n")).collect()}
    counts = [counted.get(a, 0) for a in range(len(ring))]
    total = sum(counts)
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    filled = [0] * shards
    plan = []
    for a, parts in enumerate(carry(counts, owners, capacity)):
        rank = 0
        for s, n in parts:
            plan.append({"a": a, "lo": rank, "hi": rank + n, "s": s, "base": filled[s] - rank})
            rank += n
            filled[s] += n
    given = _ranges(spark, plan, "a int, lo bigint, hi bigint, s int, base bigint").groupBy("a").agg(F.collect_list(F.struct("lo", "hi", "s", "base")).alias("_plan"))
    order = [F.col("_h"), F.col("_key"), *(F.col(f"_tie{i}") for i in range(len(ties or [])))]
    # the first arc holds the hashes at both ends of the ring; any order of its stretches will do
    before = pieces.withColumn("_before", F.sum("_n").over(Window.partitionBy("_arc").orderBy("_stretch", "_part")) - F.col("_n")).drop("_n")
    ranked = found.withColumn("_in", F.row_number().over(Window.partitionBy(*piece).orderBy(*order)).cast("long") - 1)
    ranked = ranked.join(before.hint("merge"), piece).withColumn("_rank", F.col("_before") + F.col("_in"))
    # `given` has a row per arc: shards x vnodes rows at most, whatever the input
    placed = ranked.join(F.broadcast(given), F.col("_arc") == F.col("a"))
    mine = F.filter("_plan", lambda x: (x["lo"] <= F.col("_rank")) & (F.col("_rank") < x["hi"]))[0]
    placed = placed.withColumn("_to", mine)
    return placed.select(*[F.col("_row").getField(c).alias(c) for c in df.columns if c not in ("_shard", "_slot")], F.col("_to.s").alias("_shard"), (F.col("_to.base") + F.col("_rank")).alias("_slot"))


def op10_ring_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, law `rows`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    slim = docs.select("doc_id", (F.length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    out = shard(slim, "doc_id", 40, ties=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"), F.col("_slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
