"""Texts of varying length combined into containers of fixed capacity with as little room left as possible.

Planning works on a histogram of lengths: best fit over counts, longest first, so its cost depends on the capacity and not on
the number of texts. The plan gives each length its slots (ranges of ranks and of containers), and each text takes the slot
of its rank among the texts of its length. A text is split only if it exceeds the capacity: into full containers and one
rest, which is planned like any other length. Pieces that fill a container take one of their own, without rank or join.

Nothing is joined on a length alone: ranks are counted within (length, salt), with as many salts as the length has texts to
share out, and the plan, whose size depends on the capacities only, goes to every task.

Defined results: null, blank-token and empty texts have no pieces. Capacities that are null or below 1 are left out. Texts
of equal length are ranked by a salt of their id, then by id; repeated ids are pieces of their own. Every piece is placed
exactly once. Container ids are unique within a capacity, but not dense.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.tokens import VOCABULARY, token_sizes
from ledgerloom.session import written

#: How many texts of one length are ranked together: a length has a salt for each so many texts it holds.
RANKED = 200_000


@dataclass
class Group:
    """Containers ``first`` to ``first + count - 1``, all filled alike: (length, per container, first rank)."""

    first: int
    count: int
    room: int
    items: list[tuple[int, int, int]] = field(default_factory=list)

    def split(self, count: int) -> "Group":
        """Takes the first ``count`` containers out of this group."""
        head = Group(self.first, count, self.room, list(self.items))
        self.items = [(length, per, rank + per * count) for length, per, rank in self.items]
        self.first += count
        self.count -= count
        return head


def plan(histogram: dict[int, int], capacity: int) -> list[Group]:
    """Best fit, longest first, of ``histogram`` (length to count) into containers of ``capacity``."""
    by_room: dict[int, list[Group]] = {}
    rooms: list[int] = []
    full: list[Group] = []
    opened = 0

    def put(g: Group) -> None:
        if g.room == 0:
            full.append(g)
            return
        if g.room not in by_room:
            by_room[g.room] = []
            insort(rooms, g.room)
        by_room[g.room].append(g)

    for length in sorted((k for k, n in histogram.items() if n > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                per = capacity // length
                whole, rest = divmod(left, per)
                for count, each in ((whole, per), (1, rest)):
                    if count and each:
                        put(Group(opened, count, capacity - each * length, [(length, each, rank)]))
                        opened += count
                        rank += count * each
                left = 0
                break
            room = rooms[at]
            g = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            per = room // length
            take = min(g.count, left // per)
            if take == 0:
                per, take = left, 1
            if take < g.count:
                head = g.split(take)
                put(g)
                g = head
            g.items.append((length, per, rank))
            g.room -= per * length
            rank += per * take
            left -= per * take
            put(g)
    return full + [g for gs in by_room.values() for g in gs]


def pack(docs: DataFrame, specs: DataFrame, id: str = "doc_id", text: str = "text", spec: str = "spec_id", capacity: str = "capacity_tokens", vocabulary: str = VOCABULARY, max_capacity: int = 1 << 20) -> DataFrame:
    """(spec_id, container_id, doc_id, piece_no, start_token, piece_tokens, container_room) for every piece of every text.

    Capacities above ``max_capacity`` are refused: the histogram that is planned on has at most as many lengths.
    """
    spark = docs.sparkSession
    wanted = {r.s: r.c for r in specs.select(F.col(spec).alias("s"), F.col(capacity).cast("long").alias("c")).where("s is not null and c >= 1").collect()}
    if any(c > max_capacity for c in wanted.values()):
        raise ValueError(f"a capacity exceeds {max_capacity}")
    sized = written(token_sizes(docs.where(F.col(id).isNotNull()), text, [id], vocabulary).where("tokens > 0"))
    kind = dict(specs.dtypes)[spec]
    if not wanted:
        return sized.select(F.lit(None).cast(kind).alias(spec), F.lit(0).cast("long").alias("container_id"), F.col(id), F.lit(0).alias("piece_no"), F.lit(0).cast("long").alias("start_token"), "tokens", F.lit(0).cast("long").alias("container_room")).withColumnRenamed("tokens", "piece_tokens").limit(0)
    caps = F.array(*[F.struct(F.lit(s).cast(kind).alias("spec"), F.lit(c).cast("long").alias("cap")) for s, c in sorted(wanted.items())])
    # a text has one rest for each capacity; what comes before it are full containers
    rests = sized.select(F.col(id).alias("id"), "tokens", F.explode(caps).alias("c")).select(
        "id", "c.spec", "c.cap", F.floor((F.col("tokens") - 1) / F.col("c.cap")).cast("int").alias("last"), ((F.col("tokens") - 1) % F.col("c.cap") + 1).alias("size")
    )
    open_rests = rests.where("size < cap")
    histogram: dict = {s: {} for s in wanted}
    for r in open_rests.groupBy("spec", "size").count().collect():
        histogram[r.spec][r["size"]] = r["count"]
    rows, opened = [], {}
    for s, c in wanted.items():
        slots: dict[int, list] = {}
        opened[s] = 0
        for g in plan(histogram[s], c):
            opened[s] = max(opened[s], g.first + g.count)
            for length, per, rank in g.items:
                slots.setdefault(length, []).append((rank, rank + per * g.count, per, g.first, g.room))
        rows += [(s, length, -(-histogram[s][length] // RANKED), sorted(x)) for length, x in slots.items()]
    schema = f"spec {kind}, size long, salts long, slots array<struct<lo:long,hi:long,per:long,first:long,room:long>>"
    # at most one row per capacity and length, however many texts there are
    planned = F.broadcast(spark.createDataFrame(rows, schema))
    salted = open_rests.join(planned, ["spec", "size"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")))
    own = Window.partitionBy("spec", "size", "salt")
    before = Window.partitionBy("spec", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("spec", "size", "salt").count().withColumn("offset", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    ranked = salted.drop("salts", "slots").withColumn("nth", F.row_number().over(own.orderBy("id")) - 1)
    placed = ranked.join(offsets, ["spec", "size", "salt"]).withColumn("rank", F.col("nth") + F.col("offset")).join(planned, ["spec", "size"])
    slot = F.filter("slots", lambda x: (x["lo"] <= F.col("rank")) & (F.col("rank") < x["hi"]))[0]
    placed = placed.select("spec", "id", "last", "cap", "size", "rank", slot.alias("slot")).select(
        "spec", (F.col("slot.first") + F.floor((F.col("rank") - F.col("slot.lo")) / F.col("slot.per"))).cast("long").alias("container"), "id", F.col("last").alias("piece"), "cap", "size", F.col("slot.room").alias("room")
    )
    # full pieces are numbered where they lie, after the containers of the plan
    after = F.create_map(*[F.lit(x).cast(t) for s, n in opened.items() for x, t in ((s, kind), (n, "long"))])
    full = rests.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("last")))).where("piece < last or size = cap")
    full = full.select("spec", (after[F.col("spec")] + F.monotonically_increasing_id()).alias("container"), "id", "piece", "cap", F.col("cap").alias("size"), F.lit(0).cast("long").alias("room"))
    return placed.unionByName(full).select(
        F.col("spec").alias(spec),
        F.col("container").alias("container_id"),
        F.col("id").alias(id),
        F.col("piece").alias("piece_no"),
        (F.col("piece") * F.col("cap")).cast("long").alias("start_token"),
        F.col("size").cast("long").alias("piece_tokens"),
        F.col("room").alias("container_room"),
    )
