"""Trie of the common beginnings of conversations, built as Patricia trees.

Each conversation is a sequence of turn digests, cut into segments of ``SEGMENT`` turns, so that no row grows with the
length of a conversation. A segment hangs from the digest of all before it. Equal segments are counted once, and the
different ones are range-sorted: neighbours then share the longest beginnings. In sorted order a task keeps one path of
open points, and makes a point only where a path branches, ends or leaves the segment; turns between two points stay on
the edge. What the task before or after it shares with a task is kept turn by turn, so that partial sums of both meet in
the same points. Sums are made on points alone; at last each edge is laid out into its unary nodes by suffix sums of its
turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import only, stored

#: Turns in a segment, and bytes of a turn's digest.
SEGMENT, WIDTH = 64, 16
#: Conversations share the beginning of the first of so many ids.
FAMILY = 100
#: The turns taken from it: crc32 of the id modulo this.
HEADS = 6
TOP = bytes(32)
NOBODY = hashlib.sha256(b"").hexdigest()


def below(root: bytes, digest: bytes) -> bytes:
    """The name of the node below ``root`` that turns with this SHA-256 lead to."""
    return hashlib.sha256(root + digest).digest()


def node_of(root: bytes, prefix: bytes) -> bytes:
    return below(root, hashlib.sha256(prefix).digest()) if prefix else root


def shared_turns(a: bytes, b: bytes) -> int:
    """How many turns two segments have in common at their beginning."""
    at, most = 0, min(len(a), len(b))
    while at < most and a[at : at + WIDTH] == b[at : at + WIDTH]:
        at += WIDTH
    return at // WIDTH


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, pos, digest, size): turns of each conversation counted from 0, by turn (null first), ties by digest.

    Sorted ranges count by themselves; only the one conversation that enters a range from the last one is moved on.
    """
    order = [F.col("conv").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, conv, at = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for c in batch.column(0).to_pylist():
                conv, at = (c, at + 1) if c == conv else (c, 0)
                places.append(at)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([part] * len(batch), pa.int32()), pa.array(places, pa.int64())], names=["conv", "digest", "size", "part", "at"])

    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "digest", "size")
    ranged = stored(ranged.mapInArrow(number, "conv long, digest binary, size long, part int, at long"), "numbered")
    counts = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.withColumn("before", F.sum("n").over(before)).filter("before > 0").select("conv", "part", "before")
    # one row for each range at most, so its size is bounded by the number of ranges
    placed = ranged.join(F.broadcast(moved), ["conv", "part"], "left")
    return placed.select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "size")


def rebuilt(placed: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(conv, total) of every conversation, and (conv, total, depth, digest, size) of every turn that it has after rebuilding.

    Conversation c gets the first h turns of c - c % family (all if it has fewer, none if it is absent), then its own
    turns after its first h; h = crc32(c) % heads.
    """
    own = placed.groupBy("conv").agg(F.count("*").alias("own"))
    convs = own.withColumns({"h": F.crc32(F.col("conv").cast("string").cast("binary")) % heads, "first": F.col("conv") - F.col("conv") % family})
    convs = convs.join(own.select(F.col("conv").alias("first"), F.col("own").alias("there")), "first", "left")
    convs = convs.withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    convs = stored(convs.select("conv", "first", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("total")), "convs")
    firsts = placed.filter((F.col("pos") < heads) & (F.col("conv") % family == 0)).select(F.col("conv").alias("first"), "pos", "digest", "size")
    given = convs.join(firsts, "first").filter("pos < taken").select("conv", "total", F.col("pos").alias("depth"), "digest", "size")
    kept = placed.join(convs, "conv").filter("pos >= h").select("conv", "total", (F.col("taken") + F.col("pos") - F.col("h")).alias("depth"), "digest", "size")
    return convs.select("conv", "total"), given.unionByName(kept)


def segments(convs: DataFrame, turns: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """(conv, level, root, key, sizes, more): the segments of each conversation; one without turns has an empty one."""
    held = turns.groupBy("conv", F.floor(F.col("depth") / segment).alias("level")).agg(
        F.max("total").alias("total"), F.sort_array(F.collect_list(F.struct("depth", "digest", "size"))).alias("t")
    )
    key = F.aggregate("t", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["digest"]))
    held = held.select("conv", "level", key.alias("key"), F.transform("t", lambda x: x["size"]).alias("sizes"), ((F.col("level") + 1) * segment < F.col("total")).alias("more"), "total")
    none = convs.filter("total = 0").select("conv", F.lit(0).cast("long").alias("level"), F.lit(b"").cast("binary").alias("key"), F.array().cast("array<long>").alias("sizes"), F.lit(False).alias("more"), "total")
    held = stored(held.unionByName(none), "segments")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, root = None, TOP
        for batch in batches:
            roots = []
            for c, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                conv, root = (c, root) if c == conv else (c, TOP)
                roots.append(root)
                root = below(root, digest)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(roots, pa.binary())], names=["conv", "level", "root"])

    long = held.filter(F.col("total") > segment)
    digests = long.select("conv", "level", F.unhex(F.sha2("key", 256)).alias("digest"))
    roots = digests.repartition("conv").sortWithinPartitions("conv", "level").mapInArrow(chain, "conv long, level long, root binary")
    top = held.filter(F.col("total") <= segment).withColumn("root", F.lit(TOP))
    return stored(top.unionByName(long.join(roots, ["conv", "level"])).drop("total"), "rooted")


def sorted_paths(rooted: DataFrame) -> DataFrame:
    """The different segments in sorted ranges, each range with the segment before it and after it."""
    paths = rooted.groupBy("root", "key").agg(F.count("*").alias("n"), F.min("conv").alias("conv"), F.max("sizes").alias("sizes"), F.max("level").alias("level"), F.max("more").alias("more"))
    ranged = paths.repartitionByRange("root", "key").sortWithinPartitions("root", "key")
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "paths")
    at = F.struct("root", "key")
    ends = ranged.groupBy("part").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    # one row for each range
    w = Window.orderBy("part")
    ends = ends.select("part", F.lag("last").over(w).alias("before"), F.lead("first").over(w).alias("after"))
    return stored(ranged.join(F.broadcast(ends), "part"), "ranges")


def in_order(ranges: DataFrame, *columns: str) -> DataFrame:
    return ranges.repartition("part").sortWithinPartitions("part", "root", "key").select("part", "root", "key", "before", "after", *columns)


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, int, int, bool, bool]]:
    """(row, turns shared with the row before, with the row after, first of its range, last of it) in order; other roots share -1."""
    def shared(a, b) -> int:
        return shared_turns(a["key"], b["key"]) if a is not None and b is not None and a["root"] == b["root"] else -1

    held, before = None, -1
    for row in (r for batch in batches for r in batch.to_pylist()):
        opens = held is None or held["part"] != row["part"]
        if held is not None:
            common = shared(held, held["after"] if opens else row)
            yield held, before, common, held["opens"], opens
            before = common
        row["opens"] = opens
        before = shared(row["before"], row) if opens else before
        held = row
    if held is not None:
        yield held, before, shared(held, held["after"]), held["opens"], True


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment below the first: the code points on its own nodes, and whether its last node has no child."""
    out = []
    for row, before, after, _, _ in neighbours(batches):
        if row["level"]:
            leaf = not row["more"] and after < len(row["sizes"])
            out.append((row["root"], row["key"], sum(row["sizes"][max(before, 0) :]), int(leaf)))
    columns = list(zip(*out)) or [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int64(), pa.int64()))], names=["root", "key", "fresh", "leaf"])


_POINT = pa.schema([
    ("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("conv", pa.int64()), ("n", pa.int64()), ("children", pa.int64()), ("leaves", pa.int64()), ("saved", pa.int64()), ("tails", pa.list_(pa.int64())),
])


class _Open:
    """A point whose subtree is not read to its end: its depth within the segment, whether this range brings it, and sums so far.

    ``saved`` leaves out the turns of the edge to the point until it closes.
    """

    __slots__ = ("depth", "fresh", "n", "conv", "children", "leaves", "saved")

    def __init__(self, depth: int, fresh: bool, children: int = 0):
        self.depth, self.fresh, self.children = depth, fresh, children
        self.n, self.conv, self.leaves, self.saved = 0, None, 0, 0

    def add(self, n: int, conv: int, leaves: int, saved: int) -> None:
        self.n += n
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.leaves += leaves
        self.saved += saved


def _points(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    """Each point with its sums over the segments of a range."""
    out: list[tuple] = []
    path: list[_Open] = []
    for row, before, after, opens, closes in neighbours(batches):
        size = len(row["sizes"])
        if not path:  # the turns shared with the range before are points that it brought
            path = [_Open(d, False) for d in range(before + 1)] if opens and before >= 0 else [_Open(0, True)]
        if size > path[-1].depth:
            path[-1].children += 1
            path.append(_Open(size, True))
        leaf = not row["more"] and after < size
        path[-1].add(row["n"], row["conv"], row["below_leaves"] + leaf, row["below_saved"])
        for depth in range(after + 1) if closes else [after] if after >= 0 else []:
            _split(path, depth)
        while path and (closes or path[-1].depth > after):
            _close(path, row, out, segment)
        if len(out) >= 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _split(path: list[_Open], depth: int) -> None:
    """Make sure that the path has a point at ``depth``; one put on an edge has one child so far."""
    at = len(path)
    while path[at - 1].depth > depth:
        at -= 1
    if path[at - 1].depth < depth:
        path.insert(at, _Open(depth, True, 1))


def _close(path: list[_Open], row: dict, out: list[tuple], segment: int) -> None:
    """Take the last point off the path, write it down and add it to the one above."""
    point, root, key, level = path.pop(), row["root"], row["key"], row["level"]
    node = node_of(root, key[: point.depth * WIDTH])
    if not path:
        if level:  # the root of a lower tree is a point of the tree above it, which has all but the children
            out.append((node, None, None, None, 0, point.children, 0, 0, []))
        else:
            out.append((node, None, 0, point.conv, point.n, point.children, point.leaves, point.saved, [0]))
        return
    above = path[-1]
    edge = row["sizes"][above.depth : point.depth]
    times = point.n - point.fresh
    saved = point.saved + edge[-1] * times
    tails = [sum(edge[i:-1]) for i in range(len(edge))]
    out.append((node, node_of(root, key[: above.depth * WIDTH]), level * segment + point.depth, point.conv, point.n, point.children, point.leaves, saved, tails))
    above.add(point.n, point.conv, point.leaves, saved + tails[0] * times)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[] for _ in _POINT]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _POINT)], schema=_POINT)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the comma-joined ids of each node, from rows sorted by node and id: one state, whatever the number of ids."""
    node, state, out = None, None, []
    for batch in batches:
        for n, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = n, hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.string()))], names=["node", "ends"])
            out = []
    if node is not None:
        out.append((node, state.hexdigest()))
    columns = list(zip(*out)) or [[], []]
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string()))], names=["node", "ends"])


def _below(rooted: DataFrame, ranges: DataFrame) -> DataFrame:
    """(root, key, below_saved, below_leaves) of segments that go on: sums over all turns and leaves in the segments after them.

    Each node is counted for the smallest conversation of the segment that brings it, which is a member of all nodes above.
    """
    alone = in_order(ranges, "level", "sizes", "more").mapInArrow(_alone, "root binary, key binary, fresh long, leaf long")
    mine = ranges.filter("level > 0").select("root", "key", F.col("conv").alias("owner")).join(alone, ["root", "key"])
    long = rooted.filter("level > 0 or more").select("conv", "level", "root", "key", "more", F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))
    own = F.col("owner") == F.col("conv")
    each = long.join(mine, ["root", "key"], "left").withColumns({"gain": F.when(F.col("level") > 0, F.col("total") - F.when(own, F.col("fresh")).otherwise(0)).otherwise(0), "leaf": F.when(own, F.col("leaf")).otherwise(0)})
    later = Window.partitionBy("conv").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)
    sums = each.withColumns({"s": F.coalesce(F.sum("gain").over(later), F.lit(0)), "l": F.coalesce(F.sum("leaf").over(later), F.lit(0))})
    return sums.filter("more").groupBy("root", "key").agg(F.sum("s").alias("below_saved"), F.sum("l").alias("below_leaves"))


def digest_of(role: Column, text: Column) -> Column:
    """The first ``WIDTH`` bytes of the SHA-256 of role and text."""
    return F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", family: int = FAMILY, heads: int = HEADS, segment: int = SEGMENT) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by number, null first, and equal numbers by the digest of role and text; rows that repeat are
    turns of their own; a null role or text is empty. Rows without a conversation id belong to none and are left out.
    Conversations without turns end at the root. An empty table gives no row. Other columns are ignored.
    """
    rows = only(conversations, conv=conv_col, turn=turn_col, role=role_col, text=text_col).filter("conv is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = rows.select(F.col("conv").cast("long").alias("conv"), "turn", digest_of(role, text).alias("digest"), F.char_length(text).cast("long").alias("size"))
    convs, rebuilt_turns = rebuilt(numbered_turns(turns), family, heads)
    rooted = segments(convs, rebuilt_turns, segment)
    ranges = sorted_paths(rooted)
    ranges = stored(ranges.join(_below(rooted, ranges), ["root", "key"], "left").na.fill(0, ["below_saved", "below_leaves"]), "summed")
    parts = in_order(ranges, "n", "conv", "sizes", "level", "more", "below_saved", "below_leaves").mapInArrow(lambda batches: _points(batches, segment), "node binary, parent binary, depth long, conv long, n long, children long, leaves long, saved long, tails array<long>")
    points = parts.groupBy("node").agg(
        F.max("parent").alias("parent"), F.max("depth").alias("depth"), F.min("conv").alias("conv"), F.sum("n").alias("n"), F.sum("children").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.max("tails").alias("tails")
    )
    points = stored(points, "points")
    node = F.when(F.octet_length("key") > 0, F.unhex(F.sha2(F.concat("root", F.unhex(F.sha2("key", 256))), 256))).otherwise(F.col("root"))
    ends = rooted.filter("not more").select(node.alias("node"), "conv").repartition("node").sortWithinPartitions("node", "conv").mapInArrow(_ends, "node binary, ends string")
    named = points.join(ends, "node", "left").join(points.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv")), "parent", "left")
    # each edge is laid out into its nodes: the last is the point, the others have one child
    laid = named.select("*", F.posexplode("tails").alias("i", "tail"))
    last = F.col("i") == F.size("tails") - 1
    return laid.select(
        F.col("conv").alias("conv_id"),
        (F.col("depth") - F.size("tails") + 1 + F.col("i")).cast("long").alias("depth"),
        F.when(F.col("i") == 0, F.col("parent_conv")).otherwise(F.col("conv")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("children")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") + (F.col("n") - 1) * F.col("tail")).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NOBODY))).otherwise(F.lit(NOBODY)).alias("ends_sha256"),
    )
