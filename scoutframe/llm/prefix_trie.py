"""Prefix trie of conversations as node tables with minimal perfect hashes.

A node is a distinct sequence of first turns; conversations that begin with it are its members. Steps:

1. Turns are put in order over the whole table, so that a conversation of any length lies in as many parts as it needs.
   The digest of a prefix is the exclusive or of the digests of its turns, each bound to its place (128 bits): parts
   make their own and take over what the parts before them left.
2. Distinct digests are the nodes; members are counted where they are read (partial aggregates).
3. A node belongs to its smallest member, its owner. Shards take whole bands of depth of an owner's nodes; in a shard every
   digest gets a slot by a minimal perfect hash, checked against the digest that lies there. Counts are scattered to flat
   arrays by slot, and sums go up through the array of parents' slots, deepest nodes first.
4. A node whose parent lies elsewhere hands its sum to all nodes above it: these are the shallower prefixes of its owner, so
   its sum joins the owner's prefixes and is added per digest. No subtree is ever gathered in one place, and there are
   no rounds.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable, narrow
from .textbytes import mix


@dataclass(frozen=True)
class Trie:
    group: int = 100  # a conversation takes its first turns from the one whose id is the next lower multiple
    longest_head: int = 5
    band: int = 4_096  # depths that stay together
    shard_nodes: int = 16_384


class NodeTable:
    """Slots 0 to n - 1 for n distinct keys of three numbers, without storing where a key lies.

    Each level has a row of bits, twice as long as the keys that are left; a key that is alone at its bit stays there, the
    others go on to the next level. A key's slot is the number of set bits before its own. Keys are kept in order of slots,
    so that a key that is not in the table is told from one that is.
    """

    def __init__(self, depth: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.levels, left, done = [], np.arange(len(a)), 0
        while len(left):
            if len(self.levels) == 256:
                raise ValueError("keys repeat")
            size = max(16, 2 * len(left))
            at = self._place(depth[left], a[left], b[left], len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            self.levels.append((alone, done + np.cumsum(alone) - 1))
            done += int(alone.sum())
            left = left[~alone[at]]
        self.keys = [np.zeros(len(a), dtype=x.dtype) for x in (depth, a, b)]
        slot = self._find(depth, a, b)
        for kept, x in zip(self.keys, (depth, a, b)):
            kept[slot] = x

    @staticmethod
    def _place(depth, a, b, level: int, size: int) -> np.ndarray:
        key = mix(a.view(np.uint64) + np.uint64(level)) ^ mix(b.view(np.uint64) + depth.astype(np.uint64) + np.uint64(level << 32))
        return (mix(key) % np.uint64(size)).astype(np.int64)

    def _find(self, depth, a, b) -> np.ndarray:
        out, left = np.full(len(a), -1, dtype=np.int64), np.arange(len(a))
        for level, (alone, rank) in enumerate(self.levels):
            at = self._place(depth[left], a[left], b[left], level, len(alone))
            here = alone[at]
            out[left[here]] = rank[at[here]]
            left = left[~here]
        return out

    def slots(self, depth: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the key in its slot is another."""
        slot = self._find(depth, a, b)
        same = slot >= 0
        for kept, x in zip(self.keys, (depth, a, b)):
            same &= (kept[slot] == x) if len(kept) else False
        return np.where(same, slot, -1)


def sums_to_parents(depth: np.ndarray, parent: np.ndarray, *values: np.ndarray) -> None:
    """Add each slot's values to its parent's slot, deepest slots first; a slot without parent keeps its own."""
    order = np.argsort(-depth, kind="stable")
    for slots in np.split(order, np.flatnonzero(np.diff(depth[order])) + 1):
        slots = slots[parent[slots] >= 0]
        for value in values:
            np.add.at(value, parent[slots], value[slots])


_NODE = ["depth", "a", "b", "conv_id", "n_convs", "chars", "n_children", "pa", "pb"]


def _shard(rows: pd.DataFrame) -> pd.DataFrame:
    """applyInPandas step: the nodes of a shard with sums over what lies below them in the shard."""
    given = {c: rows[c].to_numpy(np.int64) for c in _NODE}
    table = NodeTable(given["depth"], given["a"], given["b"])
    slot = table.slots(given["depth"], given["a"], given["b"])
    flat = {c: np.empty(len(slot), dtype=np.int64) for c in _NODE}
    for c in _NODE:
        flat[c][slot] = given[c]
    parent = table.slots(flat["depth"] - 1, flat["pa"], flat["pb"])
    saved, leaves = (flat["n_convs"] - 1) * flat["chars"], (flat["n_children"] == 0).astype(np.int64)
    sums_to_parents(flat["depth"], parent, saved, leaves)
    out = pd.DataFrame({c: flat[c] for c in _NODE} | {"saved": saved, "leaves": leaves})
    out["parent_conv_id"] = pd.array(flat["conv_id"][np.maximum(parent, 0)], dtype="Int64")
    out.loc[parent < 0, "parent_conv_id"] = pd.NA
    return out


_SHARD = ", ".join(f"{c} long" for c in [*_NODE, "saved", "leaves", "parent_conv_id"])
_KEY = ["depth", "a", "b"]


def _in_parts(turns: DataFrame, plan: Trie) -> tuple[DataFrame, DataFrame]:
    """(rows, conversations): rebuilt rows (conv, part, depth, a, b, chars) and one row per conversation (conv, length, ...)."""
    # a sorted table whose numbers are written down: the upper bits of a number are the part
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b")]
    placed = turns.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id())
    rows = durable(placed.select("conv", F.shiftright("row", 33).alias("part"), "row", "a", "b", "chars"))
    runs = rows.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = durable(runs.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    convs = runs.groupBy("conv").agg(F.sum("n").alias("n_own"), F.min("part").alias("first_part"))
    convs = convs.withColumn("head", F.crc32(F.col("conv").cast("string").cast("binary")) % (plan.longest_head + 1))
    convs = convs.withColumn("base", F.col("conv") - F.col("conv") % plan.group)
    bases = convs.select(F.col("conv").alias("base"), F.col("n_own").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("taken", F.least("head", F.coalesce("n_base", F.lit(0))))
    convs = durable(convs.withColumn("length", F.col("taken") + F.greatest(F.col("n_own") - F.col("head"), F.lit(0))))

    facts = runs.select("conv", "part", "before").join(convs.select("conv", "head", "taken", "length"), "conv")
    local = F.row_number().over(Window.partitionBy("conv", "part").orderBy("row"))
    numbered = rows.withColumn("local", local).join(facts, ["conv", "part"]).withColumn("place", F.col("before") + F.col("local"))
    own = numbered.where("place > head").withColumn("depth", F.expr("taken + place - head"))
    heads = numbered.where((F.col("place") <= plan.longest_head) & (F.col("conv") % plan.group == 0)).select(F.col("conv").alias("base"), "place", "a", "b", "chars")
    # at most one conversation per id of the group takes a head
    takers = convs.where("taken > 0").select("base", "conv", F.col("first_part").alias("part"), "head", "length")
    taken = heads.join(takers, "base").where("place <= head").withColumn("depth", F.col("place"))
    columns = ["conv", "part", F.col("depth").cast("long").alias("depth"), "a", "b", "chars", "length"]
    return own.select(*columns).unionByName(taken.select(*columns)), convs


def _prefixes(rows: DataFrame) -> DataFrame:
    """Each row with the digest (a, b) of the prefix that it ends and (pa, pb) of the one before."""
    bound = [F.xxhash64(F.lit(seed), "a", "b", "depth").alias(name) for seed, name in ((3, "ta"), (4, "tb"))]
    bound = rows.select("conv", "part", "depth", "chars", "length", *bound)
    so_far = Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = bound.groupBy("conv", "part").agg(F.bit_xor("ta").alias("ta"), F.bit_xor("tb").alias("tb"))
    # rows only for parts after a conversation's first: fewer than there are parts
    left = parts.select("conv", "part", F.bit_xor("ta").over(earlier).alias("la"), F.bit_xor("tb").over(earlier).alias("lb")).where("la is not null")
    local = bound.withColumn("xa", F.bit_xor("ta").over(so_far)).withColumn("xb", F.bit_xor("tb").over(so_far)).join(left, ["conv", "part"], "left")
    local = local.withColumn("a", F.col("xa").bitwiseXOR(F.coalesce("la", F.lit(0)))).withColumn("b", F.col("xb").bitwiseXOR(F.coalesce("lb", F.lit(0))))
    return local.select("conv", "depth", "chars", "length", "a", "b", F.col("a").bitwiseXOR(F.col("ta")).alias("pa"), F.col("b").bitwiseXOR(F.col("tb")).alias("pb"))


_ENDS = "depth long, a long, b long, first long, ids string"


def _id_pieces(source):
    """mapInArrow step over rows in order of (node, conv): the ids of a node in pieces of a batch at most."""
    for batch in source:
        columns = [batch.column(c).to_numpy() for c in ("depth", "a", "b", "conv")]
        if not batch.num_rows:
            continue
        new = np.any([x[1:] != x[:-1] for x in columns[:3]], axis=0)
        begin = np.concatenate([[0], np.flatnonzero(new) + 1])
        end = np.append(begin[1:], batch.num_rows)
        ids = [",".join(map(str, columns[3][i:j].tolist())) for i, j in zip(begin.tolist(), end.tolist())]
        yield pa.RecordBatch.from_arrays([*(pa.array(x[begin]) for x in columns), pa.array(ids)], names=["depth", "a", "b", "first", "ids"])


def _digests(source):
    """mapInArrow step over pieces in order of (node, first id): one running digest per node."""
    at, digest, done = None, None, []

    def emit():
        return pa.RecordBatch.from_arrays([pa.array([d[0][i] for d in done], pa.int64()) for i in range(3)] + [pa.array([d[1].hexdigest() for d in done])], names=[*_KEY, "ends_sha256"])

    for batch in source:
        for depth, a, b, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids"))):
            if (depth, a, b) != at:
                at, digest = (depth, a, b), hashlib.sha256()
                done.append((at, digest))
            else:
                digest.update(b",")
            digest.update(ids.encode())
        if len(done) > 4_096:  # the last one may go on in the next batch
            done, last = done[:-1], done[-1]
            yield emit()
            done = [last]
    if done:
        yield emit()


def _ends(members: DataFrame) -> DataFrame:
    """(node, conv) rows -> (node, ends_sha256). A digest is sequential by definition; it reads joined ids in constant memory."""
    order = [*_KEY, "conv"]
    pieces = members.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_id_pieces, _ENDS)
    return pieces.repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digests, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(
    rows: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text", plan: Trie = Trie()
) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Conversation c is rebuilt from the first h turns of c - c % group and its own turns after its first h, with h the
    unsigned CRC-32 of its decimal id modulo ``longest_head + 1``.

    Defined results: NULL turns come first; rows with one turn number go by a hash of role and text, and equal rows count
    as often as they are there; NULL role or text is empty; rows with a NULL conversation belong to none and take no part;
    texts of any length count by their digest; an empty table gives no rows, not even the root; other columns are ignored.
    """
    own = narrow(rows, conv=conv_column, turn=turn_column, role=role_column, text=text_column).where("conv is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    lanes = [F.xxhash64(F.lit(seed), role, text).alias(name) for seed, name in ((1, "a"), (2, "b"))]
    turns = own.select(F.col("conv").cast("long").alias("conv"), "turn", *lanes, F.length(text).cast("long").alias("chars"))
    rebuilt, convs = _in_parts(turns, plan)
    paths = durable(_prefixes(rebuilt))

    zero = F.lit(0).cast("long")
    least = [F.count("*").alias("n_convs"), F.min("conv").alias("conv_id")]
    counted = durable(paths.groupBy(*_KEY).agg(*least, F.max("chars").alias("chars"), F.max("pa").alias("pa"), F.max("pb").alias("pb")))
    children = counted.groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = durable(counted.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", zero)))

    shards = max(1, -(-nodes.count() // plan.shard_nodes))
    shard = F.pmod(F.xxhash64("conv_id", F.floor(F.col("depth") / plan.band)), F.lit(shards))
    solved = durable(nodes.select(*_NODE, shard.alias("shard")).groupBy("shard").applyInPandas(_shard, _SHARD))

    # what a node without a parent in its shard has summed up belongs to all shorter prefixes of its owner
    heads = solved.where("parent_conv_id is null").select(F.col("conv_id").alias("conv"), F.col("depth").alias("until"), "saved", "leaves")
    above = Window.partitionBy("conv").orderBy("until")  # one row per band of a conversation at most
    rest = above.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spans = heads.select("conv", F.coalesce(F.lag("until").over(above), F.lit(1)).alias("since"), "until", F.sum("saved").over(rest).alias("more_saved"), F.sum("leaves").over(rest).alias("more_leaves"))
    band = F.floor(F.col("depth") / plan.band)
    spans = spans.where("since < until").withColumn("band", F.explode(F.expr(f"sequence(floor(since / {plan.band}), floor((until - 1) / {plan.band}))")))
    handed = paths.select("conv", *_KEY, band.alias("band")).join(spans, ["conv", "band"]).where("depth >= since and depth < until")
    handed = handed.groupBy(*_KEY).agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))

    # a parent elsewhere; at depth 1 it is the root, whose smallest member is the smallest of all
    smallest = convs.agg(F.min("conv").alias("root_conv"), F.count("*").alias("n_convs"))
    elsewhere = solved.where("parent_conv_id is null and depth > 1").select(*_KEY, (F.col("depth") - 1).alias("up"), "pa", "pb")
    owners = nodes.select(F.col("depth").alias("up"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("upper"))
    upper = elsewhere.join(owners, ["up", "pa", "pb"]).select(*_KEY, "upper")
    root_above = F.broadcast(smallest.select(F.lit(1).cast("long").alias("depth"), "root_conv"))
    below = solved.join(handed, _KEY, "left").join(upper, _KEY, "left").join(root_above, "depth", "left")
    parent = F.when(F.col("depth") == 1, F.col("root_conv")).otherwise(F.coalesce("parent_conv_id", "upper"))
    below = below.select(
        "conv_id", *_KEY, parent.alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") + F.coalesce("more_leaves", zero)).alias("n_leaves"), (F.col("saved") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
    )
    totals = nodes.agg(
        zero.alias("depth"), F.count_if(F.col("depth") == 1).alias("n_children"), F.greatest(F.lit(1), F.count_if(F.col("n_children") == 0)).alias("n_leaves"),
        F.coalesce(F.sum((F.col("n_convs") - 1) * F.col("chars")), zero).alias("saved_tokens"),
    )
    root = smallest.where("n_convs > 0").withColumn("depth", zero).join(F.broadcast(totals), "depth")  # one row and one row
    root = root.select(F.col("root_conv").alias("conv_id"), "depth", zero.alias("a"), zero.alias("b"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens")
    members = paths.where("depth = length").select(*_KEY, "conv").unionByName(convs.where("length = 0").select(zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        below.unionByName(root).join(_ends(members), _KEY, "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
    )


ORACLE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')]),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
joined AS (
  SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.base AND p <= h
  UNION ALL SELECT c.conv_id, p, role, text FROM c JOIN t USING (conv_id) WHERE p > h),
numbered AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY p) AS d, role, text FROM joined),
paths AS MATERIALIZED (
  SELECT conv_id, d, text, string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM numbered
  UNION ALL SELECT conv_id, 0, '', '' FROM c),
linked AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY d) AS parent, max(d) OVER (PARTITION BY conv_id) AS last FROM paths),
nodes AS MATERIALIZED (
  SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(parent) AS parent, (count(*) - 1) * length(any_value(text)) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE d = last), '')) AS ends_sha256
  FROM linked GROUP BY path, d),
kids AS (SELECT parent AS path, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
under AS (SELECT DISTINCT u.path, u.d, v.path AS below, v.d AS below_d FROM paths u JOIN paths v ON u.conv_id = v.conv_id AND v.d >= u.d),
sums AS (
  SELECT u.path, u.d, sum(n.saved)::BIGINT AS saved_tokens, count(*) FILTER (WHERE k.n IS NULL) AS n_leaves
  FROM under u JOIN nodes n ON n.path = u.below AND n.d = u.below_d LEFT JOIN kids k ON k.path = u.below AND k.d = u.below_d GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.path = n.path AND s.d = n.d LEFT JOIN kids k ON k.path = n.path AND k.d = n.d LEFT JOIN nodes p ON p.path = n.parent AND p.d = n.d - 1
"""
