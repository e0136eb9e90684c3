"""Merkle dataset manifest: hash trees kept as one hex string per aligned block and level.

Leaves are numbered per group (here: per source) by a distributed rank: one
range-partitioned, sorted and staged table, of which only the counts of each
partition and group are summed. WIDTH**2 consecutive nodes make an aligned
block. A block keeps its lowest level as one string of fixed-width digests;
the parents of a run are the digest of a substring, the level above is the
string of those, and the substrings left and right of a node are its siblings.
A block's last digest is a node of the next table of blocks, until every group
is one node; the groups' roots are treated in the same way. Paths go back down
block by block: all nodes of a block share what lies above, so a path is
joined once per block and the long strings of siblings only exist inside the
projection that digests them. Groups of any size are spread over many blocks;
no task holds more than a block's nodes at a time.

A null value enters a leaf as ``-``, an empty one as ``0:``. Rows without an
order key come first in their group and are never tampered with; rows of equal
key are ordered by their leaf digest, repeated rows count one by one. The null
group is the first. An empty table has an empty result. Only the columns named
are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.url_filters import LOWER, UPPER

#: Children of a node, hex characters of a digest.
WIDTH, DIGEST = 16, 64
RUN = WIDTH * DIGEST
STEP = "array<struct<before:string,after:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return digest(F.concat(*map(field, values)))


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ranked(nodes: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``nodes`` with ``place``, the number of a row within its ``group`` from 0, by ``order``. Written once, so that all who read it see one order."""
    rows = nodes.repartitionByRange("group", *order).sortWithinPartitions("group", *order)
    # the id holds the partition above 33 bits of the row number
    table = staged(rows.withColumn("_id", F.monotonically_increasing_id()), name)
    part, group = F.shiftright("_id", 33).alias("part"), F.col("group")
    sizes = table.groupBy(part, group).agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("group").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(F.col("group").alias("g"), "part", (before - F.col("first")).alias("shift"))
    same = group.eqNullSafe(F.col("g")) & (F.shiftright("_id", 33) == F.col("part"))
    return table.join(offsets, same).withColumn("place", F.col("_id") + F.col("shift")).drop("_id", "g", "part", "shift")


def above(level: Column) -> Column:
    """The string of a level's parents."""
    runs = F.sequence(F.lit(0), F.floor((F.length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda r: digest(F.substring(level, r * RUN + 1, F.lit(RUN)))), "")


def blocks_of(nodes: DataFrame, carried: Column | None = None) -> DataFrame:
    """group, block, s0, s1, s2, up, and the rows' carried values in order. nodes: group, place, node.

    ``up`` is the number of levels that the group still needs, at most two: the
    strings beyond it are null.
    """
    size = WIDTH * WIDTH
    sizes = nodes.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    rows = F.struct(F.col("place"), F.col("node"), *([carried.alias("carried")] if carried is not None else []))
    held = nodes.groupBy("group", F.floor(F.col("place") / size).alias("block")).agg(F.array_sort(F.collect_list(rows)).alias("rows"))  # size rows at most
    held = held.withColumn("s0", F.array_join(F.transform("rows", lambda r: r["node"]), ""))
    held = held.join(sizes.withColumnRenamed("group", "g"), F.col("group").eqNullSafe(F.col("g"))).drop("g")
    held = held.withColumn("up", F.when(F.col("n") == 1, 0).when(F.col("n") <= WIDTH, 1).otherwise(2))
    held = held.withColumn("s1", F.when(F.col("up") > 0, above(F.col("s0")))).withColumn("s2", F.when(F.col("up") > 1, above(F.col("s1"))))
    kept = ["group", "block", "s0", "s1", "up"] + ["node"]
    held = held.withColumn("node", F.coalesce("s2", "s1", "s0"))
    return held.select(*kept, F.transform("rows", lambda r: r["carried"]).alias("carried")) if carried is not None else held.select(*kept)


def flanks(level: Column, place: Column) -> Column:
    """What stands left and right of a node in its run."""
    start, at = F.floor(place / WIDTH) * RUN, (place % WIDTH) * DIGEST
    run = F.substring(level, (start + 1).cast("int"), F.lit(RUN))
    return F.struct(F.substring(run, F.lit(1), at.cast("int")).alias("before"), F.substring(run, (at + DIGEST + 1).cast("int"), F.lit(RUN)).alias("after"))


def steps(s0: Column, s1: Column, up: Column, place: Column) -> Column:
    """The siblings of the node at ``place`` of a block, level by level."""
    one, two = flanks(s0, place), flanks(s1, F.floor(place / WIDTH))
    return F.when(up == 0, F.array().cast(STEP)).when(up == 1, F.array(one)).otherwise(F.array(one, two))


class Tree:
    """The tables of blocks of some nodes, lowest first, and the nodes (group, node) that are left at the top."""

    def __init__(self, nodes: DataFrame, name: str, carried: Column | None = None) -> None:
        self.levels = [staged(blocks_of(nodes, carried), f"{name}-0")]
        while self.levels[-1].where("block > 0").limit(1).count():
            below = self.levels[-1].select("group", F.col("block").alias("place"), "node")
            self.levels.append(staged(blocks_of(below), f"{name}-{len(self.levels)}"))

    def roots(self) -> DataFrame:
        return self.levels[-1].select("group", "node")

    def block_paths(self, tops: DataFrame) -> DataFrame:
        """group, block, and the columns of ``tops`` with ``path``, the siblings above each block of the lowest table. tops: group, path, further columns."""
        rest = [c for c in tops.columns if c not in ("group", "path")]
        paths = tops.select(F.col("group").alias("g"), F.lit(0).cast("long").alias("b"), "path", *rest)
        for level in reversed(self.levels[1:]):
            here = level.join(paths, F.col("group").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
            places = F.explode(F.sequence(F.lit(0), (F.length("s0") / DIGEST - 1).cast("int"))).alias("i")
            here = here.select("group", "block", "s0", "s1", "up", "path", *rest, places)
            paths = here.select(F.col("group").alias("g"), (F.col("block") * WIDTH * WIDTH + F.col("i")).alias("b"), F.concat(steps(F.col("s0"), F.col("s1"), F.col("up"), F.col("i")), F.col("path")).alias("path"), *rest)
        return paths.select(F.col("g").alias("group"), F.col("b").alias("block"), "path", *rest)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["before"], h, s["after"])))


def proof(path: Column) -> Column:
    """The siblings in one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def manifest(docs: DataFrame, *, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group: str = "source", key: str = "doc_id", text: str = "text", tamper_every: int = 5) -> DataFrame:
    """doc_id, leaf, subroot, root, proof (one string of siblings), folded_root and verified of every row.

    Rows whose crc32 of the key's decimal text is divisible by ``tamper_every``
    are verified with A-Z of the text lower-cased; all others as they are.
    """
    plain = [F.col(c) for c in fields]
    changed = [lowered(F.col(c)) if c == text else F.col(c) for c in fields]
    hit = F.crc32(F.col(key).cast("string").cast("binary")) % tamper_every == 0
    leaves = docs.select(F.col(group).cast("string").alias("group"), F.col(key).alias("id"), leaf_digest(plain).alias("node"), F.when(hit, leaf_digest(changed)).alias("altered"))
    leaves = staged(leaves, "merkle-digests")  # the sort samples its input, which would digest every text twice
    nodes = ranked(leaves, "merkle-leaves", "id", "node")
    tree = Tree(nodes, "merkle-blocks", F.struct("id", "altered"))
    subroots = staged(tree.roots(), "merkle-subroots")
    over = ranked(subroots.select(F.lit(0).alias("group"), F.col("group").alias("of"), "node"), "merkle-groups", "of")
    crown = Tree(over, "merkle-crown", F.col("of"))
    top = crown.roots().select("group", F.array().cast(STEP).alias("path"), F.col("node").alias("root"))
    joined = crown.levels[0].join(crown.block_paths(top).select(F.col("block").alias("b"), "path", "root"), F.col("block") == F.col("b"))
    each = joined.select("s0", "s1", "up", "path", "root", F.posexplode("carried").alias("i", "of"))
    tops = each.select(F.col("of").alias("group"), F.concat(steps(F.col("s0"), F.col("s1"), F.col("up"), F.col("i")), F.col("path")).alias("path"), "root", F.substring(F.col("s0"), F.col("i") * DIGEST + 1, F.lit(DIGEST)).alias("subroot"))
    paths = tree.block_paths(tops).withColumnsRenamed({"group": "g", "block": "b"})
    whole = tree.levels[0].join(paths, F.col("group").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b")))
    node = lambda i: F.substring(F.col("s0"), i * DIGEST + 1, F.lit(DIGEST))
    path = lambda i: F.concat(steps(F.col("s0"), F.col("s1"), F.col("up"), i), F.col("path"))
    # within the block, so that its strings are not copied for every row
    shown = F.transform("carried", lambda d, i: F.struct(d["id"].alias("doc_id"), node(i).alias("leaf"), F.coalesce(d["altered"], node(i)).alias("shown"), path(i).alias("path")))
    done = F.transform(shown, lambda d: F.struct(d["doc_id"].alias("doc_id"), d["leaf"].alias("leaf"), proof(d["path"]).alias("proof"), folded(d["shown"], d["path"]).alias("folded_root")))
    rows = whole.select("subroot", "root", F.explode(done).alias("d"))
    return rows.select("d.doc_id", "d.leaf", "subroot", "root", "d.proof", "d.folded_root", (F.col("d.folded_root") == F.col("root")).alias("verified"))
