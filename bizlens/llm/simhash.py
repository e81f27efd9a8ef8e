"""SimHash near-duplicate detection with BK-trees (operator 6).

Each text becomes a 64-bit fingerprint: a bit is set if it is set in over half
of the XXH64 hashes of its word shingles (repeats included). Fingerprints that
differ in at most ``distance`` bits are linked; a document's component is the
smallest id it can reach over links.

Search: distinct fingerprints only. The 64 bits are cut into ``distance + 1``
parts; two fingerprints within the distance agree on at least one whole part,
so shards are keyed by one part's bits and no link is lost. Keys are pooled
into shards of about ``tree_nodes`` fingerprints, each with one BK-tree
(children keyed by their Hamming distance to the parent) that lies in the task
of its shard; a tree sent to every task would be quadratic in the corpus. A
search follows only the edges whose distance is within the radius of the
query's distance to the node. A part that more than ``tree_nodes`` fingerprints
share has its other bits cut in the same way, again and again, until so few
bits are free that no shard can be larger. Links are united inside a shard and
leave it as stars (at most one row a fingerprint), never as all pairs. Stars
meet in a large-star / small-star contraction whose rounds are written to the
shared folder.

Defined results: null, empty or blank text has fingerprint zero and links like
any other. Fewer words than the shingle length: the whole sequence is one
shingle. Rows with equal text share a fingerprint; repeated ids are separate
rows with equal answers. Null ids never become a component id; a component of
null ids only has a null one. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.shared import free_name, join_by_weight, read, stored

SEED = 42
TREE_NODES = 4096
PROBES = 512  # searched together in one walk down a tree
TREES_A_TASK = 64


def fingerprint_of(text: bytes, shingle: int = 3) -> int:
    """Unsigned fingerprint of one text."""
    words = text.lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    h = np.array(list(map(xxhash.xxh64_intdigest, runs, repeat(SEED))), np.uint64)
    # one byte a bit, summed eight at a time in 64-bit lanes; a lane holds 255 rows
    lanes = np.unpackbits(h.view(np.uint8)).view(np.uint64).reshape(-1, 8)
    part = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0)
    ones = part.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h)).view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """The fingerprint of a text column as a signed 64-bit number."""

    @F.arrow_udf("long")
    def prints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            raw = col.fill_null("").cast(pa.large_binary())
            got = np.fromiter((fingerprint_of(x.as_py(), shingle) for x in raw), np.uint64, len(raw))
            yield pa.array(got.view(np.int64))

    return prints.asNondeterministic()(text)


class BKTree:
    """Distinct integers under Hamming distance: the first one is the root, and all that lie at
    distance k from a node go below its child of edge k, of which the first is that child.

    The edges are one array sorted by (parent, distance), in which ``_at`` finds the children
    of a range of distances; ``visited`` counts the nodes that searches compared."""

    def __init__(self, values: np.ndarray) -> None:
        self.values, self.visited = values, 0
        edges, kids = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        below = np.arange(1, len(values))
        node = np.zeros(len(below), np.int64)
        while len(below):
            edge = node * 65 + np.bitwise_count(values[node] ^ values[below])
            by_edge = np.argsort(edge, kind="stable")
            edge, below = edge[by_edge], below[by_edge]
            first = np.append(True, edge[1:] != edge[:-1])
            edges.append(edge[first])
            kids.append(below[first])
            node = below[first][np.cumsum(first) - 1][~first]
            below = below[~first]
        edge, kid = np.concatenate(edges), np.concatenate(kids)
        by_edge = np.argsort(edge, kind="stable")
        self._kids = kid[by_edge]
        self._at = np.searchsorted(edge[by_edge], np.arange(len(values) * 65 + 1))

    def within(self, probes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(probe, node) positions of all pairs at most ``radius`` apart."""
        probe = np.arange(len(probes) if len(self.values) else 0)
        node = np.zeros(len(probe), np.int64)
        found = []
        while len(probe):
            self.visited += len(probe)
            d = np.bitwise_count(self.values[node] ^ probes[probe]).astype(np.int64)
            near = d <= radius
            found.append((probe[near], node[near]))
            lo = self._at[node * 65 + np.maximum(d - radius, 0)]
            n = self._at[node * 65 + np.minimum(d + radius, 64) + 1] - lo
            probe = np.repeat(probe, n)
            node = self._kids[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
        return (np.concatenate([p for p, _ in found] or [probe]), np.concatenate([k for _, k in found] or [node]))


def _stars(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, smallest united fingerprint) of all distinct ``values`` that have a link."""
    values = np.unique(values)
    tree, up = BKTree(values), np.arange(len(values))
    for start in range(0, len(values), PROBES):
        a, b = tree.within(values[start:start + PROBES], radius)
        a, b = up[a + start], up[b]
        while len(apart := np.flatnonzero(a != b)):
            a, b = a[apart], b[apart]
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up[up] != up).any():
                up = up[up]
            a, b = up[a], up[b]
    moved = np.flatnonzero(up != np.arange(len(values)))
    return values[moved], values[up[moved]]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _finer(mask: int, parts: int) -> list[int]:
    """``mask`` with one part more, for each of the ``parts`` parts of the bits it leaves free."""
    free = [k for k in range(64) if not mask >> k & 1]
    edge = [len(free) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << k for k in free[lo:hi]) for lo, hi in zip(edge, edge[1:])]


def _map(entries: dict) -> Column:
    """Map column from masks, as the signed numbers of the rows, to columns."""
    return F.create_map(*[x for m, c in entries.items() for x in (F.lit(_signed(m)).cast("long"), c)])


def shards(prints: DataFrame, *, distance: int, tree_nodes: int = TREE_NODES) -> tuple[DataFrame, int]:
    """(mask, shard, fp) such that linked fingerprints meet in a shard, and about how many shards there are."""
    rows, masks, trees, done = {0: prints.count()}, [0], 1, []
    keyed = prints.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("bits"))
    full = rows[0] > tree_nodes
    # with ``distance`` free bits or fewer a mask has no finer ones
    while full and (64 - masks[0].bit_count()) > distance + 1:
        finer = {m: _finer(m, distance + 1) for m in masks if _signed(m) in rows}
        masks = list(dict.fromkeys(k for f in finer.values() for k in f))
        pools = {k: -(-sum(rows[_signed(m)] for m, f in finer.items() if k in f) // tree_nodes) for k in masks}
        trees += sum(pools.values())
        below = _map({m: F.array(*[F.lit(_signed(k)) for k in f]) for m, f in finer.items()})
        keyed = (keyed.select("fp", F.explode(below[F.col("mask")]).alias("mask"))
                 .withColumn("bits", F.col("fp").bitwiseAND(F.col("mask"))))
        heavy = stored(keyed.groupBy("mask", "bits").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > tree_nodes),
                       "heavy").select("mask", "bits")
        pool = _map({k: F.lit(n) for k, n in pools.items()})[F.col("mask")]
        shard = F.pmod(F.xxhash64("mask", "bits"), pool).alias("shard")
        done.append(keyed.join(heavy, ["mask", "bits"], "left_anti").select("mask", shard, "fp"))
        full = not heavy.isEmpty()
        if full:
            keyed = stored(keyed.join(heavy, ["mask", "bits"], "left_semi").select("fp", "mask", "bits"), "hot")
            # one row a mask: at most (distance + 1) ** levels
            rows = {r["mask"]: r["count"] for r in keyed.groupBy("mask").count().collect()}
    if full or not done:  # so few free bits that no key can hold more than 2 ** (distance + 1) fingerprints
        done.append(keyed.select("mask", F.col("bits").alias("shard"), "fp"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, trees


def links(prints: DataFrame, *, distance: int, tree_nodes: int = TREE_NODES) -> DataFrame:
    """Stars (u, v) that connect the distinct fingerprints ``fp`` linked to each other."""
    units, trees = shards(prints, distance=distance, tree_nodes=tree_nodes)
    tasks = max(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), trees // TREES_A_TASK)

    def search(shard: pa.Table) -> pa.Table:
        u, v = _stars(shard["fp"].to_numpy().view(np.uint64), distance)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return (units.repartition(tasks, "mask", "shard").groupBy("mask", "shard")
            .applyInArrow(search, "u long, v long").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) of every node of ``edges`` (u, v): alternating large-star and
    small-star steps until nothing changes; each round is written out."""
    cur = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                 .where("u <> v").distinct(), "edges")

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = mark(cur)
    while seen[0]:
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every u keeps its smallest neighbour and hands the others to it
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))))
        cur = stored(small.where("u <> v").distinct(), "stars")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("fp"), F.col("v").alias("root")) \
        .unionByName(cur.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())


def component_ids(prints: DataFrame, *, distance: int, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(fp, n, component_id, root) of every distinct fingerprint of ``prints`` (id, fp); n: its rows;
    root: the component's smallest fingerprint, which tells components apart whatever their ids."""
    reps = stored(prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")), "fingerprints")
    member = stored(components(links(reps.select("fp"), distance=distance, tree_nodes=tree_nodes)), "members")
    best = member.join(reps, "fp").groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = member.join(best, "root").select("fp", "component_id", "root")
    return reps.join(linked, "fp", "left").select("fp", "n", F.coalesce("component_id", "rep").alias("component_id"),
                                                  F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", shingle: int = 3,
                    distance: int = 2, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(key, fingerprint, component_id), one row a document."""
    prints = stored(docs.select(F.col(key).alias("id"), fingerprint(F.col(text), shingle).alias("fp")), "simhash")
    groups = stored(component_ids(prints, distance=distance, tree_nodes=tree_nodes), "groups")
    out = join_by_weight(prints, groups, "fp", "n")  # many documents may share a fingerprint
    return out.select(F.col("id").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
                      "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each component: that with the smallest id (of
    repeated ids one row; null ids come last)."""
    uid, fp = free_name(docs, "row_uid"), free_name(docs, "row_fp")
    # written with a row number, so that the number holds for every later reading
    rows = stored(docs.withColumn(fp, fingerprint(F.col("text"))).withColumn(uid, F.monotonically_increasing_id()),
                  "docs")
    prints = rows.select(F.col("doc_id").alias("id"), F.col(fp).alias("fp"), F.col(uid).alias("uid"))
    groups = component_ids(prints, distance=2)
    first = prints.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("best"))
    keep = (first.join(groups, "fp").groupBy("root").agg(F.min("best").alias("best"))
            .select(F.col("best.uid").alias(uid)))
    return rows.join(keep, uid, "left_semi").select(*docs.columns)
