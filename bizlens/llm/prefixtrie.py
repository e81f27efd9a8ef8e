"""Prefix trie of conversations with count-min screening (operator 12).

Conversations are rebuilt first: conversation c takes the first h turns of
conversation c - c % 20 and then its own turns after its first h, with
h = CRC-32 of c modulo 4. A node of the trie is a distinct sequence of first
turns; its members are the rebuilt conversations that start with it.

* Digests: a turn's hash is cut into four numbers, and a prefix is the four sums
  over its turns, each with its place. Sums come from range-partitioned running
  totals, so a conversation of any length is spread over many tasks, and the
  digest of the parent is the difference to the last turn.
* Screening: a count-min sketch of ``ROWS`` rows counts the digests. An estimate
  of one (some counter is one) proves a singleton, and so all longer prefixes of
  that conversation: these tails are nodes of one member, emitted where they are.
  A task needs to know only which counters exceed one, ``ROWS * 2 ** BITS`` bits
  at any input size. A full sketch lets more prefixes through, with equal results.
* Exact grouping: the other prefixes are grouped by digest.
* Subtrees: a node counts for its smallest member at its depth. Backward running
  sums along each conversation, added up over a node's members, are the sums
  over its subtree, without a walk and at any depth.
* Ids of the members that end at a node are joined in sorted pieces and hashed
  piece by piece, so memory follows the piece and not the group.

Defined results: turns ascend, null first; turns with an equal number are
ordered by the MD5 of role and text; repeated rows are separate turns. Null
roles and texts are empty. Turns without a conversation id belong to none and
have no node. Very long texts enter as their hash. A rebuilt conversation
without turns is a member of the root only. Extra columns are not read. An empty
table has no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm.merkle import CRC32_SQL
from bizlens.llm.shared import join_by_weight, read, stored
from bizlens.plans.order import running_totals

GROUP = 20
HEADS = 4
ROWS = 3
BITS = 24
PIECE = 1 << 16
_WORD = r"[^\x20\x09-\x0D]+"
_NOTHING = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
             text: str = "text") -> DataFrame:
    """(c, i, content, words): every turn with its place in its conversation, from 1."""
    r, t = (F.coalesce(F.col(x), F.lit("")) for x in (role, text))
    turns = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), F.regexp_count(t, F.lit(_WORD)).cast("long").alias("words"),
        F.md5(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t)).alias("content"), F.lit(1).alias("one"))
    return running_totals(turns, ["c"], ["turn", "content"], ["one"]).select("c", F.col("cum_one").alias("i"), "content", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (c, n: turns after rebuilding) and their turns (c, pos, content, words)."""
    own = turns.groupBy("c").agg(F.count(F.lit(1)).alias("n_own"))
    base = own.select(F.col("c").alias("base"), F.col("n_own").alias("n_base"))
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % HEADS).cast("long")
    convs = stored(own.withColumn("h", h).withColumn("base", F.col("c") - F.col("c") % GROUP).join(base, "base", "left")
                   .withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0)))), "convs")
    tails = join_by_weight(turns, convs.select("c", "h", "k", "n_own"), "c", "n_own").where("i > h") \
        .select("c", (F.col("k") + F.col("i") - F.col("h")).alias("pos"), "content", "words")
    first = turns.where((F.col("c") % GROUP == 0) & (F.col("i") < HEADS)).withColumnRenamed("c", "base")
    heads = first.join(convs.select("c", "base", "h"), "base").where("i <= h") \
        .select("c", F.col("i").alias("pos"), "content", "words")  # at most GROUP conversations a base
    n = F.col("k") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))
    return convs.select("c", n.alias("n")), heads.unionByName(tails)


def _key(sums: list[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", *sums)))


def _root_key() -> Column:
    return _key([F.lit(0)] * 4)


def prefixes(turns: DataFrame) -> DataFrame:
    """(c, pos, key, parent, words, last) of every prefix; equal keys are equal prefixes."""
    digest = F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), F.col("content")))
    parts = turns.withColumn("digest", digest).select("c", "pos", "words", *[
        F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"p{k}") for k in range(4)])
    sums = running_totals(parts, ["c"], ["pos"], [f"p{k}" for k in range(4)], next_of="pos")
    return sums.select("c", "pos", "words", F.col("next_pos").isNull().alias("last"),
                       _key([F.col(f"cum_p{k}") for k in range(4)]).alias("key"),
                       _key([F.col(f"cum_p{k}") - F.col(f"p{k}") for k in range(4)]).alias("parent"))


def _counters(key: Column) -> list[Column]:
    """The counter of ``key`` in each row of the sketch, numbered through."""
    mask = F.lit((1 << BITS) - 1)
    return [F.xxhash64(key, F.lit(r)).bitwiseAND(mask) + F.lit(r << BITS) for r in range(ROWS)]


def sketch(keys: DataFrame) -> np.ndarray:
    """The count-min sketch of ``key``, one bit a counter: whether it exceeds one."""
    counts = keys.select(F.explode(F.array(*_counters(F.col("key")))).alias("b")).groupBy("b").count().where("count > 1")
    slots = counts.groupBy(F.shiftright("b", 6).alias("at")) \
        .agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("on")).toArrow()
    out = np.zeros(ROWS << (BITS - 6), "<i8")
    out[slots["at"].to_numpy()] = slots["on"].to_numpy()
    return out.view(np.uint8)


def possibly_shared(spark, key: Column, seen) -> Column:
    """Whether the estimate of ``key`` exceeds one, ``seen`` being the broadcast sketch."""

    @F.arrow_udf("boolean")
    def look(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for counters in batches:
            hit = np.ones(len(counters[0]), bool)
            for c in counters:
                b = c.to_numpy()
                hit &= ((seen.value[b >> 3] >> (b & 7).astype(np.uint8)) & 1) == 1
            yield pa.array(hit)

    return look.asNondeterministic()(*_counters(key))


def ends_hash(ends: DataFrame) -> DataFrame:
    """(key, ends_sha256) of the ids ``c`` of each ``key``, ascending and joined by commas.

    Ranges of sorted ids become pieces of text in many tasks; a key's pieces are hashed in order."""
    n, piece = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), PIECE

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[bytes, int, list[str]]] = []
        size = 0
        for b in batches:
            for key, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not out or out[-1][0] != key or size > piece:
                    if len(out) > 1000 or size > piece:
                        yield flush(out)
                        out = []
                    out.append((key, c, []))
                    size = 0
                out[-1][2].append(str(c))
                size += len(out[-1][2][-1]) + 1
        yield flush(out)

    def flush(out: list[tuple[bytes, int, list[str]]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in out], pa.binary()), pa.array([x[1] for x in out], pa.int64()),
             pa.array([",".join(x[2]) for x in out], pa.string())], ["key", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k == key:
                    state.update(b",")
                else:
                    if state:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()),
                                              pa.array([x[1] for x in done], pa.string())], ["key", "ends_sha256"])
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends_sha256"])

    cut = ends.select("key", "c").repartitionByRange(n, "key", "c").sortWithinPartitions("key", "c") \
        .mapInArrow(pieces, "key binary, first long, ids string")
    return cut.repartition(n, "key").sortWithinPartitions("key", "first").mapInArrow(digest, "key binary, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    convs, turns = rebuilt(stored(turns_of(conversations), "turns"))
    every = stored(prefixes(turns), "prefixes")
    seen = spark.sparkContext.broadcast(sketch(every))
    rows = every.withColumn("shared", possibly_shared(spark, F.col("key"), seen)) \
        .withColumn("up", (F.col("pos") == 1) | possibly_shared(spark, F.col("parent"), seen))
    rows = stored(rows, "screened")
    alone, group = rows.where("NOT shared"), rows.where("shared")

    nodes = stored(group.groupBy("key").agg(
        F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("parent").alias("parent"),
        F.first("pos").alias("depth"), F.first("words").alias("words"), F.first("up").alias("up"),
        F.bool_and("last").alias("childless")), "nodes")
    kids = nodes.where("up").select("parent").unionByName(alone.where("up").select("parent")) \
        .groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    kids = stored(kids, "children")

    # what a node adds to the sums of its ancestors stands at its smallest member
    mine = F.col("c") == F.col("conv_id")
    own = join_by_weight(group.select("key", "c", "pos"), nodes.select("key", "conv_id", "n_convs", "words", "childless",
                                                                      F.col("n_convs").alias("weight")), "key", "weight")
    adds = own.select("c", "pos", "key", F.when(mine, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("saved"),
                      (mine & F.col("childless")).cast("long").alias("leaf"))
    tips = alone.where("last").select("c", "pos", F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("saved"),
                                      F.lit(1).cast("long").alias("leaf"))
    adds = stored(adds.unionByName(tips).withColumn("back", -F.col("pos")), "adds")
    below = running_totals(adds, ["c"], ["back"], ["saved", "leaf"]).where("key IS NOT NULL").groupBy("key") \
        .agg(F.sum("cum_saved").alias("saved_tokens"), F.sum("cum_leaf").alias("n_leaves"))

    ends = ends_hash(group.where("last"))
    first = convs.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()
    full = nodes.join(kids, "key", "left").join(below, "key").join(ends, "key", "left") \
        .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    full = stored(full, "full")

    # the parent's smallest member: the root's, that of a shared prefix, or the conversation itself
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tails = alone.select("parent", "up", F.col("c").alias("conv_id"), F.col("pos").alias("depth"), F.lit(1).alias("n_convs"),
                         F.when(F.col("last"), 0).otherwise(1).alias("n_children"), F.lit(1).alias("n_leaves"),
                         F.lit(0).alias("saved_tokens"),
                         F.when(F.col("last"), F.sha2(F.col("c").cast("string"), 256)).alias("ends_sha256"))
    out = full.select("parent", "up", *columns).unionByName(tails.select("parent", "up", *columns))
    linked = (F.col("depth") > 1) & F.col("up")
    parents = full.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"),
                                                  F.col("n_children").alias("weight"))
    deep = join_by_weight(out.where(linked), parents, "parent", "weight")
    rest = out.where(~linked).withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first.conv_id)).otherwise(F.col("conv_id")))
    columns.insert(2, "parent_conv_id")
    result = deep.select(*columns).unionByName(rest.select(*columns)).unionByName(_root(convs, kids, adds, first, columns))
    return result.select(*[F.col(c).cast("long").alias(c) for c in columns[:-1]],
                         F.coalesce("ends_sha256", F.lit(_NOTHING)).alias("ends_sha256"))


def _root(convs: DataFrame, kids: DataFrame, adds: DataFrame, first, columns: list[str]) -> DataFrame:
    """The textless root, of which every conversation is a member; no row without conversations."""
    spark = convs.sparkSession
    total = adds.agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")).first()
    n_children = kids.where(F.col("key") == _root_key()).first()
    ends = ends_hash(convs.where("n = 0").select(_root_key().alias("key"), "c")).first()
    row = (first.conv_id, 0, None, first.n_convs, n_children.n_children if n_children else 0, total.leaf or 1,
           total.saved or 0, ends.ends_sha256 if ends else None)
    kinds = ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in columns)
    return spark.createDataFrame([row] if first.n_convs else [], kinds)


def query(spark, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST,
  md5(concat(strlen(role), ':', role, text))) AS i, role, text FROM t),
conv AS (SELECT DISTINCT c, c - c % 20 AS base, @CRC % 4 AS h FROM t),
heads AS (SELECT conv.c, own.i AS pos, role, text FROM conv JOIN own ON own.c = conv.base AND own.i <= conv.h),
k AS (SELECT conv.c, h, (SELECT count(*) FROM heads WHERE heads.c = conv.c) AS k FROM conv),
built AS (SELECT * FROM heads UNION ALL
  SELECT k.c, k.k + own.i - k.h, role, text FROM own JOIN k ON own.c = k.c WHERE own.i > k.h),
whole AS (SELECT conv.c, list(md5(concat(strlen(role), ':', role, text)) ORDER BY pos) FILTER (WHERE pos IS NOT NULL) AS path,
  list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY pos) FILTER (WHERE pos IS NOT NULL) AS words
  FROM conv LEFT JOIN built ON built.c = conv.c GROUP BY conv.c),
full_ AS (SELECT c, coalesce(path, []) AS path, coalesce(words, []) AS words, coalesce(len(path), 0) AS n FROM whole),
pre AS (SELECT c, n, d, path[1:d] AS p, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w
  FROM (SELECT *, unnest(generate_series(0, n)) AS d FROM full_)),
node AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w, bool_and(n = d) AS leaf,
  string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE n = d) AS ends FROM pre GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
below AS (SELECT p[1:a] AS p, sum((n_convs - 1) * w) AS saved, count(*) FILTER (WHERE leaf) AS leaves
  FROM (SELECT *, unnest(generate_series(0, d)) AS a FROM node) GROUP BY 1)
SELECT node.conv_id, node.d AS depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(n_children, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node LEFT JOIN node up ON up.p = node.p[1:node.d - 1] AND up.d = node.d - 1 AND node.d > 0
LEFT JOIN kids ON kids.p = node.p JOIN below ON below.p = node.p
""".replace("@CRC", CRC32_SQL.format(x="c::VARCHAR"))
