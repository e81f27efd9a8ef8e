"""Merkle manifest of a dataset, with proofs by a recursive climb (operator 11).

Every row is a leaf: SHA-256 of its fields, each written as its UTF-8 length,
a colon and the value (``-`` if null). Leaves of one group ascend by id; runs of
``FAN`` consecutive nodes become their parent until one node, the subroot, is
left; subroots in the order of their groups become the root in the same way.

* Build: leaf places come from range-partitioned running counts, so a group of
  any size is spread over many tasks. A run is one ``groupBy`` of at most
  ``FAN`` rows; each level is written as node rows that name their parent.
* Climb: a recursive SQL query joins each climbing row with its parent, appends
  the siblings to the proof and folds the hashes of the possibly tampered
  leaves. The leaves of a run have the same path above it, so they climb as one
  row that holds their different hashes; only their own siblings differ.
* Skew: near the root all rows meet in few nodes. Nodes above more than 1 /
  ``SHARE`` of all leaves (fewer than ``SHARE`` a level) are sent to all tasks;
  below them the climb joins by a shuffle whose keys hold at most that share.

A verifier that holds the root recomputes it from a leaf and its proof. The
query plays a tampered copy in which some texts are lower-cased.

Defined results: null ids come first in their group, a null group is a group of
its own and comes first. Rows with equal ids are ordered by their leaves;
repeated rows are separate leaves. Nulls, empty and very long texts are hashed
as they are. Extra columns are not read. An empty table has no leaf and no root.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizlens.llm.shared import read, stored
from bizlens.plans.order import global_row_number, running_totals

FAN = 8
SHARE = 1000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: Sequence[Column]) -> Column:
    """The leaf of a row as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[_field(v) for v in values]), 256))


def _node_hash(kids: Column) -> Column:
    """The parent of the concatenated hashes ``kids``: their hex text is hashed."""
    return F.unhex(F.sha2(F.lower(F.hex(kids)), 256))


def _joined(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x))


def _around(kids: Column, pos: Column) -> tuple[Column, Column]:
    """The hashes before and after place ``pos`` (from 0) of the concatenated hashes."""
    return F.substring(kids, F.lit(1), pos * 32), F.substring(kids, pos * 32 + 33, F.lit(32 * FAN))


def _id(group: Column, level: Column, idx: Column) -> Column:
    """Name of a node of a group's tree."""
    return F.concat_ws(".", level.cast("string"), idx.cast("string"), F.coalesce(F.concat(F.lit("g"), group), F.lit("n")))


def _top_id(level: int, idx: Column) -> Column:
    return F.concat(F.lit(f"t{level}."), idx.cast("string"))


def leaf_runs(leaves: DataFrame) -> DataFrame:
    """(grp, run, n, ids, kids, changed): runs of consecutive leaves of ``leaves``
    (id, grp, leaf, changed); ``changed`` is the leaf as it is met by the verifier."""
    placed = running_totals(leaves.withColumn("one", F.lit(1)), ["grp"], ["id", "leaf"], ["one"])
    idx = F.col("cum_one") - 1
    run = F.floor(idx / FAN).cast("long")
    member = F.struct(idx.alias("idx"), "id", "leaf", "changed")
    return (placed.groupBy("grp", run.alias("run")).agg(F.sort_array(F.collect_list(member)).alias("m"))
            .select("grp", "run", F.size("m").alias("n"), F.col("m.id").alias("ids"), _joined(F.col("m.leaf")).alias("kids"),
                    F.col("m.changed").alias("changed")))


def _levels(nodes: DataFrame, keys: list[str], first: int, name: str) -> tuple[list[DataFrame], list[DataFrame]]:
    """Build the levels over ``nodes`` (*keys, idx, hash, w), the trees being ``keys``.

    Returns the parents of each level (*keys, level, idx, hash, kids, w) and the
    last nodes of the trees (*keys, level, hash, w). One job a level, each an
    eighth of the one below."""
    built, tops, level, cur = [], [], first, nodes
    while True:
        up = F.floor(F.col("idx") / FAN).cast("long")
        above = cur.groupBy(*keys, up.alias("up")).agg(F.sort_array(F.collect_list(F.struct("idx", "hash"))).alias("m"),
                                                       F.sum("w").alias("w"))
        last = (F.size("m") == 1) & (F.col("up") == 0)  # the only node of its tree at this level
        made = stored(above.select(*keys, "up", "w", last.alias("last"), _joined(F.col("m.hash")).alias("kids")), f"{name}{level}")
        tops.append(made.where("last").select(*keys, F.lit(level).alias("level"), F.col("kids").alias("hash"), "w"))
        rest = made.where("NOT last").select(*keys, F.lit(level + 1).alias("level"), F.col("up").alias("idx"),
                                             _node_hash(F.col("kids")).alias("hash"), "kids", "w")
        if rest.isEmpty():
            return built, tops
        built.append(rest)
        cur, level = rest, level + 1


def build(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The stored tree over ``runs``: node rows (node, parent, pos, hash, kids, is_sub, w)
    and one row a subroot (node, parent, pos); the root has no parent."""
    lone = (F.col("n") == 1) & (F.col("run") == 0)
    first = runs.select("grp", F.col("run").alias("idx"), F.lit(1).alias("level"), "kids", F.col("n").cast("long").alias("w"),
                        lone.alias("lone"), F.when(lone, F.col("kids")).otherwise(_node_hash(F.col("kids"))).alias("hash"))
    built, tops = _levels(first.where("NOT lone"), ["grp"], 1, "level")
    tops.append(first.where("lone").select("grp", F.lit(0).alias("level"), "hash", "w"))
    subs = stored(global_row_number(reduce(DataFrame.unionByName, tops), ["grp"], name="rn"), "subroots")
    subs = subs.withColumn("idx", F.col("rn") - 1)
    above, _ = _levels(subs.select("idx", "hash", "w"), [], 0, "top")
    alone = F.lit(not above)  # one group only: its subroot is the root
    links = subs.select(_id(F.col("grp"), F.col("level"), F.lit(0)).alias("node"),
                        F.when(~alone, _top_id(1, F.floor(F.col("idx") / FAN).cast("long"))).alias("link"),
                        (F.col("idx") % FAN).cast("int").alias("link_pos"))
    links = stored(links, "links")
    own = [d.select(_id(F.col("grp"), F.col("level"), F.col("idx")).alias("node"), "hash", "kids", "w",
                    _id(F.col("grp"), F.col("level") + 1, F.floor(F.col("idx") / FAN).cast("long")).alias("parent"),
                    (F.col("idx") % FAN).cast("int").alias("pos")) for d in built]
    empty = first.limit(0).select(F.lit("").alias("node"), "hash", "kids", "w", F.lit("").alias("parent"), F.lit(0).alias("pos"))
    own = _linked(reduce(DataFrame.unionByName, own, empty), links)
    top = [d.select(_top_id(k + 1, F.col("idx")).alias("node"), "hash", "kids", "w",
                    F.lit(None).cast("string").alias("parent") if k + 1 == len(above)
                    else _top_id(k + 2, F.floor(F.col("idx") / FAN).cast("long")).alias("parent"),
                    (F.col("idx") % FAN).cast("int").alias("pos"), F.lit(False).alias("is_sub")) for k, d in enumerate(above)]
    return stored(reduce(DataFrame.unionByName, top, own), "nodes"), links


def _linked(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Let the subroots among ``nodes`` name their parent in the tree of subroots."""
    sub = F.col("link_pos").isNotNull()
    return nodes.join(links, "node", "left").withColumn("is_sub", sub) \
        .withColumn("parent", F.when(sub, F.col("link")).otherwise(F.col("parent"))) \
        .withColumn("pos", F.when(sub, F.col("link_pos")).otherwise(F.col("pos"))).drop("link", "link_pos")


@contextmanager
def _unlimited(spark: SparkSession) -> Iterator[None]:
    """Without Spark's default limit of rows in a recursive query."""
    key = "spark.sql.cteRecursionRowLimit"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def climb(spark: SparkSession, starts: DataFrame, nodes: DataFrame, *, send: bool) -> DataFrame:
    """Every row of ``starts`` carried upwards through ``nodes`` as far as they reach.

    A row holds its place (parent, pos), the hash of the node it stands at, the
    subroot it has passed, the proof so far and the hashes folded so far."""
    hint = "/*+ BROADCAST(n) */" if send else ""
    sql = f"""
        WITH RECURSIVE climb AS (
          SELECT run, parent, pos, stop, hash, subroot, proof, folds FROM {{starts}}
          UNION ALL
          SELECT {hint} c.run, n.parent, n.pos, n.stop, n.hash,
                 coalesce(c.subroot, CASE WHEN n.is_sub THEN n.hash END),
                 concat(c.proof, substring(n.kids, 1, 32 * c.pos), substring(n.kids, 32 * c.pos + 33)),
                 transform(c.folds, f -> unhex(sha2(lower(hex(concat(
                   substring(n.kids, 1, 32 * c.pos), f, substring(n.kids, 32 * c.pos + 33)))), 256)))
          FROM climb c JOIN {{nodes}} n ON c.parent = n.node WHERE NOT c.stop)
        SELECT * FROM climb WHERE stop"""
    with _unlimited(spark):
        return stored(spark.sql(sql, starts=starts, nodes=nodes), "climb")


def _begin(runs: DataFrame) -> DataFrame:
    """The runs with the name of their node and the first step of the climb:
    ``folds``, the different hashes their leaves lead to, and ``which`` of them a leaf leads to."""
    lone = (F.col("n") == 1) & (F.col("run") == 0)

    def fold(p: Column) -> Column:
        before, after = _around(F.col("kids"), p)
        return _node_hash(F.concat(before, F.get("changed", p), after))

    each = F.when(lone, F.col("changed")).otherwise(F.transform(F.sequence(F.lit(0), F.col("n") - 1), fold))
    return (runs.select(_id(F.col("grp"), F.when(lone, 0).otherwise(1), F.col("run")).alias("node"), "ids", "kids", "n",
                        F.when(lone, F.col("kids")).otherwise(_node_hash(F.col("kids"))).alias("hash"),
                        _id(F.col("grp"), F.lit(2), F.floor(F.col("run") / FAN).cast("long")).alias("parent"),
                        (F.col("run") % FAN).cast("int").alias("pos"), each.alias("each"))
            .withColumn("folds", F.array_distinct("each"))
            .withColumn("which", F.transform("each", lambda f: F.array_position("folds", f).cast("int"))).drop("each"))


def proofs(leaves: DataFrame) -> DataFrame:
    """(id, leaf, subroot, root, siblings, folded_root), hashes as 32 bytes and the
    siblings from leaf to root one after the other, for ``leaves`` (id, grp, leaf, changed)."""
    spark = leaves.sparkSession
    runs = stored(leaf_runs(leaves), "runs")
    nodes, links = build(runs)
    total = F.lit(runs.agg(F.sum("n")).first()[0] or 0)
    heavy = stored(nodes.where(F.col("w") * SHARE > total), "heavy")  # fewer than SHARE a level
    ids = F.broadcast(heavy.select(F.col("node").alias("parent"), F.lit(True).alias("up")))

    def until_heavy(df: DataFrame) -> DataFrame:
        return df.join(ids, "parent", "left").withColumn("stop", F.col("parent").isNull() | F.col("up").isNotNull()).drop("up")

    begin = stored(_linked(_begin(runs), links), "begin")
    starts = until_heavy(begin.select(F.col("node").alias("run"), "parent", "pos", "hash", "folds", F.lit(b"").alias("proof"),
                                      F.when(F.col("is_sub"), F.col("hash")).alias("subroot")))
    light = stored(until_heavy(nodes.join(F.broadcast(heavy.select("node")), "node", "left_anti")), "light")
    low = climb(spark, starts, light, send=False)
    at_root = F.col("parent").isNull()
    done = climb(spark, low.withColumn("stop", at_root), heavy.withColumn("stop", at_root), send=True)
    done = done.select(F.col("run").alias("node"), F.col("hash").alias("root"), "subroot", "proof", F.col("folds").alias("ends"))
    each = begin.select("node", "kids", "n", "which", F.posexplode("ids").alias("at", "id"))
    before, after = _around(F.col("kids"), F.col("at"))
    return each.join(done, "node").select(
        "id", F.substring("kids", F.col("at") * 32 + 1, F.lit(32)).alias("leaf"), "subroot", "root",
        F.concat(before, after, "proof").alias("siblings"),
        F.get("ends", F.get("which", F.col("at")) - 1).alias("folded_root"))


def manifest(docs: DataFrame, changed: Column, *, key: str = "doc_id", group: str = "lang", text: str = "text",
             fields: Sequence[str] = FIELDS) -> DataFrame:
    """Leaf, subroot, root and proof of every row of ``docs``, and what a verifier
    finds who meets ``changed`` in place of its ``text``."""
    leaf = leaf_hash([F.col(c) for c in fields])
    met = leaf_hash([changed if c == text else F.col(c) for c in fields])
    leaves = docs.select(F.col(key).alias("id"), F.col(group).cast("string").alias("grp"), leaf.alias("leaf"), met.alias("changed"))
    out = proofs(leaves)
    hexed = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root", "folded_root")]
    return out.select(F.col("id").alias(key), *hexed, F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256"),
                      (F.col("folded_root") == F.col("root")).alias("verified"))


def tampered(key: Column, text: Column) -> Column:
    """The text as the verifier meets it: where 3 divides the CRC-32 of the id, A-Z are lower-cased."""
    return F.when(F.crc32(key.cast("string").cast("binary")) % 3 == 0, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    return manifest(read(spark, sf_dir, "documents"), tampered(F.col("doc_id"), F.col("text")))


#: CRC-32 of an ASCII text ``{x}``: a fold over its bytes, each followed by eight shifts.
CRC32_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(str_split({x}, ''),
  lambda b: [ascii(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"""

ORACLE = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS uid, doc_id, lang,
  concat(coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source) || ':' || source, '-'),
    coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
  text, CASE WHEN @CRC % 3 = 0
    THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS met FROM documents),
leaf AS (SELECT uid, doc_id, lang, coalesce('g' || lang, 'n') AS tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  sha256(head || coalesce(strlen(met) || ':' || met, '-')) AS changed FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, uid) - 1 AS idx FROM leaf),
lv(tree, level, idx, hash, n) AS (
  SELECT tree, 0, idx, leaf, count(*) OVER (PARTITION BY tree) FROM placed
  UNION ALL
  SELECT tree, level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), any_value((n + 7) // 8)
  FROM lv WHERE n > 1 GROUP BY tree, level, idx // 8),
sub AS (SELECT tree, hash, row_number() OVER (ORDER BY tree = 'n' DESC, tree) - 1 AS t FROM lv WHERE n = 1),
tp(level, idx, hash, n) AS (
  SELECT 0, t, hash, count(*) OVER () FROM sub
  UNION ALL
  SELECT level + 1, idx // 8, sha256(string_agg(hash, '' ORDER BY idx)), any_value((n + 7) // 8)
  FROM tp WHERE n > 1 GROUP BY level, idx // 8),
every AS (SELECT * FROM lv UNION ALL SELECT 't', level, idx, hash, n FROM tp),
step AS (SELECT e.tree, level, idx, n,
  coalesce(string_agg(e.hash, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(e.hash, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r, t
  FROM every e LEFT JOIN sub ON e.tree = sub.tree
  WINDOW w AS (PARTITION BY e.tree, level, idx // 8 ORDER BY idx)),
climb(uid, tree, level, idx, sibs, fold, done) AS (
  SELECT uid, tree, 0, idx, '', changed, false FROM placed
  UNION ALL
  SELECT uid, CASE WHEN s.n > 1 THEN c.tree ELSE 't' END, CASE WHEN s.n > 1 THEN c.level + 1 ELSE 0 END,
    CASE WHEN s.n > 1 THEN c.idx // 8 ELSE s.t END, CASE WHEN s.n > 1 THEN sibs || l || r ELSE sibs END,
    CASE WHEN s.n > 1 THEN sha256(l || fold || r) ELSE fold END, s.n = 1 AND c.tree = 't'
  FROM climb c JOIN step s ON c.tree = s.tree AND c.level = s.level AND c.idx = s.idx WHERE NOT done)
SELECT p.doc_id, p.leaf, sub.hash AS subroot, top.hash AS root, sha256(sibs) AS proof_sha256, fold AS folded_root,
  fold = top.hash AS verified
FROM climb JOIN placed p USING (uid) JOIN sub ON sub.tree = p.tree, (SELECT hash FROM tp WHERE n = 1) top WHERE done
""".replace("@CRC", CRC32_SQL.format(x="doc_id::VARCHAR"))
