r"""Quotation linking of conversations (operator 8): DataFrame operations only.

Lines that begin with ``>`` are quotes; their number of ``>`` is the level.
Consecutive lines of one level are a passage. Passages (and each of their
lines) are normalised and hashed, and so are the unquoted body, paragraphs and
lines of every message of conversations with quotes. A quote is linked to the
latest earlier message of its conversation with that hash. Quotes and
originals are sorted together by (conversation, hash, turn) over range
partitions and the last original is carried forward, so a phrase that is said
and quoted very often neither makes pairs nor lands in one task.

A message replies to the latest message that its level-1 quotes link to;
deeper levels are links, not parents. A message without such a link starts a
thread. Messages are numbered per conversation thread by thread, in order of
turns inside a thread, so that every reply follows what it answers; quotes and
the attribution line before them are left out of the text.

Defined results: null text is empty and quotes nothing. Rows with a null
conversation form one conversation. A null turn sorts first, and neither links
nor is linked. Repeated rows are separate messages; among equal turns the row
order decides. A null role is formatted as ``unknown``. An empty table gives
no row. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bizlens.llm.shared import read, stored
from bizlens.plans.order import global_row_number, prefix_max

QUOTE = r"^(?:[ \t]{0,3}>)+"
ATTRIBUTION = r"(?i)(wrote|schrieb|a écrit|escribió)\s*:\s*$"


def level_of(line: Column) -> Column:
    """Number of quote marks that the line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def unquoted(text: Column) -> Column:
    """The text without quoted lines and without the attribution line before a quote."""
    lines = F.split(text, "\n")
    return F.array_join(F.filter(lines, lambda x, k: ~x.rlike(QUOTE) & ~(
        x.rlike(ATTRIBUTION) & F.coalesce(F.get(lines, k + 1).rlike(QUOTE), F.lit(False)))), "\n")


def quotes(messages: DataFrame) -> DataFrame:
    """(uid, conv, turn, level, passage, hash): every quoted passage, and each line of longer ones."""
    lines = messages.where(F.col("text").contains(">")) \
        .select("uid", "conv", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line")) \
        .withColumn("level", level_of(F.col("line"))).where("level > 0")
    run = Window.partitionBy("uid", "level").orderBy("pos")  # the lines of one message
    lines = lines.withColumn("run", F.col("pos") - F.row_number().over(run)) \
        .withColumn("said", F.regexp_replace("line", QUOTE + " ?", ""))
    passage = lines.groupBy("uid", "conv", "turn", "level", "run").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"]), "\n").alias("t"),
        F.min("pos").alias("passage"))
    one = lines.select("uid", "conv", "turn", "level", "run", F.col("said").alias("t")) \
        .join(passage.select("uid", "level", "run", "passage"), ["uid", "level", "run"])
    return passage.select("uid", "conv", "turn", "level", "passage", "t") \
        .unionByName(one.select("uid", "conv", "turn", "level", "passage", "t")) \
        .withColumn("t", normal(F.col("t"))).where("t <> ''") \
        .select("uid", "conv", "turn", "level", "passage", F.md5("t").alias("hash")).distinct()


def originals(messages: DataFrame) -> DataFrame:
    """(uid, conv, turn, hash) of the body, paragraphs and lines of each message."""
    parts = F.array_distinct(F.transform(F.concat(F.array("body"), F.split("body", r"\n[ \t]*\n"), F.split("body", "\n")), normal))
    return messages.select("uid", "conv", "turn", F.explode(parts).alias("t")).where("t <> ''") \
        .select("uid", "conv", "turn", F.md5("t").alias("hash"))


def link(quoted: DataFrame, said: DataFrame) -> DataFrame:
    """(uid, level, passage, to_turn, to_uid): the latest earlier original of each quote."""
    every = quoted.select("conv", "hash", "turn", F.lit(0).alias("kind"), "uid", "level", "passage",
                          F.lit(None).cast("struct<turn:bigint,uid:bigint>").alias("origin")) \
        .unionByName(said.select("conv", "hash", "turn", F.lit(1).alias("kind"), "uid", F.lit(None).cast("int").alias("level"),
                                 F.lit(None).cast("int").alias("passage"), F.struct("turn", "uid").alias("origin")))
    # at one turn quotes come before originals, so a message never links to its own turn
    placed = global_row_number(every, ["conv", "hash", "turn", "kind", "uid"], keep_partition=True)
    carried = prefix_max(placed, ["conv", "hash"], "rn", "origin", name="to")
    return carried.where("kind = 0 and to is not null").select("uid", "level", "passage", F.col("to.turn").alias("to_turn"),
                                                               F.col("to.uid").alias("to_uid"))


def roots(parents: DataFrame) -> DataFrame:
    """(uid, root) of (uid, to_uid) by pointer jumping; every pointer leads to an earlier turn."""
    cur = stored(parents.select("uid", F.col("to_uid").alias("root")), "threads")
    while True:
        up = cur.select(F.col("uid").alias("mid"), F.col("root").alias("next"))
        far = cur.join(up, cur["root"] == up["mid"], "left")
        nxt = stored(far.select("uid", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "threads")
        cur = nxt.select("uid", "root")
        if nxt.where("moved").isEmpty():
            return cur


def threads(conversations: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text") -> DataFrame:
    """One row a message: (conv_id, turn, role, position, thread_turn, reply_to, n_quotes, n_linked, text, formatted)."""
    rows = conversations.select(
        F.col(conv).alias("conv_id"), F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("n")).alias("conv"),
        F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = stored(rows.withColumn("uid", F.monotonically_increasing_id()), "messages")
    timed = rows.where("turn is not null")
    quoted = stored(quotes(timed), "quotes")
    counted = quotes(rows).groupBy("uid").agg(F.count_distinct("level", "passage").alias("n_quotes"))
    said = originals(timed.join(quoted.select("conv").distinct(), "conv", "left_semi")
                     .withColumn("body", unquoted(F.col("text"))))
    linked = stored(link(quoted, said), "links")
    n_linked = linked.groupBy("uid").agg(F.count_distinct("level", "passage").alias("n_linked"))
    parent = linked.where("level = 1").groupBy("uid").agg(F.max(F.struct("to_turn", "to_uid")).alias("p")) \
        .select("uid", F.col("p.to_turn").alias("reply_to"), F.col("p.to_uid").alias("to_uid"))
    parent = stored(parent, "parents")
    top = roots(parent).join(rows.select(F.col("uid").alias("root"), F.col("turn").alias("thread_turn")), "root")
    keys = (rows.select("uid", "conv", "turn").join(parent.drop("to_uid"), "uid", "left").join(top, "uid", "left")
            .join(counted, "uid", "left").join(n_linked, "uid", "left")
            .withColumn("root", F.coalesce("root", "uid")).withColumn("thread_turn", F.coalesce("thread_turn", "turn")))
    keys = global_row_number(keys, ["conv", "thread_turn", "root", "turn", "uid"])  # without the texts
    first = keys.groupBy("conv").agg(F.min("rn").alias("first"))
    placed = keys.join(first, "conv").drop("conv", "turn")
    clean = F.trim(F.col("body"))
    return rows.withColumn("body", unquoted(F.col("text"))).drop("text").join(placed, "uid").select(
        "conv_id", "turn", "role", (F.col("rn") - F.col("first")).cast("long").alias("position"), "thread_turn", "reply_to",
        F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), clean.alias("text"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), clean, F.lit("<|end|>")).alias("formatted"))


def query(spark, sf_dir: str) -> DataFrame:
    return threads(read(spark, sf_dir, "conversations"))


ORACLE = r"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS uid, conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT uid, conv_id, turn, pos, lines[pos] AS line, regexp_matches(lines[pos], '^(?:[ \t]{0,3}>)+') AS q,
    length(regexp_replace(regexp_extract(lines[pos], '^(?:[ \t]{0,3}>)+'), '[^>]', '', 'g')) AS level,
    coalesce(regexp_matches(lines[pos + 1], '^(?:[ \t]{0,3}>)+'), false) AS before_quote
  FROM (SELECT *, unnest(generate_series(1, len(lines))) AS pos
        FROM (SELECT uid, conv_id, turn, string_split(text, chr(10)) AS lines FROM m))),
b AS (SELECT uid, any_value(conv_id) AS conv_id, any_value(turn) AS turn,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT q AND NOT (before_quote
      AND regexp_matches(line, '(?i)(wrote|schrieb|a écrit|escribió)\s*:\s*$'))), '') AS body
  FROM l GROUP BY uid),
ql AS (SELECT *, pos - row_number() OVER (PARTITION BY uid, level ORDER BY pos) AS run,
    regexp_replace(line, '^(?:[ \t]{0,3}>)+ ?', '') AS said FROM l WHERE level > 0),
p AS (SELECT uid, conv_id, turn, level, run, min(pos) AS passage, string_agg(said, chr(10) ORDER BY pos) AS t FROM ql GROUP BY ALL),
qt AS (SELECT uid, conv_id, turn, level, passage, t FROM p
  UNION ALL SELECT ql.uid, ql.conv_id, ql.turn, level, passage, said FROM ql JOIN p USING (uid, level, run)),
qn AS (SELECT DISTINCT uid, conv_id, turn, level, passage, trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM qt),
o AS (SELECT DISTINCT uid, conv_id, turn, trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM (
  SELECT uid, conv_id, turn, body AS t FROM b
  UNION ALL SELECT uid, conv_id, turn, unnest(string_split_regex(body, '\n[ \t]*\n')) FROM b
  UNION ALL SELECT uid, conv_id, turn, unnest(string_split(body, chr(10))) FROM b)),
k AS (SELECT qn.uid, qn.level, qn.passage, max(struct_pack(turn := o.turn, uid := o.uid)) AS origin FROM qn
  JOIN o ON qn.conv_id IS NOT DISTINCT FROM o.conv_id AND qn.t = o.t AND o.turn < qn.turn WHERE qn.t <> '' GROUP BY ALL),
par AS (SELECT uid, max(origin) AS origin FROM k WHERE level = 1 GROUP BY uid),
top(uid, root) AS (SELECT uid, uid FROM m WHERE uid NOT IN (SELECT uid FROM par)
  UNION ALL SELECT par.uid, top.root FROM par JOIN top ON par.origin.uid = top.uid)
SELECT m.conv_id, m.turn, m.role,
  row_number() OVER (PARTITION BY m.conv_id ORDER BY r.turn NULLS FIRST, r.uid, m.turn NULLS FIRST, m.uid) - 1 AS position,
  r.turn AS thread_turn, par.origin.turn AS reply_to,
  (SELECT count(DISTINCT (level, passage)) FROM qn WHERE qn.uid = m.uid AND qn.t <> '') AS n_quotes,
  (SELECT count(DISTINCT (level, passage)) FROM k WHERE k.uid = m.uid) AS n_linked, trim(b.body) AS text,
  '<|' || coalesce(m.role, 'unknown') || '|>' || chr(10) || trim(b.body) || '<|end|>' AS formatted
FROM m JOIN b USING (uid) JOIN top USING (uid) JOIN m r ON r.uid = top.root LEFT JOIN par USING (uid)
"""
