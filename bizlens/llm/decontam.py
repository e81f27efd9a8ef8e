"""Benchmark decontamination by a prefix-filtered set join (operator 3).

Items are cut into windows of ``window`` consecutive words (a shorter item is
one window) and windows into shingles of ``SHINGLE`` words. A window occurs in
a document only if all its shingles do, so by the prefix-filter principle one
shingle is a sufficient prefix at full containment; the rarest one in the
corpus is taken, after counting the document frequency of every benchmark
shingle over all documents.

Documents are scanned for prefix shingles through a bitmap of bounded size; a
hit carries the words around it. Hits and windows meet in a Spark join on the
shingle. The length and positional bounds (the window must fit before and
after the hit) come first, then the exact comparison of all words. Matches
turn into the union of hit words and the set of items of each document.

Defined results: null or wordless texts have no words and no hits; null or
wordless items match nothing. Repeated items and ids: an item id is listed
once; an item without an id marks words but is not listed or counted.
Repeated documents are judged row by row. Empty tables give no row, or rows
without hits. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.llm import bytetext as bt
from bizlens.llm.shared import free_name, read, stored

SHINGLE = 3
MAX_BITS = 27


def _block_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    low = bt.LOWER[data]
    starts, ends, cut = bt.words(low, offsets, bt.ALNUM)
    return low, starts, ends, cut, bt.word_hashes(low, starts, ends)


def _shingles(h: np.ndarray, cut: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes at every word, and whether the ``n`` words from there are in one text."""
    s = bt.shingle_hashes(h, n)
    of = bt.text_of(cut)
    return s, of[:len(s)] == of[n - 1:]


def item_windows(bench: DataFrame, *, key: str, text: str, window: int) -> DataFrame:
    """(item, words, shingles): the windows of each item and their shingle hashes."""

    def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = bt.text_bytes(b.column(1))
            row, words, hashes = [], [], []
            for lo, hi, d, o in bt.blocks(data, offsets):
                low, starts, ends, cut, h = _block_words(d, o)
                raw = low.tobytes()
                for k in range(hi - lo):
                    a, z = int(cut[k]), int(cut[k + 1])
                    w = [raw[starts[i]:ends[i]].decode() for i in range(a, z)]
                    size = min(window, len(w))
                    s = bt.shingle_hashes(h[a:z], min(SHINGLE, size)).view(np.int64).tolist() if size else []
                    for at in range(len(w) - size + 1 if size else 0):
                        row.append(lo + k)
                        words.append(w[at:at + size])
                        hashes.append(s[at:at + max(1, size - SHINGLE + 1)])
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(words, pa.list_(pa.string())),
                 pa.array(hashes, pa.list_(pa.int64()))], ["item", "words", "shingles"])

    kind = bench.schema[key].dataType.simpleString()
    return bench.select(F.col(key).alias("item"), F.col(text)).mapInArrow(
        cut_items, f"item {kind}, words array<string>, shingles array<long>")


def _bitmaps(shingles: DataFrame) -> dict[int, tuple[int, np.ndarray]]:
    """For each shingle length: (mask, bitmap) over the hashes ``h``. At most
    2**MAX_BITS bits whatever the benchmark; a full bitmap only lets more hits
    through to the join."""
    out = {}
    for n, count in shingles.groupBy("n").agg(F.count_distinct("h")).collect():  # SHINGLE rows
        bits = min(MAX_BITS, max(16, int(count * 64).bit_length()))
        # 64 slots a row: at most 2**(MAX_BITS - 6) rows reach the driver
        slots = shingles.where(F.col("n") == n).select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("b")) \
            .groupBy(F.shiftright("b", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("on")) \
            .toPandas()
        mask = np.zeros(1 << (bits - 6), "<i8")
        mask[slots["at"].to_numpy(np.int64)] = slots["on"].to_numpy(np.int64)
        out[n] = ((1 << bits) - 1, mask.view(np.uint8))
    return out


def _member(maps: dict, n: int, s: np.ndarray, ok: np.ndarray) -> np.ndarray:
    """Places in ``s`` whose hash is in the bitmap for length ``n``."""
    mask, bits = maps[n]
    at = (s & np.uint64(mask)).astype(np.int64)
    hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
    return np.flatnonzero((hit == 1) & ok)


def document_frequency(docs: DataFrame, text: str, maps: dict) -> DataFrame:
    """(h, df) of the shingles in ``maps`` over all documents, summed in the tasks first."""
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}

        def table() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(np.fromiter(seen.keys(), np.uint64, len(seen)).view(np.int64)),
                 pa.array(list(seen.values()), pa.int64())], ["h", "df"])
            seen.clear()
            return out

        for b in batches:
            data, offsets = bt.text_bytes(b.column(0))
            for _, _, d, o in bt.blocks(data, offsets):
                _, _, _, cut, h = _block_words(d, o)
                of = bt.text_of(cut)
                for n in shared.value:
                    s, ok = _shingles(h, cut, n)
                    at = _member(shared.value, n, s, ok)
                    pair = np.unique(np.stack([of[at].astype(np.uint64), s[at]], 1), axis=0) if len(at) else s[:0].reshape(0, 1)
                    keys, sizes = np.unique(pair[:, -1], return_counts=True)
                    for x, c in zip(keys.tolist(), sizes.tolist()):
                        seen[x] = seen.get(x, 0) + c
            if len(seen) > 500_000:
                yield table()
        yield table()

    return docs.select(text).mapInArrow(count, "h long, df long").groupBy("h").agg(F.sum("df").alias("df"))


def scan(spark, text, maps: dict, window: int):
    """Struct (n_words, hits): for each prefix shingle found its hash, place,
    the words around it and the place of the first of them."""
    shared = spark.sparkContext.broadcast(maps)
    hit = pa.struct([("h", pa.int64()), ("pos", pa.int32()), ("first", pa.int32()), ("words", pa.list_(pa.string()))])

    @F.arrow_udf("struct<n_words:long,hits:array<struct<h:long,pos:int,first:int,words:array<string>>>>")
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for col in batches:
            data, offsets = bt.text_bytes(col)
            n_words, hits = np.zeros(len(col), np.int64), [[] for _ in range(len(col))]
            for lo, hi, d, o in bt.blocks(data, offsets):
                low, starts, ends, cut, h = _block_words(d, o)
                n_words[lo:hi] = np.diff(cut)
                of, raw = None, None
                for n in shared.value:
                    s, ok = _shingles(h, cut, n)
                    at = _member(shared.value, n, s, ok)
                    if not len(at):
                        continue
                    if raw is None:
                        of, raw = bt.text_of(cut), low.tobytes()
                    reach = window - n if n == SHINGLE else 0
                    for i in at.tolist():
                        k = int(of[i])
                        a, z = max(int(cut[k]), i - reach), min(int(cut[k + 1]), i + n + reach)
                        hits[lo + k].append({"h": int(s[i].astype(np.int64)), "pos": i - int(cut[k]),
                                             "first": a - int(cut[k]),
                                             "words": [raw[starts[j]:ends[j]].decode() for j in range(a, z)]})
            yield pa.StructArray.from_arrays([pa.array(n_words), pa.array(hits, pa.list_(hit))], ["n_words", "hits"])

    return look.asNondeterministic()(text)


def prefixes(docs: DataFrame, windows: DataFrame, text: str) -> DataFrame:
    """(win, h, at, size, words, n): the rarest shingle of each distinct window."""
    each = windows.select("win", "words", F.size("words").alias("size"),
                          F.least(F.size("words"), F.lit(SHINGLE)).alias("n"),
                          F.posexplode("shingles").alias("at", "h")).dropDuplicates(["win", "at"])
    each = stored(each, "shingles")
    df = document_frequency(docs, text, _bitmaps(each))
    rarest = Window.partitionBy("win").orderBy("df", "h", "at")  # at most ``window`` shingles
    return stored(each.join(df, "h", "left").withColumn("df", F.coalesce("df", F.lit(0)))
                  .withColumn("r", F.row_number().over(rarest)).where("r = 1").drop("r", "df"), "prefixes")


def windows_of(bench: DataFrame, *, key: str = "item_id", text: str = "text", window: int = 10) -> DataFrame:
    """(item, win, words, shingles); ``win`` identifies equal windows."""
    out = item_windows(bench, key=key, text=text, window=window)
    return stored(out.withColumn("win", F.md5(F.concat_ws(" ", "words"))), "windows")


def matches(scanned: DataFrame, prefix: DataFrame, *, uid: str, hits: str) -> DataFrame:
    """(uid, win, start, stop) of every exact occurrence of a window."""
    found = scanned.select(F.col(uid).alias("uid"), F.col(f"{hits}.n_words").alias("n_words"),
                           F.explode(f"{hits}.hits").alias("hit"))
    found = found.select("uid", "n_words", F.col("hit.h").alias("h"), F.col("hit.pos").alias("pos"),
                         F.col("hit.first").alias("first"), F.col("hit.words").alias("near"))
    start = F.col("pos") - F.col("at")
    fits = (start >= F.col("first")) & (start + F.col("size") <= F.col("n_words"))
    exact = F.slice("near", F.greatest(F.lit(1), start - F.col("first") + 1), F.col("size")) == F.col("words")
    return found.join(prefix, "h").where(fits).where(exact) \
        .select("uid", "win", start.alias("start"), (start + F.col("size")).alias("stop"))


def contamination(docs: DataFrame, bench: DataFrame, *, key: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items (sorted ids as strings), contaminated), one row a document."""
    spark = docs.sparkSession
    windows = windows_of(bench, key=item, text=item_text, window=window)
    prefix = prefixes(docs, windows, text)
    maps = _bitmaps(prefix)
    scanned = stored(docs.select(F.col(key).alias("key"), scan(spark, F.col(text), maps, window).alias("scan"))
                     .withColumn("uid", F.monotonically_increasing_id()), "scanned")
    found = stored(matches(scanned, prefix, uid="uid", hits="scan").distinct(), "matches")
    before = Window.partitionBy("uid").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("uid", "start", "stop").distinct()
    covered = spans.withColumn("done", F.coalesce(F.max("stop").over(before), F.lit(0))) \
        .groupBy("uid").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "done"))).alias("n_hit"))
    # documents with the same set of windows have the same items, so every distinct set is resolved once
    sets = stored(found.groupBy("uid").agg(F.sort_array(F.collect_set("win")).alias("wins"))
                  .select("uid", F.sha2(F.concat_ws(",", "wins"), 256).alias("set"), "wins"), "window-sets")
    each = sets.select("set", "wins").dropDuplicates(["set"]).select("set", F.explode("wins").alias("win"))
    items = (each.join(windows.select("win", "item").distinct(), "win")
             .groupBy("set").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items")))
    ids = sets.select("uid", "set").join(items, "set").select("uid", "items")
    out = scanned.select("uid", "key", F.col("scan.n_words").alias("n_words")) \
        .join(covered, "uid", "left").join(ids, "uid", "left")
    return out.select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
                      F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
                      F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                      F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"))


def query(spark, sf_dir: str) -> DataFrame:
    out = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items",
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold any window of the benchmark."""
    windows = windows_of(read(spark, sf_dir, "benchmark"))
    prefix = prefixes(docs, windows, "text")
    # rows of one id and text have the same verdict, so only ids, hashes and hits are written
    scanned = stored(docs.select(F.col("doc_id").alias("key"), F.xxhash64("text").alias("h"),
                                 scan(spark, F.col("text"), _bitmaps(prefix), 10).alias("scan"))
                     .withColumn("uid", F.monotonically_increasing_id()), "scanned")
    found = matches(scanned, prefix, uid="uid", hits="scan").select("uid").distinct()
    key, h = free_name(docs, "bad_key"), free_name(docs, "bad_hash")
    bad = scanned.join(found, "uid", "left_semi").select(F.col("key").alias(key), F.col("h").alias(h)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(key)) & (F.xxhash64(docs["text"]) == F.col(h))
    return docs.join(bad, same, "left_anti").select(*docs.columns)


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS size,
  array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
occ AS (SELECT uid, s, size, array_to_string(w[s:s + size - 1], ' ') AS t
  FROM (SELECT uid, w, size, unnest(generate_series(1, len(w) - size + 1)) AS s FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT o.uid, o.s, o.size, win.item_id FROM occ o JOIN win ON o.t = win.t AND o.size = win.size),
hit AS (SELECT uid, count(DISTINCT p) AS n_hit
  FROM (SELECT uid, unnest(generate_series(s, s + size - 1)) AS p FROM (SELECT DISTINCT uid, s, size FROM m)) GROUP BY uid),
ids AS (SELECT uid, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT uid, CAST(item_id AS VARCHAR) AS i FROM m WHERE item_id IS NOT NULL) GROUP BY uid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(ids.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids.l, '')) AS items_sha256,
  coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (uid) LEFT JOIN ids USING (uid)
"""
