"""Substring deduplication by fixed-block anchors (operator 13).

A window is ``window`` consecutive words of one document. Every word covered by
a window whose words also start anywhere else is removed, first places included.

* Index: the non-overlapping reference blocks of ``(window + 1) // 2`` words
  that start at multiples of that length. A window contains exactly one whole
  block of its own document's grid, so a repeated window holds a block whose
  words also occur elsewhere, at any offset.
* Probe: every rolling window of block length, in every document, is looked up
  in the index, first through a bitmap of fixed size, then by a join on the
  hash. Blocks found at a second place are the anchors.
* Extension: an anchor is extended by every window around it. Comparing all
  pairs of places would be quadratic in a group of copies, so the extended
  windows are counted by their content (96 bits of two rolling hashes), each
  window once, since it has one block of the grid. Consecutive windows that
  occur twice merge into the maximal exact repeats.

Rows with equal id and text have the same repeats, so windows find their way
back by a 96-bit hash of both; texts are not written, and meet the repeats in
one join. Windows with very many places are sent to all tasks (fewer than 1,000
of them), the others are shuffled. The bitmaps have ``2 ** BITS`` bits at any
input size; where they fill up, more probes and windows go through the joins,
and the result stays the same.

Defined results: null, empty and blank texts have no words and lose none, as do
texts shorter than a window. Repeated rows and equal texts of at least a window
lose all their words in every row. Extra columns are not read. An empty table
gives no row. A very long text is a block of its own in its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm import bytetext as bt
from bizlens.llm.shared import join_by_weight, read, stored

BITS = 27
_SALT = np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64((1 << 32) - 1)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words, from one prefix sum."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    up, down = bt._powers(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[:len(h)], dtype=np.uint64, out=total[1:])
    return bt.mix((total[n:] - total[:-n]) * down[:m] + np.uint64(n))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, place in its text) of every word of a block."""
    starts, ends, cut = bt.words(data, offsets, bt.NOT_BLANK)
    of = bt.text_of(cut)
    return bt.word_hashes(data, starts, ends), of, np.arange(len(of)) - cut[:-1][of]


def _runs(h: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hashes, and which of them lie in one text."""
    s = rolling(h, n)
    return s, of[:len(s)] == of[n - 1:] if len(s) else np.zeros(0, bool)


def _in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have both of their places set."""
    mask = np.uint64(8 * len(bits) - 1)
    a, b = (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)
    return (((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8))) & 1) == 1


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The hashes ``h`` as two places each of ``2 ** BITS`` bits. At most
    ``2 ** (BITS - 6)`` rows of 64 places reach the driver."""
    mask = (1 << BITS) - 1
    place = F.explode(F.array(F.col("h").bitwiseAND(F.lit(mask)),
                              F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(mask)))).alias("b")
    slots = hashes.select(place).groupBy(F.shiftright("b", 6).alias("at")) \
        .agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("on")).toArrow()
    out = np.zeros(1 << (BITS - 6), "<i8")
    out[slots["at"].to_numpy()] = slots["on"].to_numpy()
    return out.view(np.uint8)


def _hash_column(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], ["h"])


def reference_blocks(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(h, n): the blocks of every document's grid, with their number."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, d, o in bt.blocks(*bt.text_bytes(b.column(0))):
                h, of, at = _words(d, o)
                s, one = _runs(h, of, size)
                yield _hash_column(s[one & (at[:len(s)] % size == 0)])

    return docs.select(text).mapInArrow(cut, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))


def anchors(docs: DataFrame, text: str, size: int) -> DataFrame:
    """(h): the reference blocks whose words start at two places or more."""
    index = stored(reference_blocks(docs, text, size), "blocks")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(index))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, d, o in bt.blocks(*bt.text_bytes(b.column(0))):
                h, of, at = _words(d, o)
                s, one = _runs(h, of, size)
                s = s[one & (at[:len(s)] % size != 0)]  # the blocks themselves are counted in the index
                yield _hash_column(np.unique(s[_in(bits.value, s)]))

    probes = docs.select(text).mapInArrow(probe, "h long").groupBy("h").agg(F.lit(True).alias("off_grid"))
    return index.join(probes, "h", "left").where("n > 1 OR off_grid").select("h")


def _row(key: str, text: str) -> list[Column]:
    """The 96 bits that stand for a row's id and text."""
    both = F.coalesce(F.col(key).cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(*both).alias("r1"), F.hash(F.crc32(both[1]), *both).alias("r2")]


def extended(docs: DataFrame, found: np.ndarray, *, key: str, text: str, window: int) -> DataFrame:
    """(k1, k2, r1, r2, at): every window around an anchor: its content, row and first word."""
    size = (window + 1) // 2
    bits = docs.sparkSession.sparkContext.broadcast(found)

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, d, o in bt.blocks(*bt.text_bytes(b.column(2))):
                h, of, at = _words(d, o)
                k, one = _runs(h, of, window)
                if not len(k):
                    continue
                s = rolling(h, size)
                block = np.arange(len(k)) + (-at[:len(k)]) % size  # the window's block of the grid
                w = np.flatnonzero(one)
                w = w[_in(bits.value, s[block[w]])]
                k2 = rolling(bt.mix(h ^ _SALT), window)[w]
                row = pa.array(lo + of[w])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k[w].view(np.int64)), pa.array((k2 & _HALF).astype(np.uint32).view(np.int32)),
                     b.column(0).take(row), b.column(1).take(row), pa.array(at[w].astype(np.int32))],
                    ["k1", "k2", "r1", "r2", "at"])

    return docs.select(*_row(key, text), F.col(text)).mapInArrow(extend, "k1 long, k2 int, r1 long, r2 int, at int")


def repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """(r1, r2, starts, stops): the maximal exact repeats of each row that has any, in words."""
    found = bitmap(stored(anchors(docs, text, (window + 1) // 2), "anchors"))
    near = extended(docs, found, key=key, text=text, window=window).withColumn("k", F.struct("k1", "k2"))
    twice = stored(near.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "windows")
    places = join_by_weight(near.select("k", "r1", "r2", "at"), twice, "k", "n")
    each = places.groupBy("r1", "r2").agg(F.sort_array(F.collect_set("at")).alias("at"))
    gap = F.lit(window)
    starts = F.filter("at", lambda x, i: (i == 0) | (x - F.get("at", i - 1) > gap))
    stops = F.filter("at", lambda x, i: (i == F.size("at") - 1) | (F.get("at", i + 1) - x > gap))
    return stored(each.select("r1", "r2", starts.alias("starts"), F.transform(stops, lambda x: x + gap).alias("stops")),
                  "repeats")


def _without(text: bytes, spans: tuple[list[int], list[int]] | None) -> tuple[int, int, bytes]:
    """(words, words removed, the kept words joined by a space)."""
    words = text.split()
    if not spans:
        return len(words), 0, b" ".join(words)
    kept, done = [], 0
    for a, z in zip(*spans):
        kept += words[done:a]
        done = z
    kept += words[done:]
    return len(words), len(words) - len(kept), b" ".join(kept)


def deduplicate(docs: DataFrame, *, key: str = "doc_id", text: str = "text", window: int = 35,
                keep_text: bool = True) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, kept]), one row a document."""
    spans = repeats(docs, key=key, text=text, window=window)
    kind = "n_words long, n_removed long, kept_sha256 string" + (", kept string" if keep_text else "")

    def clean(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts, stops in batches:
            rows = []
            for t, a, z in zip(texts.fill_null("").cast(pa.large_binary()), starts, stops):
                n, gone, kept = _without(t.as_py(), (a.as_py(), z.as_py()) if a.is_valid else None)
                rows.append((n, gone, hashlib.sha256(kept).hexdigest(), *([kept.decode()] if keep_text else [])))
            cols = list(zip(*rows)) or [()] * (4 if keep_text else 3)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_words", "n_removed", "kept_sha256", "kept"]
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names[:len(cols)])

    udf = F.arrow_udf(clean, f"struct<{kind.replace(' ', ':').replace(',:', ',')}>").asNondeterministic()
    out = docs.select(F.col(key).alias("id"), F.col(text).alias("t"), *_row(key, text)).join(spans, ["r1", "r2"], "left")
    return out.select("id", udf("t", "starts", "stops").alias("o")).select(F.col("id").alias(key), "o.*")


def query(spark, sf_dir: str) -> DataFrame:
    return deduplicate(read(spark, sf_dir, "documents"), keep_text=False)


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS uid,
  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT uid, s, sha256(array_to_string(w[s:s + 34], ' ')) AS k
  FROM (SELECT uid, w, unnest(generate_series(1, len(w) - 34)) AS s FROM d WHERE len(w) >= 35)),
rep AS (SELECT uid, s FROM win WHERE k IN (SELECT k FROM win GROUP BY k HAVING count(*) > 1)),
word AS (SELECT uid, unnest(w) AS x, unnest(generate_series(1, len(w))) AS i FROM d),
last AS (SELECT word.uid, i, x, s FROM word ASOF LEFT JOIN rep ON word.uid = rep.uid AND word.i >= rep.s),
kept AS (SELECT uid, count(*) FILTER (WHERE s IS NOT NULL AND i < s + 35) AS n_removed,
  string_agg(x, ' ' ORDER BY i) FILTER (WHERE s IS NULL OR i >= s + 35) AS t FROM last GROUP BY uid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (uid)
"""
