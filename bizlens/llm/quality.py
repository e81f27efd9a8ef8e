"""Quality rules (operator 7).

Two multinomials over hashed word n-grams (1 and 2 words, ``2**BUCKET_BITS``
buckets, lower-cased) are counted: the trusted target (documents labelled good
and not toxic, a bounded sample of them) and the raw corpus (all documents). A document's score is the
log-likelihood ratio of its n-grams between the two, divided by their number.
The threshold is deterministic, so the same document always gets the same
verdict: halfway between the ``keep_quantile`` quantile of the scores of the
trusted documents and the ``1 - 10 * keep_quantile`` quantile of the distrusted
ones, or just below the former where the two overlap.
Toxic documents are made of the same words as clean ones but for a few, which
the ratio over all n-grams does not show. A second ratio holds those few: the
words (letters and digits, ``2**WORD_BITS`` buckets) that labelled toxic
documents hold more often than trusted ones, where the likelihood-ratio
statistic of the two document counts is at least ``WORD_EVIDENCE``. Their log
ratios summed over a document's words and divided by the number of words are its
toxicity. Its cut is the one with the fewest misjudged labelled documents
(trusted ones above it, toxic ones below it), and these are scored by words
fitted on the other half of the labels, so no document vouches for itself.
Independent base rules (word count, share of repeated words) come first.

Defined results: a null or blank text has no words, so it fails the base rule.
Without trusted documents there is no target and the base rule alone decides;
score 0. Without toxic ones toxicity is 0. Labels without a document, or of null ids, are ignored; of several
labels of one id the worst counts. Repeated rows get equal answers. Only the
named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm import bytetext as bt
from bizlens.llm.shared import free_name, read, stored

BUCKET_BITS = 16
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_TRUSTED = 100_000
WORD_BITS = 18
WORD_EVIDENCE = 20.0

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LEAD = np.ones(256, bool)  # bytes that begin a code point
_LEAD[0x80:0xC0] = False


def _buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and word pairs of each text, and where each text's begin."""
    low = bt.LOWER[data]
    starts, ends, cut = bt.words(low, offsets, bt.NOT_BLANK)
    h = bt.word_hashes(low, starts, ends)
    of = bt.text_of(cut)
    pair = bt.shingle_hashes(h, 2)
    pair = pair[of[:-1] == of[1:]] if len(of) > 1 else pair
    n_pairs = np.maximum(np.diff(cut) - 1, 0)
    size = np.diff(cut) + n_pairs
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(at[-1], np.int64)
    shift = np.uint64(64 - BUCKET_BITS)
    out[np.arange(len(h)) + (at[:-1] - cut[:-1])[of]] = (h >> shift).astype(np.int64)
    pcut = np.concatenate([[0], np.cumsum(n_pairs)])
    pof = np.repeat(np.arange(len(n_pairs)), n_pairs)
    out[np.arange(len(pair)) + (at[:-1] + np.diff(cut) - pcut[:-1])[pof]] = (pair >> shift).astype(np.int64)
    return out, at


def _word_buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words of letters and digits of each text, and where each text's begin."""
    low = bt.LOWER[data]
    starts, ends, cut = bt.words(low, offsets, bt.ALNUM)
    return (bt.word_hashes(low, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64), cut


def count_ngrams(docs: DataFrame, *, text: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target, raw) counts of every bucket over all documents, and the number
    of labelled documents of each kind, all of them and those with each word
    bucket. ``kind``: half of the labels plus 2 for toxic ones, null elsewhere.
    Each task sends one row a bucket, so the shuffle does not grow with the text."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((2, 1 << BUCKET_BITS), np.int64)
        word, n = np.zeros((4, 1 << WORD_BITS), np.int64), np.zeros(4, np.int64)
        for b in batches:
            data, offsets = bt.text_bytes(b.column(0))
            kinds = b.column(1).fill_null(-1).to_numpy(zero_copy_only=False)
            for lo, hi, d, o in bt.blocks(data, offsets):
                ids, at = _buckets(d, o)
                mine = kinds[lo:hi]
                count[1] += np.bincount(ids, minlength=1 << BUCKET_BITS)
                good = np.repeat((mine == 0) | (mine == 1), np.diff(at))
                count[0] += np.bincount(ids[good], minlength=1 << BUCKET_BITS)
                if (mine >= 0).any():
                    ids, cut = _word_buckets(d, o)
                    of = bt.text_of(cut)
                    some = mine[of] >= 0
                    once = np.unique(of[some].astype(np.int64) << WORD_BITS | ids[some])
                    of, ids = once >> WORD_BITS, once & ((1 << WORD_BITS) - 1)
                    for k in range(4):
                        word[k] += np.bincount(ids[mine[of] == k], minlength=1 << WORD_BITS)
                        n[k] += (mine == k).sum()
        for first, rows in ((0, count), (1 << BUCKET_BITS, np.column_stack([word, n]))):
            some = np.flatnonzero(rows.any(axis=0))
            cols = [pa.array(x[some]) for x in rows] + [pa.array(np.zeros(len(some), np.int64))] * (4 - len(rows))
            yield pa.RecordBatch.from_arrays([pa.array(some + first), *cols], ["bucket", "n0", "n1", "n2", "n3"])

    rows = docs.select(F.col(text).alias("text"), F.col(kind).alias("kind")) \
        .mapInArrow(partial, "bucket long, n0 long, n1 long, n2 long, n3 long")
    # one row a bucket reaches the driver, of the words those in toxic documents and the number of documents
    first, last = 1 << BUCKET_BITS, (1 << BUCKET_BITS) + (1 << WORD_BITS)
    got = rows.groupBy("bucket").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(4)]) \
        .where((F.col("bucket") < first) | (F.col("bucket") == last) | (F.col("n2") + F.col("n3") > 0)).toPandas()
    every = np.zeros((4, last + 1))
    every[:, got["bucket"]] = got[["n0", "n1", "n2", "n3"]].to_numpy().T
    return every[0, :first], every[1, :first], every[:, first:last], every[:, last]


def toxic_table(clean: np.ndarray, n_clean: float, toxic: np.ndarray, n_toxic: float) -> np.ndarray:
    """log(toxic share / clean share) of the word buckets that toxic documents hold
    more often, add-half smoothed; 0 where the evidence is too small."""
    if not n_clean or not n_toxic:
        return np.zeros(len(clean))
    share = (clean + toxic) / (n_clean + n_toxic)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))

    evidence = 2 * (part(toxic, n_toxic * share) + part(n_toxic - toxic, n_toxic * (1 - share))
                    + part(clean, n_clean * share) + part(n_clean - clean, n_clean * (1 - share)))
    weight = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    return np.where((evidence >= WORD_EVIDENCE) & (weight > 0), weight, 0.0)


def ratio_table(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """log(target share / raw share) of every bucket, add-one smoothed."""
    b = len(target)
    if not target.sum():
        return np.zeros(b)
    return np.log((target + 1) / (target.sum() + b)) - np.log((raw + 1) / (raw.sum() + b))


def _measure(column: pa.Array, table: np.ndarray, words: Sequence[np.ndarray]) -> list[np.ndarray]:
    data, offsets = bt.text_bytes(column)
    n = len(offsets) - 1
    out = [np.zeros(n, np.int64) for _ in range(5)] + [np.zeros(n) for _ in range(1 + len(words))]
    for lo, hi, d, o in bt.blocks(data, offsets):
        starts, ends, cut = bt.words(d, o, bt.NOT_BLANK)
        span = slice(lo, hi)
        out[0][span] = np.diff(cut)
        lead = np.concatenate([[0], np.cumsum(_LEAD[d])])
        out[1][span] = bt.sums(lead[ends] - lead[starts], cut)
        symbol = np.concatenate([[0], np.cumsum(_SYMBOL[d])])
        out[2][span] = symbol[o[1:]] - symbol[o[:-1]]
        raw = d.tobytes()
        for k in range(hi - lo):
            lines = [x for x in raw[o[k]:o[k + 1]].split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
            out[3][lo + k] = len(lines) - len(set(lines))
        # words inside a 3-word window that occurs at least twice in the same text
        of = bt.text_of(cut)
        three = bt.shingle_hashes(bt.word_hashes(d, starts, ends), 3)
        inside = of[:-2] == of[2:] if len(of) > 2 else np.zeros(0, bool)
        where = np.flatnonzero(inside)
        keys = bt.mix(three[where] ^ bt.mix(of[where].astype(np.uint64)))
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(where), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(len(starts) + 2, bool)
        at = where[twice]
        for k in range(3):
            hit[at + k] = True
        out[4][span] = bt.sums(hit[:len(starts)].astype(np.int64), cut)
        ids, at = _buckets(d, o)
        out[5][span] = np.round(bt.sums(table[ids], at) / np.maximum(np.diff(at), 1), 9)
        ids, cut = _word_buckets(d, o)
        for k, w in enumerate(words):
            out[6 + k][span] = np.round(bt.sums(w[ids], cut) / np.maximum(np.diff(cut), 1), 9)
    return out


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double, " \
          "toxicity double, toxicity_0 double, toxicity_1 double"


def measures(spark, table: np.ndarray, words: Sequence[np.ndarray], text: Column) -> Column:
    """Struct of the base figures, the score and the toxicities by ``words`` (all
    labels, each half of them) of a text column."""
    shared = spark.sparkContext.broadcast((table, words))  # 2**BUCKET_BITS + 3 * 2**WORD_BITS numbers

    @F.arrow_udf(f"struct<{_FIELDS.replace(' ', ':').replace(',:', ',')}>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = [x.split()[0] for x in _FIELDS.split(", ")]
        for col in batches:
            yield pa.StructArray.from_arrays([pa.array(x) for x in _measure(col, *shared.value)], names)

    return measure.asNondeterministic()(text)


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def _quantile(count: np.ndarray, q: float) -> int:
    """Index of the smallest grid point with at least a share ``q`` of the counts at or below it."""
    return int(np.searchsorted(np.cumsum(count), max(1, np.ceil(q * count.sum()))))


def threshold(scored: DataFrame, *, score: str, failed: str, trusted: str, distrusted: str,
              keep_quantile: float) -> float | None:
    """The cut between kept and rejected scores; None without trusted documents.

    Scores are counted on a grid of 0.0001 (a bounded number of rows reaches
    the driver), so the cut depends on the labelled documents alone, not on
    their partitions."""
    grid = (scored.where(~F.col(failed) & (F.col(trusted) | F.col(distrusted)))
            .groupBy(F.round(F.col(score) * 10000).cast("long").alias("at"))
            .agg(F.sum(F.col(trusted).cast("long")).alias("good"), F.sum(F.col(distrusted).cast("long")).alias("bad"))
            .orderBy("at").toPandas())
    if not len(grid) or not grid["good"].sum():
        return None
    at = grid["at"].to_numpy()
    good = at[_quantile(grid["good"].to_numpy(), keep_quantile)]
    if not grid["bad"].sum():
        return (good - 1) / 10000
    bad = at[_quantile(grid["bad"].to_numpy(), 1 - 10 * keep_quantile)]
    return (good + bad) / 20000 if bad < good else (good - 1) / 10000


def toxic_threshold(scored: DataFrame, *, score: str, trusted: str, toxic: str) -> float | None:
    """The cut with the fewest trusted documents above and toxic ones at or below
    it; None without toxic ones. Counted on a grid as in ``threshold``."""
    grid = (scored.where(F.col(trusted) | F.col(toxic))
            .groupBy(F.round(F.col(score) * 10000).cast("long").alias("at"))
            .agg(F.sum(F.col(trusted).cast("long")).alias("good"), F.sum(F.col(toxic).cast("long")).alias("bad"))
            .orderBy("at").toPandas())
    if not len(grid) or not grid["bad"].sum():
        return None
    at, good, bad = (grid[c].to_numpy() for c in ("at", "good", "bad"))
    wrong = good.sum() - np.cumsum(good) + np.cumsum(bad)  # cut just above each grid point
    k = len(at) - 1 - int(np.argmin(wrong[::-1]))  # of equal ones the highest, which keeps more
    return (at[k] + at[k + 1]) / 20000 if k + 1 < len(at) else (at[k] + 1) / 10000


def judge(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text",
          max_trusted: int = MAX_TRUSTED, keep_quantile: float = 0.001, name: str = "quality_of",
          columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or its ``columns``, with the key among them) plus a struct column
    ``name``: the base figures, score, toxicity, base_failed and kept.

    ``labels``: (doc_id, quality, toxic). The target is fitted on about
    ``max_trusted`` trusted documents at most and the words on as many toxic ones,
    chosen by a hash of the id, whose ids are broadcast; the raw counts cover all documents and the threshold all
    labels, by a join of ids and scores without the texts (the two toxicities of
    halves of the labels serve the cut alone). The measured rows
    are written to the shared folder once, for the threshold and the result."""
    spark = docs.sparkSession
    mark = stored(labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(
        F.min(F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))).alias("good"),
        F.max(F.coalesce(F.col("quality") == 0, F.lit(False))).alias("bad"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
        .withColumn("half", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int")), "labels")
    # what is bad anyway does not tell toxic words
    fits = {0: F.col("good"), 2: F.col("toxic") & ~F.col("bad")}
    n = mark.agg(*[F.count_if(c).alias(str(k)) for k, c in fits.items()]).first()
    share = {k: int(1_000_000 * min(1.0, max_trusted / max(1, n[str(k)]))) for k in fits}
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_000))
    chosen = [F.when(c & (place < share[k]), F.col("half") + k) for k, c in fits.items()]
    some = mark.select("id", F.coalesce(*chosen).alias("kind")).where("kind is not null")
    marked = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(some), "id", "left")
    target, raw, word, n_word = count_ngrams(marked, text="text", kind="kind")
    words = [toxic_table(word[g].sum(axis=0), n_word[g].sum(), word[t].sum(axis=0), n_word[t].sum())
             for g, t in (([0, 1], [2, 3]), ([0], [2]), ([1], [3]))]
    columns = columns or docs.columns
    scored = stored(docs.withColumn(name, measures(spark, ratio_table(target, raw), words, F.col(text)))
                    .select(*columns, name), "quality")
    failed = base_failed(F.col(name)["n_words"], F.col(name)["n_repeat_words"])
    flat = scored.select(F.col(key).alias("id"), F.col(name)["score"].alias("s"), failed.alias("f"),
                         F.col(name)["toxicity_0"].alias("t0"), F.col(name)["toxicity_1"].alias("t1")).join(mark, "id")
    cut = threshold(flat, score="s", failed="f", trusted="good", distrusted="bad", keep_quantile=keep_quantile)
    kept = ~failed if cut is None else ~failed & (F.col(name)["score"] >= cut)
    passed = flat.where(~F.col("f") if cut is None else ~F.col("f") & (F.col("s") >= cut))
    held_out = passed.withColumn("t", F.when(F.col("half") == 0, F.col("t1")).otherwise(F.col("t0")))
    top = None if cut is None else toxic_threshold(held_out, score="t", trusted="good", toxic="toxic")
    kept = kept if top is None else kept & (F.col(name)["toxicity"] <= top)
    return scored.select(*columns, F.struct(F.col(f"{name}.*"), failed.alias("base_failed"), kept.alias("kept"))
                         .dropFields("toxicity_0", "toxicity_1").alias(name))


def query(spark, sf_dir: str) -> DataFrame:
    """The texts are read twice (counts, then scores) and only figures are written."""
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    out = judge(docs, labels, columns=["doc_id"])
    return out.select("doc_id", *[f"quality_of.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score", "toxicity")])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that pass the base rules and the threshold."""
    name = free_name(docs, "quality_of")
    out = judge(docs, read(spark, sf_dir, "labels"), name=name)
    return out.where(F.col(name)["kept"]).select(*docs.columns)
