"""Language-model scoring by prediction by partial matching (operator 10).

A text is its lower-cased words joined by single spaces and an end symbol.
Counts of all byte runs of ``ORDER + 1`` symbols over all training documents
are the leaves of the context trie; shorter contexts are sums of longer ones.
Escape estimation is method D (each different symbol seen in a context gives
half a count to the escape), with symbol exclusion: after
an escape the symbols of the longer context are left out. Below order 0 all
256 byte values not yet excluded are equally likely. The score is the log10
probability of the whole text under the pretrained trie.

The trie is sent to the tasks in shards keyed by the last two bytes of the
context, each of about ``MAX_ENTRIES`` leaves; all contexts that a position
escapes to (down to two bytes) share its shard, and the shorter ones have at
most 65,536 leaves and go along. Texts are scored against one shard after the
other and the parts are added, so memory is bounded and every leaf counts.

The base score is an add-half unigram model of the words. Words that make up
more than 1 / ``FREQUENT`` of all tokens (so fewer than ``FREQUENT`` words) are
looked up in the tasks, all others by a join.

Defined results: a null or blank text is the end token alone. Documents with a
null id are scored, never learned from, and not held out. No training
documents: base score 0, uniform bytes. Words of
equal frequency are treated alike. Repeated rows are scored (and learned from) row by row. An empty
table gives no row. Only the named columns are read.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm import bytetext as bt
from bizlens.llm.shared import read, stored

ORDER = 5
MAX_ENTRIES = 3_000_000
FREQUENT = 400_000
PIECE = 500_000
BLOCK = 1 << 20
END = 10  # a line feed is never inside a word


def _symbols(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, where, cut): the byte run that ends at each coded symbol, packed in
    an integer, and the first symbol of each text."""
    lead = bytes([END]) * ORDER
    parts = [lead + b" ".join(w) + bytes([END]) for w in texts]
    size = np.array([len(p) for p in parts])
    raw = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint64)
    run = np.zeros(max(0, len(raw) - ORDER), np.uint64)
    for k in range(ORDER + 1):
        run = (run << np.uint64(8)) | raw[k:k + len(run)]
    ends = np.cumsum(size)
    good = np.ones(len(run), bool)
    for k in range(ORDER):  # runs that would cross into the next text
        cross = ends[:-1] - ORDER + k
        good[cross] = False
    cut = np.concatenate([[0], np.cumsum(size - ORDER)])
    return run[good], np.flatnonzero(good), cut


def _blocks(column: pa.Array) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(first text, words of each text) in blocks of bounded size."""
    raw, lo, held, size = column.fill_null("").cast(pa.large_binary()), 0, [], 0
    for k in range(len(raw)):
        text = raw[k].as_py().lower()
        held.append(text.split())
        size += len(text)
        if size > BLOCK:
            yield lo, held
            lo, held, size = k + 1, [], 0
    if held:
        yield lo, held


def gather(docs: DataFrame, text: str) -> DataFrame:
    """(word, run, n) over all training texts: word counts and run counts, summed in each task first."""

    def merge(keys: list[np.ndarray], sizes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        k, c = np.concatenate(keys), np.concatenate(sizes)
        order = np.argsort(k, kind="stable")
        k, c = k[order], c[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        return k[first], np.add.reduceat(c, first)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        keys, sizes, held = [], [], 0

        def word_rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(words.keys()), pa.binary()).cast(pa.string()), pa.nulls(len(words), pa.int64()),
                 pa.array(list(words.values()), pa.int64())], ["word", "run", "n"])
            words.clear()
            return out

        def run_rows() -> pa.RecordBatch:
            k, c = merge(keys, sizes)
            return pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(c)],
                                              ["word", "run", "n"])

        for b in batches:
            for _, texts in _blocks(b.column(0)):
                for w in texts:
                    words.update(w)
                k, c = np.unique(_symbols(texts)[0], return_counts=True)
                keys.append(k)
                sizes.append(c)
                held += len(k)
                if held > 2_000_000:
                    k, c = merge(keys, sizes)
                    keys, sizes, held = [k], [c], len(k)
                    if held > 1_500_000:
                        yield run_rows()
                        keys, sizes, held = [], [], 0
                if len(words) > 500_000:
                    yield word_rows()
        if words:
            yield word_rows()
        if keys:
            yield run_rows()

    partial = docs.select(text).mapInArrow(count, "word string, run long, n long")
    return stored(partial.groupBy("word", "run").agg(F.sum("n").alias("n")), "counts")


class Trie:
    """Leaves of one shard: the runs of ``ORDER + 1`` bytes and their counts,
    with the bigram counts of the whole corpus."""

    def __init__(self, runs: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> None:
        order = np.argsort(runs, kind="stable")
        top = (runs[order].astype(np.uint64), counts[order].astype(np.int64))
        self.levels = {ORDER: top}
        for k in range(ORDER - 1, 1, -1):
            self.levels[k] = self._shorter(top, k)
        some = np.flatnonzero(pairs)
        self.levels[1] = (some.astype(np.uint64), pairs[some])
        single = pairs.reshape(256, 256).sum(0)
        self.levels[0] = (np.flatnonzero(single).astype(np.uint64), single[np.flatnonzero(single)])
        self.memo: dict[int, float] = {}
        self._hash(*top)

    @staticmethod
    def _shorter(top: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        key = top[0] & np.uint64((1 << 8 * (k + 1)) - 1)
        order = np.argsort(key, kind="stable")
        key, n = key[order], top[1][order]
        if not len(key):
            return key, n
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        return key[first], np.add.reduceat(n, first)

    def _hash(self, runs: np.ndarray, counts: np.ndarray) -> None:
        """Open addressing: the log10 probability of every leaf in its full context."""
        ctx = runs >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.zeros(0, int)
        kinds = np.diff(np.append(first, len(ctx)))
        total = np.add.reduceat(counts, first) if len(first) else counts
        logp = np.log10((2 * counts - 1) / np.repeat(2 * total, kinds))
        self.bits = max(10, int(2 * len(runs)).bit_length())
        self.keys, self.logp = np.full(1 << self.bits, ~np.uint64(0)), np.zeros(1 << self.bits)
        todo = np.arange(len(runs))
        at = (bt.mix(runs) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = self.keys[at[todo]] == ~np.uint64(0)
            self.keys[at[todo[free]]] = runs[todo[free]]
            mine = self.keys[at[todo]] == runs[todo]
            self.logp[at[todo[mine]]] = logp[todo[mine]]
            todo = todo[~mine]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    def score(self, runs: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each run after the others."""
        out, todo = np.empty(len(runs)), np.arange(len(runs))
        at = (bt.mix(runs) >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(todo):
            seen = self.keys[at]
            hit = seen == runs[todo]
            out[todo[hit]] = self.logp[at[hit]]
            new = seen == ~np.uint64(0)
            if new.any():
                keys, place = np.unique(runs[todo[new]], return_inverse=True)
                out[todo[new]] = np.array([self.escaped(int(k)) for k in keys])[place]
            more = ~(hit | new)
            todo, at = todo[more], (at[more] + 1) & ((1 << self.bits) - 1)
        return out

    def escaped(self, run: int) -> float:
        """A run that is no leaf: escape to shorter contexts with exclusion."""
        got = self.memo.get(run)
        if got is not None:
            return got
        symbol, p, out = run & 255, 0.0, set()
        for k in range(ORDER, -1, -1):
            keys, counts = self.levels[k]
            ctx = (run >> 8) & ((1 << 8 * k) - 1)
            lo, hi = np.searchsorted(keys, np.array([ctx << 8, (ctx << 8) + 256], np.uint64))
            seen = {int(s) & 255: int(c) for s, c in zip(keys[lo:hi], counts[lo:hi])}
            left = {s: c for s, c in seen.items() if s not in out}
            if not left:
                continue
            total = 2 * sum(left.values())
            if symbol in left:
                p += np.log10((2 * left[symbol] - 1) / total)
                break
            p += np.log10(len(left) / total)
            out |= left.keys()
        else:
            p += np.log10(1 / (256 - len(out)))
        if len(self.memo) > 1_000_000:
            self.memo.clear()
        self.memo[run] = float(p)
        return float(p)


_TRIES: dict[str, Trie] = {}


def _shard_of(run: Column, shards: int) -> Column:
    return F.pmod(F.shiftright(run, 8).bitwiseAND(F.lit(0xFFFF)), F.lit(shards))


def _measures(spark, text: Column, shared, shard: int, shards: int, frequent) -> Column:
    """Struct (n_tokens, n_known, known_log, ppm, rare) for one shard of the
    trie; the word figures come with the first shard only."""
    name = uuid.uuid4().hex

    @F.arrow_udf("struct<n_tokens:long,n_known:long,known_log:double,ppm:double,rare:array<struct<word:string,n:int>>>")
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if name not in _TRIES:
            _TRIES.clear()  # one trie a worker process
            _TRIES[name] = Trie(*shared.value)
        trie = _TRIES[name]
        log_of = frequent.value if shard == 0 else {}
        kind = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int32())]))
        for col in batches:
            tokens, known, klog, ppm = [np.zeros(len(col), t) for t in (np.int64, np.int64, float, float)]
            rare_word, rare_n, rare_cut = [], [], [0]
            for lo, texts in _blocks(col):
                runs, _, cut = _symbols(texts)
                if shards > 1:
                    mine = ((runs >> np.uint64(8)) & np.uint64(0xFFFF)) % np.uint64(shards) == np.uint64(shard)
                    value = np.zeros(len(runs))
                    value[mine] = trie.score(runs[mine])
                else:
                    value = trie.score(runs)
                ppm[lo:lo + len(texts)] = bt.sums(value, cut)
                if shard:
                    rare_cut += [len(rare_word)] * len(texts)
                    continue
                for k, w in enumerate(texts, lo):
                    tokens[k] = len(w) + 1
                    for word, n in Counter(w).items():
                        if (x := log_of.get(word)) is None:
                            rare_word.append(word)
                            rare_n.append(n)
                        else:
                            known[k] += n
                            klog[k] += n * x
                    rare_cut.append(len(rare_word))
            rare = pa.StructArray.from_arrays([pa.array(rare_word, pa.binary()).cast(pa.string()),
                                               pa.array(rare_n, pa.int32())], ["word", "n"])
            yield pa.StructArray.from_arrays(
                [pa.array(tokens), pa.array(known), pa.array(klog), pa.array(ppm),
                 pa.ListArray.from_arrays(pa.array(rare_cut, pa.int32()), rare).cast(kind)],
                ["n_tokens", "n_known", "known_log", "ppm", "rare"])

    return measure.asNondeterministic()(text)


def held_out(key: Column) -> Column:
    """Whether the crc32 of the id as text leaves 1 modulo 5; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", max_entries: int = MAX_ENTRIES,
          n_frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row a document."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    train = docs.where(F.col(key).isNotNull() & ~held_out(F.col(key)))
    counts = gather(train, text)
    words, runs = counts.where("word is not null").select("word", "n"), counts.where("run is not null").select("run", "n")
    n_train = train.count()
    row = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    total, distinct = row[1] + n_train, row[0] + (n_train > 0)
    # fewer than n_frequent words can have such a share of all tokens
    top = words.where(F.col("n") * n_frequent > total).toArrow()
    frequent = sc.broadcast({w.encode(): float(np.log10(c + 0.5)) for w, c in zip(
        top.column("word").to_pylist(), top.column("n").to_pylist())})
    del top

    entries = runs.count()
    shards = max(1, -(-entries // max_entries))
    pair = np.zeros(1 << 16, np.int64)
    got = runs.groupBy(F.col("run").bitwiseAND(F.lit(0xFFFF)).alias("p")).agg(F.sum("n").alias("n")).toPandas()
    pair[got["p"].to_numpy(np.int64)] = got["n"]

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("hash"))

    def part(shard: int) -> DataFrame:
        # about max_entries rows, fetched in pieces
        mine, leaf = runs.where(_shard_of(F.col("run"), shards) == shard), []
        pieces = -(-min(entries, max_entries) // PIECE) or 1
        for k in range(pieces):
            got = mine.where(F.pmod(F.xxhash64("run"), F.lit(pieces)) == k).toArrow()
            leaf.append([got.column(c).to_numpy() for c in ("run", "n")])
        shared = sc.broadcast((np.concatenate([x[0] for x in leaf]).view(np.uint64),
                               np.concatenate([x[1] for x in leaf]), pair))
        del leaf, got
        m = _measures(spark, F.col("text"), shared, shard, shards, frequent)
        return stored(rows.select("key", "hash", m.alias("m"))
                      .select("key", "hash", F.monotonically_increasing_id().alias("uid"), "m.*"), "scores")

    main = part(0)
    more = main.select("uid", F.explode("rare").alias("r")).select("uid", "r.word", F.col("r.n").alias("tf")) \
        .join(words, "word", "left")
    more = more.groupBy("uid").agg(F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_log"),
                                   F.sum(F.when(F.col("n").isNotNull(), F.col("tf"))).alias("rare_known"))
    out = main.drop("rare").withColumnRenamed("ppm", "score").join(more, "uid", "left")
    for shard in range(1, shards):  # rows of one id and text have the same part
        extra = part(shard).groupBy(F.col("key").alias("k"), F.col("hash").alias("h")).agg(F.max("ppm").alias("ppm"))
        out = out.join(extra, F.col("key").eqNullSafe(F.col("k")) & F.col("hash").eqNullSafe(F.col("h"))) \
            .withColumn("score", F.col("score") + F.col("ppm")).drop("k", "h", "ppm")
    spread = float(np.log10(total + 0.5 * (distinct + 1)))
    end_log = float(np.log10(n_train + 0.5))
    return out.select(
        F.col("key").alias(key), held_out(F.col("key")).alias("held_out"), "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + int(n_train > 0)).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("known_log") + F.coalesce("rare_log", F.lit(0.0)) + end_log - F.col("n_tokens") * spread).alias("base_score"),
        "score")


def query(spark, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
