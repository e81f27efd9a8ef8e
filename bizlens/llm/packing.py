"""Best-fit packing of token sequences by a grouping genetic algorithm (operator 5).

Documents are tokenised, closed with an end id and cut into pieces only where
they are longer than a sequence; a full piece is a sequence of its own. The
other pieces are packed: they are dealt by hash over shards of about
``shard_items`` pieces, each a bin-packing problem of bounded size, evolved on
several islands, which are rows of a Spark table and so run in different tasks.

An individual assigns pieces to sequences; the first of an island is best-fit
decreasing, the others best-fit in disturbed orders. Crossover injects whole
well-filled sequences of one parent into another, removes the sequences of
the other that hold duplicates, and best-fits the displaced pieces. Mutation
empties the worst sequences. After each epoch the best individual of an island
migrates to the next island of its shard. A shard that reaches its lower bound
(total length / capacity) is optimal and leaves the search. Then the emptiest
sequences of every shard are pooled and packed as a smaller problem, until one
shard is left, so waste does not grow with the number of shards.

Defined results: a null text counts as empty, and an empty text is one piece
holding the end id. Repeated rows and ids are packed row by row. Ties are
broken by row number. An empty table gives no row. Only the named columns are
read.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.llm.shared import read, stored

CAPACITY = 4096
#: A shard holds at least so many full sequences, so that the pooled twentieth is a part of it.
SHARD_SEQUENCES = 20
END_ID = 1
CACHE_WORDS = 250_000

# Characters whose normal form is known without the library: printable ASCII
# but the apostrophe, and the letters of Latin-1.
_PLAIN = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+")
_WORD = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_PIECES = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


class Kept(dict):
    """What ``make`` gives for a key, kept in two generations: a young one that grows beyond
    ``CACHE_WORDS`` becomes the old one, from which only what is asked for again comes back."""

    def __init__(self, make) -> None:
        self.make, self.old = make, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got

    def turn(self) -> None:
        if len(self) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()


class WordIds:
    """Token ids (little-endian uint32 bytes) of blank-separated chunks.

    The tokenizer drops white space and never joins across it, so a chunk has
    the same ids wherever it stands. Chunks of plain characters are split here
    and go straight to the library's BPE model; all others through the whole
    tokenizer. Chunks and parts are kept in two generations each."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers
        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        visible = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # the byte-level form of a text is that of its characters, one after the other
        self.visible = {c: visible.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.chunks, self.parts = Kept(self._chunk), Kept(self._part)

    def _part(self, text: str) -> bytes:
        shown = text if text.isascii() else text.translate(self.visible)
        found = [t.id for t in self.model.tokenize(shown)]
        return struct.pack(f"<{len(found)}I", *found)

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if _WORD.fullmatch(text):
            return self.parts[text.lower()]
        if _PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.parts.__getitem__, _PIECES.findall(text.lower())))
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: bytes) -> bytes:
        self.chunks.turn()
        self.parts.turn()
        return b"".join(map(self.chunks.__getitem__, text.split()))


_LOADED: dict[str, WordIds] = {}


def _word_ids(path: str) -> WordIds:
    """One tokenizer a worker process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def pieces(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
           with_ids: bool = False) -> DataFrame:
    """(uid, doc_id, piece, start, length, ids_crc32[, ids]) of every document, in the shared folder."""
    end = np.array([END_ID], "<u4").tobytes()
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(tokenizer)
        for b in batches:
            raw = b.column(1).fill_null("").cast(pa.large_binary())
            row, piece, start, length, crc, ids = [], [], [], [], [], []
            for k in range(len(raw)):
                all_ids = words.ids(raw[k].as_py()) + end
                for p, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    part = all_ids[at:at + 4 * capacity]
                    row.append(k)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4"))
            cols = [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = [key, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int64())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    out = docs.select(F.col(key), F.col(text)).mapInArrow(
        cut, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids)
    return stored(out.withColumn("uid", F.monotonically_increasing_id()), "pieces")


class Sequences:
    """Open sequences with a sorted list of (free room, number) for best fit."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.items, self.free, self.room = capacity, [], [], []

    def open(self, items: list[int], used: int) -> None:
        self.items.append(items)
        self.free.append(self.capacity - used)
        insort(self.room, (self.capacity - used, len(self.items) - 1))

    def put(self, item: int, size: int) -> None:
        """Into the fullest sequence that has room, else into a new one."""
        at = bisect_left(self.room, (size, -1))
        if at == len(self.room):
            self.open([item], size)
            return
        free, n = self.room.pop(at)
        self.items[n].append(item)
        self.free[n] = free - size
        insort(self.room, (free - size, n))

    def value(self) -> tuple[int, float]:
        """(sequences, minus their mean squared fill): smaller is better."""
        fill = (self.capacity - np.array(self.free, float)) / self.capacity
        return len(self.items), -float((fill ** 2).mean())


def best_fit(size: np.ndarray, order: np.ndarray, capacity: int) -> Sequences:
    out = Sequences(capacity)
    for k in order.tolist():
        out.put(k, int(size[k]))
    return out


def crossover(a: Sequences, b: Sequences, size: np.ndarray, rng: np.random.Generator) -> Sequences:
    """Whole well-filled sequences of ``a`` injected into ``b``."""
    free = np.array(a.free)
    good = np.argsort(free, kind="stable")[:max(1, len(free) // 2)]
    picked = good[rng.random(len(good)) < 0.5]
    out, taken = Sequences(a.capacity), set()
    for n in picked.tolist():
        out.open(list(a.items[n]), a.capacity - a.free[n])
        taken.update(a.items[n])
    loose = []
    for n, items in enumerate(b.items):
        if taken.isdisjoint(items):
            out.open(list(items), b.capacity - b.free[n])
        else:
            loose += [k for k in items if k not in taken]
    for k in sorted(loose, key=lambda k: (-size[k], k)):
        out.put(k, int(size[k]))
    return out


def mutate(a: Sequences, size: np.ndarray, rng: np.random.Generator) -> Sequences:
    """Empty the worst sequences and a few random ones, and best-fit their items."""
    n = len(a.items)
    drop = set(np.argsort(-np.array(a.free), kind="stable")[:max(1, n // 50)].tolist())
    drop.update(rng.integers(0, n, max(1, n // 50)).tolist())
    out, loose = Sequences(a.capacity), []
    for k, items in enumerate(a.items):
        if k in drop:
            loose += items
        else:
            out.open(list(items), a.capacity - a.free[k])
    for k in sorted(loose, key=lambda k: (-size[k], k)):
        out.put(k, int(size[k]))
    return out


def _decoded(of: np.ndarray, size: np.ndarray, capacity: int) -> Sequences:
    out = Sequences(capacity)
    order = np.argsort(of, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(of[order])) + 1) if len(of) else []:
        out.open(group.tolist(), int(size[group].sum()))
    return out


def _encoded(a: Sequences, n: int) -> np.ndarray:
    of = np.empty(n, np.int32)
    for k, items in enumerate(a.items):
        of[items] = k
    return of


def evolve(size: np.ndarray, population: list[np.ndarray], *, capacity: int, seed: int, generations: int,
           members: int) -> tuple[list[np.ndarray], int, float, bool]:
    """One epoch of one island: (population, best first; its sequences; its value; whether optimal)."""
    rng = np.random.default_rng(seed)
    bound = -(-int(size.sum()) // capacity)
    down = np.argsort(-size, kind="stable")
    pop = [_decoded(of, size, capacity) for of in population]
    if not pop:
        pop = [best_fit(size, down, capacity)]
        while len(pop) < members and pop[0].value()[0] > bound:
            pop.append(best_fit(size, np.argsort(-size * rng.uniform(0.8, 1.2, len(size)), kind="stable"), capacity))
    pop.sort(key=Sequences.value)
    for _ in range(generations):
        if pop[0].value()[0] <= bound or len(pop) < 2:
            break
        a, b = (pop[int(min(rng.integers(0, len(pop), 2)))] for _ in range(2))
        child = mutate(a, size, rng) if a is b else crossover(a, b, size, rng)
        if child.value() < pop[-1].value():
            pop[-1] = child
            pop.sort(key=Sequences.value)
    n, value = pop[0].value()
    return [_encoded(p, len(size)) for p in pop[:members]], n, value, n <= bound


_ISLAND = ("shard long, island int, uids array<long>, sizes array<int>, population array<array<int>>, "
           "sequences int, value double, done boolean")


def _epoch(islands: DataFrame, epoch: int, *, capacity: int, generations: int, members: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                shard, island, uids, sizes, population = (b.column(c)[k].as_py() for c in range(5))
                pop, n, value, done = evolve(
                    np.array(sizes, np.int64), [np.array(p, np.int32) for p in population or []], capacity=capacity,
                    seed=(shard * 64 + island) * 64 + epoch, generations=generations, members=members)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard]), pa.array([island], pa.int32()), pa.array([uids], pa.list_(pa.int64())),
                     pa.array([sizes], pa.list_(pa.int32())),
                     pa.array([[p.tolist() for p in pop]], pa.list_(pa.list_(pa.int32()))),
                     pa.array([n], pa.int32()), pa.array([value]), pa.array([done])],
                    [x.split()[0] for x in _ISLAND.split(", ")])

    n = int(islands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = islands.select("shard", "island", "uids", "sizes", "population").repartition(n, "shard", "island")
    return stored(dealt.mapInArrow(run, _ISLAND), "islands")


def _migrated(islands: DataFrame, count: int) -> DataFrame:
    """Each island of an unsolved shard also gets the best individual of its left neighbour."""
    elite = islands.select("shard", ((F.col("island") + 1) % count).alias("island"),
                           F.col("population")[0].alias("migrant"))
    return (islands.join(elite, ["shard", "island"]).withColumn(
        "population", F.concat(F.slice("population", 1, F.greatest(F.lit(1), F.size("population") - 1)),
                               F.array("migrant"))).drop("migrant"))


def _solve(items: DataFrame, shards: int, level: int, *, capacity: int, islands: int, epochs: int, generations: int,
           members: int) -> DataFrame:
    """(uid, length, level, shard, sequence, position, fill) of one level of ``shards`` shards."""
    state = (items.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(shards)).alias("shard"))
             # about shard_items entries, or SHARD_SEQUENCES full sequences: the shard is a hash of the row number
             .agg(F.sort_array(F.collect_list(F.struct("length", "uid"))).alias("i"))
             .select("shard", F.col("i.uid").alias("uids"), F.col("i.length").cast("array<int>").alias("sizes"),
                     F.lit(None).cast("array<array<int>>").alias("population"),
                     F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island")))
    solved = None
    for epoch in range(epochs):
        state = _epoch(state, epoch, capacity=capacity, generations=generations, members=members)
        open_shards = state.groupBy("shard").agg(F.max("done").alias("d")).where("not d").select("shard")
        last = epoch == epochs - 1
        over = state if last else state.join(open_shards, "shard", "left_anti")
        solved = over if solved is None else solved.unionByName(over)
        if last:
            break
        state = state.join(open_shards, "shard", "left_semi")
        if state.isEmpty():
            break
        state = _migrated(state, islands)
    rank = Window.partitionBy("shard").orderBy("sequences", "value", "island")  # one row an island
    best = solved.withColumn("r", F.row_number().over(rank)).where("r = 1")
    placed = best.select("shard", F.explode(F.arrays_zip("uids", "sizes", F.col("population")[0].alias("of"))).alias("x"))
    placed = placed.select("shard", F.col("x.uids").alias("uid"), F.col("x.sizes").cast("long").alias("length"),
                           F.col("x.of").alias("sequence"))
    inside = Window.partitionBy("shard", "sequence")  # at most ``capacity`` pieces
    return placed.select(
        "uid", "length", F.lit(level).alias("level"), "shard", "sequence",
        (F.sum("length").over(inside.orderBy("uid")) - F.col("length")).alias("position"),
        F.sum("length").over(inside).alias("fill"))


def assign(items: DataFrame, *, capacity: int = CAPACITY, shard_items: int = 4096, islands: int = 2, epochs: int = 3,
           generations: int = 30, members: int = 6, pool_percent: int = 5) -> DataFrame:
    """(uid, sequence_id, offset) of the items (uid, length), all shorter than the capacity.

    A level has as many shards as its items, or its tokens if these ask for fewer, fill. The
    emptiest sequences of each shard are pooled for the next level, as long as that pools fewer
    items than the level had; a level of one shard is the last."""
    def measure(df: DataFrame) -> tuple[int, int]:
        row = df.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
        return row[0], max(1, min(-(-row[0] // shard_items), -(-row[1] // (capacity * SHARD_SEQUENCES))))

    level, parts, todo = 0, [], items
    n, shards = measure(todo)
    while n:
        got = stored(_solve(todo, shards, level, capacity=capacity, islands=islands, epochs=epochs,
                            generations=generations, members=members), f"packed-{level}")
        if shards == 1:
            parts.append(got)
            break
        worst = Window.partitionBy("shard").orderBy("fill", "sequence")
        each = got.select("shard", "sequence", "fill").distinct()
        size = each.groupBy("shard").agg(F.count(F.lit(1)).alias("of"))
        loose = (each.withColumn("r", F.row_number().over(worst)).join(size, "shard")
                 .where(F.col("r") <= F.greatest(F.lit(1), F.col("of") * pool_percent / 100)).select("shard", "sequence"))
        todo = stored(got.join(loose, ["shard", "sequence"], "left_semi").select("uid", "length"), "loose")
        before, (n, shards), level = n, measure(todo), level + 1
        if n == before:  # nothing would be settled by pooling it again
            parts.append(got)
            break
        parts.append(got.join(loose, ["shard", "sequence"], "left_anti").select(*got.columns))
    if not parts:
        return items.select("uid", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    number = F.shiftleft(F.col("level").cast("long"), 56) + F.shiftleft(F.col("shard").cast("long"), 20) \
        + F.col("sequence").cast("long")
    return out.select("uid", number.alias("sequence_id"), F.col("position").alias("offset"))


def pack(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
         with_ids: bool = False, **search) -> DataFrame:
    """One row a piece: (doc_id, piece, start, length, ids_crc32, sequence_id, offset[, ids])."""
    all_pieces = pieces(docs, tokenizer, key=key, text=text, capacity=capacity, with_ids=with_ids)
    placed = assign(all_pieces.where(F.col("length") < capacity).select("uid", "length"), capacity=capacity, **search)
    out = all_pieces.join(placed, "uid", "left")
    return out.select(F.col(key), "piece", "start", "length", "ids_crc32",
                      F.coalesce("sequence_id", -1 - F.col("uid")).alias("sequence_id"),
                      F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), *(["ids"] if with_ids else []))


def default_tokenizer() -> str:
    import public_tokenizers
    return str(public_tokenizers.path("word_bpe_49k.json"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), default_tokenizer())


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, default_tokenizer())
