"""Language identification (operator 2).

Model: every text is the average of the embeddings of its hashed byte n-grams
(2 to 4 bytes inside a word, word boundaries included), followed by a linear
softmax. Embeddings and softmax are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows (about ``docs_per_lang``
documents a language, and about ``segments_per_lang`` segments of their texts).
A part of the sampled documents is held back to calibrate: a temperature is
fitted to their likelihood, and the rejection threshold is the ``reject_rate``
quantile of their calibrated top probability, at most ``reject_cap``.

Because the softmax is linear in the average, the trained model folds into one
score per (n-gram bucket, language): prediction is a table lookup for every
byte of every whole text.

Defined results: null text, or text without a letter: ``und``, score 0,
rejected. Nothing to learn from (no labelled row): ``und`` for every text.
Ties go to the alphabetically first language. Repeated rows get equal
answers. Extra columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bizlens.llm import bytetext as bt
from bizlens.llm.shared import free_name, read, stored

UNDETERMINED = "und"
BUCKET_BITS = 16
DIM = 16
ORDERS = (2, 3, 4)

# A-Z become a-z; every other ASCII byte that is not a letter is a boundary.
_LETTERS = bt.LOWER.copy()
_LETTERS[:65] = _LETTERS[91:97] = _LETTERS[123:128] = 32


def _padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes with a boundary before and after each text, and the texts' places there."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    at = offsets[:-1] + np.arange(n) + 1
    folded = _LETTERS[data]
    for k in range(n):
        out[at[k]:at[k] + offsets[k + 1] - offsets[k]] = folded[offsets[k]:offsets[k + 1]]
    return out, at


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram length: (buckets, cut) of the texts' n-grams."""
    text, at = _padded(data, offsets)
    inside = text != 32
    wide = text.astype(np.uint32)
    # A text owns the grams that start at the boundary before it or inside it.
    edges = np.append(at - 1, len(text) - 1)
    for n in ORDERS:
        m = max(0, len(text) - n + 1)
        key, good = np.full(m, n, np.uint32), np.ones(m, bool)
        for k in range(n):
            key = key * np.uint32(0x01000193) ^ wide[k:k + m]
            if 0 < k < n - 1:
                good &= inside[k:k + m]
        if n == 2:
            good = inside[:m] | inside[1:1 + m]
        key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - BUCKET_BITS)
        where = np.flatnonzero(good)
        yield key[where], np.searchsorted(where, edges)


def _joined(segments: list[str]) -> list[np.ndarray]:
    """All n-gram buckets of each segment."""
    data, offsets = bt.text_bytes(pa.array(segments, pa.large_string()))
    parts: list[list[np.ndarray]] = [[] for _ in segments]
    for lo, hi, d, o in bt.blocks(data, offsets):
        for buckets, cut in grams(d, o):
            for k in range(hi - lo):
                parts[lo + k].append(buckets[cut[k]:cut[k + 1]].astype(np.int64))
    return [np.concatenate(p) if p else np.zeros(0, np.int64) for p in parts]


def train(texts: list[str], labels: list[str], *, epochs: int = 3, batch: int = 32, rate: float = 0.5,
          seed: int = 7) -> tuple[list[str], np.ndarray]:
    """(languages, table): the folded score of every (bucket, language)."""
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    feats = _joined(texts)
    keep = np.array([k for k, f in enumerate(feats) if len(f)], np.int64)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BUCKET_BITS, DIM)).astype(np.float32)
    soft = np.zeros((DIM, len(langs)), np.float32)
    steps, done = max(1, epochs * -(-len(keep) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(keep)
        for lo in range(0, len(order), batch):
            rows = order[lo:lo + batch]
            ids = np.concatenate([feats[r] for r in rows])
            size = np.array([len(feats[r]) for r in rows])
            first = np.concatenate([[0], np.cumsum(size)[:-1]])
            mean = np.add.reduceat(emb[ids], first, axis=0) / size[:, None]
            logit = mean @ soft
            prob = np.exp(logit - logit.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            prob[np.arange(len(rows)), y[rows]] -= 1
            step = rate * (1 - done / steps)
            back = (prob @ soft.T) / size[:, None]
            soft -= step * (mean.T @ prob)
            uniq, place = np.unique(ids, return_inverse=True)
            owner = np.repeat(np.arange(len(rows)), size)
            count = np.zeros((len(uniq), len(rows)), np.float32)
            np.add.at(count, (place, owner), 1)
            emb[uniq] -= step * (count @ back)
            done += 1
    return langs, (emb @ soft).astype(np.float32)


def logits(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean folded score of every whole text, one column per language (0 where a text has no n-gram)."""
    data, offsets = bt.text_bytes(column)
    out = np.zeros((len(offsets) - 1, table.shape[1]))
    columns = [np.ascontiguousarray(table[:, k]) for k in range(table.shape[1])]
    for lo, hi, d, o in bt.blocks(data, offsets):
        total, n = np.zeros((hi - lo, table.shape[1])), np.zeros(hi - lo)
        for buckets, cut in grams(d, o):
            n += np.diff(cut)
            for k, col in enumerate(columns):
                total[:, k] += bt.sums(col[buckets].astype(np.float64), cut)
        out[lo:hi] = total / np.maximum(n, 1)[:, None]
    return out


def softmax(z: np.ndarray, temperature: float) -> np.ndarray:
    z = z / temperature
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def calibrate(z: np.ndarray, y: np.ndarray, reject_rate: float, reject_cap: float) -> tuple[float, float]:
    """(temperature, threshold) from held-back segments."""
    if not len(y):
        return 1.0, 0.0
    scale = np.geomspace(0.02, 5, 60)
    loss = [-np.log(np.maximum(softmax(z, t)[np.arange(len(y)), y], 1e-12)).mean() for t in scale]
    t = float(scale[int(np.argmin(loss))])
    top = softmax(z, t).max(1)
    return t, float(min(reject_cap, np.quantile(top, reject_rate)))


def sample(docs: DataFrame, *, text: str, lang: str, key: str, docs_per_lang: int, segments_per_lang: int,
           segment_chars: int) -> DataFrame:
    """(lang, text, held): segments of a bounded hash sample of the labelled documents.

    A document or segment is taken if the hash of its key is below the share
    that is wanted of its language, so no language is ranked in one task."""
    def share(r: Column, wanted: int) -> Column:
        return F.pmod(r, F.lit(1 << 30)) * F.col("of") < float(wanted) * (1 << 30)

    rows = docs.select(F.col(lang).alias("lang"), F.col(key).alias("key"), F.col(text).alias("text")) \
        .where("lang is not null and text is not null")
    count = F.broadcast(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of")))  # one row a language
    # rows of one id and language meet as partial results, so a repeated id is one document
    picked = stored(rows.join(count, "lang").where(share(F.xxhash64(F.lit(1), "key"), docs_per_lang))
                    .groupBy("lang", "key").agg(F.min("text").alias("text")), "labelled")
    count = F.broadcast(picked.groupBy("lang").agg(F.sum(F.ceil(F.length("text") / segment_chars)).alias("of")))
    cut = picked.select("lang", "key", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length("text") - 1).cast("int")), F.lit(segment_chars)),
        lambda p: F.substr("text", p + 1, F.lit(segment_chars)))).alias("seg", "text"))
    return (cut.join(count, "lang").where(share(F.xxhash64(F.lit(2), "key", "seg"), segments_per_lang))
            .where(F.col("text").rlike(r"\p{L}"))
            .select("lang", "text", (F.pmod(F.xxhash64(F.lit(3), "key"), F.lit(5)) == 0).alias("held")))


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id",
        docs_per_lang: int = 2000, segments_per_lang: int = 2500, segment_chars: int = 300,
        reject_rate: float = 0.001, reject_cap: float = 0.4) -> dict:
    """Train on the labelled rows of ``docs``; the driver receives about
    ``segments_per_lang`` segments of ``segment_chars`` characters a language."""
    got = sample(docs, text=text, lang=lang, key=key, docs_per_lang=docs_per_lang,
                 segments_per_lang=segments_per_lang, segment_chars=segment_chars).toPandas()
    got = got.sort_values(["lang", "text"], kind="stable")
    if not len(got):
        return {"langs": [], "table": np.zeros((1 << BUCKET_BITS, 0), np.float32), "temperature": 1.0,
                "threshold": 0.0}
    # a language without a segment to learn from is held back nowhere
    held = (got["held"] & ~got.groupby("lang")["held"].transform("all")).to_numpy(bool)
    langs, table = train(got["text"][~held].tolist(), got["lang"][~held].tolist())
    back = got[held & got["lang"].isin(langs).to_numpy()]
    z = logits(pa.array(back["text"].tolist(), pa.large_string()), table)
    t, threshold = calibrate(z, np.array([langs.index(x) for x in back["lang"]], int), reject_rate, reject_cap)
    return {"langs": langs, "table": table, "temperature": t, "threshold": threshold}


def predict(spark, model: dict, text: Column) -> Column:
    """Struct (lang_pred, score, rejected) of a text column."""
    shared = spark.sparkContext.broadcast(model)  # 2**BUCKET_BITS floats a language, whatever the corpus

    @F.arrow_udf("struct<lang_pred string, score double, rejected boolean>")
    def verdict(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = shared.value
        for col, letter in batches:
            known = letter.fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
            if not m["langs"]:
                known[:] = False
                p = np.zeros((len(col), 1))
            else:
                p = softmax(logits(col, m["table"]), m["temperature"])
            best = p.argmax(1) if len(p) else np.zeros(0, int)
            score = np.where(known, p.max(1) if len(p) else 0.0, 0.0)
            names = np.array([*m["langs"], UNDETERMINED], object)[np.where(known, best, -1)]
            yield pa.StructArray.from_arrays(
                [pa.array(names, pa.string()), pa.array(score, pa.float64()),
                 pa.array(~known | (score < m["threshold"]), pa.bool_())], ["lang_pred", "score", "rejected"])

    return verdict.asNondeterministic()(text, F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))


def held_out(key: Column) -> Column:
    """Whether the crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, model: dict, *, text: str = "text", name: str = "lang_id") -> DataFrame:
    """``docs`` with the struct column ``name``."""
    return docs.withColumn(name, predict(docs.sparkSession, model, F.col(text)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_id.lang_pred", "lang_id.score",
                      "lang_id.rejected")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are not rejected."""
    model = fit(docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))))
    name = free_name(docs, "lang_id")
    out = identify(docs, model, name=name)
    return out.where(~F.col(name)["rejected"]).select(*docs.columns)
