"""Similarity search over ``array<float>`` vectors.

N1 is exact cosine top-k without all pairs: vectors lie in the cells of their
nearest pivots, and the triangle inequality on the unit sphere tells which cells,
and which vectors in them, can be among a query's k nearest. Dot products are
``aggregate(zip_with(...))`` in the JVM; ``row_number() <= k`` lets Spark keep
only k rows per query in each partition before the shuffle. N2 is an upsert
keyed by a text hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bizlens.session import cut_lineage

#: Slack of the distance bounds, far above the rounding of a dot product.
EPSILON = 1e-9


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda acc, v: acc + v)


def _norm(a):
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def centroids(vectors: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """Mean vector per key (one aggregate over exploded coordinates)."""
    ex = vectors.select(F.col(key), F.posexplode(vec).alias("pos", "x"))
    g = ex.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return g.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))),
                                          lambda s: s["m"]).alias(vec))  # one dimension-sized array per key


def _unit(v, norm):
    return F.transform(v, lambda x: x.cast("double") / norm)


def _distance(similarity):
    """Distance on the unit sphere of two vectors with this cosine."""
    return F.sqrt(F.greatest(F.lit(0.0), 2.0 - 2.0 * similarity))


def _pivot_distances(unit, pivots: list[list[float]]):
    told = F.array(*[F.array(*[F.lit(x) for x in p]) for p in pivots])
    return F.transform(told, lambda p: _distance(_dot(p, unit)))


def _top(scored: DataFrame, query_id: str, store_id: str, k: int) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc_nulls_last("similarity"), F.asc(store_id))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


@dataclass
class PivotIndex:
    """Vectors in the cells of their nearest pivots, and the bounds of each cell."""
    vectors: DataFrame  # (id, _sv, _sn, cell, r, chunk): r is the distance to the cell's pivot
    cells: DataFrame    # (cell, n, chunks, lo, hi): smallest and largest distance to every pivot
    pivots: list[list[float]]


def pivot_index(store: DataFrame, *, store_id: str = "vec_id", vec: str = "embedding", pivots: int = 64,
                chunk_rows: int = 100_000) -> PivotIndex:
    """Index the vectors of ``store`` that have a direction (norm above 0).

    ``pivots`` of them, chosen by hash, reach the driver; every vector goes to the nearest
    one's cell. A cell with many vectors is cut into chunks, so none is a hot key."""
    s = store.select(F.col(store_id).alias("id"), F.col(vec).alias("_sv")).withColumn("_sn", _norm(F.col("_sv"))).where("_sn > 0")
    s = s.withColumn("unit", _unit(F.col("_sv"), F.col("_sn")))
    chosen = s.select("unit", F.xxhash64("id").alias("h")).orderBy("h").limit(pivots).collect()
    told = [list(r.unit) for r in chosen]
    if not told:
        return PivotIndex(s, s, [])
    s = s.withColumn("d", _pivot_distances(F.col("unit"), told)).withColumn("r", F.array_min("d"))
    s = cut_lineage(s.withColumn("cell", (F.array_position("d", F.col("r")) - 1).cast("int")).drop("unit"))
    bounds = [f(F.get("d", F.lit(j))) for j in range(len(told)) for f in (F.min, F.max)]
    cells = s.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[b.alias(f"b{j}") for j, b in enumerate(bounds)])
    chunks = F.ceil(F.col("n") / chunk_rows).cast("int")
    cells = cells.select("cell", "n", chunks.alias("chunks"), F.array(*[F.col(f"b{2 * j}") for j in range(len(told))]).alias("lo"),
                         F.array(*[F.col(f"b{2 * j + 1}") for j in range(len(told))]).alias("hi"))
    cells = cut_lineage(cells)  # at most one row a pivot
    sizes = F.broadcast(cells.select("cell", "chunks"))
    return PivotIndex(s.join(sizes, "cell").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).drop("d", "chunks"),
                      cells, told)


def _scored(index: PivotIndex, visits: DataFrame) -> DataFrame:
    """(query, id, similarity) of the vectors in the cells of ``visits`` (query, _qv, _qn, cell, chunks, qr, reach)
    that the triangle inequality leaves within ``reach`` of the query."""
    each = visits.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = index.vectors.join(each, ["cell", "chunk"]).where(F.abs(F.col("qr") - F.col("r")) <= F.col("reach") + EPSILON)
    return met.select("query", "id", F.try_divide(_dot(F.col("_sv"), F.col("_qv")), F.col("_sn") * F.col("_qn")).alias("similarity"))


def scored_pairs(index: PivotIndex, queries: DataFrame, *, k: int, query_id: str = "query_id", vec: str = "embedding") -> DataFrame:
    """(query, id, similarity): of every pair that can be among a query's ``k`` nearest, and a few more.

    First the nearest cells that hold ``k`` vectors together: their k-th similarity bounds the
    distance of all that can still enter. Then the cells within that distance by the triangle
    inequality at any pivot, and of those the vectors within it at their own pivot."""
    qs = queries.select(F.col(query_id).alias("query"), F.col(vec).alias("_qv")).withColumn("_qn", _norm(F.col("_qv"))).where("_qn > 0")
    qs = qs.withColumn("qd", _pivot_distances(_unit(F.col("_qv"), F.col("_qn")), index.pivots))
    apart = F.zip_with(F.zip_with("qd", "hi", lambda x, h: x - h), F.zip_with("lo", "qd", lambda lo, x: lo - x), lambda a, b: F.greatest(a, b))
    visits = qs.join(F.broadcast(index.cells))  # one row a query and cell: at most ``pivots`` cells
    visits = visits.select("query", "_qv", "_qn", "cell", "n", "chunks", F.greatest(F.lit(0.0), F.array_max(apart)).alias("least"),
                           F.get("qd", F.col("cell")).alias("qr"))
    nearest = Window.partitionBy("query").orderBy("least", "qr", "cell").rowsBetween(Window.unboundedPreceding, -1)
    visits = cut_lineage(visits.withColumn("before", F.coalesce(F.sum("n").over(nearest), F.lit(0))))
    first = _scored(index, visits.where(F.col("before") < k).withColumn("reach", F.lit(2.0)))
    first = cut_lineage(first)
    kth = _top(first, "query", "id", k).groupBy("query").agg(F.count(F.lit(1)).alias("found"), F.min("similarity").alias("worst"))
    reach = F.when(F.col("found") < k, 2.0).otherwise(_distance(F.col("worst")))
    rest = visits.where(F.col("before") >= k).join(kth.select("query", reach.alias("reach")), "query") \
        .where(F.col("least") <= F.col("reach") + EPSILON)
    return first.unionByName(_scored(index, rest))


def cosine_top_k(store: DataFrame, queries: DataFrame, *, k: int = 5, store_id: str = "vec_id",
                 query_id: str = "query_id", vec: str = "embedding", pivots: int = 64) -> DataFrame:
    """The k stored vectors most similar to each query (ties by id), exact.

    Vectors without a direction have no similarity: they come last, by id, and so does
    everything for a query without one."""
    index = pivot_index(store, store_id=store_id, vec=vec, pivots=pivots)
    none = F.lit(None).cast("double")
    names = F.col("query").alias(query_id), F.col("id").alias(store_id)
    lost = store.select(F.col(store_id).alias("id"), _norm(F.col(vec)).alias("n")).where("n = 0 OR n IS NULL").orderBy("id").limit(k)
    low = store.select(F.col(store_id).alias("id")).orderBy("id").limit(k)
    asked = queries.select(F.col(query_id).alias("query"), _norm(F.col(vec)).alias("n"))
    out = asked.where("n > 0").join(F.broadcast(lost)).select("query", "id", none.alias("similarity")) \
        .unionByName(asked.where("n = 0 OR n IS NULL").join(F.broadcast(low)).select("query", "id", none.alias("similarity")))  # k rows
    if index.pivots:
        out = out.unionByName(scored_pairs(index, queries, k=k, query_id=query_id, vec=vec))
    return _top(out.select(*names, "similarity"), query_id, store_id, k)


def upsert_by_text(existing: DataFrame, incoming: DataFrame, *, text: str = "text", order: str = "doc_id") -> DataFrame:
    """key = md5(text); an incoming row replaces a stored row with the same key,
    and inside one batch the highest ``order`` wins (``max_by``, one aggregate)."""
    tag = lambda df, b: df.withColumn("_batch", F.lit(b)).withColumn("key", F.md5(F.col(text)))
    both = tag(existing, 0).unionByName(tag(incoming, 1), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in ("key", "_batch")]
    win = F.max_by(F.struct(*cols), F.struct("_batch", order))
    return both.groupBy("key").agg(win.alias("r")).select("key", "r.*")
