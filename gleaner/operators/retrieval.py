"""Dense retrieval, quality re-ranking and ranking metrics.

How similarity and quality are blended, and how quality is normalised, are
stated assumptions; both stay parameters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probability import topk_mean

# Query vectors shipped to every task at a time.
QUERY_BYTES = 64 << 20
# Above this many candidate rows from all tasks, a bound is computed first.
CANDIDATE_ROWS = 1_000_000_000
PRESCAN_SHARE = 0.001
_TIE_DIGITS = 12  # similarities equal to this many digits are ties
_QUERY_ROWS = 256  # queries multiplied with one batch of documents at a time


def _best_per_query(shared, k: int, doc_id: str, vector: str):
    """Arrow function: best ``k`` of one task's documents for every query."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        names, matrix, floor = shared.value
        floor = floor.copy()
        q, d, s = (np.empty(0, np.int64), None, np.empty(0))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            column = batch.column(batch.schema.get_field_index(vector))
            docs = np.asarray(column.flatten(), dtype=np.float64).reshape(batch.num_rows, -1)
            ids = batch.column(batch.schema.get_field_index(doc_id)).to_numpy(zero_copy_only=False)
            if d is None:
                d = ids[:0]
            parts = [(q, d, s)]
            for start in range(0, len(matrix), _QUERY_ROWS):
                block = np.round(matrix[start : start + _QUERY_ROWS] @ docs.T, _TIE_DIGITS)
                bound = floor[start : start + _QUERY_ROWS]
                if block.shape[1] > k:
                    bound = np.maximum(bound, -np.partition(-block, k - 1, axis=1)[:, k - 1])
                rows, cols = np.nonzero(block >= bound[:, None])
                parts.append((rows + start, ids[cols], block[rows, cols]))
            q, d, s = (np.concatenate(column) for column in zip(*parts))
            # Keep the best k per query (smaller id first among ties).
            order = np.lexsort((d.astype(str) if d.dtype == object else d, -s, q))
            q, d, s = q[order], d[order], s[order]
            place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
            q, d, s = q[place < k], d[place < k], s[place < k]
            last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q, side="left") == k - 1)
            floor[q[last]] = np.maximum(floor[q[last]], s[last])
        if len(q):
            for start in range(0, len(q), 50_000):
                part = slice(start, start + 50_000)
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(q[part])), pa.array(d[part]), pa.array(s[part])],
                    names=["query_id", "doc_id", "sim"],
                )

    return run


def _unit(vector):
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.transform(wide, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0)))


def _search(
    queries: DataFrame, corpus: DataFrame, k: int, query_id: str, doc_id: str, vector: str, prescan: float | None
) -> DataFrame:
    import numpy as np

    spark = corpus.sparkSession
    held = queries.select(query_id, F.col(vector).cast("array<double>").alias(vector)).toArrow()
    names = held.column(0).combine_chunks()
    vectors = held.column(1).combine_chunks()
    flat = np.asarray(vectors.flatten(), dtype=np.float64)
    matrix = flat.reshape(len(names), -1) if len(names) else np.empty((0, 1))
    kinds = dict(queries.dtypes), dict(corpus.dtypes)
    schema = f"query_id {kinds[0][query_id]}, doc_id {kinds[1][doc_id]}, sim DOUBLE"
    docs = corpus.select(doc_id, F.col(vector).cast("array<double>").alias(vector)).where(F.col(vector).isNotNull())

    def candidates(rows, floor):
        shared = spark.sparkContext.broadcast((names, matrix, floor))
        found = rows.mapInArrow(_best_per_query(shared, k, doc_id, vector), schema)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "doc_id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    if prescan is None:
        prescan = PRESCAN_SHARE if len(corpus.inputFiles()) * len(names) * k > CANDIDATE_ROWS else 0.0
    floor = np.full(len(names), -np.inf)
    if prescan > 0:
        seen = candidates(docs.sample(fraction=prescan, seed=0), floor).where(F.col("rank") == k)
        known = {r["query_id"]: r["sim"] for r in seen.collect()}
        floor = np.array([known.get(n, -np.inf) for n in names.to_pylist()])
    return candidates(docs, floor)


def dense_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 50,
    query_id: str = "query_id",
    doc_id: str = "doc_id",
    vector: str = "embedding",
    prescan: float | None = None,
    query_bytes: int = QUERY_BYTES,
    metric: str = "dot",
) -> DataFrame:
    """query_id, doc_id, sim and rank of the ``k`` most similar documents.

    ``metric`` is ``dot`` or ``cosine`` (a zero vector is similar to nothing: 0).
    Rows without a vector are left out on both sides; vectors of different
    lengths are an error that names the lengths.

    Exact. The corpus stays where it is: each task multiplies its vectors with
    a block of query vectors and keeps ``k`` per query, so only those are
    shuffled. Queries are measured first; as many blocks are formed as keep
    each within ``query_bytes``, one corpus pass per block. With very many
    corpus files (or ``prescan`` > 0) that share of the corpus is ranked first;
    its k-th similarity is a lower bound that lets the tasks of the full pass
    emit far fewer candidates.
    """
    if metric not in ("dot", "cosine"):
        raise ValueError(f"metric must be 'dot' or 'cosine', not {metric!r}")
    queries, corpus = (rows.where(F.col(vector).isNotNull()) for rows in (queries, corpus))
    sizes = queries.select(F.size(vector).alias("n")).union(corpus.select(F.size(vector).alias("n"))).distinct().limit(2).collect()
    if len(sizes) > 1:
        raise ValueError(f"vectors of lengths {sorted(r['n'] for r in sizes)}")
    if metric == "cosine":
        queries, corpus = (rows.withColumn(vector, _unit(F.col(vector))) for rows in (queries, corpus))
    measured = queries.agg(
        F.coalesce(F.sum(F.size(vector).cast("long") * 8 + 64), F.lit(0)).alias("bytes")
    ).first()["bytes"]
    blocks = max(1, -(-measured // query_bytes))
    if blocks == 1:
        return _search(queries, corpus, k, query_id, doc_id, vector, prescan)
    part = F.pmod(F.xxhash64(query_id), F.lit(2 * blocks))
    found = [
        _search(queries.where(part == b), corpus, k, query_id, doc_id, vector, prescan) for b in range(2 * blocks)
    ]
    return reduce(DataFrame.unionByName, found)


def normalise_quality(run: DataFrame, mode: str = "minmax", by: tuple[str, ...] = ("query_id",), k: int = 3) -> DataFrame:
    """Quality scaled within each query's retrieved documents.

    ``minmax`` (assumed meaning of the ``top_k`` setting): to 0..1 over the
    retrieved documents, 0 where all are equal. ``topk_mean``: ``quality`` is an
    array of class probabilities and the mean of its ``k`` largest is taken.
    """
    if mode == "topk_mean":
        return run.withColumn("quality", topk_mean(F.col("quality"), k))
    if mode != "minmax":
        raise ValueError(f"unknown mode {mode!r}")
    same = Window.partitionBy(*by)
    low, high = F.min("quality").over(same), F.max("quality").over(same)
    ranged = run.withColumns({"_low": low, "_high": high})
    scaled = F.when(
        F.col("_high") > F.col("_low"), (F.col("quality") - F.col("_low")) / (F.col("_high") - F.col("_low"))
    ).otherwise(0.0)
    return ranged.withColumn("quality", scaled).drop("_low", "_high")


def blend(weight: Column, similarity: Column, quality: Column) -> Column:
    """Assumed blend: weight * similarity + (1 - weight) * quality."""
    return weight * similarity + (1.0 - weight) * quality


def rerank(run: DataFrame, weight: float | Column, by: tuple[str, ...] = ("query_id",), cut: int | None = None) -> DataFrame:
    """Order each query's documents by the blended score; ties by doc_id."""
    weight = weight if isinstance(weight, Column) else F.lit(float(weight))
    scored = run.withColumn("score", F.round(blend(weight, F.col("sim"), F.col("quality")), _TIE_DIGITS))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "doc_id"))
    ranked = scored.withColumn("rank", place)
    return ranked if cut is None else ranked.where(F.col("rank") <= cut)


def judge(run: DataFrame, relevant: DataFrame) -> DataFrame:
    """Add ``rel`` and ``n_relevant`` from query_id, doc_id judgements.

    Queries without a relevant document are left out.
    """
    positive = relevant.where(F.col("rel") > 0).select("query_id", "doc_id", F.lit(1).alias("rel")).distinct()
    totals = positive.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    marked = run.join(positive, ["query_id", "doc_id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0)))
    return marked.join(totals, "query_id")


def ranking_metrics(run: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """nDCG, MAP, recall, precision and MRR at ``k``, mean over queries.

    ``run`` holds query_id, rank, rel (0/1) and n_relevant; queries with no
    relevant document are left out. The ideal is computed from ``n_relevant``,
    so relevance is never expanded into pairs.
    """
    keys = [*by, "query_id"]
    top = run.where((F.col("rank") <= k) & (F.col("n_relevant") > 0))
    sofar = Window.partitionBy(*keys).orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hits = top.withColumn("_hits", F.sum("rel").over(sofar))
    hit = F.col("rel") > 0
    per_query = hits.groupBy(*keys).agg(
        F.sum(F.when(hit, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("_dcg"),
        F.sum(F.when(hit, F.col("_hits") / F.col("rank")).otherwise(0.0)).alias("_ap"),
        F.sum("rel").alias("_found"),
        F.min(F.when(hit, F.col("rank"))).alias("_first"),
        F.first("n_relevant").alias("_r"),
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.least(F.col("_r"), F.lit(k)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + 1.0 / F.log2(i + 1.0),
    )
    return per_query.groupBy(*by).agg(
        F.avg(F.col("_dcg") / ideal).alias("ndcg"),
        F.avg(F.col("_ap") / F.col("_r")).alias("map"),
        F.avg(F.col("_found") / F.col("_r")).alias("recall"),
        F.avg(F.col("_found") / F.lit(float(k))).alias("precision"),
        F.avg(F.coalesce(1.0 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        F.count("*").alias("n_queries"),
    )


def sweep(run: DataFrame, qualities: dict[str, Column], weights: list[float], mode: str = "minmax") -> DataFrame:
    """Every (weight, quality model) setting over one retrieval run.

    ``run`` is the stored top-k. The grid is a literal array, so each row is
    expanded in place and all settings are ranked by one job. Quality is
    normalised once per model, before the weights are expanded.
    """
    models = F.array(*[F.struct(F.lit(m).alias("model"), q.alias("quality")) for m, q in qualities.items()])
    wide = run.select(*[c for c in run.columns if c not in ("rank", "quality")], F.inline(models))
    scaled = normalise_quality(wide, mode, ("model", "query_id"))
    settings = scaled.withColumn("quality_p", F.explode(F.array(*[F.lit(float(w)) for w in weights])))
    return rerank(settings, F.col("quality_p"), ("model", "quality_p", "query_id"))
