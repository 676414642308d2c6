"""Maximum inner product search with score-aware (anisotropic) quantisation.

Vectors are cut into ``dim / 2`` subspaces of two dimensions; each part is coded by one of
16 codewords (4 bits). Codewords and codes minimise the score-aware loss: the part of
the residual that is parallel to the vector costs ``ETA`` times as much as the rest,
because only that part changes the large inner products. For a query, a table of the
inner products with all codewords is made (two codes together make one table of 256),
and the codes of a block are scanned through it; the ``RERANK`` best of each block are
scored exactly, in double precision, on the original vectors (floats or doubles).

The codebook is learned from a bounded sample (``SAMPLE`` vectors); every vector is
indexed. Equal vectors are one class, of which only the smallest ``k + 1`` ids can be
among the k nearest, so hot vectors stay small. A hash of the id deals the index
into blocks of about ``INDEX_BLOCK`` vectors and the queries into blocks of about
``QUERY_BLOCK``, so the result does not depend on how the table is cut into partitions.
A tile is one block of queries and up to ``TILE`` blocks of the index: one task meets it
whole, keeps k + 1 results for each query, and the best of all tiles stay. Index blocks
are shuffled once for each ``QUERY_BLOCK`` queries, queries once for each ``TILE`` blocks;
the tables score every query against every vector.

Defined cases: vectors that are null, zero, hold null or non-finite components, or are of
another length than most vectors (ties: the longer) take no part; the query's own id is
no candidate, equal vectors of other ids are; fewer candidates than k give fewer rows;
rows that repeat a vec_id and its vector count once, a vec_id with two vectors counts
with the smaller one; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read

#: Vectors that the codebook is learned from, at most.
SAMPLE = 10_000
#: Cost of the parallel residual against the rest: (dim-1) T^2 / (1-T^2) for T = 0.2, dim = 64.
ETA = 2.6
SWEEPS = 6
#: Vectors of a block that are scored exactly for each query.
RERANK = 100
#: Vectors of a block, about; blocks of the index in a tile, at most; queries whose tables are made at a time.
QUERY_BLOCK, INDEX_BLOCK, TILE, CHUNK = 8192, 8192, 8, 512


def parts(x: np.ndarray) -> np.ndarray:
    """(n, subspaces, 2); an odd dimension is filled up with zero."""
    if x.shape[1] % 4:
        x = np.pad(x, ((0, 0), (0, -x.shape[1] % 4)))
    return x.reshape(len(x), -1, 2)


def assign(x: np.ndarray, book: np.ndarray, codes: np.ndarray | None = None, sweeps: int = 2) -> np.ndarray:
    """Codes that lower the score-aware loss, one subspace after the other."""
    p = parts(x)
    u = p / np.linalg.norm(x, axis=1)[:, None, None]
    if codes is None:
        codes = ((p[:, :, None] - book[None]) ** 2).sum(-1).argmin(-1) if len(x) * book.size < 4e7 else np.concatenate([((p[i : i + 4096, :, None] - book[None]) ** 2).sum(-1).argmin(-1) for i in range(0, len(x), 4096)])
    m = np.arange(book.shape[0])
    parallel = ((p - book[m, codes]) * u).sum((1, 2))
    for _ in range(sweeps):
        for k in range(book.shape[0]):
            r = p[:, k, None] - book[k][None]
            along = (r * u[:, k, None]).sum(-1)
            rest = parallel - along[np.arange(len(x)), codes[:, k]]
            cost = (r * r).sum(-1) + (ETA - 1) * (rest[:, None] + along) ** 2
            codes[:, k] = cost.argmin(1)
            parallel = rest + along[np.arange(len(x)), codes[:, k]]
    return codes


def learn(x: np.ndarray) -> np.ndarray:
    """Codebook (subspaces, 16, 2) by alternating codes and codewords."""
    p = parts(x)
    u = p / np.linalg.norm(x, axis=1)[:, None, None]
    rng = np.random.default_rng(3)
    start = rng.choice(len(x), 16, replace=len(x) < 16)
    book = p[start].transpose(1, 0, 2).astype(np.float64).copy()
    codes = None
    for _ in range(SWEEPS):
        codes = assign(x, book, codes, 1)
        m = np.arange(book.shape[0])
        parallel = ((p - book[m, codes]) * u).sum((1, 2))
        for k in range(book.shape[0]):
            own = parallel - ((p[:, k] - book[k, codes[:, k]]) * u[:, k]).sum(-1)
            want = own + (p[:, k] * u[:, k]).sum(-1)
            for c in range(16):
                at = codes[:, k] == c
                if at.sum() > 2:
                    v = u[at, k]
                    a = at.sum() * np.eye(2) + (ETA - 1) * v.T @ v
                    b = p[at, k].sum(0) + (ETA - 1) * (want[at, None] * v).sum(0)
                    book[k, c] = np.linalg.solve(a, b)
            parallel = own + ((p[:, k] - book[k, codes[:, k]]) * u[:, k]).sum(-1)
    return book


def packed(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes in a byte."""
    return (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)


def block_of(of: int, salt: int):
    """Number of the block, below ``of``, that a class falls into."""
    return F.pmod(F.xxhash64("class", F.lit(salt)), F.lit(of))


def columns_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors (floats or doubles, as given) of one block, by id."""
    table = table.select(["class", "embedding"]).combine_chunks()
    ids = table.column("class").to_numpy().astype("<i8")
    x = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    order = np.argsort(ids)
    return ids[order], x[order]


def indexer(shared):
    book = shared.value

    def work(key: tuple, table: pa.Table) -> pa.Table:
        ids, x = columns_of(table)
        codes = packed(assign(x.astype(np.float64), book))
        return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, x, codes))], names=["part", "ids", "vectors", "codes"])

    return work


def query_packer(key: tuple, table: pa.Table) -> pa.Table:
    ids, x = columns_of(table)
    return pa.table([pa.array([key[0].as_py()], pa.int64()), *(pa.array([v.tobytes()], pa.binary()) for v in (ids, x))], names=["block", "query_ids", "query_vectors"])


def scanner(shared, k: int, kind: str):
    book = shared.value

    def work(index: pa.Table, queries: pa.Table) -> pa.Table:
        whom, who, scores = [], [], []
        for asked in queries.to_pylist():
            qid = np.frombuffer(asked["query_ids"], "<i8")
            q_all = np.frombuffer(asked["query_vectors"], kind).reshape(len(qid), -1).astype(np.float64)
            blocks = []
            for row in index.select(["ids", "vectors", "codes"]).to_pylist():
                ids = np.frombuffer(row["ids"], "<i8")
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                blocks.append((ids, np.frombuffer(row["vectors"], kind).reshape(len(ids), -1), codes.astype(np.intp) + 256 * np.arange(codes.shape[1])))
            for begin in range(0, len(qid), CHUNK):
                q = q_all[begin : begin + CHUNK]
                tables = np.einsum("qmd,mcd->qmc", parts(q), book).astype(np.float32)
                pairs = (tables[:, ::2, :, None] + tables[:, 1::2, None, :]).reshape(len(q), -1)
                for i in range(len(q)):
                    near, score = [], []
                    for ids, x, at in blocks:
                        some = np.arange(len(ids))
                        if len(ids) > RERANK:
                            some = np.argpartition(pairs[i].take(at).sum(1), -RERANK)[-RERANK:]
                        near.append(ids[some])
                        score.append((x[some].astype(np.float64) * q[i]).sum(1))
                    near, score = np.concatenate(near), np.concatenate(score)
                    first = np.lexsort((near, -score))[: k + 1]
                    whom.append(np.full(len(first), qid[begin + i]))
                    who.append(near[first])
                    scores.append(score[first])
        flat = [np.concatenate(v) if v else np.zeros(0) for v in (whom, who, scores)]
        return pa.table([pa.array(flat[0], pa.int64()), pa.array(flat[1], pa.int64()), pa.array(flat[2], pa.float64())], names=["query_class", "class", "score"])

    return work


def element(vectors: DataFrame) -> str:
    """float for vectors of floats, double for all others."""
    return "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the vectors that take part, once each."""
    e = F.col("embedding")
    good = vectors.select("vec_id", e.cast(f"array<{element(vectors)}>").alias("embedding")).filter(F.col("vec_id").isNotNull() & e.isNotNull())
    good = good.filter(F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0))
    size = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return good.filter(F.size("embedding") == (size.d if size else 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def nearest(vectors: DataFrame, is_query, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row of ``vectors`` (vec_id, embedding) for which ``is_query`` holds."""
    spark = vectors.sparkSession
    own = materialize(usable(vectors), "vectors")
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    small = own.withColumn("_r", rank).filter(F.col("_r") <= k + 1)
    classes = materialize(small.groupBy("embedding").agg(F.min("vec_id").alias("class"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "vector-classes")
    sample = classes.select("class", "embedding").orderBy(F.xxhash64("class"), "class").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    book = spark.sparkContext.broadcast(learn(np.array([r.embedding for r in sample], np.float64)))  # bounded by the dimension
    queries = materialize(own.filter(is_query).join(classes.select("class", "embedding"), "embedding").select("vec_id", "class", "embedding"), "queries")
    asked = queries.select("class", "embedding").dropDuplicates(["class"])
    n, asking = classes.count(), asked.count()
    parts_, blocks_ = 1 + n // INDEX_BLOCK, 1 + asking // QUERY_BLOCK
    blocks = materialize(asked.withColumn("block", block_of(blocks_, 1)).groupBy("block").applyInArrow(query_packer, "block bigint, query_ids binary, query_vectors binary"), "query-blocks")
    index = materialize(classes.select("class", "embedding").withColumn("part", block_of(parts_, 2)).groupBy("part").applyInArrow(indexer(book), "part bigint, ids binary, vectors binary, codes binary"), "index")
    # every block of the index goes to every block of queries; tiles are smaller than TILE while there are fewer of them than tasks that can run
    tile = max(1, min(TILE, parts_ * blocks_ // (2 * spark.sparkContext.defaultParallelism)))
    upto = lambda most: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(most).cast("bigint")))
    left = index.withColumn("tile", F.floor(F.col("part") / tile)).drop("part").withColumn("block", upto(blocks_ - 1))
    right = blocks.withColumn("tile", upto((parts_ - 1) // tile))
    tiles = left.groupBy("block", "tile").cogroup(right.groupBy("block", "tile"))
    found = materialize(tiles.applyInArrow(scanner(book, k, "<f4" if element(vectors) == "float" else "<f8"), "query_class bigint, class bigint, score double"), "found")
    top = found.withColumn("_r", F.row_number().over(Window.partitionBy("query_class").orderBy(F.desc("score"), "class"))).filter(F.col("_r") <= k + 1).drop("_r")
    named = top.join(classes.select("class", "ids"), "class").select("query_class", "score", F.explode("ids").alias("candidate"))
    order = Window.partitionBy("query_class").orderBy(F.desc("score"), "candidate")
    lists = named.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k + 1).groupBy("query_class").agg(F.sort_array(F.collect_list(F.struct("_r", "candidate", "score"))).alias("found"))
    each = queries.select("vec_id", F.col("class").alias("query_class")).join(lists, "query_class")
    others = each.select("vec_id", F.slice(F.filter("found", lambda x: x["candidate"] != F.col("vec_id")), 1, k).alias("found"))
    flat = others.select(F.col("vec_id").alias("query_id"), F.posexplode("found").alias("pos", "x"))
    return flat.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.candidate").alias("vec_id"), F.col("x.score").alias("score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
