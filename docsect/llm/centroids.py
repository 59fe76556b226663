"""Centroid clustering over distinct vectors: equal quantised vectors count once, with their multiplicity.

Components become whole numbers (floor(SCALE * x)), and equal vectors are grouped into one row with the number of times
they occur, so that however many copies a vector has, it is assigned once a round and moves once.  Lloyd's rounds run on the distinct
vectors with weighted integer sums: a task sends a row for each centroid and component, which are added up before anything comes to the driver
(k * size rows a round).  Everything is exact, so results do not depend on how rows are dealt.  At the end each vec_id is
joined to the assignment of its vector.

Vectors that are null, have another length, or hold a null or a number that is not finite are left out.  Repeated rows are rows
of their own.  A null vec_id cannot be a first centroid.  Among equal vec_ids the first centroid is the lesser vector.  With
fewer than k vectors there are fewer centroids; an empty table has no rows.  Extra columns are ignored.  A component whose
whole number does not fit in LARGEST is refused with an error, as distances would leave 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsect.llm.common import Scratch

SIZE, SCALE, CLUSTERS, ROUNDS, SEED = 64, 256, 40, 5, 2
#: Bounds of whole components: 64 squared differences stay in 64 bits, or within the whole numbers that doubles hold.
LARGEST, FOR_DOUBLES = 1 << 27, 1 << 22
AT_ONCE = 4096


def quantised(vectors: DataFrame, size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the whole components, of vectors with size finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    x = F.transform("embedding", lambda x: x.cast("double"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).filter((F.size("x") == size) & F.forall("x", finite))
    whole = lambda x: F.when(F.abs(x) * scale <= LARGEST, F.floor(x * scale)).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} / {scale}")).cast("long"))
    return kept.select("vec_id", F.transform("x", whole).alias("q"))


def first_centroids(vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED) -> list[list[int]]:
    """The vectors with the k least digests of seed:vec_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r["q"] for r in vectors.filter("vec_id is not null").select(digest.alias("h"), "q").orderBy("h", "q").limit(k).collect()]


def nearest(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each vector, the smaller of equal ones, and the squared distance."""
    kind = np.float64 if max(np.abs(q).max(initial=0), np.abs(centroids).max(initial=0)) <= FOR_DOUBLES else np.int64
    a, c = q.astype(kind), centroids.astype(kind)
    distance = (a * a).sum(1)[:, None] - 2 * (a @ c.T) + (c * c).sum(1)
    best = distance.argmin(1)
    return best.astype(np.int32), distance[np.arange(len(q)), best].astype(np.int64)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, AT_ONCE):
        part = batch.slice(at, AT_ONCE)
        yield part, part.column("q").flatten().to_numpy().reshape(part.num_rows, -1)


def moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: centroids at the floor of the mean of the vectors nearest to them; empty ones stay."""
    k, size = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, size), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for batch in batches:
            for part, q in _rows(batch):
                n, (best, _) = part.column("n").to_numpy(), nearest(q, centroids)
                order = np.argsort(best, kind="stable")
                some, at = np.unique(best[order], return_index=True)
                sums[some] += np.add.reduceat((q * n[:, None])[order], at, axis=0)
                counts[some] += np.add.reduceat(n[order], at)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(some, size).astype(np.int32)), pa.array(np.tile(np.arange(size, dtype=np.int32), len(some))), pa.array(sums[some].ravel()), pa.array(np.repeat(counts[some], size))], ["cluster", "component", "total", "n"])

    rows = distinct.mapInArrow(run, "cluster int, component int, total long, n long").groupBy("cluster", "component").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # k * size rows
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["component"]] = r["total"] // r["n"]
    return out


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, size: int = SIZE, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, cluster and distance of each vector of vectors (vec_id, embedding), and the final centroids."""
    scratch = Scratch(vectors.sparkSession, "clusters")
    kept = scratch.save(quantised(vectors, size, scale), "quantised")
    distinct = scratch.save(kept.groupBy("q").agg(F.count("*").alias("n")), "distinct")
    centroids = np.array(first_centroids(kept, k, seed), dtype=np.int64).reshape(-1, size)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(distinct, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, q in _rows(batch):
                best, distance = nearest(q, centroids) if len(centroids) else (np.full(len(q), -1, dtype=np.int32), np.zeros(len(q), dtype=np.int64))
                yield pa.RecordBatch.from_arrays([part.column("q"), part.column("n"), pa.array(best), pa.array(distance)], ["q", "n", "cluster", "distance"])

    assigned = scratch.save(distinct.mapInArrow(run, "q array<long>, n long, cluster int, distance long").filter("cluster >= 0").withColumn("key", F.xxhash64("q")), "assigned")
    totals = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance") * F.col("n")).alias("d")).collect()}  # k rows
    scratch.leave(kept, assigned)
    known = F.create_map(*[F.lit(x) for c, d in totals.items() for x in (c, d)]) if totals else F.create_map().cast("map<int,bigint>")
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # equal vectors meet by the vector itself; the hash in front makes the sort cheap
    both = kept.withColumn("key", F.xxhash64("q")).join(assigned.drop("n"), ["key", "q"])
    out = both.select("vec_id", "cluster", "distance", F.try_element_at(known, F.col("cluster")).cast("long").alias("cluster_inertia"), F.lit(sum(totals.values())).cast("long").alias("inertia"), F.try_element_at(F.array(*map(F.lit, digests)) if digests else F.array().cast("array<string>"), F.col("cluster") + 1).alias("centroid_sha256"))
    return out, centroids


def op13_centroid_clustering(spark, sf_dir: str) -> DataFrame:
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))[0]


def _sql() -> str:
    """The rounds, one after the other, as SQL."""
    near = """n{i} AS (SELECT vec_id, q, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.vec_id, v.rid, v.q, k.c, list_sum(list_transform(list_zip(v.q, k.m), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept v, c{i} k) GROUP BY vec_id, rid, q),
"""
    move = """s{i} AS (SELECT c, j, sum(q[j])::HUGEINT AS total, count(*)::HUGEINT AS n FROM n{i}, (SELECT unnest(range(1, SIZE + 1)) AS j) GROUP BY c, j),
m{i} AS (SELECT c, list((CASE WHEN total % n < 0 THEN total // n - 1 ELSE total // n END)::BIGINT ORDER BY j) AS m FROM s{i} GROUP BY c),
c{j} AS (SELECT k.c, coalesce(m.m, k.m) AS m FROM c{i} k LEFT JOIN m{i} m USING (c)),
"""
    out = """WITH kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(SCALE * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = SIZE AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY h, q) - 1 AS c, q AS m FROM (SELECT sha256('SEED:' || vec_id) AS h, q FROM kept WHERE vec_id IS NOT NULL) ORDER BY h, q LIMIT CLUSTERS),
"""
    for i in range(ROUNDS):
        out += near.replace("{i}", str(i)) + move.replace("{i}", str(i)).replace("{j}", str(i + 1))
    out += near.replace("{i}", str(ROUNDS))
    out += f"""t AS (SELECT c, sum(d)::BIGINT AS inertia FROM n{ROUNDS} GROUP BY c)
SELECT n.vec_id, n.c::INTEGER AS cluster, n.d AS distance, t.inertia AS cluster_inertia, (SELECT sum(inertia)::BIGINT FROM t) AS inertia, sha256(array_to_string(k.m, ',')) AS centroid_sha256
FROM n{ROUNDS} n JOIN t USING (c) JOIN c{ROUNDS} k USING (c)"""
    return out.replace("SIZE", str(SIZE)).replace("SCALE", str(SCALE)).replace("CLUSTERS", str(CLUSTERS)).replace("SEED", str(SEED))


OP13_SQL = _sql()
