"""Vehicle identity from feature vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize, partitions
from .graph import components


def standardise(df: DataFrame, id_col: str = "vec_id", col: str = "features") -> DataFrame:
    """Z-scores per dimension as rows ``id, dim, z``; a dimension without spread gives 0."""
    long = df.select(id_col, F.posexplode(col).alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    stats = long.groupBy("dim").agg(F.avg("v").alias("_m"), F.stddev_pop("v").alias("_s"))
    # One row per dimension.
    return long.join(stats, "dim").select(id_col, "dim", F.coalesce(F.try_divide(F.col("v") - F.col("_m"), F.col("_s")), F.lit(0.0)).alias("z"))


def _ward(points: np.ndarray, sizes: np.ndarray, others: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Squared Ward distances of clusters (their centres and sizes) to others; the same to the
    last bit in both directions, so that ties are ties."""
    gap = np.zeros((len(points), len(others)))
    for x, y in zip(points.T, others.T):
        step = x[:, None] - y[None]
        gap += step * step
    return gap * (2 * sizes[:, None] * other_sizes / (sizes[:, None] + other_sizes))


def nearest_of(ids: np.ndarray, points: np.ndarray, sizes: np.ndarray, other_ids: np.ndarray, others: np.ndarray, other_sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and distance of the nearest other of each cluster, the first of equals: what
    :func:`_ward` gives, to the last bit. A product of matrices rules out what is further than
    its rounding allows; only the rest is measured exactly."""
    a, b = (points * points).sum(1), (others * others).sum(1)
    own = ids[:, None] == other_ids[None]
    weight = 2 * sizes[:, None] * other_sizes / (sizes[:, None] + other_sizes)
    with np.errstate(over="ignore", invalid="ignore"):
        d = (a[:, None] + b - 2 * (points @ others.T)) * weight
        slack = 1e-13 * (points.shape[1] + 8) * (a + b.max(initial=0)) * weight.max(1, initial=0)
    if not (np.isfinite(d).all() and np.isfinite(slack).all()):
        d = _ward(points, sizes, others, other_sizes)
        d[own] = np.inf
        best = d.argmin(1)
        return best, d[np.arange(len(best)), best]
    d[own] = np.inf
    row, col = np.nonzero(d <= (d.min(1) + slack)[:, None])
    gap = np.zeros(len(row))
    for x, y in zip(points.T, others.T):
        step = x[row] - y[col]
        gap += step * step
    exact = gap * weight[row, col]
    exact[own[row, col]] = np.inf
    order = np.lexsort((col, exact, row))
    first = order[np.searchsorted(row[order], np.arange(len(points)))]
    return col[first], exact[first]


def ward_merges(points: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, float]]:
    """``(kept, gone, squared height)`` of every merge of a Ward tree over weighted points; a
    cluster is known by its first point. Ward distances are reducible: a merge brings nothing
    nearer, so all pairs that are each other's nearest merge at once. Of equal distances the
    smaller number counts as nearer. Equal points merge first."""
    n = len(points)
    c, size = points.astype(float).copy(), sizes.astype(float).copy()
    alive, first = np.unique(c, axis=0, return_index=True, return_inverse=True)[1:]
    first = alive[first.ravel()]
    merges = [(int(a), i, 0.0) for i, a in enumerate(first) if a != i]
    size, alive = np.bincount(first, weights=size, minlength=n), np.sort(alive)
    near, dist = np.full(n, -1), np.full(n, np.inf)
    ask = alive
    while len(alive) > 1:
        for i in range(0, len(ask), 1024):
            rows = ask[i : i + 1024]
            best, dist[rows] = nearest_of(rows, c[rows], size[rows], alive, c[alive], size[alive])
            near[rows] = alive[best]
        a = alive[(near[near[alive]] == alive) & (alive < near[alive])]
        if not len(a):  # rounding can break a tie in a ring
            i = alive[dist[alive].argmin()]
            a = np.array([min(i, near[i])])
            near[a], dist[a] = max(i, near[i]), dist[i]
        b = near[a]
        merges += list(zip(a.tolist(), b.tolist(), dist[a].tolist()))
        c[a] = (c[a] * size[a, None] + c[b] * size[b, None]) / (size[a] + size[b])[:, None]
        size[a] += size[b]
        alive = np.setdiff1d(alive, b)
        changed = np.zeros(n, bool)
        changed[a] = changed[b] = True
        ask = alive[changed[alive] | changed[near[alive]]]
    return merges


def ward_cut(points: np.ndarray, sizes: np.ndarray, share: float = 0.7) -> np.ndarray:
    """Flat clusters of a Ward tree over weighted points, cut at ``share`` of its height."""
    merges, label = ward_merges(points, sizes), np.arange(len(points))
    height = max((m[2] for m in merges), default=0.0)
    for a, b, h in sorted(merges, key=lambda m: m[2]):
        if np.sqrt(h) <= share * np.sqrt(height):
            label[label == label[b]] = label[a]
    return np.unique(label, return_inverse=True)[1]


def numbered(df: DataFrame, order: list[str], name: str, after: int = 0) -> DataFrame:
    """Rows with a running number from ``after`` + 1 on: ranges of ``order`` are numbered each
    on its own, and go on from the totals of the ranges before."""
    spark = df.sparkSession
    rows = materialize(df.repartitionByRange(partitions(spark), *order).withColumn("_range", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    return rows.join(totals, "_range").withColumn(name, F.col("_base") + after + F.row_number().over(Window.partitionBy("_range").orderBy(*order))).drop("_range", "_base")


#: Clusters that are merged on the driver, and that a task compares with as many others.
FEW, BLOCK = 2048, 4096


def _blocks(clusters: DataFrame, name: str) -> DataFrame:
    """``block`` and up to :data:`BLOCK` clusters of it in one row: numbers, sizes, centres."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def row():
            ids, n, c = zip(*held)
            out = [np.array(ids, np.int64), np.array(n, float), np.array(c, float)]
            return pa.RecordBatch.from_arrays([pa.array([now]), *(pa.array([x.tobytes()]) for x in out)], names=["block", "ids", "n", "c"])

        for b in batches:
            for block, *rest in zip(*(b.column(i).to_pylist() for i in range(4))):
                if block != now and held:
                    yield row()
                    held = []
                now = block
                held.append(rest)
        if held:
            yield row()

    dealt = clusters.withColumn("block", F.floor(F.col("cid") / BLOCK)).repartition(partitions(clusters.sparkSession), "block").sortWithinPartitions("block", "cid")
    return materialize(dealt.select("block", "cid", "n", "c").mapInArrow(pack, "block long, ids binary, n binary, c binary"), name)


def _nearest(ask: DataFrame, clusters: DataFrame) -> DataFrame:
    """``cid, near, d``: the nearest of all ``clusters`` for each that is asked for, in blocks
    of both; what leaves a task is one row for each cluster of a block."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(i) for i in range(6))):
                (i, n, c), (j, m, e) = ([np.frombuffer(x.as_py(), k) for x, k in zip(part, (np.int64, float, float))] for part in (row[:3], row[3:]))
                c, e = c.reshape(len(i), -1), e.reshape(len(j), -1)
                for a in range(0, len(i), 512):
                    at = slice(a, a + 512)
                    best, d = nearest_of(i[at], c[at], n[at], j, e, m)
                    yield pa.RecordBatch.from_arrays([pa.array(i[at]), pa.array(j[best]), pa.array(d)], names=["cid", "near", "d"])

    rows, all_ = (_blocks(d, name).select("ids", "n", "c") for d, name in ((ask, "asked"), (clusters, "clusters")))
    # Tasks read the files of both sides: blocks are neither sent nor broadcast.
    both = rows.hint("shuffle_replicate_nl").crossJoin(all_.toDF("ids2", "n2", "c2"))
    found = both.mapInArrow(meet, "cid long, near long, d double")
    return found.groupBy("cid").agg(F.min(F.struct("d", "near")).alias("b")).select("cid", "b.near", "b.d")


def ward_tree(points: DataFrame, few: int = FEW) -> DataFrame:
    """``kept, gone, d``: every merge (squared height ``d``) of the Ward tree over ``cid, c``
    with numbers from 1 on and centres as arrays; a cluster is known by its smallest number.

    Rounds over a table of nearest neighbours: all pairs that are each other's nearest merge,
    and only clusters that have merged, or whose nearest has, are asked for again. The last
    ``few`` clusters are merged on the driver in the same way, so the number changes nothing
    but where the work is done. The first round compares all clusters, in blocks.
    """
    spark = points.sparkSession
    points = materialize(points.select("cid", "c"), "points")
    clusters = materialize(points.groupBy("c").agg(F.min("cid").alias("cid"), F.count("*").cast("double").alias("n")).select("cid", "n", "c"), "clusters")
    equal = points.join(clusters.where("n > 1").select(F.col("cid").alias("kept"), "c"), "c").where("cid <> kept")
    told = materialize(equal.select("kept", F.col("cid").alias("gone"), F.lit(0.0).alias("d")), "equal")
    m, near = clusters.count(), None
    ask = clusters
    while m > few:
        found = _nearest(ask, clusters)
        near = materialize(found if near is None else found.unionByName(near.join(ask.select("cid"), "cid", "left_anti")), "near")
        other = near.select(F.col("cid").alias("near"), F.col("near").alias("back"))
        pairs = materialize(near.join(other, "near").where("back = cid and cid < near").select(F.col("cid").alias("kept"), F.col("near").alias("gone"), "d"), "merges")
        met = pairs.count()
        if not met:  # rounding can break a tie in a ring
            met, pairs = 1, materialize(near.orderBy("d", "cid").limit(1).select(F.least("cid", "near").alias("kept"), F.greatest("cid", "near").alias("gone"), "d"), "merges")
        told = told.unionByName(pairs)
        a = clusters.select(F.col("cid").alias("kept"), F.col("n").alias("na"), F.col("c").alias("ca"))
        b = clusters.select(F.col("cid").alias("gone"), F.col("n").alias("nb"), F.col("c").alias("cb"))
        total = F.col("na") + F.col("nb")
        made = pairs.join(a, "kept").join(b, "gone").select(F.col("kept").alias("cid"), total.alias("n"), F.zip_with("ca", "cb", lambda x, y: (x * F.col("na") + y * F.col("nb")) / total).alias("c"))
        ends = pairs.select(F.explode(F.array("kept", "gone")).alias("cid"))
        clusters = materialize(clusters.join(ends, "cid", "left_anti").unionByName(made), "clusters")
        near = near.join(pairs.select(F.col("gone").alias("cid")), "cid", "left_anti")
        lost = near.join(ends.select(F.col("cid").alias("near")), "near", "left_semi").select("cid").unionByName(pairs.select(F.col("kept").alias("cid"))).distinct()
        ask = materialize(clusters.join(lost, "cid"), "ask")
        m -= met
    rest = clusters.orderBy("cid").toPandas()
    merges = ward_merges(np.stack(rest["c"]), rest["n"].to_numpy()) if m else []
    ids = rest["cid"].tolist()
    last = spark.createDataFrame([(ids[a], ids[b], d) for a, b, d in merges], "kept long, gone long, d double")
    return told.unionByName(last)


def vehicle_ids(df: DataFrame, share: float = 0.7, few: int = FEW, id_col: str = "vec_id", col: str = "features", order: str = "t") -> DataFrame:
    """``vehicle_id`` V1, V2, ... by first appearance: the Ward tree over z-scores, cut at
    ``share`` of its height (see :func:`ward_tree`). Rows without features get ids of their own
    after these; so does every row if at most one has any.

    Ids do not depend on partitions or on ``few``. An exact tree compares every row with all
    others once, so work grows with the square of the rows of a table.
    """
    from pyspark.ml.feature import StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    keys = [order, id_col]
    have, none = df.where(F.col(col).isNotNull()), df.where(F.col(col).isNull())
    named = lambda rows, after=0: numbered(rows, keys, "vehicle_id", after).withColumn("vehicle_id", F.concat(F.lit("V"), F.col("vehicle_id").cast("string")))
    if have.limit(2).count() <= 1:
        return named(df)
    rows = materialize(numbered(have, keys, "_cid"), "rows").withColumn("_raw", array_to_vector(F.col(col).cast("array<double>")))
    scaled = StandardScaler(inputCol="_raw", outputCol="_z", withMean=True).fit(rows).transform(rows)
    tree = materialize(ward_tree(scaled.select(F.col("_cid").cast("long").alias("cid"), vector_to_array("_z").alias("c")), few), "tree")
    height = tree.agg(F.max("d")).first()[0]
    low = tree.where(F.sqrt("d") <= share * float(np.sqrt(height))).select(F.col("gone").alias("a"), F.col("kept").alias("b"))
    # Heights grow towards the root, so low merges alone join what a cut leaves together.
    roots = components(low).select(F.col("node").alias("_cid"), "root")
    made = materialize(rows.drop("_raw").join(roots, "_cid", "left").withColumn("_root", F.coalesce("root", "_cid")).drop("root"), "clustered")
    ids = materialize(numbered(made.select("_root").distinct(), ["_root"], "_n"), "vehicles")
    found = made.join(ids, "_root").withColumn("vehicle_id", F.concat(F.lit("V"), F.col("_n").cast("string"))).select(*df.columns, "vehicle_id")
    return found.unionByName(named(none, ids.count()))
