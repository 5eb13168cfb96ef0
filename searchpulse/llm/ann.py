"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are grown on a bounded sample, one in a task: a node splits its points by
the hyperplane between two means until a leaf is small enough. The number of leaves follows that of the
vectors, so leaves keep their size (up to ``MAX_LEAVES``, which bounds what is broadcast). Every vector is
filed in one leaf of each tree. A query takes nodes from one priority queue shared by all
trees, the most promising margin first, until it has visited enough leaves; the vectors of
those leaves are its candidates and are reranked exactly. How many leaves are enough is
measured: some queries are answered exactly by a pass over all vectors, and the visits are those that find
the wanted share of their neighbours. A product that enough vectors of the sample reach bounds a query's
nearest from below; of the candidates beneath it a bucket passes on only as many as a full answer may need.

Nearness is the largest inner product. For the trees each vector gets one more
component that makes all norms equal, so that the largest product is the nearest
point. Equal vectors are searched once, as the class of their smallest id, and only
the ids that can be among the nearest leave a class.

Leaves that lie together in a tree form a bucket; its vectors meet the queries that visit any of its leaves.
Buckets are cut into blocks of about ``BLOCK`` rows, and their queries too,
so no task holds a bucket whole; a block gives each query its best candidates, and the
best of all blocks are merged.

Edge cases: vectors that are null, zero, or hold null or non-finite components take
no part, nor do those of another than the most common length, nor null ids; a query
with fewer candidates gets them all; ties go to the smaller id; rows that repeat an
id and its vector are one; an empty table gives no rows; only the id and the vector are
read, so other columns' names may clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from searchpulse.llm.common import share, stored

TREES = 12
#: Vectors in a leaf, about, and the leaves that a tree has at most.
LEAF, MAX_LEAVES = 24, 8192
#: Neighbouring leaves whose vectors are kept together.
BUCKET = 32
#: Share of the nearest that the measured queries must find, and how many queries are measured.
TARGET, MEASURED = 0.93, 96
#: Vectors the trees are grown on.
SAMPLE = 65_536
BLOCK = 4096


class Forest:
    """Trees as arrays: normals, offsets, children, root; a child below 0 is the leaf -1 - child."""

    def __init__(self, trees: list[tuple]):
        self.trees = trees

    @classmethod
    def tree(cls, points, leaves: int, seed: int) -> tuple:
        """A tree over ``points`` with about so many leaves, numbered from one side to the other."""
        import numpy as np

        return cls._grow(points, max(1, len(points) // leaves), np.random.default_rng(seed))

    @staticmethod
    def _plane(points, rng):
        """Unit normal and offset of the plane between two means; the median where that is lopsided."""
        import numpy as np

        a, b = points[rng.integers(0, len(points), 2)]
        for _ in range(4):
            some = points[rng.integers(0, len(points), min(64, len(points)))]
            near = ((some - a) ** 2).sum(1) < ((some - b) ** 2).sum(1)
            if near.any() and not near.all():
                a, b = some[near].mean(0), some[~near].mean(0)
        normal = a - b
        size = np.linalg.norm(normal)
        normal = normal / size if size > 0 else rng.normal(size=points.shape[1])
        along = points @ normal
        offset = (a + b) @ normal / 2
        if not 0.1 < (along > offset).mean() < 0.9:
            offset = np.median(along)
        return normal, offset, along > offset

    @classmethod
    def _grow(cls, points, leaf_size, rng):
        import numpy as np

        normals, offsets, below, above, leaves = [], [], [], [], 0

        def node(rows) -> int:
            nonlocal leaves
            if len(rows) > leaf_size and len(rows) > 1:
                normal, offset, up = cls._plane(points[rows], rng)
                if up.any() and not up.all():
                    me = len(normals)
                    normals.append(normal)
                    offsets.append(offset)
                    below.append(0)
                    above.append(0)
                    below[me] = node(rows[~up])
                    above[me] = node(rows[up])
                    return me
            leaves += 1
            return -leaves

        root = node(np.arange(len(points)))
        shape = (len(normals), points.shape[1])
        return np.array(normals).reshape(shape), np.array(offsets), np.array(below, np.int64), np.array(above, np.int64), root

    def leaves_of(self, vectors):
        """Leaf of each vector in each tree."""
        import numpy as np

        out = np.empty((len(vectors), len(self.trees)), np.int32)
        for k, (normals, offsets, below, above, root) in enumerate(self.trees):
            at = np.full(len(vectors), root)
            while len(open_rows := np.flatnonzero(at >= 0)):
                here = at[open_rows]
                margin = np.einsum("ij,ij->i", vectors[open_rows], normals[here]) - offsets[here]
                at[open_rows] = np.where(margin > 0, above[here], below[here])
            out[:, k] = -1 - at
        return out

    def visit(self, vectors, visits: int):
        """For each vector the (tree, leaf) of its most promising leaves, from one priority queue over all trees."""
        import heapq

        below = [t[2].tolist() for t in self.trees]
        above = [t[3].tolist() for t in self.trees]
        for at in range(0, len(vectors), 64):
            some = vectors[at : at + 64]
            margins = [some @ normals.T - offsets for normals, offsets, *_ in self.trees]
            for i in range(len(some)):
                own = [m[i].tolist() for m in margins]
                queue = [(float("-inf"), k, tree[4]) for k, tree in enumerate(self.trees)]
                found: list[tuple[int, int]] = []
                while queue and len(found) < visits:
                    far, k, node = heapq.heappop(queue)
                    if node < 0:
                        found.append((k, -1 - node))
                        continue
                    margin = own[k][node]
                    heapq.heappush(queue, (max(far, -margin), k, above[k][node]))
                    heapq.heappush(queue, (max(far, margin), k, below[k][node]))
                yield found


def usable_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) with v as doubles, of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(good)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").head()
    return rows.where(F.size("v") == (sizes["n"] if sizes else 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _needed_visits(forest: Forest, queries, neighbours, target: float) -> int:
    """Leaves to visit so that the given share of all ``neighbours`` (an array of vectors for each query) is met."""
    import numpy as np

    total = sum(len(t[0]) + 1 for t in forest.trees)
    needs = []
    for order, near in zip(forest.visit(queries, total), neighbours):
        place = {leaf: n for n, leaf in enumerate(order)}
        leaves = forest.leaves_of(near)
        needs += [min(place.get((k, int(leaf)), total) for k, leaf in enumerate(row)) + 1 for row in leaves]
    return int(np.sort(needs)[int(np.ceil(target * len(needs))) - 1]) if needs else 1


def nearest(
    table: DataFrame,
    queries: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    trees: int = TREES,
    leaf: int = LEAF,
    target: float = TARGET,
    sample: int = SAMPLE,
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found of every row that ``queries`` selects by ``id``."""
    import pickle

    import numpy as np
    import pyarrow as pa

    spark = table.sparkSession
    usable = stored(usable_vectors(table, id_col, vector_col), "vectors")
    classes = stored(usable.groupBy("v").agg(F.min("id").alias("rep")), "vector-classes")
    by_class = Window.partitionBy("rep").orderBy("id")
    # of a class only its k + 1 smallest ids can be among k nearest that are not the query itself
    members = usable.join(classes, "v").select("rep", "id")
    ids = members.distinct().withColumn("n", F.row_number().over(by_class)).where(F.col("n") <= k + 1).drop("n")
    ids = stored(ids, "class-members")
    asking = stored(members.where(queries).distinct(), "query-classes")

    norm = F.sqrt(inner_product(F.col("v"), F.col("v")))
    longest, n_classes = classes.agg(F.max(norm), F.count("*")).head()
    answer = "query_id long, rank int, vec_id long, score double"
    if longest is None:
        return spark.createDataFrame([], answer)
    grown_on = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("v").toArrow().column(0).combine_chunks()
    points = grown_on.flatten().to_numpy(zero_copy_only=False).reshape(len(grown_on), -1)
    width = points.shape[1]

    def lifted(vectors):
        rest = np.sqrt(np.maximum(longest**2 - (vectors**2).sum(1), 0))
        return np.column_stack((vectors, rest)).astype(np.float32)

    def asked_for(vectors):
        return np.column_stack((vectors, np.zeros(len(vectors)))).astype(np.float32)

    leaves = max(1, min(MAX_LEAVES, n_classes // leaf, len(points) // 4))
    keep = k + 5
    seeds = share(spark, lifted(points))

    def grow(batches):
        given = seeds()
        for batch in batches:
            grown = [pickle.dumps(Forest.tree(given, leaves, number)) for number in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grown, pa.binary())], ["id", "tree"])

    grown = spark.range(0, trees, 1, trees).mapInArrow(grow, "id long, tree binary").orderBy("id").toLocalIterator()
    grown = Forest([pickle.loads(bytes(row["tree"])) for row in grown])
    forest = share(spark, grown)

    def matrix(column):
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    asked = classes.join(asking.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), "v")
    asked = stored(asked, "queries")

    # some queries exactly, by a pass over all vectors
    few = asked.orderBy(F.xxhash64("id"), "id").limit(MEASURED).toArrow().combine_chunks()
    few_ids = few.column(0).to_numpy()
    few_v = matrix(few.column(1).combine_chunks()) if len(few_ids) else np.zeros((0, width))

    def exactly(batches):
        for batch in batches:
            products = few_v @ matrix(batch.column(1)).T
            n = min(k + 1, batch.num_rows)
            if n:
                best = np.argpartition(-products, n - 1, axis=1)[:, :n]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(few_ids, n)),
                        batch.column(0).take(pa.array(best.ravel())),
                        pa.array(np.take_along_axis(products, best, 1).ravel()),
                    ],
                    ["q", "c", "s"],
                )

    met = classes.select(F.col("rep").alias("id"), "v").mapInArrow(exactly, "q long, c long, s double").where("q <> c")
    first = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    met = met.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k)
    found = met.join(classes.select(F.col("rep").alias("c"), "v"), "c").groupBy("q").agg(F.flatten(F.collect_list("v")).alias("v"))
    truth = {row["q"]: np.array(row["v"]).reshape(-1, width) for row in found.toLocalIterator()}
    near = [lifted(truth.get(q, np.zeros((0, width)))) for q in few_ids.tolist()]
    visits = _needed_visits(grown, asked_for(few_v), near, target)

    def file(batches):
        grown = forest()
        for batch in batches:
            found = grown.leaves_of(lifted(matrix(batch.column(1))))
            places = pa.array(list(found), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), places], ["id", "v", "leaves"])

    def lower_bounds(vectors, given):
        """A product that k others of the sample reach, so that nothing below it is among the k nearest."""
        out = np.full(len(vectors), -np.inf)
        for at in range(0, len(vectors) if len(given) > k else 0, 64):
            products = vectors[at : at + 64] @ given.T  # the last component of a query is 0
            out[at : at + 64] = np.partition(products, len(given) - k - 1, axis=1)[:, len(given) - k - 1]
        return out - 1e-4 * longest**2  # products of the sample are in single precision

    def ask(batches):
        grown, given = forest(), seeds()
        for batch in batches:
            vectors, rows = asked_for(matrix(batch.column(1))), []
            bounds = lower_bounds(vectors, given)
            for i, found in enumerate(grown.visit(vectors, visits)):
                by_place: dict[int, list[int]] = {}
                for t, number in found:
                    by_place.setdefault(t << 20 | number // BUCKET, []).append(number)
                # a vector stands in one bucket of each tree: so many from each are enough for all of ``keep``
                enough = -(-keep * trees // len(by_place))
                rows += [(i, place, some, enough) for place, some in by_place.items()]
            at, places, lists, enough = zip(*rows) if rows else ((), (), (), ())
            least = pa.array(bounds[list(at)], pa.float64())
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(places, pa.int32()), batch.column(0).take(at), batch.column(1).take(at), pa.array(lists, pa.list_(pa.int32())), least, pa.array(enough, pa.int32())],
                ["place", "id", "v", "leaves", "least", "enough"],
            )

    filed = classes.select(F.col("rep").alias("id"), "v").mapInArrow(file, "id long, v array<double>, leaves array<int>")
    filed = filed.select("id", "v", F.posexplode("leaves").alias("tree", "leaf"))
    place = F.shiftleft("tree", 20) + F.floor(F.col("leaf") / BUCKET).cast("int")
    filed = stored(filed.select(place.alias("place"), "id", "v", F.array("leaf").alias("leaves")), "leaves")
    visited = stored(asked.mapInArrow(ask, "place int, id long, v array<double>, leaves array<int>, least double, enough int"), "visited")

    def blocks(rows, block, *more):
        """Rows of a place in blocks of about BLOCK rows, one array each."""
        counted = rows.groupBy("place").agg(F.count("*").alias("n"))
        dealt = rows.join(counted, "place").withColumn(block, F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / BLOCK)))
        # the lists of one aggregation keep the same order of rows
        lists = [F.collect_list("id").alias(f"{block}_ids"), F.flatten(F.collect_list("v")).alias(f"{block}_v"), F.collect_list("leaves").alias(f"{block}_leaves")]
        lists += [F.collect_list(c).alias(f"{block}_{c}") for c in more]
        return dealt.groupBy("place", block).agg(*lists)

    met = blocks(visited, "q", "least", "enough").join(blocks(filed, "c"), "place")
    met = met.select("q_ids", "q_v", "q_leaves", "c_ids", "c_v", "c_leaves", "q_least", "q_enough")

    def score(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, c_ids = (batch.column(j)[i].values.to_numpy() for j in (0, 3))
                q, c = (batch.column(j)[i].values.to_numpy().reshape(-1, width) for j in (1, 4))
                wanted, least, enough = batch.column(2)[i].as_py(), *(batch.column(j)[i].values.to_numpy() for j in (6, 7))
                own = batch.column(5)[i].values.flatten().to_numpy()  # each vector has one leaf
                order = np.argsort(own, kind="stable")
                own = own[order]
                out = []
                for number, at_leaves in enumerate(wanted):
                    ends = np.searchsorted(own, [at_leaves, [x + 1 for x in at_leaves]])
                    rows = np.concatenate([order[a:b] for a, b in zip(*ends)])
                    if len(rows):
                        products = c[rows] @ q[number]
                        n = min(keep, max(int((products >= least[number]).sum()), int(enough[number])))
                        if len(rows) > n:
                            best = np.argpartition(-products, n - 1)[:n]
                            rows, products = rows[best], products[best]
                        out.append((np.full(len(rows), q_ids[number]), c_ids[rows], products))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["q", "c", "s"])

    scored = met.mapInArrow(score, "q long, c long, s double")
    # one candidate comes from several trees, with products that may differ in the last bit
    best = Window.partitionBy("q").orderBy(F.desc("s"), "c")
    near = scored.groupBy("q", "c").agg(F.max("s").alias("s")).withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep)
    near = near.select("q", "c").unionByName(asked.select(F.col("id").alias("q"), F.col("id").alias("c"))).distinct()

    vectors = classes.select("rep", "v")
    exact = near.join(vectors.select(F.col("rep").alias("q"), F.col("v").alias("vq")), "q")
    exact = exact.join(vectors.select(F.col("rep").alias("c"), F.col("v").alias("vc")), "c")
    exact = exact.select("q", "c", inner_product(F.col("vq"), F.col("vc")).alias("score"))
    found = exact.join(ids.select(F.col("rep").alias("c"), F.col("id").alias("vec_id")), "c")
    # the ids of a query's class share one list of k + 1, from which each leaves itself out
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    listed = found.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"))
    answers = asking.select(F.col("rep").alias("q"), F.col("id").alias("query_id")).join(listed, "q")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answers = answers.select("query_id", F.posexplode(others).alias("place", "x"))
    return answers.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
