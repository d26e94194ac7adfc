"""Approximate nearest neighbours by the inner product: NN-descent and greedy graph search.

Equal vectors are one node. Nodes on the same sides of random directions are compared with each other,
which gives each its first neighbours. Each round joins the neighbours of a node, forward and
reverse, with each other where one of them is new, and offers them what they find better than their
worst neighbour. Neighbours that a round didn't draw stay new; rounds end when hardly any neighbour is
new. A search starts at the query's own neighbours, follows the neighbours of the best
nodes that it hasn't followed yet, and stops when none of them is among the best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strongbox.llm.tables import arrow_schema, partitions, written

K = 20
#: Neighbours of a node in the graph; nodes that one is joined with in a round, new and old ones, forward
#: and reverse each; share of new neighbours that is left when rounds end.
DEGREE, JOINED, LEFT_NEW = 32, 16, 0.001
#: Tables of random directions that the graph starts from, and nodes compared at once there.
TABLES, LEAF = 20, 2048

EDGE_DDL = "node long, other long, sim double"
EDGE = arrow_schema(node=pa.int64(), other=pa.int64(), sim=pa.float64())


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array<double>) of the rows that take part: not null, not zero, all finite.
    Of several vectors with one id the smallest counts."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite & F.exists("embedding", lambda x: x != 0)).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def classes(vectors: DataFrame, keep: int) -> DataFrame:
    """Equal vectors as one node: node (the smallest vec_id), embedding, and its ``keep`` smallest
    members. Members are first counted within parts, as one vector may be that of a third of all rows."""
    part = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    own = Window.partitionBy("embedding", "part").orderBy("vec_id")
    few = vectors.withColumn("part", part).withColumn("n", F.row_number().over(own)).where(F.col("n") <= keep)
    few = few.withColumn("n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("n") <= keep)
    return few.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.sort_array(F.collect_list("vec_id")).alias("members"))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter vectors are filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), -1)
    out = np.zeros((len(sizes), sizes.max(initial=0)), flat.dtype)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def _batch(node: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(other, pa.int64()), pa.array(sim, pa.float64())], schema=EDGE)


def _best(node: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each node's best others, each once."""
    order = np.lexsort((other, -sim, node))
    node, other, sim = node[order], other[order], sim[order]
    again = np.concatenate([[False], (node[1:] == node[:-1]) & (other[1:] == other[:-1])]) if len(node) else np.empty(0, bool)
    node, other, sim = node[~again], other[~again], sim[~again]
    starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
    rank = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    return node[rank < most], other[rank < most], sim[rank < most]


def _directions(table: int, bits: int, width: int) -> np.ndarray:
    """The random directions of a table: one for each bit of the code, one for the order."""
    return np.random.default_rng(table).standard_normal((width, bits + 1)).astype(np.float32)


LISTS_DDL = "node long, embedding array<float>, others array<long>, sims array<float>, code long, at float"


def _placed(node: np.ndarray, x: np.ndarray, others: np.ndarray, sims: np.ndarray, centre: np.ndarray, table: int, bits: int) -> pa.RecordBatch:
    """Nodes with their lists, and where the table's directions put them."""
    along = (x - centre) @ _directions(table, bits, x.shape[1])
    code = ((along[:, :bits] > 0) << np.arange(bits)).sum(1)

    def lists(values: np.ndarray) -> pa.Array:
        n, k = values.shape
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.array(values.ravel()))

    columns = [pa.array(node, pa.int64()), lists(x), lists(others), lists(sims), pa.array(code, pa.int64()), pa.array(along[:, bits], pa.float32())]
    return pa.RecordBatch.from_arrays(columns, names=["node", "embedding", "others", "sims", "code", "at"])


def _improved(node: np.ndarray, x: np.ndarray, others: np.ndarray, sims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists of nodes after comparing all of them with each other. Unused places hold -1."""
    degree = others.shape[1]
    own = x @ x.T
    np.fill_diagonal(own, -np.inf)
    k = min(degree, len(node) - 1)
    if k < 1:
        return others, sims
    near = np.argpartition(-own, k - 1, axis=1)[:, :k]
    found, values = node[near], np.take_along_axis(own, near, 1)
    values[(found[:, :, None] == others[:, None, :]).any(2)] = -np.inf
    both, values = np.concatenate([others, found], 1), np.concatenate([sims, values], 1)
    best = np.argpartition(-values, degree - 1, axis=1)[:, :degree]
    both, values = np.take_along_axis(both, best, 1), np.take_along_axis(values, best, 1)
    return np.where(np.isneginf(values), -1, both), values


def first_graph(nodes: DataFrame, count: int, degree: int = DEGREE, tables: int = TABLES, leaf: int = LEAF) -> DataFrame:
    """Neighbours among nodes that lie on the same sides of random directions, table after table.

    A node carries its list from table to table, so a table is one shuffle of the nodes. A side with
    more than a leaf of nodes is cut along one more direction. Returns node, other, sim."""
    spark = nodes.sparkSession
    width = nodes.select(F.max(F.size("embedding"))).first()[0] or 1
    sums = nodes.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).collect()  # a row a dimension
    centre = np.zeros(width, np.float32)
    for r in sums:
        centre[r["i"]] = r["x"] / max(count, 1)
    bits = max(0, (max(count, 1) // leaf).bit_length())

    def filled(column: pa.Array) -> np.ndarray:
        x = _matrix(column).astype(np.float32)
        return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n = part.num_rows
                none = np.full((n, degree), -1, np.int64), np.full((n, degree), -np.inf, np.float32)
                yield _placed(part.column(0).to_numpy(), filled(part.column(1)), *none, centre, 0, bits)

    def compare(table: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def close(rows: pa.Table) -> pa.RecordBatch:
                rows = rows.combine_chunks()
                node = rows.column("node").to_numpy()
                x, others, sims = (_matrix(rows.column(c).combine_chunks()) for c in ("embedding", "others", "sims"))
                return _placed(node, x, *_improved(node, x, others, sims), centre, table + 1, bits)

            rest = None
            for batch in batches:
                rows = pa.Table.from_batches([batch])
                rest = rows if rest is None else pa.concat_tables([rest, rows])
                while rest is not None:
                    code = rest.column("code").to_numpy()
                    same = int(np.searchsorted(code, code[0], "right"))
                    if same == len(code) and same < 2 * leaf:
                        break  # its rows may go on
                    take = leaf if same >= 2 * leaf else same
                    yield close(rest.slice(0, take))
                    rest = rest.slice(take) if take < len(code) else None
            if rest is not None:
                yield close(rest)

        return run

    state = nodes.select("node", "embedding").mapInArrow(start, LISTS_DDL)
    for table in range(tables):
        state = state.repartition(partitions(spark), "code").sortWithinPartitions("code", "at").mapInArrow(compare(table), LISTS_DDL)
        if table % 5 == 4:
            state = written(state, "lists")
    pairs = state.select("node", F.explode(F.arrays_zip("others", "sims")).alias("e"))
    return pairs.select("node", F.col("e.others").alias("other"), F.col("e.sims").cast("double").alias("sim")).where("other >= 0 or sim > -1e300")


def _nearest(edges: DataFrame, most: int, by: str = "node") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("sim"), "other"))
    return edges.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def descend(graph: DataFrame, nodes: DataFrame, round_: int, degree: int = DEGREE, joined: int = JOINED) -> DataFrame:
    """One round: what neighbours of a node find in each other, merged into the graph (node, other, sim, new)."""
    drawn = F.row_number().over(Window.partitionBy("node", "new").orderBy(F.xxhash64(F.lit(round_), "node", "other")))
    reverse = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "new")
    ways = [edges.withColumn("n", drawn).where(F.col("n") <= joined).drop("n") for edges in (graph.select("node", "other", "new"), reverse)]
    both = ways[0].unionByName(ways[1]).groupBy("node", "other").agg(F.max("new").alias("new"))
    least = graph.groupBy("node").agg(F.when(F.count("*") >= degree, F.min("sim")).otherwise(float("-inf")).alias("least"))
    known = nodes.select("node", "embedding").join(least, "node").withColumnRenamed("node", "other")
    around = both.join(known, "other").repartition(partitions(graph.sparkSession), "node").sortWithinPartitions("node")
    schema = ("node", "other", "new", "embedding", "least")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[np.ndarray]] = []

        def close(ids: np.ndarray, new: np.ndarray, least: np.ndarray, x: np.ndarray) -> None:
            if len(ids) < 2 or not new.any():
                return
            sims = x @ x.T
            fits = (new[:, None] | new[None, :]) & (sims > least[:, None])
            np.fill_diagonal(fits, False)
            a, b = np.nonzero(fits)
            found.append([ids[a], ids[b], sims[a, b]])

        def give() -> Iterator[pa.RecordBatch]:
            if found:
                yield _batch(*_best(*(np.concatenate(x) for x in zip(*found, strict=True)), degree))
                found.clear()

        def each(table: pa.Table, ended: bool) -> pa.Table | None:
            """Joins the neighbours of every node but the last, whose rows may go on, and gives that back."""
            table = table.combine_chunks()
            own, ids, least = (table.column(c).to_numpy() for c in ("node", "other", "least"))
            new, x = table.column("new").to_numpy().astype(bool), _matrix(table.column("embedding").combine_chunks())
            starts = [*np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])).tolist(), *([len(own)] if ended else [])]
            for a, z in zip(starts, starts[1:], strict=False):
                close(ids[a:z], new[a:z], least[a:z], x[a:z])
            return None if ended else table.slice(starts[-1])

        rest = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                table = pa.Table.from_batches([batch.slice(at, 4096)])
                rest = each(table if rest is None else pa.concat_tables([rest, table]), False)
                if sum(len(f[0]) for f in found) > 1_000_000:
                    yield from give()
        if rest is not None:
            each(rest, True)
        yield from give()

    offered = around.select(*schema).mapInArrow(join, EDGE_DDL).withColumn("new", F.lit(True))
    # What was drawn is new no longer.
    kept = graph.withColumn("n", drawn).withColumn("new", F.col("new") & (F.col("n") > joined)).drop("n")
    merged = kept.unionByName(offered)
    merged = merged.groupBy("node", "other").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return written(_nearest(merged, degree), "graph")


def neighbour_graph(nodes: DataFrame, degree: int = DEGREE, left_new: float = LEFT_NEW, tables: int = TABLES, leaf: int = LEAF) -> DataFrame:
    """The graph of nodes (node, embedding): node, other, sim, new. Rounds end when the share of new
    neighbours is at most ``left_new``; each one replaces neighbours by nearer ones, so they do end."""
    graph = written(first_graph(nodes, nodes.count(), degree, tables, leaf).withColumn("new", F.lit(True)), "graph")
    round_, share = 0, 1.0
    while share > left_new:
        graph = descend(graph, nodes, round_, degree)
        round_, share = round_ + 1, graph.agg(F.avg(F.col("new").cast("int"))).first()[0] or 0.0
    return graph


def inner_product(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double"), F.lit(0.0)) * F.coalesce(y.cast("double"), F.lit(0.0))), F.lit(0.0), lambda x, y: x + y
    )


def search(graph: DataFrame, nodes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """Greedy search for the nearest nodes of queries (node): node, other, sim, for at least ``k`` others
    each where the graph has as many. Ends when every node among a query's best ``k`` was followed."""
    edges = graph.select("node", "other")
    wanted = nodes.select("node", "embedding")
    asked = queries.join(wanted, "node").select("node", F.col("embedding").alias("asked"))
    found = graph.join(queries, "node", "left_semi").select("node", "other", "sim", F.lit(False).alias("done"))
    while True:
        follow = written(_nearest(found, k).where("not done").select("node", "other"), "follow")
        if follow.isEmpty():
            break
        reached = follow.join(edges.select(F.col("node").alias("other"), F.col("other").alias("next")), "other")
        reached = reached.select("node", F.col("next").alias("other")).where("node <> other").distinct().join(found.select("node", "other"), ["node", "other"], "left_anti")
        measured = reached.join(wanted.withColumnRenamed("node", "other"), "other").join(asked, "node")
        measured = measured.select("node", "other", inner_product("asked", "embedding").alias("sim"), F.lit(False).alias("done"))
        rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("sim"), "other"))
        marked = found.withColumn("done", F.col("done") | (rank <= k))  # those that were followed now
        # Beyond the best, nodes are never followed; they are remembered so as not to be measured again.
        found = written(marked.unionByName(measured), "found")
    return _nearest(found.select("node", "other", "sim"), k)


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = K, tables: int = TABLES, leaf: int = LEAF) -> DataFrame:
    """The ``k`` nearest rows of each query row by the inner product, itself left out.

    ``vectors`` has vec_id and embedding, ``is_query`` chooses rows by vec_id. Returns query_id, rank
    (from 1), vec_id and score (the inner product in double precision): nearest first, ties to the
    smaller vec_id; fewer where there are fewer candidates. Rows without vec_id, and vectors that are
    null, empty, zero or hold null or non-finite components, take no part. Of several vectors with one id
    the smallest counts. Shorter vectors count as filled up with zeros. Other columns are left out.
    """
    rows = written(usable(vectors), "vectors")
    nodes = written(classes(rows, k + 1), "nodes")
    # Single precision finds the nodes; what is found is measured in double precision.
    light = written(nodes.select("node", F.col("embedding").cast("array<float>").alias("embedding")), "light")
    graph = neighbour_graph(light, tables=tables, leaf=leaf)
    asked = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")
    asked = written(asked.join(nodes.select("embedding", "node"), "embedding").select("query_id", "node"), "asked")
    queries = asked.select("node").distinct()
    found = search(graph, light, queries, max(DEGREE, k + 4)).select("node", "other")
    # A query's node is a candidate too: other rows may have the same vector.
    pairs = found.unionByName(queries.select("node", F.col("node").alias("other")))
    exact = pairs.join(nodes.select("node", F.col("embedding").alias("asked")), "node").join(nodes.withColumnRenamed("node", "other"), "other")
    exact = exact.select("node", inner_product("asked", "embedding").alias("score"), "members")
    # A node stands for its smallest members; k + 1 of them are enough, as one may be the query itself.
    members = asked.join(exact, "node").select("query_id", "score", F.explode("members").alias("vec_id")).where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return members.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
