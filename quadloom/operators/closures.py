"""Closures of relations, kept as blocks that are expanded into pairs where they are read.

A closure has many more pairs than edges. Joined round by round each pair is made many times and shuffled to be told from
the known ones. Here edges are dealt by connected component, a component is closed by one task, and what is stored are
its nodes, in an order in which those that a node reaches lie side by side where they can (always in chains, trees and
cycles), and runs of positions: the pairs are distinct as they are, nothing shuffles them, and a run costs what a pair did.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadloom.plans.storage import stored

#: Components of more nodes are closed by joins; so many edges are closed by one task, without looking for components.
LOCAL_NODES, ONE_TASK = 10_000, 2_000
#: Edges (16 bytes each) whose components one task finds; more of them are contracted in rounds first.
LABELLED = 3_000_000
#: Node number at[k] reaches the many[k] nodes from number start[k] on.
BLOCKS = "msg_id long, nodes array<string>, at array<int>, start array<int>, many array<int>"


def _closer(with_edges: bool):
    """A function for mapInArrow over (part, msg_id, a, b), sorted by the first two. Nested, so that executors needn't have this package."""

    def reached(after: list[list[int]]) -> tuple[list[int], list[int]]:
        """Nodes in the order in which their strong components (Tarjan) are done, each after all it leads to, and for each node the places in it that the node reaches, as bits."""
        n = len(after)
        low, number, on, stack, masks, count, order, place = [0] * n, [0] * n, [False] * n, [], [0] * n, 0, [], [0] * n
        for root in range(n):
            if number[root]:
                continue
            count += 1
            number[root] = low[root] = count
            stack.append(root)
            on[root] = True
            work = [(root, iter(after[root]))]
            while work:
                x, todo = work[-1]
                for y in todo:
                    if not number[y]:
                        count += 1
                        number[y] = low[y] = count
                        stack.append(y)
                        on[y] = True
                        work.append((y, iter(after[y])))
                        break
                    if on[y] and number[y] < low[x]:
                        low[x] = number[y]
                else:
                    work.pop()
                    if work and low[x] < low[work[-1][0]]:
                        low[work[-1][0]] = low[x]
                    if low[x] == number[x]:
                        first = len(order)
                        while True:
                            y = stack.pop()
                            on[y] = False
                            place[y] = len(order)
                            order.append(y)
                            if y == x:
                                break
                        group, mask = order[first:], 0
                        if len(group) > 1:  # each reaches all of them
                            mask = (1 << len(order)) - (1 << first)
                        for y in group:
                            for z in after[y]:
                                if place[z] < first or z == y:
                                    mask |= 1 << place[z] | masks[z]
                        for y in group:
                            masks[y] = mask
        return order, masks

    def close(batches):
        import numpy as np
        import pyarrow as pa

        most = 1 << 20  # pairs in a block, and positions in a batch

        def blocks(msg, pairs):
            seen, after = {}, []
            for a, b in pairs:
                for x in (a, b):
                    if x not in seen:
                        seen[x] = len(after)
                        after.append([])
                after[seen[a]].append(seen[b])
            (order, masks), names, n = reached(after), list(seen), len(after)
            if not with_edges:
                place = [0] * n
                for i, x in enumerate(order):
                    place[x] = i
                for x, ys in enumerate(after):
                    for y in ys:
                        masks[x] &= ~(1 << place[y])
            names, wide, step = [names[x] for x in order], (n + 7) // 8, max(1, min(4096, most // n))
            for first in range(0, n, step):
                rows = [masks[x] for x in order[first : first + step]]
                bits = np.unpackbits(np.frombuffer(b"".join(m.to_bytes(wide, "little") for m in rows), np.uint8).reshape(len(rows), wide), axis=1, bitorder="little")
                edge = np.diff(bits.view(np.int8), axis=1, prepend=np.int8(0), append=np.int8(0))
                (at, start), end = np.nonzero(edge == 1), np.nonzero(edge == -1)[1]
                if len(at):
                    yield msg, names, (at + first).astype(np.int32), start.astype(np.int32), (end - start).astype(np.int32)

        made, size = [], 0

        def batch():
            strings = pa.array([x for r in made for x in r[1]], pa.string())
            offsets = lambda counts: pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
            runs = [pa.ListArray.from_arrays(offsets([len(r[2]) for r in made]), pa.array(np.concatenate([r[k] for r in made]))) for k in (2, 3, 4)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in made], pa.int64()), pa.ListArray.from_arrays(offsets([len(r[1]) for r in made]), strings), *runs], ["msg_id", "nodes", "at", "start", "many"])

        def groups():
            key, pairs = None, []
            for b in batches:
                columns = [b.column(i).to_pylist() for i in range(4)]
                for part, msg, x, y in zip(*columns, strict=True):
                    if (part, msg) != key:
                        if pairs:
                            yield key[1], pairs
                        key, pairs = (part, msg), []
                    pairs.append((x, y))
            if pairs:
                yield key[1], pairs

        for msg, pairs in groups():
            for block in blocks(msg, pairs):
                made.append(block)
                size += 3 * len(block[2]) + 8 * len(block[1])
                if size > most:
                    yield batch()
                    made, size = [], 0
        if made:
            yield batch()

    return close


def _labeller():
    """A function for mapInArrow over one partition of (a, b: long): (node, to), the least node of its component. Nested for the same reason."""

    def label(batches):
        import numpy as np
        import pyarrow as pa

        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not got:
            return
        x, y = (np.concatenate([g[k] for g in got]) for k in (0, 1))
        nodes, places = np.unique(np.concatenate([x, y]), return_inverse=True)
        x, y, root = places[: len(x)], places[len(x) :], np.arange(len(nodes))
        while True:
            x, y = root[x], root[y]
            x, y = np.minimum(x, y)[x != y], np.maximum(x, y)[x != y]
            if not len(x):
                break
            np.minimum.at(root, y, x)
            while not np.array_equal(to := root[root], root):
                root = to
        for i in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[i : i + (1 << 16)]), pa.array(nodes[root[i : i + (1 << 16)]])], ["node", "to"])

    return label


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: long) -> (node, part), a label of the connected component of each node that is on an edge to another.

    Each round sends every node to the least of its closed neighbourhood by a hash of the round, so that a share of the
    nodes goes per round whatever the shape, until one task can label the rest; labels are then read from the last round back.
    """
    least_first = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    now = stored(edges.where("a <> b").select(*least_first("a", "b")), "part-edges")
    moves = []
    while now.count() > LABELLED:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = lambda c, n=len(moves): F.struct(F.xxhash64(c, F.lit(n)).alias("h"), F.col(c).alias("n"))
        least = both.groupBy("a").agg(F.min(key("b")).alias("m"))
        move = stored(least.select(F.col("a").alias("node"), F.least(F.col("m"), key("a"))["n"].alias("to")), "part-move")
        moves.append(move)
        met = now.join(move.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(move.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        now = stored(met.where("ta <> tb").select(*least_first("ta", "tb")).distinct(), "part-edges")
    part = stored(now.repartition(1).mapInArrow(_labeller(), "node long, to long"), "parts").withColumnRenamed("to", "part")
    for move in reversed(moves):
        part = stored(move.join(part.withColumnRenamed("node", "to"), "to", "left").select("node", F.coalesce("part", "to").alias("part")), "parts")
    return part


def closed_blocks(edges: DataFrame, with_edges: bool = True) -> tuple[DataFrame, DataFrame | None]:
    """Distinct edges (msg_id, a, b), stored -> (blocks of their closure, edges of the components that are too large for a task)."""
    total, large = edges.count(), None
    if total <= ONE_TASK:
        dealt = edges.select(F.lit(0).cast("long").alias("part"), "msg_id", "a", "b").repartition(1)
        return stored(dealt.sortWithinPartitions("part", "msg_id").mapInArrow(_closer(with_edges), BLOCKS), "closed"), None
    # Nodes go by 64-bit hashes: if two share one, their components are only closed by the same task.
    node = lambda c: F.xxhash64("msg_id", c)
    parts = components(edges.select(node("a").alias("a"), node("b").alias("b")))
    over = stored(parts.groupBy("part").count().where(F.col("count") > LOCAL_NODES).select("part"), "parts")
    dealt = edges.withColumn("node", node("a")).join(parts, "node", "left").select(F.coalesce("part", "node").alias("part"), "msg_id", "a", "b")
    if not over.isEmpty():
        large = stored(dealt.join(over, "part", "left_semi").select("msg_id", "a", "b"), "paths")
        dealt = dealt.join(over, "part", "left_anti")
    cores = edges.sparkSession.sparkContext.defaultParallelism
    tasks = min(10_000, max(cores, total // 20_000 + 1))
    made = dealt.repartition(tasks, "part").sortWithinPartitions("part", "msg_id").mapInArrow(_closer(with_edges), BLOCKS)
    # Blocks, which are small, are dealt anew, and so are the pairs of a few large components.
    return stored(made.repartition(max(tasks, 8 * cores)), "closed"), large


def expanded(blocks: DataFrame) -> DataFrame:
    """blocks -> the pairs (msg_id, a, b)."""
    runs = blocks.select("msg_id", "nodes", "start", "many", F.posexplode("at").alias("k", "i"))
    # Generated code holds all rows that it makes of one of its own: pairs of a run, not of a block, for Spark generates no
    # code for transform(). No run is empty; for explode() Spark would make each slice twice more, to drop empty ones.
    bs = F.transform(F.slice("nodes", F.col("start")[F.col("k")] + 1, F.col("many")[F.col("k")]), lambda b: b)
    return runs.select("msg_id", F.col("nodes")[F.col("i")].alias("a"), bs.alias("bs")).select("msg_id", "a", F.explode_outer("bs").alias("b"))


def closed(pairs: DataFrame, with_edges: bool = True, max_rounds: int = 64) -> DataFrame:
    """(msg_id, a, b) closed under composition, each pair once; with_edges: the given pairs, too, and not only what follows."""
    return closed_pairs(stored(pairs.select("msg_id", "a", "b").distinct(), "paths"), with_edges, max_rounds)


def closed_pairs(edges: DataFrame, with_edges: bool = True, max_rounds: int = 64) -> DataFrame:
    """The same for edges that are distinct and stored."""
    blocks, large = closed_blocks(edges, with_edges)
    if large is None:
        return expanded(blocks)
    more = doubled(large, max_rounds)
    return expanded(blocks).unionByName(more if with_edges else more.join(large, ["msg_id", "a", "b"], "left_anti"))


def doubled(known: DataFrame, max_rounds: int = 64) -> DataFrame:
    """Closure of distinct pairs by joins that double the paths: rounds are the logarithm of the longest."""
    delta = known
    for _ in range(max_rounds):
        left = delta.withColumnRenamed("b", "m").join(known.withColumnRenamed("a", "m"), ["msg_id", "m"]).select("msg_id", "a", "b")
        right = known.withColumnRenamed("b", "m").join(delta.withColumnRenamed("a", "m"), ["msg_id", "m"]).select("msg_id", "a", "b")
        delta = stored(reduce(DataFrame.unionByName, [left] if delta is known else [left, right]).distinct().join(known, ["msg_id", "a", "b"], "left_anti"), "paths")
        if delta.isEmpty():
            return known
        known = known.unionByName(delta)
    raise RuntimeError(f"paths did not converge in {max_rounds} rounds")


def squares(members: DataFrame, group: list[str]) -> DataFrame:
    """Rows of `group` (with msg_id) and node, each once -> the pairs (msg_id, a, b) of each group, a node with itself, too.

    Groups are cut into tiles, and every tile meets every other of its group: tasks get even shares of the largest groups.
    """
    members = stored(members.select(*group, "node"), "members")
    tiled = members.join(members.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / 512).alias("tiles")), group).withColumn("tile", F.pmod(F.xxhash64("node"), "tiles"))
    tiles = stored(tiled.groupBy(*group, "tile").agg(F.collect_list("node").alias("nodes")), "tiles")
    met = tiles.select(*group, F.col("nodes").alias("left")).join(tiles.select(*group, F.col("nodes").alias("right")), group)
    tasks = min(10_000, max(members.sparkSession.sparkContext.defaultParallelism, members.count() // 2_000))
    met = stored(met.select("msg_id", "left", "right").repartition(tasks), "tiles")
    return met.select("msg_id", F.explode("left").alias("a"), "right").select("msg_id", "a", F.explode("right").alias("b"))
