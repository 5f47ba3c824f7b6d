"""Vectors: exact top-k by the threshold algorithm, and an exact range join over pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import components, forest, materialise, trim

SCALE, TOP_K, QUERY_STEP = 1024, 10, 100
#: Candidates and queries of one task.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 2048
#: Rows that can be scored one after another in the time that one entry of a list takes, and the row that it leads to.
ENTRY_COST = 4


def usable(x: Column) -> Column:
    """The vector is not null, and all its components are finite numbers."""
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(x.isNotNull() & good, F.lit(False))


def _dense(column: pa.Array, kind: type) -> np.ndarray:
    """Rows of equally long lists as a matrix."""
    flat = np.asarray(column.flatten(), kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


class SortedLists:
    """One block's integer vectors with a list of rows for each dimension, best first."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        lists = np.argsort(-self.x, axis=0, kind="stable")  # by dimension: rows from the largest component down
        self.sorted = np.ascontiguousarray(np.take_along_axis(self.x, lists, 0).T)
        self.lists = np.ascontiguousarray(lists.T)
        self.spread = self.x.std(axis=0) if len(x) else np.zeros(x.shape[1])

    def top(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """The k best (vec_id, score) for query q, its own id left out, ties to smaller ids; and the rows scored.

        All lists are read down together, each as fast as its dimension can move a score (the
        query's component times the list's spread), in steps that double. The rows met are scored whole. What is
        not met stands in every list behind the frontier and cannot score more than the sum of the
        frontier's products; the search ends when the kth score is above that bound, or all rows are met.
        Once so many entries have been read that they have cost as much as all rows (ENTRY_COST), those not
        met yet are scored at once.
        """
        n = len(self.x)
        use = np.flatnonzero(q)
        if not n or not len(use):  # all scores are 0
            rows = np.flatnonzero(self.ids != own)[:k]
            return self.ids[rows], np.zeros(len(rows), self.x.dtype), n
        w, down = q[use], q[use] > 0
        rate = np.maximum(np.abs(w) * self.spread[use], 1e-9)
        rate = rate / rate.max()
        rows, scores = np.empty(0, np.int64), np.empty(0, self.x.dtype)
        met, depth, entries = np.zeros(n, bool), np.zeros(len(use), np.int64), 0
        step = max(4 * k, 64) / rate.sum()
        while True:
            reach = np.minimum(n, np.ceil(step * rate - 1e-9).astype(np.int64))
            many = reach - depth
            of = np.repeat(np.arange(len(use)), many)
            at = depth[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            new = self.lists[use[of], np.where(down[of], at, n - 1 - at)]
            depth, entries = reach, entries + len(of)
            last = entries >= n / ENTRY_COST
            if last:
                new = np.flatnonzero(~met & (self.ids != own))
                found = (self.x @ q)[new]  # in place: rows lie one after another
                if len(new) > k:
                    enough = np.partition(found, -k)[-k]
                    new, found = new[found >= enough], found[found >= enough]
                met[:] = True
            else:
                new = np.unique(new[~met[new]])
                met[new] = True
                new = new[self.ids[new] != own]
                found = self.x[new] @ q
            rows, scores = np.r_[rows, new], np.r_[scores, found]
            best = np.lexsort((self.ids[rows], -scores))[:k]
            rows, scores = rows[best], scores[best]
            if last:
                break
            if len(rows) == k:
                front = np.minimum(depth, n - 1)
                if scores[-1] > self.sorted[use, np.where(down, front, n - 1 - front)] @ w:
                    break
            step *= 2
        return self.ids[rows], scores, int(met.sum())


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES, reads: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest integer inner products for each query row.

    Components become floor(scale * x). Rows meet queries in blocks: a task holds block_rows
    candidates and block_queries queries, both dealt by a hash of vec_id, runs the threshold
    algorithm for each query over its own sorted lists, and returns k rows a query; a window over
    the query row then keeps the best k of all blocks. Vectors of another length are compared only
    among themselves. Every candidate with the query's id is left out; candidates of one id are
    all listed. Queries of one id are answered each by itself, so their ranks stand once for each.
    With reads, rows_read tells how many candidates were scored for the query row.
    """
    def whole(df: DataFrame) -> DataFrame:
        return df.where(usable(F.col("embedding"))).select(
            "vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long")).alias("x"), F.size("embedding").alias("dims"))

    # query rows are numbered and written once, so that a task run again meets the same numbers
    rows, asks = whole(vectors), materialise(whole(queries).withColumn("ask", F.monotonically_increasing_id()))
    counted = rows.agg(F.count("*").alias("n")).first()["n"], asks.count()
    n_rows, n_asks = (max(1, -(-c // b)) for c, b in zip(counted, (block_rows, block_queries)))
    deal = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.select("dims", deal(n_rows).alias("row_block"), numbers(n_asks).alias("ask_block"), "vec_id", "x")
    right = asks.select("dims", numbers(n_rows).alias("row_block"), F.pmod(F.xxhash64("ask"), F.lit(n_asks)).cast("int").alias("ask_block"), "vec_id", "x", "ask")

    def search(key: tuple[pa.Scalar, ...], a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        if a.num_rows and b.num_rows:
            a, b = a.combine_chunks(), b.combine_chunks()
            x, asked = (_dense(t.column("x").chunk(0), np.int64) for t in (a, b))
            most = [float(np.abs(m.astype(np.float64)).max(initial=0)) for m in (x, asked)]
            kind = np.float64 if most[0] * most[1] * max(1, x.shape[1]) < 2 ** 53 else np.int64  # doubles are faster, and exact so far
            lists, asked = SortedLists(np.asarray(a.column("vec_id").chunk(0)), x.astype(kind)), asked.astype(kind)
            for q, own, ask in zip(asked, b.column("vec_id").to_pylist(), b.column("ask").to_pylist()):
                ids, scores, read = lists.top(q, own, k)
                for col, values in zip(out, ([ask] * len(ids), [own] * len(ids), ids.tolist(), scores.astype(np.int64).tolist(), [read] + [0] * (len(ids) - 1))):
                    col += values
        return pa.table([pa.array(x, pa.int64()) for x in out], names=["ask", "query_id", "vec_id", "score", "read"])

    keys = ["dims", "row_block", "ask_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "ask long, query_id long, vec_id long, score long, read long")
    best = Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "ask")
    if reads:
        total = found.groupBy("ask").agg(F.sum("read").alias("rows_read"))  # a block's count stands in its first row
        top = top.join(total, "ask")
    return top.drop("ask")


def op4(embeddings: DataFrame) -> DataFrame:
    """Top 10 for each row whose vec_id is divisible by 100, among all other rows.

    Null vectors and vectors with null or non-finite components take no part, nor do rows without
    a vec_id. Candidates of one repeated id are listed each, ties to smaller ids; query rows of one
    id are answered each, and have no candidate of that id. Fewer than 10 candidates are all
    listed; an empty table gives no rows. Other columns are not read.
    """
    vectors = embeddings.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


COSINE = 0.9
#: Distinct vectors of one cell, as a mean, and the most pivots; pivots are broadcast within that bound.
CELL_ROWS, MAX_PIVOTS = 64, 1024
#: Members of cells, and candidates, that one task compares.
HOME_ROWS, OTHER_ROWS = 12288, 16384
#: Members whose cosines with candidates are in memory at once, and rows whose distances to all pivots are.
STRIP = 256
#: Slack of distances and cosines near their limits, far above rounding.
SLACK = 1e-9


def choose_pivots(vectors: DataFrame, cells: int) -> np.ndarray:
    """Unit vectors of a bounded sample, each as far as can be from those chosen before."""
    sample = vectors.orderBy(F.xxhash64("cid"), "cid").limit(8 * cells).select("x").collect()
    x = np.array([r["x"] for r in sample])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(cells, len(x)):
        i = int(np.argmin(near))
        chosen.append(i)
        near = np.maximum(near, x @ x[i])
    return x[chosen]


class Cells:
    """Voronoi cells of unit pivots on the unit sphere, and which of them a vector must visit."""

    def __init__(self, pivots: np.ndarray, radius: float):
        self.pivots, self.radius = pivots, radius
        self.gaps = np.sqrt(np.maximum(0, 2 - 2 * pivots @ pivots.T))
        self.reach = np.full(len(pivots), 2.0)  # the largest distance of a member from its pivot

    def homes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each unit vector, that of the nearest pivot, and its distance."""
        home, own = np.zeros(len(unit), np.int64), np.zeros(len(unit))
        for i in range(0, len(unit), STRIP):
            cos = unit[i:i + STRIP] @ self.pivots.T
            home[i:i + STRIP] = np.argmax(cos, axis=1)
            own[i:i + STRIP] = np.sqrt(np.maximum(0, 2 - 2 * cos.max(axis=1)))
        return home, own

    def visits(self, unit: np.ndarray, home: np.ndarray, own: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Whether a member of each of cells may be within radius of each vector.

        A member u of q's cell has d(u, q) <= reach(q), and is at least as near to q as to the
        vector's own pivot p. By the triangle inequality a vector v within radius of u has
        d(v, q) <= reach(q) + radius and d(v, q) <= d(v, p) + 2 * radius; and its distance from the
        plane between p and q, which also separates it from u, is at most radius.
        """
        dist = np.sqrt(np.maximum(0, 2 - 2 * (unit @ self.pivots[cells].T)))
        most = np.minimum(self.reach[cells] + self.radius, own[:, None] + 2 * self.radius) + SLACK
        plane = dist ** 2 - own[:, None] ** 2 <= 2 * self.gaps[np.ix_(home, cells)] * self.radius + SLACK
        return (dist <= most) & (plane | (home[:, None] == cells))


def range_join(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Exact neighbours by cosine among distinct vectors (cid, x, weight): (cid, links, root).

    links sums the weights of the vectors linked to cid, itself left out; rows (cid, root) of one
    cid span the links that one task saw: joining them all gives the components of the graph.
    A pivot's cell holds the vectors nearest to it. Neighbouring cells make a task of up to
    HOME_ROWS members, to which every vector that one of its cells may link with goes once; there
    each cell meets those that the triangle inequality allows for it. Each vector's links are all
    seen, once, in its own cell. Tasks of more members or more than OTHER_ROWS visitors (one cell
    may hold a third of all) are cut into blocks, so that no task holds more; a task returns a row
    or two a vector, never its pairs.
    """
    radius = float(np.sqrt(2 - 2 * cosine))
    counted = {r["dims"]: r["n"] for r in vectors.groupBy(F.size("x").alias("dims")).agg(F.count("*").alias("n")).collect()}
    parts = [_range_join_of(vectors.where(F.size("x") == d), n, radius, cosine) for d, n in sorted(counted.items()) if d > 0]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "cid long, links long, root long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _near_order(pivots: np.ndarray) -> list[int]:
    """Pivots in a chain of nearest neighbours, so that cells that stand together are near each other."""
    left, order = np.ones(len(pivots), bool), [0]
    left[0] = False
    while left.any():
        cos = np.where(left, pivots @ pivots[order[-1]], -2)
        order.append(int(np.argmax(cos)))
        left[order[-1]] = False
    return order


def _range_join_of(vectors: DataFrame, n: int, radius: float, cosine: float) -> DataFrame:
    cells = Cells(choose_pivots(vectors, max(1, min(MAX_PIVOTS, -(-n // CELL_ROWS)))), radius)
    p = len(cells.pivots)

    def unit(t: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        x = _dense(t.column(t.schema.get_field_index("x")), np.float64)
        return x, x / np.linalg.norm(x, axis=1, keepdims=True)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, far = np.zeros(p, np.int64), np.zeros(p)
        for t in batches:
            if t.num_rows:
                home, own = cells.homes(unit(t)[1])
                count += np.bincount(home, minlength=p)
                np.maximum.at(far, home, own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(p)), pa.array(count), pa.array(far)], names=["cell", "members", "far"])

    members = np.zeros(p, np.int64)
    for r in vectors.select("x").mapInArrow(measure, "cell long, members long, far double").groupBy("cell").agg(F.sum("members").alias("m"), F.max("far").alias("far")).collect():
        members[r["cell"]], cells.reach[r["cell"]] = r["m"], r["far"] + SLACK
    tasks: list[list[int]] = [[]]
    for c in _near_order(cells.pivots):
        if tasks[-1] and members[tasks[-1]].sum() + members[c] > HOME_ROWS:
            tasks.append([])
        tasks[-1].append(c)
    task_cells = [np.array(sorted(t)) for t in tasks]

    def visitors(u: np.ndarray, home: np.ndarray, own: np.ndarray, task: int) -> np.ndarray:
        out = np.zeros(len(u), bool)
        for i in range(0, len(u), STRIP):
            out[i:i + STRIP] = cells.visits(u[i:i + STRIP], home[i:i + STRIP], own[i:i + STRIP], task_cells[task]).any(axis=1)
        return out

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        alls = np.zeros(len(tasks), np.int64)
        for t in batches:
            if t.num_rows:
                _, u = unit(t)
                home, own = cells.homes(u)
                alls += [int(visitors(u, home, own, k).sum()) for k in range(len(tasks))]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tasks))), pa.array(alls)], names=["task", "alls"])

    cuts = np.ones((len(tasks), 2), np.int64)  # blocks of members and of visitors, by task
    for r in vectors.select("x").mapInArrow(tally, "task long, alls long").groupBy("task").agg(F.sum("alls").alias("a")).collect():
        cuts[r["task"]] = max(1, -(-int(members[task_cells[r["task"]]].sum()) // HOME_ROWS)), max(1, -(-r["a"] // OTHER_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows packed by (task, member block, visitor block), as members or as visitors."""
        for t in batches:
            if not t.num_rows:
                continue
            x, u = unit(t)
            home, own = cells.homes(u)
            ids, weight = np.asarray(t.column(0)), np.asarray(t.column(2))
            spot = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            for c, mine in enumerate(task_cells):
                ni, nj = cuts[c].tolist()
                for member, who in ((True, np.flatnonzero(np.isin(home, mine))), (False, np.flatnonzero(visitors(u, home, own, c)))):
                    block = (spot[who] % np.uint64(ni if member else nj)).astype(np.int64)
                    for k in np.unique(block).tolist():
                        w = who[block == k]
                        raw = ids[w].tobytes(), weight[w].tobytes(), home[w].tobytes(), own[w].tobytes(), x[w].tobytes()
                        meets = [(k, j) for j in range(nj)] if member else [(i, k) for i in range(ni)]
                        yield pa.RecordBatch.from_arrays([
                            pa.array([c] * len(meets), pa.int32()), pa.array([a for a, _ in meets], pa.int32()), pa.array([b for _, b in meets], pa.int32()), pa.array([member] * len(meets)),
                            *(pa.array([r] * len(meets), pa.binary()) for r in raw)], names=["task", "i", "j", "member", "ids", "weights", "homes", "owns", "xs"])
        trim()

    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        sides = []
        flags = t.column("member").to_pylist()
        for member in (True, False):
            mine = [k for k, m in enumerate(flags) if m == member]
            read = lambda name, kind: np.concatenate([np.empty(0, kind), *(np.frombuffer(t.column(name)[k].as_py(), kind) for k in mine)])
            ids, home = read("ids", np.int64), read("homes", np.int64)
            order = np.lexsort((ids, home)) if member else np.argsort(ids)
            sides.append((ids[order], read("weights", np.int64)[order], home[order], read("owns", np.float64)[order], read("xs", np.float64).reshape(len(ids), -1)[order]))
        (a, _, home, _, xa), (b, wb, hb, ob, xb) = sides
        if not len(a) or not len(b):
            return pa.table([pa.array([], pa.int64())] * 3, names=["cid", "links", "root"])
        na, nb = np.linalg.norm(xa, axis=1), np.linalg.norm(xb, axis=1)
        mine = task_cells[key[0].as_py()]
        unit_b = xb / nb[:, None]
        visit = np.concatenate([cells.visits(unit_b[i:i + STRIP], hb[i:i + STRIP], ob[i:i + STRIP], mine) for i in range(0, len(b), STRIP)])
        links = np.zeros(len(a), np.int64)
        edges = [np.empty((0, 2), np.int64)]
        for k, c in enumerate(mine.tolist()):
            lo, hi = np.searchsorted(home, [c, c + 1])
            near = np.flatnonzero(visit[:, k])
            if lo == hi or not len(near):
                continue
            yb, ib, mb, vb = (xb, b, nb, wb) if len(near) == len(b) else (xb[near], b[near], nb[near], wb[near])
            for i in range(lo, hi, STRIP):
                j = min(hi, i + STRIP)
                own = a[i:j]
                linked = ((xa[i:j] @ yb.T) / na[i:j, None] / mb >= cosine) & (own[:, None] != ib)
                links[i:j] = linked @ vb
                # a candidate hangs on the first member it links with, and so do its other members
                hit = np.flatnonzero(linked.any(0))
                first = linked[:, hit].argmax(0)
                edges.append(np.stack([ib[hit], own[first]], 1))
                r, q = np.nonzero(linked[:, hit])
                code = np.unique(r * STRIP + first[q])
                code = code[code // STRIP != code % STRIP]
                edges.append(np.stack([own[code // STRIP], own[code % STRIP]], 1))
        node, root = forest(np.concatenate(edges))
        trim()
        return pa.table([pa.array(np.r_[a, node]), pa.array(np.r_[links, np.zeros(len(node), np.int64)]), pa.array(np.r_[a, root])], names=["cid", "links", "root"])

    packed = vectors.select("cid", "x", "weight").mapInArrow(deal, "task int, i int, j int, member boolean, ids binary, weights binary, homes binary, owns binary, xs binary")
    return packed.groupBy("task", "i", "j").applyInArrow(compare, "cid long, links long, root long")


def near_vectors(embeddings: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings.

    Equal vectors are one class, numbered and weighing its rows; classes are joined, and rows get
    their class's links and those to its other rows. A component is named by the smallest vec_id of
    all its rows. Null and zero vectors, and vectors with null or non-finite components, link with
    nothing: each is its own component. So is a row without a vec_id, which takes no part. Repeated
    rows, and rows of one vec_id, are links of one another if their vectors are. A cosine of exactly
    the limit links. Empty in, empty out; other columns are not read.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    good = F.col("vec_id").isNotNull() & usable(F.col("x")) & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    distinct = rows.where("good").groupBy("x").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight"))
    distinct = materialise(distinct.withColumn("cid", F.monotonically_increasing_id()))  # written, so numbers stay
    named = rows.where("good").select("vec_id", "x").join(distinct.select(F.col("x").alias("cx"), "cid", "weight"), F.col("x") == F.col("cx")).select("vec_id", "cid", "weight")
    seen = materialise(range_join(distinct, cosine))
    found = components(seen.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    links = seen.groupBy("cid").agg(F.sum("links").alias("links"))
    facts = distinct.select("cid", "low").join(links, "cid").join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    facts = materialise(facts)
    lows = facts.groupBy("component").agg(F.min("low").alias("component_id"))
    facts = materialise(facts.join(lows, "component").select("cid", "links", "component_id"))
    linked = named.join(facts, "cid").select("vec_id", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6(embeddings: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector; a cosine of 0.9 or more links, whatever the labels.

    Null, empty and zero vectors and those with null or non-finite components link with nothing and keep their own id; vectors of
    different lengths never link. Equal vectors link like others; repeated ids are rows of their own. Extra columns are not
    read, whatever their names. Empty in, empty out.
    """
    return near_vectors(embeddings)
