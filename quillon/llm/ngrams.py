"""N-gram Jaccard join: rare-first prefix filtering over sets of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm import bundles as B
from quillon.llm.common import components, discard, forest, free_name, guarded, materialise, quoted, release, trim
from quillon.llm.words import Words, isin_sorted, mix, run_hashes

SHINGLE = 5
#: Link if PERCENT[0] * intersection >= PERCENT[1] * union.
PERCENT = (100, 75)
#: Bits by which document frequencies are counted. Shingles that agree in them count together,
#: which may put a rare one later in the common order but never loses a link. Raise it with the
#: corpus: 12 more than the logarithm of its distinct shingles keeps such meetings rare.
KEY_BITS = 40
#: Bytes of a shingle's second hash that are kept beside the eight of the first: shingles are the same if all bits kept are.
TWIN_BYTES = 8
#: An n-gram of more classes is compared in blocks of sets instead of pair by pair; sets of one side of a block.
CROWD, BLOCK = 48, 512
ROWS = pa.schema([("kind", pa.int8()), ("doc_id", pa.int64()), ("cid", pa.binary()), ("n", pa.int32()), ("token", pa.int64()),
                  ("pos", pa.int32()), ("spread", pa.int64()), ("tokens", pa.binary())])
ROWS_DDL = "kind byte, doc_id long, cid binary, n int, token long, pos int, spread long, tokens binary"
DOCUMENT, PREFIX, SET = 0, 1, 2


class _Sets:
    """The distinct shingle sets of a bundle's documents.

    Shingles are hashed twice, by either hash of their words: the first is the shingle's token, by which sets meet; with bytes of the
    second it says whether two shingles are the same. Documents with equal sets form a class, named by the sums of both
    hashes over its set; the class is described once. set i holds both hashes of class i, sorted by the first, then the second.
    """

    def __init__(self, payload: bytes, size: int):
        t = B.unpack(payload)
        self.ids = B.column(t, "doc_id").cast(pa.int64())
        w = Words(B.column(t, "text"), lower=True)
        at, doc = w.windows(size)
        pieces, owners = [tuple(run_hashes(h, size)[at] for h in w.hashes)], [doc]
        counts = w.counts()
        for k in range(1, size):  # the whole text is its one shingle
            short = np.flatnonzero(counts == k)
            if len(short):
                pieces.append(tuple(run_hashes(h, k)[w.first[short]] for h in w.hashes))
                owners.append(short)
        h, twin, doc = (np.concatenate(x) for x in (*zip(*pieces), owners))
        order = np.lexsort((twin, h, doc))
        h, twin, doc = h[order], twin[order], doc[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (twin[1:] != twin[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
        h, twin, doc = h[new], twin[new], doc[new]
        self.n = np.bincount(doc, minlength=t.num_rows)
        ends = np.cumsum(self.n)
        total = np.zeros((2, len(h) + 1), np.uint64)
        for k, x in enumerate((h, twin)):
            np.cumsum(mix(x), out=total[k, 1:])
        name = np.stack([total[k][ends] - total[k][ends - self.n] for k in (0, 1)], 1)
        self.names = [x.tobytes() if m else None for x, m in zip(name, self.n.tolist())]
        first: dict[bytes, int] = {}
        for i, x in enumerate(self.names):
            if x is not None:
                first.setdefault(x, i)
        self.classes = list(first.values())
        self.sets = [np.stack([h[ends[i] - self.n[i]:ends[i]], twin[ends[i] - self.n[i]:ends[i]]]) for i in self.classes]

    def frequencies(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct frequency keys of all classes, sorted, and how many classes have each."""
        every = np.concatenate([x[0] for x in self.sets]) if self.sets else np.empty(0, np.uint64)
        return np.unique(every >> np.uint64(64 - KEY_BITS), return_counts=True)

    def class_names(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names of the classes (c, 2), sorted, whose they are, and where each of n buckets' names begin."""
        raw = np.frombuffer(b"".join(self.names[i] for i in self.classes), np.uint64).reshape(-1, 2)
        order = np.lexsort(raw.T[::-1])
        return raw[order], order, np.searchsorted(B.bucket_of(raw[order, 0], n), np.arange(n + 1))


def prefix_length(n: np.ndarray | int, percent: tuple[int, int] = PERCENT):
    """Tokens of a set of n, rarest first, among which two linked sets must meet."""
    a, b = percent
    return n - (n * b + a - 1) // a + 1


def _spread(tokens: np.ndarray) -> int:
    """How many tokens fall in each quarter of the hash space, 16 bits each; 65535 stands for no bound."""
    c = np.minimum(np.bincount((tokens >> np.uint64(62)).astype(np.int64), minlength=4), 65535)
    return int(np.sum(c.astype(np.uint64) << np.arange(0, 64, 16, dtype=np.uint64)).astype(np.int64))


def describe(docs: DataFrame, size: int = SHINGLE, percent: tuple[int, int] = PERCENT) -> DataFrame:
    """One table of three kinds of rows: documents with their classes, prefix tokens, and token sets.

    Every bundle sends its distinct frequency keys, packed to about three bytes each, and the names of its classes; buckets sum
    the keys and answer those that are in two classes or more with their frequency, and tell the first bundle of each class
    that it is the one to describe it, so that every class is described once. A class then
    orders its tokens by (frequency, hash), the same order everywhere, and keeps those of its
    prefix that another class may hold. A class with none such links with nothing and has no
    further rows. No group of documents is ever gathered.
    """
    n = B.tasks(docs)
    names = B.labels(n).tolist()
    number = {x: k for k, x in enumerate(names)}
    packed = B.pack(docs, n)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bundle, payload in zip(b.column(0).to_pylist(), b.column(1)):
                s = _Sets(payload.as_py(), size)
                keys, counts = s.frequencies()
                known, _, cuts = s.class_names(n)
                places = np.searchsorted(_bucket(keys, n), np.arange(n + 1))
                parts = [(names[k], _with_size(_pack_counts(keys[places[k]:places[k + 1]], counts[places[k]:places[k + 1]]), known[cuts[k]:cuts[k + 1]].tobytes()))
                         for k in np.flatnonzero(np.diff(places) + np.diff(cuts)).tolist()]
                yield from B.blocks(bundle, parts).to_batches()
        trim()

    @B.trimmed
    def answer(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        raw = [_parted(x.as_py()) for x in t.column("payload")]
        got, known = [_unpack_counts(x[0]) for x in raw], [np.frombuffer(x[1], np.uint64).reshape(-1, 2) for x in raw]
        bundles = t.column("bundle").to_numpy()
        first = _first_of(known, bundles)
        keys, counts = (np.concatenate([x[k] for x in got]) for k in (0, 1))
        order = np.argsort(keys)
        a = keys[order]
        begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][:len(a)])
        df = np.empty(len(a), np.int64)
        if len(a):  # else only names came
            df[order] = np.repeat(np.add.reduceat(counts[order], begin), np.diff(np.r_[begin, len(a)]))
        ends = np.cumsum([len(x[0]) for x in got])
        parts = []
        for bundle, x, e, mine in zip(bundles.tolist(), got, ends.tolist(), first):
            own = df[e - len(x[0]):e]
            hit = np.flatnonzero(own > 1)
            if len(hit) or mine.any():
                parts.append((bundle, _with_size(B.planes(np.diff(hit, prepend=0), 4) + B.planes(own[hit], 6), np.packbits(mine).tobytes())))
        return B.answers(key[0].as_py(), parts)

    @B.trimmed
    def finish(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return ROWS.empty_table()
        s = _Sets(left.column("payload")[0].as_py(), size)
        keys, _ = s.frequencies()
        places = np.searchsorted(_bucket(keys, n), np.arange(n + 1))
        df = np.ones(len(keys), np.int64)
        _, whose, cuts = s.class_names(n)
        first = np.zeros(len(s.classes), bool)
        for bucket, raw in zip(right.column("bucket").to_pylist(), right.column("payload")):
            k, (raw, bits) = number[bucket], _parted(raw.as_py())
            first[whose[cuts[k]:cuts[k + 1]]] = np.unpackbits(np.frombuffer(bits, np.uint8))[:cuts[k + 1] - cuts[k]].astype(bool)
            m = len(raw) // 10
            df[places[k] + np.cumsum(B.unplanes(raw[:4 * m], 4).astype(np.int64))] = B.unplanes(raw[4 * m:], 6).astype(np.int64)
        out = [pa.table([pa.array(np.full(len(s.ids), DOCUMENT, np.int8)), s.ids, pa.array(s.names, pa.binary()), pa.array(s.n, pa.int32()),
                         *(pa.nulls(len(s.ids), f.type) for f in list(ROWS)[4:])], schema=ROWS)]
        for i, both, mine in zip(s.classes, s.sets, first.tolist()):
            if not mine:
                continue
            tokens = both[0]
            own = df[np.searchsorted(keys, tokens >> np.uint64(64 - KEY_BITS))]
            m = int(prefix_length(len(tokens), percent))
            order = np.argsort(own, kind="stable")[:m]  # tokens are sorted
            pos = np.flatnonzero(own[order] > 1)
            if not len(pos):
                continue
            c, many = s.names[i], len(pos)
            spread = _spread(tokens)
            rows = lambda kind, k, token, where, kept: pa.table([
                pa.array(np.full(k, kind, np.int8)), pa.nulls(k, pa.int64()), pa.array([c] * k, pa.binary()), pa.array(np.full(k, len(tokens), np.int32)), token, where,
                pa.array(np.full(k, spread, np.int64)), kept], schema=ROWS)
            out.append(rows(PREFIX, many, pa.array(tokens[order][pos].view(np.int64)), pa.array(pos.astype(np.int32)), pa.nulls(many, pa.binary())))
            out.append(rows(SET, 1, pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.array([_packed_set(both)], pa.binary())))
        return pa.concat_tables(out).combine_chunks()

    sent = packed.mapInArrow(send, B.BLOCKS_DDL)
    counted = B.deal(sent, n, "bucket").groupBy("bucket").applyInArrow(answer, B.ANSWERS_DDL)
    return packed.groupBy("bundle").cogroup(B.deal(counted, n, "bundle").groupBy("bundle")).applyInArrow(finish, ROWS_DDL)


def _with_size(first: bytes, second: bytes) -> bytes:
    return len(first).to_bytes(8, "little") + first + second


def _parted(raw: bytes) -> tuple[bytes, bytes]:
    end = 8 + int.from_bytes(raw[:8], "little")
    return raw[8:end], raw[end:]


def _first_of(known: list[np.ndarray], bundles: np.ndarray) -> list[np.ndarray]:
    """Which of each bundle's names no bundle of a smaller number has."""
    flat, sizes = np.concatenate(known), [len(x) for x in known]
    order = np.lexsort((np.repeat(bundles, sizes), *flat.T))
    new = np.ones(len(order), bool)
    new[1:] = (flat[order[1:]] != flat[order[:-1]]).any(1)
    out = np.zeros(len(flat), bool)
    out[order] = new
    return np.split(out, np.cumsum(sizes)[:-1])


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(KEY_BITS - 24)) * np.uint64(n)) >> np.uint64(24)


def _pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    return B.planes(np.diff(keys, prepend=np.uint64(0)), 5) + B.planes(counts, 4)


def _unpack_counts(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    m = len(raw) // 9
    return np.cumsum(B.unplanes(raw[:5 * m], 5)), B.unplanes(raw[5 * m:], 4).astype(np.int64)


def _packed_set(both: np.ndarray) -> bytes:
    """A set's first hashes as they are, then byte planes of the second ones."""
    return both[0].tobytes() + B.planes(both[1], TWIN_BYTES)


def _set(raw: bytes) -> np.ndarray:
    """Both hashes of a set's shingles, (2, n), as far as they are kept."""
    n = len(raw) // (8 + TWIN_BYTES)
    return np.stack([np.frombuffer(raw[:8 * n], np.uint64), B.unplanes(raw[8 * n:], TWIN_BYTES)])


def _shared(x: np.ndarray, y: np.ndarray) -> int:
    """Shingles of two sets that agree in all bits kept."""
    both = np.concatenate([x, y], 1)
    first, second = both[:, np.lexsort(both[::-1])]
    return int(((first[1:] == first[:-1]) & (second[1:] == second[:-1])).sum())


def may_link(percent: tuple[int, int] = PERCENT, positions: bool = True) -> Column:
    """The length, positional and suffix filters on two prefix rows (na, pa, sa), (nb, pb, sb).

    An intersection of at least (na + nb) * b / (a + b) is needed. Tokens up to the shared one can
    meet only there and those after it only after it (positional); those of each quarter of the
    hash space only in their quarter (suffix, a split of the sets at three fixed places).
    """
    a, b = percent
    tests = [F.least("na", "nb") * a >= F.greatest("na", "nb") * b]
    if positions:
        most = F.least("pa", "pb") + 1 + F.least(F.col("na") - F.col("pa") - 1, F.col("nb") - F.col("pb") - 1)
        tests.append(most * (a + b) >= (F.col("na") + F.col("nb")) * b)
    quarter = [[F.shiftrightunsigned(s, 16 * k).bitwiseAND(F.lit(65535)) for k in range(4)] for s in ("sa", "sb")]
    sums = reduce(lambda x, y: x + y, [F.least(x, y) for x, y in zip(*quarter)])
    full = reduce(lambda x, y: x | y, [x == 65535 for q in quarter for x in q])
    tests.append(full | (sums * (a + b) >= (F.col("na") + F.col("nb")) * b))
    return reduce(lambda x, y: x & y, tests)


def verify(pairs: DataFrame, sets: DataFrame, percent: tuple[int, int] = PERCENT) -> DataFrame:
    """The linked pairs (a, b) among distinct candidates, by their whole token sets."""
    a_, b_ = percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = np.zeros(t.num_rows, bool)
            last, x = None, np.empty((2, 0), np.uint64)
            for i, (ra, rb) in enumerate(zip(t.column(2).to_pylist(), t.column(3).to_pylist())):
                if ra != last:
                    last, x = ra, _set(ra)
                y = _set(rb)
                shared = _shared(x, y)
                keep[i] = a_ * shared >= b_ * (x.shape[1] + y.shape[1] - shared)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(keep))
        trim()

    own = sets.select("cid", "tokens")
    joined = (pairs.join(own.select(F.col("cid").alias("b"), F.col("tokens").alias("tb")), "b")
              .join(own.select(F.col("cid").alias("a"), F.col("tokens").alias("ta")), "a").select("a", "b", "ta", "tb"))
    return joined.mapInArrow(run, "a binary, b binary")


def class_links(prefix: DataFrame, sets: DataFrame, percent: tuple[int, int] = PERCENT) -> DataFrame:
    """Links (a, b) between classes that have the same connected components as all links.

    First every class is compared with the smallest class of each of its prefix tokens: one
    candidate a row. Then only tokens whose classes are still in several components matter: their
    pairs from different components that pass the filters are compared, those of tokens of more
    than CROWD classes in blocks of sets. A pair inside one component can add no component, so
    none is lost.
    """
    side = lambda s: [F.col("cid").alias({"a": "a", "b": "b"}[s]), F.col("n").alias(f"n{s}"), F.col("pos").alias(f"p{s}"), F.col("spread").alias(f"s{s}")]
    heads = prefix.groupBy("token").agg(F.min(F.struct("cid", "n", "pos", "spread")).alias("h"), F.count("*").alias("m")).where("m > 1")
    # written out, so that the join below meets two plain shuffles and can be split at a frequent token
    heads = materialise(heads.select("token", *[F.col(f"h.{c}").alias(x) for c, x in (("cid", "a"), ("n", "na"), ("pos", "pa"), ("spread", "sa"))]))
    first = heads.join(prefix.select("token", *side("b")), "token").where("a <> b").where(may_link(percent)).select("a", "b").distinct()
    tried = materialise(first)
    links = materialise(verify(tried, sets, percent))
    release(prefix.sparkSession)
    found = components(links)
    named = prefix.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    named = materialise(named)
    mixed = named.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("token", "m")
    mixed = materialise(mixed)
    rows_of = lambda s: [*side(s), F.col("component").alias(f"c{s}")]
    few = named.join(mixed.where(F.col("m") <= CROWD), "token")
    more = (few.select("token", *rows_of("a")).join(few.select("token", *rows_of("b")), "token").where("a < b and ca <> cb").where(may_link(percent))
            .select("a", "b").distinct())
    more = materialise(more.join(tried, ["a", "b"], "left_anti"))
    crowded = named.join(mixed.where(F.col("m") > CROWD).select("token"), "token").select("token", "cid", "component")
    return links.unionByName(verify(more, sets, percent)).unionByName(crowd_links(materialise(crowded), sets, percent))


def crowd_links(crowded: DataFrame, sets: DataFrame, percent: tuple[int, int] = PERCENT) -> DataFrame:
    """Links among classes (token, cid, component) that meet on tokens of many classes.

    Such tokens belong to large groups of near copies. Classes that share one, directly or in a
    chain, form a crowd; within it every class outside the crowd's largest component is compared
    with every other class, once, in tasks of at most BLOCK by BLOCK sets. A task counts all its
    intersections by matrix products and returns links that span the components it found, at
    most one a class, so neither pairs nor a whole crowd are ever gathered.
    """
    a_, b_ = percent
    head = guarded(materialise(crowded.groupBy("token").agg(F.min("cid").alias("head"))))
    groups = components(crowded.join(head, "token").select(F.col("head").alias("a"), F.col("cid").alias("b")))
    members = crowded.select("cid", "component").distinct().join(groups.select(F.col("node").alias("cid"), F.col("component").alias("crowd")), "cid")
    members = materialise(members)
    parts = members.groupBy("crowd", "component").agg(F.count("*").alias("n"))
    facts = parts.groupBy("crowd").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("all"))
    facts = materialise(facts.select("crowd", F.col("top.component").alias("main"), F.ceil(F.col("all") / BLOCK).cast("int").alias("nj"),
                                     F.ceil((F.col("all") - F.col("top.n")) / BLOCK).cast("int").alias("ni")).where("ni > 0"))
    known = members.join(facts, "crowd").join(sets, "cid")
    spot = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = known.where("component <> main").select("crowd", spot("ni").alias("i"), every("nj").alias("j"), F.lit(True).alias("rest"), "cid", "component", "tokens")
    full = known.select("crowd", every("ni").alias("i"), spot("nj").alias("j"), F.lit(False).alias("rest"), "cid", "component", "tokens")

    @B.trimmed
    def compare(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        flags, cids, parts = (t.column(c).to_pylist() for c in ("rest", "cid", "component"))
        left, right = [k for k, f in enumerate(flags) if f], [k for k, f in enumerate(flags) if not f]
        if not left or not right:
            return pa.table([pa.array([], pa.binary())] * 2, names=["a", "b"])
        raw = t.column("tokens").to_pylist()
        x, y = [_set(raw[k]) for k in left], [_set(raw[k]) for k in right]
        nx, ny = (np.array([s.shape[1] for s in side]) for side in (x, y))
        shared = _intersections(x, y)
        differ = np.array([[parts[i] != parts[j] for j in right] for i in left])
        linked = differ & (a_ * shared >= b_ * (nx[:, None] + ny[None] - shared))
        r, c = np.nonzero(linked)
        if not len(r):
            return pa.table([pa.array([], pa.binary())] * 2, names=["a", "b"])
        number = {x: k for k, x in enumerate(dict.fromkeys(cids))}
        of = np.array([number[x] for x in cids])
        node, root = forest(np.stack([of[np.array(left)[r]], of[np.array(right)[c]]], 1))
        names = list(number)
        return pa.table([pa.array([names[k] for k in node], pa.binary()), pa.array([names[k] for k in root], pa.binary())], names=["a", "b"])

    return rest.unionByName(full).groupBy("crowd", "i", "j").applyInArrow(compare, "a binary, b binary")


def _intersections(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0/1 matrices over strips of tokens."""
    every = np.concatenate([*x, *y], 1)
    order = np.lexsort(every[::-1])
    new = np.ones(len(order), np.int64)
    new[1:] = (every[:, order[1:]] != every[:, order[:-1]]).any(0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new)
    rx, ry = (np.repeat(np.arange(len(side)), [s.shape[1] for s in side]) for side in (x, y))
    fx, fy = number[:len(rx)], number[len(rx):]
    both = np.intersect1d(fx, fy)
    hx, hy = isin_sorted(fx, both), isin_sorted(fy, both)
    fx, rx, fy, ry = np.searchsorted(both, fx[hx]), rx[hx], np.searchsorted(both, fy[hy]), ry[hy]
    out = np.zeros((len(x), len(y)), np.float64)
    for at in range(0, len(both), width):
        a, b = np.zeros((len(x), width), np.float32), np.zeros((len(y), width), np.float32)
        for m, f, r in ((a, fx, rx), (b, fy, ry)):
            on = (f >= at) & (f < at + width)
            m[r[on], f[on] - at] = 1
        out += a @ b.T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, percent: tuple[int, int] = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable by links. A text without words has an empty set
    and links with nothing; a text of fewer words than a shingle is one shingle. Null texts have no
    words. A null doc_id takes part and is never the smallest, unless all of its component are
    null; then component_id is null. Repeated rows are linked like any other. Texts of any length are read whole; other
    columns, whatever their names, are not read. Empty in, empty out.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialise(describe(docs, size, percent))
    release(spark)
    prefix = rows.where(F.col("kind") == PREFIX).select("token", "cid", "n", "pos", "spread")  # every class is described once
    sets = rows.where(F.col("kind") == SET).select("cid", "tokens")
    found = components(class_links(prefix, sets, percent))
    members = rows.where(F.col("kind") == DOCUMENT).select("doc_id", "cid", "n")
    classes = members.where("cid is not null").groupBy("cid").agg(F.min("doc_id").alias("low"))
    classes = materialise(classes.join(found.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid")))
    lows = classes.groupBy("component").agg(F.min("low").alias("component_id"))
    by_class = materialise(classes.join(lows, "component").select("cid", "component_id"))
    return members.join(by_class, "cid", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, size: int = SHINGLE, percent: tuple[int, int] = PERCENT) -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest doc_id.

    A text without words is in no group and stays. Should several rows have the kept doc_id, each
    of them stays, for its id names them all; so does a group whose ids are all null.
    """
    own, names = free_name("_id", docs), docs.columns
    keep = F.expr("doc_id <=> component_id or n_shingles = 0")
    # the ids that go are fewer than those that stay; while they are few, the texts are not shuffled
    gone = near_duplicates(docs, size, percent).groupBy(F.col("doc_id").alias(own)).agg(F.bool_or(keep).alias("_keep")).where("not _keep").select(own)
    gone = guarded(materialise(gone))
    return docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(F.col(own)), "left_anti").select(*map(quoted, names))


def op8(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: five words a shingle, a similarity of 0.75 or more.

    Null and empty texts have no shingles and link with nothing; texts of fewer than five words are one shingle. Repeated rows and
    equal texts share a component; exactly 0.75 links. Texts of any length are read whole. Extra columns are not read,
    whatever their names. Empty in, empty out.
    """
    return near_duplicates(docs)
