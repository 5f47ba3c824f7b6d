"""Substring dedup: repeated runs of words, found through difference-cover anchors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import bundles as B
from quillon.llm.common import quoted, trim
from quillon.llm.words import Words, isin_sorted, run_hashes

WINDOW = 50
#: Every residue modulo 31 is a difference of two of these, so any two places have a common
#: offset below 31 at which both stand on the cover.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: no document comes after it


class _Bundle:
    """One bundle's documents: words, and the windows' hashes of 128 bits."""

    def __init__(self, payload: bytes, window: int):
        self.table = B.unpack(payload)
        self.words = Words(B.column(self.table, "text"))
        self.ids = np.asarray(B.column(self.table, "doc_id").cast(pa.int64()).fill_null(LAST))
        self.window = window

    def anchors(self, period: int, cover: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first word and document of each anchor: runs of window - period + 1 words at cover places."""
        size = self.window - period + 1
        at, doc = self.words.windows(size)
        on = np.zeros(period, bool)
        on[list(cover)] = True
        ok = on[(at - self.words.first[doc]) % period] & (self.words.counts()[doc] >= self.window)
        at, doc = at[ok], doc[ok]
        return run_hashes(self.words.hashes[0], size)[at], at, doc

    def window_hashes(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(run_hashes(h, self.window)[at] for h in self.words.hashes)


def _groups(h: np.ndarray, g: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (h, g, own), and where each (h, g) begins in it."""
    order = np.lexsort((own, g, h))
    a, b = h[order], g[order]
    return order, np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(h) else np.zeros(0, np.int64)


def shared_runs(docs: DataFrame, window: int = WINDOW, period: int = PERIOD, cover: tuple[int, ...] = COVER,
                emit=None, ddl: str = "", carry: tuple[str, ...] = ()) -> DataFrame:
    """Run emit(table, words, removed) on every bundle, where removed flags its repeated words.

    A word is removed if a window of that many words covers it whose words also start in a
    document of a smaller doc_id. Three exchanges of packed blocks, none by a document's group:

    1. anchors: every bundle sends the distinct hashes of its anchors; a bucket answers which are
       in more than one document. A window of 50 words shared by two documents holds a cover place
       of both within its first 31 words, so it contains a run of 20 words that is an anchor of both.
    2. windows: only windows around shared anchors are sent, by 128 bits, once a bundle
       with the smallest doc_id of the bundle; a bucket answers which have a smaller one elsewhere.
    3. the bundle flags its windows by the answers and by its own documents.

    Windows are compared by two 64-bit hashes with seeds of their own, folded from their words' hashes
    by a bijection that is not linear, so repeating patterns do not cancel. If both behave like
    random numbers, two of n different windows meet with a chance of n * n / 2 ** 129 (at 10 ** 13
    windows: 3e-13).
    """
    n = B.tasks(docs)
    names = B.labels(n).tolist()
    packed = B.pack(docs.select("doc_id", "text", *map(quoted, carry)), n)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bundle, payload in zip(b.column(0).to_pylist(), b.column(1)):
                h, _, doc = _Bundle(payload.as_py(), window).anchors(period, cover)
                order = np.lexsort((doc, h))
                h, doc = h[order], doc[order]
                begin = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
                many = doc[begin] != doc[np.r_[begin[1:], len(h)] - 1] if len(h) else np.zeros(0, bool)
                u = h[begin]
                places = B.cut(u, n)
                parts = []
                for k in np.flatnonzero(np.diff(places)).tolist():
                    s = slice(places[k], places[k + 1])
                    parts.append((names[k], np.int64(many[s].sum()).tobytes() + u[s][many[s]].tobytes() + u[s][~many[s]].tobytes()))
                yield from B.blocks(bundle, parts).to_batches()
        trim()

    @B.trimmed
    def answer_anchors(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        raws = [x.as_py() for x in t.column("payload")]
        hs = [np.frombuffer(x, np.uint64, offset=8) for x in raws]
        many = [np.arange(len(h)) < np.frombuffer(x, np.int64, 1)[0] for x, h in zip(raws, hs)]
        h, m = np.concatenate(hs), np.concatenate(many)
        order = np.argsort(h)
        a = h[order]
        begin = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
        wide = np.diff(np.r_[begin, len(a)]) > 1
        found = np.sort(a[begin][wide | np.logical_or.reduceat(m[order], begin)])
        sent = [(i, x[isin_sorted(x, found)]) for i, x in zip(t.column("bundle").to_pylist(), hs)]
        return B.answers(key[0].as_py(), [(i, x.tobytes()) for i, x in sent if len(x)])

    @B.trimmed
    def send_windows(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        bundle = key[0].as_py()
        if not left.num_rows or not right.num_rows:
            return B.BLOCKS.empty_table()
        w = _Bundle(left.column("payload")[0].as_py(), window)
        known = np.sort(np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in right.column("payload")]))
        h, at, doc = w.anchors(period, cover)
        hit = isin_sorted(h, known)
        at, doc = at[hit], doc[hit]
        first, end = w.words.first[doc], w.words.first[doc + 1] - window + 1
        mark = np.zeros(len(w.words) + 1, np.int64)
        np.add.at(mark, np.maximum(at - period + 1, first), 1)
        np.add.at(mark, np.minimum(at + 1, end), -1)
        starts = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        owner = np.searchsorted(w.words.first, starts, "right") - 1
        ids = w.ids[owner]
        h, g = w.window_hashes(starts)
        order, begin = _groups(h, g, ids)
        h, g, ids = h[order][begin], g[order][begin], ids[order][begin]
        places = B.cut(h, n)
        parts = [(names[k], _pack_windows(h[s], g[s], ids[s])) for k in np.flatnonzero(np.diff(places)).tolist() for s in [slice(places[k], places[k + 1])]]
        return B.blocks(bundle, parts)

    @B.trimmed
    def answer_windows(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        got = [_unpack_windows(x.as_py()) for x in t.column("payload")]
        h, g, ids = (np.concatenate([x[k] for x in got]) for k in range(3))
        src = np.repeat(np.arange(len(got)), [len(x[0]) for x in got])
        order, begin = _groups(h, g, ids)
        low = np.repeat(ids[order][begin], np.diff(np.r_[begin, len(h)]))
        late = order[ids[order] > low]
        late = late[np.argsort(src[late], kind="stable")]
        ends = np.searchsorted(src[late], np.arange(len(got) + 1))
        names = t.column("bundle").to_pylist()
        return B.answers(key[0].as_py(), [(names[i], h[s].tobytes() + g[s].tobytes()) for i in range(len(got)) for s in [late[ends[i]:ends[i + 1]]] if len(s)])

    @B.trimmed
    def finish(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        w = _Bundle(left.column("payload")[0].as_py(), window)
        return emit(w.table, w.words, _removed(w, [x.as_py() for x in right.column("payload")]))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    empty = to_arrow_schema(StructType.fromDDL(ddl)).empty_table()
    anchors = packed.mapInArrow(send_anchors, B.BLOCKS_DDL)
    shared = B.deal(anchors, n, "bucket").groupBy("bucket").applyInArrow(answer_anchors, B.ANSWERS_DDL)
    windows = packed.groupBy("bundle").cogroup(B.deal(shared, n, "bundle").groupBy("bundle")).applyInArrow(send_windows, B.BLOCKS_DDL)
    late = B.deal(windows, n, "bucket").groupBy("bucket").applyInArrow(answer_windows, B.ANSWERS_DDL)
    return packed.groupBy("bundle").cogroup(B.deal(late, n, "bundle").groupBy("bundle")).applyInArrow(finish, ddl)


def _pack_windows(h: np.ndarray, g: np.ndarray, ids: np.ndarray) -> bytes:
    return np.int64(len(h)).tobytes() + h.tobytes() + g.tobytes() + B.planes(ids.view(np.uint64), 8)


def _unpack_windows(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m = int(np.frombuffer(raw, np.int64, 1)[0])
    return np.frombuffer(raw, np.uint64, m, 8), np.frombuffer(raw, np.uint64, m, 8 + 8 * m), B.unplanes(raw[8 + 16 * m:], 8).view(np.int64)


def _removed(w: _Bundle, raws: list[bytes]) -> np.ndarray:
    """Words of a bundle covered by windows that the answers, or the bundle's own documents, call repeated."""
    at, doc = w.words.windows(w.window)
    h, g = w.window_hashes(at)
    ids = w.ids[doc]
    bad = np.zeros(len(at), bool)
    if raws:
        m = [len(x) // 16 for x in raws]
        ah = np.concatenate([np.frombuffer(x, np.uint64, k) for x, k in zip(raws, m)])
        ag = np.concatenate([np.frombuffer(x, np.uint64, k, 8 * k) for x, k in zip(raws, m)])
        order = np.lexsort((ag, ah))
        ah, ag = ah[order], ag[order]
        place = np.searchsorted(ah, h)
        open_ = np.flatnonzero(place < len(ah))
        while len(open_):  # one round, but for equal first parts
            p = place[open_]
            same = ah[p] == h[open_]
            bad[open_[same & (ag[p] == g[open_])]] = True
            open_ = open_[same & (ag[p] != g[open_])]
            place[open_] += 1
            open_ = open_[place[open_] < len(ah)]
    # within the bundle: only hashes that stand twice matter
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    twice = order[np.r_[same, False] | np.r_[False, same]] if len(h) else order
    if len(twice):
        o, begin = _groups(h[twice], g[twice], ids[twice])
        low = np.repeat(ids[twice][o][begin], np.diff(np.r_[begin, len(o)]))
        bad[twice[o[ids[twice][o] > low]]] = True
    mark = np.zeros(len(w.words) + 1, np.int64)
    np.add.at(mark, at[bad], 1)
    np.add.at(mark, at[bad] + w.window, -1)
    return np.cumsum(mark[:-1]) > 0


def kept_text(words: Words, removed: np.ndarray, i: int) -> bytes:
    """Text i without its removed words: kept runs stay as they are, joined by a space."""
    a, b = words.first[i], words.first[i + 1]
    keep = ~removed[a:b]
    edge = np.diff(np.r_[False, keep, False].astype(np.int8))
    runs = zip(words.starts[a + np.flatnonzero(edge == 1)], words.ends[a + np.flatnonzero(edge == -1) - 1])
    return b" ".join(words.bytes[s:e].tobytes() for s, e in runs)


def op7(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document; texts are judged as they came.

    Null texts have no words, and their kept words hash like the empty text. A null doc_id counts
    as the largest. Rows of one doc_id never remove each other's words. Empty in, empty out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")

    def emit(t: pa.Table, words: Words, removed: np.ndarray) -> pa.Table:
        first, data = words.first.tolist(), words.bytes.tobytes()
        offsets = words.offsets.tolist()
        gone = np.add.reduceat(np.r_[removed, False].astype(np.int64), words.first[:-1]) * (words.counts() > 0) if t.num_rows else np.zeros(0, np.int64)
        sums = []
        for i, lost in enumerate(gone.tolist()):
            ws = data[offsets[i]:offsets[i + 1]].split()
            if lost:
                ws = [x for x, r in zip(ws, removed[first[i]:first[i + 1]].tolist()) if not r]
            sums.append(hashlib.sha256(b" ".join(ws)).hexdigest())
        return pa.table([B.column(t, "doc_id"), pa.array(words.counts(), pa.int64()), pa.array(gone, pa.int64()), pa.array(sums, pa.string())],
                        names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return shared_runs(docs, emit=emit, ddl="doc_id long, n_words long, n_removed long, kept_sha256 string")


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with repeated runs cut out of text (and n_chars, if there, counted anew).

    Texts without a repeated run stay byte for byte; a document of which nothing is left goes.
    Null, empty and blank texts stay. A null doc_id counts as the largest, and rows of one doc_id
    never cut one another, so repeated rows are cut alike. Other columns, whatever their names,
    pass through. Empty in, empty out.
    """
    names = docs.columns

    def emit(t: pa.Table, words: Words, removed: np.ndarray) -> pa.Table:
        counts = words.counts()
        gone = np.add.reduceat(np.r_[removed, False].astype(np.int64), words.first[:-1]) * (counts > 0) if t.num_rows else np.zeros(0, np.int64)
        hit = np.flatnonzero(gone > 0)
        texts = B.column(t, "text").to_pylist()
        for i in hit.tolist():
            texts[i] = kept_text(words, removed, i).decode("utf-8")
        out = t.set_column(t.schema.get_field_index("text"), "text", pa.array(texts, t.schema.field("text").type))
        if "n_chars" in names:
            sizes = B.column(t, "n_chars").to_pylist()
            for i in hit.tolist():
                sizes[i] = len(texts[i])
            out = out.set_column(out.schema.get_field_index("n_chars"), "n_chars", pa.array(sizes, t.schema.field("n_chars").type))
        stay = np.ones(t.num_rows, bool)
        stay[hit] = gone[hit] < counts[hit]
        return out.select(names).filter(pa.array(stay))

    return shared_runs(docs, window=window, emit=emit, ddl=_ddl(docs.schema), carry=tuple(c for c in names if c not in ("doc_id", "text")))


def _ddl(schema) -> str:
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
