"""Periodic runs of words: a harmonic grid, prefix hashes and longest common extensions of all pairs at once.

A run of period q has at least 4 q words, so one of the places 0, 3 q, 6 q, ... of its document lies in it
together with the place q further on. Over all periods those grid points are harmonic: n log n / 3 a document.
Each pair of a grid point and the place a period on is extended to both sides as far as the words repeat, by a
binary search over prefix hashes that is made for all pairs of a batch of documents together. What is found
is then verified word by word, and equal stretches keep their smallest period.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm.common import trim
from quillon.llm.words import Words

#: A run repeats at least so many times, and has at least so many words.
LEAST_TIMES, LEAST_WORDS = 4, 6
#: Primes below 2 ** 31, by which prefix hashes are taken, so that products fit 64 bits.
PRIMES = (np.uint64(2**31 - 1), np.uint64(2**31 - 19))
#: Pairs of a period and a grid point that are looked at together.
PAIRS = 1 << 20
#: Bytes of text that one batch of documents has; a longer text makes a batch of its own.
BATCH_BYTES = 1 << 20
#: Words that are put together at once, for texts and for verification.
BLOCK = 1 << 16


class Prefixes:
    """Hashes of all prefixes of a sequence of 64-bit numbers, under two primes; runs of equal words hash alike."""

    def __init__(self, h: np.ndarray, attempt: int = 0):
        self.sums, self.powers = [], []
        for k, prime in enumerate(PRIMES):
            base = np.uint64(1_000_003 + 7919 * (2 * attempt + k))
            powers = np.ones(len(h) + 1, np.uint64)
            done = 1
            while done < len(powers):  # the powers known so far, times the next one
                more = min(done, len(powers) - done)
                powers[done:done + more] = powers[:more] * (powers[done - 1] * base % prime) % prime
                done += more
            terms = h % prime * powers[:-1] % prime
            self.sums.append(np.r_[np.uint64(0), np.cumsum(terms)])  # below 2 ** 64 for 2 ** 33 words
            self.powers.append(powers)

    def same(self, i: np.ndarray, shift: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the size words from i on equal those from i + shift on."""
        out = np.ones(len(i), bool)
        for prime, sums, powers in zip(PRIMES, self.sums, self.powers):
            here = (sums[i + size] - sums[i]) % prime * powers[shift] % prime
            there = (sums[i + shift + size] - sums[i + shift]) % prime
            out &= here == there
        return out


def _farthest(most: np.ndarray, holds) -> np.ndarray:
    """For each pair the largest size up to most for which holds(size), which is monotone; all are halved together."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        ok = holds(middle)
        low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
    return low


def grid(sizes: np.ndarray, starts: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, place, period) of all grid points: for each period p up to a quarter of the words, every 3 p words.

    Yields them in parts of at most `most` pairs, or of one period's.
    """
    periods = sizes // LEAST_TIMES
    for first in range(0, int(periods.sum()), most):
        flat = np.arange(first, min(first + most, int(periods.sum())))
        ends = np.cumsum(periods)
        doc = np.searchsorted(ends, flat, "right")
        period = flat - (ends - periods)[doc] + 1
        points = (sizes[doc] - period - 1) // ((LEAST_TIMES - 1) * period) + 1
        cuts = np.flatnonzero(np.diff((np.cumsum(points) - 1) // most, prepend=0))
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(flat)]):
            many = points[a:b]
            step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            d, p = np.repeat(doc[a:b], many), np.repeat(period[a:b], many)
            yield d, starts[d] + step * (LEAST_TIMES - 1) * p, p


def candidates(h: np.ndarray, starts: np.ndarray, sizes: np.ndarray, attempt: int = 0) -> np.ndarray:
    """Runs (document, start, end, period) of documents with words h[start:start + size], by hashes; places count in h.

    A stretch that several multiples of its period find is there once, with the smallest.
    """
    prefixes = Prefixes(h, attempt)
    found = []
    for doc, place, period in grid(sizes, starts):
        hit = h[place] == h[place + period]  # the first step of every search
        doc, place, period = doc[hit], place[hit], period[hit]
        first, last = starts[doc], starts[doc] + sizes[doc]
        ahead = _farthest(last - place - period, lambda size: prefixes.same(place, period, size))
        back = _farthest(place - first, lambda size: prefixes.same(place - size, period, size))
        start, end = place - back, place + period + ahead
        good = end - start >= np.maximum(LEAST_WORDS, LEAST_TIMES * period)
        found.append(_smallest_periods(np.stack([doc[good], start[good], end[good], period[good]], 1)))
    return _smallest_periods(np.concatenate(found)) if found else np.zeros((0, 4), np.int64)


def _smallest_periods(runs: np.ndarray) -> np.ndarray:
    """Of rows with one document, start and end the one with the smallest period, sorted."""
    runs = runs[np.lexsort(runs.T[::-1])]
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :3] != runs[:-1, :3]).any(1)
    return runs[new]


class Texts:
    """Words of a batch of texts, the rule that makes some of them periodic, and their runs."""

    def __init__(self, doc_ids: list, texts: pa.Array, plant: bool):
        self.words = Words(texts)
        self.raw = self.words.bytes.tobytes()
        self.sizes, self.starts = self.words.counts(), self.words.first[:-1]
        #: The word of the batch that stands at each place.
        self.at = np.arange(len(self.words))
        if plant:
            for d, (name, n) in enumerate(zip(doc_ids, self.sizes.tolist())):
                self._plant(d, name, n)

    def _plant(self, d: int, name, n: int) -> None:
        h = zlib.crc32(str(name).encode())
        g = h // 10
        if name is None or h % 10 or not n:
            return
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        i = np.arange(n - a)
        self.at[self.starts[d] + a:self.starts[d] + n] = self.starts[d] + a + i % p

    def word(self, i: int) -> bytes:
        k = self.at[i]
        return self.raw[self.words.starts[k]:self.words.ends[k]]

    def spell(self, places: np.ndarray) -> list[bytes]:
        """The words at these places."""
        k = self.at[places]
        return [self.raw[a:b] for a, b in zip(self.words.starts[k].tolist(), self.words.ends[k].tolist())]

    def repeats(self, start: int, end: int, period: int) -> bool:
        """Whether the very words repeat."""
        return all(self.spell(np.arange(i, j)) == self.spell(np.arange(i + period, j + period))
                   for i, j in ((i, min(i + BLOCK, end - period)) for i in range(start, end - period, BLOCK)))

    def runs(self) -> list[np.ndarray]:
        """Rows (start, end, period) of each document, sorted; places count in the batch.

        Equal words hash alike, so no run is missed or too short. Should different words meet in a hash,
        their document is searched again with numbers that name its words exactly, under other bases.
        """
        h = self.words.hashes[0][self.at]
        rows = candidates(h, self.starts, self.sizes)
        wrong = {int(r[0]) for r in rows.tolist() if not self.repeats(*r[1:])}
        out = [rows[a:b, 1:] for a, b in zip(np.searchsorted(rows[:, 0], np.arange(len(self.sizes))), np.searchsorted(rows[:, 0], np.arange(len(self.sizes)), "right"))]
        for d in wrong:
            out[d] = self._again(d)
        return out

    def _again(self, d: int) -> np.ndarray:
        s, n = int(self.starts[d]), int(self.sizes[d])
        names: dict[bytes, int] = {}
        exact = np.fromiter((names.setdefault(self.word(i), len(names)) for i in range(s, s + n)), np.uint64, n)
        for attempt in count(1):
            rows = candidates(exact, np.zeros(1, np.int64), np.array([n]), attempt)[:, 1:]
            if all((exact[a:b - p] == exact[a + p:b]).all() for a, b, p in rows.tolist()):
                return rows + np.array([s, s, 0])

    def text_of(self, d: int, runs: np.ndarray) -> Iterator[bytes]:
        """The document without the repeated words of its runs, in parts that are to be put together."""
        s, n = int(self.starts[d]), int(self.sizes[d])
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, runs[:, 0] + runs[:, 2] - s, 1)
        np.add.at(change, runs[:, 1] - s, -1)
        kept = s + np.flatnonzero(np.cumsum(change[:-1]) == 0)
        for i in range(0, len(kept), BLOCK):
            yield b" " * (i > 0) + b" ".join(self.spell(kept[i:i + BLOCK]))


def strongest(runs: np.ndarray) -> tuple[int, int, int]:
    """(start, length, period) of the run with the greatest exact length / period; ties to smallest start, then period."""
    length, period = runs[:, 1] - runs[:, 0], runs[:, 2]
    ratio = length / period
    near = runs[ratio >= ratio.max() * (1 - 1e-12)]
    a, b, p = min(near.tolist(), key=lambda r: (-Fraction(r[1] - r[0], r[2]), r[0], r[2]))
    return a, b - a, p


ROWS = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()),
                  ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", pa.list_(pa.list_(pa.int64()))),
                  ("collapsed", pa.string())])


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of BATCH_BYTES together, or one longer text."""
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > BATCH_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def _digest(name, base: int, d: int, texts: Texts, runs: np.ndarray, whole: bool) -> tuple:
    lines = sha256()
    for i in range(0, len(runs), BLOCK):
        lines.update(b"".join(b"%d,%d,%d\n" % (a - base, b - a, p) for a, b, p in runs[i:i + BLOCK].tolist()))
    kept, parts = sha256(), []
    for part in texts.text_of(d, runs):
        kept.update(part)
        if whole:
            parts.append(part)
    best: tuple = (None, None, None, None)
    if len(runs):
        a, length, p = strongest(runs)
        best = (a - base, length, p, 1000 * length // p)
    listed = [[a - base, b - a, p] for a, b, p in runs.tolist()] if whole else None
    return (name, len(runs), *best, lines.hexdigest(), kept.hexdigest(), listed, b"".join(parts).decode() if whole else None)


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: bool = False, whole: bool = True) -> DataFrame:
    """A row for each document: key, n_runs, the strongest run, digests, and if whole all runs and the collapsed text.

    Words are what ASCII white space divides. A run is a stretch of words with smallest period q and at least
    max(6, 4 q) words that no neighbouring word extends; `runs` holds [start, length, period] of all by start,
    then period. The collapsed text has the words that no run contains after its first q words. plant makes
    a tenth of the documents periodic first, by a hash of the key, for measurements. Null texts are empty; they and texts
    without words have no runs. Every row depends on its own text: nothing is shuffled, repeated rows give
    equal rows, a lost task is simply rerun. Memory is bounded by a batch of 1 MB, or by the longest text.
    """
    kind = docs.select(key).schema[0].dataType.simpleString()
    names = ROWS.names if whole else ROWS.names[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(1).cast(pa.large_string())
            sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]) if len(column) else np.zeros(0, np.int64)
            for i, j in _slices(sizes):
                ids = b.column(0)[i:j].to_pylist()
                texts = Texts(ids, column[i:j], plant)
                rows = [_digest(name, int(texts.starts[d]), d, texts, runs, whole) for d, (name, runs) in enumerate(zip(ids, texts.runs()))]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], ROWS.field(k).type if k else b.column(0).type) for k in range(len(names))], names=[key, *names[1:]])
        trim()

    more = ", runs array<array<long>>, collapsed string" if whole else ""
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string{more}")


def op11(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256 of every document.

    A tenth of the documents is made periodic first, as the contract says. Null and empty texts: no run, four
    nulls, digests of nothing. A null doc_id has no hash and is left as it is. Ties between runs go to the
    smallest start, then period. Empty in, empty out; other columns are not read; repeated rows give equal rows.
    """
    return periodic_runs(docs, plant=True, whole=False)


#: DuckDB has no crc32: a table of its 256 remainders, made by rule, and a fold over the digits of doc_id.
ORACLE = r"""
with recursive poly as (
  select i, 0 as k, i::ubigint as v from range(256) t(i)
  union all select i, k + 1, case when v % 2 = 1 then xor(v // 2, 3988292384::ubigint) else v // 2 end from poly where k < 8
), remainders as (select list(v order by i) as t from poly where k = 8),
crc as (
  select doc_id, 0 as k, 4294967295::ubigint as v from documents where doc_id is not null group by doc_id
  union all select doc_id, k + 1, xor(v // 256, t[(xor(v % 256, ascii(substr(doc_id::varchar, k + 1, 1))) + 1)::int]) from crc, remainders where k < length(doc_id::varchar)
), h as (select doc_id, xor(v, 4294967295::ubigint)::bigint as h from crc where k = length(doc_id::varchar)),
d as (select doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as ws, h, h // 10 as g from documents join h using (doc_id)),
s as (select *, len(ws) as n, case when h % 10 = 0 and len(ws) > 0 then g % len(ws) end as a from d),
q as (select *, 1 + (n - a) // (3 + g % 8) as p from s),
w as (select doc_id, n, i, ws[1 + case when i >= a then a + (i - a) % p else i end] as word from (select *, unnest(range(n)) as i from q)),
pairs as (select x.doc_id, y.i - x.i as p, x.i from w x join w y on x.doc_id = y.doc_id and x.word = y.word and y.i > x.i and y.i - x.i <= x.n // 4),
dense as (select doc_id, p from pairs group by all having count(*) >= 3 * p),
islands as (select doc_id, p, i, i - row_number() over (partition by doc_id, p order by i) as island from pairs semi join dense using (doc_id, p)),
found as (select doc_id, min(i) as s, max(i) + 1 + p as e, p from islands group by doc_id, p, island having count(*) + p >= greatest(6, 4 * p)),
runs as (select doc_id, s, e, min(p) as p from found group by doc_id, s, e),
best as (select * from (select *, row_number() over (partition by doc_id order by (e - s)::double / p desc, s, p) as place from runs) where place = 1),
listed as (select doc_id, count(*) as n_runs, string_agg(s || ',' || (e - s) || ',' || p || chr(10), '' order by s, p) as lines from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(s + p, e)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as collapsed from w anti join gone using (doc_id, i) group by doc_id)
select doc_id, coalesce(n_runs, 0) as n_runs, s as start, e - s as length, p as period, 1000 * (e - s) // p as exponent_milli,
  sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(collapsed, '')) as collapsed_sha256
from documents left join best using (doc_id) left join listed using (doc_id) left join kept using (doc_id)
"""
