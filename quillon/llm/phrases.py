"""Phrase collocations by Suffix-sigma: sorted truncated suffixes, all prefixes counted by one stack.

1. Every word of a piece of text begins a suffix of at most MAX_WORDS words. Equal suffixes of a batch are
   added up before they are shuffled.
2. Suffixes are dealt by ranges of (language, words), so that those with one first word lie together, and a
   frequent first word, pair or longer beginning is split at its next words. Ranges come from a bounded
   sample; they decide where rows go, never what is counted.
3. Each range is sorted in reverse order by Spark, which spills, and read as a stream: the words that a
   suffix shares with the one before stay on the stack, the others are counted and leave it. Only beginnings
   at a range's edges may go on in the next range; their parts are added up.
4. Parts of a phrase are looked up by joins on (language, phrase) among the frequent ones.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import discard, guarded, materialise, shuffle_width, small_batches, trim
from quillon.llm.words import FOLD, LOWER, mix

MAX_WORDS, LEAST, MOST = 5, 100, 2000
#: Bytes that end a piece, and those that end a word.
STOPS = np.zeros(256, bool)
STOPS[list(b".,;:!?\n\x0b\x0c\r")] = True
GAPS = STOPS.copy()
GAPS[[9, 32]] = True
#: Words are kept in lower case and with line feed, which no word has, in place of the zero byte. The zero byte
#: then divides the words of a suffix, and byte order is the order of word sequences.
CODE = LOWER.copy()
CODE[0] = 10
PLAIN = {0: " ", 10: "\0"}
#: Bytes of text whose equal suffixes are added up before the shuffle, and words that are handled at once.
FLUSH_BYTES, FLUSH_WORDS = 8 << 20, 1 << 21
#: Sampled suffixes for each range, and of one batch.
SAMPLED, SAMPLED_BATCH = 64, 256
#: Ranges for each shuffle partition: suffixes take several times the room of their text.
RANGES = 3
#: Rows of a batch that goes to Spark.
ROWS = 1 << 15


class Suffixes:
    """Words of texts, and how many follow each in its piece."""

    def __init__(self, texts: pa.LargeStringArray):
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        head = np.zeros(len(data) + 1, bool)
        head[offsets - offsets[0]] = True
        gap = GAPS[data]
        begin = ~gap
        begin[1:] &= gap[:-1] | head[1:-1]
        starts = np.flatnonzero(begin)
        piece = np.cumsum(STOPS[data] | head[:-1])[starts]
        widths = np.diff(np.r_[np.cumsum(~gap)[starts] - 1, np.count_nonzero(~gap)]) if len(starts) else np.zeros(0, np.int64)
        offsets = np.r_[0, np.cumsum(widths)].astype(np.int64)
        self.words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(CODE[data[~gap]]))
        ends = np.r_[np.flatnonzero(np.diff(piece)) + 1, len(piece)]
        at = np.arange(len(piece))
        self.size = np.minimum(ends[np.searchsorted(ends, at, "right")] - at, MAX_WORDS) if len(piece) else at

    def __len__(self) -> int:
        return len(self.size)

    def spelled(self, i: int) -> bytes:
        return "\0".join(self.words[i:i + int(self.size[i])].to_pylist()).encode("utf-8", "surrogatepass")

    def some(self, most: int) -> list[bytes]:
        """At most so many of the distinct suffixes, each with the same chance: those of the smallest hashes."""
        ids = np.r_[self.words.dictionary_encode().indices.to_numpy().astype(np.uint64) + np.uint64(1), np.zeros(MAX_WORDS, np.uint64)]
        h = np.zeros(len(self), np.uint64)
        for k in range(MAX_WORDS):
            h = mix(h * FOLD + np.where(self.size > k, ids[k:k + len(self)], np.uint64(0)))
        low = np.flatnonzero(h <= np.partition(h, min(8 * most, len(h) - 1))[min(8 * most, len(h) - 1)])
        if len(np.unique(h[low])) < most:  # suffixes that repeat often
            low = np.arange(len(h))
        _, at = np.unique(h[low], return_index=True)
        return [self.spelled(i) for i in low[at[:most]].tolist()]

    def counted(self, first: int, last: int) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
        """The suffixes that begin at words first to last: sorted words, distinct rows of their numbers (0: none), counts.

        Words are numbered from 1 in byte order, and rows are sorted.
        """
        own = self.words[first:min(last + MAX_WORDS - 1, len(self))].dictionary_encode()
        order = pc.sort_indices(own.dictionary).to_numpy()
        number = np.empty(len(order), np.int32)
        number[order] = np.arange(1, len(order) + 1)
        ids = np.r_[number[own.indices.to_numpy()], np.zeros(MAX_WORDS, np.int32)]
        n, base = last - first, np.int64(len(order) + 1)
        rows = np.empty((n, MAX_WORDS), np.int32)
        for k in range(MAX_WORDS):
            rows[:, k] = np.where(self.size[first:last] > k, ids[k:k + n], 0)
        keys = [rows[:, k] * base + rows[:, k + 1] if k + 1 < MAX_WORDS else rows[:, k] for k in range(0, MAX_WORDS, 2)]
        by = np.lexsort(keys[::-1])
        new = np.zeros(n, bool)
        new[:1] = True
        for key in keys:
            new[1:] |= np.diff(key[by]) != 0
        at = np.flatnonzero(new)
        return own.dictionary.take(pa.array(order)), rows[by[at]], np.diff(np.r_[at, n])


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.LargeStringArray]]:
    """Texts of one language from neighbouring rows (lang, text), about FLUSH_BYTES together or one longer text."""
    held, size = defaultdict(list), 0
    for b in batches:
        column = b.column(1).cast(pa.large_string())
        width = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0), np.int64))
        cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(width // FLUSH_BYTES)) + 1, len(column)]) if len(column) else [0]
        for i, j in zip(cuts[:-1], cuts[1:]):
            langs, part = b.column(0)[i:j].dictionary_encode(), column[i:j]
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                held[lang].append(part.filter(pc.equal(langs.indices, k)))
            size += int(width[j - 1] - (width[i - 1] if i else 0))
            if size >= FLUSH_BYTES:
                yield from ((lang, pa.concat_arrays(parts)) for lang, parts in held.items())
                held, size = defaultdict(list), 0
    yield from ((lang, pa.concat_arrays(parts)) for lang, parts in held.items())


def _named(lang: str) -> str:
    """A language as the first word of a suffix: without zero bytes."""
    return lang.replace("\x01", "\x01\x01").replace("\0", "\x01\x02")


def _unnamed(word: str) -> str:
    return re.sub("\x01([\x01\x02])", lambda m: "\0" if m[1] == "\x02" else "\x01", word)


def bounds(texts: DataFrame, ranges: int) -> list[tuple[bytes, ...]]:
    """Least (language, words) of every range but the first, in order, from a sample that grows with ranges alone."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, part in _by_language(batches):
            s = Suffixes(part)
            if len(s):
                some = [f"{_named(lang)}\0".encode() + x for x in s.some(SAMPLED_BATCH)]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()), pa.array(np.random.default_rng(len(s)).random(len(some)))], names=["suffix", "u"])
        trim()

    found = materialise(texts.mapInArrow(sample, "suffix binary, u double"))
    share = SAMPLED * ranges / max(1, found.count())
    known = sorted(tuple(bytes(r[0]).split(b"\0")) for r in found.where(F.col("u") < share).select("suffix").collect())
    discard(found)
    return sorted({known[len(known) * k // ranges] for k in range(1, ranges)}) if known else []


def _cut(dictionary: pa.LargeStringArray, rows: np.ndarray, words: tuple[bytes, ...]) -> int:
    """How many of the sorted rows come before these words."""
    key = []
    for w in words:
        j = bisect_left(range(len(dictionary)), w, key=lambda i: dictionary[i].as_py().encode())
        there = j < len(dictionary) and dictionary[j].as_py().encode() == w
        key.append(2 * (j + 1) if there else 2 * j + 1)  # an odd number stands between two words
        if not there:
            break
    return bisect_left(range(len(rows)), (key + [0] * MAX_WORDS)[:MAX_WORDS], key=lambda i: (2 * rows[i]).tolist())


def suffixes(texts: DataFrame, edges: list[tuple[bytes, ...]]) -> DataFrame:
    """(part, suffix, n): equal suffixes of a batch added up, and the range that each belongs to. The language is the first word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts_of in _by_language(batches):
            s, name = Suffixes(texts_of), _named(lang)
            before = sum(e[0] < name.encode() for e in edges)
            own = [e[1:] for e in edges if e[0] == name.encode()]
            for first in range(0, len(s), FLUSH_WORDS):
                dictionary, rows, n = s.counted(first, min(first + FLUSH_WORDS, len(s)))
                cuts = [_cut(dictionary, rows, words) for words in own]
                part = before + np.searchsorted(np.array(cuts, np.int64), np.arange(len(rows)), "right")
                dictionary = pa.concat_arrays([dictionary, pa.array([name], pa.large_string())])
                for i in range(0, len(rows), ROWS):
                    some = np.c_[np.full(len(rows[i:i + ROWS]), len(dictionary), np.int32), rows[i:i + ROWS]]
                    flat = dictionary.take(pa.array(some[some > 0] - 1))
                    ends = np.r_[0, np.cumsum(np.count_nonzero(some, axis=1))]
                    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat), pa.scalar("\0", pa.large_string()))
                    yield pa.RecordBatch.from_arrays([pa.array(part[i:i + ROWS], pa.int32()), joined.cast(pa.string()), pa.array(n[i:i + ROWS], pa.int64())], names=["part", "suffix", "n"])
        trim()

    return texts.mapInArrow(run, "part int, suffix string, n long")


class Stack:
    """Beginnings of the last suffix with what they have counted so far: the language, then one to MAX_WORDS words more.

    A batch of sorted suffixes passes over it at once, level by level: a beginning leaves where a suffix
    shares fewer words with the one before.
    """

    def __init__(self, least: int):
        self.least, self.last = least, None
        self.open = np.zeros(MAX_WORDS + 1, np.int64)
        self.edge = np.ones(MAX_WORDS + 1, bool)  # may have begun in the range before

    def read(self, suffix: pa.Array, n: np.ndarray) -> list[tuple[str, str | None, int]]:
        """What leaves the stack: (language, words, count), or no words with all that the language counts."""
        carried = self.last is not None
        if carried:
            suffix, n = pa.concat_arrays([pa.array([self.last], suffix.type), suffix]), np.r_[0, n]
        words = pc.split_pattern(suffix, "\0")
        offsets = words.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(offsets)
        rows = np.zeros((len(suffix), MAX_WORDS + 1), np.int32)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        rows[owner, np.arange(len(owner)) - np.repeat(offsets[:-1] - offsets[0], sizes)] = words.flatten().dictionary_encode().indices.to_numpy() + 1
        shared = np.zeros(len(rows), np.int64)
        shared[1:] = np.cumprod(rows[1:] == rows[:-1], axis=1).sum(1)
        out = []
        for level in range(MAX_WORDS + 1):
            begins = np.flatnonzero(shared <= level)
            total = n.copy()
            total[0] += self.open[level] if carried else 0
            total = np.add.reduceat(total, begins)
            there = rows[begins, level] > 0
            leave = there & ((total >= self.least) | (level == 0))
            leave[0] |= there[0] and self.edge[level]
            leave[-1] = False  # the last stays
            out += [self._entry(suffix[i].as_py(), level, c) for i, c in zip(begins[leave].tolist(), total[leave].tolist())]
            self.open[level] = total[-1] if there[-1] else 0
            self.edge[level] &= len(begins) == 1
        self.last = suffix[-1].as_py()
        return out

    def finish(self) -> list[tuple[str, str | None, int]]:
        """All that is left; it may go on in the next range."""
        return [self._entry(self.last, k, int(c)) for k, c in enumerate(self.open) if c] if self.last is not None else []

    @staticmethod
    def _entry(suffix: str, level: int, n: int) -> tuple[str, str | None, int]:
        lang, *words = suffix.split("\0")
        return _unnamed(lang), "\0".join(words[:level]).translate(PLAIN) if level else None, n


def frequent(docs: DataFrame, least: int = LEAST, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, phrase, f): all phrases of up to MAX_WORDS words with a frequency of least or more, and, without phrase, all words.

    A null language is `und`; null texts are empty.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text")).where("text is not null")
    ranges = RANGES * shuffle_width(spark)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack = Stack(least)

        def table(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["lang", "phrase", "n"])

        for b in batches:
            if b.num_rows:
                yield table(stack.read(b.column(0), b.column(1).to_numpy()))
        yield table(stack.finish())
        trim()

    with small_batches(spark, 2000):
        dealt = suffixes(texts, bounds(texts, ranges)).repartitionById(ranges, "part").select("suffix", "n").sortWithinPartitions(F.desc("suffix"))
        parts = dealt.mapInArrow(count, "lang string, phrase string, n long")
        whole = parts.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where((F.col("f") >= least) | F.col("phrase").isNull())
        return materialise(whole)


def collocations(docs: DataFrame, least: int = LEAST, most: int | None = MOST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the phrases of 2 to MAX_WORDS words that hold together.

    a: the phrase's frequency in its language; l and r: those of the two parts of its weakest cut; n: all words;
    score: floor(1000 a n / (l r)) at that cut, exact (decimals of 38 digits). Phrases inside a longer
    one that is as frequent are left out: if any such longer phrase exists, one with a single word more does, as
    frequencies only fall with length. most: rows of each language (None: all).
    """
    known = frequent(docs, least)
    counts, words = known.where("phrase is not null"), guarded(materialise(known.where("phrase is null").select("lang", F.col("f").alias("n"))))
    split = F.split("phrase", " ", -1)
    candidates = materialise(counts.withColumn("words", split).where("size(words) >= 2"))
    rest = "slice(words, k + 1, size(words))"
    cut = candidates.withColumn("k", F.explode(F.expr("sequence(1, size(words) - 1)"))).select(
        "lang", "phrase", F.col("f").alias("a"), "k", F.concat_ws(" ", F.expr("slice(words, 1, k)")).alias("left"), F.concat_ws(" ", F.expr(rest)).alias("right"))
    parts = counts.select("lang", F.col("phrase").alias("part"), "f")
    left, right = parts.toDF("lang", "left", "l"), parts.toDF("lang", "right", "r")
    scored = cut.join(left, ["lang", "left"]).join(right, ["lang", "right"]).join(words, "lang").withColumn(
        "score", F.expr("(cast(a as decimal(20, 0)) * 1000 * n) div (cast(l as decimal(20, 0)) * r)"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", "n")).alias("s")).select("lang", "phrase", "s.*")
    longer = candidates.where("size(words) >= 3").select("lang", F.col("f").alias("a"), F.explode(F.array(
        F.concat_ws(" ", F.expr("slice(words, 1, size(words) - 1)")), F.concat_ws(" ", F.expr("slice(words, 2, size(words))")))).alias("phrase")).distinct()
    kept = weakest.join(longer, ["lang", "phrase", "a"], "left_anti")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    if most is not None:  # first among a share of the language's phrases, then among the winners of all shares
        share = F.pmod(F.xxhash64("phrase"), F.lit(shuffle_width(docs.sparkSession)))
        kept = kept.withColumn("share", share).withColumn("place", F.row_number().over(Window.partitionBy("lang", "share").orderBy(*order))).where(F.col("place") <= most)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return (ranked if most is None else ranked.where(F.col("rank") <= most)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first 2,000 collocations with a frequency of 100 or more.

    Null texts, empty ones and those without words add nothing; a null lang is `und`, as is the value `und`. Ties in score go to
    the greater a, then the phrase in byte order; ties between cuts to the shorter first part. Repeated rows count
    again. Long texts are read to their end, FLUSH_WORDS at a time. Empty in, empty out; other columns are not read.
    """
    return collocations(docs)


ORACLE = r"""
with d as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as ws from d),
p as (select lang, ws, unnest(range(1, len(ws) + 1)) as i from w),
g as (select lang, array_to_string(ws[i:i + k - 1], ' ') as phrase, k from p, range(1, 6) t(k) where i + k - 1 <= len(ws)),
f as (select lang, phrase, k, count(*) as f from g group by all),
n as (select lang, sum(f)::bigint as n from f where k = 1 group by lang),
c as (select lang, phrase, k as size, f as a, string_split(phrase, ' ') as ws from f where k >= 2 and f >= 100),
cuts as (select *, unnest(range(1, size)) as k from c),
s as (select x.lang, x.phrase, x.a, x.size, x.k, l.f as l, r.f as r, n.n, (1000::hugeint * x.a * n.n) // (l.f::hugeint * r.f) as score
  from cuts x join n using (lang) join f l on l.lang = x.lang and l.phrase = array_to_string(x.ws[1:x.k], ' ') join f r on r.lang = x.lang and r.phrase = array_to_string(x.ws[x.k + 1:], ' ')),
best as (select * from (select *, row_number() over (partition by lang, phrase order by score, k) as place from s) where place = 1),
inside as (select distinct lang, a, array_to_string(ws[i:i + m - 1], ' ') as phrase from c, range(1, 5) t(i), range(2, 5) u(m) where m < size and i + m - 1 <= size),
kept as (select b.* from best b where not exists (select 1 from inside i where i.lang = b.lang and i.phrase = b.phrase and 100 * i.a >= 100 * b.a))
select lang, "rank", phrase, a, l, r, n, score::bigint as score from (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase::blob) as "rank" from kept) where "rank" <= 2000
"""
