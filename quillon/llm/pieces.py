"""SentencePiece BPE encoding and decoding by vectorised merge rounds in numpy."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Encoded words that a worker keeps.
CACHE_WORDS = 300_000
#: No piece holds a space mark after another character, so merges never leave such a run.
WORDS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: A word that starts so is merged as it is; any other has a space before it.
MARKED = (SPACE, "\n")
NO_RANK = np.iinfo(np.int64).max


class PieceCoder:
    """Encodes and decodes as the library does with an identity-normalised BPE model.

    The text gets a space mark in front, its spaces become marks, and symbols start as single
    characters. In each round a pair is merged if it is the best, and of equals the leftmost,
    within reach to either side in its word, all words at once; rounds end when no word has a pair
    whose union is a piece. Characters that are no piece become their UTF-8 bytes.

    The library merges a word's best pair, one at a time. Merging all pairs that are best within
    reach gives the same: a merge from outside can only pass inwards through the one symbol that
    stands on the border, which has at most as many characters as the longest piece; what follows
    from a merge inside stays within another such length of it. With a reach of twice that length
    and one, neither meets the other before the library would come to the inner pair, so their
    order does not matter. A word within reach of itself has one merge a round.
    """

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        names = {i: sp.id_to_piece(i) for i in range(n)}
        if any(re.search(f"[^{SPACE}]{SPACE}", names[i]) for i in plain):
            raise ValueError("a piece crosses a word boundary; this coder needs a model without such pieces")
        self.ids = {names[i]: i for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        order = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in plain}, reverse=True))}
        rank = {i: order[sp.get_score(i)] for i in plain}
        self.bytes_of = [b""] * n
        for i, name in names.items():
            if sp.is_byte(i):
                self.bytes_of[i] = bytes([int(name[3:5], 16)])
            elif not sp.is_control(i):
                self.bytes_of[i] = b" \xe2\x81\x87 " if sp.is_unknown(i) else name.replace(SPACE, " ").encode()
        # symbols: a piece's id, or n + code point for a character that is no piece
        self.n = n
        self.char_base = n
        pairs = {}
        for name, i in self.ids.items():
            for k in range(1, len(name)):
                a, b = self._symbol(name[:k]), self._symbol(name[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = (rank[i], i)
        self.reach = 2 * max(map(len, self.ids), default=1) + 1
        keys = np.fromiter(pairs, np.int64, len(pairs))
        at = np.argsort(keys)
        self.keys = keys[at]
        values = np.array(list(pairs.values()), np.int64).reshape(-1, 2)[at]
        self.ranks, self.made = values[:, 0], values[:, 1]
        self.cut_lines = not any("\n" in name for name in self.ids)
        # words seen so far: place by word, and ids of all of them in one flat array
        self.index: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _symbol(self, s: str) -> int | None:
        got = self.ids.get(s)
        return got if got is not None else self.char_base + ord(s) if len(s) == 1 else None

    def _rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NO_RANK), self.made[at]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The final symbols of all words, one after another, and how many each word has."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        chars, where = np.unique(flat, return_inverse=True)
        symbols = np.fromiter((self._symbol(chr(c)) for c in chars), np.int64, len(chars))[where]
        word = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for wide in (False, True):  # words within reach of themselves, and longer ones
            mine = np.repeat((sizes > 2 * self.reach) == wide, sizes)
            for s, w in self._rounds(symbols[mine], word[mine], wide):
                done_symbols.append(s)
                done_words.append(w)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        return symbols[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def _rounds(self, symbols: np.ndarray, word: np.ndarray, wide: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Merge until no word has a pair, and yield symbols and words as words are done."""
        rank, made = self._pairs(symbols, word)
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, starts)
            spans = np.diff(np.r_[starts, len(symbols)])
            final = best == NO_RANK
            if final.any():  # words without a pair leave the array
                stay = ~np.repeat(final, spans)
                yield symbols[~stay], word[~stay]
                symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
                best, spans = best[~final], spans[~final]
                if not len(symbols):
                    break
            if wide:
                left = self._best_in_reach(symbols, word, rank, made)
            else:
                hits = np.flatnonzero(rank == np.repeat(best, spans))
                left = hits[np.r_[True, word[hits[1:]] != word[hits[:-1]]]]  # the leftmost in each word
            symbols[left] = made[left]
            keep = np.ones(len(symbols), bool)
            keep[left + 1] = False
            moved = left - np.arange(len(left))  # places after compaction: one symbol went for each earlier merge
            symbols, word, rank, made = symbols[keep], word[keep], rank[keep], made[keep]
            fix = np.r_[moved, np.maximum(moved - 1, 0)]
            rank[fix], made[fix] = self._pairs(symbols, word, fix)

    def _best_in_reach(self, symbols: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Places of pairs that no pair within reach beats, and that no equal pair before them changes.

        Of equal pairs within reach the first is always merged. One after it is merged with it if
        all equal ones before it are calm: their merges make no pair as good as themselves, so the
        library would go on to the next equal pair. Words stand side by side; a better pair of a
        neighbour may make a pair wait a round more, but the best pair of the array never waits.
        """
        n = len(rank)
        before, after = _least_around(rank, min(self.reach, n))
        on = (rank <= before) & (rank <= after) & (rank != NO_RANK)
        begin = np.flatnonzero(on & ~np.r_[False, on[:-1]])
        hits = np.flatnonzero(on)
        hits = hits[(hits - begin[np.searchsorted(begin, hits, "right") - 1]) % 2 == 0]  # of overlapping pairs every other one
        head = rank[hits] < before[hits]
        if head.all():
            return hits
        new, own = made[hits], rank[hits]
        joined = np.r_[False, hits[1:] == hits[:-1] + 2]
        left = np.where(joined, np.r_[0, new[:-1]], symbols[np.maximum(hits - 1, 0)])
        right = np.minimum(hits + 2, n - 1)
        calm = (self._rank(left, new)[0] > own) | (word[np.maximum(hits - 1, 0)] != word[hits]) | (hits == 0)
        calm &= (self._rank(new, symbols[right])[0] > own) | (word[right] != word[hits]) | (hits + 2 >= n)
        # an equal pair before it that itself waits for a better one keeps it waiting too
        waits = ~head & (_least_around(np.where(on, NO_RANK, rank), min(self.reach, n))[0][hits] <= own)
        stops = np.cumsum(~calm) - ~calm + np.cumsum(waits)
        first = np.maximum.accumulate(np.where(head, np.arange(len(hits)), 0))
        return hits[head | (stops == stops[first])]

    def _pairs(self, symbols: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pair that starts at each place; none over a word's end."""
        at = np.arange(len(symbols)) if at is None else at
        nxt = np.minimum(at + 1, len(symbols) - 1)
        rank, made = self._rank(symbols[at], symbols[nxt])
        inside = (at + 1 < len(symbols)) & (word[at] == word[nxt])
        return np.where(inside, rank, NO_RANK), made

    def _to_ids(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words' symbols: characters that are no piece turn into their UTF-8 bytes' ids."""
        odd = np.flatnonzero(symbols >= self.char_base)
        if not len(odd):
            return symbols.astype(np.uint32), sizes
        chars, which = np.unique(symbols[odd] - self.char_base, return_inverse=True)
        coded = [[self.byte_ids[b] for b in chr(c).encode("utf-8", "surrogatepass")] for c in chars.tolist()]
        width = np.ones(len(symbols), np.int64)
        width[odd] = np.array([len(x) for x in coded], np.int64)[which]
        ids = np.repeat(symbols, width).astype(np.uint32)
        first = np.cumsum(width) - width
        table = np.array([x + [0] * (4 - len(x)) for x in coded], np.uint32)
        for k in range(4):
            has = width[odd] > k
            ids[first[odd[has]] + k] = table[which[has], k]
        word = np.repeat(np.arange(len(sizes)), sizes)
        return ids, np.bincount(word, weights=width, minlength=len(sizes)).astype(np.int64)

    def _split(self, text: str) -> list[str]:
        """A text's words as cache keys: 'x' is a word after one space; others start with a mark or a newline.

        No piece holds a newline, so a newline starts a word of its own run and joins nothing.
        """
        if not text:
            return []
        flat = text.replace("\n", " \n") if self.cut_lines else text
        if "  " not in flat and SPACE not in text and flat[0] != " " and flat[-1] != " ":
            return flat.split(" ")
        return WORDS.findall((SPACE + text).replace(" ", SPACE))

    def _known(self, words: list[list[str]]) -> None:
        """Encode the words that the cache lacks; it starts anew when it would grow too large."""
        new = list({w for ws in words for w in ws}.difference(self.index))
        if len(self.index) + len(new) > CACHE_WORDS and self.index:
            self.index, self.flat, self.start, self.size = {}, np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
            new = list({w for ws in words for w in ws})
        if not new:
            return
        whole = [w if w[0] in MARKED else SPACE + w for w in new]
        self._store(new, *self._to_ids(*self.merge_words(whole)))

    def _store(self, words: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        self.start = np.r_[self.start, len(self.flat) + np.cumsum(size) - size]
        self.flat, self.size = np.r_[self.flat, ids], np.r_[self.size, size]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text with begin and end ids."""
        split = [self._split(t) for t in texts]
        self._known(split)
        get = self.index.__getitem__
        out = []
        for ws in split:
            k = np.fromiter(map(get, ws), np.int64, len(ws))
            size = self.size[k]
            ends = np.cumsum(size)
            ids = np.empty((int(ends[-1]) if len(ws) else 0) + 2, np.uint32)
            ids[0], ids[-1] = self.bos, self.eos
            ids[1:-1] = self.flat[np.repeat(self.start[k] - ends + size, size) + np.arange(len(ids) - 2)]
            out.append(ids)
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; control ids vanish, as does the first space, which encoding added."""
        raw = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        text = raw.decode("utf-8", "replace")
        first = next((x for x in ids.tolist() if x not in (self.bos, self.eos)), None)
        return text[1:] if first is not None and self.bytes_of[first].startswith(b" ") and text.startswith(" ") else text


def _least_around(rank: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of the reach ranks before each place, and of those after it."""
    n, width = len(rank), 1
    padded = low = np.r_[np.full(reach, NO_RANK), rank, np.full(reach, NO_RANK)]
    while 2 * width <= reach:  # least of width ranks from each place on
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    m = len(padded) - reach + 1
    low = np.minimum(low[:m], low[reach - width:reach - width + m])
    return low[:n], low[reach + 1:reach + 1 + n]


@lru_cache(maxsize=2)
def coder(model_file: str) -> PieceCoder:
    return PieceCoder(model_file)


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters of text that are encoded at once; a longer text makes a batch of its own.
BATCH_CHARS = 1 << 20


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BATCH_CHARS:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", model: str = MODEL) -> DataFrame:
    """Rows (key, ids array<int>, decoded string) of every whole text; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_path(model))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in _slices(texts):
                ids = c.encode_batch(texts[i:j])
                yield pa.RecordBatch.from_arrays([b.column(0)[i:j], pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                                                  pa.array([c.decode(x) for x in ids], pa.string())], names=[key, "ids", "decoded"])

    kind = docs.select(key).schema[0].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>, decoded string")


def op5(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document's whole text.

    Null and empty texts have begin and end ids only. Empty in, empty out; other columns are not read. Nothing is shuffled; each row depends on
    its own text, so repeated rows and ties give equal rows, and a lost task is simply rerun.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(model_path(model))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for i, j in _slices(texts):
                ids = c.encode_batch(texts[i:j])
                yield pa.RecordBatch.from_arrays([
                    b.column(0)[i:j], pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(c.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids], pa.string()),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
