"""Sums of Jaccard similarities over all pairs of sets, by what the sets share: linear in the sets, not in their pairs.

J(A, B) is the sum over the non-empty subsets T of both of 1 / C(|A| + |B| - 1, |T|): the terms are the differences
at 0 of k / (|A| + |B| - k), which counts what is shared. So a sum over pairs needs only how many sets of each size hold T.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations_with_replacement
from math import comb

import numpy as np

#: Sets of up to so many names go by their subsets, of which they have 2 ** size.
SMALL = 12
#: Rows that one sum takes, rows that are worked on at a time, cells of a block, and subsets below which a kind is not a group of its own.
RUN, CHUNK, BLOCK, FEW = 32, 1024, 8192, 64
#: Draws that are scored together, and bytes of their table, about.
AT_ONCE, WORK = 256, 1 << 28


def all_subsets(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, subset) of all subsets, the empty one included, of sets written as bits of 64-bit integers."""
    size, owners, parts = np.bitwise_count(masks), [], []
    for p in np.unique(size):
        own = np.flatnonzero(size == p)
        left, out = masks[own].copy(), np.zeros((len(own), 1), np.int64)
        for _ in range(int(p)):
            low = left & -left
            left ^= low
            out = np.concatenate([out, out | low[:, None]], 1)
        owners.append(np.repeat(own, out.shape[1]))
        parts.append(out.ravel())
    return np.concatenate(owners), np.concatenate(parts)


@lru_cache(maxsize=64)
def term(k: int) -> np.ndarray:
    """1 / C(p + q - 1, k) by sizes p and q up to SMALL, 0 where a size is below k."""
    return np.array([[1 / comb(p + q - 1, k) if p >= k and q >= k else 0.0 for q in range(SMALL + 1)] for p in range(SMALL + 1)])


def shared_sums(masks: np.ndarray, sizes: np.ndarray, counts: np.ndarray, side: np.ndarray, sides: int, first: np.ndarray) -> np.ndarray:
    """(sides, sides): of the sum of similarities of all pairs of sets of two sides, the terms of the subsets whose smallest bit is first.

    A row is a set of at most SMALL members with one of its bits; counts are the sets' multiplicities.
    """
    low, width = np.int64(1) << first.astype(np.int64), SMALL + 1
    owner, t = all_subsets(masks & ~((low - 1) | low))
    found, at = np.unique(t | low[owner], return_inverse=True)
    f = np.bincount(at * (sides * width) + side[owner] * width + sizes[owner], counts[owner], len(found) * sides * width).reshape(len(found), sides * width)
    k, out = np.bitwise_count(found), np.zeros((sides, sides))
    for n in np.unique(k):
        g = f[k == n]
        out += np.einsum("apbq,pq->ab", (g.T @ g).reshape(sides, width, sides, width), term(int(n)))
    return out


def guest_sums(masks: np.ndarray, sizes: np.ndarray, counts: np.ndarray, side: np.ndarray, sides: int, guest: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """(sides, sides): summed similarities, pair by pair in blocks, of guests (sets over SMALL members) with the sets that are at home here.

    Both orders of a pair count; of two large sets each order counts where its second set is at home.
    """
    out, at, own = np.zeros((sides, sides)), np.flatnonzero(guest), np.flatnonzero(~guest)
    small = sizes[own] <= SMALL
    step = max(1, most // max(1, len(own)))
    for k in range(0, len(at), step):
        g = at[k:k + step]
        both = np.bitwise_count(masks[g][:, None] & masks[own][None])
        t = counts[g][:, None] * counts[own][None] * (both / (sizes[g][:, None] + sizes[own][None] - both))
        for x in range(sides):
            rows = t[side[g] == x].sum(0)
            out[x] += np.bincount(side[own], rows, sides)
            out[:, x] += np.bincount(side[own][small], rows[small], sides)
    return out


def _stages(items: np.ndarray, start: np.ndarray, m: np.ndarray, height: int) -> tuple[list, np.ndarray, int]:
    """Sums of m rows each, listed in items from start on: stages (first new row, rows to sum by new row), the sums' rows, and all rows then."""
    items = items[np.repeat(start - np.cumsum(m) + m, m) + np.arange(m.sum())]
    start, out, stages = np.cumsum(m) - m, np.empty(len(m), np.int32), []

    def stage(start: np.ndarray, m: np.ndarray) -> np.ndarray:
        nonlocal height
        new = np.empty(len(m), np.int32)
        for n in np.unique(m):
            own = np.flatnonzero(m == n)
            new[own] = height + np.arange(len(own))
            stages.append((height, items[start[own] + np.arange(n)[:, None]]))
            height += len(own)
        return new

    single = m == 1
    out[single] = items[start[single]]
    while (m > RUN).any():
        far = np.flatnonzero(m > RUN)
        pieces = -(-m[far] // RUN)
        first = np.cumsum(pieces) - pieces
        skip = (np.arange(pieces.sum()) - np.repeat(first, pieces)) * RUN
        sums = stage(np.repeat(start[far], pieces) + skip, np.minimum(RUN, np.repeat(m[far], pieces) - skip))
        start[far], m[far] = len(items) + first, pieces
        items = np.concatenate([items, sums])
    out[~single] = stage(start[~single], m[~single])
    return stages, out, height


def _room(space: np.ndarray, shape: tuple[int, int], kind: type) -> np.ndarray:
    """A part of these bytes as an array."""
    return space[:shape[0] * shape[1] * np.dtype(kind).itemsize].view(kind).reshape(shape)


class Similarities:
    """The matrix J of Jaccard similarities of distinct sets, used without being held: sets by their subsets, others in blocks of rows.

    member (sets, names) is 0 or 1. Memory is that of the subsets, 2 ** size a set up to SMALL members, and of the names.
    """

    def __init__(self, member: np.ndarray, most: int = 1 << 21):
        self.member, self.size = member.astype(np.float32), member.sum(1).astype(np.int64)
        self.rows = np.flatnonzero(self.size > SMALL) if member.shape[1] <= 63 else np.arange(len(member))
        self.step, self.both_ways = max(1, most // max(1, len(member))), np.full(len(member), 2.0)
        self.both_ways[self.rows] = 1.0
        inside = np.setdiff1d(np.arange(len(member)), self.rows)
        self.empty = inside[self.size[inside] == 0]
        masks = (member[inside].astype(np.int64) << np.arange(member.shape[1], dtype=np.int64)).sum(1) if len(inside) else np.zeros(0, np.int64)
        owner, t = all_subsets(masks) if len(inside) else (masks, masks)
        owner, t = owner[t != 0], t[t != 0]
        # one stable sort: the sets of a subset stay in the order of their sizes
        order = np.argsort(t, kind="stable")
        owner, t = inside[owner[order]], t[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(t)), bool), t[1:] != t[:-1]]))
        many = np.diff(first, append=len(t))
        k = np.bitwise_count(t[first]).astype(np.int64)
        # a subset of one set only adds to that set's product with itself
        alone = many == 1
        p = self.size[owner[first[alone]]]
        own = np.array([[1 / comb(2 * a - 1, b) if a >= b >= 1 else 0.0 for b in range(SMALL + 1)] for a in range(SMALL + 1)])
        self.alone = np.bincount(owner[first[alone]], own[p, k[alone]], len(member))
        self.owner = owner[np.repeat(~alone, many)].astype(np.int32)
        many, k = many[~alone], k[~alone]
        shared = np.argsort(k, kind="stable")
        place = np.empty(len(k), np.int64)
        place[shared] = np.arange(len(k))
        self.at = (np.repeat(place, many) * (SMALL + 1) + self.size[self.owner]).astype(np.int32 if len(shared) < 1 << 27 else np.int64)
        self.many, ends = len(shared), np.searchsorted(k[shared], np.arange(1, SMALL + 2))
        self.spans = [(n, ends[n - 1], ends[n]) for n in range(1, SMALL + 1) if ends[n] > ends[n - 1]]
        self._plan()

    def _plan(self):
        """How squares() sums many draws at once. A cell is a shared subset with a size of the sets that hold it.

        Subsets of one size make up blocks. A block's table has as rows the sets, a row of zeros, then sums of rows, in
        stages of at most RUN terms; a cell is one of these rows, and a group has subsets held by sets of the same sizes.
        """
        many = np.bincount(self.at, minlength=self.many * (SMALL + 1))
        # lines of a cell stand together
        items, start = self.owner, np.zeros(len(many), np.int64)
        lines = np.flatnonzero(np.diff(self.at, prepend=-1))
        start[self.at[lines]] = lines
        held = (many > 0).reshape(self.many, SMALL + 1)
        level = np.repeat([n for n, _, _ in self.spans], [j - i for _, i, j in self.spans]).astype(np.int64)
        kind = level << SMALL + 1 | (held << np.arange(SMALL + 1)).sum(1)
        _, of, number = np.unique(kind, return_inverse=True, return_counts=True)
        # kinds of few subsets share their zeros
        kind = np.where(number[of] < FEW, level << SMALL + 1, kind)
        order = np.argsort(kind, kind="stable")
        self.blocks, self.height, width = [], len(self.member) + 1, held.sum(1)[order]
        cut = level[order] * (1 << 40) + (np.cumsum(width) - width) // BLOCK
        for t in np.split(order, np.flatnonzero(np.diff(cut)) + 1) if self.many else []:
            of, p = np.nonzero(held[t])
            cell = t[of] * (SMALL + 1) + p
            stages, where, height = _stages(items, start[cell], many[cell], len(self.member) + 1)
            grid = np.full((len(t), SMALL + 1), len(self.member), np.int32)
            grid[of, p] = where
            groups = []
            for own in np.split(np.arange(len(t)), np.flatnonzero(np.diff(kind[t])) + 1):
                sizes = np.flatnonzero(held[t[own]].any(0))
                groups.append((term(int(level[t[0]]))[np.ix_(sizes, sizes)], np.ascontiguousarray(grid[np.ix_(own, sizes)].T)))
            self.blocks.append((int(level[t[0]]), stages, groups))
            self.height = max(self.height, height)

    def _weighed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each shared subset, x summed by size of the sets that hold it, and its product with the terms."""
        f = np.bincount(self.at, x[self.owner], self.many * (SMALL + 1)).reshape(self.many, SMALL + 1)
        return f, np.concatenate([f[i:j] @ term(n) for n, i, j in self.spans]) if self.spans else f

    def _blocks(self):
        for k in range(0, len(self.rows), self.step):
            g = self.rows[k:k + self.step]
            both = (self.member[g] @ self.member.T).astype(float)
            union = self.size[g][:, None] + self.size[None] - both
            yield g, np.where(union > 0, both / np.maximum(union, 1), 1.0)

    def product(self, x: np.ndarray) -> np.ndarray:
        """J x."""
        _, g = self._weighed(x)
        out = self.alone * x + np.bincount(self.owner, g.ravel()[self.at], len(x))
        out[self.empty] += x[self.empty].sum()
        for rows, alike in self._blocks():
            out[rows] += alike @ x
            out += np.where(self.both_ways > 1, x[rows] @ alike, 0.0)
        return out

    def most(self, x: np.ndarray) -> dict[int, float]:
        """By size of subsets, the largest sum of x over the sets of one size that share one: no draw from x exceeds it."""
        f, _ = self._weighed(x.astype(float))
        return {n: f[i:j].max() for n, i, j in self.spans}

    def squares(self, xs: np.ndarray, top: dict[int, float] | None = None) -> np.ndarray:
        """x' J x of each row x of xs, which are whole numbers from 0 on; top: most() of what the rows are drawn from.

        Sums and products of whole numbers are exact in the short types taken, which top bounds.
        """
        top, out = top or self.most(xs.max(0)), xs[:, self.empty].sum(1, dtype=float) ** 2
        kinds = {n: next(t for t, most in ((np.uint8, 1 << 8), (np.uint16, 1 << 16), (np.uint32, 1 << 32), (float, np.inf)) if top[n] < most) for n in top}
        step = min(len(xs), max(16, min(AT_ONCE, WORK // (8 * self.height))))
        part, short = np.empty(CHUNK * step * 8, np.uint8), np.empty(CHUNK * step * 8, np.uint8)
        space = np.empty(self.height * step * max((np.dtype(t).itemsize for t in kinds.values()), default=0), np.uint8)
        for k in range(0, len(xs), step):
            x, now = np.ascontiguousarray(xs[k:k + step].T), None
            draws = x.shape[1]
            for lo in range(0, len(x), CHUNK):
                out[k:k + draws] += self.alone[lo:lo + CHUNK] @ x[lo:lo + CHUNK].astype(float) ** 2
            for n, stages, groups in self.blocks:
                if now != kinds[n]:
                    now = kinds[n]
                    v, got = (_room(t, (rows, draws), now) for t, rows in ((space, self.height), (part, CHUNK)))
                    # a count that this type does not hold is of a set without a cell here
                    np.minimum(x, np.iinfo(now).max if now != float else np.inf, out=v[:len(x)], casting="unsafe")
                    v[len(x)] = 0
                for row, terms in stages:
                    m, w = len(terms), CHUNK // len(terms)
                    for lo in range(0, terms.shape[1], w):
                        own = terms[:, lo:lo + w]
                        to = v[row + lo:row + lo + own.shape[1]]
                        np.take(v, own.ravel(), axis=0, out=got[:own.size], mode="clip")
                        np.add.reduce(got[:own.size].reshape(m, -1), axis=0, dtype=now, out=to.reshape(-1))
                for weights, rows in groups:
                    w = CHUNK // len(rows)
                    pairs = list(combinations_with_replacement(range(len(rows)), 2))
                    sums, exact = np.zeros((len(pairs), draws)), np.float32 if w * top[n] ** 2 < 1 << 24 else float
                    for lo in range(0, rows.shape[1], w):
                        own = rows[:, lo:lo + w]
                        np.take(v, own.ravel(), axis=0, out=got[:own.size], mode="clip")
                        g = _room(short, (own.size, draws), exact)
                        g[...] = got[:own.size]
                        g = g.reshape(len(rows), -1, draws)
                        for at, (a, b) in enumerate(pairs):
                            sums[at] += np.einsum("td,td->d", g[a], g[b])
                    out[k:k + draws] += np.array([weights[a, b] * (1 if a == b else 2) for a, b in pairs]) @ sums
        for rows, alike in self._blocks():
            out += (xs[:, rows] * (xs @ (alike * self.both_ways).T)).sum(1)
        return out


def deal(rng: np.random.Generator, each: np.ndarray, k: int, draws: int) -> np.ndarray:
    """(draws, classes): how many of each class are among k members, drawn without replacement, of classes of each members.

    The law is that of multivariate_hypergeometric. All members are drawn with one chance, then as many as lack or
    exceed k, which are any of those left out or drawn, each as likely as the others, are put in or out.
    """
    kinds, of = np.unique(each, return_inverse=True)
    n, classes = int(each.sum()), np.argsort(of, kind="stable")
    cut = min(255, max(1, round(256 * k / n)))
    drawn = rng.integers(0, 1 << 64, -(-n * draws // 8), np.uint64).view(np.uint8)[:n * draws].reshape(n, draws) < cut
    for j, lack in enumerate(k - drawn.sum(0, dtype=np.int64)):
        while lack:
            pick = rng.integers(0, n, 2 * abs(lack) + 16)
            pick = pick[drawn[pick, j] == (lack < 0)]
            _, first = np.unique(pick, return_index=True)
            pick = pick[np.sort(first)][:abs(lack)]
            drawn[pick, j] = lack > 0
            lack -= len(pick) if lack > 0 else -len(pick)
    out, row, at = np.empty((len(each), draws), np.int32 if n < 1 << 31 else np.int64), 0, 0
    for m, number in zip(kinds, np.bincount(of)):
        own = drawn[row:row + m * number].view(np.uint8).reshape(int(m), number, draws)
        out[classes[at:at + number]] = own.sum(0, dtype=out.dtype)
        row, at = row + m * number, at + number
    return out.T
