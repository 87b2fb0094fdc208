"""A bidirectional FM-index over a delimited vocabulary, and searches that allow one error in one half of a word."""

from __future__ import annotations

import numpy as np

from flowlab.llm.fmindex import order_ranks

#: Entries of one table of occurrence counts; longer vocabularies keep every second, fourth, .. row of it.
TABLE = 1 << 24
#: Queries searched side by side.
BLOCK = 4096
#: Symbol before and after every word.
MARK = 0


def flat(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, starts): the words one after another."""
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum([len(w) for w in words], out=starts[1:])
    return (np.concatenate(words) if words else np.zeros(0, np.int64)), starts


class _Side:
    """One direction: how often every symbol stands in the transform before a place."""

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        order = np.argsort(order_ranks(text, depth), kind="stable")
        self.transform = text[order - 1]
        self.symbols = symbols
        self.step = 1
        while len(text) * symbols // self.step > TABLE:
            self.step *= 2
        rows = len(text) // self.step + 1
        counts = np.zeros((rows, symbols), np.int32)
        at = np.arange(len(text)) // self.step + 1
        inside = at < rows
        np.add.at(counts, (at[inside], self.transform[inside]), 1)
        self.counts = np.cumsum(counts, 0, dtype=np.int32)
        self.first = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=symbols), out=self.first[1:])

    def before(self, place: np.ndarray) -> np.ndarray:
        """A row of counts for each place."""
        out = self.counts[place // self.step].astype(np.int64)
        base = place - place % self.step
        for k in range(self.step - 1):
            row = np.flatnonzero(base + k < place)
            out[row, self.transform[base[row] + k]] += 1
        return out

    def before_one(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        out = self.counts[place // self.step, symbol].astype(np.int64)
        base = place - place % self.step
        for k in range(self.step - 1):
            row = np.flatnonzero(base + k < place)
            out[row] += self.transform[base[row] + k] == symbol[row]
        return out


class Vocabulary:
    """Index of distinct words (arrays of symbols from 1) in both directions.

    The words stand in sorted order between marks. An interval of suffixes that start with a pattern and the interval of
    prefixes that end with it have one size; extending the pattern on either side narrows one by counting in its
    transform and the other by the symbols that are smaller.
    """

    def __init__(self, words: list[np.ndarray], symbols: int):
        mark = np.zeros(1, np.int64)
        text = np.concatenate([mark, *(x for w in words for x in (w, mark))])
        self.symbols = symbols
        depth = max((len(w) for w in words), default=0) + 2
        self.forward = _Side(text, symbols, depth)
        self.backward = _Side(text[::-1].copy(), symbols, depth)
        #: Word numbers in the order of the words read from their end, which is that of the marks in the backward index.
        self.from_end = np.array(sorted(range(len(words)), key=lambda k: words[k][::-1].astype(">u4").tobytes()), np.int64)

    def left_part(self, symbols: np.ndarray, starts: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lo, size) in the backward index of a mark and the first ``split`` symbols of each query: read from the split
        to the left in the forward index, the backward interval kept in step."""
        symbol = symbols[starts + split - 1]
        lo, back = self.forward.first[symbol].copy(), self.backward.first[symbol].copy()
        size = self.forward.first[symbol + 1] - lo
        for k in range(2, int(split.max(initial=0)) + 2):
            live = np.flatnonzero((k <= split + 1) & (size > 0))
            if not len(live):
                break
            inner = split[live] - k
            symbol = np.where(inner >= 0, symbols[starts[live] + np.maximum(inner, 0)], MARK)
            low = self.forward.before(lo[live])
            counts = self.forward.before(lo[live] + size[live]) - low
            row = np.arange(len(live))
            smaller = np.cumsum(counts, 1)[row, symbol] - counts[row, symbol]
            back[live] += smaller
            lo[live] = self.forward.first[symbol] + low[row, symbol]
            size[live] = counts[row, symbol]
        return back, size

    def near(self, symbols: np.ndarray, starts: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) where the word has the query's first ``split`` symbols and its rest is exactly one error away.

        A query is ``symbols[starts[k]:starts[k + 1]]``. Each word is met once: an inserted symbol is put as far right as
        it goes, of a run of equal symbols the last is deleted.
        """
        found = []
        for k in range(0, len(split), BLOCK):
            chosen = slice(k, min(k + BLOCK, len(split)))
            query, word = self._near(symbols, starts[chosen], starts[1:][chosen], split[chosen])
            found.append((query + k, word))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])

    def _near(self, symbols, starts, ends, split):
        lo, size = self.left_part(symbols, starts, split)
        length = ends - starts
        query = np.flatnonzero(size > 0)
        lo, size, at = lo[query], size[query], split[query].copy()
        erred = [np.zeros(0, np.int64)] * 4  # query, lo, size, at of the patterns with an error
        hits = []
        side = self.backward

        def symbol_at(q, i):
            return np.where(i < length[q], symbols[np.minimum(starts[q] + i, ends[q] - 1)], MARK)

        while len(query) or len(erred[0]):
            # a deletion reads nothing: it joins the patterns of this step
            inside = at < length[query]
            last = inside & (symbol_at(query, at) != symbol_at(query, at + 1))
            bad = [np.concatenate([x, y[last]]) for x, y in zip(erred, (query, lo, size, at + 1))]
            # patterns with an error read on exactly
            q, b, n, i = bad
            symbol = symbol_at(q, i)
            low = side.before_one(b, symbol)
            n = side.before_one(b + n, symbol) - low
            b = side.first[symbol] + low
            over = (n > 0) & (i == length[q])  # the closing mark was read
            hits.append((q[over], b[over]))
            on = (n > 0) & (i < length[q])
            erred = [q[on], b[on], n[on], i[on] + 1]
            # patterns without one branch
            if len(query):
                low = side.before(lo)
                counts = side.before(lo + size) - low
                right = symbol_at(query, at)
                row = np.arange(len(query))
                own = counts[row, right]
                other = counts > 0
                other[:, MARK] = False
                other[row, right] = False
                r, c = np.nonzero(other)
                new = [query[r], side.first[c] + low[r, c], counts[r, c], at[r]]
                swap = at[r] < length[query[r]]
                moved = [new[0][swap], new[1][swap], new[2][swap], new[3][swap] + 1]
                erred = [np.concatenate(x) for x in zip(erred, new, moved)]
                on = (own > 0) & (at < length[query])
                lo, size = (side.first[right] + low[row, right])[on], own[on]
                query, at = query[on], at[on] + 1
        query = np.concatenate([x for x, _ in hits]) if hits else np.zeros(0, np.int64)
        rank = np.concatenate([x for _, x in hits]) if hits else np.zeros(0, np.int64)
        return query, self.from_end[rank - 1]  # the first mark's suffix is the end of the text
