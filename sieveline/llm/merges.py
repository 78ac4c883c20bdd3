"""Byte-pair merges of a fixed vocabulary: re-merging, pair compatibility, and exact encodings built on it.

A sequence of tokens is the encoding of its text exactly if every adjacent pair is the encoding of the pair's own
text, and a lone token is the encoding of itself. So a text can be encoded by search (`encode`, which backtracks over
longest matches) or by dynamic programming over its prefixes (`prefixes`), and only pairs are ever merged again.
"""

from __future__ import annotations

from collections.abc import Callable

import ahocorasick

END = float("inf")
MEMO = 100_000  # entries a worker remembers; then it starts afresh, which changes no result


class Merger:
    """``ranks``: the priority of each token that a merge may produce, smaller first. ``rank_of(left, right)`` gives a pair's priority or None."""

    def __init__(self, tokens, rank_of: Callable[[str, str], float | None]):
        self.rank_of = rank_of
        self.known: dict[str, tuple | None] = {}  # at most one entry for each token
        self.pairs: dict[tuple[str, str], bool] = {}
        self.matcher = ahocorasick.Automaton()
        tokens = set(tokens)
        self.shorter = {}  # of each token the next shorter one that it starts with
        for token in tokens:
            self.matcher.add_word(token, len(token))
            self.shorter[token] = next((token[:k] for k in range(len(token) - 1, 0, -1) if token[:k] in tokens), None)
        self.matcher.make_automaton()

    def merge(self, symbols: list[str]) -> list[str]:
        """The merge procedure itself: best pair first, the leftmost of equals. For texts of a few tokens."""
        parts, rank_of = list(symbols), self.rank_of
        ranks = [rank_of(a, b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for i, r in enumerate(ranks):
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank_of(parts[at], parts[at + 1])
            if at:
                ranks[at - 1] = rank_of(parts[at - 1], parts[at])

    def edges(self, token: str) -> tuple[list[tuple[str, float]], list[tuple[str, float]]] | None:
        """The symbols at the left and at the right edge of ``token`` while it is merged, each with the priority of the merge that ends it.

        None if merging the token's text does not give the token, or not in the order of priorities.
        """
        parts, rank_of = list(token), self.rank_of
        left, right, last = [], [], None
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank_of(parts[i], parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None or last is not None and best < last:
                return None
            last = best
            if at == 0:
                left.append((parts[0], best))
            if at == len(parts) - 2:
                right.append((parts[-1], best))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [*left, (token, END)], [*right, (token, END)]

    def _edges(self, token: str):
        if token not in self.known:
            self.known[token] = self.edges(token)
        return self.known[token]

    def fits(self, left: str, right: str) -> bool:
        """Whether ``left, right`` is the encoding of its own text; an empty ``left`` asks about ``right`` alone.

        Re-merges the pair along the border only: the symbols on both sides grow in the order of their merges, and the
        pair fits if no merge across the border ever comes first. Of equal merges the leftmost is first.
        """
        known = self.known
        b = known[right] if right in known else self._edges(right)
        if not left:
            return b is not None or self.merge(list(right)) == [right]
        a = known[left] if left in known else self._edges(left)
        if a is None or b is None:
            return self.merge(list(left + right)) == [left, right]
        a, b, rank_of, i, j = a[1], b[0], self.rank_of, 0, 0
        while True:
            (x, x_ends), (y, y_ends) = a[i], b[j]
            across = rank_of(x, y)
            if across is not None and across < x_ends and across <= y_ends:
                return False
            if x_ends <= y_ends:
                if x_ends == END:
                    return True
                i += 1
            else:
                j += 1

    def encode(self, text: str) -> list[str] | None:
        """Tokens of ``text`` by backtracking over longest matches; None if some character is no token.

        A bitfield keeps the positions that led nowhere. It need not know the way taken to them, since the tokens
        before a position are the encoding of the text before it and so the only ones.
        """
        n, pairs, fits, shorter, matches = len(text), self.pairs, self.fits, self.shorter, self.matcher.iter_long
        failed = bytearray(n + 1)
        tokens, starts, start = [""], [], 0
        piece = text[: next(matches(text))[1]] if n else None
        while start < n:
            last = tokens[-1]
            while piece is not None:
                end = start + len(piece)
                if not failed[end]:
                    good = pairs.get((last, piece))
                    if good is None:
                        if len(pairs) >= MEMO:
                            pairs.clear()
                        good = pairs[last, piece] = fits(last, piece)
                    if good:
                        break
                piece = shorter[piece]
            if piece is not None:
                tokens.append(piece)
                starts.append(start)
                start = end
                if end < n:
                    piece = text[end : end + next(matches(text, end))[1]]
            else:
                failed[start] = 1
                if not starts:
                    return None
                start, piece = starts.pop(), shorter[tokens.pop()]
        return tokens[1:]

    def prefixes(self, text: str) -> list[int]:
        """The number of tokens of every prefix of ``text``, from the empty one to the whole."""
        n, pairs, fits = len(text), self.pairs, self.fits
        last: list[str | None] = [""] + [None] * n
        counts = [0] * (n + 1)
        for end, length in self.matcher.iter(text):  # of one end the longest first
            end += 1
            if last[end] is None:
                start = end - length
                before = last[start]
                if before is not None:
                    piece = text[start:end]
                    good = pairs.get((before, piece))
                    if good is None:
                        if len(pairs) >= MEMO:
                            pairs.clear()
                        good = pairs[before, piece] = fits(before, piece)
                    if good:
                        last[end] = piece
                        counts[end] = counts[start] + 1
        return counts
