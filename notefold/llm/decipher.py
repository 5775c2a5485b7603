"""Letters for the symbols of an unknown substitution cipher, by expectation-maximisation.

Hidden are the letters that were written; seen are the symbols that another code page made of
them. A table gives for each symbol how likely it stands for each letter. The E step runs forwards
and backwards over each stretch, with the collection's bigrams as the chain's transitions and
characters of ASCII as they are, and sums up which letter each symbol stood for; the M step makes
those sums the new table. No code page is given: the first table only expects frequent symbols to
be frequent letters.

The state is bounded: a table has at most ``MOST_SYMBOLS`` symbols and ``MOST_LETTERS`` letters.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np

MOST_LETTERS, MOST_SYMBOLS = 120, 160
LETTER_SHARE = 2e-5  # of all a script's letters, that a letter has to have
ASCII = "".join(chr(c) for c in [*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)])
EDGE = "^"


class Chain:
    """The transitions among a script's letters, ASCII letters and the edge of a stretch."""

    def __init__(self, letters: dict[str, float], step):
        self.letters = sorted(letters, key=lambda c: (-letters[c], c))[:MOST_LETTERS]
        self.weight = np.array([letters[c] for c in self.letters])
        self.weight = self.weight / self.weight.sum()
        every = [*self.letters, *ASCII]
        n = len(self.letters)
        self.at = {c: i for i, c in enumerate(every)}
        self.first = np.exp([step(EDGE, c) if i < n else 0.0 for i, c in enumerate(every)])
        self.last = np.exp([step(c, "$") if i < n else 0.0 for i, c in enumerate(every)])
        self.move = np.exp([[step(a, b) if i < n or j < n else 0.0 for j, b in enumerate(every)] for i, a in enumerate(every)])
        self.even = np.concatenate([np.full(n, 1.0 / max(n, 1)), np.zeros(len(ASCII))])
        self.fixed = {c: np.eye(len(every))[self.at[c]] for c in ASCII}

    def start(self, symbols: dict[str, float]) -> dict[str, np.ndarray]:
        """The first table: symbols and letters in the order of how frequent they are, loosely."""
        n = len(self.letters)
        ranked = sorted(symbols, key=lambda c: (-symbols[c], c))[:MOST_SYMBOLS]
        place = np.arange(n)
        out = {}
        for i, c in enumerate(ranked):
            near = np.exp(-np.abs(place - i) / 6.0) + 0.05
            out[c] = near / near.sum()
        return out

    def expect(self, stretch: str, table: dict[str, np.ndarray], count: float, sums: dict[str, np.ndarray]) -> float:
        """Add the expected letters of a stretch's symbols to ``sums``; its log likelihood."""
        n = len(self.letters)
        seen = []
        for c in stretch:
            if c in self.fixed:
                seen.append(self.fixed[c])
            elif c in table:
                seen.append(np.concatenate([table[c], np.zeros(len(ASCII))]))
            else:
                seen.append(self.even)
        forward, scale = [], []
        x = self.first * seen[0]
        for e in seen[1:]:
            z = x.sum() or 1e-300
            forward.append(x / z)
            scale.append(z)
            x = (forward[-1] @ self.move) * e
        z = x.sum() or 1e-300
        forward.append(x / z)
        scale.append(z)
        end = float(forward[-1] @ self.last) or 1e-300
        y = self.last / end
        for i in range(len(seen) - 1, -1, -1):
            c = stretch[i]
            if c in table:
                post = (forward[i] * y)[:n]
                sums[c] += count * post / (post.sum() or 1.0)
            y = self.move @ (seen[i] * y) / scale[i]
        return sum(map(math.log, scale)) + math.log(end)


def improved(sums: dict[str, np.ndarray], smooth: float = 0.02) -> dict[str, np.ndarray]:
    """The M step: a table from expected counts."""
    return {c: (x + smooth) / (x + smooth).sum() for c, x in sums.items()}


def chosen(chain: Chain, table: dict[str, np.ndarray], least: float = 0.5) -> dict[str, str]:
    """Symbol to letter, where the table is sure enough of one."""
    return {c: chain.letters[int(p.argmax())] for c, p in table.items() if p.max() >= least}


def decipher(chain: Chain, stretches: dict[str, float], rounds: int = 60, close: float = 1e-4, least: float = 0.0) -> tuple[dict[str, np.ndarray], float]:
    """(table, log likelihood a stretch) of a small set of stretches, all in one place; of symbols seen ``least`` times."""
    symbols: dict[str, float] = defaultdict(float)
    for s, n in stretches.items():
        for c in s:
            if c > "\x7f":
                symbols[c] += n
    table, before = chain.start({c: x for c, x in symbols.items() if x >= least}), -math.inf
    mass = sum(stretches.values())
    for _ in range(rounds):
        sums = defaultdict(lambda: np.zeros(len(chain.letters)))
        like = sum(n * chain.expect(s, table, n, sums) for s, n in stretches.items()) / mass
        table = improved(sums)
        if like - before < close * abs(like):
            break
        before = like
    return table, like
