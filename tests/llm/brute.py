"""A language model by plain counting."""

from __future__ import annotations

import collections
import math
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_model(texts, order):
    def toks(t):
        low = "".join(c.lower() if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" else c for c in t or "")
        return [*WORD.findall(low), "</s>"]

    counts = [collections.Counter() for _ in range(order + 1)]
    for t in texts:
        said = ["<s>"] * (order - 1) + toks(t)
        counts[order].update(tuple(said[i - order + 1 : i + 1]) for i in range(order - 1, len(said)))
    for m in range(order - 1, 0, -1):
        counts[m].update(k[1:] for k in counts[m + 1])
    unigrams = collections.Counter(w for t in texts for w in toks(t))
    discounts = [None]
    for m in range(1, order + 1):
        of = collections.Counter(counts[m].values())
        if all(of[k] for k in (1, 2, 3, 4)):
            y = of[1] / (of[1] + 2 * of[2])
            d = [1 - 2 * y * of[2] / of[1], 2 - 3 * y * of[3] / of[2], 3 - 4 * y * of[4] / of[3]]
            discounts.append([min(max(x, 0.01), k + 0.99) for k, x in enumerate(d)])
        else:
            discounts.append([0.5, 1.0, 1.5])

    def p(gram):
        m = len(gram)
        if not m:
            return 1 / (len(unigrams) + 1)
        rest = [n for k, n in counts[m].items() if k[:-1] == gram[:-1]]
        if not rest:
            return p(gram[1:])
        d = discounts[m]
        c = counts[m][gram]
        back = sum(d[min(n, 3) - 1] for n in rest)
        return (max(c - (d[min(c, 3) - 1] if c else 0), 0) + back * p(gram[1:])) / sum(rest)

    def score(t):
        said = ["<s>"] * (order - 1) + toks(t)
        return sum(math.log10(p(tuple(said[i - order + 1 : i + 1]))) for i in range(order - 1, len(said)))

    return unigrams, toks, score
