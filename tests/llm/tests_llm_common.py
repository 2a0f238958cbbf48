"""What the tests of this folder share."""

import random

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "zo", "ba", "ne") for b in ("n", "s", "ra", "li", "to", "m", "", "ve")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for i in range(n):
        w = rng.choice(WORDS) + (rng.choice(WORDS) if rng.random() < 0.5 else "")
        out.append(w + (". " if i % 11 == 10 else " ") + ("\n" if i % 37 == 36 else ""))
    return "".join(out).strip()


# Nulls, empty and blank texts, repeated rows, shared ids, odd characters, a very long text.
ODD = [
    (1, prose(1, 120)),
    (2, prose(1, 120)),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "Ünïcödé ÉCOLE straße 日本語 😀 e\u0301 a\u00a0b"),
    (7, prose(7, 9)),
    (None, prose(8, 60)),
    (None, None),
    (9, prose(9, 60)),
    (9, prose(9, 60)),
    (10, prose(10, 40)),
    (10, prose(11, 40)),
    (12, prose(12, 6000)),
    (13, "x" * 40_000),
    (14, "the " * 3000),
]


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.select(*names).collect()), key=repr)
