"""Numbers that describe how a whole text is written, for linear models."""

from __future__ import annotations

import math

import numpy as np

from tallymark.llm.common import words

#: Characters whose share in the text is a feature each.
MARKS = "#$%&*|!?.,;:-_/+=<>@\n\"'()0"
N_PLAIN = len(MARKS) + 12


def style(text: str | None) -> list[float]:
    """N_PLAIN numbers; a null or empty text gives zeros but for the first, which marks it."""
    if not text or not (ws := words(text)):
        return [1.0] + [0.0] * (N_PLAIN - 1)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    counts = np.bincount(raw, minlength=256)
    n, w = len(raw), len(ws)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    lines = [x for x in text.split("\n") if x]
    again = 1 - len(set(lines)) / len(lines) if lines else 0.0
    ends = sum(x[-1] in "#$%&*!|" for x in ws) / w
    return [
        0.0,
        math.log1p(w) / 10,
        n / w / 10,
        len(set(ws)) / w,
        again,
        math.log1p(len(lines)) / 10,
        upper / (upper + lower + 1),
        int(counts[128:].sum()) / n,
        int(counts[48:58].sum()) / n,
        ends,
        len(ws[-1]) / 20 if len(ws[-1]) < 40 else 2.0,
        float(w < 20),
        *[int(counts[ord(c)]) / n for c in MARKS],
    ]


def expand(plain: np.ndarray) -> np.ndarray:
    """The numbers, their logarithms and their squares: bends that a linear model can use."""
    plain = np.asarray(plain, dtype=np.float64).reshape(-1, N_PLAIN)
    return np.concatenate([plain, np.log(plain + 1e-3), plain * plain], axis=1)
