"""Token ids of whole texts, fast: a text is cut where the tokenizer always cuts, and each distinct piece is encoded once.

Natural text repeats its words; so each Python worker keeps the ids of the pieces it has met, as little-endian
unsigned 32-bit bytes, and a text costs one regular-expression pass, a look-up for each piece and a join. Pieces not
met before go to the tokenizer in batches. The result equals encoding the whole text (tests compare them).
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import chain, islice
from struct import pack

import numpy as np

from tallymark.llm.common import lower_ascii

# The code points with the Unicode property White_Space.
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# ASCII punctuation but for the apostrophe, which may open a contraction, and the letters of Latin-1.
_MARKS = r"!-&(-/:-@\[-`{-~"
_LETTERS = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"


def _pieces(space: str, glue: str, rest: str) -> re.Pattern:
    """Runs of letters and runs of marks where the tokenizer surely cuts on either side; else all up to white space."""
    return re.compile(rf"{glue}[{_LETTERS}]+(?![^{space}{_MARKS}])|{glue}[{_MARKS}]+(?![^{space}{_LETTERS}])|{glue}[^{space}]+{rest}")


#: Byte-level BPE glues one space to what comes after it; other white space stands alone.
GLUED = _pieces(_SPACE, " ?", rf"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: Tokenizers that drop white space and case.
PLAIN = _pieces(r"\t-\r ", "", "")


class Encoder:
    """``keep``: pieces remembered by one worker; beyond that it forgets the later half. ``special``: the file's added tokens, where
    a text names them, are their ids, as by the library's default; else their names are ordinary text."""

    def __init__(self, path: str, keep: int = 400_000, longest: int = 64, special: bool = False) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # pieces are ordinary text
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()} if special else {}
        self.split = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")").split if added else None
        self.added, self.added_ids = added, {i: np.array([i], "<u4").tobytes() for i in added.values()}
        self.cut = GLUED if self.tokenizer.normalizer is None else PLAIN
        self.folds = "Lowercase" in str(self.tokenizer.normalizer)
        self.keep, self.longest, self.ids = keep, longest, dict(self.added_ids)

    def _cut(self, text: str) -> list[str | int]:
        """The pieces of a text; an added token is its id."""
        cut = self.cut.findall
        if self.split is None or not any(c in text for c in self.added):
            return cut(lower_ascii(text) if self.folds else text)
        out: list[str | int] = []
        for k, part in enumerate(self.split(text)):
            if k % 2:
                out.append(self.added[part])
            else:
                out += cut(lower_ascii(part) if self.folds else part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.ids) > self.keep:  # the pieces met first are the common ones
            self.ids = dict(islice(self.ids.items(), max(self.keep // 2, len(self.added_ids))))
        known = self.ids
        pieces = [self._cut(t) for t in texts]
        new = list(set(chain.from_iterable(pieces)).difference(known))
        odd = {}  # long pieces rarely come again: not kept
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                (known if len(p) <= self.longest else odd)[p] = pack(f"<{len(ids := e.ids)}I", *ids)
        if odd:
            return [b"".join([known[p] if p in known else odd[p] for p in ps]) for ps in pieces]
        return [b"".join(map(known.__getitem__, ps)) for ps in pieces]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path, special=True)


def batches_of(texts: list[str | None], chars: int = 2_000_000):
    """Slices of the texts (null: empty) that hold about so many characters, to bound memory."""
    some, size = [], 0
    for t in texts:
        some.append(t or "")
        size += len(some[-1])
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some
