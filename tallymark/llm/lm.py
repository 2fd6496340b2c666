"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

A token is a word or the end of a text, and stands on a leaf: one of CLASSES x SLOTS. The end and the COMMON commonest
words have a leaf each, in classes of like frequency; other words share the rest, in classes by a hash of their last
letters and slots by a hash of the word. So

    P(token | context) = P(class | context) P(slot | class, context) P(token | leaf).

The first two factors are softmaxes over sums of weight rows of the active features. For the class these are: a
constant, the word before (bigram), the word two before (skip), both (trigram), and the class of the word three before
(skip); for the slot, each together with the class: a constant, the word before, the word two before. Each feature is
hashed to one of ``space`` rows of its table. P(token | leaf) is by counts, with one unseen token on each shared leaf, so
that all tokens' probabilities sum to one.

Training, over all training texts: (1) one shuffle counts words; the counts name the common words and give the constants
their start; (2) ROUNDS distributed gradient updates, each over its own share of the texts (by hash of the id). Tasks
return for every weight the observed count and the exact expected count (the sum of the model's probabilities, in
integer units of 2^-15, so that sums do not depend on their order); Spark sums them by blocks of rows; the step is the
gradient over the larger of the two counts, at a falling rate. ``space`` follows the characters of the corpus, from 2^12 to 2^16 rows, and
so does a task's share of them, so the sums that travel stay in proportion to the texts.

Scoring: texts are dealt to chunks (parts of the files they are read from). A chunk asks for the counts of its distinct
words, one shuffle by word answers; of the common words the counts (COMMON + 1 numbers) are sent to
all. So a word has one row for each chunk at most, and the vocabulary is never whole in one place. A task reads its
chunk's counts, then the texts one batch at a time, in slices of 64 x SLICE bytes, whose distinct words are looked up once; a long
text is cut between words.

Broadcast: the weights (at most 2 x 2^16 x 32 floats, 16 MB), the leaves' totals and the common words.

Nothing is drawn at random: scores do not depend on how the rows are laid out.

Defined results: null is the empty text, which is one token, the end; repeated rows count and are scored as often as
they occur; a row with a null id is scored and not learned from; without training texts every token has base
probability 1; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise, repeat
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import PLACE, crc_mod, lower_ascii, placed, staged, words

CLASSES = SLOTS = 32
#: The first half of the leaves: the end and the common words.
COMMON = CLASSES * SLOTS // 2 - 1
ROUNDS, BLOCK_ROWS, SLICE = 4, 128, 1 << 15
RATE, DAMP = 0.6, 15.0
#: Bytes of a (compressed) file that are scored together.
CHUNK_BYTES = 8_000_000
END = " "  # no word holds a space
UNIT = 1 << 15
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD], dtype=np.uint64)
_KINDS = (5, 3)


def hash_of(word: str) -> int:
    return 1 if word == END else xxhash.xxh64_intdigest(word.encode("utf-8", "replace"), 42)


@lru_cache(maxsize=1 << 16)
def _class_of(tail: str) -> int:
    half = CLASSES // 2
    return half + xxhash.xxh32_intdigest(tail.encode("utf-8", "replace")) % half


def shared_leaves(ws: list[str] | pa.Array, hashes: np.ndarray) -> np.ndarray:
    """The leaves of words that have none of their own: class by the last two characters, marks after letters left out."""
    ws = pa.array(ws, pa.string()) if isinstance(ws, list) else ws
    bare = pc.utf8_rtrim(ws, characters=".,;:!?")
    tails = pc.utf8_slice_codeunits(pc.if_else(pc.equal(pc.binary_length(bare), 0), ws, bare), -2).dictionary_encode()
    classes = np.fromiter(map(_class_of, tails.dictionary.to_pylist()), np.int64, len(tails.dictionary))[tails.indices.to_numpy()]
    return classes * SLOTS + ((hashes >> np.uint64(40)) % np.uint64(SLOTS)).astype(np.int64)


def shared_leaf(word: str) -> int:
    return int(shared_leaves([word], np.array([hash_of(word)], dtype=np.uint64))[0])


def strings(ws: pa.Array) -> list[str]:
    """The words as Python's; several times as fast as to_pylist, which makes a scalar of each."""
    return ws.to_numpy(zero_copy_only=False).tolist()


def leaves_of(ws: pa.Array, hashes: np.ndarray, own: pa.Array) -> np.ndarray:
    """The leaves of words. ``own``: the end and the common words, by leaf."""
    mine = pc.index_in(ws, own).fill_null(-1).to_numpy()
    return np.where(mine < 0, shared_leaves(ws, hashes), mine)


class Words:
    """The distinct words of a slice: by number, hash and leaf. The last number is the end's. ``common``: the words with leaves of their own."""

    def __init__(self, common: tuple[str, ...] = ()) -> None:
        self.own = pa.array([END, *common], pa.string())

    def numbers(self, ws: list[str] | pa.Array) -> np.ndarray:
        """The numbers of the words of a new slice."""
        coded = (pa.array(ws, pa.string()) if isinstance(ws, list) else ws).dictionary_encode()
        distinct = coded.dictionary
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, strings(distinct), repeat(42)), np.uint64, len(distinct))
        leaves = leaves_of(distinct, hashes, self.own)
        self.hashes, self.leaves = np.r_[np.where(leaves == 0, np.uint64(1), hashes), np.uint64(1)], np.r_[leaves, 0]
        return coded.indices.to_numpy()


_GAP = re.compile(r"[\x20\x09-\x0D]")


def word_lists(text: str | None, chars: int = 1 << 20) -> Iterator[list[str]]:
    """The text's words, of about so many characters at a time."""
    text, at = text or "", 0
    while len(text) - at > chars:
        gap = _GAP.search(text, at + chars)
        if gap is None:
            break
        yield words(lower_ascii(text[at : gap.start()]))
        at = gap.start()
    yield words(lower_ascii(text[at:] if at else text))


def slices(texts: list[str | None], tokens: int = SLICE) -> Iterator[tuple[list[str], np.ndarray]]:
    """(tokens, the text that each belongs to): the texts' words, an end after each text, so many at a time."""
    ws: list[str] = []
    owners: list[np.ndarray] = []
    for i, text in enumerate(texts):
        for mine in word_lists(text):
            ws += mine
            owners.append(np.full(len(mine), i))
            while len(ws) >= tokens:
                of = np.concatenate(owners)
                yield ws[:tokens], of[:tokens]
                ws, owners = ws[tokens:], [of[tokens:]]
        ws.append(END)
        owners.append(np.array([i]))
    if ws:
        yield ws, np.concatenate(owners)


def streams(texts: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Slices of the texts: (words in lower case, the text that each token belongs to, which tokens are words; the others are ends). Arrow's
    ASCII functions know just the white space that ends a word."""
    sizes, most = pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64), 64 * SLICE
    if sizes.max(initial=0) > most // 2:
        for ws, of in slices(texts.to_pylist()):
            yield pa.array([w for w in ws if w != END], pa.string()), of, np.array([w != END for w in ws])
        return
    part = np.cumsum(sizes) // most
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(texts)] if len(texts) else []
    for i, j in pairwise(cuts):
        bare = pc.ascii_trim_whitespace(pc.ascii_lower(texts[i:j].fill_null("")))
        full = pc.not_equal(bare, "")
        lists = pc.ascii_split_whitespace(bare.filter(full))
        n = np.zeros(j - i, dtype=np.int64)
        n[full.to_numpy(zero_copy_only=False)] = pc.list_value_length(lists).to_numpy()
        word = np.ones(n.sum() + j - i, dtype=bool)
        word[np.cumsum(n + 1) - 1] = False
        yield lists.flatten(), np.repeat(np.arange(i, j), n + 1), word


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(28))


class Context:
    """Weight rows of a stream of tokens, slice by slice. Before a text's first token stands the end of another, which
    serves as its beginning; what lies before a beginning is left out."""

    def __init__(self, space: int) -> None:
        self.space, self.h, self.k = space, np.ones(3, dtype=np.uint64), np.zeros(3, dtype=np.int64)

    def rows(self, h: np.ndarray, leaves: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(rows for the class, rows for the slot), an array for each kind of feature."""
        n = len(h)
        h, k = np.concatenate([self.h, h]), np.concatenate([self.k, leaves // SLOTS])
        self.h, self.k = h[-3:], k[-3:]
        one, two = h[2 : n + 2], h[1 : n + 1]
        two = np.where(one == 1, np.uint64(1), two)
        three = np.where((one == 1) | (two == 1), 0, k[:n]).astype(np.uint64)
        own = k[3:].astype(np.uint64)
        to = lambda x, first: (first + (_mix(x) >> np.uint64(20)) % np.uint64(self.space - first)).astype(np.int32)
        of_class = [to(one * _SEEDS[0], 1), to(two * _SEEDS[1], 1), to((one * _SEEDS[2]) ^ two, 1), to(three * _SEEDS[3] + np.uint64(7), 1)]
        of_slot = [to((one * _SEEDS[4]) ^ own, SLOTS), to((two * _SEEDS[3]) ^ (own + np.uint64(99)), SLOTS)]
        return [np.zeros(n, dtype=np.int32), *of_class], [k[3:].astype(np.int32), *of_slot]


#: Tokens whose scores are held at once: few enough for a processor's cache.
PART = 2048


def probabilities(w: np.ndarray, rows: list[np.ndarray]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """For each PART of the tokens: (their places, scores, exponentials of these, sums of these): tokens x width, the same, tokens. The next
    part takes the place of the one before. The constants' greatest weight is 0 and the steps are bounded, so no exponential overflows."""
    scores, more = np.empty((2, min(PART, len(rows[0])), w.shape[1]), w.dtype)
    for i in range(0, len(rows[0]), PART):
        part = slice(i, min(i + PART, len(rows[0])))
        z, e = scores[: part.stop - i], more[: part.stop - i]
        w.take(rows[0][part], axis=0, out=z, mode="clip")  # no row is out of range; other modes copy
        for r in rows[1:]:
            z += w.take(r[part], axis=0, out=e, mode="clip")
        np.exp(z, out=e)
        yield part, z, e, e.sum(axis=1, dtype=np.float64)


def in_units(w: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """The probabilities in units, width x tokens: whole numbers, so their sums are exact in any order."""
    p = np.empty((w.shape[1], len(rows[0])))
    for part, _, e, total in probabilities(w, rows):
        x = np.ascontiguousarray(e.T) * (UNIT / total)
        p[:, part] = np.rint(x, out=x)
    return p


#: Sums of units are kept two to a 64-bit number, of fewer tokens than would let one run into the other.
HALF, TOKENS = 32, (1 << 17) - 1


class Tally:
    """Observed and expected counts (in units) of the weights of one level: rows x width, summed over the tokens that ``add`` gets."""

    def __init__(self, w: np.ndarray) -> None:
        self.w, (space, width) = w, w.shape
        self.seen, self.expected = np.zeros(space * width, dtype=np.int64), np.zeros((space, width), dtype=np.int64)
        self.pairs, self.tokens = np.zeros((space, width // 2), dtype=np.uint64), 0

    def add(self, rows: list[np.ndarray], want: np.ndarray) -> None:
        half = self.pairs.shape[1]
        for i in range(0, len(want), PART):
            some, hit = [r[i : i + PART].astype(np.int64) for r in rows], want[i : i + PART]
            if self.tokens + len(hit) > TOKENS:
                self.part()
            self.tokens += len(hit)
            p = in_units(self.w, some)
            p[half:] *= 1 << HALF
            p[:half] += p[half:]  # below 2^48: exact
            x = p[:half].astype(np.int64).view(np.uint64)
            for r in some:
                np.add.at(self.seen, r * (2 * half) + hit, 1)
                if not r.any():  # the constant
                    self.pairs[0] += x.sum(axis=1)
                    continue
                for column, units in zip(self.pairs.T, x, strict=True):
                    np.add.at(column, r, units)

    def part(self) -> None:
        """Takes the pairs apart."""
        half = self.pairs.shape[1]
        self.expected[:, :half] += (self.pairs & np.uint64((1 << HALF) - 1)).view(np.int64)
        self.expected[:, half:] += (self.pairs >> np.uint64(HALF)).view(np.int64)
        self.pairs[:], self.tokens = 0, 0

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        self.part()
        return self.seen, self.expected.reshape(-1)


def space_of(chars: int) -> int:
    return 1 << min(16, max(12, round(math.log2(max(1, chars) / (1 << 17)))))


def gradient(df: DataFrame, w: list[np.ndarray], common: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Observed and expected counts of every weight over the texts, expected ones in units: 2 x space x width. df: text."""
    space, width = w[0].shape
    cells = space * width

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, context, tallies = Words(common), Context(space), [Tally(x) for x in w]
        for batch in batches:
            for ws, _, word in streams(batch.column(0)):
                ids = np.full(len(word), -1)
                ids[word] = known.numbers(ws)
                leaves = known.leaves[ids]
                for tally, f, want in zip(tallies, context.rows(known.hashes[ids], leaves), (leaves // SLOTS, leaves % SLOTS), strict=True):
                    tally.add(f, want)
        pa.default_memory_pool().release_unused()
        seen, expected = zip(*[tally.counts() for tally in tallies], strict=True)
        step = BLOCK_ROWS * width
        blocks = [(level * cells + b, seen[level][b : b + step].tobytes(), expected[level][b : b + step].tobytes()) for level in (0, 1) for b in range(0, cells, step)]
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*blocks, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["block", "seen", "expected"])

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        add = lambda c: sum(np.frombuffer(x, np.int64) for x in pdf[c]).tobytes()
        return pd.DataFrame({"block": pdf["block"][:1], "seen": [add("seen")], "expected": [add("expected")]})

    schema = "block bigint, seen binary, expected binary"
    sums = df.mapInArrow(rows, schema).groupBy("block").applyInPandas(total, schema).toPandas().sort_values("block")  # 2 x space / BLOCK_ROWS rows
    if not len(sums):
        return np.zeros((2, space, width)), np.zeros((2, space, width))
    join = lambda c: np.frombuffer(b"".join(sums[c]), np.int64).reshape(2, space, width).astype(float)
    return join("seen"), join("expected") / UNIT


class Start(NamedTuple):
    common: tuple[str, ...]
    leaves: np.ndarray  # tokens and distinct words of the training texts on each leaf


def start(vocabulary: DataFrame) -> Start:
    """The common words, and the tokens and words on each leaf, by the counts of all training texts. vocabulary: word, c (how often it
    occurs), a row a word."""
    top = vocabulary.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(COMMON).collect()
    common = tuple(r["word"] for r in top)

    def on_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, out = pa.array([END, *common], pa.string()), np.zeros((CLASSES * SLOTS, 2), dtype=np.int64)
        for batch in batches:
            leaf = leaves_of(batch.column(0), batch.column(2).to_numpy().view(np.uint64), own)
            out[:, 0] += np.bincount(leaf, batch.column(1).to_numpy(), minlength=len(out)).astype(np.int64)
            out[:, 1] += np.bincount(leaf, minlength=len(out))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out[:, 0]), pa.array(out[:, 1])], ["leaf", "n", "v"])

    leaves = np.zeros((CLASSES * SLOTS, 2), dtype=np.int64)
    for k, n, v in vocabulary.select("word", "c", F.xxhash64("word")).mapInArrow(on_leaves, "leaf bigint, n bigint, v bigint").groupBy("leaf").agg(F.sum("n"), F.sum("v")).collect():
        leaves[k] = n, v
    return Start(common, leaves)


def train(texts: DataFrame, begin: Start, chars: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The weights for classes and slots. texts: doc_id, text of the training rows."""
    space = space_of(chars)
    w = [np.zeros((space, CLASSES)), np.zeros((space, SLOTS))]
    by_class = begin.leaves[:, 0].reshape(CLASSES, SLOTS)
    w[0][0] = np.log(by_class.sum(axis=1) + 1)
    w[1][:CLASSES] = np.log(by_class + 0.5)
    w[0][0] -= w[0][0].max()
    w[1][:CLASSES] -= w[1][:CLASSES].max(axis=1, keepdims=True)
    tasks = max(8, chars // rounds // (2048 * space))
    for n in range(rounds):
        share = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == n).select("text").coalesce(tasks)
        seen, expected = gradient(share, [x.astype(np.float32) for x in w], begin.common)
        for x, s, e in zip(w, seen, expected, strict=True):
            x += RATE / (1 + n / 2) * (s - e) / (np.maximum(s, e) + DAMP)
    return [x.astype(np.float32) for x in w]


class Model(NamedTuple):
    weights: list[np.ndarray]
    common: tuple[str, ...]
    counts: np.ndarray  # of the end and the common words
    tokens: int
    distinct: int
    leaves: np.ndarray  # tokens and distinct words on each leaf


def log_probabilities(model: Model, hashes: np.ndarray, leaves: np.ndarray, counts: np.ndarray, context: Context) -> np.ndarray:
    """log10 P of each token of a slice."""
    out = np.zeros(len(hashes))
    for w, f, want in zip(model.weights, context.rows(hashes, leaves), (leaves // SLOTS, leaves % SLOTS), strict=True):
        for part, z, _, total in probabilities(w, f):
            out[part] += z[np.arange(len(z)), want[part]] - np.log(total)
    shared = leaves > COMMON
    out /= np.log(10)
    out[shared] += np.log10(counts[shared] + 1.0) - np.log10(model.leaves[leaves[shared]].sum(axis=1) + 1.0)
    return out


def word_rows(docs: DataFrame) -> DataFrame:
    """(word, chunk, n): how often each word of a chunk occurs in its training texts (0: in others only). A chunk may
    have several rows for a word, by task."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        held = 0

        def add(chunk: int, ws: pa.Array, n: np.ndarray) -> None:
            nonlocal held
            counts.setdefault(chunk, []).append((ws, n))
            held += len(ws) + ws.nbytes // 64

        def flush(most: int) -> Iterator[pa.RecordBatch]:
            """Counts of the same word are put together; if there are still more than so many, they are let go."""
            nonlocal held
            parts, held = [*counts.items()], 0
            counts.clear()
            for chunk, some in parts:
                coded = pa.concat_arrays([ws for ws, _ in some]).dictionary_encode()
                add(chunk, coded.dictionary, np.bincount(coded.indices, np.concatenate([n for _, n in some]), len(coded.dictionary)).astype(np.int64))
            if held > most:
                for chunk, [(ws, n)] in counts.items():
                    yield pa.RecordBatch.from_arrays([ws, pa.array(np.full(len(n), chunk)), pa.array(n)], ["word", "chunk", "n"])
                counts.clear()
                held = 0

        for batch in batches:
            chunk, learn = batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
            order = np.lexsort((learn, chunk))
            texts, chunk, learn = batch.column(0).take(pa.array(order)), chunk[order], learn[order]
            cuts = [0, *(np.flatnonzero((chunk[1:] != chunk[:-1]) | (learn[1:] != learn[:-1])) + 1).tolist(), len(order)] if len(order) else []
            for i, j in pairwise(cuts):
                for ws, _, _ in streams(texts[i:j]):
                    found = ws.value_counts()
                    add(chunk[i], found.field(0), found.field(1).to_numpy() * int(learn[i]))
                    if held > 2_000_000:
                        yield from flush(1_000_000)
                if learn[i]:
                    add(chunk[i], pa.array([END]), np.array([j - i]))
        yield from flush(-1)
        pa.default_memory_pool().release_unused()  # a worker lives on beside others

    return docs.select("text", "chunk", "learn").mapInArrow(rows, "word string, chunk bigint, n bigint")


_OUT = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def score(docs: DataFrame, learn: Column, chunk: Column, rounds: int = ROUNDS) -> DataFrame:
    """docs: doc_id, text and what ``learn`` and ``chunk`` read. ``chunk`` names the share of the texts that is scored
    together; texts that are read together should share it, and it must bound the distinct words that a task holds.
    For each document: n_tokens, n_known, train_tokens, base_score and score (log10)."""
    docs = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"), chunk.cast("bigint").alias("chunk"))
    chars = docs.where("learn").agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
    whole = Window.partitionBy("word").orderBy("chunk")
    count = F.sum("n").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    counted = word_rows(docs).select("word", "chunk", count.alias("c"), (F.row_number().over(whole) == 1).alias("once"))
    vocabulary = staged(counted, "lm-words")
    begin = start(vocabulary.where("once and c > 0").select("word", "c"))
    common, leaves = begin
    weights = train(docs.where("learn"), begin, chars, rounds)
    counts = np.r_[leaves[: len(common) + 1, 0]]
    model = Model(weights, common, counts, int(leaves[:, 0].sum()), int(leaves[:, 1].sum()), leaves)
    names = _OUT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, at, base = [END, *common], None, math.log10(model.tokens + model.distinct + 1.0)
        first = (np.array([hash_of(w) for w in own], dtype=np.uint64), np.arange(len(own)), counts)
        number: dict[str, int] = {}
        held: list[tuple[np.ndarray, ...]] = []  # of the words by number: hashes, leaves, counts
        for batch in batches:
            chunks, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.r_[True, (chunks[1:] != chunks[:-1]) | (kinds[1:] != kinds[:-1])]).tolist() if len(batch) else []
            for i, j in zip(cuts, [*cuts[1:], len(batch)], strict=True):
                if chunks[i] != at:
                    at, held, number = chunks[i], [first], {w: k for k, w in enumerate(own)}
                    pa.default_memory_pool().release_unused()
                if kinds[i] == 0:
                    ws, n, h = batch.column(2)[i:j], batch.column(3)[i:j].to_numpy(), batch.column(6)[i:j].to_numpy().view(np.uint64)
                    number.update(zip(strings(ws), range(len(number), len(number) + len(n)), strict=True))
                    held.append((h, shared_leaves(ws, h), n))
                    continue
                if len(held) > 1:
                    held = [tuple(map(np.concatenate, zip(*held, strict=True)))]
                hashes, leaves, n = held[0]
                ids, texts = batch.column(4)[i:j], batch.column(5)[i:j]
                for k in range(0, j - i, 500):
                    some = texts[k : k + 500]
                    context, sums = Context(len(weights[0])), np.zeros((4, len(some)))
                    for ws, of, word in streams(some):
                        coded = ws.dictionary_encode()
                        tokens = np.zeros(len(word), dtype=np.int64)
                        tokens[word] = np.fromiter(map(number.__getitem__, strings(coded.dictionary)), np.int64, len(coded.dictionary))[coded.indices.to_numpy()]
                        c = n[tokens]
                        logp = log_probabilities(model, hashes[tokens], leaves[tokens], c, context)
                        for s, x in zip(sums, (None, (c > 0).astype(float), np.log10(c + 1.0) - base, logp), strict=True):
                            s += np.bincount(of, x, minlength=len(some))
                    tokens, known = sums[:2].astype(np.int64)
                    columns = [ids[k : k + 500], pa.array(tokens), pa.array(known), pa.array(np.full(len(some), model.tokens)), pa.array(sums[2]), pa.array(sums[3])]
                    yield pa.RecordBatch.from_arrays(columns, names)

    asked = vocabulary.where(~F.col("word").isin(END, *common)).select("chunk", F.lit(0).alias("kind"), "word", "c", F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.xxhash64("word").alias("hash"))
    own = docs.select("chunk", F.lit(1).alias("kind"), F.lit(None).cast("string").alias("word"), F.lit(None).cast("bigint").alias("c"), "doc_id", "text", F.lit(None).cast("bigint").alias("hash"))
    both = asked.unionByName(own).repartition("chunk").sortWithinPartitions("chunk", "kind")
    return both.mapInArrow(run, "doc_id bigint, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def file_chunk(df: DataFrame, size: int = CHUNK_BYTES) -> Column:
    """Of rows with PLACE: the file a row is read from, in as many parts as its size asks for; where there is no file, by the characters of
    the whole table."""
    part = F.xxhash64("doc_id", "text", PLACE)  # a row that repeats is in many chunks
    try:
        m = df.select("_metadata.file_path", "_metadata.file_size") and F.col("_metadata")
    except AnalysisException:
        chars = df.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0))).first()[0]
        return F.pmod(part, F.lit(1 + chars // (2 * size)))
    return F.xxhash64(m["file_path"], F.pmod(part, F.ceil(m["file_size"] / size)))


def digest(df: DataFrame) -> DataFrame:
    df = placed(df.select("doc_id", "text"))
    docs = df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", file_chunk(df).alias("_chunk"))
    out = score(docs, crc_mod("doc_id", 7) != 2, F.col("_chunk"))
    return out.withColumn("held_out", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False))).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
