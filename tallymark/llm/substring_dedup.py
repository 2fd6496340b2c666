"""Removal of passages that an earlier document has already, by FM-indexes of shards.

A window is ``window`` consecutive words of one document. Every word that a window covers goes if the window's words also
start somewhere in a document with a smaller id.

1. Anchors: of the ``gram``-word sequences in a window one is its anchor: by the least hash, the leftmost of equal ones,
   and any other before those of very short words, which are the common ones. Equal windows have equal anchors, so only documents that share one can share a window.
   One aggregate finds the anchors that two documents have, one join brings these to their documents.
2. Pieces: a document's windows with such anchors are cut into runs around the same anchor, with their words as text. Equal
   pieces of a task become one row with its places. Rows are dealt by anchor.
3. Shards: a task takes anchors in order until it holds SHARD words, indexes their pieces (``fm_index``) and streams the
   pieces through the index: backward search gives the matching statistics; where ``window`` words match, the interval's
   least id decides which places of the piece are to go.
4. The marked places return to their documents, and their words are cut out.

Scale: everything is linear in the words. What is shuffled is two numbers an anchor (about a sixth of the words), pieces for
shared anchors, and the texts twice. A passage in a third of all documents is one row of each task; if a task has it more
than PLACES times, the places travel apart, dealt evenly, and meet the passage's verdict in a join with a row for each piece
on one side, which Spark may split. Should the different pieces around one anchor exceed a shard, they are cut into single
windows and dealt again by these; then equal windows alone meet. Nothing is capped. Words are compared as text.

Defined results: null and empty texts have no words. Rows without an id keep all words and take none from others. Rows that
repeat an id are judged each by its own text, against smaller ids alone. Texts with fewer words than a window keep all.
An empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import sliced, staged
from tallymark.llm.fm_index import FMIndex

#: Words that a task cuts into pieces at a time; words of a shard; places of one piece that travel with it.
FLUSH, SHARD, PLACES = 1 << 20, 1 << 20, 32
_PLACE = np.dtype([("doc", "<i8"), ("text", "<i8"), ("start", "<i4")])
_PIECE = pa.schema([("anchor", pa.int64()), ("piece", pa.binary()), ("places", pa.binary()), ("least", pa.int64()), ("most", pa.int64())])
_FOUND = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("text", pa.int64()), ("start", pa.int32()), ("marks", pa.int64()), ("piece", pa.binary()), ("places", pa.binary()), ("least", pa.int64()), ("most", pa.int64()), ("mins", pa.list_(pa.int64()))])
_PIECE_SQL = "anchor bigint, piece binary, places binary, least bigint, most bigint"
_FOUND_SQL = "kind tinyint, doc bigint, text bigint, start int, marks bigint, piece binary, places binary, least bigint, most bigint, mins array<bigint>"
#: Kinds of what a shard's task says: marked places, places that wait for a verdict, such a verdict, pieces to be dealt again.
MARKED, WAITING, VERDICT, AGAIN = range(4)
_NEVER = np.iinfo(np.int64).max


def spelled(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words joined by blanks; where each word starts and ends."""
    raw = np.frombuffer(joined, dtype=np.uint8)
    blanks = np.flatnonzero(raw == 32)
    return raw, np.r_[0, blanks + 1], np.r_[blanks, len(raw)]


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ h >> np.uint64(29)


class Words:
    """Some documents' words, one after the other: where they start and end, and each document's part. A word's hash is of its
    length and first 16 bytes: it serves to choose anchors, words are compared as text."""

    def __init__(self, texts: Iterable[str | None]) -> None:
        parts = [b" ".join((t or "").encode("utf-8", "surrogatepass").split()) for t in texts]
        self.ends = np.r_[0, np.cumsum([p.count(b" ") + 1 if p else 0 for p in parts], dtype=np.int64)]
        self.text = b" ".join(p for p in parts if p)
        raw, start, end = spelled(self.text)
        if not len(raw):
            start = end = np.zeros(0, dtype=np.int64)
        self.lengths, self.places = end - start, np.r_[start, len(raw) + 1]
        eight = np.lib.stride_tricks.sliding_window_view(np.r_[raw, np.zeros(24, dtype=np.uint8)], 8)
        part = lambda at, n: np.ascontiguousarray(eight[at]).view("<u8")[:, 0] & _MASKS[np.clip(n, 0, 8)]
        second = np.where(self.lengths > 8, start + 8, start)
        self.hashes = _mix(_mix(part(start, self.lengths) + self.lengths.astype(np.uint64)) + part(second, self.lengths - 8))

    def piece(self, first: int, end: int) -> bytes:
        return self.text[self.places[first] : self.places[end] - 1]


def anchored(w: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: document, first window's start, last window's start, anchor."""
    none = np.zeros(0, dtype=np.int64)
    if len(w.hashes) < window:
        return none, none, none, none
    n, span, h, chars = len(w.hashes), window - gram + 1, w.hashes, w.lengths
    mixed, total = np.zeros(n - gram + 1, dtype=np.uint64), np.zeros(n - gram + 1, dtype=np.int64)
    for k in range(gram):
        mixed = _mix(mixed + h[k : n - gram + 1 + k])
        total += chars[k : n - gram + 1 + k]
    key = ((total < 3 * gram + 3).astype(np.uint64) << np.uint64(63)) | (mixed >> np.uint64(1))
    at = np.arange(n - window + 1)
    best = np.lib.stride_tricks.sliding_window_view(key, span).argmin(axis=1) + at
    doc = np.repeat(np.arange(len(w.ends) - 1), np.diff(w.ends))[: len(at)]
    valid = at + window <= w.ends[doc + 1]
    new = valid & np.r_[True, ~valid[:-1] | (best[1:] != best[:-1]) | (doc[1:] != doc[:-1])]
    first = np.flatnonzero(new)
    run = np.cumsum(new)[valid]
    last = at[valid][np.r_[run[1:] != run[:-1], True]] if len(first) else none
    return doc[first], first, last, mixed[best[first]].view(np.int64)


def _flushes(batches: Iterator[pa.RecordBatch], text: int) -> Iterator[pa.Table]:
    """The rows in tables of about FLUSH words, by the bytes of the texts."""
    held, size = [], 0
    for b in sliced(batches):
        held.append(b)
        size += b.column(text).nbytes
        if size > 6 * FLUSH:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _rows(anchors: np.ndarray, pieces: list[bytes], of: np.ndarray, places: np.ndarray, most_places: int) -> Iterator[pa.RecordBatch]:
    """A row for each piece, with its places (numbers in ``of``); places of a piece that has very many go in rows of their own."""
    order = np.argsort(of, kind="stable")
    places, of = places[order], of[order]
    n = np.bincount(of, minlength=len(pieces))
    few = n <= most_places
    starts = np.r_[0, np.cumsum(n)[:-1]]
    ends = np.r_[0, np.cumsum(n * few)] * _PLACE.itemsize
    own = pa.Array.from_buffers(pa.binary(), len(pieces), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(places[few[of]].tobytes())])
    least, most = np.minimum.reduceat(places["doc"], starts), np.maximum.reduceat(places["doc"], starts)
    yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(pieces, pa.binary()), own, pa.array(least), pa.array(most)], schema=_PIECE)
    for p in np.flatnonzero(~few):
        some = [places[at : min(at + 512, starts[p] + n[p])] for at in range(starts[p], starts[p] + n[p], 512)]
        keys = [xxhash.xxh64_intdigest(s[:1].tobytes()) - (1 << 63) for s in some]
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([pieces[p]] * len(some), pa.binary()), pa.array([s.tobytes() for s in some], pa.binary()), none, none], schema=_PIECE)


def _anchors(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _flushes(batches, 1):
            doc, _, _, anchor = anchored(Words(t.column(1).to_pylist()), window, gram)
            yield pa.RecordBatch.from_arrays([pa.array(anchor), t.column(0).combine_chunks().take(pa.array(doc))], ["anchor", "doc"])

    return run


def _pieces(window: int, gram: int, most_places: int):
    """(doc, text, key of the text, shared anchors) to rows of pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _flushes(batches, 1):
            ids, keys = t.column(0).to_numpy(), t.column(2).to_numpy()
            w = Words(t.column(1).to_pylist())
            doc, first, last, anchor = anchored(w, window, gram)
            lists = t.column(3).combine_chunks()
            shared, cuts = lists.flatten().to_numpy(), np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]
            runs = np.searchsorted(doc, np.arange(len(ids) + 1))
            keep = np.concatenate([np.isin(anchor[runs[i] : runs[i + 1]], shared[cuts[i] : cuts[i + 1]]) for i in range(len(ids))])
            doc, first, last, anchor = doc[keep], first[keep], last[keep], anchor[keep]
            if not len(doc):
                continue
            seen: dict[bytes, int] = {}
            a, b, text = w.places[first].tolist(), (w.places[last + window] - 1).tolist(), w.text
            of = np.array([seen.setdefault(text[x:y], len(seen)) for x, y in zip(a, b, strict=True)])
            places = np.empty(len(doc), dtype=_PLACE)
            places["doc"], places["text"], places["start"] = ids[doc], keys[doc], first - w.ends[doc]
            yield from _rows(anchor[np.unique(of, return_index=True)[1]], list(seen), of, places, most_places)

    return run


def _windows(window: int, most_places: int):
    """Rows of pieces to rows of single windows, dealt by all their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            seen: dict[bytes, int] = {}
            of, parts, apart = [], [], []
            for piece, raw, least, most in zip(*(b.column(c).to_pylist() for c in ("piece", "places", "least", "most")), strict=True):
                words, places = piece.split(b" "), np.frombuffer(raw, dtype=_PLACE)
                for k in range(len(words) - window + 1):
                    key = b" ".join(words[k : k + window])
                    moved = places.copy()
                    moved["start"] += k
                    if len(moved):
                        of += [seen.setdefault(key, len(seen))] * len(moved)
                        parts.append(moved)
                    else:  # its places travel apart, its ids count
                        apart.append((key, least, most))
            hashed = lambda keys: np.array([xxhash.xxh64_intdigest(k) for k in keys], dtype=np.uint64).view(np.int64)
            if seen:
                yield from _rows(hashed(seen), list(seen), np.array(of), np.concatenate(parts), most_places)
            if apart:
                keys, least, most = zip(*apart, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashed(keys)), pa.array(keys, pa.binary()), pa.array([b""] * len(keys), pa.binary()), pa.array(least), pa.array(most)], schema=_PIECE)

    return run


class Shard:
    """Pieces of some anchors: each with its least and greatest id, its places, and whether others travel apart."""

    def __init__(self) -> None:
        self.pieces: dict[bytes, list] = {}
        self.words = 0

    def add(self, piece: bytes, places: bytes, least: int, most: int) -> None:
        held = self.pieces.get(piece)
        if held is None:
            self.words += piece.count(b" ") + 2
            self.pieces[piece] = [least, most, [places], not places]
        else:
            held[0], held[1], held[3] = min(held[0], least), max(held[1], most), held[3] or not places
            held[2].append(places)

    def verdicts(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """For each piece (aligned at the right) and window the least id of all pieces that hold it; pieces' lengths."""
        raw, start, end = spelled(b" ".join(self.pieces))
        lengths = np.array([p.count(b" ") + 1 for p in self.pieces])
        ends = pa.py_buffer(np.r_[0, np.cumsum(end - start)].astype(np.int32))
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, ends, pa.py_buffer(raw[raw != 32].tobytes())])
        codes = words.dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        width, rows = int(lengths.max()), np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        text = np.zeros(len(codes) + len(lengths), dtype=np.int64)
        text[np.arange(len(codes)) + rows] = codes
        streams = np.zeros((len(lengths), width), dtype=np.int64)
        streams[rows, place + (width - lengths)[rows]] = codes
        index = FMIndex(text, window)
        least = index.least(np.repeat(np.array([v[0] for v in self.pieces.values()]), lengths + 1))
        index.compress(window - 1, window)
        found, ranks = index.matching_statistics(streams, lengths)
        return np.where(found >= window, least[index.group(ranks)], _NEVER), lengths

    def judged(self, window: int) -> Iterator[pa.RecordBatch]:
        """Marked places, and verdicts for pieces whose places travel apart."""
        if all(v[0] == v[1] for v in self.pieces.values()) and len({v[0] for v in self.pieces.values()}) < 2:
            return
        mins, lengths = self.verdicts(window)
        values = list(self.pieces.values())
        places = [np.frombuffer(b"".join(v[2]), dtype=_PLACE) for v in values]
        of = np.repeat(np.arange(len(values)), [len(p) for p in places])
        places = np.concatenate(places)
        for at in range(0, len(places), 1 << 16):
            yield marked(places[at : at + (1 << 16)], of[at : at + (1 << 16)], mins, lengths)
        for i, (piece, v) in enumerate(self.pieces.items()):
            if v[3]:
                yield _found(VERDICT, 1, piece=[piece], mins=[mins[i, mins.shape[1] - lengths[i] :].tolist()])


def _found(kind: int, n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, dtype=np.int8)) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND)


def marked(places: np.ndarray, of: np.ndarray, mins: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """The places with a window to go: bit k of ``marks`` stands for the window k words on."""
    go = mins[of] < places["doc"][:, None]
    marks = (go.astype(np.int64) << np.arange(mins.shape[1])).sum(axis=1) >> (mins.shape[1] - lengths[of])
    some = marks != 0
    p = places[some]
    return _found(MARKED, len(p), doc=p["doc"], text=p["text"], start=p["start"], marks=marks[some])


def _shards(window: int, last: bool, size: int):
    """Rows of pieces in order of their anchors to what is found. Unless it is the ``last`` round, the pieces of an anchor
    that has more than a shard of them go out again."""

    def again(shard: Shard) -> pa.RecordBatch:
        v = list(shard.pieces.values())
        # an empty list of places says that there are others; pieces that have both go out twice
        rows = [(p, b"".join(x[2]), x[0], x[1]) for p, x in zip(shard.pieces, v, strict=True)] + [(p, b"", x[0], x[1]) for p, x in zip(shard.pieces, v, strict=True) if x[3] and any(x[2])]
        piece, places, least, most = zip(*rows, strict=True)
        return _found(AGAIN, len(rows), piece=piece, places=places, least=least, most=most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, group, anchor, over = Shard(), Shard(), None, False

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if over and group.pieces:
                yield again(group)
                return
            for piece, (least, most, places, apart) in group.pieces.items():
                shard.add(piece, b"".join(places), least, most)
                if apart:
                    shard.pieces[piece][3] = True
            if shard.words >= size:
                yield from shard.judged(window)
                shard = Shard()

        for b in sliced(batches, 4096):
            for key, piece, places, least, most in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if least is None:
                    yield _found(WAITING, 1, piece=[piece], places=[places])
                    continue
                if key != anchor:
                    yield from close()
                    group, anchor, over = Shard(), key, False
                group.add(piece, places, least, most)
                if group.words > size and not last:
                    yield again(group)
                    group, over = Shard(), True
        yield from close()
        if shard.pieces:
            yield from shard.judged(window)

    return run


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(places, mins) to marked places."""
    for b in batches:
        for raw, mins in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            places = np.frombuffer(raw, dtype=_PLACE)
            yield marked(places, np.zeros(len(places), dtype=np.int64), np.array([mins]), np.array([len(mins)])).select(["doc", "text", "start", "marks"])


def _cut(window: int):
    """(doc, text, marked places) to the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            ns, gone, kept = [], [], []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                ns.append(len(words))
                if spans:
                    at, marks = np.array([s["start"] for s in spans]), np.array([s["marks"] for s in spans])
                    windows = np.concatenate([at[marks >> k & 1 == 1] + k for k in range(int(marks.max()).bit_length())])
                    edges = np.bincount(windows, minlength=len(words) + 1) - np.bincount(windows + window, minlength=len(words) + 1)
                    stays = np.cumsum(edges)[: len(words)] == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                gone.append(ns[-1] - len(words))
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return run


def _moved(window: int):
    """(piece, places) to the same of single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 1024):
            keys, out = [], []
            for piece, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = piece.split(b" ")
                for k in range(len(words) - window + 1):
                    places = np.frombuffer(raw, dtype=_PLACE).copy()
                    places["start"] += k
                    keys.append(b" ".join(words[k : k + window]))
                    out.append(places.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["piece", "places"])

    return run


def marks(df: DataFrame, window: int, gram: int, shard: int, most_places: int) -> DataFrame:
    """(doc, text, start, marks): what is to go, of rows (doc, text, key) without null ids."""
    anchors = staged(df.select("doc", "text").mapInArrow(_anchors(window, gram), "anchor bigint, doc bigint"), "substring-anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most").select("anchor")
    shared = staged(shared, "substring-shared")  # a row an anchor: as a stored table, so that Spark can split a common anchor's rows
    of_doc = staged(anchors.join(shared, "anchor", "left_semi").groupBy("doc").agg(F.collect_set("anchor").alias("anchors")), "substring-shared-of-doc")
    rows = df.join(of_doc, "doc").select("doc", "text", "key", "anchors").mapInArrow(_pieces(window, gram, most_places), _PIECE_SQL)

    def search(rows: DataFrame, last: bool) -> DataFrame:
        dealt = rows.repartition("anchor").sortWithinPartitions("anchor")
        return staged(dealt.mapInArrow(_shards(window, last, shard), _FOUND_SQL), "substring-found")

    def of_kind(found: DataFrame, kind: int, *columns: str) -> DataFrame:
        return found.where(F.col("kind") == kind).select(*columns)

    def all_marks(found: DataFrame, waiting: DataFrame) -> DataFrame:
        """Those of pieces that kept their places, and of those whose places met a verdict."""
        met = waiting.join(of_kind(found, VERDICT, "piece", "mins"), "piece").select("places", "mins")
        return of_kind(found, MARKED, "doc", "text", "start", "marks").unionByName(met.mapInArrow(_apart, "doc bigint, text bigint, start int, marks bigint"))

    first = search(rows, False)
    waiting = of_kind(first, WAITING, "piece", "places")
    again = of_kind(first, AGAIN, "piece", "places", "least", "most")
    out = all_marks(first, waiting)
    if again.head(1):
        second = search(again.mapInArrow(_windows(window, most_places), _PIECE_SQL), True)
        late = waiting.join(again.where(F.length("places") == 0).select("piece").distinct(), "piece", "left_semi")
        late = late.mapInArrow(_moved(window), "piece binary, places binary")
        out = out.unionByName(all_marks(second, of_kind(second, WAITING, "piece", "places").unionByName(late)))
    return out


def dedup(df: DataFrame, window: int = 13, gram: int = 3, id_column: str = "doc_id", text: str = "text", shard: int = SHARD, places: int = PLACES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of each row."""
    if not gram <= window <= 60:
        raise ValueError("a window has 60 words at most, and no fewer than an anchor")
    t = F.col(f"`{text}`")
    slim = df.select(F.col(f"`{id_column}`").cast("bigint").alias("doc"), t.alias("text"), F.xxhash64(t).alias("key"))
    named = slim.where("doc is not null")
    found = marks(named, window, gram, shard, places)
    spans = found.groupBy("doc", F.col("text").alias("key")).agg(F.collect_list(F.struct("start", "marks")).alias("spans"))
    kind = "array<struct<start:int,marks:bigint>>"
    out = named.join(spans, ["doc", "key"], "left").select("doc", "text", "spans").unionByName(slim.where("doc is null").select("doc", "text", F.lit(None).cast(kind).alias("spans")))
    return out.mapInArrow(_cut(window), "doc_id bigint, n_words bigint, n_removed bigint, kept string")


def digest(df: DataFrame) -> DataFrame:
    return dedup(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
