"""Best-fit packing of token sequences, hierarchically.

Documents are encoded and only those above the sequence length are cut: full pieces, the first one taking the
remainder. Full pieces are sequences already. The others are items that are packed in rounds: Spark deals the items to
tasks by their place in the stored table (so pieces that are alike spread), each task packs its own best-fit in decreasing order; nearly full bins, and bins that not even the least
item there is fits into, are final. The underfull bins go, as items of the next round, dealt anew, to as many fewer tasks,
until one task takes them all (or two rounds on end put together less than 2 % of what several tasks hold). A bin
carries its members with it, at most as many as it has tokens, so nothing is joined back at the end.

Bounds: a task sees about ``ITEMS`` pieces, whatever the input. Each round is stored as a table in the shared folder,
so a lost executor costs no earlier round; tasks sort their items fully before packing, so a task that runs again packs
alike.

Defined results: null and empty texts are the end id alone; repeated rows are packed as often as they occur; a null id
is carried along; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.llm.common import sliced, staged
from tallymark.llm.tokens import batches_of, encoder

ITEMS = 60_000
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_BIN = "members array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint>>, fill bigint, final boolean, sequence_id bigint"


def pieces(df: DataFrame, tokenizer: str, end_id: int, length: int, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every document."""
    end = struct.pack("<I", end_id)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            docs, rows = iter(batch.column(0).to_pylist()), []
            for some in batches_of(batch.column(1).to_pylist()):
                for ids in encoder(tokenizer).encode(some):
                    doc, ids = next(docs), ids + end
                    n = len(ids) // 4
                    ends = list(range(n, 0, -length))[::-1]
                    rows += [(doc, i, max(0, e - length), min(e, length), zlib.crc32(ids[4 * max(0, e - length) : 4 * e])) for i, e in enumerate(ends)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)] if rows else [pa.array([], f.type) for f in _PIECE], [f.name for f in _PIECE])

    slim = df.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return slim.mapInArrow(cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def best_fit(fills: list[int], length: int) -> list[list[int]]:
    """Positions of the items of each bin: items in the order given, each to the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(length + 1)]
    rooms = 0  # bit r: some bin has r free
    for i, n in enumerate(fills):
        fit = rooms >> n
        if fit:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
            bins[b].append(i)
        else:
            room, b = length, len(bins)
            bins.append([i])
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


def dealt(items: DataFrame, tasks: int, level: int) -> DataFrame:
    """The items (members, fill) in so many partitions, by their place: those that are alike spread too."""
    return items.select("members", "fill", F.xxhash64("place", F.lit(level)).alias("_deal")).repartition(tasks, "_deal").drop("_deal")


def _round(items: DataFrame, tasks: int, level: int, length: int, slack: int, least: int, last: bool) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if table is None or not table.num_rows:
            return
        first = table.column("members").combine_chunks()
        heads = first.values.take(pa.array(first.offsets.to_numpy()[:-1]))
        fill = table.column("fill").to_numpy()
        ids, piece = (np.asarray(heads.field(n).fill_null(-1)) for n in ("doc_id", "piece"))
        crc = np.asarray(heads.field("ids_crc32"))
        order = np.lexsort((crc, piece, ids, -fill))
        bins = best_fit(fill[order].tolist(), length)
        base = (level << 57) + (TaskContext.get().partitionId() << 33)
        for at in range(0, len(bins), 5000):
            some = bins[at : at + 5000]
            flat = order[np.concatenate([np.array(b) for b in some])]
            starts = np.concatenate([[0], np.cumsum([len(b) for b in some])])
            taken = first.take(pa.array(flat))
            ends = np.concatenate([[0], np.cumsum(np.asarray(taken.value_lengths()))])[starts]
            fills = np.add.reduceat(fill[flat], starts[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), taken.flatten()), pa.array(fills), pa.array((fills >= length - slack) | (fills + least > length) | last), pa.array(base + at + np.arange(len(some)))],
                ["members", "fill", "final", "sequence_id"],
            )

    return staged(dealt(items, tasks, level).mapInArrow(pack, _BIN), f"packing-{level}")


def pack(df: DataFrame, tokenizer: str, end_id: int = 2, length: int = 1024, slack: int | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset in the sequence."""
    slack = length // 128 if slack is None else slack
    all_pieces = pieces(df, tokenizer, end_id, length, id_column, text).withColumn("place", F.monotonically_increasing_id())
    all_pieces = staged(all_pieces, "packing-pieces")
    full = all_pieces.where(F.col("length") == length).drop("place").select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    own = F.struct(*[F.col(f.name) for f in _PIECE])
    items = all_pieces.where(F.col("length") < length).select(F.array(own).alias("members"), F.col("length").alias("fill"), "place")
    of = (F.count(F.lit(1)), F.coalesce(F.sum(F.size("members")), F.lit(0)), F.coalesce(F.min("fill"), F.lit(0)))
    bins, held, least = items.agg(*of).first()  # bins that are not final yet, the pieces in them, the least fill
    level, idle, done = 0, 0, []
    while bins:
        tasks = -(-held // ITEMS)
        packed = _round(items, tasks, level, length, slack, least, tasks == 1)
        done.append(packed.where("final"))
        items = packed.where("not final").withColumn("place", F.col("sequence_id"))
        level, before = level + 1, bins
        bins, held, least = items.agg(*of).first()
        idle = idle + 1 if bins > 0.98 * before else 0
        if idle == 2:  # two rounds, dealt differently, found no more to put together
            done.append(items)
            break
    out = full
    for d in done:
        w = F.expr("transform(members, (m, i) -> named_struct('m', m, 'offset', aggregate(slice(members, 1, i), 0L, (s, x) -> s + x.length)))")
        out = out.unionByName(d.select("sequence_id", F.explode(w).alias("x")).select("x.m.*", "sequence_id", "x.offset"))
    return out


def digest(df: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(df, public_tokenizers.path("byte_bpe_50k.json"))
