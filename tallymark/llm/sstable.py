"""Token ids as sorted-string-table shards, and reading them back.

A shard holds the documents of one key range in key order. Its parts, in order:

* data blocks, each zstd-compressed: entries of (length shared with the key before, rest of the key, ids), so keys are
  prefix-compressed and a block opens with a whole key;
* a sparse index, zstd-compressed: for each block its last key, place, length and number of documents;
* a Bloom filter over the keys;
* a footer of fixed length: places of the above, totals, a checksum over all before it, and a magic number.

``Shard.get`` asks the Bloom filter, finds the block by binary search in the index and decodes that block alone.

Spark range-partitions and sorts the documents by id, into as many shards as their characters and their number ask for; each task writes its shard to the shared folder under a name of
its own and renames it when whole, so a task that runs twice leaves no half-written shard under a final name; the
manifest, stored as a table, names the shards that count.

Defined results: a null text is empty; a null id sorts first, under the empty key; repeated ids keep all their rows, by
a hash of the text and then by their place (so an id with very many texts, or one row repeated very often, is cut into
shards like any range); an empty table gives no shard. Other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.llm.common import PLACE, placed, sliced, stage_root, staged
from tallymark.llm.tokens import batches_of, encoder

MAGIC = b"TMSSTAB1"
FOOTER = struct.Struct("<QQQQQQII8s")  # index place, length; filter place, length; documents, ids; hashes, checksum; magic
BLOCK_BYTES = 1 << 18
#: Characters of text and documents that a shard stands for: shards grow in number, not in size.
SHARD_CHARS, SHARD_ROWS = 64_000_000, 500_000
BITS_A_KEY = 10
MANIFEST = "shard int, file string, first_key binary, last_key binary, n_docs bigint, n_ids bigint"


def key_of(doc_id: int | None) -> bytes:
    """Bytes whose order is that of the ids; null comes first."""
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(digests: bytes | bytearray, bits: int, hashes: int) -> Iterator[np.ndarray]:
    """Places in the Bloom filter of keys with these 128-bit digests, one after the other: by hash, of all keys."""
    halves = np.frombuffer(digests, ">u8").reshape(-1, 2).astype(np.uint64)
    for i in range(hashes):
        yield (halves[:, 1] + np.uint64(i) * (halves[:, 0] | np.uint64(1))) % np.uint64(bits)


class Writer:
    """Writes one shard to an open stream; entries come in key order."""

    def __init__(self, out) -> None:
        self.out, self.at, self.sum = out, 0, 0
        self.block, self.n, self.last, self.size = [], 0, b"", 0
        self.index: list[tuple[bytes, int, int, int]] = []
        self.digests = bytearray()  # 16 bytes a key
        self.docs = self.ids = 0
        self.first = self.before = None
        self.pack = zstandard.ZstdCompressor(level=1).compress

    def _put(self, data: bytes) -> tuple[int, int]:
        place = (self.at, len(data))
        self.out.write(data)
        self.sum = zlib.crc32(data, self.sum)
        self.at += len(data)
        return place

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian unsigned 32-bit integers."""
        if self.first is None:
            self.first = key
        shared = 0
        if self.n:
            if key < self.last:
                raise ValueError("keys must come in order")
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        wide = np.frombuffer(ids, "<u4")
        width = 2 if not len(wide) or wide.max() < 1 << 16 else 4
        value = wide.astype("<u2").tobytes() if width == 2 else ids
        before = self.before
        self.before = key
        entry = b"".join((_varint(shared), _varint(len(key) - shared), key[shared:], _varint(len(wide)), bytes([width]), value))
        self.block.append(entry)
        self.size += len(entry)
        self.n, self.last = self.n + 1, key
        self.docs += 1
        self.ids += len(wide)
        if self.docs == 1 or key != before:
            self.digests += xxhash.xxh3_128_digest(key)
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.n:
            self.index.append((self.last, *self._put(self.pack(b"".join(self.block))), self.n))
        self.block, self.n, self.size = [], 0, 0

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(at) + _varint(length) + _varint(n) for k, at, length, n in self.index)
        index_place = self._put(self.pack(index))
        hashes, bits = 7, max(64, len(self.digests) // 16 * BITS_A_KEY)
        flags = np.zeros(bits, dtype=bool)
        for places in _probes(self.digests, bits, hashes):
            flags[places] = True
        bloom_place = self._put(struct.pack("<Q", bits) + np.packbits(flags, bitorder="little").tobytes())
        self._put(FOOTER.pack(*index_place, *bloom_place, self.docs, self.ids, hashes, self.sum, MAGIC))


class Shard:
    """Reads one shard through a seekable file."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size() if hasattr(file, "size") else file.seek(0, 2)
        footer = self._at(size - FOOTER.size, FOOTER.size)
        i_at, i_len, b_at, b_len, self.docs, self.ids, self.hashes, self.checksum, magic = FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a shard, or cut short")
        self.unpack = zstandard.ZstdDecompressor().decompress
        data, at, self.index = self.unpack(self._at(i_at, i_len)) if i_len else b"", 0, []
        while at < len(data):
            n, at = _read_varint(data, at)
            key = data[at : at + n]
            place, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            n, at = _read_varint(data, at)
            self.index.append((key, place, length, n))
        self.bloom = (b_at, b_len)
        self.filter: bytes | None = None

    def _at(self, place: int, length: int) -> bytes:
        self.file.seek(place)
        return self.file.read(length)

    def check(self) -> None:
        """Raises unless the checksum over all before the footer holds."""
        at, end, total = 0, self.bloom[0] + self.bloom[1], 0
        while at < end:
            part = self._at(at, min(1 << 22, end - at))
            total, at = zlib.crc32(part, total), at + len(part)
        if total != self.checksum:
            raise ValueError("the shard's checksum does not hold")

    def _block(self, n: int) -> Iterator[tuple[bytes, bytes]]:
        _, place, length, count = self.index[n]
        data, at, key = self.unpack(self._at(place, length)), 0, b""
        for _ in range(count):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            size, at = _read_varint(data, at + rest)
            width = data[at]
            value = data[at + 1 : at + 1 + size * width]
            at += 1 + size * width
            yield key, value if width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for n in range(len(self.index)):
            yield from self._block(n)

    def may_hold(self, key: bytes) -> bool:
        if self.filter is None:
            self.filter = self._at(*self.bloom)
        bits = struct.unpack("<Q", self.filter[:8])[0]
        return all(self.filter[8 + (p >> 3)] >> (p & 7) & 1 for p in (int(x[0]) for x in _probes(xxhash.xxh3_128_digest(key), bits, self.hashes)))

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every document under the key."""
        if not self.may_hold(key):
            return []
        found, n = [], bisect_left(self.index, key, key=lambda x: x[0])
        while n < len(self.index):
            mine = [v for k, v in self._block(n) if k == key]
            found += mine
            if self.index[n][0] != key:
                break
            n += 1
        return found


def _file_system(uri: str):
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith(("file:", "/")) else f"file://{uri}")


def write(df: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, append the end id and write shards by ascending id. Returns the manifest, a row a shard."""
    folder = folder or f"{stage_root(df.sparkSession)}/sstable-{uuid.uuid4().hex}"
    end = struct.pack("<I", end_id)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        files, root = _file_system(folder)
        shard = TaskContext.get().partitionId()
        name = f"{root}/{shard:07d}-{uuid.uuid4().hex}.sst"
        for batch in sliced(batches):
            keys = iter(batch.column(0).to_pylist())
            for some in batches_of(batch.column(1).to_pylist()):
                for ids in encoder(tokenizer).encode(some):
                    if writer is None:
                        files.create_dir(root, recursive=True)
                        writer = Writer(files.open_output_stream(f"{name}.part"))
                    writer.add(key_of(next(keys)), ids + end)
        if writer is not None:
            writer.close()
            writer.out.close()
            files.move(f"{name}.part", name)
            row = {"shard": shard, "file": f"{folder}/{name.rsplit('/', 1)[1]}", "first_key": writer.first, "last_key": writer.last, "n_docs": writer.docs, "n_ids": writer.ids}
            yield pa.RecordBatch.from_pylist([row], schema=_MANIFEST_ARROW)

    slim = placed(df.select(f"`{id_column}`", f"`{text}`"))
    slim = slim.select(F.col(f"`{id_column}`").cast("bigint").alias("k"), F.xxhash64(f"`{text}`").alias("h"), F.col(PLACE).alias("s"), F.col(f"`{text}`").alias("v"))
    chars, rows = slim.agg(F.coalesce(F.sum(F.char_length("v")), F.lit(0)), F.count(F.lit(1))).first()
    count = 1 + max(chars // SHARD_CHARS, rows // SHARD_ROWS)
    ranged = slim.repartitionByRange(count, "k", "h", "s").sortWithinPartitions("k", "h", "v")
    return staged(ranged.select("k", "v").mapInArrow(shards, MANIFEST), "sstable-manifest")


_MANIFEST_ARROW = pa.schema([("shard", pa.int32()), ("file", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def _spread(manifest: DataFrame) -> DataFrame:
    """A partition for each shard: its rows are few bytes but stand for much work."""
    return manifest.repartitionByRange(max(1, manifest.count()), "shard")


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Every document of the shards: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked, ids."""
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                files, path = _file_system(shard["file"])
                at, some = shard["base"], []
                with files.open_input_file(path) as f:
                    source = Shard(f)
                    source.check()
                    for key, ids in source:
                        some.append((id_of(key), at, len(ids) // 4, zlib.crc32(ids), *[np.frombuffer(ids, "<u4").astype("i8")] * with_ids))
                        at += len(ids) // 4
                        if len(some) >= (256 if with_ids else 10_000):
                            yield _batch(some, with_ids)
                            some = []
                if some:
                    yield _batch(some, with_ids)

    manifest = _spread(manifest.withColumn("base", before))
    return manifest.select("file", "base").mapInArrow(rows, _READ + (", ids array<bigint>" if with_ids else ""))


def _batch(some: list[tuple], with_ids: bool) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.list_(pa.int64())] * with_ids
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some, strict=True), kinds, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])


def lookup(manifest: DataFrame, keys: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The ids of the wanted documents (``id_column`` of keys): each shard is asked for the keys of its range."""
    number = lambda c: F.conv(F.hex(c), 16, 10).cast("decimal(20,0)")
    low = F.when(F.length("first_key") > 0, number("first_key")).otherwise(F.lit(0).cast("decimal(20,0)"))
    ranges = manifest.where(F.length("last_key") > 0).select("file", low.alias("low"), number("last_key").alias("high"))
    # the range of all keys in four bins a shard: a shard is met in the bins of its own range, a key in one
    shards, least, most = ranges.agg(F.count(F.lit(1)), F.min("low"), F.max("high")).first()
    width = -(-(int(most or 0) - int(least or 0) + 1) // (4 * max(1, shards)))
    bin_of = lambda c: F.floor((F.col(c) - F.lit(str(int(least or 0))).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)")).cast("bigint")
    binned = ranges.withColumn("bin", F.explode(F.sequence(bin_of("low"), bin_of("high"))))
    wanted = keys.select(F.col(f"`{id_column}`").cast("bigint").alias("want")).where("want is not null").distinct()
    wanted = wanted.withColumn("at", F.col("want").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).withColumn("bin", bin_of("at"))
    hits = wanted.join(binned, "bin").where((F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high")))

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_file, source = None, None
        for batch in batches:
            some = []
            for name, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != open_file:
                    files, path = _file_system(name)
                    open_file, source = name, Shard(files.open_input_file(path))
                some += [(want, np.frombuffer(v, "<u4").astype("i8")) for v in source.get(key_of(want))]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in some], pa.int64()), pa.array([s[1] for s in some], pa.list_(pa.int64()))], ["doc_id", "ids"])

    return hits.select("file", "want").repartition("file").sortWithinPartitions("file", "want").mapInArrow(get, "doc_id bigint, ids array<bigint>")


def digest(df: DataFrame) -> DataFrame:
    import public_tokenizers

    return read(write(df, public_tokenizers.path("word_bpe_49k.json"), 1))
