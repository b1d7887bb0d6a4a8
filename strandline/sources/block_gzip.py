"""Block-gzipped tables as a data source: files are cut at block headers, regions by a tabix index beside the file.

    spark.dataSource.register(BlockGzipTable)
    spark.read.format("block_gzip_table").option("region", "22:16050000-16060000").load("sumstats.tsv.bgz")

Options: split_bytes (compressed bytes of a partition), region (chr:start-end, closed; needs `chr` and `pos` columns, or those
that the index names), index (path of the index; default: the file's with `.tbi`). All columns are strings, empty cells null.
Without an index a region is a filter over all splits. Paths are those of pyarrow's file systems, local or remote; a pattern
in the last part is expanded.
"""

from __future__ import annotations

import fnmatch
import io
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

SPLIT_BYTES = 32 << 20
#: Fixed values of the format: a block's first bytes, the subfield that holds its size, the largest block.
MAGIC, FIELD, LARGEST = b"\x1f\x8b\x08\x04", b"BC\x02\x00", 1 << 16
#: Fixed values of the index: levels of bins, bits of the smallest bin, bits that a level adds.
LEVELS, SMALLEST, STEP = 6, 14, 3


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def expand(path: str) -> list[str]:
    """The files of a path whose last part may be a pattern."""
    folder, _, last = path.rpartition("/")
    if not any(c in last for c in "*?["):
        return [path]
    held, at = file_system(folder or ".")
    return sorted(f"{folder}/{x.base_name}" if folder else x.base_name for x in held.get_file_info(fs.FileSelector(at)) if x.is_file and fnmatch.fnmatch(x.base_name, last))


def is_block_gzip(path: str) -> bool:
    """Whether the first file of a path begins with a block; False where pyarrow cannot read it."""
    try:
        held, at = file_system(expand(path)[0])
        with held.open_input_file(at) as f:
            return block_size(f.read(64)) is not None
    except (OSError, ValueError, IndexError):
        return False


def block_size(head: bytes) -> int | None:
    """The size of the block that begins with these bytes; None where none does."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra, at = struct.unpack_from("<H", head, 10)[0], 12
    while at + 6 <= min(len(head), 12 + extra):
        if head[at : at + 4] == FIELD:
            return struct.unpack_from("<H", head, at + 4)[0] + 1
        at += 4 + struct.unpack_from("<H", head, at + 2)[0]
    return None


def first_block(f, begin: int, size: int) -> int:
    """The first block at or after a byte: one whose size leads to another block, or to the file's end; size if there is none."""
    if begin == 0:
        return 0
    f.seek(begin)
    window = f.read(2 * LARGEST + 18)
    at = window.find(MAGIC)
    while at >= 0:
        n = block_size(window[at : at + 64])
        if n and (begin + at + n == size or block_size(window[at + n : at + n + 64])):
            return begin + at
        at = window.find(MAGIC, at + 1)
    return size


def blocks(f, at: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the blocks from one on."""
    while at < size:
        f.seek(at)
        raw = f.read(LARGEST)
        n = block_size(raw)
        if n is None:
            raise ValueError(f"no block at byte {at}")
        yield at, zlib.decompress(raw[:n], 31)
        at += n


def regions(index: bytes, chr: str, start: int, end: int) -> tuple[list[tuple[int, int]], dict]:
    """Ranges of virtual offsets (block << 16 | place in it) that may hold rows of a region, and the index's own columns.

    Bins of the region on every level, less what ends before the linear index's first offset; ranges that meet are one."""
    raw = b"".join(content for _, content in blocks(io.BytesIO(index), 0, len(index)))
    if raw[:4] != b"TBI\x01":
        raise ValueError("not a tabix index")
    n_ref, _, seq, beg, _, _, _, names_size = struct.unpack_from("<8i", raw, 4)
    names = raw[36 : 36 + names_size].rstrip(b"\0").split(b"\0")
    at, wanted, found = 36 + names_size, {chr.removeprefix("chr"), f"chr{chr.removeprefix('chr')}"}, []
    low, high = max(start - 1, 0), end
    bins = set()
    for level in range(LEVELS):
        shift, offset = SMALLEST + STEP * (LEVELS - 1 - level), ((1 << STEP * level) - 1) // ((1 << STEP) - 1)
        bins |= set(range(offset + (low >> shift), offset + (max(high - 1, low) >> shift) + 1))
    for k in range(n_ref):
        mine, chunks = names[k].decode() in wanted, []
        (n_bin,) = struct.unpack_from("<i", raw, at)
        at += 4
        for _ in range(n_bin):
            number, n_chunk = struct.unpack_from("<Ii", raw, at)
            if mine and number in bins:
                chunks += struct.iter_unpack("<QQ", raw[at + 8 : at + 8 + 16 * n_chunk])
            at += 8 + 16 * n_chunk
        (n_intv,) = struct.unpack_from("<i", raw, at)
        if mine and n_intv:
            linear = struct.unpack_from(f"<{n_intv}Q", raw, at + 4)
            least = linear[min(low >> SMALLEST, n_intv - 1)]
            chunks = [(a, b) for a, b in chunks if b > least]
        at += 4 + 8 * n_intv
        found += chunks
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(merged[-1][1], b)
        else:
            merged.append((a, b))
    return merged, {"chr": seq - 1, "pos": beg - 1}


@dataclass
class Split(InputPartition):
    """Bytes [begin, end) of a file: the lines that the blocks which begin there start; or, with virtual, a range of offsets."""

    path: str
    begin: int
    end: int
    virtual: bool


class BlockGzipReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.names, self.path = schema.names, options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.region, self.places = None, {}
        if region := options.get("region"):
            chr_, _, span = region.rpartition(":")
            start, _, end = span.replace(",", "").partition("-")
            self.region = chr_.removeprefix("chr"), int(start), int(end)
            self.places = {"chr": self.names.index("chr") if "chr" in self.names else 0, "pos": self.names.index("pos") if "pos" in self.names else 1}
        self.index = options.get("index")

    def partitions(self) -> list[Split]:
        out = []
        for path in expand(self.path):
            held, at = file_system(path)
            size = held.get_file_info(at).size
            index, where = file_system(self.index or f"{path}.tbi")
            if self.region and index.get_file_info(where).is_file:
                with index.open_input_stream(where, compression=None) as f:
                    found, self.places = regions(f.read(), *self.region)
                out += [Split(path, a, b, True) for a, b in found]
            else:
                out += [Split(path, k, min(k + self.split, size), False) for k in range(0, size, self.split)]
        return out or [Split("", 0, 0, False)]

    def _lines(self, s: Split) -> Iterator[bytes]:
        """Pieces of whole lines."""
        held, at = file_system(s.path)
        size = held.get_file_info(at).size
        with held.open_input_file(at) as f:
            rest = b""
            if s.virtual:
                for k, content in blocks(f, s.begin >> 16, size):
                    if k << 16 >= s.end:
                        break
                    content = content[: s.end & 0xFFFF] if k == s.end >> 16 else content
                    content = content[s.begin & 0xFFFF :] if k == s.begin >> 16 else content
                    whole, cut, rest = (rest + content).rpartition(b"\n")
                    yield whole + cut
                if rest:
                    yield rest
                return
            skipping = s.begin > 0
            for k, content in blocks(f, first_block(f, s.begin, size), size):
                if skipping:  # the line that is open here, or begins here, is the split's before
                    _, cut, content = content.partition(b"\n")
                    skipping = not cut
                    if k >= s.end:
                        return
                elif k >= s.end:  # the last line goes on to its end, and one that begins with this block is still ours
                    line, cut, _ = content.partition(b"\n")
                    rest += line
                    if cut:
                        yield rest + b"\n"
                        return
                    continue
                whole, cut, rest = (rest + content).rpartition(b"\n")
                yield whole + cut
            if rest:
                yield rest

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        first, gathered, n = partition.begin == 0 and not partition.virtual, [], 0

        def batches():
            nonlocal first, gathered, n
            raw, gathered, n = b"".join(gathered), [], 0
            if first:
                raw, first = raw.partition(b"\n")[2], False
            if not raw.strip():
                return
            options = csv.ConvertOptions(column_types=dict.fromkeys(self.names, pa.string()), null_values=[""], strings_can_be_null=True)
            table = csv.read_csv(io.BytesIO(raw), csv.ReadOptions(column_names=self.names, use_threads=False, block_size=1 << 26), csv.ParseOptions(delimiter="\t", quote_char=False, ignore_empty_lines=True), options)
            if self.region:
                chr_, start, end = self.region
                pos = table.column(self.places["pos"]).to_pylist()
                keep = [c is not None and c.removeprefix("chr") == chr_ and p is not None and p.isdigit() and start <= int(p) <= end for c, p in zip(table.column(self.places["chr"]).to_pylist(), pos, strict=True)]
                table = table.filter(pa.array(keep, pa.bool_()))
            yield from table.combine_chunks().to_batches(max_chunksize=50_000)

        for piece in self._lines(partition):
            gathered.append(piece)
            n += len(piece)
            if n >= 8 << 20:
                yield from batches()
        yield from batches()


class BlockGzipTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "block_gzip_table"

    def schema(self) -> StructType:
        path = expand(self.options["path"])[0]
        held, at = file_system(path)
        head = b""
        with held.open_input_file(at) as f:
            for _, content in blocks(f, 0, held.get_file_info(at).size):
                head += content
                if b"\n" in head:
                    break
        return StructType([StructField(c, StringType()) for c in head.partition(b"\n")[0].rstrip(b"\r").decode().split("\t")])

    def reader(self, schema: StructType) -> BlockGzipReader:
        return BlockGzipReader(schema, dict(self.options))
