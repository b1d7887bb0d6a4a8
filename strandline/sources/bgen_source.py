"""BGEN files (layout 2) as a data source: splits of whole variants, regions by the `.bgi` index beside the file.

    spark.dataSource.register(BgenVariants)
    spark.read.format("bgen_variants").option("chr", "22").option("start", 1).option("end", 9).load("x.bgen")

Options: chr, start, end (closed, any of them), split_bytes (bytes of a partition), index (default: the file's with `.bgi`, an
SQLite file with the table Variant). Without an index the driver passes over the file once from length to length, some
hundred bytes a variant, to find where variants begin.
"""

from __future__ import annotations

import sqlite3
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandline.sources.block_gzip import expand, file_system

SPLIT_BYTES = 64 << 20
BGEN = "variant_id string, rsid string, chr string, pos long, ref string, alt string, sample array<string>, dosage array<float>"


def bgen_head(raw) -> tuple[int, int, int, list[str]]:
    """Where variants begin, their number, the compression and the sample ids of a layout-2 file."""
    offset, size, variants, samples = struct.unpack_from("<4I", raw, 0)
    if bytes(raw[16:20]) not in (b"bgen", b"\0\0\0\0"):
        raise ValueError("not a BGEN file")
    flags = struct.unpack_from("<I", raw, size)[0]
    if flags >> 2 & 15 != 2:
        raise ValueError("only layout 2 of BGEN is read")
    ids, at = [], 4 + size
    if flags >> 31:
        at += 8
        for _ in range(samples):
            n = struct.unpack_from("<H", raw, at)[0]
            ids.append(bytes(raw[at + 2 : at + 2 + n]).decode())
            at += 2 + n
    return offset + 4, variants, flags & 3, ids or [str(k) for k in range(samples)]


def _dosages(data: bytes) -> np.ndarray:
    """Expected copies of the second allele of two, NaN where missing; diploid samples, phased or not."""
    n, alleles, _, top = struct.unpack_from("<IHBB", data, 0)
    ploidy = np.frombuffer(data, np.uint8, n, 8)
    phased, bits = data[8 + n], data[9 + n]
    if alleles != 2 or top != 2 or ((ploidy & 63) != 2).any():
        raise ValueError("only diploid samples and two alleles are read")
    if bits in (8, 16, 32):
        p = np.frombuffer(data, f"<u{bits // 8}", 2 * n, 10 + n).astype(np.float64)
    else:
        every = np.unpackbits(np.frombuffer(data, np.uint8, -1, 10 + n), bitorder="little")[: 2 * n * bits]
        p = every.reshape(2 * n, bits) @ (2.0 ** np.arange(bits))
    p = p.reshape(n, 2) / ((1 << bits) - 1)
    out = 2 - p.sum(1) if phased else p[:, 1] + 2 * (1 - p.sum(1))
    out[ploidy >> 7 == 1] = np.nan
    return out


def identity(raw, at: int) -> tuple[int, int, list[str], int, list[str]]:
    """Of the variant that begins at a byte: where its probabilities begin, their length, its words, position and alleles."""
    words = []
    for _ in range(3):
        n = struct.unpack_from("<H", raw, at)[0]
        words.append(bytes(raw[at + 2 : at + 2 + n]).decode())
        at += 2 + n
    pos, k = struct.unpack_from("<IH", raw, at)
    at, alleles = at + 6, []
    for _ in range(k):
        n = struct.unpack_from("<I", raw, at)[0]
        alleles.append(bytes(raw[at + 4 : at + 4 + n]).decode())
        at += 4 + n
    return at + 4, struct.unpack_from("<I", raw, at)[0], words, pos, alleles


def bgen_batches(raw, at: int, count: int | None, packing: int, ids: list[str], chr: str | None, start: int | None, end: int | None) -> Iterator[pa.RecordBatch]:
    """Rows of BGEN for `count` variants from a byte on, or for all up to raw's end."""
    rows: list = []
    while count is None and at < len(raw) or count:
        count = None if count is None else count - 1
        begin, size, words, pos, alleles = identity(raw, at)
        data, at = raw[begin : begin + size], begin + size
        name = words[2].removeprefix("chr")
        if len(alleles) != 2 or chr is not None and name != chr.removeprefix("chr") or start is not None and pos < start or end is not None and pos > end:
            continue
        unpacked = bytes(data) if packing == 0 else zlib.decompress(data[4:]) if packing == 1 else zstandard.ZstdDecompressor().decompress(bytes(data[4:]))
        d = _dosages(unpacked)
        rows.append((f"chr{name}:{pos}:{alleles[0]}:{alleles[1]}", words[1], words[2], pos, alleles[0], alleles[1], ids, [None if x != x else float(x) for x in d]))
        if len(rows) * len(ids) > 1_000_000:
            yield _bgen_rows(rows)
            rows = []
    if rows:
        yield _bgen_rows(rows)


def _bgen_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.float32())]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in BGEN.split(", ")])


def readable(path: str) -> bool:
    """Whether pyarrow can open the first file of a path."""
    try:
        held, at = file_system(expand(path)[0])
        held.open_input_file(at).close()
    except (OSError, ValueError, IndexError):
        return False
    return True


def head_bytes(f) -> bytes:
    """The header and the samples' block."""
    f.seek(0)
    first = f.read(64)
    return first + f.read(max(0, 4 + struct.unpack_from("<I", first)[0] - len(first)))


def indexed(index: bytes, chr: str | None, start: int | None, end: int | None) -> list[tuple[int, int]]:
    """(first byte, length) of the index's variants in a region, in the file's order."""
    held = sqlite3.connect(":memory:")
    held.deserialize(index)
    where, values = ["1"], []
    if chr is not None:
        name = chr.removeprefix("chr")
        where, values = ["chromosome IN (?, ?)"], [name, f"chr{name}"]
    for sign, x in ((">=", start), ("<=", end)):
        if x is not None:
            where, values = [*where, f"position {sign} ?"], [*values, x]
    return held.execute(f"SELECT file_start_position, size_in_bytes FROM Variant WHERE {' AND '.join(where)} ORDER BY 1", values).fetchall()


def passed_over(f, at: int, count: int) -> Iterator[tuple[int, int]]:
    """(first byte, length) of all variants, by their lengths alone."""
    for _ in range(count):
        n = 512
        while True:
            f.seek(at)
            raw = f.read(n)
            try:
                begin, size, *_ = identity(raw, 0)
                break
            except struct.error:  # longer words or alleles than were read
                if len(raw) < n:
                    raise
                n *= 8
        yield at, begin + size
        at += begin + size


@dataclass
class Span(InputPartition):
    path: str
    begin: int
    end: int


class BgenReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.index, self.split = options["path"], options.get("index"), int(options.get("split_bytes", SPLIT_BYTES))
        self.chr = options.get("chr")
        self.start, self.end = (int(options[k]) if k in options else None for k in ("start", "end"))

    def partitions(self) -> list[Span]:
        """Variants that follow each other in the file, up to split_bytes; those outside the region are not read if an index tells."""
        out = []
        for path in expand(self.path):
            held, at = file_system(path)
            index, where = file_system(self.index or f"{path}.bgi")
            with held.open_input_file(at) as f:
                if index.get_file_info(where).is_file:
                    with index.open_input_stream(where, compression=None) as i:
                        variants = iter(indexed(i.read(), self.chr, self.start, self.end))
                else:
                    first, count, *_ = bgen_head(head_bytes(f))
                    variants = passed_over(f, first, count)
                for begin, size in variants:
                    if out and out[-1].path == path and out[-1].end == begin and begin + size - out[-1].begin <= self.split:
                        out[-1].end = begin + size
                    else:
                        out.append(Span(path, begin, begin + size))
        return out or [Span("", 0, 0)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        held, at = file_system(partition.path)
        with held.open_input_file(at) as f:
            _, _, packing, ids = bgen_head(head_bytes(f))
            f.seek(partition.begin)
            raw = memoryview(f.read(partition.end - partition.begin))
        yield from bgen_batches(raw, 0, None, packing, ids, self.chr, self.start, self.end)


class BgenVariants(DataSource):
    @classmethod
    def name(cls) -> str:
        return "bgen_variants"

    def schema(self) -> str:
        return BGEN

    def reader(self, schema) -> BgenReader:
        return BgenReader(dict(self.options))
