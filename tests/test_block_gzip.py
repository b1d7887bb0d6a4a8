"""Block-gzipped tables: splits of every size, lines across blocks and splits, regions with and without an index."""

import gzip
import random
import struct
import zlib

import pytest

from strandline.sources import readers
from strandline.sources.block_gzip import BlockGzipTable, block_size


def block(content):
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(content) + packer.flush()
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, 25 + len(body)) + body + struct.pack("<II", zlib.crc32(content), len(content))


def written(path, text, size):
    """The file, and the virtual offset of each byte of its content."""
    raw, starts = b"", []
    for k in range(0, len(text), size):
        starts.append(len(raw))
        raw += block(text[k : k + size])
    path.write_bytes(raw + block(b""))
    return lambda n: starts[n // size] << 16 | n % size if n < len(text) else len(raw) << 16


def tabix(path, places):
    """An index of (chr, pos, begin, end) lines, in order: smallest bins and the linear index, by the format's own rules."""
    names = list(dict.fromkeys(c for c, *_ in places))
    out = b"TBI\x01" + struct.pack("<8i", len(names), 0, 1, 2, 0, 0, 1, sum(len(c) + 1 for c in names)) + b"".join(c.encode() + b"\0" for c in names)
    for c in names:
        bins, linear = {}, {}
        for x, pos, a, b in places:
            if x == c:
                bins.setdefault(4681 + (pos - 1 >> 14), []).append((a, b))
                linear.setdefault(pos - 1 >> 14, a)
        out += struct.pack("<i", len(bins))
        for k, chunks in bins.items():
            out += struct.pack("<Ii", k, 1) + struct.pack("<QQ", chunks[0][0], chunks[-1][1])
        n = max(linear) + 1
        filled = [linear[min(w for w in linear if w >= k)] for k in range(n)]
        out += struct.pack("<i", n) + struct.pack(f"<{n}Q", *filled)
    path.write_bytes(block(out) + block(b""))


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    rng = random.Random(3)
    rows = sorted((rng.choice(["1", "2", "22"]), rng.randrange(1, 200_000)) for _ in range(3000))
    lines = [(c, str(p), "A", rng.choice(["G", "", "long" * rng.randrange(1, 400)]), str(k)) for k, (c, p) in enumerate(rows)]
    head = b"chr\tpos\tref\talt\tbeta_EUR\n"
    path = tmp_path_factory.mktemp("bgz") / "t.tsv.bgz"
    text = head + b"".join("\t".join(r).encode() + b"\n" for r in lines)
    virtual = written(path, text, 700)
    at, places = len(head), []
    for r in lines:
        n = len("\t".join(r)) + 1
        places.append((r[0], int(r[1]), virtual(at), virtual(at + n)))
        at += n
    return path, lines, places


def read(spark, path, **options):
    spark.dataSource.register(BlockGzipTable)
    return spark.read.format("block_gzip_table").options(**options).load(str(path))


@pytest.mark.parametrize("split", [100, 1500, 40_000, 1 << 30])
def test_every_line_is_in_one_split(spark, table, split):
    path, lines, _ = table
    df = read(spark, path, split_bytes=split)
    assert df.columns == ["chr", "pos", "ref", "alt", "beta_EUR"]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted(((a, b, c, d or None, e) for a, b, c, d, e in lines), key=str)
    assert df.rdd.getNumPartitions() == -(-path.stat().st_size // split)


@pytest.mark.parametrize("text", [b"a\tb", b"a\tb\n", b"a\tb\n1\t2", b"a\tb\r\n1\t\r\n", b"a\tb\n" + b"x" * 5000 + b"\ty\n1\t2\n"])
def test_odd_files(spark, tmp_path, text):
    path = tmp_path / "x.bgz"
    written(path, text, 90)
    want = [tuple(c or None for c in x.rstrip(b"\r").decode().split("\t")) for x in text.split(b"\n")[1:] if x]
    for split in (60, 1 << 20):
        df = read(spark, path, split_bytes=split)
        assert df.columns == ["a", "b"] and sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_regions(spark, table, tmp_path):
    """With an index only its ranges are read: a file whose other blocks are broken gives the same rows."""
    path, lines, places = table
    want = sorted((r[0], r[1], r[4]) for r in lines if r[0] == "2" and 50_000 <= int(r[1]) <= 90_000)
    plain = read(spark, path, region="chr2:50,000-90,000", split_bytes=3000)
    assert sorted((r["chr"], r["pos"], r["beta_EUR"]) for r in plain.collect()) == want and want
    copy = tmp_path / "t.tsv.bgz"
    raw = bytearray(path.read_bytes())
    low, high = min(a for c, p, a, _ in places if c == "2") >> 16, max(b for c, p, _, b in places if c == "2") >> 16
    at = block_size(bytes(raw[:64]))
    raw[at + 4 : low] = bytes(low - at - 4)
    raw[high + (block_size(bytes(raw[high : high + 64])) or 0) :] = b""
    copy.write_bytes(raw)
    tabix(tmp_path / "t.tsv.bgz.tbi", places)
    held = read(spark, copy, region="2:50000-90000")
    assert sorted((r["chr"], r["pos"], r["beta_EUR"]) for r in held.collect()) == want
    assert read(spark, copy, region="2:199999999-200000000").count() == read(spark, copy, region="7:1-100").count() == 0
    assert read(spark, copy, region="2:1-199999").count() == sum(r[0] == "2" for r in lines)


def test_readers_use_it(spark, tmp_path):
    rows = "chr\tpos\tref\talt\tbeta_EUR\tse_EUR\tneglog10_pval_EUR\n" + "".join(f"22\t{p}\tA\tG\t0.5\t0.1\t3\n" for p in range(1, 2000))
    written(tmp_path / "s.tsv.bgz", rows.encode(), 1000)
    got = readers.panukb_locus(spark, str(tmp_path / "s.tsv.bgz"), "22", 100, 149)
    assert got.count() == 50 and {r["z"] for r in got.collect()} == {5.0}
    assert "block_gzip_table" in got._jdf.queryExecution().toString()
    (tmp_path / "one.tsv.bgz").write_bytes(gzip.compress(rows.encode()))
    assert readers.panukb_locus(spark, str(tmp_path / "one.tsv.bgz"), "22", 100, 149).count() == 50
    written(tmp_path / "s2.tsv.bgz", rows.encode(), 5000)
    assert read(spark, tmp_path / "s*.tsv.bgz").count() == 2 * 1999
