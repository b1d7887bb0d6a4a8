"""Genotype decoding, projections, counts, linkage. Long form: (v, s, g), absent pairs are 0 and null g is missing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from strandline.operators.lineage import written
from strandline.operators.tiles import pair_products

#: Two-bit codes, four samples a byte, lowest bits first.
HOM_REF, HET, HOM_ALT, MISSING = 0, 1, 2, 3


@pandas_udf(T.ArrayType(T.ByteType()))
def unpack_genotypes(packed: pd.Series) -> pd.Series:
    """Codes of packed genotypes, four for each byte; null stays null."""
    shifts = np.array([0, 2, 4, 6], np.uint8)
    return packed.map(lambda b: None if b is None else ((np.frombuffer(b, np.uint8)[:, None] >> shifts) & 3).ravel().astype(np.int8))


@pandas_udf(T.BinaryType())
def pack_genotypes(codes: pd.Series) -> pd.Series:
    """The inverse; null codes are missing, and so is what fills the last byte."""

    def one(c):
        if c is None:
            return None
        a = np.array([MISSING if x is None else x for x in c], np.uint8)
        a = np.concatenate([a, np.full(-len(a) % 4, MISSING, np.uint8)]).reshape(-1, 4)
        return (a[:, 0] | a[:, 1] << 2 | a[:, 2] << 4 | a[:, 3] << 6).astype(np.uint8).tobytes()

    return codes.map(one)


#: Samples whose carriers of a variant are packed by one task at once.
REACH = 1 << 20


def pack_carriers(genotypes: DataFrame, n: int, block: int = 16_384) -> DataFrame:
    """(v, packed_from, gt_packed) of rows (v, packed_index, g): the codes of samples packed_from and after, block samples (a multiple of
    four) or those up to n. Blocks where no sample has a row are all reference and have no row themselves, so that the result
    follows the carriers. With small blocks (sparse carriers) rows are many; they are made from lists of a variant's carriers
    among REACH samples, so none is shuffled."""
    reach = -(-REACH // block) * block
    code = F.coalesce("g", F.lit(MISSING)).cast("int").alias("code")
    held = genotypes.where("packed_index IS NOT NULL").select("v", F.floor(F.col("packed_index") / reach).alias("_far"), F.col("packed_index").cast("long").alias("at"), code)
    held = held.groupBy("v", "_far").agg(F.collect_list("at").alias("at"), F.collect_list("code").alias("code"))
    kind, step = genotypes.schema["v"].dataType.simpleString(), max(1, (1 << 22) // block)

    def pack(batches):
        for b in batches:
            ends = np.concatenate([[0], np.cumsum(b["at"].value_lengths().to_numpy())])
            low = 0
            while low < b.num_rows:
                high = min(b.num_rows, max(low + 1, int(np.searchsorted(ends, ends[low] + (1 << 20), "right")) - 1))
                row = np.repeat(np.arange(low, high), np.diff(ends[low : high + 1]))
                at, codes = b["at"].slice(low, high - low).flatten().to_numpy(), b["code"].slice(low, high - low).flatten().to_numpy()
                order = np.lexsort((at, row))
                row, at, codes = row[order], at[order], codes[order]
                where = at // block
                new = np.append(True, (row[1:] != row[:-1]) | (where[1:] != where[:-1]))
                of, starts = np.cumsum(new) - 1, np.flatnonzero(new)
                for k in range(0, len(starts), step):  # blocks that make a megabyte
                    p, q = starts[k], starts[k + step] if k + step < len(starts) else len(at)
                    begin = where[starts[k : k + step]] * block
                    full = np.full((len(begin), -(-block // 4) * 4), HOM_REF, np.uint8)
                    full[of[p:q] - k, at[p:q] % block] = codes[p:q]
                    size = np.minimum(block, n - begin)
                    full[np.arange(full.shape[1]) >= size[:, None]] = MISSING
                    c = full.reshape(len(begin), -1, 4)
                    c = c[:, :, 0] | c[:, :, 1] << 2 | c[:, :, 2] << 4 | c[:, :, 3] << 6
                    width = -(-size // 4)
                    raw = c.tobytes() if (width == c.shape[1]).all() else c[np.arange(c.shape[1]) < width[:, None]].tobytes()
                    made = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(width)]).astype(np.int32)), pa.py_buffer(raw)])
                    yield pa.RecordBatch.from_arrays([b["v"].take(pa.array(row[starts[k : k + step]])), pa.array(begin.astype(np.int64)), made], ["v", "packed_from", "gt_packed"])
                low = high

    return held.mapInArrow(pack, f"v {kind}, packed_from long, gt_packed binary")


def explode_packed(variants: DataFrame, samples: DataFrame, packed: str = "gt_packed") -> DataFrame:
    """(v, s, g) of the non-reference codes; samples (s, packed_index) that are not there are left out. A column packed_from, where
    variants has it, is the index of a row's first code. Reference codes are passed over in bytes and make no rows."""
    kind = variants.schema["v"].dataType.simpleString()
    first = F.col("packed_from").cast("long") if "packed_from" in variants.columns else F.lit(0).cast("long")
    shifts = np.array([0, 2, 4, 6], np.uint8)

    def unpack(batches):
        for b in batches:
            lengths = np.where(b["gt"].is_valid().to_numpy(zero_copy_only=False), b["size"].fill_null(0).to_numpy(), 0).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            low = 0
            while low < b.num_rows:  # some megabytes of codes at once, or one row
                high = min(b.num_rows, max(low + 1, int(np.searchsorted(ends, ends[low] + (1 << 22), "right")) - 1))
                raw = np.frombuffer(b"".join(x for x in b["gt"].slice(low, high - low).to_pylist() if x is not None), np.uint8)
                some = np.flatnonzero(raw)
                found = raw[some][:, None] >> shifts & 3
                i, j = np.nonzero(found)
                row = np.searchsorted(ends[low : high + 1] - ends[low], some[i], "right") - 1
                at = (some[i] - (ends[low + row] - ends[low])) * 4 + j + b["first"].to_numpy()[low + row]
                for k in range(0, len(i), 1 << 18):
                    part = slice(k, k + (1 << 18))
                    yield pa.RecordBatch.from_arrays([b["v"].take(pa.array(low + row[part])), pa.array(at[part].astype(np.int64)), pa.array(found[i[part], j[part]].astype(np.int32))], ["v", "packed_index", "code"])
                low = high

    codes = variants.select("v", first.alias("first"), F.col(packed).alias("gt"), F.length(packed).alias("size")).mapInArrow(unpack, f"v {kind}, packed_index long, code int")
    return codes.join(samples.select("s", "packed_index"), "packed_index").select("v", "s", dosage("code").alias("g"))


def dosage(code: str | Column) -> Column:
    """Code to dosage; missing is null."""
    return F.nullif(F.col(code) if isinstance(code, str) else code, F.lit(MISSING)).cast("int")


def is_carrier(g: str = "g") -> Column:
    return F.coalesce(F.col(g).isin(1, 2), F.lit(False))


def region(variants: DataFrame, chr: int | str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Variants of a closed interval; the filter reaches the scan."""
    out = variants.where(F.col("chr") == chr)
    out = out if start is None else out.where(F.col("pos") >= start)
    return out if end is None else out.where(F.col("pos") <= end)


def count_tables(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """v, case_hr, case_het, case_ha, ctrl_hr, ctrl_het, ctrl_ha: one conditional aggregation; missing are left out.

    samples: (s, is_case), null is_case takes no part. Genotypes that have is_case already are not joined again."""
    known = samples.where(F.col("is_case").isNotNull())
    n = known.agg(F.count_if("is_case").alias("a"), F.count_if(~F.col("is_case")).alias("b")).first()
    hit = genotypes.where(F.col("is_case").isNotNull()) if "is_case" in genotypes.columns else genotypes.join(known.select("s", "is_case"), "s")
    one = lambda case, g: F.count_if((F.col("is_case") == case) & (F.col("g") == g if g is not None else F.col("g").isNull()))
    sums = hit.groupBy("v").agg(one(True, 1).alias("case_het"), one(True, 2).alias("case_ha"), one(True, None).alias("_ma"), one(False, 1).alias("ctrl_het"), one(False, 2).alias("ctrl_ha"), one(False, None).alias("_mb"))
    return sums.select("v", (F.lit(n["a"]) - F.col("case_het") - F.col("case_ha") - F.col("_ma")).alias("case_hr"), "case_het", "case_ha", (F.lit(n["b"]) - F.col("ctrl_het") - F.col("ctrl_ha") - F.col("_mb")).alias("ctrl_hr"), "ctrl_het", "ctrl_ha")


def allelic(counts: DataFrame) -> DataFrame:
    """Adds case_ref, case_alt, ctrl_ref, ctrl_alt."""
    return counts.withColumns({f"{g}_{a}": F.col(f"{g}_{h}") * 2 + F.col(f"{g}_het") for g in ("case", "ctrl") for a, h in (("ref", "hr"), ("alt", "ha"))})


def z_score(case_alt: Column, case_n: Column, ctrl_alt: Column, ctrl_n: Column) -> Column:
    """Pooled two-proportion z of allele counts; 0 where it is not defined."""
    p1, p2 = case_alt / case_n, ctrl_alt / ctrl_n
    pool = (case_alt + ctrl_alt) / (case_n + ctrl_n)
    se = F.sqrt(pool * (1 - pool) * (F.lit(1.0) / case_n + F.lit(1.0) / ctrl_n))
    return F.when((case_n > 0) & (ctrl_n > 0) & (se > 0), (p1 - p2) / se).otherwise(F.lit(0.0))


def moments(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """v, n, sg, sgg, sgy, sy, syy over the samples with a trait and a known genotype; absent pairs count as 0.

    Genotypes that have y already are not joined again."""
    known = samples.where(F.col("y").isNotNull()).select("s", "y")
    all_ = known.agg(F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("syy")).first()
    miss = F.col("g").isNull()
    hit = genotypes.where(F.col("y").isNotNull()) if "y" in genotypes.columns else genotypes.join(known, "s")
    rows = hit.groupBy("v").agg(F.count_if(miss).alias("m"), F.sum(F.when(miss, F.col("y")).otherwise(0.0)).alias("my"), F.sum(F.when(miss, F.col("y") * F.col("y")).otherwise(0.0)).alias("myy"), F.coalesce(F.sum("g"), F.lit(0)).alias("sg"), F.coalesce(F.sum(F.col("g") * F.col("g")), F.lit(0)).alias("sgg"), F.coalesce(F.sum(F.col("g") * F.col("y")), F.lit(0.0)).alias("sgy"))
    return rows.select("v", (F.lit(all_["n"]) - F.col("m")).alias("n"), "sg", "sgg", "sgy", (F.lit(float(all_["sy"] or 0)) - F.col("my")).alias("sy"), (F.lit(float(all_["syy"] or 0)) - F.col("myy")).alias("syy"))


def ld_pairs(genotypes: DataFrame, variants: DataFrame, n_samples: int, window: int = 100_000, min_valid: int = 10) -> DataFrame:
    """(v1, v2, r, r2) for v1 < v2 on a chromosome at most `window` apart: pairs meet by (chr, bin), never by a product.

    Pairwise-complete correlation from sums over shared rows, taken in pairs of tiles of variants (tiles.pair_products). n, means
    and products are corrected for the pairs' missing codes; 0 below min_valid samples or without variance. Pairs without any
    shared row are completed from the margins. Runs genotypes and writes the result once, however often it is read."""
    place = variants.select("v", "chr", "pos", (F.col("pos") / window).cast("long").alias("bin"))
    left = place.select(F.col("v").alias("v1"), "chr", F.col("pos").alias("p1"), F.explode(F.array(F.col("bin"), F.col("bin") + 1, F.col("bin") - 1)).alias("bin"))
    near = left.join(place.select(F.col("v").alias("v2"), "chr", F.col("pos").alias("p2"), "bin"), ["chr", "bin"])
    pairs = near.where((F.col("v1") < F.col("v2")) & (F.abs(F.col("p1") - F.col("p2")) <= window)).select("v1", "v2")
    genotypes = written(genotypes.select("v", "s", "g"))
    dose, miss = F.coalesce("g", F.lit(0)), F.col("g").isNull().cast("int")
    values, sums = {"d": dose}, {"s12": ("d", "d")}
    # What a missing code takes out of the other variant's sums; most tables have none.
    corrections = {"mm": ("m", "m"), "x1": ("d", "m"), "xx1": ("q", "m"), "x2": ("m", "d"), "xx2": ("m", "q")}
    some = not genotypes.where("g IS NULL").isEmpty()
    if some:
        values, sums = values | {"q": dose * dose, "m": miss}, sums | corrections
    both = pair_products(pairs, genotypes, values, sums)
    if not some:
        both = both.withColumns({c: F.lit(0.0) for c in corrections})
    one = genotypes.groupBy("v").agg(F.coalesce(F.sum("g"), F.lit(0)).alias("sg"), F.coalesce(F.sum(F.col("g") * F.col("g")), F.lit(0)).alias("sgg"), F.count_if(F.col("g").isNull()).alias("m"))
    out = pairs.join(both, ["v1", "v2"], "left")
    for k in (1, 2):
        out = out.join(one.select(F.col("v").alias(f"v{k}"), *[F.col(c).alias(f"{c}{k}") for c in ("sg", "sgg", "m")]), f"v{k}", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    n = F.lit(float(n_samples)) - z("m1") - z("m2") + z("mm")
    a, b, aa, bb = z("sg1") - z("x1"), z("sg2") - z("x2"), z("sgg1") - z("xx1"), z("sgg2") - z("xx2")
    va, vb = aa * n - a * a, bb * n - b * b
    r = F.when((n >= min_valid) & (va > 0) & (vb > 0), (z("s12") * n - a * b) / F.sqrt(va * vb)).otherwise(F.lit(0.0))
    return written(out.select("v1", "v2", r.alias("r")).withColumn("r2", F.col("r") * F.col("r")))


def impute_mean(genotypes: DataFrame) -> DataFrame:
    """Missing codes of dense rows become the variant's mean."""
    return genotypes.withColumn("g", F.coalesce(F.col("g").cast("double"), F.avg("g").over(Window.partitionBy("v")), F.lit(0.0)))
