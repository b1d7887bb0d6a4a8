"""Document fingerprints: threshold-scaled sketches, DataFrame functions only.

A text's shingles (five words, cut at ASCII white space; fewer words: the whole sequence as one) are hashed by md5, and a
sketch keeps every hash below a fixed fraction of the hash space: its first DIGITS hexadecimal digits, sorted, distinct. The
threshold is the same for all texts, so a sketch grows with its text, the union of two sketches is the sketch of both texts
together (merge_sketches), and shares of a sketch estimate containment however unequal the texts are. A fingerprint is the
text's md5, `:`, and the kept hashes in a row; where no hash of either text is kept, the md5 alone tells equal texts
(likeness 1) from others (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WORDS, DIGITS = 5, 12
#: Part of the hash space below which a hash is kept.
FRACTION = 1 / 8
#: Ranges of doc_id for each shuffle partition: hashing ranges to tasks then leaves no task far above the others.
RANGES = 4


def spaced(text: Column) -> Column:
    """A text with every run of ASCII white space as one blank."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def full_shingles(line: Column) -> Column:
    """The shingles of WORDS words of a spaced text, in order, with repetitions."""
    run = " ".join(["[^ ]++"] * WORDS)
    return F.regexp_extract_all(line, F.lit(f"(?=({run}))[^ ]++"), F.lit(1))


def shingles(line: Column) -> Column:
    """full_shingles(), or all words as one where they are fewer; none of a blank text."""
    full, words = full_shingles(line), F.trim(line)
    return F.when(F.size(full) > 0, full).when(words != "", F.array(words)).otherwise(F.array().cast("array<string>"))


def digests(texts: Column) -> Column:
    return F.transform(texts, lambda x: F.substring(F.md5(x.cast("binary")), 1, DIGITS))


def sketch_of(hashes: Column, fraction: float = FRACTION) -> Column:
    """The distinct hashes below the fraction, sorted."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction of kept hashes must be above 0 and at most 1")
    kept = hashes if fraction == 1 else F.filter(hashes, lambda h: h < f"{int(fraction * 16**DIGITS):0{DIGITS}x}")
    return F.sort_array(F.array_distinct(kept))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Estimate of the Jaccard similarity of two shingle sets from their sketches; `same` decides where both are empty."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(same.cast("double"))


def containment(a: Column, b: Column, same: Column) -> Column:
    """Estimate of the part of a's shingles that b holds; where a's sketch is empty, 1 if the texts are the same, else 0."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise(same.cast("double"))


def sketches(docs: DataFrame, text: str = "text", fraction: float = FRACTION) -> DataFrame:
    """docs with `sketch`. Null and blank texts have no shingles and an empty sketch."""
    return docs.withColumn("_shingles", shingles(spaced(F.col(text)))).withColumn("sketch", sketch_of(digests(F.col("_shingles")), fraction)).drop("_shingles")


def merge_sketches(sketched: DataFrame, *by: str) -> DataFrame:
    """One sketch for each group, that of all its texts together: hashes are made distinct before they are shuffled, and
    meet by (group, leading digits) first, so that a group with a third of all rows is many groups until its sketch is put
    together. A group of empty sketches has an empty one."""
    each = sketched.select(*by, F.explode_outer("sketch").alias("h")).distinct()
    parts = each.groupBy(*by, F.substring("h", DIGITS - 2, 2).alias("_digits")).agg(F.collect_list("h").alias("part"))
    return parts.groupBy(*by).agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("sketch"))


def _ranges(docs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """(rows with their range and its order columns, the first key of each range with the range before it).

    Ranges of about equal numbers of rows in the order of (doc_id, nulls first, md5 of the text). Bounds are approximate
    quantiles: `parts` numbers on the driver. A doc_id that fills several ranges is divided by the text's md5."""
    least = -(1 << 63)
    at = docs.withColumn("_id", F.coalesce(F.col("doc_id"), F.lit(least)))
    cuts = at.agg(F.percentile_approx("_id", [k / parts for k in range(1, parts)], F.lit(20 * parts)).alias("c")).first()["c"] if parts > 1 else []
    cuts = cuts or []
    heavy = {x for x, y in zip(cuts, cuts[1:], strict=False) if x == y}
    step = max(1, round(len(cuts) ** 0.5))
    bounds = F.array(*[F.lit(x) for x in cuts]).cast("array<bigint>")
    coarse = F.array(*[F.lit(x) for x in cuts[step - 1 :: step]]).cast("array<bigint>")
    skipped = F.size(F.filter(coarse, lambda x: x < F.col("_id"))) * step
    at = at.withColumn("_skip", skipped).withColumn("_low", F.col("_skip") + F.size(F.filter(F.slice(bounds, F.col("_skip") + 1, step), lambda x: x < F.col("_id"))))
    if heavy:
        equal = F.greatest(F.size(F.filter(bounds, lambda x: x == F.col("_id"))) - 1, F.lit(0))
        at = at.withColumn("_md5", F.md5(F.col("text").cast("binary")))
        share = F.floor(F.conv(F.substring("_md5", 1, 6), 16, 10).cast("long") * (equal + 1) / F.lit(16**6)).cast("int")
        at = at.withColumn("_range", F.col("_low") + share)
    else:
        at = at.withColumn("_md5", F.lit("")).withColumn("_range", F.col("_low"))
    starts = at.groupBy("_range").agg(F.min(F.struct("_id", "_md5")).alias("k"))
    order = Window.orderBy("_range")  # at most `parts` + 1 rows
    before = F.coalesce(F.lag("_range").over(order), F.max("_range").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return at, starts.select(before.alias("_before"), F.col("k._id").alias("_id"), F.col("k._md5").alias("_md5"))


def fingerprint_edits(docs: DataFrame, fraction: float = FRACTION, parts: int | None = None) -> DataFrame:
    """Each document's fingerprint, that of an edited text, and what they share: the contract of op11.

    The edited text has its last floor(n_chars / 4) code points replaced by the first as many (or all) of the next document
    in the order of doc_id, null ids first, ties by the text's md5; after the last comes the first, a single document follows
    itself. Null texts are empty; repeated rows are documents of their own, each with the copy after it; an empty table gives
    no row; columns other than doc_id and text are left out.

    Texts are shuffled once, to ranges of doc_id; the first row of a range is sent to the range before it too. Hashes of
    shingles before the edit are taken over from the text."""
    parts = parts or RANGES * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows, starts = _ranges(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), parts)
    own, also = F.struct(F.col("_range"), F.lit(False).alias("_late")), F.struct(F.col("_before").alias("_range"), F.lit(True).alias("_late"))
    sent = rows.join(F.broadcast(starts), ["_id", "_md5"], "left")
    sent = sent.select("doc_id", "_id", "text", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("_to"))
    sent = sent.select("doc_id", "_id", "text", F.col("_to._range").alias("_range"), F.col("_to._late").alias("_late"), F.md5(F.col("text").cast("binary")).alias("_md5"))
    along = Window.partitionBy("_range").orderBy("_late", "_id", "_md5")
    cut = "CAST(floor(length(text) / 4) AS INT)"
    x = sent.withColumn("_next", F.lead("text").over(along)).withColumn("_kept", F.expr(f"substring(text, 1, length(text) - {cut})")).withColumn("_put", F.expr(f"substring(_next, 1, {cut})"))
    edited, kept = F.concat("_kept", "_put"), F.ltrim(spaced(F.col("_kept")))
    x = x.select("doc_id", "_id", "_md5", "_range", "_late", F.length("text").cast("long").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"), F.md5(edited.cast("binary")).alias("_me"), spaced(F.col("text")).alias("_line"), kept.alias("_kept"), "_put")
    # Fields of the kept part: words that the edit leaves alone and a last one, cut or empty. Shingles of the words before it are the text's own.
    x = x.withColumn("_own", shingles(F.col("_line"))).withColumn("_fields", F.length("_kept") - F.length(F.replace("_kept", F.lit(" "), F.lit(""))) + 1)
    x = x.withColumn("_rest", spaced(F.concat(F.when(F.col("_fields") > WORDS, F.substring_index("_kept", " ", -WORDS)).otherwise(F.col("_kept")), "_put")))
    x = x.withColumn("_more", F.when(F.col("_fields") > WORDS, full_shingles(F.col("_rest"))).otherwise(shingles(F.col("_rest"))))
    x = x.drop("_line", "_kept", "_put", "_rest").withColumn("_h", digests(F.col("_own"))).withColumn("_hm", digests(F.col("_more")))
    x = x.withColumn("_s", sketch_of(F.col("_h"), fraction)).withColumn("_se", sketch_of(F.concat(F.slice("_h", F.lit(1), F.greatest(F.col("_fields") - WORDS, F.lit(0))), "_hm"), fraction)).withColumn("_m", F.col("_md5"))
    x = x.select("doc_id", "_id", "_md5", "_range", "_late", "n_chars", "edited_sha256", "_s", "_se", "_m", "_me", F.lead(F.struct("_s", "_m")).over(along).alias("_n")).where("NOT _late")
    same_edited, same_next = F.col("_m") == F.col("_me"), F.col("_m") == F.col("_n._m")
    return x.select(
        "doc_id", "n_chars", "edited_sha256",
        F.concat_ws(":", "_m", F.array_join("_s", "")).alias("fingerprint"), F.concat_ws(":", "_me", F.array_join("_se", "")).alias("edited_fingerprint"),
        likeness(F.col("_s"), F.col("_se"), same_edited).alias("near_edited"), likeness(F.col("_s"), F.col("_n._s"), same_next).alias("near_next"),
        containment(F.col("_s"), F.col("_se"), same_edited).alias("held_by_edited"), containment(F.col("_s"), F.col("_n._s"), same_next).alias("held_by_next"),
    )
