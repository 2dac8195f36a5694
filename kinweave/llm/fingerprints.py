"""Document fingerprints: threshold-scaled sketches of word shingles (native).

The sketch of a text keeps every distinct shingle hash below a fixed fraction of
the hash range, so its size follows the text and sketches of very unequal texts
compare: the kept hashes of a union are the union of the kept hashes. Beside
these, the ``least`` smallest hashes are kept, which makes sketches of short
texts complete; they merge in the same way. Two sketches are compared
over the hashes up to the bound below which both are complete.

Only DataFrame functions are used. Null and empty texts have no shingle, an empty
fingerprint, and likeness 1 to each other and 0 to other texts. A text of one
to four words has one shingle of all its words. Order: descending doc_id, null
ids last, rows of one id by their text; equal rows count as one another's next. Long texts are
sketched whole, and their sketch grows with them, by a hash for every SCALE shingles. An empty
table gives no row. Columns other than doc_id and text are not read, whatever their names.
Rows of one id are put in order in one task, so an id should not name a large share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinweave.llm.common import partitions, whole

WORDS = 5
BITS = 48
#: The fraction of hashes that is kept is 1 / SCALE.
SCALE = 8
LEAST = 64


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sketch(words: Column, size: int = WORDS, scale: int = SCALE, least: int = LEAST) -> Column:
    """Sorted kept hashes of a column of words (a column of its own, not an expression)."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - size, F.lit(0)))
    one = lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(words, i + j) for j in range(size))), 64 - BITS)
    hashes = F.sort_array(F.array_distinct(F.transform(starts, one)))
    kept = F.filter(hashes, lambda h, i: (h < F.lit((1 << BITS) // scale)) | (i < least))
    return F.when(F.size(words) > 0, kept).otherwise(F.array().cast("array<long>"))


def bound(hashes: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The largest value up to which a sketch holds every hash of its text."""
    limit = F.lit((1 << BITS) // scale - 1)
    return F.when(F.size(hashes) < least, F.lit(1 << BITS)).when(F.size(hashes) == least, F.greatest(limit, F.element_at(hashes, -1))).otherwise(limit)


def _common(a: Column, b: Column, scale: int, least: int) -> tuple[Column, Column, Column]:
    top = F.least(bound(a, scale, least), bound(b, scale, least))
    count = lambda x: F.when(F.coalesce(F.element_at(x, -1), F.lit(0)) <= top, F.size(x)).otherwise(F.size(F.filter(x, lambda h: h <= top)))
    both = F.array_intersect(a, b)
    return F.size(F.filter(both, lambda h: h <= top)), F.when(F.size(a) > 0, count(a)).otherwise(0), F.when(F.size(b) > 0, count(b)).otherwise(0)


def likeness(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    both, n_a, n_b = _common(a, b, scale, least)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.coalesce(F.try_divide(both, n_a + n_b - both), F.lit(0.0)))


def containment(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """Estimated share of a's shingles that b has too."""
    both, n_a, _ = _common(a, b, scale, least)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.coalesce(F.try_divide(both, n_a), F.lit(0.0)))


def merged(a: Column, b: Column, scale: int = SCALE, least: int = LEAST) -> Column:
    """The sketch of two texts' shingles together."""
    return F.filter(F.sort_array(F.array_union(a, b)), lambda h, i: (h < F.lit((1 << BITS) // scale)) | (i < least))


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.hex(h), BITS // 4, "0")), "")


def _ranges(ids: DataFrame, parts: int) -> tuple[list[int], int | None]:
    """Ids that cut all ids into parts of about equal rows (without the least id); the largest id."""
    row = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] if parts > 1 else [0.5], 20 * parts), F.min("doc_id"), F.max("doc_id")).first()
    cuts = sorted({x for x in row[0] or [] if x > row[1]}) if parts > 1 else []
    return cuts, row[2]


def _range_of(column: Column, cuts: list[int]) -> Column:
    """The number of cuts not above a value, found in two steps; null: 0."""
    if not cuts:
        return F.lit(0)
    step = max(1, round(len(cuts) ** 0.5))
    longs = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    upto = lambda xs: F.size(F.filter(xs, lambda c: c <= column))
    coarse = upto(longs(cuts[::step]))  # so many steps begin at or below the value
    fine = F.array(*(longs(cuts[k : k + step]) for k in range(0, len(cuts), step)))
    return F.when(column.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * step + upto(F.get(fine, coarse - 1)))


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next_<c> of each column: its value in the next row by descending doc_id; the last row's next is the first.

    Rows are dealt to ranges of ids. The first row of a range is also sent to
    the range above it, as the next of its last row: one shuffle, no global sort.
    """
    spark = docs.sparkSession
    cuts, top = _ranges(docs.select("doc_id"), partitions(spark))
    ranged = docs.withColumn("_range", _range_of(F.col("doc_id"), cuts))
    highest = {r[0]: r[1] for r in ranged.groupBy("_range").agg(F.max("doc_id")).collect()}  # one row a range
    largest = F.array(*(F.lit(highest.get(k)).cast("long") for k in range(len(cuts) + 1)))
    above = F.when((F.col("_range") < len(cuts)) & (F.col("doc_id") == F.get(largest, F.col("_range"))), F.col("_range") + 1)
    first = F.when(F.col("doc_id").eqNullSafe(F.lit(top).cast("long")), F.lit(0))
    place = lambda r, copy: F.struct(r.cast("int").alias("part"), F.lit(copy).alias("copy"))
    places = F.filter(F.array(place(F.col("_range"), 0), place(above, 1), place(first, 2)), lambda p: p.part.isNotNull())
    dealt = ranged.withColumn("_place", F.explode(places)).withColumns({"_part": F.col("_place.part"), "_copy": F.col("_place.copy")}).drop("_place", "_range")
    from pyspark.sql import Window

    order = Window.partitionBy("_part").orderBy("_copy", F.desc_nulls_last("doc_id"), F.xxhash64("text"), "text")
    return dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in columns}).filter("_copy = 0").drop("_part", "_copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and contained_edited."""
    rows = docs.select("doc_id", whole().alias("text")).withColumn("words", word_list(F.col("text")))
    rows = rows.select("doc_id", "text", sketch(F.col("words")).alias("sketch"))
    rows = with_next(rows, ["text", "sketch"])
    third = F.floor(F.length("text") / 3).cast("int")
    rows = rows.select("doc_id", "sketch", "next_sketch", F.length("text").cast("long").alias("n_chars"), F.concat(F.substring("text", F.lit(1), F.length("text") - third), F.substring("next_text", F.lit(1), third)).alias("edited"))
    rows = rows.withColumn("words", word_list(F.col("edited")))
    rows = rows.withColumn("edited_sketch", sketch(F.col("words")))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast(T.BinaryType()), 256).alias("edited_sha256"), as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"), containment(F.col("sketch"), F.col("edited_sketch")).alias("contained_edited"),
    )
