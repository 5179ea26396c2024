"""Document fingerprints by SpotSigs, in DataFrame expressions only.

A spot is a common word (the anchor) with the two content words that follow it, common words between
them left out, however many. The fingerprint is the set of the spots' hashes. Fingerprints are compared by Jaccard;
those whose numbers of spots differ too much for the similarity asked for are never intersected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.llm.texts import bodies

#: Common words of English, German, French and Spanish; the anchors are those of them that are articles and auxiliaries.
COMMON = ("the a an of and to in is that for it on was as with be by this are from at or "
          "der die das und den von zu mit des im ist ein eine nicht auf für sich dem es auch "
          "le la les de et des en un une est que du dans pour par sur avec qui au ne "
          "el los las del y se por con para una su lo como más").split()
ANCHORS = "the a an is was be are this der die das ist ein eine dem le la les un une est el los las se su lo".split()
#: Stands before an anchor in place of its space, so that a run of anchors is a run of characters without a space; words hold letters
#: and digits only.
_MARK = "\ue000"
_OTHER = f" (?:{'|'.join(w for w in COMMON if w not in ANCHORS)})(?= )"
_ANCHOR = f" ({'|'.join(ANCHORS)})(?= )"
#: A run of anchors, with what follows up to the second content word if there is one; a match ends with the run.
_RUN = f"{_MARK}(?:(?=([^ ]++ [^ {_MARK}]++(?:{_MARK}[^ ]++)? [^ {_MARK}]++))[^ ]++|[^ ]++)"


def spots(text: Column) -> Column:
    """The sorted set of spot hashes of a text. A text without spots has one, the hash of all its words,
    so that equal texts are alike and others are not.

    Common words that are no anchors are dropped first. Anchors that follow each other have the same two content words, so
    each run is looked at once, however long it is and however many common words are in between.
    """
    words = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    marked = F.regexp_replace(F.regexp_replace(words, _OTHER, ""), _ANCHOR, f"{_MARK}$1")
    found = F.filter(F.regexp_extract_all(marked, F.lit(_RUN), F.lit(1)), lambda m: m != "")

    def of_run(run: Column) -> Column:
        parts = F.split(run, " ")
        first = F.split(parts[1], _MARK)[0]
        return F.transform(F.array_distinct(F.split(parts[0], _MARK)), lambda a: F.hash(F.concat_ws(" ", a, first, parts[2])))

    bare = F.flatten(F.transform(found, of_run))
    return F.when(F.size(bare) > 0, F.array_sort(F.array_distinct(bare))).otherwise(F.array(F.hash(words)))


def as_string(fingerprint: Column) -> Column:
    return F.array_join(fingerprint.cast("array<string>"), ",")


def length_class(fingerprint: Column, similarity: float) -> Column:
    """Fingerprints that are alike are in the same class or in neighbouring ones."""
    return F.floor(F.log(F.size(fingerprint).cast("double")) / -math.log(similarity))


def likeness(a: Column, b: Column, similarity: float = 0.0) -> Column:
    """Jaccard of two fingerprints; 0 where it is below ``similarity``, without intersecting them where their
    lengths alone say so."""
    common = F.size(F.array_intersect(a, b)).cast("double")
    exact = common / (F.size(a) + F.size(b) - common)
    if not similarity:
        return exact
    lengths = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    return F.when(lengths >= similarity, F.when(exact >= similarity, exact).otherwise(0.0)).otherwise(0.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text and spots of every document. A null text is empty; other columns are not looked at."""
    return bodies(docs).withColumn("spots", spots(F.col("text")))


def _bucket(cuts: list[int]) -> Column:
    """How many cuts are below doc_id, found in blocks of cuts; -1 for null."""
    size = max(1, math.isqrt(len(cuts)))

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda c: c < F.col("doc_id")))

    every = F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>")
    ends = F.array(*[F.lit(c) for c in cuts[size - 1 :: size]]).cast("array<bigint>")
    skipped = below(ends) * size
    return F.when(F.col("doc_id").isNull(), -1).otherwise(skipped + below(F.slice(every, skipped + 1, size)))


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, text and spots of every document, and next_text and next_spots of the one that follows by
    descending doc_id (null last, equal ids by text hash); the first follows the last.

    Documents are dealt to ``buckets`` ranges of doc_id between approximate quantiles, and each range also
    gets the first document of the following one. Only the quantiles and the keys of those first
    documents, as many as there are ranges, come to the driver.
    """
    base = bodies(docs).withColumn("h", F.xxhash64("text"))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("bigint"), shares, 100 * buckets)).first()[0] if shares else None
    base = base.withColumn("bucket", _bucket(sorted(set(cuts))) if cuts else F.lit(0))
    heads = base.groupBy("bucket").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("head")).collect()
    heads = sorted(heads, key=lambda r: -r.bucket)
    moved = [(heads[i - 1].bucket, r.head.doc_id, ~r.head.h) for i, r in enumerate(heads)]
    wanted = docs.sparkSession.createDataFrame(moved, "target int, head_id bigint, head_h bigint")
    first = base.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("h") == F.col("head_h")))
    rows = base.withColumn("guest", F.lit(0)).unionByName(
        first.select("doc_id", "text", "h", F.col("target").alias("bucket"), F.lit(1).alias("guest")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").desc_nulls_last(), "h")
    rows = rows.withColumn("spots", spots(F.col("text"))).withColumns(
        {f"next_{c}": F.lead(c).over(order) for c in ("text", "spots")})
    return rows.where("guest = 0").select("doc_id", "text", "spots", "next_text", "next_spots")


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every
    document. The edited text has the beginning of the next document in place of its last third.

    Null texts are empty, and so are their edited texts. Repeated rows follow each other; a single document
    follows itself. Other columns are not looked at.
    """
    buckets = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    text = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    rows = with_next(docs, buckets).withColumn("edited", text).withColumn("edited_spots", spots(F.col("edited")))
    return rows.select(
        "doc_id", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("spots")).alias("fingerprint"), as_string(F.col("edited_spots")).alias("edited_fingerprint"),
        likeness(F.col("spots"), F.col("edited_spots")).alias("near_edited"),
        likeness(F.col("spots"), F.col("next_spots")).alias("near_next"))
