"""Bounded training samples and hold-out folds."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardloom.llm.shared import discard, staged

#: Most bytes of training text of each label value, most training rows of all, and how many label values are broadcast.
MOST_BYTES, MOST_IN_ALL, BROADCAST_LABELS, SALTS = 8 << 20, 50_000, 10_000, 64


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null ids have fold null."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


def bounded_rows(rows: DataFrame, label: str, most: int, *, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = MOST_BYTES, most_in_all: int = MOST_IN_ALL) -> list[tuple]:
    """At most `most` rows (text, label) and `most_bytes` of text of each label value, spread by a hash of id and text.

    The label is a column of `rows`, or of `labels` by `id_col`. All label values share `most_in_all` rows: with many of
    them each has fewer, with more than that a part of them has one. Rows that repeat an id and a text count once; texts
    longer than `most_bytes` and null labels are left out. The same rows come back whatever the partitioning. Texts are
    neither shuffled nor joined: rows are picked by hash and size, and only the texts of those picked are read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h = F.xxhash64(F.col(id_col).cast("string"), text, F.lit("sample"))
    given = rows.select(F.col(id_col).alias("i"), h.alias("h"), F.octet_length(text).cast("long").alias("b"), *([F.col(label).alias("y")] if labels is None else []))
    if labels is not None:
        given = given.join(labels.select(F.col(id_col).alias("i"), F.col(label).alias("y")), "i")
    given = given.filter(F.col("y").isNotNull() & (F.col("b") <= most_bytes)).select("y", "h", "b")
    counts = staged(given.groupBy("y").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b")))
    values = counts.count()
    if not values:
        return []
    each = max(1, min(most, most_in_all // values))
    rate = F.least(F.lit(1.2 * each) / F.col("n"), F.lit(1.2 * most_bytes) / F.greatest("b", F.lit(1))) * min(1.0, most_in_all / values)
    unit = F.col("h").cast("double") / 2.0**64 + 0.5
    rates = counts.select(F.col("y").alias("of"), rate.alias("rate"))
    if values <= BROADCAST_LABELS:
        picked = given.join(F.broadcast(rates), F.col("y") == F.col("of"))
    else:  # a frequent label is dealt over salts
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        picked = given.withColumn("s", F.pmod("h", F.lit(SALTS)).cast("int")).join(rates.withColumn("r", salts), (F.col("y") == F.col("of")) & (F.col("s") == F.col("r")))
    # About 1.2 * most_in_all rows of two numbers at most.
    picked = F.broadcast(picked.filter(unit < F.col("rate")).select("y", F.col("h").alias("k")).distinct())
    got = rows.select(h.alias("h"), F.col(text_col).alias("t")).join(picked, F.col("h") == F.col("k")).groupBy("y", "h").agg(F.first("t").alias("t")).collect()
    discard(counts)
    out, taken, held = [], Counter(), Counter()
    for r in sorted(got, key=lambda r: (r["h"], r["t"] or "")):
        n = len((r["t"] or "").encode())
        if taken[r["y"]] < each and (held[r["y"]] + n <= most_bytes):
            taken[r["y"]] += 1
            held[r["y"]] += n
            out.append((r["t"], r["y"]))
    return out
