"""Exact duplicates by skew-safe combining.

Three stages, each of which compares whole normalised contents and not digests alone:

1. *local*: the partial aggregate of the first `groupBy` merges equal contents inside each input task;
2. *salted*: what the tasks kept meets by (digest, salt, content), where the salt comes from the input task, so
   that a group that holds a third of all rows is merged by `salts` tasks;
3. *global*: the at most `salts` winners of a group meet by digest and are merged by content.

The last stage also counts the contents of every digest. A digest with a single content, as practically all have, is
thereby shown to name one group, and documents learn their group's winner by it; those of a digest with several
contents compare the contents again. Winners of large groups are broadcast (see `looked_up`), so no task gets a group.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardloom.llm.shared import looked_up, sifted, staged

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
SALTS = 16
#: Digests of several contents that are named one by one; with more of them, every content is compared.
MOST_NAMED = 10_000


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def normalised(text: Column) -> Column:
    """`text` without the six ASCII white-space characters; null counts as empty."""
    return reduce(lambda c, w: F.replace(c, F.lit(w), F.lit("")), WHITE, F.coalesce(text, F.lit("")))


def _points(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("long")


def _winners(docs: DataFrame, id_col: str, text_col: str, salts: int, digest: Callable[[Column], Column]) -> tuple[DataFrame, Callable[[Column, Column], Column]]:
    """(w_key, w_id, w_n, w_size) of every group of two rows or more, and the key of a row from its digest and content."""
    content = normalised(F.col(text_col))
    # The order of the rank: most code points, an id rather than none, then the smallest id.
    rank = F.struct(_points(F.col(text_col)).alias("n"), F.col(id_col).isNotNull().alias("known"), F.bitwise_not(F.col(id_col).cast("long")).alias("inverse"))
    local = docs.select(digest(content).alias("digest"), content.alias("content"), rank.alias("best"), F.lit(1).cast("long").alias("size"), (F.spark_partition_id() % salts).alias("salt"))
    merged = lambda keys, df: df.groupBy(*keys).agg(F.max("best").alias("best"), F.sum("size").alias("size"))
    salted = merged(["digest", "salt", "content"], local)
    groups = merged(["digest", "content"], salted.repartition("digest"))
    several = F.count(F.lit(1)).over(Window.partitionBy("digest")) > 1
    groups = groups.withColumn("several", several).filter("size > 1 OR several").withColumn("content", F.when(F.col("several"), F.col("content")))
    found = staged(groups.select("digest", "content", "several", "size", F.col("best.n").alias("n"), F.bitwise_not("best.inverse").alias("id")))
    named = [r[0] for r in found.filter("several").select("digest").distinct().limit(MOST_NAMED + 1).collect()]

    def key(d: Column, c: Column) -> Column:
        whole = F.concat(d, F.lit(":"), c)
        return d if not named else whole if len(named) > MOST_NAMED else F.when(d.isin(named), whole).otherwise(d)

    if len(named) > MOST_NAMED:  # then the contents of all groups are needed
        full = merged(["digest", "content"], salted.repartition("digest")).filter("size > 1")
        found = staged(full.select("digest", "content", F.lit(True).alias("several"), "size", F.col("best.n").alias("n"), F.bitwise_not("best.inverse").alias("id")))
    w_key = F.when(F.col("several"), F.concat("digest", F.lit(":"), "content")).otherwise(F.col("digest"))
    return found.filter("size > 1").select(w_key.alias("w_key"), F.col("id").alias("w_id"), F.col("n").alias("w_n"), F.col("size").alias("w_size")), key


def _stays(doc_id: Column, n: Column) -> Column:
    return F.col("w_size").isNull() | (doc_id.eqNullSafe(F.col("w_id")) & (n == F.col("w_n")))


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal contents the row with the most code points in its original text stays, then the one with the smallest id.
    Null and empty texts, and texts of white space only, are equal to one another. Rows that repeat an id and a text
    count singly in group_size and share `kept`. A null id comes last among ties; if only null ids are left, keep_id is
    null and `kept` is true. An empty table gives an empty result. Other columns are ignored, whatever their names.
    `digest` only spreads and finds groups: equal digests of different contents stay apart.
    """
    winners, key = _winners(docs, id_col, text_col, salts, digest)
    rows = docs.select(F.col(id_col).alias("doc_id"), _points(F.col(text_col)).alias("n"), normalised(F.col(text_col)).alias("content"))
    rows = rows.withColumn("digest", digest(F.col("content"))).select("doc_id", "n", "digest", key(F.col("digest"), F.col("content")).alias("w_key"))
    joined = looked_up(rows, winners, "w_key", "w_size")
    return joined.select(
        "doc_id",
        F.when(F.col("w_size").isNull(), F.col("doc_id")).otherwise(F.col("w_id")).alias("keep_id"),
        F.coalesce("w_size", F.lit(1).cast("long")).alias("group_size"),
        _stays(F.col("doc_id"), F.col("n")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def deduped(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """The rows of `docs` that stay, all columns as they were: exactly one of each group of `exact_groups`.

    Rows are told apart by their content, so a unique text stays whatever rows share its id. Of rows that share the
    winner's id and length (repeated rows, null ids) one stays.
    """
    winners, key = _winners(docs, id_col, text_col, salts, digest)
    w_key = key(digest(normalised(F.col(text_col))), normalised(F.col(text_col)))
    place = F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))
    slim = docs.select(F.col(id_col).alias("_id"), _points(F.col(text_col)).alias("_n"), place.alias("key"), w_key.alias("w_key"))
    grouped = staged(looked_up(slim, winners, "w_key", "w_size").filter("w_size IS NOT NULL").select("key", "w_key", _stays(F.col("_id"), F.col("_n")).alias("stays")))
    # Only keys whose winner stands for several rows need one of them picked; mostly there are none.
    ties = staged(grouped.filter("stays").groupBy("w_key").count().filter("count > 1").select(F.col("w_key").alias("t_key"), F.col("count").alias("t_size")))
    any_tied = ties.limit(1).count()
    # Only rows that may go travel with their texts; the others stay without a join.
    loose = grouped.filter("NOT stays").select("key")
    if any_tied:
        winners = staged(winners.join(ties, F.col("w_key") == F.col("t_key"), "left").select(*winners.columns, F.col("t_key").isNotNull().alias("tied")))
        loose = loose.unionByName(looked_up(grouped.filter("stays").withColumnRenamed("w_key", "t_key"), ties, "t_key", "t_size").filter("t_size IS NOT NULL").select("key"))
    sift = sifted(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")), F.xxhash64(F.col(f"row.`{id_col}`").cast("long"), F.col(f"row.`{text_col}`")), staged(loose))
    text = F.col(f"row.`{text_col}`")
    rows = sift.filter("maybe").select("row", F.col(f"row.`{id_col}`").alias("_id"), _points(text).alias("_n"), key(digest(normalised(text)), normalised(text)).alias("w_key"))
    stay = looked_up(rows, winners, "w_key", "w_size").filter(_stays(F.col("_id"), F.col("_n")))
    sure = sift.filter("NOT maybe").select("row.*")
    if not any_tied:
        return sure.union(stay.select("row.*"))
    one = stay.filter("tied").groupBy("w_key").agg(F.first("row").alias("row"))
    return sure.union(stay.filter("NOT coalesce(tied, false)").select("row.*")).union(one.select("row.*"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS c
  FROM documents
), w AS (
  SELECT doc_id, c, first_value(doc_id) OVER (PARTITION BY c ORDER BY n DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY c) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(c) AS text_sha256 FROM w
"""
