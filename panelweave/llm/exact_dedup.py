"""Exact deduplication by a tree of merged digest runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.functions.lineage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sorted runs at the leaves of the tree, and runs merged at once: four is two binomial rounds in one.
RUNS, FAN_IN = 64, 4


def _verified(lo: str, hi: str, value: Column) -> Column:
    return F.when(F.col(lo) == F.col(hi), value).otherwise(F.raise_error(F.lit("texts of one digest differ")))


def group_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", runs: int = RUNS, fan_in: int = FAN_IN
) -> DataFrame:
    """``(id_col, keep_id, group_size, kept, text_sha256)`` for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. ``keep`` names the id that stays:
    the smallest or the largest of the group, null only if all are null. ``group_size`` counts rows. Rows that repeat
    an id are one document: all are kept if that id stays. Columns other than the two named are not read.

    Rows fall into ``runs`` runs by a hash of the id; a run is its digests in order, one row for each, dealt into ranges
    of digests. In a round, ``fan_in`` neighbouring runs are exchanged range by range and merged in sorted order, until one
    run is left: 64, 16, 4, 1. The ids that stay travel back down the same tree. A group that holds a third of all rows
    is thus spread over all runs, and above the leaves one digest has ``fan_in`` rows at most in a merge. Each level
    verifies that an independent hash and the byte length agree within a digest, else the job fails.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    text = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), UPPER, LOWER)
    kind = docs.schema[id_col].dataType
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashed = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("hex"), F.xxhash64(text).alias("other"), F.octet_length(text).cast("long").alias("bytes"))
    rows = materialize(
        hashed.select(
            "id",
            F.unhex("hex").alias("digest"),
            F.struct("other", "bytes").alias("seal"),
            F.shiftright(F.conv(F.substring("hex", 1, 8), 16, 10).cast("long") * parts, 32).cast("int").alias("range"),
            F.pmod(F.xxhash64("id"), F.lit(runs)).cast("int").alias("run"),
        ),
        "digests",
    )

    def merged(level: DataFrame, size: Column) -> DataFrame:
        """One row for each digest of a run: what comes together in a range is sorted, and the aggregation streams over it."""
        together = level.repartition(parts, "range", "run").sortWithinPartitions("range", "run", "digest")
        found = together.groupBy("range", "run", "digest").agg(best("id").alias("id"), size.alias("n"), F.min("seal").alias("seal"), F.max("seal").alias("seal_hi"))
        return found.select("range", "run", "digest", "id", _verified("seal", "seal_hi", F.col("n")).alias("n"), "seal")

    levels, width = [materialize(merged(rows, F.count("*")), "runs")], runs
    while width > 1:
        width = -(-width // fan_in)
        up = levels[-1].withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        levels.append(materialize(merged(up, F.sum("n")), "runs"))
    down = levels[-1].select("range", "run", "digest", F.col("id").alias("keep_id"), F.col("n").alias("group_size"))
    for level in reversed(levels[:-1]):
        here = level.select("range", F.col("run").alias("own"), "digest", F.floor(F.col("run") / fan_in).cast("int").alias("run"))
        down = here.join(down, ["range", "run", "digest"]).select("range", F.col("own").alias("run"), "digest", "keep_id", "group_size")
    return rows.join(down, ["range", "run", "digest"]).select(
        F.col("id").cast(kind).alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
