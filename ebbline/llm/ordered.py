"""Documents dealt out by ascending doc_id: each task holds one range of ids, in order.

The bounds of the ranges are ids that occur (one small row reaches the driver),
so the first document of each range is known and can also be sent to the range
before it. A null doc_id counts as the smallest; equal ids are ordered by text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The key of a null doc_id.
NULL_KEY = -(1 << 63)


def by_doc_id(documents: DataFrame, edges: bool = False) -> tuple[DataFrame, int]:
    """(part int, edge boolean, key long, text string) sorted within each partition, and the number of parts.

    A part lies whole in one partition. With edges, each part is followed by the
    rows of the next part's first id (of the first part's, after the last) with
    edge true. A null text is the empty text.
    """
    keyed = documents.select(F.coalesce(F.col("`doc_id`").cast("long"), F.lit(NULL_KEY)).alias("key"), F.coalesce(F.col("`text`"), F.lit("")).alias("text"))
    parts = common.shuffle_parts(documents.sparkSession)
    bounds = common.key_bounds(keyed, "key", parts) or [0]
    count = len(bounds)
    dealt = keyed.withColumn("part", common.bucket_of(bounds)("key"))
    here = F.struct("part", F.lit(False).alias("edge"))
    if edges:
        before = F.struct(((F.col("part") + count - 1) % count).cast("int").alias("part"), F.lit(True).alias("edge"))
        targets = F.when(F.col("key").isin(bounds), F.array(here, before)).otherwise(F.array(here))
        dealt = dealt.select("key", "text", F.explode(targets).alias("to")).select("to.part", "to.edge", "key", "text")
    else:
        dealt = dealt.select("part", F.lit(False).alias("edge"), "key", "text")
    return dealt.repartitionById(parts, "part").sortWithinPartitions("part", "edge", "key", "text"), count


def doc_id_of(key: str = "key"):
    """The doc_id of a key: null for NULL_KEY."""
    return F.when(F.col(key) != NULL_KEY, F.col(key))
