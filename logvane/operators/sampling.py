"""Seeded samples that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logvane.session import materialize


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: those with the smallest seeded hash of the key.

    A bound on the hash first leaves little more than ``n`` rows, so the final
    sort does not move a candidate set from every partition to one task.
    """
    total = df.count()
    if total <= n:
        return df
    digest = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col(key).cast("string")))
    ranked = df.withColumn("_h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    share = (n + 10 * math.sqrt(n) + 10) / total
    if share < 1:
        bound = int(share * 2**60)
        # little more than the sample: stored, as counting it would hash all keys once more
        near = materialize(ranked.filter(F.col("_h") <= bound), "sampled")
        if near.count() >= n:
            ranked = near
    return ranked.orderBy("_h", key).limit(n).drop("_h")
