"""What the operators on vectors share: whole-number vectors, their extent, block sizes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import written

#: Rows of a block: so many times the root of all rows, between the limits; blocks
#: and what meets each of them then grow alike.
SPREAD, LEAST, MOST = 8, 1_024, 65_536
#: Components of a block, for wide vectors.
HELD = 1 << 22
#: Squared lengths stay below this, so that sums of doubles are exact.
EXACT = 1 << 46


@dataclass(frozen=True)
class Extent:
    rows: int
    width: int
    square: int  # the greatest squared length

    @property
    def block(self) -> int:
        wide = HELD // max(1, self.width)
        return max(1, min(wide, max(LEAST, min(MOST, SPREAD * math.isqrt(self.rows)))))

    @property
    def blocks(self) -> int:
        return max(1, -(-self.rows // self.block))


def finite(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    known = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(known, F.lit(False))


def whole(rows: DataFrame, scale: int, id_col: str, vector_col: str, label_col: str | None = None) -> tuple[DataFrame, Extent]:
    """``vec_id, vector[, label]`` written to the shared folder, and its extent:
    each component x becomes floor(scale * x), a whole number of 32 bits (beyond
    these Spark's cast fails). Rows without an id, a finite vector or, where asked
    for, a label take no part. Of rows under one id the least (label, vector) counts."""
    vector = F.col(f"`{vector_col}`").cast("array<double>")
    named = [F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), vector.alias("vector")]
    named += [F.col(f"`{label_col}`").cast("bigint").alias("label")] if label_col else []
    kept = rows.select(*named).where(finite(F.col("vector"))).dropna()
    scaled = kept.withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x).cast("int")))
    rest = [c for c in ("label", "vector") if c in scaled.columns]
    once = scaled.groupBy("vec_id").agg(F.min(F.struct(*rest)).alias("v")).select("vec_id", "v.*")
    once = written(once, "vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    n, width, most = once.agg(F.count("*"), F.max(F.size("vector")), F.max(square)).first()
    if (most or 0) >= EXACT:
        raise ValueError(f"squared length {most:.0f} after scaling; below {EXACT} needed for exact scores")
    return once, Extent(n, width or 0, int(most or 0))


def matrix(vectors: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as doubles; shorter vectors end in zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out
