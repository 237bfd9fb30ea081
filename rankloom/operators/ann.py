"""Approximate neighbours: an inverted-file index over k-means cells.

The exact join in `rankloom.operators.knn` is the default. This index trades
recall for reading only the cells nearest to each query.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.functions.scores import DISTANCE_THRESHOLD, MAX_CANDIDATES
from rankloom.functions.vectors import norm
from rankloom.operators.knn import knn
from rankloom.operators.scan import file_part

# Cells that are stated in a scan as literals.
STATED_CELLS = 10_000
FILE_ROWS = 1_000_000
# Entries of a matrix of vectors by cells that a task holds.
_ENTRIES = 1 << 21


def train_cells(corpus: DataFrame, cells: int, seed: int = 7) -> dict[int, np.ndarray]:
    """Cell centres on the unit sphere for every width of vectors, fitted on all of them.

    A width of fewer than two vectors for each cell stays one cell, without centres. One
    small job per width.
    """
    usable = corpus.where(F.col("embedding").isNotNull() & (norm(F.col("embedding")) > 0))
    widths = usable.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n")).collect()
    unit = F.transform("embedding", lambda x: x.cast("double") / norm(F.col("embedding")))
    centres = {}
    for width in sorted(r.width for r in widths if r.n >= 2 * cells):
        points = usable.where(F.size("embedding") == width).select(array_to_vector(unit).alias("features"))
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(points)
        centres[width] = unit_rows(np.array(model.clusterCenters()))
    return centres


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def _nearest_cells(shared, probes: int):
    """Names of the nearest cells of each vector: its width and the cell's number.

    Vectors of a width without centres are all in one cell of that width, so that they
    are compared with each other and nothing is lost.
    """
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def cells(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        widths = np.array([-1 if v is None else len(v) for v in vectors])
        for width in np.unique(widths[widths > 0]).tolist():
            rows = np.flatnonzero(widths == width)
            centres = shared.value.get(width)
            if centres is None:
                for row in rows:
                    out[row] = [f"{width}-0"]
                continue
            step = max(1, _ENTRIES // len(centres))
            for at in range(0, len(rows), step):
                some = rows[at:at + step]
                scores = np.stack(vectors.iloc[some].tolist()).astype(np.float64) @ centres.T
                nearest = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                for row, own in zip(some, nearest.tolist()):
                    out[row] = [f"{width}-{c}" for c in own]
        return pd.Series(out, dtype=object)

    return cells


def assign_cells(corpus: DataFrame, centres: dict[int, np.ndarray]) -> DataFrame:
    """Adds ``cell``; write the corpus partitioned by it to make probes prune."""
    shared = corpus.sparkSession.sparkContext.broadcast(centres)
    return corpus.withColumn("cell", _nearest_cells(shared, 1)("embedding")[0])


def write_cells(corpus: DataFrame, path: str, mode: str = "append", file_rows: int = FILE_ROWS) -> None:
    """Write rows with a ``cell`` in one folder per cell; rows without a vector are left out.

    A cell gets one file for every ``file_rows`` of its rows.
    """
    rows = corpus.where(F.col("cell").isNotNull())
    rows.repartition("cell", file_part(rows, ["cell"], "id", file_rows)).write.mode(mode).partitionBy("cell").parquet(path)


def probe(
    corpus: DataFrame,
    queries: DataFrame,
    centres: dict[int, np.ndarray],
    probes: int = 4,
    threshold: float | None = DISTANCE_THRESHOLD,
    cap: int = MAX_CANDIDATES,
    **options,
) -> DataFrame:
    """Exact search of each query within its ``probes`` nearest cells.

    The tenant key is extended by the cell, so the exact join compares a query only with
    rows of its own tenant in the probed cells, and ranks what all its cells return
    together. The probed cells, of which there are at most as many as centres, are stated
    in the scan: of a corpus in folders by cell only those are read. Queries that probe as many
    cells as there are meet all rows of their tenant, and no copies of them go to the cells.
    """
    if probes >= max(map(len, centres.values()), default=1):
        def in_every(df: DataFrame) -> DataFrame:
            return df.withColumn("tenant", F.concat_ws("/", "tenant", F.lit("every")))

        return knn(in_every(corpus), in_every(queries), threshold, cap, **options)
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    def in_cell(df: DataFrame) -> DataFrame:
        return df.withColumn("tenant", F.concat_ws("/", "tenant", "cell"))

    asked = queries.withColumn("cell", F.explode(_nearest_cells(shared, probes)("vector")))
    if sum(map(len, centres.values())) <= STATED_CELLS:
        probed = [r.cell for r in asked.select("cell").distinct().limit(STATED_CELLS + 1).collect()]
        if len(probed) <= STATED_CELLS:
            corpus = corpus.where(F.col("cell").isin(probed))
    return knn(in_cell(corpus), in_cell(asked), threshold, cap, **options)


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """Share of exact hits the approximate search also found, one row."""
    found = approximate.select("query_id", "id", F.lit(1).alias("hit"))
    joined = exact.select("query_id", "id").join(found, ["query_id", "id"], "left")
    return joined.agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
