"""Binary STL surfaces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Header bytes, and bytes of one facet. Fixed values of the format.
HEADER, FACET = 84, 50


def facets(raw: bytes) -> np.ndarray:
    """(n, 12): normal and three corners of each facet; the file's size tells how many there are."""
    if len(raw) < HEADER or (raw[:5] == b"solid" and (len(raw) - HEADER) % FACET):
        raise ValueError("not a binary STL file")
    n = (len(raw) - HEADER) // FACET
    body = np.frombuffer(raw, np.uint8, n * FACET, HEADER).reshape(n, FACET)
    return body[:, :48].copy().view("<f4").astype(float)


def read_stl(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``facet``, ``nx`` .. ``nz`` and the corners ``x0`` .. ``z2``."""
    names = ["nx", "ny", "nz", *(f"{c}{k}" for k in range(3) for c in "xyz")]

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, raw in zip(batch["path"], batch["content"], strict=True):
                out = pd.DataFrame(facets(bytes(raw)), columns=names)
                out.insert(0, "facet", np.arange(len(out)))
                out.insert(0, "file", file)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(step, "file string, facet long, " + ", ".join(f"{c} double" for c in names))
