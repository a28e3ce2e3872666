"""Page images as arrays of grey values: whether a page has text."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: what is dark, how much of a page is looked at, and when it has text
DARK, MARGIN, GRID, CELL, MIN_DENSITY, MIN_COVERAGE = 128, 0.1, 10, 0.01, 0.03, 0.25


def measure(pixels: np.ndarray) -> tuple[float, float]:
    """The dark share of the page's middle, and the share of its grid cells with some dark."""
    h, w = pixels.shape
    middle = pixels[int(h * MARGIN) : h - int(h * MARGIN), int(w * MARGIN) : w - int(w * MARGIN)] < DARK
    if not middle.size:
        return 0.0, 0.0
    rows, columns = (np.array_split(np.arange(n), GRID) for n in middle.shape)
    cells = [middle[np.ix_(r, c)] for r in rows for c in columns if len(r) and len(c)]
    return float(middle.mean()), float(np.mean([x.mean() >= CELL for x in cells]))


def classify(pages: DataFrame) -> DataFrame:
    """(page_num, height, width, pixels) with dark_density, grid_coverage and has_text; broken images count as text."""

    @F.pandas_udf("dark_density double, grid_coverage double")
    def look(height: pd.Series, width: pd.Series, pixels: pd.Series) -> pd.DataFrame:
        out = []
        for h, w, p in zip(height, width, pixels, strict=True):
            try:
                out.append(measure(np.frombuffer(p, np.uint8).reshape(int(h), int(w))))
            except (TypeError, ValueError):
                out.append((None, None))
        return pd.DataFrame(out, columns=["dark_density", "grid_coverage"])

    seen = pages.withColumn("__m", look("height", "width", "pixels"))
    has = (F.col("__m.dark_density") >= MIN_DENSITY) & (F.col("__m.grid_coverage") >= MIN_COVERAGE)
    return seen.withColumns({"dark_density": F.col("__m.dark_density"), "grid_coverage": F.col("__m.grid_coverage"), "has_text": F.coalesce(has, F.lit(True))}).drop("__m")
