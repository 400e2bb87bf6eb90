"""Measures of decoded pictures, given as arrays of grey values in rows: perceptual hash and quality (N4, N13, J10's input).

Decoding is left to the reader that fills the array (``mapInPandas`` over files); these run in Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _cosine_basis(n: int) -> np.ndarray:
    k = np.arange(n)
    return np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / (2 * n))


def phash_of(grey: np.ndarray) -> int:
    """64-bit hash of a 32 by 32 picture: which of its 8 by 8 slowest cosine waves are over their median, as a signed number."""
    basis = _cosine_basis(32)
    low = (basis @ grey.reshape(32, 32) @ basis.T)[:8, :8]
    return int(np.packbits(low.ravel() > np.median(low)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def phash(grey: pd.Series) -> pd.Series:
    """``phash_of`` an array of 1,024 grey values; others, and arrays with NULLs, have no hash."""
    one = lambda g: phash_of(x) if g is not None and len(g) == 1024 and np.isfinite(x := np.asarray(g, float)).all() else None
    return pd.Series([one(g) for g in grey], dtype="Int64")


@F.pandas_udf(T.StructType([T.StructField(c, T.DoubleType()) for c in ("focus", "brightness", "extreme", "quality")]))
def face_quality(grey: pd.Series, width: pd.Series, least_focus: pd.Series) -> pd.DataFrame:
    """Sharpness (variance of the Laplacian, edges mirrored), mean, share of crushed or blown values, and a quality of 0 to 1 from both;
    NULL where the array is not rows of ``width``."""
    out = []
    for g, w, least in zip(grey, width, least_focus):
        if g is None or not w or len(g) == 0 or len(g) % int(w):
            out.append((None, None, None, None))
            continue
        x = np.asarray(g, float).reshape(-1, int(w))
        p = np.pad(x, 1, mode="reflect" if min(x.shape) > 1 else "edge")
        focus = float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * x).var())
        extreme = float(((x <= 8) | (x >= 247)).mean())
        quality = focus / (focus + max(float(least or 1), 1.0)) * max(0.0, 1.0 - extreme)
        out.append((focus, float(x.mean()), extreme, min(1.0, max(0.0, quality))))
    return pd.DataFrame(out, columns=["focus", "brightness", "extreme", "quality"])
