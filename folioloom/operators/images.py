"""Images of documents: stamps are square or red and are left out."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType

from folioloom.functions import png


def is_square(width: Column, height: Column, tolerance: float = 0.03) -> Column:
    return F.coalesce((width > 0) & (height > 0) & (F.abs(width / F.nullif(height, F.lit(0)) - 1) <= tolerance), F.lit(False))


def red_share(pixels) -> float:
    """Share of red among pixels (height, width, 3) taken at a stride of a hundredth of the shorter side."""
    import numpy as np

    h, w = pixels.shape[:2]
    step = max(1, min(w, h) // 100)
    r, g, b = (pixels[::step, ::step, k].astype(np.int64) for k in range(3))
    total = (w // step) * (h // step)
    return float(((r > 100) & (r > 1.2 * g) & (r > 1.2 * b)).sum() / total) if total else 0.0


def _pixels(blob: bytes):
    """(height, width, 3) of an image: PNG by the standard library, others where a decoder is installed."""
    try:
        return png.pixels(blob)
    except Exception:  # noqa: BLE001  interlaced, broken or no PNG image
        import numpy as np
        from PIL import Image

        return np.asarray(Image.open(io.BytesIO(blob)).convert("RGB"))


@pandas_udf(BooleanType())
def is_red(blobs: pd.Series) -> pd.Series:
    """Whether a third or so of an image is red; null where it cannot be decoded."""

    def red(blob):
        try:
            return bool(red_share(_pixels(bytes(blob))) >= 0.3)
        except Exception:  # noqa: BLE001  any broken image, or no decoder
            return None

    return pd.Series([red(b) for b in blobs], dtype=object)


def without_stamps(images: DataFrame) -> DataFrame:
    """images (width, height, blob) that are neither square nor known to be red."""
    return images.where(~is_square(F.col("width"), F.col("height"))).where(~F.coalesce(is_red(F.col("blob")), F.lit(False)))


def diagnosis(images: DataFrame) -> DataFrame:
    """images with what is known of each instead of its blob: n_bytes, ratio of sides, is_square, is_red (null: not decoded) and kept."""
    known = images.withColumn("n_bytes", F.length("blob").cast("long")).withColumn("ratio", F.try_divide(F.col("width"), F.col("height")))
    known = known.withColumn("is_square", is_square(F.col("width"), F.col("height"))).withColumn("is_red", is_red(F.col("blob"))).drop("blob")
    return known.withColumn("kept", ~(F.col("is_square") | F.coalesce("is_red", F.lit(False))))
