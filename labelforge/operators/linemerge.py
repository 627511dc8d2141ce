"""Lines of several readings of one image as one set of lines.

The choice depends on the order of the candidates, so each image is one group of a grouped Arrow map: images are dealt by
their key, and a group is the lines of one image (some hundreds).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BOX = ["x0", "y0", "x1", "y1"]


def shares(box: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Shared area of one box with each of the others, over the smaller of the two."""
    side = np.clip(np.minimum(box[2:], boxes[:, 2:]) - np.maximum(box[:2], boxes[:, :2]), 0, None)
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    return side.prod(axis=1) / np.maximum(np.minimum(area(box), area(boxes)), 1e-9)


def merged(lines: DataFrame, by: Sequence[str] = ("image_id",), least: float = 0.55, overlap: float = 0.3) -> DataFrame:
    """lines: by, pass_no, lead (the best reading's lines), ord, text, confidence and box. All lines of the leading reading
    stay, unless a surer line of another reading covers them by more than `overlap` of the smaller box. Such lines come in
    by reading and order if they are sure enough, no line that they cover is as sure, and none taken before them is
    covered. Lines without text, confidence or a place don't come in; nulls in the leading reading stay and meet nothing.
    Adds `added` and `position`: the leading lines in their order, then the added ones by y0 and x0."""
    schema = lines.schema
    names = [f.name for f in schema]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pass_no", "ord"], kind="stable").reset_index(drop=True)
        box = pdf[BOX].to_numpy(float)
        sure = pdf["confidence"].to_numpy(float)
        lead = pdf["lead"].fillna(False).to_numpy(bool)
        ready = (pdf["text"].fillna("").str.strip() != "") & (sure >= least) & ~np.isnan(box).any(axis=1)
        state = lead.astype(np.int8)  # 1: leads, 2: added, 0: not among the lines
        for i in np.flatnonzero(~lead & ready.to_numpy()):
            meets = (shares(box[i], box) > overlap) & (state > 0)
            if not (meets & ((state == 2) | (sure >= sure[i]))).any():
                state[meets] = 0
                state[i] = 2
        kept = pdf[state > 0].assign(added=state[state > 0] == 2)
        kept = pd.concat([kept[~kept["added"]], kept[kept["added"]].sort_values(["y0", "x0"], kind="stable")])
        return kept.assign(position=np.arange(len(kept), dtype=np.int64))[[*names, "added", "position"]]

    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), "added boolean", "position long"])
    return lines.groupBy(*by).applyInPandas(one, out)
