"""Exact cosine ranking in blocks: the kernels behind vector search and novelty."""

from __future__ import annotations

import numpy as np
import pandas as pd

DIGITS = 6
CELLS_AT_ONCE = 4_000_000


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Rows scaled to length one. A zero vector has no direction: its row is NaN."""
    stacked = np.stack(vectors.to_numpy()).astype(np.float64)
    norms = np.linalg.norm(stacked, axis=1, keepdims=True)
    return np.divide(stacked, norms, out=np.full_like(stacked, np.nan), where=norms > 0)


def best_columns(scores: np.ndarray, k: int):
    """The k highest columns of each row, lowest column first among equals; (rows, cols) pairs."""
    rows = np.arange(len(scores))
    for rank in range(min(k, scores.shape[1])):
        cols = np.argmax(scores, axis=1)
        found = scores[rows, cols] > -np.inf
        yield rank, rows[found], cols[found], scores[rows, cols][found]
        scores[rows, cols] = -np.inf


def top_k(
    left: pd.DataFrame,
    right: pd.DataFrame,
    left_id: str,
    right_id: str,
    k: int,
    left_scope: str | None = None,
    right_scope: str | None = None,
) -> pd.DataFrame:
    """Best k of ``right`` per row of ``left``, by (rounded cosine desc, id).

    With scope columns only pairs of equal scope count.
    """
    right = right.sort_values(right_id, kind="stable").reset_index(drop=True)
    b = unit_rows(right["embedding"])
    a = unit_rows(left["embedding"])
    left_ids, right_ids = left[left_id].to_numpy(), right[right_id].to_numpy()
    parts = []
    step = max(1, CELLS_AT_ONCE // max(1, len(right)))
    for start in range(0, len(left), step):
        scores = np.round(a[start : start + step] @ b.T, DIGITS)
        scores[np.isnan(scores)] = -np.inf
        if left_scope is not None:
            same = (
                left[left_scope].to_numpy()[start : start + step, None]
                == right[right_scope].to_numpy()[None, :]
            )
            scores[~same] = -np.inf
        for _, rows, cols, values in best_columns(scores, k):
            parts.append(
                pd.DataFrame(
                    {
                        left_id: left_ids[start + rows],
                        right_id: right_ids[cols],
                        "similarity": values + 0.0,
                    }
                )
            )
    if not parts:
        return pd.DataFrame({left_id: [], right_id: [], "similarity": []})
    return pd.concat(parts, ignore_index=True)
