"""A linear head with a sigmoid as a model class, for ``models.apply_model``."""

from __future__ import annotations

import numpy as np


class LinearHead:
    """``outputs`` probabilities of rows of ``inputs`` numbers."""

    state_names = ("w", "b")

    def __init__(self, inputs: int, outputs: int = 1) -> None:
        self.shape = (outputs, inputs)

    def load_state(self, state: dict[str, np.ndarray]) -> None:
        if state["w"].shape != self.shape or state["b"].shape != self.shape[:1]:
            raise ValueError(f"weights of shape {state['w'].shape} for {self.shape}")
        self.w, self.b = state["w"].astype(np.float64), state["b"].astype(np.float64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-(x.astype(np.float64) @ self.w.T + self.b)))
