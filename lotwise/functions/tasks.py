"""The three learning tasks as column expressions, with block forms for use inside tasks.

Every formula is written in terms of the score ``z = x . w`` (or ``x . coef``), the label ``y``,
the dual value ``alpha`` and ``sq = |x|^2``; none needs the feature vector itself.  The block
forms take NumPy arrays of the same quantities and serve the training kernels.
"""

import math

import numpy as np
from pyspark.sql import functions as F

# Fixed value: half-width of the margin that keeps a dual value inside (0, 1).
DEFAULT_BOX = 1e-4


def project_box(alpha, y, box=DEFAULT_BOX):
    return y * F.greatest(F.lit(box), F.least(F.lit(1.0 - box), y * alpha))


class Task:
    """One learning task.  ``box`` only matters to the two classifiers."""

    name = ""
    classifier = True

    def __init__(self, box=DEFAULT_BOX):
        self.box = box

    def primal_loss(self, z, y):
        raise NotImplementedError

    def dual_loss(self, alpha, y):
        raise NotImplementedError

    def delta_alpha(self, z, y, alpha, sq, lam_n, sigma_p):
        raise NotImplementedError

    def gradient_factor(self, z, y):
        """The gradient of a row's loss is this factor times the row's features."""
        raise NotImplementedError

    def block_loss(self, z, y):
        raise NotImplementedError

    def block_delta(self, z, y, alpha, sq, lam_n, sigma_p):
        raise NotImplementedError

    def block_factor(self, z, y):
        raise NotImplementedError

    def step(self, z, y, alpha, sq, lam_n, sigma_p):
        """``block_delta`` of one row, in plain numbers."""
        raise NotImplementedError

    def _box(self, value):
        return min(max(value, self.box), 1.0 - self.box)

    def _boxed(self, alpha, y):
        return np.clip(y * alpha, self.box, 1.0 - self.box)


class Ridge(Task):
    name = "ridge"
    classifier = False

    def primal_loss(self, z, y):
        return F.pow(z - y, F.lit(2.0)) / 2.0

    def dual_loss(self, alpha, y):
        return alpha * alpha / 2.0 - alpha * y

    def delta_alpha(self, z, y, alpha, sq, lam_n, sigma_p):
        residual = y - z / lam_n - alpha
        return residual / (F.lit(1.0) + sq * (sigma_p / lam_n))

    def gradient_factor(self, z, y):
        return z - y

    def block_loss(self, z, y):
        return 0.5 * (z - y) ** 2

    def block_delta(self, z, y, alpha, sq, lam_n, sigma_p):
        return (y - z / lam_n - alpha) / (1.0 + sq * (sigma_p / lam_n))

    def block_factor(self, z, y):
        return z - y

    def step(self, z, y, alpha, sq, lam_n, sigma_p):
        return (y - z / lam_n - alpha) / (1.0 + sq * (sigma_p / lam_n))


class Logistic(Task):
    name = "logistic"

    def primal_loss(self, z, y):
        margin = y * z
        return F.greatest(F.lit(0.0), -margin) + F.log1p(F.exp(-F.abs(margin)))

    def dual_loss(self, alpha, y):
        a = F.greatest(F.lit(self.box), F.least(F.lit(1.0 - self.box), y * alpha))
        return (F.lit(1.0) - a) * F.log(F.lit(1.0) - a) + a * F.log(a)

    def delta_alpha(self, z, y, alpha, sq, lam_n, sigma_p):
        old = project_box(alpha, y, self.box)
        a = y * old
        slope = y * (F.log(a) - F.log(F.lit(1.0) - a)) + z / lam_n
        curvature = F.lit(1.0) / (a * (F.lit(1.0) - a)) + sq * (sigma_p / lam_n)
        return project_box(old - slope / curvature, y, self.box) - old

    def gradient_factor(self, z, y):
        target = F.when(y > 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) - target

    def block_loss(self, z, y):
        return np.logaddexp(0.0, -y * z)

    def block_delta(self, z, y, alpha, sq, lam_n, sigma_p):
        a = self._boxed(alpha, y)
        slope = y * np.log(a / (1.0 - a)) + z / lam_n
        curvature = 1.0 / (a * (1.0 - a)) + sq * (sigma_p / lam_n)
        moved = self._boxed(y * a - slope / curvature, y)
        return y * (moved - a)

    def block_factor(self, z, y):
        return np.exp(-np.logaddexp(0.0, -z)) - (y > 0)

    def step(self, z, y, alpha, sq, lam_n, sigma_p):
        a = self._box(y * alpha)
        slope = y * math.log(a / (1.0 - a)) + z / lam_n
        curvature = 1.0 / (a * (1.0 - a)) + sq * (sigma_p / lam_n)
        return y * (self._box(y * (y * a - slope / curvature)) - a)


class Hinge(Task):
    name = "hinge"

    def primal_loss(self, z, y):
        return F.greatest(F.lit(0.0), F.lit(1.0) - y * z)

    def dual_loss(self, alpha, y):
        return -alpha * y

    def delta_alpha(self, z, y, alpha, sq, lam_n, sigma_p):
        old = project_box(alpha, y, self.box)
        # A row without features has no curvature: its dual value goes straight to the far edge.
        step = F.try_divide(y * (lam_n * y - z), sq * sigma_p)
        goal = F.coalesce(F.least(F.lit(1.0), y * old + step), F.lit(1.0))
        return project_box(y * F.greatest(F.lit(0.0), goal), y, self.box) - old

    def gradient_factor(self, z, y):
        return F.when(y * z < 1.0, -y).otherwise(F.lit(0.0))

    def block_loss(self, z, y):
        return np.maximum(0.0, 1.0 - y * z)

    def block_delta(self, z, y, alpha, sq, lam_n, sigma_p):
        a = self._boxed(alpha, y)
        # As in the column form, a row without features goes straight to the far edge.
        curvature = np.maximum(sq * sigma_p, np.finfo(float).tiny)
        with np.errstate(over="ignore"):
            goal = np.minimum(1.0, a + y * (lam_n * y - z) / curvature)
        moved = np.clip(np.maximum(0.0, goal), self.box, 1.0 - self.box)
        return y * (moved - a)

    def block_factor(self, z, y):
        return np.where(y * z < 1.0, -y, 0.0)

    def step(self, z, y, alpha, sq, lam_n, sigma_p):
        a = self._box(y * alpha)
        curvature = sq * sigma_p
        goal = 1.0 if curvature == 0.0 else min(1.0, a + y * (lam_n * y - z) / curvature)
        return y * (self._box(max(0.0, goal)) - a)


TASKS = {task.name: task for task in (Ridge, Logistic, Hinge)}
# The short names of the three applications.
TASK_ALIASES = {"RR": "ridge", "LR": "logistic", "SVM": "hinge"}


def task_of(task, **options):
    """A task by object, by name or by short application name."""
    if isinstance(task, Task):
        return task
    name = TASK_ALIASES.get(task, task)
    if name not in TASKS:
        raise ValueError(f"unknown task {task!r}; known: {sorted(TASKS)}")
    return TASKS[name](**options)
