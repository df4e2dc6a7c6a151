"""What one task does with its rows: score a block, step, clip, and sum.

Each function builds an Arrow map for ``mapInArrow``.  A task reads blocks of rows and emits one
partial sum per run and feature, so what is shuffled is tasks x runs x features, never rows.
"""

import numpy as np
import pyarrow as pa

SUM_SCHEMA = "run int, idx int, value double"


class DenseBlock:
    """Rows of one Arrow batch with a dense feature matrix."""

    def __init__(self, batch, width):
        lists = batch.column("features")
        if batch.num_rows and (np.asarray(lists.value_lengths()) != width).any():
            raise ValueError(f"every row needs a vector of {width} features")
        self.x = np.asarray(lists.flatten()).reshape(batch.num_rows, width)

    def scores(self, models):
        return self.x @ models.T

    def row_scores(self, rows, models):
        return self.x[rows] @ models.T

    def weighted_sum(self, weights):
        return weights.T @ self.x

    def sq_norms(self):
        return np.einsum("ij,ij->i", self.x, self.x)

    def cells_of_row(self):
        """Numbers that a row of ``matrix_of`` may take."""
        return max(1, self.x.shape[1])

    def matrix_of(self, rows):
        """The columns that some of the rows use, and the rows as a matrix over these columns."""
        return slice(None), self.x[rows]


class SparseBlock:
    """Rows of one Arrow batch with index/value lists."""

    def __init__(self, batch, width):
        lists = batch.column("indices")
        self.n, self.width = batch.num_rows, width
        self.index = np.asarray(lists.flatten())
        self.value = np.asarray(batch.column("values").flatten())
        lengths = np.asarray(lists.value_lengths())
        if len(self.index) and self.index.max() >= width:
            raise ValueError(f"feature index {self.index.max()} is beyond the width {width}")
        self.row = np.repeat(np.arange(self.n), lengths)
        self.starts = np.concatenate(([0], np.cumsum(lengths)))

    def scores(self, models):
        return np.stack(
            [np.bincount(self.row, self.value * w[self.index], self.n) for w in models], axis=1
        )

    def row_scores(self, rows, models):
        return self.scores(models)[rows]

    def weighted_sum(self, weights):
        return np.stack([
            np.bincount(self.index, self.value * d[self.row], self.width) for d in weights.T
        ])

    def sq_norms(self):
        return np.bincount(self.row, self.value**2, self.n)

    def cells_of_row(self):
        """A block of b rows uses b times a row's entries at most, so its matrix has b of these cells a row."""
        longest = max(1, int(np.diff(self.starts).max(initial=0)))
        return longest * 64

    def matrix_of(self, rows):
        low, size = self.starts[rows], np.diff(self.starts)[rows]
        at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        columns, place = np.unique(self.index[at], return_inverse=True)
        matrix = np.zeros((len(rows), len(columns)))
        np.add.at(matrix, (np.repeat(np.arange(len(rows)), size), place), self.value[at])
        return columns, matrix


def block_of(batch, width):
    kind = DenseBlock if "features" in batch.schema.names else SparseBlock
    return kind(batch, width)


def _matrix(batch, name, columns):
    return np.asarray(batch.column(name).flatten()).reshape(batch.num_rows, columns)


def _sums_batch(total):
    runs, width = total.shape
    run, idx = np.nonzero(total)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(run.astype(np.int32)),
            pa.array(idx.astype(np.int32)),
            pa.array(total[run, idx]),
        ],
        ["run", "idx", "value"],
    )


def clipped(delta, bound):
    return delta / np.maximum(1.0, np.abs(delta) / bound)


class DualStep:
    """Constants of a dual update for a group of runs that share their lots."""

    def __init__(self, task, lam_n, sigma_p, clip, gamma, noise):
        self.task = task
        self.lam_n = np.asarray(lam_n, dtype=float)
        self.sigma_p = np.asarray(sigma_p, dtype=float)
        self.clip = np.asarray(clip, dtype=float)
        self.gamma = np.asarray(gamma, dtype=float)
        self.noise = np.asarray(noise, dtype=float)

    def deltas(self, z, y, alpha, sq):
        """Clipped steps, rows x runs, from scores of the same shape."""
        raw = self.task.block_delta(
            z, y[:, None], alpha, sq[:, None], self.lam_n[None, :], self.sigma_p[None, :]
        )
        return clipped(raw, self.clip[None, :])


def _fold(step, block, batch, y, sq, history, before):
    """Dual values of a batch after the lots of ``lots`` that come before lot ``before``.

    ``history`` maps a lot to the models in force when it was processed, the runs that were still
    active, and its step sizes.  The lots of a row are taken in order; rows that share a lot at the same place in
    their lists move together.  A row that is twice in one lot takes its step twice, from one score.
    """
    runs = len(step.gamma)
    alpha = _matrix(batch, "alpha", runs).copy()
    lists = batch.column("lots")
    lengths = np.asarray(lists.value_lengths())
    if not lengths.any():
        return alpha
    flat = np.asarray(lists.flatten())
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    noisy = "noise" in batch.schema.names
    noise = np.asarray(batch.column("noise").flatten()).reshape(-1, runs) if noisy else None
    for place in range(int(lengths.max())):
        rows = np.flatnonzero(lengths > place)
        lots = flat[starts[rows] + place]
        for lot in np.unique(lots):
            if before is not None and lot >= before:
                continue
            chosen = rows[lots == lot]
            at = starts[chosen] + place
            if place:
                fresh = flat[at - 1] != lot
                chosen, at = chosen[fresh], at[fresh]
            models, active, gamma = history[int(lot)]
            z = block.row_scores(chosen, models)
            move = step.deltas(z, y[chosen], alpha[chosen], sq[chosen])
            again = (lengths[chosen] > place + 1) & (flat[np.minimum(at + 1, len(flat) - 1)] == lot)
            move = move * np.where(again, 2.0, 1.0)[:, None]
            if noisy:
                move = move + noise[at] * step.noise[None, :]
            alpha[chosen] += (gamma * active)[None, :] * move
    return alpha


#: what a line search needs besides the sum of vectors: steps times (y - alpha), squared steps
SEARCH_SUMS = 2


def dual_lot(step, models, history, lot, width, search=False):
    """Sum of clipped step times features over the rows of one lot; with ``search`` SEARCH_SUMS more."""

    def run(batches):
        total = np.zeros((len(models), width + SEARCH_SUMS * search))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = block_of(batch, width)
            y = np.asarray(batch.column("y"))
            sq = block.sq_norms()
            alpha = _fold(step, block, batch, y, sq, history, lot)
            deltas = step.deltas(block.scores(models), y, alpha, sq)
            total[:, :width] += block.weighted_sum(deltas)
            if search:
                total[:, width] += (deltas * (y[:, None] - alpha)).sum(axis=0)
                total[:, width + 1] += (deltas * deltas).sum(axis=0)
        yield _sums_batch(total)

    return run


def dual_commit(step, history, width, keep):
    """The same rows with their dual values after all lots in ``lots``."""

    def run(batches):
        for batch in batches:
            block = block_of(batch, width)
            y = np.asarray(batch.column("y"))
            alpha = _fold(step, block, batch, y, block.sq_norms(), history, None)
            offsets = np.arange(0, alpha.size + 1, alpha.shape[1], dtype=np.int32)
            column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(alpha.ravel()))
            arrays = [column if c == "alpha" else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(arrays, keep)

    return run


def gradient_lot(task, models, clip, width):
    """Sum of clipped loss gradients over the rows of one lot."""
    bound = np.asarray(clip, dtype=float)

    def run(batches):
        total = np.zeros(models.shape)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block = block_of(batch, width)
            y = np.asarray(batch.column("y"))[:, None]
            factor = task.block_factor(block.scores(models), y)
            length = np.abs(factor) * np.sqrt(block.sq_norms())[:, None]
            total += block.weighted_sum(factor / np.maximum(1.0, length / bound[None, :]))
        yield _sums_batch(total)

    return run


EVAL_SCHEMA = (
    "side int, run int, n bigint, loss double, sq_error double, tp bigint, fp bigint, fn bigint, tn bigint"
)


def evaluate_rows(task, models, width, sides=1):
    """Loss, squared error and confusion counts of every run over a task's rows, by their ``side``."""

    def run(batches):
        runs = len(models)
        n, loss, error = np.zeros(sides, dtype=np.int64), np.zeros((sides, runs)), np.zeros((sides, runs))
        cells = np.zeros((4, sides, runs), dtype=np.int64)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            z = block_of(batch, width).scores(models)
            y = np.asarray(batch.column("y"))[:, None]
            of = np.asarray(batch.column("side"))
            losses, errors = task.block_loss(z, y), (z - y) ** 2
            up, real = z > 0, y > 0
            for side in np.unique(of):
                mine = of == side
                n[side] += mine.sum()
                loss[side] += losses[mine].sum(axis=0)
                error[side] += errors[mine].sum(axis=0)
                for i, hit in enumerate((up & real, up & ~real, ~up & real, ~up & ~real)):
                    cells[i, side] += hit[mine].sum(axis=0)
        names = ["side", "run", "n", "loss", "sq_error", "tp", "fp", "fn", "tn"]
        side, number = np.divmod(np.arange(sides * runs, dtype=np.int32), np.int32(runs))
        columns = [side, number, n[side], loss.ravel(), error.ravel(), *(c.ravel() for c in cells)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    return run
