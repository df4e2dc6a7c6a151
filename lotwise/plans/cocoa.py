"""Sequential dual ascent inside parts, parts in parallel (the CoCoA+ scheme).

The rows are written once, as a table bucketed by part; that write is the only time that features are
moved.  A round reads the buckets, each by one task, beside the dual values that the round before left
in a table of the same buckets, one row per part.  A part's visiting order is keyed by round and pass.
What a round writes and sums is one dual value per row and one change of the shared vector per part.

A task holds its part, whose size is bounded; the caller chooses the number of parts.  Rows are taken in
blocks: scores and inner products of a block are two matrix products, and each step then corrects the
scores of the block's later rows, which gives the very steps of going row by row.

A part's view moves by sigma' times its steps and its noise, and the part's change is divided by
sigma' in the end: steps and noise both enter the shared vector at their stated size.
"""

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lotwise.functions.keyed import keyed_hex, keyed_normal, normal_vector
from lotwise.operators.split import assign_partitions, lot_size_of
from lotwise.operators.update import noise_scale
from lotwise.plans import kernels
from lotwise.sources.scratch import scratch_path

#: numbers of 8 bytes that the features of a part may hold: 512 MB
PART_CELLS = 1 << 26
#: the most buckets; more parts than that share them
MOST_BUCKETS = 1 << 16
#: rows of a block, fewer where they are wide
BLOCK_ROWS = 64
BLOCK_CELLS = 1 << 20

def state_schema(key):
    """A row per part; ``key`` is the type of ``row_id``."""
    return f"label int, ids array<{key}>, alpha array<double>, idx array<int>, value array<double>"


def part_sizes(n, k):
    small, large = divmod(n, k)
    return [small + (part < large) for part in range(k)]


class PartTable:
    """Rows with their ``part``, bucketed so that each part is read by one task without an exchange.

    Spark hashes the bucket column, so parts get labels whose hashes are all different.
    """

    def __init__(self, table, k, seed):
        spark = table.df.sparkSession
        self.spark, self.k, self.buckets = spark, k, min(k, MOST_BUCKETS)
        self.names = []
        rows = assign_partitions(table.df, k, seed)
        if k <= MOST_BUCKETS:
            tries = spark.range(0, int(k * (math.log(k) + 20)) + 1).select(F.col("id").cast("int").alias("label"))
            bucket = F.pmod(F.hash("label"), F.lit(self.buckets)).alias("part")
            labels = tries.groupBy(bucket).agg(F.min("label").alias("label"))
            rows = rows.join(F.broadcast(labels), "part", "left")  # k rows
            rows = rows.withColumn("label", F.coalesce("label", -1 - F.col("part")))
        else:
            rows = rows.withColumn("label", F.col("part"))
        self.vectors = table.vector_columns
        self.state_schema = state_schema(table.df.schema["row_id"].dataType.simpleString())
        rows = rows.select("label", "part", "row_id", "y", *self.vectors)
        self.rows, _ = self.written(rows.repartition(self.buckets, "label"), "parts")

    def written(self, frame, name):
        """``frame``, whose tasks hold whole labels, as a bucketed table; and the path of its files."""
        path = scratch_path(self.spark, name)
        self.names.append(f"lotwise_{name}_{uuid.uuid4().hex[:12]}")
        frame.write.format("parquet").bucketBy(self.buckets, "label").option("path", path).saveAsTable(self.names[-1])
        return self.spark.table(self.names[-1]), path

    def forget(self):
        """Takes the tables out of the catalog; their files stay in the scratch folder."""
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")


def round_frame(parts, state, work, order_key, noise_key, number, passes):
    """One round over all parts: a row per part.  Nothing is exchanged: rows and state share buckets."""
    turns = F.sequence(F.lit(0), F.lit(passes - 1))
    digits = lambda t: F.substring(keyed_hex(order_key, "order", number, t, F.col("row_id")), 1, 15)
    rows = parts.rows.withColumn("places", F.transform(turns, lambda t: F.conv(digits(t), 16, 10).cast("bigint")))
    if noise_key:
        drawn = F.transform(turns, lambda t: keyed_normal(noise_key, "a", number, t, F.col("row_id")))
        rows = rows.withColumn("noise", drawn)
    grouped = rows.groupBy("label")
    if state is None:
        return grouped.applyInArrow(lambda mine: work(mine, None), parts.state_schema)
    left = state.select("label", "ids", "alpha").groupBy("label")
    return grouped.cogroup(left).applyInArrow(lambda mine, known: work(mine, known), parts.state_schema)


class LocalSolver:
    """The steps of one part in one round; called with the part's rows and its state."""

    def __init__(self, task, model, lam_n, sigma_p, clip, gamma, lots, passes, scales, key, width):
        self.task, self.model, self.lam_n, self.sigma_p = task, model, lam_n, sigma_p
        self.clip, self.gamma, self.lots, self.passes = clip, gamma, lots, passes
        self.scales, self.key, self.width = scales, key, width

    def __call__(self, rows, state):
        schema = _arrow(rows.schema.field("row_id").type)
        if not rows.num_rows:
            return pa.table([pa.array([], f.type) for f in schema], schema=schema)
        batch = rows.combine_chunks().to_batches()[0]
        part, label = int(batch.column("part")[0].as_py()), batch.column("label")[0]
        ids = batch.column("row_id").to_numpy(zero_copy_only=False)
        order = np.argsort(ids)
        start = np.zeros(len(ids)) if state is None else self._known(ids[order], state)
        block, y = kernels.block_of(batch, self.width), np.asarray(batch.column("y"))
        alpha = np.empty(len(ids))
        alpha[order] = start
        places = np.asarray(batch.column("places").flatten()).reshape(len(ids), self.passes)
        noise = np.asarray(batch.column("noise").flatten()).reshape(len(ids), self.passes) if self.scales else None
        view, done = self.model.copy(), 0
        for turn, updates in enumerate(self._updates(part, len(ids))):
            visit = order[np.argsort(places[order, turn], kind="stable")][:updates]
            drawn = None if noise is None else self.scales[part] * noise[:, turn]
            for chosen, ends in self._blocks(block, visit, part):
                self._steps(block, chosen, y, alpha, view, drawn)
                if ends and self.scales:
                    done += 1
                    draw = normal_vector(self.width, *self.key, part, done)
                    view += self.sigma_p * self.scales[part] * draw
        ended = start + self.gamma * (alpha[order] - start)
        change = (view - self.model) / self.sigma_p
        index = np.flatnonzero(change).astype(np.int32)
        columns = [[label.as_py()], [ids[order]], [ended], [index], [change[index]]]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    def _known(self, ids, state):
        """Dual values of the round before, in the order of the ids."""
        row = state.to_batches()[0] if state.num_rows == 1 else None
        if row is None or not np.array_equal(row.column("ids").flatten().to_numpy(zero_copy_only=False), ids):
            raise ValueError("the state of a part does not belong to its rows")
        return np.asarray(row.column("alpha").flatten())

    def _updates(self, part, size):
        """Steps in each pass: whole lots.  A lot with noise ends with its pass, so no row is in it twice."""
        lot = self.lots[part]
        if self.scales:
            return [size - size % lot] * self.passes
        all_steps = size * self.passes
        all_steps -= all_steps % lot
        return [min(size, max(0, all_steps - turn * size)) for turn in range(self.passes)]

    def _blocks(self, block, visit, part):
        """(rows, whether a lot ends with them) in visiting order."""
        lot = self.lots[part] if self.scales else len(visit)
        rows = max(1, min(BLOCK_ROWS, int(BLOCK_CELLS // block.cells_of_row())))
        for first in range(0, len(visit), max(1, lot)):
            last = min(first + lot, len(visit))
            for low in range(first, last, rows):
                yield visit[low : min(low + rows, last)], low + rows >= last

    def _steps(self, block, chosen, y, alpha, view, noise):
        """Steps of rows one after the other; each moves the scores of those behind it."""
        columns, x = block.matrix_of(chosen)
        z, gram = x @ view[columns], x @ x.T
        step, clip, rate = self.task.step, self.clip, self.sigma_p
        moves = np.zeros(len(chosen))
        ys, olds, lengths = y[chosen].tolist(), alpha[chosen].tolist(), gram.diagonal().tolist()
        for i, (label, old, sq) in enumerate(zip(ys, olds, lengths)):
            move = step(float(z[i]), label, old, sq, self.lam_n, rate)
            if abs(move) > clip:
                move = math.copysign(clip, move)
            moves[i] = move
            z[i + 1 :] += (rate * move) * gram[i, i + 1 :]
        view[columns] += rate * (moves @ x)
        alpha[chosen] += moves if noise is None else moves + noise[chosen]


def _arrow(key):
    return pa.schema([
        ("label", pa.int32()), ("ids", pa.list_(key)), ("alpha", pa.list_(pa.float64())),
        ("idx", pa.list_(pa.int32())), ("value", pa.list_(pa.float64())),
    ])


def check_part_size(table, k):
    """A part is held by one task: more parts are asked for where the table's features need them."""
    cells = table.n * table.width
    if "features" not in table.vector_columns:
        cells = 3 * (table.df.agg(F.sum(F.size("indices"))).first()[0] or 0) // 2
    least = -(-cells // PART_CELLS)
    if k < least:
        raise ValueError(f"{k} parts of this table are too large for a task each: K must be at least {least}")


def train_cocoa(table, task, params, k, rounds, gamma=1.0, sigma_p=None, on_round=None, solver="cocoa"):
    """Outer rounds over k parts; returns the shared vector and the frame ``(row_id, alpha)``.

    Every pass over a part visits each of its rows once, in a new order.  Steps beyond a part's whole
    lots are left out; in a private run lots end with the pass, else they run on over the passes.
    """
    spark = table.df.sparkSession
    check_part_size(table, k)
    sigma_p = float(k if sigma_p is None else sigma_p)
    passes = int(params.max_iter)
    lots, scales = [], []
    for size in part_sizes(table.n, k):
        lot = max(1, min(lot_size_of(params.lot_ratio, max(1, size), passes), size))
        lots.append(lot)
        scales.append(noise_scale("dual_sequential", params.sigma, params.clip, lot))
    scales = scales if params.sigma > 0 else []
    parts = PartTable(table, k, params.seed)
    model = np.zeros(table.width)
    noise_key = params.noise_key(solver, task.name)
    state = path = None
    if on_round:
        on_round(0, model)
    for number in range(rounds):
        work = LocalSolver(
            task, model, params.lambda_ * table.n, sigma_p, params.bounded_clip, gamma, lots, passes, scales,
            (noise_key, "w", number), table.width,
        )
        frame = round_frame(parts, state, work, params.seed, noise_key if scales else None, number, passes)
        state, path = parts.written(frame, "round")
        change = F.explode(F.arrays_zip("idx", "value")).alias("e")
        total = state.select(change).groupBy("e.idx").agg(F.sum("e.value").alias("value")).toArrow()
        move = np.zeros(table.width)
        move[total["idx"].to_numpy()] = total["value"].to_numpy()
        model = model + gamma * move
        if on_round:
            on_round(number + 1, model)
    parts.forget()
    if path is None:
        return model, table.df.select("row_id", F.lit(0.0).alias("alpha"))
    pairs = F.explode(F.arrays_zip("ids", "alpha")).alias("e")
    alpha = spark.read.schema(parts.state_schema).parquet(path).select(pairs)
    return model, alpha.select(F.col("e.ids").alias("row_id"), F.col("e.alpha").alias("alpha"))
