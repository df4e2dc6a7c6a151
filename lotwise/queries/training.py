"""Training jobs; where a run has few lots its SQL is the same steps written out."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lotwise.operators import metrics
from lotwise.plans.fit import GridLog, fit, fit_grid, fit_runs
from lotwise.plans.params import RunParams, param_grid
from lotwise.queries.inputs import (
    EMB, LAMBDA, delta_sql, embeddings, factor_sql, loss_sql, model_out, normal_sql, r6, skips_sql,
)
from lotwise.queries.registry import query
from lotwise.sources.scratch import scratch_path

TASKS = ("ridge", "logistic", "hinge")
SEED = "5"


class Unrolled:
    """SQL of a training run: one group of common table expressions per lot.

    ``prefix`` keeps the names of several runs in one statement apart.
    """

    def __init__(self, prefix, ratio, epochs, per_epoch, lam=LAMBDA, mode="exact", key=None, lots=None):
        self.p, self.lam, self.mode, self.key = prefix, lam, mode, key
        self.steps = [(e, s) for e in range(epochs) for s in range(per_epoch)][:lots]
        self.per_epoch = per_epoch
        self.ctes = [
            f"{prefix}nn as (select n, greatest(1, ceil({ratio}e0 * n))::bigint as l "
            "from (select count(*) as n from emb))",
            f"{prefix}w0 as (select distinct i, 0e0 as w from el)",
            f"{prefix}a0 as (select row_id, 0e0 as alpha from emb)",
        ]
        for e in range(epochs):
            self.ctes.append(
                f"{prefix}r{e} as (select row_id, row_number() over (order by md5('{SEED}|{e}|' || row_id), "
                "row_id) as rn from emb)"
            )

        if mode == "poisson":
            self.ctes += [
                f"{prefix}pz as (select n, l, ceil(n / l::double)::bigint as k, least(1e0, l::double / n) as q from {prefix}nn)",
                f"{prefix}bl as (select row_id, b from emb, {prefix}pz, range(0, {epochs + 1}) r(b))",
                skips_sql(SEED, prefix),
            ]
        self.stream = " union all ".join(
            f"select row_id, {e} * n + rn - 1 as pos from {prefix}r{e}, {prefix}nn" for e in range(epochs)
        )

    def members(self, t):
        """Row ids of lot t, and how often each is in it, as a SQL query."""
        epoch, place = self.steps[t]
        if self.mode == "poisson":
            return f"select row_id, 1 as times from {self.p}ch, {self.p}pz where t < k and b * k + t = {t}"
        if self.mode == "spanning":
            return f"select row_id, count(*) as times from ({self.stream}), {self.p}nn where pos // l = {t} group by row_id"
        return f"select row_id, 1 as times from {self.p}r{epoch}, {self.p}nn where (rn - 1) // l = {place}"

    def scored(self, t):
        p = self.p
        self.ctes.append(f"""{p}s{t} as (
select el.row_id, any_value(y) as y, any_value(alpha) as alpha, sum(v * w) as z, sum(v * v) as sq,
       any_value(times) as times
from el join {p}a{t} using (row_id) join {p}w{t} using (i) join ({self.members(t)}) using (row_id)
group by el.row_id)""")

    def noise(self, t, kind, index, sigma):
        if not sigma:
            return "0e0"
        return f"{sigma}e0 * {normal_sql(f'{chr(39)}{self.key}|{kind}|' + index)}"

    def after(self, other):
        """Begin with the models and dual values that another run ends with."""
        self.ctes += [
            f"{self.p}w0 as (select i, w from {other.p}w{other.last})", f"{self.p}a0 as (select row_id, alpha from {other.p}a{other.last})",
        ]
        own = (f"{self.p}w0 as (select distinct", f"{self.p}a0 as (select row_id, 0e0")
        self.ctes = [c for c in self.ctes if not c.startswith(own)]
        return self

    def dual(self, task, clip=None, noise=None, search=False):
        p = self.p
        scale = 0 if noise is None else noise
        size = lambda t: f"(select gamma from {p}e{t}) * " if search else ""
        for t in range(len(self.steps)):
            self.scored(t)
            raw = delta_sql(task, lam_n=f"({self.lam}e0 * n)", sigma_p="l::double")
            step = raw if clip is None else f"({raw} / greatest(1e0, abs({raw}) / {clip}e0))"
            w_noise = self.noise(t, "w", f"{t}|' || i", scale)
            a_noise = self.noise(t, "a", f"{t}|' || row_id", scale)
            self.ctes += [
                f"{p}d{t} as (select row_id, times * {step} as d from {p}s{t}, {p}nn)",
                f"{p}g{t} as (select i, sum(v * d) as g from el join {p}d{t} using (row_id) group by i)",
                *([f"""{p}e{t} as (
select (gain - wd / ({self.lam}e0 * n)) / (dd + dw / ({self.lam}e0 * n)) as gamma from {p}nn,
       (select sum(d * (y - alpha)) as gain, sum(d * d) as dd from {p}d{t} join {p}s{t} using (row_id)),
       (select sum(w * g) as wd, sum(g * g) as dw from {p}w{t} join {p}g{t} using (i)))"""] if search else []),
                f"{p}w{t + 1} as (select i, w + {size(t)}coalesce(g, 0e0) + {w_noise} as w "
                f"from {p}w{t} left join {p}g{t} using (i))",
                f"{p}a{t + 1} as (select row_id, alpha + case when d is null then 0e0 "
                f"else {size(t)}d + {a_noise} end as alpha from {p}a{t} left join {p}d{t} using (row_id))",
            ]
        return self

    def sgd(self, task, clip, eta, noise=0):
        p = self.p
        for t in range(len(self.steps)):
            self.scored(t)
            factor = factor_sql(task)
            w_noise = self.noise(t, "w", f"{t}|' || i", noise)
            self.ctes += [
                f"{p}f{t} as (select row_id, times * {factor} / greatest(1e0, abs({factor}) * sqrt(sq) / {clip}e0) "
                f"as f from {p}s{t})",
                f"{p}g{t} as (select i, sum(v * f) as g from el join {p}f{t} using (row_id) group by i)",
                f"{p}w{t + 1} as (select i, w - {eta}e0 * (coalesce(g, 0e0) + {self.lam}e0 * w + {w_noise}) "
                f"/ l as w from {p}w{t} left join {p}g{t} using (i), {p}nn)",
                f"{p}a{t + 1} as (select * from {p}a{t})",
            ]
        return self

    @property
    def text(self):
        return ",\n".join(self.ctes)

    @property
    def last(self):
        return len(self.steps)


def dual_coef_sql(run):
    return (
        f"select i::int as idx, round(w / ({run.lam}e0 * n), 6) + 0e0 as value "
        f"from {run.p}w{run.last}, {run.p}nn"
    )


def coef_out(result, run_id=0):
    frame = result.coef_frame().where(F.col("run_id") == run_id)
    return model_out(frame)


def params(**changes):
    return RunParams(**{"lambda_": LAMBDA, "lot_ratio": 0.5, "max_iter": 2, "seed": SEED, **changes})


def _register_dual():
    for task in TASKS:
        run = Unrolled("", 0.5, 2, 2).dual(task)

        @query(f"fit_dual_parallel_{task}", f"with recursive {EMB},\n{run.text}\n{dual_coef_sql(run)}")
        def dual(spark, sf, task=task):
            return coef_out(fit(embeddings(spark, sf), task, "PSCD", params(), fit_intercept=False))

        sgd = Unrolled("", 0.5, 1, 2).sgd(task, 0.5, 0.8)
        sql = f"select i::int as idx, round(w, 6) + 0e0 as value from w{sgd.last}"

        @query(f"fit_sgd_{task}", f"with recursive {EMB},\n{sgd.text}\n{sql}")
        def sgd_fit(spark, sf, task=task):
            run = params(max_iter=1, clip=0.5, gamma=0.8)
            return coef_out(fit(embeddings(spark, sf), task, "SGD", run, fit_intercept=False))


_register_dual()

ALPHA_RUN = Unrolled("", 0.5, 2, 2).dual("ridge", clip=0.3)


@query("fit_dual_parallel_alpha", f"""with recursive {EMB},
{ALPHA_RUN.text}
select row_id, round(alpha, 6) + 0e0 as alpha from a{ALPHA_RUN.last}""")
def fit_dual_parallel_alpha(spark, sf):
    result = fit(embeddings(spark, sf), "ridge", "PSCD", params(clip=0.3), fit_intercept=False)
    return result.alpha[0].select("row_id", r6("alpha", "alpha"))


PRIVATE = params(max_iter=1, clip=0.5, sigma=2.0)
PRIVATE_RUN = Unrolled("", 0.5, 1, 2, key=PRIVATE.noise_key("dual_parallel", "logistic")).dual(
    "logistic", clip=0.5, noise=2.0 * (2 * 0.25) ** 0.5
)


@query("fit_dual_parallel_private", f"with recursive {EMB},\n{PRIVATE_RUN.text}\n{dual_coef_sql(PRIVATE_RUN)}")
def fit_dual_parallel_private(spark, sf):
    rows = embeddings(spark, sf)
    return coef_out(fit(rows, "logistic", "PSCD", PRIVATE, fit_intercept=False, mode="exact"))


PRIVATE_ALPHA = Unrolled(
    "", 0.5, 1, 2, mode="poisson", key=PRIVATE.noise_key("dual_parallel", "ridge")
).dual("ridge", clip=0.5, noise=2.0 * (2 * 0.25) ** 0.5)


@query("fit_dual_parallel_poisson", f"""with recursive {EMB},
{PRIVATE_ALPHA.text}
select row_id, round(alpha, 6) + 0e0 as alpha from a{PRIVATE_ALPHA.last}""")
def fit_dual_parallel_poisson(spark, sf):
    """Independent sampling: a row may be in both lots of an epoch."""
    result = fit(embeddings(spark, sf), "ridge", "PSCD", PRIVATE, fit_intercept=False)
    return result.alpha[0].select("row_id", r6("alpha", "alpha"))


PRIVATE_STEP = params(max_iter=1, clip=0.5, gamma=0.8, sigma=2.0)
SGD_PRIVATE = Unrolled("", 0.5, 1, 2, mode="poisson", key=PRIVATE_STEP.noise_key("sgd", "logistic")).sgd(
    "logistic", 0.5, 0.8, noise=2.0 * 0.5
)


@query("fit_sgd_private", f"""with recursive {EMB},
{SGD_PRIVATE.text}
select i::int as idx, round(w, 6) + 0e0 as value from w{SGD_PRIVATE.last}""")
def fit_sgd_private(spark, sf):
    return coef_out(fit(embeddings(spark, sf), "logistic", "SGD", PRIVATE_STEP, fit_intercept=False))


SPANNING = Unrolled("", 0.4, 3, 3, mode="spanning", lots=7).dual("ridge")


@query("fit_dual_parallel_spanning", f"with recursive {EMB},\n{SPANNING.text}\n{dual_coef_sql(SPANNING)}")
def fit_dual_parallel_spanning(spark, sf):
    """Seven lots over three epochs: the third holds rows of two of them."""
    run = params(lot_ratio=0.4, max_iter=3)
    return coef_out(fit(embeddings(spark, sf), "ridge", "PSCD", run, fit_intercept=False))


SPANNING_SGD = Unrolled("", 0.4, 3, 3, mode="spanning", lots=7).sgd("logistic", 0.5, 0.8)


@query("fit_sgd_spanning", f"""with recursive {EMB},
{SPANNING_SGD.text}
select i::int as idx, round(w, 6) + 0e0 as value from w{SPANNING_SGD.last}""")
def fit_sgd_spanning(spark, sf):
    run = params(lot_ratio=0.4, max_iter=3, clip=0.5, gamma=0.8)
    return coef_out(fit(embeddings(spark, sf), "logistic", "SGD", run, fit_intercept=False))


SEARCHED = Unrolled("", 0.5, 1, 2).dual("ridge", search=True)


@query("fit_dual_parallel_search", f"with recursive {EMB},\n{SEARCHED.text}\n{dual_coef_sql(SEARCHED)}")
def fit_dual_parallel_search(spark, sf):
    """Two lots, each with the step size that its own sums find best."""
    return coef_out(fit(embeddings(spark, sf), "ridge", "PSCD", params(max_iter=1, gamma=-1), fit_intercept=False))


@query("fit_dual_parallel_search_alpha", f"""with recursive {EMB},
{SEARCHED.text}
select row_id, round(alpha, 6) + 0e0 as alpha from a{SEARCHED.last}""")
def fit_dual_parallel_search_alpha(spark, sf):
    result = fit(embeddings(spark, sf), "ridge", "PSCD", params(max_iter=1, gamma=-1), fit_intercept=False)
    return result.alpha[0].select("row_id", r6("alpha", "alpha"))


WARM_FIRST = Unrolled("f_", 0.5, 1, 2).dual("logistic")
WARM = Unrolled("", 0.5, 1, 2).after(WARM_FIRST).dual("logistic")


@query("fit_warm_start", f"with recursive {EMB},\n{WARM_FIRST.text},\n{WARM.text}\n{dual_coef_sql(WARM)}")
def fit_warm_start(spark, sf):
    """An epoch, and another one from its models and dual values."""
    rows, run = embeddings(spark, sf), params(max_iter=1)
    first = fit(rows, "logistic", "PSCD", run, fit_intercept=False)
    return coef_out(fit(rows, "logistic", "PSCD", run, fit_intercept=False, start=first))


GRID_LAMBDAS = (0.1, 0.01)
GRID_RATIOS = (0.5, 0.34)
GRID_RUNS = [
    Unrolled(f"g{i}_", ratio, 1, 2, lam=lam).dual("ridge")
    for i, (lam, ratio) in enumerate((a, b) for a in GRID_LAMBDAS for b in GRID_RATIOS)
]
GRID_CTES = ",\n".join(run.text for run in GRID_RUNS)


@query("fit_grid", f"with recursive {EMB},\n{GRID_CTES}\n" + "\nunion all\n".join(
    f"select {i}::bigint as run_id, i::int as idx, round(w / ({run.lam}e0 * n), 6) + 0e0 as value "
    f"from {run.p}w{run.last}, {run.p}nn" for i, run in enumerate(GRID_RUNS)
))
def fit_grid_runs(spark, sf):
    """Four runs in two shared passes: runs with the same lots are trained together."""
    runs = param_grid(
        spark, **{"lambda": GRID_LAMBDAS, "lot_ratio": GRID_RATIOS, "max_iter": [1], "seed": [5]}
    )
    out = fit_grid(embeddings(spark, sf), runs, "ridge", "PSCD", fit_intercept=False).coef_frame()
    return out.select("run_id", F.col("idx").cast("int").alias("idx"), r6("value", "value"))


def resumed_sql():
    """One line per run of the grid, and one for the run that is refused."""
    lines = []
    for i, run in enumerate(GRID_RUNS):
        scores = f"""select el.row_id, any_value(y) as y, sum(v * w / ({run.lam}e0 * n)) as z
      from el join {run.p}w{run.last} using (i), {run.p}nn group by el.row_id"""
        lines.append(f"""select {i}::bigint as run_id, 'complete' as status, 1::int as epochs, {"true" if i < 2 else "false"} as earlier,
       round(avg({loss_sql("ridge")}) + {run.lam}e0 / 2 * any_value(sq), 6) + 0e0 as cost, round(any_value(sq), 6) + 0e0 as sq_norm
from ({scores}), (select sum(power(w / ({run.lam}e0 * n), 2)) as sq from {run.p}w{run.last}, {run.p}nn)""")
    lines.append("select 4::bigint, 'stopped', 0::int, false, null::double, null::double")
    return f"with recursive {EMB},\n{GRID_CTES}\n" + "\nunion all\n".join(lines)


@query("fit_grid_resume", resumed_sql())
def fit_grid_resume(spark, sf):
    """Two of five runs, then the whole grid from the log: two more, and one that cannot be trained."""
    rows, log = embeddings(spark, sf), scratch_path(spark, "grid-log")
    runs = param_grid(spark, **{"lambda": GRID_LAMBDAS, "lot_ratio": GRID_RATIOS, "max_iter": [1], "seed": [5]})
    refused = param_grid(spark, sigma=[1.0], seed=[6]).withColumn("run_id", F.lit(4).cast("bigint"))
    options = dict(task="ridge", solver="PSCD", fit_intercept=False, log=log)
    fit_grid(rows, runs.where("run_id < 2"), **options)
    first = F.min("attempt").over(Window.partitionBy())
    result = fit_grid(rows, runs.unionByName(refused), **options)
    book = GridLog(spark, log).trace().withColumn("earlier", F.col("attempt") == first)
    norms = result.coef_frame().groupBy("run_id").agg(F.sum(F.col("value") * F.col("value")).alias("sq"))
    closing = book.where("status <> 'running'").join(norms, "run_id", "left")
    return closing.select("run_id", "status", F.col("epoch").alias("epochs"), "earlier", r6("cost", "cost"), r6("sq", "sq_norm"))


FINAL_SCORES = ",\n".join(
    f"q{i} as (select el.row_id, any_value(y) as y, sum(v * w) / ({run.lam}e0 * any_value(n)) as z "
    f"from el join {run.p}w{run.last} using (i), {run.p}nn group by el.row_id)"
    for i, run in enumerate(GRID_RUNS)
)


@query("final_eval_regression", f"with recursive {EMB},\n{GRID_CTES},\n{FINAL_SCORES}\n" + "\nunion all\n".join(
    f"select {i}::bigint as run_id, round(avg((y - z) * (y - z)), 6) + 0e0 as mse, "
    f"round(1e0 - sum((y - z) * (y - z)) / (var_pop(y) * count(*)), 6) + 0e0 as r2 from q{i}"
    for i in range(len(GRID_RUNS))
))
def final_eval_regression(spark, sf):
    rows = embeddings(spark, sf)
    runs = param_grid(
        spark, **{"lambda": GRID_LAMBDAS, "lot_ratio": GRID_RATIOS, "max_iter": [1], "seed": [5]}
    )
    out = fit_grid(rows, runs, "ridge", "PSCD", fit_intercept=False).evaluate(rows)
    return out.select("run_id", r6("mse", "mse"), r6("r2", "r2"))


CLASS_RUN = Unrolled("", 0.5, 2, 2).dual("hinge")


@query("final_eval_classification", f"""with recursive {EMB},
{CLASS_RUN.text},
q as (select el.row_id, any_value(y) as y, sum(v * w) as z from el join w{CLASS_RUN.last} using (i)
      group by el.row_id),
c as (select count(*) filter (where y > 0 and z > 0) as tp, count(*) filter (where y <= 0 and z > 0) as fp,
             count(*) filter (where y > 0 and z <= 0) as fn, count(*) filter (where y <= 0 and z <= 0) as tn
      from q)
select tp, fp, fn, tn, round((tp + tn)::double / (tp + fp + fn + tn), 6) + 0e0 as accuracy,
       round(coalesce(tp::double / nullif(tp + fp, 0), 0e0), 6) + 0e0 as precision,
       round(coalesce(tp::double / nullif(tp + fn, 0), 0e0), 6) + 0e0 as recall,
       round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0), 6) + 0e0 as f1 from c""")
def final_eval_classification(spark, sf):
    rows = embeddings(spark, sf)
    result = fit(rows, "hinge", "PSCD", params(), fit_intercept=False)
    out = metrics.final_eval(result.scores(rows), result.task)
    rounded = [r6(c, c) for c in ("accuracy", "precision", "recall", "f1")]
    return out.select("tp", "fp", "fn", "tn", *rounded)


TRACE_RUN = Unrolled("", 0.5, 2, 2).dual("ridge")


def trace_row_sql(epoch):
    w = f"w{2 * epoch}"
    return f"""select {epoch}::int as epoch, round(avg({loss_sql('ridge')}) + any_value(half), 6) + 0e0 as cost,
round(avg((z - y) * (z - y)), 6) + 0e0 as mse
from (select el.row_id, any_value(y) as y, sum(v * w / ({LAMBDA}e0 * n)) as z from el
      join {w} using (i), nn group by el.row_id),
     (select {LAMBDA}e0 / 2 * sum(power(w / ({LAMBDA}e0 * n), 2)) as half from {w}, nn)"""


@query("epoch_trace", f"with recursive {EMB},\n{TRACE_RUN.text}\n" + "\nunion all\n".join(
    trace_row_sql(e) for e in range(3)
))
def epoch_trace(spark, sf):
    rows = embeddings(spark, sf)
    result = fit(rows, "ridge", "PSCD", params(), fit_intercept=False, validation=rows, trace=True)
    return result.trace_frame().select("epoch", r6("cost", "cost"), r6("mse", "mse"))


def primal_sql(task, sweeps, share=None, damping="0.05e0"):
    ctes = ["nn as (select count(*) as n from emb)", "t0 as (select distinct i, 0e0 as w from el)"]
    lam = f"{LAMBDA}e0"
    sampled = lambda t: "" if share is None else (
        f" qualify row_number() over (order by md5('{SEED}|sample|{t}|' || row_id), row_id) <= "
        f"(select ceil({share}e0 * n) from nn)"
    )
    for t in range(sweeps):
        ctes.append(
            f"s{t} as (select row_id, any_value(y) as y, sum(v * w) as z from el join t{t} using (i) "
            f"group by row_id{sampled(t)})"
        )
        if task == "ridge":
            g, h, pen = "sum((y - z) * v)", "sum(v * v)", f"{lam} * n"
        else:
            e = "exp(-y * z)"
            g, h, pen = f"sum(y * v * {e} / (1e0 + {e}))", f"sum(v * v * {e} / power(1e0 + {e}, 2))", lam
        ctes.append(
            f"g{t} as (select i, {g} as g, {h} as h from (select row_id, i, v from el) "
            f"join s{t} using (row_id) group by i)"
        )
        ctes.append(
            f"t{t + 1} as (select i, w + {damping} * (g - {pen} * w) / (h + {pen}) as w "
            f"from t{t} join g{t} using (i), nn)"
        )
    body = ",\n".join(ctes)
    return f"with recursive {EMB},\n{body}\nselect i::int as idx, round(w, 6) + 0e0 as value from t{sweeps}"


def _register_primal():
    for task in ("ridge", "logistic"):

        @query(f"fit_primal_cd_{task}", primal_sql(task, 3))
        def primal(spark, sf, task=task):
            run = params(max_iter=3, gamma=0.05)
            return coef_out(fit(embeddings(spark, sf), task, "primal_cd", run, fit_intercept=False))


_register_primal()


@query("fit_primal_cd_trace", primal_sql("ridge", 3).rsplit("\n", 1)[0] + "\n" + "\nunion all\n".join(
    f"""select {t}::int as epoch, round(avg({loss_sql("ridge")}) + any_value(half), 6) + 0e0 as cost,
       round(avg((y - z) * (y - z)), 6) + 0e0 as mse, '{"complete" if t == 3 else "running"}' as status
from (select row_id, any_value(y) as y, sum(v * w) as z from el join t{t} using (i) group by row_id),
     (select {LAMBDA}e0 / 2 * sum(w * w) as half from t{t})""" for t in range(4)
))
def fit_primal_cd_trace(spark, sf):
    """A line per sweep."""
    rows, run = embeddings(spark, sf), params(max_iter=3, gamma=0.05)
    result = fit(rows, "ridge", "primal_cd", run, fit_intercept=False, validation=rows, trace=True)
    return result.trace_frame().select("epoch", r6("cost", "cost"), r6("mse", "mse"), "status")


@query("fit_primal_cd_sampled", primal_sql("logistic", 2, share=0.3))
def fit_primal_cd_sampled(spark, sf):
    """Each sweep looks at three tenths of the rows."""
    run = params(max_iter=2, gamma=0.05, sample_ratio=0.3)
    return coef_out(fit(embeddings(spark, sf), "logistic", "primal_cd", run, fit_intercept=False))


@query("fit_dual_sequential")
def fit_dual_sequential(spark, sf):
    """Each row sees the model left by the row before it."""
    rows = embeddings(spark, sf)
    return coef_out(fit(rows, "hinge", "SSCD", params(), fit_intercept=False))


def walk_sql(r, sigma_p, task, clip=None, noise=None):
    """Recursive SQL of one local pass in round r: each part's rows in order, one step at a time.

    Needs ``o{r}`` (part, t, row_id, y, x, sq, alpha) and ``m{r}`` (w as a list); gives ``v{r}``.
    With noise also ``z{r}`` (part, t, list): what a part's view gets after its row t.
    """
    step = delta_sql(task, lam_n=f"({LAMBDA}e0 * n)", sigma_p=sigma_p)
    if clip is not None:
        step = f"({step} / greatest(1e0, abs({step}) / {clip}e0))"
    if noise is not None:
        return f"""v{r} as (
  select distinct part, 0::bigint as t, w as view, -1::bigint as row_id, 0e0 as d from o{r}, m{r}
  union all
  select part, t, list_transform(list_zip(view, x, e), lambda p: p[1] + {sigma_p} * (d * p[2] + {noise}e0 * p[3])),
         row_id, d
  from (select part, t, view, x, e, row_id, {step} as d
        from (select a.part, b.t, a.view, b.x, b.row_id, b.y, b.sq, b.alpha, z.e,
                     list_inner_product(a.view, b.x) as z
              from v{r} a join o{r} b on b.part = a.part and b.t = a.t + 1
                   join z{r} z on z.part = b.part and z.t = b.t), nn))"""
    return f"""v{r} as (
  select distinct part, 0::bigint as t, w as view, -1::bigint as row_id, 0e0 as d from o{r}, m{r}
  union all
  select part, t, list_transform(list_zip(view, x), lambda p: p[1] + {sigma_p} * d * p[2]), row_id, d
  from (select part, t, view, x, row_id, {step} as d
        from (select a.part, b.t, a.view, b.x, b.row_id, b.y, b.sq, b.alpha,
                     list_inner_product(a.view, b.x) as z
              from v{r} a join o{r} b on b.part = a.part and b.t = a.t + 1), nn))"""


ROWS_SQ = """
nn as (select count(*) as n from emb),
sqs as (select row_id, y, x, list_inner_product(x, x) as sq from emb)"""
SEQUENTIAL_SQL = f"""with recursive {EMB}, {ROWS_SQ},
m0 as (select list_transform(range(64), lambda j: 0e0) as w),
o0 as (select 0 as part, row_id, y, x, sq, 0e0 as alpha,
              row_number() over (order by md5('{SEED}|order|0|0|' || row_id), row_id) as t from sqs),
{walk_sql(0, "1e0", "hinge")}
select unnest(range(64))::int as idx, round(unnest(view) / ({LAMBDA}e0 * n), 6) + 0e0 as value
from v0, nn where t = n"""


@query("fit_dual_sequential_pass", SEQUENTIAL_SQL)
def fit_dual_sequential_pass(spark, sf):
    """One pass over all rows, step by step."""
    run = params(max_iter=1, lot_ratio=1.0)
    return coef_out(fit(embeddings(spark, sf), "hinge", "SSCD", run, fit_intercept=False))


def cocoa_sql(rounds, clip=None, noise=None, key=None, task="ridge", whole_lots=False, width=64, source=EMB):
    """``noise`` is the multiple of a lot's deviation that is drawn after each of a part's two lots."""
    whole = " join ls using (part) qualify t <= size - size % l" if noise is not None or whole_lots else ""
    ctes = [f"m0 as (select list_transform(range({width}), lambda j: 0e0) as w)",
            "a0 as (select row_id, 0e0 as alpha from emb)",
            f"pt as (select row_id, (ntile(4) over (order by md5('{SEED}|' || row_id), row_id) - 1)::int "
            "as part from emb)",
            "ls as (select part, count(*) as size, ceil(0.5e0 * count(*))::bigint as l from pt group by part)"]
    for r in range(rounds):
        ctes += [
            f"o{r} as (select part, row_id, y, x, sq, alpha, row_number() over (partition by part "
            f"order by md5('{SEED}|order|{r}|0|' || row_id), row_id) as t "
            f"from sqs join pt using (row_id) join a{r} using (row_id){whole})",
            *([] if noise is None else [f"""h{r} as (
select part, t, t % l = 0 as ends, t // l as lot, sqrt((4e0 * l * l - 2e0) * {clip}e0 * {clip}e0) as deviation
from o{r} join ls using (part))""", f"""z{r} as (
select part, t, list(case when ends then deviation * {normal_sql(f"'{key}|w|{r}|' || part || '|' || lot || '|' || j")}
                     else 0e0 end order by j) as e
from h{r}, range({width}) q(j) group by part, t)"""]),
            walk_sql(r, "4e0", task, clip, noise),
            f"e{r} as (select part, max(t) as t from v{r} group by part)",
            f"c{r} as (select i, any_value(w) + sum((v - w) / 4e0) as w from (select "
            f"unnest(range({width})) as i, unnest(view) as v, unnest(w) as w from v{r} join e{r} using (part, t), "
            f"m{r}) group by i)",
            f"m{r + 1} as (select list(w order by i) as w from c{r})",
            f"a{r + 1} as (select row_id, alpha + coalesce(d, 0e0) as alpha from a{r} left join v{r} using (row_id))"
            if noise is None else f"""a{r + 1} as (
select row_id, alpha + coalesce(d + deviation * {normal_sql(f"'{key}|a|{r}|0|' || row_id")}, 0e0) as alpha
from a{r} left join (select row_id, d, deviation from v{r} join h{r} using (part, t)) using (row_id))""",
        ]
    body = ",\n".join(ctes)
    return f"with recursive {source}, {ROWS_SQ},\n{body}\n"


COCOA_ROUNDS = 3


def cocoa_trace_sql():
    """Cost and accuracy of the shared model after each round."""
    lines = [f"""select {r}::int as epoch, round(avg({loss_sql("logistic")}) + any_value(half), 6) + 0e0 as cost,
       avg(case when (z > 0) = (y > 0) then 1e0 else 0e0 end) as accuracy,
       '{"complete" if r == COCOA_ROUNDS else "running"}' as status
from (select y, list_inner_product(x, w) / ({LAMBDA}e0 * n) as z,
             {LAMBDA}e0 / 2 * list_inner_product(w, w) / power({LAMBDA}e0 * n, 2) as half from sqs, m{r}, nn)"""
             for r in range(COCOA_ROUNDS + 1)]
    return cocoa_sql(COCOA_ROUNDS, task="logistic", whole_lots=True) + "\nunion all\n".join(lines)


@query("fit_cocoa", cocoa_trace_sql())
def fit_cocoa(spark, sf):
    rows = embeddings(spark, sf)
    run = params(max_iter=1, out_iter=COCOA_ROUNDS, k=4)
    result = fit(rows, "logistic", "COCOA", run, fit_intercept=False, validation=rows, trace=True)
    return result.trace_frame().select("epoch", r6("cost", "cost"), "accuracy", "status")


@query("fit_cocoa_rounds", cocoa_sql(2) + f"""select i::int as idx,
round(w / ({LAMBDA}e0 * n), 6) + 0e0 as value from c1, nn""")
def fit_cocoa_rounds(spark, sf):
    """Two rounds over four parts."""
    run = params(max_iter=1, out_iter=2, k=4, lot_ratio=1.0)
    return coef_out(fit(embeddings(spark, sf), "ridge", "COCOA", run, fit_intercept=False))


PRIVATE_PARTS = params(max_iter=1, out_iter=2, k=4, sigma=1.0, clip=0.01)


@query("fit_cocoa_private", cocoa_sql(
    2, 0.01, 1.0, PRIVATE_PARTS.noise_key("cocoa", "ridge")
) + f"select i::int as idx, round(w / ({LAMBDA}e0 * n), 6) + 0e0 as value from c1, nn")
def fit_cocoa_private(spark, sf):
    """Two rounds over four parts of two lots, with noise in the view after every lot."""
    return coef_out(fit(embeddings(spark, sf), "ridge", "COCOA", PRIVATE_PARTS, fit_intercept=False))


@query("fit_cocoa_alpha", cocoa_sql(2) + "select row_id, round(alpha, 6) + 0e0 as alpha from a2")
def fit_cocoa_alpha(spark, sf):
    run = params(max_iter=1, out_iter=2, k=4, lot_ratio=1.0)
    result = fit(embeddings(spark, sf), "ridge", "COCOA", run, fit_intercept=False)
    return result.alpha[0].select("row_id", r6("alpha", "alpha"))


DISPATCHED = ("PSCD", "SSCD", "SGD", "COCOA", "primal_cd")


def dispatch_sql():
    """All solvers on rows with a constant 1 in front, each with its metrics."""
    ones = """raw as (select vec_id as row_id, case when label = 0 then 1e0 else -1e0 end as y, embedding from embeddings),
emb as (select row_id, y, list_concat([1e0], list_transform(embedding, lambda v: v::double)) as x from raw),
el as (select row_id, y, unnest(range(65)) as i, unnest(x) as v from emb)"""
    dual, sgd = Unrolled("d_", 0.5, 1, 2).dual("ridge"), Unrolled("s_", 0.5, 1, 2).sgd("ridge", 10**9, 0.1)
    primal = primal_sql("ridge", 1, damping="(1e0 / 65)").split("\n", 1)[1].rsplit("\n", 1)[0].split(",\n", 1)[1]
    primal = primal[primal.index("t0 as"):]
    models = {
        "PSCD": f"select i, w / ({LAMBDA}e0 * n) as c from d_w{dual.last}, nn",
        "SSCD": f"select i, w / ({LAMBDA}e0 * n) as c from c0, nn",
        "SGD": f"select i, w as c from s_w{sgd.last}",
        "COCOA": f"select i, w / ({LAMBDA}e0 * n) as c from c0, nn",
        "primal_cd": "select i, w as c from t1",
    }
    lines = [f"""select '{name}' as solver, round(avg((z - y) * (z - y)) / 2e0, 6) + 0e0 as loss,
       round(avg((z - y) * (z - y)), 6) + 0e0 as mse, round(1e0 - avg((z - y) * (z - y)) / var_pop(y), 6) + 0e0 as r2
from (select row_id, any_value(y) as y, sum(v * c) as z from el join ({model}) using (i) group by row_id)"""
             for name, model in models.items()]
    parts = cocoa_sql(1, whole_lots=True, width=65, source=ones).rstrip()
    return f"{parts},\n{dual.text},\n{sgd.text},\n{primal}\n" + "\nunion all\n".join(lines)


@query("fit_dispatch", dispatch_sql())
def fit_dispatch(spark, sf):
    """Every solver by its short name, with an intercept: one line of metrics each."""
    rows = embeddings(spark, sf)
    out = None
    for name in DISPATCHED:
        k = 4 if name in ("SSCD", "COCOA") else 1
        result = fit(rows, "RR", name, params(max_iter=1, k=k, gamma=0.1 if name == "SGD" else None))
        metrics_of = [r6(c, c) for c in ("loss", "mse", "r2")]
        line = result.evaluate(rows).select(F.lit(name).alias("solver"), *metrics_of)
        out = line if out is None else out.unionByName(line)
    return out


FLAGSHIP = dict(lambda_=0.1, lot_ratio=0.5, max_iter=1, clip=0.5, sigma=0.5, seed=SEED)
FLAG_RUN = Unrolled(
    "", 0.5, 1, 2, lam=0.1, key=RunParams(**FLAGSHIP).noise_key("dual_parallel", "ridge")
).dual("ridge", clip=0.5, noise=0.5 * (2 * 0.25) ** 0.5)


@query("flagship", f"""with recursive {EMB},
{FLAG_RUN.text},
q as (select el.row_id, any_value(y) as y, sum(v * w) as z from el join w{FLAG_RUN.last} using (i)
      group by el.row_id)
select avg(case when (z > 0) = (y > 0) then 1e0 else 0e0 end) as accuracy from q""")
def flagship(spark, sf):
    """Two private lots of ridge training on the embeddings, then the share of correct classes."""
    rows = embeddings(spark, sf)
    run = RunParams(**FLAGSHIP)
    result = fit_runs(rows, "ridge", "PSCD", [run], fit_intercept=False, mode="exact")
    label = F.when(F.col("z") > 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    return metrics.accuracy(result.scores(rows).withColumn("prediction", label))


def _ledger_out(result):
    return result.ledger.select("run_id", r6("sigma", "sigma"), r6("q", "q"), "iters")


def _ledger_sql(q, iters):
    return (
        f"select 0::bigint as run_id, 2e0 as sigma, round({q}, 6) + 0e0 as q, ({iters})::bigint as iters "
        "from (select count(*) as n, greatest(1, ceil(0.4e0 * count(*)))::bigint as l from embeddings)"
    )


def _register_ledgers():
    """What a private run books, as it was trained."""
    for solver, name in (("SGD", "sgd"), ("PSCD", "dual_parallel")):

        @query(f"fit_ledger_{name}", _ledger_sql("l::double / n", "2 * n // l"))
        def independent(spark, sf, solver=solver):
            run = params(lot_ratio=0.4, clip=0.5, sigma=2.0)
            return _ledger_out(fit(embeddings(spark, sf), "ridge", solver, run, fit_intercept=False))

    @query("fit_ledger_cocoa", _ledger_sql("1e0", "3"))
    def parts(spark, sf):
        run = params(lot_ratio=0.4, max_iter=1, out_iter=3, k=4, clip=0.5, sigma=2.0)
        return _ledger_out(fit(embeddings(spark, sf), "ridge", "COCOA", run, fit_intercept=False))


_register_ledgers()

APART = params(lot_ratio=0.4, max_iter=3, clip=0.5, sigma=2.0)
APART_RUN = Unrolled("", 0.4, 3, 2, key=APART.noise_key("dual_parallel", "ridge")).dual(
    "ridge", clip=0.5, noise=2.0 * (2 * 0.25) ** 0.5
)


@query("fit_private_apart", f"with recursive {EMB},\n{APART_RUN.text}\n{dual_coef_sql(APART_RUN)}")
def fit_private_apart(spark, sf):
    """Private lots of a permutation end with their epoch: two of two fifths each, and no row twice in one."""
    return coef_out(fit(embeddings(spark, sf), "ridge", "PSCD", APART, fit_intercept=False, mode="exact"))


@query("fit_ledger_spanning", _ledger_sql("1e0", "3"))
def fit_ledger_spanning(spark, sf):
    """Lots that do not divide an epoch: three epochs are three releases at rate 1."""
    return _ledger_out(fit(embeddings(spark, sf), "ridge", "SGD", APART, fit_intercept=False, mode="exact"))


SHORT = params(max_iter=1, clip=0.5, sigma=2.0, lot_ratio=1.0)


@query("fit_private_intercept", f"""with recursive {EMB},
ones as (select row_id, y, 0::int as i, sqrt(0.5e0) as v from emb
         union all select row_id, y, i + 1, v * sqrt(0.5e0) from el),
nn as (select count(*) as n from emb),
d as (select row_id, {delta_sql("ridge", lam_n=f"({LAMBDA}e0 * n)", sigma_p="n::double")} as raw
      from (select row_id, any_value(y) as y, 0e0 as alpha, 0e0 as z, sum(v * v) as sq from ones group by row_id), nn),
w as (select i, sum(v * raw / greatest(1e0, abs(raw) / 0.5e0)) as w from ones join d using (row_id) group by i)
select i as idx, round(sqrt(0.5e0) * (w + {2.0 * (2 * 0.25) ** 0.5}e0
       * {normal_sql(f"'{SHORT.noise_key('dual_parallel', 'ridge')}|w|0|' || i")}) / ({LAMBDA}e0 * n), 6) + 0e0 as value
from w, nn""")
def fit_private_intercept(spark, sf):
    """One private lot of all rows, shortened so that a row with its constant has length 1."""
    return coef_out(fit(embeddings(spark, sf), "ridge", "PSCD", SHORT))


NOISY_GRID = [(0.5, 0), (0.34, 1)]


def _grid_run(ratio, run_id):
    return params(run_id=run_id, lot_ratio=ratio, max_iter=1, clip=0.5, sigma=2.0)


NOISY_RUNS = [
    Unrolled(f"g{i}_", ratio, 1, 2, mode="poisson", key=_grid_run(ratio, i).noise_key("sgd", "ridge")).sgd(
        "ridge", 0.5, 1.0, noise=2.0 * 0.5
    )
    for ratio, i in NOISY_GRID
]


@query("fit_grid_private", f"with recursive {EMB},\n" + ",\n".join(r.text for r in NOISY_RUNS) + "\n" + "\nunion all\n".join(
    f"select {i}::bigint as run_id, i::int as idx, round(w, 6) + 0e0 as value from {r.p}w{r.last}"
    for i, r in enumerate(NOISY_RUNS)
))
def fit_grid_private(spark, sf):
    """Two runs with one seed and different lots: each draws its own noise."""
    result = fit_runs(embeddings(spark, sf), "ridge", "SGD", [_grid_run(*g) for g in NOISY_GRID], fit_intercept=False)
    return result.coef_frame().select("run_id", F.col("idx").cast("int").alias("idx"), r6("value", "value"))
