"""The privacy ledger, over ledgers that are aggregated from the tables."""

from pyspark.sql import functions as F

from lotwise.operators import privacy
from lotwise.queries.inputs import r6, table
from lotwise.queries.registry import query

LEDGER = """
lg as (select o_custkey as run_id, o_orderpriority as mech_id,
              1e0 + floor(min(o_totalprice) / 5e4) * 0.5e0 as sigma, 0.01e0 * count(*) as q,
              10 * count(*) as iters from orders group by 1, 2)"""


def order_ledger(spark, sf):
    """Every customer is a run, every order priority one of its mechanisms."""
    n = F.count(F.lit(1))
    return table(spark, sf, "orders").groupBy(
        F.col("o_custkey").alias("run_id"), F.col("o_orderpriority").alias("mech_id")
    ).agg(
        (F.lit(1.0) + F.floor(F.min("o_totalprice") / 5e4) * 0.5).alias("sigma"),
        (F.lit(0.01) * n).alias("q"),
        (n * 10).alias("iters"),
    )


def term_sql(sigma="sigma", q="q"):
    """One term of the binomial sum, in logs."""
    c = f"(2e0 * {sigma} * {sigma})"
    stay = f"(ln(greatest(1e0 - {q}, 1e-300)) + k * (k - 1) / {c})"
    move = f"(ln({q}) + k * (k + 1) / {c})"
    return (
        f"lgamma(o + 1) - lgamma(k + 1) - lgamma(o - k + 1) + k * ln({q}) "
        f"+ (o - k) * ln(greatest(1e0 - {q}, 1e-300)) + greatest({stay}, {move}) "
        f"+ ln(1e0 + exp(-abs({stay} - {move})))"
    )


def moments_sql(orders=32, source="lg"):
    """Log moments per distinct (sigma, q) and order."""
    return f"""
pq as (select distinct sigma, q from {source}),
tm as (select sigma, q, o, {term_sql()} as t
       from pq, range(1, {orders + 1}) a(o), range(0, {orders + 1}) b(k) where k <= o),
mx as (select sigma, q, o, max(t) as m from tm group by sigma, q, o),
lm as (select sigma, q, o, any_value(m) + ln(sum(exp(t - m))) as lm
       from tm join mx using (sigma, q, o) group by sigma, q, o)"""


COMPOSED = f"""{LEDGER}, {moments_sql()},
cp as (select run_id, o, sum(iters * lm) as a from lg join lm using (sigma, q) group by run_id, o)"""


@query("log_moments", f"""with {LEDGER}, {moments_sql()}
select run_id, mech_id, o::int as "order", round(lm, 6) + 0e0 as log_moment
from lg join lm using (sigma, q)""")
def log_moments(spark, sf):
    out = privacy.log_moments(order_ledger(spark, sf))
    return out.select("run_id", "mech_id", "order", r6("log_moment", "log_moment"))


@query("compose", f"""with {COMPOSED}
select run_id, o::int as "order", round(a, 6) + 0e0 as log_moment from cp""")
def compose(spark, sf):
    out = privacy.compose(privacy.log_moments(order_ledger(spark, sf)))
    return out.select("run_id", "order", r6("log_moment", "log_moment"))


@query("eps_for_delta", f"""with {COMPOSED}
select run_id, round(min((a - ln(1e-5)) / o), 6) + 0e0 as eps,
       arg_min(o, (a - ln(1e-5)) / o)::int as min_lambda from cp group by run_id""")
def eps_for_delta(spark, sf):
    composed = privacy.compose(privacy.log_moments(order_ledger(spark, sf)))
    out = privacy.eps_for_delta(composed, 1e-5)
    return out.select("run_id", r6("eps", "eps"), "min_lambda")


@query("delta_for_eps", f"""with {COMPOSED},
u as (select run_id, o, exp(a - o * 6e0) as d from cp where a < o * 6e0)
select run_id, round(coalesce(min(d), 1e0), 6) + 0e0 as delta from cp left join u using (run_id, o)
group by run_id""")
def delta_for_eps(spark, sf):
    composed = privacy.compose(privacy.log_moments(order_ledger(spark, sf)))
    return privacy.delta_for_eps(composed, 6.0).select("run_id", r6("delta", "delta"))


TARGETS = """
tg as (select c_custkey as run_id, 0.5e0 + floor(c_acctbal / 2e3) * 0.25e0 + 0.5e0 as eps, 1e-5 as delta,
              (c_nationkey % 5 + 1) / 1e2 as q, 100 as iters from customer)"""


def customer_targets(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("run_id"),
        (F.lit(0.5) + F.floor(F.col("c_acctbal") / 2e3) * 0.25 + 0.5).alias("eps"),
        F.lit(1e-5).alias("delta"),
        ((F.col("c_nationkey") % 5 + 1) / 1e2).alias("q"),
        F.lit(100).alias("iters"),
    )


@query("calibrate_sigma", f"""with recursive {TARGETS},
dt as (select distinct eps, q from tg),
bs as (
  select eps, q, 0 as step, 1e-10 as low, 1e10 as high from dt
  union all
  select eps, q, step + 1, case when e <= eps then low else mid end,
         case when e <= eps then mid else high end
  from (
    select eps, q, step, low, high, mid, min((100 * lm - ln(1e-5)) / o) as e
    from (
      select eps, q, step, low, high, mid, o, any_value(m) + ln(sum(exp(t - m))) as lm
      from (
        select *, max(t) over (partition by eps, q, o) as m
        from (select eps, q, step, low, high, mid, o, {term_sql("mid")} as t
              from (select *, sqrt(low * high) as mid from bs where step < 40),
                   range(1, 33) a(o), range(0, 33) b(k) where k <= o)
      ) group by eps, q, step, low, high, mid, o
    ) group by eps, q, step, low, high, mid
  )
)
select run_id, round(high, 6) + 0e0 as sigma from tg join bs using (eps, q) where step = 40""")
def calibrate_sigma(spark, sf):
    return privacy.calibrate_sigma(customer_targets(spark, sf)).select("run_id", r6("sigma", "sigma"))


@query("calibrate_sigma_geometric", f"""with {TARGETS},
lg as (select distinct 1e-4 * power(1.1e0, j) as sigma, q from tg, range(0, 200) r(j)),
{moments_sql()},
hit as (select eps, q, sigma from (select distinct eps, q from tg) join lm using (q)
        group by eps, q, sigma having exp(least(0e0, min(100 * lm - o * eps))) <= 1e-5),
fs as (select eps, q, min(sigma) as sigma from hit group by eps, q)
select run_id, round(sigma, 6) + 0e0 as sigma from tg join fs using (eps, q)""")
def calibrate_sigma_geometric(spark, sf):
    out = privacy.calibrate_sigma_geometric(customer_targets(spark, sf))
    return out.select("run_id", r6("sigma", "sigma"))


@query("check_budget", f"""with {LEDGER}, {moments_sql(128)},
cp as (select run_id, o, sum(iters * lm) as a from lg join lm using (sigma, q) group by run_id, o),
ep as (select run_id, min((a - ln(1e-3)) / o) as eps from cp group by run_id)
select run_id, round(eps, 6) + 0e0 as eps,
       case when run_id % 4 = 0 then true else eps <= 2e0 * (run_id % 4) end as accepted from ep""")
def check_budget(spark, sf):
    ledger = order_ledger(spark, sf)
    step = F.col("run_id") % 4
    runs = ledger.select("run_id").distinct()
    targets = runs.where(step != 0).select("run_id", (2.0 * step).alias("eps"))
    return privacy.check_budget(ledger, targets).select("run_id", r6("eps", "eps"), "accepted")


@query("eps_curve", f"""with {LEDGER.replace("lg as", "l0 as")},
lg as (select distinct sigma, 0.02e0 as q from l0), {moments_sql()}
select sigma, round(min((1000 * lm - ln(1e-5)) / o), 6) + 0e0 as eps from lm group by sigma""")
def eps_curve(spark, sf):
    sigmas = order_ledger(spark, sf).select("sigma").distinct()
    return privacy.eps_curve(sigmas, 0.02, 1000).select("sigma", r6("eps", "eps"))


NODES = 1_000_001
TILT = "(ln(q) + (2 * z - 1) / (2 * sigma * sigma))"
REST = "ln(greatest(1e0 - q, 1e-300))"


@query("audit_moments", f"""with {LEDGER}, {moments_sql(16)},
nd as (select sigma, q, (1e0 + 60e0 * sigma) / {NODES - 1} as h,
              -30e0 * sigma + j * ((1e0 + 60e0 * sigma) / {NODES - 1}) as z
       from pq, range(0, {NODES}) r(j)),
vl as (select sigma, q, h, -z * z / (2 * sigma * sigma) - ln(sigma) - 0.5e0 * ln(2 * pi()) as l0,
              greatest({TILT}, {REST}) + ln(1e0 + exp(-abs({TILT} - {REST}))) as r from nd),
sm as (select sigma, q, o, ln(sum(exp(l0 - o * r)) * any_value(h)) as e1,
              ln(sum(exp(l0 + (o + 1) * r)) * any_value(h)) as e2
       from vl, (values (1), (4), (16)) v(o) group by sigma, q, o)
select run_id, mech_id, o::int as "order", round(greatest(e1, e2), 6) + 0e0 as log_moment_quadrature,
       round(lm, 6) + 0e0 as log_moment, e1 < e2 as ordered
from lg join sm using (sigma, q) join lm using (sigma, q, o)""")
def audit_moments(spark, sf):
    out = privacy.audit_moments(order_ledger(spark, sf), (1, 4, 16), NODES)
    return out.select(
        "run_id", "mech_id", "order", r6("log_moment_quadrature", "log_moment_quadrature"),
        r6("log_moment", "log_moment"), "ordered",
    )


RUNS = """
rn as (select c_custkey as run_id, 1e0 + c_nationkey / 5e0 as sigma,
              case when c_custkey % 7 = 0 then 250e0 else (c_nationkey + 1) / 1e2 end as lot_ratio,
              (c_custkey % 5 + 1)::int as max_iter, (c_custkey % 4 + 1)::int as k,
              (c_custkey % 3 + 1)::int as out_iter from customer),
nn as (select count(*) as n from orders),
ls as (select *, least(case when lot_ratio <= 1 then greatest(1e0, ceil(lot_ratio * n))
                            else floor(lot_ratio) end, n * max_iter) as l from rn, nn)"""

SOLVER_SQL = {
    "dual_parallel": "select run_id, 0 as mech_id, least(1e0, l / (n * k)) as q, "
                     "floor(n * max_iter / l) as iters from ls",
    "dual_sequential": "select run_id, 0 as mech_id, least(1e0, l / (n * k)) as q, "
                       "k * out_iter * floor(n * max_iter / l) as iters from ls",
    "sgd": "select run_id, 0 as mech_id, l / n as q, floor(n * max_iter / l) as iters from ls",
    "cocoa": """select run_id, mech_id, least(1e0, ol / (own * k)) * own / n as q,
       k * out_iter * floor(own * max_iter / ol) as iters
from (select *, least(case when lot_ratio <= 1 then greatest(1e0, ceil(lot_ratio * own))
                           else floor(lot_ratio) end, own * max_iter) as ol
      from (select *, r * k + j as mech_id, n // k + case when j < n % k then 1 else 0 end as own
            from ls, range(0, 3) a(r), range(0, 4) b(j) where r < out_iter and j < k))""",
}


def _register_solver_ledgers():
    for solver, body in SOLVER_SQL.items():

        @query(f"privacy_params_{solver}", f"""with {RUNS}, t as ({body})
select run_id, mech_id::bigint as mech_id, round(q, 6) + 0e0 as q, iters::bigint as iters from t""")
        def solver_ledger(spark, sf, solver=solver):
            key, nation = F.col("c_custkey"), F.col("c_nationkey")
            ratio = F.when(key % 7 == 0, F.lit(250.0)).otherwise((nation + 1) / 1e2)
            runs = table(spark, sf, "customer").select(
                key.alias("run_id"), (1.0 + nation / 5.0).alias("sigma"), ratio.alias("lot_ratio"),
                (key % 5 + 1).cast("int").alias("max_iter"), (key % 4 + 1).cast("int").alias("K"),
                (key % 3 + 1).cast("int").alias("out_iter"),
            )
            out = privacy.solver_ledger(runs, table(spark, sf, "orders").count(), solver)
            return out.select(
                "run_id", F.col("mech_id").cast("bigint").alias("mech_id"), r6("q", "q"),
                F.col("iters").cast("bigint").alias("iters"),
            )


_register_solver_ledgers()
