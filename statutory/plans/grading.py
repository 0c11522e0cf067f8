"""Grading and paired-run statistics over the traces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.operators import grading as G
from statutory.plans.registry import query
from statutory.plans.views import Tables

_SCORED = """
v AS (SELECT *, answer = 'not_in_the_data' OR lower(trim(answer)) IN ('yea', 'nay', 'present', 'not_voting') AS valid, answer = 'not_in_the_data' AS refused FROM v_traces),
w AS (SELECT *, CASE WHEN valid THEN 1.0 ELSE 0.0 END AS format_valid, CASE WHEN valid THEN CASE WHEN is_refusal = refused THEN 1.0 ELSE 0.0 END END AS decision_correct,
  CASE WHEN valid AND NOT is_refusal AND NOT refused THEN CASE WHEN lower(trim(answer)) = lower(trim(gold)) THEN 1.0 ELSE 0.0 END END AS answer_correct FROM v),
s AS (SELECT *, CASE WHEN format_valid = 0 OR (is_refusal AND decision_correct = 0) THEN 0.0 WHEN answer_correct IS NULL THEN decision_correct ELSE (decision_correct + answer_correct) / 2 END AS score FROM w)"""
_CLASS = "CASE WHEN result_subtype <> 'success' THEN 'errored' WHEN format_valid = 0 THEN 'format_fail' WHEN decision_correct = 0 THEN 'over_refusal' WHEN answer_correct = 1 THEN 'correct' ELSE 'hallucination' END"
_CELL = "template_id, model, surface"
_VOTES = _SCORED + f""",
r AS (SELECT * FROM s WHERE NOT is_refusal AND result_subtype <> 'agent_infra'),
o AS (SELECT {_CELL}, instance_id, count(*) AS total, count(*) FILTER (WHERE result_subtype = 'success') AS n_succ, count(*) FILTER (WHERE result_subtype = 'success' AND answer_correct = 1) AS c FROM r GROUP BY ALL),
out AS (SELECT {_CELL}, instance_id, total, n_succ, CASE WHEN n_succ > 0 THEN 2 * c > n_succ END AS cond_correct, 2 * c > total AS itt_correct, CASE WHEN n_succ >= 2 THEN c > 0 AND c < n_succ END AS flipped FROM o)"""
_ARMS = """
arms AS (SELECT DISTINCT model, surface FROM v_traces),
pairs AS (SELECT 'lift' AS comparison, a.model AS model_a, a.surface AS surface_a, b.model AS model_b, b.surface AS surface_b FROM arms a JOIN arms b ON a.model = b.model AND a.surface = 'ours' AND b.surface = 'web'
  UNION ALL SELECT 'punchup', a.model, a.surface, b.model, b.surface FROM arms a JOIN arms b ON a.surface = 'ours' AND b.model = 'large' AND b.surface = 'web')"""
_TABLE = _VOTES + ", " + _ARMS + """,
t22 AS (SELECT a.template_id, p.comparison, p.model_a, p.surface_a, p.model_b, p.surface_b, count(*) FILTER (WHERE a.cond_correct AND b.cond_correct) AS a, count(*) FILTER (WHERE a.cond_correct AND NOT b.cond_correct) AS b, count(*) FILTER (WHERE NOT a.cond_correct AND b.cond_correct) AS c, count(*) FILTER (WHERE NOT a.cond_correct AND NOT b.cond_correct) AS d
  FROM pairs p JOIN out a ON a.model = p.model_a AND a.surface = p.surface_a JOIN out b ON b.model = p.model_b AND b.surface = p.surface_b AND b.template_id = a.template_id AND b.instance_id = a.instance_id WHERE a.cond_correct IS NOT NULL AND b.cond_correct IS NOT NULL GROUP BY ALL)"""


def wilson_sql(x: str, n: str) -> tuple[str, str]:
    p, d = f"({x} / CAST({n} AS DOUBLE))", f"(1 + 3.8416 / {n})"
    center = f"(({p} + 3.8416 / (2 * {n})) / {d})"
    half = f"((1.96 / {d}) * sqrt({p} * (1 - {p}) / {n} + 3.8416 / (4.0 * {n} * {n})))"
    return f"CASE WHEN {n} > 0 THEN greatest(0.0, {center} - {half}) ELSE 0.0 END", f"CASE WHEN {n} > 0 THEN least(1.0, {center} + {half}) ELSE 1.0 END"


def _pairs(t: Tables) -> DataFrame:
    return G.arm_pairs(t.traces)


def _outcomes(t: Tables) -> DataFrame:
    return G.majority(G.pairable(t.traces))


def _table(t: Tables) -> DataFrame:
    return G.paired_counts(_outcomes(t), _pairs(t))


@query("grade_answers", "SELECT template_id, model, count(*) FILTER (WHERE lower(trim(answer)) = lower(trim(gold))) AS exact, count(*) FILTER (WHERE input_tokens = 3 * output_tokens) AS exact_int FROM v_traces GROUP BY 1, 2")
def grade_answers(t: Tables) -> DataFrame:
    return t.traces.groupBy("template_id", "model").agg(
        F.count(F.when(F.lower(F.trim("answer")).eqNullSafe(F.lower(F.trim("gold"))), 1)).alias("exact"),
        F.count(F.when(F.col("input_tokens") == 3 * F.col("output_tokens"), 1)).alias("exact_int"),
    )


@query("format_valid", "SELECT template_id, count(*) FILTER (WHERE answer = 'not_in_the_data' OR lower(trim(answer)) IN ('yea', 'nay', 'present', 'not_voting')) AS valid, count(*) AS n FROM v_traces GROUP BY 1")
def format_valid(t: Tables) -> DataFrame:
    return t.traces.groupBy("template_id").agg(F.count(F.when(G.format_valid(), 1)).alias("valid"), F.count("*").alias("n"))


@query("score_answers", f"WITH {_SCORED} SELECT template_id, model, surface, count(*) AS n, avg(score) AS score FROM s GROUP BY 1, 2, 3")
def score_answers(t: Tables) -> DataFrame:
    return G.subscores(t.traces).groupBy(*G.CELL).agg(F.count("*").alias("n"), F.avg("score").alias("score"))


@query("classify_runs", f"WITH {_SCORED} SELECT {_CELL}, {_CLASS} AS outcome, count(*) AS n FROM s WHERE NOT is_refusal GROUP BY ALL")
def classify_runs(t: Tables) -> DataFrame:
    return G.subscores(t.traces).where("not is_refusal").groupBy(*G.CELL, G.outcome().alias("outcome")).agg(F.count("*").alias("n"))


@query("majority_vote", f"WITH {_VOTES} SELECT * FROM out")
def majority_vote(t: Tables) -> DataFrame:
    return _outcomes(t)


@query("paired_2x2", f"WITH {_TABLE} SELECT * FROM t22")
def paired_2x2(t: Tables) -> DataFrame:
    return _table(t)


@query("mcnemar", f"WITH {_TABLE}, terms AS (SELECT template_id, comparison, model_a, b, c, sum(exp(lgamma(b + c + 1.0) - lgamma(i + 1.0) - lgamma(b + c - i + 1.0) - (b + c) * ln(2.0))) AS tail FROM t22, unnest(generate_series(0, least(b, c))) AS g(i) GROUP BY 1, 2, 3, 4, 5) SELECT template_id, comparison, model_a, round(CASE WHEN b + c = 0 THEN 1.0 ELSE least(1.0, 2 * tail) END, 8) AS p FROM terms")
def mcnemar(t: Tables) -> DataFrame:
    return _table(t).select("template_id", "comparison", "model_a", F.round(G.mcnemar(), 8).alias("p"))


_LOW, _HIGH = wilson_sql("(a + b)", "(a + b + c + d)")


@query("wilson", f"WITH {_TABLE} SELECT template_id, comparison, model_a, {_LOW} AS low, {_HIGH} AS high FROM t22")
def wilson(t: Tables) -> DataFrame:
    low, high = G.wilson(F.col("a") + F.col("b"), F.col("a") + F.col("b") + F.col("c") + F.col("d"))
    return _table(t).select("template_id", "comparison", "model_a", low.alias("low"), high.alias("high"))


_L1, _U1 = wilson_sql("(a + b)", "n")
_L2, _U2 = wilson_sql("(a + c)", "n")


@query("newcombe", f"""WITH {_TABLE}, x AS (SELECT *, a + b + c + d AS n FROM t22), y AS (SELECT *, (a + b) / CAST(n AS DOUBLE) AS p1, (a + c) / CAST(n AS DOUBLE) AS p2, {_L1} AS l1, {_U1} AS u1, {_L2} AS l2, {_U2} AS u2,
CASE WHEN (a + b) * (c + d) * (a + c) * (b + d) = 0 THEN 0.0 ELSE (a * d - b * c) / sqrt(CAST((a + b) * (c + d) AS DOUBLE) * ((a + c) * (b + d))) END AS phi FROM x)
SELECT template_id, comparison, model_a, p1 - p2 AS difference, greatest(-1.0, p1 - p2 - sqrt((p1 - l1) ** 2 - 2 * phi * (p1 - l1) * (u2 - p2) + (u2 - p2) ** 2)) AS low, least(1.0, p1 - p2 + sqrt((u1 - p1) ** 2 - 2 * phi * (u1 - p1) * (p2 - l2) + (p2 - l2) ** 2)) AS high FROM y""")
def newcombe(t: Tables) -> DataFrame:
    return G.newcombe(_table(t)).select("template_id", "comparison", "model_a", "difference", "low", "high")


@query("bootstrap_ratio")
def bootstrap_ratio(t: Tables) -> DataFrame:
    return G.bootstrap_ratio(G.paired_costs(G.pairable(t.traces), _pairs(t)), ["template_id", "comparison", "model_a"])


_COST = "coalesce(cost, input_tokens * CASE model WHEN 'small' THEN 3e-6 ELSE 15e-6 END + output_tokens * CASE model WHEN 'small' THEN 15e-6 ELSE 75e-6 END)"


@query("paired_costs", f"WITH {_VOTES}, {_ARMS}, m AS (SELECT {_CELL}, instance_id, avg({_COST}) AS cost FROM r GROUP BY ALL) SELECT a.template_id, p.comparison, p.model_a, count(*) AS common, round(avg(a.cost), 6) AS cost_a, round(avg(b.cost), 6) AS cost_b FROM pairs p JOIN m a ON a.model = p.model_a AND a.surface = p.surface_a JOIN m b ON b.model = p.model_b AND b.surface = p.surface_b AND b.template_id = a.template_id AND b.instance_id = a.instance_id GROUP BY 1, 2, 3")
def paired_costs(t: Tables) -> DataFrame:
    costs = G.paired_costs(G.pairable(t.traces), _pairs(t))
    return costs.groupBy("template_id", "comparison", "model_a").agg(F.count("*").alias("common"), F.round(F.avg("cost_a"), 6).alias("cost_a"), F.round(F.avg("cost_b"), 6).alias("cost_b"))


_SUCC = "count(*) FILTER (WHERE result_subtype = 'success')"
_AL, _AH = wilson_sql("n_succ", "rollouts")


@query("arm_summary", f"WITH {_VOTES}, a AS (SELECT {_CELL}, count(*) AS rollouts, {_SUCC} AS n_succ, count(*) FILTER (WHERE {_CLASS} = 'correct') AS correct, count(*) FILTER (WHERE {_CLASS} = 'hallucination') AS hallucination, count(*) FILTER (WHERE cost IS NOT NULL) AS real_costs FROM r GROUP BY ALL), f AS (SELECT {_CELL}, count(*) AS n_instances, coalesce(avg(CASE WHEN flipped THEN 1.0 WHEN NOT flipped THEN 0.0 END), 0.0) AS flip_rate FROM out GROUP BY ALL) SELECT a.template_id, a.model, a.surface, rollouts, n_instances, n_succ / CAST(rollouts AS DOUBLE) AS completion, {_AL} AS low, {_AH} AS high, flip_rate, correct, hallucination, real_costs FROM a JOIN f ON a.template_id = f.template_id AND a.model = f.model AND a.surface = f.surface")
def arm_summary(t: Tables) -> DataFrame:
    runs = G.pairable(t.traces)
    count = lambda c: F.count(F.when(c, 1))
    rows = runs.groupBy(*G.CELL).agg(
        F.count("*").alias("rollouts"), count(F.col("result_subtype") == "success").alias("n_succ"), count(G.outcome() == "correct").alias("correct"),
        count(G.outcome() == "hallucination").alias("hallucination"), F.count("cost").alias("real_costs"),
    )
    flips = G.majority(runs).groupBy(*G.CELL).agg(F.count("*").alias("n_instances"), F.coalesce(F.avg(F.col("flipped").cast("int")), F.lit(0.0)).alias("flip_rate"))
    low, high = G.wilson(F.col("n_succ"), F.col("rollouts"))
    return rows.join(flips, G.CELL).select(*G.CELL, "rollouts", "n_instances", (F.col("n_succ") / F.col("rollouts")).alias("completion"), low.alias("low"), high.alias("high"), "flip_rate", "correct", "hallucination", "real_costs")


@query("drop_infra", "SELECT template_id, count(*) AS n FROM v_traces WHERE NOT is_refusal AND result_subtype <> 'agent_infra' GROUP BY 1")
def drop_infra(t: Tables) -> DataFrame:
    return G.pairable(t.traces).groupBy("template_id").agg(F.count("*").alias("n"))


_DRIFT = """SELECT model, kind, benign, restored, count(*) AS n FROM (SELECT model, CAST(output_tokens % 8 AS INT) AS kind, output_tokens % 8 IN (0, 1, 2, 5) AS benign,
CASE WHEN output_tokens % 8 IN (0, 1, 2, 5) THEN CASE WHEN output_tokens % 3 = 0 THEN 'sandbox_infra' ELSE 'success' END END AS restored FROM v_traces) x GROUP BY 1, 2, 3, 4"""


@query("drift_triage", _DRIFT)
def drift_triage(t: Tables) -> DataFrame:
    """Eight kinds of markers, of which the first three and the sixth are harmless by their making."""
    n, model = F.col("output_tokens"), F.col("model")
    served = [
        F.concat(F.lit("['"), model, F.lit("']")),
        F.concat(F.lit("['"), model, F.lit("-20260101', \"<synthetic>\"]")),
        F.lit("['<synthetic>', None, '']"),
        F.concat(F.lit("['"), model, F.lit("', 'other-model']")),
        F.concat(F.lit("['"), model, F.lit("ish']")),
        F.lit("[]"),
        F.lit("[not, a, list]"),
    ]
    marker = F.element_at(F.array(*served), (n % 8 + 1).cast("int"))
    raw = F.when(n % 8 < 7, F.concat(F.lit("text <MODEL_DRIFT requested="), model, F.lit(" served="), marker, F.lit("> end"))).otherwise("no marker")
    kinds = F.when(n % 3 == 0, F.array(F.lit("timeout"), F.lit("sandbox_infra"))).otherwise(F.array(F.lit("timeout")))
    runs = G.drift_triage(t.traces.select("model", (n % 8).cast("int").alias("kind"), raw.alias("raw"), kinds.alias("error_kinds")))
    return runs.groupBy("model", "kind", "benign", "restored").agg(F.count("*").alias("n"))


@query("surface_delta", f"WITH {_SCORED} SELECT model, avg(CASE WHEN surface = 'ours' THEN h END) - avg(CASE WHEN surface = 'web' THEN h END) AS delta FROM (SELECT model, surface, CASE WHEN {_CLASS} = 'hallucination' THEN 1.0 ELSE 0.0 END AS h FROM s WHERE NOT is_refusal) x GROUP BY 1")
def surface_delta(t: Tables) -> DataFrame:
    runs = G.subscores(t.traces).where("not is_refusal").withColumn("h", (G.outcome() == "hallucination").cast("double"))
    rate = lambda s: F.avg(F.when(F.col("surface") == s, F.col("h")))
    return runs.groupBy("model").agg((rate("ours") - rate("web")).alias("delta"))


@query("batch_invariants", f"WITH {_SCORED} SELECT model, bool_and(score BETWEEN 0 AND 1) AS in_range, bool_or(is_refusal) AS has_refusals, bool_and(format_valid = 1 OR score = 0) AS gated FROM s GROUP BY 1")
def batch_invariants(t: Tables) -> DataFrame:
    return G.subscores(t.traces).groupBy("model").agg(
        F.bool_and(F.col("score").between(0, 1)).alias("in_range"), F.bool_or("is_refusal").alias("has_refusals"), F.bool_and((F.col("format_valid") == 1) | (F.col("score") == 0)).alias("gated")
    )


_BASE = "SELECT *, CASE solver WHEN 'right' THEN gold WHEN 'refuse' THEN 'not_in_the_data' ELSE CASE gold WHEN 'yea' THEN 'nay' WHEN 'nay' THEN 'yea' ELSE 'yea' END END AS answer2 FROM v_traces, (SELECT unnest(['right', 'wrong', 'refuse']) AS solver) z"


@query("baseline_answers", f"SELECT solver, count(*) AS n, count(*) FILTER (WHERE answer2 = gold) AS passed FROM ({_BASE}) x GROUP BY 1")
def baseline_answers(t: Tables) -> DataFrame:
    """Reference solvers: one always right, one well-formed and wrong, one that always refuses."""
    gold = F.col("gold")
    wrong = F.when(gold == "yea", "nay").otherwise("yea")
    solvers = F.array(*[F.struct(F.lit(n).alias("solver"), a.alias("answer")) for n, a in (("right", gold), ("wrong", wrong), ("refuse", F.lit(G.REFUSAL)))])
    rows = t.traces.drop("answer").withColumn("x", F.explode(solvers)).select("*", "x.*")
    return rows.groupBy("solver").agg(F.count("*").alias("n"), F.count(F.when(F.col("answer") == gold, 1)).alias("passed"))


@query("pass_counts", f"WITH {_SCORED} SELECT template_id, is_refusal, count(*) AS n, count(*) FILTER (WHERE score = 1) AS passed, avg(score) AS mean_score, count(*) FILTER (WHERE format_valid = 0) AS malformed FROM s GROUP BY 1, 2")
def pass_counts(t: Tables) -> DataFrame:
    return G.subscores(t.traces).groupBy("template_id", "is_refusal").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("score") == 1, 1)).alias("passed"), F.avg("score").alias("mean_score"), F.count(F.when(F.col("format_valid") == 0, 1)).alias("malformed")
    )


@query("arm_pairs", f"WITH {_ARMS} SELECT * FROM pairs")
def arm_pairs(t: Tables) -> DataFrame:
    return _pairs(t)


@query("rate_ranges", f"WITH {_SCORED}, x AS (SELECT model, surface, template_id, avg(CASE WHEN {_CLASS} = 'correct' THEN 1.0 ELSE 0.0 END) AS rate FROM s WHERE NOT is_refusal GROUP BY 1, 2, 3) SELECT model, surface, avg(rate) AS mean, min(rate) AS low, max(rate) AS high FROM x GROUP BY 1, 2")
def rate_ranges(t: Tables) -> DataFrame:
    runs = G.subscores(t.traces).where("not is_refusal").groupBy("model", "surface", "template_id").agg(F.avg((G.outcome() == "correct").cast("double")).alias("rate"))
    return runs.groupBy("model", "surface").agg(F.avg("rate").alias("mean"), F.min("rate").alias("low"), F.max("rate").alias("high"))
