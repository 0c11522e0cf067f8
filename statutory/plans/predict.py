"""Features, training and evaluation of the passage model over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.operators import predict as P
from statutory.operators.sinks import shared_folder
from statutory.plans.registry import query
from statutory.plans.rollcall import TODAY
from statutory.plans.views import Tables

_FRAME = f"""
c AS (SELECT sp.bill_id, count(DISTINCT sp2.person_id) AS c, count(DISTINCT CASE WHEN p2.party <> p.party THEN sp2.person_id END) AS b FROM v_sponsorships sp JOIN v_people p ON p.id = sp.person_id AND sp.classification = 'primary'
  LEFT JOIN v_sponsorships sp2 ON sp2.bill_id = sp.bill_id AND sp2.classification = 'cosponsor' LEFT JOIN v_people p2 ON p2.id = sp2.person_id GROUP BY 1),
a AS (SELECT bill_id, count(*) AS n, min(action_date) AS d0, max(action_date) AS d1 FROM v_bill_actions GROUP BY 1),
frame AS (SELECT b.id AS bill_id, b.session_id, b.identifier, b.title, b.status, b.introduced_date, s.start_date AS session_start, s.end_date AS session_end, a.d0 AS first_action, a.d1 AS last_action,
  coalesce(c.c, 0) AS cosponsor_count, coalesce(c.b, 0) AS bipartisan_cosponsor_count, coalesce(a.n, 0) AS action_count, CASE WHEN b.status IN ('passed_lower', 'passed_upper', 'enrolled', 'enacted', 'vetoed') THEN 1 ELSE 0 END AS label
  FROM v_bills b JOIN v_sessions s ON s.id = b.session_id LEFT JOIN c ON c.bill_id = b.id LEFT JOIN a ON a.bill_id = b.id
  WHERE s.end_date < DATE '{TODAY}' AND list_contains(b.classification, 'bill') AND b.introduced_date IS NOT NULL AND b.status IS NOT NULL AND b.status <> 'other'
    AND b.jurisdiction_id IN (SELECT id FROM v_jurisdictions WHERE classification = 'country'))"""


def _frame(t: Tables) -> DataFrame:
    federal = t.jurisdictions.where("classification = 'country'")
    return P.training_frame(t.bills, t.sessions, t.sponsorships, t.people, t.bill_actions, TODAY, federal)


@query("training_frame", f"WITH {_FRAME} SELECT * FROM frame")
def training_frame(t: Tables) -> DataFrame:
    return _frame(t)


@query("time_split", f"WITH {_FRAME} SELECT CASE WHEN introduced_date <= DATE '1996-12-31' THEN 'train' WHEN introduced_date <= DATE '1997-12-31' THEN 'validate' ELSE 'test' END AS split, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives FROM frame GROUP BY 1")
def time_split(t: Tables) -> DataFrame:
    split = P.time_split(_frame(t), "introduced_date", "1996-12-31", "1997-12-31")
    return split.groupBy("split").agg(F.count("*").alias("n"), F.sum("label").alias("positives"))


_POSITION = "coalesce(least(greatest(introduced_date - session_start, 0) / CAST(greatest(session_end - session_start, 1) AS DOUBLE), 1.0), 0.5)"


@query("passage_features", f"WITH {_FRAME}, x AS (SELECT *, {_POSITION} AS pos, coalesce(last_action - first_action, 0) AS days, ln(1 + action_count) AS la, ln(1 + cosponsor_count) AS lc FROM frame) SELECT bill_id, cosponsor_count, round(lc, 6) AS log_cosponsor_count, bipartisan_cosponsor_count, action_count, round(la, 6) AS log_action_count, days AS days_active, round(action_count / CAST(greatest(days, 1) AS DOUBLE), 6) AS actions_per_day, round(pos, 6) AS session_position, greatest(session_end - introduced_date, 0) AS days_remaining, CAST(split_part(session_id, '-', 2) AS INT) AS congress_number, CASE WHEN starts_with(upper(identifier), 'HR') THEN 1 ELSE 0 END AS is_house_bill, CASE WHEN regexp_matches(upper(identifier), '^S\\d') THEN 1 ELSE 0 END AS is_senate_bill, length(title) AS title_length, len(string_split(title, ' ')) AS title_word_count, CASE WHEN contains(lower(title), 'appropriat') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), 'authoriz') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), 'reauthoriz') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), 'designat') THEN 1 ELSE 0 END + CASE WHEN contains(lower(title), 'post office') THEN 1 ELSE 0 END AS passage_keyword_count, 1 AS title_has_authoriz, round((1 - pos) * la, 6) AS early_bill_x_actions, round(la * lc, 6) AS action_x_cosponsor FROM x")
def passage_features(t: Tables) -> DataFrame:
    out = P.with_features(_frame(t))
    rounded = {"log_cosponsor_count", "log_action_count", "actions_per_day", "session_position", "early_bill_x_actions", "action_x_cosponsor"}
    return out.select("bill_id", *[F.round(c, 6).alias(c) if c in rounded else F.col(c) for c in P.FEATURES])


def _trained(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = P.time_split(P.with_features(_frame(t)), "introduced_date", "1996-12-31", "1997-12-31")
    return rows.where("split = 'train'"), rows.where("split <> 'train'")


@query("train_baseline")
def train_baseline(t: Tables) -> DataFrame:
    train, rest = _trained(t)
    scored = P.score(P.train_logistic(train), rest)
    return P.auroc(scored, ["split"]).join(P.brier(scored, ["split"]), "split")


#: Folders of the stacks that this process has fitted, by application and data folder.
_STACKS: dict[tuple[str, str], str] = {}


def _stack(t: Tables) -> tuple:
    """The stack as the operator's defaults have it, fitted once a session and saved; every use loads it."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _STACKS:
        path = shared_folder(t.spark)
        _trained(t)[0].write.parquet(f"{path}/rows")  # once, as fitting reads them several times
        P.save_stack(P.train_stack(t.spark.read.parquet(f"{path}/rows")), path)
        _STACKS[key] = path
    return P.load_stack(_STACKS[key])


@query("train_stack")
def train_stack(t: Tables) -> DataFrame:
    return P.auroc(P.score_stack(_stack(t), _trained(t)[1]), ["split"])


@query("score_bills")
def score_bills(t: Tables) -> DataFrame:
    """Every bill's score by the means over the folds and the layer, beside the rate of the bills that were trained on."""
    rate = _trained(t)[0].agg(F.avg("label").alias("base_rate"))
    scored = P.score_stack(_stack(t), P.with_features(_frame(t)))
    return scored.select("bill_id", "p").crossJoin(F.broadcast(rate))


@query("key_factors")
def key_factors(t: Tables) -> DataFrame:
    stack = _stack(t)
    return P.key_factors(stack[1], P.META, P.with_meta(stack, P.with_features(_frame(t))))


_TOY = "(SELECT chamber AS split, id, CAST((CAST(substr(id, 2) AS BIGINT) * 37) % 101 AS DOUBLE) / 101 AS p, CASE WHEN result = 'Passed' THEN 1 ELSE 0 END AS label FROM v_vote_events) s"


def _scores(t: Tables) -> DataFrame:
    """A score from a hash of each event, with ties, and its result as the label."""
    p = ((F.expr("cast(substr(id, 2) as bigint)") * 37) % 101).cast("double") / 101
    return t.vote_events.select(F.col("chamber").alias("split"), "id", p.alias("p"), F.when(F.col("result") == "Passed", 1).otherwise(0).alias("label"))


@query("auroc", f"WITH r AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0 AS r FROM {_TOY}) SELECT split, round((sum(CASE WHEN label = 1 THEN r END) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 9) AS auroc FROM r GROUP BY 1")
def auroc(t: Tables) -> DataFrame:
    return P.auroc(_scores(t), ["split"]).select("split", F.round("auroc", 9).alias("auroc"))


@query("brier", f"SELECT split, round(avg((p - label) ** 2), 9) AS brier, avg(label) AS positive_rate, count(*) AS n FROM {_TOY} GROUP BY 1")
def brier(t: Tables) -> DataFrame:
    return P.brier(_scores(t), ["split"]).withColumn("brier", F.round("brier", 9))


_EDGES = ", ".join(f"quantile_cont(p, {i / 10})" for i in range(1, 10))


@query("calibration", f"WITH e AS (SELECT split, [{_EDGES}] AS edges FROM {_TOY} GROUP BY 1), b AS (SELECT s.*, len(list_filter(e.edges, lambda x: x < s.p)) AS bin FROM {_TOY} JOIN e ON e.split = s.split) SELECT split, CAST(bin AS INT) AS bin, round(avg(p), 9) AS mean_p, avg(label) AS rate, count(*) AS n FROM b GROUP BY 1, 2")
def calibration(t: Tables) -> DataFrame:
    return P.calibration(_scores(t), ["split"]).withColumn("mean_p", F.round("mean_p", 9))


@query("class_report", f"WITH c AS (SELECT split, CAST(count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS DOUBLE) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn FROM {_TOY} GROUP BY 1) SELECT split, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0 END AS f1 FROM c")
def class_report(t: Tables) -> DataFrame:
    return P.class_report(_scores(t), ["split"])


@query("threshold_sweep", f"WITH k AS (SELECT unnest(generate_series(1, 50)) AS k), f AS (SELECT split, k, 2.0 * count(*) FILTER (WHERE floor(round(p * 100, 9)) >= k AND label = 1) / (2.0 * count(*) FILTER (WHERE floor(round(p * 100, 9)) >= k AND label = 1) + count(*) FILTER (WHERE floor(round(p * 100, 9)) >= k AND label = 0) + count(*) FILTER (WHERE floor(round(p * 100, 9)) < k AND label = 1)) AS f1 FROM {_TOY}, k GROUP BY 1, 2) SELECT split, k / 100.0 AS threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round(f1, 12) DESC, k) AS n FROM f) x WHERE n = 1")
def threshold_sweep(t: Tables) -> DataFrame:
    return P.threshold_sweep(_scores(t), ["split"])


@query("best_run", "SELECT template_id, max(cost) AS best FROM v_traces WHERE cost IS NOT NULL GROUP BY 1")
def best_run(t: Tables) -> DataFrame:
    """The best value per template of a metrics log, written as JSON lines and read back."""
    from statutory.operators.sinks import through_json

    log = through_json(t.traces.where("cost is not null").select("template_id", F.col("cost").alias("auroc")))
    return log.groupBy("template_id").agg(F.max("auroc").alias("best"))
