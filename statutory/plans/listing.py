"""Lists, joins, windows, set operations and orders over the views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statutory.operators import listing as L
from statutory.operators import rollcall as R
from statutory.operators import windows as W
from statutory.plans.registry import query
from statutory.plans.views import Tables


def _newest() -> list:
    return [F.desc("created_at"), "id"]


@query("list_bills", "WITH f AS (SELECT * FROM v_bills WHERE status = 'enacted' AND list_contains(subject, 'machinery') AND contains(lower(title), 'authorize')) SELECT id, created_at, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at DESC, id LIMIT 50")
def list_bills(t: Tables) -> DataFrame:
    found = L.filter_bills(t.bills, status="enacted", subject="machinery", text="AUTHORIZE")
    return L.page(found.select("id", "created_at"), _newest(), 50)


@query("list_people", "SELECT id, name FROM v_people WHERE party = 'D' AND current_chamber = 'lower' AND contains(lower(name), 'rep.') ORDER BY name, id")
def list_people(t: Tables) -> DataFrame:
    return t.people.where("party = 'D' and current_chamber = 'lower'").where(L.contains_folded("name", "REP.")).select("id", "name").orderBy("name", "id")


@query("list_jurisdictions", "SELECT j.id, j.name, (SELECT max(start_date) FROM v_sessions) AS latest FROM v_jurisdictions j WHERE classification = 'state' ORDER BY name")
def list_jurisdictions(t: Tables) -> DataFrame:
    latest = t.sessions.agg(F.max("start_date").alias("latest"))
    return t.jurisdictions.where("classification = 'state'").select("id", "name").crossJoin(F.broadcast(latest)).orderBy("name")


@query("date_range", "SELECT id, created_at FROM v_bills WHERE created_at >= TIMESTAMP '1996-01-01' AND created_at <= TIMESTAMP '1997-06-30'")
def date_range(t: Tables) -> DataFrame:
    return L.date_range(t.bills.select("id", "created_at"), "created_at", "1996-01-01", "1997-06-30")


@query("array_contains", "SELECT id FROM v_bills WHERE list_contains(classification, 'bill')")
def array_contains(t: Tables) -> DataFrame:
    return t.bills.where(F.array_contains("classification", "bill")).select("id")


@query("find_people", "SELECT id, name FROM v_people WHERE contains(lower(name), '#0000') AND contains(lower(name), 'rep')")
def find_people(t: Tables) -> DataFrame:
    return L.find_people(t.people, ["#0000", "Rep"]).select("id", "name")


_MATCH = "(s.jurisdiction_id IS NULL OR s.jurisdiction_id = b.jurisdiction_id) AND (s.status IS NULL OR coalesce(s.status = b.status, false)) AND (s.query IS NULL OR contains(lower(b.title), lower(s.query)))"


@query("match_criteria", f"SELECT s.id AS search_id, count(*) AS bills FROM v_saved_searches s JOIN v_bills b ON {_MATCH} GROUP BY 1")
def match_criteria(t: Tables) -> DataFrame:
    """Bills per search; searches are few, a row per saved search, and go to every task."""
    from statutory.operators.changes import matching_bills

    return matching_bills(t.saved_searches, t.bills).groupBy("search_id").agg(F.count("*").alias("bills"))


@query("list_vote_events", "SELECT e.id, e.chamber, yes_count, no_count FROM v_vote_events e JOIN v_bills b ON b.id = e.bill_id WHERE b.session_id = 'us-111' AND yes_count IS NOT NULL AND no_count IS NOT NULL ORDER BY e.id")
def list_vote_events(t: Tables) -> DataFrame:
    known = R.with_congress(t.vote_events, t.bills).where("session_id = 'us-111'").dropna(subset=["yes_count", "no_count"])
    return known.select("id", "chamber", "yes_count", "no_count").orderBy("id")


@query("list_deliveries", "SELECT id, endpoint_id, attempted_at, status FROM v_deliveries ORDER BY attempted_at DESC, CAST(id AS BIGINT) LIMIT 200")
def list_deliveries(t: Tables) -> DataFrame:
    return t.deliveries.select("id", "endpoint_id", "attempted_at", "status").orderBy(F.desc("attempted_at"), F.col("id").cast("long")).limit(200)


@query("list_searches", "SELECT org_id, id, CAST(row_number() OVER (PARTITION BY org_id ORDER BY CAST(substr(id, 2) AS INT) DESC) AS INT) AS rank FROM v_saved_searches")
def list_searches(t: Tables) -> DataFrame:
    order = Window.partitionBy("org_id").orderBy(F.expr("cast(substr(id, 2) as int)").desc())
    return t.saved_searches.select("org_id", "id", F.row_number().over(order).alias("rank"))


@query("list_analyses", "SELECT id, template_id, model FROM (SELECT *, CAST(event_id AS VARCHAR) AS id, event_type AS template_id, CASE WHEN event_id % 2 = 0 THEN 'small' ELSE 'large' END AS model FROM events) x WHERE template_id = 'click' AND model = 'small' ORDER BY ts DESC, event_id LIMIT 100")
def list_analyses(t: Tables) -> DataFrame:
    """Events stand for analyses: of one type and model, newest first."""
    rows = t.events.where("event_type = 'click'").where(F.col("event_id") % 2 == 0).orderBy(F.desc("ts"), "event_id").limit(100)
    return rows.select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("template_id"), F.lit("small").alias("model"))


@query("person_votes", "SELECT r.person_id, r.vote_event_id, e.vote_date, r.option, b.identifier, s.identifier AS session FROM v_vote_records r JOIN v_vote_events e ON e.id = r.vote_event_id JOIN v_bills b ON b.id = e.bill_id JOIN v_sessions s ON s.id = b.session_id")
def person_votes(t: Tables) -> DataFrame:
    bills = t.bills.select(F.col("id").alias("bill_id"), "identifier", "session_id")
    sessions = t.sessions.select(F.col("id").alias("session_id"), F.col("identifier").alias("session"))
    joined = R.dated_votes(t.vote_records, t.vote_events).join(bills, "bill_id").join(F.broadcast(sessions), "session_id")
    return joined.select("person_id", "vote_event_id", "vote_date", "option", "identifier", "session")


@query("left_counts", "SELECT b.id, coalesce(a.n, 0) AS actions, coalesce(s.n, 0) AS sponsors FROM v_bills b LEFT JOIN (SELECT bill_id, count(*) AS n FROM v_bill_actions GROUP BY 1) a ON a.bill_id = b.id LEFT JOIN (SELECT bill_id, count(*) AS n FROM v_sponsorships GROUP BY 1) s ON s.bill_id = b.id")
def left_counts(t: Tables) -> DataFrame:
    count = lambda rows, name: rows.groupBy(F.col("bill_id").alias("id")).agg(F.count("*").alias(name))
    out = t.bills.select("id").join(count(t.bill_actions, "actions"), "id", "left").join(count(t.sponsorships, "sponsors"), "id", "left")
    return out.na.fill(0, ["actions", "sponsors"])


@query("id_crosswalk", "SELECT r.vote_event_id, r.person_id AS lis, CASE WHEN CAST(r.person_id AS BIGINT) % 6 <> 0 THEN 'B' || r.person_id END AS bioguide, CASE WHEN CAST(r.person_id AS BIGINT) % 6 <> 0 THEN p.id END AS person_id FROM v_vote_records r LEFT JOIN v_people p ON p.id = r.person_id")
def id_crosswalk(t: Tables) -> DataFrame:
    """Votes by one id, through a table of a second id that lacks some, to people."""
    known = t.people.where(F.col("id").cast("long") % 6 != 0)
    first = known.select(F.col("id").alias("lis"), F.concat(F.lit("B"), "id").alias("bioguide"))
    second = t.people.select(F.concat(F.lit("B"), "id").alias("bioguide"), F.col("id").alias("person_id"))
    return t.vote_records.select("vote_event_id", F.col("person_id").alias("lis")).join(first, "lis", "left").join(second, "bioguide", "left")


@query("sponsor_features", "SELECT sp.bill_id, arg_min(p.party, p.id) AS sponsor_party, count(DISTINCT sp2.person_id) AS cosponsor_count, count(DISTINCT CASE WHEN p2.party <> p.party THEN sp2.person_id END) AS bipartisan_cosponsor_count FROM v_sponsorships sp JOIN v_people p ON p.id = sp.person_id AND sp.classification = 'primary' LEFT JOIN v_sponsorships sp2 ON sp2.bill_id = sp.bill_id AND sp2.classification = 'cosponsor' LEFT JOIN v_people p2 ON p2.id = sp2.person_id GROUP BY 1")
def sponsor_features(t: Tables) -> DataFrame:
    from statutory.operators.predict import sponsor_features as features

    return features(t.sponsorships, t.people)


@query("bill_detail", """SELECT b.id AS bill_id, b.identifier, b.title,
coalesce((SELECT string_agg(id || ':' || version_name, ';' ORDER BY version_date, id) FROM v_bill_texts t WHERE t.bill_id = b.id), '') AS texts,
coalesce((SELECT string_agg(CAST(action_order AS VARCHAR) || ':' || description, ';' ORDER BY action_order, action_date, description) FROM v_bill_actions a WHERE a.bill_id = b.id), '') AS actions,
coalesce((SELECT string_agg(classification || ':' || person_id, ';' ORDER BY classification, person_id) FROM v_sponsorships s WHERE s.bill_id = b.id), '') AS sponsors FROM v_bills b""")
def bill_detail(t: Tables) -> DataFrame:
    out = L.bill_detail(t.bills, t.bill_texts, t.bill_actions, t.sponsorships, t.people)
    text = lambda c, a, b: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x[a].cast("string"), x[b])), ";").alias(c)
    return out.select("bill_id", "identifier", "title", text("texts", "id", "version_name"), text("actions", "action_order", "description"), text("sponsors", "classification", "person_id"))


@query("bill_votes_nested", "SELECT e.bill_id, e.id, count(r.person_id) AS n, coalesce(string_agg(r.person_id || '=' || r.option, ',' ORDER BY r.person_id), '') AS voters FROM v_vote_events e LEFT JOIN v_vote_records r ON r.vote_event_id = e.id GROUP BY 1, 2")
def bill_votes_nested(t: Tables) -> DataFrame:
    voters = L.nested(t.vote_records.withColumnRenamed("vote_event_id", "id"), "id", ["person_id", "option"], "voters")
    out = t.vote_events.select("bill_id", "id").join(voters, "id", "left")
    return out.select("bill_id", "id", F.coalesce(F.size("voters"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.transform("voters", lambda v: F.concat_ws("=", v["person_id"], v["option"])), ","), F.lit("")).alias("voters"))


@query("bill_cosponsors", "SELECT DISTINCT s.bill_id, s.person_id, p.name FROM v_sponsorships s JOIN v_people p ON p.id = s.person_id WHERE s.classification IN ('cosponsor', 'original-cosponsor')")
def bill_cosponsors(t: Tables) -> DataFrame:
    people = t.people.select(F.col("id").alias("person_id"), "name")
    return t.sponsorships.where(F.col("classification").isin("cosponsor", "original-cosponsor")).join(people, "person_id").select("bill_id", "person_id", "name").distinct()


@query("member_sponsorships", "SELECT DISTINCT s.person_id, s.bill_id, b.session_id FROM v_sponsorships s JOIN v_bills b ON b.id = s.bill_id WHERE s.classification = 'primary'")
def member_sponsorships(t: Tables) -> DataFrame:
    bills = t.bills.select(F.col("id").alias("bill_id"), "session_id")
    return t.sponsorships.where("classification = 'primary'").join(bills, "bill_id").select("person_id", "bill_id", "session_id").distinct()


@query("lookup_status", "WITH k AS (SELECT id FROM v_bills UNION ALL SELECT 'none' || id FROM v_people), v AS (SELECT bill_id, count(*) AS n FROM v_vote_events GROUP BY 1) SELECT k.id, CASE WHEN b.id IS NULL THEN 'missing' WHEN v.n IS NULL THEN 'empty' ELSE 'found' END AS status, coalesce(v.n, 0) AS n FROM k LEFT JOIN v_bills b ON b.id = k.id LEFT JOIN v ON v.bill_id = k.id")
def lookup_status(t: Tables) -> DataFrame:
    """Requested keys: found, known without rows, or unknown."""
    keys = t.bills.select("id").union(t.people.select(F.concat(F.lit("none"), "id")))
    known = t.bills.select("id", F.lit(True).alias("known"))
    counts = t.vote_events.groupBy(F.col("bill_id").alias("id")).agg(F.count("*").alias("n"))
    out = keys.join(known, "id", "left").join(counts, "id", "left")
    status = F.when(F.col("known").isNull(), "missing").when(F.col("n").isNull(), "empty").otherwise("found")
    return out.select("id", status.alias("status"), F.coalesce("n", F.lit(0)).alias("n"))


@query("member_record", "SELECT r.person_id, CAST(split_part(b.session_id, '-', 2) AS INT) AS congress, e.chamber, r.vote_event_id, r.option FROM v_vote_records r JOIN v_vote_events e ON e.id = r.vote_event_id JOIN v_bills b ON b.id = e.bill_id")
def member_record(t: Tables) -> DataFrame:
    events = R.with_congress(t.vote_events, t.bills).select(F.col("id").alias("vote_event_id"), "congress", "chamber")
    return t.vote_records.join(events, "vote_event_id").select("person_id", "congress", "chamber", "vote_event_id", "option")


_HELD = "(SELECT * FROM v_bill_texts WHERE coalesce(content_text, '') <> '') t"


@query("first_text", f"SELECT bill_id, substr(arg_min(content_text, struct_pack(a := version_date, b := id)), 1, 5000) AS text FROM {_HELD} GROUP BY 1")
def first_text(t: Tables) -> DataFrame:
    return W.first_text(t.bill_texts)


@query("best_text", f"SELECT b.id, coalesce(x.text, b.title) AS text FROM v_bills b LEFT JOIN (SELECT bill_id, substr(arg_min(content_text, struct_pack(a := version_date, b := id)), 1, 5000) AS text FROM {_HELD} GROUP BY 1) x ON x.bill_id = b.id")
def best_text(t: Tables) -> DataFrame:
    return t.bills.join(W.first_text(t.bill_texts).withColumnRenamed("bill_id", "id"), "id", "left").select("id", F.coalesce("text", "title").alias("text"))


@query("version_pair", f"SELECT bill_id, arg_min(id, struct_pack(a := version_date, b := id)) AS oldest, arg_max(id, struct_pack(a := version_date, b := id)) AS newest FROM {_HELD} GROUP BY 1 HAVING count(*) >= 2")
def version_pair(t: Tables) -> DataFrame:
    return W.version_pair(t.bill_texts)


@query("latest_summary", "WITH a AS (SELECT bill_id, created_at, CASE WHEN value > 3 THEN props END AS summary FROM v_change_events) SELECT bill_id, arg_max(coalesce(summary, ''), struct_pack(a := created_at, b := coalesce(summary, ''))) AS latest, max(CASE WHEN summary IS NOT NULL THEN created_at END) AS latest_held FROM a GROUP BY 1")
def latest_summary(t: Tables) -> DataFrame:
    """The latest summary even if it is empty, and the time of the latest that is not."""
    rows = t.change_events.select("bill_id", "created_at", F.when(F.col("value") > 3, F.col("props")).alias("summary"))
    text = F.coalesce("summary", F.lit(""))
    return rows.groupBy("bill_id").agg(F.max_by(text, F.struct("created_at", text)).alias("latest"), F.max(F.when(F.col("summary").isNotNull(), F.col("created_at"))).alias("latest_held"))


@query("build_spans", "WITH t AS (SELECT person_id, party, start_date, CAST(end_date + INTERVAL 20 DAY AS DATE) AS end_date FROM v_party_spans) SELECT person_id, party, start_date, CAST(least(coalesce(lead(start_date) OVER (PARTITION BY person_id ORDER BY start_date), DATE '9999-01-01'), CAST(end_date + INTERVAL 1 DAY AS DATE)) AS DATE) AS end_date FROM t")
def build_spans(t: Tables) -> DataFrame:
    return W.build_spans(t.party_spans.withColumn("end_date", F.date_add("end_date", 20)))


@query("hash_sample", "SELECT vote_event_id, person_id FROM v_vote_records ORDER BY sha256('7:' || vote_event_id || ':' || person_id), vote_event_id, person_id LIMIT 100")
def hash_sample(t: Tables) -> DataFrame:
    return W.hash_sample(t.vote_records.select("vote_event_id", "person_id"), 7, ["vote_event_id", "person_id"], 100)


@query("disjoint_pairs", "SELECT party, (n - 1) // 2 AS pair, min(id) AS a, max(id) AS b FROM (SELECT party, id, row_number() OVER (PARTITION BY party ORDER BY sha256('3:' || id), id) AS n FROM v_people) x GROUP BY 1, 2 HAVING count(*) = 2")
def disjoint_pairs(t: Tables) -> DataFrame:
    return W.disjoint_pairs(t.people, ["party"], "id", 3)


@query("stratify_rr", "SELECT person_id, vote_event_id, CAST(d AS INT) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY sha256('5:' || vote_event_id), vote_event_id) AS d FROM v_vote_records) x ORDER BY d, person_id, vote_event_id LIMIT 150")
def stratify_rr(t: Tables) -> DataFrame:
    return W.round_robin(t.vote_records.select("person_id", "vote_event_id"), "person_id", "vote_event_id", 5, 150)


@query("stratify_two", "WITH b AS (SELECT id, status = 'vetoed' OR id LIKE '%77%' AS clean FROM (SELECT id, coalesce(status, 'none') AS status FROM v_bills) y), r AS (SELECT *, row_number() OVER (PARTITION BY clean ORDER BY sha256('9:' || id), id) AS n FROM b), s AS (SELECT count(*) FILTER (WHERE clean) AS y, count(*) FILTER (WHERE NOT clean) AS o FROM b) SELECT id, clean FROM r, s WHERE n <= CASE WHEN clean THEN least(y, greatest(500, 1000 - o)) ELSE least(o, greatest(500, 1000 - y)) END")
def stratify_two(t: Tables) -> DataFrame:
    pools = t.bills.select("id", ((F.coalesce("status", F.lit("none")) == "vetoed") | F.contains("id", F.lit("77"))).alias("clean"))
    return W.balanced_pools(pools, "clean", "id", 9, 1000)


@query("trim_history", "WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS f, coalesce(length(text), 0) AS n FROM conversations), y AS (SELECT *, sum(CASE WHEN f THEN 0 ELSE n END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) + sum(CASE WHEN f THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS used FROM x) SELECT conv_id, turn FROM y WHERE f OR used <= 1500")
def trim_history(t: Tables) -> DataFrame:
    return W.trim_history(t.conversations, 1500).select("conv_id", "turn")


@query("action_order", "SELECT id, CAST(unnest(generate_series(1, len(subject))) AS INT) - 1 AS place, unnest(subject) AS subject FROM v_bills")
def action_order(t: Tables) -> DataFrame:
    """The ordinal of every list element, from 0."""
    return t.bills.select("id", F.posexplode("subject").alias("place", "subject"))


@query("latest_generation", "SELECT bill_id, arg_max(created_at, struct_pack(a := created_at, b := value)) AS created_at, arg_max(value, struct_pack(a := created_at, b := value)) AS value FROM v_change_events WHERE change_type = 'updated' GROUP BY 1")
def latest_generation(t: Tables) -> DataFrame:
    order = F.struct("created_at", "value")
    return t.change_events.where("change_type = 'updated'").groupBy("bill_id").agg(F.max_by("created_at", order).alias("created_at"), F.max_by("value", order).alias("value"))


@query("revision_history", "SELECT event_id, bill_id, CAST(row_number() OVER (PARTITION BY bill_id ORDER BY created_at DESC, event_id DESC) AS INT) AS rank FROM v_change_events")
def revision_history(t: Tables) -> DataFrame:
    order = Window.partitionBy("bill_id").orderBy(F.desc("created_at"), F.desc("event_id"))
    return t.change_events.select("event_id", "bill_id", F.row_number().over(order).alias("rank"))


@query("page_total", "SELECT id, created_at, (SELECT count(*) FROM v_bills) AS total FROM v_bills ORDER BY created_at DESC, id LIMIT 25 OFFSET 50")
def page_total(t: Tables) -> DataFrame:
    return L.page(t.bills.select("id", "created_at"), _newest(), 25, 50)


@query("nulls_last", "SELECT id, status_date FROM v_bills ORDER BY status_date DESC NULLS LAST, id LIMIT 400")
def nulls_last(t: Tables) -> DataFrame:
    return t.bills.select("id", "status_date").orderBy(F.desc_nulls_last("status_date"), "id").limit(400)


@query("union_frames", "SELECT id, 'first' AS part FROM v_bills WHERE status = 'enacted' UNION ALL SELECT id, 'second' FROM v_bills WHERE status = 'failed'")
def union_frames(t: Tables) -> DataFrame:
    part = lambda status, name: t.bills.where(F.col("status") == status).select("id", F.lit(name).alias("part"))
    return part("enacted", "first").unionByName(part("failed", "second"))


@query("set_equal", "SELECT id, array_to_string(list_sort(list_distinct(list_transform(subject, lambda x: lower(trim(x))))), ',') = array_to_string(list_sort(list_distinct(list_transform(list_reverse(subject), lambda x: lower(trim(' ' || upper(x)))))), ',') AS same FROM v_bills WHERE subject IS NOT NULL")
def set_equal(t: Tables) -> DataFrame:
    fold = lambda c: F.array_sort(F.array_distinct(F.transform(c, lambda x: F.lower(F.trim(x)))))
    other = F.transform(F.reverse("subject"), lambda x: F.concat(F.lit(" "), F.upper(x)))
    return t.bills.where("subject is not null").select("id", (fold("subject") == fold(other)).alias("same"))


@query("singletons", "SELECT coalesce(a.instance_id, b.instance_id) AS instance_id, a.instance_id IS NOT NULL AS small FROM (SELECT DISTINCT instance_id FROM v_traces WHERE model = 'small') a FULL JOIN (SELECT DISTINCT instance_id FROM v_traces WHERE model = 'large') b ON a.instance_id = b.instance_id WHERE a.instance_id IS NULL OR b.instance_id IS NULL")
def singletons(t: Tables) -> DataFrame:
    """Instances that only one arm ran."""
    side = lambda model, name: t.traces.where(F.col("model") == model).select("instance_id").distinct().withColumn(name, F.lit(True))
    both = side("small", "a").join(side("large", "b"), "instance_id", "full")
    return both.where("a is null or b is null").select("instance_id", F.col("a").isNotNull().alias("small"))
