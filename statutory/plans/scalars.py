"""Scalar functions over whole views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statutory.functions import text as T
from statutory.plans.registry import query
from statutory.plans.views import Tables


def _case(column: str, pairs: dict[str, str], otherwise: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {otherwise} END"


def _status_sql(column: str) -> str:
    tests = " ".join(f"WHEN contains(lower(trim({column})), '{p}') THEN '{s}'" for p, s in T.STATUS_PATTERNS)
    return f"CASE WHEN {column} IS NULL THEN NULL {tests} ELSE 'other' END"


@query("stable_id", "SELECT id, substr(sha256(concat_ws(':', jurisdiction_id, session_id, identifier)), 1, 16) AS stable_id FROM v_bills")
def stable_id(t: Tables) -> DataFrame:
    return t.bills.select("id", T.stable_id("jurisdiction_id", "session_id", "identifier").alias("stable_id"))


@query("content_hash", "SELECT id, sha256(content_text) AS content_hash, sha256('v2:' || content_text) AS prompt_hash FROM v_bill_texts")
def content_hash(t: Tables) -> DataFrame:
    return t.bill_texts.select("id", T.content_hash("content_text").alias("content_hash"), T.content_hash("content_text", "v2").alias("prompt_hash"))


@query("norm_identifier", "SELECT id, upper(trim(regexp_replace(replace(substr(identifier, 1, 1) || '.  ' || substr(identifier, 2), '.', ''), '\\s+', ' ', 'g'))) AS identifier FROM v_bills")
def norm_identifier(t: Tables) -> DataFrame:
    spaced = F.concat(F.substring("identifier", 1, 1), F.lit(".  "), F.expr("substr(identifier, 2)"))
    return t.bills.select("id", T.norm_identifier(spaced).alias("identifier"))


@query("norm_status", f"SELECT bill_id, action_order, {_status_sql('description')} AS status FROM v_bill_actions")
def norm_status(t: Tables) -> DataFrame:
    return t.bill_actions.select("bill_id", "action_order", T.norm_status("description").alias("status"))


@query("map_status_code", f"SELECT id, {_case('CAST(CAST(id AS BIGINT) % 9 AS VARCHAR)', T.STATUS_CODES, chr(39) + 'other' + chr(39))} AS status FROM v_bills")
def map_status_code(t: Tables) -> DataFrame:
    return t.bills.select("id", T.map_status_code(F.col("id").cast("long") % 9).alias("status"))


@query("word_count", "SELECT id, CASE WHEN content_text = '' THEN NULL WHEN regexp_replace(content_text, '^\\s+|\\s+$', '', 'g') = '' THEN 0 ELSE len(regexp_split_to_array(regexp_replace(content_text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END AS words FROM v_bill_texts")
def word_count(t: Tables) -> DataFrame:
    return t.bill_texts.select("id", T.word_count("content_text").alias("words"))


@query("vote_ref", "SELECT id, upper(regexp_replace(replace(identifier, 'HR', 'H. R. '), '[\\s.]', '', 'g')) AS ref, regexp_full_match(upper(regexp_replace(replace(identifier, 'HR', 'H. R. '), '[\\s.]', '', 'g')), '(HCONRES|HJRES|SCONRES|SJRES|HRES|SRES|HR|S)\\d+') AS is_bill FROM v_bills")
def vote_ref(t: Tables) -> DataFrame:
    raw = F.replace("identifier", F.lit("HR"), F.lit("H. R. "))
    return t.bills.select("id", T.vote_ref(raw).alias("ref"), T.is_bill_ref(raw).alias("is_bill"))


_RAW_OPTION = "CASE option WHEN 'yea' THEN 'Aye' WHEN 'nay' THEN ' No' WHEN 'present' THEN 'Present' ELSE 'Absent' END"


@query("vote_option", f"SELECT vote_event_id, person_id, {_case(f'trim({_RAW_OPTION})', T.VOTE_OPTIONS)} AS option FROM v_vote_records")
def vote_option(t: Tables) -> DataFrame:
    return t.vote_records.select("vote_event_id", "person_id", T.vote_option(F.expr(_RAW_OPTION)).alias("option"))


@query("event_id", "SELECT id, printf('us-house-%d-%d-%04d', CAST(year(vote_date) - 1885 AS BIGINT), year(vote_date), CAST(substr(id, 2) AS BIGINT) % 10000) AS house_id, CAST(year(vote_date) AS INT) AS year, CAST(CAST(substr(id, 2) AS BIGINT) % 10000 AS INT) AS roll FROM v_vote_events")
def event_id(t: Tables) -> DataFrame:
    year = F.year("vote_date")
    out = t.vote_events.select("id", T.house_event_id(year - 1885, year, F.expr("cast(substr(id, 2) as bigint) % 10000")).alias("house_id"))
    return out.select("id", "house_id", T.event_id_parts("house_id")[0].alias("year"), T.event_id_parts("house_id")[1].alias("roll"))


@query("congress_years", "SELECT id, CAST(2007 + 2 * (CAST(identifier AS INT) - 110) AS INT) AS first_year, CAST(2008 + 2 * (CAST(identifier AS INT) - 110) AS INT) AS last_year FROM v_sessions")
def congress_years(t: Tables) -> DataFrame:
    return t.sessions.withColumn("years", T.congress_years("identifier")).select("id", F.col("years")[0].alias("first_year"), F.col("years")[1].alias("last_year"))


@query("parse_dates", "SELECT id, status_date AS iso, status_date AS us, status_date AS action, status_date AS long, CAST(NULL AS DATE) AS bad FROM v_bills")
def parse_dates(t: Tables) -> DataFrame:
    d = F.col("status_date")
    return t.bills.select(
        "id",
        T.parse_date(F.concat(d.cast("string"), F.lit("T10:00:00"))).alias("iso"),
        T.parse_date(F.date_format(d, "M/d/yyyy")).alias("us"),
        T.parse_date(F.date_format(d, "dd-MMM-yyyy")).alias("action"),
        T.parse_date(F.date_format(d, "MMMM d, yyyy',  10:00 AM'")).alias("long"),
        T.parse_date(F.concat(F.lit("soon "), d.cast("string"))).alias("bad"),
    )


@query("norm_chamber", f"SELECT id, {_case('lower(trim(upper(substr(chamber, 1, 1)) || chr(32)))', T.CHAMBERS)} AS chamber, 'upper house' AS other FROM v_vote_events")
def norm_chamber(t: Tables) -> DataFrame:
    short = F.concat(F.upper(F.substring("chamber", 1, 1)), F.lit(" "))
    return t.vote_events.select("id", T.norm_chamber(short).alias("chamber"), T.norm_chamber(F.lit("Upper House")).alias("other"))


@query("parse_package", "SELECT id, 119 AS congress, regexp_extract(lower(identifier), '^([a-z]+)', 1) AS doc_class, regexp_extract(identifier, '(\\d+)$', 1) AS number, 'ih' AS version, regexp_extract(lower(identifier), '^([a-z]+)', 1) AS kind FROM v_bills")
def parse_package(t: Tables) -> DataFrame:
    low = F.lower("identifier")
    name = F.concat(F.lit("BILLS-119"), low, F.lit("ih.xml"))
    return t.bills.withColumn("p", T.package_parts(name)).select("id", "p.*", T.split_bill_id(F.concat(low, F.lit("-119")))[0].alias("kind"))


@query("refs_regulatory", "SELECT id, list_sort(['HR ' || id, 'PL 118-5', 'S ' || id]) AS refs FROM v_bills")
def refs_regulatory(t: Tables) -> DataFrame:
    """Texts that mention two bills, a section, a simple resolution and a law; the result is the sorted references."""
    made = F.concat(F.lit("See H.R. "), "id", F.lit(", Section 5, h r "), "id", F.lit(", H.Res. 9, S. "), "id", F.lit(" and Public Law 118-5: "), "title")
    return t.bills.select("id", T.references_in_rules(made).alias("refs"))


@query("refs_reports", "SELECT id, ['SRES ' || id, 'HR ' || id] AS refs FROM v_bills")
def refs_reports(t: Tables) -> DataFrame:
    made = F.concat(F.lit("On S.Res. "), "id", F.lit(" and H.R. "), "id", F.lit(", HR 7; again S.Res. "), "id")
    return t.bills.select("id", T.references_in_reports(made).alias("refs"))


@query("name_parts", "SELECT id, trim(regexp_replace(name, '\\s*\\[[^\\]]*\\]\\s*$', '')) AS bare, CASE WHEN party = 'ID' THEN 'I' ELSE party END AS party, array_to_string(list_filter(regexp_split_to_array(trim(replace(lower(regexp_replace(regexp_replace(name, '\\[.*?\\]', ' ', 'g'), '^\\s*\\w+\\.\\s+', ' ')), ',', ' ')), '\\s+'), lambda w: regexp_full_match(w, '[a-z]+')), ' ') AS tokens FROM v_people")
def name_parts(t: Tables) -> DataFrame:
    return t.people.select(
        "id", T.strip_party_tag("name").alias("bare"), T.current_party("party").alias("party"), F.array_join(T.core_name_tokens("name"), " ").alias("tokens")
    )


@query("fold_answers", "SELECT p.id, CASE WHEN s.p IN ('D', 'I') THEN s.p ELSE 'R' END AS party, 'not_voting' AS option, CAST(p.id AS BIGINT) AS n, CAST(NULL AS BIGINT) AS bad FROM v_people p JOIN (SELECT id, CASE WHEN party = 'ID' THEN 'I' ELSE party END AS p FROM v_people) s USING (id)")
def fold_answers(t: Tables) -> DataFrame:
    said = F.when(F.col("party") == "D", "Democratic Party").when(F.col("party") == "ID", " independent").otherwise("GOP")
    return t.people.select(
        "id", T.fold_party(said).alias("party"), T.fold_option(F.lit("Not Voting ")).alias("option"),
        T.strict_int(F.concat(F.lit(" "), "id")).alias("n"), T.strict_int(F.concat("id", F.lit(".0"))).alias("bad"),
    )


@query("csv_guard", "SELECT id, CASE WHEN CAST(id AS BIGINT) % 4 = 3 THEN title ELSE '''' || substr('=+-', CAST(CAST(id AS BIGINT) % 4 AS INT) + 1, 1) || title END AS cell FROM v_bills")
def csv_guard(t: Tables) -> DataFrame:
    cell = F.concat(F.expr("substr('=+-', cast(cast(id as bigint) % 4 as int) + 1, 1)"), "title")
    return t.bills.select("id", T.csv_guard(cell).alias("cell"))


@query("like_escape", "SELECT id, replace(replace(replace(title || '_50%', '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS pattern, contains(lower(title), 'machin') AS found FROM v_bills")
def like_escape(t: Tables) -> DataFrame:
    return t.bills.select("id", T.escape_like(F.concat("title", F.lit("_50%"))).alias("pattern"), T.contains_folded("title", "MACHIN").alias("found"))


_CHARS = "map([" + ", ".join(f"'{k}'" for k in T.REFERENCES) + "], [" + ", ".join("chr(" + str(ord(v)) + ")" for v in T.REFERENCES.values()) + "])"
# pages hold few references, so each gets some more of them: known, unknown, numbered, doubled and out of range
_MORE = "<p>&#8212;&apos;&sect; 2&amp;lt; &#x1F600;&bogus; & &#0; &#55296; &#38;amp;<b>bold</b>tail</p>"
_BARE = rf"regexp_replace(coalesce(html, '') || '{_MORE}', '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>', chr(10), 'g')"
_CODE = "CASE WHEN regexp_matches(n, '^#[xX]') THEN CAST('0x' || substr(n, 3) AS BIGINT) WHEN starts_with(n, '#') THEN CAST(substr(n, 2) AS BIGINT) END"


@query("strip_markup", rf"""WITH parts AS (SELECT page_id, string_split({_BARE}, '&') AS parts FROM pages),
named AS (SELECT page_id, i, x, regexp_extract(x, '^(#[xX][0-9a-fA-F]{{1,6}}|#[0-9]{{1,7}}|[A-Za-z][A-Za-z0-9]*);', 1) AS n FROM (SELECT page_id, unnest(range(1, len(parts) + 1)) AS i, unnest(parts) AS x FROM parts) y),
coded AS (SELECT *, {_CODE} AS code FROM named),
chars AS (SELECT *, CASE WHEN code BETWEEN 1 AND 55295 OR code BETWEEN 57344 AND 1114111 THEN chr(CAST(code AS INT)) WHEN code IS NULL THEN {_CHARS}[n] END AS c FROM coded),
joined AS (SELECT page_id, string_agg(CASE WHEN i = 1 THEN x WHEN c IS NULL THEN '&' || x ELSE c || substr(x, length(n) + 2) END, '' ORDER BY i) AS text FROM chars GROUP BY 1)
SELECT page_id, coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> ''), chr(10)), '') AS text FROM joined""")
def strip_markup(t: Tables) -> DataFrame:
    return t.pages.select("page_id", T.plain_text(F.concat(F.coalesce("html", F.lit("")), F.lit(_MORE))).alias("text"))


@query("text_title", "SELECT conv_id, turn, CASE WHEN s = '' THEN 'Untitled conversation' WHEN instr(s, '.') BETWEEN 2 AND 80 THEN substr(s, 1, CAST(instr(s, '.') AS INT)) WHEN instr(s, '?') BETWEEN 2 AND 80 THEN substr(s, 1, CAST(instr(s, '?') AS INT)) WHEN instr(s, '!') BETWEEN 2 AND 80 THEN substr(s, 1, CAST(instr(s, '!') AS INT)) WHEN length(s) > 80 THEN substr(s, 1, 80) || '...' ELSE s END AS title, substr(text, 1, 200) AS snippet FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS s FROM conversations)")
def text_title(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", T.message_title("text").alias("title"), F.substring("text", 1, 200).alias("snippet"))


@query("token_cost", "SELECT template_id, instance_id, model, CASE WHEN cost IS NOT NULL THEN cost ELSE round((input_tokens * CASE model WHEN 'small' THEN 3.0 ELSE 15.0 END + output_tokens * CASE model WHEN 'small' THEN 15.0 ELSE 75.0 END) / 1e6, 6) END AS cost, CASE WHEN cost IS NOT NULL THEN 'real' ELSE 'proxy' END AS source, input_tokens, output_tokens FROM v_traces")
def token_cost(t: Tables) -> DataFrame:
    from statutory.operators.grading import rollout_costs

    out = rollout_costs(t.traces)
    return out.select("template_id", "instance_id", "model", F.when(F.col("cost_source") == "real", F.col("usable_cost")).otherwise(F.round("usable_cost", 6)).alias("cost"), F.col("cost_source").alias("source"), "input_tokens", "output_tokens")


@query("state_map", "SELECT id, 'us-' || lower(abbreviation) AS jurisdiction_id, " + _case("upper(abbreviation)", T.STATES) + " AS state_name FROM v_jurisdictions WHERE " + _case("upper(abbreviation)", T.STATES) + " IS NOT NULL")
def state_map(t: Tables) -> DataFrame:
    known = t.jurisdictions.withColumn("state_name", T.mapped(F.upper("abbreviation"), T.STATES)).where("state_name is not null")
    return known.select("id", F.concat(F.lit("us-"), F.lower("abbreviation")).alias("jurisdiction_id"), "state_name")


@query("month_cutoff", "SELECT id, CAST(date_trunc('month', introduced_date - INTERVAL 6 MONTH) AS DATE) AS cutoff FROM v_bills")
def month_cutoff(t: Tables) -> DataFrame:
    return t.bills.select("id", T.month_cutoff("introduced_date", 6).alias("cutoff"))


_KEY = "regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


@query("json_from_text", f"""SELECT id, CASE WHEN k IN (3, 4) THEN 0 ELSE 2 END AS n, CASE WHEN k IN (3, 4) THEN NULL WHEN k = 0 THEN 'given' ELSE substr({_KEY}, 1, 100) END AS first_key,
  CASE WHEN k IN (3, 4) THEN NULL ELSE 'section_1' END AS second_key, CASE WHEN k IN (3, 4) THEN NULL ELSE 'Section 2' END AS second_heading,
  CASE WHEN k IN (3, 4) THEN NULL WHEN k = 1 THEN 'No purpose provided' ELSE substr(repeat(title, 40), 1, 1000) END AS purpose,
  CASE WHEN k IN (3, 4) THEN NULL WHEN k = 0 THEN title WHEN k = 1 THEN '' ELSE 'a|b|c|d|e' END AS notes, CASE WHEN k IN (3, 4) THEN NULL WHEN k = 2 THEN '1|2|3|4|5' ELSE '' END AS bills,
  CASE WHEN k = 3 THEN 'no outline: ' || title WHEN k = 4 THEN 'Unable to parse outline.' WHEN k = 2 THEN '0|1|2|3|4|5|6|7|8|9' ELSE '' END AS drafting, CASE WHEN k IN (3, 4) THEN 0.0 WHEN k = 0 THEN 0.25 ELSE 0.7 END AS confidence
FROM (SELECT *, CAST(id AS BIGINT) % 5 AS k FROM v_bills) b""")
def json_from_text(t: Tables) -> DataFrame:
    """Outlines as they come back: plain, in a fenced block, unreadable, empty; with keys, notes and lists present, missing or of another type."""
    k = F.col("id").cast("long") % 5
    quoted = F.concat(F.lit('"'), "title", F.lit('"'))
    long = F.concat(F.lit('"'), F.repeat("title", F.lit(40)), F.lit('"'))
    plain = F.concat(F.lit('{"sections": [{"section_key": "given", "heading": '), quoted, F.lit(', "purpose": '), long, F.lit(', "source_notes": '), quoted, F.lit(', "source_bill_ids": "12"}, {}], "confidence": 0.25}'))
    fenced = F.concat(F.lit('Here:\n```json\n{"sections": [{"section_number": 3, "heading": '), quoted, F.lit(', "source_notes": ""}, {"purpose": "p"}]}\n```\nDone.'))
    lists = F.concat(
        F.lit('```\n{"drafting_notes": ["0","1","2","3","4","5","6","7","8","9","10","11"], "sections": [{"section_key": "", "heading": '), quoted, F.lit(', "purpose": '), long,
        F.lit(', "source_bill_ids": ["1","2","3","4","5","6"], "source_notes": ["a","b","c","d","e","f"]}, {"source_notes": []}]}```'),
    )
    said = F.when(k == 0, plain).when(k == 1, fenced).when(k == 2, lists).when(k == 3, F.concat(F.lit("no outline: "), "title")).otherwise("")
    o = t.bills.select("id", T.outline(said).alias("o"))
    first, second = F.get("o.sections", F.lit(0)), F.get("o.sections", F.lit(1))
    return o.select(
        "id", F.size("o.sections").alias("n"), first["section_key"].alias("first_key"), second["section_key"].alias("second_key"), second["heading"].alias("second_heading"), first["purpose"].alias("purpose"),
        F.array_join(first["source_notes"], "|").alias("notes"), F.array_join(first["source_bill_ids"], "|").alias("bills"), F.array_join("o.drafting_notes", "|").alias("drafting"), F.col("o.confidence").alias("confidence"),
    )


@query("index_numbers", "WITH n AS (SELECT bill_id, CAST(substr(id, 2) AS BIGINT) AS n FROM v_vote_events), a AS (SELECT bill_id, max(n) AS highest, list_sort(list(DISTINCT n)) AS rolls, list_sort(list(DISTINCT CAST(n % 12 AS VARCHAR))) AS sessions FROM n GROUP BY 1) SELECT b.id AS bill_id, coalesce(highest, 0) AS highest, coalesce(rolls, []) AS rolls, coalesce(sessions, []) AS sessions FROM v_bills b LEFT JOIN a ON a.bill_id = b.id")
def index_numbers(t: Tables) -> DataFrame:
    """The highest roll of an index page, the numbers of a vote menu and the sessions of a listing, made of each bill's events; bills without any have empty ones."""
    n = F.expr("substr(id, 2)")
    each = lambda column: F.array_join(F.sort_array(F.collect_list(column)), "")
    folder = (n.cast("long") % 12).cast("string")
    pages = t.vote_events.groupBy("bill_id").agg(
        each(F.concat(F.lit("<a href='?rollnumber="), n, F.lit("'>x</a>"))).alias("page"),
        each(F.concat(F.lit("<vote><vote_number> 00"), n, F.lit(" </vote_number><vote_number>none</vote_number></vote>"))).alias("menu"),
        F.array_join(F.collect_list(F.concat(F.lit('{"justFileName": "'), F.when(n.cast("long") % 2 == 0, folder).otherwise(""), F.lit('", "name": "/'), folder, F.lit('/", "size": 1}'))), ",").alias("files"),
    )
    made = t.bills.select(F.col("id").alias("bill_id")).join(pages, "bill_id", "left")
    menu = F.concat(F.lit("<vote_summary><votes>"), "menu", F.lit("</votes></vote_summary>"))
    listing = F.concat(F.lit('{"files": ['), "files", F.lit(', {"name": "readme"}, {}]}'))
    return made.select("bill_id", T.highest_roll("page").alias("highest"), T.menu_votes(F.coalesce(menu, F.lit("not xml"))).alias("rolls"), T.listed_sessions(listing).alias("sessions"))


@query("int_buckets", "WITH b AS (SELECT CASE WHEN m < 0 THEN '<0' WHEN m = 0 THEN '0' WHEN m = 1 THEN '1' WHEN m <= 5 THEN '2-5' WHEN m <= 10 THEN '6-10' WHEN m <= 25 THEN '11-25' ELSE '26+' END AS bucket FROM (SELECT yes_count - no_count AS m FROM v_vote_events WHERE yes_count IS NOT NULL AND no_count IS NOT NULL)) SELECT l.bucket, count(b.bucket) AS n FROM (SELECT unnest(['<0', '0', '1', '2-5', '6-10', '11-25', '26+']) AS bucket) l LEFT JOIN b ON b.bucket = l.bucket GROUP BY l.bucket")
def int_buckets(t: Tables) -> DataFrame:
    from statutory.operators.aggregates import bucket_counts

    return bucket_counts(t.vote_events.select((F.col("yes_count") - F.col("no_count")).alias("margin")), "margin")


_TITLED = "(SELECT id, CAST(id AS BIGINT) AS n, CAST(id AS BIGINT) // 8 AS g, lower(substr(title, 21, 4)) || CAST(CAST(id AS BIGINT) // 8 AS VARCHAR) || 'x' || ['', '', '_2', '', '_2_2', '_2', '_3', ''][CAST(id AS BIGINT) % 8 + 1] AS base FROM v_bills)"


@query("slug_unique", f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n) AS i FROM {_TITLED} t),
w AS (SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS slug, CAST([] AS VARCHAR[]) AS used FROM s
  UNION ALL SELECT g, i, id, slug, list_append(used, slug) FROM (SELECT s.g, s.i, s.id, w.used, list_filter(list_transform(range(1, 12), lambda k: s.base || CASE WHEN k > 1 THEN '_' || CAST(k AS VARCHAR) ELSE '' END), lambda c: NOT list_contains(w.used, c))[1] AS slug FROM w JOIN s ON s.g = w.g AND s.i = w.i + 1) x)
SELECT id, slug FROM w WHERE i > 0""")
def slug_unique(t: Tables) -> DataFrame:
    """Titles of every eight bills that clash: a slug may be free, taken, or given out to an earlier row with a number."""
    from statutory.operators.windows import unique_slugs

    n = F.col("id").cast("long")
    ends = F.array(*[F.lit(x) for x in ("", "", " 2", "", " 2 2", " 2", " 3", "")])
    title = F.concat(F.substring("title", 21, 4), F.floor(n / 8).cast("string"), F.lit("X"), F.element_at(ends, (n % 8 + 1).cast("int")))
    return unique_slugs(t.bills.select("id", n.alias("n"), title.alias("title")), "title", "n").select("id", "slug")


def _quotes_sql() -> str:
    from statutory.operators.quality import HEAD_CHARS, HEAD_WORDS, LEAD_WORDS, QUOTE_WORDS, QUOTES, SWAPS

    swaps = ", ".join(f"{{'o': '{old}', 'w': '{new}'}}" for old, new in SWAPS)
    raised = f"list_transform(list_filter(range({HEAD_WORDS + 1}, {QUOTE_WORDS + 1}), lambda i: regexp_full_match(w[i], '[0-9]{{1,4}}')), lambda i: array_to_string(list_concat(list_concat(w[1:i - 1], [CAST(CAST(w[i] AS INT) + 1 AS VARCHAR)]), w[i + 1:]), ' '))"
    at = f"instr(substr(quote, {HEAD_CHARS + 1}), z.o)"
    swapped = f"list_transform(list_filter([{swaps}], lambda z: {at} > 0), lambda z: substr(quote, 1, {HEAD_CHARS} + {at} - 1) || z.w || substr(quote, {HEAD_CHARS} + {at} + length(z.o)))"
    free = f"len(words) - {LEAD_WORDS + QUOTE_WORDS}"
    return rf"""WITH d AS (SELECT doc_id, whole, string_split(whole, ' ') AS words FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS whole FROM documents) x),
q AS (SELECT doc_id, k, whole, words[{LEAD_WORDS} + ({free}) * k // {QUOTES} + 1 : {LEAD_WORDS + QUOTE_WORDS} + ({free}) * k // {QUOTES}] AS w FROM d, (SELECT unnest(range({QUOTES})) AS k) n WHERE {free} > 0),
s AS (SELECT *, array_to_string(w, ' ') AS quote FROM q)
SELECT doc_id, CAST(k AS INT) AS k, quote, list_filter(list_concat({raised}, {swapped}), lambda c: NOT contains(whole, c))[1] AS altered FROM s"""


@query("quote_negatives", _quotes_sql())
def quote_negatives(t: Tables) -> DataFrame:
    from statutory.operators.quality import altered_quotes

    return altered_quotes(t.documents, "doc_id", "text")


@query("scan_texts", "SELECT id, bill_id, version_name, version_date, content_text FROM v_bill_texts")
def scan_texts(t: Tables) -> DataFrame:
    return t.bill_texts.select("id", "bill_id", "version_name", "version_date", "content_text")
