"""Hand-made cases with literal results."""

import datetime as dt
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from statutory.functions import text as T
from statutory.operators import changes, grading, listing, quality, rollcall, search, sinks, windows
from statutory.operators.aggregates import fold_top
from statutory.streaming import jobs

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "raw, want",
    [("Passed House", "passed_lower"), ("Failed in committee", "failed"), ("Became Public Law", "enacted"), ("Referred to the Committee", "in_committee"), ("??", "other"), (None, None)],
)
def test_status(spark, raw, want):
    assert one(spark, T.norm_status(F.lit(raw).cast("string"))) == want


def test_dates(spark):
    for raw, want in (("2024-12-20T10:00:00", D(2024, 12, 20)), ("20-Dec-2024", D(2024, 12, 20)), ("December 5, 2024,  10:00 AM", D(2024, 12, 5)), ("1/2/2024", D(2024, 1, 2)), ("2024-13-40", None), ("", None)):
        assert one(spark, T.parse_date(F.lit(raw))) == want


def test_references(spark):
    text = "H.R. 12, Section 5 and S. 7; S.J.Res. 3; Public Law 118-5; h.r. 12"
    assert one(spark, T.references_in_rules(F.lit(text))) == ["HR 12", "PL 118-5", "S 7", "SJRES 3"]
    assert one(spark, T.references_in_reports(F.lit("S.Res. 9, H.R. 1 and S.Res. 9"))) == ["SRES 9", "HR 1"]


def test_markup(spark):
    assert one(spark, T.plain_text(F.lit("<p>a  &amp; b</p>\n<script>x</script><p>c</p>"))) == "a & b\nc"


def test_title(spark):
    assert one(spark, T.message_title(F.lit("  Hello there. More"))) == "Hello there."
    assert one(spark, T.message_title(F.lit("   "))) == "Untitled conversation"
    assert one(spark, T.message_title(F.lit("x" * 90))) == "x" * 80 + "..."


def test_span_boundary(spark):
    spans = spark.createDataFrame([("p", "D", D(2000, 1, 1), D(2001, 5, 1)), ("p", "R", D(2001, 5, 1), None)], "person_id string, party string, start_date date, end_date date")
    votes = spark.createDataFrame([("e1", "p", D(2001, 4, 30)), ("e2", "p", D(2001, 5, 1))], "vote_event_id string, person_id string, vote_date date")
    assert {r.vote_event_id: r.party for r in rollcall.party_asof(votes, spans).collect()} == {"e1": "D", "e2": "R"}


def test_reconciliation(spark):
    events = spark.createDataFrame([("exact", 1, 1, 0), ("under", 2, 0, 0), ("over", 0, 0, 0), ("null", None, 0, 0), ("both", None, 0, 0)], "id string, yes_count int, no_count int, other_count int")
    records = spark.createDataFrame([("exact", "yea"), ("exact", "nay"), ("under", "yea"), ("over", "yea"), ("null", "yea"), ("both", "nay")], "vote_event_id string, option string")
    got = {r.id: r.verdict for r in quality.reconcile(events, records).collect()}
    assert got == {"exact": "complete", "under": "under", "over": "over", "null": "missing", "both": "over"}


def test_empty_inputs(spark):
    events = spark.createDataFrame([], "id string, yes_count int, no_count int, other_count int")
    records = spark.createDataFrame([], "vote_event_id string, option string")
    assert quality.reconcile(events, records).count() == 0


def test_fold_top(spark):
    rows = spark.createDataFrame([(1, "a", 100), (1, "b", 50), (1, "c", 8), (2, "b", 30), (2, "c", 10)], "period int, dimension string, count long")
    got = {(r.period, r.dimension): r["count"] for r in fold_top(rows, 1).collect()}
    assert got == {(1, "a"): 100, (1, "Other"): 58, (2, "Other"): 40}


def test_changes(spark):
    old = spark.createDataFrame([("1", "t", "x", ["b", "a"]), ("2", None, "x", None)], "id string, title string, status string, subject array<string>")
    new = spark.createDataFrame([("1", "t", "y", ["a", "b"]), ("2", "n", "x", None), ("3", "q", "x", None)], "id string, title string, status string, subject array<string>")
    got = {(r.bill_id, r.change_type, r.field_name) for r in changes.detect_changes(old, new).collect()}
    assert got == {("1", "status_changed", "status"), ("2", "updated", "title"), ("3", "created", None)}


def test_upsert_unique(spark):
    old = spark.createDataFrame([(1, "a", "k"), (2, "b", "k")], "id int, v string, w string")
    new = spark.createDataFrame([(2, None, "n"), (3, "c", "n"), (3, "c", "n")], "id int, v string, w string")
    got = {r.id: (r.v, r.w) for r in changes.upsert(old, new, ["id"], ["v"]).collect()}
    assert got == {1: ("a", "k"), 2: (None, "k"), 3: ("c", "n")}
    kept = {r.id: r.v for r in changes.upsert(old, new, ["id"], ["v"], keep_old_values=True).collect()}
    assert kept[2] == "b"


def test_statistics(spark):
    table = spark.createDataFrame([(45, 15, 5, 15), (0, 0, 0, 0)], "a long, b long, c long, d long")
    rows = grading.newcombe(table).withColumn("p", grading.mcnemar()).collect()
    assert rows[0]["p"] == pytest.approx(0.0413895, abs=1e-6)
    assert rows[0]["difference"] == pytest.approx(0.125)
    assert rows[1]["p"] == 1.0 and (rows[1]["low"], rows[1]["high"]) == (-1.0, 1.0)
    low, high = grading.wilson(F.lit(0), F.lit(10))
    assert one(spark, low) == pytest.approx(0.0) and one(spark, high) == pytest.approx(0.27754, abs=1e-4)


def test_rrf(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "query_id string, id string, rank int")
    b = spark.createDataFrame([("q", "y", 1), ("q", "z", 2)], "query_id string, id string, rank int")
    assert [r.id for r in search.rrf_fuse([a, b], 2).orderBy("rank").collect()] == ["y", "x"]


def test_slugs(spark):
    rows = spark.createDataFrame([(1, "A b"), (2, "a-b"), (3, "a b 2"), (4, "!!")], "n int, title string")
    got = [r.slug for r in windows.unique_slugs(rows, "title", "n").orderBy("n").collect()]
    assert len(set(got)) == 4 and got[0] == "a_b" and got[3] == "section"


def given_slugs(titles):
    """One by one, as the rule says it."""
    used, out = set(), []
    for title in titles:
        base = re.sub(r"[^a-z0-9]+", "_", title.lower()).strip("_") or "section"
        tried = itertools.chain([base], (f"{base}_{k}" for k in itertools.count(2)))
        out.append(next(x for x in tried if x not in used))
        used.add(out[-1])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_slugs_are_given_out_in_order(spark, seed):
    rng = random.Random(seed)
    parts = ["A", "a 2", "A 2 2", "a 3", "b", "b 10", "!!", "section", "section 2", "a 02", "A_2_3", "c 7", "c"]
    titles = ["A", "a", "A 2", "a 2 2"] if not seed else [rng.choice(parts) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(titles)), "n int, title string").repartition(3)
    got = [r.slug for r in windows.unique_slugs(rows, "title", "n").orderBy("n").collect()]
    assert got == given_slugs(titles) and len(set(got)) == len(got)


def colliding(members):
    """Per window and member, the others whose name holds all its tokens."""
    found = {}
    for congress, chamber, person, name in members:
        cut = re.sub(r"^\s*\w+\.\s+", " ", re.sub(r"\[.*?\]", " ", name))
        tokens = [x for x in cut.lower().replace(",", " ").split() if x.isalpha()]
        others = {p for c, h, p, other in members if (c, h) == (congress, chamber) and p != person and all(x in other.lower() for x in tokens)}
        if tokens and others:
            found[congress, chamber, person] = len(others)
    return found


def test_names_collide_by_substrings(spark):
    rng = random.Random(8)
    fixed = [(118, "house", "1", "Lee, Ann"), (118, "house", "2", "Ann Lee"), (118, "house", "3", "Leeson, Annabel"), (118, "house", "4", "Sen. Li [D-XX-1]"), (118, "house", "5", "Olivia Li"), (118, "senate", "1", "Lee, Ann"), (118, "house", "6", "123"), (118, "house", "7", ""), (118, "house", "8", "X"), (118, "house", "9", "Max X")]
    made = [(117, h, f"p{i}", " ".join(rng.choice(["an", "ann", "annabel", "lee", "leeson", "o", "Rep. lee", "[X]", "de", "1a"]) for _ in range(rng.randrange(1, 4)))) for h in ("house", "senate") for i in range(40)]
    members = spark.createDataFrame(fixed + made, "congress int, chamber string, person_id string, name string")
    got = {(r.congress, r.chamber, r.person_id): r.n for r in quality.window_collisions(members).collect()}
    assert got == colliding(fixed + made) and got[118, "house", "1"] == 2


def test_date_range_rejects(spark):
    rows = spark.createDataFrame([(D(2024, 1, 1),)], "d date")
    with pytest.raises(ValueError):
        listing.date_range(rows, "d", "2024-02-01", "2024-01-01")
    with pytest.raises(ValueError):
        listing.date_range(rows, "d", "2020-01-01", "2024-01-01")


def test_replace_refuses(spark, tmp_path):
    spans = spark.createDataFrame([("p", "D", D(2000, 1, 1), D(2002, 1, 1)), ("p", "R", D(2001, 1, 1), D(2003, 1, 1))], "person_id string, party string, start_date date, end_date date")
    with pytest.raises(ValueError):
        sinks.replaced(spans, windows.overlapping_spans, str(tmp_path / "t"))
    assert not (tmp_path / "t").exists()


def test_quotes_are_altered(spark):
    lead = " ".join(f"lead{i}" for i in range(70))
    head = "one two 3 four five"
    quotes = {
        1: f"{head} 12 members and 13 votes",  # the first number behind the head is raised
        2: f"{head} six seven eight the board shall meet annually",
        3: f"{head} six seven eight nothing to change here",
        4: f"{head} 12 members and 13 votes",  # raised as well, as the text holds the first edit already
        5: f"{head} six seven eight 12345 each Secretary reports",
    }
    want = {
        1: f"{head} 13 members and 13 votes", 2: f"{head} six seven eight the board may meet annually", 3: None,
        4: f"{head} 12 members and 14 votes", 5: f"{head} six seven eight 12345 each Director reports",
    }
    fill = lambda q: " ".join([q, *[f"z{i}" for i in range(34 - len(q.split()))]])
    rows = [(k, f"{lead}\n {fill(q)} " + " ".join(["tail"] * 4) + (f" {fill(want[1])}" if k == 4 else "")) for k, q in quotes.items()]
    rows += [(6, None), (7, ""), (8, " ".join(["w"] * 104)), (9, " ".join(["w"] * 105))]
    got = {}
    for r in quality.altered_quotes(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect():
        got.setdefault(r.doc_id, {})[r.k] = (r.quote, r.altered)
    assert {k: got[k][0] for k in quotes} == {k: (fill(q), want[k] and fill(want[k])) for k, q in quotes.items()}
    assert set(got) == {1, 2, 3, 4, 5, 9} and all(len(v) == 4 for v in got.values()) and got[9][3] == (" ".join(["w"] * 34), None)


@pytest.mark.parametrize(
    ("text", "sections", "notes", "confidence"),
    [
        ('{"sections": [{"heading": "Short Title!", "source_notes": "n"}], "confidence": 1}', [("short_title", "Short Title!", "No purpose provided", [], ["n"])], [], 1.0),
        ('x ```json\n{"sections": [{}, {"section_key": "k", "purpose": "p", "source_bill_ids": {"a": 1}}]}\n``` y', [("section_0", "Section 1", "No purpose provided", [], []), ("k", "Section 2", "p", [], [])], [], 0.7),
        ("no json", [], ["no json"], 0.0),
        ("```\nnot json\n```", [], ["```\nnot json\n```"], 0.0),
        ("[1, 2]", [], ["[1, 2]"], 0.0),
        ("", [], ["Unable to parse outline."], 0.0),
        (None, [], ["Unable to parse outline."], 0.0),
        ('{"drafting_notes": ["a"]}', [], ["a"], 0.7),
        ('{"sections": [{"section_key": "' + "k" * 150 + '", "heading": "' + "h" * 250 + '", "source_notes": ["1","2","3","4","5","6"]}]}', [("k" * 100, "h" * 200, "No purpose provided", [], ["1", "2", "3", "4", "5"])], [], 0.7),
    ],
)
def test_outlines(spark, text, sections, notes, confidence):
    got = one(spark, T.outline(F.lit(text).cast("string")))
    assert [(s.section_key, s.heading, s.purpose, s.source_bill_ids, s.source_notes) for s in got.sections] == sections
    assert (got.drafting_notes, got.confidence) == (notes, confidence)


def test_numbers_of_index_pages(spark):
    menu = "<vote_summary><votes><vote><vote_number>00012</vote_number></vote><vote><vote_number> 3 </vote_number></vote><vote><vote_number>x</vote_number></vote><vote><vote_number/></vote><vote><vote_number>3</vote_number></vote></votes></vote_summary>"
    assert one(spark, T.menu_votes(F.lit(menu))) == [3, 12]
    assert one(spark, T.menu_votes(F.lit("<broken"))) == [] and one(spark, T.menu_votes(F.lit(None).cast("string"))) == []
    assert one(spark, T.highest_roll(F.lit("rollnumber=7 rollnumber=71&x rollnumber="))) == 71
    assert one(spark, T.highest_roll(F.lit("none"))) == 0 and one(spark, T.highest_roll(F.lit(None).cast("string"))) == 0
    listing = '{"files": [{"justFileName": "2"}, {"name": "/1/"}, {"justFileName": "", "name": "10"}, {"name": "readme"}, {}, {"name": "2"}]}'
    assert one(spark, T.listed_sessions(F.lit(listing))) == ["1", "10", "2"]
    assert one(spark, T.listed_sessions(F.lit("{}"))) == [] and one(spark, T.listed_sessions(F.lit("not json"))) == []


def test_text_nodes_are_lines():
    from statutory.sources import formats

    xml = b"<bill xmlns:dc='x'><metadata>gone</metadata><section><enum>1.</enum><header>Short  title</header>\n<text>This \t Act\n  may <i>be</i> </text></section></bill>"
    assert formats._text_of(xml) == "1.\nShort title\nThis Act\n may\nbe"
    assert formats._text_of(b"<broken") is None


def test_loose_searches_meet_bills_by_parts_of_the_word(spark):
    rng = random.Random(9)
    title = lambda: "".join(rng.choice("abC dÄé%_") for _ in range(rng.randrange(12)))
    bills = spark.createDataFrame([(f"b{i}", "j1", "x", None if i % 17 == 0 else title(), f"HR{i}") for i in range(120)], "id string, jurisdiction_id string, status string, title string, identifier string")
    words = [None, "", "a", "AB", "ab", "c d", "bC d", "ä", "ÄÉ", "%", "zzz", *[title()[:4] for _ in range(40)]]
    searches = spark.createDataFrame([(f"s{i}", "o", None, None, w, ["bill.updated"], True) for i, w in enumerate(words)], "id string, org_id string, jurisdiction_id string, status string, query string, event_types array<string>, alerts_enabled boolean")
    both = [sorted((r.search_id, r.bill_id) for r in changes.matching_bills(searches, bills, n).collect()) for n in (1000, 0)]
    assert both[0] == both[1] and len(both[0]) > 300


def test_state_survives_batches(spark):
    rows = spark.createDataFrame([("b", i, v) for i, v in enumerate("aabba")], "bill string, seq int, value string")
    ordered = rows.repartitionByRange(2, "seq")
    stream = jobs.changes(jobs.replay(ordered, 2), "bill", ["seq"], "value")
    found = jobs.drain(stream)
    assert found.count() >= 2
    assert found.where("old_value is null").count() == 1
