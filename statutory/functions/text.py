"""Column expressions on strings: ids, hashes, names, statuses, dates, references, answers."""

from __future__ import annotations

import re
from xml.etree import ElementTree

import pandas as pd
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapped(key: Column, table: dict[str, object]) -> Column:
    """The value of key in a fixed table, or null."""
    return F.element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


# Free-text status patterns in the order in which they are tried.
STATUS_PATTERNS = (
    ("introduced", "introduced"),
    ("passed house", "passed_lower"),
    ("passed senate", "passed_upper"),
    ("passed lower", "passed_lower"),
    ("passed upper", "passed_upper"),
    ("resolving that the bill has passed", "passed_upper"),
    ("enrolled", "enrolled"),
    ("presented to president", "enrolled"),
    ("enacted", "enacted"),
    ("signed", "enacted"),
    ("became law", "enacted"),
    ("became public law", "enacted"),
    ("public law", "enacted"),
    ("vetoed", "vetoed"),
    ("pocket vetoed", "vetoed"),
    ("failed", "failed"),
    ("dead", "failed"),
    ("withdrawn", "withdrawn"),
    ("referred to", "in_committee"),
    ("committee", "in_committee"),
)

# How far a status is.
STATUS_RANKS = {
    "introduced": 0, "other": 0, "in_committee": 1, "failed": 1, "withdrawn": 1,
    "passed_lower": 2, "passed_upper": 3, "enrolled": 4, "enacted": 5, "vetoed": 5,
}

# Numeric status codes.
STATUS_CODES = {"1": "introduced", "2": "engrossed", "3": "enrolled", "4": "enacted", "5": "vetoed", "6": "failed"}

# Recorded votes.
VOTE_OPTIONS = {"Yea": "yea", "Aye": "yea", "Yes": "yea", "Nay": "nay", "No": "nay", "Present": "present", "Not Voting": "not_voting"}

# Party names.
PARTY_NAMES = {
    "democrat": "D", "democratic": "D", "dem": "D", "d": "D", "republican": "R", "gop": "R", "r": "R",
    "independent": "I", "i": "I", "libertarian": "L", "l": "L",
}

# Chamber names.
CHAMBERS = {"senate": "senate", "s": "senate", "house": "house", "h": "house", "joint": "joint", "house of representatives": "house"}

# The states by their postal code.
STATES = {
    "AL": "Alabama",
    "AK": "Alaska",
    "AZ": "Arizona",
    "AR": "Arkansas",
    "CA": "California",
    "CO": "Colorado",
    "CT": "Connecticut",
    "DE": "Delaware",
    "FL": "Florida",
    "GA": "Georgia",
    "HI": "Hawaii",
    "ID": "Idaho",
    "IL": "Illinois",
    "IN": "Indiana",
    "IA": "Iowa",
    "KS": "Kansas",
    "KY": "Kentucky",
    "LA": "Louisiana",
    "ME": "Maine",
    "MD": "Maryland",
    "MA": "Massachusetts",
    "MI": "Michigan",
    "MN": "Minnesota",
    "MS": "Mississippi",
    "MO": "Missouri",
    "MT": "Montana",
    "NE": "Nebraska",
    "NV": "Nevada",
    "NH": "New Hampshire",
    "NJ": "New Jersey",
    "NM": "New Mexico",
    "NY": "New York",
    "NC": "North Carolina",
    "ND": "North Dakota",
    "OH": "Ohio",
    "OK": "Oklahoma",
    "OR": "Oregon",
    "PA": "Pennsylvania",
    "RI": "Rhode Island",
    "SC": "South Carolina",
    "SD": "South Dakota",
    "TN": "Tennessee",
    "TX": "Texas",
    "UT": "Utah",
    "VT": "Vermont",
    "VA": "Virginia",
    "WA": "Washington",
    "WV": "West Virginia",
    "WI": "Wisconsin",
    "WY": "Wyoming",
}


def stable_id(*parts: str | Column) -> Column:
    """The first 16 hex digits of the SHA-256 of the parts, joined by colons."""
    return F.substring(F.sha2(F.concat_ws(":", *[_column(p).cast("string") for p in parts]), 256), 1, 16)


def content_hash(text: str | Column, version: str | None = None) -> Column:
    """SHA-256 of a text, or of a version, a colon and the text."""
    value = _column(text) if version is None else F.concat(F.lit(f"{version}:"), _column(text))
    return F.sha2(value, 256)


def norm_identifier(c: str | Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(F.replace(_column(c), F.lit("."), F.lit("")), r"\s+", " ")))


def norm_status(c: str | Column) -> Column:
    """One of the canonical statuses; the first pattern that occurs decides, null stays null."""
    text = F.lower(F.trim(_column(c)))
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for pattern, status in STATUS_PATTERNS:
        out = out.when(F.contains(text, F.lit(pattern)), status)
    return out.otherwise("other")


def map_status_code(c: str | Column) -> Column:
    return F.coalesce(mapped(_column(c).cast("string"), STATUS_CODES), F.lit("other"))


def word_count(c: str | Column) -> Column:
    """Words between white space; null for null and empty texts."""
    text = _column(c)
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(text.isNull() | (text == ""), F.lit(None)).when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, r"\s+")))


def vote_ref(c: str | Column) -> Column:
    return F.upper(F.regexp_replace(F.coalesce(_column(c), F.lit("")), r"[\s.]", ""))


def is_bill_ref(c: str | Column) -> Column:
    return vote_ref(c).rlike(r"^(HCONRES|HJRES|SCONRES|SJRES|HRES|SRES|HR|S)\d+$")


def vote_option(c: str | Column) -> Column:
    """The canonical option, null for an unknown one (its event is then set aside)."""
    return mapped(F.trim(F.coalesce(_column(c), F.lit(""))), VOTE_OPTIONS)


def house_event_id(congress: Column, year: Column, roll: Column) -> Column:
    return F.format_string("us-house-%d-%d-%04d", congress.cast("long"), year.cast("long"), roll.cast("long"))


def senate_event_id(congress: Column, session: Column, vote: Column) -> Column:
    return F.format_string("us-senate-%d-%d-%05d", congress.cast("long"), session.cast("long"), vote.cast("long"))


def event_id_parts(c: str | Column) -> tuple[Column, Column]:
    """Year (or session) and number of an event id; null if it is none."""
    parts = F.split(_column(c), "-")
    return F.try_element_at(parts, F.lit(4)).try_cast("int"), F.try_element_at(parts, F.lit(5)).try_cast("int")


def congress_years(congress: str | Column) -> Column:
    first = F.lit(2007) + 2 * (_column(congress).cast("int") - 110)
    return F.array(first, first + 1)


def parse_date(c: str | Column) -> Column:
    """A date in one of the forms of the sources (ISO, ISO with a time, US, day-month-year, long); null for others."""
    text = F.trim(_column(c))
    iso = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2})", 1)
    long = F.regexp_extract(text, r"^([A-Z][a-z]+ \d{1,2}, \d{4})", 1)
    return F.coalesce(
        F.try_to_date(iso, "yyyy-MM-dd"),
        F.try_to_date(F.regexp_extract(text, r"^(\d{1,2}/\d{1,2}/\d{4})$", 1), "M/d/yyyy"),
        F.try_to_date(F.regexp_extract(text, r"^(\d{1,2}-[A-Z][a-z]{2}-\d{4})$", 1), "d-MMM-yyyy"),
        F.try_to_date(long, "MMMM d, yyyy"),
    )


def norm_chamber(c: str | Column) -> Column:
    low = F.lower(F.trim(_column(c)))
    return F.when(low != "", F.coalesce(mapped(low, CHAMBERS), low))


def split_bill_id(c: str | Column) -> tuple[Column, Column]:
    """Type and number of an id like hr1234-118; a stem of another form is all type."""
    stem = F.regexp_replace(_column(c), r"-[^-]*$", "")
    kind = F.regexp_extract(stem, r"^([a-z]+)(\d+)$", 1)
    return F.when(kind == "", stem).otherwise(kind), F.regexp_extract(stem, r"^([a-z]+)(\d+)$", 2)


def package_parts(c: str | Column) -> Column:
    """congress, doc_class, number and version of a package file name; nulls if it is none."""
    low = F.lower(F.trim(_column(c)))
    pattern = r"^bills-(\d+)([a-z]+)(\d+)([a-z]+)(?:\.xml)?$"
    part = lambda i: F.when(low.rlike(pattern), F.regexp_extract(low, pattern, i))
    return F.struct(part(1).cast("int").alias("congress"), part(2).alias("doc_class"), part(3).alias("number"), part(4).alias("version"))


# The names of the chambers' documents, word by word.
HOUSE_NAMES = (("H", "R"), ("H", "J", "Res"), ("H", "Con", "Res"))
SENATE_NAMES = (("S",), ("S", "J", "Res"), ("S", "Con", "Res"))
RESOLUTIONS = (("H", "Res"), ("S", "Res"))


def _references(text: Column, names: str, flags: str = "") -> Column:
    """Name and number, as `HR 12`, of everything in a text that has one of the names before a number."""
    pattern = F.lit(rf"{flags}\b({names})\s*(\d+)\b")
    bare = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: F.upper(F.regexp_replace(x, r"[\s.]", "")))
    return F.zip_with(bare, F.regexp_extract_all(text, pattern, F.lit(2)), lambda a, b: F.concat(a, F.lit(" "), b))


def references_in_rules(c: str | Column) -> Column:
    """Bill and public-law references of regulatory texts, each once and sorted.

    Words of a name may be parted by a point, a blank, both or neither. Simple resolutions
    are none; neither is an S after "sec" within eight characters, as in "Section 5".
    """
    text = F.coalesce(_column(c), F.lit(""))

    def loose(name: tuple[str, ...]) -> str:
        return r"\.?\s?".join(name) + r"\.?"

    bills = _references(text, "|".join(map(loose, HOUSE_NAMES)), "(?i)")
    senate = _references(text, loose(SENATE_NAMES[0]), "(?is)(?<!sec.{0,5})")
    joint = _references(text, "|".join(map(loose, SENATE_NAMES[1:])), "(?i)")
    law = F.lit(r"(?i)\b(?:Public\s+Law|P\.?\s?L\.?)\s+(\d+)[–\-](\d+)\b")
    laws = F.zip_with(F.regexp_extract_all(text, law, F.lit(1)), F.regexp_extract_all(text, law, F.lit(2)), lambda a, b: F.concat(F.lit("PL "), a, F.lit("-"), b))
    return F.array_sort(F.array_distinct(F.concat(bills, senate, joint, laws)))


def references_in_reports(c: str | Column) -> Column:
    """Bill references of reports, each once in the order of the text; every word of a name ends with a point."""
    names = "|".join("".join(rf"{word}\." for word in name) for name in (*HOUSE_NAMES, *SENATE_NAMES, *RESOLUTIONS))
    return F.array_distinct(_references(F.coalesce(_column(c), F.lit("")), names))


def strip_party_tag(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(_column(c), r"\s*\[[^\]]*\]\s*$", ""))


def current_party(c: str | Column) -> Column:
    return F.when(_column(c) == "ID", "I").otherwise(_column(c))


def core_name_tokens(c: str | Column) -> Column:
    """Lower-case words of a name, without its title and its tag."""
    name = F.regexp_replace(F.regexp_replace(_column(c), r"\[.*?\]", " "), r"^\s*\w+\.\s+", " ")
    words = F.split(F.trim(F.replace(F.lower(name), F.lit(","), F.lit(" "))), r"\s+")
    return F.filter(words, lambda w: w.rlike(r"^\p{L}+$"))


def fold_option(c: str | Column) -> Column:
    table = {k.lower(): v for k, v in VOTE_OPTIONS.items()} | {v: v for v in VOTE_OPTIONS.values()}
    return F.coalesce(mapped(F.lower(F.trim(_column(c))), table), _column(c))


def fold_party(c: str | Column) -> Column:
    name = F.trim(F.regexp_replace(F.lower(F.trim(_column(c))), r"\s+(party|caucus)$", ""))
    return F.coalesce(mapped(name, PARTY_NAMES), _column(c))


def strict_int(c: str | Column) -> Column:
    """The integer that a text spells, null for anything else (also 5.0)."""
    text = F.trim(_column(c))
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("long"))


def csv_guard(c: str | Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(_column(c).rlike(r"^[=+\-@\t\r|;]"), F.concat(F.lit("'"), _column(c))).otherwise(_column(c))


def escape_like(c: str | Column) -> Column:
    return F.regexp_replace(_column(c), r"([\\%_])", r"\\$1")


def contains_folded(c: str | Column, part: str | Column) -> Column:
    """Substring test that ignores case and takes % and _ for themselves."""
    return F.contains(F.lower(_column(c)), F.lower(F.lit(part) if isinstance(part, str) else part))


# Character references by name, of XML and the common ones of HTML.
REFERENCES = {
    "lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'", "nbsp": "\u00a0", "sect": "\u00a7", "para": "\u00b6", "copy": "\u00a9", "reg": "\u00ae", "deg": "\u00b0",
    "frac12": "\u00bd", "ndash": "\u2013", "mdash": "\u2014", "lsquo": "\u2018", "rsquo": "\u2019", "ldquo": "\u201c", "rdquo": "\u201d", "bull": "\u2022", "hellip": "\u2026",
}


def decoded(c: str | Column) -> Column:
    """Character references as characters, each once: decimal, hexadecimal, and the names in REFERENCES. Others stay."""
    parts = F.split(_column(c), "&", -1)

    def part(x: Column) -> Column:
        name = F.regexp_extract(x, r"^(#[xX][0-9a-fA-F]{1,6}|#[0-9]{1,7}|[A-Za-z][A-Za-z0-9]*);", 1)
        code = F.when(name.rlike("^#[xX]"), F.conv(F.substring(name, F.lit(3), F.length(name)), 16, 10)).when(name.startswith("#"), F.substring(name, F.lit(2), F.length(name))).cast("long")
        valid = ((code > 0) & (code < 0xD800)) | ((code > 0xDFFF) & (code <= 0x10FFFF))
        numbered = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
        char = F.coalesce(numbered, mapped(name, REFERENCES))
        return F.coalesce(F.concat(char, F.substring(x, F.length(name) + 2, F.length(x))), F.concat(F.lit("&"), x))

    return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), part), ""))


def plain_text(c: str | Column) -> Column:
    """Markup taken out: every text node a line of its own, trimmed, blanks in it made one; null gives no text.

    Scripts, styles and comments go; references are decoded once the markup is gone.
    """
    bare = F.regexp_replace(F.coalesce(_column(c), F.lit("")), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>", "\n")
    lines = F.transform(F.split(decoded(bare), "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, r"\s+", " "), "^ | $", ""))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def message_title(c: str | Column) -> Column:
    """The first sentence, if it ends within 80 characters, else the first 80 characters."""
    text = F.regexp_replace(_column(c), r"^\s+|\s+$", "")
    out = F.when(F.coalesce(text, F.lit("")) == "", "Untitled conversation")
    for mark in (".", "?", "!"):
        at = F.instr(text, mark)
        out = out.when((at > 1) & (at <= 80), F.substring(text, F.lit(1), at))
    return out.when(F.length(text) > 80, F.concat(F.substring(text, 1, 80), F.lit("..."))).otherwise(text)


def slug(c: str | Column) -> Column:
    found = F.regexp_replace(F.regexp_replace(F.lower(_column(c)), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(found == "", "section").otherwise(found)


def int_bucket(c: str | Column) -> Column:
    v = _column(c)
    return (
        F.when(v < 0, "<0").when(v == 0, "0").when(v == 1, "1").when(v <= 5, "2-5").when(v <= 10, "6-10").when(v <= 25, "11-25").when(v.isNotNull(), "26+")
    )


def list_key(c: str | Column) -> Column:
    """The compare key of a list: sorted, joined by commas."""
    return F.array_join(F.array_sort(_column(c)), ",")


def month_cutoff(day: str | Column, months: int) -> Column:
    """The first day of the month so many months before a day."""
    return F.trunc(F.add_months(_column(day), -months), "MM")


def json_from_text(c: str | Column, schema: str) -> Column:
    """The JSON object in a free text or in its fenced block; null if there is none."""
    fenced = F.regexp_extract(_column(c), r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1)
    bare = F.regexp_extract(_column(c), r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(bare), schema)


OUTLINE = "struct<sections: array<struct<section_key: string, heading: string, purpose: string, source_bill_ids: array<string>, source_notes: array<string>>>, drafting_notes: array<string>, confidence: double>"


def outline(c: str | Column) -> Column:
    """An outline read from free text: sections, drafting_notes and confidence, with defaults for what is missing.

    The text is JSON, or has it in its first fenced block. A section without a key gets one
    from its heading; notes may be one string; ids that aren't a list are none. Texts are cut
    to 100, 200 and 1,000 characters, lists to 5 and 10 entries. What can't be read gives no
    sections, the text as the only note, and a confidence of 0.
    """
    text = F.coalesce(_column(c), F.lit(""))
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    whole = F.try_parse_json(text)
    found = F.coalesce(whole, F.try_parse_json(F.trim(fenced)))
    data = F.when(F.schema_of_variant(found).startswith("OBJECT"), found)
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    sections = F.coalesce(get(data, "$.sections", "array<variant>"), F.array().cast("array<variant>"))

    def section(v: Column, i: Column) -> Column:
        heading = get(v, "$.heading", "string")
        key = get(v, "$.section_key", "string")
        made = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(heading, F.concat(F.lit("section_"), i.cast("string")))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
        purpose = F.substring(F.coalesce(get(v, "$.purpose", "string"), F.lit("")), 1, 1000)
        note = get(v, "$.source_notes", "string")
        notes = F.coalesce(get(v, "$.source_notes", "array<string>"), F.when(note != "", F.array(note)), F.array().cast("array<string>"))
        return F.struct(
            F.substring(F.when(F.coalesce(key, F.lit("")) != "", key).otherwise(made), 1, 100).alias("section_key"),
            F.substring(F.coalesce(heading, F.concat(F.lit("Section "), (i + 1).cast("string"))), 1, 200).alias("heading"),
            F.when(purpose == "", "No purpose provided").otherwise(purpose).alias("purpose"),
            F.slice(F.coalesce(get(v, "$.source_bill_ids", "array<string>"), F.array().cast("array<string>")), 1, 5).alias("source_bill_ids"),
            F.slice(notes, 1, 5).alias("source_notes"),
        )

    read = F.struct(
        F.transform(sections, section).alias("sections"),
        F.slice(F.coalesce(get(data, "$.drafting_notes", "array<string>"), F.array().cast("array<string>")), 1, 10).alias("drafting_notes"),
        F.coalesce(get(data, "$.confidence", "double"), F.lit(0.7)).alias("confidence"),
    ).cast(OUTLINE)
    note = F.when(text == "", "Unable to parse outline.").otherwise(text)
    unread = F.struct(F.array().alias("sections"), F.array(note).alias("drafting_notes"), F.lit(0.0).alias("confidence")).cast(OUTLINE)
    return F.when(data.isNotNull(), read).otherwise(unread)


def highest_roll(page: str | Column) -> Column:
    """The highest roll number that an index page links to; 0 without any."""
    numbers = F.transform(F.regexp_extract_all(F.coalesce(_column(page), F.lit("")), F.lit(r"rollnumber=(\d+)"), F.lit(1)), lambda x: x.try_cast("long"))
    return F.coalesce(F.array_max(numbers), F.lit(0).cast("long"))


@F.pandas_udf(ArrayType(LongType()))
def menu_votes(menus: pd.Series) -> pd.Series:
    """The distinct numbers in the vote_number elements of a vote menu, rising; none if it isn't XML."""

    def numbers(text: str | None) -> list[int]:
        try:
            root = ElementTree.fromstring(text or "")
        except ElementTree.ParseError:
            return []
        found = (x.text.strip() for x in root.iterfind(".//vote_number") if x.text)
        return sorted({int(x) for x in found if re.fullmatch(r"[+-]?\d+", x)})

    return menus.map(numbers)


def listed_sessions(listing: str | Column) -> Column:
    """The distinct numeric folder names of a JSON listing of files, sorted as strings."""
    files = F.get_json_object(_column(listing), "$.files")
    entries = F.coalesce(F.from_json(files, "array<struct<justFileName: string, name: string>>"), F.array())
    named = F.transform(entries, lambda f: F.coalesce(F.nullif(f["justFileName"], F.lit("")), f["name"], F.lit("")))
    names = F.transform(named, lambda n: F.regexp_replace(F.trim(n), "^/+|/+$", ""))
    return F.coalesce(F.array_sort(F.array_distinct(F.filter(names, lambda n: n.rlike(r"^\d+$")))), F.array().cast("array<string>"))
