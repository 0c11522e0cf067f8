"""Words of lines: every way to count them gives what the definition of a word gives."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from statutory.llm import lines

BLANKS = " \t\n\x0b\f\r\x85\xa0  -     　"
SIGNS = "々-〇ぁ-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ\U00020000-\U0003ffff"
LETTERS = "ก-໿က-႟ក-៿"
DEFINED = re.compile(f"[^{BLANKS}{SIGNS}{LETTERS}]++|[{SIGNS}]|[{LETTERS}]{{1,4}}+")
CASES = [
    "", "a", "a b", "a  b", "a\tb", "a \t b", "x\x0by\x1fz", "a\xa0b", "a\x85b", "soft\xadhy phen", "\xe9t\xe9 d’\xe9t\xe9", "na\xefve — dash", "෿ ฀ ก", " ",
    "水火 a水b", "กขฃคฅฆ a", "\U0001f600 \U0001f600\U0001f600", "\U00020001\U00020002 �", "end\x00of \x7f line", "a​b　c", "\r", "a\r", "~ ! \xa1\xff",
]


def test_words_are_counted_as_defined(spark):
    draw = random.Random(3)
    parts = ["a", "bc", " ", "  ", "\t", "\xa0", "\xe9", "水", "กข", "—", "\x85", "\U0001f600", "෿", "\x01"]
    made = CASES + ["".join(draw.choices(parts, k=draw.randint(1, 12))).strip(" ") for _ in range(2000)]
    rows = spark.createDataFrame([(x,) for x in made], "line string").select("line", lines._words(F.col("line")).alias("words"))
    assert [(r.line, r.words) for r in rows.collect() if r.words != len(DEFINED.findall(r.line))] == []


def test_plain_lines_take_no_search_for_words(spark, monkeypatch):
    """The search is most of the work over a large table; here it would fail."""
    monkeypatch.setattr(lines, "WORD", "(")
    rows = [(1, "one line of five words\n\nanother \xe9 l\xefne of six words"), (2, "one line of five words\nfour words more here\n"), (3, None)]
    found = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {1: (3, 0, rows[0][1]), 2: (3, 1, "four words more here\n"), 3: (0, 0, None)}
