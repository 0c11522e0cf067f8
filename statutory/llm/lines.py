"""Line dedup by pairwise alignment of overlapping documents.

Texts are reduced to line hashes, and exact copies to one text. A line that several texts
hold links each of them to the first that holds it, so links grow with the lines and never
with the square of a group, and every link is followed, however many texts hold the line.
Lines of fewer than LINE_WORDS words link by the shortest runs of neighbours that have so
many words, from the line forward and back, so passages of short lines are found as well.
Linked texts are aligned by patience diff on their hashes, and the aligned blocks are
deleted from the later document, as are blocks that the alignment passes over because they
are repeated or stand in another order. The first holder of a line never loses it.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutory.llm.common import materialize

#: A line that more texts hold is joined in parts of about so many.
HEAVY_TEXTS = 2000
#: Such lines are broadcast up to this number, and joined by a shuffle beyond it.
BROADCAST_LINES = 200_000
LINE_WORDS = 5
BLOCK_WORDS = 5
#: White space, and the letters of scripts without blanks: one (Chinese, Japanese) or four (Thai, Lao, Burmese, Khmer) count as a word.
_BLANKS = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_SIGNS = r"\x{3005}-\x{3007}\x{3041}-\x{30FF}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}\x{20000}-\x{3FFFF}"
_LETTERS = r"\x{E01}-\x{EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}"
#: Characters of words that stand below all of these; a few ranges are tested faster than many.
_PLAIN = r"!-~\x{A1}-\x{DFF}"
PLAIN_LINE = rf"\A[ {_PLAIN}]*+\z"
WORD = f"(?:[{_PLAIN}]++|[^{_BLANKS}{_SIGNS}{_LETTERS}])++|[{_SIGNS}]|[{_LETTERS}]{{1,4}}+"


def patience_pairs(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two lists of hashes, in order.

    Items that are unique on both sides of a stretch are matched along their longest common
    order; matches grow over equal neighbours; what lies between them is aligned likewise.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a = {x for x, n in Counter(a[a0:a1]).items() if n == 1}
        place = {x: i for i, x in enumerate(a[a0:a1], a0) if x in once_a}
        counts = Counter(b[b0:b1])
        both = [(place[x], j) for j, x in enumerate(b[b0:b1], b0) if x in place and counts[x] == 1]
        tails: list[int] = []
        ends: list[int] = []
        back: list[int] = []
        for k, (i, _) in enumerate(both):
            at = bisect_left(tails, i)
            back.append(ends[at - 1] if at else -1)
            if at == len(tails):
                tails.append(i)
                ends.append(k)
            else:
                tails[at], ends[at] = i, k
        chain: list[tuple[int, int]] = []
        k = ends[-1] if ends else -1
        while k >= 0:
            chain.append(both[k])
            k = back[k]
        if not chain:
            continue
        out += chain
        left, right = a0, b0
        for i, j in [*reversed(chain), (a1, b1)]:
            todo.append((left, i, right, j))
            left, right = i + 1, j + 1
    return sorted(out)


class Runs:
    """Every run of a list, as a suffix automaton; tells how far a reading of another list is a run of this one."""

    def __init__(self, items: list[int]) -> None:
        self.after: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for x in items:
            new = self._state({}, 0, self.length[last] + 1)
            p = last
            while p >= 0 and x not in self.after[p]:
                self.after[p][x] = new
                p = self.link[p]
            if p >= 0:
                q = self.after[p][x]
                if self.length[q] > self.length[p] + 1:
                    twin = self._state(dict(self.after[q]), self.link[q], self.length[p] + 1)
                    while p >= 0 and self.after[p].get(x) == q:
                        self.after[p][x] = twin
                        p = self.link[p]
                    self.link[q] = q = twin
                self.link[new] = q
            last = new

    def _state(self, after: dict[int, int], link: int, length: int) -> int:
        self.after.append(after)
        self.link.append(link)
        self.length.append(length)
        return len(self.after) - 1

    def step(self, state: int, n: int, x: int) -> tuple[int, int]:
        """The state and length of the longest run that ends with x, after a run of n items at state."""
        while state and x not in self.after[state]:
            state = self.link[state]
            n = self.length[state]
        return (self.after[state][x], n + 1) if x in self.after[state] else (0, 0)


def repeated_blocks(a: list[int], b: list[int], words: list[int], gone: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Places of b outside gone that lie in a block, outside gone, of at least so many words that a holds anywhere."""
    known, taken = set(a), set(gone)
    parts: list[list[int]] = [[]]
    for j, x in enumerate(b):
        if x in known and j not in taken:
            parts[-1].append(j)
        elif parts[-1]:
            parts.append([])
    parts = [p for p in parts if sum(words[j] for j in p) >= least]
    runs = Runs(a) if parts else None
    out: list[int] = []
    for part in parts:
        before = [0]  # words before each place of the part
        for j in part:
            before.append(before[-1] + words[j])
        state = n = 0
        open_from = 0  # places of the part from here on are not in out
        for k, j in enumerate(part):
            state, n = runs.step(state, n, b[j])
            if before[k + 1] - before[k + 1 - n] >= least:
                out += part[max(open_from, k + 1 - n) : k + 1]
                open_from = k + 1
    return out


def common_blocks(a: list[int], b: list[int], words: list[int], least: int = BLOCK_WORDS) -> list[int]:
    """Places in b of the blocks of at least so many words that a holds.

    First those of the alignment; then, among the lines it leaves, those that repeat or
    stand in another order, until no block of so many words is left.
    """
    out: list[int] = []
    block: list[int] = []
    last = (-2, -2)
    for pair in [*patience_pairs(a, b), (-9, -9)]:
        if block and pair != (last[0] + 1, last[1] + 1):
            if sum(words[j] for j in block) >= least:
                out += block
            block = []
        block.append(pair[1])
        last = pair
    return out + repeated_blocks(a, b, words, out, least)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, places = [], []
        for key, first, own, words in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            found = common_blocks(first, own, words)
            if found:
                keys.append(key)
                places.append(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))], names=["key", "places"])


def _words(line: Column) -> Column:
    """Matches of WORD in a trimmed line; where all words are plain and parted by one blank each, they are counted by the blanks."""
    plain = line.rlike(PLAIN_LINE) & ~F.contains(line, F.lit("  "))
    return F.when(plain, F.when(line == "", 0).otherwise(F.size(F.split(line, " ")))).otherwise(F.regexp_count(line, F.lit(WORD)))


def _rank(first: str = "first", key: str = "key") -> Column:
    """The order of texts: by the smallest id of their documents, null ids last."""
    return F.struct(F.col(first).isNull().alias("none"), F.col(first).alias("id"), F.col(key).alias("key"))


def _run(lines: Column) -> Column:
    """Hash of the shortest beginning of lines that has LINE_WORDS words, with its inner blank lines; null if there is none."""

    def longer(run: Column, x: Column) -> Column:
        # the distance tells how many blank lines lie between; it keeps forward and backward runs apart too
        grown = F.struct(F.xxhash64(run["hash"], x["at"] - run["at"], x["hash"]).alias("hash"), x["at"].alias("at"), (run["words"] + x["words"]).alias("words"))
        return F.when(run["words"] >= LINE_WORDS, run).otherwise(grown)

    first = F.element_at(lines, 1)
    start = F.struct(first["hash"].alias("hash"), first["at"].alias("at"), first["words"].alias("words"))
    return F.aggregate(F.slice(lines, 2, LINE_WORDS - 1), start, longer, lambda last: F.when(last["words"] >= LINE_WORDS, last["hash"]))


def _full() -> Column:
    """Hash, words and place of the lines that are not blank."""
    placed = F.transform(F.arrays_zip("hashes", "words"), lambda line, at: F.struct(line["hashes"].alias("hash"), line["words"].alias("words"), at.alias("at")))
    return F.filter(placed, lambda kept: kept["words"] > 0)


def _links() -> Column:
    """What links a text, with its words: the hashes of its long lines, and of the runs about its short ones, which count no words."""
    full = F.col("full")

    def runs(short: Column, i: Column) -> Column:
        start = F.greatest(i - (LINE_WORDS - 2), F.lit(1))
        return F.when(short["words"] < LINE_WORDS, F.array(_run(F.slice(full, i + 1, LINE_WORDS)), _run(F.reverse(F.slice(full, start, i + 2 - start)))))

    own = F.transform(F.filter(full, lambda long: long["words"] >= LINE_WORDS), lambda one: F.struct(one["hash"].alias("hash"), one["words"].alias("words")))
    about = F.flatten(F.filter(F.transform(full, runs), lambda both: both.isNotNull()))
    about = F.transform(F.filter(about, lambda run: run.isNotNull()), lambda found: F.struct(found.alias("hash"), F.lit(0).alias("words")))
    return F.array_distinct(F.concat(own, about))


def _with_owners(held: DataFrame, owners: DataFrame) -> DataFrame:
    """Join on the line; one of more than HEAVY_TEXTS texts is written so often that each part of its texts finds it in a task of its own."""
    parts = F.ceil(F.col("texts") / HEAVY_TEXTS)
    heavy = owners.where(F.col("texts") > HEAVY_TEXTS).select("hash", parts.alias("parts"))
    n = heavy.count()
    if not n:
        return held.join(owners, "hash")
    tagged = held.join(F.broadcast(heavy) if n <= BROADCAST_LINES else heavy, "hash", "left")
    tagged = tagged.withColumn("part", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1)).cast("long"))).drop("parts")
    return tagged.join(owners.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))), ["hash", "part"])


def _deduped(rows: DataFrame) -> DataFrame:
    """rows has doc_id, text and carried, which comes back beside the text that is left and the counts."""
    trimmed = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), F.trim)
    rows = rows.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    lines = rows.where("text <> ''").select(
        "doc_id",
        "key",
        F.transform(trimmed, lambda x: F.xxhash64(x)).alias("hashes"),
        F.transform(trimmed, _words).alias("words"),
    )
    texts = materialize(
        lines.groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("hashes").alias("hashes"), F.first("words").alias("words"))
    )
    held = texts.select("key", "first", _full().alias("full")).select("key", "first", F.explode(_links()).alias("line")).select("key", "first", "line.hash", "line.words")
    owners = materialize(held.groupBy("hash").agg(F.count("*").alias("texts"), F.min(_rank()).alias("owner")).where("texts > 1"))
    links = _with_owners(held, owners).where("key <> owner.key").select(F.col("owner.key").alias("owner"), "key").distinct()
    earlier = texts.select(F.col("key").alias("owner"), F.col("hashes").alias("owner_hashes"))
    pairs = links.select("owner", "key").join(earlier, "owner").join(texts.select("key", "hashes", "words"), "key")
    gone = pairs.select("key", "owner_hashes", "hashes", "words").mapInArrow(_align, "key binary, places array<int>")
    gone = gone.groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"))
    touched = texts.select("key", "first", "copies").join(gone, "key", "left").where("copies > 1 or places is not null")
    joined = rows.join(touched, "key", "left")
    parts = F.split("text", "\n")
    copy = F.col("copies").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first"))
    left = F.filter(parts, lambda x, i: ~F.array_contains("places", i))
    kept = F.when(copy, F.lit("")).when(F.col("places").isNotNull(), F.array_join(left, "\n")).otherwise(F.col("text"))
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(parts)).cast("long")
    removed = F.when(copy, n_lines).otherwise(F.coalesce(F.size("places"), F.lit(0))).cast("long")
    return joined.select("doc_id", "carried", kept.alias("text"), n_lines.alias("n_lines"), F.greatest(removed, F.lit(0)).alias("n_removed"))


def dedup_lines(documents: DataFrame) -> DataFrame:
    """Delete from every document the aligned blocks that it shares with an earlier one.

    Earlier means a smaller doc_id; an exact copy of an earlier text loses all its lines.
    Lines are compared without the white space around them. Lines of LINE_WORDS words
    or more link documents, and so do runs of neighbours about shorter lines; a block goes
    if it has BLOCK_WORDS words. Words are parted by any white space; of scripts without
    blanks one sign or four letters count as a word.

    Returns doc_id, text (the lines left, null if the text was null), n_lines and n_removed.
    A null or empty text has no lines; a repeated row (same id, same text) is the same
    document and keeps its lines as often; null ids come last; other columns are ignored;
    no rows give no rows.
    """
    rows = documents.select("doc_id", "text", F.lit(None).cast("int").alias("carried"))
    return _deduped(rows).drop("carried")


def with_deduped_text(documents: DataFrame) -> DataFrame:
    """All columns of documents, with the lines deleted from text and n_chars brought up to date.

    Documents that lose all their words are dropped; those that had none (null or empty
    texts) stay. Repeated rows and null ids are as dedup_lines has them; no rows give no rows.
    """
    others = [F.col(f"`{c}`") for c in documents.columns if c != "text"]
    done = _deduped(documents.select("doc_id", "text", F.struct(*others).alias("carried")))
    lost = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == "")
    columns = [
        F.col("text") if c == "text" else F.char_length("text").cast(documents.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"carried.`{c}`")
        for c in documents.columns
    ]
    return done.where(~lost).select(*columns)
