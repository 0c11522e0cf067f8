"""Language identification by cross-parsing with suffix automata.

For each language an automaton accepts every substring of a sample of labelled text. A text
is parsed from left to right into the longest phrases that the automaton knows, words and
the blanks between them alike; the language that needs the fewest phrases, normalised by what
unseen text of that language itself needs, wins. All automata are one table with a row per
state, in which a phrase's end is a step to where the next phrase goes on, so that many texts
are parsed together, a character of each at a time.

The sample is bounded: SAMPLE_DOCS documents per language in the order of a hash of their
id, of which at most SAMPLE_CHARS characters are used. All of every text is parsed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statutory.llm.common import materialize, only_warm, same_rows, slices

SAMPLE_DOCS = 120
SAMPLE_CHARS = 60_000
#: Documents longer than this are no sample.
LONGEST_SAMPLE = 20_000
#: Characters that texts are parsed together, and the number of texts below which each goes on alone.
BAND, ALONE = 64, 12


class SuffixAutomaton:
    """The substrings of a text; grows by one character at a time, in constant time each."""

    def __init__(self, text: str) -> None:
        follow: list[dict[str, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in text:
            new = len(follow)
            follow.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in follow[p]:
                follow[p][c] = new
                p = link[p]
            if p >= 0:
                q = follow[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(follow)
                    follow.append(dict(follow[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and follow[p].get(c) == q:
                        follow[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new
        # only the transitions are needed to parse; one table is smaller than many
        number = {c: i for i, c in enumerate(sorted(set(text)))}
        self.number = number
        self.width = len(number)
        self.table = {s * self.width + number[c]: t for s, out in enumerate(follow) for c, t in out.items()}

    def longest(self, text: str, start: int) -> int:
        """Characters of the longest known phrase that starts there."""
        state, at = 0, start
        number, table, width = self.number, self.table, self.width
        while at < len(text):
            c = number.get(text[at])
            after = None if c is None else table.get(state * width + c)
            if after is None:
                break
            state, at = after, at + 1
        return at - start

    def phrases(self, text: str) -> int:
        """Phrases of the greedy parse; an unknown character is a phrase."""
        at = n = 0
        while at < len(text):
            at += max(1, self.longest(text, at))
            n += 1
        return n


#: 256-byte table: ASCII letters and bytes of other characters kept, all else a space.
LETTER_BYTES = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Runs of letters, in lower case, as UTF-8."""
    return text.lower().encode().translate(LETTER_BYTES).split()


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class LanguageModel:
    """One automaton and one norm (phrases per character of its own unseen text) for each language."""

    def __init__(self, samples: dict[str, list[str]], sample_chars: int = SAMPLE_CHARS) -> None:
        self.languages = sorted(samples)
        self.automata: list[SuffixAutomaton] = []
        self._table: np.ndarray | None = None
        self._numbers: np.ndarray | None = None
        unseen = []
        for language in self.languages:
            texts = [b" ".join(words_of(t)).decode() for t in samples[language]]
            seen = [t for i, t in enumerate(texts) if i % 5 != 4]
            unseen.append(" ".join(texts[4::5] or texts))
            self.automata.append(SuffixAutomaton((" " + " ".join(seen) + " ")[:sample_chars]))
        self.norms = [1.0] * len(self.languages)
        if self.languages:
            counts, chars = self.phrases(unseen)
            self.norms = [max(1, int(counts[i, i])) / int(chars[i]) for i in range(len(unseen))]

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_table": None, "_numbers": None}  # each worker builds its own

    def forget(self) -> None:
        self._table = self._numbers = None

    def _build(self) -> None:
        """The table: by language, state and character the next state's row and, in the two lowest bits, how many phrases end there."""
        letters = sorted(set().union(*(a.number for a in self.automata)))
        self._unknown, self._none = len(letters), len(letters) + 1  # a character that no sample has, and no character at all
        width = len(letters) + 2
        self._numbers = np.full(0x110000, self._unknown, np.int32)
        self._numbers[[ord(c) for c in letters]] = np.arange(len(letters))
        parts, self._roots, first = [], [], 0
        for automaton in self.automata:
            own = np.array([letters.index(c) for c in automaton.number], np.int64)
            keys, after = (np.fromiter(x, np.int64, len(automaton.table)) for x in (automaton.table.keys(), automaton.table.values()))
            states = int(after.max(initial=0)) + 1
            steps = np.full((states, width), -1, np.int64)
            steps[keys // automaton.width, own[keys % automaton.width]] = after
            root = first * width
            begins = steps[0].copy()  # where a phrase that begins with a character leads to
            fresh = np.where(begins >= 0, 4 * (root + begins * width) + 1, 4 * root + 2)
            values = np.where(steps >= 0, 4 * (root + steps * width), fresh[None, :])
            values[0] = np.where(begins >= 0, 4 * (root + begins * width), 4 * root + 1)  # at a root no phrase is open
            values[:, self._none] = 4 * (root + np.arange(states) * width)
            parts.append(values)
            self._roots.append(root)
            first += states
        table = np.concatenate(parts).reshape(-1)
        self._table = table.astype(np.int32) if table.max(initial=0) < 1 << 31 else table

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of the greedy parse of each text (rows) in each language, and the characters that were parsed."""
        if self._table is None:
            self._build()
        codes = [self._numbers[np.frombuffer(f" {' '.join(x.decode() for x in words_of(t))} ".encode("utf-32-le"), "<u4")] for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        order = np.argsort(-sizes, kind="stable")
        falling = sizes[order]
        begins = (np.cumsum(sizes) - sizes)[order]
        flat = np.concatenate([*codes, np.array([self._none], np.int32)])
        roots = np.array(self._roots, np.int64)[:, None]
        states, counts = np.repeat(roots, len(texts), 1), np.zeros((len(roots), len(texts)), np.int64)
        at, n = 0, int((falling > 0).sum())
        while n >= ALONE:
            places = np.arange(at, at + BAND)[:, None]
            rows = flat[np.where(places < falling[None, :n], begins[None, :n] + places, len(flat) - 1)]
            state, count = states[:, :n].copy(), counts[:, :n].copy()
            for row in rows:
                step = self._table.take(state + row)
                count += step & 3
                state = step >> 2
            states[:, :n], counts[:, :n] = state, count
            at += BAND
            n = int((falling > at).sum())
        table = memoryview(self._table)
        for i in range(n):  # the ends of the longest texts
            rest = flat[begins[i] + at : begins[i] + falling[i]].tolist()
            for k in range(len(roots)):
                state, count = int(states[k, i]), 0
                for c in rest:
                    step = table[state + c]
                    count += step & 3
                    state = step >> 2
                states[k, i] = state
                counts[k, i] += count
        counts += states != roots  # the last phrase is open yet
        out = np.empty_like(counts.T)
        out[order] = counts.T
        return out, sizes

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of each text and how sure it is (0 to 1); `und` for texts without letters. Ties go to the first name."""
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        asked = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        if asked:
            counts, chars = self.phrases([texts[i] for i in asked])
            costs = counts / (chars[:, None] * np.array(self.norms)[None, :])
            for i, row in zip(asked, costs.tolist(), strict=True):
                best = min(range(len(row)), key=row.__getitem__)
                out[i] = self.languages[best], 1 / sum(math.exp(8 * (row[best] - c)) for c in row)
        return out


def sample_texts(documents: DataFrame, learn: Column, n: int = SAMPLE_DOCS) -> dict[str, list[str]]:
    """At most n texts for each language among the rows to learn from."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = documents.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)).between(20, LONGEST_SAMPLE)))
    ids = rows.select("doc_id", "lang").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")
    texts = documents.where(learn).select("doc_id", "lang", "text").join(F.broadcast(materialize(ids).distinct()), ["doc_id", "lang"])
    out: dict[str, list[str]] = {}
    for r in sorted(texts.select("lang", "doc_id", "text").toLocalIterator(), key=lambda r: (r.lang, r.doc_id)):
        if r.text:
            out.setdefault(r.lang, []).append(r.text)
    return out


def identify(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row; null texts and texts without letters are `und` with score 0."""
    docs = documents.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = only_warm("language", shared.value, LanguageModel.forget)
        for batch in slices(batches, "text"):
            found = own.predict_all(batch.column("text").to_pylist())
            yield same_rows(batch, ["doc_id"], {
                "lang_pred": pa.array([x for x, _ in found], pa.string()),
                "score": pa.array([s for _, s in found], pa.float64()),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def identify_languages(documents: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the labelled documents that are not held out, then identify every document.

    Returns doc_id, held_out, lang_pred and score. A null doc_id is never learnt from and
    is not held out; without any labelled text every document is `und`; repeated rows are
    repeated; other columns are ignored; no rows give no rows.
    """
    model = LanguageModel(sample_texts(documents, ~F.coalesce(held_out, F.lit(True))))
    return identify(documents, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
