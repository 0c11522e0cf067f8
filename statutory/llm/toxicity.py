"""Toxicity: a linear-chain conditional random field over tokens, from document labels.

Documents carry labels, tokens do not, so tokens are labelled first: a word or word
beginning that marks toxic documents and hardly any others in the sample makes its tokens
toxic where the document is. A two-state chain is then trained on the labelled tokens. Its
forward-backward marginals give every token of every document a probability; from these
come the offending spans and, by a logistic fit on two of their aggregates, the score.

The sample is bounded: SAMPLE_TOXIC and SAMPLE_CLEAN labelled documents in the order of a
hash of their id, of at most LONGEST_SAMPLE characters each; the chain is trained on whole
texts of it, of TRAIN_TOKENS tokens in all. All of every text is scored, as one chain.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutory.llm.common import WORD_BYTES, materialize, only_warm, row_field, row_slices, same_rows, slices

SAMPLE_TOXIC, SAMPLE_CLEAN = 1200, 2400
LONGEST_SAMPLE = 20_000
#: A marker is in at least this share of the sample's toxic documents, and in so many documents.
MARKER_SHARE, MARKER_DOCS = 0.015, 4
#: Of the documents that hold a marker, weighted to equal classes, this share is toxic.
MARKER_PURITY = 0.97
#: A beginning whose most frequent word is in this share of its documents marks nothing beyond that word.
ONE_WORD = 0.8
FEATURES = 1 << 16
#: Tokens to train on, in whole texts: at most two thirds in texts with toxic ones, then clean texts spread evenly over the sample.
TRAIN_TOKENS = 600_000
#: Places that texts walk together, and the number of texts below which each goes on alone.
BAND, ALONE = 128, 12
CACHE_WORDS = 200_000
#: Text bytes that a task scores at once, except where one text alone is longer.
SCORED_BYTES = 1 << 20
#: Tokens above this marginal are offending.
SPAN_THRESHOLD = 0.5


def tokens_of(text: str) -> list[bytes]:
    """Words in lower case, as UTF-8: runs of letters, digits and other non-ASCII characters."""
    return text.lower().encode().translate(WORD_BYTES).split()


def signs_of(word: bytes) -> list[bytes]:
    """What a word is known by: itself, its beginnings of 3 to 6 characters and its last three."""
    text = word.decode("utf-8", "replace")
    return [b"=" + word, *(b"^" + text[:n].encode() for n in range(3, 7) if len(text) >= n), b"$" + text[-3:].encode()]


def feature_ids(word: bytes) -> np.ndarray:
    return np.array([zlib.crc32(s) % FEATURES for s in signs_of(word)], np.int64)


def without_near_copies(docs: list[np.ndarray]) -> list[np.ndarray]:
    """Documents of which no earlier one shares a minimum of the hashes of four-word runs: near-copies count once."""
    factors = np.array([[0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5]], np.uint64)
    seen: set[tuple[int, int]] = set()
    out = []
    for doc in docs:
        words = doc.astype(np.uint64)
        runs = np.lib.stride_tricks.sliding_window_view(words, 4) if len(words) >= 4 else np.pad(words, (0, 4 - len(words)))[None, :]
        hashes = ((runs + np.uint64(1)) * factors).sum(1, dtype=np.uint64)
        least = set()
        for k in range(4):
            mixed = (hashes ^ np.uint64(k * 0x9E37)) * np.uint64(0xD6E8FEB86659FD93)
            least.add((k, int((mixed ^ (mixed >> np.uint64(29))).min())))
        if seen.isdisjoint(least):
            out.append(doc)
        seen |= least
    return out


def find_markers(toxic: list[np.ndarray], clean: list[np.ndarray], words: list[bytes]) -> np.ndarray:
    """Which words hold a sign (a word, or a beginning of four characters or more) that marks toxic documents.

    Documents come as arrays of word numbers. Clean documents are only searched for signs
    that enough toxic ones hold. Near-copies count as one document.
    """
    toxic, clean = without_near_copies(toxic), without_near_copies(clean)
    usable = lambda s: s[:1] == b"=" or (s[:1] == b"^" and len(s.decode("utf-8", "replace")) > 4)
    count: Counter[bytes] = Counter()
    by_word: Counter[int] = Counter()
    for doc in toxic:
        own = np.unique(doc).tolist()
        by_word.update(own)
        count.update({s for w in own for s in signs_of(words[w]) if usable(s)})
    least = max(MARKER_DOCS, MARKER_SHARE * len(toxic))
    often = {s for s, n in count.items() if n >= least}
    main = Counter()  # by beginning, the documents of its most frequent word
    for i, n in by_word.items():
        for s in often.intersection(signs_of(words[i])):
            main[s] = max(main[s], n)
    often = {s for s in often if s[:1] == b"=" or main[s] < ONE_WORD * count[s]}  # else the word says it all
    held = {i: found for i, w in enumerate(words) if (found := often.intersection(signs_of(w)))}
    clean_count: Counter[bytes] = Counter()
    for doc in clean:
        clean_count.update({s for w in np.unique(doc).tolist() if w in held for s in held[w]})
    odds = len(toxic) / max(1, len(clean))
    marks = {s for s in often if count[s] >= MARKER_PURITY * (count[s] + odds * clean_count[s])}
    out = np.zeros(len(words), bool)
    out[[i for i, found in held.items() if not marks.isdisjoint(found)]] = True
    return out


@dataclass
class ChainModel:
    """Emissions by feature and transitions of the chain, and the fit of the score."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES, np.float64))
    bias: float = 0.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    score_fit: tuple[float, float, float] = (0.0, 0.0, 0.0)
    known: dict[bytes, float] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}

    def emissions(self, words: list[bytes]) -> np.ndarray:
        """Log-odds of the toxic state for each word, remembered by word."""
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        try:
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))
        except KeyError:
            for w in set(words).difference(known):
                known[w] = float(self.weights[feature_ids(w)].sum()) + self.bias
            return np.fromiter(map(known.__getitem__, words), np.float64, len(words))

    def marginals(self, lengths: list[int], emissions: np.ndarray) -> np.ndarray:
        """Probability of the toxic state for every token of texts with these many tokens."""
        return forward_backward(lengths, emissions, self.transitions)[0]


def _alone(odds: list[float], message: float, weights: tuple[float, float, float, float]) -> list[float]:
    """The messages before each token of one text, walked from the given message on, and the one after its end."""
    a, b, c, d = weights
    out = [message]
    for x in odds:
        x *= message
        message = (a + x * b) / (c + x * d)
        out.append(message)
    return out


def forward_backward(lengths: list[int], emissions: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the toxic state for every token, and the expected transitions, of texts as uncut chains.

    With two states a message is one number, the odds of toxic over clean. Texts walk together
    by falling length, in bands of BAND places, and hand their messages from band to band; the
    ends of the longest, of which fewer than ALONE are left, are walked one by one.
    """
    cc, ct, tc, tt = np.exp(np.clip(transitions, -20, 20)).reshape(-1).tolist()
    odds = np.exp(np.clip(emissions, -40, 40))
    ahead, back = np.ones(len(odds)), np.ones(len(odds))
    sizes = np.asarray(lengths, np.int64)
    order = np.argsort(-sizes, kind="stable")
    begins = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    longer = lambda at: int((sizes > at).sum())  # noqa: E731  texts that reach place `at`, which come first
    reach, bands = 0, []
    while longer(reach) >= ALONE:
        n = longer(reach)
        places = np.arange(reach, reach + BAND)[:, None]
        filled = places < sizes[None, :n]
        bands.append((np.where(filled, begins[:n] + places, 0), filled))
        reach += BAND
    message = np.ones(len(sizes))
    for rows, filled in bands:
        message, here = message[: filled.shape[1]], odds[rows]
        found = np.empty_like(here)
        for t in range(BAND):
            found[t] = message
            x = here[t] * message
            message = (ct + x * tt) / (cc + x * tc)
        ahead[rows[filled]] = found[filled]
    later = np.zeros(0)  # the message from the next band on, of the texts that have one
    if tails := longer(reach):
        later = np.ones(tails)
        for i in range(tails):
            rest = slice(begins[i] + reach, begins[i] + sizes[i])
            own = odds[rest].tolist()
            ahead[rest] = _alone(own, float(message[i]), (ct, tt, cc, tc))[:-1]
            found = _alone(own[::-1], 1.0, (tc, tt, cc, ct))
            back[rest] = found[-2::-1]
            later[i] = found[-1]
    for rows, filled in reversed(bands):
        here = odds[rows]
        found = np.empty_like(here)
        message = np.ones(filled.shape[1])
        message[: len(later)] = later
        for t in range(BAND - 1, -1, -1):
            found[t] = message
            x = here[t] * message
            message = np.where(filled[t], (tc + x * tt) / (cc + x * ct), 1.0)
        back[rows[filled]] = found[filled]
        later = message
    both = ahead * odds * back
    inner = np.ones(len(odds), bool)
    inner[begins[sizes > 0]] = False  # first tokens follow none
    after = np.flatnonzero(inner)
    a, b = (ahead * odds)[after - 1], (odds * back)[after]
    pair = np.stack([np.full(len(after), cc), ct * b, tc * a, tt * a * b])
    return both / (1 + both), (pair / pair.sum(0)).sum(1).reshape(2, 2)


def train_chain(texts: list[np.ndarray], labels: list[np.ndarray], vocabulary: list[bytes], rounds: int = 30, l2: float = 1e-6) -> ChainModel:
    """Fit the chain to token labels by gradient steps with per-weight rates; texts are arrays of word numbers."""
    model = ChainModel()
    positive = np.array([x.any() for x in labels], bool)
    sizes = np.array([len(x) for x in texts], np.int64)
    chosen: list[int] = []
    for group, until in ((np.flatnonzero(positive), TRAIN_TOKENS * 2 // 3), (np.flatnonzero(~positive), TRAIN_TOKENS)):
        room = until - int(sizes[chosen].sum())
        step = max(1, -(-int(sizes[group].sum()) // max(1, room)))
        spread = np.concatenate([group[k::step] for k in range(step)]).astype(int)
        chosen += spread[np.cumsum(sizes[spread]) <= room].tolist()
    words = np.concatenate([*(texts[i] for i in chosen), np.zeros(0, np.int64)]).astype(np.int64)
    gold = np.concatenate([*(labels[i] for i in chosen), np.zeros(0)]).astype(float)
    sizes = sizes[chosen].tolist()
    if not len(words):
        return model
    used, words = np.unique(words, return_inverse=True)
    ids = [feature_ids(vocabulary[i]) for i in used.tolist()]
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in ids])
    flat = np.concatenate(ids)
    inner = np.ones(len(words), bool)
    inner[np.cumsum([0, *sizes])[:-1][np.array(sizes) > 0]] = False
    after = np.flatnonzero(inner)
    pairs = np.bincount((2 * gold[after - 1] + gold[after]).astype(int), minlength=4).reshape(2, 2).astype(float)
    share = float(np.clip(gold.mean(), 1e-6, 1 - 1e-6))
    model.bias = math.log(share / (1 - share))
    squares, transition_squares, bias_squares = np.full(FEATURES, 1e-8), np.full((2, 2), 1e-8), 1e-8
    size = len(words)
    for _ in range(rounds):
        per_word = np.bincount(owner, model.weights[flat], len(ids)) + model.bias
        marginal, expected = forward_backward(sizes, per_word[words], model.transitions)
        error = np.bincount(words, gold - marginal, len(ids))
        gradient = np.bincount(flat, error[owner], FEATURES) / size - l2 * model.weights
        squares += gradient**2
        model.weights += gradient / np.sqrt(squares)
        change = (pairs - expected) / size - l2 * model.transitions
        transition_squares += change**2
        model.transitions += 0.3 * change / np.sqrt(transition_squares)
        step = error.sum() / size
        bias_squares += step**2
        model.bias += 0.3 * step / math.sqrt(bias_squares)
    return model


def aggregates(marginals: np.ndarray) -> tuple[float, float]:
    """What the score is made of: the largest marginal and the log of the expected number of toxic tokens."""
    if not len(marginals):
        return 0.0, 0.0
    sure = marginals[marginals > 0.05]
    return float(marginals.max()), math.log1p(float(sure.sum()))


def fit_score(values: np.ndarray, toxic: np.ndarray, rounds: int = 60) -> tuple[float, float, float]:
    """Logistic fit of document labels on the aggregates, with non-negative slopes, classes weighted alike."""
    if not 0 < toxic.sum() < len(toxic):
        return (-4.0, 0.0, 0.0) if not toxic.sum() else (4.0, 0.0, 0.0)
    x = np.column_stack([np.ones(len(values)), values])
    w = np.where(toxic > 0, 0.5 / toxic.sum(), 0.5 / (len(toxic) - toxic.sum()))
    beta = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(3)
        beta = beta + np.linalg.solve(h, x.T @ (w * (toxic - p)) - 1e-4 * beta)
        beta[1:] = np.maximum(beta[1:], 0)
    return tuple(float(b) for b in beta)


def train(sample: list[tuple[str, int]]) -> ChainModel:
    """A model from texts with document labels; without toxic texts nothing is toxic."""
    number: dict[bytes, int] = {}
    texts = [np.array([number.setdefault(w, len(number)) for w in tokens_of(t)], np.int32) for t, _ in sample]
    vocabulary = list(number)
    toxic = np.array([y for _, y in sample], float)
    marked = find_markers([t for t, y in zip(texts, toxic, strict=True) if y], [t for t, y in zip(texts, toxic, strict=True) if not y], vocabulary)
    labels = [marked[t] & bool(y) for t, y in zip(texts, toxic, strict=True)]
    model = train_chain(texts, labels, vocabulary)
    values = []
    for at in range(0, len(sample), 200):  # in parts, to hold few marginals
        values += [aggregates(m) for m in text_marginals(model, [tokens_of(t) for t, _ in sample[at : at + 200]])]
    model.score_fit = fit_score(np.array(values).reshape(-1, 2), toxic)
    return model


def text_marginals(model: ChainModel, texts: list[list[bytes]]) -> list[np.ndarray]:
    """The marginals of every text's tokens."""
    lengths = [len(t) for t in texts]
    if not lengths:
        return []
    marginals = model.marginals(lengths, model.emissions([w for t in texts for w in t]))
    return np.split(marginals, np.cumsum(lengths)[:-1])


def _score(fit: tuple[float, float, float], values: tuple[float, float]) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, fit[0] + fit[1] * values[0] + fit[2] * values[1]))))


def token_offsets(text: str) -> list[tuple[int, int]]:
    """Character ranges in text of its tokens, in their order."""
    return [m.span() for m in re.finditer(r"[0-9A-Za-z\u0080-\U0010ffff]+", text)]


def score_texts(model: ChainModel, texts: list[str]) -> list[tuple[float, list[dict]]]:
    """Score and offending spans of every text."""
    words = [tokens_of(t) for t in texts]
    out = []
    for text, tokens, own in zip(texts, words, text_marginals(model, words), strict=True):
        n = len(tokens)
        spans: list[dict] = []
        hit = np.flatnonzero(own > SPAN_THRESHOLD).tolist()
        if hit:
            places = token_offsets(text)
            if len(places) != n:  # lower case changed the tokens of this text
                places = token_offsets(text.lower())
            last = -2
            for i in hit:
                start, end = places[i] if i < len(places) else (len(text), len(text))
                if i == last + 1:
                    spans[-1]["end"] = end
                    spans[-1]["probability"] = max(spans[-1]["probability"], float(own[i]))
                else:
                    spans.append({"start": start, "end": end, "probability": float(own[i])})
                last = i
        out.append((_score(model.score_fit, aggregates(own)), spans))
    return out


def sample_labelled(documents: DataFrame, labels: DataFrame, learn: Column, n_toxic: int = SAMPLE_TOXIC, n_clean: int = SAMPLE_CLEAN) -> list[tuple[str, int]]:
    """The bounded sample to learn from: texts and labels, equal texts once.

    A document with several labels takes the largest; null labels and null ids are no labels.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.where(learn)
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids = known.where("toxic > 0").orderBy(*order).limit(n_toxic).union(known.where("toxic <= 0").orderBy(*order).limit(n_clean))
    texts = documents.select("doc_id", "text").where(F.length("text") <= LONGEST_SAMPLE)
    rows = texts.join(F.broadcast(materialize(ids)), "doc_id").select("text", "toxic", "doc_id").toLocalIterator()
    return sorted({(r.text, int(r.toxic > 0)) for r in rows})


def train_on(documents: DataFrame, labels: DataFrame, learn: Column) -> ChainModel:
    return train(sample_labelled(documents, labels, learn))


def score_documents(documents: DataFrame, model: ChainModel) -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 from 0.5 on) and spans (character ranges with their probability) of every row.

    Null and empty texts have no tokens and take the score of a text without any toxic one;
    repeated rows are repeated; other columns are ignored; no rows give no rows.
    """
    docs = documents.select("doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = only_warm("toxicity", shared.value, lambda m: m.known.clear())
        for batch in slices(batches, "text", SCORED_BYTES):
            found = score_texts(own, [t or "" for t in batch.column("text").to_pylist()])
            span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())])
            yield same_rows(batch, ["doc_id"], {
                "score": pa.array([s for s, _ in found], pa.float64()),
                "predicted": pa.array([int(s >= 0.5) for s, _ in found], pa.int32()),
                "spans": pa.array([x for _, x in found], pa.list_(span)),
            })

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, score double, predicted int, spans array<struct<start:long,end:long,probability:double>>")


def keep_clean(documents: DataFrame, model: ChainModel) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns, in one pass without a shuffle.

    Null texts are scored as empty ones; repeated rows stay or go alike, null ids stay; no
    rows give no rows.
    """
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by FEATURES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = only_warm("toxicity", shared.value, lambda m: m.known.clear())
        for batch in row_slices(batches, "row", "text", SCORED_BYTES):
            found = score_texts(own, [t or "" for t in row_field(batch, "row", "text").to_pylist()])
            yield batch.filter(pa.array([s < 0.5 for s, _ in found], pa.bool_()))

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}").select("row.*")
