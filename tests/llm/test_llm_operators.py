"""The training-data operators against brute force on small fixtures, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from statutory.llm import chat, components, decontaminate, html, language, lines, media, packing, repeats, simhash, toxicity
from statutory.llm.queries import ORACLES, QUERIES
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, k=400):
    return " ".join(f"w{rng.randrange(k)}x" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty texts, copies, near-copies, shared passages, repeats inside a text, one long text, non-ASCII."""
    rng = random.Random(5)
    base = [words(rng, rng.randrange(1, 160)) for _ in range(25)]
    passage = words(rng, 110, 5000)
    near = base[3].split() * 4
    changed = list(near)
    changed[7] = "other"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(100, None), (101, ""), (102, "   \n \t"), (103, base[2]), (103, base[2]), (104, " ".join(near)), (105, " ".join(changed)), (106, " ".join(near))]
    rows += [(110, f"start {passage} end"), (111, f"{words(rng, 50)} {passage}"), (112, f"Ünï {passage} çödé ß漢字 {passage}"), (113, "ab" * 900), (114, words(rng, 5000, 10**6))]
    rows += [(None, base[4]), (115, "One line here with words\nlast"), (118, "a <|endoftext|> b<|endoftext|>"), (116, "\n".join(["first line of five words", "second line of five words", "x", "third line of five words"]))]
    rows += [(117, "\n".join(["fourth line of five words", "second line of five words", "x", "third line of five words"]))]
    return rows


@pytest.fixture(scope="module")
def documents(spark, texts):
    made = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)
    clash = ("score", "fp", "key", "media", "piece", "hits", "items", "length", "host", "row", "bucket", "predicted", "carried", "first")
    return made.select("*", *[F.lit("clash").alias(c) for c in clash])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# --- decontamination


def test_decontamination(spark, documents, texts):
    rng = random.Random(1)
    target = next(t for i, t in texts if i == 114).split()
    items = [(1, " ".join(target[100:140])), (2, " ".join(target[50:60])), (3, "Other"), (4, None), (5, "..."), (6, words(rng, 40, 10**7)), (None, " ".join(target[300:320])), (7, " ".join(target[100:140]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: pattern.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    windows: dict[tuple, set] = {}
    for item, t in items:
        w = split(t)
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    want = []
    for i, t in texts:
        w, hit, found = split(t), set(), set()
        for k in {len(x) for x in windows}:
            for at in range(len(w) - k + 1):
                if tuple(w[at : at + k]) in windows:
                    hit.update(range(at, at + k))
                    found |= windows[tuple(w[at : at + k])]
        names = sorted(str(x) for x in found if x is not None)
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    for block in (decontaminate.BLOCK_CHARS, 100):  # in one block, and in several
        found = decontaminate.benchmark_matches(documents, benchmark, block_chars=block)
        got = found.select("doc_id", "n_words", decontaminate.n_hit(), F.size("items"), F.sha2(F.array_join("items", ","), 256), decontaminate.is_contaminated()).collect()
        assert Counter(map(tuple, got)) == Counter(want)
    longest = {r.doc_id: r.longest for r in decontaminate.benchmark_matches(documents, benchmark).collect()}
    assert longest[114] == 40 and longest[0] == 0
    kept = decontaminate.remove_contaminated(documents, benchmark)
    assert kept.columns == documents.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_, bad in want if not bad)


def test_decontamination_of_repeated_words():
    """Work grows with the words and matches, not with the pairs of equal suffixes."""
    item, text = b"a " * 2000, b"a " * 20_000
    began = time.process_time()
    (n, found), (_, other) = decontaminate.search_shard([text, b"b a " * 50], decontaminate.BenchmarkBlock([("i", item.decode())], 13))
    assert time.process_time() - began < 3
    assert n == 20_000 and max(x[3] for x in found) == 2000 and not other
    assert decontaminate._merge([(p, p + size) for _, _, p, size in found]) == [(0, 20_000)]
    assert len(found) <= 22_000


def test_decontamination_of_nothing(spark, documents, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination_report(nothing, none).count() == 0
    assert decontaminate.contamination_report(documents, none).where("contaminated").count() == 0


# --- repeats


def removed(texts, length):
    data = [(t or "").encode() for _, t in texts]
    counts = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for (key, _), b in zip(texts, data, strict=True):
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - length + 1):
            if counts[b[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[1:-1]])
        out.append((key, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def repeated_words(texts, size):
    split = [(key, (t or "").encode().split()) for key, t in texts]
    counts = Counter(tuple(w[i : i + size]) for _, w in split for i in range(len(w) - size + 1))
    out = []
    for key, w in split:
        out.append((key, len({k for i in range(len(w) - size + 1) if counts[tuple(w[i : i + size])] > 1 for k in range(i, i + size)})))
    return Counter(out)


@pytest.mark.parametrize("group, chunk", [(2000, 1 << 20), (0, 1 << 20), (2000, 300)])
def test_repeats(documents, texts, monkeypatch, group, chunk):
    monkeypatch.setattr(repeats, "GROUP_CONTEXTS", group)  # 0: every start is a row of its own
    found = repeats.repeat_report(documents).collect()
    assert Counter(tuple(r)[:5] for r in found) == removed(texts, 400)
    assert Counter((r.doc_id, r.n_repeated_words) for r in found) == repeated_words(texts, 51)


def test_samples_do_not_depend_on_the_surroundings():
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 120, 1500, dtype=np.uint8)
    one = np.concatenate([rng.integers(97, 120, 777, dtype=np.uint8), shared])
    two = np.concatenate([shared, rng.integers(97, 120, 333, dtype=np.uint8)])
    starts = []
    for data, offset in ((one, 777), (two, 0)):
        first, more, grams, _ = repeats.samples(repeats.byte_symbols(data.tobytes()), 400, 64)
        decided = {int(s): int(g) for f, m, g in zip(first, more, grams, strict=True) for s in range(f, f + m + 1)}
        assert sorted(decided) == list(range(len(data) - 399))
        starts.append([decided[offset + i] for i in range(1101)])
    assert starts[0] == starts[1]


def test_periodic_texts_have_few_samples():
    """A text of a short period is two samples a chunk, whatever its length, and they decide every start."""
    rng = np.random.default_rng(5)
    for period in (1, 2, 7, 100, 300):
        data = np.tile(rng.integers(97, 123, period, dtype=np.uint8), 60_000 // period + 1)
        first, more, _, _ = repeats.samples(repeats.byte_symbols(data.tobytes()), 400, 64)
        assert len(first) <= 6 and sum(more + 1) == len(data) - 399
        assert (first[1:] == (first + more + 1)[:-1]).all()


def test_repeats_in_periodic_texts(spark, monkeypatch):
    rng = random.Random(6)
    unit = "".join(rng.choice("abcd") for _ in range(331))
    rows = [(1, "-" * 5000), (2, "x" * 399), (3, "y" * 400), (4, "z" * 401), (5, "ab" * 1500), (6, unit * 9), (7, "start " + "=-" * 700 + " end"), (8, "head " + "-" * 450), (9, unit[5:] * 3 + "tail"), (10, "w " * 900), (11, "\n" * 777)]
    got = repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r)[:5] for r in got) == removed(rows, 400)
    assert Counter((r.doc_id, r.n_repeated_words) for r in got) == repeated_words(rows, 51)


def test_repeats_in_long_periodic_texts(spark):
    """Texts of millions of bytes and a short period go as a whole; nothing of them is held for every byte."""
    rows = [(1, "-" * 6_000_000), (2, "a long day " * 300_000), (3, "no copy")]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in repeats.repeat_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (6_000_000, 6_000_000, 1), 2: (3_300_000, 3_300_000, 1), 3: (7, 0, 0)}


def test_repeats_of_nothing(nothing):
    assert repeats.repeat_report(nothing).count() == 0


# --- SimHash


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    runs = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(documents, texts):
    prints = [fingerprint(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for i, (key, _) in enumerate(texts):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    want = Counter((key, f"{prints[i]:016x}", least.get(find(i))) for i, (key, _) in enumerate(texts))
    assert Counter(map(tuple, simhash.near_duplicates(documents).collect())) == want
    kept = simhash.keep_one_per_group(documents)
    assert kept.columns == documents.columns
    assert {r.doc_id for r in kept.collect()} == set(least.values())


def test_one_row_of_every_group_is_kept(spark):
    """Rows without an id, repeated rows, and one id with the texts of two groups."""
    rng = random.Random(8)
    one, two, three, four = (words(rng, 60, 10**6) for _ in range(4))
    rows = [(None, one), (None, two), (None, two), (3, three), (3, three), (1, four), (3, four), (5, three), (None, three)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("other", F.lit(1))
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(None, one), (None, two), (3, three), (1, four)])
    assert simhash.keep_one_per_group(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket_rows", [2000, 1])
def test_links_of_close_fingerprints(spark, bucket_rows):
    """A dense group and far ones: what links within four bits is connected, in large buckets too."""
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    prints = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))) for _ in range(120)} | {rng.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    found = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"), bucket_rows).collect()
    root = {x: x for x in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in found:
        assert ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4
        root[find(r.a)] = find(r.b)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4:
                assert find(a) == find(b)


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, None)]
    found = components.components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.root for r in found if r.root == 0}.keys() == set(range(1, 41))
    assert (101, 100) in {(r.node, r.root) for r in found}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- packing


def test_packing(documents, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack(documents).collect()
    want = Counter()
    for key, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        head = len(ids) % 1024 or 1024
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(key, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == want
    by_sequence: dict[int, list] = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in found)
    assert len(by_sequence) <= -(-total // 1024) + 3


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(0)
    counts = np.bincount(rng.integers(1, 1025, 20_000), minlength=1025)
    plan = packing.plan(counts)
    used = Counter()
    for lengths, times in plan:
        assert sum(lengths) <= 1024
        for length in lengths:
            used[length] += times
    assert used == Counter({i: int(n) for i, n in enumerate(counts) if n})
    least = -(-int((counts * np.arange(1025)).sum()) // 1024)
    assert sum(t for _, t in plan) <= 1.005 * least


def test_encoder_matches_the_tokenizer():
    from tokenizers import Tokenizer

    import public_tokenizers

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.Encoder.of(packing.tokenizer_path())
    for text in ("a b  c", " lead", "trail ", "x\n y", "don't I'll 12 345", "ünï çödé 漢字　x", "a b c", "tab\tb c", "<|endoftext|> x", "x <|endoftext|> y<|endoftext|>z", "<|endoftext", "!! ?? ..", "a\x1c b", "", " "):
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_packing_nothing(nothing):
    assert packing.pack(nothing).count() == 0


# --- media


def test_media(documents, texts):
    found = media.media_features(media.with_media(documents)).collect()
    want = Counter()
    for key, text in texts:
        payload = media.payload_of((text or "").encode())
        assert len(payload) % 192 == 0 and payload
        want[(key, len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in found) == want
    hashes = {r.payload_sha256: bytes(r.cosine_hash) for r in found}
    assert all(bytes(r.cosine_hash) == hashes[r.payload_sha256] and len(r.cosine_hash) == 8 for r in found)


def _filtered(rows, kind, bpp=3):
    """Rows filtered by the definition of each filter, one sample at a time."""
    out = bytearray()
    for y, row in enumerate(rows):
        out.append(kind)
        for i, x in enumerate(row):
            a = int(row[i - bpp]) if i >= bpp else 0
            b = int(rows[y - 1][i]) if y else 0
            c = int(rows[y - 1][i - bpp]) if y and i >= bpp else 0
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            out.append((int(x) - (0, a, b, (a + b) // 2, near)[kind]) % 256)
    return bytes(out)


@pytest.mark.parametrize("kind", range(5))
def test_unfiltering(kind):
    rows = np.random.default_rng(kind).integers(0, 256, (6, 15), dtype=np.uint8)
    lines_ = np.frombuffer(_filtered(rows, kind), np.uint8).reshape(6, 16)
    assert (media._unfilter(lines_, 3) == rows).all()


def test_broken_images():
    good = media.write_png(media.payload_of(b"some text"))
    assert media.read_png(good).tobytes() == media.payload_of(b"some text")
    for bad in (b"", b"x", good[:-5], good[:40] + bytes([good[40] ^ 1]) + good[41:]):
        with pytest.raises(ValueError):
            media.read_png(bad)


# --- pages

PAGE = (
    "<!DOCTYPE html><html><head><title>t</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/x>Menu</a></li></ul></nav>"
    "<div class='ad'>Buy</div><article><h1>Head &amp; line</h1><p><b>One   two<br><p>Thr&eacute;e <i>four</i></p><div class=comments><p>me too</p></div><form>mail</form></article>"
    "<aside>side</aside><footer>&copy; foot</footer></body></html>"
)


def test_pages(spark):
    rows = [(1, "http://a.example/1", PAGE), (2, "http://a.example/2", PAGE.replace("One", "Uno")), (3, None, None), (4, "http://b.example/", ""), (5, "junk", "no markup & more"), (6, "http://c.example", "<div id=x><p>unclosed <b>text"), (1, "http://a.example/1", PAGE)]
    found = {(r.page_id, r.text) for r in html.page_report(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("x"))).collect()}
    assert found == {(1, "Head & line\nOne two\nThrée four"), (2, "Head & line\nUno two\nThrée four"), (3, ""), (4, ""), (5, "no markup & more"), (6, "unclosed text")}
    assert html.page_report(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_wrapper_groups():
    pages = [f"<div><h1>T{i}</h1><ul>{'<li>x</li>' * (i + 1)}</ul>{'<p>more</p>' if i else ''}</div>" for i in range(3)]
    wrapper = html.infer(pages)
    assert "+" in str(wrapper) and "?" in str(wrapper) and "<h0>" in str(wrapper)
    assert wrapper.template_texts() == ["more"] or "T0" not in wrapper.template_texts()


# --- line dedup


def test_lines(spark, documents, texts):
    found = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in lines.dedup_lines(documents).collect()}
    assert lines.dedup_lines(documents).count() == len(texts)
    assert found[(116, texts[-2][1])] == (4, 0)
    assert found[(117, "fourth line of five words")] == (4, 3)
    assert found[(100, None)] == (0, 0) and found[(101, "")] == (0, 0)
    assert found[(103, "")][1] == 1 and found[(106, "")][1] == 1  # exact copies of earlier texts
    assert found[(None, "")][1] == 1
    kept = lines.with_deduped_text(documents)
    assert kept.columns == documents.columns
    assert {100, 101, 102} <= {r.doc_id for r in kept.collect()} and not {103, 106} & {r.doc_id for r in kept.collect()}
    assert kept.where("doc_id = 117").first().n_chars == len("fourth line of five words")


def test_large_groups_lose_shared_passages(spark):
    """Lines that many texts hold: passages go, and so does a lone common line, in all texts but the first."""
    body = [" ".join(f"word{i}{j}" for j in range(12)) for i in range(6)]
    license_ = "Licensed under the usual terms here"
    rows = [(i, "\n".join([*body, f"own line number {i} of this"])) for i in range(60)] + [(1000 + i, f"{license_}\nalone {i} stands here now") for i in range(60)]
    found = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == 0 and all(found[i] == 6 for i in range(1, 60))
    assert found[1000] == 0 and all(found[1000 + i] == 1 for i in range(1, 60))


def test_common_lines_go_at_any_size(spark):
    """A line of any number of texts, and a passage whose lines belong to two first holders."""
    body = [" ".join(f"word{i}{j}" for j in range(10)) for i in range(6)]
    license_ = "Licensed under the usual terms here"
    rows = [(0, "\n".join([*body[:3], "number 0 has lines of its own"])), (1, "\n".join([*body, "number 1 has lines of its own"]))]
    rows += [(i, "\n".join([*body, f"number {i} has lines of its own"])) for i in range(2, 200)]
    rows += [(1000 + i, f"{license_}\nalone {i} stands here now") for i in range(60)]
    found = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0] == 0 and found[1] == 3 and all(found[i] == 6 for i in range(2, 200))
    assert found[1000] == 0 and all(found[1000 + i] == 1 for i in range(1, 60))


def test_patience():
    a, b = list("abcdefg"), list("xbcyefz")
    assert [(a[i], b[j]) for i, j in lines.patience_pairs(a, b)] == [("b", "b"), ("c", "c"), ("e", "e"), ("f", "f")]
    assert lines.patience_pairs([], [1]) == [] and lines.patience_pairs([1, 1, 1], [1, 1]) == [(0, 0), (1, 1)]
    rng = random.Random(1)
    for _ in range(50):
        x, y = ([rng.randrange(9) for _ in range(12)] for _ in range(2))
        pairs = lines.patience_pairs(x, y)
        assert all(x[i] == y[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))


def test_passages_of_short_lines(spark):
    """Verse, lists with blank lines, tabs, and scripts without blanks."""
    verse = ["roses are red", "violets", "", "sugar is sweet", "so"]
    rows = [(0, "\n".join(["first", *verse, "end"])), (1, "\n".join([*verse, "other"])), (2, "\n".join(["lone", "roses are red", "here"]))]
    rows += [(10, "a\tb\tc\td\te\nown"), (11, "mine\na\tb\tc\td\te")]
    rows += [(20, "春眠不覚暁\n一"), (21, "二\n春眠不覚暁"), (30, "สวัสดีครับยินดีที่ได้รู้จัก\nก"), (31, "ข\nสวัสดีครับยินดีที่ได้รู้จัก"), (40, "漢字\n一"), (41, "漢字\n二")]
    rows += [(50, "only one line of seven words here\nnot"), (51, "only one line of seven words here\nso short"), (52, "begin\nonly one line of seven words here\nso short")]
    rows += [(60, "unlike\nonly two\nthe last line with six words"), (61, "so short\nthe last line with six words"), (62, "so short\nthe last line with six words\nleft")]
    found = {r.doc_id: r.n_removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {0: 0, 1: 5, 2: 0, 10: 0, 11: 1, 20: 0, 21: 1, 30: 0, 31: 1, 40: 0, 41: 0, 50: 0, 51: 1, 52: 2, 60: 0, 61: 1, 62: 2}


def test_repeated_and_swapped_blocks():
    p, q = ["p1", "p2", "p3"], ["q1", "q2"]
    cases = [([*p, "tail"], ["head", *p, "mid", *p, "end"], [1, 2, 3, 5, 6, 7]), ([*p, "x", *p, "y"], ["head", *p, "end"], [1, 2, 3]), ([*p, "x", *q], [*q, "y", *p], [0, 1, 3, 4, 5])]
    for a, b, want in cases:
        assert sorted(lines.common_blocks(a, b, [5] * len(b))) == want
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 16))] for _ in range(2))
        words_ = [(x * 7) % 4 for x in b]
        gone = lines.common_blocks(a, b, words_)
        assert len(gone) == len(set(gone))
        held = lambda i, j: any(b[i:j] == a[k : k + j - i] for k in range(len(a)))
        blocks = [range(i, j) for i in range(len(b)) for j in range(i + 1, len(b) + 1) if sum(words_[i:j]) >= 5 and held(i, j)]
        assert set(gone) <= {k for x in blocks for k in x}
        assert all(set(x) & set(gone) for x in blocks)


# --- chat


def test_chat_matches_sql(spark):
    con = connect(FOLDER)
    assert difference(QUERIES["op8_chat"](spark, FOLDER), con, ORACLES["op8_chat"]) is None


def test_chat_awkward_rows(spark):
    rows = [(1, 0, "user", "a&lt;<s>[x]"), (1, 1, "assistant", None), (1, 1, "assistant", "b"), (1, None, None, "n"), (2, 5, "ro]l\ne", ""), (None, 0, "assistant", "q")]
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_conversations(made).withColumn("turns", chat.read_turns("formatted")).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("", "n"), ("user", "a&lt;<s>[x]"), ("assistant", ""), ("assistant", "b")]
    assert [(t.role, t.text) for t in out[2].turns] == [("ro]l\ne", "")]
    assert out[None].formatted == "<s>[assistant]q</s>"
    assert chat.chat_report(spark.createDataFrame([], made.schema)).count() == 0


def test_reply_trees(spark):
    """Branches are ranked by mean score; a lost parent makes a root, a circle no path."""
    rows = [("t", 1, None, 0.0), ("t", 2, 1, 1.0), ("t", 3, 1, 0.2), ("t", 4, 3, 9.0), ("t", 5, 99, 0.5), ("t", 6, 7, 1.0), ("t", 7, 6, 1.0), ("u", 1, None, None)] + [("v", i, i - 1 if i else None, 1.0) for i in range(37)]
    made = spark.createDataFrame(rows, "tree string, node int, parent int, score double")
    found = {(r.tree, r.leaf): (list(r.path), r.score) for r in chat.paths(made).collect()}
    assert found[("t", 2)] == ([1, 2], 0.5) and found[("t", 4)][0] == [1, 3, 4] and found[("t", 5)] == ([5], 0.5)
    assert found[("u", 1)] == ([1], 0.0) and found[("v", 36)][0] == list(range(37))
    assert not {("t", 6), ("t", 7)} & set(found)
    best = {r.tree: r.leaf for r in chat.best_paths(chat.paths(made)).collect()}
    assert best == {"t": 4, "u": 1, "v": 36}


# --- language


def test_automaton_accepts_substrings():
    text = "abracadabra kadabra"
    automaton = language.SuffixAutomaton(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            assert automaton.longest(text[i:j], 0) == j - i
    assert automaton.phrases("abrakada") == 2 and automaton.phrases("zz") == 2 and automaton.phrases("") == 0


def test_language(spark):
    rng = random.Random(4)
    stems = {"aa": ["tion", "the", "ing"], "bb": ["lich", "sch", "ung"], "cc": ["que", "eau", "oi"]}
    rows = [(i, " ".join("".join(rng.choices(stems[x], k=rng.randrange(1, 4))) for _ in range(60)), x) for i in range(300) for x in [rng.choice(list(stems))]]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 !! 34", "aa"), (1003, "THE TION!! ING", None), (None, "sch lich", "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    got = {r.doc_id: r for r in language.identify_languages(docs, held).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows[:300])
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "aa", "bb"]
    assert all(0 <= r.score <= 1 for r in got.values())
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify_languages(unlabelled, held).collect()} == {"und"}


# --- toxicity


def test_forward_backward_sums_paths():
    """Marginals of short chains equal sums over all label sequences."""
    rng = np.random.default_rng(0)
    emissions, transitions = rng.normal(size=(1, 5)), rng.normal(size=(2, 2))
    weights = {}
    for code in range(32):
        ys = [code >> i & 1 for i in range(5)]
        weights[tuple(ys)] = np.exp(sum(e for e, y in zip(emissions[0], ys, strict=True) if y) + sum(transitions[a, b] for a, b in zip(ys, ys[1:], strict=False)))
    total = sum(weights.values())
    marginal, pairs = toxicity.forward_backward([5], emissions[0], transitions)
    assert np.allclose(marginal, [sum(w for ys, w in weights.items() if ys[i]) / total for i in range(5)])
    for a in (0, 1):
        for b in (0, 1):
            assert np.isclose(pairs[a, b], sum(w * sum(x == a and y == b for x, y in zip(ys, ys[1:], strict=False)) for ys, w in weights.items()) / total)


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(400):
        ws = words(rng, rng.randrange(20, 200)).split()
        bad = i % 5 == 0
        for _ in range(3 * bad):
            ws.insert(rng.randrange(len(ws)), rng.choice(["Idiot", "scum", f"lowei{rng.randrange(30)}"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "!!"), (None, "an idiot"), (5, rows[5][1])]
    labels += [(3, None), (None, 1), (5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    model = toxicity.train_on(docs, known, learn)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert all(got[i].predicted == (i % 5 == 0) for i in range(400))
    assert [got[i].predicted for i in (900, 901, 902, None)] == [0, 0, 0, 1]
    text = dict(rows)
    for i in range(0, 400, 5):
        assert all(re.fullmatch(r"(Idiot|scum|lowei\d+)( (Idiot|scum|lowei\d+))*", text[i][s.start : s.end]) for s in got[i].spans)
    assert toxicity.score_documents(docs.limit(0), model).count() == 0
    blank = toxicity.train_on(docs, known.limit(0), learn)
    assert toxicity.score_documents(docs, blank).where("predicted = 1").count() == 0
    assert toxicity.keep_clean(docs, model).columns == docs.columns


# --- queries and pipeline


def test_decontamination_matches_sql(spark):
    con = connect(FOLDER)
    assert difference(QUERIES["op2_decontaminate"](spark, FOLDER), con, ORACLES["op2_decontaminate"]) is None


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER).cache()
        assert after.columns == columns, name
        assert 0 < after.count() <= n, name
        n, docs = after.count(), after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
