"""Near-duplicates by set similarity, found along chosen paths.

Texts become sets of shingles, equal sets one row with a signature of minwise tokens. Trees
branch the sets: a node selects some of the signature's places and sends every set to one
child for each, named by its token there. Nodes of few sets are compared, larger ones
branch again on other places. A pair of the target similarity keeps a token with that
probability at each place, so every tree finds it with a probability that the branching
keeps from falling with the depth, and independent trees multiply what is missed.

Signatures find candidates only. Sets joined by candidates form a cluster; its sets are
read once more in full and kept as their differences from the cluster's leader, which are
small and suffice for exact sizes of intersection and union of any two of them. Links to
the leader need no further comparison; the others are looked for among the whole cluster,
or along chosen paths inside it where it is large. Links leave every comparison as a
spanning forest, so that a group of copies never becomes all its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statutory.llm.common import slices, stored, utf8
from statutory.llm.components import components

WORDS = 4
SEED = 42
#: Bytes of a text that are hashed at once, up to the next blank.
PART_BYTES = 4 << 20
BLANK = re.compile(rb"[ \t-\r]")
#: Minwise tokens of a signature.
PLACES = 64
#: Two sets of similarity 0.8 agree in fewer places with a probability of 4e-6.
AGREE = 36
#: Independent trees, the children of a set at their roots, and at all other nodes that branch.
TREES, ROOT_BRANCHES, BRANCHES = 3, 4, 2
#: Sets that a node may hold at the first level; twice as many at each further one, up to the largest.
NODE_ROWS, LARGEST_NODE = 2000, 16_000
#: Levels after which nodes that are still larger are compared part by part.
DEPTH = 6
#: Members of a cluster for each copy of its leader.
LEADER_ROWS = 2000
#: Rows named for reading again are broadcast up to this number (48 bytes each), and joined by a shuffle beyond it.
BROADCAST_ROWS = 200_000
#: Tasks over which the sets of one component are spread.
SALTS = 32


def _hashed(tokens: list[bytes], words: int) -> np.ndarray:
    """The hashes of the distinct runs of so many tokens, rising."""
    line, digest = b" ".join(tokens), xxhash.xxh3_64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(tokens) - words + 1].tolist()
    return np.unique(np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist(), strict=True)], np.uint64))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """The hashes of a text's distinct shingles, rising; a shorter text is one shingle, one without words none.

    Long texts are read in parts, each with the last words of the one before.
    """
    found: list[np.ndarray] = []
    tokens: list[bytes] = []
    at = 0
    while at < len(text):
        cut = BLANK.search(text, at + PART_BYTES)
        end = cut.start() if cut else len(text)
        tokens = tokens[1 - words :] if len(tokens) >= words else tokens
        tokens = tokens + text[at:end].lower().split()  # of bytes: folds A-Z only and parts at space and \t to \r only
        if len(tokens) >= words:
            found.append(_hashed(tokens, words))
        at = end + 1
    if found:
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found))
    return np.array([xxhash.xxh3_64_intdigest(b" ".join(tokens), SEED)], np.uint64) if tokens else np.zeros(0, np.uint64)


def _mixers() -> tuple[np.ndarray, np.ndarray]:
    drawn = np.array([[xxhash.xxh3_64_intdigest(f"{kind} {i}", SEED) for i in range(PLACES)] for kind in ("mask", "factor")], np.uint64)
    return drawn[0], drawn[1] | np.uint64(1)


MASKS, FACTORS = _mixers()


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least of the hashes under every mixing, cut to 32 bits."""
    least = np.array([((hashes ^ m) * f).min() for m, f in zip(MASKS, FACTORS, strict=True)], np.uint64)
    return (least ^ (least >> np.uint64(32))).astype(np.uint32).view(np.int32)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        sizes, keys, signatures = [], [], []
        for text in utf8(batch, "text"):
            found = shingles(text)
            sizes.append(len(found))
            keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signatures.append(signature(found) if len(found) else np.zeros(PLACES, np.int32))
        flat = pa.FixedSizeListArray.from_arrays(np.concatenate(signatures), PLACES).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), flat], names=["doc_id", "row", "n", "key", "sig"])


def _row_key() -> Column:
    """Names a row by its id and text, both null-safe."""
    return F.concat(*[F.coalesce(F.unhex(F.md5(F.col(c).cast("string"))), F.lit("-").cast("binary")) for c in ("doc_id", "text")])


def _child(node: Column, place: Column, token: Column) -> Column:
    return F.xxhash64(node, place, token)


def _roots(rows: DataFrame) -> DataFrame:
    """node and id: the children of every tree's root; rows have id, sig and root (0, or what parts the trees further)."""
    places = range(TREES * ROOT_BRANCHES)
    return rows.select("id", F.explode(F.array(*[_child(F.col("root"), F.lit(p), F.col("sig")[p]) for p in places])).alias("node"))


def _branch(rows: DataFrame) -> DataFrame:
    """The children of nodes; rows have node, id and sig."""
    first = TREES * ROOT_BRANCHES
    places = [F.lit(first) + F.pmod(F.xxhash64("node", F.lit(i)), F.lit(PLACES - first)).cast("int") for i in range(BRANCHES)]
    return rows.select("id", F.explode(F.array_distinct(F.array(*[_child(F.col("node"), p, F.col("sig")[p]) for p in places]))).alias("node"))


def leaves(nodes: DataFrame, signatures: DataFrame) -> DataFrame:
    """node and id of the nodes that are to be compared: of two sets at least, and of a bounded number.

    Nodes that branching doesn't make small in DEPTH levels are dealt in parts, and every
    two parts of one are compared.
    """
    found: DataFrame | None = None
    for level in range(DEPTH + 1):
        limit = min(NODE_ROWS << level, LARGEST_NODE)
        sizes = nodes.groupBy("node").agg(F.count("*").alias("m")).where("m > 1")
        held = stored(nodes.join(sizes, "node").select("node", "id", "m"))
        small = held.where(F.col("m") <= limit).select("node", "id")
        found = small if found is None else found.unionByName(small)
        large = held.where(F.col("m") > limit)
        if large.isEmpty():
            return found
        if level < DEPTH:
            nodes = stored(_branch(large.join(signatures, "id")))
    parts = F.ceil(F.col("m") / F.lit(LARGEST_NODE // 2))
    dealt = large.withColumn("part", F.pmod(F.xxhash64("id"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    dealt = dealt.select(F.xxhash64("node", F.least("part", "other"), F.greatest("part", "other")).alias("node"), "id")
    return found.unionByName(dealt)


def _by_node(work: Callable[[dict[str, np.ndarray]], np.ndarray], columns: dict[str, type]):
    """Run work on the rows of every node; rows come sorted by node, whose rows may lie in several batches.

    work gets the columns of one node (a list column as an array of arrays) and returns links as two columns of places.
    """

    def read(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        found = {}
        for name in ("node", "id", *columns):
            column = batch.column(name)
            if pa.types.is_list(column.type):
                offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
                cells = np.empty(len(column), object)
                cells[:] = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
                found[name] = cells
            else:
                found[name] = column.to_numpy(zero_copy_only=False)
        return found

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = read(batch)
            cuts = [0, *(np.flatnonzero(np.diff(rows["node"])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = {k: v[a:b] for k, v in rows.items()}
                if held and held[0]["node"][0] != part["node"][0]:
                    yield {k: np.concatenate([h[k] for h in held]) for k in part}
                    held = []
                held.append(part)
        if held:
            yield {k: np.concatenate([h[k] for h in held]) for k in held[0]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right, n = [], [], 0
        for rows in nodes(batches):
            links = work(rows)
            if len(links):
                left.append(rows["id"][links[:, 0]])
                right.append(rows["id"][links[:, 1]])
                n += len(links)
            if n > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
                left, right, n = [], [], 0
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    return run


def _links(rows: DataFrame, work: Callable[[dict[str, np.ndarray]], np.ndarray], columns: dict[str, type]) -> DataFrame:
    dealt = rows.select("node", "id", *columns).repartition("node").sortWithinPartitions("node", "id")
    return dealt.mapInArrow(_by_node(work, columns), "a long, b long")


def spanning(n: int, near: Callable[[int, np.ndarray], np.ndarray], reached: list[int] | None = None) -> np.ndarray:
    """Links (places) that connect what near connects; near(x, rest) says which of rest are near x.

    The places in reached are connected already.
    """
    rest = np.setdiff1d(np.arange(n), reached or [])
    waiting, links = list(reached or []), []
    while len(rest):
        if not waiting:
            waiting, rest = [int(rest[0])], rest[1:]
        x = waiting.pop()
        hit = near(x, rest)
        if hit.any():
            found = rest[hit]
            links.append(np.stack([np.full(len(found), x), found], 1))
            waiting += found.tolist()
            rest = rest[~hit]
    return np.concatenate(links) if links else np.zeros((0, 2), np.int64)


def _candidates(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Links of sets that may have the similarity: by their sizes and by how many places agree."""
    sizes = rows["n"]
    signatures = np.stack(list(rows["sig"]))

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        hit = (5 * np.minimum(sizes[rest], sizes[x]) >= 4 * np.maximum(sizes[rest], sizes[x]))
        at = np.flatnonzero(hit)
        hit[at] = (signatures[rest[at]] == signatures[x]).sum(1) >= AGREE
        return hit

    return spanning(len(sizes), near)


def similar(size: np.ndarray | int, other: np.ndarray | int, differ: np.ndarray | int):
    """Whether 100 * intersection >= 80 * union for sets of two sizes that differ in so many shingles."""
    return 9 * differ <= size + other


def _exact(rows: dict[str, np.ndarray]) -> np.ndarray:
    """Links of a node's sets, which are given by their differences from one set; those linked to that set are connected already."""
    sizes, deltas = rows["n"], rows["delta"]
    lengths = np.array([len(x) for x in deltas])
    holder = np.repeat(np.arange(len(deltas)), lengths)
    _, element = np.unique(np.concatenate([np.zeros(0, np.int64), *deltas]), return_inverse=True)
    order = np.argsort(element, kind="stable")
    holders, element_of = holder[order], np.split(element, np.cumsum(lengths)[:-1])
    at = np.searchsorted(element[order], np.arange(element.max(initial=-1) + 2))

    def near(x: int, rest: np.ndarray) -> np.ndarray:
        first, many = at[element_of[x]], at[element_of[x] + 1] - at[element_of[x]]
        places = np.repeat(first - np.concatenate([[0], np.cumsum(many)[:-1]]).astype(np.int64), many) + np.arange(many.sum()) if len(many) else np.zeros(0, np.int64)
        shared = np.bincount(holders[places], minlength=len(deltas))
        return similar(sizes[x], sizes[rest], lengths[x] + lengths[rest] - 2 * shared[rest])

    return spanning(len(deltas), near, np.flatnonzero(rows["reached"]).tolist())


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [shingles(t).view(np.int64) for t in utf8(batch, "text")]
        offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("cluster"), pa.ListArray.from_arrays(offsets, np.concatenate(found))], names=["id", "cluster", "items"])


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def cells(column: pa.ListArray) -> list[np.ndarray]:
        offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
        return [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]

    for batch in batches:
        items, lead = cells(batch.column("items")), cells(batch.column("lead"))
        deltas = [np.setxor1d(a, b, assume_unique=True) for a, b in zip(items, lead, strict=True)]
        reached = [bool(similar(len(a), len(b), len(d))) for a, b, d in zip(items, lead, deltas, strict=True)]
        offsets = np.cumsum([0, *map(len, deltas)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *deltas])
        kept = [batch.column(c) for c in ("id", "cluster", "leader")]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array([len(x) for x in items], pa.int64()), pa.array(reached), pa.ListArray.from_arrays(offsets, flat)],
            names=["id", "cluster", "leader", "n", "reached", "delta"],
        )


def _leaders(members: DataFrame) -> DataFrame:
    """cluster, size and leader: the set whose first tokens most of its cluster shares, then the smallest id."""
    sized = members.groupBy("cluster").agg(F.count("*").alias("size"), F.min("id").alias("least"))
    small = sized.where(F.col("size") <= LEADER_ROWS).select("cluster", "size", F.col("least").alias("leader"))
    large = members.join(sized.where(F.col("size") > LEADER_ROWS), "cluster")
    votes = large.select("cluster", "size", "id", F.posexplode(F.slice("sig", 1, 8)).alias("place", "token"))
    shared = votes.groupBy("cluster", "place", "token").agg(F.count("*").alias("votes"))
    scored = votes.join(shared, ["cluster", "place", "token"]).groupBy("cluster", "size", "id").agg(F.sum("votes").alias("votes"))
    chosen = scored.groupBy("cluster", "size").agg(F.max(F.struct("votes", (-F.col("id")).alias("id"))).alias("best"))
    return small.unionByName(chosen.select("cluster", "size", (-F.col("best.id")).alias("leader")))


def set_links(sets: DataFrame, documents: DataFrame) -> DataFrame:
    """Links a, b between the ids of distinct sets that connect what the similarity connects.

    sets has id, n, sig and row, the name of one row of documents that has the set.
    """
    roots = _roots(sets.select("id", "sig", F.lit(0).cast("long").alias("root")))
    held = leaves(roots, sets.select("id", "sig"))
    candidates = _links(held.join(sets.select("id", "n", "sig"), "id"), _candidates, {"n": int, "sig": list})
    clusters = components(candidates)
    clusters = clusters.select(F.col("node").alias("id"), F.col("root").alias("cluster")).union(clusters.select(F.col("root").alias("id"), F.col("root").alias("cluster")).distinct())
    members = stored(sets.join(clusters, "id"))

    named = members.select("row", "id", "cluster")
    if members.count() <= BROADCAST_ROWS:
        named = F.broadcast(named)
    texts = documents.select("text", _row_key().alias("row")).join(named, "row").groupBy("id").agg(F.first("cluster").alias("cluster"), F.first("text").alias("text"))
    full = stored(texts.mapInArrow(_sets, "id long, cluster long, items array<long>"))
    leaders = stored(_leaders(members.select("id", "cluster", "sig")))
    copies = F.ceil(F.col("size") / F.lit(LEADER_ROWS))
    lead = full.select(F.col("id").alias("leader"), F.col("items").alias("lead")).join(leaders, "leader")
    lead = lead.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1)))
    salted = full.join(leaders.select("cluster", "size"), "cluster").withColumn("salt", F.pmod(F.xxhash64("id"), copies)).drop("size")
    met = salted.join(lead, ["cluster", "salt"]).select("id", "cluster", "leader", "items", "lead")
    compared = stored(met.mapInArrow(_differences, "id long, cluster long, leader long, n long, reached boolean, delta array<long>"))
    to_leader = compared.where("reached and id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b"))

    open_ = compared.groupBy("cluster").agg(F.count("*").alias("size"), F.sum(F.when(F.col("reached"), 0).otherwise(1)).alias("apart")).where("apart > 0 and size > 2")
    open_ = stored(compared.select("cluster", "id").join(open_.select("cluster", "size"), "cluster"))
    whole = open_.where(F.col("size") <= NODE_ROWS).select(F.col("cluster").alias("node"), "id")
    split = open_.where(F.col("size") > NODE_ROWS).join(members.select("id", "sig"), "id")
    if not split.isEmpty():
        whole = whole.unionByName(leaves(_roots(split.select("id", "sig", F.col("cluster").alias("root"))), members.select("id", "sig")).select("node", "id"))
    among = _links(whole.join(compared.select("id", "n", "reached", "delta"), "id"), _exact, {"n": int, "reached": bool, "delta": list})
    return to_leader.unionByName(among)


def _names(sets: DataFrame, roots: DataFrame) -> DataFrame:
    """id and component_id of the sets that have a link; the sets of one component look it up in SALTS tasks."""
    linked = roots.select("node", "root").union(roots.select(F.col("root").alias("node"), "root").distinct())
    names = linked.join(sets.select(F.col("id").alias("node"), "first_id"), "node").groupBy("root").agg(F.min("first_id").alias("component_id"))
    salted = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    own = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    return own.join(salted, ["root", "salt"]).select(F.col("node").alias("id"), "component_id")


def near_duplicate_sets(documents: DataFrame) -> DataFrame:
    """Shingle count and component of every document row.

    Returns doc_id, n_shingles (distinct shingles of WORDS words), component_id, the smallest
    doc_id reachable over links of a similarity of 0.8 at least, and kept (doc_id is
    component_id). Texts that are null or without words have no shingles and no links; their
    component is their own id. Repeated rows are repeated; rows with a null id belong to
    their component but never name it, and aren't kept (a component of null ids only has a
    null component_id); other columns are ignored; an empty table gives an empty result.
    Links are found with a probability of more than 0.99999 at a similarity of 0.8, and with
    a higher one above it; every link found is exact.
    """
    source = documents.select("doc_id", "text")
    id_type = source.schema["doc_id"].dataType.simpleString()
    docs = stored(source.withColumn("row", _row_key()).mapInArrow(_sketches, f"doc_id {id_type}, row binary, n long, key binary, sig array<int>"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    sets = docs.where("n > 0").groupBy("key").agg(first.alias("first"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    sets = stored(sets.select("key", F.col("first.doc_id").alias("first_id"), F.col("first.row").alias("row"), "n", "sig", F.monotonically_increasing_id().alias("id")))
    roots = components(set_links(sets.drop("key", "first_id"), source))
    linked = _names(sets, roots).withColumn("linked", F.lit(True))
    member = sets.select("id", "key", "first_id").join(linked, "id", "left")
    member = member.select("key", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"))
    own = docs.select("doc_id", "n", "key").join(member, "key", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
