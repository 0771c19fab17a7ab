"""SimHash near-dedup at a similarity: texts whose sets of five-word shingles have a Jaccard similarity of four fifths.

Shingles: texts lower-cased for A-Z, cut into words at ASCII white space, five words each; a shingle is a 64-bit hash
of its words' hashes.  Texts of one set are one node, however many copies there are.

1. Fingerprints of the shingles meet at anchor points (:func:`papyra.llm.simhash.links`), each with at most one partner that
   is compared by the whole sets.  No distance of fingerprints covers the rule: pairs at 0.8 differ in ten of 64 bits on
   average, many in more, and no covering of that many bits is selective.
2. So large groups are gathered first: texts that have one of their ``LOW`` least shingles in common are compared with the
   one of them that has most near fingerprints, the middle of a group of near copies.  That grows with the texts, not with their
   pairs, and leaves most groups of near copies as one class.
3. The rest is found by prefixes, which lose no pair: if the shingles of all sets are ordered alike, two sets as similar as
   that share one of the first n // 5 + 1 of each, and more of longer prefixes (:func:`needed`).  Prefixes meet in one exchange
   by shingle.  A hub and the texts compared with it are one star there, and meet as one; only stars of different classes make
   pairs.  Any order gives the same pairs; to meet rarely, shingles that recur in a sample of the documents (``SAMPLE`` of
   them, counted by Spark) come last.
4. Stars that meet often enough are compared by their hubs, for each star those first that have the most links so far, then
   those that meet most.  As Jaccard distances keep the triangle inequality, texts of two stars can only be similar if their
   hubs are no farther apart than a fifth and both radii; only then are texts compared one by one.  A pair whose ends have
   become one class is no longer needed for the components; the rounds end when no pair is left, each with sixteen times
   the pairs of a text as the one before.

Whole sets are compared by 32 bits of each shingle's hash: by chance, two of n shingles each share n * n / 2**32 more.
Only the sample's recurring shingles and, while there are at most ``FEW_LINKS``, the links found come to the driver.

Defined results: null and blank texts are one node without shingles; a text of fewer than five words is one shingle;
repeated rows share a component; further columns and their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from papyra.operators.sizes import is_small

from .common import checkpointed, lean, let_go, text_slices
from .components import components
from .simhash import SEED, keep_first
from .simhash import links as fingerprint_links

WORDS = 5
#: Shingles in whole sets that every task gets at most (16 MB).
FEW = 4_000_000
#: Links that are united on the driver at most (16 MB); more of them on the executors.
FEW_LINKS = 1_000_000
#: Least shingles by which groups are gathered.
LOW = 4
#: Documents of the sample that orders the shingles, and how many of its sets make a shingle a recurring one.
SAMPLE, RECURRING = 16384, 3
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Ascending hashes of the distinct shingles."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return np.zeros(0, np.uint64)
    if len(w) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w), SEED)], np.uint64)
    each = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in w), np.uint64, len(w))
    out = np.zeros(len(w) - words + 1, np.uint64)
    for k in range(words):
        out = (out ^ out >> np.uint64(29)) * FACTOR + each[k : k + len(out)]
    return np.unique((out ^ out >> np.uint64(32)) * FACTOR)


def fingerprint(own: np.ndarray) -> int:
    """The bits that more than half of the shingles have, as a signed long."""
    if not len(own):
        return 0
    bits = np.unpackbits(own.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(own), bitorder="little").view(np.int64)[0])


def _node(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).view(np.int64))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)))


def recurring(docs: DataFrame, *, text: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Ascending shingles that recur in the sample, and in how many of its sets."""
    share = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t"):
                own = [shingles(t) for t in part.column("t").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in own], pa.int64()), _lists(own)], names=["node", "s"])

    sample = docs.select(docs[text].cast("string").alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(share)) == 0).distinct()
    sets = sample.mapInArrow(lean(run), "node long, s array<long>").dropDuplicates(["node"])
    found = sets.select(F.explode("s").alias("s")).groupBy("s").count().where(F.col("count") >= RECURRING).toArrow()
    keys = found.column("s").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], found.column("count").to_numpy()[order]


def length(n):
    """Shingles in the prefix of a set of n: enough for one in common, and a fortieth more."""
    return n // 5 + 1 + n // 40


def needed(a, b):
    """Common shingles that the prefixes of sets of a and b >= a shingles have if the sets are similar enough.

    Of the two prefixes take the one that ends first in the order: what the sets have in common beyond the prefixes
    lies in the rest of that set, so that there are at most b - length(b) of them.
    """
    return np.maximum(1, -(-4 * (a + b) // 9) - (b - length(b)))


def prefix(own: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first length(n) of a set in the order of recurrence, then of the hash."""
    if len(keys):
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        own = own[np.argsort(np.where(keys[at] == own, counts[at], 0), kind="stable")]
    return own[: length(len(own))]


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``u, v, k`` of rows ``s, hub, n, place, class`` sorted by s and hub: meetings of two classes' stars that sizes and places allow, and how many they need at least."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
    made: list[list[np.ndarray]] = [[], [], []]

    def sent() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in made], names=["u", "v", "k"])
        for x in made:
            x.clear()
        return out

    def pairs(s: np.ndarray, hub: np.ndarray, n: np.ndarray, place: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(s):
            return
        # a star is one row for each of its shingles: sizes from least to most, and the farthest places
        new = np.flatnonzero(np.concatenate([[True], (np.diff(s) != 0) | (np.diff(hub) != 0)]))
        least, most = np.minimum.reduceat(n, new), np.maximum.reduceat(n, new)
        before, behind = np.maximum.reduceat(place, new), np.maximum.reduceat(n - place, new)
        s, hub, own = s[new], hub[new], own[new]
        first = np.searchsorted(s, s)  # shingles whose stars are all of one class make no pairs
        mixed = np.bincount(first, weights=own != own[first], minlength=len(s))[first] > 0
        s, hub, own, least, most, before, behind = (x[mixed] for x in (s, hub, own, least, most, before, behind))
        order = np.lexsort((least, s))
        s, hub, own, least, most, before, behind = (x[order] for x in (s, hub, own, least, most, before, behind))
        step, alive = 1, np.arange(len(s))
        while True:
            alive = alive[alive + step < len(s)]
            other = alive + step
            near = (s[alive] == s[other]) & (5 * most[alive] >= 4 * least[other])  # as sizes ascend, none farther on is nearer
            alive, other = alive[near], other[near]
            if not len(alive):
                return
            common = np.minimum(before[alive], before[other]) + np.minimum(behind[alive], behind[other])
            fit = (9 * common >= 4 * (least[alive] + least[other])) & (own[alive] != own[other])
            i, j = alive[fit], other[fit]
            k = needed(least[i], np.maximum(most[i], most[j]))
            k = np.where((least[i] == most[i]) & (least[j] == most[j]), k, np.maximum(1, k - 2))  # rounding, over all sizes of a star
            for out, x in zip(made, (np.minimum(hub[i], hub[j]), np.maximum(hub[i], hub[j]), k), strict=True):
                out.append(x)
            if sum(map(len, made[0])) > 50_000:
                yield sent()
            step += 1

    for batch in batches:
        rows = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
        whole = int(np.searchsorted(rows[0], rows[0][-1])) if len(rows[0]) else 0  # the last shingle may go on
        yield from pairs(*(r[:whole] for r in rows))
        held = [r[whole:] for r in rows]
    yield from pairs(*held)
    if made[0]:
        yield sent()


class _Sets:
    """Whole sets of some nodes (column ``node``), taken from the texts once and kept in the shared folder."""

    def __init__(self, docs: DataFrame, rows: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> None:
        nodes = checkpointed(nodes.distinct())
        hint = F.broadcast if is_small(nodes) else lambda df: df  # the texts of few nodes are picked without an exchange of all texts
        one = rows.select("node", "row_key").join(hint(nodes), "node", "left_semi").groupBy("node").agg(F.min("row_key").alias("row_key"))
        keyed = docs.select(F.xxhash64(docs[doc_id], docs[text]).alias("row_key"), docs[text].cast("string").alias("t"))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, "t"):
                    own = [np.unique(shingles(t) >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in part.column("t").to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(own, pa.list_(pa.int32()))], names=["node", "s"])

        texts = keyed.join(hint(one), "row_key").dropDuplicates(["node"])
        self.sets = checkpointed(texts.select("node", "t").mapInArrow(lean(whole), "node long, s array<int>"))
        held = self.sets.agg(F.sum(F.size("s").cast("long"))).first()[0] or 0
        self.hint = F.broadcast if held <= FEW else lambda df: df  # then no pair carries a set through an exchange

    def compared(self, pairs: DataFrame) -> DataFrame:
        """``u, v, d, alike``: the Jaccard distance of each pair ``u, v``, and whether it is similar enough."""
        left, right = (self.sets.select(F.col("node").alias(k), F.col("s").alias(f"of_{k}")) for k in ("u", "v"))
        both = pairs.select("u", "v").join(self.hint(left), "u").join(self.hint(right), "v")
        sizes = both.select("u", "v", F.size(F.array_intersect("of_u", "of_v")).alias("i"), (F.size("of_u") + F.size("of_v")).alias("n"))
        return sizes.select("u", "v", (1 - F.col("i") / (F.col("n") - F.col("i"))).alias("d"), (9 * F.col("i") >= 4 * F.col("n")).alias("alike"))


class _Links:
    """What has been compared so far (``u, v, d, alike``), and the classes that the similar ones make."""

    def __init__(self, sets: _Sets, pairs: DataFrame) -> None:
        self.sets = sets
        self.all = checkpointed(sets.compared(pairs))
        self.links = self.all.where("alike")
        self.classes = _classes(self.links.select("u", "v"))

    def compare(self, pairs: DataFrame) -> None:
        new = checkpointed(self.sets.compared(pairs))
        self.all = self.all.unionByName(new)
        if not (found := new.where("alike")).isEmpty():
            self.links = self.links.unionByName(found)
            # the classes so far are stars already, so that few rounds are left
            self.classes = _classes(self.classes.select(F.col("node").alias("u"), F.col("class").alias("v")).unionByName(found.select("u", "v")))
        let_go(pairs.sparkSession)

    def degrees(self) -> DataFrame:
        return self.links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose nodes aren't of one class."""
        own = lambda k: self.classes.select(F.col("node").alias(k), F.col("class").alias(f"of_{k}"))
        told = pairs.join(own("u"), "u", "left").join(own("v"), "v", "left")
        return told.where(F.coalesce("of_u", "u") != F.coalesce("of_v", "v")).select(pairs.columns)

    def settle(self, pairs: DataFrame) -> None:
        """Compare pairs ``u, v, count`` until each is compared or of one class."""
        pairs, budget = checkpointed(self.apart(pairs)), 2
        while not pairs.isEmpty():
            sides = pairs.withColumn("at", F.explode(F.array("u", "v"))).withColumn("node", F.when(F.col("at") == F.col("u"), F.col("v")).otherwise(F.col("u")))
            order = F.row_number().over(Window.partitionBy("at").orderBy(F.desc_nulls_last("degree"), F.desc("count"), "u", "v"))
            ranked = sides.join(self.degrees(), "node", "left").withColumn("rank", order)
            ranked = checkpointed(ranked.groupBy("u", "v", "count").agg(F.min("rank").alias("rank")))  # the better rank of the two
            self.compare(ranked.where(F.col("rank") <= budget))
            pairs = checkpointed(self.apart(ranked.where(F.col("rank") > budget).drop("rank")))
            budget *= 16

    def stars(self) -> DataFrame:
        """``node, hub, d``: nodes linked to one that has more links than they, if no neighbour of that one has still more."""
        degree = self.degrees()
        ends = self.links.select("u", "v", "d").unionByName(self.links.select(F.col("v").alias("u"), F.col("u").alias("v"), "d"))
        told = ends.join(degree.toDF("u", "own"), "u").join(degree.toDF("v", "others"), "v").where(F.struct("others", "v") > F.struct("own", "u"))
        best = checkpointed(told.groupBy("u").agg(F.max(F.struct("others", "v", "d")).alias("m")).select(F.col("u").alias("node"), "m.v", "m.d"))
        return best.join(best.select(F.col("node").alias("v")), "v", "left_anti").select("node", F.col("v").alias("hub"), "d")


def _classes(links: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """``node, class`` of links ``u, v``; at most ``few`` of them are united on the driver, which saves it the plans of dozens of jobs."""
    if links.count() > few:
        return checkpointed(components(links).select("node", F.col("root").alias("class")))
    found = links.where("u <> v").toArrow()
    node, root = united(*(found.column(k).to_numpy() for k in ("u", "v")))
    made = pa.table([pa.array(node, pa.int64()), pa.array(root, pa.int64())], names=["node", "class"])
    return checkpointed(links.sparkSession.createDataFrame(made, "node long, class long"))


def united(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges u, v, ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return nodes, nodes[root]


def anchored(nodes: DataFrame, threshold: int) -> DataFrame:
    """``u, v``: for each node ``node, fp`` at most one of equal, or else near, fingerprint."""
    of = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("least")))
    near = fingerprint_links(of, threshold)
    partner = near.unionByName(near.select(F.col("u").alias("v"), F.col("v").alias("u"))).groupBy("u").agg(F.min("v").alias("v"))
    across = partner.join(of.select(F.col("fp").alias("u"), F.col("least").alias("a")), "u").join(of.select(F.col("fp").alias("v"), F.col("least").alias("b")), "v")
    same = nodes.join(of, "fp").where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    pairs = across.select("a", "b").unionByName(same)
    return pairs.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def gathered(low: DataFrame, links: _Links) -> DataFrame:
    """``u, v``: for each node of ``low(s, n, node)`` at most one of another class, that has most links of those with the same s.

    The one is found by a partial aggregation; a shingle that many texts have makes one pair for each of them.
    """
    told = low.join(links.degrees(), "node", "left").join(links.classes, "node", "left")
    told = told.select("s", "n", "node", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"), F.coalesce("class", "node").alias("class"))
    hubs = told.groupBy("s").agg(F.max(F.struct("degree", "node", "n", "class")).alias("hub"), F.min("class").alias("a"), F.max("class").alias("b")).where("a <> b")
    met = told.join(hubs.select("s", "hub"), "s").where("class <> hub.class and 5 * least(n, hub.n) >= 4 * greatest(n, hub.n)")
    counted = met.groupBy("node", "hub.node", "hub.degree").agg(F.count("*").alias("count")).toDF("u", "v", "degree", "count")
    best = counted.groupBy("u").agg(F.max_by("v", F.struct("degree", "count", "v")).alias("v"))
    return best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def similar(docs: DataFrame, rows: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = 2) -> DataFrame:
    """``node, class`` of the nodes that are similar to any; rows as :func:`near_copies` makes them."""
    few = checkpointed(rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("low").alias("low")))
    low = few.select(F.explode("low").alias("s"), "n", "node")
    shared = low.groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    near = checkpointed(anchored(few, threshold))
    ends = near.select(F.explode(F.array("u", "v")).alias("node")).unionByName(low.join(shared, "s", "left_semi").select("node"))
    links = _Links(_Sets(docs, rows, ends, doc_id, text), near)
    links.compare(gathered(low, links))
    stars = checkpointed(links.stars())
    nodes = rows.where("n > 0").groupBy("node").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    named = nodes.join(stars.select("node", "hub"), "node", "left").join(links.classes, "node", "left")
    placed = named.select(F.posexplode("prefix").alias("place", "s"), "n", F.coalesce("hub", "node").alias("hub"), F.coalesce("class", "node").alias("class"))
    together = placed.select("s", "hub", F.col("n").cast("long"), F.col("place").cast("long"), "class").repartition("s").sortWithinPartitions("s", "hub")
    met = together.mapInArrow(lean(meet), "u long, v long, k long").groupBy("u", "v").agg(F.count("*").alias("count"), F.min("k").alias("k"))
    pairs = checkpointed(met.where("count >= k").select("u", "v", "count"))
    if pairs.isEmpty():
        return links.classes
    radius = stars.groupBy("hub").agg(F.max("d").alias("r"))
    of = lambda k: radius.select(F.col("hub").alias(k), F.col("r").alias(f"r_{k}"))
    wide = pairs.join(of("u"), "u", "left").join(of("v"), "v", "left")
    # stars of one text are settled by that text; others are all compared by their hubs
    hubs = checkpointed(wide.where("r_u is not null or r_v is not null").select("u", "v", "count", F.coalesce("r_u", F.lit(0.0)).alias("r_u"), F.coalesce("r_v", F.lit(0.0)).alias("r_v")))
    members = checkpointed(stars.unionByName(stars.select(F.col("hub").alias("node"), "hub", F.lit(0.0).alias("d")).distinct()).join(few.select("node", "n"), "node"))
    ends = pairs.select(F.explode(F.array("u", "v")).alias("hub")).distinct()
    needed_sets = ends.select(F.col("hub").alias("node")).unionByName(members.join(ends, "hub", "left_semi").select("node"))
    links.sets = _Sets(docs, rows, needed_sets, doc_id, text)
    links.compare(hubs)
    links.settle(wide.where("r_u is null and r_v is null").select("u", "v", "count"))
    known = links.all.groupBy("u", "v").agg(F.min("d").alias("d"))
    near = checkpointed(links.apart(hubs.join(known, ["u", "v"])).where(F.col("d") <= 0.2 + F.col("r_u") + F.col("r_v") + 1e-9))
    alone = lambda k: few.select(F.col("node"), F.col("node").alias("hub"), F.lit(0.0).alias("d"), "n").join(near.select(F.col(k).alias("hub")).distinct(), "hub", "left_semi").join(stars.select("hub"), "hub", "left_anti")
    texts = lambda k: members.unionByName(alone(k)).select(F.col("hub").alias(k), F.col("node").alias(f"n_{k}"), F.col("d").alias(f"d_{k}"), F.col("n").alias(f"s_{k}"))
    for one_is_hub in (True, False):  # first against the hubs, which settles most
        open_ = links.apart(near)
        both = open_.join(texts("u"), "u").join(texts("v"), "v").where("5 * least(s_u, s_v) >= 4 * greatest(s_u, s_v)")
        both = both.where((F.col("d_u") + F.col("d_v") >= F.col("d") - 0.2 - 1e-9) & (F.col("d_u") + F.col("d_v") > 0))
        both = both.where("n_u = u or n_v = v") if one_is_hub else both.where("n_u <> u and n_v <> v")
        told = both.select(F.least("n_u", "n_v").alias("u"), F.greatest("n_u", "n_v").alias("v"), F.round((F.col("d_u") + F.col("d_v")) * 1000).cast("long").alias("count"))
        links.settle(told.groupBy("u", "v").agg(F.max("count").alias("count")))
    return links.classes


def near_copies(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = 2) -> DataFrame:
    """One row for each of docs: ``doc_id, row_key, node, root``; root is the same for all rows of a component."""
    keys, counts = recurring(docs, text=text)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t"):
                own = [shingles(t) for t in part.column("t").to_pylist()]
                first = _lists([prefix(s, keys, counts) for s in own])
                made = [pa.array([_node(s) for s in own], pa.int64()), pa.array([fingerprint(s) for s in own], pa.int64()), pa.array([len(s) for s in own], pa.int32()), _lists([s[:LOW] for s in own]), first]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), *made], names=["doc_id", "row_key", "node", "fp", "n", "low", "prefix"])

    texts = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[doc_id], docs[text]).alias("row_key"), docs[text].cast("string").alias("t"))
    rows = checkpointed(texts.mapInArrow(lean(run), f"doc_id {kind}, row_key long, node long, fp long, n int, low array<long>, prefix array<long>"))
    grouped = similar(docs, rows, doc_id=doc_id, text=text, threshold=threshold)
    return rows.join(grouped, "node", "left").select("doc_id", "row_key", "node", F.coalesce("class", "node").alias("root"))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without the near copies: of each component the row of least doc_id (nulls last) stays, once."""
    return keep_first(docs, near_copies(docs, doc_id=doc_id, text=text), doc_id=doc_id, text=text)
