"""Near-duplicate documents: a chosen-path similarity join over minwise tokens, confirmed on full sets.

1. Each text becomes the set of its distinct five-word shingles (64-bit hashes), with
   ``COORDINATES`` minwise tokens and a 128-bit hash of the set; equal sets are one node
   from here on.
2. Independent trees branch documents by selected minwise tokens.  Nodes of one document
   end there; small nodes are compared exhaustively on sketches (16 bits of each
   token); in a larger node every document is compared with the node's least one, the pivot, linked
   if alike, set aside if so alike that its partners are linked as well, and the
   rest branches again, until all of a node are linked already.  This gives coarse groups that hold every link with the
   recall stated at ``TREES``.
3. Inside each coarse group sets are compared in full, small groups whole, large ones
   in blocks: within blocks first, then across blocks for documents whose
   components still differ.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shingles
from .common import cut, cut_counted, few_tasks, salted_join
from .graph import connected_components
from .mixing import numbered

COORDINATES = 64
#: Trees and branches at each root: 12 tokens are tried.  A pair of similarity s meets under none with
#: probability (1 - s) ** 12: 1.3e-10 at 0.85, 4e-9 at 0.8.
TREES, ROOTS = 6, 2
#: Levels, and the size up to which a node is small and compared exhaustively.
LEVELS, SMALL = 6, 200
#: (least threshold, SECOND, ALIKE, SAME), for 0.85 and for 0.8.  A node that isn't small branches once, and one in SECOND twice: 1.2 * 0.85
#: and 1.5 * 0.8 are above 1, so that a pair at the threshold is expected in as many nodes of each level as under the roots, while unlike ones part.
#: ALIKE is the share of equal sketch places from which two documents are compared in full, SAME that from which one needs no further
#: branching: whoever is near to it differs from it in fewer than SAME - ALIKE of the places (but for a chance of 1e-4), and so is alike to the pivot.
TUNING = ((0.85, 5, 0.55, 0.88), (0.8, 2, 0.5, 0.92))
#: Documents and shingles of a block that is compared in one task.
BLOCK_DOCS, BLOCK_SHINGLES = 400, 1_500_000
#: Rows of one node that meet its pivot in one task.
PART = 5_000
FACTORS = shingles.seeds(COORDINATES, 31) | np.uint64(1)
MASKS = shingles.seeds(COORDINATES, 37)


def minwise(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``COORDINATES`` tokens (uint64) of each non-empty set; zeros for an empty one."""
    out = np.zeros((len(counts), COORDINATES), np.uint64)
    full = np.flatnonzero(counts)
    ends = np.cumsum(counts)
    step = 1 << 16  # hashes at a time, which fit a core's cache
    low = np.full((len(full), COORDINATES), np.uint64(0xFFFFFFFFFFFFFFFF))
    starts = (ends - counts)[full]
    for lo in range(0, len(hashes), step):
        hi = min(len(hashes), lo + step)
        a, b = int(np.searchsorted(starts, lo, "right")) - 1, int(np.searchsorted(starts, hi, "left"))
        edges = np.maximum(starts[a:b] - lo, 0)
        piece = hashes[lo:hi]
        for k in range(COORDINATES):
            low[a:b, k] = np.minimum(low[a:b, k], np.minimum.reduceat((piece ^ MASKS[k]) * FACTORS[k], edges))
    out[full] = low
    return out


def set_hash(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's scrambled members; 0 for an empty set."""
    out = np.zeros((2, len(counts)), np.uint64)
    full = np.flatnonzero(counts)
    starts = (np.cumsum(counts) - counts)[full]
    if len(full):
        out[0, full] = np.add.reduceat(shingles.mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), starts)
        out[1, full] = np.add.reduceat(shingles.mix(hashes ^ np.uint64(0x14057B7EF767814F)), starts)
    return out[0], out[1]


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``(k, n, h1, h2, roots, sketch)``: size and hash of each text's set, its root tokens, and 16 bits of each token."""

    def run(batches):
        shingles.let_go()
        for whole in batches:
            for b in shingles.pieces(whole, 1):
                hashes, counts = shingles.text_sets(b.column(1), width)
                h1, h2 = set_hash(hashes, counts)
                tokens = minwise(hashes, counts)
                roots = shingles.lists(tokens[:, : TREES * ROOTS].copy().view(np.int64))
                sketch = shingles.lists((tokens >> np.uint64(24)).astype(np.uint16).view(np.int16))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), roots, sketch], ["k", "n", "h1", "h2", "roots", "sketch"])

    src = docs.select(docs[id_col].cast("long").alias("k"), docs[text_col].alias("t"))
    return src.mapInArrow(run, "k long, n long, h1 long, h2 long, roots array<long>, sketch array<short>")


class Union:
    """Union-find over the ids that one task sees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def batch(self) -> pa.RecordBatch:
        pairs = [(x, r) for x in list(self.up) if (r := self.root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])


MOST_LINKS = 200_000


def sketches(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)


def small_node_links(batches, least: float):
    """Rows ``(path, k, sketch)`` sorted by path, at most ``SMALL`` a path: links between documents with ``least`` of the sketch places equal."""
    shingles.let_go()
    held, union = None, Union()

    def compare(path, k, sketch):
        offset, rows = 1, np.arange(len(path) - 1)
        while len(rows := rows[rows + offset < len(path)]) and len(rows := rows[path[rows] == path[rows + offset]]):
            alike = rows[(sketch[rows] == sketch[rows + offset]).sum(1) >= least * COORDINATES]
            for a, b in zip(k[alike].tolist(), k[alike + offset].tolist()):
                union.join(a, b)
            offset += 1

    for b in batches:
        if not b.num_rows:
            continue
        path, k, sketch = b.column(0).to_numpy(), b.column(1).to_numpy(), sketches(b.column(2))
        if held is not None:
            path, k, sketch = (np.concatenate(x) for x in zip(held, (path, k, sketch)))
        last = int(np.searchsorted(path != path[-1], False)) if path[0] == path[-1] else int(np.flatnonzero(path != path[-1])[-1]) + 1
        last = 0 if path[0] == path[-1] else last
        compare(path[:last], k[:last], sketch[:last])
        held = path[last:], k[last:], sketch[last:]
        if len(union.up) > MOST_LINKS:
            yield union.batch()
            union.up.clear()
    if held is not None:
        compare(*held)
    yield union.batch()


def coarse_links(sets: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Links ``(u, v)`` between sets that may be near: the chosen-path trees over ``(k, roots, sketch)``.

    Every document has a label, one that it is already linked with (the least it met through
    pivots of earlier levels); a node under one label has nothing left to link and ends.
    """
    second, alike, same = next((t[1:] for t in TUNING if threshold >= t[0]), TUNING[-1][1:])
    paths = F.array(*[F.xxhash64(F.lit(t), F.lit(TREES * r + t), F.col("roots")[TREES * r + t]) for t in range(TREES) for r in range(ROOTS)])
    held = sets.select("k", "sketch", F.col("k").alias("label"), paths.alias("paths"))
    small, stars, n_rows = None, [], None
    for level in range(LEVELS + 1):
        rows = held.select("k", "label", F.explode("paths").alias("path"))
        nodes = rows.groupBy("path").agg(F.count("*").alias("m"), F.min(F.struct("k", "label")).alias("pivot"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("m > 1 and lo < hi")
        met = salted_join(rows, nodes.select("path", "m", F.col("pivot.k").alias("pivot"), F.col("pivot.label").alias("own")), ["path"], "k").join(held.select("k", "sketch"), "k")
        found, _, seen = cut_counted(met if n_rows is None else few_tasks(met, 2 * n_rows, 50_000), F.count_if(F.col("m") > SMALL).alias("large"))
        few = found.where(F.col("m") <= SMALL).select("path", "k", "sketch")
        small = few if small is None else small.unionByName(few)
        if not seen["large"]:
            break
        # a node's rows are dealt by k as well, and its pivot goes to each part
        parts = F.ceil(F.col("m") / PART).cast("int")
        large = found.where(F.col("m") > SMALL).withColumn("part", F.pmod(F.xxhash64(F.lit(6), "k"), parts).cast("int"))
        pivots = large.where("k = pivot").select("path", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("sketch").alias("of_pivot"))
        equal = F.size(F.filter(F.zip_with("sketch", "of_pivot", lambda a, b: a == b), lambda x: x)) / COORDINATES
        compared = large.where("k != pivot").join(pivots, ["path", "part"]).select("path", "k", "label", "pivot", "own", equal.alias("equal"), "sketch")
        judged, _, seen = cut_counted(few_tasks(compared, seen["large"], 50_000))
        n_rows = seen["rows"]
        # documents that a path could not part at its end stay together: more to compare, nothing lost
        stars.append(judged.where(F.col("equal") >= (alike if level < LEVELS else 0.0)).select(F.col("k").alias("u"), F.col("pivot").alias("v")))

        def branch(j: int) -> Column:
            at = F.pmod(F.xxhash64("path", F.lit(j)), F.lit(COORDINATES)).cast("int")
            return F.xxhash64("path", F.lit(j), at, F.get(F.col("sketch"), at))

        deeper = F.when(F.pmod(F.xxhash64("path"), F.lit(second)) == 0, F.array(branch(0), branch(1))).otherwise(F.array(branch(0)))
        best = F.min(F.least("label", F.when(F.col("equal") >= alike, F.col("own"))))
        rest = judged.where(F.col("equal") < same).groupBy("k").agg(F.first("sketch").alias("sketch"), best.alias("label"), F.array_distinct(F.flatten(F.collect_set(deeper))).alias("paths"))
        held = cut(few_tasks(rest, n_rows, 50_000))
    out = small.repartition("path").sortWithinPartitions("path").mapInArrow(lambda b: small_node_links(b, alike), "u long, v long")
    for more in stars[1:]:
        stars[0] = stars[0].unionByName(more)
    if stars:
        # a document met a pivot in each of many nodes: it keeps the least one, and its pivots are linked instead
        met = cut(stars[0].groupBy("u").agg(F.min("v").alias("v"), F.collect_set("v").alias("all")))
        hubs = met.where("size(all) > 1").select(F.explode("all").alias("u"), "v").where("u != v").distinct()
        out = out.unionByName(met.select("u", "v")).unionByName(hubs)
    return out


def near(a: np.ndarray, sets: list[np.ndarray], rows: np.ndarray, num: int, den: int) -> np.ndarray:
    """Those of ``rows`` whose set has  den * intersection >= num * union  with ``a`` (all sorted and distinct)."""
    sizes = np.array([len(sets[r]) for r in rows])
    rows = rows[(den * np.minimum(sizes, len(a)) >= num * np.maximum(sizes, len(a)))]
    if not len(rows):
        return rows
    sizes = np.array([len(sets[r]) for r in rows])
    flat = np.concatenate([sets[r] for r in rows])
    at = np.searchsorted(a, flat)
    hit = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(a[np.minimum(at, len(a) - 1)] == flat, out=hit[1:])
    ends = np.cumsum(sizes)
    both = hit[ends] - hit[ends - sizes]
    return rows[den * both >= num * (sizes + len(a) - both)]


def group_links(ids: list[int], sets: list[np.ndarray], union: Union, num: int, den: int) -> None:
    """All components of one block: each reached set is held against those not yet reached."""
    left = np.arange(len(ids))
    while len(left):
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            i = stack.pop()
            found = near(sets[i], sets, left, num, den)
            if len(found):
                for j in found.tolist():
                    union.join(ids[i], ids[j])
                stack += found.tolist()
                left = left[~np.isin(left, found)]


def cross_links(ids, labels, fringe, sets, union: Union, num: int, den: int) -> None:
    """Links between fringe and other sets of one pair of blocks whose components differ."""
    label = np.array(labels)
    side = np.array(fringe)
    for i in np.flatnonzero(side):
        rest = np.flatnonzero((label != label[i]) & (~side | (np.arange(len(side)) > i)))
        for j in near(sets[i], sets, rest, num, den).tolist():
            union.join(ids[i], ids[j])


def as_set(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), np.uint64)


def by_group(batches, n_keys: int, done):
    """Call ``done(rows)`` for each run of equal first ``n_keys`` columns; ``rows`` are lists of scalars."""
    key, rows = None, []
    for b in batches:
        keys = list(zip(*[b.column(i).to_pylist() for i in range(n_keys)]))
        for r in range(b.num_rows):
            if keys[r] != key:
                if rows:
                    done(rows)
                key, rows = keys[r], []
            rows.append([b.column(i)[r] for i in range(n_keys, b.num_columns)])
    if rows:
        done(rows)


@contextmanager
def bloom_join(spark: SparkSession):
    """Joins planned inside may test the larger side against a Bloom filter (8 MB at most) of the smaller one before its shuffle."""
    at = "spark.sql.optimizer.runtime.bloomFilter."
    want = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1g", "expectedNumItems": "4000000", "numBits": "67108864"}
    before = {k: spark.conf.get(at + k, None) for k in want}
    for k, v in want.items():
        spark.conf.set(at + k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(at + k) if v is None else spark.conf.set(at + k, v)


def full_sets(docs: DataFrame, members: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """``members`` with ``set binary``: the sorted shingle hashes of document ``k``'s text."""

    def run(batches):
        shingles.let_go()
        seen: set = set()  # of a task; what other tasks repeat is compared twice, to no harm
        for whole in batches:
            for b in shingles.pieces(whole, whole.num_columns - 1):
                hashes, counts = shingles.text_sets(b.column(b.num_columns - 1), width)
                h1, h2 = set_hash(hashes, counts)
                ends = np.cumsum(counts) * 8
                data = hashes.tobytes()
                sets = [data[e - 8 * n : e] for e, n in zip(ends.tolist(), counts.tolist())]
                new = [(x := (i, h)) not in seen and not seen.add(x) for i, h in zip(b.column(2).to_pylist(), h1.tolist())]
                mine = np.array(new, bool) & (h1.view(np.int64) == b.column(3).to_numpy()) & (h2.view(np.int64) == b.column(4).to_numpy())  # not another text under the same id
                out = pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sets, pa.binary()), b.column(3)], ["cid", "block", "k", "set", "h1"])
                yield out.filter(pa.array(mine))

    text = docs.select(docs[id_col].cast("long").alias("k"), docs[text_col].alias("t"))
    # the filter holds for all rows; it lets the optimizer build a Bloom filter of the members' ids
    joined = text.join(members.where("block >= 0"), "k").select("cid", "block", "k", "h1", "h2", "t")
    return joined.mapInArrow(run, "cid long, block int, k long, set binary, h1 long")


def near_components(docs: DataFrame, threshold: float = 0.85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row a document.

    Two documents are linked if their sets of distinct ``width``-word shingles have a
    Jaccard coefficient of ``threshold`` (a whole percentage) or more; ``component_id`` is
    the least id reachable.  Words are runs other than the six ASCII blanks, A-Z lowered; a
    text of fewer words is one shingle, one without words and a null text have no set
    and no link.  Rows that share an id share a component; a null id has none
    and stays kept.  Other columns are not read.
    """
    num, den = round(threshold * 100), 100
    sig = cut(signatures(docs, width, id_col, text_col))
    sets = cut(sig.where("n > 0 and k is not null").groupBy("h1", "h2").agg(F.min("k").alias("k"), F.max("n").alias("n"), F.first("roots").alias("roots"), F.first("sketch").alias("sketch")))
    # an id that stands for several texts is one node with all their links
    groups = connected_components(coarse_links(sets.select("k", "roots", "sketch"), threshold))
    member = sets.join(groups, sets["k"] == groups["node"]).select("k", "n", "h1", "h2", F.col("component").alias("cid"))
    member, _, seen = cut_counted(member)
    sizes = member.groupBy("cid").agg(F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # groups of several blocks; at most a row for each BLOCK_DOCS members or BLOCK_SHINGLES shingles
    many, _, of_many = cut_counted(few_tasks(sizes.where("blocks > 1"), seen["rows"]))
    place = F.pmod(F.xxhash64(F.lit(1), "k"), F.coalesce("blocks", F.lit(1))).cast("int")
    placed = cut(salted_join(member, many, ["cid"], "k", "left").select("k", "cid", place.alias("block"), "h1", "h2"))
    with bloom_join(docs.sparkSession):
        held = cut(full_sets(docs, placed, width, id_col, text_col))

    def within(batches):
        shingles.let_go()
        union = Union()
        by_group(batches, 2, lambda rows: group_links([r[0].as_py() for r in rows], [as_set(r[1]) for r in rows], union, num, den))
        yield union.batch()

    first = cut(held.repartition("cid", "block").sortWithinPartitions("cid", "block").mapInArrow(within, "u long, v long"))
    true = first
    if of_many["rows"]:
        true = first.unionByName(across_blocks(held, many, first, num, den))
    comps = connected_components(true)
    by_set = sets.join(comps, sets["k"] == comps["node"], "left").select("h1", "h2", F.coalesce("component", "k").alias("component"))
    out = sig.join(by_set, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.least("component", "k")).otherwise(F.col("k"))
    component = F.when(F.col("k").isNotNull(), component)
    return out.select(F.col("k").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(True)).alias("kept"))


def across_blocks(held: DataFrame, many: DataFrame, first: DataFrame, num: int, den: int) -> DataFrame:
    """Links between blocks of large groups.

    A sample document of each block is held against the whole group, which joins most of its
    components; then documents outside the group's largest component (the fringe) meet
    every block, so that each pair of different components has been compared in full.
    """
    # pass 1: the least document of each block
    large = salted_join(held, many, ["cid"], "k")
    stars = large.groupBy("cid", "block").agg(F.min("k").alias("k"))
    marked = large.join(stars.select("cid", "k", F.lit(True).alias("star")), ["cid", "k"], "left").withColumn("star", F.coalesce("star", F.lit(False)))
    pass_1 = cut(_meet(marked.withColumn("fringe", F.col("star")).withColumn("label", F.col("k")), num, den))
    # pass 2: all that is still outside the largest component
    comps = connected_components(first.unionByName(pass_1))
    label = cut(large.select("cid", "block", "blocks", "k").join(comps, large["k"] == comps["node"], "left").select("cid", "k", F.coalesce("component", "k").alias("label")).distinct())
    top = label.groupBy("cid", "label").agg(F.count("*").alias("m")).groupBy("cid").agg(F.max_by("label", F.struct("m", "label")).alias("main"))
    with_label = large.join(salted_join(label, top, ["cid"], "k"), ["cid", "k"]).withColumn("fringe", F.col("label") != F.col("main"))
    return pass_1.unionByName(cut(_meet(with_label, num, den)))


def _meet(rows: DataFrame, num: int, den: int) -> DataFrame:
    """Each fringe document against every document of its group with another label, a block of fringe and a block of the group at a time."""
    fringe = rows.where("fringe")
    count = fringe.groupBy("cid").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("parts"))
    base = salted_join(rows, count, ["cid"], "k").withColumn("part", F.pmod(F.xxhash64(F.lit(2), "k"), F.col("parts")).cast("int"))
    group = base.select("cid", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "k", "label", F.lit(False).alias("fringe"), "set", F.col("part").alias("own"), F.col("fringe").alias("f"))
    group = group.where("not (f and own = part)").select("cid", "part", "block", "k", "label", "fringe", "set")
    sides = base.where("fringe").select("cid", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "k", "label", "fringe", "set")

    def meet(batches):
        shingles.let_go()
        union = Union()

        def one(rows):
            k, label, side = ([r[i].as_py() for r in rows] for i in range(3))
            cross_links(k, label, side, [as_set(r[3]) for r in rows], union, num, den)

        by_group(batches, 3, one)
        yield union.batch()

    return group.unionByName(sides).repartition("cid", "part", "block").sortWithinPartitions("cid", "part", "block").mapInArrow(meet, "u long, v long")


def one_of_each(docs: DataFrame, threshold: float = 0.85, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with one row of each group of near-duplicates: that of least id.

    Rows of one id and text stay once; texts that share an id are judged each for itself, and of
    several in one group that of least digest stays.  Rows without an id stay.
    """
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row")).withColumn("k", F.col("row")[id_col].cast("long"))
    twice = docs.where(docs[id_col].isNotNull()).groupBy(docs[id_col].cast("long")).count().where("count > 1")
    if twice.isEmpty():
        found = near_components(docs, threshold, width, id_col, text_col)
        kept = rows.join(found.where("not kept").select(F.col(id_col).alias("k")), "k", "left_anti")
    else:
        # a node for each id and text, numbered in the order of ids
        named = rows.where("k is not null").withColumn("digest", F.coalesce(F.md5(F.col("row")[text_col]), F.lit("")))
        places = numbered(named.select("k", "digest").distinct(), "k", "digest")
        single = named.groupBy("k", "digest").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        nodes = cut(single.join(places, ["k", "digest"]).select("place", "row"))
        found = near_components(nodes.select("place", F.col("row")[text_col].alias("text")), threshold, width, "place", "text")
        kept = nodes.join(found.where("not kept").select("place"), "place", "left_anti").select("row").unionByName(rows.where("k is null").select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
