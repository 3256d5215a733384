"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

Sketch. A set is thrown into `bins` bins in rounds; round i hashes every element to a bin and a value, and a bin keeps
the least value of the first round that reaches it. In rounds bins to 2 bins - 1 all elements go to bin i - bins, so
every bin is filled after 2 bins rounds at the latest, mostly after two or three. Two sets agree in a bin with the
probability of their similarity, with the concentration of independent draws.

Links. Equal sets are one class. Classes that share a band are candidates; band count and width are derived from the
threshold, so that a pair at the threshold is missed with a chance of at most MISS. In each bucket all members are
verified against one hub (the member with most company), never against each other. What that leaves open, members of
one hub's circle in different components, is settled by bounds: writing i for what a member shares with a consensus set
and c for the elements outside it that two members share, their intersection is at most min(i, i') + c. So a link needs
shared rare elements (joined by element, with a prefix filter) or sizes small enough for c = 0 (joined by size range);
only such pairs are verified. Every link between different components that shares a band is found, and no bucket is
ever expanded into its pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm import kernel
from tidelog.llm.common import cut, small_batches, texts
from tidelog.llm.components import components

MISS, MOST_BINS = 1e-6, 160
NO_ID = np.iinfo(np.int64).min
U64 = np.uint64


def banding(threshold: float) -> tuple[int, int]:
    """(bands, rows of a band): the widest bands that MOST_BINS bins allow at a miss of MISS."""
    best = (1, 1)
    for rows in range(1, 20):
        bands = max(1, math.ceil(math.log(MISS) / math.log1p(-(threshold**rows)))) if threshold < 1 else 1
        if bands * rows <= MOST_BINS:
            best = (bands, rows)
    return best


def shingle_sets(x: kernel.Block, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence."""
    starts, ends, before = x.words()
    h = x.word_hashes(starts, ends, lower=True)
    w, first = kernel.windows(h, before, k)
    bounds = np.searchsorted(first, before)
    out = []
    for r in range(x.hi - x.lo):
        n = before[r + 1] - before[r]
        if n >= k:
            out.append(np.unique(w[bounds[r] : bounds[r + 1]]))
        elif n:
            own, _ = kernel.windows(h[before[r] : before[r + 1]], np.array([0, n]), int(n), seed=int(n) + 1)
            out.append(own)
        else:
            out.append(h[:0])
    return out


def sketches(sets: list[np.ndarray], bins: int) -> np.ndarray:  # up to 512 bins
    """One row of `bins` values for each set; rows of empty sets mean nothing."""
    size = np.array([len(s) for s in sets])
    values = np.full((len(sets), bins), np.iinfo(np.uint64).max, U64)
    flat, seeds = values.reshape(-1), kernel.splitmix(2 * bins, 0xF55)
    live = np.flatnonzero(size)
    for i in range(2 * bins):
        if not len(live):
            break
        elements = np.concatenate([sets[r] for r in live])
        row = np.repeat(live, size[live])
        y = kernel.mix(elements ^ seeds[i])
        place = (((y >> U64(32)) * U64(bins)) >> U64(32)).astype(np.int64) if i < bins else i - bins
        np.minimum.at(flat, row * bins + place, (U64(i) << U64(54)) | ((y << U64(32) | y >> U64(32)) >> U64(10)))
        live = live[(values[live] == np.iinfo(np.uint64).max).any(axis=1)]
    return values


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    factors = kernel.splitmix(rows, 0xBA4D) | U64(1)
    folded = (values.reshape(-1, bands, rows) * factors).sum(axis=2, dtype=U64)
    return kernel.mix(kernel.mix(folded) + kernel.splitmix(bands, 0xB4)).view(np.int64)


def digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def sketch_rows(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """id, n_shingles, node (digest of the set; null for empty sets), bands."""

    def run(batches):
        for b in batches:
            size, node, keys = [], [], []
            for x in kernel.blocks(b.column("text")):
                sets = shingle_sets(x, k)
                made = band_keys(sketches(sets, bands * rows), bands, rows)
                size += [len(s) for s in sets]
                node += [digest(s) if len(s) else None for s in sets]
                keys += [made[r] if len(s) else None for r, s in enumerate(sets)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(size, pa.int64()), pa.array(node, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["id", "n_shingles", "node", "bands"])

    return docs.mapInArrow(run, "id long, n_shingles long, node binary, bands array<long>")


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """node, elements: the full set of each row that has one."""

    def run(batches):
        for b in batches:
            for x in kernel.blocks(b.column("text")):
                sets = [s for s in shingle_sets(x, k) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([digest(s) for s in sets], pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "elements"])

    return docs.mapInArrow(run, "node binary, elements array<long>")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (p, u) with both sets: adds s_p, s_u, common, and extra, the elements of u outside p."""
    a = sets.select(F.col("node").alias("_a"), F.col("elements").alias("_u"))
    b = sets.select(F.col("node").alias("_b"), F.col("elements").alias("_p"))
    x = pairs.join(a.hint("merge"), F.col("u") == F.col("_a")).join(b.hint("merge"), F.col("p") == F.col("_b"))
    x = x.select("p", "u", F.size("_p").cast("long").alias("s_p"), F.size("_u").cast("long").alias("s_u"), F.array_except("_u", "_p").alias("extra"))
    return x.withColumn("common", F.col("s_u") - F.size("extra"))


def is_link(common, size_a, size_b, num: int, den: int):
    """den * intersection >= num * union."""
    return den * common >= num * (size_a + size_b - common)


def consensus(circles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, extras) of circles, seen from what a quarter of their members share instead of from their hub.

    members: hub, node, label, s (set size), common (elements in the hub or in a quarter of the circle).
    extras: hub, node, x, df for all other elements that at least two members have.
    """
    size = circles.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("hub", "_hub")
    every = circles.select("hub", "node", F.explode("extra").alias("x"))
    df = every.groupBy("hub", "x").agg(F.count(F.lit(1)).alias("df")).filter("df > 1").join(size, F.col("hub") == F.col("_hub")).select(F.col("hub").alias("_h"), F.col("x").alias("_x"), "df", (4 * F.col("df") >= F.col("n")).alias("often"))
    e = cut(every.join(df, (F.col("hub") == F.col("_h")) & (F.col("x") == F.col("_x"))).select("hub", "node", "x", "df", "often"))
    more = e.filter("often").groupBy("hub", "node").agg(F.count(F.lit(1)).alias("more"))
    members = circles.select("hub", "node", "label", "s", "common").join(more, ["hub", "node"], "left").withColumn("common", F.col("common") + F.coalesce("more", F.lit(0))).drop("more")
    return cut(members), e.filter("not often").select("hub", "node", "x", "df")


def in_several(members: DataFrame) -> DataFrame:
    """Only circles with members in more than one component."""
    mixed = members.groupBy("hub").agg(F.min("label").alias("_l"), F.max("label").alias("_m")).filter("_l != _m").select("hub")
    return members.join(mixed, "hub", "left_semi")


STEP = math.log(1.02)


def open_pairs(members: DataFrame, extras: DataFrame, num: int, den: int) -> DataFrame:
    """(p, u) of members of one circle in different components that the bounds do not exclude.

    With o the intersection a link needs, two members share at least o - min(common, common') elements outside the
    consensus. Where sizes alone leave that at 0, the pair is open (`by size`, only where the least size of the range
    leaves it at 0). All others share at least one, and the poorer one (by common) k or more with partners of a size
    range: one of its rarest extras, all but the last k - 1, is among the partner's (`by element`), and as many of
    these are as the exact sizes need beyond k - 1.
    """
    o = lambda a, b: num * (a + b) / (num + den)
    bin_of = lambda v: F.floor(F.log(v.cast("double")) / STEP)
    low, high = F.ceil(F.col("s") * num / den), F.floor(F.col("s") * den / num)
    members = members.withColumn("bin", bin_of(F.col("s")))
    # the circle's size bins (a few hundred at most, as sizes go) with their labels: only those matter where another component is
    there = members.groupBy("hub", "bin").agg(F.min("label").alias("l"), F.max("label").alias("m")).groupBy("hub").agg(F.collect_list(F.struct("bin", "l", "m")).alias("bins"))
    near = lambda b: (b["bin"] >= bin_of(F.greatest(low, F.lit(1)))) & (b["bin"] <= bin_of(high)) & ((b["l"] != F.col("label")) | (b["m"] != F.col("label")))
    ranged = members.join(there.hint("merge"), "hub").withColumn("_bin", F.explode(F.transform(F.filter("bins", near), lambda b: b["bin"]))).drop("bins")
    need = F.ceil(o(F.col("s"), F.exp(F.col("_bin") * STEP) - 1e-6) - 1e-6) - F.col("common")
    ranged = ranged.withColumn("k", need).drop("bin")
    own = Window.partitionBy("hub", "node")  # one document's elements
    e = extras.withColumn("r", F.row_number().over(own.orderBy("df", "x"))).withColumn("m", F.count(F.lit(1)).over(own))
    poor = ranged.withColumn("k", F.greatest("k", F.lit(1))).join(e, ["hub", "node"]).filter("r <= m - k + 1").select("hub", "x", "_bin", "node", "label", "common", "s", "k")
    rich = members.join(extras, ["hub", "node"]).select(F.col("hub").alias("_hub"), F.col("x").alias("_x"), F.col("bin").alias("_b"), F.col("node").alias("_node"), F.col("label").alias("_label"), F.col("common").alias("_common"), F.col("s").alias("_s"))
    poorer = (F.col("common") < F.col("_common")) | ((F.col("common") == F.col("_common")) & (F.col("node") < F.col("_node")))
    fits = (F.col("label") != F.col("_label")) & poorer & (num * F.col("s") <= den * F.col("_s")) & (num * F.col("_s") <= den * F.col("s"))
    enough = (num + den) * F.col("common") >= num * (F.col("s") + F.col("_s"))
    by_element = poor.join(rich.hint("merge"), (F.col("hub") == F.col("_hub")) & (F.col("x") == F.col("_x")) & (F.col("_bin") == F.col("_b")) & fits & ~enough)
    shared = by_element.groupBy("hub", "node", "_node").agg(F.count(F.lit(1)).alias("both"), *[F.first(c).alias(c) for c in ("k", "common", "s", "_s")])
    by_element = shared.filter((num + den) * (F.col("both") + F.col("k") - 1 + F.col("common")) >= num * (F.col("s") + F.col("_s")))
    sizes = members.select(F.col("hub").alias("_hub"), F.col("node").alias("_node"), F.col("label").alias("_label"), F.col("s").alias("_s"), F.col("common").alias("_common"), F.col("bin").alias("_b"))
    by_size = ranged.filter("k <= 0").join(sizes.hint("merge"), (F.col("hub") == F.col("_hub")) & (F.col("_bin") == F.col("_b")) & fits & enough)
    pair = [F.col("node").alias("p"), F.col("_node").alias("u")]
    return by_element.select(*pair).unionByName(by_size.select(*pair)).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z; a document's set holds its distinct shingles of `shingle` words (fewer words: the
    whole sequence as one). Documents with den * intersection >= num * union are linked; component_id is the smallest
    doc_id reachable and kept says that it is the row's own. Texts without words (null, empty) have n_shingles 0 and
    stand alone. A null doc_id counts as smaller than all others, as doc_id and as component_id; rows that repeat a
    doc_id each give a row, and are kept alike. An empty table gives no rows; other columns are not read.
    """
    small_batches(docs.sparkSession)
    bands, rows = banding(num / den)
    source = texts(docs).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    made = cut(sketch_rows(source, shingle, bands, rows))
    classes = cut(made.filter("node is not null").groupBy("node").agg(F.min("id").alias("root"), F.first("bands").alias("bands")))

    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    buckets = cut(keyed.join(shared, "key"))
    score = cut(buckets.groupBy("node").agg(F.sum("n").alias("score")))
    scored = buckets.select("node", "key").join(score, "node")
    hubs = scored.groupBy("key").agg(F.max_by("node", F.struct("score", "node")).alias("p"))
    stars = cut(buckets.select("key", F.col("node").alias("u")).join(hubs, "key").filter("p != u").select("p", "u").distinct())

    involved = classes.select("node", "root").join(score.select("node"), "node", "left_semi")
    wanted = source.join(involved.select(F.col("root").alias("id")).distinct().hint("merge"), "id", "left_semi")
    sets = set_rows(wanted, shingle).join(involved.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"])
    sets = cut(sets)

    def linked(pairs: DataFrame) -> DataFrame:
        return pairs.filter(is_link(F.col("common"), F.col("s_p"), F.col("s_u"), num, den)).select(F.col("p").alias("a"), F.col("u").alias("b"))

    def joined(found: DataFrame, more: DataFrame) -> DataFrame:
        more = cut(more)
        return cut(components(found.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))) if more.limit(1).count() else found

    def labelled(members: DataFrame, found: DataFrame) -> DataFrame:
        return cut(in_several(cut(members.join(found.withColumnsRenamed({"node": "_n", "label": "_l"}), F.col("node") == F.col("_n"), "left").withColumn("label", F.coalesce("_l", "node")).drop("_n", "_l"))))

    first = cut(overlaps(stars, sets))
    found = cut(components(linked(first)))
    circles = labelled(first.select(F.col("p").alias("hub"), F.col("u").alias("node"), F.col("s_u").alias("s"), "common", "extra"), found)
    members, extras = consensus(circles)
    # the member nearest to the consensus is a second hub of its circle
    best = members.groupBy("hub").agg(F.max_by(F.struct("node", "label"), F.struct("common", -F.col("s"), "node")).alias("best")).select(F.col("hub").alias("_hub"), F.col("best.node").alias("p"), F.col("best.label").alias("_label"))
    again = members.join(best, (F.col("hub") == F.col("_hub")) & (F.col("label") != F.col("_label"))).select("p", F.col("node").alias("u")).distinct()
    found = joined(found, linked(overlaps(again, sets)))
    rest = cut(open_pairs(labelled(members.drop("label"), found), extras, num, den))
    found = joined(found, linked(overlaps(rest, sets)))

    named = classes.select("node", "root").join(found, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("root").alias("component"))
    named = named.join(least, "label").select(F.col("node").alias("_node"), "component")
    out = made.select("id", "n_shingles", "node").join(named, F.col("node") == F.col("_node"), "left")
    component = F.coalesce("component", "id")
    back = lambda c: F.when(c != NO_ID, c)
    return out.select(back(F.col("id")).alias("doc_id"), "n_shingles", back(component).alias("component_id"), (F.col("id") == component).alias("kept"))
