"""Mixing sources to target weights, with DataFrame functions only.

Tokens here are words. Each source's words, document after document, are packed into blocks of BLOCK words; a source is
laid out as several strips (documents by hash), so that no source has to pass through one task, and the blocks of all
strips are numbered through. The mix is a row of slots, SHARD of them an output shard, each filled by one block:

* draw: every slot draws its source with the targets' shares as probabilities, so a shard's counts by source are a
  multinomial draw (seeded: a hash of the slot's number);
* correction: where all shards together drew more of a source than its target, its last slots in a pseudorandom order
  go to sources that were drawn too seldom, so that small sources meet their targets too. The slots moved are the
  draw's sampling error, some sqrt(slots) a source, and lie spread over all shards;
* permutation: a source's k-th slot takes block p(k mod n) of the source's n blocks, p a pseudorandom permutation
  computed from the index alone (swap-or-not rounds), a new pass beginning when all are used;
* join: blocks, then documents, are joined by block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm.common import WORD, cut, in_order, ranked, tasks_for, total_before

#: Words in a block, weights of sources in turn, most uses of a document, slots in a shard, rows in a strip over all sources.
BLOCK, WEIGHTS, MOST, SHARD, STRIP = 128, (5, 2, 1), 3, 4096, 2_000
#: Rounds of the permutation; numbers in a cell of a lookup, and cells made at a time.
ROUNDS, CELL, RUN = 40, 64, 4096


def by_source() -> Column:
    return F.col("source").asc_nulls_last()


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """From (source, source_size): adds weight and target, and number, the source's place by code point, null last.

    Sources get the weights in turn. All sizes are shared by weight; a source stops at `most` times its size and what
    is above goes to the others by weight. The level, words for a weight of 1, rises with each round of sources that
    stop, as in words; only sums come to the driver.
    """
    x = in_order(sizes, by_source()).withColumn("_one", F.lit(1).cast("long"))
    x = total_before(x, "_one", "number", by_source()).drop("_one")
    w = F.array(*[F.lit(float(v)) for v in weights])
    x = cut(x.withColumn("weight", F.element_at(w, (F.pmod("number", F.lit(len(weights))) + 1).cast("int"))))
    cap = F.lit(most) * F.col("source_size")
    level, total = 0.0, x.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    while True:
        stopped = cap < F.lit(level) * F.col("weight")
        held, free = x.agg(F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~stopped, F.col("weight"))), F.lit(0.0))).first()
        risen = (total - held) / free if free else level
        if risen <= level:
            break
        level = risen
    return x.withColumn("target", F.least(cap.cast("double"), F.lit(level) * F.col("weight")))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the text; null: 0) and text_key (a hash of the text) for each row."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("text_key"))


def layout(rows: DataFrame) -> DataFrame:
    """Adds strip, row (number in its source's strip) and first_word, the words before the row there.

    The number of strips follows the table, not the cluster, so that reruns agree anywhere.
    """
    rows = cut(rows)
    strips = 1 + rows.count() // STRIP
    rows = rows.withColumn("strip", F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(strips)))
    order = Window.partitionBy("source", "strip").orderBy("doc_id", "size", "text_key")
    before = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("row", F.row_number().over(order).cast("long")).withColumn("first_word", F.coalesce(before, F.lit(0)))


def located(points: DataFrame, at: str, ranges: DataFrame) -> DataFrame:
    """points with the row of ranges (_from, _count, ...) that holds the number `at`; ranges don't overlap.

    Both sides meet in cells of CELL numbers, so the work is a join and no list of ranges is held anywhere.
    """
    last = F.floor((F.col("_from") + F.col("_count") - 1) / CELL)
    first = F.floor(F.col("_from") / CELL)
    runs = ranges.filter("_count > 0").withColumn("_run", F.explode(F.sequence(F.floor(first / RUN), F.floor(last / RUN))))
    cells = runs.withColumn("_cell", F.explode(F.sequence(F.greatest(first, F.col("_run") * RUN), F.least(last, (F.col("_run") + 1) * RUN - 1)))).drop("_run")
    found = points.withColumn("_at", F.floor(F.col(at) / CELL)).join(cells.hint("merge"), (F.col("_at") == F.col("_cell")) & (F.col(at) >= F.col("_from")) & (F.col(at) < F.col("_from") + F.col("_count")))
    return found.drop("_at", "_cell")


def permuted(place: Column, n: Column, *key: Column, seed: int = 0) -> Column:
    """A pseudorandom permutation of 0 to n - 1 for each key, at `place`: in each round, x and its partner k - x (mod n)
    change places or stay, as a hash of the larger of both says."""

    def step(x: Column, i: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(F.lit(seed), i, *key), n) - x, n)
        return F.when(F.xxhash64(F.lit(seed + 1), i, F.greatest(x, partner), *key).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), place.cast("long"), step)


def drawn(sources: DataFrame, n: int, seed: int) -> DataFrame:
    """(slot, number): the source each of n slots draws; sources have number, _from and _count, whose sum is n."""
    slots = sources.sparkSession.range(0, n, 1, max(tasks_for(sources.sparkSession), 1 + n // (1 << 20))).withColumnRenamed("id", "slot")
    slots = slots.withColumn("_draw", F.pmod(F.xxhash64(F.lit(seed), "slot"), F.lit(max(1, n))))
    return located(slots, "_draw", sources.select("number", "_from", "_count")).select("slot", "number")


def corrected(slots: DataFrame, sources: DataFrame, seed: int, *more: str) -> DataFrame:
    """(slot, number, k, more columns of the sources): k counts each source's slots from 0 to its n_slots - 1; surplus
    slots go to sources that lack some.

    Few sources may hold all slots, so each source meets its slots in several places: as many copies of the sources as
    there are tasks, but no more rows than a part of the slots.
    """
    slots = cut(ranked(slots, ["number"], F.col("slot"), "k", seed))
    salts = max(1, min(tasks_for(slots.sparkSession), slots.count() // (64 * (1 + sources.count()))))
    got = slots.groupBy(F.col("number").alias("_n")).agg(F.count(F.lit(1)).alias("_drawn"))
    x = sources.join(got, F.col("number") == F.col("_n"), "left").drop("_n").withColumn("_drawn", F.coalesce("_drawn", F.lit(0)))
    x = x.withColumn("_more", F.greatest(F.col("_drawn") - F.col("n_slots"), F.lit(0))).withColumn("_less", F.greatest(F.col("n_slots") - F.col("_drawn"), F.lit(0)))
    x = cut(total_before(total_before(x, "_more", "_more_from", "number"), "_less", "_less_from", "number"))
    own = x.select(F.col("number").alias("_n"), "n_slots", "_more_from", *more, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    slots = slots.withColumn("_s", F.pmod("slot", F.lit(salts))).join(own.hint("merge"), (F.col("number") == F.col("_n")) & (F.col("_s") == F.col("_salt")))
    kept = slots.filter(F.col("k") < F.col("n_slots")).select("slot", "number", "k", *more)
    loose = slots.filter(F.col("k") >= F.col("n_slots")).select("slot", (F.col("_more_from") + F.col("k") - F.col("n_slots")).alias("_i"))
    moved = located(loose, "_i", x.select("number", "_drawn", F.col("_less_from").alias("_from"), F.col("_less").alias("_count"), *more))
    return kept.unionByName(moved.select("slot", "number", (F.col("_drawn") + F.col("_i") - F.col("_from")).alias("k"), *more))


def plan(laid: DataFrame, block: int = BLOCK, seed: int = 0, weights=WEIGHTS, most: int = MOST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources, strips, filled): sources has source_size and target; strips has (source, strip, start), the number of its
    first block; filled has (slot, shard, block) of the whole mix."""
    strips = laid.groupBy("source", "strip").agg(F.sum("size").alias("words")).withColumn("n", F.ceil(F.col("words") / block).cast("long"))
    strips = cut(total_before(in_order(strips, by_source(), "strip"), "n", "start", by_source(), "strip"))
    own = strips.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_blocks"), F.min("start").alias("first_block"))
    share = targets(own, weights, most)
    slots = F.round(F.col("target") / F.col("source_size") * F.col("n_blocks")).cast("long")
    share = share.withColumn("n_slots", F.when(F.col("source_size") > 0, F.least(slots, most * F.col("n_blocks"))).otherwise(F.lit(0)))
    share = cut(total_before(share.withColumn("_count", F.col("n_slots")), "_count", "_from", "number"))
    n = share.agg(F.coalesce(F.sum("n_slots"), F.lit(0))).first()[0]
    filled = corrected(drawn(share, n, seed), share.drop("_count", "_from"), seed + 1, "n_blocks", "first_block")
    index = permuted(F.pmod("k", F.col("n_blocks")), F.col("n_blocks"), F.col("number"), seed=seed + 2)
    filled = filled.select("slot", F.floor(F.col("slot") / SHARD).alias("shard"), (F.col("first_block") + index).alias("block"))
    return share.select("source", "source_size", "weight", "target"), strips.select("source", "strip", "start"), filled


def pieces(laid: DataFrame, strips: DataFrame, block: int = BLOCK) -> DataFrame:
    """Each row's part in each block: block (numbered through), n, its words there, and `at`, how many come before."""
    strips = strips.withColumnsRenamed({"source": "_source", "strip": "_strip"})
    x = laid.filter("size > 0").join(strips.hint("merge"), laid["source"].eqNullSafe(strips["_source"]) & (laid["strip"] == strips["_strip"])).drop("_source", "_strip")
    x = x.withColumn("_b", F.explode(F.sequence(F.floor(F.col("first_word") / block), F.floor((F.col("first_word") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("first_word"), F.col("_b") * block)
    x = x.withColumn("n", F.least(F.col("first_word") + F.col("size"), (F.col("_b") + 1) * block) - lo).withColumn("at", lo - F.col("first_word"))
    return x.withColumn("block", F.col("start") + F.col("_b")).drop("_b", "start")


def uses(filled: DataFrame) -> DataFrame:
    """(block, times, first_shard) of each block in the mix."""
    return filled.groupBy("block").agg(F.count(F.lit(1)).alias("times"), F.min("shard").alias("first_shard"))


def in_mix(parts: DataFrame, used: DataFrame, how: str) -> DataFrame:
    """The pieces with the columns of `used`; null (how = left) if the mix doesn't take them."""
    used = used.withColumnRenamed("block", "_block")
    return parts.join(used.hint("merge"), F.col("block") == F.col("_block"), how).drop("_block")


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 0, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row for each row of `docs`: doc_id, source, size, source_size, target, taken (its words in the mix, repeats
    counted) and first_shard, the first output shard that holds some of them (null: none).

    Rows without words (null, empty) have size and taken 0 and stay in the result; a null source is a source of its
    own, the last; rows repeated with one doc_id lie side by side and are taken each for itself; very long texts lie in
    as many blocks as they fill; an empty table gives an empty result; other columns of `docs` are not read. The same
    table gives the same mix.
    """
    laid = cut(layout(sized(docs)))
    sources, strips, filled = plan(laid, block, seed, weights, most)
    took = in_mix(pieces(laid, strips, block), uses(filled), "inner").groupBy("source", "strip", "row")
    took = took.agg(F.sum(F.col("n") * F.col("times")).alias("taken"), F.min("first_shard").alias("first_shard")).withColumnsRenamed({"source": "_source", "strip": "_strip", "row": "_row"})
    out = laid.join(took.hint("merge"), laid["source"].eqNullSafe(took["_source"]) & (laid["strip"] == took["_strip"]) & (laid["row"] == took["_row"]), "left").drop("_source", "_strip", "_row")
    sources = sources.withColumnRenamed("source", "_source")
    out = out.join(sources, out["source"].eqNullSafe(sources["_source"]), "left").drop("_source")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_shard")


def mixed_blocks(docs: DataFrame, block: int = BLOCK, seed: int = 0, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix by slot: (shard, slot, source, doc_id, at, n), where a slot holds n words of a document from word `at` on.

    Nulls, empty texts, repeated rows, long texts and empty tables as in `mix`; other columns are not read.
    """
    laid = cut(layout(sized(docs)))
    _, strips, filled = plan(laid, block, seed, weights, most)
    return in_mix(pieces(laid, strips, block), filled, "inner").select("shard", "slot", "source", "doc_id", "at", "n")


def mixed_texts(docs: DataFrame, block: int = BLOCK, seed: int = 0, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The mix itself, in the columns of `docs`: a document's first copy holds its words in blocks taken at all, its
    second those in blocks taken at least twice, and so on. A copy that holds all words has the text as it was; others
    have their words joined by a space. Copies without words are no rows, so null and empty texts don't return; n_chars,
    where it is a column, follows the text. A null source is the last source; null doc_ids are documents like others.
    Equal rows (doc_id, source and text) are laid out each for itself. Whatever other columns are called, they stay as they are;
    very long texts may return in parts; an empty table gives an empty result.
    """
    laid = cut(layout(sized(docs)))
    _, strips, filled = plan(laid, block, seed, weights, most)
    parts = in_mix(pieces(laid, strips, block), uses(filled).select("block", "times"), "left").withColumn("times", F.coalesce("times", F.lit(0)))
    parts = parts.groupBy("source", "strip", "row", "doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("at", "n", "times"))).alias("parts"), F.min("times").alias("all"), F.max("times").alias("top")).filter("top > 0")
    parts = parts.select(F.col("source").alias("_from"), F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "parts", "all", "top")
    rows = docs.select(F.struct("*").alias("_row"), F.col("source").alias("_source"), F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text_key"))
    equal = Window.partitionBy("_source", "_id", "_text_key").orderBy(F.lit(0))
    rows = rows.withColumn("_nth", F.row_number().over(equal)).filter("_nth = 1")
    x = rows.join(parts.hint("merge"), F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")) & F.col("_source").eqNullSafe(F.col("_from")))
    x = x.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("top").cast("int"))))
    words = F.regexp_extract_all("_row.text", F.lit(WORD), 0)
    some = F.flatten(F.transform(F.filter("parts", lambda p: p["times"] >= F.col("_copy")), lambda p: F.slice(words, p["at"].cast("int") + 1, p["n"].cast("int"))))
    x = x.withColumn("_text", F.when(F.col("all") >= F.col("_copy"), F.col("_row.text")).otherwise(F.array_join(some, " ")))
    made = F.col("_row").withField("text", F.col("_text"))
    if "n_chars" in docs.columns:
        made = made.withField("n_chars", F.length("_text").cast(docs.schema["n_chars"].dataType))
    return x.select(made.alias("_row")).select("_row.*")
