"""License scan, with DataFrame functions only: phrases, and an exact set-similarity join of text blocks with templates.

Texts are tokenised once. What any template or phrase uses (a fixed vocabulary) is kept as one number a word, word
number times vocabulary plus word code, in a checkpointed table; counts, blocks, filters, verification and phrases are
read from there, never from the text again.

Blocks follow words, not lines, so that wrapped and commented texts are found: for each L of LEVELS, blocks of 2 L
words begin every L words, and any L consecutive words lie in one. A template belongs to the least level that it fits.
It is found in a block that holds at least CONTAINED of its distinct words, and all of those it cannot do without
(``must``: its names, and what sets it apart from a template of another label that is as good as contained). Of the
labels of a family a block keeps the one it holds most words of.

The words of the vocabulary are put in the order of their counts in the whole corpus, rarest first. Then a block can
hold a template only if

* length: it has as many template words as the template needs (`least`),
* prefix: it has one of the template's first size - least + 1 words, which are rare,
* position: at a common word, what is left of both in the common order is still enough.

Pairs that pass are verified on their full sets.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import cut, texts
from tidelog.llm.templates import TEMPLATES

#: Phrases and labels of the base.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words by what they are made of: the complement of [\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F], and much faster to match.
WORD = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]+"
CONTAINED, LEVELS = 0.8, (32, 128)


@dataclass(frozen=True)
class Template:
    label: str
    family: str
    level: int
    words: frozenset[str]
    must: frozenset[str]
    least: int


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9\x80-\U0010ffff]+", text.translate(str.maketrans(UPPER, LOWER)))


def compiled(entries, contained: float = CONTAINED) -> list[Template]:
    """Templates with what each cannot do without; (label, family, must, text) of each entry."""
    sets = [(label, family, frozenset(words_of(must)), words_of(text)) for label, family, must, text in entries]
    out = []
    for label, family, must, words in sets:
        own = frozenset(words)
        least = math.ceil(contained * len(own) - 1e-9)
        for other, _, _, theirs in sets:
            if other != label and len(own & set(theirs)) >= least:
                must |= own - set(theirs)
        level = next((x for x in LEVELS if len(words) <= x), None)
        if level is None:
            raise ValueError(f"a template of {len(words)} words fits no level: give its paragraphs")
        out.append(Template(label, family, level, own, must & own, least))
    return out


def numbers(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<int>)")


def vocabulary(templates: list[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words} | {w for p in PHRASES for w in p.split()})


def tokenised(rows: DataFrame, words: list[str]) -> DataFrame:
    """row, doc_id, n_words and hits: place * len(words) + code of each word of the vocabulary, in the order of the text."""
    every = F.regexp_extract_all("text", F.lit(WORD), 0)
    known = F.array(*[F.lit(w) for w in words])

    def hit(w: Column, i: Column) -> Column:
        low = F.lower(w)  # lower() also turns the Kelvin sign, three bytes, into a k
        code = F.array_position(known, low) - 1
        return F.when(low.isin(*words) & (F.octet_length(low) == F.octet_length(w)), i.cast("long") * len(words) + code)

    x = rows.select("doc_id", every.alias("w"))
    return x.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("w").cast("long").alias("n_words"), F.filter(F.transform("w", hit), lambda h: h.isNotNull()).alias("hits"))


def places_of(words: list[str], phrase: str, label: str) -> Column:
    """Structs (start, label) of the places where the phrase's words stand consecutively, from hits."""
    n, codes = len(words), [words.index(w) for w in phrase.split()]

    def starts(h: Column, i: Column) -> Column:
        ok = F.pmod(h, F.lit(n)) == codes[0]
        for j, c in enumerate(codes[1:], 1):
            ok = ok & (F.get("hits", i + j) == h + j * n + c - codes[0])
        return F.coalesce(ok, F.lit(False))

    return F.transform(F.filter("hits", starts), lambda h: F.struct(F.floor(h / n).cast("long").alias("start"), F.lit(label).alias("label")))


def phrase_places(words: list[str]) -> Column:
    return F.concat(*[places_of(words, p, label) for p, label in PHRASES.items()])


def word_counts(made: DataFrame, words: list[str]) -> list[int]:
    """How often each word of the vocabulary occurs in all texts; at most a row for each comes to the driver."""
    codes = made.select(F.explode("hits").alias("h")).groupBy(F.pmod("h", F.lit(len(words))).alias("code")).agg(F.count(F.lit(1)).alias("n"))
    out = [0] * len(words)
    for x in codes.collect():
        out[x["code"]] = x["n"]
    return out


def block_sets(made: DataFrame, n: int, place_of: list[int], prefix: set[int], level: int, least: int) -> DataFrame:
    """(row, block, own): the vocabulary of each block of a level as sorted places in the common order.

    Only rows that hold a word of some prefix, and blocks with `least` words, can lead anywhere.
    """
    codes = [c for c, p in enumerate(place_of) if p in prefix]
    near = made.filter(F.exists("hits", lambda h: F.pmod(h, F.lit(n)).isin(*codes))).select("row", F.explode("hits").alias("h"))
    place = F.element_at(numbers(place_of), (F.pmod("h", F.lit(n)) + 1).cast("int"))
    last = F.floor(F.col("h") / n / level).cast("long")
    each = near.select("row", place.alias("place"), F.explode(F.when(last > 0, F.array(last - 1, last)).otherwise(F.array(last))).alias("block"))
    own = each.groupBy("row", "block").agg(F.array_sort(F.collect_set("place")).alias("own"))  # at most 2 * level of them
    return own.filter((F.size("own") >= least) & F.arrays_overlap("own", numbers(sorted(prefix))))


def matches(made: DataFrame, templates: list[Template], words: list[str]) -> DataFrame:
    """(row, label, containment) of all blocks that hold a template."""
    counts = word_counts(made, words)
    order = sorted(range(len(words)), key=lambda c: (counts[c], words[c]))
    place_of = [0] * len(words)
    for p, c in enumerate(order):
        place_of[c] = p
    at = {w: place_of[c] for c, w in enumerate(words)}
    spark, found = made.sparkSession, []
    for level in LEVELS:
        here = [(k, t, sorted(at[w] for w in t.words)) for k, t in enumerate(templates) if t.level == level]
        if not here:
            continue
        first = [(s[i], k, i, len(s), t.least) for k, t, s in here for i in range(len(s) - t.least + 1)]
        starts = spark.createDataFrame(first, "_place int, template int, i int, size int, least int")
        full = spark.createDataFrame([(k, t.label, t.family, s, sorted(at[w] for w in t.must)) for k, t, s in here], "_template int, label string, family string, _set array<int>, _must array<int>")
        own = block_sets(made, len(words), place_of, {f[0] for f in first}, level, min(t.least for _, t, _ in here))
        each = own.select("row", "block", "own", F.posexplode("own").alias("j", "place"))
        rest = F.least(F.col("size") - F.col("i"), F.size("own") - F.col("j"))
        near = each.join(F.broadcast(starts), (F.col("place") == F.col("_place")) & (F.size("own") >= F.col("least")) & (rest >= F.col("least")))
        pairs = near.select("row", "block", "own", "template", "size", "least").distinct()
        checked = pairs.join(F.broadcast(full), F.col("template") == F.col("_template")).withColumn("both", F.size(F.array_intersect("own", "_set")))
        checked = checked.filter((F.col("both") >= F.col("least")) & (F.size(F.array_except("_must", "own")) == 0))
        own_family = checked.groupBy("row", "block", "family").agg(F.collect_set(F.struct("both", "label", (F.col("both") / F.col("size")).alias("containment"))).alias("m"))  # at most the templates
        best = F.filter("m", lambda x: x["both"] == F.array_max(F.transform("m", lambda y: y["both"])))
        found.append(own_family.select("row", F.explode(best).alias("b")).select("row", "b.label", "b.containment"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def license_scan(docs: DataFrame, templates=TEMPLATES, contained: float = CONTAINED) -> DataFrame:
    """One row for each row of `docs`: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest containment of a template found, and 1 where a phrase stands. Null and empty texts have no
    words, no labels and score 0; null doc_ids and repeated rows stay and are scanned each for itself; very long texts
    are cut into blocks like any other; an empty table gives no rows; other columns are not read.
    """
    made_of = compiled(templates, contained)
    words = vocabulary(made_of)
    made = cut(tokenised(texts(docs), words))
    found = matches(made, made_of, words).groupBy("row").agg(F.collect_set("label").alias("_labels"), F.max("containment").alias("_best"))  # at most the labels
    x = made.select("row", "doc_id", "n_words", phrase_places(words).alias("places"))
    base = F.array_sort(F.array_distinct(F.col("places.label")))
    x = x.select("row", "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"), base.alias("_base"))
    out = x.join(found.withColumnRenamed("row", "_row"), F.col("row") == F.col("_row"), "left")
    every = F.array_sort(F.array_union("_base", F.coalesce("_labels", F.expr("cast(array() as array<string>)"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("_best", F.lit(0.0)))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("_base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
