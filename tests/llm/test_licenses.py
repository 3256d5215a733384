import re

import pytest

from tests.llm import cases
from tidelog.llm import licenses as li
from tidelog.llm.templates import TEMPLATES


def brute(rows, entries=TEMPLATES):
    """Every block of every text against every template."""
    made, result = li.compiled(entries), []
    for i, t in rows:
        w = li.words_of(t or "")
        labels, best = set(), 0.0
        for level in li.LEVELS:
            for lo in range(0, len(w), level):
                block = set(w[lo : lo + 2 * level])
                held = [(len(block & x.words), x) for x in made if x.level == level and len(block & x.words) >= x.least and x.must <= block]
                for n, x in held:
                    if n == max(m for m, y in held if y.family == x.family):
                        labels.add(x.label)
                        best = max(best, n / len(x.words))
        places = [(k, label) for p, label in li.PHRASES.items() for n in [len(p.split())] for k in range(len(w)) if w[k : k + n] == p.split()]
        base = sorted({x for _, x in places})
        starts = [k for k, _ in places]
        result.append((i, len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(sorted({*base, *labels})), 1.0 if places else best))
    return sorted(result, key=repr)


NAMES = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scanned(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [x["labels"] for x in li.license_scan(df).orderBy("doc_id").collect()]


def test_ordinary_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("doc_id < 600")
    plain = [(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()]
    got = cases.collected(li.license_scan(df), *NAMES)
    assert got == brute(plain)
    assert {"apache", "gpl"} <= {y for x in got for y in x[5].split(",")}


def test_odd_rows_and_templates(spark):
    rows = [(x[0], x[1]) for x in cases.rows()]
    assert cases.collected(li.license_scan(cases.frame(spark)), *NAMES) == brute(rows)
    whole = [t for *_, t in TEMPLATES]
    more = [(k, f"before it\nx {t.upper()} y\nafter") for k, t in enumerate(whole)]
    more += [(100 + k, " ".join(re.findall(r"\S+", t)[2:])) for k, t in enumerate(whole)] + [(200, "the MIT-License. ccby cc by\ncc\n\nby mit licenses Kmit license K mit license KK")]
    more += [(300 + k, "lead " * k + whole[2]) for k in (31, 32, 33, 100, 130)] + [(400, "x " * 5000 + " ".join(whole))]
    df = spark.createDataFrame(more, "doc_id long, text string")
    assert cases.collected(li.license_scan(df), *NAMES) == brute(more)
    assert li.license_scan(cases.empty(spark)).count() == 0


def test_every_template_gets_its_label(spark):
    got = scanned(spark, [t for *_, t in TEMPLATES])
    for (label, *_), labels in zip(TEMPLATES, got, strict=True):
        assert label in labels.split(","), (label, labels)
    cc = [(label, labels) for (label, family, *_), labels in zip(TEMPLATES, got, strict=True) if family == "cc"]
    for label, labels in cc:  # one word sets them apart
        assert set(labels.split(",")) - {"cc-by"} == {label}


def test_near_templates_and_bare_names(spark):
    lines = ["Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International", "Released under the Apache License.", "Released under the BSD license.", "This work is licensed under the GNU General Public License, version 3."]
    assert scanned(spark, lines) == ["cc-by,cc-by-4.0", "cc-by-4.0", "apache", "bsd", "gpl,gpl-3.0"]


@pytest.mark.parametrize("lead", ["", "# ", " * ", "// "])
def test_wrapped_texts(spark, lead):
    import textwrap

    entries = [e for e in TEMPLATES if len(e[3]) > 200]
    got = scanned(spark, ["\n".join(lead + x for x in textwrap.wrap(t, 72)) for *_, t in entries])
    assert all(e[0] in labels.split(",") for e, labels in zip(entries, got, strict=True))


def test_rows_of_one_doc_id_are_scanned_each(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY 4.0."), (1, "nothing")], "doc_id long, text string")
    assert sorted(x["labels"] for x in li.license_scan(df).collect()) == ["", "cc-by,cc-by-4.0"]
