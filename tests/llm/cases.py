"""Documents with the odd cases: nulls, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, size string, kept string"


def rows():
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeéü") for _ in range(r.randint(1, 6)))
    passage = " ".join(word() for _ in range(60))
    long_text = " ".join(word() for _ in range(30_000))
    texts = [None, "", " \n\t", "one", "one two", "ONE two\vthree\fx", passage, passage, f"start here {passage} and the end", passage.replace(" ", "\n", 7)]
    texts += ["a  b \n c   d\n\n e", "x" * 5000, "don't we'll <|endoftext|> say 12345 so.  ok 漢字かな 🙂🙂", "GNU General Public License, mit LICENSE; cc-by"]
    texts += ["line one here\nline one here\nline two\n\n", "w " * 300, long_text, "## $$ %% && ||", "ｕｎｉ \x1c\x1d y"]
    out = [(i, t, "en", r.choice(["a", "b", "é", None]), len(t or ""), 7, "s", "k") for i, t in enumerate(texts)]
    out += [out[6], out[6], (None, passage, None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return out


def frame(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def collected(df, *names):
    return sorted((tuple(x[n] for n in names) for x in df.collect()), key=repr)


def sample(spark, sf, n=200):
    """Ordinary documents for the brute-force versions, as Python tuples (doc_id, text) and as a frame."""
    df = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(n)
    return [(x.doc_id, x.text) for x in df.select("doc_id", "text").collect()], df
