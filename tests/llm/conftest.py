import random

import pytest


def sentence(rng, n):
    vocabulary = ["the", "of", "and", "river", "stone", "café", "light", "house", "walks", "blue", "über", "seven", "niño", "quietly", "Paper"]
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ".", ","]) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """(doc_id, text, lang, source): copies, shared passages, nulls, blanks, long and periodic texts, repeated rows."""
    rng = random.Random(5)
    out = [(i, sentence(rng, rng.choice([3, 25, 60, 130, 260])), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "c", "é", None])) for i in range(60)]
    passage = sentence(rng, 70)
    for i in range(60, 80):
        out.append((i, f"{sentence(rng, 30)}\n{passage} {sentence(rng, 20)}", "en", "hot"))
    for i in range(80, 95):
        out.append((i, out[i % 7][1].replace(" ", "  \t", i % 3), "en", "hot"))
    for i in range(95, 105):
        words = out[3][1].split(" ")
        words[i % len(words)] = "changed"
        out.append((i, " ".join(words), "fr", "b"))
    out += [(105, None, None, None), (106, "", "en", "a"), (107, " \n\t ", "en", "a"), (108, "x", "de", "a"), (109, "ab" * 300, "en", "a"), (110, "na " * 400, "en", "b"), (111, sentence(rng, 4000), "en", "a"), (112, "%% $$ ## " * 40, "en", "c"), (113, "intro " + "na " * 150 + "end", "en", "b"), (114, "na\tna " * 80, "fr", "b")]
    out.append((115, " ".join(rng.choice(["%%", "$$x", "##", "&&a", "**", "<|>"]) for _ in range(200)), "en", "c"))
    out += [out[10], out[105], (None, out[12][1], "en", "a")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    """With extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    for name in ("did", "tag", "h", "size", "key", "row", "target", "n_chars", "pos", "fp", "recipe", "shared", "range", "keep"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
