import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
import xxhash
from test_corpus import brute_quality
from test_dedup import LAST, brute_near, norm, rank, words

import corpus_pipeline
from lectern.llm import mixing, packing


@pytest.fixture(scope="module")
def stages(spark, docs):
    """The table after every stage, with the input first."""
    current, out = docs, [docs]
    for name, stage in corpus_pipeline.STAGES:
        current = corpus_pipeline.materialise(stage(spark, current, ""), name)
        out.append(current)
    return out


def of(table):
    return Counter((r["doc_id"], r["text"], r["lang"], r["source"]) for r in table.collect())


def listed(rows):
    return sorted(rows.elements(), key=lambda r: (rank(r[0]), str(r)))


def test_columns_stay(stages):
    assert all(t.columns == stages[0].columns for t in stages[1:5])


def test_quality_as_by_brute_force(stages):
    rows = listed(of(stages[0]))
    assert of(stages[1]) == Counter(r for r, q in zip(rows, brute_quality(rows), strict=True) if q[-1])
    assert 0 < stages[1].count() < len(rows)


def test_exact_as_by_brute_force(stages):
    rows = listed(of(stages[1]))
    first = {}
    for r in rows:
        first[norm(r[1])] = min(first.get(norm(r[1]), LAST), rank(r[0]))
    assert of(stages[2]) == Counter(r for r in rows if rank(r[0]) == first[norm(r[1])])
    assert stages[2].count() < len(rows)


def test_near_as_by_brute_force(stages):
    rows = listed(of(stages[2]))
    labels = brute_near([r[0] for r in rows], [r[1] for r in rows])
    assert of(stages[3]) == Counter(r for r, c in zip(rows, labels, strict=True) if rank(r[0]) == c)
    assert stages[3].count() < len(rows)


def spark_hash(value, bits, seed=42):
    return xxhash.xxh64_intdigest(value if bits is None else (value & (1 << bits) - 1).to_bytes(bits // 8, "little"), seed)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_mix(rows):
    """Rows as the mix takes them: keys in order, complete epochs first, and the first words at the edge of a budget."""
    by = defaultdict(list)
    for d, t, lang, source in rows:
        did = (1 << 63) - 1 if d is None else d
        n = len(words(t))
        u = (signed(spark_hash(mixing.SEED, 32, spark_hash(did, 64))) % (1 << 53) + 0.5) / float(1 << 53)
        mean = len(t or "") / max(n, 1)
        quality = (0.5 + 0.5 * min(n / 50.0, 1.0)) * (2.0 if 4 <= mean <= 10 else 1.0)
        tag = signed(spark_hash(t.encode(), None)) if t is not None else 42
        by[source].append((-math.log(u) / quality, did, tag, n, (d, t, lang, source)))
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    size = {s: sum(r[3] for r in by[s]) for s in order}
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, Fraction(0)), [s for s in order if size[s]], Fraction(3 * sum(size.values()), 2)
    while left and open_:
        share = left / sum(weight[s] for s in open_)
        left = Fraction(0)
        for s in list(open_):
            target[s] += share * weight[s]
            if target[s] >= 2 * size[s]:
                left += target[s] - 2 * size[s]
                target[s] = Fraction(2 * size[s])
                open_.remove(s)
    out = Counter()
    for s in order:
        if not size[s]:
            continue
        epochs = target[s] // size[s]
        rest = round(target[s] - epochs * size[s])
        for *_, n, (d, t, lang, source) in sorted(by[s], key=lambda r: r[:3]):
            part = min(n, rest)
            rest -= part
            if n and epochs + (part == n):
                out[d, t, lang, source] += int(epochs) + (part == n)
            if 0 < part < n:
                out[d, " ".join(words(t)[:part]), lang, source] += 1
    return out


def test_mixing_as_by_brute_force(stages):
    rows = listed(of(stages[3]))
    assert of(stages[4]) == brute_mix(rows)
    assert stages[4].count() > len(rows)


def test_packing_places_every_id_of_the_mix(stages):
    encode = packing.encoding(packing.vocabulary_path()).encode
    want, got = Counter(), Counter()
    for d, t, *_ in of(stages[4]).elements():
        ids = [*encode(t, allowed_special="all"), packing.END]
        want.update((d, len(ids), i, x) for i, x in enumerate(ids))
    for p in stages[5].collect():
        got.update((p["doc_id"], p["doc_tokens"], p["start"] + i, x) for i, x in enumerate(p["ids"]))
    assert got == want


def test_run_is_the_stages_in_turn(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert got.columns == "doc_id start length ids_crc32 doc_tokens sequence_id offset ids".split()
    assert got.agg({"length": "sum"}).first()[0] > 1000


def test_names_and_long_texts(spark, rows):
    """Clashing and dotted names, and a text of several MB, go through every stage."""
    numbers = " ".join(f"the river {i} and" for i in range(300_000))
    docs = spark.createDataFrame([*rows, (900, numbers, "en", "a")], "doc_id long, text string, lang string, source string")
    for name in ("a.b", "x`y", "__did", "__tag", "__sha", "row", "tag_", "size", "node"):
        docs = docs.withColumn(name, corpus_pipeline.F.lit(1))
    current = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        current = corpus_pipeline.materialise(stage(spark, current, ""), name)
        assert current.columns == docs.columns
        assert name == "mixing" or current.filter("doc_id = 900").first()["text"] == numbers
    packed = corpus_pipeline.STAGES[4][1](spark, current, "")
    assert packed.agg({"length": "sum"}).first()[0] > 1000


def test_empty_table(spark, empty):
    current = empty
    for name, stage in corpus_pipeline.STAGES:
        current = corpus_pipeline.materialise(stage(spark, current, ""), name)
    assert current.count() == 0
