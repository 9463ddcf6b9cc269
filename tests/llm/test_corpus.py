import base64
import glob
import gzip
import hashlib
import html as html_lib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import extraction, mixing, packing, quality, url_filter, warc


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_targets_by_repeated_resharing(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, "d": 5, None: 50, "Z": 0}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.source_targets(df).collect()}
    order = sorted((k for k in sizes if k is not None), key=lambda k: k.encode()) + [None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while left > 1e-9 and open_:
        total = sum(weight[k] for k in open_)
        over = 0.0
        for k in list(open_):
            target[k] += left * weight[k] / total
            if target[k] >= 2 * sizes[k]:
                over += target[k] - 2 * sizes[k]
                target[k] = 2 * sizes[k]
                open_.discard(k)
        left = over
    assert got == pytest.approx(target)


def test_mix_meets_its_targets(docs, rows):
    first = mixing.op3(docs).collect()
    again = mixing.op3(docs.repartition(5)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(first, key=key) == sorted(again, key=key)
    assert len(first) == len(rows)
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(words(t))
    by = defaultdict(list)
    for r in mixing.mix(docs).collect():
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == size[r["source"]]
    for s, rs in by.items():
        assert sum(r["taken"] for r in rs) == pytest.approx(rs[0]["target"], abs=1), s
        epochs = rs[0]["epochs"]
        assert all(r["taken"] >= epochs * r["size"] for r in rs)
        assert sum(r["taken"] % max(1, r["size"]) > 0 for r in rs) <= 1


def test_heavier_documents_come_first_more_often(spark):
    rows = [(k * 10**6 + i, "word " * 10, s) for k, s in enumerate("rst") for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    heavy = F.when(F.col("did") % 2 == 0, 3.0).otherwise(1.0)
    taken = mixing.mix(df, quality=heavy).filter("source = 't'").groupBy((F.col("did") % 2).alias("odd")).agg(F.sum("taken").alias("n")).collect()
    n = {r["odd"]: r["n"] for r in taken}
    assert n[0] + n[1] == pytest.approx(40_000 / 1.2, abs=2)
    assert n[0] > 1.25 * n[1]


def test_odd_qualities_keep_every_row(spark):
    """Null, zero, negative, infinite and undefined weights: rows out are rows in, targets are met, the least weights come last."""
    nan, inf = float("nan"), float("inf")
    values = [None, 0.0, -3.0, nan, inf, -inf, 1e-300, 1e300, 1.0, 1e4]
    rows = [(i, "word " * (i % 7), "abc"[i % 3], values[i % len(values)]) for i in range(1200)]
    quality = {i: q for i, _, _, q in rows}
    df = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, source string")
    given = F.element_at(F.array(*[F.lit(v) for v in values]).cast("array<double>"), (F.col("did") % len(values) + 1).cast("int"))
    got = mixing.mix(df, quality=given).collect()
    assert len(got) == len(rows)
    for source in "abc":
        mine = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in mine) == pytest.approx(mine[0]["target"], abs=1)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in mine)
        if source != "a":  # which is taken twice, whole
            least = [r for r in mine if r["size"] and (quality[r["did"]] is None or not quality[r["did"]] > 1e-9)]
            most = [r for r in mine if r["size"] and quality[r["did"]] is not None and quality[r["did"]] > 1e8]
            assert sum(r["taken"] / r["size"] for r in least) / len(least) < sum(r["taken"] / r["size"] for r in most) / len(most)
    again = mixing.mix(df.repartition(7), quality=given).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


@pytest.mark.parametrize("quality", [1e4, 1.0, 1e-6])
def test_no_range_of_keys_is_hot(spark, quality):
    """One range of a source is sorted in one task: it has less than a hundredth of the source, whatever the weights."""
    df = spark.range(60_000).select(F.floor(mixing.RANGES * F.log2(mixing.exponential_key(F.col("id"), F.lit(quality)))).alias("range"))
    assert df.groupBy("range").count().agg(F.max("count")).first()[0] < 600
    rows = spark.createDataFrame([(None, f"text number {i}", "a") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(rows, quality=F.lit(quality))
    assert got.count() == 3000 and got.filter("taken > 0").count() == 3000  # one source: one epoch and half of the next
    assert got.agg(F.sum("taken")).first()[0] == 13_500


def test_mixed_documents_hold_the_words_taken(docs):
    plan = Counter()
    for r in mixing.mix(docs).collect():
        plan[r["did"], r["source"]] += r["taken"]
    docs = docs.withColumn("a.b`c", F.lit("clash")).withColumn("__did", F.lit(1)).withColumn("row", F.lit(2)).withColumn("__text", F.lit(3))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    for r in mixed.collect():
        got[(1 << 63) - 1 if r["doc_id"] is None else r["doc_id"], r["source"]] += len(words(r["text"]))
        assert r["a.b`c"] == "clash"
    assert got == +plan


def test_repeated_rows_are_mixed_one_by_one(spark):
    rows = [(1, "w " * 101, "a")] * 7 + [(None, "v " * 40, "a")] * 9 + [(2, None, "a")] * 3 + [(3 + i, "u " * 90, "b") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    plan = mixing.mix(docs).collect()
    assert len(plan) == len(rows)
    mixed = mixing.mixed_documents(docs).collect()
    for source in "ab":
        taken = sum(r["taken"] for r in plan if r["source"] == source)
        assert taken == pytest.approx(next(r["target"] for r in plan if r["source"] == source), abs=1)
        assert sum(len(words(r["text"])) for r in mixed if r["source"] == source) == taken


def page_rows():
    body = "<html><body>%s</body></html>"
    return [
        (5, "https://Example.com/a?x=1#y", body % "one"), (3, "http://www.example.com/a", body % "one"), (9, None, body % "one"), (1, "no scheme", None), (2, "http://[bad", ""),
        (4, "http://x.org/é", "é\r\n\r\nWARC/1.1\r\n\r\n" + "long " * 60_000), (None, "http://x.org/n", body % "one"), (7, "http://x.org/r\r\nn", "r"), (7, "http://x.org/r\r\nn", "r"), (8, "http://x.org/z", "r"),
    ]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(2)
    for name in ("n", "digest", "sha1", "path", "host", "key", "text", "first", "value"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_archives_round_trip(pages):
    first = {}
    for i, _, h in page_rows():
        p = (h or "").encode()
        first[p] = min(first.get(p, 1 << 62), 1 << 62 if i is None else i)
    want = []
    for i, _, h in page_rows():
        p = (h or "").encode()
        response = i == first[p]
        want.append((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if response else "revisit", None if response else first[p]))
    got = [tuple(r) for r in warc.op4(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_index_is_in_global_order(spark, pages, tmp_path, monkeypatch):
    many = spark.createDataFrame([(i, f"http://h{i % 7}.example.com/{i * 7919 % 100}", f"t{i % 90}") for i in range(9000)], "page_id long, url string, html string").repartition(2)
    monkeypatch.setattr(warc, "RANGE_ROWS", 700)
    index = warc.archive_pages(many, f"file://{tmp_path}/w").collect()
    keys = [(r["urlkey"], r["timestamp"], r["page_id"]) for r in index]
    assert len({r["archive"] for r in index}) > 1
    assert sorted(keys) == keys
    assert {r["page_id"] for r in index} == set(range(9000))
    assert len(index) == 9000
    with_digest = {r["payload_digest"] for r in index if r["record_type"] == "response"}
    assert {r["payload_digest"] for r in index} == with_digest


def test_small_payloads_can_stay_responses(pages):
    rows = warc.with_revisits(pages, "page_id", "url", "html", min_bytes=10).collect()
    assert all(r["refers_to"] is None for r in rows if len(r["html"].encode()) < 10)


def test_damaged_archives_are_found(spark, pages, tmp_path):
    path = f"{tmp_path}/w"
    warc.write_archives(pages.filter("page_id = 5"), f"file://{path}")
    (name,) = glob.glob(f"{path}/*/part-*")
    data = gzip.decompress(open(name, "rb").read()).replace(b"one", b"two")
    with pytest.raises(ValueError, match="digest"):
        warc.parse_archive("x", gzip.compress(data))
    with pytest.raises(ValueError, match="ends within"):
        warc.parse_archive("x", gzip.compress(data[:-30]))


def test_archives_are_closed_by_size_and_can_be_sought_in(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 5}.org/{i}", f"<p>{rng.random()} {i % 300}" if i % 3 else "same") for i in range(600)]
    rows += [(1000, "http://long.org/", "".join(rng.choice("ab") for _ in range(50_000))), (1001, "http://huge.org/", "x" * 17_000_000 + "end")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = f"{tmp_path}/w"
    warc.write_archives(df, f"file://{path}", archive_bytes=4000)
    sizes = {"/".join(name.split("/")[-2:]): os.path.getsize(name) for name in glob.glob(f"{path}/*/part-*")}
    assert len(sizes) > 30
    assert sum(size > 4000 for size in sizes.values()) <= 2
    source = {i: h for i, _, h in rows}
    index = warc.capture_index(spark, f"file://{path}").collect()
    assert {r["page_id"] for r in index} == set(source)
    ends = defaultdict(int)
    for r in index:
        with open(f"{path}/{r['archive']}", "rb") as archive:
            archive.seek(r["offset"])
            record = gzip.decompress(archive.read(r["length"]))
        assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + r["record_type"].encode())
        assert record.endswith((source[r["page_id"]].encode() if r["record_type"] == "response" else b"") + b"\r\n\r\n")
        ends[r["archive"]] += r["length"]
    assert ends == sizes


def test_foreign_archives_of_one_member(pages):
    """Several records in one member: each is found, and sought by the member."""
    record = "WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:lectern:page:%d>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Target-URI: http://a.org/%d\r\nWARC-Payload-Digest: sha1:X\r\nWARC-Refers-To: <urn:lectern:page:1>\r\nContent-Length: 38\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\n\r\n\r\n"
    record = record.replace("Content-Length: 38", "Content-Length: 38").encode()
    data = gzip.compress(record % (2, 2) + record % (3, 3)) + gzip.compress(record % (4, 4))
    rows = warc.parse_archive("x", data)
    assert [r[2] for r in rows] == [2, 3, 4]
    assert len({r[9] for r in rows}) == 2
    assert [gzip.decompress(data[r[9] : r[9] + r[10]]).count(b"WARC/1.1") for r in rows] == [2, 2, 1]


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(7)
    for k in (0, 1, 2, 3, 7, 16, 33):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
        merged = list(warc.LoserTree([iter([(x, (x, i)) for x in r]) for i, r in enumerate(runs)]))
        assert [x for x, _ in merged] == sorted(x for r in runs for x in r)


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page has-sidebar">
<header><h1>Site</h1><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav></header>
<div class="cookie-notice"><p>We use cookies, and so on. Accept, please, all of them.</p></div>
<div id="wrap"><div class="sidebar"><p>Latest: many things, all of them new, and more.</p></div>
<div class="content"><h2>A  heading</h2><p>First paragraph, with <b>bold</b> &amp; <a href="x">a link</a>, long enough to count. It goes on, and on.</p>
<script>var x = "<p>no</p>";</script><p>Second<br>one, which also has some length to it, commas, and full stops. Yes.</p><ul><li>Point one, said.</li><li>Two</li></ul>
<div class="ad">Buy now, cheap, today.</div><p>Caf&eacute; &#8212; short.</p><form><label>Mail</label><input><button>Go</button></form></div>
<div class="comments"><p>Nice article, thanks a lot, I liked it very much. Really.</p></div></div><footer>&copy; 2020</footer></body></html>"""


def test_the_article_is_extracted():
    got = extraction.main_text(ARTICLE).split("\n")
    assert got == [
        "A heading", "First paragraph, with bold & a link, long enough to count. It goes on, and on.", "Second one, which also has some length to it, commas, and full stops. Yes.",
        "Point one, said.", "Two", "Café — short.",
    ]


@pytest.mark.parametrize("wrap", ["{}", "<html><body>{}</body></html>", "<html><body><div id='a'>{}</div></body></html>"])
def test_articles_of_plain_elements_are_whole(wrap):
    long, short = "A sentence of the article, which is long. " * 24, "The last paragraph of it, which is a short one, ends here."
    want = ["T", long.strip(), short]
    assert extraction.main_text(wrap.format(f"<div><h1>T</h1><p>{long}</p><p>{short}</p></div>")).split("\n") == want
    assert extraction.main_text(wrap.format(f"<div><h1>T</h1><div><p>{long}</p><p>{short}</p></div></div>")).split("\n") == want
    assert extraction.main_text(wrap.format(f"<div><h1>T</h1><p>{short}</p><div><p>{long}</p><p>{long}</p></div></div>")).split("\n") == ["T", short, long.strip(), long.strip()]


LONG = "A sentence of the article, which is long, and has commas. " * 6


def test_nothing_of_an_article_is_lost():
    parts = ["<p class='alert'>Mind the gap, please.</p>", "<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "<xmp><b>raw</b> &amp; text</xmp>", "<ul class='references'><li><a href=x>Ref one</a></li><li><a href=y>Ref two</a></li></ul>", "<div>caption</div>", "<table><tr><td>1</td><td>2</td></tr></table>", "<p>End.</p>"]
    page = f"<body><nav><p>{LONG}</p></nav><article><p>{LONG}</p>{''.join(parts)}</article><div class='related'><p>{LONG}</p></div></body>"
    assert extraction.main_text(page).split("\n") == [LONG.strip(), "Mind the gap, please.", "x=1", "<b>raw</b> &amp; text", "Ref one", "Ref two", "caption", "1", "2", "End."]


def test_paths_are_told_apart_without_names():
    page = f"<body><ul><li><a href=x>Menu one</a></li><li><a href=y>Menu two</a></li></ul><div>Buy this now.</div><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p><ul><li><a href=z>Next</a></li></ul></body>"
    assert extraction.main_text(page).split("\n") == ["Head", LONG.strip(), "Short.", LONG.strip()]


def test_a_class_around_the_whole_page_says_nothing():
    page = f"<body><div class='widget'><h1>Head</h1><p>{LONG}</p><p>{LONG}</p><div class='comments'><p>Nice, thanks.</p></div></div><p>12 May</p></body>"
    assert extraction.main_text(page).split("\n")[:3] == ["Head", LONG.strip(), LONG.strip()]
    assert "Nice" not in extraction.main_text(page)


def renamed(page):
    return page.replace("<article>", "<div>").replace("</article>", "</div>")


def test_the_ratios_select(spark, monkeypatch):
    """With nothing but the ratios replaced, by a constant or their inverse, most pages without an article element give another text."""
    pages = [renamed(r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    texts = list(map(extraction.main_text, pages))
    real = extraction.path_ratios
    for other in (lambda found: dict.fromkeys(real(found), 1.0), lambda found: {k: 1 / max(v, 1e-9) for k, v in real(found).items()}):
        monkeypatch.setattr(extraction, "path_ratios", other)
        assert sum(extraction.main_text(p) != t for p, t in zip(pages, texts, strict=True)) > 0.9 * len(pages)
        monkeypatch.setattr(extraction, "path_ratios", real)


def test_pages_that_say_nothing_about_themselves(spark, monkeypatch):
    """Without article elements, and without class words too, by ratios alone, nearly all texts are those of the pages as they are."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").limit(600).collect()]
    texts = list(map(extraction.main_text, pages))
    assert sum(extraction.main_text(renamed(p)) == t for p, t in zip(pages, texts, strict=True)) > 0.99 * len(pages)
    monkeypatch.setattr(extraction, "MARKED", 1.0)
    assert sum(extraction.main_text(renamed(p)) == t for p, t in zip(pages, texts, strict=True)) > 0.97 * len(pages)


def test_priors_are_bounded():
    nest = "<div class='ad banner'><section class='sidebar'>" * 4
    found = extraction.blocks(f"<body>{nest}<p>x</p></section></div><article class='comments'><div class='ad'><main><p>y</p></main></div></article></body>")
    assert [b.prior for b in found] == [pytest.approx(1 / 3), pytest.approx(1)]


def test_pages_as_a_table(spark):
    rows = [(1, "http://a.org/", ARTICLE), (1, None, ARTICLE), (None, "u", None), (2, "u", ""), (2, "u", ""), (3, None, f"<p>{LONG}</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for name in ("text", "n_chars", "a.b", "path", "title"):
        df = df.withColumn(name, F.lit("clash"))
    key = lambda r: tuple(map(str, r))
    want = [(i, u, t, len(t)) for i, u, t in ((i, u, extraction.main_text(h or "")) for i, u, h in rows)]
    assert sorted(map(tuple, extraction.op5(df).collect()), key=key) == sorted(want, key=key)
    assert extraction.op5(df).columns == ["page_id", "url", "text", "n_chars"]


@pytest.mark.parametrize("page", ["", "   ", "<p>", "</div></p>", "<!-- open", "<script>never closed", "a < b and c > d", "<a <b <c", "<p class='x", "&#xD800; &bogus; &#99999999;", "<div>" * 3000 + "deep"])
def test_odd_pages_do_not_crash(page):
    assert isinstance(extraction.main_text(page), str)


def test_long_pages_are_read_to_the_end():
    page = "<html><body><article>" + "".join(f"<p>Paragraph {i}, with some text in it, and a stop.</p>" for i in range(5000)) + "</article></body></html>"
    got = extraction.main_text(page).split("\n")
    assert len(got) == 5000
    assert got[-1].startswith("Paragraph 4999")


def test_generated_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in df.collect()}
    for r in extraction.op5(df).collect():
        page = source[r["page_id"]]
        start, end = page.find("<article>"), page.find("</article>")
        part = re.sub("</?b>", "", page[start : end if end >= 0 else len(page)]).replace("<br>", " ")
        blocks = [" ".join(html_lib.unescape(x).split()) for x in re.split("</?(?:p|h1|article)>", part)]
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def js_distance(p, q):
    out = 0.0
    for a, b in zip(p, q, strict=True):
        x, y = a / sum(p), b / sum(q)
        m = (x + y) / 2
        out += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
    return math.sqrt(max(out, 0))


def class_of(ch):
    if "a" <= ch <= "z":
        return 0
    if "A" <= ch <= "Z":
        return 1
    if "0" <= ch <= "9":
        return 2
    if ch in " \t\n\r\x0b\x0c":
        return 3
    if ch in ".,;:!?'\"-()":
        return 4
    return 6 if ch in "#*$%&|<>" else 7 if ord(ch) > 127 else 5


def brute_quality(rows):
    """(doc_id, counts, base_failed, kept) of every row."""
    common = list(dict.fromkeys(quality.COMMON_WORDS))
    stats = []
    for d, t, lang, _ in rows:
        t = t or ""
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        repeat = set()
        for i in range(len(w) - 7):
            if grams[tuple(w[i : i + 8])] > 1:
                repeat.update(range(i, i + 8))
        classes = [0] * 8
        for ch in t:
            classes[class_of(ch)] += 1
        lower = Counter(re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in w)
        counts = [lower[c] for c in common]
        counts.append(len(w) - sum(counts))
        stats.append((d, len(w), sum(map(len, w)), sum(map(t.count, "#*$%&|<>")), len(lines) - len(set(lines)), len(repeat), lang, classes, counts))
    refs = {}
    for lang in {x[6] for x in stats}:
        plausible = [x for x in stats if x[6] == lang and x[1] >= 20 and 100 * x[5] <= 30 * x[1] and x[7][0] + x[7][1] + x[7][7] >= 0.6 * (sum(x[7]) - x[7][3])]
        worded = [x for x in plausible if x[1] - x[8][-1] >= 0.1 * x[1]]
        fitted = worded if len(worded) >= 5 else plausible if len(plausible) >= 5 else []
        sums = lambda part, k: [sum(col) for col in zip(*(x[k] for x in part), strict=True)]
        refs[lang] = (sums(fitted, 7), sums(worded, 8) if len(worded) >= 5 else [])
    want = []
    for d, n, chars, symbols, dup, repeat, lang, classes, counts in stats:
        failed = n < 20 or 100 * repeat > 30 * n
        far = sum(classes) >= quality.MIN_CLASS_CHARS and bool(refs[lang][0]) and js_distance(classes, refs[lang][0]) > quality.MAX_CLASS_DISTANCE
        if n >= quality.MIN_COMMON_WORDS and sum(refs[lang][1]):
            far = far or js_distance(counts, refs[lang][1]) > quality.MAX_COMMON_DISTANCE
            own, usual = n - counts[-1], sum(refs[lang][1][:-1])
            less = counts[-1] / n > refs[lang][1][-1] / sum(refs[lang][1])
            far = far or less and js_distance([own, counts[-1]], [usual, refs[lang][1][-1]]) > quality.MAX_SHARE_DISTANCE
        want.append((d, n, chars, symbols, dup, repeat, failed, not failed and not far))
    return want


def test_quality_as_by_brute_force(docs, rows):
    want = brute_quality(rows)
    got = [tuple(r) for r in quality.op7(docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(not r[6] and not r[7] for r in want)


def test_texts_without_their_languages_common_words_are_rejected(spark):
    rng = random.Random(11)
    common = {"en": "the of and to in is that for".split(), "fr": "de la le les et des en un".split()}
    token = lambda: "".join(rng.choice("aeionrsthl") for _ in range(7))
    prose = lambda lang, n: " ".join(rng.choice(common[lang]) if rng.random() < 0.22 else token() for _ in range(n))
    rows = [(i, prose(("en", "fr")[i % 2], 150 + i), ("en", "fr")[i % 2]) for i in range(40)]
    rows += [(100, " | ".join(token() for _ in range(150)), "en"), (101, " ".join(token() for _ in range(2000)), "fr"), (102, prose("fr", 300), "en"), (103, " ".join(token() for _ in range(60)), "en")]
    rows += [(104, prose("en", 60) + " " + " | ".join(token() for _ in range(140)), "en")]
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.op7(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i, (base_failed, kept) in got.items() if base_failed] == []
    assert sorted(i for i, (_, kept) in got.items() if not kept) == [100, 101, 102, 104]  # 103 is too short to tell


@pytest.mark.parametrize("junk", ["%% $$x ## &&a ** <|> ", "token {} ", "ЖЖ№ {} ", "12 {} 34 "])
def test_a_language_of_mostly_junk_keeps_its_prose(spark, junk):
    """Ten clean texts among forty of junk stay, and the junk goes."""
    rng = random.Random(12)
    common = "the of and to in is that for".split()
    token = lambda: "".join(rng.choice("aeionrsthl") for _ in range(7))
    rows = [(i, " ".join(rng.choice(common) if rng.random() < 0.25 else token() for _ in range(160)), "en") for i in range(10)]
    rows += [(100 + i, " ".join(junk.replace("{}", token()) + str(rng.random()) for _ in range(120)), "en") for i in range(40)]
    rows += [(200, rows[0][1], "zz"), (201, rows[100 - 90][1], "zz"), (202, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["kept"] for r in quality.op7(df).collect()}
    assert [i for i in range(10) if not got[i]] == [] and not any(got[100 + i] for i in range(40))
    report = {r["lang"]: tuple(r)[1:] for r in quality.reference_report(df).collect()}
    assert report["en"][0] == 50 and report["en"][2:] == (10, True, True)
    assert report["zz"][3:] == (False, False) and report[None][:3] == (1, 0, 0)


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def swapped(text):
    return text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 4096])
def test_periodic_lines_and_words_are_told_apart(spark, n):
    a = thue_morse(n)
    b = swapped(a)
    texts = [f"{a}\n{b}\nx", f"{a}\n{a}\nx", " ".join([*"1234567", a, *"1234567", b]), " ".join([*"1234567", a, *"1234567", a]), f"{a} 1\n{a} 2\n{b} 1\n{b} 1"]
    rows = [(i, t, "en") for i, t in enumerate(texts)]
    got = {r["doc_id"]: (r["n_dup_lines"], r["n_repeat_words"]) for r in quality.op7(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (0, 0), 3: (0, 16), 4: (1, 0)}


def test_wrong_hashes_are_found_out(monkeypatch):
    text = "one two\nthree four\none two\nfive\n" + "a b c d e f g h " * 2 + "a b c d e f g i"
    data = np.frombuffer(text.encode(), "uint8")
    want = quality.text_stats(data, np.array([0, len(data)]))
    monkeypatch.setattr(quality, "range_hashes", lambda d, s, e, seed=0: np.zeros(len(s), "uint64"))
    got = quality.text_stats(data, np.array([0, len(data)]))
    for name in ("n_dup_lines", "n_repeat_words"):
        assert got[name].tolist() == want[name].tolist()
    assert want["n_dup_lines"].tolist() == [1]


def test_packing_places_every_id_once(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    reference = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter(tuple(reference.encode(t or "", add_special_tokens=False).ids + [0]) for _, t, *_ in rows)
    pieces = packing.pack_documents(docs).collect()
    sequences, texts = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append(p)
        assert p["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in p["ids"]))
        assert len(p["ids"]) == p["length"] > 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p["offset"])
        total = 0
        for p in parts:
            assert p["offset"] == total
            total += p["length"]
        assert total <= 1024
        assert total & (total - 1) == 0
        assert len(parts) <= packing.MAX_SEGMENTS
    # pieces of one document follow each other in a partition, whose number leads the sequence id
    for p in pieces:
        texts[p["did"], p["doc_tokens"], p["sequence_id"] >> 32].append(p)
    assert sum(p["length"] for p in pieces) == sum(len(k) * n for k, n in want.items())
    for (_, n, _), parts in texts.items():
        if sum(p["length"] for p in parts) == n:
            ids = tuple(i for p in sorted(parts, key=lambda p: p["start"]) for i in p["ids"])
            assert ids in want


def test_the_added_token_is_one_id(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    reference = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"end {mark} of text", mark, f"{mark}{mark}", f"  {mark}  \n {mark}\n\nx", f"a{mark}'s {mark}é", "<|endoftext| > <|endoftext|", f"<{mark}>", f"tab\t{mark}\t \tb 12"]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = defaultdict(dict)
    for p in packing.pack_documents(docs).collect():
        got[p["did"]].update(enumerate(p["ids"], p["start"]))
    for i, t in enumerate(texts):
        ids = reference.encode(t, add_special_tokens=False).ids
        assert [got[i][k] for k in sorted(got[i])] == [*ids, packing.END]
        assert ids.count(50256) == t.count(mark)


def test_ids_equal_the_tokenizers_on_random_strings(spark):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    reference = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    bits = ["<|endoftext|>", "<|", "|>", "endoftext", " ", "  ", "\n", "\t", "a", "'s", "'Ll", "123", "é", "日本", "🙂", "\u00a0", "\u2003", "!?", "word", " Word", "\r\n", "\x00", "\x1c"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = defaultdict(dict)
    for p in packing.pack_documents(docs).collect():
        got[p["did"]].update(enumerate(p["ids"], p["start"]))
    for i, ids in enumerate(reference.encode_batch(texts, add_special_tokens=False)):
        assert [got[i][k] for k in sorted(got[i])] == [*ids.ids, packing.END], texts[i]
    assert sum("<|endoftext|>" in t for t in texts) > 300


@pytest.mark.parametrize(("limits", "which", "chars"), [((256, 64, 256), 0, (400, 300)), ((256, 3, 256), 1, (60, 60)), ((256, 64, 100), 2, (30, 30))])
def test_every_limit_binds_on_instructions(spark, limits, which, chars):
    """Questions and answers of the driver's conversations, whole: with each limit in turn, some bin is full by it."""
    turns = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], {})[r["turn"]] = r["text"] or ""
    rows = [(i, *x) for i, x in enumerate((t[k][: chars[0]], t[k + 1][: chars[1]]) for t in turns.values() for k in sorted(t)[:-1] if k + 1 in t)]
    examples = spark.createDataFrame(rows, "doc_id long, prompt string, text string").coalesce(1)
    pieces = packing.pack_documents(examples, prompt_col="prompt", limits=limits, cut=False).collect()
    encode = packing.encoding(packing.vocabulary_path()).encode_ordinary
    own = {i: (len(encode(p)), len(encode(t)) + 1) for i, p, t in rows}
    bins, seen = defaultdict(list), defaultdict(list)
    for p in pieces:
        bins[p["sequence_id"]].append(p)
        seen[p["did"]].append(p)
    for i, parts in seen.items():
        prompt, answer = own[i]
        assert sum(p["length"] for p in parts) == prompt + answer
        assert len(parts) == 1 or prompt + answer > limits[0] or answer > limits[2]
    loss = lambda p: max(0, p["start"] + p["length"] - max(p["start"], own[p["did"]][0]))
    totals = [(sum(p["length"] for p in b), len(b), sum(map(loss, b))) for b in bins.values()]
    assert all(x <= limit for t in totals for x, limit in zip(t, limits, strict=True))
    assert sum(t[which] >= 0.9 * limits[which] for t in totals) > len(totals) / 3
    assert len(seen) == len(rows)


def test_cut_examples_keep_a_small_loss_limit():
    packer = packing.Packer((64, 8, 20))
    sizes = [(300, 250), (10, 10), (64, 0), (500, 1), (1, 1), (30, 25)] * 6
    for i, (n, loss) in enumerate(sizes):
        packer.add(i, n, loss)
    packer.pack()
    seen = defaultdict(list)
    for b in packer.bins:
        total = sum(x.length for x in b)
        assert 0 < total <= 64
        assert total & (total - 1) == 0
        assert len(b) <= 8
        assert sum(x.loss for x in b) <= 20
        for x in b:
            seen[x.key].append((x.start, x.length))
    for i, (n, _) in enumerate(sizes):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == n


def test_limits_hold_without_cutting():
    packer = packing.Packer((100, 4, 50), cut=False)
    sizes = [(37, 20), (60, 50), (10, 1), (10, 10), (99, 3), (5, 5), (5, 0), (41, 30)] * 5
    for i, (n, loss) in enumerate(sizes):
        packer.add(i, n, loss)
    packer.pack()
    placed = [x.key for b in packer.bins for x in b]
    assert sorted(placed) == list(range(len(sizes)))
    for b in packer.bins:
        assert sum(x.length for x in b) <= 100
        assert sum(x.loss for x in b) <= 50
        assert len(b) <= 4
    with pytest.raises(ValueError, match="fit"):
        packer.add(0, 101, 0)


def brute_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), m[1]) if m else ""
    path = m[2] if m else ""
    fits = [(len(h + p), h + p, v) for v, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls_as_by_brute_force(spark):
    urls = [f"http://{h}{p}" for h in ("com", "a.com", "example.com", "x.example.com", "EXAMPLE.net", "example.net", "notexample.net", "net", "org", "a.b.org", "example.com.", "example.com:80", "") for p in ("", "/", "/en/", "/en/7", "/en/71?q", "/de/8#f", "/de/", "/es/x", "/EN/", "?/en/", "#://a.com/en/")]
    urls += [None, "", "com/en/", "x://y://com/en/", "http://com/en/ http://org/es/", "http://" + "a." * 3000 + "com/en/" + "x" * 100_000]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(None, urls[0]), (1, urls[1])], "page_id long, url string")
    for name in ("host", "path", "key", "rule", "w", "p"):
        df = df.withColumn(name, F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.op10(df).collect()}
    for i, u in enumerate(urls):
        assert got[i] == brute_verdict(u), u


def test_rules_from_a_table(spark):
    """A list of any length as a table: hosts in capitals, rules for one key, nulls, an empty table."""
    rng = random.Random(5)
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "org", "EN.org"]
    rules = [(rng.choice(["block", "allow"]), rng.choice(hosts), rng.choice(["", "/", "/en/", "/en/7", "/de", "/de/8/x"])) for _ in range(60)] + [("block", None, "/q"), ("other", "com", "/"), ("block", "z.org", None)]
    urls = [f"http://{h}{p}" for h in ("com", "w.a.com", "b.a.com", "q.b.a.com", "net", "y.x.net", "en.org", "z.org", "", "edu") for p in ("", "/", "/en/", "/en/71", "/de/8/xy", "/q")] + [None, "no scheme"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    lowered = [(v, (h or "").lower(), p or "") for v, h, p in rules if v in ("block", "allow")]

    def want(url, listed):
        name, rest = brute_verdict(url)[:2]
        # a rule without a host fits what has an empty last label, an empty host too
        best = max(((len(h + p), h + p, v) for v, h, p in listed if (name == h or name.endswith("." + h)) and rest.startswith(p)), default=(0, None, "allow"))
        return name, rest, best[1], best[2]

    table = spark.createDataFrame(rules, "verdict string, host string, path string").withColumn("key", F.lit("clash"))
    for given, listed in ((table, lowered), (table.limit(0), []), (rules, lowered), ([], [])):
        got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(df, given).collect()}
        for i, u in enumerate(urls):
            assert got[i] == want(u, listed), u


def test_cascades_are_exact(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "FIRST_BITS", 2)
    monkeypatch.setattr(url_filter, "LATER_BITS", 2)
    listed = spark.range(300).selectExpr("concat('k', id * 7) AS key")
    universe = spark.range(5000).selectExpr("concat('k', id) AS key")
    cascade = url_filter.Cascade(listed, universe)
    assert len(cascade.levels) > 2
    hits = {r["key"] for r in universe.filter(cascade.holds(F.col("key"))).collect()}
    assert hits == {f"k{i * 7}" for i in range(300)}
    monkeypatch.setattr(url_filter, "MAX_BITS", 64)
    with pytest.raises(ValueError, match="bits"):
        url_filter.Cascade(listed, universe)


@pytest.mark.parametrize("late", [False, True])  # the list itself is too long, or a level over the corpus's keys
def test_lists_beyond_the_filters_are_joined(spark, monkeypatch, late):
    rows = [(i, f"http://{h}{p}") for i, (h, p) in enumerate((h, p) for h in ("a.com", "example.com", "x.example.net", "org", "net") for p in ("/en/", "/en/7", "/de/8", "/es/", ""))]
    rows += [rows[0], (None, rows[1][1]), (None, None), (3, None)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("keys", F.lit("clash"))
    key = lambda r: tuple(str(x) for x in r)
    want = sorted(map(tuple, url_filter.op10(df).collect()), key=key)
    if late:

        def build(keys, number):
            raise url_filter.TooManyKeys

        monkeypatch.setattr(url_filter, "build_level", build)
    else:
        monkeypatch.setattr(url_filter, "MAX_BITS", 0)
    assert sorted(map(tuple, url_filter.op10(df).collect()), key=key) == want
    assert "Join" in url_filter.op10(df)._jdf.queryExecution().toString()


def test_empty_tables(empty, pages):
    for op in (mixing.op3, quality.op7, packing.op8):
        assert op(empty).count() == 0
    for op in (warc.op4, extraction.op5, url_filter.op10):
        assert op(pages.limit(0)).count() == 0
