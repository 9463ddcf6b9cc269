"""Texts far longer than a slice, without white space, or periodic."""

import hashlib
import os
import random
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest

from lectern.llm import byte_dedup, common, exact_dedup, mixing, packing, quality, simhash, substring_dedup


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def long_docs(spark):
    numbers = " ".join(map(str, range(900_000)))  # over 6 MB
    texts = {1: numbers, 2: "x" * 1_000_000, 3: "head " + numbers[: len(numbers) // 2], 4: "ab " * 100_000, 5: ""}
    return texts, spark.createDataFrame([(k, t, "en", "s") for k, t in texts.items()], "doc_id long, text string, lang string, source string").repartition(2)


def test_words(long_docs):
    texts, df = long_docs
    got = {r["doc_id"]: r for r in substring_dedup.op1(df).collect()}
    assert [got[k]["n_words"] for k in (1, 2, 3, 4, 5)] == [len(texts[k].split()) for k in (1, 2, 3, 4, 5)]
    assert got[1]["n_removed"] == got[4]["n_removed"] == 0
    half = len(texts[3].split()) - 1
    assert half - 1 <= got[3]["n_removed"] <= half


def test_bytes(long_docs):
    texts, df = long_docs
    got = {r["doc_id"]: r for r in byte_dedup.op2(df).collect()}
    assert got[1]["n_removed"] == 0
    assert got[2]["n_removed"] == 999_999
    assert got[2]["kept_sha256"] == hashlib.sha256(b"x").hexdigest()
    assert got[4]["n_removed"] == 299_997
    assert got[3]["n_removed"] == len(texts[3]) - len("head ")


def test_others(long_docs):
    texts, df = long_docs
    assert all(r["kept"] for r in exact_dedup.op9(df).collect())
    assert simhash.op6(df).count() == 5
    stats = {r["doc_id"]: r for r in quality.op7(df).collect()}
    assert stats[1]["n_words"] == 900_000
    assert stats[1]["n_repeat_words"] == 0
    assert stats[4]["n_repeat_words"] == 100_000
    assert {r["doc_id"]: r["size"] for r in mixing.op3(df).collect()}[1] == 900_000


def test_packing(long_docs):
    texts, df = long_docs
    pieces = packing.pack_documents(df, with_ids=False).collect()
    for k in texts:
        mine = sorted((p for p in pieces if p["did"] == k), key=lambda p: p["start"])
        at = 0
        for p in mine:
            assert p["start"] == at
            at += p["length"]
        assert at == mine[0]["doc_tokens"]


def test_pieces_hold_every_window_once():
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcd") for _ in range(rng.choice([1, 3, 6, 40]))) for _ in range(3000)) + " " + "x" * 5000 + "  tail end"
    data = text.encode()
    batch = pa.RecordBatch.from_pydict({"text": [text, "short", "", text[:700]]})
    found = []
    for rows, piece, off, at in common.byte_pieces(iter([batch]), "text", 99, 1500):
        if rows.column("text")[0].as_py() == text:
            assert len(piece) <= 1599
            assert len(off) == 2
            found += [(at + i, piece[i : i + 100].tobytes()) for i in range(len(piece) - 99)]
    assert found == [(i, data[i : i + 100]) for i in range(len(data) - 99)]
    parts, found = data.split(), []
    for rows, piece, _, at in common.word_pieces(iter([batch]), "text", 49, 1500):
        if rows.column("text")[0].as_py() == text:
            own = piece.tobytes().split()
            found += [(at + i, own[i : i + 50]) for i in range(len(own) - 49)]
    assert found == [(i, parts[i : i + 50]) for i in range(len(parts) - 49)]
    assert sum(len(off) - 1 for _, _, off, _ in common.byte_pieces(iter([batch]), "text", 99, 10**6)) == 4


def test_counts_of_a_text_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = "\n".join(" ".join(rng.choice(["the", "É%", "x" * 300] if rng.random() < 0.1 else ["the", "É%"]) for _ in range(rng.randrange(9))) for _ in range(700))
    data = np.frombuffer(text.encode(), np.uint8)
    want = quality.text_stats(data, np.array([0, len(data)]))
    monkeypatch.setattr(quality, "SLICE_BYTES", 700)
    got = quality.text_stats(data, np.array([0, len(data)]))
    assert {k: v.tolist() for k, v in got.items()} == {k: v.tolist() for k, v in want.items()}
    assert got["n_repeat_words"][0] > 100
    assert got["n_dup_lines"][0] > 20


def test_memory_of_a_text_of_100_mb():
    """A scan of op1, op2 and op7 over one text of 100 MB: at most 13 bytes a byte of it, in a process of its own."""
    code = """
import re, sys
import numpy as np, pyarrow as pa
from lectern.llm import byte_dedup, quality, substring_dedup
used = lambda what: int(re.search(what + r":\\s+(\\d+) kB", open("/proc/self/status").read())[1])
rng = np.random.default_rng(1)
data = rng.integers(97, 123, 100_000_000, dtype=np.uint8)
data[rng.integers(0, len(data), len(data) // 6)] = 32
text = data.tobytes().decode()
batch = pa.RecordBatch.from_pydict({"did": [1], "tag": [0], "text": [text]})
del data, text
open("/proc/self/clear_refs", "w").write("5")  # the peak from here on: making the text took more
base = used("VmRSS")
if sys.argv[1] == "7":
    list(quality._scan(iter([batch.append_column("row", pa.array([1])).append_column("lang", pa.array(["en"]))])))
else:
    for _ in (substring_dedup if sys.argv[1] == "1" else byte_dedup)._anchors(iter([batch])):
        pass
print((used("VmHWM") - base) / 1e5)
"""
    for op, most in (("1", 4), ("2", 4), ("7", 13)):
        out = subprocess.run([sys.executable, "-c", code, op], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": ROOT})
        assert float(out.stdout) < most, (op, out.stdout)
