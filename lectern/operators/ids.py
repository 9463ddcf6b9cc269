"""Stable ids of words: positions in the correct text, assigned per document by bounds and backtracking."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import ascii_text, tokens
from .match import spread

#: Guesses that one document's search may make before it is given up as unsolved.
MAX_GUESSES = 10_000


def word_positions(ref_lines: DataFrame) -> DataFrame:
    """(doc_name, word, gid): a running number over all single-space tokens of a text, empty ones included."""
    counted = ref_lines.withColumn("__n", F.size(tokens("line")))
    before = Window.partitionBy("doc_name").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    based = counted.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return based.select("doc_name", "__base", F.posexplode(tokens("line")).alias("__i", "word")).select("doc_name", "word", (F.col("__base") + F.col("__i")).cast("int").alias("gid"))


class Assignment:
    """Words in reading order, each of one or more snippets; candidates are ids of a snippet strictly between the bounds
    that the assigned words before and after it set."""

    def __init__(self, words: Sequence[str], index: dict[str, list[int]], fail_policy: str = "skip"):
        self.snippets = [w.split(" ") for w in words]
        self.index = index
        self.ids: list[list[int] | None] = [None] * len(words)
        self.failed = [False] * len(words)
        self.cascade = fail_policy == "cascade"

    def bounds(self, ids: list) -> tuple[list[int], list[float]]:
        """Greatest id before and least id after every word: two linear passes."""
        low, top = [-1] * len(ids), -1
        for i, x in enumerate(ids):
            low[i] = top
            if x:
                top = max(top, *x)
        return low, self.after(ids)

    def after(self, ids: list) -> list[float]:
        """Least id after every word."""
        high, end = [0.0] * len(ids), float("inf")
        for i in range(len(ids) - 1, -1, -1):
            high[i] = end
            if ids[i] and (self.cascade or -1 not in ids[i]):
                end = min(end, *ids[i])
        return high

    def candidates(self, snippet: str, low: int, high: float) -> list[int]:
        at = self.index.get(snippet, [])
        return at[bisect_right(at, low) : bisect_left(at, high)]

    def propagate(self, ids: list, strict: bool) -> bool:
        """Assign what has one candidate until nothing changes; False if `strict` and some word has none.

        A sweep goes from left to right: what it assigns bounds the words after it, so the greatest id so far is carried along and
        the least ids after each word hold for the whole sweep.
        """
        moved = True
        while moved:
            moved = False
            low, high = -1, self.after(ids)
            for i, parts in enumerate(self.snippets):
                if ids[i] is None:
                    for k, snippet in enumerate(parts):
                        at = self.index.get(snippet, ())
                        first = bisect_right(at, low)
                        n = bisect_left(at, high[i]) - first
                        if n == 1:
                            ids[i] = [at[first] - k + j for j in range(len(parts))]
                            self.failed[i] = False
                            moved = True
                            break
                        if n <= 0:
                            if strict:
                                return False
                            ids[i], self.failed[i] = [-1], True
                            moved = True
                if ids[i]:
                    low = max(low, *ids[i])
        return True

    def search(self) -> bool:
        """Guess the first open word's first snippet, ids ascending, propagate, step back at dead ends."""
        stack: list[tuple[list, int, list[int]]] = []
        ids = list(self.ids)
        guesses = 0
        alive = self.propagate(ids, strict=True)
        while True:
            if alive and None not in ids:
                self.ids = ids
                return True
            if alive:
                i = ids.index(None)
                low, high = self.bounds(ids)
                stack.append((list(ids), i, self.candidates(self.snippets[i][0], low[i], high[i])[::-1]))
            while stack and not stack[-1][2]:
                stack.pop()
            if not stack or guesses >= MAX_GUESSES:
                return False
            guesses += 1
            base, i, left = stack[-1]
            g = left.pop()
            ids = list(base)
            ids[i] = list(range(g, g + len(self.snippets[i])))
            alive = self.propagate(ids, strict=True)

    def solve(self) -> str:
        self.propagate(self.ids, strict=False)
        if None in self.ids and not self.search():
            return "unsolved"
        return "failed words" if any(self.failed) else "solved"


def assign_ids(words: DataFrame, positions: DataFrame, keys: Sequence[str], fail_policy: str = "skip") -> DataFrame:
    """(keys, reading_idx, text, global_ids, status) for words (keys, doc_name, reading_idx, text) with text in ASCII.

    A word without a candidate gets the id -1; with fail_policy "cascade" that id also bounds the words before it. A document that
    cannot be solved keeps what was found and says so. Each document is one group, which a frame bounds.
    """
    rows = words.select(*keys, "doc_name", "reading_idx", ascii_text("text").alias("text")).filter(F.trim("text") != "")
    needed = rows.select("*", F.explode(F.array_distinct(tokens("text"))).alias("word")).join(positions, ["doc_name", "word"])
    index = needed.groupBy(*keys, "word").agg(F.array_sort(F.collect_set("gid")).alias("gids")).groupBy(*keys).agg(F.collect_list(F.struct("word", "gids")).alias("index"))
    listed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("reading_idx", "text"))).alias("all"))

    @F.pandas_udf("struct<ids:array<array<int>>,status:string>")
    def solve(all_words: pd.Series, index: pd.Series) -> pd.DataFrame:
        out = []
        for ws, ix in zip(all_words, index, strict=True):
            job = Assignment([w["text"] for w in ws], {x["word"]: [int(g) for g in x["gids"]] for x in (ix if ix is not None else ())}, fail_policy)
            status = job.solve()
            out.append(([x or [] for x in job.ids], status))
        return pd.DataFrame(out, columns=["ids", "status"])

    solved = spread(listed.join(index, list(keys), "left"), *keys).withColumn("s", solve("all", "index"))
    words_of = solved.select(*keys, F.col("s.status").alias("status"), F.explode(F.arrays_zip(F.col("all").alias("w"), F.col("s.ids").alias("g"))).alias("x"))
    return words_of.select(*keys, F.col("x.w.reading_idx").alias("reading_idx"), F.col("x.w.text").alias("text"), F.col("x.g").alias("global_ids"), "status")
