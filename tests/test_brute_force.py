"""Matching, repair and ids of whole tables against plain Python, which works word by word and keeps nothing."""

import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from statistics import median

import pandas as pd
import pytest

from lectern.plans import driver

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts():
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    lines = {d: (t or "").split("\n") for d, t in zip(docs["doc_id"].tolist(), docs["text"], strict=True)}
    corpus = {i: (t or "").replace(". ", ".\n").split("\n") for i, t in zip(items["item_id"].tolist(), items["text"], strict=True)}
    return lines, corpus


def ascii_of(text):
    return re.sub(r"[^\x00-\x7F]", "", text)


def distance(consumed, target, edge, fold=str):
    """The full matrix of the alignment, in hundredths."""
    a, b = fold(consumed), fold(target)
    cell = [[j * edge for j in range(len(b) + 1)]]
    for i in range(1, len(a) + 1):
        cell.append([cell[i - 1][0] + 100])
        for j in range(1, len(b) + 1):
            step = cell[i - 1][j - 1] if a[i - 1] == b[j - 1] else min(cell[i - 1][j - 1] + 100, cell[i - 1][j] + 100)
            cell[i].append(min(step, cell[i][j - 1] + 100))
    return min(cell[-1][j] + (len(b) - j) * edge for j in range(len(b) + 1))


def line_distance(seen, ref):
    seen = ascii_of(seen)
    return distance(seen, ref, 1) / 100 / len(seen) if seen.strip() else 1.0


@pytest.fixture(scope="module")
def matches(texts):
    """(doc, line): updated line, whether anchored, line of the text, distance; and the text of each document."""
    lines, corpus = texts
    known, unique = defaultdict(set), {}
    for name, refs in corpus.items():
        count = Counter(w for line in refs for w in line.split(" "))
        unique[name] = {w: i for i, line in enumerate(refs) for w in line.split(" ") if count[w] == 1}
        for w in count:
            known[w].add(name)
    out, best = {}, {}
    for d, own in lines.items():
        score = Counter()
        for w in (ascii_of(w) for line in own for w in line.split(" ")):
            if len(w) >= 2:
                for name in known.get(w, ()):
                    score[name] += len(w)
        if not score:
            continue
        name = best[d] = min(score, key=lambda n: (-score[n], n))
        refs = corpus[name]
        anchored = {}
        for i, line in enumerate(own):
            hits = [unique[name][w] for w in line.split(" ") if w in unique[name]]
            if len(hits) >= 2 and len(set(hits)) == 1:
                anchored[i] = hits[0]
        if not anchored:
            continue
        found = {i: (line_distance(own[i], refs[r]), r, True) for i, r in anchored.items()}
        for i in range(len(own)):
            if i in anchored:
                continue
            after, before = min((k for k in anchored if k > i), default=None), max((k for k in anchored if k < i), default=None)
            lo = anchored[after] - (after - i) if after is not None else anchored[before] + 1
            hi = anchored[after] - 1 if after is not None else anchored[before] + (i - before)
            near = min(((line_distance(own[i], refs[r]), r) for r in range(max(lo, 0), min(hi, len(refs) - 1) + 1)), default=None)
            if near is not None and near[0] < 0.6:
                found[i] = (*near, False)
        for r in {f[1] for f in found.values()}:
            same = sorted((f[0], i) for i, f in found.items() if f[1] == r)
            for _, i in same[1:]:
                del found[i]
        for i in range(len(own)):
            x = found.get(i)
            out[d, i] = (refs[x[1]], x[2], x[1], x[0]) if x else ("", False, None, None)
    return out, best


def test_line_matches(spark, matches):
    got = {(r["doc_id"], r["line_idx"]): (r["updated_line"], r["in_first_step"], r["ref_idx"], r["dist"]) for r in driver.QUERIES["fuzzy_line_matches"](spark, SF).collect()}
    want, _ = matches
    assert got.keys() == want.keys()
    for k, w in want.items():
        assert got[k][:3] == w[:3], k
        assert got[k][3] == (pytest.approx(w[3], abs=1e-12) if w[3] is not None else None), k
    assert sum(bool(w[0]) and not w[1] for w in want.values()) > 20


def boxes(line):
    at, out = 0, []
    for j, w in enumerate(line.split(" ")):
        left = at * 8 + j % 3
        out.append((w, float(left), float(left + 8 * len(w))))
        at += len(w) + 1
    return out


def climb(pairing, correct, cost):
    """One climb over lists, looking at every box each time."""
    n = len(pairing)

    def pull(box, lower):
        order = range(box - 1, -1, -1) if lower else range(box + 1, n)
        donor = next((i for i in order if pairing[i]), None)
        if donor is None:
            used = [w for p in pairing for w in p]
            word = (min(used) - 1 if used else len(correct) - 1) if lower else (max(used) + 1 if used else 0)
            return (cost(box, []) - cost(box, [word]), word, None) if 0 <= word < len(correct) else (0, None, None)
        given = pairing[donor]
        word = given[-1] if lower else given[0]
        return cost(box, []) + cost(donor, given) - cost(box, [word]) - cost(donor, given[1:]), word, donor

    for _ in range(20):
        moved = False
        for box in range(n - 1, -1, -1):
            own = pairing[box]
            if own:
                options = []
                for a in range(len(own) + 1):
                    for b in range(a, len(own) + 1):
                        price = cost(box, own[a:b]) + (cost(box - 1, pairing[box - 1] + own[:a]) if box else 0) + (cost(box + 1, own[b:] + pairing[box + 1]) if box + 1 < n else 0)
                        options.append((price, (a, b) != (0, len(own)), a, b))
                _, other, a, b = min(options)
                if not other:
                    continue
                if box:
                    pairing[box - 1] = pairing[box - 1] + own[:a]
                if box + 1 < n:
                    pairing[box + 1] = own[b:] + pairing[box + 1]
                pairing[box] = own[a:b]
                moved = True
                continue
            up, word, donor = pull(box, False)
            word, donor = (word, donor) if up > 0 else (None, None)
            low, low_word, low_donor = pull(box, True)
            if low > 0 and low > up:
                word, donor = low_word, low_donor
            if word is None:
                continue
            pairing[box] = [word]
            if donor is not None:
                pairing[donor] = pairing[donor][1:] if donor > box else pairing[donor][:-1]
            moved = True
        if not moved:
            break
    return pairing


def repaired_line(seen, correct, widths, space, scale):
    """(texts of the boxes, shift of the start)."""
    n, known = len(seen), {}

    def cost(box, chosen):
        key = (box, tuple(chosen))
        if key not in known:
            word, text = ascii_of(seen[box][0]), " ".join(correct[i] for i in chosen)
            known[key] = distance(text, word, 80, str.lower) if text.strip() else len(word) * 80
        return known[key]

    at, start, box = 0.0, [[] for _ in range(n)], 0
    for word, text in enumerate(correct):
        size = sum(widths.get(c, space) for c in text)
        a, b = int(at * scale), int((at + size) * scale)
        at += size + space
        while box < n and a >= seen[box][2]:
            box += 1
        if box == n:
            break
        if box + 1 < n and b > seen[box][2] and b - seen[box + 1][1] > seen[box][2] - a:
            box += 1
        start[box].append(word)
    results = []
    for k, by in enumerate((0, -6, -4, -2, 2, 4, 6)):
        moved = climb([list(start[i - by]) if 0 <= i - by < n else [] for i in range(n)], correct, cost)
        results.append((sum(cost(i, p) for i, p in enumerate(moved)), k, by, moved))
    _, _, by, best = min(results, key=lambda r: r[:2])
    return [" ".join(correct[i] for i in p) for p in best], by


@pytest.fixture(scope="module")
def repaired(texts, matches):
    lines, _ = texts
    found, _ = matches
    out = {}
    for d in {d for d, _ in found}:
        own = lines[d]
        height = [12 + len(t) % 9 for t in own]
        usual = [abs(h - median(height)) <= 0.1 * median(height) for h in height]
        gaps = [b[1] - a[2] for t, u in zip(own, usual, strict=True) if u for a, b in zip(boxes(t), boxes(t)[1:], strict=False)]
        space = median(gaps) if gaps else 5.0
        widths = {}
        for i, t in enumerate(own):
            once = Counter(found[d, i][0].split(" "))
            for w, left, right in boxes(t) if usual[i] else ():
                expected = sum(widths.get(c, space) for c in w)
                if once[w] != 1 or expected <= 0:
                    continue
                ratio = (right - left) / expected
                for c in w:
                    widths[c] = widths.get(c, space) * ratio
        for i, t in enumerate(own):
            correct = found[d, i][0].split(" ") if found[d, i][0] else []
            scale = 1.0 if usual[i] or not median(height) else height[i] / median(height)
            fixed, by = repaired_line(boxes(t), correct, widths, space, scale) if correct else ([""] * len(boxes(t)), 0)
            for j, (b, text) in enumerate(zip(boxes(t), fixed, strict=True)):
                out[d, i, j] = (b[0], text, by)
    return out


def test_repaired_words(spark, repaired):
    got = {(r["doc_id"], r["line_idx"], r["word_idx"]): (r["ocr_text"], r["text"], r["pair_offset"]) for r in driver.QUERIES["repaired_words"](spark, SF).collect()}
    assert got == repaired
    assert sum(a != b and b != "" for a, b, _ in repaired.values()) > 50


def assigned(words, index):
    """(ids, status): bounds looked up anew for every word."""
    parts = [w.split(" ") for w in words]

    def options(ids, i, snippet):
        low = max((g for x in ids[:i] if x for g in x), default=-1)
        high = min((g for x in ids[i + 1 :] if x and -1 not in x for g in x), default=float("inf"))
        at = index.get(snippet, [])
        return at[bisect_right(at, low) : bisect_left(at, high)]

    failed = set()

    def spread(ids, strict):
        moved = True
        while moved:
            moved = False
            for i, own in enumerate(parts):
                if ids[i] is not None:
                    continue
                base = list(ids)
                for k, snippet in enumerate(own):
                    at = options(base, i, snippet)
                    if len(at) == 1:
                        ids[i] = [at[0] - k + j for j in range(len(own))]
                        failed.discard(i)
                        moved = True
                        break
                    if not at:
                        if strict:
                            return False
                        ids[i] = [-1]
                        failed.add(i)
                        moved = True
        return True

    def guess(ids, left):
        if not spread(ids, True):
            return None
        if None not in ids:
            return ids
        i = ids.index(None)
        for g in options(ids, i, parts[i][0]):
            if not left[0]:
                return None
            left[0] -= 1
            trial = list(ids)
            trial[i] = list(range(g, g + len(parts[i])))
            if done := guess(trial, left):
                return done
        return None

    ids = [None] * len(words)
    spread(ids, False)
    if None in ids:
        done = guess(list(ids), [10_000])
        if done is None:
            return [x or [] for x in ids], "unsolved"
        ids = done
    return ids, "failed words" if failed else "solved"


def test_global_ids(spark, texts, matches, repaired):
    _, corpus = texts
    _, best = matches
    positions = {}
    for name, refs in corpus.items():
        index = positions[name] = defaultdict(list)
        for g, w in enumerate(w for line in refs for w in line.split(" ")):
            index[w].append(g)
    placed = defaultdict(list)
    for (d, i, j), (_, text, _) in repaired.items():
        if text:
            placed[d].append((i, j, text))
    lines, _ = texts
    want = {}
    for d, words in placed.items():
        # lines stand at least sixteen pixels apart, so each is a line of its own; within it words go by their centres
        ordered = sorted(words, key=lambda w: (w[0], sum(boxes(lines[d][w[0]])[w[1]][1:]), w[1]))
        kept = [(k, ascii_of(t)) for k, (_, _, t) in enumerate(ordered) if ascii_of(t).strip(" ")]
        found, status = assigned([t for _, t in kept], positions[best[d]])
        want.update({(d, k): (t, x, status) for (k, t), x in zip(kept, found, strict=True)})
    got = {(r["doc_id"], r["reading_idx"]): (r["text"], r["global_ids"], r["status"]) for r in driver.QUERIES["global_ids"](spark, SF).collect()}
    assert got == want
    assert {s for _, _, s in want.values()} >= {"solved"}
