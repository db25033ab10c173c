import os
import random
import re

import pytest

from tidewake.llm import line_dedup
from tidewake.llm.line_dedup import GRAM_WORDS, PASSAGE_WORDS, drop_repeated_runs

DATA = "/root/testdata/sf0.01"
M = (1 << 64) - 1


# --- the same in plain Python, one value after another --------------------------------


def mixed(h):
    h = ((h ^ (h >> 32)) * 0xFF51AFD7ED558CCD) & M
    h = ((h ^ (h >> 29)) * 0xC4CEB9FE1A85EC53) & M
    return h ^ (h >> 32)


def summed(values):
    return mixed((sum((v + 1) * pow(0x9E3779B97F4A7C15, k & 0xFFFF, 1 << 64) for k, v in enumerate(values)) + len(values)) & M)


def rolled(values):
    h = 0
    for v in values:
        h = (h * 0x9E3779B97F4A7C15 + v) & M
    return mixed(h)


def minima(grams, w):
    """Places of least hashes; ``grams``: hash or None."""
    out, at = set(), 0
    while at < len(grams):
        if grams[at] is None:
            at += 1
            continue
        end = at
        while end < len(grams) and grams[end] is not None:
            end += 1
        for s in range(at, max(at + 1, end - w + 1)):
            window = range(s, min(s + w, end))
            out.add(min(window, key=lambda i: (grams[i], -i)))
        at = end
    return sorted(out)


def fingerprints(text):
    data = text.encode()
    words = [m.group() for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
    hashes = [summed(list(w)) for w in words]
    g = [rolled(hashes[i : i + 24]) for i in range(len(words) - 23)]
    out = [(g[i], i, 24, False) for i in minima(g, 27)]
    lines, at = [], 0
    for line in data.split(b"\n"):
        n = len(re.findall(rb"[^\x20\x09-\x0d]+", line))
        if n:
            lines.append((at, n))
        at += n
    lh = [summed(hashes[a : a + n]) for a, n in lines]
    g = [rolled(lh[i : i + 2]) if lines[i][1] + lines[i + 1][1] < 50 else None for i in range(len(lines) - 1)]
    out += [(~g[i] & M, lines[i][0], lines[i][1] + lines[i + 1][1], True) for i in minima(g, 2)]
    return words, [a for a, _ in lines] + [len(words)], out


def brute(rows):
    """Deleted words of each (id, text): later fingerprints make runs, and a run's ends are extended against their first occurrence."""
    docs = sorted({(i, t) for i, t in rows if i is not None and t is not None})
    known = {d: fingerprints(d[1]) for d in docs}
    first = {}
    for d in docs:
        for h, p, _, _ in sorted(known[d][2], key=lambda x: x[1]):
            first.setdefault(h, (d, p))
    gone = {}
    for d in docs:
        words, bounds, found = known[d]
        later = []
        for h, p, n, lines in found:
            d0, p0 = first[h]
            if d0 != d or p >= p0 + n:
                later.append((p, n, h - (1 << 64) * (h >> 63), lines, h))
        runs = []
        for x in sorted(later):
            if runs and x[0] <= max(p + n for p, n, *_ in runs[-1]):
                runs[-1].append(x)
            else:
                runs.append([x])
        for run in runs:
            p, n, _, lines, h = min(run)
            d0, p0 = first[h]
            low, floor, other = p, p0 + n if d0 == d else 0, known[d0][0]
            while low > max(floor, p - (50 if lines else 27)) and low - p + p0 > 0 and words[low - 1] == other[low - 1 - p + p0]:
                low -= 1
            if lines:
                low = min(b for b in bounds if b >= low)
            p, n, _, lines, h = max(run, key=lambda x: (x[0] + x[1], *x))
            d0, p0 = first[h]
            high, end, other = p + n, p + n + (50 if lines else 27), known[d0][0]
            while high < min(len(words), end) and high - p + p0 < len(other) and words[high] == other[high - p + p0]:
                high += 1
            if lines:
                high = max(b for b in bounds if b <= high)
            gone.setdefault(d, set()).update(range(low, high))
    return gone


def ranges(places):
    out = []
    for i in sorted(places):
        if out and out[-1][1] == i:
            out[-1][1] = i + 1
        else:
            out.append([i, i + 1])
    return [tuple(r) for r in out]


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS doc", "'w' AS tag", "'x' AS runs", "2 AS ld_other")
    got = drop_repeated_runs(docs).collect()
    assert len(got) == len(rows) and {(r.doc, r.tag, r.runs, r.ld_other) for r in got} <= {(1, "w", "x", 2)}
    return got


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


def corpus():
    r = random.Random(5)
    passages = [prose(100 + k, n, 5000) for k, n in enumerate((51, 55, 60, 90, 300))]
    boiler = ["cookie notice", "all rights reserved", "share  this", "back to top"]
    rows = [(1, "a b\nc d\ne f\ng h"), (2, "x\nc d\ne f\ng h\ny"), (3, "a b\nc d\ne f\ng h"), (4, None), (5, ""), (6, " \n\n "), (None, " ".join(passages[3]))]
    rows += [(7, "z\n" * 40), (8, "la " * 200), (9, "\n".join(boiler)), (9, "\n".join(boiler)), (9, "other text of the same id")]
    for i in range(10, 90):
        words = prose(i, r.randrange(0, 200), 5000)
        for p in r.sample(passages, r.randrange(0, 3)):
            a, b = r.randrange(0, 3), r.randrange(0, 3)
            at = r.randrange(0, len(words) + 1)
            words[at:at] = p[a : len(p) - b]
        text = ""
        for w in words:
            text += w + r.choice([" ", " ", " ", "  ", " ", ". ", "\n"])
        rows.append((i, text + "\n" * (i % 2) + "\n".join(boiler[: r.randrange(0, 5)])))
    rows += [(100 + k, rows[20 + k][1]) for k in range(10)]
    return rows


def test_matches_the_plain_version_and_its_promises(spark):
    rows = corpus()
    gone, got = brute(rows), run(spark, rows)
    assert sum(map(len, gone.values())) > 2000
    left = {}
    for r in got:
        matching = [t for i, t in rows if i == r.doc_id]
        if r.doc_id is None or None in matching:
            assert r.ld_deleted == [] and r.text in matching
            continue
        kept = lambda t: [w for k, w in enumerate(t.split()) if k not in gone.get((r.doc_id, t), ())]  # noqa: E731, B023
        t = next((t for t in matching if kept(t) == r.text.split()), None)
        assert t is not None, (r.doc_id, r.ld_deleted)
        lost = gone.get((r.doc_id, t), set())
        assert ranges(lost) == [tuple(x) for x in r.ld_deleted]
        assert lost or r.text == t
        left[r.doc_id, t] = (t.split(), lost)
    # no passage that occurred before is left whole, and nothing goes that did not occur before
    seen, grams = {}, set()
    for (i, t), (words, lost) in sorted(left.items()):
        for p in range(len(words) - PASSAGE_WORDS + 1):
            at = seen.setdefault(tuple(words[p : p + PASSAGE_WORDS]), (i, t, p))
            if at[:2] != (i, t):
                assert lost & set(range(p, p + PASSAGE_WORDS)), (i, p)
    for (i, t), (words, lost) in sorted(left.items()):
        own = [tuple(words[p : p + 4]) for p in range(len(words) - 3)]
        for a, b in ranges(lost):
            inside = {tuple(words[p : p + 4]) for p in range(a, b - 3)}
            assert inside <= grams | set(own)
        grams |= set(own)


def test_a_passage_in_the_middle_of_a_line_goes_whole(spark):
    passage = " ".join(prose(1, PASSAGE_WORDS, 10**6))
    rows = [(1, f"before {passage} after"), (2, f"quite other {passage} words"), (3, f"more\n{passage}\nends")]
    assert {r.doc_id: r.text for r in run(spark, rows)} == {1: rows[0][1], 2: "quite other words", 3: "more\nends"}


def test_a_run_of_three_lines_goes_and_single_lines_stay(spark):
    rows = [(1, "one\n\ntwo\nthree\nfour"), (2, "head\none\ntwo\nthree"), (3, "three\none\nhead"), (4, "two three")]
    got = {r.doc_id: r.text for r in run(spark, rows)}
    assert got == {1: rows[0][1], 2: "head", 3: rows[2][1], 4: rows[3][1]}


def test_very_long_texts_and_many_lines(spark):
    same, words = "a line\n" * 100_000, " ".join(prose(3, 200_000, 10**6))
    got = {r.doc_id: r for r in run(spark, [(1, same), (2, words), (3, words + " end")])}
    assert 3 <= len(got[1].text.split("\n")) <= 6 and got[1].ld_deleted[-1][1] == 200_000
    assert got[2].text == words and got[3].text == "end"


def test_equal_hashes_of_different_words_delete_nothing():
    run_of = {"s": 0, "last": 2, "first_n": 3, "last_n": 3, "own": b"a b x", "last_own": b"c d e", "left": b"", "right": b"", "floor": 0, "first_lines": False, "last_lines": False}
    assert line_dedup.extended("a b c d e f", [run_of]) == []
    assert line_dedup.extended("a b c d e f", [run_of | {"own": b"a b c"}]) == [(0, 5)]
    assert line_dedup.without("a b c  d e f", [(0, 5)]) == "f" and line_dedup.without(" a\nb c ", [(1, 3)]) == " a"


def test_empty_table(spark):
    assert drop_repeated_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test data")
def test_no_long_passage_of_the_documents_is_left_whole(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    before = {r.doc_id: (r.text or "").split() for r in docs.collect()}
    lost = {r.doc_id: {k for a, b in r.ld_deleted for k in range(a, b)} for r in drop_repeated_runs(docs).collect()}
    seen = {}
    for i, words in sorted(before.items()):
        for p in range(len(words) - PASSAGE_WORDS + 1):
            if seen.setdefault(tuple(words[p : p + PASSAGE_WORDS]), i) != i:
                assert not lost[i].isdisjoint(range(p, p + PASSAGE_WORDS)), (i, p)
    assert GRAM_WORDS < PASSAGE_WORDS
