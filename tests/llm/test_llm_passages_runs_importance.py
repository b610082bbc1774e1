"""Repeated passages, periodic runs and importance resampling against brute force; nulls, ties, repeats, empty tables, clashing names."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weftline.llm import importance, runs, substrings

SCHEMA = "doc_id long, text string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def split(text):
    return [w for w in SPACE.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd(spark):
    """Null, empty, blank, long and repeated texts, null and repeated keys, extra columns with internal names."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, long), (5, "a few words"), (6, "a few words"), (6, "a few words"), (None, long), (None, None), (7, "x " * 80), (7, "x  " * 80), (8, "é" * 200_000), (9, "é" * 200_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("_key", "_text", "id", "t", "h", "start", "score", "rank", "weight"):
        df = df.withColumn(c, F.lit("clash"))
    return rows, df


# repeated passages


def kept_by_brute(rows):
    """Words left of each row: those that no window of 50 covers that also starts in a row of a lesser key."""
    first = {}
    for k, t in rows:
        w = split(t)
        for i in range(len(w) - 49):
            x = tuple(w[i : i + 50])
            if k is not None:
                first[x] = min(k, first.get(x, k))
    out = []
    for k, t in rows:
        w = split(t)
        gone = set()
        for i in range(len(w) - 49):
            if k is not None and first[tuple(w[i : i + 50])] < k:
                gone.update(range(i, i + 50))
        out.append((k, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def made_documents(seed, n=90):
    """Copies with changed, left out and moved words, shared passages in different surroundings, periodic texts, small vocabularies, repeated keys."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(r.choice([2, 40, 4000]))] + ["L" * 70]
    text = lambda n: [r.choice(words) for _ in range(n)]
    passages = [text(r.randint(45, 160)) for _ in range(4)]
    rows = []
    for _ in range(n):
        kind = r.randrange(6)
        if kind == 0 or not rows:
            w = text(r.randint(0, 400))
        elif kind == 1:
            w = text(r.randint(0, 60)) + r.choice(passages) + text(r.randint(0, 60)) + r.choice(passages)[: r.randint(0, 160)]
        elif kind == 2:
            w = list(split(r.choice(rows)[1]))
            for _ in range(r.randint(0, 3)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
        elif kind == 3:
            a, b = split(r.choice(rows)[1]), split(r.choice(rows)[1])
            w = a[r.randint(0, 60) :] + b[: r.randint(0, 300)]
        elif kind == 4:
            p = r.randint(1, 70)
            unit = text(p)
            w = [unit[i % p] for i in range(r.randint(0, 400))]
        else:
            w = split(r.choice(rows)[1])
        rows.append((r.choice([None, *range(n)]) if r.random() < 0.2 else r.randrange(10_000), r.choice([" ", "\n", " \t"]).join(w)))
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_passages_equal_brute_force(spark, seed):
    rows = made_documents(seed)
    got = substrings.remove_passages(spark.createDataFrame(rows, SCHEMA).repartition(3)).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(kept_by_brute(rows))


def test_passages_at_the_edges(spark):
    rows, df = odd(spark)
    got = substrings.remove_passages(df)
    assert Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect())) == Counter(kept_by_brute(rows))
    assert substrings.remove_passages(df.limit(0)).count() == 0


def test_kept_text_is_given(spark):
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(1, common), (2, f"before {common} after"), (3, common)]
    got = {r["doc_id"]: (r["n_removed"], r["kept"]) for r in substrings.remove_passages(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: (0, None), 2: (60, "before after"), 3: (60, "")}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_factors_find_all_windows_of_the_blocks(seed):
    r = random.Random(seed)
    words = [b"w%d" % i for i in range(r.choice([1, 2, 3, 50, 1000]))]
    text = lambda n: [r.choice(words) for _ in range(n)]
    base = text(r.randint(60, 300))
    blocks = []
    for _ in range(r.randint(1, 4)):
        b = list(base) if r.random() < 0.5 else text(r.randint(10, 200))
        for _ in range(r.randint(0, 4)):
            b[r.randrange(len(b))] = r.choice(words)
        a = r.randrange(len(b))
        blocks.append(b[a : a + r.randint(50, 250)])
    t = text(r.randint(0, 30)) + base + base[: r.randint(0, 100)]
    for _ in range(r.randint(0, 5)):
        t[r.randrange(len(t))] = r.choice(words)
    held = {tuple(b[i : i + 50]) for b in blocks for i in range(len(b) - 49)}
    n = len(t) - 49
    assert substrings.windows_in(substrings.Reference(t, blocks).passages(), n).tolist() == [tuple(t[i : i + 50]) in held for i in range(n)]


def test_every_window_has_its_anchor():
    r = np.random.default_rng(1)
    for n in (49, 50, 51, 300):
        g = substrings.groups(r.integers(0, 3, n).astype(np.uint64))
        a = substrings.anchors(g)
        assert a.tolist() == [g[i : i + 41].min() for i in range(max(0, n - 49))]
        found, place, again = substrings.first_anchors(g)
        assert found.tolist() == sorted(set(a.tolist())) and (g[place] == found).all()
        assert again.tolist() == [any(x == f and not i <= p <= i + 40 for i, x in enumerate(a)) for f, p in zip(found, place, strict=True)]


def test_a_repetitive_text_takes_no_square_time():
    t = [b"a", b"b", b"c"] * 20_000
    assert substrings.windows_in(substrings.Reference(t, [t[5:]]).passages(), len(t) - 49).all()


def test_blocks_that_follow_one_another_are_joined():
    w = [b"%d" % i for i in range(900)]
    cut = lambda b: w[max(0, 128 * b - 40) : 128 * (b + 1) + 50]
    assert substrings.joined([(7, 2, cut(2)), (7, 1, cut(1)), (7, 1, cut(1)), (7, 5, cut(5)), (8, 6, cut(6))]) == [(7, 88, w[88:434]), (7, 600, cut(5)), (8, 728, cut(6))]
    assert substrings.joined([(7, 0, cut(0)), (7, 1, cut(1)), (7, 6, cut(6))]) == [(7, 0, w[:306]), (7, 728, cut(6))]


# periodic runs


def runs_by_brute(s, least, power):
    best = {}
    for q in range(1, len(s) // power + 1):
        i = 0
        while i + q < len(s):
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            if j - i + q >= max(least, power * q):
                best[i, j - i + q] = min(q, best.get((i, j - i + q), q))
            i = max(j, i + 1)
    return sorted(((i, n, q) for (i, n), q in best.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**6))
def test_runs_equal_brute_force(seed):
    r = random.Random(seed)
    s = [r.randrange(r.choice([1, 2, 3, 4])) for _ in range(r.randint(0, 70))]
    if s and r.random() < 0.5:
        a, p = r.randrange(len(s)), r.randint(1, 12)
        s = [x if i < a else s[min(a + (i - a) % p, len(s) - 1)] for i, x in enumerate(s)]
    for least, power in ((2, 2), (3, 3), (6, 4)):
        assert runs.runs(s, least, power) == runs_by_brute(s, least, power)
    assert runs.word_runs([b"%d" % x for x in s]) == runs_by_brute(s, 6, 4)


def test_factors_are_the_longest_that_start_before():
    r = random.Random(3)
    for _ in range(50):
        s = [r.randrange(3) for _ in range(40)]
        at = 0
        for start, size, earlier in runs.factors(s):
            longest = max((k for k in range(1, len(s) - start + 1) if any(s[g : g + k] == s[start : start + k] for g in range(start))), default=0)
            assert start == at and size == max(longest, 1) and (earlier < start and s[earlier : earlier + size] == s[start : start + size] if longest else earlier == -1)
            at += size
        assert at == len(s)


def expected_runs(key, text, planted):
    w = split(text)
    if planted and key is not None and w:
        h = zlib.crc32(str(key).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found = runs_by_brute(w, 6, 4)
    top = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return (key, len(found), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None, sha("".join(f"{a},{n},{q}\n" for a, n, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_run_query_and_edges(spark):
    r = random.Random(9)
    rows = [(k, " ".join(r.choice("a b c d".split()) for _ in range(r.randint(0, 90)))) for k in range(300)]
    columns = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = runs.find(spark.createDataFrame(rows, SCHEMA), plant=runs.planted).select(columns).collect()
    assert Counter(map(tuple, got)) == Counter(expected_runs(k, t, True) for k, t in rows)
    rows, df = odd(spark)
    few = [(k, t) for k, t in rows if len(split(t)) < 1000]
    got = runs.find(df.where("size(split(text, ' ')) < 1000 or text is null"), plant=runs.planted).select(columns).collect()
    assert Counter(map(tuple, got)) == Counter(expected_runs(k, t, True) for k, t in few)
    assert runs.find(df.limit(0)).count() == 0


def test_a_long_periodic_text(spark):
    text = " ".join(["one two three"] * 30_000)
    got = runs.find(spark.createDataFrame([(1, text)], SCHEMA)).first()
    assert (got["n_runs"], got["start"], got["length"], got["period"], got["collapsed"]) == (1, 0, 90_000, 3, "one two three")


# importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def feature_buckets(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10_000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def expected_draw(rows, target, percent=5, least=20):
    have = [feature_buckets(t) for _, t in rows]
    s, t = Counter(b for _, f in have for b in f), Counter(b for x in target for b in feature_buckets(x)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000))))
    out = []
    for (k, _), (n, f) in zip(rows, have, strict=True):
        weight = sum(gain(b) for b in f)
        h = None if k is None else int(sha(f"42:{k}")[:8], 16)
        out.append([k, n, len(f), weight, None if k is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((-x[4], x[0], i) for i, x in enumerate(out) if x[1] >= least and x[4] is not None)
    rank = {i: r + 1 for r, (_, _, i) in enumerate(fit[: percent * len(fit) // 100])}
    return [(x[0], x[2], x[3], x[4], rank.get(i)) for i, x in enumerate(out)]


def got_draw(df):
    return Counter(map(tuple, df.select("doc_id", "n_features", "weight", "score", "rank").collect()))


def test_draw_equals_brute_force(spark):
    r = random.Random(4)
    words = [*"alpha Beta GAMMA délta ß 数 x9".split(), "w" * 60, "Z" * 47, "y" * 48]
    rows = [(k, r.choice([" ", "-", "\x00", "__"]).join(r.choice(words) for _ in range(r.randint(0, 60)))) for k in range(400)]
    target = [" ".join(r.choice(words[:4]) for _ in range(50)) for _ in range(20)] + [None]
    df = spark.createDataFrame(rows, SCHEMA)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for percent in (5, 37, 100, 0):
        assert got_draw(importance.resample(df, aim, percent)) == Counter(expected_draw(rows, target, percent))


def test_draw_at_the_edges(spark):
    rows, df = odd(spark)
    aim = spark.createDataFrame([("w1 w2 w3",)], "text string")
    got = got_draw(importance.resample(df, aim, 50).select("doc_id", "n_features", "weight", "score", "rank"))
    want = Counter(expected_draw(rows, ["w1 w2 w3"], 50))
    drop_rank = lambda c: Counter(x[:4] for x in c.elements())
    assert drop_rank(got) == drop_rank(want)
    assert sorted(x[4] for x in got.elements() if x[4]) == sorted(x[4] for x in want.elements() if x[4])
    assert importance.resample(df.limit(0), aim).count() == 0
    assert drop_rank(got_draw(importance.resample(df, aim.limit(0)))) == drop_rank(Counter(expected_draw(rows, [])))


def test_ranks_settle_ties_by_key(spark):
    rows = spark.createDataFrame([(k, s) for s in (5, 3, 3, 9) for k in range(s * 100, s * 100 + 50)], "doc_id long, score long")
    got = importance.highest(rows, 70).where("rank is not null").orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 71))
    assert [(r["score"], r["doc_id"]) for r in got] == [(9, 900 + i) for i in range(50)] + [(5, 500 + i) for i in range(20)]


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=20), st.binary(max_size=importance.SHORT))
def test_checksums_are_appended(a, b):
    one = lambda x: np.array([x], dtype=np.uint32)
    assert importance.append(one(zlib.crc32(a)), one(zlib.crc32(b)), np.array([len(b)]))[0] == zlib.crc32(a + b)
