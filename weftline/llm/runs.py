"""Periodic runs of words in a text, by the method of Kolpakov and Kucherov.

A run is a stretch whose words repeat with a smallest period and that no neighbouring word extends.
Only stretches all of whose word triples occur three times or more can hold a run of LEAST words and
POWER periods; each is factored by a suffix automaton into longest pieces that started before. Runs
that cross or touch a factor's ends are found by Main's extensions to both sides of each boundary (four
arrays of common prefixes); those inside a factor are copied from its earlier occurrence.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import slices, table

#: A run has at least so many words, and so many times its period.
LEAST, POWER = 6, 4


def common_prefixes(s: list[int]) -> list[int]:
    """For each place, how long the text from there on agrees with the text's beginning (at place 0: its length)."""
    n = len(s)
    out = [n] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, out[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        out[i] = k
        if i + k > right:
            left, right = i, i + k
    return out


def suffix_automaton(s: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """Transitions of each state, and the place where its strings end first."""
    steps, link, length, ends = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(s):
        new = len(steps)
        steps.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append(i)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                ends.append(ends[q])
                link[q] = link[new] = twin
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
        last = new
    return steps, ends


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """``start, length, earlier start`` of the longest factors that also start earlier, overlaps allowed; -1 for a new word."""
    steps, ends = suffix_automaton(s)
    out, i = [], 0
    while i < len(s):
        state, k = 0, 0
        while i + k < len(s) and ends[to := steps[state][s[i + k]]] < i + k:
            state, k = to, k + 1
        out.append((i, k, ends[state] - k + 1) if k else (i, 1, -1))
        i += max(k, 1)
    return out


def crossing(s: list[int], low: int, at: int, high: int) -> Iterator[tuple[int, int, int]]:
    """``start, end, period`` of repeats in s[low:high] that cross or touch ``at``, extended to both sides within it (Main)."""
    t, u = s[low:at], s[at:high]
    a, b, back = len(t), len(u), t[::-1]
    ahead = common_prefixes(u)
    before = common_prefixes([*back, -1, *u[::-1], *back])[a + 1 :]
    behind = common_prefixes(back)
    after = common_prefixes([*u, -1, *t, *u])[b + 1 :]
    for q in range(1, b + 1):  # a whole period lies to the right
        left, right = min(before[b - q], a) if a else 0, ahead[q] if q < b else 0
        if left + right >= q:
            yield at - left, at + q + right, q
    for q in range(1, a + 1):  # a whole period lies to the left
        left, right = behind[q] if q < a else 0, min(after[a - q], b) if b else 0
        if left + right >= q:
            yield at - q - left, at + right, q


def runs(s: list[int], least: int = LEAST, power: int = POWER) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of at least ``least`` symbols (0 and up) and ``power`` (2 or more) periods, by start and period."""
    n, parts = len(s), factors(s)
    found: dict[tuple[int, int], int] = {}
    starting: dict[int, dict[int, int]] = defaultdict(dict)  # start: end: period

    def add(start: int, end: int, q: int) -> None:
        if end - start >= max(least, power * q) and q < found.get((start, end), n):
            found[start, end] = q
            starting[start][end] = q

    before = 0
    for at, size, earlier in [*parts, (n, 0, -1)]:
        # a run whose last boundary is this one reaches so far back at most
        for start, end, q in crossing(s, max(0, at - 2 * before - size), at, at + size):
            if (start == 0 or s[start - 1] != s[start - 1 + q]) and (end == n or s[end] != s[end - q]):
                add(start, end, q)
        if earlier >= 0:
            move = at - earlier
            for x in range(earlier + 1, earlier + size - 1):
                for end, q in list(starting[x].items()) if x in starting else ():
                    if end < earlier + size:
                        add(x + move, end + move, q)
        before = size
    return sorted(((start, end - start, q) for (start, end), q in found.items()), key=lambda r: (r[0], r[2]))


def stretches(w: np.ndarray) -> list[tuple[int, int]]:
    """Ends of the stretches of 6 words or more all of whose triples occur at least three times in ``w``."""
    if len(w) < LEAST:
        return []
    wide = np.int64(w.max()) + 1
    pairs = np.unique(w[:-1] * wide + w[1:], return_inverse=True)[1]
    _, which, n = np.unique(pairs[:-1] * wide + w[2:], return_inverse=True, return_counts=True)
    edge = np.diff(np.concatenate([[0], (n[which] >= 3).astype(np.int8), [0]]))
    return [(a, b + 2) for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True) if b + 2 - a >= LEAST]


def word_runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """``start, length, period`` of all runs of LEAST words and POWER periods, by start and period.

    In such a run each triple of words occurs three times or more, so a run lies in one stretch.
    """
    ids: dict[bytes, int] = {}
    w = np.array([ids.setdefault(x, len(ids)) for x in words], dtype=np.int64)
    return sorted(((a + i, k, q) for a, b in stretches(w) for i, k, q in runs(w[a:b].tolist())), key=lambda r: (r[0], r[2]))


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    keep = np.ones(len(words), dtype=bool)
    for start, length, q in found:
        keep[start + q : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length by period; of equal ones the first, then that of the least period."""
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


#: A function of a row's key and number of words: the words from place a on repeat those of [a, a + p); None leaves them.
Plant = Callable[[object, int], tuple[int, int] | None]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", plant: Plant | None = None) -> DataFrame:
    """``key, n_runs, start, length, period, exponent_milli, runs, collapsed, runs_sha256, collapsed_sha256`` of each row.

    ``runs`` is a line ``start,length,period`` for each run of the whole text, ``collapsed`` its words
    without those that only repeat, joined by one space. The next four are of the strongest run, null
    where there is none. Null and empty texts have no words and no runs. Repeated rows and null keys
    are rows like any other; other columns are not read; an empty table stays empty. A text of any
    length is treated whole in linear time, with about 0.5 kB for each word of a periodic stretch.
    """
    kind = dict(docs.dtypes)[key]
    names = ["_key", "n_runs", "start", "length", "period", "exponent_milli", "runs", "collapsed", "runs_sha256", "collapsed_sha256"]
    types = [pa.int64()] * 5 + [pa.string()] * 4

    def one(k: object, t: str | None) -> tuple:
        words = (t or "").encode("utf-8", "replace").split()  # at ASCII white space
        planted = plant(k, len(words)) if plant and words else None
        if planted:
            a, p = planted
            words = [*words[:a], *(words[a + (i - a) % p] for i in range(a, len(words)))]
        found = word_runs(words)
        best = strongest(found)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        kept = b" ".join(collapse(words, found) if found else words)
        return (len(found), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None, lines, kept.decode(), hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            rows = [one(k.as_py(), t.as_py()) for k, t in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=names)

    source = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))
    schema = f"_key {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs string, collapsed string, runs_sha256 string, collapsed_sha256 string"
    return source.mapInArrow(run, schema).withColumnRenamed("_key", key)


def planted(key: object, n: int) -> tuple[int, int] | None:
    """The contract's periodic tails: in a tenth of the keys, from a place and with a period that the key's CRC-32 gives."""
    if key is None:
        return None
    h = zlib.crc32(str(key).encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the whole texts of all documents, with the contract's planted tails (``find``, ``planted``); a null doc_id has no tail."""
    out = find(table(spark, sf_dir, "documents", "doc_id", "text"), plant=planted)
    return out.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


#: The same rows by pairs of equal word triples at each distance. CRC-32 is its step table, applied to each digit.
OP12_SQL = r"""
WITH step AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT unnest(range(256)) AS n))),
split AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: unicode(x)::BIGINT)), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS h
  FROM documents, step),
place AS (SELECT doc_id, w, len(w) AS n, h, h // 10 AS g FROM split),
tail AS (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS planted, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM place),
texts AS (
  SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END) ELSE w END AS w FROM tail),
triples AS (SELECT doc_id, n, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS x FROM (SELECT doc_id, n, w, unnest(range(n - 2)) AS i FROM texts)),
same AS (SELECT l.doc_id, l.n, l.i, r.i - l.i AS q FROM triples l JOIN triples r ON l.doc_id = r.doc_id AND l.x = r.x AND r.i > l.i AND r.i - l.i <= l.n // 4),
joined AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS s FROM same),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM joined GROUP BY doc_id, q, s),
run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY 1, 2, 3),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
per AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM run GROUP BY 1),
cut AS (SELECT doc_id, list(i) AS i FROM gone GROUP BY 1),
rated AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length // period DESC, (length % period)::DOUBLE / period DESC, start, period) AS r FROM run)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(CASE WHEN n_runs > 0 THEN array_to_string(list_filter(w, lambda x, k: NOT list_contains(cut.i, k - 1)), ' ') ELSE array_to_string(w, ' ') END) AS collapsed_sha256
FROM texts LEFT JOIN per USING (doc_id) LEFT JOIN cut USING (doc_id) LEFT JOIN (SELECT * FROM rated WHERE r = 1) USING (doc_id)
"""
