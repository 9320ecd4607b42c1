"""Runs by partition refinement against a brute-force version."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import periods


def brute(words, least_words=6, least_periods=4):
    found = {}
    n = len(words)
    for q in range(n // least_periods, 0, -1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least_words, least_periods * q):
                found[(i, j - i + q)] = q  # a smaller period of the same stretch comes later
            i = j
    return sorted((s, m, q) for (s, m), q in found.items())


def texts(seed, count=300):
    rng, out = random.Random(seed), []
    for _ in range(count):
        words = [rng.choice("abcdefgh"[: rng.choice([1, 2, 2, 3, 8])]) for _ in range(rng.choice([0, 1, 3, 7, 20, 60, 150]))]
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            words[at:at] = (words[at : at + rng.randint(1, 9)] or ["z"]) * rng.randint(2, 7)
        out.append([w.encode() for w in words])
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rows = texts(seed)
    assert periods.runs(rows) == [brute(w) for w in rows]


def test_runs_of_two_periods_equal_brute_force():
    rows = texts(50)
    assert periods.runs(rows, 2, 2) == [brute(w, 2, 2) for w in rows]


def test_words_that_do_not_fit_one_number_are_sorted_by_columns():
    rng = np.random.default_rng(3)
    keys = tuple(rng.integers(0, 50, 400) for _ in range(3))
    assert all((a == b).all() for a, b in zip(periods.in_order(keys, 50), periods.in_order(keys, 1 << 22), strict=True))


def test_long_texts():
    rng = random.Random(8)
    plain = [str(rng.randrange(3000)).encode() for _ in range(30_000)]
    tail = plain[:5000] * 4
    once = [b"la"] * 20_000
    found = periods.runs([plain, plain + tail + tail[:17], once])
    assert found[0] == [] and found[2] == [(0, 20_000, 1)]
    assert (30_000, 20_017, 5000) in found[1]


def digest(rows):
    out = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n = len(words)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        gone = {i for s, m, q in found for i in range(s + q, s + m)}
        best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        out.append((doc_id, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{q}\n" for s, m, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone))))
    return sorted(out, key=str)


def test_digest_of_rows(spark):
    """Nulls, empty and long texts, repeated rows, columns of clashing names."""
    rng = random.Random(1)
    rows = [(i, " ".join(w.decode() for w in t)) for i, t in enumerate(texts(9, 150))]
    rows += [(None, "no id " * 9), (None, None), (900, None), (901, ""), (902, " \t\n"), (903, "ü " * 40), (903, "ü " * 40)]
    rows += [(d, " ".join(rng.choice("abc") * 3 for _ in range(2000))) for d in range(1000, 1012)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("runs", "start", "collapsed", "period")})
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(r[c] for c in names) for r in periods.runs_digest(docs).collect()), key=str) == digest(rows)
    assert periods.runs_digest(docs.limit(0)).count() == 0


def test_collapsed_text_keeps_one_period(spark):
    row = periods.runs_table(spark.createDataFrame([(1, "a b " + "c d e " * 5 + "f")], "doc_id long, text string")).first()
    assert row["collapsed"] == "a b c d e f" and [tuple(r) for r in row["runs"]] == [(2, 15, 3)]
