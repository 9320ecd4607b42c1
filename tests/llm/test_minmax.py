"""Min-max hashing against brute force, and the work that template pages make."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import DOCS, brute_components, near_texts, odd_documents

from tideline.llm import minmax, neardup


def test_dedup_equals_brute_force(spark):
    rows = near_texts(31)
    got = {r["doc_id"]: r for r in minmax.dedup_table(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == brute_components(rows, minmax.LIKE)
    assert all(r["kept"] == (r["component_id"] == d) for d, r in got.items()) and not all(r["kept"] for r in got.values())


def test_minima_and_maxima_are_those_of_the_permuted_set():
    rng = np.random.default_rng(1)
    tokens = np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64))
    first, second = neardup.seeds(10)
    h = (tokens >> np.uint64(32)).astype(np.uint32) * first
    h ^= h >> np.uint32(15)
    h *= second
    least, most = minmax.signature(tokens, 10)
    assert (least == h.min(axis=1)).all() and (most == h.max(axis=1)).all()
    assert len(np.unique((np.arange(1 << 16, dtype=np.uint32) * first[0]))) == 1 << 16  # odd factors permute


@pytest.mark.parametrize("size", [5, 60, 3000])
def test_agreement_is_unbiased_and_varies_less_than_separate_minima(size):
    """Mean agreement is the similarity; minimum and maximum of one permutation vary together no more than two permutations do."""
    rng = np.random.default_rng(size)
    share, shifts, plain = [], [], []
    for _ in range(300):
        union = rng.integers(0, 2**64, size, dtype=np.uint64)
        a, b = np.sort(union[: -max(1, size // 5)]), np.sort(union)
        (la, ma), (lb, mb) = minmax.signature(a, 64), minmax.signature(b, 64)
        share.append(len(a) / len(b))
        shifts.append(((la == lb)[:32].sum() + (ma == mb)[:32].sum()) / 64)
        plain.append((la == lb).mean())
    assert abs(np.mean(shifts) - np.mean(share)) < 0.02
    assert np.var(shifts) < np.var(plain) * 1.25


def test_bands_miss_as_little_as_stated():
    n, like = minmax.bands(minmax.LIKE), minmax.LIKE
    assert n % 2 == 0 and (1 - 0.8**minmax.ROWS) ** n <= like.miss < (1 - 0.8**minmax.ROWS) ** (n - 2)
    tokens = np.arange(1, 400, dtype=np.uint64) << np.uint64(40)
    assert len(minmax.band_names(tokens, like)) == n and len(minmax.band_names(tokens[:0], like)) == 0


def test_odd_rows(spark):
    got = minmax.dedup_table(odd_documents(spark)).collect()
    assert len(got) == 10 and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert {r["doc_id"]: r["component_id"] for r in got}[6] == 5  # a long text and the same with one word more
    assert minmax.dedup_table(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("table", [neardup.join_table, minmax.dedup_table])
def test_rows_without_an_id_carry_links(spark, table):
    """The first and the last text link with that in the middle only, whose rows have no id."""
    base = [f"w{i}" for i in range(400)]
    changed = lambda k: " ".join(f"v{w}" if i < k else w for i, w in enumerate(base))
    step = 16 if table is neardup.join_table else 40
    rows = [(1, changed(0)), (2, changed(2 * step)), (None, changed(step)), (None, changed(step)), (9, "alone"), (None, None)]
    got = table(spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (0, 1), (0, 1), (1, 1), (2, 1), (9, 9)]


@pytest.mark.parametrize("share", [0.80, 0.85, 0.88])
def test_template_pages_make_linear_work(spark, monkeypatch, share):
    """Pages of one template whose own words are too many for a link: twice the pages, twice the questions to groups."""
    asked = []
    plain = neardup.open_groups
    monkeypatch.setattr(neardup, "open_groups", lambda members, asking, sets, like: asked.append(asking.count()) or plain(members, asking, sets, like))

    def work(pages):
        rng, asked[:] = random.Random(4), []
        template = [f"t{i}" for i in range(int(400 * share))]
        rows = [(i, " ".join(template + [f"own{rng.randrange(10**9)}" for _ in range(400 - len(template))])) for i in range(pages)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        assert neardup.join_table(docs).filter("doc_id <> component_id").count() == 0
        return sum(asked)

    few, many = work(500), work(1000)
    assert many <= 2.4 * max(few, 100), (few, many)
