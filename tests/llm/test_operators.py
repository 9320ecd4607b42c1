"""Brute-force versions, exact round trips and edge cases of the ten operators."""

import hashlib
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.llm import bpe, components, language, licenses, mixing, neardup, nearest, quality, queries, sharding, urlfilter, warc

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words_of(text):
    return (text or "").encode().split()


def odd_documents(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and a clashing extra column."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    rows = [(1, "the cat sat on the mat " * 3, "en", "a", 1), (1, "the cat sat on the mat " * 3, "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (4, " \t\n ", "fr", "b", 3), (None, "no id here at all", "en", "b", 4), (5, long, "en", None, 5), (6, long + " tail", "en", "c", 6), (7, "1234 ** ##", None, "c", 7), (8, "x", "de", "c", 8)]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("clash")).withColumn("node", F.lit("clash")).withColumn("target", F.lit("clash"))


# --- 1 near duplicates


def brute_components(rows, like):
    sets = []
    for doc_id, text in rows:
        w = [x.lower() for x in words_of(text)]
        sets.append((doc_id, {tuple(w[i : i + like.words]) for i in range(len(w) - like.words + 1)} or ({tuple(w)} if w else set())))
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, s) in enumerate(sets):
        for e, t in sets[:i]:
            if s and t and like.den * len(s & t) >= like.num * len(s | t):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets}


def near_texts(seed, n=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 5, 12, 40, 120, 700, 1500]))] for _ in range(25)]
    out = []
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, max(1, len(w) // rng.choice([20, 40, 60, 200])))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if i % 7 == 0:
            w += passage
        out.append((i, " ".join(w)))
    return out


@pytest.mark.parametrize("like", [neardup.Likeness(), neardup.Likeness(5, 80, 100), neardup.Likeness(5, 80, 100, exact=True)])
def test_jaccard_join_equals_brute_force(spark, like):
    rows = near_texts(like.words)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.join_table(spark.createDataFrame(rows, "doc_id long, text string"), like).collect()}
    assert got == brute_components(rows, like)


def test_chain_within_large_groups(spark):
    """Neighbours of a chain link while its ends do not; the chain is longer than a group."""
    base = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(400):
        rows.append((i, " ".join(base)))
        base[i] = f"v{i}"
    like = neardup.Likeness(1, 90, 100)
    got = {r["doc_id"]: r["component_id"] for r in neardup.join_table(spark.createDataFrame(rows, "doc_id long, text string"), like).collect()}
    assert got == {d: c for d, (_, c) in brute_components(rows, like).items()} and set(got.values()) == {0}


def names_of(cuts):
    return np.concatenate([names for _, names in cuts]) if cuts else np.zeros(0, np.uint64)


def linked_sets(rng, like, n):
    """A set of n elements with sets that lose, gain or exchange as many elements as the threshold allows."""
    a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
    gained = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for lost, won in ((1, 0), (0, 1), (1, 1)):
        k = 0
        while like.link(n, n + (won - lost) * (k + 1), n - lost * (k + 1)):
            k += 1
        b = np.unique(np.concatenate([rng.permutation(a)[lost * k :], gained[: won * k]]))
        if not np.array_equal(a, b):
            yield a, b


LIKES = [neardup.Likeness(), neardup.Likeness(5, 80, 100)]


def test_rarest_blocks_meet_for_every_link():
    """Whatever the order of rarity: each set shows spare + len(names) of its names, the ones that only it has first."""
    rng = np.random.default_rng(2)
    some = 0
    for like in LIKES:
        for n in (9, 10, 11, 19, 23, 57, 120, 260, 500, 3000):
            for _ in range(20):
                for a, b in linked_sets(rng, like, n):
                    x, y = neardup.cut(a, like), neardup.cut(b, like)
                    both = np.intersect1d(names_of(x), names_of(y))
                    order = {int(h): i for i, h in enumerate(rng.permutation(both))}
                    show = []
                    for cuts in (x, y):
                        shown = set()
                        for spare, names in cuts:
                            held = sorted((int(h) for h in names if int(h) in order), key=order.get)
                            shown |= set(held[: max(0, spare + len(held))])
                            some = max(some, len(names) - len(held))
                        show.append(shown)
                    assert show[0] & show[1]
    assert some > 20


def test_hints_meet_for_every_link():
    rng = np.random.default_rng(3)
    for like in LIKES:
        for n in (9, 23, 120, 800):
            shares = []
            for _ in range(40):
                for a, b in linked_sets(rng, like, n):
                    shares.append(np.mean(neardup.hints(a, like) == neardup.hints(b, like)))
            rows, _ = neardup.minima(like)
            assert min(shares) > 0 and np.mean(shares) > 0.8 * (like.num / like.den) ** rows


def test_a_passage_in_thousands_of_texts_links_none_of_them(spark):
    """One passage in 3000 different texts, and near copies of a tenth of these: pairs are not formed, links are found."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(3000):
        w = [f"w{rng.randrange(3000)}" for _ in range(70)]
        rows.append((2 * i, " ".join(w) + " " + passage))
        if i % 10 == 0:
            w[35] = "other"
            rows.append((2 * i + 1, passage + " " + " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.join_table(spark.createDataFrame(rows, "doc_id long, text string"), neardup.Likeness(5, 80, 100)).collect()}
    assert got == {i: i - i % 2 for i, _ in rows}


def test_clashing_names_stay(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "k1", "r1", "n1"), (2, text, "k2", "r2", "n2")], "doc_id long, text string, key string, row string, node string")
    assert [tuple(r) for r in neardup.keep_one(docs).collect()] == [(1, text, "k1", "r1", "n1")]


def test_jaccard_join_edge_cases(spark):
    got = neardup.join_table(odd_documents(spark)).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert len(got) == 10 and by[2] == [(0, 2)] and by[3] == [(0, 3)] and by[4] == [(0, 4)] and by[None][0][1] is None and by[6][0][1] == 5 and by[1] == [by[1][0]] * 2
    assert neardup.join_table(spark.createDataFrame([], DOCS)).count() == 0
    kept = neardup.keep_one(odd_documents(spark)).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == [1, 2, 3, 4, 5, 7, 8] and len(kept) == 8


def test_rows_that_share_an_id_are_kept_by_their_text(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (1, b), (3, c), (7, c + " more"), (7, d), (None, d + " more"), (None, "x " + c), (None, "lonely text of its own"), (None, "lonely text of its own"), (9, b), (9, b), (10, ""), (10, "")]
    kept = neardup.keep_one(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r["doc_id"], r["text"]) for r in kept), key=key) == sorted([(1, a), (1, b), (3, c), (7, d), (None, "lonely text of its own"), (10, ""), (10, "")], key=key)


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for p in links for x in p}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    assert got == {x: find(x) for p in links if p[0] != p[1] for x in p}


# --- 2 language


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language.language_table(docs).withColumnRenamed("doc_id", "id").join(docs, F.col("id") == F.col("doc_id"))
    right, n = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.9, right


def test_language_edge_cases(spark):
    got = language.language_table(odd_documents(spark)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (2, 3, 4, 7)) and by[1]["lang_pred"] in ("en", "fr", "de")
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language.language_table(spark.createDataFrame([], DOCS)).count() == 0


def test_language_equals_exact_gram_sets(spark):
    """Brute force over strings: the same grams in plain sets, without hashing and Bloom filters, give the same languages."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    train = language.training_rows(docs).collect()

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")
        return [g for w in words if w for p in [f" {w} "] for n in (3, 4) for i in range(len(p) - n + 1) for g in [p[i : i + n]] if " " not in g[1:-1]]

    counts = {}
    for r in train:
        for g in grams(r["text"]):
            counts.setdefault(g, {}).setdefault(r["lang"], 0)
            counts[g][r["lang"]] += 1
    totals = {}
    for by in counts.values():
        for l, n in by.items():
            totals[l] = totals.get(l, 0) + n
    sets = {l: set() for l in totals}
    for g, by in counts.items():
        shares = {l: n / totals[l] for l, n in by.items()}
        if sum(by.values()) >= 3:
            for l, share in shares.items():
                if share >= 0.34 * max(shares.values()):
                    sets[l].add(g)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.language_table(docs).collect()}
    near = 0
    for r in docs.collect():
        found = grams(r["text"] or "")
        if found:
            exact = {l: sum(g in s for g in found) / len(found) for l, s in sets.items()}
            best = max(exact.values())
            assert abs(got[r["doc_id"]][1] - best) < 0.02 and exact[got[r["doc_id"]][0]] > best - 0.02
            near += 1
        else:
            assert got[r["doc_id"]] == ("und", 0)
    assert near > 100


def test_every_language_can_be_predicted(spark):
    """More languages than a word has bits, and one of few texts beside one with a long tail of words."""
    rng = random.Random(7)
    word = lambda l: "".join(chr(0x4E00 + 60 * l + rng.randrange(60)) for _ in range(4))
    vocabulary = [[word(l) for _ in range(8)] for l in range(70)]
    rows = [(100 * l + i, " ".join(rng.choices(vocabulary[l], k=20)), f"l{l}", "s", 0) for l in range(70) for i in range(5)]
    long = [word(80) for _ in range(600)]
    rows += [(20_000 + i, " ".join(long), "long", "s", 0) for i in range(30)]
    docs = spark.createDataFrame(rows, DOCS)
    filters = language.learn(docs, 2000, 500)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict(docs, filters).collect()}
    assert len(filters.languages) == 71 and all(got[r[0]][0] == r[2] and got[r[0]][1] > 0.1 for r in rows)


def test_a_dirty_language_column_is_not_learned(spark):
    rows = [(i, "the cat sat on the mat" if i % 2 else "le chat est dans la maison", "en" if i % 2 else "fr", "s", 0) for i in range(400)]
    docs = spark.createDataFrame(rows + [(1000 + i, f"junk {i}", f"x{i}", "s", 0) for i in range(500)], DOCS)
    filters = language.learn(docs, least_share=0.01)
    assert set(filters.languages) == {"en", "fr"} and len(language.learn(docs, least_share=0.0).languages) == 502
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, filters).collect()}
    assert all(got[r[0]] == r[2] for r in rows)


def test_probe_returns_all_languages_of_a_gram():
    slots = np.zeros(1 << language.SLOT_BITS, np.uint8)
    h = np.array([12345678901234567890], np.uint64)
    for k in range(language.PROBES):
        slots[(h >> np.uint64(language.SLOT_BITS * k)) & np.uint64((1 << language.SLOT_BITS) - 1)] |= 5
    assert language.probe(slots, h)[0] == 5


# --- 3 URL filters


def test_url_filter_follows_intervals(spark):
    entries = spark.createDataFrame([("l", "domain", "b.org", "add", 10), ("l", "domain", "b.org", "remove", 20), ("l", "path", "x.com/a/", "add", 5), ("l", "host", None, "add", 5), ("m", "domain", "b.org", "add", 15)], "list string, kind string, key string, action string, effective long")
    pages = [(1, "http://www.b.org/x", 9), (2, "http://www.b.org/x", 10), (3, "HTTP://u:p@B.org:80", 19), (4, "http://b.org/", 20), (5, "http://ab.org/", 12), (6, "http://x.com/a/b/c?q#f", 6), (7, "http://x.com/ab", 6), (8, None, 6), (9, "nonsense", 6), (10, "http://b.org/", None), (2, "http://www.b.org/x", 10)]
    got = urlfilter.evaluate(spark.createDataFrame(pages, "page_id long, url string, fetched_at long").withColumn("list", F.lit("clash")), entries).collect()
    n = {r["page_id"]: (r["n_active"], r["blocked"], r["entry"]) for r in got}
    assert len(got) == 11 and n == {1: (0, False, None), 2: (1, True, "b.org"), 3: (2, True, "b.org"), 4: (1, True, "b.org"), 5: (0, False, None), 6: (1, True, "x.com/a/"), 7: (0, False, None), 8: (0, False, None), 9: (0, False, None), 10: (0, False, None)}
    assert urlfilter.evaluate(spark.createDataFrame([], "page_id long, url string, fetched_at long"), entries).count() == 0


def test_url_filter_takes_long_urls_empty_lists_and_equal_keys(spark):
    long = "http://" + ".".join(["a"] * 60) + ".b.org/" + "/".join(["d"] * 20_000)
    pages = spark.createDataFrame([(1, long, 5), (2, "http://c.b.org", 5)], "page_id long, url string, fetched_at long")
    none = spark.createDataFrame([], "list string, kind string, key string, action string, effective long")
    assert [(r["n_active"], r["blocked"]) for r in urlfilter.evaluate(pages, none).collect()] == [(0, False)] * 2
    entries = spark.createDataFrame([("l", "domain", "b.org", "add", 1), ("m", "domain", "b.org", "add", 1), ("l", "path", long[7:].split("/")[0] + "/d/d/", "add", 1)], none.schema)
    got = {r["page_id"]: (r["n_active"], r["list"], r["kind"]) for r in urlfilter.evaluate(pages, entries).collect()}
    assert got == {1: (3, "l", "path"), 2: (2, "l", "domain")}


def test_a_generated_list_equals_brute_force(spark):
    """Some 6000 dated entries of all kinds against captures at many times, by a walk over every entry that a URL can match."""
    rng = random.Random(5)
    word = lambda: rng.choice("abcdef") + rng.choice("xyz")
    entries = []
    for _ in range(6000):
        kind, host = rng.choice(("domain", "host", "path")), ".".join(word() for _ in range(rng.choice((1, 2, 3)))) + ".org"
        key = host + "/" + "".join(word() + "/" for _ in range(rng.choice((1, 2)))) if kind == "path" else host
        entries.append((rng.choice("lmn"), kind, key, rng.choice(("add", "add", "remove")), rng.randrange(100)))
    pages = [(i, f"http://{'.'.join(word() for _ in range(rng.choice((1, 2, 3))))}.org/{word()}/{word()}/p?q", rng.randrange(-5, 110)) for i in range(1500)]
    by = {}
    for name, kind, key, action, at in entries:
        by.setdefault((kind, key), {}).setdefault(name, []).append((at, action == "add"))
    want = {}
    for i, url, at in pages:
        host, *folders = url[7:].split("/")[:-1]
        labels = host.split(".")
        keys = [("host", host), *(("domain", ".".join(labels[k:])) for k in range(len(labels))), *(("path", "/".join([host, *folders[:k]]) + "/") for k in range(1, len(folders) + 1))]
        active = []
        for kind, key in keys:
            for name, dated in by.get((kind, key), {}).items():
                past = [(t, listed) for t, listed in dated if t <= at]
                if past and min(past, key=lambda x: (-x[0], x[1]))[1]:
                    active.append((-len(key), kind, name, key))
        want[i] = (len(active), min(active)[1:] if active else (None, None, None))
    table = spark.createDataFrame(entries, "list string, kind string, key string, action string, effective long")
    got = urlfilter.evaluate(spark.createDataFrame(pages, "page_id long, url string, fetched_at long"), table).collect()
    assert {r["page_id"]: (r["n_active"], (r["kind"], r["list"], r["entry"])) for r in got} == want and sum(n > 1 for n, _ in want.values()) > 50


# --- 4 mixing


def test_mix_targets_and_reruns(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix_table(docs).collect()
    sizes, sources = {r["doc_id"]: r["size"] for r in got}, {r["doc_id"]: r["source"] for r in docs.collect()}
    total = sum(sizes.values())
    by = {}
    for r in got:
        assert r["taken"] in (0, r["size"], 2 * r["size"]) and r["target"] <= 2 * r["source_size"] + 1e-3
        by.setdefault(sources[r["doc_id"]], []).append(r)
    assert abs(sum(v[0]["target"] for v in by.values()) - 1.5 * total) < 1
    for v in by.values():
        p = v[0]["target"] / v[0]["source_size"] % 1
        sigma = (sum(r["size"] ** 2 for r in v) * p * (1 - p)) ** 0.5
        assert abs(sum(r["taken"] for r in v) - v[0]["target"]) <= 4 * sigma + 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix_table(docs.repartition(7)).collect()))


def test_mix_edge_cases(spark):
    got = mixing.mix_table(odd_documents(spark)).collect()
    assert len(got) == 10 and all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix_table(spark.createDataFrame([], DOCS)).count() == 0
    mixed = mixing.mix_documents(odd_documents(spark))
    taken = sum(r["taken"] for r in got)
    assert mixed.columns == odd_documents(spark).columns and sum(len(words_of(r["text"])) for r in mixed.collect()) == taken


def test_rows_without_an_id_draw_by_their_texts(spark):
    rows = [(None, f"w{i} " * 10, "en", "a", 0) for i in range(600)] + [(i, "x " * 10, "en", "b", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    by = {r["size"]: r for r in mixing.mix_table(docs).groupBy(F.round("target").alias("size")).agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()}
    assert all(abs(r["taken"] - r["size"]) < 0.1 * r["size"] for r in by.values()) and sum(r["n"] for r in by.values()) == 1200


def test_repeated_rows_meet_their_target(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PIECE", 64)
    docs = spark.createDataFrame([(1, "a b c d", "one")] * 400 + [(None, "x y", None)] * 300 + [(i, "w " * (i % 9), "two") for i in range(2000)], "doc_id long, text string, source string")
    got = mixing.mix_table(docs)
    by = {r["source_size"]: r for r in got.groupBy("source_size").agg(F.max("target").alias("target"), F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()}
    assert {size: r["n"] for size, r in by.items()} == {1600: 400, 600: 300, docs.filter("source = 'two'").selectExpr("sum(size(filter(split(text, ' '), x -> x <> '')))").first()[0]: 2000}
    assert all(abs(r["taken"] - r["target"]) <= 0.1 * r["target"] for r in by.values())
    assert sorted(map(str, got.collect())) == sorted(map(str, mixing.mix_table(docs.repartition(7)).collect()))


def test_mix_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", 7, 8, "x")], "doc_id long, text string, source string, copies long, rate long, row string")
    assert {tuple(r) for r in mixing.mix_documents(docs).collect()} == {(1, "a b c", "s", 7, 8, "x")}


# --- 5 WARC


def test_warc_round_trip_and_edge_cases(spark):
    rows = [(3, "http://a", "<p>é</p>"), (1, "http://b", "<p>é</p>"), (2, None, None), (7, "http://c\r\nX: y", ""), (4, "http://d", "x\r\n\r\nWARC/1.1\r\n"), (1, "http://b", "<p>é</p>"), (None, "http://e", "z"), (9, "http://f", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("header", F.lit("clash"))
    path = warc.write_archive(pages)
    got = warc.read_archive(spark, path, bodies=True).collect()
    assert sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got) == sorted([("3", "revisit", 1), ("1", "response", None), ("1", "revisit", 1), ("2", "response", None), ("7", "revisit", 2), ("4", "response", None), ("None", "revisit", 9), ("9", "response", None)])
    stream = warc.parse_stream(b"".join(r["record"] for r in got))
    payloads = {r[0]: (r[2] or "").encode() for r in rows}
    assert len(stream) == len(rows)
    for r, (fields, block) in zip(got, stream, strict=True):
        body = payloads[r["page_id"]]
        assert r["payload_digest"] == warc.digest_of(body) and r["payload"] == body and r["payload_bytes"] == len(body) and block == (body if r["record_type"] == "response" else b"")
        assert fields["WARC-Payload-Digest"] == "sha1:" + r["payload_digest"]
    assert spark.read.parquet(path + "/payloads").count() == 4
    assert all(r["record_type"] == "response" for r in warc.read_archive(spark, warc.write_archive(pages.filter("page_id < 8"), least_bytes=100)).filter("page_id <> 1").collect())
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).count() == 0


def test_records_keep_their_own_url_and_repetitions(spark, monkeypatch):
    monkeypatch.setattr(warc, "RUN", 3)
    big = "x" * 3_000_000
    rows = [(1, "http://a", "p"), (1, "http://b", "p"), (1, None, "p"), (2, "http://a", "p"), (5, "http://z", big), (6, "http://z", big)] + [(7, "http://c", "q")] * 8
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.write_archive(pages)
    got = warc.read_archive(spark, path, bodies="records").collect()
    fields = [(warc.parse_stream(r["record"])[0], r) for r in got]
    assert sorted((r["page_id"], f["WARC-Target-URI"]) for (f, _), r in fields) == sorted((i, u or "") for i, u, _ in rows)
    assert len({f["WARC-Record-ID"] for (f, _), _ in fields}) == len(rows)
    responses = {f["WARC-Record-ID"]: (f["WARC-Target-URI"], r["payload"]) for (f, _), r in fields if r["record_type"] == "response"}
    assert sorted(u for u, _ in responses.values()) == ["http://a", "http://c", "http://z"]
    assert all(responses[f["WARC-Refers-To"]][1].decode() == {i: h for i, _, h in rows}[r["page_id"]] and r["payload"] is None for (f, _), r in fields if r["record_type"] == "revisit")
    told = sorted(map(tuple, warc.rebuilt(warc.read_archive(spark, path, bodies="records")).collect()))
    assert told == sorted(map(tuple, warc.read_archive(spark, path).collect()))
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    read = warc.read_archive(other, path, bodies="records")
    assert sorted(map(tuple, warc.rebuilt(read).collect())) == told and not [t for t in spark.catalog.listTables() if t.name.startswith("warc_")]
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan, plan


def test_a_very_long_payload_comes_back(spark):
    long = "é<p>" * 8_000_000
    path = warc.write_archive(spark.createDataFrame([(2, "u", long), (1, "v", "a"), (3, "w", long)], "page_id long, url string, html string"))
    got = {r["page_id"]: tuple(r)[1:] for r in warc.rebuilt(warc.read_archive(spark, path, bodies="records")).collect()}
    size, digest = len(long.encode()), warc.digest_of(long.encode())
    assert got == {1: (1, warc.digest_of(b"a"), "response", None), 2: (size, digest, "response", None), 3: (size, digest, "revisit", 2)}


def test_damaged_archive_fails(spark):
    path = warc.write_archive(spark.createDataFrame([(1, "u", "one")], "page_id long, url string, html string"))
    spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(), b"two")], "sha256 string, payload binary").write.mode("overwrite").parquet(path + "/payloads")
    with pytest.raises(Exception, match="damaged payload"):
        warc.read_archive(spark, path).collect()


# --- 6 BPE


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    own, theirs = bpe.Codec(open(queries.TOKENIZER, "rb").read()), Tokenizer.from_file(queries.TOKENIZER)
    rng = random.Random(6)
    texts = ["", " ", "a  b\n\n c", "<|endoftext|>x<|endoftext|>", "don't WE'LL  'tis", "日本語テキスト🙂é\x00\x7f", "aaaa" * 50, " 　x", "١٢٣ ²³"]
    texts += ["".join(rng.choice("abcdeé ñ'\n0189.,;-_🙂ж") for _ in range(rng.randint(1, 120))) for _ in range(400)]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for t in texts:
        want = theirs.encode(t, add_special_tokens=False).ids
        got = own.encode(t)
        assert got == struct.pack(f"<{len(want)}I", *want), t
        assert own.decode(got).decode() == theirs.decode(want, skip_special_tokens=False) == t


def test_bpe_long_words_and_a_full_memory(monkeypatch):
    """Words far longer than any token, and a memory that turns over within one text."""
    from tokenizers import Tokenizer

    own, theirs = bpe.Codec(open(queries.TOKENIZER, "rb").read()), Tokenizer.from_file(queries.TOKENIZER)
    monkeypatch.setattr(bpe, "MOST_WORDS", 3)
    rng = random.Random(7)
    runs = ["".join(rng.choice(letters) for _ in range(5000)) for letters in ("abcdefghinorst", "a", " ", "=", "日本語éöабв")]
    for t in [*runs, "x".join(runs), " ".join(f"w{i % 7} {i}" for i in range(500))]:
        want = theirs.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == struct.pack(f"<{len(want)}I", *want)
        assert len(own.memory) <= 3 and len(own.older) <= 3
    assert all(token.startswith(start) and start in own.ids for token, start in own.shorter.items())


def test_bpe_edge_cases(spark):
    got = bpe.encode_table(odd_documents(spark), queries.TOKENIZER, ids=True).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 10 and by[2]["n_tokens"] == by[3]["n_tokens"] == 0 and by[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and by[5]["n_tokens"] == len(by[5]["ids"])
    assert bpe.encode_table(spark.createDataFrame([], DOCS), queries.TOKENIZER).count() == 0


# --- 7 licenses


def test_license_rules_are_ordered(spark):
    table = {"one sentence": "a", "two sentence": "b", "three sentence": "c", "other": "x"}
    rules = [("AB", ("a", "b")), ("ABC", ("a", "b", "c")), ("X", ("x",))]
    texts = [(1, "One sentence.\nunknown text here\nTWO sentence!"), (2, "Two sentence. One sentence."), (3, None), (4, ""), (5, "Other"), (5, "Other"), (6, "word " * 50_000 + "\none sentence. other. other. two sentence. Three sentence"), (7, "one sentence. other. other. other. two sentence"), (None, "nothing")]
    got = {r["doc_id"]: (r["n_known"], r["licenses"]) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_known", F.lit(1)).withColumn("run", F.lit(1)), table=table, rules=rules).collect()}
    assert got == {1: (2, ["AB"]), 2: (2, []), 3: (0, []), 4: (0, []), 5: (1, ["X"]), 6: (5, ["AB", "ABC", "X"]), 7: (5, ["X"]), None: (0, [])}
    assert licenses.scan(spark.createDataFrame([], DOCS)).count() == 0


def test_whole_license_texts_are_recognised_however_they_are_wrapped(spark):
    import textwrap

    from tideline.llm.license_texts import NOTICES, TEXTS

    def wrapped(text, mark, width):
        return "\n".join(mark + line for p in text.strip().split("\n\n") for line in [*textwrap.wrap(p, width, break_on_hyphens=False, break_long_words=False), ""])

    rows, want = [], {}
    for n, (name, text) in enumerate(TEXTS.items()):
        for k, (mark, width) in enumerate((("", 79), ("# ", 60), (" * ", 72), ("", 5000))):
            rows.append((10 * n + k, f"{mark}Copyright (c) 2020 Someone\n{mark}\n" + wrapped(text, mark, width) + "\ncode = 1"))
            want[10 * n + k] = name
    for n, name in enumerate(NOTICES):
        rows.append((1000 + n, f"some words\n{NOTICES[name][0]}\nmore words"))
        want[1000 + n] = name
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not {i: (name, got[i]) for i, name in want.items() if name not in got[i]}


MIT_TEXT = """MIT License

Copyright (c) 2020 Someone
Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
APACHE_HEADER = """# Copyright 2020 Someone
#
# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
#
# Unless required by applicable law or agreed to in writing, software
"""
GPL_NOTICE = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.
"""


def test_wrapped_licenses_are_recognised(spark):
    crlf = lambda x: x.replace("\n", "\r\n")
    texts = [(1, MIT_TEXT), (2, APACHE_HEADER), (3, GPL_NOTICE), (4, crlf(MIT_TEXT)), (5, crlf(APACHE_HEADER)), (7, "Released under the MIT.\nLicense"), (8, "Released under\nthe MIT License"), (9, "Not released under\nthe MIT License today")]
    got = {r["doc_id"]: (r["n_known"], r["licenses"]) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    mit, apache = (2, ["MIT-text"]), (3, ["Apache-2.0", "Apache-2.0-header"])
    assert got == {1: mit, 2: apache, 3: (3, ["GPL-3.0-or-later"]), 4: mit, 5: apache, 7: (0, []), 8: (1, ["MIT"]), 9: (0, [])}


BSD = """Copyright (c) 2020 Someone, Inc. All rights reserved.

Redistribution and use in source and binary forms, with or without modification,
are permitted provided that the following conditions are met:

 * Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

 * Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
{more}
THIS SOFTWARE IS PROVIDED BY {who} "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL {who} BE LIABLE FOR
ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES
(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON
ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
HOLDERS = """
 * Neither the name Someone, nor Another, nor the names of its contributors may
   be used to endorse or promote products derived from this software without
   specific prior written permission.
"""
ADVERTISING = """
3. All advertising materials mentioning features or use of this software
   must display the following acknowledgement: This product includes software
   developed by Someone and its contributors.
"""


def test_holders_stand_in_slots_and_marks_give_way(spark):
    """The same texts by the operator and by SQL that cuts the sentences itself."""
    import duckdb

    from tideline.llm import oracle

    everyone = "Everyone is permitted to copy and distribute verbatim copies\nof this license document, but changing it is not allowed.\n"
    texts = [
        (1, BSD.format(who="THE COPYRIGHT HOLDERS AND CONTRIBUTORS", more="")), (2, BSD.format(who="Someone", more=HOLDERS)),
        (3, BSD.format(who="THE REGENTS AND CONTRIBUTORS", more=ADVERTISING + HOLDERS)), (4, BSD.format(who="word " * 13, more="")),
        (5, "News of today.\n\nCopyright 2020 Someone. All rights reserved.\n"), (6, "All rights reserved.\n" + MIT_TEXT), (7, None), (8, ""),
        (9, "   GNU GENERAL PUBLIC LICENSE\n     Version 2, June 1991\n\n Copyright (C) 1989\n " + everyone), (10, everyone),
        (11, "      Apache License\n   Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\n TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n 1. Definitions.\n"),
        (12, MIT_TEXT.split("subject")[0].rstrip(" \n,") + ".\n"), (13, "x " * 50_000 + "\nCC0 1.0 Universal\n"), (13, "x " * 50_000 + "\nCC0 1.0 Universal\n"),
        (14, "developed by\nAll advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by"),
    ]
    want = {1: "BSD-2-Clause", 2: "BSD-3-Clause", 3: "BSD-4-Clause", 4: "All-rights-reserved", 5: "All-rights-reserved", 6: "MIT-text", 7: "", 8: "", 9: "GPL-2.0", 10: "", 11: "Apache-2.0", 12: "MIT-0", 13: "CC0-1.0", 14: ""}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = [tuple(r) for r in licenses.scan(docs).select("doc_id", "n_known", F.array_join("licenses", ",")).collect()]
    assert {i: names for i, _, names in got} == want
    with duckdb.connect() as con:
        con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
        con.executemany("INSERT INTO documents VALUES (?, ?)", texts)
        assert sorted(con.execute(oracle.licenses_sql()).fetchall()) == sorted(got)


def test_license_table_of_any_size(spark):
    """A table of 20,000 sentences costs no more regular expressions than a small one."""
    table = {f"this is the known sentence of license number {i}": f"n{i}" for i in range(20_000)}
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('Some text.\nThis is the known sentence of\nlicense number ', id * 40, '.\nmore') AS text")
    got = {r["doc_id"]: r["licenses"] for r in licenses.scan(docs, table=table, rules=[("even", ("n80",))]).collect()}
    assert got == {i: (["even"] if i == 2 else []) for i in range(500)}


# --- 8 nearest neighbours


def test_nearest_recall_and_exact_scores(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    v = {r["vec_id"]: np.array(r["embedding"], float) for r in rows}
    ids = np.array(sorted(v))
    table = np.stack([v[i] for i in ids])
    got = {}
    for r in nearest.search(spark.createDataFrame(rows), shortlist=48, block_rows=512).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((table - v[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        found = sorted(got[q])
        assert [x[0] for x in found] == list(range(1, 11))
        assert all(abs(s - np.sqrt(((v[i] - v[q]) ** 2).sum())) < 1e-12 for _, i, s in found)
        hits += len({ids[i] for i in order} & {x[1] for x in found})
    assert hits >= 0.95 * 10 * len(got)


def test_nearest_copies_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 8))
    rows = [(i, [float(x) for x in base[i % 60]]) for i in range(1, 400)] + [(400, [float(x) for x in base[7]])]
    rows += [(1000, None), (1100, []), (1200, [0.0] * 8), (1300, [float("nan")] * 8), (1400, [None] * 8), (1500, [1.0, 2.0]), (None, [1.0] * 8), (1600, [float("inf")] * 8), (400, [float(x) for x in base[7]])]
    got = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash"))).collect()
    assert {r["query_id"] for r in got} == {100, 200, 300, 400}
    mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 400)
    assert [x[1] for x in mine[:7]] == [7, 67, 127, 187, 247, 307, 367] and all(x[2] == 0 for x in mine[:7]) and len(mine) == 10
    assert nearest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert len(nearest.search(spark.createDataFrame([(100, [1.0, 0.0]), (101, [0.0, 1.0])], "vec_id long, embedding array<float>")).collect()) == 1


def _recall(got, v, ids):
    table, hits = np.stack([v[i] for i in ids]), 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((table - v[q]) ** 2).sum(axis=1))
        near = [ids[i] for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits += len(set(near) & {r["vec_id"] for r in got if r["query_id"] == q})
    return hits / (10 * len(ids[ids % 100 == 0]))


@pytest.mark.parametrize("clusters", [0, 40])
def test_nearest_recall_at_the_parameters_of_the_query(spark, clusters):
    """Vectors without structure open most cells, vectors in clusters few; recall holds in both."""
    rng = np.random.default_rng(1)
    n = 12_000
    v = rng.normal(size=(n, 32)) if not clusters else 8 * rng.normal(size=(clusters, 32))[rng.integers(clusters, size=n)] + rng.normal(size=(n, 32))
    quantizer = nearest.fit(v[:4000])
    opened = nearest.probes(quantizer, v[:4000], 10, 0.98)
    assert opened <= 8 if clusters else opened > 24
    got = nearest.search(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")).collect()
    assert len(got) == 10 * n // 100
    assert _recall(got, dict(enumerate(v)), np.arange(n)) >= 0.95


def test_nearest_exact_and_sparse_cells(spark):
    """With `exact` all is found; a query whose cells hold too few rows opens more of them."""
    rng = np.random.default_rng(2)
    v = {i: x for i, x in enumerate(np.concatenate([rng.normal(size=(900, 6)), 50 + 9 * rng.normal(size=(7, 6))]))}
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "vec_id long, embedding array<double>")
    got = nearest.search(rows, exact=True, block_rows=100, query_rows=2).collect()
    assert _recall(got, v, np.arange(len(v))) == 1.0 and len(got) == 100
    assert len(nearest.search(rows.filter("vec_id >= 900"), words=7).collect()) == 6


# --- 9 sharding


def jump_hash(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_equals_the_published_loop(spark):
    keys = [0, 1, 2, 24, 12345, 2**40 + 7, 2**62 + 11, 2**63 - 1, -1, -(2**63)] + list(range(100, 1100))
    got = sharding.shard(spark.createDataFrame([(k, "t") for k in keys], "doc_id long, text string")).collect()
    for r in got:
        assert (r["shard"], r["grown_shard"]) == (jump_hash(r["doc_id"], 24), jump_hash(r["doc_id"], 25)) and r["grown_shard"] in (r["shard"], 24)


def test_sharding_edge_cases(spark):
    import zlib

    docs = odd_documents(spark)
    got = sharding.shard(docs).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "key"
    assert len(got) == 10 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert {(r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (2, 3)} == {(8, 0)}
    assert {r["text_crc32"] for r in got if r["doc_id"] == 8} == {zlib.crc32(b"x")}
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
    assert sharding.shard(spark.createDataFrame([("k1", "t"), (None, "u")], "doc_id string, text string")).count() == 2


def test_equal_rows_fill_slots_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN", 7)
    rows = [(None, "same")] * 50 + [(0, "same")] * 3 + [(64 * i, f"t{i}") for i in range(200)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sum(r["doc_id"] is None for r in got) == 50


# --- 10 quality


def brute_figures(text):
    import regex

    words = regex.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if regex.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_figures_equal_brute_force(spark):
    rng = random.Random(3)
    texts = ["", " ", "a", "é b\x0b c\x1cd", "x\r\ny\r\nx\r\n"] + ["".join(rng.choice("abé  \n#*<") for _ in range(rng.randint(1, 300))) for _ in range(60)] + [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 9, 40)]
    for t in texts + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(40).collect() if len(r["text"]) < 4000]:
        assert quality.figures(t)[:5] == brute_figures(t), t


def test_common_lines_go_and_depleted_documents_with_them(spark):
    own = lambda i: " ".join(f"own{i}word{k}" for k in range(30))
    menu = "home about contact imprint privacy " * 12
    rows = [(i, f"{own(i)}\n{menu}", "en", "h", 0) for i in range(40)] + [(100, f"{own(100)} short\n{menu}", "en", "other", 0)]
    rows += [(200 + i, f"{menu}\none two three four five six seven eight nine ten {i}", "en", "h", 0) for i in range(3)]
    limits = quality.Limits(most_docs=20, base_repeat=100)
    got = {r["doc_id"]: r for r in quality.quality_table(spark.createDataFrame(rows, DOCS), limits).collect()}
    assert all(got[i]["n_left"] == 30 and got[i]["kept"] for i in range(40)) and got[100]["n_left"] == got[100]["n_words"]
    assert all(not got[200 + i]["kept"] for i in range(3))
    assert {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(rows, DOCS), limits).collect()} == {i for i, r in got.items() if r["kept"]}


def test_common_lines_that_go_together_are_all_found(spark):
    """Every document has the same five lines and two of its own."""
    shared_lines = [f"{w} one two three four" for w in ("home", "about", "contact", "imprint", "privacy")]
    rows = [(i, "\n".join([*shared_lines, *(" ".join(f"own{i}x{k}y{j}" for k in range(15)) for j in range(2))]), "en", "h", 0) for i in range(300)]
    got = quality.quality_table(spark.createDataFrame(rows, DOCS), quality.Limits(most_docs=50)).collect()
    assert all(r["n_left"] == 30 for r in got)


def brute_left(rows, limits):
    """n_left of each document where different whole texts of a host decide."""
    plain = lambda text: [" ".join(x.lower().split()) for x in text.split("\n") if x.split()]
    texts = {}
    for _, text, _, host, _ in rows:
        for line in set(plain(text)):
            texts.setdefault((host, line), set()).add(text)
    most = {h: max(limits.most_docs, limits.most_share * sum(r[3] == h for r in rows)) for h in {r[3] for r in rows}}
    return {r[0]: sum(len(x.split()) for x in plain(r[1]) if len(texts[r[3], x]) <= most[r[3]]) for r in rows}


def test_lines_of_different_documents_go_whatever_else_they_hold(spark):
    """Pages of stock lines only, and documents with many common lines and one of their own; exact copies count once."""
    rng = random.Random(10)
    menu = [f"menu {i} one two three four" for i in range(40)]
    rows = [(i, "\n".join(rng.sample(menu, 12)), "en", "stock", 0) for i in range(300)]
    rows += [(1000 + n * 1000 + i, "\n".join([*menu[:n], f"own {i} five six seven eight"]), "en", f"n{n}", 0) for n in (10, 20) for i in range(100)]
    rows += [(5000 + i, "\n".join(menu), "en", "copies", 0) for i in range(100)]
    limits = quality.Limits(most_docs=50)
    got = {r["doc_id"]: r["n_left"] for r in quality.quality_table(spark.createDataFrame(rows, DOCS), limits).collect()}
    assert got == brute_left(rows, limits)
    assert {got[i] for i in range(300)} == {0} and {got[i] for i in (11000, 21000)} == {6} and got[5000] == 240


def test_pages_of_one_menu_lose_it_however_little_else_they_hold(spark):
    menu = "\n".join(f"menu {i} one two three four five six seven" for i in range(40))
    rows = [(n * 1000 + i, menu + "\n" + " ".join(f"own{i}x{k}" for k in range(n)), "en", f"host {n}", 0) for n in range(0, 41, 4) for i in range(300)]
    got = quality.quality_table(spark.createDataFrame(rows, DOCS)).collect()
    assert all(r["n_left"] == r["doc_id"] // 1000 for r in got if r["doc_id"] >= 1000)  # without own words they are one text
    assert not any(r["kept"] for r in got if 1000 <= r["doc_id"])


def test_quality_edge_cases(spark):
    got = quality.quality_table(odd_documents(spark)).collect()
    assert len(got) == 10 and all(r["base_failed"] and not r["kept"] for r in got if r["n_words"] < 20)
    assert quality.quality_table(spark.createDataFrame([], DOCS)).count() == 0
    assert quality.keep_good(odd_documents(spark)).columns == odd_documents(spark).columns


def test_quality_keeps_columns_of_any_name(spark):
    text = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, "s", "k", "r", "b")], "doc_id long, text string, source string, key string, row string, bad string")
    assert [tuple(r) for r in quality.keep_good(docs).collect()] == [(1, text, "s", "k", "r", "b")]


# --- pipeline


def test_pipeline_stages_keep_columns_and_clean_documents(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    now, before = docs, None
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SMALL)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        path = str(tmp_path / f"s{i}")
        out.write.parquet(path)
        before, now = now, spark.read.parquet(path)
        if i < 3:
            assert 0.5 * before.count() <= now.count() <= before.count()
    assert now.count() == before.count()
    assert corpus_pipeline.run(spark, SMALL).count() == now.count()


def test_pipeline_edge_cases(spark):
    import corpus_pipeline

    for docs in (odd_documents(spark), spark.createDataFrame([], DOCS)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, SMALL).collect()
