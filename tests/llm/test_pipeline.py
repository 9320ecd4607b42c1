"""The whole pipeline against a brute-force version on planted documents."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import tokenizers
from test_operators import DOCS, brute_components, brute_figures, brute_left, words_of

import corpus_pipeline
from tideline.llm import quality
from tideline.llm.queries import TOKENIZER


def planted():
    """Two languages; exact and near copies, pages of one menu, junk, short and repetitive texts, one long text, nulls, repeated rows."""
    rng = random.Random(12)
    syllables = {"en": ["tha", "ing", "her", "ess", "wor", "bly"], "fr": ["eau", "que", "oux", "ion", "lle", "par"]}
    vocabulary = {lang: sorted({"".join(rng.choices(s, k=rng.randint(1, 4))) for _ in range(300)}) for lang, s in syllables.items()}
    text = lambda lang, n: "\n".join(" ".join(rng.choices(vocabulary[lang], k=12)) for _ in range(n // 12))
    sources = ["web", "books", "news", None]
    rows = [(i, text(lang := rng.choice(["en", "fr"]), rng.choice([36, 60, 240, 600])), lang, rng.choice(sources), 0) for i in range(130)]
    rows += [(200 + i, rows[i % 9][1], rows[i % 9][2], sources[i % 4], 0) for i in range(30)]  # exact copies
    for i in range(40):  # near copies: one word of 240 or 600 is another
        base = next(r for r in rows[i % 17 :] if len(words_of(r[1])) >= 240)
        words = base[1].split(" ")
        words[rng.randrange(len(words))] = "changed"
        rows.append((300 + i, " ".join(words), base[2], base[3], 0))
    menu = text("en", 240)
    rows += [(400 + i, menu + "\n" + text("en", 24) + f"\nown{i} thing", "en", "shop", 0) for i in range(70)]
    rows += [(500, "12 34 567 " * 20, "en", "web", 0), (501, None, "en", "web", None), (502, "", None, None, 0), (503, "short thing", "en", "web", 0), (504, "thaing her essing worbly thaher inging esswor blything " * 12, "en", "web", 0), (505, text("fr", 6000), "fr", "books", 0)]
    rows += [(None, text("en", 120), "en", None, 0), (None, text("fr", 60), None, "news", 0), rows[3], rows[3], (130, text("fr", 60), None, "web", 0)]
    rng.shuffle(rows)
    return rows


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")
    return [g for w in words if w for p in [f" {w} "] for n in (3, 4) for i in range(len(p) - n + 1) for g in [p[i : i + n]] if " " not in g[1:-1]]


def recognised(rows):
    counts, totals = defaultdict(Counter), Counter()
    for doc_id, text, lang, *_ in rows:
        if doc_id is not None and text is not None and lang is not None and zlib.crc32(str(doc_id).encode()) % 5:
            for g in grams(text):
                counts[g][lang] += 1
                totals[lang] += 1
    sets = {lang: {g for g, by in counts.items() if sum(by.values()) >= 3 and by[lang] and by[lang] / totals[lang] >= 0.34 * max(by[x] / totals[x] for x in by)} for lang in totals}
    kept = []
    for row in rows:
        found = grams(row[1] or "")
        score = max((sum(g in s for g in found) / len(found) for s in sets.values()), default=0.0) if found else 0.0
        assert abs(score - corpus_pipeline.LEAST_SCORE) > 0.05  # the filters' false positives decide nothing here
        if score >= corpus_pipeline.LEAST_SCORE:
            kept.append(row)
    return kept


def good(rows):
    limits = quality.Limits()
    numbered = [(i, *row[1:]) for i, row in enumerate(rows)]
    left = brute_left(numbered, limits)
    out = []
    for i, row in enumerate(rows):
        n_words, *_, repeated = brute_figures(row[1])
        if n_words >= limits.base_words and 100 * repeated <= limits.base_repeat * n_words and left[i] >= limits.least_left * n_words:
            out.append(row)
    return out


def one_of_each(rows):
    found = brute_components([(i, row[1]) for i, row in enumerate(rows)], corpus_pipeline.NEAR)
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[found[i][1]].append(row)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def mixed(rows):
    sizes = Counter()
    for row in rows:
        sizes[row[3]] += len(words_of(row[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(order)}
    target, rest, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        level = rest / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] > 2 * sizes[s]]
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            rest -= target[s]
            open_.discard(s)
    out = []
    for row in rows:
        rate = target[row[3]] / sizes[row[3]]
        digest = hashlib.md5(row[1].encode()).hexdigest()
        draw = int(hashlib.md5(f"17|{'' if row[0] is None else row[0]}|{digest}".encode()).hexdigest()[:13], 16) / 2**52
        out += [row] * (math.floor(rate) + (draw < rate - math.floor(rate)))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rows = planted()
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    steps = [rows]
    for stage in (recognised, good, one_of_each, mixed):
        steps.append(stage(steps[-1]))
    sizes = [len(s) for s in steps]
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] and sizes[4] > sizes[3]  # every stage decides something
    assert not any(r[3] == "shop" for r in steps[2]) and any(r[0] is None for r in steps[4]) and any(r[3] is None for r in steps[4])
    library = tokenizers.Tokenizer.from_file(TOKENIZER)
    library.no_truncation()
    want = Counter()
    for doc_id, text, lang, source, _ in steps[-1]:
        ids = library.encode(text, add_special_tokens=False).ids
        want[doc_id, lang, source, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()] += 1
    got = Counter((r["doc_id"], r["lang"], r["source"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == want
