"""Language ID by bit-sliced Bloom filters over character n-grams."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import discard, given_back, mix, pieces, prepare, stored

#: A slot index takes 21 bits of a hash, so three probes use 63 of its 64 bits.
SLOT_BITS, PROBES = 21, 3
#: Bytes of text whose grams are laid out at once, whole texts at least; each takes some 80 bytes meanwhile.
PIECE = 1 << 18
#: Share of all labelled texts that a language needs to be learned: what bounds the languages, and so slots and driver.
LEAST_SHARE = 1 / 1000
_SPACE = np.uint32(32)


@dataclass(frozen=True)
class Filters:
    """languages: names by bit, the most frequent first. slots: a row of words for each slot, in which language l's filter
    has bit l, counted through the words. false_positive: by language."""

    languages: tuple[str, ...]
    slots: np.ndarray
    false_positive: np.ndarray


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 3- and 4-grams of each text's words, and where each text's hashes end.

    Words are runs of letters in lower case with a space on either side; a gram's inner characters are letters.
    """
    low = pc.utf8_lower(pc.fill_null(texts, ""))
    ends = np.cumsum(pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64) + 2)
    points = np.frombuffer("".join(f" {t} " for t in low.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    wide = np.where(letter, points, _SPACE).astype(np.uint64)
    if len(wide) < 4:
        wide, letter = np.append(wide, np.full(4, 32, np.uint64)), np.append(letter, np.zeros(4, bool))
    at3 = np.flatnonzero(letter[1:-1])
    at4 = np.flatnonzero(letter[1:-2] & letter[2:-1])
    three = (wide[at3] * np.uint64(0x9E3779B97F4A7C15) + wide[at3 + 1]) * np.uint64(0xD6E8FEB86659FD93) + wide[at3 + 2]
    four = ((wide[at4] * np.uint64(0xA0761D6478BD642F) + wide[at4 + 1]) * np.uint64(0xE7037ED1A0B428DB) + wide[at4 + 2]) * np.uint64(0x8EBC6AF09C88C6E3) + wide[at4 + 3]
    # merged in order of position, so that a text's hashes are together
    where = np.concatenate([at3, at4])
    order = np.argsort(where, kind="stable")
    return mix(np.concatenate([three, four]))[order], np.searchsorted(where[order], ends)


def probe(slots: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash the words of the bitmask of the languages whose filter holds it."""
    low = np.uint64((1 << SLOT_BITS) - 1)
    found = slots[hashes & low]
    for k in range(1, PROBES):
        found = found & slots[(hashes >> np.uint64(SLOT_BITS * k)) & low]
    return found


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def learn(labelled: DataFrame, docs_per_language: int = 2000, most_grams: int = 100_000, least_count: int = 3, ratio: float = 0.34, least_share: float = LEAST_SHARE) -> Filters:
    """Fit the filters on about docs_per_language whole texts of each language.

    labelled: doc_id, text, lang, all non-null. Texts are chosen by a hash of doc_id. A gram enters the filter of each
    language in which its share of all grams is at least `ratio` times that in the language where it is greatest; of these
    about the most_grams most frequent of each language are taken, so that no language loses its grams to another. The
    driver receives these (12 bytes each) and the languages that at least `least_share` of the labelled texts have, which are
    1 / least_share at most; labels of fewer texts, such as the many values of a dirty column, are not learned.
    """
    prepare(labelled.sparkSession)
    by_lang = stored(labelled.groupBy("lang").count(), "language-counts")
    every = by_lang.agg(F.sum("count")).first()[0] or 0
    counts = by_lang.filter(F.col("count") >= every * least_share).orderBy(F.desc("count"), "lang").collect()
    discard(by_lang)
    languages = tuple(r["lang"] for r in counts)
    kind, bits = next(((t, n) for t, n in ((np.uint8, 8), (np.uint16, 16), (np.uint32, 32)) if len(languages) <= n), (np.uint64, 64))
    slots = np.zeros((1 << SLOT_BITS, max(1, -(-len(languages) // bits))), dtype=kind)
    if not languages:
        return Filters((), slots, np.zeros(0))
    wide = 1 << 30
    limits = F.create_map(*[x for i, r in enumerate(counts) for x in (F.lit(r["lang"]), F.struct(F.lit(i).alias("bit"), F.lit(int(min(1.0, docs_per_language / r["count"]) * wide)).alias("most")))])
    sample = labelled.withColumn("_l", F.try_element_at(limits, F.col("lang"))).filter(F.pmod(F.xxhash64(F.lit(5), F.col("doc_id")), F.lit(wide)) < F.col("_l.most"))

    def count(batches):
        for batch in batches:
            for piece in pieces(batch, "text", PIECE):
                hashes, ends = grams(piece.column("text"))
                bit = np.repeat(piece.column("bit").to_numpy(), np.diff(ends, prepend=0))
                for l in np.unique(bit):
                    found, n = np.unique(hashes[bit == l], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), l, np.int32)), pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["bit", "gram", "n"])

    found = sample.select("text", F.col("_l.bit").alias("bit")).mapInArrow(given_back(count), "bit int, gram long, n long")
    by = stored(found.groupBy("gram", "bit").agg(F.sum("n").alias("n")), "language-grams")
    totals = by.groupBy("bit").agg(F.sum("n").alias("total"))
    shares = by.join(F.broadcast(totals), "bit").select("gram", F.struct("bit", "n", (F.col("n") / F.col("total")).alias("share")).alias("x"))
    by_gram = shares.groupBy("gram").agg(F.collect_list("x").alias("x")).filter(F.aggregate("x", F.lit(0).cast("long"), lambda a, x: a + x["n"]) >= least_count)
    enters = F.filter("x", lambda x: x["share"] >= ratio * F.array_max(F.transform("x", lambda y: y["share"])))
    entering = stored(by_gram.select("gram", F.explode(enters).alias("x")).select("gram", "x.bit", "x.n"), "language-entering")
    # the least count that fits for each language, and the part of the grams with one less that fits too, by their hash
    least: dict[int, list] = {}
    for r in sorted(entering.groupBy("bit", "n").agg(F.count("*").alias("grams")).collect(), key=lambda r: (r["bit"], -r["n"])):
        cut = least.setdefault(r["bit"], [0, 1 << 62, 0])
        if cut[0] < most_grams:
            cut[:] = [cut[0] + r["grams"], r["n"], int(wide * min(1.0, (most_grams - cut[0]) / r["grams"]))]
    cuts = labelled.sparkSession.createDataFrame([(b, n, part) for b, (_, n, part) in least.items()], "bit int, least long, part long")
    fits = (F.col("n") > F.col("least")) | ((F.col("n") == F.col("least")) & (F.pmod("gram", F.lit(wide)) < F.col("part")))
    kept = entering.join(F.broadcast(cuts), "bit").filter(fits).select("gram", "bit").toArrow()
    grams_, bit = kept.column("gram").to_numpy().view(np.uint64), kept.column("bit").to_numpy()
    for l in range(len(languages)):
        own = grams_[bit == l]
        for k in range(PROBES):
            slots[(own >> np.uint64(SLOT_BITS * k)) & np.uint64((1 << SLOT_BITS) - 1), l // bits] |= kind(1 << l % bits)
    fill = np.array([np.mean((slots[:, l // bits] >> kind(l % bits)) & kind(1)) for l in range(len(languages))])
    return Filters(languages, slots, fill**PROBES)


def classify(texts: pa.Array, filters: Filters) -> tuple[list[str], np.ndarray]:
    """Language and score of each text. hits: grams of the text in each language's filter, by popcount of the masks' bit."""
    hashes, ends = grams(texts)
    starts = np.concatenate([[0], ends[:-1]])
    n = ends - starts
    if not filters.languages:
        return ["und"] * len(n), np.zeros(len(n))
    masks = probe(filters.slots, hashes)
    shares = np.zeros((len(n), len(filters.languages)))
    kind, bits = masks.dtype.type, masks.dtype.itemsize * 8
    for l, fp in enumerate(filters.false_positive):
        seen = np.concatenate([[0], np.cumsum((masks[:, l // bits] >> kind(l % bits)) & kind(1), dtype=np.int64)])
        hits = seen[ends] - seen[starts]
        shares[:, l] = np.clip((hits / np.maximum(n, 1) - fp) / (1 - fp), 0, 1)
    best = shares.argmax(axis=1)
    score = np.where(n > 0, shares[np.arange(len(n)), best], 0.0)
    return [filters.languages[b] if k else "und" for b, k in zip(best, n, strict=True)], score


def predict(docs: DataFrame, filters: Filters, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns `keep`, then lang_pred and score of each row's whole text.

    Defined cases: a null text and a text without letters are `und` with score 0; a text none of whose grams is known
    gets the most frequent language with score 0; without learned languages everything is `und`; ties go to the more
    frequent language; repeated rows are judged alike, each for itself; a text of any length is judged whole; an empty table
    gives an empty result; columns besides `keep` are left out.
    """
    prepare(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # a fixed number of slots, a bit for each language
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").withColumn("lang_pred", F.lit("")).withColumn("score", F.lit(0.0)).schema

    def each(batches):
        for batch in batches:
            for piece in pieces(batch, "_text", PIECE):
                names, score = classify(piece.column("_text"), sent.value)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(given_back(each), schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def language_table(docs: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out, and predict all. A null doc_id is not held out and not learned from."""
    out = predict(docs, learn(training_rows(docs)))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
