"""License scans: normalised sentences to known sentence ids, then ordered id rules to licenses."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import prepare
from tideline.llm.license_texts import CLOSE, ENOUGH, MARKS, NOTICES, PASSAGES, TEXTS

#: Marks of a sentence's end and of a line's end in a normalised text; a sentence may run over line ends.
_STOP, _LINE = "\x01", "\x02"
#: Known sentences that may stand between two that a rule asks for, such as another license's.
GAP = 2
#: Where names of holders stand in a known sentence, and how many words they may have.
SLOT, MOST_HOLDER = "<holder>", 12


def normalised(sentence: str) -> str:
    return f" {SLOT} ".join(re.sub("[^a-z0-9]+", " ", part.lower()).strip() for part in sentence.split(SLOT)).strip()


def sentences(text: str) -> list[str]:
    """A license's sentences: cut at paragraphs, at a full stop before white space, and after the number of a list item."""
    parts = [re.sub(r"^\s*([0-9]+[.)]|[*-])\s+", "", p) for p in re.split(r"\n\s*\n", text.strip())]
    return [s.strip() for p in parts for s in re.split(r"[.!?]+\s+|[.!?]+$", p) if normalised(s)]


@dataclass(frozen=True)
class Rule:
    """A license is known where sentences with these ids come in this order, with at most `gap` other known ones between two."""

    license: str
    ids: tuple[str, ...]
    gap: int = GAP
    #: A mark counts only where no license is known.
    mark: bool = False


@lru_cache(maxsize=1)
def known() -> tuple[dict[str, str], list[Rule]]:
    """The sentences (normalised, to their id) and the rules of the table of texts. A sentence that several licenses share has
    one id; a license with a longer rule than another's, of which it holds all sentences, is told apart by its own ones."""
    ids: dict[str, str] = {}
    rules = []
    for name, text in TEXTS.items():
        order = tuple(ids.setdefault(normalised(s), f"{name.lower()}~{i}") for i, s in enumerate(sentences(text)))
        rules.append(Rule(name, order[: ENOUGH.get(name)], 0 if name in CLOSE else GAP))
    for name, parts in PASSAGES.items():
        rules.append(Rule(name, tuple(ids.setdefault(normalised(s), f"{name.lower()}~passage{i}") for i, s in enumerate(parts))))
    for mark, table in ((False, NOTICES), (True, MARKS)):
        for name, notices in table.items():
            rules += [Rule(name, (ids.setdefault(normalised(s), f"{name.lower()}~notice{i}"),), mark=mark) for i, s in enumerate(notices)]
    return ids, rules


class Lookup:
    """Known sentences by a hash of their first words: a place of a text is compared with those only that open like it."""

    OPENING = 3

    def __init__(self, table: dict[str, str], most: int = MOST_HOLDER):
        self.most = most
        self.by_opening: dict[tuple[str, ...], list[tuple[list[list[str]], str]]] = {}
        for sentence, name in table.items():
            parts = [p.split() for p in sentence.split(SLOT)]
            self.by_opening.setdefault(tuple(parts[0][: self.OPENING]), []).append((parts, name))
        self.first = {o[0] for o in self.by_opening}
        self.lengths = sorted({len(o) for o in self.by_opening})

    def _ends(self, words: list[str], at: int, parts: list[list[str]], ends: set[int]) -> int:
        """The furthest end of a line at which the parts stop that begin at a word, with 1 to `most` words in each slot; or -1."""
        reached = {at + len(parts[0])} if words[at : at + len(parts[0])] == parts[0] else set()
        for part in parts[1:]:
            reached = {e + gap + len(part) for e in reached for gap in range(1, self.most + 1) if words[e + gap : e + gap + len(part)] == part and e + gap + len(part) <= len(words)}
        return max(reached & ends, default=-1)

    def find(self, text: str) -> list[str]:
        """Ids of the known sentences of a marked text, in order, none of which overlaps another."""
        out = []
        for stretch in text.split(_STOP):
            lines = stretch.split(_LINE)
            if not any(line.partition(" ")[0] in self.first for line in lines):
                continue
            words, starts = [], []
            for line in lines:
                starts.append(len(words))
                words += line.split()
            ends, over = set(starts[1:]) | {len(words)}, 0
            for at in starts:
                if at < over or at == len(words) or words[at] not in self.first:
                    continue
                opens = [x for n in self.lengths for x in self.by_opening.get(tuple(words[at : at + n]), ()) if at + n <= len(words)]
                end, name = max(((self._ends(words, at, parts, ends), name) for parts, name in opens), default=(-1, ""))
                if end > at:
                    out.append(name)
                    over = end
        return out


def marked(text: Column) -> Column:
    """A text in lower case, with runs of anything but a-z and 0-9 as one space and a mark at each end of a sentence or line."""
    out = F.regexp_replace(F.lower(F.translate(text, _STOP + _LINE, "  ")), "[.!?]+[ \\t\\r\\n]+", _STOP)
    out = F.regexp_replace(F.regexp_replace(out, "[\\r\\n]+", _LINE), f"[^a-z0-9{_STOP}{_LINE}]+", " ")
    out = F.regexp_replace(out, f"[ {_LINE}]*{_LINE}[ {_LINE}]*", _LINE)
    out = F.regexp_replace(out, f"[ {_STOP}{_LINE}]*{_STOP}[ {_STOP}{_LINE}]*", _STOP)
    return F.concat(F.lit(_STOP), F.trim(out), F.lit(_STOP))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", table: dict[str, str] | None = None, rules: list[Rule] | list[tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """Per document: key, n_known (known sentences in its whole text) and licenses (array of license names, sorted).

    A known sentence begins and ends at a sentence's or line's end, and may be wrapped over lines, each behind a comment mark;
    where it names holders, any 1 to MOST_HOLDER words may stand. Of sentences that begin at one place the longest counts, and
    none overlaps another. A rule matches where its ids come in its order among the document's known sentences, with at most
    its gap of others between two of them, whatever unknown text stands there. Marks are given only where no rule of a license
    matches. Each document is worked on alone, without a shuffle; a place of a text is compared with the sentences that its
    first words open, so the work does not grow with the table. Defined cases: a null or empty text knows no sentence; repeated
    rows give equal rows; an empty table gives an empty result; other columns are left out.
    """
    table, rules = table or known()[0], [r if isinstance(r, Rule) else Rule(*r) for r in rules or known()[1]]
    prepare(docs.sparkSession)

    def look(batches):
        lookup = Lookup(table)
        for batch in batches:
            found = [lookup.find(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found, pa.list_(pa.string()))], ["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), marked(F.coalesce(F.col(text), F.lit(""))).alias("text")).mapInArrow(look, f"key {kind}, ids array<string>")
    rows = rows.withColumn("run", F.concat(F.lit("|"), F.array_join("ids", "|"), F.lit("|")))

    def matched(mark: bool):
        at = lambda r: "\\|" + f"\\|(?:[^|]*\\|){{0,{r.gap}}}".join(re.escape(i) for i in r.ids) + "\\|"
        named = [F.when(F.col("run").rlike(at(r)), F.lit(r.license)) for r in rules if r.mark == mark]
        return F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))) if named else F.array().cast("array<string>")

    none = F.array().cast("array<string>")
    licenses = F.when(F.size("ids") == 0, none).when(F.size(F.col("sure")) > 0, F.col("sure")).otherwise(matched(True))
    rows = rows.withColumn("sure", F.when(F.size("ids") > 0, matched(False)).otherwise(none))
    return rows.select(F.col("key").alias(key), F.size("ids").cast("long").alias("n_known"), licenses.alias("licenses"))
