"""Byte-level BPE: a backtracking encoder over longest token matches, and decoding by an offset table."""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import given_back, pieces, prepare

#: Fixed value: the published pattern that cuts a text before byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Remembered words of the younger half of the memory, their greatest length, and remembered pairs. A full half becomes the
#: older one, from which words in use come back; a full table of pairs is emptied.
MOST_WORDS, MOST_LENGTH, MOST_PAIRS = 100_000, 48, 250_000


def _byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as code points from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """The vocabulary of one tokenizer file. Byte strings are held as latin-1 str, one character for each byte."""

    def __init__(self, definition: bytes) -> None:
        spec = json.loads(definition)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = model["type"] == "BPE" and pre["type"] == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and spec["normalizer"] is None and spec["post_processor"] is None and not model.get("ignore_merges")
        if not plain or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("only plain byte-level BPE without normalisation is supported")
        symbol = _byte_of_symbol()
        raw = lambda s: "".join(chr(symbol[c]) for c in s)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {raw(s): i for s, i in model["vocab"].items() if s not in special}
        self.code = {s: i.to_bytes(4, "little") for s, i in self.ids.items()}
        if any(chr(b) not in self.ids for b in range(256)):
            raise ValueError("every byte must be a token, so that every text has an encoding")
        self.most = max(map(len, self.ids))  # no match looks further, so long words are read in windows of this length
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        self.rank = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.special = {s.encode(): i for s, i in special.items()}
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.special_ids = special
        self.words = regex.compile(PATTERN)
        self.matcher = ahocorasick.Automaton()
        for s in self.ids:
            self.matcher.add_word(s, s)
        self.matcher.make_automaton()
        # each token's longest proper beginning that is a token too: the matches at a place, from long to short
        starts = ((s, next((s[:n] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), None)) for s in self.ids)
        self.shorter = {s: start for s, start in starts if start}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memory: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # decoding: all tokens' bytes in one run, and where each token starts and how long it is
        by_id = {i: s.encode("latin-1") for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        texts = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.blob = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length

    def _merged(self, symbols: str) -> list[str]:
        """Plain merging, lowest rank first; only for the few bytes of one or two tokens."""
        parts = list(symbols)
        while len(parts) > 1:
            ranks = [self.rank.get(p, len(self.rank)) for p in zip(parts, parts[1:], strict=False)]
            at = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[at] == len(self.rank):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """The pair-compatibility table: whether the two tokens, side by side, are what merging makes of their bytes. left may be empty."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self._merged(left + right) == ([left, right] if left else [right])
        return known

    def encode_word(self, word: str) -> list[str]:
        """Tokens of a word in byte form. Longest match first; a match that its left neighbour refuses gives way to the
        next shorter one, and a position from which no match goes on is struck out, so that each is given up once at most."""
        longest, shorter, known, most = self.matcher.iter_long, self.shorter, self.pairs.get, self.most
        out: list[str] = []
        closed: set[int] = set()
        at, end, left, token = 0, len(word), "", next(longest(word[:most]))[1]
        while True:
            while token is not None:
                fits = known((left, token))
                if (self.compatible(left, token) if fits is None else fits) and at + len(token) not in closed:
                    break
                token = shorter.get(token)
            if token is not None:
                out.append(token)
                at += len(token)
                if at == end:
                    return out
                left, token = token, next(longest(word[at : at + most]))[1]
            else:
                closed.add(at)
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                token = out.pop()
                at -= len(token)
                left, token = out[-1] if out else "", shorter.get(token)

    def encode_piece(self, word: str) -> bytes:
        found = self.older.get(word)
        if found is None:
            found = b"".join([self.code[t] for t in self.encode_word(word.encode().decode("latin-1"))])
        if len(word) <= MOST_LENGTH:
            if len(self.memory) >= MOST_WORDS:
                self.older = dict(self.memory)
                self.memory.clear()
            self.memory[word] = found
        return found

    def _encode_plain(self, text: str) -> bytes:
        known, piece = self.memory.get, self.encode_piece
        return b"".join([known(w) or piece(w) for w in self.words.findall(text)])

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; a special token's string stands for that token."""
        if self.cut is None or not self.cut.search(text):
            return self._encode_plain(text)
        out, last = [], 0
        for m in self.cut.finditer(text):
            out += [self._encode_plain(text[last : m.start()]), np.array([self.special_ids[m[0]]], dtype="<u4").tobytes()]
            last = m.end()
        return b"".join([*out, self._encode_plain(text[last:])])

    def decode(self, ids: bytes) -> bytes:
        """The text's bytes: each id's run of the table, gathered in one step."""
        which = np.frombuffer(ids, dtype="<u4")
        length = self.length[which]
        shift = np.repeat(self.start[which] - (np.cumsum(length) - length), length)
        return self.blob[shift + np.arange(len(shift))].tobytes().decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def codec(definition: bytes) -> Codec:
    return Codec(definition)


def encode_table(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = False) -> DataFrame:
    """Encode every whole text with the tokenizer file at `path`, decode the ids again, and give digests of both.

    Columns: keep, n_tokens, ids_sha256, decoded_sha256, and with ids=True the ids themselves (array<int>). Defined cases:
    a null text counts as empty (0 tokens); repeated rows give equal rows; of merges that tie the file's order decides; texts of
    any length are encoded whole, in linear time; an empty table gives an empty result; other columns are left out. The
    driver reads the file and sends its bytes, of fixed size, to the executors.
    """
    prepare(docs.sparkSession)
    with open(path, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.drop("_text").withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema
    if ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))

    def each(batches):
        own = codec(sent.value)
        for batch in batches:
            for piece in pieces(batch, "_text"):
                n, encoded, decoded, whole = [], [], [], []
                for value in piece.column("_text"):
                    found = own.encode(value.as_py() or "")
                    n.append(len(found) // 4)
                    encoded.append(hashlib.sha256(found).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(found)).hexdigest())
                    if ids:
                        whole.append(np.frombuffer(found, dtype="<u4").astype(np.int32))
                columns = [*(piece.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(encoded, pa.string()), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(whole, pa.list_(pa.int32()))] if ids else []), names=schema.names)

    return rows.mapInArrow(given_back(each), schema)
