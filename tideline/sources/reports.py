"""Transcripts and reports as text, their files, and the evidence of unfinished audio files."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.operators import outcomes, segments


def _joined(order: str, line, between: str):  # noqa: ANN001, ANN202
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda s: s["l"]), between)


def markdown(turns: DataFrame, keys: list[str], order: str, line: str = "**%s** [%s] %s", header: DataFrame | None = None) -> DataFrame:
    """One Markdown text for each session of turns (order, speaker, start_s, end_s, text): a paragraph for each run of one speaker.

    line is the paragraph's format: speaker, MM:SS, text. header (keys, then a column for each field) puts a block of YAML fields in
    front, its texts quoted; a session without header row has none.
    """
    b = segments.blocks(turns.select(*keys, order, "speaker", "start_s", "end_s", "text"), keys, order, "speaker", "start_s", "end_s", "text")
    body = b.groupBy(*keys).agg(_joined("run", F.format_string(line, "speaker", T.mmss(F.col("start")), "text"), "\n\n").alias("markdown"))
    if header is None:
        return body
    fields = [c for c in header.columns if c not in keys]
    block = F.concat(F.lit("---\n"), *[F.concat(F.lit(f"{c}: "), T.yaml_scalar(F.col(c).cast("string")), F.lit("\n")) for c in fields], F.lit("---\n\n"))
    return body.join(header.select(*keys, block.alias("_h")), keys, "left").select(*keys, F.concat(F.coalesce("_h", F.lit("")), F.col("markdown")).alias("markdown"))


def web_vtt(turns: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One WebVTT text for each session; a cue for each turn, with its speaker as voice."""
    cue = F.concat(T.vtt_time(F.col("start_s")), F.lit(" --> "), T.vtt_end(F.col("start_s"), F.col("end_s")), F.lit("\n<v "), T.cue_text(F.col("speaker")), F.lit(">"), T.cue_text(F.col("text")))
    return turns.groupBy(*keys).agg(F.concat(F.lit("WEBVTT\n\n"), _joined(order, cue, "\n\n"), F.lit("\n")).alias("vtt"))


def json_report(rows: DataFrame, keys: list[str], order: str, version: int, *columns: str) -> DataFrame:
    """One JSON document for each key: version, the keys and its rows in order. Null fields are kept."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*columns).alias("_r")))), lambda s: s["_r"])
    return rows.groupBy(*keys).agg(items.alias("_i")).select(*keys, F.to_json(F.struct(F.lit(version).alias("version"), *keys, F.col("_i").alias("rows")), {"ignoreNullFields": "false"}).alias("report"))


#: What the read-only documents call their layouts: a new field keeps the name, a renamed or retyped one takes the next.
LIST_SCHEMA, DRY_RUN_SCHEMA = "voices.list.v1", "voices.dry-run.v1"
_KEEP_NULLS = {"ignoreNullFields": "false"}


def voice_lists(voices: DataFrame, candidates: DataFrame, sessions: DataFrame, schema: str = LIST_SCHEMA) -> DataFrame:
    """One document for each session with offered voices: its voices by place, and the names that each sounds like, nearest first.

    voices: session, id, place, number, label, speech_s; candidates: session, id, name, similarity, n_references; sessions: session,
    meeting. Gives session, report (JSON: schema, and sessions with this one in it) and lines, one block for each voice, which ask
    as a person is asked. Defined cases: a session without row in sessions has no meeting (null); a voice without candidates has an
    empty list; ties of similarity go by name; sessions without voices and null sessions give no document.
    """
    c = candidates.select("session", "id", F.struct((-F.col("similarity")).alias("o"), "name", "similarity", F.col("n_references").alias("references")).alias("_c"))
    met = voices.join(c, ["session", "id"], "left").groupBy("session", "id", "place", "number", "label", "speech_s").agg(F.array_sort(F.collect_list("_c")).alias("_c"))
    asks = F.when(F.col("label") == F.col("number"), F.format_string("who is %s?", "number")).when(F.endswith("label", F.lit("?")), F.format_string("is %s %s", "number", "label")).otherwise(F.format_string("is %s %s?", "number", "label"))
    head = F.concat(F.col("session").cast("string"), F.lit("  "), asks, F.lit("  "), T.spoken(F.col("speech_s")), F.lit(" of speech"))
    named = F.transform("_c", lambda x: F.concat(F.lit("    "), F.rpad(x["name"], F.greatest(F.lit(20), F.length(x["name"])), F.lit(" ")), F.lit(" "), T.hundredths(x["similarity"]), F.lit("  "), F.format_string("%2d ref", x["references"])))
    found = F.transform("_c", lambda x: F.struct(x["name"].alias("name"), x["similarity"].alias("similarity"), x["references"].alias("references")))
    each = met.select("session", "place", "id", F.struct("number", "label", F.col("speech_s").alias("speech_seconds"), found.alias("candidates")).alias("_v"), F.array_join(F.concat(F.array(head), named), "\n").alias("_l"))
    whole = each.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("place", "id", "_v", "_l"))).alias("_all")).join(sessions.select("session", "meeting"), "session", "left")
    one = F.struct(F.col("session").cast("string").alias("id"), "meeting", F.col("_all._v").alias("voices"))
    return whole.select("session", F.to_json(F.struct(F.lit(schema).alias("schema"), F.array(one).alias("sessions")), _KEEP_NULLS).alias("report"), F.array_join("_all._l", "\n\n").alias("lines"))


def _json(value: Column) -> Column:
    """A text, number or array as JSON, null as null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(value.alias("v")), _KEEP_NULLS), '(?s)^\\{"v":(.*)\\}$', 1), F.lit("null"))


def _object(**fields: Column) -> Column:
    parts = [F.concat(F.lit(f'"{k}":'), v) for k, v in fields.items()]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def dry_runs(outcome: DataFrame, keys: list[str], schema: str = DRY_RUN_SCHEMA) -> DataFrame:
    """What each answer would do, as a document and as lines: outcome holds keys, id, number, name, the columns of
    outcomes.outcomes, and verdict, other_number and losing of the labels (see assign.judged_answers).

    Gives keys, id, report (JSON: schema, voice, name, consequence with refused, stored, session_only, displaced and stale) and
    lines. refused and stored are the bare name of their case, or an object of that name with its fields. A blank name has no
    consequence (null). The first of keys is the session. Every row gives one document.
    """
    c = F.col
    refused = F.when(c("verdict") == "vetoed", _object(Vetoed=_object(holder=_json(c("other_number"))))).when(c("verdict") == "taken", _object(Taken=_object(voice=_json(c("other_number")), losing=_json(c("losing")))))
    stored = (
        F.when(c("stored") == "enrolled", '"Enrolled"').when(c("stored") == "already_held", '"AlreadyHeld"').when(c("stored") == "added", _object(Added=_object(held=_json(c("held")))))
        .when(c("stored") == "replaced", _object(Replaced=_object(held=_json(c("held")), evicted_seconds=_json(c("evicted_s")))))
        .when(c("stored") == "at_capacity", _object(AtCapacity=_object(held=_json(c("held")), shortest=_json(c("shortest_s")))))
    )
    null = F.lit("null")
    consequence = _object(refused=F.coalesce(refused, null), stored=F.coalesce(stored, null), session_only=_json(c("session_only")), displaced=_json(c("displaced")), stale=_json(c("stale")))
    name = F.coalesce("name", F.lit(""))
    report = _object(schema=_json(F.lit(schema)), voice=_object(session=_json(c(keys[0]).cast("string")), number=_json(c("number"))), name=_json(name), consequence=F.when(c("name").isNull(), null).otherwise(consequence))
    head = F.format_string('%s in %s, answering "%s":', c("number"), c(keys[0]).cast("string"), name)
    return outcome.select(*keys, "id", report.alias("report"), F.array_join(F.concat(F.array(head), F.transform(outcomes.sentences(), lambda l: F.concat(F.lit("  "), l))), "\n").alias("lines"))


def write_transcripts(turns: DataFrame, key: str, order: str, path: str, changed: DataFrame | None = None) -> None:
    """Writes Markdown and WebVTT tables under path, then the JSON one: where it has a session's turns, so have the others.

    Tables are partitioned by key. With `changed` (key) only the sessions in it are written again, and the files of the others stay
    as they are; a changed session without turns keeps what it had. Null keys have a partition of their own; without rows
    nothing is written over.
    """
    if changed is not None:
        turns = turns.join(changed.select(key).distinct(), key, "left_semi")
    kinds = (("markdown", markdown(turns, [key], order)), ("vtt", web_vtt(turns, [key], order)), ("json", json_report(turns, [key], order, 1, order, "speaker", "start_s", "end_s", "text")))
    for name, table in kinds:
        mode = "static" if changed is None else "dynamic"
        table.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(key).parquet(f"{path}/{name}")


def _evidence(head: bytes, size: int) -> tuple[str, int | None, int | None]:
    """What a RIFF header declares against what the file holds, the bytes concerned and their length in milliseconds. head: the
    file's first bytes. Of several chunks of one name the first counts, even if it cannot be used."""
    if len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return "not_a_wav", None, None
    at, fmt, data = 12, None, None
    while at + 8 <= len(head):
        name, declared = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt " and fmt is None:
            body = head[at + 8 : at + 8 + declared]
            fmt = (struct.unpack_from("<I", body, 4)[0], struct.unpack_from("<H", body, 12)[0]) if len(body) >= 16 else (0, 0)
        elif name == b"data" and data is None:
            data = declared, at + 8
        at += 8 + declared + declared % 2
    rate = fmt[0] * fmt[1] if fmt else 0  # sample rate times block align; the byte rate is an estimate for buffers
    if not rate or data is None:
        return "unknown", None, None
    declared, held = data[0], max(size - data[1], 0)
    if held == 0 and declared in (0, 0xFFFFFFFF):
        return "header_only", None, None
    if declared == held:
        return "complete", None, None
    kind, gap = ("no_declared_length", held) if declared == 0xFFFFFFFF else ("short", declared - held) if declared > held else ("beyond", held - declared)
    return kind, gap, gap * 1000 // rate


def wav_evidence(spark: SparkSession, paths: str | list[str], head: int = 65536) -> DataFrame:
    """path, length, evidence, and bytes and millis of the audio concerned, for each .wav under the paths: complete, short, beyond,
    no_declared_length, header_only, unknown, not_a_wav or unreadable.

    Spark lists the files and reads none of them; tasks open each and read its first `head` bytes, however long it is. What can't
    be opened is unreadable. A file without bytes gives no row, as Spark's scan leaves it out, and neither does one that is
    missing; see unfinished().
    """

    def judge(parts):  # noqa: ANN001, ANN202
        for part in parts:
            found = [_evidence(h, n) if (h := _head(p, head)) is not None else ("unreadable", None, None) for p, n in zip(part["path"], part["length"], strict=True)]
            yield pd.DataFrame({"path": part["path"], "length": part["length"], "evidence": [e for e, _, _ in found], "bytes": pd.array([b for _, b, _ in found], dtype="Int64"), "millis": pd.array([m for _, _, m in found], dtype="Int64")})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(paths)
    return files.select("path", "length").mapInPandas(judge, "path string, length long, evidence string, bytes long, millis long")


def _head(path: str, size: int) -> bytes | None:
    """The first bytes of a file under a path as Spark's scan gives it, or None where it can't be opened."""
    from urllib.parse import quote

    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    try:
        with where.open_input_file(name) as file:
            return file.read(size)
    except OSError:
        return None


def unfinished(sessions: DataFrame, evidence: DataFrame, tracks: tuple[str, ...] = ("mic", "speaker")) -> DataFrame:
    """What is known of each session's tracks: session and a column for each track, `absent` where the session has no such file.
    evidence: path (…/session/track.wav) and evidence."""
    e = evidence.select(F.regexp_extract("path", "([^/]+)/([^/]+)[.]wav$", 1).alias("session"), F.regexp_extract("path", "([^/]+)[.]wav$", 1).alias("_track"), "evidence")
    wide = sessions.select("session").distinct().join(e, "session", "left").groupBy("session").agg(*[F.max(F.when(F.col("_track") == t, F.col("evidence"))).alias(t) for t in tracks])
    return wide.select("session", *[F.coalesce(t, F.lit("absent")).alias(t) for t in tracks])


def template(explicit: str | None, stored: str | None, built_in: str) -> str:
    """The line format that counts: the one asked for, else the one stored with the sessions, else the built-in one."""
    return explicit if explicit is not None else stored if stored is not None else built_in
