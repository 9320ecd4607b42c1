"""Commits over several tables, documents that can't be used, rewriting what changed, and audio headers from their first bytes."""

import os
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from tideline.sources import files, reports


def held(spark, path):
    return sorted(r["x"] for r in files.read_current(spark, path).collect())


@pytest.mark.parametrize("fails_at", [1, 2, 3])
def test_a_commit_that_fails_leaves_all_tables_as_they_were(spark, tmp_path, monkeypatch, fails_at):
    paths = [str(tmp_path / n) for n in "abc"]
    old, new = spark.createDataFrame([(1,)], "x int"), spark.createDataFrame([(2,)], "x int")
    files.replace_all({p: old for p in paths[:2]}, spark)
    plain, calls = files._point, []

    def failing(*args):
        calls.append(args)
        if len(calls) == fails_at:
            raise OSError("no space")
        plain(*args)

    monkeypatch.setattr(files, "_point", failing)
    with pytest.raises(OSError, match="no space"):
        files.replace_all({p: new for p in paths}, spark)
    assert [held(spark, p) for p in paths[:2]] == [[1], [1]] and files.current(spark, paths[2]) is None
    assert all(len([n for n in os.listdir(p) if n.startswith("v-")]) == (1 if p != paths[2] else 0) for p in paths)
    monkeypatch.setattr(files, "_point", plain)
    files.replace_all({p: new for p in paths}, spark)
    assert [held(spark, p) for p in paths] == [[2], [2], [2]]


def test_a_failed_write_moves_nothing_and_a_table_that_stays_moved_is_named(spark, tmp_path, monkeypatch):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    one = spark.createDataFrame([(1,)], "x int")
    files.replace_all({a: one, b: one}, spark)
    with pytest.raises(Exception, match="spoiled"):
        files.replace_all({a: one, b: one.select(F.raise_error(F.lit("spoiled")).cast("int").alias("x"))}, spark)
    assert held(spark, a) == held(spark, b) == [1]
    plain, calls = files._point, []

    def stuck(*args):
        calls.append(args)
        if len(calls) > 1:
            raise OSError("read only")
        plain(*args)

    monkeypatch.setattr(files, "_point", stuck)
    with pytest.raises(files.NotReverted, match="/a"):
        files.replace_all({a: one.select((F.col("x") + 1).alias("x")), b: one}, spark)
    assert held(spark, a) == [2] and held(spark, b) == [1] and files.replace_all({}, spark) == {}


def test_documents_that_cannot_be_used_are_named_and_cost_no_other(spark, tmp_path):
    texts = {"20240101-000001": '{"schema_version": 2, "names": ["a"]}', "20240101-000002": '{"schema_version": 9, "names": []}', "20240101-000003": "{broken", "20240101-000004": '{"schema_version": 1}', "20240101-000005": None, "20240101-000006": '{"names": ["b"]}', "20240101-000007": "", "20240101-000008": '{\n "schema_version": 1,\n "names": []\n}', "20240101-000009": '{"schema_version": "two", "names": []}'}
    for session, text in texts.items():
        (tmp_path / session).mkdir()
        if text is not None:
            (tmp_path / session / "names.json").write_text(text)
    schema = StructType().add("schema_version", IntegerType()).add("names", ArrayType(StringType()))
    good, bad = files.documents(spark, spark.createDataFrame([(s,) for s in texts], "session string"), str(tmp_path), "names.json", schema, (1, 2), ("names",))
    assert {(r["session"][-1], tuple(r["names"])) for r in good.collect()} == {("1", ("a",)), ("8", ())}
    why = {r["session"][-1]: r["why"] for r in bad.collect()}
    # Spark's scan leaves files without bytes out
    assert why == {"2": "unsupported version 9", "3": "not JSON of this form", "4": "without names", "5": "missing", "6": "no version", "7": why["7"], "9": "not JSON of this form"} and why["7"] in ("missing", "not JSON of this form")
    good, bad = files.documents(spark, spark.createDataFrame([("20240101-000001",)], "session string"), str(tmp_path / "none"), "names.json", schema, (1, 2))
    assert good.count() == 0 and [r["why"] for r in bad.collect()] == ["missing"]


def test_only_changed_sessions_are_written_again(spark, tmp_path):
    turns = spark.createDataFrame([(s, 1, "Ann", 0.0, 1.0, f"hello {s}") for s in ("s1", "s2", "s3")], "session string, n int, speaker string, start_s double, end_s double, text string")
    path = str(tmp_path / "out")
    listed = lambda: {os.path.join(d, f)[len(path) :]: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}
    reports.write_transcripts(turns, "session", "n", path)
    before = listed()
    again = turns.withColumn("speaker", F.lit("Bo"))
    reports.write_transcripts(again, "session", "n", path, spark.createDataFrame([("s2",), ("gone",)], "session string"))
    after = listed()
    stays = {f: t for f, t in before.items() if "session=s2" not in f}
    assert len(before) == 9 and stays == {f: t for f, t in after.items() if "session=s2" not in f} and not {f for f in before if "session=s2" in f} & set(after)
    told = {r["session"]: r["markdown"] for r in spark.read.parquet(f"{path}/markdown").collect()}
    assert "Bo" in told["s2"] and "Ann" in told["s1"] and "Ann" in told["s3"]


def wav(declared, body, rate=8000, align=2, byte_rate=16000, size=16):
    fmt = struct.pack("<HHIIHH", 1, 1, rate, byte_rate, align, 16)[:size]
    return b"RIFF\0\0\0\0WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", declared) + b"\0" * body


def test_audio_headers(spark, tmp_path):
    """8000 bytes at 8 kHz and 2 bytes a sample last 500 ms, whatever the byte rate says."""
    made = {
        "short": wav(16_000, 8000), "lying": wav(16_000, 8000, byte_rate=1), "zero_byte_rate": wav(16_000, 8000, byte_rate=0), "no_align": wav(16_000, 8000, align=0), "no_rate": wav(16_000, 8000, rate=0), "stub": wav(16_000, 8000, size=14),
        "complete": wav(8000, 8000), "beyond": wav(0, 8000), "open": wav(0xFFFFFFFF, 8000), "empty": wav(0, 0), "empty open": wav(0xFFFFFFFF, 0), "text": b"hello, this is no audio", "cut": b"RIFF\0\0\0\0WAVEfmt ", "long": wav(10**7, 9 * 10**6),
    }
    for name, data in made.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    got = {os.path.basename(r["path"]).replace("%20", " ")[:-4]: (r["evidence"], r["bytes"], r["millis"]) for r in reports.wav_evidence(spark, str(tmp_path)).collect()}
    none = (None, None)
    assert got == {
        "short": ("short", 8000, 500), "lying": ("short", 8000, 500), "zero_byte_rate": ("short", 8000, 500), "no_align": ("unknown", *none), "no_rate": ("unknown", *none), "stub": ("unknown", *none),
        "complete": ("complete", *none), "beyond": ("beyond", 8000, 500), "open": ("no_declared_length", 8000, 500), "empty": ("header_only", *none), "empty open": ("header_only", *none), "text": ("not_a_wav", *none), "cut": ("unknown", *none), "long": ("short", 10**6, 62_500),
    }
    assert reports._head(f"file://{tmp_path}/missing.wav", 10) is None
