"""Folders, manifests, vocabularies, versions and the evidence of unfinished files."""

import pytest
from pyspark.sql import functions as F

from tideline.functions import text as T
from tideline.sources import files, reports


def test_session_folders(spark, tmp_path):
    assert files.sessions(spark, str(tmp_path / "missing")).count() == 0
    for name, held in {"20240101-090000": "session.json", "20240102-090000-2": "transcript.json", "20240103-090000": None, "notes": "session.json", "20240104-090000": "mic.wav"}.items():
        (tmp_path / name).mkdir()
        if held:
            (tmp_path / name / held).write_text("{}")
    found = files.sessions(spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("20240101-090000", "valid"), ("20240102-090000-2", "transcribed"), ("20240103-090000", "orphaned"), ("20240104-090000", "orphaned")]
    assert {(r.state, r.n) for r in files.sessions_report(found).collect()} == {("valid", 1), ("transcribed", 1), ("orphaned", 2)}


def test_manifests_keep_their_order_and_name_bad_lines(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("# head\n\na\ts1\tz.wav\nb\ts1\tb.wav\na\ts1\ta.wav\n")
    assert {(r.speaker, tuple(r.wavs)) for r in files.manifest(spark, str(tmp_path / "m.tsv")).collect()} == {("a", ("z.wav", "a.wav")), ("b", ("b.wav",))}
    (tmp_path / "bad.tsv").write_text("a\ts\tw\na s w\n")
    with pytest.raises(Exception, match="line 2"):
        files.manifest(spark, str(tmp_path / "bad.tsv")).collect()


def test_vocabularies_fail_on_a_bad_pattern(spark, tmp_path):
    (tmp_path / "v.toml").write_text('terms = ["x"]\n[profiles.p]\nmatch_title = "^a"\nterms = ["y"]\n')
    assert [tuple(r) for r in files.vocabulary(spark, str(tmp_path / "v.toml")).collect()] == [("p", "^a", ["x", "y"])]
    (tmp_path / "w.toml").write_text('[profiles.p]\nterms = []\nmatch_title = "(a"\n')
    with pytest.raises(ValueError, match="line 3"):
        files.vocabulary(spark, str(tmp_path / "w.toml"))


def test_versions_replace_each_other_whole(spark, tmp_path):
    path = str(tmp_path / "t")
    first = files.replace(spark.range(3), path)
    old = files.read_current(spark, path)
    second = files.replace(spark.range(5), path)
    assert files.current(spark, path) == second != first and old.count() == 3 and files.read_current(spark, path).count() == 5
    files.replace(spark.range(7), path)
    assert files.read_current(spark, path).count() == 7 and not (tmp_path / "t" / first).exists() and (tmp_path / "t" / second).exists()


def test_documents_ids_and_vectors(spark, tmp_path):
    schema = spark.createDataFrame([], "schema_version int, x string").schema
    assert files.read_or_empty(spark, str(tmp_path / "none.json"), schema).count() == 0
    (tmp_path / "d.json").write_text('{"schema_version": 2, "x": "y"}')
    assert files.read_or_empty(spark, str(tmp_path / "d.json"), schema, (1, 2)).first().x == "y"
    with pytest.raises(Exception, match="unsupported version"):
        files.read_or_empty(spark, str(tmp_path / "d.json"), schema, (3, 4)).collect()
    ids = files.allocated_ids(spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "base string, n int"), "base", "n")
    assert [r.session for r in ids.orderBy("n").collect()] == ["a", "a-1", "b"]
    spark.createDataFrame([([1.0, 2.0],), (None,)], "embedding array<double>").write.parquet(str(tmp_path / "ok"))
    assert files.embedding_cache(spark, str(tmp_path / "ok")).count() == 2
    spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>").write.parquet(str(tmp_path / "mixed"))
    with pytest.raises(ValueError, match="different lengths"):
        files.embedding_cache(spark, str(tmp_path / "mixed"))


def test_what_is_known_of_unfinished_sessions(spark, tmp_path):
    (tmp_path / "s1").mkdir()
    (tmp_path / "s1" / "mic.wav").write_bytes(b"RIFF")
    got = reports.unfinished(spark.createDataFrame([("s1",), ("s2",)], "session string"), reports.wav_evidence(spark, str(tmp_path))).orderBy("session").collect()
    assert [tuple(r) for r in got] == [("s1", "not_a_wav", "absent"), ("s2", "absent", "absent")]
    assert reports.template(None, "stored", "built") == "stored" and reports.template("", "stored", "built") == "" and reports.template(None, None, "built") == "built"


def test_headers_of_transcripts(spark):
    t = spark.createDataFrame([("s", 1, "Ann", 0.0, 1.0, "hi"), ("u", 1, "Bo", 0.0, 1.0, "yo")], "session string, n int, speaker string, start_s double, end_s double, text string")
    head = spark.createDataFrame([("s", 'A "b": c', None)], "session string, title string, room string")
    got = {r.session: r.markdown for r in reports.markdown(t, ["session"], "n", header=head).collect()}
    assert got == {"s": '---\ntitle: "A \\"b\\": c"\nroom: null\n---\n\n**Ann** [00:00] hi', "u": "**Bo** [00:00] yo"}


def test_labels_of_odd_texts(spark):
    one = spark.range(1)
    told = one.select(T.parse_mmss(F.lit(" [75:09] ")), T.parse_mmss(F.lit("1:60")), T.mail_address(F.lit("MAILTO:a@b")), T.mail_address(F.lit("mailto:")), T.rfc3339(F.lit("2024-01-02 03:04:05").cast("timestamp")), T.percent(F.lit(5), F.lit(0)), T.elapsed(F.lit(247)), T.audio_span(F.lit(59_999))).first()
    assert tuple(told) == (4509, None, "a@b", None, "2024-01-02T03:04:05Z", 0, "4m07s", "59.9 s")
