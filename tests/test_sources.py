"""Files in and out, transcripts, streams and the entry module."""

import json
import os

import pytest
from pyspark.sql import functions as F

from engramlake.sources import notes, transcripts
from engramlake.streaming import jobs as streams

SF = "/root/testdata/sf0.001"


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def thread(i, content):
    return json.dumps({"type": "user_message", "timestamp": f"2024-05-0{i}T10:00:00Z", "data": {"content": content}})


def test_notes(spark, tmp_path):
    put(f"{tmp_path}/memory/02-semantic/a b.md", "---\ntags: [x]\n---\nhello world")
    put(f"{tmp_path}/memory/.archive/old.md", "gone")
    put(f"{tmp_path}/memory/x.txt", "no")
    got = notes.note_chunks(notes.scan_notes(spark, str(tmp_path))).collect()
    assert [(r["rel"], r["type"], r["tags"], r["ord"]) for r in got] == [("memory/02-semantic/a b.md", "semantic", ["x"], 0)]


def test_index_and_decay(spark, tmp_path):
    chunk = {"startLine": 3, "text": "t", "vector": [1.0, 0.0]}
    put(f"{tmp_path}/i.json", json.dumps({"meta": {"dim": 2}, "files": {"a.md": {"mtime": 1.5, "meta": {"type": "fact"}, "chunks": [chunk, chunk]}, "b.md": {"chunks": [chunk]}}}))
    got = notes.read_index(spark, f"{tmp_path}/i.json").orderBy("ord").collect()
    assert [(r["ord"], r["rel"], r["type"], r["status"], r["start_line"]) for r in got] == [(0, "a.md", "fact", "active", 3), (1, "a.md", "fact", "active", 3), (2, "b.md", "note", "active", 3)]
    put(f"{tmp_path}/d.json", notes.decay_json([{"rel": "a", "access": 2, "last_access_ms": 5, "importance": 0.4}]))
    assert [tuple(r) for r in notes.read_decay(spark, f"{tmp_path}/d.json").collect()] == [("a", 2, 5, 0.4)]
    put(f"{tmp_path}/bad.json", "{broken")
    assert notes.read_decay(spark, f"{tmp_path}/bad.json").count() == 0


def test_eval_sets(spark):
    lines = ['{"query": "q", "relevant": ["a"]}', "# note", "", "{bad", '{"relevant": ["a"]}', '{"query": "q", "relevant": "a"}', '{"query": "q", "relevant": []}']
    df = spark.createDataFrame(list(enumerate(lines)), "line int, value string")
    assert [r["skip_reason"] for r in notes.read_eval(df).orderBy("line").collect()] == [None, "malformed", "no query", "bad relevant", "empty relevant"]
    one = spark.createDataFrame([('[{"id": "a", "text": "x"}, {"rel": "b", "content": "y"}]',)], "value string")
    assert [tuple(r)[:2] for r in notes.read_corpus(one).collect()] == [("a", "x"), ("b", "y")]


def test_versions_audit_and_blocks(spark, tmp_path):
    path = f"{tmp_path}/t"
    for v in ("1", "2"):
        notes.write_version(spark.range(int(v)), path, v)
    assert notes.read_version(spark, path).count() == 2
    row = spark.createDataFrame([("t", "ARCHIVE", "f", "me", "auto", "s")], "timestamp string, action string, file string, actor string, approval string, summary string")
    for _ in range(2):
        notes.append_audit(row, f"{tmp_path}/audit")
    assert notes.read_audit(spark, f"{tmp_path}/audit").count() == 2
    once = notes.managed_block("# Doc\n", "a")
    assert notes.managed_block(once, "a") == once and "b" in notes.managed_block(once, "b") and notes.managed_block(once, "b").count("begin") == 1
    files = notes.note_files(spark.createDataFrame([("fact", "Tea time", ["t"], "2024-01-01", True)], "type string, text string, tags array<string>, date string, review boolean")).first()
    assert files["path"].startswith("memory/02-semantic/tea-time-") and "reconcile: review" in files["value"]


def test_transcripts(spark, tmp_path):
    root = f"{tmp_path}/in"
    lines = [thread(1, "a first message that is long enough"), thread(2, "private <NO-RECALL> message"), thread(3, "short"), "", "not json", json.dumps({"type": "decision", "timestamp": "2024-05-04", "data": {"what": "use spark", "channel": "c", "why": ["fast", "public"]}})]
    put(f"{root}/threads/t.jsonl", "\n".join(lines))
    blocks = [{"type": "thinking", "text": "hidden"}, {"type": "text", "text": "visible words in a block"}]
    put(f"{root}/other/s.jsonl", json.dumps({"type": "assistant", "timestamp": "2024-06-01", "message": {"content": blocks}}) + "\n")
    put(f"{root}/session-archive-1.jsonl", json.dumps({"type": "message", "message": {"role": "user", "content": "archived words of someone"}}))
    put(f"{root}/plain.jsonl", '{"type": "other"}')
    u = transcripts.units(transcripts.parse_lines(transcripts.classify(transcripts.read_lines(spark, root)))).collect()
    got = {(r["kind"], r["line"]): (r["role"], r["text"]) for r in u}
    assert got == {
        ("thread", 1): ("user", "a first message that is long enough"), ("thread", 6): ("assistant", "what: use spark. why: fast; public"),
        ("claude-code", 1): ("assistant", "visible words in a block"), ("archive", 1): ("user", "archived words of someone"),
    }
    out = f"{tmp_path}/out"
    assert transcripts.ingest(spark, root, out).count() == 4 and transcripts.ingest(spark, root, out).count() == 0
    with open(f"{root}/threads/t.jsonl", "a") as f:
        f.write("\n" + thread(7, "an appended line that must not be skipped") + "\n")
    assert transcripts.ingest(spark, root, out).count() == 1
    assert {r["month"] for r in spark.read.parquet(out).select("month").collect()} == {"2024-05", "2024-06", "undated"}


def test_streams(spark, tmp_path):
    src, out, mark = (f"{tmp_path}/{x}" for x in ("src", "out", "mark"))
    kind = "file string, line long, kind string, ts string, role string, text string"
    rows = spark.createDataFrame([("/threads/a", 1, "thread", "2024-01-02", "user", "token=abcdefgh12345 is in this line")], kind)
    rows.write.mode("append").parquet(src)
    for n in (1, 2):
        streams.ingest_messages(spark.readStream.schema(kind).parquet(src), out, mark).awaitTermination()
        rows.withColumn("line", F.lit(n).cast("long")).write.mode("append").parquet(src)
    streams.ingest_messages(spark.readStream.schema(kind).parquet(src), out, mark).awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 2 and got.where("text like '%[REDACTED]%'").count() == 2
    link = "a string, b string, weight double"
    e_src, e_out = f"{tmp_path}/e", f"{tmp_path}/graph"
    for n in range(3):
        spark.createDataFrame([("x", "y", 0.8)], link).coalesce(1).write.mode("append").parquet(e_src)
        streams.reinforce_stream(spark.readStream.schema(link).parquet(e_src), e_out, f"{tmp_path}/em").awaitTermination()
    r = spark.read.parquet(f"{e_out}/round=3").first()
    assert r["recurrence"] == 3 and r["neural_score"] == pytest.approx(1.04)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    q = e.queries()
    assert set(e.oracle_sql()) <= set(q)


def test_nothing_else_imports_llm():
    import engramlake

    root = os.path.dirname(engramlake.__file__)
    for d, _, names in os.walk(root):
        if os.path.basename(d) not in ("llm", "__pycache__"):
            for n in names:
                if n.endswith(".py"):
                    assert "engramlake.llm" not in open(os.path.join(d, n)).read(), n
