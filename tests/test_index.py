"""The index over time, tails of transcripts, messages of any shape, benchmarks, insight views and reports."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from engramlake.operators import links, ranking
from engramlake.plans import jobs
from engramlake.sources import index, messages as M, notes as N, transcripts as X

NOW = 1_717_200_000_000


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


def vector(text):
    return F.array(F.length(text).cast("double"), F.lit(1.0))


def test_the_index_keeps_what_is_unchanged(spark, tmp_path):
    root, path = f"{tmp_path}/ws", f"{tmp_path}/index"
    for name in "abc":
        put(f"{root}/{name}.md", f"note {name}")
    count = lambda df: {r["what"]: r["n"] for r in df.collect()}
    assert count(index.rebuild(spark, root, path, "1", vector, NOW)) == {"files": 3, "reused": 0, "embedded": 3, "removed": 0}
    os.utime(f"{root}/a.md", (1, 1))
    os.remove(f"{root}/b.md")
    put(f"{root}/aa.md", "note new")
    assert count(index.rebuild(spark, root, path, "2", vector, NOW, 2)) == {"files": 3, "reused": 1, "embedded": 2, "removed": 1}
    rows = [(r["ord"], r["rel"], r["reused"]) for r in N.read_version(spark, path).orderBy("ord").collect()]
    assert rows == [(0, "a.md", False), (1, "aa.md", False), (2, "c.md", True)]
    # Vectors of another size are made anew.
    assert count(index.rebuild(spark, root, path, "3", lambda t: F.array(F.lit(1.0)), NOW, 1))["embedded"] == 3


def test_an_index_that_cannot_be_read_stops_the_run(spark, tmp_path):
    root, path = f"{tmp_path}/ws", f"{tmp_path}/index"
    put(f"{root}/a.md", "note")
    put(f"{path}/_current/part.json", '{"version": "7"}')
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        index.rebuild(spark, root, path, "8", vector, NOW)
    assert not os.path.exists(f"{path}/v=8") and not os.path.exists(f"{path}/_lock")


def test_one_writer(spark, tmp_path):
    path, now = f"{tmp_path}/x/_lock", int(time.time() * 1000)
    with index.writer_lock(spark, path, now):
        with pytest.raises(RuntimeError):
            with index.writer_lock(spark, path, now):
                pass
        os.utime(path, (1, 1))
        with index.writer_lock(spark, path, now):
            assert os.path.exists(path)
    assert not os.path.exists(path)


def said(text, day="2024-05-01"):
    return json.dumps({"type": "user_message", "timestamp": day, "data": {"content": text}}) + "\n"


def test_tails_of_transcripts(spark, tmp_path):
    root, out, cursor = f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/cursor"
    put(f"{root}/threads/a.jsonl", said("the first message of the first file") + "\n" + said("token ghp_" + "a1" * 12))
    put(f"{root}/threads/b.jsonl", said("the first message of the second file", "2024-06-01"))
    assert X.ingest_tails(spark, root, out, cursor, "1", most=1) == {"scanned": 1, "new": 2, "known": 0, "redacted": 1}
    assert X.ingest_tails(spark, root, out, cursor, "2") == {"scanned": 1, "new": 1, "known": 0, "redacted": 0}
    assert X.ingest_tails(spark, root, out, cursor, "3")["scanned"] == 0
    with open(f"{root}/threads/a.jsonl", "a") as f:
        f.write(said("one more message at the end of it"))
    assert X.ingest_tails(spark, root, out, cursor, "4") == {"scanned": 1, "new": 1, "known": 0, "redacted": 0}
    assert sorted((r["file"][-7], r["line"]) for r in X.read_shards(spark, out).collect()) == [("a", 1), ("a", 3), ("a", 4), ("b", 1)]
    assert X.read_shards(spark, out, "thread", ("2024-06", "2024-06")).count() == 1 and X.read_shards(spark, out, "archive").count() == 0
    plan = X.read_shards(spark, out, "archive")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan
    put(f"{root}/threads/c.jsonl", '{"type": "unknown"}\n')
    with pytest.raises(RuntimeError):
        X.ingest_tails(spark, root, out, cursor, "5")


def test_sources_are_found_once(spark, tmp_path):
    root = f"{tmp_path}/w"
    put(f"{root}/threads/a.jsonl", said("x"))
    put(f"{root}/other/b.jsonl", "{}")
    assert [r["src"] for r in X.discover(spark, root).collect()] == ["thread"]
    both = X.discover(spark, root, root).collect()
    assert sorted((r["file"], r["src"]) for r in both) == [("/other/b.jsonl", "cc"), ("/threads/a.jsonl", "thread")]


def test_messages_of_any_shape(spark):
    given = [
        ("plain <invoke> words", ("note", "plain words", "")),
        ({"role": "user", "content": "a  b", "timestamp": "t1"}, ("user", "a b", "t1")),
        ({"type": "assistant", "content": [{"type": "thinking", "text": "no"}, {"type": "text", "text": "yes"}], "ts": "t2"}, ("assistant", "yes", "t2")),
        ({"author": "me", "text": "by text"}, ("me", "by text", "")),
        ({"message": {"text": "inside"}}, ("?", "inside", "")),
        ({"role": "user", "content": ""}, None),
        ({"role": "user"}, None),
    ]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, (v, _) in enumerate(given)] + [(99, "not json")], "k int, value string")
    got = {r["k"]: (r["role"], r["text"], r["ts"]) for r in M.normalise(df, "k").collect()}
    assert got == {k: want for k, (_, want) in enumerate(given) if want}
    lines = [{"type": "user", "message": {"content": "hello"}, "timestamp": "t"}, {"type": "system", "message": {"content": "no"}}, {"type": "assistant", "message": {"content": [{"type": "text", "text": "<b>hi"}]}}]
    got = M.session_messages(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [("user", "hello", "t"), ("assistant", "<b>hi", "")]


def test_benchmarks(spark):
    dialog = {
        "sample_id": "c1", "conversation": {"session_1": [{"speaker": "A", "dia_id": "D1:1", "text": "hi"}, {"speaker": "B", "dia_id": "", "text": "no id"}], "session_1_date_time": "x"},
        "qa": [{"question": "q?", "evidence": ["D1:1"], "category": 1}, {"question": "none?", "evidence": [], "category": 1}, {"question": "trick?", "evidence": ["D1:1"], "category": 5}],
    }
    rows = spark.createDataFrame([(json.dumps(dialog),)], "value string").select(F.from_json("value", M.DIALOGS).alias("r")).select("r.*")
    corpus, queries = M.from_dialogs(rows)
    assert [tuple(r) for r in corpus.collect()] == [("c1/D1:1", "A: hi")]
    assert [tuple(r) for r in queries.collect()] == [("q?", ["c1/D1:1"])]
    rows = spark.createDataFrame([("q1", "who?", ["s1", None], [[("user", "a"), ("assistant", "b")], []], ["s1"]), ("q2", "abstain?", [], [], [])], M.SESSIONS)
    corpus, queries = M.from_sessions(rows)
    assert [tuple(r) for r in corpus.collect()] == [("q1/s1", "user: a\nassistant: b")]
    assert [tuple(r) for r in queries.collect()] == [("who?", ["q1/s1"])]


INSIGHTS = "id string, members array<string>, strength double, size long, runs long, first_ms long, last_ms long, status string"


def test_insight_views(spark):
    rows = [(f"i{k}", [f"n{k}", f"m{k}", f"o{k}"], 1.0 + k, 3, 2 + k % 2, 0, 0, "promoted" if k else "candidate") for k in range(12)]
    insights = spark.createDataFrame(rows, INSIGHTS)
    notes = spark.createDataFrame([("n3", "We prefer green tea leaves"), ("m3", "Never drink green tea leaves")], "id string, text string")
    listed = {(r["id"], r["pos"]): (r["snippet"], r["conflicts"]) for r in jobs.insight_list(insights, notes).collect()}
    assert len(listed) == 36 and listed["i3", 1] == ("Never drink green tea leaves", 1) and listed["i4", 0] == ("", 0)
    themes = spark.createDataFrame([("i3", "green · tea")], "cluster string, theme string")
    lines = [r["line"] for r in jobs.insight_block(insights, themes).orderBy("pos").collect()]
    assert len(lines) == 11 and any("theme: green · tea, in 3 notes (n3, m3, …), seen 3 times" in x for x in lines)
    marks = jobs.mark_phrased(spark.createDataFrame([], "id string, phrased_ms long"), insights, "i11", NOW)
    assert [tuple(r) for r in jobs.mark_phrased(marks, insights, "i11", 5).collect()] == [("i11", NOW)] and jobs.mark_phrased(marks, insights, "nobody", 5).count() == 1
    wheel = {r["id"] for r in jobs.flywheel(insights, notes, marks).collect()}
    assert len(wheel) == 8 and "i11" not in wheel and "i9" in wheel
    assert len({r["id"] for r in jobs.to_phrase(insights, notes).collect()}) == 11


def test_briefing_and_scan(spark):
    files = spark.createDataFrame(
        [
            ("active-tasks.md", "---\ntype: x\n---\n# Ship it\n## Location: here\n## Next\ntext", NOW - 4 * 86_400_000), ("last-conversation.md", "\nwe spoke\n\nof tea", NOW),
            ("learnings.md", "intro\n- first PENDING\n- pending too", NOW), ("health-monitor.log", "all ok\ndisk warn\nnothing", NOW), ("MEMORY.md", "x" * 12_000, NOW),
        ], "name string, content string, mtime_ms long",
    )
    entries = spark.createDataFrame([], "rel string, access int, last_access_ms long, importance double")
    got = [tuple(r) for r in jobs.briefing(entries, spark.createDataFrame([], INSIGHTS), spark.createDataFrame([], "rel string"), NOW, files).collect()]
    assert sorted(got) == sorted([("focus", "Ship it"), ("continuity", "we spoke"), ("continuity", "of tea"), ("pending", "Ship it"), ("pending", "Next"), ("learned", "- first PENDING"), ("health", "disk warn")])
    assert sorted(tuple(r) for r in jobs.proactive(files, NOW).collect()) == [("large", "MEMORY.md", 11), ("pending", "learnings.md", 2), ("stalled", "active-tasks.md", 4)]


def test_reports_and_briefs(spark):
    m = spark.createDataFrame([("a", 1, 1.0, 1.0, 1.0, 1.0), ("b", 1, 0.0, 0.0, 0.5, 0.0)], "query string, k int, recall double, precision double, mrr double, ndcg double")
    got = {(r["scope"], r["query"]): r["mrr"] for r in N.report(m).collect()}
    assert got == {("query", "a"): 1.0, ("query", "b"): 0.5, ("aggregate", None): 0.75}
    rows = spark.createDataFrame([("p.md", 3, None, 0.51234, 0.1, "semantic\tline", "a snippet")], "path string, start_line int, type string, rel double, redundancy double, reason string, snippet string")
    assert N.links_tsv(rows).first()["value"] == "p.md:3\tnote\t0.512\tsemantic line"
    assert N.links_text(rows).first()["value"] == "[note] p.md:3\n  similarity 0.512, overlap 0.100: semantic\tline\n  a snippet"
    found = spark.createDataFrame([("DUP", "a ~ b", 0.97), ("SURFACE", "c", 0.5)], "section string, item string, value double")
    lines = [(r["section"], r["line"]) for r in jobs.consolidation_brief(found).orderBy("section", "pos").collect()]
    assert lines == [("A", "- [DUP 0.970] a ~ b"), ("B", "- (none)"), ("C", "- c"), ("D", "- (none)")]
    n = spark.createDataFrame([("My Title!", "web", "password=secretsecret", ["t"], "2024-01-01", True)], "title string, source string, content string, tags array<string>, date string, review boolean")
    r = N.distilled_files(n).first()
    assert r["path"].startswith("my-title-") and "password=[REDACTED]" in r["value"] and f"provenance: sha256-{r['path'][-11:-3]}" in r["value"] and "reconcile: review" in r["value"]


def test_small_helpers(spark):
    assert [ranking.pool_size(k) for k in (1, 8, 20, None)] == [400, 400, 500, 400] and ranking.pool_size(50, 10) == 50 and ranking.pool_size(5, 70) == 70
    matches = F.array(F.struct(F.lit("p.md").alias("path"), F.lit(0.9).alias("score"), F.lit("a snippet").alias("snippet")))
    prompt = spark.range(1).select(links.verdict_prompt(F.lit("new  text"), matches).alias("p")).first()["p"]
    assert "New: new text" in prompt and "- p.md (0.900): a snippet" in prompt


def test_messages_stream_in_bounded_batches(spark, tmp_path):
    from engramlake.streaming import jobs as streams

    schema = "file string, line int, kind string, ts string, role string, text string"
    for k in range(3):
        put(f"{tmp_path}/in/{k}.json", json.dumps({"file": f"/threads/{k}.jsonl", "line": 1, "kind": "thread", "ts": "2024-05-01", "role": "user", "text": f"a message of file number {k}"}))
    messages = streams.message_files(spark, f"{tmp_path}/in", schema, 1)
    streams.ingest_messages(messages, f"{tmp_path}/out", f"{tmp_path}/mark").awaitTermination()
    assert X.read_shards(spark, f"{tmp_path}/out").count() == 3
    assert len([f for f in os.listdir(f"{tmp_path}/mark/commits") if f.isdigit()]) == 3
