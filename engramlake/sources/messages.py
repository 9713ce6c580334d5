"""Messages of any runtime's shape as (role, text, ts), and public conversation benchmarks as evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from engramlake.sources.transcripts import _string

# Fixed value: tags of tools and systems that a message may hold.
NOISE = r"(?i)</?(?:function_calls|function_results|invoke|antml:[a-z]+|parameter|system-reminder|bash-(?:input|stdout|stderr)|local-command-[a-z]+|command-[a-z]+)[^>]*>"


def clean(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, NOISE, " "), r"\s+", " "))


def plain_text(v: Column, path: str) -> Column:
    """The text at a path: a string, the text blocks of a list, or an object's text."""
    blocks = F.try_variant_get(v, path, "array<variant>")
    texts = F.transform(F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: _string(b, "$.text"))
    return F.coalesce(_string(v, path), F.array_join(F.array_compact(texts), "\n"), _string(v, f"{path}.text"))


def _there(v: Column, path: str) -> Column:
    return F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")) != "VOID", F.lit(False))


def normalise(messages: DataFrame, *keep: str) -> DataFrame:
    """role, text, ts of messages (value: JSON), with the columns in keep; what has no text goes.

    A bare string is a note. The role is the first of role, type and author that says something, the text that of content,
    text or message, whichever is there first, the time ts or timestamp."""
    m = messages.withColumn("v", F.try_parse_json("value")).where("v is not null")
    bare = _string(F.col("v"), "$")
    role = F.coalesce(*(F.nullif(F.try_variant_get("v", f"$.{k}", "string"), F.lit("")) for k in ("role", "type", "author")), F.lit("?"))
    body = F.lit(None).cast("string")
    for k in ("message", "text", "content"):
        body = F.when(_there(F.col("v"), f"$.{k}"), F.coalesce(plain_text(F.col("v"), f"$.{k}"), F.lit(""))).otherwise(body)
    ts = F.coalesce(*(F.nullif(F.try_variant_get("v", f"$.{k}", "string"), F.lit("")) for k in ("ts", "timestamp")), F.lit(""))
    out = m.select(*keep, F.when(bare.isNotNull(), "note").otherwise(role).alias("role"), clean(F.coalesce(bare, body, F.lit(""))).alias("text"), F.when(bare.isNotNull(), "").otherwise(ts).alias("ts"))
    return out.where("text <> ''")


def session_messages(lines: DataFrame, *keep: str) -> DataFrame:
    """role, text, ts of a session transcript's lines (value: JSON): what user and assistant said."""
    m = lines.withColumn("v", F.try_parse_json("value")).where("v is not null")
    kind = F.try_variant_get("v", "$.type", "string")
    text = clean(F.coalesce(plain_text(F.col("v"), "$.message.content"), F.lit("")))
    return m.where(kind.isin("user", "assistant")).select(*keep, kind.alias("role"), text.alias("text"), F.coalesce(F.try_variant_get("v", "$.timestamp", "string"), F.lit("")).alias("ts")).where("text <> ''")


# --- benchmarks --------------------------------------------------------------------------------------------------

TURNS = "array<struct<speaker: string, dia_id: string, text: string>>"
DIALOGS = "sample_id string, conversation map<string, variant>, qa array<struct<question: string, evidence: array<string>, category: int>>"
SESSIONS = "question_id string, question string, haystack_session_ids array<string>, haystack_sessions array<array<struct<role: string, content: string>>>, answer_session_ids array<string>"


def from_dialogs(rows: DataFrame, unanswerable: int = 5) -> tuple[DataFrame, DataFrame]:
    """(corpus: id, text; queries: query, relevant) of long dialogues (DIALOGS) whose questions name turns as evidence; ids
    are named after their dialogue. Questions of the category that has no answer, or without evidence, are left out."""
    sessions = rows.select("sample_id", F.explode("conversation").alias("name", "turns")).where("name rlike '^session_[0-9]+$'")
    turns = sessions.select("sample_id", F.explode(F.try_variant_get("turns", "$", TURNS)).alias("t")).where("t.dia_id <> '' and t.text <> ''")
    corpus = turns.select(F.concat_ws("/", "sample_id", "t.dia_id").alias("id"), F.concat("t.speaker", F.lit(": "), "t.text").alias("text"))
    asked = rows.select("sample_id", F.explode("qa").alias("q")).where(F.coalesce(F.col("q.category") != unanswerable, F.lit(True)))
    return corpus, _asked(asked.select("sample_id", "q.question", "q.evidence"))


def from_sessions(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(corpus: id, text; queries: query, relevant) of questions with their own haystack of sessions (SESSIONS); ids are
    named after their question. Questions without an answering session are left out."""
    pairs = F.arrays_zip("haystack_session_ids", "haystack_sessions")
    hay = rows.select("question_id", F.explode(pairs).alias("s")).where("s.haystack_session_ids is not null")
    said = F.transform("s.haystack_sessions", lambda t: F.concat(t["role"], F.lit(": "), t["content"]))
    corpus = hay.select(F.concat_ws("/", "question_id", "s.haystack_session_ids").alias("id"), F.coalesce(F.array_join(said, "\n"), F.lit("")).alias("text"))
    return corpus, _asked(rows.select("question_id", "question", "answer_session_ids"))


def _asked(rows: DataFrame) -> DataFrame:
    space, question, ids = rows.columns
    named = F.transform(ids, lambda i: F.concat_ws("/", F.col(space), i))
    return rows.where((F.col(question) != "") & (F.size(ids) > 0)).select(F.col(question).alias("query"), named.alias("relevant"))
