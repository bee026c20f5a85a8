"""Transcript lines, conversations, keyword scores, prompts and model answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.registry import query
from catalog.standins import (
    CONVERSATIONS,
    HISTORY,
    RECORDS,
    TRANSCRIPT_LINES,
    read,
    records,
    sql_text,
    transcript_lines,
)
from wardbook import fixed_values as fv
from wardbook.functions import ids, json_text, transcript
from wardbook.operators import filters
from wardbook.operators.folds import conversation_segments as segments_of
from wardbook.plans.extraction import (
    conversations_from,
    draft_prescriptions,
    extraction_prompts,
    with_drafts,
)
from wardbook.plans.model_stage import ask, with_prompt_key
from wardbook.plans.prompts import CONVERSATION_SLOT, EXTRACTION_PROMPT, HISTORY_SLOT

_SPOKEN = f"{TRANSCRIPT_LINES}, {CONVERSATIONS}"


@query(f"WITH {_SPOKEN} SELECT consult_id, turn, line FROM spoken")
def speaker_lines(spark, sf_dir):
    line = transcript.transcript_line(F.col("speaker"), F.col("text")).alias("line")
    return transcript_lines(spark, sf_dir).select("consult_id", "turn", line)


@query(f"WITH {_SPOKEN} SELECT consult_id, conversation FROM consultations")
def conversation_fold(spark, sf_dir):
    return conversations_from(transcript_lines(spark, sf_dir))


@query(
    f"""WITH {_SPOKEN} SELECT consult_id, CAST(turn // 2 AS BIGINT) AS segment,
      string_agg(line, chr(10) ORDER BY turn, line) AS conversation
    FROM spoken GROUP BY consult_id, turn // 2"""
)
def conversation_segments(spark, sf_dir):
    line = transcript.transcript_line(F.col("speaker"), F.col("text")).alias("line")
    lines = transcript_lines(spark, sf_dir).select("consult_id", "turn", line)
    return segments_of(lines, segment_turns=2)


@query(
    f"""WITH {TRANSCRIPT_LINES}, routed AS (
      SELECT *, lower(speaker) = 'doctor' AS doctor FROM transcript_lines)
    SELECT consult_id, turn, CASE WHEN doctor THEN 'hi-IN' ELSE 'kn-IN' END AS source_lang,
      CASE WHEN doctor THEN 'kn-IN' ELSE 'en-IN' END AS target_lang,
      CASE WHEN doctor THEN TRUE ELSE FALSE END AS second_step,
      CASE WHEN doctor THEN '[kn] ' || text ELSE text END AS final_text FROM routed"""
)
def language_routing(spark, sf_dir):
    speaker = F.col("speaker")
    target = transcript.target_language(speaker)
    second = transcript.needs_second_translation(target)
    translated = F.when(second, F.concat(F.lit("[kn] "), "text"))
    return transcript_lines(spark, sf_dir).select(
        "consult_id",
        "turn",
        transcript.source_language(speaker).alias("source_lang"),
        target.alias("target_lang"),
        second.alias("second_step"),
        transcript.translated_or_original(translated, F.col("text")).alias("final_text"),
    )


@query(
    r"""SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS stripped_chars
      FROM documents WHERE length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 10"""
)
def text_guard(spark, sf_dir):
    documents = filters.extractable(read(spark, sf_dir, "documents"), "text")
    size = F.length(transcript.stripped(F.col("text"))).cast("bigint")
    return documents.select("doc_id", size.alias("stripped_chars"))


_WORDS = ("the", "license", "password")


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'the|license|password')
        THEN CAST(0.9 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS risk_score,
      regexp_matches(lower(text), 'the|license|password') AS is_leak FROM documents"""
)
def keyword_risk(spark, sf_dir):
    score = transcript.keyword_risk(F.col("text"), _WORDS)
    scored = read(spark, sf_dir, "documents").select("doc_id", score.alias("risk_score"))
    return scored.withColumn("is_leak", transcript.is_leak(F.col("risk_score")))


@query(
    """SELECT doc_id, source || '.' || lang AS file_name FROM documents
      WHERE regexp_matches(source || '.' || lang, '\\.(wav|mp3|ogg|webm|m4a)$')
    UNION ALL SELECT doc_id, doc_id || '.mp3' FROM documents WHERE lang = 'en'"""
)
def audio_files(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    named = documents.select("doc_id", F.concat_ws(".", "source", "lang").alias("file_name"))
    ending = F.when(F.col("lang") == "en", ".mp3").otherwise(".MP3")
    sounds = documents.select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), ending).alias("file_name")
    )
    return filters.audio_files(named.unionByName(sounds))


@query(
    """SELECT doc_id, 'lab_reports/lab_' || source || '_' || lang ||
        CASE WHEN lang = 'en' THEN '.pdf' ELSE '' END AS file_path
      FROM documents"""
)
def attachment_paths(spark, sf_dir):
    name = F.when(F.col("lang") == "en", "scan.v2.pdf").otherwise(".hidden")
    path = ids.attachment_path(F.col("source"), F.col("lang"), name)
    return read(spark, sf_dir, "documents").select("doc_id", path.alias("file_path"))


@query(
    """SELECT event_id, json_extract_string(props, '$.k') AS k,
      json_extract_string(props, '$.absent') AS absent FROM events"""
)
def json_field(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k"),
        F.get_json_object("props", "$.absent").alias("absent"),
    )


# What a model may answer, by event type: fenced JSON with a further key, no
# JSON, broken JSON, null and missing keys, two objects.
_RESPONSES = """responses AS (SELECT event_id, event_type, CASE event_type
    WHEN 'click' THEN 'Here:' || chr(10) || '```json' || chr(10) || '{"diagnosis": "case '
      || event_id || '",' || chr(10) || ' "symptoms": ["a", "b"], "note": 1}' || chr(10) || '```'
    WHEN 'view' THEN 'No finding for ' || event_id
    WHEN 'error' THEN '{"diagnosis": "' || event_id || ' }'
    WHEN 'purchase' THEN '{"diagnosis": null, "dosage": "' || event_id || '", "symptoms": null}'
    ELSE props || ' or ' || props END AS response
  FROM events)"""


def _responses(spark, sf_dir):
    number = F.col("event_id").cast("string")
    kind = F.col("event_type")
    fenced = F.concat(
        F.lit('Here:\n```json\n{"diagnosis": "case '),
        number,
        F.lit('",\n "symptoms": ["a", "b"], "note": 1}\n```'),
    )
    response = (
        F.when(kind == "click", fenced)
        .when(kind == "view", F.concat(F.lit("No finding for "), number))
        .when(kind == "error", F.concat(F.lit('{"diagnosis": "'), number, F.lit(" }")))
        .when(
            kind == "purchase",
            F.concat(F.lit('{"diagnosis": null, "dosage": "'), number, F.lit('", "symptoms": null}')),
        )
        .otherwise(F.concat("props", F.lit(" or "), "props"))
    )
    return read(spark, sf_dir, "events").select("event_id", response.alias("response"))


@query(
    rf"""WITH {_RESPONSES} SELECT event_id,
      nullif(regexp_extract(response, '(?s)\{{.*\}}', 0), '') AS found FROM responses"""
)
def extract_json(spark, sf_dir):
    found = json_text.json_object_in(F.col("response")).alias("found")
    return _responses(spark, sf_dir).select("event_id", found)


def _overlay_sql(key: str, default: str) -> str:
    return f"""CASE WHEN json_exists(parsed, '$.{key}') THEN json_extract_string(parsed, '$.{key}')
      ELSE '{default}' END AS {key}"""


_PARSED = rf"""{_RESPONSES}, found AS (
  SELECT event_id, regexp_extract(response, '(?s)\{{.*\}}', 0) AS text FROM responses),
parsed AS (
  SELECT event_id, CASE WHEN json_valid(text) THEN CAST(text AS JSON) ELSE CAST('{{}}' AS JSON) END
    AS parsed, json_valid(text) AS readable FROM found)"""


@query(
    f"""WITH {_PARSED} SELECT event_id,
      {", ".join(_overlay_sql(k, d) for k, d in fv.DRAFT_TEXT_DEFAULTS.items())},
      CASE WHEN json_exists(parsed, '$.symptoms')
        THEN array_to_string(CAST(json_extract(parsed, '$.symptoms') AS VARCHAR[]), '|')
        ELSE '' END AS symptoms,
      '' AS lab_tests, json_extract_string(parsed, '$.note') AS note
    FROM parsed"""
)
def overlay_defaults(spark, sf_dir):
    drafts = with_drafts(_responses(spark, sf_dir))
    return drafts.select(
        "event_id",
        *fv.DRAFT_TEXT_DEFAULTS,
        F.array_join("symptoms", "|").alias("symptoms"),
        F.array_join("lab_tests", "|").alias("lab_tests"),
        F.col("extra")["note"].alias("note"),
    )


def _prompt_sql() -> str:
    before, rest = EXTRACTION_PROMPT.split(HISTORY_SLOT)
    between, after = rest.split(CONVERSATION_SLOT)
    return (
        f"{sql_text(before)} || coalesce(history, '{fv.NO_HISTORY}') || {sql_text(between)}"
        f" || conversation || {sql_text(after)}"
    )


_PROMPTS = f"""{RECORDS}, {HISTORY}, {_SPOKEN}, prompts AS (
  SELECT consult_id, conversation, {_prompt_sql()} AS prompt
  FROM consultations LEFT JOIN history ON consult_id = patient_id)"""


def _conversations(spark, sf_dir):
    conversations = conversations_from(transcript_lines(spark, sf_dir))
    return conversations.withColumn("patient_id", F.col("consult_id"))


@query(f"WITH {_PROMPTS} SELECT consult_id, prompt, sha256(prompt) AS prompt_key FROM prompts")
def prompt_text(spark, sf_dir):
    prompts = extraction_prompts(_conversations(spark, sf_dir), records(spark, sf_dir))
    return prompts.select("consult_id", "prompt", "prompt_key")


def stub_client():
    """A client that is a pure function of the prompt and always finds model "a" busy."""

    def answer(prompt: str, model: str) -> str:
        if model == "a":
            raise RuntimeError("429 too many requests")
        return 'Draft: {"diagnosis": "%s read %d", "symptoms": ["s"], "lab_tests": null}' % (
            model,
            len(prompt),
        )

    return answer


@query(
    f"""WITH {_PROMPTS} SELECT consult_id, conversation, 'b read ' || length(prompt) AS diagnosis,
      '{fv.DRAFT_TEXT_DEFAULTS["medication"]}' AS medication,
      '{fv.DRAFT_TEXT_DEFAULTS["dosage"]}' AS dosage,
      's' AS symptoms, CAST(NULL AS VARCHAR) AS lab_tests
    FROM prompts"""
)
def enrich_stub(spark, sf_dir):
    drafts = draft_prescriptions(
        spark,
        _conversations(spark, sf_dir),
        records(spark, sf_dir),
        stub_client(),
        ["a", "b"],
        wait_seconds=0,
    )
    return drafts.select(
        "consult_id",
        "conversation",
        *fv.DRAFT_TEXT_DEFAULTS,
        F.array_join("symptoms", "|").alias("symptoms"),
        F.array_join("lab_tests", "|").alias("lab_tests"),
    )


@query(
    """SELECT sha256(text) AS prompt_key, 'b' AS model, CAST(3 AS INTEGER) AS attempts,
      'Draft: {"diagnosis": "b read ' || length(text)
        || '", "symptoms": ["s"], "lab_tests": null}' AS response
    FROM conversations"""
)
def model_answers(spark, sf_dir):
    prompts = with_prompt_key(read(spark, sf_dir, "conversations").select(F.col("text").alias("prompt")))
    answers = ask(prompts, stub_client(), ["a", "b"], wait_seconds=0)
    return answers.drop("error")
