"""For each registered query the equivalent SQL over the same parquet tables."""

from __future__ import annotations

from string import Formatter

from workloads.queries import LISTED_IDS, ONE_KEY

# The white space that text is stripped of, by code point.
MARKS = [*range(9, 14), *range(28, 33), 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
WS = " || ".join(f"chr({mark})" for mark in MARKS)
NL = "chr(10)"


# What the prompts have to say, stated here once more.
DISTIL = """Input document:
---
{text}
---
Output: bullet points, at most one line each. One point per thing the document names, with its \
fields; one per link between two things, with how many of each; one per condition. Leave out \
everything else."""
GENERATE = """Input document:
---
{text}
---
Output: PlantUML source of its class diagram. First line: @startuml. Last line: @enduml. No other text."""
SIMILARITY = """Input A, PlantUML source:
---
{script}
---
Input B, document:
---
{text}
---
Output: a JSON object, no other text, with the keys
extracted_description: string, what A models
similarity_score: number, 0 (A has nothing of B) to 100 (all of it)
discrepancies: strings, where A and B contradict
missing_elements: strings, in B only
additional_elements: strings, in A only"""
REGENERATE_ORIG = """Input A, document:
---
{text}
---
Input B, PlantUML source of its class diagram:
---
{script}
---
Input C, review of B:
---
{analysis}
---
Output: B with every point of C settled in favour of A. First line: @startuml. Last line: @enduml. \
No other text."""
REGENERATE_DIST = REGENERATE_ORIG.replace("Input A, document:", "Input A, bullet points of a document:")


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fill(template: str, **slots: str) -> str:
    """A template as a SQL concatenation."""
    pieces = []
    for literal, slot, _, _ in Formatter().parse(template):
        if literal:
            pieces.append(quoted(literal))
        if slot is not None:
            pieces.append(f"coalesce({slots[slot]}, '')")
    return "(" + " || ".join(pieces) + ")"


def strip(text: str) -> str:
    return f"trim({text}, {WS})"


def script(reply: str) -> str:
    return f"regexp_extract({reply}, '(?s)@startuml.*@enduml')"


MODELS = """models(pos, llm_provider, llm_model, api_id, fixed) AS (VALUES
    (0, 'pA', 'm0', 'api-m0', CAST(NULL AS DOUBLE)), (1, 'pA', 'm1', 'api-m1', NULL),
    (2, 'pA', 'm2', 'api-m2', 1.0), (3, 'pB', 'm3', 'api-m3', NULL), (4, 'pB', 'm4', 'api-m4', NULL))"""

CORPUS = """corpus AS (SELECT doc_id AS id, source AS srs_origin, lang || ' doc ' || doc_id AS srs_title,
    text AS srs_content FROM documents)"""

TRIPLES = """triples AS (SELECT doc_id AS id, source AS srs_origin,
    CASE WHEN n_chars >= 200 THEN lang END AS srs_title, text AS srs_content FROM documents)"""

ENTRIES = """last_entry AS (
    SELECT title, min(doc_id) AS pos, arg_max(text, doc_id) AS content, arg_max(source, doc_id) AS origin
    FROM (SELECT *, source || '/' || lang AS title FROM documents) GROUP BY title)"""

LOG = """run_log AS (
    SELECT event_id AS id, event_type,
        CASE WHEN event_id % 5 < 3 THEN 'pA' ELSE 'pB' END AS llm_provider,
        'm' || (event_id % 5) AS llm_model,
        CASE WHEN event_id % 5 = 2 THEN 1.0::DOUBLE ELSE (event_id % 2) * 0.5::DOUBLE END AS temperature,
        CASE WHEN value < 1 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS srs_id,
        CASE WHEN value < 2 THEN NULL ELSE 'requirements of ' || user_id || ': ' || props END
            AS original_srs_text,
        CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN ' ' ELSE props END AS distilled_srs_text,
        value AS similarity_score_orig_srs,
        CASE WHEN event_type = 'error' THEN NULL ELSE props END AS uml_image_data_orig_srs,
        '@startuml' || chr(10) || 'class U' || user_id || chr(10) || '@enduml' AS plantuml_script_orig_srs,
        'system ' || user_id AS extracted_uml_descr_orig_srs,
        'found ' || event_type AS similarity_descr_orig_srs,
        value * 0.5::DOUBLE AS similarity_score_dist_srs,
        event_type AS uml_image_data_dist_srs,
        '@startuml' || chr(10) || 'class D' || user_id || chr(10) || '@enduml' AS plantuml_script_dist_srs,
        'core ' || user_id AS extracted_uml_descr_dist_srs,
        props AS similarity_descr_dist_srs,
        ts AS created_at
    FROM events)"""

KEY = "srs_id, llm_provider, llm_model, temperature"
PAYLOAD = """original_srs_text, distilled_srs_text, plantuml_script_orig_srs, plantuml_script_dist_srs,
    similarity_descr_orig_srs, similarity_descr_dist_srs"""

RANKED = f"""ranked AS (
    SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY created_at DESC, id DESC) AS newest,
        count(*) OVER (PARTITION BY {KEY}) AS run_count
    FROM run_log WHERE srs_id IS NOT NULL)"""

KEYS = f"""wanted AS (
    SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS srs_id, llm_provider, llm_model,
        coalesce(fixed, 0.5::DOUBLE) AS temperature, api_id
    FROM customer CROSS JOIN models)"""

REPORT = """'{"extracted_description":"In ' || lang || ' from ' || source || '","similarity_score":'
    || (n_chars % 101) || ',"discrepancies":["- ' || lang || '","- ' || source
    || '"],"missing_elements":[],"additional_elements":["' || n_chars || ' characters"]}'"""


def similarity_reply(shape: str) -> str:
    return f"""CASE {shape}
        WHEN 0 THEN '```json' || {NL} || {REPORT} || {NL} || '```'
        WHEN 1 THEN {REPORT}
        WHEN 2 THEN '```' || {NL} || {REPORT} || {NL} || '```'
        WHEN 3 THEN {REPORT} || ' Hope this helps.'
        WHEN 4 THEN '{{}}'
        WHEN 5 THEN '[Error] no key for ' || source
        WHEN 6 THEN '{{"similarity_score":"' || n_chars || '"}}'
        WHEN 7 THEN '{{"discrepancies":"' || lang || '"}}'
        WHEN 8 THEN '{{"discrepancies":null,"missing_elements":["' || source || '"]}}' || {NL} || '```'
        ELSE '[' || {REPORT} || ']' END"""


REPLIES = f"""replies AS (
    SELECT doc_id AS id, text, {similarity_reply("doc_id % 10")} AS reply,
        CASE doc_id % 5
            WHEN 0 THEN 'Here:' || {NL} || '@startuml' || {NL} || text || {NL} || '@enduml' || {NL} || 'bye'
            WHEN 1 THEN '@startuml' || {NL} || 'A' || {NL} || '@enduml' || {NL} || 'then' || {NL}
                || '@startuml' || {NL} || text || {NL} || '@enduml'
            WHEN 2 THEN '@enduml ' || text || ' @startuml'
            WHEN 3 THEN {NL} || '  @startuml' || {NL} || text
            ELSE text END AS script_reply
    FROM documents)"""


def unfenced(reply: str) -> str:
    opened = (
        f"(CASE WHEN starts_with({reply}, '```json') THEN {strip(f'substr({reply}, 8)')} ELSE {reply} END)"
    )
    return (
        f"(CASE WHEN ends_with({opened}, '```') THEN {strip(f'left({opened}, length({opened}) - 3)')} "
        f"ELSE {opened} END)"
    )


def report_columns(reply: str, suffix: str = "") -> str:
    """ok, description, score, the three lists as text, and the analysis of a reply column."""
    body = f"TRY_CAST({unfenced(reply)} AS JSON)"

    def section(name: str) -> str:
        return f"array_to_string(coalesce(json_extract_string({body}, '$.{name}[*]'), []), {NL})"

    lists = " AND ".join(
        f"coalesce(json_type({body}, '$.{name}'), 'NULL') IN ('ARRAY', 'NULL')"
        for name in ("discrepancies", "missing_elements", "additional_elements")
    )
    return f"""coalesce(json_type({body}) = 'OBJECT' AND {lists}, false) AS ok{suffix},
        coalesce(json_extract_string({body}, '$.extracted_description'), '') AS description{suffix},
        TRY_CAST(json_extract_string({body}, '$.similarity_score') AS DOUBLE) AS score{suffix},
        {section('discrepancies')} AS discrepancies{suffix},
        {section('missing_elements')} AS missing_elements{suffix},
        {section('additional_elements')} AS additional_elements{suffix}"""


def analysis(suffix: str = "") -> str:
    return (
        f"'discrepancies:' || {NL} || discrepancies{suffix} || {NL} || {NL} || 'missing_elements:' || {NL} "
        f"|| missing_elements{suffix} || {NL} || {NL} || 'additional_elements:' || {NL} "
        f"|| additional_elements{suffix}"
    )


PARSED = f"{REPLIES}, parsed AS (SELECT id, reply, {report_columns('reply')} FROM replies)"
FAILED = "(starts_with({0}, '[Error]') OR starts_with({0}, 'Error processing '))"


def failed(reply: str) -> str:
    return FAILED.format(reply)


SHAPE = "(doc_id + CAST(substr(llm_model, 2) AS BIGINT))"

# The five recorded replies of every run, then scripts, reports and states.
RUNS = f"""{MODELS}, asked AS (
    SELECT doc_id || '_' || lang || 'doc' || doc_id AS srs_id, llm_provider, llm_model,
        coalesce(fixed, 0.5::DOUBLE) AS temperature, doc_id, lang, source, n_chars,
        text AS original_srs_text, CAST(substr(llm_model, 2) AS BIGINT) AS m
    FROM documents CROSS JOIN models),
replied AS (
    SELECT *,
        CASE WHEN doc_id % 17 = m THEN 'no diagram'
            ELSE 'ok @startuml' || {NL} || 'class C' || doc_id || {NL} || '@enduml ' || llm_model END AS gen_orig,
        CASE WHEN doc_id % 19 = m THEN '[Error] busy' WHEN doc_id % 23 = m THEN ' ' || {NL}
            ELSE 'short: ' || original_srs_text END AS dist_reply,
        {similarity_reply(f"{SHAPE} % 10")} AS sim_orig,
        '@startuml' || {NL} || 'class S' || doc_id || {NL} || '@enduml' AS gen_dist,
        CASE WHEN doc_id % 29 = m THEN NULL ELSE {similarity_reply(f"({SHAPE} + 4) % 10")} END AS sim_dist
    FROM asked),
scripted AS (
    SELECT *, CASE WHEN {failed('dist_reply')} THEN NULL ELSE dist_reply END AS distilled_srs_text,
        {script('gen_orig')} AS script_orig, {script('gen_dist')} AS script_dist,
        {report_columns('sim_orig', '_o')}, {report_columns("coalesce(sim_dist, '')", '_d')}
    FROM replied),
runs AS (
    SELECT *,
        CASE WHEN script_orig = '' THEN 'no_script' WHEN {failed('sim_orig')} THEN 'failed_response'
            WHEN NOT ok_o THEN 'rejected_report' ELSE 'ok' END AS state_orig,
        CASE WHEN distilled_srs_text IS NULL THEN 'failed_response'
            WHEN {strip('distilled_srs_text')} = '' THEN 'blank_text'
            WHEN sim_dist IS NULL THEN 'pending' WHEN {failed('sim_dist')} THEN 'failed_response'
            WHEN NOT ok_d THEN 'rejected_report' ELSE 'ok' END AS state_dist
    FROM scripted)"""

CALL = "'pA' AS llm_provider, 'm0' AS llm_model, 0.5::DOUBLE AS temperature"

WORK = f"""WITH {MODELS}, {LOG}, {RANKED}, {KEYS}, work AS (
    SELECT w.*, r.run_count, r.id, {PAYLOAD}
    FROM wanted w JOIN ranked r USING ({KEY}) WHERE newest = 1 AND original_srs_text IS NOT NULL)"""


def side_by_side(left: str, right: str, how: str) -> str:
    shown = ["similarity_score_orig_srs", "uml_image_data_orig_srs", "similarity_descr_orig_srs",
             "similarity_score_dist_srs", "uml_image_data_dist_srs", "similarity_descr_dist_srs"]
    columns = ", ".join(f"{side}.{name} AS {name}_{word}" for side, word in (("l", "left"), ("r", "right")) for name in shown)
    return f"""WITH {LOG}, newest AS (
        SELECT *, row_number() OVER (PARTITION BY {KEY}, event_type ORDER BY created_at DESC, id DESC) AS rn
        FROM run_log WHERE srs_id IS NOT NULL),
        l AS (SELECT * FROM newest WHERE rn = 1 AND event_type = '{left}'),
        r AS (SELECT * FROM newest WHERE rn = 1 AND event_type = '{right}')
        SELECT {KEY}, l.id AS id_left, r.id AS id_right, {columns} FROM l {how} JOIN r USING ({KEY})"""


def facets(ids: str) -> str:
    parts = [("llm_provider", "llm_provider", "NULL"), ("llm_model", "llm_model", "NULL"),
             ("temperature", "CAST(temperature AS VARCHAR)", "temperature"), ("event_type", "event_type", "NULL")]
    selects = " UNION ".join(
        f"SELECT srs_id, '{name}' AS facet, {value} AS value, CAST({number} AS DOUBLE) AS number "
        f"FROM run_log WHERE srs_id IS NOT NULL {ids}"
        for name, value, number in parts
    )
    return f"WITH {LOG} {selects}"


INSERTED = """SELECT min(id) AS id, srs_origin, srs_title, srs_content FROM triples
    WHERE srs_title IS NOT NULL {0} GROUP BY srs_origin, srs_title, srs_content
    UNION ALL SELECT id, srs_origin, srs_title, srs_content FROM triples WHERE srs_title IS NULL"""

# What the stand-in for a model client answers to the five prompts of each run.
COMPLETED = f"""WITH {MODELS}, one AS (
        SELECT doc_id || '_' || lang || 'doc' || doc_id AS srs_id, llm_provider, llm_model,
            coalesce(fixed, 0.5::DOUBLE) AS temperature, text,
            api_id || ' ' || CASE WHEN fixed IS NULL THEN '0.5' ELSE '1.0' END || ' '
                || md5({strip(fill(DISTIL, text='text'))}) AS short,
            '@startuml' || {NL} || ''' ' || md5({fill(GENERATE, text='text')}) || {NL} || '@enduml' AS script_orig
        FROM documents CROSS JOIN models {{}}),
    two AS (SELECT *, {fill(SIMILARITY, script='script_orig', text='text')} AS check_orig,
            '@startuml' || {NL} || ''' ' || md5({fill(GENERATE, text='short')}) || {NL} || '@enduml'
                AS script_dist FROM one),
    three AS (SELECT *, {fill(SIMILARITY, script='script_dist', text='short')} AS check_dist FROM two)"""


def said(prompt: str) -> str:
    return (
        f"('{{\"similarity_score\": ' || length({prompt}) || ', \"discrepancies\": [\"' || md5({prompt}) || '\"]}}')"
    )


SQL: dict[str, str] = {
    "corpus_scan": f"WITH {CORPUS} SELECT * FROM corpus",
    "corpus_by_ids": f"""WITH {CORPUS} SELECT id, srs_title, srs_content FROM corpus
        WHERE id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
    "corpus_by_id_list": f"""WITH {CORPUS} SELECT id, srs_title, srs_content FROM corpus
        WHERE id IN ({', '.join(map(str, LISTED_IDS))})""",
    "corpus_by_ids_empty": "SELECT 'batch' AS rule, count(*) AS documents FROM documents",
    "corpus_for_batch": f"WITH {CORPUS} SELECT id, srs_title, srs_content FROM corpus",
    "corpus_from_entries": f"""WITH {ENTRIES} SELECT pos, origin AS srs_origin, title AS srs_title,
        content AS srs_content FROM last_entry""",
    "insert_if_absent": f"""WITH {TRIPLES},
        stored AS (SELECT * FROM triples WHERE id IN (SELECT doc_id FROM labels)) """
    + INSERTED.format(
        """AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.srs_origin = triples.srs_origin
        AND s.srs_title = triples.srs_title AND s.srs_content = triples.srs_content)"""
    ),
    "insert_skipped": f"""WITH {TRIPLES}, numbered AS (
        SELECT *, row_number() OVER (PARTITION BY srs_origin, srs_title, srs_content ORDER BY id) AS copy,
            bool_or(id IN (SELECT doc_id FROM labels)) OVER (
                PARTITION BY srs_origin, srs_title, srs_content) AS present FROM triples)
        SELECT id, srs_origin, srs_title FROM numbered
        WHERE srs_title IS NOT NULL AND (copy > 1 OR present)""",
    "import_corpus": f"""WITH {ENTRIES} SELECT row_number() OVER (ORDER BY pos) AS id, origin AS srs_origin,
        title AS srs_title, content AS srs_content FROM last_entry""",
    "import_repeated_positions": """WITH entries AS (
        SELECT source || '/' || lang AS title, CASE WHEN doc_id % 7 > 0 THEN doc_id % 50 END AS pos, text, source
        FROM documents),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY title
            ORDER BY pos DESC NULLS LAST, text DESC NULLS LAST, source DESC NULLS LAST) AS newest FROM entries),
        places AS (SELECT title, CASE WHEN count(*) = count(pos) THEN min(pos) END AS place
            FROM entries GROUP BY title)
        SELECT row_number() OVER (ORDER BY place NULLS FIRST, title) AS id, source AS srs_origin,
            title AS srs_title, text AS srs_content
        FROM ranked JOIN places USING (title) WHERE newest = 1""",
    "artifact_keys": "SELECT doc_id AS id, doc_id || '_' || lang || 'doc' || doc_id AS srs_id FROM documents",
    "run_log_append": f"""WITH {LOG}, batches AS (
        SELECT *, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS batch FROM run_log)
        SELECT row_number() OVER (ORDER BY batch, id) AS id, srs_id, event_type, llm_provider, llm_model,
            temperature, original_srs_text, similarity_score_orig_srs,
            strlen(uml_image_data_orig_srs) AS image_bytes FROM batches""",
    "append_repeated_ids": f"""WITH {LOG}, counted AS (
        SELECT srs_id, CAST(srs_id AS BIGINT) AS place, count(*) AS rows FROM run_log GROUP BY ALL),
        placed AS (SELECT *, CAST(sum(rows) OVER (ORDER BY place NULLS FIRST) AS BIGINT) AS last_id FROM counted)
        SELECT srs_id, last_id - rows + 1 AS first_id, last_id, rows, rows AS ids FROM placed""",
    "latest_run": f"""WITH {MODELS}, {LOG}, {RANKED}, {KEYS}
        SELECT {KEY}, coalesce(run_count, 0) AS run_count, id, {PAYLOAD}
        FROM wanted LEFT JOIN (SELECT * FROM ranked WHERE newest = 1) r USING ({KEY})""",
    "latest_run_by_rank": f"WITH {LOG}, {RANKED} SELECT {KEY}, id, {PAYLOAD} FROM ranked WHERE newest = 1",
    "latest_of_one_key": f"""WITH {LOG} SELECT id, {KEY}, original_srs_text FROM run_log
        WHERE ({KEY}) = {ONE_KEY} ORDER BY created_at DESC, id DESC LIMIT 1""",
    "rows_of_one_key": f"""WITH {LOG} SELECT id, event_type, similarity_score_orig_srs FROM run_log
        WHERE ({KEY}) = {ONE_KEY}""",
    "run_counts": f"""WITH {LOG} SELECT {KEY}, count(*) AS run_count, arg_max(id, (created_at, id)) AS id
        FROM run_log WHERE srs_id IS NOT NULL GROUP BY {KEY}""",
    "iteration_label": f"""WITH {LOG}, numbered AS (
        SELECT {KEY}, id, row_number() OVER (PARTITION BY {KEY} ORDER BY created_at, id) - 1 AS earlier_runs
        FROM run_log WHERE srs_id IS NOT NULL)
        SELECT *, CASE WHEN earlier_runs = 0 THEN 'FIRST_PASS'
            ELSE 'BACKFEED_IMPROVEMENT_' || earlier_runs END AS label FROM numbered""",
    "distinct_ids": f"WITH {LOG} SELECT DISTINCT srs_id FROM run_log",
    "facets": facets(""),
    "facets_of_ids": facets("AND srs_id IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)"),
    "side_by_side": side_by_side("signup", "purchase", "INNER"),
    "side_by_side_full": side_by_side("view", "click", "FULL"),
    "flows_long": f"""WITH {LOG} SELECT id, 'orig' AS flow, original_srs_text AS text,
            plantuml_script_orig_srs AS script, similarity_score_orig_srs AS score,
            extracted_uml_descr_orig_srs AS description, similarity_descr_orig_srs AS analysis,
            uml_image_data_orig_srs AS image FROM run_log
        UNION ALL SELECT id, 'dist', distilled_srs_text, plantuml_script_dist_srs, similarity_score_dist_srs,
            extracted_uml_descr_dist_srs, similarity_descr_dist_srs, uml_image_data_dist_srs FROM run_log""",
    "flows_wide": f"""WITH {LOG} SELECT id, {PAYLOAD}, similarity_score_orig_srs, similarity_score_dist_srs,
        extracted_uml_descr_orig_srs, extracted_uml_descr_dist_srs, uml_image_data_orig_srs,
        uml_image_data_dist_srs FROM run_log""",
    "image_lookup": """WITH images AS (
        SELECT d.doc_id AS id, CASE WHEN coalesce(l.toxic, 0) = 0 THEN d.text END AS image
        FROM documents d LEFT JOIN labels l USING (doc_id))
        SELECT c.c_custkey AS id, CASE WHEN i.id IS NULL THEN 'not_found' WHEN image IS NULL
            THEN 'null_image' ELSE 'ok' END AS status, strlen(image) AS n_bytes, md5(image) AS image_md5
        FROM customer c LEFT JOIN images i ON i.id = c.c_custkey""",
    "accept_split": f"""WITH {LOG}, {RANKED} SELECT {KEY}, run_count, id, similarity_score_orig_srs,
        CASE WHEN run_count > 1 AND similarity_score_orig_srs >= 20 THEN 'accept' ELSE 'backfeed' END AS verdict
        FROM ranked WHERE newest = 1""",
    "request_fanout": f"""WITH {MODELS} SELECT doc_id || '_' || lang || 'doc' || doc_id AS srs_id,
        llm_provider, llm_model, coalesce(fixed, 0.5::DOUBLE) AS temperature, api_id, text AS original_srs_text
        FROM documents CROSS JOIN models WHERE {strip('text')} <> ''""",
    "models_of_providers": f"""WITH {MODELS}, {LOG} SELECT m.llm_provider AS provider, m.llm_model AS model,
        m.api_id, m.fixed AS fixed_temperature, count(l.id) AS runs
        FROM models m LEFT JOIN run_log l USING (llm_provider, llm_model) WHERE m.llm_provider = 'pA'
        GROUP BY ALL""",
    "catalog_lookup": f"""WITH {MODELS}, asked AS (
        SELECT event_id, CASE WHEN event_type = 'error' THEN 'pX' WHEN event_id % 5 < 3 THEN 'pA' ELSE 'pB' END
            AS llm_provider, CASE WHEN event_type = 'view' THEN 'm9' ELSE 'm' || (event_id % 5) END AS llm_model
        FROM events)
        SELECT event_id, llm_provider, llm_model, api_id,
            CASE WHEN llm_provider = 'pX' THEN 'unknown_provider' WHEN api_id IS NULL THEN 'unknown_model'
                ELSE 'ok' END AS lookup_status,
            CASE WHEN llm_provider = 'pX' THEN '[Error] Unknown provider: pX'
                WHEN api_id IS NULL THEN 'Error processing ' || llm_provider || ' request: ''' || llm_model || ''''
                END AS lookup_error
        FROM asked LEFT JOIN models USING (llm_provider, llm_model)""",
    "effective_temperature": f"WITH {LOG} SELECT id, llm_provider, llm_model, temperature FROM run_log",
    "prompt_distil": f"""SELECT doc_id AS id, {strip(fill(DISTIL, text='text'))} AS prompt
        FROM documents""",
    "prompt_generate": f"""SELECT doc_id AS id, {fill(GENERATE, text='text')} AS prompt
        FROM documents WHERE {strip('text')} <> ''""",
    "prompt_similarity": f"""WITH {REPLIES} SELECT id,
        {fill(SIMILARITY, script='script_reply', text='text')} AS prompt FROM replies""",
    "prompt_regenerate": f"""WITH {LOG} SELECT id,
        {fill(REGENERATE_ORIG, text='original_srs_text', script='plantuml_script_orig_srs',
              analysis='similarity_descr_orig_srs')} AS prompt_orig,
        {fill(REGENERATE_DIST, text='distilled_srs_text', script='plantuml_script_dist_srs',
              analysis='similarity_descr_dist_srs')} AS prompt_dist FROM run_log""",
    "strip_text": "SELECT doc_id AS id, text AS stripped FROM documents",
    "unfence_text": f"WITH {REPLIES} SELECT id, {unfenced('reply')} AS body FROM replies",
    "extract_script": f"WITH {REPLIES} SELECT id, {script('script_reply')} AS script FROM replies",
    "wrap_script": f"""WITH {REPLIES} SELECT id, CASE WHEN starts_with({strip('script_reply')}, '@startuml')
        THEN script_reply ELSE '@startuml' || {NL} || script_reply || {NL} || '@enduml' END AS script
        FROM replies""",
    "reply_status": f"""WITH {REPLIES} SELECT id, CASE WHEN {failed('reply')} THEN 'error' ELSE 'ok' END
        AS status FROM replies""",
    "report_parse": f"""WITH {PARSED} SELECT id, description, score, discrepancies, missing_elements,
        additional_elements FROM parsed WHERE ok""",
    "report_text": f"WITH {PARSED} SELECT id, {analysis()} AS analysis FROM parsed WHERE ok",
    "report_rejects": f"""WITH {PARSED} SELECT id, reply, CASE WHEN {failed('reply')} THEN 'error' ELSE 'ok' END
        AS status FROM parsed WHERE NOT ok""",
    "scoring_ready": f"""WITH {REPLIES} SELECT id, CASE WHEN text <> '' AND {script('script_reply')} <> ''
        THEN 'ready' ELSE 'not ready' END AS state FROM replies""",
    "event_tags": """SELECT conv_id, turn, CASE
        WHEN role = 'user' AND turn < 2 THEN 'ALL_IN_ONE_ORIG_SRS'
        WHEN role = 'user' AND turn < 6 THEN 'ALL_IN_ONE_DIST_SRS'
        WHEN role = 'assistant' AND turn < 2 THEN 'CHECK_SIMILARITY_ORIG'
        WHEN role = 'assistant' AND turn < 6 THEN 'CHECK_SIMILARITY_DIST'
        WHEN role NOT IN ('user', 'assistant') AND turn < 2 THEN 'DISTILL_SRS' END AS event_type
        FROM conversations""",
    "response_text": """SELECT conv_id AS request_id, string_agg(text, '' ORDER BY turn) AS response
        FROM conversations GROUP BY conv_id""",
    "chunk_running": """WITH shown AS (SELECT conv_id AS request_id, turn AS seq,
        string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running
        FROM conversations WHERE text <> '')
        SELECT request_id, seq, length(running) AS n_chars, md5(running) AS digest FROM shown""",
    "chunk_offsets": """SELECT conv_id AS request_id, turn AS seq, CAST(sum(length(text)) OVER (
            PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT)
            AS end_at FROM conversations""",
    "chat_history": """WITH numbered AS (SELECT *, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (
            PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS pair
            FROM conversations)
        SELECT conv_id, pair, max(text) FILTER (role = 'user') AS "user",
            coalesce(arg_max(text, turn) FILTER (role = 'assistant'), '') AS assistant
        FROM numbered WHERE pair > 0 GROUP BY conv_id, pair""",
    "match_responses": f"""WITH answers AS (
        SELECT conv_id, string_agg(text, '' ORDER BY turn) AS response FROM conversations GROUP BY conv_id)
        SELECT doc_id AS request_id, lang AS stage, response, CASE WHEN response IS NULL THEN 'pending'
            WHEN {failed('response')} THEN 'error' ELSE 'ok' END AS response_status
        FROM documents LEFT JOIN answers ON conv_id = doc_id""",
    "first_pass_log": f"""WITH {RUNS} SELECT 'FIRST_PASS' AS event_type, {KEY}, original_srs_text,
        distilled_srs_text, score_o AS similarity_score_orig_srs, script_orig AS plantuml_script_orig_srs,
        description_o AS extracted_uml_descr_orig_srs, {analysis('_o')} AS similarity_descr_orig_srs,
        score_d AS similarity_score_dist_srs, script_dist AS plantuml_script_dist_srs,
        description_d AS extracted_uml_descr_dist_srs, {analysis('_d')} AS similarity_descr_dist_srs
        FROM runs WHERE state_orig = 'ok' AND state_dist = 'ok'""",
    "first_pass_states": f"""WITH {RUNS} SELECT srs_id, llm_provider, llm_model, state_orig, state_dist
        FROM runs""",
    "first_pass_rejects": f"""WITH {RUNS} SELECT srs_id, llm_provider, llm_model,
        sim_orig AS reply_similarity_orig, sim_dist AS reply_similarity_dist
        FROM runs WHERE NOT (state_orig = 'ok' AND state_dist = 'ok')""",
    "first_pass_chat": f"""WITH {RUNS} SELECT srs_id, llm_model, 0::BIGINT AS pair, original_srs_text AS "user",
            gen_orig AS assistant FROM runs
        UNION ALL SELECT srs_id, llm_model, 1, distilled_srs_text, gen_dist FROM runs
            WHERE coalesce({strip('distilled_srs_text')}, '') <> ''""",
    "batch_summary": f"""WITH {RUNS} SELECT srs_id, llm_provider AS provider, llm_model AS model, script_orig,
        sim_orig AS similarity_orig, distilled_srs_text AS distilled_text, script_dist,
        sim_dist AS similarity_dist FROM runs""",
    "generate_only": f"""WITH {REPLIES} SELECT 'ALL_IN_ONE_ORIG_SRS' AS event_type, {CALL},
            text AS original_srs_text, NULL AS distilled_srs_text,
            {script('script_reply')} AS plantuml_script_orig_srs, NULL AS plantuml_script_dist_srs FROM replies
        UNION ALL SELECT 'ALL_IN_ONE_DIST_SRS', {CALL}, NULL, text, NULL, {script('script_reply')} FROM replies""",
    "distil_only": f"""WITH {REPLIES} SELECT 'DISTILL_SRS' AS event_type, {CALL}, text AS original_srs_text,
        reply AS distilled_srs_text, CAST(NULL AS VARCHAR) AS srs_id FROM replies""",
    "similarity_only": f"""WITH {REPLIES} SELECT 'CHECK_SIMILARITY_DIST' AS event_type,
        0.5::DOUBLE AS temperature, text AS distilled_srs_text,
        {script('script_reply')} AS plantuml_script_dist_srs, reply AS similarity_descr_dist_srs,
        CAST(NULL AS VARCHAR) AS similarity_descr_orig_srs
        FROM replies WHERE text <> '' AND {script('script_reply')} <> ''""",
    "render_only": f"""WITH {REPLIES} SELECT 'GENERATE_UML_ORIG' AS event_type,
        CAST(NULL AS VARCHAR) AS llm_provider, {script('script_reply')} AS plantuml_script_orig_srs,
        md5(reply) AS image_md5 FROM replies WHERE {strip(script('script_reply'))} <> ''""",
    "backfeed_work": f"{WORK} SELECT {KEY}, run_count, id, {PAYLOAD}, api_id, 'ok' AS lookup_status FROM work",
    "backfeed_results": f"""{WORK} SELECT {KEY}, 'BACKFEED_IMPROVEMENT_' || run_count AS event_type,
        original_srs_text, distilled_srs_text,
        '@startuml' || {NL} || 'class N' || srs_id || {NL} || '@enduml' AS plantuml_script_orig_srs,
        '@startuml' || {NL} || 'class P' || srs_id || {NL} || '@enduml' AS plantuml_script_dist_srs,
        CAST(srs_id AS DOUBLE) AS similarity_score_orig_srs,
        'discrepancies:' || {NL} || {NL} || {NL} || 'missing_elements:' || {NL} || {NL} || {NL}
            || 'additional_elements:' || {NL} AS similarity_descr_orig_srs,
        'discrepancies:' || {NL} || CASE WHEN llm_model = 'm4' THEN '' ELSE srs_id END || {NL} || {NL}
            || 'missing_elements:' || {NL} || {NL} || {NL} || 'additional_elements:' || {NL}
            AS similarity_descr_dist_srs,
        'ok' AS state_orig,
        CASE WHEN coalesce({strip('distilled_srs_text')}, '') = '' THEN 'blank_text'
            WHEN llm_model = 'm4' THEN 'rejected_report' ELSE 'ok' END AS state_dist
        FROM work""",
    "completion_map": f"""WITH {MODELS} SELECT doc_id || '_' || lang || 'doc' || doc_id AS srs_id, llm_model,
        api_id || ' ' || CASE WHEN fixed IS NULL THEN '0.5' ELSE '1.0' END || ' '
            || md5({strip(fill(DISTIL, text='text'))}) AS response
        FROM documents CROSS JOIN models""",
    "first_pass_completed": f"""{COMPLETED.format('')}
        SELECT {KEY}, script_orig AS plantuml_script_orig_srs, short AS distilled_srs_text,
            script_dist AS plantuml_script_dist_srs,
            CAST(length(check_orig) AS DOUBLE) AS similarity_score_orig_srs,
            CAST(length(check_dist) AS DOUBLE) AS similarity_score_dist_srs,
            'discrepancies:' || {NL} || md5(check_orig) || {NL} || {NL} || 'missing_elements:' || {NL} || {NL}
                || {NL} || 'additional_elements:' || {NL} AS similarity_descr_orig_srs,
            'ok' AS state_orig, 'ok' AS state_dist FROM three""",
    "stream_latest": """WITH log AS (
        SELECT event_id AS id, CAST(user_id AS VARCHAR) AS srs_id,
            CASE WHEN event_id % 5 < 3 THEN 'pA' ELSE 'pB' END AS llm_provider,
            'm' || (event_id % 5) AS llm_model, (event_id % 2) * 0.5::DOUBLE AS temperature, ts FROM events)
        SELECT srs_id, llm_provider, llm_model, temperature, count(*) AS run_count,
            arg_max(id, (ts, id)) AS id FROM log GROUP BY ALL""",
    "batch_of_ids": f"""{COMPLETED.format(f"WHERE doc_id IN ({', '.join(map(str, LISTED_IDS))})")}
        SELECT srs_id, llm_provider AS provider, llm_model AS model, script_orig,
            {said('check_orig')} AS similarity_orig, short AS distilled_text, script_dist,
            {said('check_dist')} AS similarity_dist FROM three""",
    "backfeed_completed": f"""{WORK}, one AS (SELECT *,
            coalesce({strip('distilled_srs_text')}, '') <> '' AS has_dist,
            '@startuml' || {NL} || ''' ' || md5({fill(REGENERATE_ORIG, text='original_srs_text',
                script='plantuml_script_orig_srs', analysis='similarity_descr_orig_srs')}) || {NL} || '@enduml' AS new_orig,
            '@startuml' || {NL} || ''' ' || md5({fill(REGENERATE_DIST, text='distilled_srs_text',
                script='plantuml_script_dist_srs', analysis='similarity_descr_dist_srs')}) || {NL} || '@enduml' AS new_dist
            FROM work),
        two AS (SELECT *, {fill(SIMILARITY, script='new_orig', text='original_srs_text')} AS check_orig FROM one)
        SELECT {KEY}, 'BACKFEED_IMPROVEMENT_' || run_count AS event_type, new_orig AS plantuml_script_orig_srs,
            CASE WHEN has_dist THEN new_dist ELSE '' END AS plantuml_script_dist_srs,
            CAST(length(check_orig) AS DOUBLE) AS similarity_score_orig_srs,
            'discrepancies:' || {NL} || md5(check_orig) || {NL} || {NL} || 'missing_elements:' || {NL} || {NL}
                || {NL} || 'additional_elements:' || {NL} AS similarity_descr_orig_srs,
            'ok' AS state_orig, CASE WHEN has_dist THEN 'ok' ELSE 'blank_text' END AS state_dist FROM two""",
}
SQL["stream_responses"] = SQL["response_text"]
SQL["stream_insert"] = SQL["insert_if_absent"]
SQL["stream_unseen"] = f"""WITH {TRIPLES}
    SELECT srs_origin, srs_title, srs_content FROM ({INSERTED.format('')})"""
SQL["retrieval_facets"] = facets("AND srs_id IN ('8', '11', 'nobody')")
SQL["retrieval_rows"] = SQL["rows_of_one_key"]
SQL["retrieval_compared"] = (
    side_by_side("click", "view", "FULL")
    + f" WHERE srs_id = '{ONE_KEY[0]}' AND llm_provider = '{ONE_KEY[1]}' AND llm_model = '{ONE_KEY[2]}'"
    f" AND temperature = {ONE_KEY[3]}"
)
SQL["stream_unseen_within"] = """SELECT DISTINCT CAST(user_id AS VARCHAR) AS srs_origin, event_type AS srs_title,
    CAST(CAST(trunc(value) AS BIGINT) AS VARCHAR) AS srs_content FROM events"""
SQL["chunk_offsets_sparse"] = f"SELECT request_id, seq * 5000 + 17 AS seq, end_at FROM ({SQL['chunk_offsets']})"
SQL["latest_run_bucketed"] = SQL["latest_run"]
SQL["latest_run_as_of"] = f"""WITH {LOG}, asked AS (
        SELECT event_id AS request_id, CASE WHEN value > 480 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS srs_id,
            CASE WHEN (event_id + 1) % 5 < 3 THEN 'pA' ELSE 'pB' END AS llm_provider,
            'm' || ((event_id + 1) % 5) AS llm_model,
            CASE WHEN (event_id + 1) % 5 = 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS temperature, ts AS at
        FROM events),
    newest AS (SELECT {KEY}, created_at, max(id) AS id FROM run_log WHERE srs_id IS NOT NULL GROUP BY ALL)
    SELECT a.request_id, a.srs_id, a.llm_provider, a.llm_model, a.temperature, n.id,
        r.original_srs_text, r.similarity_score_orig_srs
    FROM asked a ASOF LEFT JOIN newest n ON a.srs_id = n.srs_id AND a.llm_provider = n.llm_provider
        AND a.llm_model = n.llm_model AND a.temperature = n.temperature AND a.at >= n.created_at
    LEFT JOIN run_log r ON r.id = n.id"""

_NEW = {
    flow: f"""'@startuml' || {NL} || ''' ' || md5({fill(template, text=text, script=f'script_{flow}',
        analysis=f'analysis_{flow}')}) || {NL} || '@enduml'"""
    for flow, template, text in (("orig", REGENERATE_ORIG, "original_srs_text"), ("dist", REGENERATE_DIST, "distilled_srs_text"))
}


def _findings(check: str) -> str:
    return f"""'discrepancies:' || {NL} || md5({check}) || {NL} || {NL} || 'missing_elements:' || {NL} || {NL}
        || {NL} || 'additional_elements:' || {NL}"""


SQL["backfeed_until_accepted"] = f"""{WORK.replace('WITH ', 'WITH RECURSIVE ', 1)},
    rounds AS (
        SELECT {KEY}, original_srs_text, distilled_srs_text, plantuml_script_orig_srs AS script_orig,
            plantuml_script_dist_srs AS script_dist, similarity_descr_orig_srs AS analysis_orig,
            similarity_descr_dist_srs AS analysis_dist, CAST(NULL AS DOUBLE) AS score_dist, run_count, 0 AS rounds,
            coalesce({strip('original_srs_text')}, '') <> '' AND coalesce({strip('distilled_srs_text')}, '') <> '' AS told,
            false AS accepted
        FROM work
        UNION ALL
        SELECT {KEY}, original_srs_text, distilled_srs_text, script_orig, script_dist, {_findings('check_orig')},
            {_findings('check_dist')}, CAST(length(check_dist) AS DOUBLE), run_count + 1, rounds + 1, told,
            md5(check_orig) < '6'
        FROM (
            SELECT *, {fill(SIMILARITY, script='script_orig', text='original_srs_text')} AS check_orig,
                {fill(SIMILARITY, script='script_dist', text='distilled_srs_text')} AS check_dist
            FROM (SELECT * REPLACE ({_NEW['orig']} AS script_orig, {_NEW['dist']} AS script_dist) FROM rounds
                WHERE told AND NOT accepted AND rounds < 5)))
    SELECT {KEY}, rounds, CASE WHEN NOT told THEN 'no_text' WHEN accepted THEN 'accepted' ELSE 'open' END AS verdict,
        run_count, CASE WHEN rounds > 0 THEN 'BACKFEED_IMPROVEMENT_' || (run_count - 1) END AS event_type,
        script_orig AS plantuml_script_orig_srs, script_dist AS plantuml_script_dist_srs,
        analysis_orig AS similarity_descr_orig_srs, score_dist AS similarity_score_dist_srs
    FROM rounds QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY rounds DESC) = 1"""
SQL["stream_running"] = """WITH shown AS (SELECT conv_id AS request_id, turn AS seq,
        string_agg(text, '') OVER (PARTITION BY conv_id ORDER BY turn
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place,
        max(turn) OVER (PARTITION BY conv_id) AS last_turn FROM conversations)
    SELECT request_id, seq, length(running) AS end_at, md5(running) AS digest,
        CASE WHEN seq = last_turn THEN 'done' ELSE 'running' END AS state FROM shown WHERE place = seq"""
SQL["stream_matched"] = f"""WITH requests AS (
        SELECT event_id AS request_id, event_type AS stage, ts AS asked_at FROM events WHERE event_id % 2 = 0),
    replies AS (
        SELECT event_id - 1 AS request_id, CASE WHEN event_type = 'view' THEN '[Error] ' || props ELSE props END AS response,
            ts + to_minutes(CAST(trunc(value) AS INTEGER)) AS replied_at
        FROM events WHERE event_id % 2 = 1 AND event_type <> 'error')
    SELECT q.request_id, stage, response, CASE WHEN response IS NULL THEN 'pending'
        WHEN {failed('response')} THEN 'error' ELSE 'ok' END AS response_status
    FROM requests q LEFT JOIN replies r ON r.request_id = q.request_id AND replied_at >= asked_at
        AND replied_at <= asked_at + INTERVAL 30 MINUTE"""

_NOTED = f"""{REPLIES}, noted AS (SELECT id, CASE WHEN id % 3 = 0 THEN replace(replace(reply, '"similarity_score"',
        '"note":{{"by":["a"]}},"sure":true,"similarity_score"'), '"missing_elements":[]',
        '"missing_elements":[1.5,null,"x",[true]]') ELSE reply END AS reply FROM replies),
    checked AS (SELECT id, reply, TRY_CAST({unfenced('reply')} AS JSON) AS body, {report_columns('reply')} FROM noted)"""
SQL["report_items"] = f"WITH {_NOTED}, lists AS (" + " UNION ALL ".join(
    f"SELECT id, '{name}' AS section, json_extract(body, '$.{name}[*]') AS items FROM checked WHERE ok"
    for name in ("discrepancies", "missing_elements", "additional_elements")
) + """) SELECT id, section, position, json_extract_string(items[position + 1], '$') AS item
    FROM (SELECT *, unnest(range(len(items))) AS position FROM lists)"""
SQL["report_extra_keys"] = f"""WITH {_NOTED}, keyed AS (
        SELECT id, body, unnest(json_keys(body)) AS key FROM checked WHERE ok)
    SELECT id, key, json_extract_string(body, '$.' || key) AS value FROM keyed
    WHERE key NOT IN ('extracted_description', 'similarity_score', 'discrepancies', 'missing_elements', 'additional_elements')"""
SQL["completion_retried"] = """WITH asked AS (SELECT doc_id AS id, md5(doc_id || ': ' || text) AS digest FROM documents),
    failing AS (SELECT *, (instr('0123456789abcdef', left(digest, 1)) - 1) % 4 AS failures FROM asked)
    SELECT id, CASE WHEN failures < 3 THEN 'api-m0 0.5 ' || digest ELSE 'Error processing pA request: busy' END AS reply,
        CAST(least(failures + 1, 3) AS INTEGER) AS attempts FROM failing WHERE digest IS NOT NULL
    UNION ALL SELECT id, NULL, 0 FROM asked WHERE digest IS NULL"""
SQL["completion_once"] = """SELECT doc_id AS id, 'api-m0 0.5 ' || md5(text) AS reply,
        coalesce(text IS NOT NULL AND doc_id = min(doc_id) OVER (PARTITION BY text)
            AND NOT bool_or(doc_id % 2 = 0) OVER (PARTITION BY text), false) AS called
    FROM documents"""
SQL["sql_latest_run_of"] = f"""WITH {LOG}, {RANKED} SELECT c_custkey, id, original_srs_text,
        'BACKFEED_IMPROVEMENT_' || c_custkey AS label
    FROM customer JOIN ranked ON srs_id = CAST(c_custkey AS VARCHAR)
    WHERE newest = 1 AND llm_provider = 'pA' AND llm_model = 'm0' AND temperature = 0.5"""
SQL["sql_extract_script"] = SQL["extract_script"]
SQL["stream_insert_indexed"] = f"SELECT srs_origin, srs_title, srs_content FROM ({SQL['stream_insert']})"
