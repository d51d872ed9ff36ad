"""The catalog's queries in plain SQL for an independent check.

Written apart from the Spark side: lines are wrapped and chunks packed by a
fold over words and sentences, and times are summed by a fold, so that the
doubles agree to the last bit.
"""

from __future__ import annotations

from cuesheet.operators.pages import NO_TEXT
from cuesheet.plans.catalog import CREATED, SHORT_PAGE_WORDS, SLOW_PAGE_WORDS

STAMP = "20240101_000000"


def clean(text: str) -> str:
    collapsed = rf"trim(regexp_replace(coalesce({text}, ''), '\s+', ' ', 'g'))"
    kept = (
        f"CASE WHEN length({collapsed}) < 3 OR regexp_full_match({collapsed}, '\\p{{Nd}}+') "
        f"THEN '' ELSE {collapsed} END"
    )
    dots = rf"regexp_replace({kept}, '\.{{2,}}', '.', 'g')"
    dashes = rf"regexp_replace({dots}, '\s*-\s*', ' - ', 'g')"
    return rf"trim(regexp_replace({dashes}, '([.!?])\s*([A-Z])', '\1 \2', 'g'))"


def split_words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


def words(text: str) -> str:
    return f"len({split_words(text)})"


def sentences(text: str) -> str:
    pieces = rf"regexp_split_to_array({text}, '[.!?]+\s+')"
    return f"list_filter(list_transform({pieces}, lambda x: trim(x)), lambda x: x <> '')"


def wrap(text: str, max_lines: int, repeat_dots: bool) -> str:
    """Fold over words; lines beyond the first that is cut off are not kept."""
    empty = "{'lines': []::VARCHAR[], 'line': '', 'used': 0::BIGINT}"
    states = (
        f"list_transform({split_words(text)}, "
        "lambda w: {'lines': []::VARCHAR[], 'line': w, 'used': length(w)::BIGINT})"
    )
    folded = f"""list_reduce({states}, lambda s, w:
        CASE WHEN len(s.lines) > {max_lines} THEN s
             WHEN s.used + w.used + 1 <= 60
             THEN {{'lines': s.lines, 'line': CASE WHEN s.line = '' THEN w.line ELSE s.line || ' ' || w.line END,
                    'used': s.used + w.used + 1}}
             ELSE {{'lines': CASE WHEN s.line = '' THEN s.lines ELSE list_append(s.lines, s.line) END,
                    'line': w.line, 'used': w.used}} END, {empty})"""
    lines = (
        f"list_transform([{folded}], lambda s: "
        "CASE WHEN s.line = '' THEN s.lines ELSE list_append(s.lines, s.line) END)[1]"
    )
    dots = "'...'" if repeat_dots else f"CASE WHEN ls[{max_lines}] LIKE '%...' THEN '' ELSE '...' END"
    return f"""list_transform([{lines}], lambda ls:
        CASE WHEN len(ls) > {max_lines}
             THEN array_to_string(ls[1:{max_lines}], chr(10)) || {dots}
             ELSE array_to_string(ls, chr(10)) END)[1]"""


def wrap_cue(text: str) -> str:
    return wrap(text, 2, False)


def wrap_caption(text: str) -> str:
    return wrap(text, 3, True)


def cue_chunks(text: str, duration: str) -> str:
    empty = "{'done': []::VARCHAR[], 'open': '', 'used': 0::BIGINT}"
    states = (
        f"list_transform({sentences(text)}, "
        "lambda x: {'done': []::VARCHAR[], 'open': x, 'used': length(x)::BIGINT})"
    )
    folded = f"""list_reduce({states}, lambda s, x:
        CASE WHEN s.used + x.used > 120 AND s.open <> ''
             THEN {{'done': list_append(s.done, s.open), 'open': x.open, 'used': x.used}}
             ELSE {{'done': s.done, 'open': CASE WHEN s.open = '' THEN x.open ELSE s.open || ' ' || x.open END,
                    'used': s.used + x.used + 1}} END, {empty})"""
    packed = f"list_transform([{folded}], lambda s: list_append(s.done, s.open))[1]"
    return f"CASE WHEN {duration} <= 6 THEN [{text}] ELSE {packed} END"


def request_chunks(text: str) -> str:
    empty = "{'done': []::VARCHAR[], 'open': ''}"
    states = f"list_transform(string_split({text}, '. '), lambda x: {{'done': []::VARCHAR[], 'open': x}})"
    folded = f"""list_reduce({states}, lambda s, x:
        CASE WHEN length(s.open || x.open) <= 5000
             THEN {{'done': s.done, 'open': s.open || x.open || '. '}}
             ELSE {{'done': CASE WHEN s.open = '' THEN s.done ELSE list_append(s.done, trim(s.open)) END,
                    'open': x.open || '. '}} END, {empty})"""
    packed = f"list_transform([{folded}], lambda s: list_append(s.done, trim(s.open)))[1]"
    return f"CASE WHEN length({text}) <= 5000 THEN [{text}] ELSE {packed} END"


def timestamp(seconds: str, mark: str) -> str:
    return (
        f"printf('%02d:%02d:%02d{mark}%03d', (({seconds} - {seconds} % 3600) / 3600)::BIGINT, "
        f"(({seconds} % 3600 - {seconds} % 60) / 60)::BIGINT, trunc({seconds} % 60)::BIGINT, "
        f"trunc(({seconds} % 1) * 1000)::BIGINT)"
    )


def preview(text: str) -> str:
    return f"CASE WHEN length({text}) <= 500 THEN {text} ELSE substr({text}, 1, 500) || '...' END"


def rows_of(array: str, source: str, value: str) -> str:
    """Elements of an array with their place, counted from 1."""
    return f"""SELECT doc_id, unnest(range(1, len(a) + 1))::INT AS "index", unnest(a) AS {value}
        FROM (SELECT doc_id, {array} AS a FROM {source})"""


PAGES = f"""pages_of AS (SELECT * FROM (
    SELECT conv_id AS doc_id, (turn + 1)::INT AS page_number, {clean('text')} AS text FROM conversations)
    WHERE text <> '')"""
DOCS = "docs_of AS (SELECT DISTINCT conv_id AS doc_id FROM conversations)"
SCRIPTS = f"""scripts AS (SELECT *, {words('text')} * 60.0::DOUBLE / 200 AS duration FROM (
    SELECT doc_id, {clean('text')} AS text FROM documents) WHERE text <> '')"""
DURATIONS = f"""durations AS (SELECT doc_id, page_number, {words('text')} * 60.0::DOUBLE / 200 AS duration
    FROM pages_of)"""
MEASURED = f"""durations AS (SELECT doc_id, page_number + (doc_id % 3 = 1)::INT AS page_number, {words('text')} * 60.0::DOUBLE / 200 AS duration
    FROM pages_of WHERE {words('text')} <= {SLOW_PAGE_WORDS})"""
OUTCOMES = f"""outcomes AS (SELECT doc_id, page_number, 'c' || doc_id || '_' || printf('%03d', page_number) || '.mp3' AS path,
    {words('text')} >= {SHORT_PAGE_WORDS} AS ok FROM pages_of)"""
# From the opening of the article to its end or that of the page; every tag of a
# paragraph or heading becomes a mark at which the text is cut.
HTML = f"""articles AS (SELECT page_id AS doc_id, url, string_split(html, '<article>')[2] AS rest FROM pages),
pieces AS (SELECT doc_id, url, list_filter(list_transform(string_split(replace(replace(
        regexp_replace(string_split(rest, '</article>')[1], '<h1>[^<]*</h1>', chr(1), 'g'),
        '</p>', chr(1)), '<p>', chr(1)), chr(1)),
        lambda p: replace(replace(replace(regexp_replace(p, '<[^>]*>', ' ', 'g'),
            '&quot;', '"'), '&middot;', chr(183)), '&amp;', '&')),
        lambda p: regexp_matches(p, '\\S')) AS ps FROM articles),
html_rows AS (SELECT doc_id, url, page_number, {clean('raw')} AS text FROM (
    SELECT doc_id, url, unnest(range(1, len(ps) + 1))::INT AS page_number, unnest(ps) AS raw FROM pieces))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def timed(source: str, keys: str) -> str:
    """Cues of texts with a duration, by folding over the sentence durations."""
    return f"""parts AS (SELECT {keys}, text, duration, {sentences('text')} AS ss FROM {source} WHERE duration > 0),
lasting AS (SELECT *, list_transform(ss, lambda x:
    greatest(1.0::DOUBLE, least(6.0::DOUBLE, length(x) / (length(text)::DOUBLE / duration)))) AS ds FROM parts),
summed AS (SELECT *, list_reduce(
    list_transform(ds, lambda d: {{'began': []::DOUBLE[], 'now': d}}),
    lambda s, d: {{'began': list_append(s.began, s.now), 'now': s.now + d.now}},
    {{'began': []::DOUBLE[], 'now': 0.0::DOUBLE}}) AS run FROM lasting),
spread_out AS (SELECT {keys}, duration, run.now AS last, unnest(range(1, len(ss) + 1))::INT AS "index",
    unnest(ss) AS piece, unnest(ds) AS d, unnest(run.began) AS began FROM summed),
cues AS (SELECT {keys}, "index", began * (duration / last) AS start_time,
    (began + d) * (duration / last) AS end_time, {wrap_cue('piece')} AS text FROM spread_out)"""


CUES = with_(SCRIPTS, timed("scripts", "doc_id"))


def paged_cues(durations: str) -> str:
    return with_(
        PAGES,
        durations,
        f"""counted AS (SELECT doc_id, count(*) FILTER (p.text IS NULL OR d.duration IS NULL) AS unmatched
    FROM pages_of p FULL JOIN durations d USING (doc_id, page_number) GROUP BY doc_id),
lists AS (SELECT doc_id, list(duration ORDER BY page_number) AS ds, list(page_number ORDER BY page_number) AS ns
    FROM durations GROUP BY doc_id),
run AS (SELECT doc_id, ns, list_reduce(
    list_transform(ds, lambda d: {{'began': []::DOUBLE[], 'now': d}}),
    lambda s, d: {{'began': list_append(s.began, s.now), 'now': s.now + d.now}},
    {{'began': []::DOUBLE[], 'now': 0.0::DOUBLE}}).began AS offsets FROM lists),
offsets AS (SELECT doc_id, unnest(ns) AS page_number, unnest(offsets) AS began FROM run),
chunked AS (SELECT doc_id, page_number, duration, began, {cue_chunks('text', 'duration')} AS cs
    FROM pages_of JOIN durations USING (doc_id, page_number) JOIN offsets USING (doc_id, page_number)
    JOIN counted USING (doc_id) WHERE unmatched = 0),
chunks AS (SELECT doc_id, page_number, duration, began, duration / len(cs) AS share,
    unnest(range(len(cs))) AS i, unnest(cs) AS c FROM chunked),
placed AS (SELECT *, began + i * share AS shown, least(began + i * share + share, began + duration) AS gone FROM chunks),
cues AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, i) AS "index",
    shown AS start_time, CASE WHEN gone - shown < 1 THEN shown + 1 ELSE gone END AS end_time, {wrap_cue('c')} AS text FROM placed)""",
    )


SRT_BLOCK = (
    f"\"index\" || chr(10) || {timestamp('start_time', ',')} || ' --> ' || "
    f"{timestamp('end_time', ',')} || chr(10) || text || chr(10) || chr(10)"
)
VTT_BLOCK = (
    f"{timestamp('start_time', '.')} || ' --> ' || {timestamp('end_time', '.')} "
    "|| chr(10) || text || chr(10) || chr(10)"
)
SRT_FILE = f"string_agg({SRT_BLOCK}, '' ORDER BY \"index\")"
VTT_FILE = f"'WEBVTT' || chr(10) || chr(10) || string_agg({VTT_BLOCK}, '' ORDER BY \"index\")"

JOBS = """jobs AS (SELECT doc_id + step * 1000000000 AS job_id, doc_id,
    CASE s % 4 WHEN 0 THEN 'pyttsx3' WHEN 1 THEN 'gtts' WHEN 2 THEN 'elevenlabs' ELSE 'other' END AS engine,
    CASE WHEN s % 5 <> 0 THEN 0.3::DOUBLE + (s % 20) / 10.0::DOUBLE ELSE 1.0::DOUBLE END AS speed,
    (s % 121 - 60)::INT AS pitch,
    lang AS language,
    CASE s % 3 WHEN 0 THEN upper(lang) WHEN 1 THEN lang || '/' || source END AS voice_id,
    CASE s % 3 WHEN 0 THEN 'audio' WHEN 1 THEN 'video' ELSE 'both' END AS output_type,
    CASE s % 5 WHEN 2 THEN 'wav' WHEN 3 THEN 'ogg' ELSE 'mp3' END AS audio_format,
    'mp4' AS video_format, 'high' AS audio_quality,
    CASE s % 4 WHEN 0 THEN '1920x1080' WHEN 1 THEN '1280x720' WHEN 2 THEN '0x480' ELSE 'wide' END AS resolution,
    24::INT AS fps, s % 2 = 0 AS subtitles, s % 3 = 0 AS separate_pages,
    'auto' AS extraction_method FROM (
        SELECT *, doc_id + step AS s FROM (
            SELECT *, unnest(CASE WHEN doc_id % 3 = 1 THEN [0, 2] ELSE [0] END) AS step FROM documents)))"""
ROUTED = """routed AS (SELECT *, CASE WHEN engine IN ('pyttsx3', 'gtts', 'elevenlabs') THEN 'gtts' END AS routed_engine,
    CASE engine WHEN 'gtts' THEN 'requested' WHEN 'other' THEN 'unknown engine' ELSE 'fallback' END AS routing
    FROM jobs)"""
PATHS = """paths AS (SELECT doc_id, n_chars, 'd' || doc_id ||
    CASE doc_id % 3 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PDF' ELSE '.txt' END AS path FROM documents)"""
SIZES = """sized AS (SELECT *, CASE resolution WHEN '1920x1080' THEN 1920 WHEN '1280x720' THEN 1280 END::BIGINT AS width,
    CASE resolution WHEN '1920x1080' THEN 1080 WHEN '1280x720' THEN 720 END::BIGINT AS height FROM jobs)"""


def text_value(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 'null' ELSE '\"' || {column} || '\"' END"


VOICE_JSON = f"""'{{"engine":"' || engine || '","speed":' || speed || ',"pitch":' || pitch ||
    ',"language":"' || language || '","voice_id":' || {text_value('voice_id')} || '}}'"""
SIZE_JSON = "CASE WHEN width IS NULL THEN '[null,null]' ELSE '[' || width || ',' || height || ']' END"
OUTPUT_JSON = f"""'{{"audio_format":"' || audio_format || '","video_format":"mp4","audio_quality":"high",' ||
    '"video_resolution":' || {SIZE_JSON} || ',"fps":24}}'"""

MANIFEST = with_(
    PAGES,
    OUTCOMES,
    DOCS,
    JOBS,
    SIZES,
    f"""page_counts AS (SELECT doc_id, count(*) AS n FROM pages_of GROUP BY 1),
audio AS (SELECT doc_id, count(*) AS files, string_agg(path, ',' ORDER BY page_number) AS plain,
    string_agg('"' || path || '"', ',' ORDER BY page_number) AS quoted FROM outcomes WHERE ok GROUP BY 1),
facts AS (SELECT s.*, CASE WHEN doc_id % 5 <> 0 THEN 'c' || doc_id ELSE 'Unnamed Project' END AS project_name,
    CASE WHEN doc_id % 4 <> 0 THEN 'c' || doc_id || '.pdf' ELSE '' END AS source_pdf,
    coalesce(n, 0) AS total_pages, coalesce(files, 0) AS total_audio_files,
    coalesce(plain, '') AS plain, coalesce(quoted, '') AS quoted,
    CASE WHEN output_type = 'both' AND files IS NOT NULL THEN 'c' || doc_id || '.mp4' END AS video
    FROM sized s JOIN docs_of USING (doc_id) LEFT JOIN page_counts USING (doc_id) LEFT JOIN audio USING (doc_id))""",
)


def _first_reason() -> str:
    rules = [
        ("engine = 'other'", "unknown engine"),
        ("audio_format = 'ogg'", "unknown audio format"),
        ("n_chars < 100", "input not found"),
        ("path LIKE '%.txt'", "input is no script"),
        ("speed < 0.5 OR speed > 2.0", "speed out of range"),
        ("pitch < -50 OR pitch > 50", "pitch out of range"),
        ("width IS NULL", "invalid resolution"),
        ("doc_id % 7 <> 0 AND doc_id % 11 = 0", "background not found"),
    ]
    return "CASE " + " ".join(f"WHEN {test} THEN '{reason}'" for test, reason in rules) + " END"


REPORT = with_(
    PAGES,
    DOCS,
    f"""stats AS (SELECT doc_id, count(text) AS total_pages, coalesce(sum(length(text)), 0)::BIGINT AS total_characters,
    coalesce(sum({words('text')}), 0)::BIGINT AS total_words
    FROM docs_of LEFT JOIN pages_of USING (doc_id) GROUP BY doc_id),
averages AS (SELECT *, CASE WHEN total_pages = 0 THEN 0 ELSE total_words // total_pages END::BIGINT
    AS average_words_per_page FROM stats),
firsts AS (SELECT doc_id, arg_min({preview('text')}, page_number) AS preview FROM pages_of GROUP BY 1),
whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page_number) AS text FROM pages_of GROUP BY 1)""",
)

MISMATCH = """SELECT doc_id, count(text) AS total_pages, count(duration) AS total_durations,
        count(*) FILTER (text IS NULL OR duration IS NULL) AS unmatched,
        CASE WHEN count(text) <> count(duration) THEN 'counts differ' ELSE 'page numbers differ' END AS reason
    FROM pages_of FULL JOIN durations USING (doc_id, page_number)
    GROUP BY doc_id HAVING count(*) FILTER (text IS NULL OR duration IS NULL) > 0"""

REQUEST = """CAST(trunc(speed * 200) AS INT) AS rate, speed < 0.8 AS slow, length(text)::INT AS n_chars"""


def oracle_sql() -> dict[str, str]:
    scripts_only = with_(SCRIPTS)
    return {
        "clean_scripts": scripts_only + "SELECT doc_id, text FROM scripts",
        "clean_text": f"SELECT doc_id, {clean('text')} AS text FROM documents",
        "page_rows": with_(PAGES) + "SELECT *, 'pymupdf' AS extraction_method FROM pages_of",
        "html_page_rows": with_(HTML)
        + "SELECT doc_id, page_number, text, 'pymupdf' AS extraction_method FROM html_rows WHERE text <> ''",
        "extract_fallback": with_(
            HTML,
            """first AS (SELECT doc_id, page_number, text, 'pymupdf' AS extraction_method
                FROM html_rows WHERE text <> '' AND url LIKE 'https:%')""",
            f"""second AS (SELECT page_id AS doc_id, 1::INT AS page_number,
                {clean("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")} AS text,
                'pdfplumber' AS extraction_method FROM pages)""",
        )
        + """SELECT * FROM first UNION ALL SELECT * FROM second
             WHERE text <> '' AND doc_id NOT IN (SELECT doc_id FROM first)""",
        "text_stats": REPORT + "SELECT * FROM averages",
        "corpus_totals": with_(PAGES)
        + "SELECT count(*) AS total_pages, coalesce(sum(length(text)), 0)::BIGINT AS total_characters FROM pages_of",
        "doc_assembly": REPORT + "SELECT doc_id, text FROM whole",
        "doc_preview": REPORT
        + f"SELECT doc_id, coalesce({preview('text')}, '{NO_TEXT}') AS preview FROM docs_of LEFT JOIN whole USING (doc_id)",
        "first_page_preview": REPORT + "SELECT * FROM firsts",
        "text_report": REPORT
        + f"""SELECT doc_id, total_pages, format('{{:,}}', total_characters) AS characters,
            format('{{:,}}', total_words) AS words, average_words_per_page,
            coalesce(preview, '{NO_TEXT}') AS preview,
            printf('%.1f', total_characters / 1000.0::DOUBLE) AS minutes
            FROM averages LEFT JOIN firsts USING (doc_id)""",
        "empty_documents": with_(HTML)
        + """SELECT page_id AS doc_id FROM pages WHERE page_id NOT IN
            (SELECT doc_id FROM html_rows WHERE text <> '' AND url LIKE 'https:%')""",
        "sentences": scripts_only + rows_of(sentences("text"), "scripts", "sentence"),
        "cue_wrap": scripts_only
        + f"""SELECT doc_id, "index", {wrap_cue('piece')} AS cue
            FROM ({rows_of(sentences('text'), 'scripts', 'piece')})""",
        "caption_wrap": scripts_only + f"SELECT doc_id, {wrap_caption('text')} AS caption FROM scripts",
        "cue_chunks": scripts_only
        + f"""SELECT doc_id, "index", {wrap_cue('c')} AS chunk
            FROM ({rows_of(cue_chunks('text', 'duration'), 'scripts', 'c')})""",
        "tts_chunks": scripts_only + rows_of(request_chunks("text"), "scripts", "chunk"),
        "paragraphs": rows_of(
            """list_filter(list_transform(string_split(trim(text, chr(10) || ' '), chr(10) || chr(10)),
                lambda p: trim(p, chr(10) || ' ')), lambda p: p <> '')""",
            "documents",
            "paragraph",
        ),
        "speech_duration": f"""WITH t AS (SELECT doc_id, n_chars, {clean('text')} AS text,
                0.3::DOUBLE + (doc_id % 20) / 10.0::DOUBLE AS speed FROM documents)
            SELECT doc_id, CAST(trunc(speed * 200) AS INT) AS rate,
                CASE WHEN speed > 2.0 THEN n_chars / 15.0::DOUBLE
                     ELSE {words('text')} * 60.0::DOUBLE / CAST(trunc(speed * 200) AS INT) END AS duration
            FROM t WHERE text <> ''""",
        "text_cues": CUES + "SELECT * FROM cues",
        "render_cues": CUES
        + "SELECT doc_id, start_time AS start, end_time AS \"end\", text FROM cues WHERE trim(text) <> ''",
        "cue_stats": CUES
        + """, stats AS (SELECT doc_id, count(*) AS n, max(end_time) AS e, avg(end_time - start_time) AS d,
                sum(length(text))::BIGINT AS c, avg(length(text)) AS a,
                min(end_time - start_time) AS lo, max(end_time - start_time) AS hi FROM cues GROUP BY 1)
            SELECT doc_id, coalesce(n, 0) AS total_subtitles, coalesce(e, 0) AS total_duration,
                round(coalesce(d, 0), 6) AS average_duration, coalesce(c, 0) AS total_characters,
                round(coalesce(a, 0), 6) AS average_characters, lo AS min_duration, hi AS max_duration
            FROM documents LEFT JOIN stats USING (doc_id)""",
        "page_cues": paged_cues(DURATIONS) + "SELECT * FROM cues",
        "measured_page_cues": paged_cues(MEASURED) + "SELECT * FROM cues",
        "duration_mismatch": with_(PAGES, MEASURED) + MISMATCH,
        "segment_mismatch": with_(
            PAGES,
            """durations AS (SELECT doc_id, page_number + (doc_id % 3 = 1)::INT AS page_number, 1 AS duration
                FROM pages_of)""",
        )
        + MISMATCH,
        "document_cues": with_(
            PAGES,
            DURATIONS,
            """whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page_number) AS text,
                list_reduce(list(duration ORDER BY page_number), lambda a, b: a + b, 0.0::DOUBLE) AS duration
                FROM pages_of JOIN durations USING (doc_id, page_number) GROUP BY doc_id)""",
            timed("whole", "doc_id"),
        )
        + 'SELECT doc_id, "index"::BIGINT AS "index", start_time, end_time, text FROM cues',
        "segment_timeline": with_(
            PAGES,
            DURATIONS,
            OUTCOMES,
            """made AS (SELECT doc_id, list(page_number ORDER BY page_number) AS ns,
                list(duration ORDER BY page_number) AS ds
                FROM durations JOIN outcomes USING (doc_id, page_number)
                WHERE ok AND doc_id % 3 <> 1 GROUP BY doc_id)""",
            """run AS (SELECT *, list_reduce(
                list_transform(ds, lambda d: {'began': []::DOUBLE[], 'now': d}),
                lambda s, d: {'began': list_append(s.began, s.now), 'now': s.now + d.now},
                {'began': []::DOUBLE[], 'now': 0.0::DOUBLE}).began AS ats FROM made)""",
            """flat AS (SELECT doc_id, unnest(ns) AS page_number, unnest(range(1, len(ns) + 1)) AS segment,
                unnest(ats) AS began, unnest(ds) AS d FROM run)""",
        )
        + f"""SELECT doc_id, page_number, segment, began AS start_time, began + d AS end_time,
            'Page ' || page_number AS title, {wrap_caption('text')} AS caption
            FROM flat JOIN pages_of USING (doc_id, page_number)""",
        "srt_timestamp": f"SELECT doc_id, {timestamp('(n_chars / 7.0::DOUBLE)', ',')} AS timestamp FROM documents",
        "vtt_timestamp": f"SELECT doc_id, {timestamp('(n_chars / 7.0::DOUBLE)', '.')} AS timestamp FROM documents",
        "srt_files": CUES + f"SELECT doc_id, {SRT_FILE} AS srt FROM cues GROUP BY doc_id",
        "srt_documents": CUES + f"SELECT doc_id, {SRT_FILE} AS srt FROM cues GROUP BY doc_id",
        "vtt_documents": CUES + f"SELECT doc_id, {VTT_FILE} AS vtt FROM cues GROUP BY doc_id",
        "page_srt": with_(
            PAGES,
            DURATIONS,
            OUTCOMES,
            """named AS (SELECT doc_id, page_number, text, 'c' || doc_id || '_page_' || printf('%03d',
                row_number() OVER (PARTITION BY doc_id ORDER BY page_number)) || '.srt' AS filename FROM pages_of)""",
            """heard AS (SELECT n.*, duration FROM named n JOIN durations USING (doc_id, page_number)
                JOIN outcomes USING (doc_id, page_number) WHERE ok)""",
            timed("heard", "doc_id, page_number, filename"),
        )
        + f"SELECT doc_id, page_number, filename, {SRT_FILE} AS srt FROM cues GROUP BY ALL",
        "page_cue_srt": paged_cues(DURATIONS)
        + f'SELECT doc_id, "index", {SRT_BLOCK} AS block FROM cues',
        "page_cue_vtt": paged_cues(DURATIONS)
        + f"""SELECT doc_id, "index", {VTT_BLOCK} AS block FROM cues
            UNION ALL SELECT DISTINCT doc_id, 0, 'WEBVTT' || chr(10) || chr(10) FROM cues""",
        "job_defaults": with_(JOBS) + "SELECT * FROM jobs",
        "config_snapshot": with_(JOBS, SIZES)
        + f"""SELECT job_id, '{{"voice":' || {VOICE_JSON} || ',"output":' || {OUTPUT_JSON} ||
            ',"paths":{{"pdf_input_dir":"pdf_scripts","audio_output_dir":"audio_output",' ||
            '"video_output_dir":"video_output","temp_dir":"temp"}}}}' AS config FROM sized""",
        "format_gate": with_(PATHS)
        + """SELECT doc_id, path, path NOT LIKE '%.txt' AS is_valid,
            CASE WHEN path LIKE '%.txt' THEN 'Unsupported file format: .txt' END AS reject_reason FROM paths""",
        "job_validation": with_(JOBS, SIZES, PATHS)
        + f"""SELECT job_id, width, height, {_first_reason()} AS reject_reason
            FROM sized JOIN paths USING (doc_id)""",
        "engine_routing": with_(JOBS, ROUTED) + "SELECT job_id, engine, routed_engine, routing FROM routed",
        "voice_match": with_(
            JOBS,
            """voices AS (SELECT 'Voice-' || lang || '/' || upper(source[1]) || source[2:] AS id, min(doc_id) AS ordinal,
                CASE WHEN min(doc_id) % 2 = 0 THEN 'pyttsx3' ELSE 'gtts' END AS engine
                FROM documents GROUP BY lang, source)""",
            """wanted AS (SELECT DISTINCT engine, voice_id FROM jobs)""",
            """matched AS (SELECT w.engine, voice_id, arg_min(id, ordinal) AS matched_voice FROM wanted w JOIN voices v
                ON w.engine = v.engine AND contains(lower(id), lower(voice_id)) GROUP BY 1, 2)""",
        )
        + "SELECT job_id, voice_id, matched_voice FROM jobs LEFT JOIN matched USING (engine, voice_id)",
        "rejected_requests": with_(JOBS, ROUTED)
        + """SELECT job_id, CASE WHEN routing = 'unknown engine' THEN routing ELSE 'no audio wanted' END AS reason
            FROM routed WHERE routing = 'unknown engine' OR output_type = 'video'""",
        "document_srt": with_(
            PAGES,
            DURATIONS,
            JOBS,
            """whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page_number) AS text,
                list_reduce(list(duration ORDER BY page_number), lambda a, b: a + b, 0.0::DOUBLE) AS duration
                FROM pages_of JOIN durations USING (doc_id, page_number)
                WHERE doc_id IN (SELECT doc_id FROM jobs WHERE NOT separate_pages) GROUP BY doc_id)""",
            timed("whole", "doc_id"),
        )
        + f'SELECT doc_id, "index"::BIGINT AS "index", {SRT_BLOCK} AS block FROM cues',
        "synthesis_requests": with_(
            PAGES,
            SCRIPTS,
            JOBS,
            ROUTED,
            "able AS (SELECT * FROM routed WHERE routed_engine IS NOT NULL AND output_type <> 'video')",
            """whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY page_number) AS text FROM pages_of GROUP BY 1)""",
        )
        + f"""SELECT job_id, doc_id, page_number, 'c' || doc_id || '_' || printf('%03d', page_number) || '.mp3' AS filename,
                routed_engine, {REQUEST}, len({request_chunks('text')})::INT AS n_chunks
                FROM pages_of JOIN able USING (doc_id) WHERE separate_pages
            UNION ALL
            SELECT job_id, doc_id, NULL::INT, 'c' || doc_id || '_complete.' || audio_format, routed_engine, {REQUEST},
                len({request_chunks('text')})::INT FROM whole JOIN able USING (doc_id) WHERE NOT separate_pages
            UNION ALL
            SELECT job_id, doc_id, NULL::INT, 'd' || doc_id || '_complete.' || audio_format, routed_engine, {REQUEST},
                len({request_chunks('text')})::INT FROM scripts JOIN able USING (doc_id)""",
        "synthesis_outcomes": with_(PAGES, OUTCOMES)
        + """SELECT doc_id, count(*) AS n_requests, count(*) FILTER (ok) AS n_ok, count(*) FILTER (NOT ok) AS n_failed,
            min(page_number) FILTER (NOT ok) AS first_failed_page, bool_or(ok) AS doc_ok
            FROM outcomes GROUP BY doc_id""",
        "failed_pages": with_(PAGES, OUTCOMES) + "SELECT doc_id, page_number FROM outcomes WHERE NOT ok",
        "artifact_plan": with_(
            PAGES,
            JOBS,
            """numbered AS (SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS n
                FROM pages_of)""",
            "makers AS (SELECT * FROM jobs WHERE output_type IN ('audio', 'both') AND doc_id IN (SELECT doc_id FROM pages_of))",
        )
        + """SELECT job_id, doc_id, 'audio' AS kind, page_number, 'c' || doc_id || '_' || printf('%03d', page_number) || '.mp3' AS filename
                FROM makers JOIN numbered USING (doc_id) WHERE separate_pages
            UNION ALL SELECT job_id, doc_id, 'audio', NULL::INT, 'c' || doc_id || '_complete.' || audio_format
                FROM makers WHERE NOT separate_pages
            UNION ALL SELECT job_id, doc_id, 'video', NULL::INT, 'c' || doc_id || '_complete.mp4'
                FROM makers WHERE output_type = 'both'
            UNION ALL SELECT job_id, doc_id, 'srt', page_number, 'c' || doc_id || '_page_' || printf('%03d', n) || '.srt'
                FROM makers JOIN numbered USING (doc_id) WHERE separate_pages AND subtitles
            UNION ALL SELECT job_id, doc_id, 'srt', NULL::INT, 'c' || doc_id || '_complete.srt'
                FROM makers WHERE NOT separate_pages AND subtitles""",
        "output_layout": with_(
            PAGES,
            OUTCOMES,
            """numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS n FROM outcomes)""",
        )
        + f"""SELECT doc_id, path AS source, 'c' || doc_id || '_{STAMP}/audio/c' || doc_id || '_page_' ||
                printf('%03d', n) || '.mp3' AS target FROM numbered WHERE ok
            UNION ALL SELECT DISTINCT doc_id, 'c' || doc_id || '.mp4', 'c' || doc_id || '_{STAMP}/video/c' || doc_id ||
                '_complete.mp4' FROM numbered WHERE ok""",
        "unique_names": f"""WITH asked AS (SELECT doc_id AS id, source AS base,
                row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
            held AS (SELECT DISTINCT source AS base, n_chars AS counter FROM documents WHERE n_chars < 40),
            most AS (SELECT base, count(*) AS asked_for FROM asked GROUP BY 1),
            space AS (SELECT base, unnest(range(asked_for + 40)) AS counter FROM most),
            free AS (SELECT base, counter, row_number() OVER (PARTITION BY base ORDER BY counter) AS n
                FROM space ANTI JOIN held USING (base, counter))
            SELECT id, base || '_{STAMP}' || CASE WHEN counter = 0 THEN '' ELSE '_' || counter END || '.mp3' AS filename
            FROM asked JOIN free USING (base, n)""",
        "concat_plan": with_(PAGES, OUTCOMES)
        + """SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number) AS position,
            CASE WHEN count(*) OVER (PARTITION BY doc_id) = 1 THEN 'copy' ELSE 'concat' END AS action,
            count(*) OVER (PARTITION BY doc_id) AS n_files, path FROM outcomes WHERE ok""",
        "file_inventory": """WITH asked AS (SELECT regexp_extract(url, '//([^?#]*)', 1) || '-' || page_id || '.html' AS path,
                strlen(html) AS bytes, contains(url, '?') AS lost FROM pages)
            SELECT path, CASE WHEN NOT lost THEN bytes END AS size,
                CASE WHEN NOT lost THEN round_even(bytes / 1048576.0::DOUBLE, 2) END AS size_mb,
                CASE WHEN NOT lost THEN '.html' END AS suffix,
                CASE WHEN NOT lost THEN string_split(path, '/')[-1] END AS name, NOT lost AS exists FROM asked""",
        "files_in_order": """WITH files AS (SELECT regexp_extract(url, '//([^?#]*)', 1) || '-' || page_id || '.html' AS path FROM pages)
            SELECT path, row_number() OVER (ORDER BY path) AS position FROM files""",
        "event_stamps": """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS file_stamp,
            strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN ''
                ELSE strftime(ts, '.%f') END AS created FROM events""",
        "project_manifest": MANIFEST
        + f"""SELECT job_id, doc_id, '{{"created":"{CREATED}","project_name":"' || project_name ||
            '","source_pdf":"' || source_pdf || '","total_pages":' || total_pages || ',"total_audio_files":' ||
            total_audio_files || ',"has_video":' || (video IS NOT NULL) || ',"voice_config":' || {VOICE_JSON} ||
            ',"output_config":' || {OUTPUT_JSON} || ',"file_list":{{"audio_files":[' || quoted ||
            '],"video_file":' || {text_value('video')} || '}}}}' AS manifest FROM facts""",
        "manifest_files": MANIFEST
        + """SELECT f.job_id, o.path FROM facts f JOIN outcomes o USING (doc_id) WHERE o.ok""",
        "manifest_roundtrip": MANIFEST
        + """SELECT job_id, project_name, source_pdf, total_pages, total_audio_files, video IS NOT NULL AS has_video, engine,
            audio_format, plain AS audio_files, video AS video_file, true AS is_valid FROM facts""",
    }
