"""The registered queries in SQL for another engine, written independently of Spark.

Only the input views and the vocabulary are shared with the queries; every result is
derived here again, the merge by a write-by-write replay.
"""

from __future__ import annotations

from rollcall.functions.files import SUPPORTED_EXTENSIONS
from rollcall.functions.skills import TAXONOMY, TRADES
from rollcall.operators.records import EMAIL, PHONE, YEARS
from rollcall.operators.seed import CITIES, FIRST_NAMES, LAST_NAMES
from rollcall.plans.queries import LIMITS, PROBES
from rollcall.plans.views import EMAIL_SLOTS, EVENT_STATES, PHONE_SLOTS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else text(v) for v in values) + "]"


def phone_key(p: str) -> str:
    digits = f"regexp_replace({p}, '[^0-9]', '', 'g')"
    key = f"right({digits}, 10)"
    repeated = "|".join(str(d) * 10 for d in range(10))
    return (
        f"CASE WHEN length({digits}) >= 10 AND NOT regexp_matches({key}, '^({repeated})$') "
        f"AND NOT regexp_matches({key}, '55501[0-9][0-9]$') THEN {key} END"
    )


def skill_list(skills: str, labels: str) -> str:
    """Known labels of a list in first-seen order, or the fallback."""
    mapped = (
        f"list_filter(list_transform({skills}, lambda s: "
        f"list_filter({labels}, lambda t: lower(t) = lower(trim(s)))[1]), lambda s: s IS NOT NULL)"
    )
    ordered = f"list_filter({mapped}, lambda s, i: list_position({mapped}, s) = i)"
    return f"CASE WHEN len({mapped}) > 0 THEN array_to_string({ordered}, '|') ELSE 'Other' END"


BASE = f"""
base AS (
    SELECT c_custkey AS k, c_custkey // 20 AS q, c_custkey % 20 AS r, c_name,
           {listed(PHONE_SLOTS)}[(c_custkey % 20 + 1)::INT] AS ps,
           {listed(EMAIL_SLOTS)}[(c_custkey % 20 + 1)::INT] AS es
    FROM customer
),
digits AS (SELECT *, ((q * 20 + ps) * 7919 + 2000000000)::VARCHAR AS d FROM base),
people AS (
    SELECT k AS id, k AS seq, CASE WHEN r <> 14 THEN c_name END AS name,
           {listed(TRADES)}[(k % {len(TRADES)} + 1)::INT] AS raw_title,
           (k % 26)::INT AS experience_years,
           list_concat([upper({listed(TRADES)}[(k % {len(TRADES)} + 1)::INT]),
                        {listed(TRADES)}[((k + 1) % {len(TRADES)} + 1)::INT],
                        lower({listed(TRADES)}[(k % {len(TRADES)} + 1)::INT])],
                       CASE WHEN k % 5 = 0 THEN ['Unknown Trade'] ELSE [] END) AS skills,
           CASE WHEN r IN (10, 11) THEN '(555) 555-5555'
                WHEN r = 12 THEN '(918) 555-01' || lpad((q % 100)::VARCHAR, 2, '0')
                WHEN ps IS NULL THEN NULL
                WHEN k % 4 = 0 THEN '(' || d[1:3] || ') ' || d[4:6] || '-' || d[7:10]
                WHEN k % 4 = 1 THEN d[1:3] || '-' || d[4:6] || '-' || d[7:10]
                WHEN k % 4 = 2 THEN d
                ELSE '+1 ' || d[1:3] || ' ' || d[4:6] || ' ' || d[7:10] END AS phone,
           'user' || (q * 20 + es)::VARCHAR || '@example.com' AS email,
           'r' || (CASE WHEN r = 4 THEN k - 1 ELSE k END)::VARCHAR || '.pdf' AS source_file,
           'b' || (q % 7)::VARCHAR AS batch_id, q, r
    FROM digits
),
candidates AS (SELECT *, {phone_key('phone')} AS phone_normalized FROM people)
"""

STORED = """
earlier AS (
    SELECT s_suppkey AS id, s_name AS name, s_suppkey AS j, s_suppkey % 4 AS kind,
           CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 8 WHEN 3 THEN 14 END AS ps,
           CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 6 WHEN 3 THEN 15 END AS es
    FROM supplier
),
stored AS (
    SELECT id, name, 'Welder' AS raw_title, 1 AS experience_years, 'Welder' AS skills,
           ((j * 20 + ps) * 7919 + 2000000000)::VARCHAR AS phone,
           ((j * 20 + ps) * 7919 + 2000000000)::VARCHAR AS phone_normalized,
           'user' || (j * 20 + es)::VARCHAR || '@example.com' AS email,
           CASE WHEN kind = 2 THEN 'r' || (j * 20 + 3)::VARCHAR || '.pdf'
                ELSE 's' || j::VARCHAR || '.pdf' END AS source_file,
           CASE WHEN kind = 2 THEN 'b' || (j % 7)::VARCHAR ELSE 'seed' END AS batch_id,
           '2024-01-01' AS created_on, j AS q
    FROM earlier
)
"""

KEY = "COALESCE('p' || phone_normalized, 'b' || batch_id || '|' || source_file)"

# Replays the twenty writes of each block in order. A row is (id, key, email, the write
# it shows, when it was made); `act` says what became of the write of this step.
REPLAY = f"""
{BASE}, {STORED},
ops AS (SELECT *, {KEY} AS kk FROM candidates),
start AS (SELECT max(id) AS largest FROM stored),
blocks AS (SELECT DISTINCT q FROM ops),
replay AS (
    SELECT b.q, -1 AS step,
           COALESCE((SELECT list({{'id': s.id, 'kk': {KEY.replace('phone_normalized', 's.phone_normalized')
           .replace('batch_id', 's.batch_id').replace('source_file', 's.source_file')},
                                   'ee': s.email, 'src': -1::BIGINT, 'made': s.created_on}})
                     FROM stored s WHERE s.q = b.q),
                    []::STRUCT(id BIGINT, kk VARCHAR, ee VARCHAR, src BIGINT, made VARCHAR)[]) AS rws,
           NULL::BIGINT AS seq, NULL::VARCHAR AS act, NULL::VARCHAR AS strat
    FROM blocks b
    UNION ALL
    SELECT q, step, CASE act
               WHEN 'insert' THEN list_append(rws, {{'id': largest + 1 + seq, 'kk': kk, 'ee': ee,
                                                     'src': seq, 'made': '2026-01-01'}})
               WHEN 'reject' THEN rws
               ELSE list_transform(rws, lambda x: CASE WHEN x.id = target
                   THEN {{'id': x.id, 'kk': kk, 'ee': ee, 'src': seq, 'made': x.made}} ELSE x END) END,
           seq, act, CASE WHEN act = 'reject' THEN 'conflict'
                          WHEN act = 'update' AND t IS NULL THEN 'email' ELSE named END
    FROM (
        SELECT *, COALESCE(t, e) AS target,
               CASE WHEN seq IS NULL THEN 'reject'
                    WHEN t IS NULL AND e IS NULL THEN 'insert'
                    WHEN t IS NOT NULL AND e IS NOT NULL AND t <> e THEN 'reject'
                    ELSE 'update' END AS act
        FROM (
            SELECT p.q, p.step + 1 AS step, p.rws, o.seq AS seq, o.kk AS kk, o.email AS ee,
                   (SELECT largest FROM start) AS largest,
                   CASE WHEN o.phone_normalized IS NOT NULL THEN 'phone' ELSE 'batch_file' END AS named,
                   list_filter(p.rws, lambda x: x.kk = o.kk)[1].id AS t,
                   list_filter(p.rws, lambda x: x.ee = o.email)[1].id AS e
            FROM replay p LEFT JOIN ops o ON o.q = p.q AND o.r = p.step + 1
            WHERE p.step < 19
        )
    )
)
"""

MERGED = f"""
WITH RECURSIVE {REPLAY},
left_rows AS (SELECT unnest(rws, recursive := true) FROM replay WHERE step = 19),
written AS (
    SELECT f.id, c.name, c.raw_title, c.experience_years, array_to_string(c.skills, '|') AS skills,
           c.phone, c.phone_normalized, c.email, c.source_file, c.batch_id, f.made AS created_on
    FROM left_rows f JOIN candidates c ON c.seq = f.src
)
SELECT * FROM written
UNION ALL
SELECT id, name, raw_title, experience_years, skills, phone, phone_normalized, email,
       source_file, batch_id, created_on
FROM stored WHERE id NOT IN (SELECT id FROM written)
"""

OUTCOMES = f"WITH RECURSIVE {REPLAY} SELECT seq, strat AS strategy, act AS action FROM replay WHERE seq IS NOT NULL"

REJECTED = f"""
WITH RECURSIVE {REPLAY}
SELECT c.seq, c.phone_normalized, c.email FROM replay JOIN candidates c USING (seq) WHERE act = 'reject'
"""

LOADED = f"""
            WITH {BASE}, {STORED},
            firsts AS (SELECT email, min(seq) AS first FROM candidates GROUP BY email),
            newest AS (
                SELECT c.*, CASE WHEN c.email IS NULL THEN c.seq ELSE f.first END AS first
                FROM candidates c LEFT JOIN firsts f ON f.email = c.email
                QUALIFY c.email IS NULL OR row_number() OVER (PARTITION BY c.email ORDER BY seq DESC) = 1)
            SELECT s.id, COALESCE(n.name, CASE WHEN n.seq IS NULL THEN s.name END) AS name,
                   CASE WHEN n.seq IS NULL THEN s.raw_title ELSE n.raw_title END AS raw_title,
                   CASE WHEN n.seq IS NULL THEN s.experience_years ELSE n.experience_years END AS experience_years,
                   CASE WHEN n.seq IS NULL THEN s.skills ELSE array_to_string(n.skills, '|') END AS skills,
                   CASE WHEN n.seq IS NULL THEN s.phone ELSE n.phone END AS phone,
                   s.phone_normalized, s.email,
                   CASE WHEN n.seq IS NULL THEN s.source_file ELSE n.source_file END AS source_file,
                   s.batch_id, s.created_on
            FROM stored s LEFT JOIN newest n ON n.email = s.email
            UNION ALL
            SELECT (SELECT max(id) FROM stored) + 1 + first, name, raw_title, experience_years,
                   array_to_string(skills, '|'), phone, NULL, email, source_file, NULL, '2026-01-01'
            FROM newest WHERE email IS NULL OR email NOT IN (SELECT email FROM stored WHERE email IS NOT NULL)
"""

CENTER = """
center AS (
    SELECT list(m ORDER BY i) AS v FROM (
        SELECT i, avg(x) AS m FROM (
            SELECT unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY i)
)
"""

CENTERS = """
centers AS (
    SELECT query_id, list(m ORDER BY i) AS v FROM (
        SELECT query_id, i, avg(x) AS m FROM (
            SELECT label AS query_id, unnest(embedding)::DOUBLE AS x,
                   generate_subscripts(embedding, 1) AS i FROM embeddings)
        GROUP BY query_id, i)
    GROUP BY query_id
)
"""

SIMS = f"""
{CENTERS},
sims AS (
    SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS s
    FROM embeddings, centers
),
hits AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM sims
)
"""


def score(s: str) -> str:
    return f"least(greatest(({s} - 0.2) / 0.6 * 100, 0), 100)"


def tier(s: str) -> str:
    return (
        f"CASE WHEN {score(s)} >= 70 THEN 'High Match' "
        f"WHEN {score(s)} >= 40 THEN 'Moderate Match' ELSE 'Low Match' END"
    )


BITS, DIMS, CELLS = PROBES["bits"], PROBES["dimensions"], PROBES["probes"]

CELLED = f"""
{CENTERS},
planes AS (
    SELECT b, list(CASE WHEN md5(b || ':' || d)[1:1] < '8' THEN 1.0::DOUBLE ELSE -1.0 END ORDER BY d) AS p
    FROM range({BITS}) x(b), range({DIMS}) y(d) GROUP BY b
),
corpus AS (
    SELECT vec_id, sum(CASE WHEN list_dot_product(embedding::DOUBLE[], p) >= 0 THEN 1 << b ELSE 0 END)::INT AS cell
    FROM embeddings, planes GROUP BY vec_id
),
margins AS (SELECT query_id, b, list_dot_product(v, p) AS m FROM centers, planes),
homes AS (SELECT query_id, sum(CASE WHEN m >= 0 THEN 1 << b ELSE 0 END)::INT AS home FROM margins GROUP BY query_id),
probed AS (
    SELECT query_id, cell FROM (
        SELECT query_id, c::INT AS cell, round(sum((xor(c::INT, home) >> b::INT & 1) * m * m), 9) AS cost
        FROM margins JOIN homes USING (query_id), range(1 << {BITS}) z(c) GROUP BY query_id, c)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY cost, cell) <= {CELLS}
),
near AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM (
        SELECT query_id, vec_id, cell, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS s
        FROM probed JOIN corpus USING (cell) JOIN embeddings USING (vec_id) JOIN centers USING (query_id))
)
"""


TEXTS = f"""
{BASE},
texts AS (
    SELECT id, name, raw_title, experience_years, phone, email, {skill_list('skills', listed(TAXONOMY))} AS known,
           'Title: ' || COALESCE(raw_title, 'None') || '. Experience: '
           || COALESCE(experience_years::VARCHAR, 'None') || ' years. Skills: '
           || replace({skill_list('skills', listed(TAXONOMY))}, '|', ', ') || '.' AS text
    FROM candidates
)
"""


def buckets(source: str, key: str, body: str, dims: int) -> str:
    return f"""
    SELECT {key}, bucket, count(*)::INT AS weight FROM (
        SELECT {key}, ('0x' || md5(word)[1:8])::BIGINT % {dims} AS bucket FROM (
            SELECT {key}, unnest(regexp_extract_all(lower({body}), '[a-z0-9]+')) AS word FROM {source}))
    GROUP BY {key}, bucket
    """


MEMBERS = """
members AS (
    SELECT source AS archive, doc_id AS pos, n_chars AS file_size,
           CASE WHEN doc_id % 50 = 0 THEN 0 ELSE n_chars // (1 + doc_id % 120) END AS compress_size,
           CASE doc_id % 9 WHEN 0 THEN 'cv/' || doc_id || '.pdf' WHEN 1 THEN doc_id || '.PDF'
                WHEN 2 THEN 'cv/' || doc_id || '.docx' WHEN 3 THEN doc_id || '.txt'
                WHEN 4 THEN doc_id || '.png' WHEN 5 THEN '__MACOSX/' || doc_id || '.pdf'
                WHEN 6 THEN 'cv/.' || doc_id || '.txt' WHEN 7 THEN doc_id || '.exe'
                ELSE 'cv/' || doc_id || '/' END AS member
    FROM documents
),
leaves AS (SELECT *, string_split(member, '/')[-1] AS leaf FROM members),
suffixes AS (SELECT *, lower(regexp_extract(leaf, '^.+(\\.[^.]+)$', 1)) AS suffix FROM leaves)
"""
USABLE = (
    "(member NOT LIKE '\\_\\_MACOSX%' ESCAPE '\\' AND member NOT LIKE '%/' AND leaf <> '' AND leaf NOT LIKE '.%' AND ("
    + " OR ".join(f"lower(leaf) LIKE '%{e}'" for e in SUPPORTED_EXTENSIONS)
    + "))"
)

CHECKED = f"""
{MEMBERS},
usable AS (
    SELECT *, CASE WHEN compress_size > 0 THEN file_size::DOUBLE / compress_size END AS ratio
    FROM leaves WHERE {USABLE}
),
broken AS (
    SELECT archive, member, rule FROM (
        SELECT *, CASE WHEN file_size > {LIMITS.file_bytes} THEN 'file too large'
                       WHEN ratio > {LIMITS.ratio} THEN 'ratio too high' END AS rule FROM usable)
    WHERE rule IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY archive ORDER BY pos) = 1
),
stats AS (
    SELECT a.archive, count(u.pos) AS files, COALESCE(sum(u.file_size), 0)::BIGINT AS total_bytes,
           max(u.file_size) AS largest_file, round(max(u.ratio), 6) AS largest_ratio
    FROM (SELECT DISTINCT archive FROM members) a LEFT JOIN usable u USING (archive) GROUP BY a.archive
),
checked AS (
    SELECT s.*, CASE WHEN files = 0 THEN 'no supported files' WHEN files > {LIMITS.files} THEN 'too many files'
                     WHEN total_bytes > {LIMITS.total_bytes} THEN 'too large in total' ELSE rule END AS rejection,
           CASE WHEN files > 0 AND files <= {LIMITS.files} AND total_bytes <= {LIMITS.total_bytes}
                THEN member END AS member
    FROM stats s LEFT JOIN broken USING (archive)
)
"""

STATES = " ".join(f"WHEN '{kind}' THEN '{state}'" for kind, state in EVENT_STATES.items())
TASKS = f"""
tasks AS (
    SELECT 'b' || user_id AS batch_id, event_id AS pos, 't' || event_id AS task_id,
           'f' || json_extract_string(props, '$.k') AS file,
           CASE event_type {STATES} END AS reported, event_type
    FROM events
),
status AS (
    SELECT *, COALESCE(reported, 'PENDING') AS state,
           CASE event_type WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'pending' END AS status
    FROM tasks
)
"""

RESULTS = f"""
WITH {BASE}
SELECT name, raw_title, experience_years, array_to_string(skills, '|') AS skills, phone, email, source_file, batch_id
FROM candidates
"""

FINISHED = f"""
WITH {TASKS}
SELECT batch_id, count(DISTINCT file) AS total,
       count(DISTINCT CASE WHEN status <> 'pending' THEN file END) AS finished,
       count(DISTINCT file) = count(DISTINCT CASE WHEN status <> 'pending' THEN file END) AS complete
FROM status GROUP BY batch_id
"""

REPLIES = """
replies AS (
    SELECT event_id,
           '{"name": "User ' || user_id || '", "raw_title": "' || event_type || '", "experience_years": '
           || CASE event_id % 9 WHEN 1 THEN '"' || k || '"' WHEN 2 THEN k || '.5' WHEN 3 THEN 'null'
                                WHEN 4 THEN '"many"' ELSE k END
           || ', "phone": null, "email": null'
           || CASE event_id % 9 WHEN 7 THEN '' WHEN 5 THEN ', "skills": [1]' WHEN 6 THEN ', "skills": []'
                                ELSE ', "skills": ["welder ", "Juggler", "PLUMBER", "Welder"]' END
           || CASE event_id % 9 WHEN 8 THEN '' ELSE '}' END AS reply
    FROM (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
)
"""


def unit(*parts: str) -> str:
    joined = " || '|' || ".join(f"({part})::VARCHAR" for part in parts)
    return f"('0x' || md5({joined})[1:8])::BIGINT / 4294967296.0::DOUBLE"


def draw(low: int, high: int, salt: str) -> str:
    return f"(floor({unit('i', text(salt))} * {high - low + 1}) + {low})::INT"


SEEDS = f"""
pools AS (
    SELECT i, {listed(TRADES)}[{draw(1, len(TRADES), 'trade')}] AS trade,
           {listed(FIRST_NAMES)}[{draw(1, len(FIRST_NAMES), 'first')}] AS first,
           {listed(LAST_NAMES)}[{draw(1, len(LAST_NAMES), 'last')}] AS last
    FROM (SELECT c_custkey AS i FROM customer)
),
others AS (
    SELECT i, list(t ORDER BY md5(i::VARCHAR || '|' || t)) AS shuffled
    FROM pools, (SELECT unnest({listed(TRADES)}) AS t) WHERE t <> trade GROUP BY i
)
"""

EXTRACTED = f"""
SELECT doc_id, emails[1] AS email, len(emails) AS n_emails, numbers[1] AS phone,
       list_filter(list_transform(numbers, lambda p: {phone_key('p')}), lambda p: p IS NOT NULL)[1]
           AS phone_normalized,
       len(numbers) AS n_phones,
       TRY_CAST(nullif(regexp_extract(text, {text(YEARS)}, 1), '') AS INT) AS experience_years
FROM (SELECT doc_id, text, regexp_extract_all(text, {text(EMAIL)}) AS emails,
             regexp_extract_all(text, {text(PHONE)}) AS numbers FROM documents)
"""

ATTEMPT = "(json_extract_string(props, '$.k')::INT % 12)"


def registered() -> dict[str, str]:
    return {
        "topk_cosine": f"""
            WITH {CENTER},
            sims AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS s
                     FROM embeddings, center)
            SELECT row_number() OVER (ORDER BY s DESC, vec_id)::INT AS rank, vec_id, label,
                   round(s, 6) AS similarity
            FROM sims ORDER BY s DESC, vec_id LIMIT 10""",
        "topk_calibrated": f"""
            WITH {SIMS}
            SELECT query_id, vec_id, round(s, 3) AS raw_similarity, round({score('s')}, 1) AS match_score,
                   {tier('s')} AS confidence_tier, count(*) OVER (PARTITION BY query_id) AS total_evaluated
            FROM hits WHERE rank <= 5""",
        "topk_filtered": f"""
            WITH {BASE}, {CENTER},
            sims AS (SELECT id, name, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS s
                     FROM candidates JOIN embeddings ON vec_id = id, center WHERE name IS NOT NULL)
            SELECT row_number() OVER (ORDER BY s DESC, id)::INT AS rank, id, name, round(s, 6) AS similarity
            FROM sims ORDER BY s DESC, id LIMIT 10""",
        "topk_batch": f"""
            WITH {SIMS}
            SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM hits WHERE rank <= 5""",
        "topk_every_vector": """
            SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM (
                    SELECT q.vec_id AS query_id, c.vec_id,
                           round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s
                    FROM embeddings q, embeddings c))
            WHERE rank <= 5""",
        "ann_pq": """
            SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM (
                SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM (
                    SELECT q.vec_id AS query_id, c.vec_id,
                           round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS s
                    FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0))
            WHERE rank <= 5""",
        "ann_lsh": f"""
            WITH {CELLED}
            SELECT query_id, rank, vec_id, cell, round(s, 6) AS similarity FROM near WHERE rank <= 5""",
        "ann_recall": f"""
            WITH {CELLED},
            sims AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], v), 9) AS s
                     FROM embeddings, centers),
            exact AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank
                      FROM sims)
            SELECT e.query_id, count(*) AS exact_hits, count(n.vec_id) AS found_hits
            FROM exact e LEFT JOIN near n ON n.query_id = e.query_id AND n.vec_id = e.vec_id AND n.rank <= 5
            WHERE e.rank <= 5 GROUP BY e.query_id""",
        "search_candidates": f"""
            WITH {TEXTS},
            named AS (SELECT * FROM texts WHERE name IS NOT NULL),
            titles AS (SELECT DISTINCT raw_title AS query_id FROM texts),
            cv AS ({buckets('named', 'id', 'text', 384)}),
            qv AS ({buckets('titles', 'query_id', 'query_id', 384)}),
            cn AS (SELECT id, sqrt(sum(weight * weight)) AS n FROM cv GROUP BY id),
            qn AS (SELECT query_id, sqrt(sum(weight * weight)) AS n FROM qv GROUP BY query_id),
            dots AS (SELECT id, query_id, sum(cv.weight * qv.weight) AS d FROM cv JOIN qv USING (bucket)
                     GROUP BY id, query_id),
            sims AS (SELECT named.id, qn.query_id, round(COALESCE(d, 0) / (cn.n * qn.n), 9) AS s
                     FROM named JOIN cn USING (id) CROSS JOIN qn
                     LEFT JOIN dots ON dots.id = named.id AND dots.query_id = qn.query_id),
            hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id)::INT AS rank
                     FROM sims)
            SELECT query_id, rank, id, name, raw_title AS title, experience_years, known AS skills,
                   round(s, 3) AS raw_similarity, round({score('s')}, 1) AS match_score,
                   {tier('s')} AS confidence_tier, phone, email
            FROM hits JOIN named USING (id) WHERE rank <= 5""",
        "extract_contacts": EXTRACTED,
        "normalize_phone": f"WITH {BASE} SELECT id, phone, phone_normalized FROM candidates",
        "placeholder_report": f"""
            WITH {BASE}
            SELECT CASE WHEN phone IS NULL THEN 'missing'
                        WHEN length(regexp_replace(phone, '[^0-9]', '', 'g')) < 10 THEN 'too short'
                        WHEN phone_normalized IS NULL THEN 'placeholder' ELSE 'usable' END AS kind,
                   count(*) AS n
            FROM candidates GROUP BY ALL""",
        "duplicate_phones": f"""
            WITH {BASE}
            SELECT phone_normalized AS key, count(*) OVER (PARTITION BY phone_normalized) AS n, id
            FROM candidates WHERE phone_normalized IS NOT NULL
            QUALIFY count(*) OVER (PARTITION BY phone_normalized) > 1""",
        "duplicate_phones_top": f"""
            WITH {BASE}
            SELECT '...' || right(key, 4) AS phone, n FROM (
                SELECT phone_normalized AS key, count(*) AS n FROM candidates
                WHERE phone_normalized IS NOT NULL GROUP BY ALL HAVING count(*) > 1
                ORDER BY n DESC, key LIMIT 20)""",
        "phone_backfill": f"""
            WITH {BASE}
            SELECT id, phone, CASE WHEN id % 3 = 0 THEN 'kept' || id ELSE phone_normalized END AS phone_normalized
            FROM candidates""",
        "normalize_skills": f"WITH {BASE} SELECT id, {skill_list('skills', listed(TAXONOMY))} AS skills FROM candidates",
        "map_skills_table": f"""
            WITH {BASE}, vocabulary AS (SELECT list(DISTINCT raw_title) AS labels FROM candidates)
            SELECT id, {skill_list('skills', 'labels')} AS skills FROM candidates, vocabulary""",
        "embedding_text": f"WITH {TEXTS} SELECT id, text FROM texts",
        "hash_encode": f"WITH {TEXTS} SELECT id, bucket::INT AS bucket, weight FROM ({buckets('texts', 'id', 'text', 384)})",
        "missing_vectors": f"""
            WITH {TEXTS},
            made AS (SELECT id, sum(weight) AS total FROM ({buckets('texts', 'id', 'text', 64)}) GROUP BY id)
            SELECT id, vec_id IS NOT NULL AS had_vector, 64 AS dims,
                   round(CASE WHEN vec_id IS NULL THEN total ELSE list_sum(embedding::DOUBLE[]) END, 4)::DOUBLE AS total
            FROM texts JOIN made USING (id) LEFT JOIN embeddings ON vec_id = id""",
        "merge_last_wins": f"""
            WITH {BASE}
            SELECT seq, name, phone_normalized, email, source_file, batch_id FROM candidates
            QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY seq DESC) = 1""",
        "merge_full": MERGED,
        "merge_outcomes": OUTCOMES,
        "merge_rejected": REJECTED,
        "merge_by_email": LOADED,
        "load_results": f"SELECT * EXCLUDE (id) FROM ({LOADED})",
        "pending_files": """
            SELECT doc_id, 'doc' || doc_id || '.txt' AS source_file FROM documents d
            WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
        "pending_counts": """
            SELECT count(*) AS found, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS skipped,
                   count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS pending FROM documents""",
        "append_union": f"""
            WITH {BASE}, {STORED}
            SELECT id, name, email, source_file, batch_id FROM stored
            UNION ALL SELECT id, name, email, source_file, batch_id FROM candidates""",
        "batch_status": f"""
            WITH {TASKS},
            counts AS (SELECT batch_id, count(*) AS total, count(*) FILTER (status = 'done') AS done,
                              count(*) FILTER (status = 'failed') AS failed,
                              count(*) FILTER (status = 'pending') AS pending
                       FROM status GROUP BY batch_id)
            SELECT *, done + failed = total AS complete, round((done + failed)::DOUBLE / total, 3) AS progress
            FROM counts""",
        "batch_files": f"""
            WITH {TASKS}
            SELECT batch_id, pos, task_id, file, state, status,
                   CASE WHEN status = 'failed' THEN 'PermanentExtractionError' END AS error FROM status""",
        "batch_finished": FINISHED,
        "archive_entries": f"""
            WITH {MEMBERS},
            numbered AS (SELECT *, row_number() OVER (PARTITION BY archive ORDER BY pos) - 1 AS idx
                         FROM suffixes WHERE {USABLE})
            SELECT archive, idx, member, CASE WHEN idx > 9999 THEN idx::VARCHAR ELSE lpad(idx::VARCHAR, 5, '0') END || suffix AS spool_name
            FROM numbered""",
        "spool_names": """
            SELECT event_id, CASE WHEN event_id + 95000 > 9999 THEN (event_id + 95000)::VARCHAR
                                  ELSE lpad((event_id + 95000)::VARCHAR, 5, '0') END || '.pdf' AS spool_name FROM events""",
        "batch_keys": "SELECT page_id, sha256(url || chr(0) || page_id::VARCHAR) AS batch_key FROM pages",
        "dispatch_tasks": f"""
            WITH {CHECKED},
            accepted AS (SELECT u.member, sha256(u.archive || chr(0) || '1767225600') AS batch_id,
                                row_number() OVER (PARTITION BY u.archive ORDER BY u.pos) - 1 AS pos
                         FROM usable u JOIN checked c ON c.archive = u.archive AND c.rejection IS NULL)
            SELECT batch_id, pos, sha256(batch_id || chr(0) || pos::VARCHAR) AS task_id, member AS file FROM accepted""",
        "manifest_payloads": """
            SELECT 'b' || user_id AS batch_id, 0::BIGINT AS pos, 't' || event_id AS task_id,
                   'f' || json_extract_string(props, '$.k') AS file FROM events WHERE event_id % 5 > 1
            UNION ALL
            SELECT 'b' || user_id, 1::BIGINT, 'u' || event_id, NULL FROM events WHERE event_id % 5 > 1""",
        "manifest_unexpired": f"""
            WITH {TASKS}
            SELECT batch_id, pos, task_id, file FROM tasks JOIN events ON event_id = pos
            WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY""",
        "json_lines": RESULTS,
        "prior_results": RESULTS,
        "json_array": RESULTS,
        "unpacked_members": """
            SELECT archive, idx, member, lpad(idx::VARCHAR, 5, '0') || '.txt' AS spool_name, content_sha256, NULL::VARCHAR AS error FROM (
                SELECT 'a' || lpad((doc_id // 200)::VARCHAR, 6, '0') || '.zip' AS archive, 'cv/' || doc_id || '.txt' AS member,
                       row_number() OVER (PARTITION BY doc_id // 200 ORDER BY doc_id) - 1 AS idx, sha256(coalesce(text, '')) AS content_sha256
                FROM documents WHERE doc_id % 9 <> 7)""",
        "task_summaries": "SELECT * EXCLUDE (embedding) FROM embeddings",
        "archive_limits": f"""
            WITH {CHECKED}
            SELECT archive, files, total_bytes, largest_file, largest_ratio, rejection, member FROM checked""",
        "upload_receipts": f"""
            WITH {CHECKED}
            SELECT sha256(u.archive) AS batch_id, count(*) AS queued, string_agg(u.member, '|' ORDER BY pos) AS files
            FROM usable u JOIN checked c ON c.archive = u.archive AND c.rejection IS NULL GROUP BY u.archive""",
        "route_by_extension": f"""
            WITH {MEMBERS}
            SELECT pos, leaf, suffix,
                   CASE WHEN suffix IN ('.docx', '.txt') THEN 'text'
                        WHEN suffix IN ('.pdf', '.jpg', '.jpeg', '.png') THEN 'binary' ELSE 'unsupported' END AS route,
                   CASE suffix WHEN '.pdf' THEN 'application/pdf' WHEN '.png' THEN 'image/png'
                               WHEN '.jpg' THEN 'image/jpeg' WHEN '.jpeg' THEN 'image/jpeg' END AS mime_type
            FROM suffixes""",
        "parse_json_records": f"""
            WITH {REPLIES},
            valid AS (SELECT event_id, CASE WHEN json_valid(reply) THEN reply::JSON END AS j FROM replies),
            typed AS (
                SELECT event_id, j,
                       TRY_CAST(CASE WHEN regexp_matches(trim(j->>'$.experience_years'), '^[+-]?[0-9]+(\\.0*)?$')
                                     THEN j->>'$.experience_years' END AS INT) AS years,
                       json_type(j, '$.experience_years') AS kind,
                       (j->'$.skills')::JSON[] AS skills
                FROM valid),
            judged AS (
                SELECT *, COALESCE(skills IS NOT NULL AND (kind = 'NULL' OR years IS NOT NULL)
                    AND len(list_filter(skills, lambda s: json_type(s) <> 'VARCHAR')) = 0, false) AS ok FROM typed)
            SELECT event_id, CASE WHEN NOT ok THEN 'PermanentExtractionError' END AS error_class,
                   CASE WHEN ok THEN j->>'$.name' END AS name, CASE WHEN ok THEN j->>'$.raw_title' END AS raw_title,
                   CASE WHEN ok THEN years END AS experience_years,
                   CASE WHEN NOT ok THEN NULL WHEN len(skills) = 0 THEN 'Other' ELSE 'Welder|Plumber' END AS skills
            FROM judged""",
        "retry_delay": f"""
            SELECT event_id, {ATTEMPT} AS attempt,
                   floor(least(pow(2, {ATTEMPT}) + 2, 600) * (0.8::DOUBLE + 0.4::DOUBLE * {unit('event_id', ATTEMPT)}))::INT AS delay,
                   CASE WHEN {ATTEMPT} < 5 THEN (pow(2, {ATTEMPT}) + 2)::INT END AS batch_delay
            FROM events""",
        "error_classes": """
            SELECT event_id, CASE WHEN kind IN ('network', 'server') THEN 'transient'
                WHEN kind = 'api' AND (COALESCE(code IN (429, 500, 503), false)
                                       OR COALESCE(status IN ('UNAVAILABLE', 'INTERNAL'), false)) THEN 'transient'
                ELSE 'permanent' END AS error_kind
            FROM (SELECT event_id, ['network', 'server', 'api', 'other'][(event_id % 4 + 1)::INT] AS kind,
                         [400, 401, 404, 429, 500, 503, NULL][(event_id % 7 + 1)::INT] AS code,
                         ['UNAVAILABLE', 'NOT_FOUND', 'INTERNAL', NULL][(event_id // 4 % 4 + 1)::INT] AS status
                  FROM events)""",
        "cache_keys": """
            SELECT item_id, 'search:v1:' || sha256(text || chr(0) || (5 + item_id % 3)::VARCHAR) AS cache_key
            FROM benchmark""",
        "vector_text": "SELECT vec_id, len(embedding)::INT AS dims, true AS unchanged FROM embeddings",
        "seed_candidates": f"""
            WITH {SEEDS}
            SELECT i AS index, first || ' ' || last AS name, trade AS raw_title,
                   {draw(0, 25, 'years')} AS experience_years,
                   CASE WHEN {unit('i', text('phone'))} >= 0.05 THEN '(' || {draw(200, 999, 'area')} || ') 555-'
                        || {draw(1000, 9999, 'line')} END AS phone,
                   lower(first) || '.' || replace(lower(last), '''', '') || i || '@example.com' AS email,
                   array_to_string(list_concat([trade], shuffled[1:{draw(0, 3, 'extra')}]), '|') AS skills,
                   'synthetic_' || i || '.pdf' AS source_file,
                   {listed(CITIES)}[{draw(1, len(CITIES), 'city')}] AS city
            FROM pools JOIN others USING (i)""",
        "stream_ingest": MERGED,
        "stream_rejected": f"""
            WITH RECURSIVE {REPLAY}
            SELECT c.seq, c.name, c.raw_title, array_to_string(c.skills, '|') AS skills, c.phone, c.email
            FROM replay JOIN candidates c USING (seq) WHERE act = 'reject'""",
        "stream_skip_known": f"""
            WITH RECURSIVE {REPLAY},
            accepted AS (SELECT c.batch_id, c.source_file FROM replay JOIN candidates c USING (seq) WHERE act <> 'reject')
            SELECT c.seq, c.batch_id, c.source_file FROM candidates c
            WHERE NOT EXISTS (SELECT 1 FROM accepted a
                              WHERE a.batch_id = c.batch_id AND a.source_file = c.source_file)""",
        "stream_status": FINISHED,
        "stream_status_ttl": FINISHED,
        "stream_extract": f"""
            WITH extracted AS ({EXTRACTED}),
            sent AS (SELECT doc_id, coalesce(length(text) % 11, 5) AS r FROM documents)
            SELECT doc_id || '.txt' AS file,
                   CASE WHEN r IN (3, 7) THEN 'exhausted' WHEN r = 5 THEN 'failed' ELSE 'done' END AS outcome,
                   CASE WHEN r IN (3, 7) THEN 6 ELSE 1 END AS attempts,
                   CASE WHEN r NOT IN (3, 5, 7) THEN email END AS email,
                   CASE WHEN r NOT IN (3, 5, 7) THEN phone END AS phone,
                   CASE WHEN r NOT IN (3, 5, 7) THEN experience_years END AS experience_years
            FROM sent JOIN extracted USING (doc_id)""",
        "admitted_files": """
            SELECT 'item' || item_id || '.txt' AS source_file, strlen(text) AS length, sha256(text) AS content_sha256, 0 AS attempt
            FROM benchmark WHERE text IS NOT NULL""",
        "stream_retry": f"""
            SELECT event_id AS file,
                   CASE WHEN {ATTEMPT} > 5 THEN 'exhausted' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END
                       AS outcome,
                   least({ATTEMPT}, 5) + 1 AS attempts,
                   CASE WHEN {ATTEMPT} > 5 THEN 'transient' WHEN event_type = 'error' THEN 'permanent' END AS error_class
            FROM events""",
    }
