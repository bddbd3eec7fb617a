from checks.base import ip, with_ev, with_lab

NAMES = """nm AS (SELECT s_suppkey AS request_id, CASE s_suppkey % 5 WHEN 0 THEN 'node-' || s_suppkey WHEN 1 THEN 'ODE-' || s_suppkey
    WHEN 2 THEN 'depot DEV-' || s_suppkey WHEN 3 THEN '10.0.0.' || s_suppkey ELSE 'nowhere ' || s_suppkey END AS name FROM supplier)"""


def resolution(names: str, values: str, value: str, words: bool = True) -> str:
    """CTEs {names}_m (stage matches) and {names}_v (verdicts)."""
    by_word = f"""UNION ALL SELECT DISTINCT name, {value}, 'words' FROM (SELECT name, unnest(regexp_split_to_array(name, '[\\s_-]+')) AS w
        FROM {names} WHERE name NOT IN (SELECT name FROM {names}_e) AND name NOT IN (SELECT name FROM {names}_s)) x
      JOIN {values} ON length(w) >= 3 AND contains(lower({value}), lower(w))""" if words else ""
    return f"""{names}_e AS (SELECT DISTINCT name, {value} FROM {names} JOIN {values} ON name = {value}),
{names}_s AS (SELECT DISTINCT name, {value} FROM {names} JOIN {values} ON contains(lower({value}), lower(trim(name))) WHERE name NOT IN (SELECT name FROM {names}_e)),
{names}_m AS (SELECT name, {value}, 'exact' AS stage FROM {names}_e UNION ALL SELECT name, {value}, 'substring' FROM {names}_s {by_word}),
{names}_v AS (SELECT n.name, CASE count({value}) WHEN 0 THEN 'none' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS verdict,
    CASE WHEN count({value}) = 1 THEN min({value}) END AS {value}, count({value}) AS match_count, min(stage) AS stage
  FROM (SELECT DISTINCT name FROM {names}) n LEFT JOIN {names}_m USING (name) GROUP BY 1)"""


HOSTS = "hosts AS (SELECT DISTINCT hostname FROM lab), progs AS (SELECT DISTINCT program FROM lab)"
REASONS = ("rare_template", "always_severe", "security_content", "severity_spike", "volume_spike",
           "unusual_template_mix", "unusual_transition", "interface_flapping")
_R = ", ".join(f"('{r}')" for r in REASONS)
_PH = ["volume spike", "spike", "ethernet flap", "wireless drops", "severe templates", "Rare_Template",
       "unusual transitions", "security", "radio disconnect"]
PHRASES = "ph AS (SELECT event_id, CASE k % 12 " + " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PH)) + \
    " ELSE message END AS phrase FROM ev JOIN (SELECT event_id, k FROM seed) USING (event_id))"
_SYN = ["disconnect", "dropout", "drop", "link down", "goes down", "going down"]
_WIFI = ["wireless", "wifi", "wi-fi", "radio"]
_any = lambda words: "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"
RESOLVED_REASONS = f"""dp AS (SELECT DISTINCT phrase, trim(lower(phrase)) AS l FROM ph),
sw AS (SELECT phrase, unnest(list_distinct(regexp_extract_all(l, '[a-z]+'))) AS w FROM dp),
sp AS (SELECT r, unnest(string_split(r, '_')) AS p FROM (VALUES {_R}) t(r)),
sc AS (SELECT phrase, r, count(DISTINCT p) AS s FROM sw JOIN sp ON w = p OR (length(w) >= 4 AND length(p) >= 4 AND (starts_with(p, w) OR starts_with(w, p))) GROUP BY 1, 2),
bs AS (SELECT phrase, list(r ORDER BY list_position({list(REASONS)}, r)) AS m FROM sc QUALIFY TRUE GROUP BY phrase, s HAVING s = (SELECT max(s) FROM sc x WHERE x.phrase = sc.phrase)),
rr AS (SELECT dp.phrase, l, coalesce(m, []) AS m, l IN {REASONS} AS exact FROM dp LEFT JOIN bs USING (phrase)),
rs AS (SELECT phrase, CASE WHEN exact THEN l WHEN len(m) = 1 THEN m[1] WHEN len(m) = 0 AND NOT {_any(_WIFI)} AND {_any(_SYN)} THEN 'interface_flapping' END AS reason,
    CASE WHEN exact OR len(m) = 1 OR (len(m) = 0 AND NOT {_any(_WIFI)} AND {_any(_SYN)}) THEN 'resolved' WHEN len(m) > 1 THEN 'ambiguous' ELSE 'none' END AS verdict,
    CASE WHEN NOT exact AND len(m) > 1 THEN array_to_string(m, ',') END AS candidates FROM rr)"""
RESOLVED_REASONS = RESOLVED_REASONS.replace(" QUALIFY TRUE", "")
REQUESTS = """rq AS (SELECT request_id, CASE WHEN request_id % 7 <> 0 THEN name END AS hostname,
    CASE request_id % 3 WHEN 0 THEN 'interface' WHEN 1 THEN 'sshd' END AS program FROM nm)"""


def _n(h: str, p: str) -> str:
    return f"(SELECT coalesce(CAST(sum(n) AS BIGINT), 0) FROM cell WHERE ({h} IS NULL OR cell.hostname = {h}) AND ({p} IS NULL OR cell.program = {p}))"


COUNTED = f"""cell AS (SELECT hostname, program, count(*) AS n FROM lab GROUP BY 1, 2),
c1 AS (SELECT rq.*, {_n('rq.hostname', 'rq.program')} AS n FROM rq),
c2 AS (SELECT c1.request_id, CASE WHEN c1.n = 0 AND v.verdict = 'resolved' THEN v.hostname ELSE c1.hostname END AS hostname, c1.program, c1.n AS n1
    FROM c1 LEFT JOIN nm_v v ON v.name = c1.hostname),
c3 AS (SELECT *, CASE WHEN n1 > 0 THEN n1 ELSE {_n('c2.hostname', 'c2.program')} END AS n2 FROM c2),
c4 AS (SELECT request_id, hostname, CASE WHEN n2 = 0 AND program = 'interface' THEN 'interface,info' ELSE program END AS program, n2 FROM c3)"""


def cosine(docs: str, queries: str, k: int) -> str:
    return f"""SELECT query_id, doc_id, score, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (
        SELECT q.id AS query_id, d.id AS doc_id, round(list_cosine_similarity(CAST(q.e AS DOUBLE[]), CAST(d.e AS DOUBLE[])), 6) AS score
        FROM {docs} d, {queries} q)) WHERE rank <= {k}"""


def bm(docs: str, queries: str, k: int, p: str) -> str:
    """CTE {p}top: ranking of docs(id, text) for queries(id, text)."""
    words = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
    return f"""{p}qt AS (SELECT id AS query_id, t AS token, count(*) AS qtf FROM (SELECT id, unnest({words}) AS t FROM {queries}) GROUP BY 1, 2),
{p}dt AS (SELECT id AS doc_id, {words} AS ts, len({words}) AS dl FROM {docs}),
{p}st AS (SELECT count(*) AS n, avg(dl) AS l FROM {p}dt),
{p}tf AS (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, dl, unnest(ts) AS token FROM {p}dt) WHERE token IN (SELECT token FROM {p}qt) GROUP BY 1, 2, 3),
{p}df AS (SELECT token, count(*) AS df FROM {p}tf GROUP BY 1),
{p}sc AS (SELECT query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / l))), 6) AS score
    FROM {p}tf JOIN {p}df USING (token) JOIN {p}qt USING (token), {p}st GROUP BY 1, 2),
{p}top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM {p}sc) WHERE rank <= {k})"""


_D = "bd AS (SELECT doc_id AS id, text FROM documents), bq AS (SELECT item_id AS id, text FROM benchmark)"
_H = """hd AS (SELECT doc_id AS id, text, embedding AS e FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
hq AS (SELECT item_id AS id, text, embedding AS e FROM benchmark LEFT JOIN embeddings ON vec_id = item_id),
hde AS (SELECT * FROM hd WHERE e IS NOT NULL), hqe AS (SELECT * FROM hq WHERE e IS NOT NULL)"""
DAY = "TIMESTAMP '2024-01-01' + to_days(CAST(s_suppkey % 30 AS INTEGER))"
COVER = f"""cr AS (SELECT s_suppkey AS request_id, CASE WHEN s_suppkey % 4 <> 3 THEN {ip('s_suppkey')} END AS source_ip,
    CASE WHEN s_suppkey % 4 > 1 THEN 'juniper' END AS vendor, CASE WHEN s_suppkey % 4 <> 1 THEN {DAY} END AS s,
    CASE WHEN s_suppkey % 4 <> 1 THEN {DAY} + INTERVAL 12 HOUR END AS f FROM supplier),
cj AS (SELECT cr.request_id, lab.is_anomaly, lab.event_time FROM cr JOIN lab ON (cr.source_ip IS NULL OR cr.source_ip = lab.source_ip)
    AND (cr.vendor IS NULL OR cr.vendor = lab.vendor) AND (s IS NULL OR lab.event_time >= s) AND (f IS NULL OR lab.event_time <= f)),
ca AS (SELECT request_id, count(*) AS total, count(*) FILTER (is_anomaly = 1) AS anomalous,
    count(*) FILTER (is_anomaly = 1 AND event_time < TIMESTAMP '2024-01-20') AS hits FROM cj GROUP BY 1)"""

QUESTIONS = """qs AS (SELECT DISTINCT event_type AS query_id, CASE event_type WHEN 'view' THEN 'which device has the most wireless disconnections'
    WHEN 'click' THEN 'top devices with interface link problems, mikrotik' WHEN 'error' THEN 'how many authentication failures for cisco happened'
    WHEN 'signup' THEN 'what are the recent login successes for sshd' ELSE 'show addresses assigned to clients' END AS question FROM events)"""
GENERIC = """['most','top','which','who','whose','device','devices','vendor','vendors','highest','worst','busiest','active','noisiest','the','a','an','is','for',
'with','by','of','has','have','give','me','what','show','and','to','in','that','how','many','much','count','number','total','events','happened','occur','occurred',
'there','were','was','did','logs','today','yesterday','tomorrow','week','month','year','this','last','next','ago','right','now','currently','presently','actually',
'really','just','simply','basically','immediately','still','please','overall','same','before','after','date','dates']"""


def concept(text: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({text}), '[a-z'']+'), "
            f"lambda w: length(w) >= 4 AND NOT list_contains({GENERIC}, w))")


TOPICS = f"""td AS (SELECT event_id AS id, message AS text FROM lab), tq AS (SELECT query_id AS id, array_to_string({concept('question')}, ' ') AS text FROM qs),
{bm('td', 'tq', 15, 't_')},
hits AS (SELECT query_id, question, doc_id, message, program FROM t_top JOIN lab ON event_id = doc_id JOIN qs USING (query_id)),
kvend AS (SELECT DISTINCT vendor FROM lab), kprog AS (SELECT DISTINCT program FROM lab),
hs AS (SELECT query_id, any_value(question) AS question, count(*) AS hits FROM hits GROUP BY 1),
wd AS (SELECT query_id, w AS word, count(*) AS document_frequency FROM (SELECT query_id, doc_id, unnest(list_distinct(list_transform(regexp_extract_all(message, '[A-Za-z][A-Za-z'']{{3,}}'), lambda x: lower(x)))) AS w FROM hits)
    WHERE w NOT IN ('wlan','wlan1','wlan2','info','debug','warning','error','notice','the','and','for','with','from','data','device','unknown','that','this','received','link',
      'sent','send','message','event','vendor','hostname','severity','program','category','source','anomaly') GROUP BY 1, 2),
wf AS (SELECT wd.*, hits, NOT (word IN (SELECT lower(vendor) FROM kvend) OR EXISTS (SELECT 1 FROM kprog WHERE contains(lower(program), word))) AS real,
    list_contains(list_transform(list_filter(regexp_extract_all(lower(question), '[a-z]+'), lambda x: length(x) >= 4), lambda x: x[1:4]), word[1:4]) AS stem,
    document_frequency >= greatest(2, (hits + 2) // 3) AS often, document_frequency >= 2 AS twice FROM wd JOIN hs USING (query_id)),
wa AS (SELECT *, often AND (real OR NOT bool_or(often AND real) OVER q) AS a, twice AND (real OR NOT bool_or(twice AND real) OVER q) AS b, bool_or(often) OVER q AS anyc
    FROM wf WINDOW q AS (PARTITION BY query_id)),
wk AS (SELECT *, CASE WHEN bool_or(a AND stem) OVER q THEN a AND stem WHEN bool_or(b AND stem) OVER q THEN b AND stem ELSE a END AS keep FROM wa WINDOW q AS (PARTITION BY query_id)),
ct AS (SELECT query_id, word, document_frequency, CAST(row_number() OVER (PARTITION BY query_id ORDER BY document_frequency DESC, word) AS INTEGER) AS place FROM wk WHERE keep AND anyc),
hp AS (SELECT query_id, program, count(*) AS hit_count FROM hits GROUP BY 1, 2),
spg AS (SELECT * FROM (SELECT *, hit_count / sum(hit_count) OVER (PARTITION BY query_id) AS share,
    CAST(row_number() OVER (PARTITION BY query_id ORDER BY hit_count DESC, program) AS INTEGER) AS place FROM hp))"""
SCOPE = f"""np AS (SELECT DISTINCT query_id, program FROM (SELECT query_id, unnest({concept('question')}) AS w FROM hs) JOIN kprog ON contains(lower(program), w)),
dm AS (SELECT DISTINCT query_id FROM spg s WHERE share >= 0.5 AND NOT EXISTS (SELECT 1 FROM np WHERE np.query_id = s.query_id AND np.program = s.program)),
np2 AS (SELECT np.* FROM np WHERE query_id NOT IN (SELECT query_id FROM dm) OR EXISTS (SELECT 1 FROM hp WHERE hp.query_id = np.query_id AND hp.program = np.program)),
scp AS (SELECT query_id, program FROM spg WHERE place <= 3 AND share >= 0.2 UNION SELECT * FROM np2),
mv AS (SELECT DISTINCT query_id, vendor FROM (SELECT query_id, trim(lower(w), '.,!?;:') AS w FROM (SELECT query_id, unnest(regexp_split_to_array(question, '\\s+')) AS w FROM hs))
    JOIN kvend ON lower(vendor) = w AND vendor <> 'unknown'),
key1 AS (SELECT query_id, word AS keyword FROM ct WHERE place = 1),
mt AS (SELECT k.query_id, k.keyword, lab.* FROM key1 k JOIN lab ON contains(lower(message), keyword)
    AND (program IN (SELECT program FROM scp WHERE scp.query_id = k.query_id) OR NOT EXISTS (SELECT 1 FROM scp WHERE scp.query_id = k.query_id))
    AND (vendor IN (SELECT vendor FROM mv WHERE mv.query_id = k.query_id) OR NOT EXISTS (SELECT 1 FROM mv WHERE mv.query_id = k.query_id)))"""


def _ranking(by: str) -> str:
    return with_lab(f"""SELECT query_id, keyword, {by}, event_count, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY event_count DESC, {by}) AS place
      FROM (SELECT query_id, keyword, {by}, count(*) AS event_count FROM mt WHERE event_time BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-31' GROUP BY 1, 2, 3)) WHERE place <= 10""",
      QUESTIONS, TOPICS, SCOPE)


_CLAIM = (r"(\d[\d,]*)\D{0,20}?(?:events?|logs?|log lines?|lines?|entries|occurrences?|times?)\b"
          r"|(?:events?|logs?|log lines?|lines?|entries|count(?:ed)?|total(?:\s+of)?)\D{0,12}?(\d[\d,]*)")

SQL = {
    "resolve_hostnames": with_lab("SELECT * FROM nm_v", NAMES, HOSTS, resolution("nm", "hosts", "hostname")),
    "resolve_programs": with_lab("SELECT * FROM pn_v", HOSTS,
        "pn AS (SELECT DISTINCT name FROM (SELECT unnest(string_split(program, ',')) AS name FROM progs UNION SELECT upper(substring(program, 2, 3)) FROM progs))",
        resolution("pn", "progs", "program", words=False)),
    "resolve_reasons": with_ev("SELECT event_id, ph.phrase, reason, verdict, candidates FROM ph JOIN rs ON rs.phrase = ph.phrase", PHRASES, RESOLVED_REASONS),
    "resolved_count": with_lab(f"SELECT request_id, hostname, program, CASE WHEN n2 > 0 THEN n2 ELSE {_n('c4.hostname', 'c4.program')} END AS event_count FROM c4",
        NAMES, HOSTS, resolution("nm", "hosts", "hostname"), REQUESTS, COUNTED),
    "knn_exact": "WITH d AS (SELECT vec_id AS id, embedding AS e FROM embeddings), q AS (SELECT vec_id AS id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0) " + cosine("d", "q", 10),
    "knn_approx": "WITH d AS (SELECT vec_id AS id, embedding AS e FROM embeddings), q AS (SELECT vec_id AS id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0) " + cosine("d", "q", 10),
    "bm25": f"WITH {_D}, {bm('bd', 'bq', 10, 'b_')} SELECT * FROM b_top",
    "hybrid_search": f"""WITH {_H}, {bm('hd', 'hq', 10, 'h_')}, kn AS ({cosine('hde', 'hqe', 10)}),
      fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, doc_id, rank FROM h_top UNION ALL SELECT query_id, doc_id, rank FROM kn) GROUP BY 1, 2)
      SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fu) WHERE rank <= 10""",
    "window_hits": with_lab("""SELECT event_id AS doc_id, event_time, source_ip, message FROM lab WHERE is_anomaly = 1 AND vendor = 'juniper'
      AND event_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'"""),
    "coverage": with_lab("""SELECT request_id, coalesce(total, 0) AS total, coalesce(anomalous, 0) AS anomalous,
        CASE WHEN coalesce(total, 0) = 0 THEN 'none' WHEN anomalous = 0 THEN 'never_indexed' ELSE 'not_indexed_yet' END AS verdict
      FROM cr LEFT JOIN ca USING (request_id) WHERE coalesce(hits, 0) = 0 AND (source_ip IS NOT NULL OR (s IS NOT NULL AND f IS NOT NULL))""", COVER),
    "summarize_hits": with_lab("""SELECT b.*, p.programs FROM (SELECT predicted_category AS category, count(*) AS message_count,
        array_to_string(list_sort(list_distinct(list(severity))), '/') AS severities, trim(arg_min(message, event_time)) AS example,
        array_to_string(list_sort(list_distinct(flatten(list(anomaly_reasons)))), ', ') AS reasons, min(event_time) AS first_time, max(event_time) AS last_time FROM lab GROUP BY 1) b
      LEFT JOIN (SELECT category, string_agg(program || ' x' || n, ', ' ORDER BY p) AS programs FROM (SELECT predicted_category AS category, program, count(*) AS n,
        row_number() OVER (PARTITION BY predicted_category ORDER BY count(*) DESC, min(event_time)) AS p FROM lab GROUP BY 1, 2) WHERE p <= 3 GROUP BY 1) p USING (category)"""),
    "concept_tokens": with_lab("SELECT * FROM ct", QUESTIONS, TOPICS),
    "significant_programs": with_lab("SELECT query_id, program, hit_count, round(share, 6) AS share, place FROM spg WHERE place <= 3 AND share >= 0.2", QUESTIONS, TOPICS),
    "concept_ranking": _ranking("hostname"),
    "concept_ranking_vendors": _ranking("vendor"),
    "concept_count": with_lab("""SELECT k.query_id, k.keyword, count(mt.event_id) AS event_count FROM key1 k
      LEFT JOIN mt ON mt.query_id = k.query_id AND mt.event_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-31' GROUP BY 1, 2""", QUESTIONS, TOPICS, SCOPE),
    "concept_listing": with_lab("""SELECT query_id, keyword, CAST(place AS INTEGER) AS place, event_id, event_time, hostname, message, n > 10 AS truncated FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY event_time DESC, event_id) AS place, count(*) OVER (PARTITION BY query_id) AS n FROM mt
        WHERE event_time BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-31') WHERE place <= 10""", QUESTIONS, TOPICS, SCOPE),
    "phrase_concept": f"SELECT conv_id, turn, nullif(array_to_string({concept('text')}, ' '), '') AS concept FROM conversations",
    "claim_audit": f"""WITH c AS (SELECT user_id AS u, count(*) AS n FROM events GROUP BY 1),
      t AS (SELECT u, n, 'The top 10 logs:   had ' || n || ' warning-severity events, a total of ' || (n + CASE WHEN u % 3 = 0 THEN 7 ELSE 0 END) || '.' AS text FROM c),
      m AS (SELECT u, n, unnest(list_concat(regexp_extract_all(text, '{_CLAIM}', 1, 'i'), regexp_extract_all(text, '{_CLAIM}', 2, 'i'))) AS v FROM t)
      SELECT DISTINCT u AS answer_id, CAST(replace(v, ',', '') AS BIGINT) AS value FROM m WHERE v <> '' AND CAST(replace(v, ',', '') AS BIGINT) NOT IN (10, n)""",
}
