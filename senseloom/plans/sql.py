"""SQL of the common tables, for DuckDB: an independent statement of what the operators compute."""

from senseloom.functions.stopwords import STOP_WORDS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def valid(token: str) -> str:
    return f"(NOT starts_with({token}, '##') AND length({token}) > 1 AND {token} NOT IN ({STOPS}))"


def cleaned(name: str, source: str, n: int, drop_query: bool) -> str:
    """Substitutes of ``source`` (lemma, file_id, pos, token, prev, next) after cleaning, as rows (lemma, file_id, pos, rank, sub, cnt)."""
    drop = "WHERE sub <> lemma" if drop_query else ""
    return f"""
{name}_raw AS (SELECT i.lemma, i.file_id, i.pos, f.token, f.lemma AS sub, f.cnt, row_number() OVER (PARTITION BY i.lemma, i.file_id, i.pos ORDER BY f.rank) AS place
  FROM {source} i JOIN fill f ON i.prev = f.prev AND i.next = f.next AND f.token <> i.token QUALIFY place <= 100),
{name}_one AS (SELECT * FROM {name}_raw QUALIFY row_number() OVER (PARTITION BY lemma, file_id, pos, sub ORDER BY place) = 1),
{name} AS (SELECT lemma, file_id, pos, row_number() OVER (PARTITION BY lemma, file_id, pos ORDER BY place) AS rank, sub, cnt FROM {name}_one {drop} QUALIFY rank <= {n})"""


TOKENS = rf"""
tok AS MATERIALIZED (SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY wo, po) - 1 AS pos, CASE WHEN po > 1 THEN '##' || piece ELSE piece END AS token, po > 1 AS is_half
  FROM (SELECT file_id, wo, unnest(ps) AS piece, generate_subscripts(ps, 1) AS po
    FROM (SELECT file_id, wo, regexp_extract_all(word, '.{{1,8}}') AS ps
      FROM (SELECT doc_id AS file_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS wo FROM (SELECT doc_id, regexp_extract_all(lower(text), '\p{{L}}+') AS ws FROM documents))))),
nbr AS (SELECT *, lag(token) OVER w AS prev, lead(token) OVER w AS next, coalesce(lead(is_half) OVER w, false) AS next_half FROM tok WINDOW w AS (PARTITION BY file_id ORDER BY pos)),
counted AS MATERIALIZED (SELECT token, count(*) AS n FROM tok GROUP BY token),
vocab AS MATERIALIZED (SELECT a.token, coalesce(b.token, a.token) AS lemma, starts_with(a.token, '##') AS is_half, a.token IN ({STOPS}) OR length(a.token) = 1 AS is_stop, a.n
  FROM counted a LEFT JOIN counted b ON b.token = CASE WHEN starts_with(a.token, '##') THEN NULL WHEN a.token LIKE '%ing' THEN left(a.token, -3) WHEN a.token LIKE '%ed' THEN left(a.token, -2) WHEN a.token LIKE '%s' THEN left(a.token, -1) END),
idx AS (SELECT v.lemma, n.file_id, n.pos, n.token, n.prev, n.next FROM nbr n JOIN vocab v USING (token) WHERE {valid("n.token")} AND NOT n.next_half)"""

FILLERS = """
ctx AS (SELECT prev, next, token, lemma, count(*) AS cnt FROM idx WHERE prev IS NOT NULL AND next IS NOT NULL GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY prev, next ORDER BY cnt DESC, token) AS rank FROM ctx QUALIFY rank <= 101),
fill AS (SELECT * FROM ranked QUALIFY count(*) OVER (PARTITION BY prev, next) > 1)"""

INSTANCES = """
firsts AS (SELECT * FROM idx QUALIFY row_number() OVER (PARTITION BY lemma, file_id ORDER BY pos) = 1),
inst AS (SELECT * FROM firsts QUALIFY row_number() OVER (PARTITION BY lemma ORDER BY md5('111:' || file_id), file_id) <= 1000)"""

EDGES = """
edge AS (SELECT a.lemma, least(a.sub, b.sub) AS u, greatest(a.sub, b.sub) AS v, count(*) AS w FROM subs a JOIN subs b ON a.lemma = b.lemma AND a.file_id = b.file_id AND a.pos = b.pos AND a.rank < b.rank GROUP BY ALL)"""

COMMUNITIES = """
strong AS (SELECT lemma, u, v FROM edge WHERE w >= 2 UNION ALL SELECT lemma, v, u FROM edge WHERE w >= 2),
reach AS (SELECT lemma, u AS node, u AS other FROM strong UNION SELECT r.lemma, r.node, s.v FROM reach r JOIN strong s ON r.lemma = s.lemma AND r.other = s.u),
comm AS (SELECT lemma, token, dense_rank() OVER (PARTITION BY lemma ORDER BY first) - 1 AS community FROM (SELECT lemma, node AS token, min(other) AS first FROM reach GROUP BY ALL)),
pop AS (SELECT lemma, sub AS token, count(*) AS cnt FROM subs GROUP BY ALL),
vote AS (SELECT s.lemma, s.file_id, s.pos, c.community, count(*) AS votes, min(s.rank) AS first_rank FROM subs s JOIN comm c ON s.lemma = c.lemma AND s.sub = c.token WHERE s.rank <= 10 GROUP BY ALL),
best AS (SELECT * FROM vote QUALIFY row_number() OVER (PARTITION BY lemma, file_id, pos ORDER BY votes DESC, first_rank, community) = 1)"""


def senses(min_second: int) -> str:
    return f"""
shaped AS (SELECT c.lemma, c.community, c.token, p.cnt, row_number() OVER (PARTITION BY c.lemma, c.community ORDER BY p.cnt DESC, c.token) AS rank FROM comm c JOIN pop p USING (lemma, token)),
shape AS (SELECT lemma, community, count(*) AS size, max(CASE WHEN rank = 2 THEN cnt END) AS second FROM shaped GROUP BY ALL),
numbered AS (SELECT s.lemma, s.community, row_number() OVER (PARTITION BY s.lemma ORDER BY coalesce(b.won, 0) DESC, s.size DESC, s.community) - 1 AS sense_id
  FROM shape s LEFT JOIN (SELECT lemma, community, count(*) AS won FROM best GROUP BY ALL) b USING (lemma, community) WHERE s.second > {min_second}),
sense AS (SELECT r.lemma, n.sense_id, r.rank, r.token, r.cnt FROM shaped r JOIN numbered n USING (lemma, community) WHERE r.rank <= 100)"""


ASSIGNED = f"""
{cleaned("near", "idx", 10, False).strip()},
near_n AS (SELECT lemma, file_id, pos, count(*) AS n FROM near GROUP BY ALL),
sense_n AS (SELECT lemma, sense_id, count(*) AS n FROM sense GROUP BY ALL),
met AS (SELECT a.lemma, a.file_id, a.pos, s.sense_id, count(*) AS shared FROM near a JOIN sense s ON a.lemma = s.lemma AND a.sub = s.token WHERE {valid("a.lemma")} GROUP BY ALL),
scored AS (SELECT m.*, a.n + s.n - m.shared AS total, m.shared / (a.n + s.n - m.shared) AS score FROM met m JOIN near_n a USING (lemma, file_id, pos) JOIN sense_n s USING (lemma, sense_id)),
assigned AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lemma, file_id, pos ORDER BY score DESC, sense_id) = 1)"""

LINKS = """
sig AS (SELECT DISTINCT lemma || '_' || sense_id AS sense, token FROM (SELECT lemma, sense_id, token FROM sense WHERE rank <= 10 UNION ALL SELECT lemma, sense_id, lemma FROM sense)),
sig_n AS (SELECT sense, count(*) AS n FROM sig GROUP BY ALL),
link_met AS (SELECT a.sense, b.sense AS neighbour, count(*) AS shared FROM sig a JOIN sig b ON a.token = b.token AND a.sense <> b.sense GROUP BY ALL),
link_all AS (SELECT a.sense, b.sense AS neighbour, coalesce(m.shared, 0) AS shared, a.n + b.n - coalesce(m.shared, 0) AS total FROM sig_n a JOIN sig_n b ON a.sense <> b.sense LEFT JOIN link_met m ON m.sense = a.sense AND m.neighbour = b.sense),
link AS (SELECT *, shared / total AS score, row_number() OVER (PARTITION BY sense ORDER BY shared / total DESC, neighbour DESC) AS rank FROM link_all QUALIFY rank <= 11)"""


def statement(select: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(parts)}\n{select}" if parts else select
