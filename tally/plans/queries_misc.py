"""Catalogue: masked views, source contract, sessions/tokens, status
transitions, text functions and retrieval."""
from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from tally.functions.text import is_blank
from tally.functions.vectors import fake_embedding
from tally.operators import contract, governance, retrieval, sessions
from tally.plans.registry import register
from tally.sources import bank
from tally.sources.testdata import table

CONTRACT_PATH = os.path.join(os.path.dirname(os.path.dirname(__file__)), "checks", "contracts", "source_contract.json")
TOKEN_AS_OF = "2024-01-15 00:00:00"
TOPK = 3


# ---------------------------------------------------------------- governance

@register("masked_accounts", """
SELECT id, account_number, '***MASKED***' AS owner_name, status, currency, balance, account_type, created_at, updated_at
FROM accounts
""")
def masked_accounts(spark, sf_dir):
    return governance.masked_accounts(bank.accounts(spark, sf_dir))


@register("masked_users", """
SELECT id, left(username, 2) || repeat('*', greatest(length(username) - 2, 0)) AS username, role FROM users
""")
def masked_users(spark, sf_dir):
    return governance.masked_users(bank.users(spark, sf_dir))


# ---------------------------------------------------------------- source contract

def _contract_doc():
    with open(CONTRACT_PATH, encoding="utf-8") as f:
        return json.load(f)


def _contract_sql() -> str:
    doc = _contract_doc()
    values = ", ".join(
        f"('{t}', '{c}', '{s['type']}', {'true' if s['nullable'] else 'false'})"
        for t, cols in doc["tables"].items() for c, s in cols.items())
    lives = " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, column_name, column_type AS data_type, null_percentage > 0 AS nullable "
        f"FROM (SUMMARIZE {t})" for t in doc["tables"])
    return f"""
, c AS (SELECT * FROM (VALUES {values}) v(table_name, column_name, c_type, c_nullable)),
l AS ({lives}),
lt AS (SELECT DISTINCT table_name FROM l),
j AS (SELECT coalesce(c.table_name, l.table_name) AS table_name, coalesce(c.column_name, l.column_name) AS column_name,
             c.c_type, c.c_nullable, l.data_type AS l_type, l.nullable AS l_nullable
      FROM c FULL OUTER JOIN l ON c.table_name = l.table_name AND c.column_name = l.column_name),
k AS (SELECT j.*, CASE WHEN c_type IS NULL THEN 'new_column'
                       WHEN j.table_name NOT IN (SELECT table_name FROM lt) THEN 'missing_table'
                       WHEN l_type IS NULL THEN 'missing_column'
                       WHEN l_type <> c_type THEN 'type_changed'
                       WHEN l_nullable AND NOT c_nullable THEN 'nullability_loosened'
                       ELSE 'ok' END AS kind FROM j)
SELECT table_name, column_name, kind, kind NOT IN ('ok', 'new_column') AS breaking,
       CASE WHEN kind = 'new_column' THEN 'warning' ELSE 'critical' END AS severity,
       CASE kind WHEN 'new_column' THEN l_type || ' column not in the contract'
                 WHEN 'missing_table' THEN table_name || ' does not exist'
                 WHEN 'missing_column' THEN table_name || '.' || column_name || ' no longer exists'
                 WHEN 'type_changed' THEN c_type || ' -> ' || l_type
                 WHEN 'nullability_loosened' THEN 'was NOT NULL, now nullable'
                 ELSE '' END AS detail
FROM k
"""


@register("contract_diff", _contract_sql())
def contract_diff(spark, sf_dir):
    doc = _contract_doc()
    live = contract.live_schema(spark, {t: table(spark, sf_dir, t) for t in doc["tables"]})
    return contract.contract_diff(contract.contract_frame(spark, doc), live)


# ---------------------------------------------------------------- tokens, transitions

_TOKENS_SQL = """
, tokens AS (
    SELECT event_id AS id, user_id, sha256('tok-' || CAST(event_id AS VARCHAR)) AS token_hash,
           'fam-' || CAST(user_id AS VARCHAR) AS family_id, ts + INTERVAL 30 DAY AS expires_at, ts AS created_at,
           lead(ts) OVER w AS revoked_at, lead(event_id) OVER w AS replaced_by
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
pres AS (
    SELECT * FROM (
        SELECT event_id AS presentation_id,
               'tok-' || CAST(CASE WHEN event_type = 'error' THEN lag(event_id, 2) OVER w
                                   ELSE lag(event_id, 1) OVER w END AS VARCHAR) AS raw_token, ts
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    WHERE raw_token IS NOT NULL)
"""


@register("token_status", _TOKENS_SQL + f"""
SELECT id, user_id, family_id,
       CASE WHEN revoked_at IS NOT NULL AND revoked_at <= TIMESTAMP '{TOKEN_AS_OF}' THEN 'REVOKED'
            WHEN expires_at <= TIMESTAMP '{TOKEN_AS_OF}' THEN 'EXPIRED' ELSE 'ACTIVE' END AS status
FROM tokens WHERE created_at <= TIMESTAMP '{TOKEN_AS_OF}'
""")
def token_status(spark, sf_dir):
    return sessions.token_status(bank.refresh_tokens(spark, sf_dir), F.to_timestamp_ntz(F.lit(TOKEN_AS_OF)))


@register("token_family_audit", _TOKENS_SQL + """
, chk AS (SELECT p.presentation_id, t.family_id, t.created_at, p.ts, coalesce(t.revoked_at < p.ts, FALSE) AS spent
        FROM pres p JOIN tokens t ON t.token_hash = sha256(p.raw_token)),
caught AS (SELECT *, min(ts) FILTER (WHERE spent) OVER (PARTITION BY family_id) AS first_reuse_at FROM chk),
fam AS (SELECT family_id, first_reuse_at, count(*) AS reuse_count FROM caught
        WHERE spent OR (ts > first_reuse_at AND created_at <= first_reuse_at) GROUP BY ALL),
live AS (SELECT f.family_id, count(*) AS n FROM fam f JOIN tokens t ON t.family_id = f.family_id
         WHERE t.created_at <= f.first_reuse_at AND (t.revoked_at IS NULL OR t.revoked_at > f.first_reuse_at)
           AND t.expires_at > f.first_reuse_at GROUP BY f.family_id)
SELECT fam.family_id, first_reuse_at, CAST(reuse_count AS BIGINT) AS reuse_count,
       CAST(coalesce(live.n, 0) AS BIGINT) AS active_tokens_revoked
FROM fam LEFT JOIN live ON live.family_id = fam.family_id
""")
def token_family_audit(spark, sf_dir):
    return sessions.token_family_audit(bank.token_presentations(spark, sf_dir), bank.refresh_tokens(spark, sf_dir))


@register("account_status_transitions", """
, s AS (SELECT o_custkey AS entity_id, o_orderdate AS as_of, o_orderkey AS seq,
               CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'FROZEN' WHEN 'P' THEN 'OPEN'
                    ELSE o_orderstatus END AS status FROM orders),
p AS (SELECT *, lag(status) OVER (PARTITION BY entity_id ORDER BY as_of, seq) AS from_status FROM s)
SELECT entity_id, as_of, seq, from_status, status AS to_status FROM p
WHERE from_status IS NOT NULL AND from_status <> status
  AND NOT ((from_status = 'OPEN' AND status = 'ACTIVE') OR (from_status = 'FROZEN' AND status = 'ACTIVE')
        OR (from_status = 'ACTIVE' AND status = 'FROZEN') OR (from_status = 'ACTIVE' AND status = 'CLOSED'))
""".replace("\n, s AS", ", s AS", 1))
def account_status_transitions(spark, sf_dir):
    return sessions.invalid_transitions(bank.account_status_snapshots(spark, sf_dir), sessions.ACCOUNT_TRANSITIONS)


@register("kyc_status_transitions", """
, s AS (SELECT user_id AS entity_id, ts AS as_of, event_id AS seq,
               CASE event_type WHEN 'signup' THEN 'UNVERIFIED' WHEN 'view' THEN 'PENDING' WHEN 'click' THEN 'PENDING'
                    WHEN 'purchase' THEN 'VERIFIED' WHEN 'error' THEN 'REJECTED' ELSE event_type END AS status
        FROM events),
p AS (SELECT *, lag(status) OVER (PARTITION BY entity_id ORDER BY as_of, seq) AS from_status FROM s)
SELECT entity_id, as_of, seq, from_status, status AS to_status FROM p
WHERE from_status IS NOT NULL AND from_status <> status
  AND NOT ((from_status = 'UNVERIFIED' AND status = 'PENDING') OR (from_status = 'PENDING' AND status = 'VERIFIED')
        OR (from_status = 'PENDING' AND status = 'REJECTED'))
""".replace("\n, s AS", ", s AS", 1))
def kyc_status_transitions(spark, sf_dir):
    return sessions.invalid_transitions(bank.kyc_status_snapshots(spark, sf_dir), sessions.KYC_TRANSITIONS)


# The per-user state machine written as a recursive CTE (one step per attempt
# in (ts, attempt_id) order).  Valid for this data, where every user logs in
# from a single address; the Spark operator keeps one window per address.
_LOGIN_SQL = """
, a AS (SELECT event_id AS attempt_id, '10.0.' || CAST(user_id AS VARCHAR) AS ip,
               'user' || CAST(user_id AS VARCHAR) AS username, ts, event_type <> 'error' AS success,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
        FROM events),
RECURSIVE_PLACEHOLDER
"""


def _login_oracle(select: str) -> str:
    step = """
        SELECT a.username, a.rn, a.attempt_id, a.ip, a.ts,
               nw.ws, nw.wc,
               o.outcome,
               CASE WHEN o.outcome = 'RATE_LIMITED'
                    THEN greatest(0, (epoch_us(nw.ws) + 60000000 - epoch_us(a.ts)) // 1000000) ELSE 0 END AS retry,
               CASE WHEN o.outcome = 'FAILED' THEN p.fails + 1 WHEN o.outcome = 'SUCCESS' THEN 0 ELSE p.fails END AS fails,
               CASE WHEN o.outcome = 'FAILED' AND p.fails + 1 >= 3 THEN a.ts + INTERVAL 24 HOUR
                    WHEN o.outcome = 'SUCCESS' THEN NULL ELSE p.lock_until END AS lock_until,
               o.outcome <> 'SUCCESS' AS has_w
        FROM prev p JOIN a ON a.username = p.username AND a.rn = p.rn + 1,
        LATERAL (SELECT CASE WHEN NOT p.has_w OR a.ts >= p.ws + INTERVAL 60 SECOND THEN a.ts ELSE p.ws END AS ws,
                        CASE WHEN NOT p.has_w OR a.ts >= p.ws + INTERVAL 60 SECOND THEN 1 ELSE p.wc + 1 END AS wc) nw,
        LATERAL (SELECT CASE WHEN nw.wc > 5 THEN 'RATE_LIMITED'
                             WHEN p.lock_until IS NOT NULL AND p.lock_until > a.ts THEN 'LOCKED'
                             WHEN NOT a.success THEN 'FAILED' ELSE 'SUCCESS' END AS outcome) o
    """
    seed = """
        SELECT a.username, a.rn, a.attempt_id, a.ip, a.ts, a.ts AS ws, 1 AS wc,
               CASE WHEN a.success THEN 'SUCCESS' ELSE 'FAILED' END AS outcome, CAST(0 AS BIGINT) AS retry,
               CASE WHEN a.success THEN 0 ELSE 1 END AS fails, CAST(NULL AS TIMESTAMP) AS lock_until,
               NOT a.success AS has_w
        FROM a WHERE a.rn = 1
    """
    rec = ("s AS (SELECT * FROM (WITH RECURSIVE prev(username, rn, attempt_id, ip, ts, ws, wc, outcome, retry, fails, "
           "lock_until, has_w) AS (" + seed + " UNION ALL " + step.replace("FROM prev p", "FROM prev p") +
           ") SELECT * FROM prev))")
    return _LOGIN_SQL.replace("RECURSIVE_PLACEHOLDER", rec) + select


@register("login_limiter", _login_oracle("""
SELECT attempt_id, ip, username, outcome <> 'RATE_LIMITED' AS allowed, CAST(retry AS BIGINT) AS retry_after_seconds FROM s
"""))
def login_limiter(spark, sf_dir):
    """Sequential per-key limiter; oracle: recursive CTE, plus a brute-force test."""
    out = sessions.login_outcomes(bank.login_attempts(spark, sf_dir))
    return out.select("attempt_id", "ip", "username", (F.col("outcome") != "RATE_LIMITED").alias("allowed"),
                      "retry_after_seconds")


@register("lockout", _login_oracle("""
SELECT attempt_id, username, outcome, CAST(fails AS INTEGER) AS failed_attempts, lock_until AS locked_until FROM s
"""))
def lockout(spark, sf_dir):
    """Lockout state after every attempt; oracle: recursive CTE, plus a brute-force test."""
    out = sessions.login_outcomes(bank.login_attempts(spark, sf_dir))
    return out.select("attempt_id", "username", "outcome", "failed_attempts", "locked_until")


# ---------------------------------------------------------------- text functions

_RE2_YEN = r"(?:([0-9０-９]+(?:,[0-9０-９]+)*)\s*万円|([0-9０-９]+(?:,[0-9０-９]+)*)\s*円)"


def _sql_amounts(col: str) -> str:
    def num(g):
        return f"translate(replace({g}, ',', ''), '０１２３４５６７８９', '0123456789')"

    return (f"list_transform(list_sort(list_transform(list_distinct(list_transform(list_transform(list_zip("
            f"regexp_extract_all({col}, '{_RE2_YEN}', 1), regexp_extract_all({col}, '{_RE2_YEN}', 2)), "
            f"lambda p: CASE WHEN p[1] IS NOT NULL AND p[1] <> '' THEN {num('p[1]')} || '0000' ELSE {num('p[2]')} END), "
            f"lambda v: coalesce(nullif(ltrim(v, '0'), ''), '0'))), lambda v: {{'n': len(v), 'v': v}})), lambda p: p.v)")


# Notices that name amounts, made from orders: the price in yen, the key in man-yen with full-width digits.
_NOTICE_SQL = ("concat('入金 ', CAST(floor(o_totalprice) AS BIGINT), ' 円、上限 ', "
               "translate(CAST(o_orderkey AS VARCHAR), '0123456789', '０１２３４５６７８９'), '万円 (', o_orderkey % 7, ',000円)')")


@register("amount_extraction", f"""
, named AS (SELECT 'document' AS kind, doc_id AS id, text FROM documents
            UNION ALL SELECT 'notice', o_orderkey, {_NOTICE_SQL} FROM orders)
SELECT kind, id, coalesce(array_to_string({_sql_amounts('text')}, ','), '') AS amounts FROM named
""")
def amount_extraction(spark, sf_dir):
    """Yen amounts of every document and of a notice per order, as one string per row."""
    from tally.functions.text import yen_amounts

    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    wide = F.translate(F.col("o_orderkey").cast("string"), "0123456789", "０１２３４５６７８９")
    notice = F.concat(F.lit("入金 "), F.floor("o_totalprice").cast("string"), F.lit(" 円、上限 "), wide, F.lit("万円 ("),
                      (F.col("o_orderkey") % 7).cast("string"), F.lit(",000円)"))
    notices = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select(
        F.lit("notice").alias("kind"), F.col("o_orderkey").alias("id"), notice.alias("text"))
    return docs.unionByName(notices).select("kind", "id", F.coalesce(F.array_join(yen_amounts(F.col("text")), ","), F.lit("")).alias("amounts"))


def _sql_fake_embedding(col: str, dims: int = 8) -> str:
    v = (f"(list_sum(list_transform(regexp_extract_all(hex(encode({col})), '..'), "
         f"lambda h: CAST(('0x' || h) AS INTEGER))) % 1000)")
    return (f"CASE WHEN {col} IS NULL OR regexp_matches({col}, '^\\s*$') THEN NULL "
            f"ELSE list_transform(range({dims}), lambda i: CAST((coalesce({v}, 0) + i) % 1000 AS DOUBLE) / 1000.0) END")


@register("fake_embedding", f"""
SELECT doc_id, {_sql_fake_embedding('text')} AS embedding FROM documents
""")
def fake_embedding_q(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    return d.select("doc_id", fake_embedding(F.col("text"), 8).alias("embedding"))


# ---------------------------------------------------------------- retrieval

_CENTROIDS_SQL = """
, ex AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS pos FROM embeddings),
cent AS (SELECT label AS query_id, list(m ORDER BY pos) AS qv
         FROM (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS m FROM ex GROUP BY label, pos) GROUP BY label),
scored AS (SELECT query_id, vec_id AS doc_id,
                  round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), qv), 9) AS distance
           FROM embeddings, cent WHERE embedding IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM scored)
"""


VECTOR_LENGTH = 64  # of the embeddings table


def _centroid_topk(spark, sf_dir, k):
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    q = retrieval.label_centroids(emb)
    docs = emb.select(F.col("vec_id").alias("doc_id"), "embedding")
    return retrieval.cosine_topk(docs, q, k, VECTOR_LENGTH)


@register("vector_topk", _CENTROIDS_SQL + f"""
SELECT query_id, doc_id, distance, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= {TOPK}
""")
def vector_topk(spark, sf_dir):
    return _centroid_topk(spark, sf_dir, TOPK)


@register("retrieval_eval", _CENTROIDS_SQL + """
, top1 AS (SELECT r.query_id, e.label = r.query_id AS hit FROM ranked r JOIN embeddings e ON e.vec_id = r.doc_id
           WHERE rank = 1)
SELECT CAST(count(*) AS BIGINT) AS queries, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS hits,
       sum(CAST(hit AS INTEGER)) / count(*) AS hit_rate FROM top1
""")
def retrieval_eval(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    top = _centroid_topk(spark, sf_dir, 1).withColumn("final_rank", F.col("rank"))
    expected = emb.select(F.col("label").alias("query_id"), F.col("vec_id").alias("expected_doc_id"))
    return retrieval.hit_rate(top, expected, at=1)


@register("faq_retrieval", f"""
, docs AS (SELECT doc_id, text AS question, {_sql_fake_embedding('text')} AS embedding FROM documents),
qs AS (SELECT item_id AS query_id, {_sql_fake_embedding('text')} AS qv, {_sql_amounts('text')} AS qa FROM benchmark
       WHERE NOT (text IS NULL OR regexp_matches(text, '^\\s*$'))),
scored AS (SELECT query_id, doc_id, round(1 - list_cosine_similarity(embedding, qv), 9) AS distance
           FROM docs, qs WHERE embedding IS NOT NULL),
cand AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank
                        FROM scored) WHERE rank <= 10),
m AS (SELECT c.*, CASE WHEN len(q.qa) > 0 AND len(list_intersect(q.qa, {_sql_amounts('d.question')})) > 0
                       THEN 1 ELSE 0 END AS mt
      FROM cand c JOIN qs q USING (query_id) JOIN docs d USING (doc_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY mt DESC, rank) AS final_rank FROM m)
SELECT query_id, doc_id, distance, mt = 1 AS amount_match, CAST(rank AS INTEGER) AS distance_rank,
       CAST(final_rank AS INTEGER) AS final_rank
FROM f WHERE final_rank <= {TOPK}
""")
def faq_retrieval(spark, sf_dir):
    docs = retrieval.embed_corpus(
        table(spark, sf_dir, "documents", "doc_id", "text").withColumnRenamed("text", "question"))
    queries = table(spark, sf_dir, "benchmark", "item_id", "text").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    return retrieval.retrieve(docs, queries, TOPK)


@register("faq_upsert", f"""
, old AS (SELECT doc_id AS faq_id, text AS question, source AS answer FROM documents WHERE doc_id % 3 <> 0),
new AS (SELECT doc_id AS faq_id, text AS question, lang AS answer FROM documents WHERE doc_id % 3 <> 1)
SELECT faq_id, question, answer, {_sql_fake_embedding('question')} AS embedding FROM (
    SELECT * FROM old WHERE faq_id NOT IN (SELECT faq_id FROM new)
    UNION ALL SELECT * FROM new)
""")
def faq_upsert(spark, sf_dir):
    """Every document is stored, loaded anew or both, by its key: the load inserts ids
    that are new and overwrites known ones; the result holds them all."""
    d = table(spark, sf_dir, "documents", "doc_id", "text", "lang", "source")
    key = F.col("doc_id") % 3
    old = d.filter(key != 0).select(F.col("doc_id").alias("faq_id"), F.col("text").alias("question"), F.col("source").alias("answer"))
    new = d.filter(key != 1).select(F.col("doc_id").alias("faq_id"), F.col("text").alias("question"), F.col("lang").alias("answer"))
    return retrieval.embed_corpus(retrieval.upsert(old, new))


@register("blank_texts", """
SELECT 'documents' AS table_name, CAST(count(*) FILTER (WHERE text IS NULL OR regexp_matches(text, '^\\s*$')) AS BIGINT)
       AS blank_rows FROM documents
UNION ALL SELECT 'conversations', CAST(count(*) FILTER (WHERE text IS NULL OR regexp_matches(text, '^\\s*$')) AS BIGINT)
       FROM conversations
""")
def blank_texts(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "text").agg(F.count_if(is_blank(F.col("text"))).cast("long").alias("blank_rows"))
    c = table(spark, sf_dir, "conversations", "text").agg(F.count_if(is_blank(F.col("text"))).cast("long").alias("blank_rows"))
    return d.withColumn("table_name", F.lit("documents")).unionByName(c.withColumn("table_name", F.lit("conversations")))
