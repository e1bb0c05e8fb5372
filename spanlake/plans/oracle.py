"""DuckDB oracle SQL (independent formulations of the same semantics).

Every query starts from the pre-registered table views; shared derived views
(FIXTURES.md §3) are CTE text joined in front of the final SELECT.  The
oracles use plain SQL constructs (row-level window frames, range joins,
explicit pair joins, ``row_number`` ranks) rather than the array-based plans of
the Spark side, so that the two really check each other.
"""

from __future__ import annotations

from spanlake.config import DecodeConfig, WindowConfig

# --- shared CTEs -------------------------------------------------------------

TOK = r"""
tok AS (
  SELECT doc_id, lang, text, n, CAST(floor(n / 2) AS BIGINT) AS k, pos, tok,
         CAST(te - length(tok) AS BIGINT) AS ts, CAST(te AS BIGINT) AS te
  FROM (
    SELECT doc_id, lang, text, n, pos, regexp_extract(piece, '\S+') AS tok,
           sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS te
    FROM (SELECT doc_id, lang, text, len(x) AS n, unnest(x) AS piece, generate_subscripts(x, 1) - 1 AS pos
          FROM (SELECT doc_id, lang, text, regexp_extract_all(text, '\s*\S+') AS x FROM documents) d0) d1) d2
)"""

QA = r"""
qa0 AS (
  SELECT d.doc_id AS id, max(d.lang) AS language, max(d.text) AS context, coalesce(max(n), 0) AS n_tok, coalesce(max(k), 0) AS k,
    max(CASE WHEN n >= 7 AND pos = k THEN ts END) AS answer_start,
    max(CASE WHEN n >= 7 AND pos = k + 2 THEN te END) AS answer_end,
    coalesce(max(CASE WHEN n >= 7 AND pos = k - 1 THEN tok END) || ' ' || max(CASE WHEN pos = k THEN tok END) || ' ' ||
    max(CASE WHEN pos = k + 1 THEN tok END) || ' ' || max(CASE WHEN pos = k + 2 THEN tok END) || ' ' ||
    max(CASE WHEN pos = k + 3 THEN tok END), '') AS question
  FROM documents d LEFT JOIN tok ON tok.doc_id = d.doc_id GROUP BY d.doc_id
),
qa AS (
  SELECT id, language, context, CAST(n_tok AS BIGINT) AS n_tok, k, answer_start, answer_end, question,
         substr(context, CAST(answer_start + 1 AS INTEGER), CAST(answer_end - answer_start AS INTEGER)) AS answer_text,
         answer_start + id % 4 AS claimed_start
  FROM qa0
)"""

QA_CONV = r"""
qa_conv AS (
  SELECT u.conv_id * 1000000 + u.turn AS id, u.text AS question, a.text AS context
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
)"""

QA_BENCH = r"""
qa_bench AS (
  SELECT CAST(d.doc_id AS VARCHAR) || ':' || CAST(b.item_id AS VARCHAR) AS id, d.lang AS language, d.text AS context, b.text AS answer_text,
         CAST(instr(d.text, b.text) - 1 AS BIGINT) AS answer_start
  FROM documents d JOIN benchmark b ON contains(d.text, b.text)
)"""


def words_sql(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"


def jaccard_sql(a: str, b: str) -> str:
    """Word-set Jaccard; NULL for blank vs blank."""
    sa = f"list_distinct({words_sql(f'lower({a})')})"
    sb = f"list_distinct({words_sql(f'lower({b})')})"
    inter = f"len(list_intersect({sa}, {sb}))"
    denom = f"(len({sa}) + len({sb}) - {inter})"
    return f"(CASE WHEN {denom} = 0 THEN NULL ELSE {inter} / {denom} END)"


def logits_ctes(src: str, w: WindowConfig, include_special: bool) -> list[str]:
    """``src`` (id, context, question) -> CTE ``alllog(id, fid, pos, sl, el, is_ctx, ts, te)``."""
    room = w.max_len - w.n_special
    ctes = [
        rf"""geo AS (
  SELECT id, q_len, n_ctx, cap, step, qset,
         CASE WHEN step > 0 THEN 1 + CAST(ceil(greatest(n_ctx - cap, 0) / step) AS BIGINT) ELSE 0 END AS n_windows
  FROM (SELECT id, len(regexp_extract_all(question, '\S+')) AS q_len,
               len(regexp_extract_all(context, '\s*\S+')) AS n_ctx,
               {room} - len(regexp_extract_all(question, '\S+')) AS cap,
               {room} - len(regexp_extract_all(question, '\S+')) - {w.stride} AS step,
               list_distinct(list_transform(regexp_extract_all(question, '\S+'), lambda x: lower(x))) AS qset
        FROM {src}) g0
)""",
        "wins AS (SELECT id, unnest(range(0, n_windows)) AS fid FROM geo)",
        rf"""ctok AS (
  SELECT id, pos AS p, tok, te - length(tok) AS ts, te FROM (
    SELECT id, pos, regexp_extract(piece, '\S+') AS tok,
           sum(length(piece)) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS te
    FROM (SELECT id, unnest(x) AS piece, generate_subscripts(x, 1) - 1 AS pos
          FROM (SELECT id, regexp_extract_all(context, '\s*\S+') AS x FROM {src}) c0) c1) c2
)""",
        """wtok AS (
  SELECT c.id, w.fid, c.p, c.tok, CAST(c.ts AS BIGINT) AS ts, CAST(c.te AS BIGINT) AS te,
         g.q_len + 2 + c.p - w.fid * g.step AS pos,
         CASE WHEN list_contains(g.qset, lower(c.tok)) THEN 1 ELSE 0 END AS f
  FROM ctok c JOIN geo g ON c.id = g.id JOIN wins w ON w.id = c.id
  WHERE c.p >= w.fid * g.step AND c.p < w.fid * g.step + g.cap
)""",
        """clog AS (
  SELECT id, fid, pos, TRUE AS is_ctx, ts, te,
    1000 * CAST(sum(f) OVER (PARTITION BY id, fid ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS BIGINT)
      + (id * 7919 + fid * 104729 + pos * 1299709) % 997 AS sl,
    1000 * CAST(sum(f) OVER (PARTITION BY id, fid ORDER BY p ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS BIGINT)
      + (id * 7919 + fid * 104729 + pos * 15485863) % 997 AS el
  FROM wtok
)""",
    ]
    if include_special:
        ctes += [
            """spos AS (SELECT w.id, w.fid, g.q_len, unnest(range(0, g.q_len + 1)) AS pos
             FROM wins w JOIN geo g ON w.id = g.id)""",
            """slog AS (
  SELECT id, fid, pos, FALSE AS is_ctx, CAST(NULL AS BIGINT) AS ts, CAST(NULL AS BIGINT) AS te,
    1000 * (CASE WHEN pos = 0 THEN 0 ELSE least(q_len, pos + 4) - pos + 1 END)
      + (id * 7919 + fid * 104729 + pos * 1299709) % 997 AS sl,
    1000 * (CASE WHEN pos = 0 THEN 0 ELSE pos - greatest(1, pos - 4) + 1 END)
      + (id * 7919 + fid * 104729 + pos * 15485863) % 997 AS el
  FROM spos
)""",
            "alllog AS (SELECT id, fid, pos, is_ctx, ts, te, sl, el FROM clog UNION ALL "
            "SELECT id, fid, pos, is_ctx, ts, te, sl, el FROM slog)",
        ]
    else:
        ctes.append("alllog AS (SELECT id, fid, pos, is_ctx, ts, te, sl, el FROM clog)")
    return ctes


def candidate_ctes(d: DecodeConfig, src: str = "alllog") -> list[str]:
    """``src`` logits -> ``rs``/``re`` ranks, ``cand`` pairs, ``best`` per id."""
    return [
        f"""rs AS (SELECT id, fid, pos, is_ctx, ts, sl,
                   row_number() OVER (PARTITION BY id, fid ORDER BY sl DESC, pos DESC) AS srank FROM {src})""",
        f"""re AS (SELECT id, fid, pos, is_ctx, te, el,
                   row_number() OVER (PARTITION BY id, fid ORDER BY el DESC, pos DESC) AS erank FROM {src})""",
        f"""cand AS (
  SELECT s.id, s.fid, s.srank, e.erank, s.pos AS s_pos, e.pos AS e_pos, s.ts AS s_char, e.te AS e_char,
         s.sl + e.el AS score
  FROM (SELECT * FROM rs WHERE srank <= {d.n_best} AND is_ctx) s
  JOIN (SELECT * FROM re WHERE erank <= {d.n_best} AND is_ctx) e
    ON s.id = e.id AND s.fid = e.fid AND s.pos <= e.pos AND e.pos - s.pos + 1 <= {d.max_answer_len}
)""",
        """best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, fid, srank, erank) AS r FROM cand) b0
  WHERE r = 1
)""",
    ]


def decode_ctes(src: str, w: WindowConfig, d: DecodeConfig, keep: tuple[str, ...] = ()) -> list[str]:
    """``src`` -> CTE ``pred(id, keep..., prediction, score)``."""
    k = "".join(f"x.{c}, " for c in keep)
    return logits_ctes(src, w, not d.mask_before_topk) + candidate_ctes(d) + [
        f"""pred AS (
  SELECT x.id, {k}coalesce(substr(x.context, CAST(b.s_char + 1 AS INTEGER), CAST(b.e_char - b.s_char AS INTEGER)), '')
           AS prediction,
         coalesce(CAST(b.score AS DOUBLE), 0.0) AS score
  FROM {src} x LEFT JOIN best b ON x.id = b.id
)"""
    ]


def with_ctes(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n" + select


PREDS = r"""
ktok AS (SELECT doc_id, pos, ts, te FROM tok WHERE n >= 7 AND pos BETWEEN k - 1 AND k + 3),
pv AS (
  SELECT q.id, m.member, q.k - 1 + ((q.id * 31 + m.member * 17 + (q.id % 5) * m.member * m.member) % 3) AS s
  FROM (SELECT * FROM qa WHERE answer_start IS NOT NULL) q CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3), (4)) t(member)) m
),
preds AS (
  SELECT pv.id, CAST(pv.member AS INTEGER) AS member, pv.s AS start_tok, pv.s + 2 AS end_tok,
         (pv.id * 7919 + pv.member * 104729) % 1009 AS score,
         substr(q.context, CAST(a.ts + 1 AS INTEGER), CAST(b.te - a.ts AS INTEGER)) AS text, q.language, q.answer_text
  FROM pv JOIN qa q ON pv.id = q.id
  JOIN ktok a ON a.doc_id = pv.id AND a.pos = pv.s
  JOIN ktok b ON b.doc_id = pv.id AND b.pos = pv.s + 2
)"""

HISTORY = r"""
history AS (
  SELECT run, CAST(epoch AS INTEGER) AS epoch, ((event_id * 37) % 100) / CAST(100 AS DOUBLE) AS jaccard,
         value AS val_loss, CAST(10 + event_id % 7 AS BIGINT) AS seconds
  FROM (SELECT event_type || '-' || CAST(event_id // 64 AS VARCHAR) AS run, event_id, value,
               row_number() OVER (PARTITION BY event_type, event_id // 64 ORDER BY event_id) - 1 AS epoch FROM events) h
)"""

STOP = r"""
stop AS (
  SELECT word FROM (
    SELECT word, count(*) AS c FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS word FROM documents) w
    WHERE word <> '' GROUP BY word ORDER BY c DESC, word ASC LIMIT 20) s
)"""

LEXICON = r"""
bw AS (SELECT item_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
lexicon AS (
  SELECT lower(w[i]) AS word, w[i + 1] || '-' || w[i] AS raw
  FROM (SELECT item_id, w, unnest(range(1, len(w))) AS i FROM bw) t
),
synonyms AS (
  SELECT DISTINCT word, regexp_replace(lower(translate(raw, '_-', '  ')), '[^ a-z]', '', 'g') AS synonym FROM lexicon
),
syn AS (SELECT word, synonym FROM synonyms WHERE synonym <> word AND synonym <> '')"""
