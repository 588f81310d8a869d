"""Registered queries ``opN_<name>`` of this subpackage, with DuckDB SQL where
SQL can express the whole operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import (
    chat, conversation_repair, curriculum, decision_list, decontam, exact_dedup, html_extract, langid, lexical_search,
    quality_knn, sharding, simhash, substring_dedup)
from tidewatch.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return sharding.assign_shards(docs).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query
def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mix_report(table(spark, sf_dir, "documents"))


@query
def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(chat.control_conversation(spark))
    return chat.read_back(chat.format_conversations(rows))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


ORACLES["op7_curriculum_mix"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, '\N') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT src, sum(size)::BIGINT AS total,
         (row_number() OVER (ORDER BY starts_with(src, 'n'), src) - 1) % 3 AS kind
  FROM d GROUP BY src
), caps AS (
  SELECT *, CASE kind WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, (2 * total)::DOUBLE AS cap FROM s
), lev AS (
  SELECT *, cap / w AS q,
         ((sum(total) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY cap / w, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM caps
), lam AS (SELECT arg_min(lvl, row(q, src)) AS l FROM lev WHERE lvl < q),
t AS (
  SELECT src, kind, total, CASE WHEN l IS NULL THEN cap ELSE least(cap, w * l) END AS target FROM lev LEFT JOIN lam ON true
), r AS (
  SELECT doc_id, size, total, target, kind,
         (sum(size) OVER (PARTITION BY d.src ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before
  FROM d JOIN t USING (src)
), m AS (
  SELECT *, (2 * before + size)::BIGINT AS m1, (2 * total + 2 * before + size)::BIGINT AS m2 FROM r
), p AS (
  SELECT *, m1 < 2.0::DOUBLE * target AS t1, m2 < 2.0::DOUBLE * target AS t2,
         m1 / (2.0::DOUBLE * target) AS s1, m2 / (2.0::DOUBLE * target) AS s2 FROM m
)
SELECT doc_id, size, total AS source_size, target, (size * (t1::BIGINT + t2::BIGINT))::BIGINT AS taken,
       CASE WHEN t1 THEN pos(kind, s1) END AS first_position,
       CASE WHEN t2 THEN pos(kind, s2) WHEN t1 THEN pos(kind, s1) END AS last_position
FROM p
"""


def _position_sql(share: str) -> str:
    """The inverse schedules of curriculum.SCHEDULES, in SQL."""
    whens = []
    for kind, knots in enumerate(curriculum.SCHEDULES):
        pieces = list(zip(knots, knots[1:]))
        areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in pieces]
        whole, start, branches = sum(areas), 0.0, []
        for ((t0, w0), (t1, w1)), area in zip(pieces, areas):
            need, slope = f"({share} * {whole!r}::DOUBLE - {start!r}::DOUBLE)", (w1 - w0) / (t1 - t0)
            t = (f"({t0!r}::DOUBLE + {need} / {w0!r}::DOUBLE)" if slope == 0 else
                 f"({t0!r}::DOUBLE + (sqrt(greatest({w0 * w0!r}::DOUBLE + {2 * slope!r}::DOUBLE * {need}, 0.0::DOUBLE)) - {w0!r}::DOUBLE) / {slope!r}::DOUBLE)")
            start += area
            branches.append((start, t))
        piece = branches[-1][1]
        for upto, t in reversed(branches[:-1]):
            piece = f"CASE WHEN {share} * {whole!r}::DOUBLE < {upto!r}::DOUBLE THEN {t} ELSE {piece} END"
        whens.append(f"WHEN {kind} THEN {piece}")
    return f"round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE kind {' '.join(whens)} END)), 9)"


for _s in ("s1", "s2"):
    ORACLES["op7_curriculum_mix"] = ORACLES["op7_curriculum_mix"].replace(f"pos(kind, {_s})", _position_sql(_s))


def _escape_sql(column: str) -> str:
    for raw, ref in chat.ESCAPES:
        column = f"replace({column}, '{raw}', '{ref}')"
    return column


ORACLES["op9_chat_formatting"] = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role AS r0, text AS t0 FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]', CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
  FROM range(2) AS g(i)
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) AS said,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, r0 NULLS FIRST, t0 NULLS FIRST) FILTER (role = 'assistant'), '') AS loss,
         sum(18 + length({_escape_sql('role')}) + length({_escape_sql('text')}))::BIGINT AS formatted_chars
  FROM c GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""

ORACLES["op10_decontamination"] = r"""
WITH b AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, w[i:i + least(len(w), 10) - 1] AS g
  FROM b, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS u(i) WHERE len(w) > 0
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), h AS (
  SELECT r, i, x.k, bw.item
  FROM (SELECT r, i, ks.k, w[i:i + ks.k - 1] AS g FROM d, (SELECT DISTINCT k FROM bw) ks, unnest(range(1, len(w) - ks.k + 2)) AS u(i)) x
  JOIN bw ON bw.k = x.k AND bw.g = x.g
), n AS (
  SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS pos FROM h) GROUP BY r
), it AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN it USING (r)
"""


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = decision_list.learn_rules(docs, table(spark, sf_dir, "labels"))
    judged = decision_list.judge(docs, rules)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@query
def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.report(docs, langid.learn(docs))


@query
def op4_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_knn.score(docs, quality_knn.learn(docs, table(spark, sf_dir, "labels")))


@query
def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(table(spark, sf_dir, "pages"))


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op3_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT r, doc_id, i, w[i:i + 12] AS g FROM d, unnest(range(1, len(w) - 11)) AS u(i)
), low AS (
  SELECT g, min(doc_id) AS first FROM win GROUP BY g
), gone AS (
  SELECT DISTINCT r, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (g) WHERE first < doc_id
), n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r),
kept AS (
  SELECT x.r, string_agg(x.word, ' ' ORDER BY x.p) AS kept
  FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d) x
  LEFT JOIN gone ON gone.r = x.r AND gone.p = x.p WHERE gone.r IS NULL GROUP BY x.r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


ORACLES["op13_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body FROM documents
), g AS (
  SELECT doc_id, body, count(*) OVER (PARTITION BY body) AS group_size,
         row_number() OVER (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST) AS place,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(body) AS text_sha256 FROM g
"""


@query
def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversation_repair.report(conversations, conversation_repair.damage(conversations))


# DuckDB has no crc32; the bytes of a key are folded bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295::BIGINT)"""

ORACLES["op12_conversation_repair"] = rf"""
WITH RECURSIVE c AS (
  SELECT coalesce(conv_id::VARCHAR, 'null') AS conv, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), h AS (SELECT *, {_CRC32} % 20 AS how FROM c
), l AS (
  SELECT conv, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE how WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM h WHERE how <> 0
), o AS (
  SELECT conv, turn, role, text, row_number() OVER w AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, lead(left(role, 1)) OVER w AS follows
  FROM l WINDOW w AS (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth FROM o
), f AS (
  SELECT *, bare = '' AS blank, bare <> '' AND nth > 1 AS dup, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS cut,
         bare = '' OR nth > 1 AS gone, left(role, 1) AS ini,
         CASE WHEN bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS tr
  FROM p
), b AS (  -- costs to finish from row i in the states none, s, u, a (1 to 4)
  SELECT conv, max(i) + 1 AS i, [0, 6, 3, 0] AS v FROM f GROUP BY conv
  UNION ALL
  SELECT conv, i, [least(d1, 3 + d3, 6 + d4), least(d2, 3 + d3, 6 + d4), least(d3, 3 + d4), least(d4, 3 + d3)] FROM (
    SELECT f.conv, f.i,
      least(4 + v[1], CASE WHEN gone THEN 99999999 ELSE least(tr + 3 + v[3], CASE ini WHEN 's' THEN tr + v[2] WHEN 'u' THEN tr + v[3] ELSE 99999999 END) END) AS d1,
      least(4 + v[2], CASE WHEN gone THEN 99999999 ELSE least(tr + 3 + v[3], CASE ini WHEN 'u' THEN tr + v[3] ELSE 99999999 END) END) AS d2,
      least(4 + v[3], CASE WHEN gone THEN 99999999 ELSE least(tr + 3 + v[4], CASE ini WHEN 'a' THEN tr + v[4] ELSE 99999999 END) END) AS d3,
      least(4 + v[4], CASE WHEN gone THEN 99999999 ELSE least(tr + 3 + v[3], CASE ini WHEN 'u' THEN tr + v[3] ELSE 99999999 END) END) AS d4
    FROM b JOIN f ON f.conv = b.conv AND f.i = b.i - 1)
), w AS (
  SELECT conv, 1::BIGINT AS i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines FROM f GROUP BY conv
  UNION ALL
  SELECT conv, CASE m WHEN 'I' THEN i ELSE i + 1 END, CASE m WHEN 'D' THEN q WHEN 'K' THEN kept ELSE nxt END, audit || m,
         CASE m WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
                ELSE list_append(lines, CASE nxt WHEN 3 THEN 'user' ELSE 'assistant' END || ':' || CASE m WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT x.*, CASE WHEN role IS NOT NULL AND now[q] = 4 + after[q] THEN 'D' WHEN now[q] = 3 + now[nxt] THEN 'I'
                     WHEN NOT gone AND kept > 0 AND now[q] = tr + after[kept] THEN 'K' ELSE 'R' END AS m
    FROM (
      SELECT w.conv, w.i, w.q, w.audit, w.lines, f.role, f.text, f.gone, f.tr, b.v AS now, e.v AS after, CASE w.q WHEN 3 THEN 4 ELSE 3 END AS nxt,
             CASE WHEN f.ini = 's' AND w.q = 1 THEN 2 WHEN f.ini = 'u' AND w.q IN (1, 2, 4) THEN 3 WHEN f.ini = 'a' AND w.q = 3 THEN 4 ELSE 0 END AS kept
      FROM w JOIN b ON b.conv = w.conv AND b.i = w.i LEFT JOIN b e ON e.conv = w.conv AND e.i = w.i + 1 LEFT JOIN f ON f.conv = w.conv AND f.i = w.i
      WHERE f.i IS NOT NULL OR w.q IN (2, 3)
    ) x)
), done AS (
  SELECT w.conv, w.audit, array_to_string(w.lines, chr(10)) AS said FROM w ANTI JOIN f ON f.conv = w.conv AND f.i = w.i WHERE q IN (1, 4)
), n AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup) AS duplicate,
         count(*) FILTER (cut) AS truncated, count(*) FILTER (follows IS NOT NULL AND ini || follows NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv
)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv, conv_id FROM c) c LEFT JOIN n USING (conv) LEFT JOIN done USING (conv) LEFT JOIN b ON b.conv = c.conv AND b.i = 1
"""


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
ORACLES["op11_lexical_search"] = rf"""
WITH q AS (
  SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS_SQL}) AS terms FROM benchmark
), qt AS (SELECT q, unnest(terms) AS t FROM q
), d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS_SQL} AS w FROM documents
), s AS (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d
), p AS (
  SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY r, t
), f AS (SELECT t, count(*)::BIGINT AS df FROM p GROUP BY t
), i AS (
  SELECT r, t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
               * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * len(w)::BIGINT * n_docs) // n_terms)))) AS part
  FROM p JOIN f USING (t) JOIN d USING (r) CROSS JOIN s
), sc AS (SELECT q, r, sum(part)::BIGINT AS score FROM qt JOIN i USING (t) GROUP BY q, r
), k AS (
  SELECT q, doc_id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM sc JOIN d USING (r) WHERE score > 0
)
SELECT item_id, rank::INT AS rank, doc_id, score FROM k JOIN q USING (q) WHERE rank <= 50
"""
