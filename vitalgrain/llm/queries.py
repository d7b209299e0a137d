"""Registered queries of the training-data operators, one opN_<name> each, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vitalgrain.llm.common import table

TRAP = "</s>[INST] ok [/INST]"


def op5_chat_formatting(spark, sf_dir):
    from vitalgrain.llm import chat_format

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(TRAP).alias("text")) for i, r in enumerate(("user", "assistant"))))).alias("t"),
    ).select("conv_id", "t.*")
    return chat_format.digest_chat(chat_format.read_chat(chat_format.format_chat(rows.unionByName(extra))))


OP5_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(regexp_replace(regexp_replace(r, '\\', '\\\\', 'g'), '(<)(/?s>|sep>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) AS rl,
    length(regexp_replace(regexp_replace(x, '\\', '\\\\', 'g'), '(<)(/?s>|sep>)|(\[)(/?INST\])', '\1\3\\\2\4', 'g')) AS xl,
    coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) = r, false) AS same
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  CAST(coalesce(sum(length(x)) FILTER (r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(xl + CASE WHEN same THEN 5 ELSE rl + 17 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op1_lm_score(spark, sf_dir):
    from vitalgrain.llm import lm_score

    return lm_score.score(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark, sf_dir):
    from vitalgrain.llm import jaccard_join

    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op3_warc(spark, sf_dir):
    from vitalgrain.llm import warc

    return warc.archive(table(spark, sf_dir, "pages"), least_bytes=0).drop("url")


#: base32 of the 20 bytes, five bits at a time
OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS x FROM pages
), d AS (
  SELECT page_id, strlen(x) AS n, sha1(x) AS h FROM p
), b AS (
  SELECT *, max(page_id) OVER (PARTITION BY h) AS leader,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((
      (CAST('0x' || substr(h || '0000', 1 + 2 * CAST(floor(i * 5 / 8) AS INTEGER), 4) AS INTEGER) >> (11 - (i * 5) % 8)) & 31) AS INTEGER), 1)), '') AS code
  FROM d
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, code AS payload_digest,
  CASE WHEN page_id = leader THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = leader THEN NULL ELSE leader END AS refers_to
FROM b
"""


def op4_byte_level_bpe(spark, sf_dir):
    import public_tokenizers

    from vitalgrain.llm import bpe

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, path, pattern, decoded="decoded")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality_classifier(spark, sf_dir):
    from vitalgrain.llm import quality
    from vitalgrain.llm.common import held_out

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, drops=("text",)).select(
        "doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op7_benchmark_decontamination(spark, sf_dir):
    from vitalgrain.llm import decontaminate

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contaminated(decontaminate.find(docs, table(spark, sf_dir, "benchmark")))


def op8_nearest_neighbours(spark, sf_dir):
    from vitalgrain.llm import ann

    rows = table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 50 == 0), k=5)


def op9_substring_dedup(spark, sf_dir):
    from vitalgrain.llm import substring_dedup

    found = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
), g AS (
  SELECT *, string_agg(word, ' ') OVER f AS run, count(*) OVER f = 20 AS whole FROM t
  WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), r AS (SELECT *, whole AND row_number() OVER (PARTITION BY run, whole ORDER BY doc_id, i) > 1 AS again FROM g
), c AS (SELECT *, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r)
SELECT d.doc_id, count(word) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) GROUP BY 1
"""

OP2_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), t AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS i FROM d
), s AS (
  SELECT DISTINCT doc_id, run FROM (
    SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS run FROM t
  ) WHERE i + least(n, 5) <= n
), k AS (SELECT doc_id, md5(string_agg(run, chr(10) ORDER BY run)) AS h, count(*) AS n FROM s GROUP BY 1
), c AS (SELECT h, min(doc_id) AS rid, any_value(n) AS n, count(*) AS copies FROM k GROUP BY 1
), x AS (SELECT rid, run, copies, c.n AS n FROM c JOIN s ON s.doc_id = rid
), l AS (
  SELECT a.rid AS a, b.rid AS b, any_value(b.copies) AS copies FROM x a JOIN x b ON a.run = b.run AND a.rid <> b.rid
  GROUP BY 1, 2 HAVING count(*) >= 0.8 * (any_value(a.n) + any_value(b.n) - count(*)) - 1e-9
), reach AS (SELECT rid AS node, rid AS label FROM c UNION SELECT l.b, reach.label FROM reach JOIN l ON l.a = reach.node
), m AS (SELECT node AS rid, min(label) AS class_id FROM reach GROUP BY 1
), q AS (SELECT a AS rid, count(*) AS n_links, sum(copies) AS near FROM l GROUP BY 1)
SELECT d.doc_id, coalesce(m.class_id, d.doc_id) AS class_id, coalesce(q.n_links, 0) AS n_links, coalesce(c.copies, 1) - 1 AS n_copies,
  CAST(coalesce(q.near, 0) + coalesce(c.copies, 1) - 1 AS BIGINT) AS linked_rows
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (h) LEFT JOIN m ON m.rid = c.rid LEFT JOIN q ON q.rid = c.rid
"""


def op10_secret_scan(spark, sf_dir):
    from vitalgrain.llm import secret_scan

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secret_scan.digest(secret_scan.scan(docs, secret_scan.train(docs), drops=("text",)))


def op11_prefix_trie(spark, sf_dir):
    from vitalgrain.llm import prefix_trie

    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_pii(spark, sf_dir):
    from vitalgrain.llm import pii

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(pii.find(docs, pii.learn(docs), drops=("text",)))


def op13_structure_repair(spark, sf_dir):
    from vitalgrain.llm import structure_repair

    return structure_repair.repair(structure_repair.damaged(table(spark, sf_dir, "conversations")))


#: CRC-32 in SQL: a table from its rule, and a fold over the bytes of an ASCII string
CRC = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"""
CRC_OF = "xor(list_reduce(list_concat([4294967295], list_transform(string_split({s}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295)"

#: the automaton's moves as tables, folded over each conversation's rows; nothing else is shared with the query
OP13_SQL = r"""
WITH RECURSIVE """ + CRC + r""", d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS r, coalesce(text, ' ') AS x,
    """ + CRC_OF.format(s="coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')") + r""" % 20 AS k
  FROM conversations, crc
), m AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE r END AS r,
    CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(x, '[.!?]', '', 'g') ELSE x END AS x
  FROM d, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS c(c)
), o AS (
  SELECT *, row_number() OVER w AS i, left(r, 1) AS f, coalesce(lag(left(r, 1)) OVER w || left(r, 1) NOT IN ('su', 'ua', 'au'), false) AS odd,
    right(rtrim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, sha256(x))
), e AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, r, x ORDER BY i) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM o
), a AS (
  SELECT conv_id, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal, count(*) AS n
  FROM e GROUP BY 1
), ins(s, t, letters, paid) AS (
  VALUES (0, 0, '', 0), (0, 2, 'I', 2), (0, 3, 'II', 4), (1, 1, '', 0), (1, 2, 'I', 2), (1, 3, 'II', 4), (2, 2, '', 0), (2, 3, 'I', 2), (2, 2, 'II', 4), (3, 3, '', 0), (3, 2, 'I', 2), (3, 3, 'II', 4)
), act(f, s, t, letter, paid) AS (
  VALUES (NULL, 0, 0, 'D', 3), (NULL, 1, 1, 'D', 3), (NULL, 2, 2, 'D', 3), (NULL, 3, 3, 'D', 3), ('s', 0, 1, 'K', 0), ('u', 0, 2, 'K', 0), ('u', 1, 2, 'K', 0), ('u', 3, 2, 'K', 0), ('a', 2, 3, 'K', 0),
    (NULL, 0, 2, 'R', 2), (NULL, 1, 2, 'R', 2), (NULL, 3, 2, 'R', 2), (NULL, 2, 3, 'R', 2)
), st AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS s, 0 AS cost, '' AS audit FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s, cost, audit FROM (
    SELECT e.conv_id, e.i, act.t AS s, st.cost + ins.paid + act.paid + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 1 ELSE 0 END AS cost, audit || letters || letter AS audit
    FROM st JOIN e ON e.conv_id IS NOT DISTINCT FROM st.conv_id AND e.i = st.i + 1 JOIN ins ON ins.s = st.s JOIN act ON act.s = ins.t AND (act.f IS NULL OR act.f = e.f) AND (letter = 'D' OR coalesce(fault, '') NOT IN ('blank', 'duplicate'))
  ) QUALIFY row_number() OVER (PARTITION BY conv_id, s ORDER BY cost, audit) = 1
), z AS (
  SELECT st.conv_id, gaps, blank, duplicate, truncated, illegal, cost + paid AS cost, audit || letters AS audit FROM st LEFT JOIN a ON a.conv_id IS NOT DISTINCT FROM st.conv_id JOIN ins ON ins.s = st.s
  WHERE st.i = coalesce(a.n, 0) AND ins.t IN (0, 3) QUALIFY row_number() OVER (PARTITION BY st.conv_id ORDER BY cost + paid, audit || letters) = 1
), p AS (
  SELECT conv_id, unnest(string_split(audit, '')) AS l, unnest(range(length(audit))) AS j FROM z WHERE audit <> ''
), q AS (
  SELECT *, count(*) FILTER (l <> 'I') OVER w AS i, count(*) FILTER (l <> 'D') OVER w AS spot FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY j)
), g AS (
  SELECT q.*, e.r, e.x, bool_or(l = 'K' AND f = 's') OVER (PARTITION BY q.conv_id) AS sys FROM q LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM q.conv_id AND e.i = q.i AND l <> 'I' WHERE l <> 'D'
), h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN l = 'K' THEN r WHEN (spot - CAST(sys AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE x END, chr(10) ORDER BY j)) AS h FROM g GROUP BY 1
)
SELECT z.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(cost AS BIGINT) AS cost, audit, coalesce(h, sha256('')) AS repaired_sha256
FROM z LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM z.conv_id
"""


OP11_SQL = r"""
WITH """ + CRC + r""", own AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 AS i
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (SELECT conv_id, count(*) AS n FROM own GROUP BY 1
), f AS (SELECT conv_id, conv_id - conv_id % 20 AS b, """ + CRC_OF.format(s="CAST(conv_id AS VARCHAR)") + r""" % 4 AS h FROM n, crc
), b AS (
  SELECT f.conv_id, i, r, x FROM f JOIN own ON own.conv_id = f.b AND own.i < f.h
  UNION ALL SELECT f.conv_id, i + 4, r, x FROM f JOIN own ON own.conv_id = f.conv_id AND own.i >= f.h
), c AS (
  SELECT conv_id, row_number() OVER w AS d, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words, md5(string_agg(length(r) || ':' || length(x) || ':' || r || x, '') OVER w) AS k
  FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), p AS (SELECT conv_id, d, words, k FROM c UNION ALL SELECT conv_id, 0, 0, '' FROM n
), q AS (SELECT *, lag(k) OVER w AS up, lead(k) OVER w IS NULL AS last FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY d)
), g AS (
  SELECT k, d AS depth, any_value(up) AS up, any_value(words) AS words, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
  FROM q GROUP BY 1, 2
), kids AS (SELECT up AS k, count(*) AS n FROM g WHERE up IS NOT NULL GROUP BY 1
), below AS (SELECT DISTINCT a.k AS top, z.k FROM p a JOIN p z ON a.conv_id = z.conv_id AND a.d <= z.d
), sums AS (
  SELECT top, count(*) FILTER (kids.n IS NULL) AS n_leaves, CAST(sum((n_convs - 1) * words) AS BIGINT) AS saved_tokens FROM below JOIN g USING (k) LEFT JOIN kids USING (k) GROUP BY 1
)
SELECT g.conv_id, g.depth, o.conv_id AS parent_conv_id, g.n_convs, coalesce(kids.n, 0) AS n_children, n_leaves, saved_tokens, g.ends_sha256
FROM g JOIN sums ON sums.top = g.k LEFT JOIN g o ON o.k = g.up LEFT JOIN kids ON kids.k = g.k
"""


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql():
    return {"op2_jaccard_join": OP2_SQL, "op3_warc": OP3_SQL, "op5_chat_formatting": OP5_SQL, "op9_substring_dedup": OP9_SQL, "op11_prefix_trie": OP11_SQL, "op13_structure_repair": OP13_SQL}
