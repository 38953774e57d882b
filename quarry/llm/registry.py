"""Queries of the training-data operators, and SQL oracles where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.llm import chat, decontamination, html, language, nearjoin, packing, quality, repair, resampling, sentences, suffixes, topk, urls
from quarry.sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_exact_topk(spark, sf_dir):
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


ORACLES["op8_exact_topk"] = """
WITH v AS (SELECT vec_id, row_number() OVER () AS n, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT q.n, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product([CAST(x AS DOUBLE) for x in q.e], [CAST(x AS DOUBLE) for x in c.e]) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.n <> c.n),
     r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op9_url_filters(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op4_decontamination(spark, sf_dir):
    return decontamination.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLES["op4_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
     b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     bi AS (SELECT item_id, w, least(len(w), 13) AS sz, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0),
     bw AS (SELECT DISTINCT item_id, sz, array_to_string(w[i:i + sz - 1], ' ') AS g FROM bi),
     sizes AS (SELECT DISTINCT sz FROM bw),
     di AS (SELECT doc_id, w, sz, unnest(range(1, len(w) - sz + 2)) AS i FROM d, sizes WHERE len(w) >= sz),
     dw AS (SELECT doc_id, sz, i, array_to_string(w[i:i + sz - 1], ' ') AS g FROM di),
     o AS (SELECT doc_id, i, dw.sz, item_id FROM dw JOIN bw USING (sz, g)),
     h AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + sz)) AS j FROM o) GROUP BY 1),
     k AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
           FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM o) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""


@query
def op7_language_id(spark, sf_dir):
    return language.digest(table(spark, sf_dir, "documents"))


@query
def op10_suffix_dedup(spark, sf_dir):
    return suffixes.passages(table(spark, sf_dir, "documents"))


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    return nearjoin.digest(table(spark, sf_dir, "documents"))


@query
def op3_quality_classifier(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_substring_dedup(spark, sf_dir):
    return sentences.digest(table(spark, sf_dir, "documents"))


@query
def op5_html_extraction(spark, sf_dir):
    return html.extract(table(spark, sf_dir, "pages"))


@query
def op12_structure_repair(spark, sf_dir):
    return repair.check(table(spark, sf_dir, "conversations"))


@query
def op11_chat_formatting(spark, sf_dir):
    return chat.check(table(spark, sf_dir, "conversations"))


ORACLES["op11_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
     e AS (SELECT *, length(regexp_replace(replace(text, '\', '\\'), '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|role\|>|<\|text\|>|<\|end\|>', '###', 'g')) AS n,
                  length(regexp_replace(replace(role, '\', '\\'), '<<SYS>>|<</SYS>>|\[INST\]|\[/INST\]|<s>|</s>|<\|role\|>|<\|text\|>|<\|end\|>', '###', 'g')) AS r
           FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 16 WHEN 'assistant' THEN 10 ELSE 24 + r END) AS BIGINT) AS formatted_chars,
       regexp_full_match(string_agg(role || ',', '' ORDER BY turn NULLS FIRST, role, text), '(system,)?(user,assistant,)+') AS valid
FROM e GROUP BY conv_id
"""


@query
def op13_importance_resampling(spark, sf_dir):
    return resampling.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# A CRC-32 by its table of 256 steps; distinct words only.
_CRC = """
     steps(n, c, k) AS (SELECT i, CAST(i AS BIGINT), 0 FROM range(256) r(i)
                        UNION ALL SELECT n, CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
     crc_table AS (SELECT list(c ORDER BY n) AS l FROM steps WHERE k = 8)"""


def _crc(text: str) -> str:
    """SQL of the CRC-32 of a text column, where the list `l` of `crc_table` can be seen."""
    byte = f"[CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS INT), 2) AS BIGINT) for i in range(octet_length(encode({text})))]"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {byte}), lambda a, x: xor(a >> 8, l[1 + (xor(a, x) & 255)])))"


ORACLES["op13_importance_resampling"] = f"""
WITH RECURSIVE {_CRC},
     d AS (SELECT row_number() OVER () AS n, doc_id, {_WORDS} AS w FROM documents),
     dw AS (SELECT n, unnest(w) AS word FROM d),
     bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
     words AS (SELECT word, {_crc("word")} % 10000 AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM dw UNION ALL SELECT word FROM bw)), crc_table),
     s AS (SELECT bucket, count(*) AS s FROM dw JOIN words USING (word) GROUP BY 1),
     t AS (SELECT bucket, count(*) AS t FROM bw JOIN words USING (word) GROUP BY 1),
     totals AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
     gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + CAST(1 AS DOUBLE)) * (s_all + CAST(10000 AS DOUBLE)) / ((s + CAST(1 AS DOUBLE)) * (t_all + CAST(10000 AS DOUBLE))))) AS BIGINT) AS g
              FROM s LEFT JOIN t USING (bucket), totals),
     per AS (SELECT n, sum(g) AS total FROM dw JOIN words USING (word) JOIN gain USING (bucket) GROUP BY 1),
     weighed AS (SELECT n, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(total, 0) AS BIGINT) AS total,
                        CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
                 FROM d LEFT JOIN per USING (n)),
     scored AS (SELECT n, doc_id, n_features, CASE WHEN n_features = 0 THEN 0 ELSE (total - (total % n_features + n_features) % n_features) // n_features END AS weight,
                       CAST(floor(-1000 * ln(-ln((h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS noise
                FROM weighed),
     ranked AS (SELECT n, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS r, count(*) OVER () AS many FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN r <= many * 10 // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (n)
"""


def _least(*options: str) -> str:
    """The least of (cost, audit) structs."""
    return f"list_sort([{', '.join(options)}])[1]"


def _then(cost: str, letter: str, after: str) -> str:
    return f"{{'c': {cost} + {after}.c, 's': '{letter}' || {after}.s}}"


def _state(own: str, keep: dict[str, str], other: str) -> str:
    """A state's cheapest edits from a row on, from those after it: `keep` says which initials may stay and where they lead."""
    stay = " ".join(f"WHEN NOT bad AND initial = '{i}' THEN {_then('open', 'K', to)}" for i, to in keep.items())
    never = "{'c': 1000000000, 's': ''}"
    return _least(_then("2", "D", own), f"CASE {stay} ELSE {never} END", f"CASE WHEN bad THEN {never} ELSE {_then('1 + open', 'R', other)} END")


# Cheapest edits from each row on, from a conversation's last row to its first, by state: nothing yet (b), system (y), user (u), assistant (a).
ORACLES["op12_structure_repair"] = f"""
WITH RECURSIVE {_CRC},
     every AS (SELECT conv_id, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
     damage AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("coalesce(CAST(v.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind
                FROM conversations v JOIN every e ON v.conv_id IS NOT DISTINCT FROM e.conv_id, crc_table),
     r AS (SELECT c, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                  unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
           FROM damage WHERE kind <> 0),
     n AS (SELECT c, turn, role, text, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY c) AS many,
                  left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM r),
     f AS (SELECT *, bare = '' AS blank, bare <> '' AND row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again FROM n),
     g AS (SELECT *, blank OR again AS bad, NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') AS cut_off,
                  CASE WHEN NOT blank AND NOT again AND right(bare, 1) NOT IN ('.', '!', '?') THEN 5 ELSE 0 END AS open,
                  lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM f),
     dp AS (SELECT c, many + 1 AS i, {{'c': 0, 's': ''}} AS b, {{'c': 10, 's': 'II'}} AS y, {{'c': 5, 's': 'I'}} AS u, {{'c': 0, 's': ''}} AS a FROM g WHERE i = 1
            UNION ALL
            SELECT c, i, {_least("b", _then("5", "I", "u1"))}, {_least("y", _then("5", "I", "u1"))}, u1, {_least("a", _then("5", "I", "u"))}
            FROM (SELECT *, {_least("u", _then("5", "I", "a"))} AS u1
                  FROM (SELECT dp.c, g.i, {_state("b", {"s": "y", "u": "u"}, "u")} AS b, {_state("y", {"u": "u"}, "u")} AS y, {_state("u", {"a": "a"}, "a")} AS u, {_state("a", {"u": "u"}, "u")} AS a
                        FROM dp JOIN g ON g.c = dp.c AND g.i = dp.i - 1))),
     best AS (SELECT c, b.c AS cost, b.s AS audit FROM dp WHERE i = 1),
     letters AS (SELECT c, k, substr(audit, CAST(k AS INT), 1) AS letter, length(replace(audit, 'D', '')) AS many FROM (SELECT c, audit, unnest(range(1, length(audit) + 1)) AS k FROM best)),
     placed AS (SELECT *, sum(CASE letter WHEN 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY k) AS i, sum(CASE letter WHEN 'D' THEN 0 ELSE 1 END) OVER (PARTITION BY c ORDER BY k) AS j FROM letters),
     fixed AS (SELECT p.c, k, CASE letter WHEN 'K' THEN role || ':' || text ELSE CASE WHEN (j + p.many) % 2 = 1 THEN 'user:' ELSE 'assistant:' END || CASE letter WHEN 'R' THEN text ELSE '' END END AS line
               FROM placed p LEFT JOIN g ON g.c = p.c AND g.i = p.i WHERE letter <> 'D'),
     sealed AS (SELECT c, sha256(string_agg(line, chr(10) ORDER BY k)) AS h FROM fixed GROUP BY 1),
     counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate, count(*) FILTER (cut_off) AS truncated,
                       count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM g GROUP BY 1)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM every LEFT JOIN counts USING (c) LEFT JOIN best USING (c) LEFT JOIN sealed USING (c)
"""
