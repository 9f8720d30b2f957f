"""The registered queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, html_extract, line_dedup, near_dup, quality, recurrent_lm, toxicity
from .common import table


def op1_toxicity(spark, sf_dir):
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_bpe(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"), bpe.vocabulary_path())


def op3_exact_dedup(spark, sf_dir):
    return exact_dedup.report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op4_line_cut(spark, sf_dir):
    return line_dedup.deduplicate(table(spark, sf_dir, "documents"))


def op5_recurrent_lm(spark, sf_dir):
    return recurrent_lm.report(table(spark, sf_dir, "documents"))


def op6_quality(spark, sf_dir):
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_near_dup(spark, sf_dir):
    return near_dup.annotate(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_html_extract(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_chat_format(spark, sf_dir):
    return chat.report(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_bpe, op3_exact_dedup, op4_line_dedup, op4_line_cut, op5_recurrent_lm, op6_quality, op7_near_dup, op8_decontaminate, op9_html_extract, op10_chat_format)}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOW} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM d""",
    "op4_line_dedup": """
        WITH l AS (SELECT x AS line, count(*) AS n_rows, min(doc_id) AS first_doc_id, sha256(x) AS sha, length(x) AS n
                   FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x FROM documents) WHERE x <> '' GROUP BY x),
        k AS (SELECT sha, n, line, unnest(range(1, n + 1)) AS i FROM l WHERE n >= 20),
        s AS (SELECT sha, n, md5(i || ':' || line[1:i - 1] || chr(1) || line[i + 1:n]) AS m, md5(line[1:i - 1] || line[i + 1:n]) AS d FROM k),
        e AS (SELECT a.sha AS x, b.sha AS y FROM s a JOIN s b ON a.m = b.m AND a.n = b.n AND a.sha <> b.sha
              UNION SELECT a.sha, b.sha FROM s a JOIN l b ON a.d = md5(b.line) AND b.n = a.n - 1 AND b.n >= 20
              UNION SELECT b.sha, a.sha FROM s a JOIN l b ON a.d = md5(b.line) AND b.n = a.n - 1 AND b.n >= 20),
        f AS (SELECT x, count(*) AS n_links, min(struct_pack(d := first_doc_id, s := sha)) AS m FROM e JOIN l ON l.sha = e.y GROUP BY x)
        SELECT sha AS line_sha256, n AS n_chars, n_rows, first_doc_id, coalesce(n_links, 0) AS n_links,
               CASE WHEN m < struct_pack(d := first_doc_id, s := sha) THEN m.s ELSE sha END AS class_sha256
        FROM l LEFT JOIN f ON f.x = l.sha""",
    "op7_near_dup": """
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
        r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, min(r.b) AS component_id, d.doc_id = min(r.b) AS kept
        FROM d LEFT JOIN n USING (doc_id) JOIN r ON r.a = d.doc_id GROUP BY d.doc_id, n""",
    "op8_decontaminate": f"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
        k AS (SELECT item_id, w, least(len(w), 13) AS n FROM b WHERE len(w) > 0),
        g AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
              FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM k)),
        s AS (SELECT DISTINCT n FROM k),
        p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
              FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, s)),
        h AS (SELECT doc_id, i, p.n, item_id FROM p JOIN g ON p.g = g.g AND p.n = g.n),
        c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM h) GROUP BY 1),
        t AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_chat_format": """
        WITH m AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\\', '\\\\'), '<|', '<\\|'), '<s>', '<\\s>'),
                '</s>', '<\\/s>'), '[INST]', '[\\INST]'), '[/INST]', '[\\/INST]'), '<<SYS>>', '<\\<SYS>>'), '<</SYS>>', '<\\</SYS>>') AS x FROM m)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(12 + length(role) + 1 + length(x) + 10 + 1) AS BIGINT) AS formatted_chars
        FROM e GROUP BY conv_id""",
}
