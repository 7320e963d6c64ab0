"""DuckDB statements for the queries of this subpackage that SQL can express."""

from __future__ import annotations

SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
TOKEN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> str:
    return f"translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


LINE_DEDUP = f"""
    WITH lines AS (
        SELECT row, doc_id, unnest(cut) AS line, unnest(range(1, len(cut) + 1)) AS position
        FROM (SELECT row_number() OVER () AS row, doc_id,
                     string_split(coalesce(text, ''), chr(10)) AS cut FROM documents)
    ), keyed AS (
        SELECT *, {lowered(f"regexp_replace(regexp_replace(line, '^{SPACES}+', ''), '{SPACES}+$', '')")}
                  AS key FROM lines
    ), repeated AS (
        SELECT key FROM keyed WHERE length(key) >= 1
        GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    ), marked AS (
        SELECT *, key IN (SELECT key FROM repeated) AS gone FROM keyed
    ), runs AS (
        SELECT row, count(*) AS length, min(position) AS first, any_value(gone) AS gone
        FROM (SELECT *, position - row_number() OVER (PARTITION BY row, gone ORDER BY position)
                     AS island FROM marked) GROUP BY row, gone, island
    ), bitmaps AS (
        SELECT row, CASE WHEN arg_min(gone, first) THEN '0,' ELSE '' END
                    || string_agg(length, ',' ORDER BY first)
                    || CASE WHEN arg_max(gone, first) THEN ',0' ELSE '' END AS keep
        FROM runs GROUP BY row
    )
    SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines,
           count(*) FILTER (gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT gone), ''))
               AS kept_sha256, any_value(keep) AS keep
    FROM marked JOIN bitmaps USING (row) GROUP BY row"""

#: Targets in closed form: sources in order of cap over weight, the first level that caps none.
#: A source takes its target to the word, from the front of its documents laid end to end twice.
MIXING = f"""
    WITH sized AS (
        SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
               md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS place
        FROM documents
    ), sources AS (
        SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
               row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
        FROM sized GROUP BY source
    ), weighed AS (
        SELECT *, [3, 1, 2][no % 3 + 1] AS weight, 2 * source_size AS cap,
               sum(source_size) OVER () * 1.5::DOUBLE AS total FROM sources
    ), levels AS (
        SELECT *, (total - coalesce(sum(cap) OVER (fill ROWS BETWEEN UNBOUNDED PRECEDING
                                                   AND 1 PRECEDING), 0))
                  / sum(weight) OVER (fill ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
                  AS level
        FROM weighed WINDOW fill AS (ORDER BY cap / weight, no)
    ), targets AS (
        SELECT *, least(CAST(cap AS DOUBLE),
                        weight * (SELECT level FROM levels WHERE level * weight <= cap
                                  ORDER BY cap / weight, no LIMIT 1))
                  AS target FROM levels
    ), placed AS (
        SELECT doc_id, size, source_size, target, CAST(round(target) AS BIGINT) AS words,
               sum(size) OVER (PARTITION BY no ORDER BY place, doc_id
                               ROWS UNBOUNDED PRECEDING) - size AS start
        FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
    )
    SELECT doc_id, size, source_size, target,
           CAST(greatest(0, least(size, words - start))
                + greatest(0, least(size, words - start - source_size)) AS BIGINT) AS taken
    FROM placed"""

DECONTAMINATION = f"""
    WITH items AS (
        SELECT row_number() OVER () AS item, CAST(item_id AS VARCHAR) AS item_id,
               regexp_extract_all({lowered("text")}, '{TOKEN}') AS words FROM benchmark
    ), windows AS (
        SELECT DISTINCT item_id, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS passage,
               least(len(words), 10) AS n
        FROM (SELECT *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i
              FROM items WHERE len(words) > 0)
    ), docs AS (
        SELECT row_number() OVER () AS row, doc_id,
               regexp_extract_all({lowered("coalesce(text, '')")}, '{TOKEN}') AS words FROM documents
    ), lengths AS (SELECT DISTINCT n FROM windows
    ), passages AS (
        SELECT row, i, n, array_to_string(words[i:i + n - 1], ' ') AS passage
        FROM (SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i
              FROM docs, lengths WHERE len(words) >= n)
    ), found AS (
        SELECT row, i, n, item_id FROM passages JOIN windows USING (passage, n)
    ), hit AS (
        SELECT row, count(DISTINCT spot) AS n_hit
        FROM (SELECT DISTINCT row, unnest(range(i, i + n)) AS spot FROM found) GROUP BY row
    ), named AS (
        SELECT row, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
        FROM (SELECT DISTINCT row, item_id FROM found) GROUP BY row
    )
    SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM docs LEFT JOIN hit USING (row) LEFT JOIN named USING (row)"""

SEARCH_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

LEXICAL = f"""
    WITH items AS (
        SELECT DISTINCT item_id, unnest(regexp_extract_all({lowered("text")}, '{SEARCH_TERM}')) AS term
        FROM benchmark
    ), words AS (
        SELECT row, doc_id, unnest(cut) AS term, len(cut) AS n
        FROM (SELECT row_number() OVER () AS row, doc_id,
                     regexp_extract_all({lowered("text")}, '{SEARCH_TERM}') AS cut FROM documents)
    ), corpus AS (
        SELECT CAST(count(DISTINCT row) AS BIGINT) AS docs, CAST(count(*) AS BIGINT) AS total FROM words
    ), counted AS (
        SELECT row, any_value(doc_id) AS doc_id, term, any_value(n) AS n, count(*) AS tf
        FROM words WHERE term IN (SELECT term FROM items) GROUP BY row, term
    ), weighed AS (
        SELECT term, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
        FROM counted, corpus GROUP BY term, docs
    ), added AS (
        SELECT row, doc_id, term,
               w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))) AS score
        FROM counted JOIN weighed USING (term), corpus
    ), summed AS (
        SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(score) AS BIGINT) AS score
        FROM added JOIN items USING (term) GROUP BY item_id, row
    )
    SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score
    FROM summed WHERE score > 0
    WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
    QUALIFY rank <= 10"""

SQL = {
    "op3_line_dedup": LINE_DEDUP,
    "op9_mixing": MIXING,
    "op10_decontamination": DECONTAMINATION,
    "op11_lexical": LEXICAL,
}


def licenses() -> str:
    """Every run of words against every notice, by counting the words they share."""
    from tradewind.llm.licenses import (
        CONTAINMENT, NAMES, NOTICES, longer_names, needed_words, notice_words,
    )

    notices = [(label, notice_words(t)) for label, texts in NOTICES.items() for t in texts]
    values = ", ".join(
        f"('{label}', {sorted(set(words))}, {len(words)}, {needed_words(len(set(words)), CONTAINMENT)})"
        for label, words in notices
    )
    has_name = []
    for label, phrases in NAMES.items():
        for phrase in phrases:
            rest = "text"
            for longer in longer_names(phrase):
                for _ in range(2):
                    rest = f"replace({rest}, ' {longer} ', ' | ')"
            has_name.append(f"CASE WHEN contains({rest}, ' {phrase} ') THEN '{label}' END")
    return f"""
    WITH docs AS (
        SELECT row_number() OVER () AS row, doc_id,
               regexp_extract_all({lowered("coalesce(text, '')")}, '{TOKEN}') AS words FROM documents
    ), places AS (
        SELECT row, i - 1 AS i,
               CASE WHEN words[i] = 'mit' AND words[i + 1] = 'license' THEN 'mit'
                    WHEN words[i] = 'apache' AND words[i + 1] = 'license' THEN 'apache'
                    WHEN words[i] = 'general' AND words[i + 1] = 'public'
                         AND words[i + 2] = 'license' THEN 'gpl' END AS label
        FROM (SELECT row, words, unnest(range(1, len(words))) AS i FROM docs
              WHERE list_contains(words, 'license'))
    ), base AS (
        SELECT row, count(*) AS n, min(i) AS first, max(i) AS last,
               string_agg(DISTINCT label, ',' ORDER BY label) AS labels
        FROM places WHERE label IS NOT NULL GROUP BY row
    ), named AS (
        SELECT row, unnest(list_filter([{", ".join(has_name)}], lambda x: x IS NOT NULL)) AS label
        FROM (SELECT row, ' ' || array_to_string(words, ' ') || ' ' AS text FROM docs)
    ), notices(label, words, length, needed) AS (VALUES {values}
    ), near AS (
        SELECT row, label, docs.words, notices.words AS notice, length, needed
        FROM docs, notices
        WHERE len(list_intersect(list_distinct(docs.words), notices.words)) >= needed
    ), meet AS (
        SELECT row, label, max(n) / any_value(len(notice)) AS part
        FROM (SELECT row, label, notice, needed,
                     len(list_intersect(list_distinct(words[i:i + length - 1]), notice)) AS n
              FROM (SELECT *, unnest(range(1, len(words) + 1)) AS i FROM near))
        WHERE n >= needed GROUP BY row, label
    ), best AS (SELECT row, max(part) AS part FROM meet GROUP BY row
    ), every AS (
        SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
        FROM (SELECT row, label FROM meet UNION ALL SELECT row, label FROM named
              UNION ALL SELECT row, label FROM places WHERE label IS NOT NULL) GROUP BY row
    )
    SELECT doc_id, len(docs.words) AS n_words, coalesce(base.n, 0) AS n_base, first AS first_word,
           last AS last_word, coalesce(base.labels, '') AS base_labels,
           coalesce(every.labels, '') AS labels,
           CASE WHEN base.n > 0 OR row IN (SELECT row FROM named) THEN 1.0::DOUBLE
                ELSE coalesce(part, 0)::DOUBLE END AS score
    FROM docs LEFT JOIN base USING (row) LEFT JOIN best USING (row) LEFT JOIN every USING (row)"""


SQL["op6_licenses"] = licenses()

SQL["op8_topk"] = """
    WITH vectors AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v
        FROM embeddings
        WHERE len(embedding) > 0
          AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
    ), scored AS (
        SELECT q.vec_id AS query_id, p.vec_id, CAST(list_inner_product(q.v, p.v) AS BIGINT) AS score
        FROM vectors q JOIN vectors p ON q.vec_id % 20 = 0 AND q.vec_id <> p.vec_id
    )
    SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
          FROM scored)
    WHERE rank <= 20"""
