"""One query for each operator of this subpackage, over its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeflow.llm.chat_windows import chat_windows, window_digest
from gaugeflow.llm.common import ship, table
from gaugeflow.llm.edit_matching import contamination
from gaugeflow.llm.line_windows import dedup_lines
from gaugeflow.llm.packing import pack_documents
from gaugeflow.llm.part_codes import ENTRIES, PARTS, ROUNDS, SCALE, compressed_vectors
from gaugeflow.llm.periodic_runs import periodic_runs, periods_by_id, run_digest
from gaugeflow.llm.pivot_index import near_vectors
from gaugeflow.llm.quality import quality_scores
from gaugeflow.llm.secret_ownership import secret_spans
from gaugeflow.llm.set_join import shingle_groups
from gaugeflow.llm.token_counts import token_counts
from gaugeflow.llm.toxicity import toxicity_scores
from gaugeflow.llm.wrapper_text import page_texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")
    )


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    )


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


ORACLE["op8_line_dedup"] = r"""
WITH split AS (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), line AS (
    SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM split
), following AS (
    SELECT doc_id, place, line AS a,
        lead(line, 1) OVER (PARTITION BY doc_id ORDER BY place) AS b,
        lead(line, 2) OVER (PARTITION BY doc_id ORDER BY place) AS c,
        lead(place, 2) OVER (PARTITION BY doc_id ORDER BY place) AS last
    FROM line WHERE regexp_matches(line, '\S')
), numbered AS (
    SELECT doc_id, place, last, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, place) AS nth
    FROM following WHERE last IS NOT NULL
), covered AS (
    SELECT DISTINCT doc_id, unnest(range(place, last + 1)) AS place FROM numbered WHERE nth > 1
)
SELECT l.doc_id, count(*) AS n_lines, count(c.place) AS n_removed,
    coalesce(string_agg(l.line, chr(10) ORDER BY l.place) FILTER (WHERE c.place IS NULL), '') AS text
FROM line l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.place = c.place
GROUP BY l.doc_id
"""


@query
def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    injected = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame(
        [(-1, 0, "user", injected), (-1, 1, "assistant", injected)], conversations.schema
    )
    return window_digest(
        chat_windows(conversations.union(probe), public_tokenizers.path("byte_bpe_50k.json"))
    )


@query
def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


@query
def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


# Every pair of equal label is compared.
ORACLE["op4_near_vectors"] = r"""
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS MATERIALIZED (
    SELECT a.vec_id AS a, b.vec_id AS b
    FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reached AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION
    SELECT r.vec_id, l.b FROM reached r JOIN link l ON r.other = l.a
), least AS (
    SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id
), linked AS (
    SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a
)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e LEFT JOIN linked USING (vec_id) JOIN least USING (vec_id)
"""


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_groups(table(spark, sf_dir, "documents"))


# Every pair that shares a shingle is counted.
ORACLE["op6_jaccard_join"] = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingle AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[])
        WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
    FROM words
), size AS (
    SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), link AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
        JOIN size m ON m.doc_id = a.doc_id JOIN size n ON n.doc_id = b.doc_id
    GROUP BY a.doc_id, b.doc_id, m.n, n.n
    HAVING 100 * count(*) >= 75 * (m.n + n.n - count(*))
), reached AS (
    SELECT doc_id, doc_id AS other FROM documents
    UNION
    SELECT r.doc_id, l.b FROM reached r JOIN link l ON r.other = l.a
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents d LEFT JOIN size USING (doc_id) JOIN least USING (doc_id)
"""


# Places of a pattern's matches: lengths of the stretches between them, added up.
_PLACES = r"""
    SELECT doc_id, source, lang, {kind} AS kind, nth,
        list_sum(list_transform(gaps[1:nth], lambda x: length(x)))
            + coalesce(list_sum(list_transform(found[1:nth - 1], lambda x: length(x))), 0) AS start,
        length(found[nth]) AS size, vals[nth] AS val
    FROM (
        SELECT doc_id, source, lang, string_split_regex(body, '{pattern}') AS gaps,
            regexp_extract_all(body, '{pattern}', 0) AS found,
            regexp_extract_all(body, '{pattern}', {part}) AS vals,
            unnest(range(1, len(regexp_extract_all(body, '{pattern}', 0)) + 1)) AS nth
        FROM (SELECT *, coalesce(text, '') AS body FROM documents)
    )
"""
_PARTS = (
    r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)""",
    "AKIA[A-Z0-9]+",
    "[0-9a-f]{24,}",
    "[A-Za-z0-9+/_-]{32,}",
)
ORACLE["op2_secrets"] = (
    "WITH matched AS ("
    + " UNION ALL ".join(
        _PLACES.replace("{kind}", str(k)).replace("{pattern}", p).replace("{part}", "2" if k == 0 else "0")
        for k, p in enumerate(_PARTS)
    )
    + r"""), span AS (
    SELECT *, CAST(start + size AS BIGINT) AS stop FROM matched
    WHERE (kind = 0 AND length(val) >= 6) OR (kind = 1 AND size >= 20) OR (kind = 2 AND size >= 24)
        OR (kind = 3 AND regexp_matches(val, '[0-9]') AND regexp_matches(val, '[A-Z]') AND regexp_matches(val, '[a-z]'))
), owned AS (
    SELECT val, count(DISTINCT source) AS n_owners, count(DISTINCT source || '/' || lang) AS n_repositories
    FROM span GROUP BY val
), judged AS (
    SELECT s.*, n_owners >= 3 OR n_repositories >= 6 AS copied,
        ['assign', 'access', 'hex', 'opaque'][kind + 1] || ':' || CAST(start AS BIGINT) || ':' || stop AS entry
    FROM span s JOIN owned USING (val)
), kept AS (
    SELECT * FROM judged j WHERE kind < 3 OR (NOT copied AND NOT EXISTS (
        SELECT 1 FROM judged b
        WHERE b.doc_id = j.doc_id AND b.kind < 3 AND b.start < j.stop AND b.stop > j.start))
)
SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
    count(*) FILTER (kind = 2) AS n_hex,
    sha256(coalesce(string_agg(entry, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
    coalesce(string_agg(entry, ',' ORDER BY start, kind), '') AS spans,
    count(*) FILTER (kind < 3 AND copied) AS n_examples,
    count(*) FILTER (kind < 3 AND NOT copied) AS n_live
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
GROUP BY d.doc_id
"""
)


@query
def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_texts(table(spark, sf_dir, "pages"))


# The pages of these tables have one article, of headings, paragraphs, bold print and breaks.
ORACLE["op11_main_text"] = r"""
WITH article AS (
    SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages
), block AS (
    SELECT page_id, url, unnest(split) AS raw, generate_subscripts(split, 1) AS place
    FROM (SELECT *, string_split_regex(body, '</?(h1|p)>') AS split FROM article)
), plain AS (
    SELECT page_id, url, place, trim(regexp_replace(replace(replace(replace(replace(replace(
        regexp_replace(replace(raw, '<br>', ' '), '</?b>', '', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&'),
        '\s+', ' ', 'g')) AS line
    FROM block
), told AS (
    SELECT page_id, url, place, regexp_replace(line, '&amp$', '&') AS line FROM plain
)
SELECT page_id, url, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (line <> ''), '') AS text,
    length(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (line <> ''), '')) AS n_chars
FROM told GROUP BY page_id, url
"""


@query
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed_vectors(table(spark, sf_dir, "embeddings"))


def _codes_sql() -> str:
    """The rounds written out one after the other, each distance computed."""
    steps = [
        f"""number AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), place AS MATERIALIZED (
    SELECT vec_id, label, p, unnest(range(1, len(v) // {PARTS} + 1)) AS i,
        unnest(v[p * (len(v) // {PARTS}) + 1:(p + 1) * (len(v) // {PARTS})]) AS x
    FROM number, range({PARTS}) AS t(p)
), start AS (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM number QUALIFY e < {ENTRIES}
), book0 AS MATERIALIZED (
    SELECT p, e, i, x FROM place JOIN start USING (vec_id)
)"""
    ]
    for k in range(ROUNDS + 1):
        steps.append(
            f"""goes{k} AS MATERIALIZED (
    SELECT vec_id, label, p, min(d) AS d, arg_min(e, d * {ENTRIES} + e) AS e
    FROM (
        SELECT vec_id, label, p, e, CAST(sum((a.x - b.x) * (a.x - b.x)) AS BIGINT) AS d
        FROM place a JOIN book{k} b USING (p, i) GROUP BY ALL
    )
    GROUP BY ALL
)"""
        )
        if k < ROUNDS:
            steps.append(
                f"""book{k + 1} AS MATERIALIZED (
    SELECT p, e, i, coalesce(m.x, b.x) AS x
    FROM book{k} b LEFT JOIN (
        SELECT p, e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x
        FROM place JOIN goes{k} USING (vec_id, p) GROUP BY p, e, i
    ) m USING (p, e, i)
)"""
            )
    return (
        "WITH "
        + ", ".join(steps)
        + f""", code AS (
    SELECT vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
    FROM goes{ROUNDS} GROUP BY vec_id, label
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
    (SELECT sha256(string_agg(x, ',' ORDER BY p, e, i)) FROM book{ROUNDS}) AS codebooks_sha256
FROM code
"""
    )


ORACLE["op12_vector_codes"] = _codes_sql()


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digest(periodic_runs(table(spark, sf_dir, "documents"), periods_by_id))
