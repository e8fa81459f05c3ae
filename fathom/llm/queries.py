"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F  # noqa: F401

from .common import table


def op10_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


def op2_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import quantised, top_k

    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding")).alias("vector"))
    return top_k(rows, rows.where("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"), 5)


URL_RULES = [("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block")]


def op9_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .urls import alias_edges, judge

    pages = table(spark, sf_dir, "pages")
    return judge(pages, URL_RULES, alias_edges(pages))


def op3_dom_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html import main_text

    return main_text(table(spark, sf_dir, "pages"))


#: The production tree's first level, by source, and the weights of its nodes; others weigh 1.
DOMAIN = "case when source in ('src0', 'src1', 'src2', 'src3') then 'web' when try_cast(substring(source, 4) as int) < 12 then 'books' else 'reference' end"
MIX = {("web",): 3.0, ("books",): 4.0, ("reference",): 3.0, ("web", "en"): 3.0, ("books", "en"): 2.0, ("reference", "en"): 2.0, ("web", "en", "src0"): 0.5}


def op1_weighted_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    levels = [("domain", F.expr(DOMAIN)), ("lang", F.col("lang")), ("source", F.col("source"))]
    return mix(table(spark, sf_dir, "documents"), levels, MIX, 0.75, epochs=4)


def op4_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import maximal_conversations

    return maximal_conversations(table(spark, sf_dir, "conversations"))


def op5_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan

    return scan(table(spark, sf_dir, "documents"))


_WORDS_SQL = "list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda y: y <> '')"
_PAIRS_SQL = "list_distinct(list_transform(range(1, len({0})), lambda k: ({0})[k] || ' ' || ({0})[k + 1]))"


def _license_sql() -> str:
    from .licenses import TEMPLATES, THRESHOLD, bigrams, normal_words

    rows = ", ".join(f"('{k}', {bigrams(normal_words(t))!r})" for k, t in TEMPLATES.items())
    return f"""
        WITH t(license, b) AS (VALUES {rows}),
        u AS (SELECT doc_id, 'text' AS scope, text AS unit FROM documents
              UNION ALL SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents),
        w AS (SELECT doc_id, scope, list_filter(string_split(regexp_replace(lower(unit), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM u),
        g AS (SELECT doc_id, scope, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM w WHERE len(w) > 1),
        d AS (SELECT doc_id, scope, license, 2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b)) AS dice FROM g, t
              WHERE len(g) >= len(b) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9 AND len(g) <= len(b) * (2 - {THRESHOLD}) / {THRESHOLD} + 1e-9),
        l AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_WORDS_SQL.format("x")}), lambda w: len(w) > 0) AS lines FROM documents WHERE contains(text, chr(10))),
        f AS (SELECT doc_id, lines, flatten(lines) AS w FROM l WHERE len(lines) > 1),
        p AS MATERIALIZED (SELECT doc_id, lines, {_PAIRS_SQL.format("w")} AS g FROM f),
        near AS MATERIALIZED (SELECT doc_id, lines, license, b FROM p, t WHERE len(list_intersect(g, b)) >= len(b) * {THRESHOLD} / (2 - {THRESHOLD}) - 1e-9),
        i AS (SELECT *, unnest(range(1, len(lines))) AS i FROM near),
        j AS (SELECT doc_id, license, b, flatten(lines[i:j]) AS w FROM (SELECT *, unnest(range(i + 1, len(lines) + 1)) AS j FROM i)),
        run AS (SELECT doc_id, license, max(2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b))) AS dice FROM (SELECT doc_id, license, b, {_PAIRS_SQL.format("w")} AS g FROM j) GROUP BY 1, 2),
        one AS (SELECT doc_id, license, max(2.0::DOUBLE * len(list_intersect(g, b)) / (len(g) + len(b))) AS alone FROM (
            SELECT doc_id, license, b, {_PAIRS_SQL.format("w")} AS g FROM (SELECT doc_id, license, b, unnest(list_prepend(flatten(lines), lines)) AS w FROM near)) GROUP BY 1, 2),
        every AS (SELECT * FROM d UNION ALL SELECT doc_id, 'lines', license, dice FROM run JOIN one USING (doc_id, license) WHERE dice > alone + 1e-12),
        m AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, scope <> 'text', license, scope) AS k
              FROM every WHERE dice >= {THRESHOLD} - 1e-12)
        SELECT doc_id, license, dice, scope, CAST(coalesce(n, 0) AS BIGINT) AS n_matches
        FROM (SELECT doc_id FROM documents) LEFT JOIN (FROM m WHERE k = 1) USING (doc_id)
    """


QUERIES = {"op1_weighted_tree": op1_weighted_tree, "op4_snapshots": op4_snapshots, "op5_license_dice": op5_license_dice, "op3_dom_trees": op3_dom_trees, "op2_threshold": op2_threshold, "op9_redirects": op9_redirects, "op6_decision_list": op6_decision_list, "op7_tiered_packing": op7_tiered_packing, "op8_noisy_channel": op8_noisy_channel, "op10_setsketch": op10_setsketch}
ORACLE: dict[str, str] = {
    "op4_snapshots": """
        WITH r AS (
            SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
        ), c AS (
            SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns,
                string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
                list(length(role) || ':' || role || length(text) || ':' || text ORDER BY turn NULLS FIRST, role, text) AS turns
            FROM r GROUP BY conv_id
        ), k AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_snapshots, first(text) AS text, turns FROM c GROUP BY n_turns, turns)
        SELECT conv_id, n_turns, n_snapshots, text FROM k
        WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.n_turns > k.n_turns AND c.turns[1:k.n_turns] = k.turns)
    """,
    "op5_license_dice": _license_sql(),
    "op2_threshold": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q) WHERE a.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
    """,
    "op9_redirects": r"""
        WITH RECURSIVE links AS (
            SELECT source, trim(CASE
                WHEN regexp_matches(tag, '(?i)^<link\b.*\srel\s*=\s*["'']?[^"''>]*\bcanonical\b') THEN regexp_extract(tag, '(?i)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 1)
                    || regexp_extract(tag, '(?i)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 2) || regexp_extract(tag, '(?i)\shref\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', 3)
                WHEN regexp_matches(tag, '(?i)^<meta\b.*\shttp-equiv\s*=\s*["'']?\s*refresh\b') THEN regexp_extract(tag, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END) AS t
            FROM (SELECT url AS source, regexp_replace(unnest(regexp_extract_all(
                regexp_replace(html, '<!--.*?(?:-->|\z)|<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<textarea\b.*?(?:</textarea\s*>|\z)|<title\b.*?(?:</title\s*>|\z)', '', 'gis'),
                '(?i)<(?:link|meta)\b[^<>]*>')), '\s+', ' ', 'g') AS tag FROM pages)
        ), bits AS (
            SELECT source, t, regexp_extract(source, '^(.*?://[^/?#]*)', 1, 's') AS site, regexp_extract(source, '://[^/?#]*([^?#]*)', 1) AS own, regexp_extract(source, '://[^?#]*(\?[^#]*)', 1) AS ask
            FROM (SELECT source, replace(t, '&amp;', '&') AS t FROM links WHERE t <> '' AND source IS NOT NULL)
        ), raw AS (
            SELECT source, site, regexp_extract(t, '^[^?#]*(.*)', 1, 's') AS rest,
                CASE WHEN regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN CASE WHEN contains(t, '://') THEN t END WHEN starts_with(t, '//') THEN 'http:' || t
                     WHEN starts_with(t, '#') THEN site || own || ask WHEN starts_with(t, '?') THEN site || own || t END AS whole,
                CASE WHEN starts_with(t, '/') THEN regexp_extract(t, '^([^?#]*)', 1) ELSE CASE WHEN contains(own, '/') THEN regexp_extract(own, '^(.*/)', 1, 's') ELSE '/' END || regexp_extract(t, '^([^?#]*)', 1) END AS p,
                regexp_matches(t, '^([A-Za-z][A-Za-z0-9+.-]*:|//|#|\?)') AS absolute
            FROM bits
        ), steps AS (
            SELECT source, site, rest, whole, absolute, 1 AS i, [''] AS done, (string_split(CASE WHEN regexp_matches(p, '/\.\.?$') THEN p || '/' ELSE p END, '/'))[2:] AS parts FROM raw
            UNION ALL
            SELECT source, site, rest, whole, absolute, i + 1, CASE parts[i] WHEN '.' THEN done WHEN '..' THEN done[1:greatest(len(done) - 1, 1)] ELSE list_append(done, parts[i]) END, parts
            FROM steps WHERE NOT absolute AND i <= len(parts)
        ), ends AS (
            SELECT source, CASE WHEN absolute THEN whole ELSE site || array_to_string(done, '/') || rest END AS target FROM steps WHERE absolute OR i > len(parts)
        ), urls AS (
            SELECT url, translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '://[^?#]*(\?[^#]*)', 1) AS query
            FROM (SELECT source AS url FROM ends UNION SELECT target FROM ends WHERE contains(target, '://') UNION SELECT url FROM pages WHERE contains(url, '://'))
        ), judged AS (
            SELECT *, host || path || query AS node,
                CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
                     WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
                     WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
                     WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
                     WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule
            FROM urls WHERE contains(url, '://')
        ), ruled AS (
            SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS v FROM judged
        ), edges AS (
            SELECT DISTINCT a.node AS x, b.node AS y FROM ends e JOIN ruled a ON a.url = e.source JOIN ruled b ON b.url = e.target
        ), both_ways AS (SELECT x, y FROM edges UNION SELECT y, x FROM edges),
        reach AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
        by_alias AS (
            SELECT r.x AS node, CASE WHEN bool_or(v = 'allow') THEN 'allow' WHEN bool_or(v = 'block') THEN 'block' END AS v
            FROM reach r JOIN ruled u ON u.node = r.y GROUP BY r.x
        )
        SELECT p.page_id, coalesce(u.host, '') AS host, coalesce(u.path, '') AS path, u.rule, coalesce(u.v, a.v, 'allow') AS verdict
        FROM pages p LEFT JOIN ruled u ON u.url = p.url LEFT JOIN by_alias a ON a.node = u.node
    """,
    "op10_setsketch": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
        ), s AS MATERIALIZED (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w
        ), h AS MATERIALIZED (SELECT doc_id, hash(g) AS g FROM s
        ), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id
        ), inter AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM h a JOIN h b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
          SELECT a, b FROM inter JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
        ), both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links
        ), reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
        ), c AS (SELECT a AS doc_id, least(a, min(b)) AS component_id FROM reach GROUP BY a)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
        FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
}
