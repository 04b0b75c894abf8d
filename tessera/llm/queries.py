"""The registered queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.setsketch import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.recompression import digests, remove_repeats

    return digests(remove_repeats(table(spark, sf_dir, "documents")))


def op6_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.bpe import encode_digests

    return encode_digests(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.langid import identify_languages

    return identify_languages(table(spark, sf_dir, "documents"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ppm import score_texts

    return score_texts(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pstable import nearest

    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors.filter("vec_id % 100 = 0"), vectors)


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.revisits import captures, header_lines, resolve_revisits

    return header_lines(resolve_revisits(captures(table(spark, sf_dir, "pages"))))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.decontaminate import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.ordinal import grade_texts, graded

    return grade_texts(table(spark, sf_dir, "documents"), graded(table(spark, sf_dir, "labels")))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.lexical import search

    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.variants import group_variants, marked_words

    return group_variants(marked_words(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op10_quality_grades": op10_quality_grades,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op6_bpe_encode_decode": op6_bpe_encode_decode,
    "op9_toxicity": op9_toxicity,
    "op4_language_id": op4_language_id,
    "op5_lm_scoring": op5_lm_scoring,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op11_license_scan": op11_license_scan,
    "op12_lexical_search": op12_lexical_search,
    "op13_spelling_variants": op13_spelling_variants,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPLIT = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x != '')"

_TAG = "'\"' || substr({}, 1, 16) || '\"'"
_LINES = """array_to_string(list_sort(list_filter([
    CASE WHEN {date} IS NOT NULL THEN 'date: ' || {date} END, CASE WHEN {etag} IS NOT NULL THEN 'etag: ' || {etag} END,
    'cache-control: max-age=' || {age}, 'content-type: text/html', 'content-length: ' || {size}, 'server: node' || {node}], lambda x: x IS NOT NULL)), chr(10))"""

_TERMS = r"list_filter(string_split_regex(" + _LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


def _license_sql() -> str:
    from tessera.llm.licenses import PERCENT, PHRASES, TEMPLATES

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    listed = lambda rows: ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    return f"""
        WITH d AS MATERIALIZED (SELECT doc_id, row_number() OVER () AS id, {_TERMS} AS w FROM documents),
        x AS MATERIALIZED (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM d),
        ph AS (SELECT {_TERMS} AS p, label FROM (VALUES {listed(PHRASES)}) v(text, label)),
        base AS (SELECT id, i, label FROM x JOIN ph ON word = p[1] JOIN d USING (id) WHERE w[i + 1 : i + len(p)] = p),
        b AS (SELECT id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM base GROUP BY id),
        tw AS (SELECT row_number() OVER () AS t, label, {_TERMS} AS p FROM (VALUES {listed(TEMPLATES)}) v(label, text)),
        tk AS MATERIALIZED (SELECT t, label, len(p) + len(p) // 4 + 1 AS span, len(list_distinct(p)) AS size, unnest(list_distinct(p)) AS word FROM tw),
        occ AS MATERIALIZED (SELECT id, t, label, span, size, i, word FROM x JOIN tk USING (word)),
        rich AS (SELECT id, t FROM occ GROUP BY id, t, size HAVING 100 * count(DISTINCT word) >= {PERCENT} * size),
        near AS MATERIALIZED (SELECT occ.* FROM occ SEMI JOIN rich USING (id, t)),
        win AS (SELECT a.id, a.label, a.size, count(DISTINCT b.word) AS n FROM near a JOIN near b ON a.id = b.id AND a.t = b.t AND b.i >= a.i AND b.i < a.i + a.span GROUP BY a.id, a.t, a.label, a.size, a.i),
        m AS (SELECT id, list(DISTINCT label) AS labels, max(n / size) AS best FROM win WHERE 100 * n >= {PERCENT} * size GROUP BY id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
            coalesce(array_to_string(b.labels, ','), '') AS base_labels, coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, m.labels))), ','), '') AS labels,
            CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
        FROM d LEFT JOIN b USING (id) LEFT JOIN m USING (id)"""


ORACLE_SQL: dict[str, str] = {
    "op12_lexical_search": f"""
        WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS w FROM documents),
        s AS MATERIALIZED (SELECT count(*) FILTER (len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
        q AS MATERIALIZED (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY 1, 2),
        p AS MATERIALIZED (
            SELECT k, doc_id, n, term, count(*) AS tf FROM (SELECT k, doc_id, len(w) AS n, unnest(w) AS term FROM d)
            WHERE term IN (SELECT term FROM q) GROUP BY ALL),
        w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term, n_docs),
        i AS MATERIALIZED (SELECT k, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))) AS gain FROM p JOIN w USING (term), s),
        r AS (SELECT item_id, k, doc_id, sum(times * gain)::BIGINT AS score FROM i JOIN q USING (term) GROUP BY ALL HAVING sum(times * gain) > 0)
        SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""",
    "op13_spelling_variants": """
        WITH RECURSIVE t AS MATERIALIZED (
            SELECT i AS byte, i::BIGINT AS v, 0 AS step FROM range(256) x(i)), -- the table of the checksum, one entry a byte
        tab AS MATERIALIZED (SELECT list(list_reduce(list_concat([v], range(8)), lambda a, j: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY byte) AS tab FROM t),
        runs AS MATERIALIZED (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
        hexed AS (SELECT doc_id, run, n, hex(encode(doc_id || ':' || run)) AS h FROM runs),
        crc AS (
            SELECT doc_id, run, n, xor(list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, (2 * i + 1)::BIGINT, 2))::BIGINT)),
                lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) AS h FROM hexed, tab),
        marked AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM crc),
        w AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM marked WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
        cut AS MATERIALIZED (SELECT DISTINCT word, substr(word, 1, i) || '?' || substr(word, i + 2) AS masked, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, unnest(range(length(word))) AS i FROM w)),
        e AS (
            SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.masked = b.masked AND a.word <> b.word
            UNION SELECT word, less FROM cut WHERE less IN (SELECT word FROM w) UNION SELECT less, word FROM cut WHERE less IN (SELECT word FROM w)),
        near AS MATERIALIZED (SELECT a AS word, b, n FROM e JOIN w ON w.word = b),
        best AS MATERIALIZED (SELECT w.word, w.n, count(b) AS n_near, (list(struct_pack(b := b, n := near.n) ORDER BY near.n DESC, b) FILTER (b IS NOT NULL))[1] AS f FROM w LEFT JOIN near USING (word) GROUP BY 1, 2),
        g AS MATERIALIZED (SELECT word, n, n_near, CASE WHEN f.n >= 2 * n THEN f.b END AS form, CASE WHEN f.n >= 2 * n THEN f.n END AS form_n FROM best),
        walk(word, here) AS (SELECT word, word FROM g UNION ALL SELECT walk.word, g.form FROM walk JOIN g ON g.word = walk.here WHERE g.form IS NOT NULL),
        root AS (SELECT walk.word, here AS root FROM walk JOIN g ON g.word = here WHERE g.form IS NULL)
        SELECT word, form, root, n, n_near, form_n FROM g JOIN root USING (word)""",
    "op11_license_scan": _license_sql(),
    "op1_warc_revisits": rf"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS html, page_id * 7 AS t, md5(coalesce(html, '')) AS d, md5(coalesce(html, '') || '+') AS e,
                page_crc % 4 AS k, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
            FROM (SELECT *, (WITH RECURSIVE b(i, c) AS (
                    SELECT 0, 4294967295::UBIGINT UNION ALL
                    SELECT i + 1, list_reduce(range(8), lambda a, j: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(c, ascii(substr(page_id::VARCHAR, i + 1, 1))::UBIGINT)::UBIGINT)
                    FROM b WHERE i < length(page_id::VARCHAR))
                SELECT xor(c, 4294967295::UBIGINT) FROM b ORDER BY i DESC LIMIT 1) AS page_crc FROM pages)),
        u AS (
            SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www[0-9]*\.', ''), ':(80|443)$', '')
                || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest, '^[^/?]*', ''), '([?&])((utm_[a-z]+|gclid|fbclid)=[^&]*&?)+', '\1', 'g'), '[?&]+$', ''), '/+$', '') AS url_key
            FROM p),
        r AS (
            SELECT url_key, page_id || '-1' AS record_id, t AS ts, true AS full_, {_TAG.format("d")} AS etag, t AS lm, d AS digest, 1 AS n, html FROM u
            UNION ALL SELECT url_key, page_id || '-2', t + 86400, k = 0, CASE k WHEN 0 THEN {_TAG.format("e")} WHEN 1 THEN {_TAG.format("d")} WHEN 2 THEN 'W/' || {_TAG.format("d")} ELSE '"other"' END, CASE WHEN k = 0 THEN t + 86400 ELSE t END, e, 2, html FROM u
            UNION ALL SELECT url_key, page_id || '-3', t + 172800, false, CASE WHEN page_id % 5 <> 0 THEN {_TAG.format("d")} END, t, d, 3, html FROM u
            UNION ALL SELECT url_key, page_id || '-0', t - 86400, false, {_TAG.format("d")}, t, d, 0, html FROM u WHERE page_id % 10 = 0),
        j AS (
            SELECT a.*, b.record_id AS refers_to, b.ts AS refers_ts, b.etag AS b_etag, b.lm AS b_lm, b.digest AS b_digest, b.n AS b_n, b.html AS b_html,
                row_number() OVER (PARTITION BY a.record_id ORDER BY b.ts DESC NULLS LAST, b.record_id DESC) AS pick
            FROM r a LEFT JOIN r b ON b.full_ AND a.url_key = b.url_key AND (b.ts < a.ts OR b.ts = a.ts AND b.record_id < a.record_id)
            WHERE NOT a.full_),
        o AS (
            SELECT *, CASE WHEN refers_to IS NULL THEN 'no_earlier_response'
                WHEN CASE WHEN etag IS NOT NULL THEN replace(etag, 'W/', '') = b_etag ELSE lm = b_lm END THEN 'resolved' ELSE 'validator_mismatch' END AS outcome
            FROM j WHERE pick = 1)
        SELECT record_id, url_key, ts, outcome, refers_to, refers_ts, CASE WHEN outcome = 'resolved' THEN b_digest END AS digest,
            CASE WHEN outcome = 'resolved' THEN {_LINES.format(date="ts", etag="coalesce(etag, b_etag)", age="(60 * (n + 1))", size="octet_length(encode(b_html))", node="b_n")} END AS headers
        FROM o""",
    "op7_minhash_near_dedup": f"""
        WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_SPLIT.format(_LOWER)} AS w FROM documents),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        e AS MATERIALIZED (
            SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
        r(v, t) AS (SELECT a, a FROM both_ways UNION SELECT b, t FROM r JOIN both_ways ON v = a),
        m AS (SELECT v, min(t) AS t FROM r GROUP BY 1)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.t, d.doc_id) AS component_id, coalesce(m.t, d.doc_id) = d.doc_id AS kept
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.v = d.doc_id""",
    "op8_substring_dedup": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS w FROM documents),
        s AS MATERIALIZED (
            SELECT doc_id, i, md5(array_to_string(w[i : i + 34], ' ')) AS h
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
        r AS (SELECT doc_id, list(i) AS firsts FROM s WHERE h IN (SELECT h FROM s GROUP BY h HAVING count(*) > 1) GROUP BY doc_id),
        x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
        c AS (SELECT DISTINCT doc_id, unnest(range(a, a + 35)) AS i FROM (SELECT doc_id, unnest(firsts) AS a FROM r)),
        k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS kept, count(*) AS n FROM x LEFT JOIN c USING (doc_id, i) WHERE c.i IS NULL GROUP BY 1)
        SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON k.doc_id = d.doc_id""",
}
