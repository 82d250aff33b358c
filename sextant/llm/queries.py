"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from sextant.llm import decontaminate, exact_dedup, html_text, line_dedup, media, near_dedup, packing, phrases, pii, ranked_search, substrings, toxicity, urls
from sextant.llm.common import table


def op1_personal_data(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents", "doc_id", "text")))


def op2_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.trained(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_line_dedup(spark, sf_dir):
    return line_dedup.digest(line_dedup.deduplicate(table(spark, sf_dir, "documents", "doc_id", "text")))


def op4_near_dedup(spark, sf_dir):
    found = near_dedup.classes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def op5_audio_features(spark, sf_dir):
    return media.digest(media.audio_columns(table(spark, sf_dir, "documents", "doc_id", "text")))


def op6_url_filters(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op7_decontamination(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")
    return decontaminate.digest(decontaminate.match_items(docs, items))


def op8_harmonic_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_suffix_arrays(spark, sf_dir):
    return substrings.digest(substrings.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text")))


def op10_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_exact_dedup(spark, sf_dir):
    return exact_dedup.digest_columns(exact_dedup.find(table(spark, sf_dir, "documents", "doc_id", "text")))


def op12_ranked_search(spark, sf_dir):
    return ranked_search.search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


def op13_phrase_mining(spark, sf_dir):
    return phrases.mine(table(spark, sf_dir, "documents", "lang", "text"))


QUERIES = {f.__name__: f for f in (op1_personal_data, op2_toxicity, op3_line_dedup, op4_near_dedup, op5_audio_features, op6_url_filters, op7_decontamination, op8_harmonic_packing, op9_suffix_arrays, op10_html_extraction, op11_exact_dedup, op12_ranked_search, op13_phrase_mining)}


# Of some queries SQL can say a part: those columns, taken from the same operators.


def llm_personal_data_counts(spark, sf_dir):
    return op1_personal_data(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def llm_media_payload(spark, sf_dir):
    return op5_audio_features(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes")


def llm_url_rules(spark, sf_dir):
    return op6_url_filters(spark, sf_dir).select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


def llm_decontamination_hits(spark, sf_dir):
    return op7_decontamination(spark, sf_dir)


def llm_repeated_bytes(spark, sf_dir):
    return op9_suffix_arrays(spark, sf_dir).select("doc_id", "n_bytes", "n_removed", "n_spans")


PARTS = (llm_personal_data_counts, llm_media_payload, llm_url_rules, llm_decontamination_hits, llm_repeated_bytes)
QUERIES |= {f.__name__: f for f in PARTS}

LOWERED = f"translate(coalesce({{}}, ''), '{urls.UPPER}', '{urls.LOWER}')"
WORDS = rf"regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
LUHN = f"list_sum([CASE WHEN k % 2 = 1 THEN d WHEN d > 4 THEN 2 * d - 9 ELSE 2 * d END for d, k in [CAST(c AS INTEGER) for c in string_split(reverse({DIGITS}), '')]]) % 10 = 0"

ORACLE_SQL: dict[str, str] = {
    "llm_personal_data_counts": rf"""
        SELECT doc_id,
               CAST(len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS BIGINT) AS n_email,
               CAST(len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda m: list_max([CAST(p AS HUGEINT) for p in string_split(m, '.')]) <= 255)) AS BIGINT) AS n_ip,
               CAST(len(list_filter(regexp_extract_all(t, '[0-9](?:[ -]?[0-9])+'), lambda m: length({DIGITS}) BETWEEN 16 AND 19 AND {LUHN})) AS BIGINT) AS n_card,
               CAST(len(list_filter(regexp_extract_all(t, '\+[0-9][ ().0-9-]+[0-9]'), lambda m: length({DIGITS}) BETWEEN 8 AND 15)) AS BIGINT) AS n_phone
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""",
    "llm_media_payload": """
        SELECT doc_id, n AS n_bytes, p AS payload_bytes, sha256(encode(t) || from_hex(repeat('FF', CAST(p - n AS BIGINT)))) AS payload_sha256, p + 44 AS media_bytes
        FROM (SELECT doc_id, t, n, greatest(1, (n + 575) // 576) * 576 AS p
              FROM (SELECT doc_id, coalesce(text, '') AS t, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents))""",
    "llm_url_rules": f"""
        WITH split AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
             parts AS (SELECT page_id, {LOWERED.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM split),
             rules(verdict, rule, rule_host, rule_path) AS (VALUES {", ".join(f"('{v}', '{h}{p}', '{h}', '{p}')" for v, h, p in urls.RULES)}),
             fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
                     FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
        SELECT page_id, host, path, rule, verdict FROM parts LEFT JOIN fit USING (page_id)""",
    "llm_decontamination_hits": f"""
        WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
             i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format("text")} AS w FROM benchmark),
             item_windows AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s : s + least(10, len(w)) - 1], ' ') AS win
                              FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS s FROM i WHERE len(w) > 0)),
             sizes AS (SELECT DISTINCT n FROM item_windows),
             doc_windows AS (SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS win
                             FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
             found AS (SELECT doc_id, s, dw.n, item FROM doc_windows dw JOIN item_windows iw ON dw.win = iw.win AND dw.n = iw.n),
             hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM (SELECT DISTINCT doc_id, s, n FROM found)) GROUP BY doc_id),
             who AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN who USING (doc_id)""",
    "llm_repeated_bytes": f"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
             starts AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, {2 * substrings.LENGTH})) AS win FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {substrings.LENGTH - 1})) AS s FROM d)),
             later AS (SELECT doc_id, s FROM starts QUALIFY row_number() OVER (PARTITION BY win ORDER BY doc_id, s) > 1),
             steps AS (SELECT doc_id, s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS step FROM later),
             found AS (SELECT doc_id, sum(coalesce(least(step, {substrings.LENGTH}), {substrings.LENGTH})) AS n_removed, count(*) FILTER (WHERE step IS NULL OR step > {substrings.LENGTH}) AS n_spans FROM steps GROUP BY doc_id)
        SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans FROM d LEFT JOIN found USING (doc_id)""",
    "op11_exact_dedup": f"""
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, {LOWERED.format("text")} AS t FROM documents) WINDOW same AS (PARTITION BY t)""",
    "op12_ranked_search": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED.format("text")}, '{TERM}') AS w FROM documents),
             texts AS (SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM d WHERE len(w) > 0),
             total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM texts),
             tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM texts) GROUP BY ALL),
             weights AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, total GROUP BY term, docs),
             parts AS (SELECT doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS part FROM tf JOIN weights USING (term), total),
             asked AS (SELECT item_id, unnest(regexp_extract_all({LOWERED.format("text")}, '{TERM}')) AS term FROM benchmark),
             scored AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (term) GROUP BY item_id, doc_id)
        SELECT item_id, CAST(row_number() OVER best AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
        WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER best <= 20""",
    "op13_phrase_mining": rf"""
        WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
                        FROM (SELECT lang, unnest(string_split_regex({LOWERED.format("text")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
             words AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
             frequent AS (SELECT lang, m, phrase, count(*) AS f
                          FROM (SELECT lang, m, array_to_string(w[s : s + m - 1], ' ') AS phrase
                                FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS s FROM pieces, range(1, {phrases.MAX_WORDS + 1}) AS sizes(m) WHERE len(w) >= m))
                          GROUP BY ALL HAVING count(*) >= {phrases.SUPPORT}),
             cuts AS (SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, n, CAST((CAST(1000 AS HUGEINT) * c.f * n) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
                      FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM frequent WHERE m > 1) c JOIN words USING (lang)
                      JOIN frequent x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : k], ' ')
                      JOIN frequent y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[k + 1 : c.m], ' ')),
             best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
             inside AS (SELECT lang, array_to_string(w[s : s + z - 1], ' ') AS phrase, max(f) AS within
                        FROM (SELECT *, unnest(range(1, m - z + 2)) AS s FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(2, m)) AS z FROM frequent WHERE m > 2)) GROUP BY ALL)
        SELECT lang, row_number() OVER top AS rank, phrase, a, l, r, n, score FROM best LEFT JOIN inside USING (lang, phrase) WHERE within IS NULL OR 100 * within < 100 * a
        WINDOW top AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY row_number() OVER top <= {phrases.TOP}""",
}

ORACLE_SQL["op7_decontamination"] = ORACLE_SQL["llm_decontamination_hits"]
