"""The registered queries opN_<name> and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.quality import score_documents

    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.html import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.media import documents_as_media

    return documents_as_media(table(spark, sf_dir, "documents"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.decontam import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "coverage", "n_slots")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, similarity=0.85)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.urlfilter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.linedup import line_report

    return line_report(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.warc import archive_pages

    _, records = archive_pages(table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.tokenids import token_ids

    return token_ids(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.resample import resample

    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.licenses import scan_licenses

    return scan_licenses(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from svloom.llm.lexical import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_html_extraction": op2_html_extraction,
    "op3_media_columns": op3_media_columns,
    "op4_mix_sources": op4_mix_sources,
    "op5_decontamination": op5_decontamination,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc": op9_warc,
    "op10_token_ids": op10_token_ids,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_license_scan": op12_license_scan,
    "op13_ranked_search": op13_ranked_search,
}

_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(h, 5 * k + 1, 5) AS BIGINT) >> {}) & 31 AS INT), 1)"

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _license_sql() -> str:
    """All rules over all texts, without keywords first; a detection goes if any other one that contains it is stronger."""
    from svloom.llm import licenses as L

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    rules = ", ".join(f"({k}, {quoted(r.label)}, {r.priority}, {L.CONFIDENCE[r.priority]}::DOUBLE, {quoted(L.spaced(r.pattern))})" for k, r in enumerate(L.RULES))
    base = ", ".join(f"({quoted(phrase)}, {quoted(label)}, {quoted(L.plain(phrase))})" for phrase, label in L.BASE)
    gap = "(length({0}) - length(replace({0}, ' ', '')))"
    return f"""WITH t AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents), n AS (SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n_words, '  ' || array_to_string(w, '  ') || '  ' AS norm FROM t),
      b(phrase, label, plain) AS (VALUES {base}), r(rule, label, priority, sure, pattern) AS (VALUES {rules}),
      bp AS (SELECT row, label, string_split(norm, plain) AS p, n_words, len(string_split(phrase, ' ')) AS size FROM n, b WHERE contains(norm, plain)),
      bd AS (SELECT row, CAST(sum(len(p) - 1) AS BIGINT) AS n_base, CAST(min({gap.format('p[1]')} // 2) AS BIGINT) AS first_word, CAST(max(n_words - {gap.format('p[len(p)]')} // 2 - size) AS BIGINT) AS last_word, list(DISTINCT label) AS base FROM bp GROUP BY row),
      m AS (SELECT row, rule, label, priority, sure, string_split_regex(norm, pattern) AS p, regexp_extract_all(norm, pattern) AS f FROM n, r WHERE regexp_matches(norm, pattern)),
      e AS (SELECT row, rule, label, priority, sure, {gap.format('p[k]')} AS gap, {gap.format('f[k]')} AS own, k FROM m, LATERAL (SELECT unnest(range(1, len(f) + 1)) AS k)),
      d AS (SELECT *, (upto - own) // 2 AS s, upto // 2 AS e FROM (SELECT *, sum(gap + own) OVER (PARTITION BY row, rule ORDER BY k) AS upto FROM e)),
      kept AS (SELECT * FROM d a WHERE NOT EXISTS (SELECT 1 FROM d b WHERE b.row = a.row AND b.s <= a.s AND b.e >= a.e AND (b.priority > a.priority OR (b.priority = a.priority AND (b.e - b.s > a.e - a.s OR (b.e - b.s = a.e - a.s AND b.rule < a.rule)))))),
      l AS (SELECT row, label, max(sure) AS sure, count(*) AS n FROM kept GROUP BY ALL), g AS (SELECT row, list(label) AS own, round(1 - product(1 - sure), 6) AS score, CAST(sum(n) AS BIGINT) AS n_detections FROM l GROUP BY row)
      SELECT doc_id, n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(own, [])))), ',') AS labels, coalesce(score, 0.0) AS score, coalesce(n_detections, 0) AS n_detections FROM n LEFT JOIN bd USING (row) LEFT JOIN g USING (row)"""


ORACLE_SQL: dict[str, str] = {
    # crc32 by a table of bytes; sums over features instead of planes
    "op11_importance_resampling": f"""WITH c AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) for i in range(0, 256)] AS crc),
      d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents), dw AS (SELECT row, unnest(w) AS w FROM d), bw AS (SELECT unnest({_WORDS}) AS w FROM benchmark),
      v AS (SELECT w, [CAST('0x' || substr(hex(encode(w)), 2 * k + 1, 2) AS BIGINT) for k in range(0, strlen(w))] AS bytes FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
      h AS (SELECT w, xor(list_reduce(list_prepend(4294967295, bytes), lambda a, b: xor(crc[(xor(a, b) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket FROM v, c),
      s AS (SELECT bucket, count(*) AS s FROM dw JOIN h USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN h USING (w) GROUP BY 1),
      g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000.0::DOUBLE) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + 10000.0::DOUBLE)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (bucket)),
      x AS (SELECT row, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight FROM dw JOIN h USING (w) JOIN g USING (bucket) GROUP BY row),
      y AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS u FROM d LEFT JOIN x USING (row)),
      z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM y),
      k AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n FROM z)
      SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM k""",
    "op12_license_scan": _license_sql(),
    "op13_ranked_search": f"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents), n AS (SELECT count(*) AS n, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
      q AS (SELECT item, item_id, unnest(list_distinct({_WORDS})) AS w FROM (SELECT row_number() OVER () AS item, * FROM benchmark)),
      p AS (SELECT row, w, count(*) AS tf FROM (SELECT row, unnest(w) AS w FROM d) WHERE w IN (SELECT w FROM q) GROUP BY ALL),
      f AS (SELECT w, CAST(floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS weight FROM p, n GROUP BY w, n),
      i AS (SELECT row, w, (1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(words) * n) // l)) AS impact FROM p JOIN (SELECT row, w AS words FROM d) USING (row), n),
      s AS (SELECT item, item_id, row, CAST(sum(weight * impact) AS BIGINT) AS score FROM q JOIN f USING (w) JOIN (SELECT row, w, impact FROM i) USING (w) GROUP BY ALL),
      r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INT) AS rank FROM s JOIN d USING (row) WHERE score > 0)
      SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""",
    # caps in the order of size by weight, then three passes over the documents of a source by their hash
    "op4_mix_sources": r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS place FROM documents),
      s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
      o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source) AS k FROM s),
      f AS (SELECT j, (SELECT sum(source_size) FROM o) - coalesce((SELECT sum(3 * source_size) FROM o WHERE k <= j), 0) AS free, (SELECT sum(w) FROM o WHERE k > j) AS ws FROM (SELECT unnest(range(0, (SELECT count(*) FROM o)::BIGINT)) AS j)),
      b AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.k = f.j + 1 AND CAST(f.free AS DOUBLE) * o.w / CAST(f.ws AS DOUBLE) > 3 * o.source_size) ORDER BY j LIMIT 1),
      t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 WHEN k <= j THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(free AS DOUBLE) * w / CAST(ws AS DOUBLE) END AS target FROM o, b),
      e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
      p0 AS (SELECT d.*, source_size, target, epochs, target - epochs * source_size AS budget, sum(size) OVER (PARTITION BY d.source ORDER BY place) AS c0 FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
      q0 AS (SELECT *, c0 <= budget AS t0, budget - coalesce(max(c0) FILTER (WHERE c0 <= budget) OVER (PARTITION BY source), 0) AS left0 FROM p0),
      p1 AS (SELECT *, NOT t0 AND size <= left0 AS in1, sum(CASE WHEN NOT t0 AND size <= left0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place) AS c1 FROM q0),
      q1 AS (SELECT *, in1 AND c1 <= left0 AS t1, left0 - coalesce(max(c1) FILTER (WHERE in1 AND c1 <= left0) OVER (PARTITION BY source), 0) AS left1 FROM p1),
      p2 AS (SELECT *, NOT t0 AND NOT t1 AND size <= 2 * left1 AS in2, sum(CASE WHEN NOT t0 AND NOT t1 AND size <= 2 * left1 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY place) AS c2 FROM q1),
      q2 AS (SELECT *, coalesce(max(c2) FILTER (WHERE in2 AND c2 <= left1) OVER (PARTITION BY source), 0) AS below, min(c2) FILTER (WHERE in2 AND c2 > left1) OVER (PARTITION BY source) AS edge FROM p2),
      r AS (SELECT *, least(epochs + CASE WHEN t0 OR t1 OR (in2 AND (c2 <= left1 OR (c2 = edge AND edge - left1 < left1 - below))) THEN 1 ELSE 0 END, 3) AS copies FROM q2)
      SELECT doc_id, size, source_size, target, CAST(copies AS BIGINT) AS copies, CAST(size * copies AS BIGINT) AS taken FROM r""",
    # all pairs that share a shingle, and the smallest doc_id that links lead to
    "op6_minhash_near_dedup": r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
      s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct([w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] for k in range(1, len(w) - 1)]) END AS s FROM w),
      n AS (SELECT doc_id, len(s) AS n FROM s), u AS (SELECT doc_id, unnest(s) AS s FROM s),
      pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
      links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
      reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
      SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, min(r.b) AS component_id, n.doc_id = min(r.b) AS kept FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n""",
    "op9_warc": f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), m AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
      SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, array_to_string([{' || '.join(_BASE32.format(n) for n in (15, 10, 5, 0))} for k in range(0, 8)], '') AS payload_digest,
        CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to, url FROM p JOIN m USING (h)""",
}
