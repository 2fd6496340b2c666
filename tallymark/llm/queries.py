"""The queries of the training-data operators: name -> function of (spark, sf_dir), each over its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallymark.llm import filter_audit, fingerprints, jaccard_join, lm, mixing, neighbours, packing, quality, secrets, sstable, substring_dedup, toxicity, whitening
from tallymark.llm.common import documents


def op1_maxent_lm(spark, sf_dir):
    return lm.digest(documents(spark, sf_dir))


def op2_best_fit_packing(spark, sf_dir):
    return packing.digest(documents(spark, sf_dir))


def op3_source_mix(spark, sf_dir):
    return mixing.digest(documents(spark, sf_dir))


def op4_quality_classifier(spark, sf_dir):
    return quality.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_secret_scan(spark, sf_dir):
    return secrets.digest(documents(spark, sf_dir))


def op6_weighted_fingerprint(spark, sf_dir):
    return fingerprints.digest(documents(spark, sf_dir))


def op7_ngram_jaccard_join(spark, sf_dir):
    return jaccard_join.digest(documents(spark, sf_dir))


def op8_toxicity_chain(spark, sf_dir):
    return toxicity.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_nearest_neighbours(spark, sf_dir):
    return neighbours.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_sorted_shards(spark, sf_dir):
    return sstable.digest(documents(spark, sf_dir))


def op11_chan_whitening(spark, sf_dir):
    return whitening.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_fm_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(documents(spark, sf_dir))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {
    "op1_maxent_lm": op1_maxent_lm,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_source_mix": op3_source_mix,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_secret_scan": op5_secret_scan,
    "op6_weighted_fingerprint": op6_weighted_fingerprint,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_toxicity_chain": op8_toxicity_chain,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_sorted_shards": op10_sorted_shards,
    "op11_chan_whitening": op11_chan_whitening,
    "op12_fm_substring_dedup": op12_fm_substring_dedup,
    "op13_filter_audit": op13_filter_audit,
}



def llm_source_targets(spark, sf_dir):
    """The part of the source mix that SQL can say: sizes and targets."""
    return mixing.digest(documents(spark, sf_dir)).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"))


def llm_edited_texts(spark, sf_dir):
    """The part of the fingerprints that SQL can say: lengths and edited texts."""
    return fingerprints.digest(documents(spark, sf_dir)).select("doc_id", "n_chars", "edited_sha256")


def llm_neighbours_whole_walk(spark, sf_dir):
    """A walk over all cells finds the exact neighbours."""
    found = neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, share=1.0)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", F.round("score", 9).alias("score"))


def llm_whitening_deviation(spark, sf_dir):
    """The part of the whitening that SQL can say: the fit list's size and the exact deviations."""
    return whitening.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).select("vec_id", "component", "n", "deviation")


QUERIES |= {"llm_source_targets": llm_source_targets, "llm_edited_texts": llm_edited_texts, "llm_neighbours_whole_walk": llm_neighbours_whole_walk, "llm_whitening_deviation": llm_whitening_deviation}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _spans_sql(n: int, rule: secrets.Rule) -> str:
    """(doc_id, rule, kind, base, start, stop): matches of one rule. A match is marked by characters that no text holds, so its
    place is the length of all before it."""
    pattern, flag = rule.pattern.replace("'", "''"), "gi" if rule.ignore_case else "g"
    if rule.kind == "hex":
        pattern = "[0-9a-f]+"
    kept = f"regexp_extract(hit, '{pattern}', {rule.group}, '{flag[1:]}')" if rule.group else "hit"
    return f"""SELECT doc_id, {n} AS rule, '{rule.kind}' AS kind, {str(rule.base).upper()} AS base, place AS start, place + length(hit) AS stop FROM (
      SELECT doc_id, string_split(parts[i], chr(57345))[1] AS hit, length(replace(array_to_string(parts[1:i - 1], ''), chr(57345), '')) AS place
      FROM (SELECT doc_id, parts, unnest(range(2, len(parts) + 1)) AS i FROM (
        SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '{pattern}', chr(57344) || '\\0' || chr(57345), '{flag}'), chr(57344)) AS parts FROM documents))) WHERE length({kept}) >= {rule.least}"""


#: DuckDB SQL where SQL can say it. The others are tested against brute force (op1, op2, op3, op6, op9, op10) or on held-out
#: rows (op4, op8).
ORACLE_SQL: dict[str, str] = {
    "op5_secret_scan": "WITH hits AS ("
    + " UNION ALL ".join(_spans_sql(n, r) for n, r in enumerate(secrets.RULES))
    + """), named AS (SELECT *, kind || ':' || start || ':' || stop AS span FROM hits)
    SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      sha256(coalesce(string_agg(span, ',' ORDER BY start, rule) FILTER (base), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY start, rule), '') AS spans
    FROM documents d LEFT JOIN named n ON d.doc_id = n.doc_id GROUP BY d.doc_id""",
    "op7_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    v AS (SELECT doc_id, {_WORDS} AS ws FROM w),
    s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh FROM v),
    e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
    alike AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    reach AS (SELECT x, y FROM alike UNION SELECT r.x, a.y FROM reach r JOIN alike a ON r.y = a.x)
    SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce((SELECT min(y) FROM reach WHERE x = s.doc_id), s.doc_id)) AS component_id, (SELECT count(*) FROM alike WHERE x = s.doc_id) AS n_links FROM s""",
    "llm_source_targets": f"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
    t AS (SELECT source, sum(size) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
    r AS (SELECT *, 3 * source_size / w AS ratio, sum(source_size) OVER () AS total, sum(w) OVER () AS weights FROM t),
    c AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER before, 0)) / (weights - coalesce(sum(w) OVER before, 0)) AS level FROM r WINDOW before AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    l AS (SELECT min(level) FILTER (ratio >= level) AS level FROM c WHERE ratio = (SELECT min(ratio) FROM c WHERE ratio >= level))
    SELECT d.doc_id, d.size, CAST(c.source_size AS BIGINT) AS source_size, round(CAST(least(3 * c.source_size, l.level * c.w) AS DOUBLE), 6) AS target FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source, l""",
    "llm_edited_texts": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lead(text) OVER w, first_value(coalesce(text, '')) OVER w, '') AS next FROM documents WINDOW w AS (ORDER BY doc_id))
    SELECT doc_id, length(text) AS n_chars, sha256(substring(text, 1, length(text) - length(text) // 2) || substring(next, 1, length(text) // 2)) AS edited_sha256 FROM d""",
    "llm_neighbours_whole_walk": """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
    SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 9) AS score FROM p) WHERE rank <= 20""",
    "llm_whitening_deviation": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS HUGEINT)) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    f AS (SELECT DISTINCT x FROM v), e AS (SELECT unnest(x) AS c, unnest(range(len(x))) AS i FROM f), s AS (SELECT list(t ORDER BY i) AS t FROM (SELECT i, sum(c) AS t FROM e GROUP BY i)), m AS (SELECT count(*) AS n FROM f)
    SELECT vec_id, component, n, CAST(list_sum(list_transform(range(1, len(x) + 1), lambda i: (n * x[i] - t[i]) * (n * x[i] - t[i]))) AS BIGINT) AS deviation FROM v, s, m, (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS component)""",
    "op12_fm_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    w AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM d)),
    f AS (SELECT g, min(doc_id) AS least FROM w GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM w JOIN f USING (g) WHERE least < doc_id)),
    t AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM d),
    k AS (SELECT doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY p) AS text FROM t ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, len(ws) - coalesce(kept, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)""",
    "op13_filter_audit": f"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
    l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
      || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END
      || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS fails FROM d LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
    x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
    o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substring(filter_order, CAST(step AS INTEGER), 1) AS f, '[' || substring(filter_order, 1, CAST(step AS INTEGER)) || ']' AS upto, '[' || substring(filter_order, 1, CAST(step AS INTEGER) - 1) || '-]' AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
    r AS (SELECT part, filter_order, step, f, sum(n) FILTER (NOT regexp_matches(fails, upto)) AS kept, sum(n) FILTER (contains(fails, f) AND NOT regexp_matches(fails, before)) AS removed,
      sum(n) FILTER (contains(fails, f) AND regexp_matches(fails, before)) AS redundant, sum(n) FILTER (fails = f) AS unique_fails, sum(good) FILTER (contains(fails, f) AND NOT regexp_matches(fails, before)) AS good_lost,
      sum(toxic) FILTER (contains(fails, f) AND NOT regexp_matches(fails, before)) AS toxic_lost FROM c, s GROUP BY part, filter_order, step, f)
    SELECT part, filter_order, step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails,
      CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost, CAST(coalesce(sum(removed) OVER (PARTITION BY part, f), 0) AS BIGINT) AS shapley FROM r""",
}
