"""The registered queries of this subpackage, one per operator, and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import embed_dedup, exact_dedup, langid, licenses, mixing, packing, pii, ranking, simhash, token_files, topk, toxicity, whitening
from cairn.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op1_embedding_dedup"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a, v AS b
    WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach(vec_id, other) AS (
    SELECT vec_id, vec_id FROM embeddings
    UNION
    SELECT reach.vec_id, links.b FROM reach JOIN links ON links.a = reach.other
), component AS (
    SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), degree AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT component.vec_id, CAST(coalesce(degree.n, 0) AS BIGINT) AS n_links, component.component_id, component.vec_id = component.component_id AS kept
FROM component LEFT JOIN degree ON degree.a = component.vec_id
"""


@query
def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digest(table(spark, sf_dir, "documents"))


@query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


#: The four kinds as they are asked for, with the checks on a match v and its digits n.
_PII_SQL = {
    "email": ("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
    "ip": ("[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)", "len(list_filter(string_split(v, '.'), lambda x: TRY_CAST(x AS HUGEINT) IS NULL OR CAST(x AS HUGEINT) > 255)) = 0"),
    "card": ("[0-9](?:[ -]?[0-9])+", "length(n) BETWEEN 14 AND 19 AND list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN (length(n) - i) % 2 = 0 THEN CAST(n[i] AS INTEGER) WHEN n[i] > '4' THEN 2 * CAST(n[i] AS INTEGER) - 9 ELSE 2 * CAST(n[i] AS INTEGER) END)) % 10 = 0"),
    "phone": ("\\+[0-9][ ().0-9-]+[0-9]", "length(n) BETWEEN 10 AND 15"),
}


def _matches_sql(text: str, pattern: str) -> str:
    """start (from 0) and v of every match of the pattern in the text, unnested."""
    return f"""unnest(list_transform(range(1, len(regexp_extract_all({text}, '{pattern}')) + 1), lambda i: {{
        'start': list_sum(list_transform(regexp_split_to_array({text}, '{pattern}')[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all({text}, '{pattern}')[1:i - 1], lambda x: length(x))), 0),
        'v': regexp_extract_all({text}, '{pattern}')[i]}}))"""


_BASE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, {rank} AS rank, '{kind}' AS kind, CAST(start AS BIGINT) AS start, CAST(start AS BIGINT) + length(v) AS stop, v FROM (SELECT doc_id, m.start, m.v, regexp_replace(m.v, '[^0-9]', '', 'g') AS n FROM (SELECT doc_id, {_matches_sql('t', pattern)} AS m FROM d)) WHERE {keep}"
    for rank, (kind, (pattern, keep)) in enumerate(_PII_SQL.items())
)
_ENTITY = "kind || ':' || lower(v)"
_CLASS = "kind || '@' || CASE kind WHEN 'email' THEN split_part(lower(v), '@', 2) WHEN 'ip' THEN regexp_replace(v, '[.][0-9]+$', '') WHEN 'card' THEN substring(regexp_replace(v, '[^0-9]', '', 'g'), 1, 6) ELSE substring(regexp_replace(v, '[^0-9]', '', 'g'), 1, 4) END"
ORACLE_SQL["op4_pii"] = f"""
WITH d AS (SELECT doc_id, md5(coalesce(text, '')) AS hash, coalesce(text, '') AS t FROM documents),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM d),
base AS ({_BASE_SQL}),
words AS (SELECT DISTINCT doc_id, hash, lower(w) AS term FROM (SELECT doc_id, hash, unnest(regexp_split_to_array(regexp_replace(t, '{_PII_SQL["email"][0]}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM d) WHERE regexp_matches(w, '\\p{{L}}')),
held AS (SELECT DISTINCT d.doc_id, d.hash, kind, entity FROM d JOIN (SELECT doc_id, kind, {_ENTITY} AS entity FROM base UNION ALL SELECT doc_id, kind, {_CLASS} FROM base) AS e ON e.doc_id = d.doc_id),
kinds AS (SELECT kind, count(DISTINCT doc_id) AS n_k FROM held GROUP BY kind),
entities AS (SELECT entity, held.kind, any_value(n_k) AS n_k, count(DISTINCT doc_id) AS n_e, count(DISTINCT hash) AS d_e FROM held JOIN kinds ON kinds.kind = held.kind GROUP BY entity, held.kind HAVING count(DISTINCT hash) >= 2 AND count(DISTINCT doc_id) < any_value(n_k)),
counts AS (SELECT term, count(*) AS n_t FROM words GROUP BY term),
joint AS (
    SELECT term, held.entity, held.kind, any_value(n_k) AS n_k, any_value(n_e) AS n_e, any_value(d_e) AS d_e, count(*) AS n_te, count(DISTINCT words.hash) AS d_te
    FROM words JOIN held ON held.doc_id = words.doc_id JOIN entities ON entities.entity = held.entity GROUP BY term, held.entity, held.kind HAVING count(DISTINCT words.hash) >= 2
), of_kind AS (
    SELECT term, kind, count(*) AS n_tk FROM words JOIN (SELECT DISTINCT doc_id, kind FROM held) AS h ON h.doc_id = words.doc_id GROUP BY term, kind
), rated AS (
    SELECT joint.*, n_t, n, d_te / d_e AS q, n_t / n AS p, n_te / n_t AS certain, log2(n_te * n_k / (n_tk * n_e)) / log2(n_k / n_e) AS among
    FROM joint JOIN counts ON counts.term = joint.term JOIN of_kind ON of_kind.term = joint.term AND of_kind.kind = joint.kind, total
), told AS (
    SELECT term, max(certain) AS certain FROM rated
    WHERE certain >= {pii.GENERALISE} AND among >= {pii.OF_KIND} AND q > p
      AND d_e * (q * log2(q / p) + CASE WHEN q < 1 THEN (1 - q) * log2((1 - q) / (1 - p)) ELSE 0 END) >= log2(n) + {pii.EVIDENCE} GROUP BY term
), places AS (
    SELECT doc_id, m.start AS start, m.start + length(m.v) AS stop, lower(m.v) AS term
    FROM (SELECT doc_id, {_matches_sql("t", "[\\p{L}\\p{N}]+")} AS m FROM d WHERE doc_id IN (SELECT doc_id FROM words WHERE term IN (SELECT term FROM told)))
), found AS (
    SELECT places.doc_id, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, CASE WHEN certain >= {pii.REMOVE} THEN 'term_removed' ELSE 'term' END AS kind FROM places JOIN told ON told.term = places.term
    WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.doc_id = places.doc_id AND base.start < places.stop AND places.start < base.stop)
), every AS (SELECT doc_id, rank, kind, start, stop FROM base UNION ALL SELECT doc_id, CASE kind WHEN 'term' THEN 4 ELSE 5 END, kind, start, stop FROM found),
joined AS (SELECT doc_id, string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans, string_agg(CASE WHEN rank < 4 THEN kind || ':' || start || ':' || stop END, ',' ORDER BY start, rank) AS base,
    count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined ON joined.doc_id = d.doc_id
"""


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = mixing.mix(table(spark, sf_dir, "documents"))
    return chosen.select("doc_id", "mix_domain", "lang", "source", "mix_tokens", "mix_epoch")


def _level_sql(depth: int) -> str:
    """Water-filling of one level of the tree as CTEs n, w and b of that depth; the budget of its parents is b of the depth before."""
    node, above = mixing.LEAF[: depth + 1], mixing.LEAF[:depth]
    keys, name = ", ".join(f"l.{c}" for c in node), node[-1]
    weight = ["1.0", "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mixing.LANGUAGE_WEIGHTS.items()) + f" ELSE {mixing.OTHER_WEIGHT} END", "sqrt(tokens)"][depth]
    parent = f"FROM leaf AS l JOIN b{depth - 1} AS p ON " + " AND ".join(f"l.{c} IS NOT DISTINCT FROM p.{c}" for c in above) if depth else "FROM leaf AS l, (SELECT sum(tokens) * " + str(mixing.BUDGET_SHARE) + " AS budget FROM leaf) AS p"
    by = f"PARTITION BY {', '.join(above)} " if depth else ""
    return f"""n{depth} AS (SELECT {keys}, p.budget AS parent, CAST(sum(l.tokens) AS DOUBLE) AS tokens, CAST(sum(l.tokens) * {mixing.MAX_EPOCHS} AS DOUBLE) AS capacity {parent} GROUP BY {keys}, p.budget HAVING sum(l.tokens) > 0),
m{depth} AS (SELECT *, {weight} AS weight, capacity / ({weight}) AS ratio FROM n{depth}),
w{depth} AS (SELECT *, (parent - coalesce(sum(capacity) OVER ({by}ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER ({by}ORDER BY ratio, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM m{depth}),
f{depth} AS (SELECT *, first_value(CASE WHEN ratio > water THEN water END IGNORE NULLS) OVER ({by}ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM w{depth}),
b{depth} AS (SELECT {', '.join(node)}, tokens, CASE WHEN ratio <= water THEN capacity ELSE weight * final END AS budget FROM f{depth})"""


_SPACE = "[ \\t\\n\\r\\f\\v]+"
ORACLE_SQL["op5_mixing"] = f"""
WITH d AS (
    SELECT doc_id, lang, source, md5(coalesce(text, '')) AS hash,
           CASE WHEN regexp_extract(source, '([0-9])[^0-9]*$', 1) = '' OR source IS NULL THEN 'domain_x' ELSE 'domain_' || CAST(CAST(regexp_extract(source, '([0-9])[^0-9]*$', 1) AS INTEGER) % 4 AS VARCHAR) END AS domain,
           len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '')) AS tokens
    FROM documents
), leaf AS (SELECT domain, lang, source, sum(tokens) AS tokens FROM d GROUP BY domain, lang, source),
{_level_sql(0)},
{_level_sql(1)},
{_level_sql(2)},
plan AS (SELECT *, least(CAST(floor(budget / tokens + 1e-9) AS BIGINT), {mixing.MAX_EPOCHS}) AS whole FROM b2),
keyed AS (
    SELECT d.*, whole, CAST(floor(budget - whole * plan.tokens + 1e-6) AS BIGINT) AS rest, md5('{mixing.SEED}|' || whole || '|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || hash) AS place
    FROM d JOIN plan ON d.domain = plan.domain AND d.lang IS NOT DISTINCT FROM plan.lang AND d.source IS NOT DISTINCT FROM plan.source
), cut AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM keyed),
closed AS (SELECT *, min(CASE WHEN used > rest THEN place END) OVER (PARTITION BY domain, lang, source) AS first_out FROM cut)
SELECT doc_id, domain AS mix_domain, lang, source, CAST(tokens AS BIGINT) AS mix_tokens, CAST(e AS INTEGER) AS mix_epoch
FROM closed, (SELECT unnest(range({mixing.MAX_EPOCHS})) AS e)
WHERE e < whole OR (e = whole AND (first_out IS NULL OR place < first_out))
"""


@query
def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL["op6_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor(256 * x)) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
    FROM v AS q, v AS c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), ranked AS (
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_language(table(spark, sf_dir, "documents"))


@query
def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


_WORDS = ", ".join(f"('{name}', {number}, '{word}', {n})" for name, number, word, n in licenses.template_words())
_SIZES = ", ".join(f"({size}, {step})" for size, step in licenses.window_sizes())
_SPLIT = f"list_filter(regexp_split_to_array(lower(%s), '{licenses.WORD}'), lambda x: x <> '')"
ORACLE_SQL["op8_licenses"] = f"""
WITH t(licence, template, word, n) AS (VALUES {_WORDS}),
total AS (SELECT count(*) AS n FROM documents),
df AS (SELECT w.word, count(*) AS df FROM (SELECT DISTINCT word FROM t) AS w JOIN (SELECT unnest(list_distinct(regexp_split_to_array(lower(text), '{licenses.WORD}'))) AS word FROM documents) AS d ON d.word = w.word GROUP BY w.word),
idf AS (SELECT DISTINCT t.word, ln((total.n + 1) / (coalesce(df.df, 0) + 1)) + 1 AS idf FROM t LEFT JOIN df ON df.word = t.word, total),
norms AS (SELECT template, sqrt(sum((t.n * idf) ** 2)) AS norm FROM t JOIN idf USING (word) GROUP BY template),
weighted AS (SELECT licence, t.template, t.word, t.n * idf / norm AS weight FROM t JOIN idf USING (word) JOIN norms ON norms.template = t.template),
d AS (
    SELECT doc_id, concat_ws('/', coalesce(source, 'none'), coalesce(lang, 'none'), coalesce(CAST(doc_id // 1000 AS VARCHAR), 'none'), coalesce(CAST(doc_id // 100 AS VARCHAR), 'none')) AS dir,
           coalesce(CAST(doc_id AS VARCHAR), 'none') AS name, text FROM documents
), gated AS (SELECT doc_id, dir, text, {_SPLIT % "text"} AS w FROM d WHERE regexp_matches(text, '{licenses.NOTICE}')),
placed AS (SELECT *, list_filter(range(len(w)), lambda i: regexp_matches(w[i + 1], '{licenses.NOTICE_WORD}')) AS pos FROM gated),
units AS (
    SELECT DISTINCT doc_id, dir, array_to_string(u, ' ') AS unit FROM (
        SELECT doc_id, dir, {_SPLIT % "u"} AS u FROM (SELECT doc_id, dir, unnest(list_concat(string_split(text, chr(10)), regexp_split_to_array(text, '\\n[ \\t]*\\n'))) AS u FROM gated) WHERE regexp_matches(u, '{licenses.NOTICE}')
        UNION ALL SELECT doc_id, dir, w[b + 1:b + size] FROM (
            SELECT doc_id, dir, w, size, unnest(list_distinct(flatten(list_transform(pos, lambda p: list_transform(range(greatest(0, CAST(ceil((p - size + 1) / step) AS BIGINT)), p // step + 1), lambda k: k * step))))) AS b
            FROM placed, (VALUES {_SIZES}) AS sizes(size, step)))
), words AS (
    SELECT unit, word, count(*) AS n FROM (SELECT unit, unnest(string_split(unit, ' ')) AS word FROM (SELECT DISTINCT unit FROM units)) WHERE word <> '' GROUP BY unit, word
), valued AS (SELECT unit, words.word, words.n * coalesce(idf, ln((total.n + 1) / 2) + 1) AS v FROM words LEFT JOIN idf ON idf.word = words.word, total),
lengths AS (SELECT unit, sqrt(sum(v * v)) AS norm FROM valued GROUP BY unit),
scored AS (SELECT unit, licence, round(sum(v * weight) / any_value(norm), 6) AS score FROM valued JOIN weighted USING (word) JOIN lengths USING (unit) GROUP BY unit, licence, template),
told AS (
    SELECT doc_id, dir, licence, score FROM (SELECT doc_id, dir, licence, score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) AS r FROM units JOIN scored USING (unit) WHERE score >= {licenses.MIN_COSINE}) WHERE r = 1
), of_dir AS (SELECT dir AS licence_dir, min_by(licence, doc_id) AS above FROM told GROUP BY dir),
near AS (
    SELECT dir, licence_dir, above, row_number() OVER (PARTITION BY dir ORDER BY length(licence_dir) DESC) AS r
    FROM (SELECT DISTINCT dir FROM d) AS x JOIN of_dir ON licence_dir = '' OR x.dir = licence_dir OR starts_with(x.dir, licence_dir || '/')
)
SELECT d.doc_id, d.dir || '/' || d.name AS path, coalesce(told.licence, near.above) AS licence,
       CASE WHEN told.licence IS NOT NULL THEN 'notice' WHEN near.above IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin, told.score,
       CASE WHEN told.licence IS NULL THEN near.licence_dir END AS licence_dir
FROM d LEFT JOIN told ON told.doc_id = d.doc_id LEFT JOIN near ON near.dir = d.dir AND near.r = 1
"""


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


@query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.least("deviation", F.lit(2**63 - 1)).cast("long"))


@query
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
ORACLE_SQL["op12_ranked_search"] = f"""
WITH words AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, {_UPPER}), '{_TERM}')) AS term FROM documents
), counts AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY doc_id, term),
lengths AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counts GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM lengths),
asked AS (
    SELECT item_id, term, count(*) AS qtf FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, {_UPPER}), '{_TERM}')) AS term FROM benchmark
    ) GROUP BY item_id, term
), weights AS (
    SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
    FROM counts, total WHERE term IN (SELECT term FROM asked) GROUP BY term
), impacts AS (
    SELECT counts.doc_id, counts.term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // terms)) AS impact
    FROM counts JOIN lengths USING (doc_id), total WHERE counts.term IN (SELECT term FROM asked)
), scored AS (
    SELECT item_id, doc_id, CAST(sum(qtf * w * impact) AS BIGINT) AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY item_id, doc_id
), best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM best WHERE rank <= 20
"""


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL["op13_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
