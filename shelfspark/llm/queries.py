"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm import mixing
from shelfspark.llm import quality_outliers as outliers
from shelfspark.llm.alignment import align
from shelfspark.llm.decontaminate import decontaminate
from shelfspark.llm.language_id import language_ids
from shelfspark.llm.line_dedup import dedup_lines
from shelfspark.llm.projected_search import nearest
from shelfspark.llm.repeated_spans import repeated_spans
from shelfspark.llm.secrets import scan_secrets
from shelfspark.llm.simhash import simhash_components
from shelfspark.llm.token_counts import token_counts
from shelfspark.llm.warc import archive_pages
from shelfspark.llm.whitening import whitened_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is the DuckDB statement with the same result."""

    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def _spans_sql(kind: int, pattern: str, group: int) -> str:
    """Match spans of a pattern as structs, from the pieces between the matches."""
    gaps, found = f"string_split_regex(t, '{pattern}')", f"regexp_extract_all(t, '{pattern}', 0)"
    values = f"regexp_extract_all(t, '{pattern}', {group})"
    return f"""
list_transform(range(1, len({found}) + 1), lambda k: {{
  'start': (coalesce(list_sum(list_transform({gaps}[1:k], lambda x: length(x))), 0)
            + coalesce(list_sum(list_transform({found}[1:k-1], lambda x: length(x))), 0))::INT,
  'kind': {kind}, 'size': length({found}[k])::INT, 'value': {values}[k]}})"""


def _letters(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# RE2 would fold other letters into a (?i) group, so both cases are spelled out.
_WORDS = "|".join(_letters(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN_SQL = f"""(?:{_WORDS})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""".replace("\\\\", "\\")

OP2_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS owner,
                  coalesce(source, '') || chr(1) || coalesce(lang, '') AS repo FROM documents),
raw AS (SELECT doc_id, owner, repo,
  list_filter({_spans_sql(0, _ASSIGN_SQL, 1)}, lambda s: length(s.value) >= 6) AS a,
  list_filter({_spans_sql(1, "AKIA[A-Z0-9]+", 0)}, lambda s: s.size >= 20) AS k,
  {_spans_sql(2, "[0-9a-f]{24,}", 0)} AS h,
  list_filter({_spans_sql(3, "[A-Za-z0-9+/_=-]{20,}", 0)},
              lambda s: regexp_matches(s.value, '[0-9]') AND regexp_matches(s.value, '[A-Za-z]')) AS w FROM d),
b AS (SELECT *, list_sort(list_concat(list_concat(a, k), h)) AS base FROM raw),
f AS (SELECT *, list_filter(w, lambda c: len(list_filter(base, lambda x: x.start < c.start + c.size AND c.start < x.start + x.size)) = 0) AS free FROM b),
spans AS (SELECT doc_id, owner, repo, unnest(list_concat(base, free)) AS s FROM f),
standing AS (SELECT s.value AS v, count(DISTINCT owner) AS owners FROM spans GROUP BY 1),
told AS (SELECT doc_id, s.kind AS kind, s.start AS start, owners,
                ['assign', 'access', 'hex', 'owned'][s.kind + 1] || ':' || s.start || ':' || (s.start + s.size) AS txt
         FROM spans JOIN standing ON s.value = v)
SELECT f.doc_id, len(a)::BIGINT AS n_assign, len(k)::BIGINT AS n_access, len(h)::BIGINT AS n_hex,
  sha256(coalesce((SELECT string_agg(txt, ',' ORDER BY start, kind) FROM told WHERE told.doc_id = f.doc_id AND kind < 3), '')) AS base_sha256,
  coalesce((SELECT string_agg(txt, ',' ORDER BY start, kind) FROM told WHERE told.doc_id = f.doc_id AND (kind < 3 OR owners = 1)), '') AS spans,
  (SELECT count(*) FROM told WHERE told.doc_id = f.doc_id AND kind = 3 AND owners = 1) AS n_owned,
  (SELECT count(*) FROM told WHERE told.doc_id = f.doc_id AND kind < 3 AND owners = 1) AS n_live,
  (SELECT count(*) FROM told WHERE told.doc_id = f.doc_id AND kind < 3 AND owners >= 3) AS n_example
FROM f"""


@query("op2_secret_scan", OP2_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return scan_secrets(table(spark, folder, "documents"))


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest FROM p),
t AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, d.payload_digest,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN top IS NOT NULL AND page_id IS DISTINCT FROM top THEN top END AS refers_to
FROM d LEFT JOIN t ON d.payload_digest = t.payload_digest"""


@query("op10_warc_archives", OP10_SQL)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return archive_pages(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query("op7_simhash_near_duplicates")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_components(table(spark, folder, "documents"))


# Words and windows as the contract has them, without fingerprints.
OP3_SQL = r"""
WITH
dw AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i+9], ' '))) AS g
        FROM iw WHERE len(w) > 0),
size AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {'p': i, 'g': array_to_string(w[i:i+n-1], ' ')})) AS x
        FROM dw, size WHERE len(w) >= n),
hit AS (SELECT doc_id, item_id, x.p AS p, win.n FROM pos JOIN win ON win.g = x.g AND win.n = pos.n),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY 1),
names AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM hit) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN names ON names.doc_id = d.doc_id"""


@query("op3_benchmark_decontamination", OP3_SQL)
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")


OP1_SQL = r"""
WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS pos, unnest(string_split(text, chr(10))) AS line
           FROM documents WHERE text IS NOT NULL),
t AS (SELECT doc_id, pos, list_transform(list_filter(string_split_regex(line, '[\x20\x09\x0B-\x0D]+'), lambda x: x <> ''),
             lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l),
k AS (SELECT doc_id, pos, w, len(w) AS n, len(w) || ' ' || array_to_string(w[1:3], ' ') AS leaf, array_to_string(w, ' ') AS skel FROM t WHERE len(w) >= 4),
s AS (SELECT leaf, skel, count(DISTINCT doc_id) AS docs, any_value(w) AS w FROM k GROUP BY leaf, skel),
o AS (SELECT leaf, count(*) AS kinds FROM s GROUP BY leaf HAVING sum(docs) >= 3),
x AS (SELECT s.leaf, skel, docs, unnest(w) AS token, unnest(range(1, len(w) + 1)) AS i FROM s JOIN o ON o.leaf = s.leaf WHERE kinds > 1),
u AS (SELECT leaf, i, token, sum(docs) AS support FROM x GROUP BY ALL),
v AS (SELECT x.leaf, skel, list(CASE WHEN x.i <= 3 OR support >= 3 THEN x.token ELSE '<*>' END ORDER BY x.i) AS w
      FROM x JOIN u ON u.leaf = x.leaf AND u.i = x.i AND u.token = x.token GROUP BY ALL),
m AS (SELECT doc_id, pos, k.leaf, coalesce(v.w, k.w) AS w, n FROM k JOIN o ON o.leaf = k.leaf LEFT JOIN v ON v.leaf = k.leaf AND v.skel = k.skel),
f AS (SELECT doc_id, pos, leaf || '|' || array_to_string(w, ' ') AS tpl FROM m WHERE len(list_filter(w, lambda y: y <> '<*>')) >= ceil(n * 0.6)),
r AS (SELECT tpl, min((doc_id, pos)) AS first FROM f GROUP BY tpl HAVING count(DISTINCT doc_id) >= 3),
d AS (SELECT doc_id, list(pos) AS gone FROM f JOIN r ON r.tpl = f.tpl WHERE (doc_id, pos) <> first GROUP BY doc_id)
SELECT c.doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_dropped,
  sha256(CASE WHEN gone IS NULL THEN text ELSE coalesce((SELECT string_agg(line, chr(10) ORDER BY pos) FROM l
         WHERE l.doc_id = c.doc_id AND NOT list_contains(gone, l.pos)), '') END) AS kept_sha256
FROM documents c LEFT JOIN d ON d.doc_id = c.doc_id"""


@query("op1_line_dedup", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    kept = dedup_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op6_language_id")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return language_ids(table(spark, folder, "documents"))


#: Rounds of raking in the SQL, which has no test for their end; more than the tables need.
SQL_ROUNDS = 20


def _mix_sql() -> str:
    """The rounds of raking spelled out, one table each."""
    topic = " ".join(f"WHEN regexp_matches(text, '{pattern}') THEN '{name}'" for name, pattern in mixing.TOPICS)
    steps, last = [], "w0"
    for number in range(SQL_ROUNDS):
        for name in mixing.DIMENSIONS:
            new = f"w{number}_{name}"
            steps.append(
                f"{new} AS MATERIALIZED (SELECT * EXCLUDE (weight), CASE WHEN sum(weight) OVER (PARTITION BY {name}) > 0 "
                f"THEN weight * to_{name} / sum(weight) OVER (PARTITION BY {name}) ELSE 0 END AS weight FROM {last})"
            )
            last = new
    share = ", ".join(
        f"pow((sum(tokens) OVER (PARTITION BY {n}))::DOUBLE, {mixing.EVENNESS[n]}) / (SELECT sum(pow(t::DOUBLE, {mixing.EVENNESS[n]})) FROM "
        f"(SELECT sum(tokens) AS t FROM cells GROUP BY {n})) AS to_{n}" for n in mixing.DIMENSIONS
    )
    order = "pull DESC, source, lang, topic"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, coalesce(lang, '(none)') AS lang,
  CASE {topic} ELSE 'general' END AS topic, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens FROM documents),
cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
w0 AS MATERIALIZED (SELECT *, tokens::DOUBLE AS weight, {share} FROM cells),
{", ".join(steps)},
q AS MATERIALIZED (SELECT *, CASE WHEN tokens > 0 THEN weight / tokens ELSE 0 END AS pull FROM {last}),
r AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {order}) AS rank,
  ((SELECT sum(tokens) * {mixing.RATE} FROM q) - coalesce(sum(tokens) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / ((SELECT sum(weight) FROM q) - coalesce(sum(weight) OVER (ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS scale FROM q),
p AS MATERIALIZED (SELECT source, lang, topic, weight, CASE WHEN pull > 0 THEN least(1.0, coalesce((SELECT arg_min(scale, rank) FROM r WHERE scale * pull <= 1) * pull, 1.0)) ELSE 0.0 END AS p FROM q)
SELECT doc_id, d.topic, d.tokens AS n_tokens, round(weight, 6) AS weight, round(p, 6) AS p,
  ('0x' || md5('{mixing.SEED}:' || doc_id)[1:8])::BIGINT / 4294967296.0 < p AS kept
FROM d JOIN p ON p.source = d.source AND p.lang = d.lang AND p.topic = d.topic"""


@query("op9_source_mixing", _mix_sql())
def op9(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", F.col("mix_topic").alias("topic"), F.col("mix_tokens").alias("n_tokens"), F.round("mix_weight", 6).alias("weight"),
        F.round("mix_p", 6).alias("p"), F.col("mix_kept").alias("kept"),
    )


@query("op5_projected_search")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings")
    return nearest(vectors, vectors.where("vec_id % 20 = 0").select("vec_id"))


@query("op4_repeated_spans")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_spans(table(spark, folder, "documents")).drop("spans")


@query("op11_alignment")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    paths = (public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return align(table(spark, folder, "documents"), *paths).withColumn("groups_sha256", digest).drop("groups")


@query("op12_whitening")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return whitened_components(table(spark, folder, "embeddings"))


def _outlier_sql() -> str:
    """Statistics by lists, then the concentration steps spelled out, a few tables each."""
    layered = lambda source, layers: (
        f"(SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in layers[-1].items())} FROM {layered(source, layers[:-1])})" if layers else source
    )
    sums = ", ".join(f"{sql} AS {name}" for name, sql in outliers.sum_layer().items())
    added = ", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in outliers.sum_layer())
    estimate = ", ".join(outliers.ESTIMATE)
    dims = range(outliers.DIMS)
    tables = [
        f"""e AS MATERIALIZED (SELECT grp, 0 AS start, {estimate} FROM {layered(f'(SELECT grp, {sums} FROM v GROUP BY grp)', outliers.estimate_layers())}
          UNION ALL SELECT grp, 1, {', '.join(f'a{i} * 10.0::DOUBLE' for i in dims)},
            {', '.join(f'greatest(b{i} * 14.826::DOUBLE, {outliers.UNIT * outliers.FLOORS[i]}::DOUBLE)' if i == j else '0.0::DOUBLE' for i, j in outliers.PAIRS)}
          FROM (SELECT grp, {', '.join(f'quantile_disc(abs(x{i} - a{i}), 0.5) AS b{i}' for i in dims)}, {', '.join(f'any_value(a{i}) AS a{i}' for i in dims)}
                FROM (SELECT grp, {', '.join(f'(v{i} // 10) - (CASE WHEN v{i} < 0 AND v{i} % 10 <> 0 THEN 1 ELSE 0 END) AS x{i}' for i in dims)} FROM v)
                JOIN (SELECT grp AS g, {', '.join(f'quantile_disc((v{i} // 10) - (CASE WHEN v{i} < 0 AND v{i} % 10 <> 0 THEN 1 ELSE 0 END), 0.5) AS a{i}' for i in dims)} FROM v GROUP BY grp) ON g = grp GROUP BY grp))"""
    ]
    last = "e"
    for step in range(outliers.STEPS):
        met = layered(f"(SELECT v.*, {last}.* EXCLUDE (grp) FROM v JOIN {last} ON {last}.grp = v.grp)", outliers.distance_layers())
        tables.append(
            f"""b{step} AS MATERIALIZED (SELECT grp, start, {outliers.BUCKET} AS bucket, {sums} FROM {met} GROUP BY ALL),
h{step} AS MATERIALIZED (SELECT *, sum(n) OVER (PARTITION BY grp, start ORDER BY bucket) - n AS before, sum(n) OVER (PARTITION BY grp, start) AS whole FROM b{step}),
e{step} AS MATERIALIZED (SELECT grp, start, {estimate} FROM {layered(f'(SELECT grp, start, {added} FROM h{step} WHERE before < ceil(whole * {outliers.SHARE}::DOUBLE) GROUP BY grp, start)', outliers.estimate_layers())})"""
        )
        last = f"e{step}"
    limit = outliers.chi_square_quantile(1 - outliers.LEFT_OUT, outliers.DIMS) * outliers._consistency(outliers.SHARE)
    chosen = f"(SELECT * FROM {last} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {outliers.DETERMINANT}, start) = 1)"
    inner = layered(f"(SELECT v.*, c.* EXCLUDE (grp) FROM v JOIN {chosen} c ON c.grp = v.grp)", outliers.distance_layers())
    final = layered("(SELECT v.*, f.* EXCLUDE (grp) FROM v JOIN f ON f.grp = v.grp)", outliers.distance_layers())
    steps = ",\n".join(tables)
    most = outliers.chi_square_quantile(1 - outliers.TAIL, outliers.DIMS)
    return rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, lang, source, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS x FROM d WHERE len(w) >= 5),
r AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 5)) AS at
      FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS times FROM g) WHERE times > 1) GROUP BY doc_id),
s AS MATERIALIZED (SELECT d.doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    len(l)::BIGINT AS n_lines, len(w) < 10 OR 100 * coalesce(r.n, 0) > 20 * len(w) AS base_failed FROM d LEFT JOIN r ON r.doc_id = d.doc_id),
o AS (SELECT *, count(*) OVER (PARTITION BY lang, source) AS own FROM s WHERE NOT base_failed),
q AS (SELECT *, CASE WHEN own >= {outliers.LEAST_ROWS} THEN 'own' || coalesce('=' || lang, '') || chr(1) || coalesce('=' || source, '') ELSE 'pool' || coalesce('=' || lang, '') END AS grp FROM o),
v AS MATERIALIZED (SELECT grp, doc_id, {', '.join(f'{sql} AS {name}' for name, sql in outliers.vector_layer().items())} FROM q QUALIFY count(*) OVER (PARTITION BY grp) >= {outliers.LEAST_ROWS}),
{steps},
f AS MATERIALIZED (SELECT grp, {estimate} FROM {layered(f'(SELECT grp, {sums} FROM {inner} WHERE d2 <= {limit!r}::DOUBLE GROUP BY grp)', outliers.estimate_layers())}),
m AS (SELECT doc_id, d2 FROM {final})
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, round(d2 / {outliers._consistency(1 - outliers.LEFT_OUT)!r}::DOUBLE, 6) AS distance,
  NOT base_failed AND (d2 IS NULL OR d2 / {outliers._consistency(1 - outliers.LEFT_OUT)!r}::DOUBLE <= {most!r}::DOUBLE) AS kept
FROM s LEFT JOIN m ON m.doc_id = s.doc_id"""


@query("op13_quality_outliers", _outlier_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return outliers.quality_verdicts(table(spark, folder, "documents")).withColumn("distance", F.round("distance", 6))


@query("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    return corpus_pipeline.run(spark, folder)
