"""Queries over the operators of this package, with reference SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.llm import (
    collocations,
    decontamination,
    licenses,
    masked_lm,
    quality_classifier,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
    whitening,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op2_quality_classifier")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_classifier.score(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")))


@query("op3_sentencepiece_codec")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, sf_dir, "documents"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS g
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
gram AS (SELECT doc_id, l, i, array_to_string(list_slice(w, i, i + l - 1), ' ') AS g
         FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
m AS (SELECT doc_id, gram.l, i, item_id FROM gram JOIN win ON gram.g = win.g AND gram.l = win.l),
h AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM m) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS s
        FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS x FROM m) GROUP BY 1)
SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items,
       sha256(coalesce(its.s, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op4_benchmark_decontamination", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def _grams(n: int, name: str) -> str:
    return (
        f"{name} AS (SELECT doc_id, g, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, "
        f"array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS g "
        f"FROM (SELECT doc_id, w, unnest(range(1, len(w) - {n - 2})) AS i FROM d WHERE len(w) >= {n})))"
    )


def _inside(n: int, source: str, name: str) -> str:
    return f"{name} AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {n})) AS p FROM {source} WHERE c > 1) GROUP BY 1)"


OP6_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
{_grams(3, "g3")}, {_grams(quality_rules.MIN_REPEAT, "gm")}, {_grams(quality_rules.MAX_REPEAT + 1, "gx")},
{_inside(3, "g3", "r3")}, {_inside(quality_rules.MIN_REPEAT, "gm", "rm")},
lx AS (SELECT DISTINCT doc_id FROM gx WHERE c > 1),
li AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
       WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1),
f AS (SELECT d.doc_id, cast(len(w) AS bigint) AS n_words, cast(length(array_to_string(w, '')) AS bigint) AS word_chars,
        cast(length(text) - length(translate(text, '#*$%&|<>', '')) AS bigint) AS n_symbols, coalesce(li.n, 0) AS n_dup_lines,
        coalesce(r3.n, 0) AS n_repeat_words, coalesce(rm.n, 0) AS covered_words, lx.doc_id IS NOT NULL AS too_long
      FROM d LEFT JOIN li USING (doc_id) LEFT JOIN r3 USING (doc_id) LEFT JOIN rm USING (doc_id) LEFT JOIN lx USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)
         AND covered_words <= {quality_rules.MAX_COVERED} * n_words AND NOT too_long AS kept, covered_words
FROM f
"""


@query("op6_quality_rules", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "covered_words"
    )


@query("op7_suffix_array_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_ring_sharding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.ring_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op9_license_scan", licenses.oracle())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op10_masked_lm_scoring")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_lm.fit_and_score(table(spark, sf_dir, "documents"))


_WORD = "[^\\x20\\x09]+"
OP11_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(regexp_split_to_array(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '{_WORD}') AS w FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase, list_slice(w, i, i + k - 1) AS w
      FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, any_value(w) AS w, count(*) AS a FROM g GROUP BY lang, k, phrase),
t AS (SELECT lang, cast(sum(a) AS bigint) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT * FROM f WHERE k > 1 AND a >= {collocations.MIN_COUNT}),
cut AS (SELECT lang, k, phrase, a, j, array_to_string(list_slice(w, 1, j), ' ') AS head, array_to_string(list_slice(w, j + 1, k), ' ') AS tail
        FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.k, cut.phrase, cut.a, j, x.a AS l, y.a AS r,
        cast(1000000 * cast(cut.a AS hugeint) * cut.a // (cast(x.a AS hugeint) * y.a) AS bigint) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = head JOIN f y ON y.lang = cut.lang AND y.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner2 AS (SELECT lang, array_to_string(list_slice(w, i, i + 1), ' ') AS phrase, max(a) AS around
           FROM (SELECT lang, w, a, unnest([1, 2]) AS i FROM c WHERE k = 3) GROUP BY 1, 2),
q AS (SELECT b.* FROM b LEFT JOIN inner2 i ON i.lang = b.lang AND i.phrase = b.phrase WHERE around IS NULL OR 100 * around < {collocations.COVERED_PERCENT} * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM q) JOIN t USING (lang)
WHERE rank <= {collocations.TOP}
"""


@query("op11_collocations", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def _either_case(words: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in words)


def _marked(kind: str, number: int, pattern: str, kept: str) -> str:
    """Matches of a pattern with their places: matches are wrapped in two marks that no text has, and split there."""
    return rf"""
m{number} AS (SELECT doc_id, string_split(regexp_replace(text, '({pattern})', chr(1114110) || '\1' || chr(1114111), 'g'), chr(1114110)) AS p FROM d),
o{number} AS (SELECT doc_id, i, p[i] AS x, list_sum(list_transform(list_slice(p, 1, i - 1), lambda y: length(replace(y, chr(1114111), '')))) AS s
       FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1)) AS i FROM m{number})),
k{number} AS (SELECT doc_id, '{kind}' AS kind, {number} AS k, cast(s AS bigint) AS s, cast(s + strpos(x, chr(1114111)) - 1 AS bigint) AS e, string_split(x, chr(1114111))[1] AS hit FROM o{number}),
b{number} AS (SELECT doc_id, kind, k, s, e FROM k{number} WHERE {kept})"""


def _op12_sql() -> str:
    names = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
    lead = rf"""({names})["'']?\x20*[:=]\x20*["'']?"""
    parts = [
        _marked("assign", 0, lead + "[A-Za-z0-9+/_.=-]+", rf"length(regexp_replace(hit, '^{lead}', '')) >= 6"),
        _marked("access", 1, "AKIA[A-Z0-9]+", "length(hit) >= 20"), _marked("hex", 2, "[0-9a-f]+", "length(hit) >= 24"),
    ]
    allowed = "|".join(f"(?:{a})" for a in secret_scan.ALLOW)
    for k, c in enumerate(secret_scan.CLASSES, 3):
        most = secret_scan.most_weight(c.window, c.bits)
        parts.append(_marked(c.name, k, f"[{c.characters}]+", f"length(hit) >= {c.window} AND NOT regexp_full_match(hit, '{allowed}', 's')"))
        parts.append(f"""
w{k} AS (SELECT doc_id, s, i, x FROM (SELECT doc_id, s, i, substr(hit, i, {c.window}) AS x FROM
        (SELECT doc_id, s, hit, unnest(range(1, length(hit) - {c.window - 2})) AS i FROM k{k}
         WHERE length(hit) >= {c.window} AND NOT regexp_full_match(hit, '{allowed}', 's')))),
h{k} AS (SELECT doc_id, s, s + i - 1 AS a FROM (SELECT doc_id, s, i, ch, count(*) AS n FROM (SELECT doc_id, s, i, unnest(string_split(x, '')) AS ch FROM w{k}) GROUP BY ALL)
        GROUP BY doc_id, s, i HAVING sum(cast(round(n * log2(n) * {secret_scan.SCALE}) AS bigint)) <= {most}),
j{k} AS (SELECT doc_id, s, a, sum(fresh) OVER (PARTITION BY doc_id, s ORDER BY a) AS g FROM
        (SELECT *, CASE WHEN a - lag(a) OVER (PARTITION BY doc_id, s ORDER BY a) <= {c.window} THEN 0 ELSE 1 END AS fresh FROM h{k})),
e{k} AS (SELECT doc_id, '{c.name}' AS kind, {k} AS k, cast(min(a) AS bigint) AS s, cast(max(a) + {c.window} AS bigint) AS e FROM j{k} GROUP BY doc_id, s, g)""")
    added = " ".join(f"UNION ALL SELECT * FROM e{k}" for k in range(3, 3 + len(secret_scan.CLASSES)))
    line = "coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k{extra}), '')"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {",".join(parts)},
base AS (SELECT * FROM b0 UNION ALL SELECT * FROM b1 UNION ALL SELECT * FROM b2),
x AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {line.format(extra='')} AS l FROM base GROUP BY 1),
y AS (SELECT doc_id, {line.format(extra=', e')} AS l FROM (SELECT * FROM base {added}) GROUP BY 1)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(x.l, '')) AS base_sha256, coalesce(y.l, '') AS spans
FROM d LEFT JOIN x USING (doc_id) LEFT JOIN y USING (doc_id)
"""


@query("op12_secret_scan", _op12_sql())
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).drop("n_entropy")


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector and component."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    each = F.explode(F.transform(F.arrays_zip("whitened", "explained"), lambda z, i: F.struct((i + 1).cast("int").alias("component"), z["whitened"].alias("w"), z["explained"].alias("e"))))
    rows = white.select("vec_id", "n", "deviation", "identity_error", each.alias("c"))
    return rows.select("vec_id", "c.component", "n", "deviation", F.col("c.w").alias("whitened"), F.col("c.e").alias("explained"), "identity_error")
