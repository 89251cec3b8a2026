"""Every operator of this package applied to its whole table, with SQL where that can express it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tablesight.functions.storage import shared_folder
from tablesight.llm import (codes, collocations, jaccard, mixing, neighbours, packing, quality, secrets, suffixes, token_counts,
                            toxicity, urls, whitening)
from tablesight.llm.sampling import held_out

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``build(read)``, where ``read(table)`` is one of the given tables."""

    def register(build: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def ranks_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@query("op1_packing")
def op1(read):
    return packing.pack(packing.tokenise(read("documents"), ranks_path()))


@query("op4_mixing", r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, length(coalesce(text, '')) AS chars,
    substr(md5(coalesce(text, '')), 1, 16) AS content
  FROM documents),
keyed AS (
  SELECT *, -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || size), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)
    / (1.0 / (1.0 + abs(chars / greatest(size, 1) - 6.0))) AS key
  FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, sum(size) * 2.0 AS cap,
    list_value(5.0, 2.0, 1.0)[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sized GROUP BY source),
levels AS (
  SELECT *, ((SELECT sum(source_size) FROM sources) * 1.5
      - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
chosen AS (SELECT level FROM levels WHERE level <= cap / weight ORDER BY cap / weight, level LIMIT 1),
plan AS (
  SELECT source, source_size, least(cap, coalesce(weight * (SELECT level FROM chosen), cap))::DOUBLE AS target,
    CASE WHEN source_size > 0 THEN floor(least(cap, coalesce(weight * (SELECT level FROM chosen), cap)) / source_size) ELSE 0 END AS epochs
  FROM levels),
running AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size AS budget,
    sum(size) OVER (PARTITION BY k.source ORDER BY key, content ROWS UNBOUNDED PRECEDING) AS upto, size AS own
  FROM keyed k JOIN plan p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN budget > 0 AND (upto < budget OR (upto - own < budget AND upto - budget < budget - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running""")
def op4(read):
    return mixing.mix(read("documents")).drop("times")


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query("op5_urls", r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest AS (SELECT page_id, row_number() OVER () AS row, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
raw AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM rest),
parts AS (
  SELECT page_id, row, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path
  FROM raw)
SELECT page_id, any_value(host) AS host, any_value(path) AS path,
  arg_max(r_host || r_path, length(r_host || r_path)) AS rule, coalesce(arg_max(r_verdict, length(r_host || r_path)), 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
GROUP BY row, page_id""")
def op5(read):
    pages = read("pages")
    return urls.judge(pages, pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string"))


@query("op6_secrets")
def op6(read):
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secrets.scan(read("documents")).select(
        "doc_id", *[count(kind) for kind in secrets.BASE_KINDS], "base_sha256",
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        count("literal"))


@query("op8_toxicity")
def op8(read):
    docs = read("documents")
    return toxicity.score(docs, toxicity.fit(docs, read("labels"))).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


@query("op10_quality")
def op10(read):
    docs = read("documents")
    return quality.score(docs, quality.fit(docs, read("labels"))).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op9_jaccard")
def op9(read):
    return jaccard.link(read("documents"))


@query("op3_neighbours")
def op3(read):
    return neighbours.search(read("embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_codes")
def op7(read):
    return codes.link(read("embeddings"))


@query("op2_suffixes")
def op2(read):
    return suffixes.remove_repeats(read("documents")).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS phrase
  FROM worded, (VALUES (1), (2), (3), (4)) sizes(m)),
counted AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE m = 1 GROUP BY lang),
candidates AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE m > 1 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, m)) AS k FROM candidates),
scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a) // (x.f + y.f) AS score
  FROM cuts c JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
    JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[s:s + t - 1], ' ') AS phrase, max(a) AS longer
  FROM (SELECT *, unnest(range(2, m)) AS t FROM candidates), unnest(range(1, m - t + 2)) starts(s) GROUP BY ALL),
best AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, score
  FROM lowest LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM best JOIN sizes USING (lang) WHERE rank <= 2000""")
def op11(read):
    return collocations.mine(read("documents")).drop("left", "right")


@query("op12_whitening")
def op12(read):
    return whitening.whiten(read("embeddings"))


@query("op13_token_counts")
def op13(read):
    """The cache begins empty, so that every run encodes all distinct texts of its table."""
    import public_tokenizers

    docs = read("documents")
    cache = f"{shared_folder(docs.sparkSession)}/token-counts-{uuid.uuid4().hex}"
    return token_counts.count(docs, public_tokenizers.path("byte_bpe_50k.json"), cache)
