"""The registered queries of this subpackage, and the SQL that gives the same rows where SQL can.

Without SQL: op3 and op5 (a tokenizer, a trained classifier), op7 and op9 (SQL would pair all lines, or all windows with
all items), op10 (a parser), op12 (SQL would make a row of every byte), op13 (DuckDB has no crc32), op4 (tests/llm hold a
version in plain Python, as for all the others).
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.llm import bottom_k, conversations, decontaminate, licenses, line_dedup, main_text, packing, ranking, revisits, suffixes, toxicity, url_rules, vectors
from stratalake.llm.tables import read, ship

Query = Callable[[SparkSession, str], DataFrame]


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_rules.judge(read(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_duplicates(read(ship(spark), sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(read(ship(spark), sf_dir, "documents"), path)
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def captures(pages: DataFrame) -> DataFrame:
    """An archive's records as `pages` imply them: each page fetched in full and checked again later, and its site's
    home page fetched or checked along with it."""
    html, url, key = F.coalesce("html", F.lit("")), F.col("url"), F.col("page_id").cast("string")
    digit = lambda salt: F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 1)
    second = 1_700_000_000 + F.col("page_id") * 60
    home = F.concat(F.regexp_extract(url, "^[^:]*://[^/?#]*", 0), F.lit("/"))
    tag = F.concat(F.lit('"'), F.substring(F.md5(html), 1, 16), F.lit('"'))
    home_tag = F.concat(F.lit('"'), F.substring(F.md5(home), 1, 8), F.when(digit("home") < "2", "-old").otherwise(""), F.lit('"'))
    size = F.octet_length(html).cast("string")
    modified = F.concat(F.lit("day "), (F.col("page_id") % 28).cast("string"))
    headers = lambda *pairs: F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())
    record = lambda mark, url, date, kind, head: F.struct(
        F.concat(F.lit(mark), key).alias("record_id"), url.alias("url"), F.timestamp_seconds(date).alias("date"),
        kind.alias("kind"), head.alias("headers"),
    )
    first = headers(
        F.lit("ETag"), F.when(digit("none") >= "2", tag), F.lit("Last-Modified"), modified, F.lit("Content-Type"), F.lit("text/html"),
        F.lit("Content-Length"), size, F.lit("Cache-Control"), F.lit("max-age=60"),
    )
    again = headers(
        F.lit("ETag"), F.when(digit("tag") < "2", '"other"').when(digit("tag") < "4", F.concat(F.lit("W/"), tag)).when(digit("tag") < "c", tag),
        F.lit("Last-Modified"), F.when(digit("date") < "8", modified), F.lit("Content-Length"), F.lit("0"),
        F.lit("Cache-Control"), F.lit("max-age=600"),
    )
    front = headers(F.lit("ETag"), home_tag, F.lit("Server"), F.concat(F.lit("s"), digit("server")))
    records = F.array(
        record("r", url, second, F.lit("response"), first),
        record("v", url, second + 86_400, F.lit("revisit"), again),
        record("h", home, second + 30, F.when(digit("home") < "4", "response").otherwise("revisit"), front),
    )
    return pages.select(F.explode(records).alias("r")).select("r.*")


def op4_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = revisits.resolve(captures(read(spark, sf_dir, "pages")))
    lines = F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return resolved.select(
        "record_id", "url_key", F.unix_seconds("date").alias("date_s"), "refers_to", F.unix_seconds("refers_date").alias("refers_s"),
        "outcome", F.array_join(lines, "\n").alias("headers"),
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(ship(spark), sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(*licenses.scan(read(spark, sf_dir, "documents")))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = line_dedup.dedup_lines(read(ship(spark), sf_dir, "documents").select("doc_id", "text"), least=1)
    return deduped.select("doc_id", "n_lines", F.size("removed").alias("n_removed"), F.array_join("removed", ",").alias("removed"), "text")


def op8_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(read(ship(spark), sf_dir, "embeddings"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(ship(spark), sf_dir, "documents"), read(spark, sf_dir, "benchmark"), short_inside=True)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    extracted = main_text.main_text(read(ship(spark), sf_dir, "pages").select("page_id", "url", "html"))
    return extracted.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.rank(read(ship(spark), sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.report(read(ship(spark), sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(read(ship(spark), sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_url_rules": op1_url_rules,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_packing": op3_packing,
    "op4_revisits": op4_revisits,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_line_dedup": op7_line_dedup,
    "op8_vectors": op8_vectors,
    "op9_decontamination": op9_decontamination,
    "op10_main_text": op10_main_text,
    "op11_ranked_search": op11_ranked_search,
    "op12_repeated_bytes": op12_repeated_bytes,
    "op13_conversations": op13_conversations,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = f"""regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"""
_FALL = """
    edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT a AS node, b AS other FROM edges UNION SELECT reach.node, edges.b FROM reach JOIN edges ON reach.other = edges.a),
    parts AS (SELECT node, least(node, min(other)) AS part FROM reach GROUP BY node)
"""


def _license_twin() -> str:
    rows = licenses.template_rows(licenses.PHRASES, licenses.TEMPLATES, licenses.DECISIVE)
    values = ", ".join(
        f"({t}, '{label}', {phrase}, {n}, {grams}, {musts}, {at}, '{' '.join(gram)}', {must})" for t, label, phrase, n, grams, musts, at, gram, must in rows
    )
    return f"""
    WITH t(template, label, phrase, length, grams, musts, spot, gram, must) AS (VALUES {values}),
    w AS (SELECT row_number() OVER () AS id, doc_id,
            regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
    g AS (SELECT id, i - 1 AS pos, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
            FROM (SELECT id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
    votes AS (SELECT id, template, label, phrase, length, grams, musts, pos - spot AS diagonal, list(DISTINCT spot) AS hit,
                list(DISTINCT spot) FILTER (must) AS decided, min(pos) AS low, max(pos) AS high
            FROM g JOIN t USING (gram) GROUP BY ALL),
    fresh AS (SELECT *, CASE WHEN phrase OR diagonal - lag(diagonal) OVER s <= 3 IS NOT TRUE THEN 1 ELSE 0 END AS new
            FROM votes WINDOW s AS (PARTITION BY id, template ORDER BY diagonal)),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY id, template ORDER BY diagonal) AS run FROM fresh),
    spans AS (SELECT id, template, label, phrase, length, grams, musts, len(list_distinct(flatten(list(hit)))) AS covered,
                coalesce(len(list_distinct(flatten(list(decided) FILTER (decided IS NOT NULL)))), 0) AS decided,
                min(low) AS start, max(high) + 3 AS stop FROM runs GROUP BY id, template, label, phrase, length, grams, musts, run),
    good AS (SELECT *, covered::DOUBLE / grams AS coverage FROM spans
            WHERE CASE WHEN phrase THEN covered = grams ELSE covered::DOUBLE / grams >= 0.75 AND decided = musts AND stop - start <= length + 12 END),
    found AS (SELECT id, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
                string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
                string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(coverage) AS score FROM good GROUP BY id)
    SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
        coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM w LEFT JOIN found USING (id)
    """


TWINS: dict[str, str] = {
    "op1_url_rules": f"""
    WITH rests AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
    parsed AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
            regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rests),
    rules(rule, site, start, verdict) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
            ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
    best AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM parsed JOIN rules
            ON (host = site OR ends_with(host, '.' || site)) AND starts_with(path, start) GROUP BY page_id)
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN best USING (page_id)
    """,
    "op2_near_duplicates": f"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
    s AS (SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN words ELSE words[i : i + 4] END AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(2, len(words) - 3))) AS i FROM w WHERE len(words) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
    {_FALL}
    SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(part, doc_id) AS component_id, coalesce(part, doc_id) = doc_id AS kept
    FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN parts ON node = doc_id
    """,
    "op6_licenses": _license_twin(),
    "op8_vectors": f"""
    WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE list_aggregate(embedding, 'count') = len(embedding)),
    links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id < y.vec_id AND len(x.e) = len(y.e)
            WHERE list_dot_product(x.e, y.e) >= 0.95 * sqrt(list_dot_product(x.e, x.e)) * sqrt(list_dot_product(y.e, y.e))
              AND list_dot_product(x.e, x.e) > 0 AND list_dot_product(y.e, y.e) > 0),
    {_FALL}
    SELECT vec_id, (SELECT count(*) FROM edges WHERE a = vec_id) AS n_links, coalesce(part, vec_id) AS component_id,
        coalesce(part, vec_id) = vec_id AS kept
    FROM embeddings LEFT JOIN parts ON node = vec_id
    """,
    "op11_ranked_search": f"""
    WITH d AS (SELECT row_number() OVER () AS id, doc_id, {_TERMS} AS words FROM documents),
    filled AS (SELECT id, doc_id, words, len(words) AS n FROM d WHERE len(words) > 0),
    stats AS (SELECT count(*) AS n_docs, sum(n) AS n_terms FROM filled),
    counted AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(words) AS word FROM filled) GROUP BY id, word),
    weights AS (SELECT word, floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
            FROM counted, stats GROUP BY word),
    asked AS (SELECT item_id, text, unnest({_TERMS}) AS word FROM (SELECT DISTINCT item_id, text FROM benchmark)),
    q AS (SELECT item_id, text, word, count(*) AS qtf FROM asked GROUP BY ALL),
    scored AS (SELECT item_id, text, id, any_value(doc_id) AS doc_id,
                sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
            FROM q JOIN weights USING (word) JOIN counted USING (word) JOIN filled USING (id), stats GROUP BY item_id, text, id),
    ranked AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
            FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
    """,
}
