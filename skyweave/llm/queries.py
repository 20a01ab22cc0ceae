"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch_path
from . import chat, decontam, exact_dedup, packing, phrases, quality, simhash, token_counts, token_files, toxicity, url_rules, warc, whitening
from .shared import stored

TOKENIZER = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the smaller half of the doc_ids first, so that a text's
    smallest doc_id is the one that the index knows it by."""
    docs = _table(spark, sf_dir, "documents")
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    middle = docs.select(F.percentile_approx("doc_id", 0.5)).first()[0]
    early = F.coalesce(F.col("doc_id") <= middle, F.lit(False))
    parts = [stored(index.ingest(docs.where(rows), batch=name), "deduplicated") for name, rows in (("early", early), ("late", ~early))]
    index.drop()
    verdicts = parts[0].unionByName(parts[1])
    # in a table, so that a hot text's rows can be split
    sizes = stored(verdicts.groupBy("text_sha256").agg(F.count(F.lit(1)).alias("group_size")), "group-sizes")
    return verdicts.drop("group_size").join(sizes, "text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        decontam.n_hit(F.col("spans")).alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        decontam.items_sha256(F.col("item_ids")).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer(), 2048, 0)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path, min_bytes=0, chunk_bytes=4 << 10)
    return warc.read_records(spark, path)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_digests(stored(chat.whole_examples(rows, tails=True), "chat-examples"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_tokens(_table(spark, sf_dir, "documents"), path, tokenizer(), end_id=2)
    return token_files.read_documents(spark, path)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rollup = token_counts.TokenRollup(spark, scratch_path(spark, "token-rollup"), tokenizer(), TOKENIZER)
    # an eighth is loaded under another source, then revised: deleted there and inserted where it belongs
    revised = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 8 == 0, F.lit(False))
    unsorted = F.concat_ws("/", F.lit("unsorted"), "source")
    load = docs.withColumn("source", F.when(revised, unsorted).otherwise(F.col("source")))
    sides = F.explode(F.array(F.struct(unsorted.alias("source"), F.lit(-1).alias("sign")), F.struct("source", F.lit(1).alias("sign"))))
    revision = docs.where(revised).select("lang", "text", sides.alias("side")).select("side.source", "lang", "text", "side.sign")
    rollup.commit("load", load)
    rollup.commit("revision", revision, "sign")
    rollup.compact()
    rollup.commit("load", load)  # replays, which change nothing
    rollup.commit("revision", revision, "sign")
    return rollup.totals()


URL_RULES = [
    url_rules.domain_rule("net/", "block"),
    url_rules.domain_rule("example.net/en/", "allow"),
    url_rules.domain_rule("example.com/de/", "block"),
    url_rules.domain_rule("org/fr/", "allow"),
]


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), radius=2)


def held_out(doc_id: Column, parts: int = 5, part: int = 0) -> Column:
    """A null doc_id isn't held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def train_toxicity(spark: SparkSession, documents: DataFrame, sf_dir: str) -> toxicity.Model:
    """The model of the rows that aren't held out."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.train(documents, labels.where(~held_out(F.col("doc_id"))))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, train_toxicity(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_rows(_table(spark, sf_dir, "embeddings"), components=8)


def op12_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def train_quality(spark: SparkSession, documents: DataFrame, sf_dir: str) -> quality.Model:
    """The model of the rows that aren't held out."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.train(documents, labels.where(~held_out(F.col("doc_id"), 3, 1)))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, train_quality(spark, docs, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_benchmark_decontamination, op3_best_fit_packing, op4_warc, op5_chat_formatting, op6_token_files, op7_token_counts, op8_url_filters, op9_simhash_near_dedup, op10_toxicity, op11_embedding_whitening, op12_phrase_mining, op13_quality)}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {shift}) & 31) + 1, 1)" for k in range(8) for shift in (15, 10, 5, 0))

ORACLE_SQL = {
    "op2_benchmark_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        g AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS g
              FROM i, LATERAL (SELECT unnest(generate_series(1, greatest(1, len(w) - 9))) AS k) WHERE len(w) > 0),
        p AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS g
              FROM d, (SELECT DISTINCT n FROM g), LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS k)),
        f AS (SELECT doc_id, item_id, n, k FROM p JOIN g USING (n, g)),
        hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS pos FROM f) GROUP BY doc_id),
        own AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM f) GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id)""",
    "op4_warc": f"""
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY h, payload_bytes) AS first FROM p)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f""",
    "op5_chat_formatting": r"""
        WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        f AS (SELECT *, length(text) + len(regexp_extract_all(text, '\\|</?s>|\[/?(?:INST|SYS|ASST|ROLE)\]'))
                     + CASE role WHEN 'user' THEN length('<s>[INST]  [/INST]') WHEN 'system' THEN length('<s>[SYS]  [/SYS]') WHEN 'assistant' THEN length('<s>[ASST]  </s>') ELSE length('<s>[ROLE] ') + length(role) + length(chr(10) || ' [/ROLE]') END AS chars FROM c)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
        FROM f GROUP BY conv_id""",
    "op1_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op12_phrase_mining": rf"""
        WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
        f AS (SELECT lang, m, array_to_string(w[k : k + m - 1], ' ') AS phrase, count(*) AS f
              FROM w, (VALUES (1), (2), (3)) AS v(m), LATERAL (SELECT unnest(generate_series(1, len(w) - m + 1)) AS k) GROUP BY ALL),
        c AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m > 1 AND f >= 10),
        x AS (SELECT DISTINCT s.lang, s.phrase FROM c s, c t, (VALUES (1), (2)) AS v(k)
              WHERE s.lang = t.lang AND s.m = 2 AND t.m = 3 AND s.phrase = array_to_string(t.w[k : k + 1], ' ') AND 100 * t.a >= 50 * s.a),
        cut AS (SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, 1000000::HUGEINT * a * a // (l.f::HUGEINT * r.f) AS score
                FROM c, (VALUES (1), (2)) AS v(k), f l, f r
                WHERE k < c.m AND l.lang = c.lang AND r.lang = c.lang AND l.phrase = array_to_string(c.w[1 : k], ' ') AND r.phrase = array_to_string(c.w[k + 1 : c.m], ' ')),
        best AS (SELECT * FROM cut ANTI JOIN x USING (lang, phrase) QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang)
        SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
        FROM best JOIN n USING (lang) QUALIFY rank <= 2000""",
    "op8_url_filters": r"""
        WITH s AS (
          SELECT page_id,
                 translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
          FROM pages),
        j AS (
          SELECT *, CASE
            WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
            WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
            WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
            WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
          FROM s)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j""",
}
