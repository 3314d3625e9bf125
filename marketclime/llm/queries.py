"""The registered queries of this folder: each operator on its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from marketclime.llm import alignment, bpe, chat, contamination, langid, lm, minhash, quality, repeats, search, secrets, slots, urls
from marketclime.session import scratch_path

RANKS = "byte_bpe_50k.tiktoken"
BYTE_BPE = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
# fixed values: rules and the probe conversation that results must agree on
URL_RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
PROBE = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(list(PROBE), "conv_id long, turn long, role string, text string")
    return chat.digests(chats.unionByName(probe))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = slots.shard_documents(table(spark, sf_dir, "documents"), scratch_path(spark, "slot-map"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
        "next_shard",
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_quality(table(spark, sf_dir, "documents"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), public_tokenizers.path(PIECES))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_byte_bpe,
        op2_secret_scan,
        op3_chat_format,
        op4_lm_score,
        op5_virtual_slots,
        op6_decontamination,
        op7_suffix_dedup,
        op8_minhash_dedup,
        op9_url_filter,
        op10_quality_rules,
        op11_lexical_search,
        op12_tokenizer_alignment,
        op13_language_id,
    )
} | {"pipeline": corpus_pipeline.run}

_WORDS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

ORACLES = {
    "op6_decontamination": f"""
with docs as (select doc_id, {_WORDS} as w from documents),
items as (select item_id, {_WORDS} as w from benchmark),
doc_shingles as (
  select distinct doc_id, array_to_string(w[i:i+4], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from docs)),
item_shingles as (
  select distinct item_id, array_to_string(w[i:i+4], ' ') as s
  from (select item_id, w, unnest(range(1, len(w) - 3)) as i from items)),
sizes as (select item_id, count(*) as n_shingles from item_shingles group by item_id),
shared as (
  select doc_id, item_id, count(*) as n_shared
  from doc_shingles join item_shingles using (s) group by doc_id, item_id)
select doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles as containment
from shared join sizes using (item_id) where n_shared >= 0.8 * n_shingles""",
    "op9_url_filter": r"""
with rules(verdict, rh, rp) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
parts as (
  select page_id, row_number() over () as r,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
best as (
  select r, rh || rp as rule, verdict, row_number() over (partition by r order by length(rh || rp) desc) as place
  from parts join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict
from parts left join (from best where place = 1) using (r)""",
    "op11_lexical_search": r"""
with words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t
  from documents),
sizes as (select doc_id, len(t)::bigint as n from words where len(t) > 0),
corpus as (select count(*)::bigint as big_n, sum(n)::bigint as l from sizes),
wanted as (
  select i, item_id, term, count(*)::bigint as repeats from (
    select i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select row_number() over () as i, item_id, text from benchmark))
  group by i, item_id, term),
tf as (
  select doc_id, term, count(*)::bigint as tf from (select doc_id, unnest(t) as term from words)
  where term in (select term from wanted) group by doc_id, term),
w as (
  select term, floor(1000 * ln((2 * big_n + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*)::bigint as df from tf group by term), corpus),
impact as (
  select doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // l))) as impact
  from tf join w using (term) join sizes using (doc_id), corpus),
scored as (
  select i, item_id, doc_id, sum(repeats * impact)::bigint as score
  from wanted join impact using (term) group by i, item_id, doc_id),
ranked as (
  select *, row_number() over (partition by i order by score desc, doc_id) as rank from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 20""",
}
