"""The registered queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import chat, collocations, exact_dedup, matroska, minhash, mixing, packing, permutation_index, quality, secret_scan, sharding, spelling, url_filter


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_documents(spark, sf_dir)).drop("n_chunks")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op5_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(_documents(spark, sf_dir))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"select * from values (-7L, 0L, 'user', '{tricky}'), (-7L, 1L, 'assistant', '{tricky}') as t(conv_id, turn, role, text)")
    return chat.read_back(chat.windows(conversations.unionByName(extra), public_tokenizers.path("word_bpe_49k.json")), in_order=True)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query in globals().items() if name.startswith("op") and name[2].isdigit()}


#: Rows that agree in doc_id don't occur in the tables; the numbering keeps one of them anyway.
OP3_SQL = r"""with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
    select doc_id, min(doc_id) over same as keep_id, count(*) over same as group_size, row_number() over (partition by text_sha256 order by doc_id) = 1 as kept, text_sha256
    from n window same as (partition by text_sha256)"""


#: f has the occurrences of all runs of one to four words; phrases are lists of words until the end.
OP11_SQL = r"""with pieces as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
    words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
    f as materialized (select lang, p, count(*) as a from (select lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) as p, k from words, (values (1), (2), (3), (4)) as t(k) where len(w) >= k) group by lang, p having count(*) >= 30 or len(p) = 1),
    c as materialized (select lang, p, a from f where len(p) > 1 and a >= 30),
    longer as (select lang, p[i:i + k - 1] as part, max(a) as above from c, range(1, 4) as i(i), range(2, 4) as k(k) where k < len(p) and i + k - 1 <= len(p) group by lang, part),
    kept as (select c.* from c left join longer on c.lang = longer.lang and c.p = longer.part where above is null or 100::hugeint * above < 80::hugeint * a),
    cuts as (select kept.lang, kept.p, kept.a, k, l.a as l, r.a as r, (2000000::hugeint * kept.a // (l.a + r.a))::bigint as score from kept, range(1, 4) as k(k), f l, f r
        where k < len(kept.p) and l.lang = kept.lang and l.p = kept.p[1:k] and r.lang = kept.lang and r.p = kept.p[k + 1:]),
    best as (select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
    ranked as (select lang, array_to_string(p, ' ') as phrase, a, l, r, score from best),
    n as (select lang, sum(a)::bigint as n from f where len(p) = 1 group by lang)
    select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from ranked join n using (lang) qualify rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": OP3_SQL, "op11_collocations": OP11_SQL}
