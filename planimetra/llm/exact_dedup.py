"""Exact duplicates by content-defined chunk recipes.

A text, its white-space runs replaced by one space, is cut into chunks at places that its
own characters choose. Only digests of the chunks move: a dictionary gives each distinct
chunk an identifier (its 64-bit hash and, where chunks of different SHA-256 share that hash,
the digest's rank among them), and a document becomes the ordered list of its chunks'
identifiers, its recipe. Equal recipes mean equal texts. Texts themselves are never shuffled.

Defined cases: a null text counts as empty; empty texts are equal to each other; a null
doc_id is larger than any other; rows that agree in doc_id and text form one group like any
other copies, and only the first of them is kept; a very long text is cut into chunks of at
most MAX_CHUNK characters in one task, and only its digests move on; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, fresh, materialise, small_or_not, text_or_empty

#: Chunks have at least MIN_CHUNK characters and at most MAX_CHUNK; between, a chunk ends
#: before a space that has one of these letters on either side.
MIN_CHUNK, MAX_CHUNK = 1024, 8192
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?=(?<=[bdfhlnprtvxz]) [acegikmoqsuwy][a-m])|.{{1,{MAX_CHUNK}}}"

#: White-space runs other than a single space: the only ones that change.
RUNS = r"\x20?[\x09-\x0D][\x20\x09-\x0D]*|\x20{2}[\x20\x09-\x0D]*"

#: A group of copies is joined to its members in this many parts, as it may hold a third of all rows.
SALTS = 16


def normalised(text: str = "text") -> Column:
    """The text with every run of white space replaced by one space."""
    return F.regexp_replace(text_or_empty(text), RUNS, " ")


def chunk_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each chunk: doc_id, text_sha256, pos, hash, digest; one with null pos for an empty text."""
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(text).alias("norm"))
    cut = norm.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.posexplode_outer(F.regexp_extract_all("norm", F.lit(CHUNK), F.lit(0))).alias("pos", "chunk"))
    return cut.select("doc_id", "text_sha256", "pos", F.xxhash64("chunk").alias("hash"), F.unhex(F.sha2("chunk", 256)).alias("digest"))


def chunk_dictionary(chunks: DataFrame) -> DataFrame:
    """hash, digests: the sorted distinct digests of the chunks with that hash (nearly always one)."""
    return chunks.where("pos is not null").groupBy("hash").agg(F.array_sort(F.collect_set("digest")).alias("digests"))


def recipes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each distinct doc_id and text: doc_id, text_sha256, copies, recipe (ordered identifiers)."""
    chunks = chunk_rows(docs, id_col, text)
    # 64-bit hashes hardly ever clash, so this table is tiny and the chunks themselves need not meet it in a shuffle
    clashes = small_or_not(materialise(chunk_dictionary(chunks).where(F.size("digests") > 1)))
    known = chunks.join(clashes, "hash", "left").withColumn("version", F.coalesce(F.array_position("digests", F.col("digest")), F.lit(1)) - 1)
    lists = known.groupBy("doc_id", "text_sha256").agg(
        F.sort_array(F.collect_set(F.when(F.col("pos").isNotNull(), F.struct("pos", "hash", "version")))).alias("parts"),
        F.sum(F.when(F.coalesce("pos", F.lit(0)) == 0, 1).otherwise(0)).alias("copies"),
    )
    return lists.select("doc_id", "text_sha256", "copies", F.transform("parts", lambda x: F.struct(x["hash"], x["version"])).alias("recipe"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Only groups of two rows or more are joined back, each in SALTS parts.
    """
    lists = materialise(recipes(docs, id_col, text).withColumn("recipe_hash", F.xxhash64("recipe")))
    groups = lists.groupBy("recipe_hash", "recipe").agg(F.min("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"), F.count("*").alias("members"))
    shared = groups.where("members > 1").select("recipe_hash", "recipe", "keep_id", "group_size", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = lists.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_sha256"), F.lit(SALTS)).cast("int"))
    joined = salted.join(shared, ["recipe_hash", "recipe", "salt"], "left")
    one_each = joined.select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", "copies").alias("group_size"),
        "text_sha256",
        F.size("recipe").alias("n_chunks"),
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
    )
    return one_each.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "n_chunks")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates drops; all columns stay as they are.

    The keys of the dropped rows go to the documents if there are few of them; else both
    sides are shuffled. Of rows that agree in doc_id and text, any one stays.
    """
    key, sha = fresh(docs, "_key", "_sha")
    found = materialise(exact_duplicates(docs, id_col, text).where("not kept").select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha), (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("again")).distinct())
    few = found.limit(BROADCAST_ROWS // 4 + 1).count() <= BROADCAST_ROWS // 4
    hint = F.broadcast if few else (lambda x: x)
    dropped, again = found.where("not again").select(key, sha), found.where("again").select(key, sha)
    same = docs[id_col].eqNullSafe(F.col(key)) & (F.sha2(normalised(text), 256) == F.col(sha))
    rest = docs.join(hint(dropped), same, "left_anti")
    if again.isEmpty():
        return rest
    once = rest.join(hint(again), same, "left_semi").withColumn(sha, F.sha2(normalised(text), 256)).dropDuplicates([id_col, sha]).drop(sha)
    return rest.join(hint(again), same, "left_anti").unionByName(once)
