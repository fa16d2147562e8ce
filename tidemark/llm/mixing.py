"""Mixing sources to target weights by Sainte-Lague apportionment; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialize, n_words

#: Words in a block, the seat that sources and shards are apportioned.
BLOCK_WORDS = 16
#: No source and no document is taken more often than this.
MOST_REPEATS = 3
SEED = "mix-1"


def seeded(doc_id: Column, salt: str) -> Column:
    """60 bits of an MD5 of salt and id, as a long: an order that any SQL engine can repeat."""
    text = F.concat(F.lit(f"{salt}|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def apportion(df: DataFrame, group: list[str], votes: str, seats: str, order: list, out: str) -> DataFrame:
    """``df`` with integer quotas of its rows: ``seats`` of each group go to the highest quotients votes/(2k+1).

    A divisor near votes/seats gives all but a few seats at once; only the seats between what a slightly larger
    and a slightly smaller divisor give are ranked, about three rows for each row of ``df``. Ties go by
    ``order``. Rows without votes get none; a group of no votes or no seats gets none.
    """
    whole = Window.partitionBy(*group)
    n, total, rows = F.col(seats), F.col("_tidemark_total"), F.col("_tidemark_rows")
    base = df.withColumns({"_tidemark_total": F.sum(votes).over(whole), "_tidemark_rows": F.count_if(F.col(votes) > 0).over(whole)})
    fewer, more = n - rows / 2, n + rows / 2
    low = F.when((fewer > 0) & (total > 0), F.greatest(F.lit(0), F.floor(F.col(votes) * fewer / total + 0.5) - 1)).otherwise(F.lit(0))
    high = F.when((F.col(votes) > 0) & (n > 0), F.floor(F.col(votes) * more / total + 0.5) + 1).otherwise(F.lit(0))
    base = base.withColumns({"_tidemark_low": low.cast("long"), "_tidemark_high": high.cast("long")})
    base = base.withColumn("_tidemark_left", n - F.sum("_tidemark_low").over(whole)).withColumn("_tidemark_row", F.row_number().over(whole.orderBy(*order)))
    tries = base.where("_tidemark_high > _tidemark_low").select(*group, "_tidemark_row", "_tidemark_left", F.col(votes).alias("_tidemark_v"), F.explode(F.sequence("_tidemark_low", F.col("_tidemark_high") - 1)).alias("_tidemark_k"))
    best = Window.partitionBy(*group).orderBy((F.col("_tidemark_v") / (2 * F.col("_tidemark_k") + 1)).desc(), "_tidemark_row", "_tidemark_k")
    won = tries.withColumn("_tidemark_rank", F.row_number().over(best)).where("_tidemark_rank <= _tidemark_left").groupBy(*group, "_tidemark_row").agg(F.count("*").alias("_tidemark_won"))
    won = won.select(*[F.col(c).alias(f"_tidemark_w{i}") for i, c in enumerate([*group, "_tidemark_row"])], "_tidemark_won")
    on = [F.col(c).eqNullSafe(F.col(f"_tidemark_w{i}")) for i, c in enumerate([*group, "_tidemark_row"])]
    return base.join(won, on, "left").select(*df.columns, (F.col("_tidemark_low") + F.coalesce("_tidemark_won", F.lit(0))).alias(out))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_docs, target) from rows (source, size).

    Sources in order of code points, null last, weigh 1, 2, 3 in turn and share all words by weight; none gets
    more than MOST_REPEATS times its own size, and what is over goes to the others by weight. That is the fill
    level L with targets min(cap, L * weight) that uses all words.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    src = src.withColumn("weight", (F.row_number().over(everything) - 1) % 3 + 1).withColumn("cap", F.col("source_size") * MOST_REPEATS)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = rising.rowsBetween(Window.unboundedPreceding, -1), rising.rowsBetween(0, Window.unboundedFollowing)
    src = src.withColumns({"_tidemark_all": F.sum("source_size").over(Window.partitionBy()), "_tidemark_full": F.coalesce(F.sum("cap").over(before), F.lit(0)), "_tidemark_weights": F.sum("weight").over(after)})
    level = (F.col("_tidemark_all") - F.col("_tidemark_full")) / F.col("_tidemark_weights")
    src = src.withColumn("_tidemark_level", F.max(F.when(level <= F.col("cap") / F.col("weight"), level)).over(Window.partitionBy()))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("_tidemark_level") * F.col("weight"), F.col("cap").cast("double")))
    return src.select("source", "source_size", "n_docs", "_tidemark_all", target.alias("target"), F.row_number().over(everything).alias("place"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size_col: str = "size", block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """``docs`` (with word counts in ``size_col``) and _tidemark_source_size, _tidemark_target, _tidemark_taken: the words the mix takes of each.

    The budget, all words, is cut into blocks. Sources get blocks by Sainte-Lague on their targets, then the
    shards of a source (about the square root of its documents, so neither shards nor what is in one grow with
    the table's size) by Sainte-Lague on their words. Within a shard the documents lie in a seeded order and the
    shard's blocks are taken from the front, going round again until the quota is met; a document's last round
    may take a part of it. No document is taken over MOST_REPEATS times.

    Null sources are one source. A null id is ordered as an empty one; rows that repeat an id follow one another
    by size. Documents of no words get 0. An empty table gives an empty result. Reruns agree.
    """
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(size_col).cast("long").alias("size"))
    src = source_targets(sizes).withColumns({"_tidemark_one": F.lit(0), "seats": F.round(F.col("_tidemark_all") / block_words).cast("long"), "n_shards": F.ceil(F.sqrt("n_docs")).cast("long")})
    src = apportion(src, ["_tidemark_one"], "target", "seats", ["place"], "quota").select("source", "source_size", "target", "n_shards", "quota")
    src = materialize(src, "sources")
    shards = sizes.join(src, sizes.source.eqNullSafe(src.source)).select(src["source"], "quota", (seeded(F.col("id"), seed + "s") % F.col("n_shards")).alias("shard"), "size")
    shards = shards.groupBy("source", "quota", "shard").agg(F.sum("size").alias("words"))
    shards = apportion(shards, ["source"], "words", "quota", ["shard"], "blocks").select("source", "shard", "words", F.least(F.col("blocks") * block_words, F.col("words") * MOST_REPEATS).alias("budget"))
    shards = materialize(shards, "shards")

    src = src.select(F.col("source").alias("_tidemark_s"), F.col("source_size").alias("_tidemark_source_size"), F.col("target").alias("_tidemark_target"), F.col("n_shards").alias("_tidemark_n_shards"))
    shards = shards.select(F.col("source").alias("_tidemark_s2"), F.col("shard").alias("_tidemark_h"), F.col("words").alias("_tidemark_words"), F.col("budget").alias("_tidemark_budget"))
    placed = docs.join(src, docs[source_col].eqNullSafe(src._tidemark_s)).withColumn("_tidemark_shard", seeded(F.col(id_col), seed + "s") % F.col("_tidemark_n_shards"))
    placed = placed.join(shards, placed["_tidemark_s"].eqNullSafe(shards._tidemark_s2) & (placed["_tidemark_shard"] == shards._tidemark_h))
    size = F.col(size_col).cast("long")
    row = Window.partitionBy("_tidemark_s", "_tidemark_shard").orderBy(seeded(F.col(id_col), seed + "d"), F.col(id_col), size).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_tidemark_before", F.coalesce(F.sum(size).over(row), F.lit(0)))
    rounds = F.when(F.col("_tidemark_words") > 0, F.floor(F.col("_tidemark_budget") / F.col("_tidemark_words"))).otherwise(F.lit(0)).cast("long")
    placed = placed.withColumn("_tidemark_rounds", rounds).withColumn("_tidemark_rest", F.col("_tidemark_budget") - F.col("_tidemark_rounds") * F.col("_tidemark_words"))
    part = F.greatest(F.lit(0), F.least(size, F.col("_tidemark_rest") - F.col("_tidemark_before")))
    return placed.select(*[placed[c] for c in docs.columns], "_tidemark_source_size", "_tidemark_target", (F.col("_tidemark_rounds") * size + part).cast("long").alias("_tidemark_taken"))


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of each document, sizes in words."""
    slim = materialize(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    return mix(slim).select("doc_id", "size", F.col("_tidemark_source_size").alias("source_size"), F.col("_tidemark_target").alias("target"), F.col("_tidemark_taken").alias("taken"))


def mixed_documents(docs: DataFrame, text_col: str = "text", n_chars_col: str = "n_chars") -> DataFrame:
    """The mix itself, with the columns of ``docs``: a row for each time a document is taken.

    A document taken in part gives one more row, whose text ends after the words taken (n_chars follows). Columns
    that begin with ``_tidemark_`` are reserved; any other name may occur.
    """
    sized = docs.withColumn("_tidemark_size", n_words(F.col(text_col)))
    out = mix(sized, size_col="_tidemark_size").where("_tidemark_taken > 0").withColumn("_tidemark_part", F.col("_tidemark_taken") % F.col("_tidemark_size"))
    copies = F.array_repeat(F.lit(0).cast("long"), F.floor(F.col("_tidemark_taken") / F.col("_tidemark_size")).cast("int"))
    out = out.withColumn("_tidemark_cut", F.explode(F.concat(copies, F.when(F.col("_tidemark_part") > 0, F.array("_tidemark_part")).otherwise(F.array().cast("array<bigint>")))))
    pieces = F.split(text_col, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    lead = F.col(text_col).rlike(f"^{SPACE}").cast("int")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_tidemark_cut").cast("int") + lead), "")
    text = F.when(F.col("_tidemark_cut") > 0, cut).otherwise(F.col(text_col))
    made = {text_col: text}
    if n_chars_col in docs.columns:
        made[n_chars_col] = F.when(F.col("_tidemark_cut") > 0, F.length(cut).cast(docs.schema[n_chars_col].dataType)).otherwise(F.col(n_chars_col))
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in docs.columns])


SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}s|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hs,
    ('0x' || substr(md5('{SEED}d|' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS hd
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) AS n_docs FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM s0),
s2 AS (SELECT *, (place - 1) % 3 + 1 AS weight, {MOST_REPEATS} * source_size AS cap FROM s1),
s3 AS (SELECT *, sum(source_size) OVER ()::DOUBLE AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS full_caps,
    sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS weights FROM s2),
s4 AS (SELECT *, max(CASE WHEN (total - full_caps) / weights <= cap / weight THEN (total - full_caps) / weights END) OVER () AS level FROM s3),
s5 AS (SELECT source, source_size, total, place, ceil(sqrt(n_docs))::BIGINT AS n_shards, least(cap::DOUBLE, coalesce(level * weight, cap::DOUBLE)) AS target FROM s4),
t AS (SELECT place, target, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, place, k) AS r, round(total / {BLOCK_WORDS})::BIGINT AS seats
  FROM s5, LATERAL (SELECT unnest(generate_series(0, (target / {BLOCK_WORDS})::BIGINT + (SELECT count(*) FROM s5) + 1)) AS k) WHERE target > 0),
q AS (SELECT place, count(*) AS quota FROM t WHERE r <= seats GROUP BY place),
src AS (SELECT s5.*, coalesce(quota, 0) AS quota FROM s5 LEFT JOIN q USING (place)),
h0 AS (SELECT src.place, src.quota, d.hs % src.n_shards AS shard, sum(size)::BIGINT AS words FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source GROUP BY ALL),
h1 AS (SELECT *, sum(words) OVER (PARTITION BY place) AS all_words, count(*) OVER (PARTITION BY place) AS n FROM h0),
u AS (SELECT place, shard, quota, row_number() OVER (PARTITION BY place ORDER BY words / (2 * k + 1) DESC, shard, k) AS r
  FROM h1, LATERAL (SELECT unnest(generate_series(0, (words * quota / all_words)::BIGINT + n + 1)) AS k) WHERE words > 0),
v AS (SELECT place, shard, count(*) AS blocks FROM u WHERE r <= quota GROUP BY place, shard),
h AS (SELECT h0.place, h0.shard, words, least(coalesce(blocks, 0) * {BLOCK_WORDS}, words * {MOST_REPEATS}) AS budget FROM h0 LEFT JOIN v USING (place, shard)),
p AS (SELECT d.doc_id, d.size, src.source_size, src.target, h.words, h.budget,
    coalesce(sum(d.size) OVER (PARTITION BY h.place, h.shard ORDER BY d.hd, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source JOIN h ON h.place = src.place AND h.shard = d.hs % src.n_shards)
SELECT doc_id, size, source_size, target,
  (CASE WHEN words > 0 THEN budget // words ELSE 0 END * size
   + greatest(0, least(size, budget - CASE WHEN words > 0 THEN budget // words ELSE 0 END * words - before)))::BIGINT AS taken
FROM p
"""
