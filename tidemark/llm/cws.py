"""Document fingerprints by consistent weighted sampling; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, SPACE, UPPER, materialize, text_key

SAMPLES = 32
#: Bits of a component, and the component of a text without terms.
BITS = 24
NOTHING = (1 << BITS) - 1


def _uniform(h: Column, skip: int, bits: int) -> Column:
    """A number strictly between 0 and 1 from ``bits`` bits of a hash, after the lowest ``skip``."""
    return (F.shiftrightunsigned(h, skip).bitwiseAND(F.lit((1 << bits) - 1)) + 0.5) / (1 << bits)


def sample(term: Column, weight: Column, k: int) -> Column:
    """Sample k of a weighted term: its rank in the high bits of a long, what identifies it in the low BITS.

    With r and c drawn from Gamma(2, 1) and b from [0, 1) by hashes of (term, k), let t = floor(ln w / r + b),
    ln y = r (t - b) and ln a = ln c - ln y - r. The term with the smallest a is drawn, with its t; two weighted
    sets draw the same pair with a probability equal to their generalised Jaccard similarity.
    """
    h1, h2 = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r, b = -F.ln(_uniform(h1, 0, 21) * _uniform(h1, 21, 21)), _uniform(h1, 42, 21)
    ln_c = F.ln(-F.ln(_uniform(h2, 0, 31) * _uniform(h2, 31, 31)))
    t = F.floor(F.ln(weight) / r + b)
    ln_a = ln_c - r * (t - b) - r  # within 100 of zero for any weight below 2**31
    rank = F.floor((ln_a + 128) * (1 << 30))
    mark = F.shiftrightunsigned(h2, 20).bitwiseXOR(t * 0x9E3779).bitwiseAND(F.lit(NOTHING))
    return F.shiftleft(rank, BITS).bitwiseOR(mark)


def signatures(weights: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """(*keys, c0, c1, ...) from rows (*keys, term long, weight): each sample's smallest long for each key."""
    return weights.groupBy(*keys).agg(*[F.min(sample(F.col("term"), F.col("weight"), k)).alias(f"c{k}") for k in range(samples)])


KEY = ["has_id", "id", "text_key"]


def likeness(a: list[Column], b: list[Column]) -> Column:
    """The share of equal components of two fingerprints."""
    same = [F.when(x == y, 1).otherwise(0) for x, y in zip(a, b, strict=True)]
    return sum(same[1:], same[0]) / F.lit(float(len(same)))


def hexed(parts: list[Column]) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(p)), BITS // 4, "0") for p in parts])


def next_rows(keys: DataFrame) -> DataFrame:
    """Each row of ``keys`` (KEY and n_chars) with that of the next and the previous in order of KEY, in a ring.

    Rows are dealt to ranges of the order; within a range neighbours come from a window, and only the first and
    last row of each range meet in one task.
    """
    n = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = materialize(keys.repartitionByRange(n, *KEY).withColumn("part", F.spark_partition_id()), "ranges")
    me = F.struct(*KEY, "n_chars")
    ends = ranged.groupBy("part").agg(F.min(me).alias("first"), F.max(me).alias("last"))
    ring, whole = Window.orderBy("part"), Window.partitionBy()
    ends = ends.select(
        F.col("part").alias("p"),
        F.coalesce(F.lead("first").over(ring), F.min(F.struct("part", "first")).over(whole)["first"]).alias("after"),
        F.coalesce(F.lag("last").over(ring), F.max(F.struct("part", "last")).over(whole)["last"]).alias("before"),
    )
    own = Window.partitionBy("part").orderBy(*KEY)
    linked = ranged.withColumns({"_next": F.lead(me).over(own), "_prev": F.lag(me).over(own)}).join(ends, F.col("part") == F.col("p"))
    return linked.select(*KEY, "n_chars", F.coalesce("_next", "after").alias("next"), F.coalesce("_prev", "before").alias("prev"))


def _of(struct: str) -> list[Column]:
    return [F.col(f"{struct}.{k}").alias(k) for k in KEY]


def _edited(rows: DataFrame, order: DataFrame) -> DataFrame:
    """(KEY, text, edited): the last quarter of each text replaced by the head of the next one's."""
    lent = rows.join(order.select(*KEY, "prev"), KEY)
    lent = lent.select(*_of("prev"), F.expr("substring(text, 1, cast(floor(prev.n_chars / 4) as int))").alias("tail"))
    edited = F.expr("concat(substring(text, 1, length(text) - cast(floor(length(text) / 4) as int)), tail)")
    return rows.join(lent, KEY).withColumn("edited", edited)


def _weights(both: DataFrame) -> DataFrame:
    """(KEY, side, term, weight) of both texts: side 1 or 2, or 0 for a term of equal weight in both.

    The two texts begin alike; the words that end before the edit are split and counted once.
    """
    whole = r"^[^\x20\x09-\x0D]*"
    cut = F.expr("length(text) - cast(floor(length(text) / 4) as int)")
    begin = both.withColumn("cut", cut).withColumn("cut", F.col("cut") - F.length(F.regexp_extract(F.reverse(F.expr("left(text, cut)")), whole, 0)))
    parts = [F.expr("left(text, cut)"), F.expr("substring(text, cut + 1)"), F.expr("substring(edited, cut + 1)")]
    low = [F.split(F.translate(x, UPPER, LOWER), SPACE) for x in parts]
    listed = begin.select(*KEY, F.size(low[0]).alias("n"), (F.size(low[0]) + F.size(low[1])).alias("m"), F.concat(*low).alias("words"))
    # the outer form, as the other one has its input evaluated twice
    words = listed.select(*KEY, "n", "m", F.posexplode_outer("words").alias("at", "word")).where("word != ''")
    in_text, in_edited = F.col("at") < F.col("m"), (F.col("at") < F.col("n")) | (F.col("at") >= F.col("m"))
    words = words.select(*KEY, F.xxhash64("word").alias("term"), in_text.cast("int").alias("a"), in_edited.cast("int").alias("b"))
    counts = words.groupBy(*KEY, "term").agg(F.sum("a").cast("double").alias("a"), F.sum("b").cast("double").alias("b"))
    part = F.explode(F.when(F.col("a") == F.col("b"), F.array(F.lit(0))).when(F.col("a") == 0, F.array(F.lit(2))).when(F.col("b") == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))))
    return counts.select(*KEY, "term", "a", "b", part.alias("side")).select(*KEY, "side", "term", F.when(F.col("side") == 2, F.col("b")).otherwise(F.col("a")).alias("weight"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every text.

    Terms are words with A-Z lower-cased, weighted by how often they occur. The edited text has its last quarter
    of code points replaced by the first as many (or all) of the next document by id; the last is followed by
    the first, a single document by itself. Null counts as empty; a text without words has a fingerprint of its
    own, so two such are alike by 1. Rows that repeat id and text are one document and each get its result; rows
    with one id and several texts follow one another by a hash of the text, null ids come first. An empty table
    gives an empty result.
    """
    id_ = F.col(id_col)
    blank = F.lit(0).cast(docs.schema[id_col].dataType)
    rows = docs.select(id_.isNotNull().cast("int").alias("has_id"), F.coalesce(id_, blank).alias("id"), text_key(F.col(text_col)).alias("text_key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sizes = rows.select(*KEY, F.length("text").cast("long").alias("n_chars"))
    order = materialize(next_rows(sizes.distinct()), "order")
    repeats = not sizes.groupBy(*KEY).count().where("count > 1").isEmpty()
    both = _edited(rows.dropDuplicates(KEY) if repeats else rows, order)

    drawn = signatures(_weights(both), [*KEY, "side"], samples)
    names = range(samples)
    least = [F.min(F.when(F.col("side") != 2, F.col(f"c{k}"))).alias(f"t{k}") for k in names]
    least += [F.min(F.when(F.col("side") != 1, F.col(f"c{k}"))).alias(f"e{k}") for k in names]
    drawn = drawn.groupBy(*KEY).agg(*least)

    def marks(kind: str) -> Column:
        return F.array(*[F.coalesce(F.col(f"{kind}{k}").bitwiseAND(F.lit(NOTHING)), F.lit(NOTHING)).cast("int") for k in names])

    hashed = both.select(*KEY, F.sha2("edited", 256).alias("edited_sha256"))
    prints = hashed.join(drawn, KEY, "left").select(*KEY, "edited_sha256", marks("t").alias("own"), marks("e").alias("changed"))
    prints = materialize(prints, "prints")

    after = prints.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("own").alias("after"))
    full = order.select(*KEY, "n_chars", "next").join(prints, KEY)
    full = full.join(after, [F.col(f"next.{k}") == F.col(f"_{k}") for k in KEY])
    own, changed, after = ([F.element_at(c, k + 1) for k in names] for c in ("own", "changed", "after"))
    result = full.select(
        *KEY,
        "n_chars",
        "edited_sha256",
        hexed(own).alias("fingerprint"),
        hexed(changed).alias("edited_fingerprint"),
        likeness(own, changed).alias("near_edited"),
        likeness(own, after).alias("near_next"),
    )
    if repeats:
        result = sizes.select(*KEY).join(result, KEY)
    return result.withColumn("doc_id", F.when(F.col("has_id") == 1, F.col("id"))).select("doc_id", *result.columns[len(KEY) :])
