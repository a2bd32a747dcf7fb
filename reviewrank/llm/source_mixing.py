"""Sources mixed to target weights: whole copies of documents plus one drawn by a hash.

Words are added up per source; weights and the words wanted give every source a target, and target over words is the
rate at which its documents repeat.  A document is taken ``floor(rate)`` times, and once more if a number drawn from a
hash of the seed, its id and its text is below the fraction.  Nothing but one row per source is ever ordered or shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewrank.functions.prefix import Ordered
from reviewrank.llm.common import own_columns
from reviewrank.session import cut_lineage

WEIGHTS = (3, 1, 2)  # of the sources in the order of their names, over and over
SHARE = 1.5  # words wanted, as a share of all words
MOST = 2.0  # times a source may be repeated at most
SEED = 13
_DIGITS = 13  # hexadecimal digits of a draw: 52 bits


def words(text: Column | str) -> Column:
    """Runs without ASCII white space in a text (null: none)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def draw(doc_id: Column | str, text: Column | str, seed: int = SEED) -> Column:
    """A number in [0, 1) that follows from the seed, the id and the text; nulls count as absent."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(doc_id).cast("string"), F.md5(text)))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, target, rate)`` from ``(source, source_size)``, one row per source, null being one.

    ``share`` of all words is dealt by weight.  A target stops at ``most`` times its source's words; what is over goes to
    the others by weight, until none is above.  All targets are then the lesser of their bound and one level times the
    weight.  The level follows from running sums over the sources in the order of bound over weight, so any number of
    sources is dealt in a few passes.  If all bounds together are below the words wanted, every source is at its bound.
    """
    named = sizes.withColumns({"nameless": F.col("source").isNull(), "name": F.coalesce("source", F.lit(""))})
    ranked = Ordered(named, [], [F.col("nameless"), F.col("name")]).running(sums={"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    bound = F.col("source_size") * F.lit(float(most))
    weighed = cut_lineage(ranked.withColumns({"weight": weight, "bound": bound, "full_at": bound / weight}))
    total = weighed.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()  # one row
    upto = Ordered(weighed, [], [F.col("full_at"), F.col("nameless"), F.col("name")]).running(
        sums={"bounds": F.col("bound"), "held": F.col("weight")}
    )
    # the level if all sources before this one are at their bound and no others
    bounds, held = F.col("bounds") - F.col("bound"), F.col("held") - F.col("weight")
    level = (F.lit(float(total["words"] or 0) * share) - bounds) / (F.lit(float(total["weights"] or 0)) - held)
    found = upto.agg(F.max(F.when(level <= F.col("full_at"), level))).first()[0]
    target = F.col("bound") if found is None else F.least(F.col("bound"), F.lit(found) * F.col("weight"))
    out = weighed.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return cut_lineage(out.select("source", "source_size", "target", rate.alias("rate")))


def copies(rate: Column | str, drawn: Column | str) -> Column:
    """How often a document is taken."""
    rate, drawn = (F.col(c) if isinstance(c, str) else c for c in (rate, drawn))
    return (F.floor(rate) + (drawn < rate - F.floor(rate)).cast("long")).cast("long")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return own_columns(docs, "doc_id", "source", "text").select("doc_id", "source", words("text").alias("size"), draw("doc_id", "text", seed).alias("drawn"))


def _per_source(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def taken_words(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``; ``taken`` counts its words as often as it is taken.

    A null text is empty, a null source a source of its own (last), an empty one another.  A null ``doc_id`` leaves the draw
    to the text.  Rows equal in id and text are taken equally often.  Empty documents, and sources of such, take nothing.
    Other columns are not read; no rows give no rows.  The result is the same on every run and for any partitioning.
    """
    sized = cut_lineage(_sized(docs, seed))
    found = targets(_per_source(sized), weights, share, most).withColumnRenamed("source", "of")
    dealt = sized.join(found, F.col("source").eqNullSafe(F.col("of")))
    return dealt.select("doc_id", "size", "source_size", "target", (F.col("size") * copies("rate", "drawn")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs``, all columns, as often as it is taken, with the number of its copy from 0 as last column.

    That column is called ``copy``, with underscores in front where ``docs`` has such a name (case apart).  Texts meet the
    rates of their sources in a join and are not counted again.  Nulls, repeats and empty tables are as in
    :func:`taken_words`.  Zero-word documents are left out.
    """
    taken = {c.lower() for c in docs.columns}
    fresh = lambda name: name if name not in taken else fresh(f"_{name}")
    held, of = fresh("held"), fresh("of")
    found = targets(_per_source(_sized(docs, seed)), weights, share, most)
    found = found.where("rate > 0").select(F.col("source").alias(of), F.col("rate").alias(held))
    joined = docs.join(found, F.col("source").eqNullSafe(F.col(of)))
    often = F.when(words("text") > 0, copies(held, draw("doc_id", "text", seed))).otherwise(F.lit(0))
    kept = joined.withColumn(held, often).where(F.col(held) > 0)
    numbered = F.explode(F.sequence(F.lit(0).cast("long"), F.col(held) - 1)).alias(fresh("copy"))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns], numbered)


ORACLE_SQL = r"""
WITH sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5(concat_ws(':', '13', doc_id, md5(text))), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS drawn
    FROM documents
), summed AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
    SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight,
           1.5 * sum(source_size) OVER () AS wanted
    FROM summed
), ranked AS (
    SELECT *, sum(2.0 * source_size) OVER w AS bounds, sum(weight) OVER w AS held, sum(weight) OVER () AS weights
    FROM weighed WINDOW w AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)
), levels AS (
    SELECT *, ((wanted - bounds + 2.0 * source_size) / (weights - held + weight))::DOUBLE AS level FROM ranked
), dealt AS (
    SELECT source, source_size, least(2.0 * source_size, weight * max(CASE WHEN level <= 2.0 * source_size / weight THEN level END) OVER ())::DOUBLE AS target
    FROM levels
)
SELECT s.doc_id, s.size, d.source_size, d.target,
       coalesce(s.size * (floor(target / source_size) + CASE WHEN drawn < target / source_size - floor(target / source_size) THEN 1 ELSE 0 END)::BIGINT, 0) AS taken
FROM sized s JOIN dealt d ON s.source IS NOT DISTINCT FROM d.source
"""
