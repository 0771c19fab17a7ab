"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate: its target share of the output over its share of the input, times
``epochs``.  A document's uniform number comes from the md5 of (seed, id, text digest, nothing else), so a rerun or
a lost executor gives the same copies; inverting the Poisson distribution of its source's rate at that number gives
how often the document is repeated.  Copies are exploded and dealt out by a hash of (seed, id, copy): a global
shuffle in one exchange, sorted by that hash within each partition.

Scale: sizes by source are partial sums; the table of sources (rate and cumulative distribution) is joined back by
broadcast only while it has at most ``broadcast_sources`` rows; beyond that it is an ordinary join with the hot
sources dealt over ``salts`` keys.  Copies of a hot source spread evenly, as the shuffle key is a hash.

Defined results: sources without a target weight (or with weight 0) are left out; a null source is a source of its
own, which only a weight by ``exponent`` reaches; null or empty texts are documents like any other; rows alike in id
and text get equal counts; an empty table gives no rows; columns of any other names are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

#: Mantissa digits of the uniform numbers: 13 hexadecimal digits are 52 bits.
_HEX, _BITS = 13, 52


def uniform(*parts: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of the parts, exact in double precision up to the half step."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, _HEX), 16, 10).cast("double") + 0.5) / float(1 << _BITS)


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k from 0 until the rest is below 2**-53; terms in logarithms, so that large rates don't underflow."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    steps = F.transform(F.sequence(F.lit(1), last), lambda k: F.ln(rate / k))
    start = F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("cdf"))
    made = F.aggregate(
        steps,
        start,
        lambda a, x: F.struct((a["log"] + x).alias("log"), F.array_append(a["cdf"], F.element_at(a["cdf"], -1) + F.exp(a["log"] + x)).alias("cdf")),
    )
    return made["cdf"]


def rates(docs: DataFrame, weights: dict[str, float] | None = None, *, source: str = "source", exponent: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``source, n_docs, rate, cdf``: one row per source that takes part.

    weights: target share by source (any scale); None: shares in proportion to n_docs ** exponent.  Two sums, over
    the sources, come to the driver.
    """
    sizes = docs.groupBy(docs[source].alias("source")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        sized = sizes.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(float(exponent))))
    else:
        given = F.lit(None).cast("double")
        for name, weight in weights.items():
            given = F.when(F.col("source") == name, F.lit(float(weight))).otherwise(given)
        sized = sizes.withColumn("weight", given)
    sums = sized.agg(F.sum(F.when(F.col("weight") > 0, F.col("weight"))).alias("weight"), F.sum("n_docs").alias("n_docs")).first()
    scale = epochs * (sums["n_docs"] or 0) / (sums["weight"] or 1.0)
    rated = sized.where("weight > 0").withColumn("rate", F.lit(float(scale)) * F.col("weight") / F.col("n_docs"))
    return rated.select("source", "n_docs", "rate", poisson_cdf(F.col("rate")).alias("cdf"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    *,
    source: str = "source",
    doc_id: str = "doc_id",
    text: str = "text",
    exponent: float = 0.5,
    epochs: float = 1.0,
    seed: int = 17,
    broadcast_sources: int = 10_000,
    salts: int = 64,
    copy: str = "copy",
    shuffle_key: str = "shuffle_key",
) -> DataFrame:
    """docs, each row as often as drawn, in a globally shuffled order; with ``copy`` (from 1) and ``shuffle_key``.

    The two names can be chosen; a column of docs that is called so gives way.
    """
    docs = docs.select(*[c for c in docs.columns if c.lower() not in (copy.lower(), shuffle_key.lower())])
    of, cdf, digest, salt, deal, u, n = (unused(docs, x) for x in ("mix_source", "mix_cdf", "mix_digest", "mix_salt", "mix_deal", "mix_u", "mix_n"))
    plan = rates(docs, weights, source=source, exponent=exponent, epochs=epochs).select(F.col("source").alias(of), F.col("cdf").alias(cdf))
    keyed = docs.withColumn(digest, F.md5(F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")))
    if plan.limit(broadcast_sources + 1).count() <= broadcast_sources:
        rated = keyed.join(F.broadcast(plan), F.col(source).eqNullSafe(F.col(of)))
    else:
        salted = plan.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        dealt = keyed.withColumn(deal, F.pmod(F.xxhash64(digest, doc_id), F.lit(salts)).cast("int"))
        rated = dealt.join(salted, (F.col(deal) == F.col(salt)) & F.col(source).eqNullSafe(F.col(of))).drop(deal, salt)
    drawn = rated.withColumn(u, uniform(F.col(doc_id), F.col(digest), seed=seed))
    times = F.size(F.filter(cdf, lambda c: c <= F.col(u)))
    copies = drawn.withColumn(n, times).where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), digest, copy).cast("binary"))
    dealt = copies.withColumn(shuffle_key, key).select(*docs.columns, copy, shuffle_key)
    return dealt.repartition(F.col(shuffle_key)).sortWithinPartitions(shuffle_key)
