"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source has a target share; its mean repetition rate is share * budget / bytes of the source. A document's number of
copies is the inverse of the Poisson distribution with that mean at a uniform number taken from a seeded hash of its id,
so runs repeat, and any part of the corpus can be mixed alone. A mean above MOST_RATE is cut into equal parts of at most
that, each drawn at a number of its own, and their sum is again Poisson: rates have no bound, distributions do. Documents are exploded by their counts and dealt out by a
second seeded hash: the row's partition and its place there are random, which shuffles globally without a sample.

Per source only (bytes, rate, distribution) is kept: partial aggregation makes it, and it is broadcast when the counted
sources are at most BROADCAST_SOURCES, else joined by (source, salt), so that a source with a third of all rows is split.

Rates are rounded to RATE_DIGITS significant digits, so that they don't hang on the order of a sum.

Defined results: a null source is a source of its own; null text is empty; a document weighs its UTF-8 bytes plus 1;
rows that repeat an id get the same count, rows with a null id are hashed by their text; an empty table gives an empty
table; a source without a given weight gets none and its documents no copy. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import free_name, plain, stored

SEED, TEMPERATURE, EPOCHS = 17, 0.5, 1.0
#: A source's row holds its distribution, some 50 to MOST_RATE * 9 bytes; so many of them are broadcast at most.
BROADCAST_SOURCES, SALTS = 10_000, 64
#: The highest mean of a single draw; higher rates are sums of draws.
MOST_RATE = 1000.0
RATE_DIGITS = 12
#: Copies are exploded in blocks of so many, so that no array grows with the rate.
BLOCK = 10_000


def uniform(key: Column) -> Column:
    """52 bits of the key's md5 as a number in [0, 1)."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, source_col: str, text_col: str, weights: DataFrame | None, temperature: float, epochs: float) -> DataFrame:
    """Per source: src, bytes, rate, parts, cdf (of a part's draw). weights: (source, weight), or bytes ** temperature where it is None."""
    size = F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + F.lit(1)
    per = docs.groupBy(F.col(source_col).alias("src")).agg(F.sum(size.cast("long")).alias("bytes"))
    if weights is None:
        per = per.withColumn("w", F.pow(F.col("bytes").cast("double"), F.lit(float(temperature))))
    else:
        given = weights.select(F.col(weights.columns[0]).alias("s"), F.col(weights.columns[1]).cast("double").alias("w"))
        per = per.join(given, F.col("src").eqNullSafe(F.col("s"))).drop("s").where("w > 0")
    per = stored(per, "mix-sources")
    total, all_w = per.agg(F.sum("bytes"), F.sum("w")).first()  # two numbers
    exact = F.lit(float(epochs) * float(total or 0)) * F.col("w") / F.lit(float(all_w or 1)) / F.col("bytes")
    rate = F.format_string(f"%.{RATE_DIGITS - 1}e", exact).cast("double")
    parts, mean = F.ceil(F.col("rate") / F.lit(MOST_RATE)), F.col("rate") / F.col("parts")
    last = F.ceil(F.lit(30) + F.col("mean") + 12 * F.sqrt("mean")).cast("int")
    zero = F.struct(F.array(F.exp(-F.col("mean"))).alias("cdf"), (-F.col("mean")).alias("lp"))
    step = lambda a, k: F.struct(F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + F.exp(a["lp"] + F.ln("mean") - F.ln(k)))).alias("cdf"), (a["lp"] + F.ln("mean") - F.ln(k)).alias("lp"))
    cdf = F.aggregate(F.sequence(F.lit(1), last), zero, lambda a, k: step(a, k.cast("double")), lambda a: a["cdf"])
    return per.select("src", "bytes", rate.alias("rate")).where("rate > 0").withColumn("parts", parts).withColumn("mean", mean).withColumn("cdf", cdf).drop("mean")


def mix(docs: DataFrame, weights: DataFrame | None = None, *, temperature: float = TEMPERATURE, epochs: float = EPOCHS, seed: int = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """docs, each as often as drawn, in random order, with n_copies, copy (from 1), rate and mix_key (names get _ if taken)."""
    n_copies, copy, rate, mix_key = (free_name(docs.columns, x) for x in ("n_copies", "copy", "rate", "mix_key"))
    given, name = plain(docs)
    own, doc_id, source, text = [*name.values()], name[id_col], name[source_col], name[text_col]
    table = stored(rates(given, source, text, weights, temperature, epochs), "mix-rates")
    inner = given.withColumn("key", F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    sources, high = table.agg(F.count("*"), F.coalesce(F.max("parts"), F.lit(1))).first()
    if sources <= BROADCAST_SOURCES:
        inner = inner.join(F.broadcast(table), inner[source].eqNullSafe(table["src"]))
    else:
        spread = table.withColumn("own_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        inner = inner.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        inner = inner.join(spread, (F.col("salt") == F.col("own_salt")) & inner[source].eqNullSafe(spread["src"]))
    drawn = inner.select(*own, "key", "rate", "parts", "cdf", uniform(F.concat(F.lit(f"{seed}:"), F.col("key"))).alias("u"))
    below = lambda u: F.size(F.filter("cdf", lambda c: c <= u))
    n = below(F.col("u"))
    if high > 1:
        # A row holds one number for each part, a thousandth of the copies that it is repeated to.
        part = lambda k: uniform(F.concat(F.lit(f"{seed}#"), k.cast("string"), F.lit(":"), F.col("key")))
        ordinals = F.when(F.col("parts") > 1, F.sequence(F.lit(2).cast("long"), F.greatest("parts", F.lit(2)))).otherwise(F.array().cast("array<bigint>"))
        more = F.aggregate(F.transform(ordinals, part), F.lit(0).cast("long"), lambda a, u: a + below(u))
        n = (n + more).cast("int")
    counted = drawn.withColumn("n", n).drop("cdf", "u", "parts").where("n > 0")
    if high > 1:
        counted = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int"))))
        first = F.col("block") * BLOCK + 1
        each = counted.withColumn("copy", F.explode(F.sequence(first, F.least(F.col("n"), first + (BLOCK - 1)))))
    else:
        each = counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    keyed = each.withColumn("mix", F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.col("key"), F.lit("/"), F.col("copy").cast("string"))), 1, 16))
    out = keyed.repartition("mix").sortWithinPartitions("mix")
    return out.select(*[F.col(c).alias(x) for x, c in name.items()], F.col("n").alias(n_copies), F.col("copy").alias(copy), F.col("rate").alias(rate), F.col("mix").alias(mix_key))
