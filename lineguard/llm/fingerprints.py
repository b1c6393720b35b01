"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A text is a bag of lower-cased words weighted by how often each occurs. For each sample k a word of weight w draws,
from its hash alone, r and c ~ Gamma(2, 1) and b ~ Uniform(0, 1), and gets

    t = floor(ln w / r + b),    ln a = ln c - r (t - b + 1).

The word of least a is the sample. Two texts get the same least a with the probability of their
generalised Jaccard similarity (sum of minima over sum of maxima of the weights). The value
itself names word and t, so its hash is what the signature keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lineguard.llm.common import stage

#: The standard error of a likeness is at most 0.5 / sqrt(SAMPLES).
SAMPLES = 32
#: Hex digits that each sample has in a fingerprint.
DIGITS = 8
#: Rows of one window task when documents are put in order, and most ranges that they are cut into: the cuts pass
#: through the driver. Neither changes a result.
ORDERED_ROWS = 4_000
MOST_RANGES = 16_384


def terms(text: Column) -> Column:
    """The words of a text, hashed and sorted so that equal ones stand together.

    White space and punctuation part words; at the ends of a text they leave an empty word, which counts like
    any other, so an empty text has one term.
    """
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\s\p{Punct}]+")
    return F.sort_array(F.transform(words, lambda w: F.xxhash64(w)))


def _drawn(term: Column, log_weight: Column, k: int) -> Column:
    """ln a of sample *k*. A Gamma(2, 1) number is minus the logarithm of a product of two uniform ones."""
    first, second = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    uniform = lambda h, low, n: (F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << n) - 1)) + F.lit(0.5)) * F.lit(2.0**-n)
    r = -F.ln(uniform(first, 0, 21) * uniform(first, 21, 21))
    b = uniform(first, 42, 22)
    log_c = F.ln(-F.ln(uniform(second, 0, 32) * uniform(second, 32, 32)))
    return log_c - r * (F.floor(log_weight / r + b) - b + 1)


def signatures(texts: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """*keys* and ``signature`` (an array of *samples* longs) of each row; *keys* together must name rows uniquely.

    One row per distinct word is made and folded at once into its text's minima, so what is shuffled is one
    short row per text.
    """
    sorted_terms = texts.select(*keys, terms(F.col(text_col)).alias("terms"))
    starts = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    runs = sorted_terms.select(*keys, "terms", starts.alias("starts"))
    counted = F.transform(
        "starts",
        lambda s, i: F.struct(
            F.get("terms", s).alias("term"),
            (F.coalesce(F.get("starts", i + 1), F.size("terms")) - s).cast("double").alias("weight"),
        ),
    )
    rows = runs.select(*keys, F.explode(counted).alias("w")).select(*keys, "w.term", F.ln("w.weight").alias("log_weight"))
    least = rows.groupBy(*keys).agg(*[F.min(_drawn(F.col("term"), F.col("log_weight"), k)).alias(f"m{k}") for k in range(samples)])
    return least.select(*keys, F.array(*[F.xxhash64(f"m{k}") for k in range(samples)]).alias("signature"))


def as_text(signature: Column) -> Column:
    """Equal-length hex of the samples, in order."""
    return F.array_join(F.transform(signature, lambda s: F.lower(F.substring(F.lpad(F.hex(s), 16, "0"), 1, DIGITS))), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples, 0 to 1, that two fingerprints have in common."""
    part = lambda s, k: F.substring(s, k * DIGITS + 1, DIGITS)
    return sum((part(a, k) == part(b, k)).cast("int") for k in range(samples)) / F.lit(float(samples))


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``place``, ``next_place`` (longs), ``doc_id``, ``text`` and ``next_text`` of each document by ascending id.

    The table is cut at ids into ranges of about ``ORDERED_ROWS`` rows, each ordered on its own; the document after
    the last of a range is the first of the next, and after the very last comes the first. Null ids come first;
    rows that share an id are ordered by their texts.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    n = rows.count()
    ranges = min(MOST_RANGES, max(1, -(-n // ORDERED_ROWS)))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("c")).first()["c"] if ranges > 1 else []
    cuts = sorted(set(cuts or []))
    coarse = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + coarse] for i in range(0, len(cuts), coarse)]
    if cuts:  # a cut belongs to the range that it starts; two levels keep the search short
        heads = F.array(*[F.lit(b[0]).cast("long") for b in blocks])
        inner = F.array(*[F.array(*[F.lit(c).cast("long") for c in b]) for b in blocks])
        block = F.size(F.filter(heads, lambda h: h <= F.col("doc_id")))
        within = F.size(F.filter(F.get(inner, block - 1), lambda h: h <= F.col("doc_id")))
        spot = F.when(F.col("doc_id").isNull() | (block == 0), 0).otherwise((block - 1) * coarse + within)
    else:
        spot = F.lit(0)
    by = Window.partitionBy("range").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    placed = rows.withColumn("range", spot.cast("long")).withColumns(
        {"nth": F.row_number().over(by), "follower": F.lead("text").over(by)}
    )
    spots = rows.select(F.min(spot).cast("long").alias("low"), F.max(spot).cast("long").alias("high")).first()
    low, high = spots["low"] or 0, spots["high"] or 0  # every range from the first cut on holds that cut, so none is empty between
    before = F.when(F.col("range") == low, F.lit(high)).when(F.col("range") == max(low, 0) + 1, F.lit(low)).otherwise(F.col("range") - 1)
    heads = placed.where(F.col("nth") == 1).select(before.alias("range"), F.col("text").alias("head"), F.col("range").alias("head_range"))
    joined = placed.join(heads, "range", "left")
    last = F.col("follower").isNull()
    at = lambda r, n: F.shiftleft(r, 32) + n
    return joined.select(
        at(F.col("range"), F.col("nth")).alias("place"),
        F.when(last, at(F.col("head_range"), F.lit(1))).otherwise(at(F.col("range"), F.col("nth") + 1)).alias("next_place"),
        "doc_id",
        "text",
        F.coalesce("follower", "head").alias("next_text"),
    )


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """The fingerprint of each document, of its edited text, and how alike they and the next document are.

    The edited text has the last half of the code points (rounded down) replaced by as many from the
    start of the next document, or all of it. Null texts count as empty; an empty text has the fingerprint of the
    single term 0, equal for all of them; the only document of a table is its own next; an empty
    table gives an empty result; repeated rows stay.
    """
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.substring("next_text", F.lit(1), half))
    rows = ordered(docs, id_col, text_col).select("place", "next_place", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    both = F.explode(F.array(F.struct(F.lit(0).alias("edit"), F.col("text").alias("body")), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("body"))))
    each = rows.select("place", "next_place", "doc_id", "n_chars", both.alias("v")).select("place", "next_place", "doc_id", "n_chars", "v.edit", "v.body")
    each = each.withColumn("sha256", F.when(F.col("edit") == 1, F.sha2("body", 256)))
    made = signatures(each, ["place", "next_place", "doc_id", "n_chars", "edit", "sha256"], "body", samples)
    made = stage(made.withColumn("print", as_text(F.col("signature"))).drop("signature"), "fingerprints")
    own = made.where("edit = 0").drop("edit", "sha256")
    changed = made.where("edit = 1").select("place", F.col("sha256").alias("edited_sha256"), F.col("print").alias("edited_fingerprint"))
    follower = own.select(F.col("place").alias("next_place"), F.col("print").alias("next_print"))
    return own.join(changed, "place").join(follower, "next_place").select(
        F.col("doc_id").alias(id_col),
        "n_chars",
        "edited_sha256",
        F.col("print").alias("fingerprint"),
        "edited_fingerprint",
        likeness(F.col("print"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("print"), F.col("next_print"), samples).alias("near_next"),
    )
