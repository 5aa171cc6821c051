"""Document fingerprints by SpotSigs.

A spot signature is a common word (the anchor) and the chain of the next
content words after it, with other common words passed over.  Prose is full of
such spots and boilerplate has few.  A document's fingerprint is its set of
signatures, and two documents are as like as the Jaccard share of their sets.

Everything runs as DataFrame expressions; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import table

#: Content words in a chain.
CHAIN = 2
#: Rows that share a window of neighbours, about.
BUCKET_ROWS = 2000
#: Bounds between ranges, at most, as they go into the plan, and keys that are looked at for each.
MOST_BOUNDS, SAMPLED = 20_000, 20
THRESHOLD = 0.8
#: Of so many words one is an anchor at least; where fewer are, as in languages without a list here, every word is one.
ANCHOR_EVERY = 16
# Common words of English, French, German and Spanish.
ANCHORS = sorted(set((
    "a an and are as at be been but by for from had has have he her his i in is it its not of on or she that the their they this to was were which who will with would you "
    "au aux avec ce ces cette dans de des du elle en est et il ils la le les leur mais ne on ou par pas plus pour que qui sa se ses son sur un une vous "
    "als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch sich sie sind so über um und von vor war wie wird zu zum zur "
    "al como con del desde el ella en entre era es esta este fue ha hay las lo los más me mi muy no nos o para pero por se sin sobre su sus también un una y ya"
).split()))


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """The set of a text's spot signatures as sorted hashes.

    The start of a text is an anchor as well, and where it has no content words
    at all its words are one chain: every text with a word has a signature.
    Where the listed common words are rare, nothing tells which words are
    common, and each is the anchor of the words behind it.  Null and empty texts
    have no signatures.  The last chains are as long as the text allows.
    """

    def of_words(words: Column) -> Column:
        def of_content(content: Column) -> Column:
            start = F.when(F.size(words) > 0, F.array(F.concat_ws(" ", F.lit("^"), F.when(F.size(content) > 0, F.slice(content, 1, chain)).otherwise(words)))).otherwise(F.array().cast("array<string>"))
            anchors = F.filter(F.transform(words, lambda w, i: F.when(w.isin(ANCHORS), F.struct(w.alias("w"), i.alias("i")))), lambda s: s.isNotNull())
            # the k-th anchor, at word i, has i - k content words before it
            chains = F.transform(anchors, lambda s, k: F.concat_ws(" ", s["w"], F.slice(content, s["i"] - k + 1, chain)))
            every = F.transform(words, lambda w, i: F.concat_ws(" ", w, F.slice(words, i + 2, chain)))
            rare = (F.size(words) - F.size(content)) * ANCHOR_EVERY < F.size(words)
            return F.array_sort(F.array_distinct(F.transform(F.concat(start, F.when(rare, every).otherwise(chains)), lambda x: F.xxhash64(x))))

        return _let(F.filter(words, lambda w: ~w.isin(ANCHORS)), of_content)

    return _let(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)), of_words)


def fingerprint(signatures_: str) -> Column:
    """A digest of a signature set."""
    return F.md5(F.concat_ws(",", F.col(signatures_)).cast("binary"))


def likeness(a: str, b: str, at_least: float = 0.0) -> Column:
    """Jaccard share of two sets, or 0 if it is below ``at_least``; two empty sets are alike.

    Sets whose sizes alone rule the share out are not compared.
    """
    n, m = F.size(a), F.size(b)
    both = F.size(F.array_intersect(F.col(a), F.col(b)))
    share = F.when(F.greatest(n, m) == 0, F.lit(1.0)).when(F.least(n, m) < at_least * F.greatest(n, m), F.lit(0.0)).otherwise(both / (n + m - both))
    return F.when(share >= at_least, share).otherwise(0.0)


def near_duplicates(signed: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Near-duplicates of ``signed(doc_id, signatures)``: pairs ``(a, b, likeness)`` of fingerprints, and membership ``(doc_id, fingerprint)``.

    Documents with one set are one fingerprint.  Sets fall into classes of
    length whose bounds grow by 1/threshold, so that a partner is in the same or
    the next class.  Within a class, sets meet by their rarest signatures: of n
    sorted by frequency, the first n - ceil(threshold n) + 1 hold one that each
    partner has among its own.  Pairs are verified on whole sets.
    """
    keyed = signed.select("doc_id", "signatures", fingerprint("signatures").alias("fingerprint"), F.size("signatures").alias("n"))
    members = keyed.select("doc_id", "fingerprint")
    sets = keyed.where("n > 0").groupBy("fingerprint").agg(F.first("signatures").alias("signatures"), F.first("n").alias("n"))
    each = sets.select("fingerprint", "n", F.explode("signatures").alias("s"))
    frequent = each.groupBy("s").agg(F.count("*").alias("f"))
    ranked = each.join(frequent, "s").groupBy("fingerprint", "n").agg(F.array_sort(F.collect_list(F.struct("f", "s"))).alias("r"))
    rare = ranked.select("fingerprint", "n", F.floor(F.log(F.col("n").cast("double")) / -F.log(F.lit(threshold)) + 1e-9).alias("k"), F.explode(F.slice("r", 1, F.col("n") - F.ceil(threshold * F.col("n") - 1e-9).cast("int") + 1)).alias("r"))
    rare = rare.where("r.f > 1").select("fingerprint", "n", "k", F.col("r.s").alias("s"))
    small = rare.select(F.col("fingerprint").alias("a"), F.col("n").alias("m"), F.explode(F.array("k", F.col("k") + 1)).alias("k"), "s")
    pairs = rare.withColumnRenamed("fingerprint", "b").join(small, ["s", "k"]).where((F.col("m") >= threshold * F.col("n") - 1e-9) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("a") < F.col("b"))))).select("a", "b").distinct()
    left, right = (sets.select(F.col("fingerprint").alias(c), F.col("signatures").alias(f"{c}_set")) for c in "ab")
    found = pairs.join(left, "a").join(right, "b").withColumn("likeness", likeness("a_set", "b_set", threshold))
    return found.where(F.col("likeness") >= threshold).select("a", "b", "likeness"), members


def _bounds(keyed: DataFrame, bucket_rows: int) -> list[tuple]:
    """Keys ``(there, id, tie)`` that cut ``keyed`` into ranges of about ``bucket_rows`` rows; MOST_BOUNDS at most, by a sample of the keys."""
    n = keyed.count()
    wanted = min(n // bucket_rows, MOST_BOUNDS)
    if not wanted:
        return []
    share = SAMPLED * wanted / n
    keys = (keyed.sample(share, seed=7) if share < 1 else keyed).select("there", "id", "tie").toArrow()  # SAMPLED rows a bound, about
    keys = sorted(zip(*(keys[c].to_pylist() for c in ("there", "id", "tie"))))
    return sorted({keys[i * len(keys) // (wanted + 1)] for i in range(1, wanted + 1)}) if keys else []


def _number(x: int) -> str:
    return f"{x}L" if x > -(1 << 63) else f"({x + 1}L - 1L)"


def _bucket(bounds: list[tuple]) -> Column:
    """How many bounds are not above the row's key, by halving."""
    if not bounds:
        return F.lit(0)
    table_ = F.expr("array(" + ",".join(f"struct({str(there).lower()} AS there, {_number(i)} AS id, {_number(t)} AS tie)" for there, i, t in bounds) + ")")
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]

    def further(at: Column, step: Column) -> Column:
        return F.when((at + step <= len(bounds)) & (F.get(table_, at + step - 1) <= F.struct("there", "id", "tie")), at + step).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), further)


def with_next(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``docs(doc_id, text)`` with signatures, and of the next document (ascending doc_id; after the last, the first) next_text and next_signatures.

    Null texts are empty, null ids come first, and rows with one id follow each
    other by a hash of their texts.  A sample of ids and hashes cuts the order
    into ranges with about ``bucket_rows`` rows each, however the ids are
    spread and however many rows have one id or none; a window puts the rows of
    a range in order, and its last row gets the first one of the next range
    that has any.
    """
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.col("doc_id").isNotNull().alias("there"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("tie"))
    placed = keyed.withColumn("bucket", _bucket(_bounds(keyed, bucket_rows)))
    rows = placed.select("doc_id", "text", "bucket", "tie").repartition("bucket")
    order = Window.partitionBy("bucket").orderBy("doc_id", "tie")
    signed = rows.withColumn("signatures", signatures(F.col("text")))
    led = signed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in ("text", "signatures")])
    # the first row of each range, for the last one of the range before; tasks pick theirs first, so texts don't move for it
    first = F.min_by("text", F.struct("there", "id", "tie"))
    heads = placed.groupBy("bucket").agg(first.alias("head_text")).withColumn("head_signatures", signatures(F.col("head_text")))
    filled = sorted(r[0] for r in placed.select("bucket").distinct().collect())  # MOST_BOUNDS + 1 at most
    follows = docs.sparkSession.createDataFrame(list(zip(filled, filled[1:] + filled[:1])), "before int, bucket int")
    heads = follows.join(heads, "bucket").select(F.col("before").alias("bucket"), "head_text", "head_signatures")
    last = F.col("next_text").isNull()
    joined = led.withColumn("last", last).join(heads.withColumn("last", F.lit(True)), ["bucket", "last"], "left")
    return joined.select("doc_id", "text", "signatures", F.coalesce("next_text", "head_text").alias("next_text"), F.coalesce("next_signatures", "head_signatures").alias("next_signatures"))


def op7_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr(F.col("text"), F.lit(1), n - part), F.substr(F.col("next_text"), F.lit(1), part))
    rows = rows.withColumn("edited", edited).withColumn("edited_signatures", signatures(F.col("edited")))
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("signatures").alias("fingerprint"),
        fingerprint("edited_signatures").alias("edited_fingerprint"),
        likeness("signatures", "edited_signatures").alias("near_edited"),
        likeness("signatures", "next_signatures").alias("near_next"),
    )
