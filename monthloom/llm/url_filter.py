"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams for the rest.

Everything runs as DataFrame expressions and Spark's own classifier; there is
no Python on the executors.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import table

GRAMS = (3, 4, 5)
FEATURES = 1 << 16
REGULARIZATION = 1e-3
#: Rules go into the plan, so their number is bounded; more belong into a table that is joined.
MOST_RULES = 10_000

# Words of hosts that people block and of hosts that they visit.
BLOCKED_WORDS = "adult ads bets bonus cams casino cheap clicks crack dating escort farm free gambling hack jackpot keygen loans lottery meds phish pills poker porn replica sex slots spam spyware torrent track viagra warez win xxx x".split()
VISITED_WORDS = "action archive author bakery bank bread bridge brother century church city doctor earth east education father fishing garden gather gold heart heating history hotel house island journal kitchen leather library market mother motion mountain museum nation news north ocean orchard other painting people portion press radio reading recipe river school science season shore south sport station stone story street study teacher theatre theory thesis thing thread thunder tradition travel university village water weather west winter wood world writing".split()


def _of_hosts() -> list[tuple[str, int]]:
    """Hosts that tell: single words and neighbouring pairs, in turn under the same prefixes, domains and paths."""
    out = []
    for words, block, steps in ((BLOCKED_WORDS, 1, (0, 1, 3, 7, 11)), (VISITED_WORDS, 0, (0, 1, 5))):
        names = [w if not step else f"{w}-{words[(i + step) % len(words)]}" for step in steps for i, w in enumerate(words)]
        for i, name in enumerate(names):
            prefix, domain = ("", "www.", "m.", "blog.")[i % 4], ("com", "net", "org")[i % 3]
            place = (f"/en/{i}", f"/fr/{i}.html", f"/de/{i}/", f"/es/{i}?page=2", f"/en/{i}#top")[i % 5]
            out.append((f"https://{prefix}{name}.example.{domain}{place}", block))
    return out


def _of_paths() -> list[tuple[str, int]]:
    """Paths that tell, on hosts that don't: words of either list in turn in the same places of the same paths."""
    out = []
    for words, block in ((BLOCKED_WORDS, 1), (VISITED_WORDS, 0)):
        for step in (0, 2, 5):
            for i, word in enumerate(words):
                other, neutral = words[(i + step) % len(words)], VISITED_WORDS[(7 * i + step) % len(VISITED_WORDS)]
                host_ = (f"www.{neutral}.io", f"{neutral}.co.uk", f"my{neutral}.info", f"{neutral}{i}.dev:8080", f"user.{neutral}.net")[i % 5]
                place = (f"/{word}/", f"/{word}-{other}.html", f"/2020/05/{word}/{other}", f"/shop/{other}/{word}?id={i}", f"/tag/{word}#a", f"/a_{word}/{i}")[(i + step) % 6]
                out.append((f"http://{host_}{place}", block))
    return out


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table, ``(url, 1 for block)``: URLs whose host tells, and URLs whose path does."""
    return _of_hosts() + _of_paths()


#: Rules as (host and path, verdict).  Fixed values of the contract.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: str = "url") -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; empty for null and others."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and others."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _grams(text: Column, mark: str) -> Column:
    def of(n: int) -> Column:
        begins = F.sequence(F.lit(1), F.length(text) - n + 1)
        return F.when(F.length(text) >= n, F.transform(begins, lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))

    return F.concat(*map(of, GRAMS))


def url_grams(host_: str, path_: str) -> Column:
    """Character n-grams of host and path, told apart, with digits alike."""
    where = F.regexp_replace(F.col(path_), "[0-9]+", "0")
    return F.concat(_grams(F.concat(F.lit("^"), F.col(host_), F.lit("$")), "h:"), _grams(where, "p:"))


def train(spark: SparkSession, labelled: list[tuple[str, int]] | DataFrame | None = None) -> PipelineModel:
    """The classifier of a small table ``(url, block)``; ``labelled_urls()`` by default."""
    rows = labelled if isinstance(labelled, DataFrame) else spark.createDataFrame(labelled or labelled_urls(), "url string, block int")
    rows = rows.where("block IS NOT NULL").select(host().alias("__ml_host"), path().alias("__ml_path"), F.col("block").cast("double").alias("__ml_label"))
    rows = rows.coalesce(1).withColumn("__ml_grams", url_grams("__ml_host", "__ml_path"))
    hashed = HashingTF(inputCol="__ml_grams", outputCol="__ml_features", numFeatures=FEATURES, binary=True)
    fit = LogisticRegression(featuresCol="__ml_features", labelCol="__ml_label", predictionCol="__ml_block", probabilityCol="__ml_p", rawPredictionCol="__ml_raw", regParam=REGULARIZATION, standardization=False, maxIter=100)
    return PipelineModel([hashed, fit.fit(hashed.transform(rows))])


def rule_of(rules: list[tuple[str, str]], host_: str, path_: str) -> Column:
    """The longest rule that fits, as a struct of its text and verdict; null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Of equally long rules the first by code point is taken.
    """
    if len(rules) > MOST_RULES:
        raise ValueError("join the rules as a table")
    by_host: dict[str, list[tuple[str, str]]] = {}
    for text, verdict in rules:
        by_host.setdefault(text.partition("/")[0], []).append((text, verdict))
    kind = "array<struct<size:int,text:string,path:string,verdict:string>>"
    if not by_host:
        return F.lit(None).cast("struct<text:string,verdict:string>")
    entries = []
    for name, some in sorted(by_host.items()):
        rows = [F.struct(F.lit(-len(t)).alias("size"), F.lit(t).alias("text"), F.lit(t[len(name) :]).alias("path"), F.lit(v).alias("verdict")) for t, v in some]
        entries += [F.lit(name), F.array(*rows).cast(kind)]
    table_ = F.create_map(*entries)
    labels = F.split(F.col(host_), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.flatten(F.transform(suffixes, lambda s: F.coalesce(F.try_element_at(table_, s), F.array().cast(kind)))), lambda r: F.startswith(F.col(path_), r["path"]))
    best = F.array_min(fitting)
    return F.when(best.isNotNull(), F.struct(best["text"].alias("text"), best["verdict"].alias("verdict")))


def judged(pages: DataFrame, model: PipelineModel, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``pages`` with host, path, rule, verdict (allow or block) and block_chance.

    Where a rule fits, its verdict holds; elsewhere the classifier's does, from
    one half on.  Null and odd URLs have an empty host and path and are judged
    by the classifier.  Columns of these names are replaced.
    """
    rest = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict", "block_chance")]
    named = pages.select(*rest, host().alias("__ml_host"), path().alias("__ml_path"))
    named = named.withColumn("__ml_grams", url_grams("__ml_host", "__ml_path")).withColumn("__ml_rule", rule_of(rules, "__ml_host", "__ml_path"))
    scored = model.transform(named)
    own = F.when(F.col("__ml_block") == 1, "block").otherwise("allow")
    return scored.select(*rest, F.col("__ml_host").alias("host"), F.col("__ml_path").alias("path"), F.col("__ml_rule.text").alias("rule"), F.coalesce("__ml_rule.verdict", own).alias("verdict"), vector_to_array("__ml_p")[1].alias("block_chance"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "pages").select("page_id", "url"), train(spark))
    return rows.select("page_id", "host", "path", "rule", "verdict", "block_chance")
