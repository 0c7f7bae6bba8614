"""URL filter: allow and block rules, and gradient-boosted trees for the URLs that no rule decides.

Everything is DataFrame functions, and the trees are Spark ML's. Features are lexical: lengths, depth,
digit ratio, character entropy, parameter counts, and for three suffixes of the host (its last label,
last two and last three) and the first path segment the smoothed share of blocked URLs and their
number, gathered from all labelled URLs by grouped aggregation. Trees are fitted on all distinct labelled URLs.
A hash halves them, and in training each half has the shares of the other; every URL is judged, by the
shares of all.

Labels come as a table (url, blocked). Where none is given, they come from what is behind the URLs: a page
counts as blocked if its visible text is poor (see poor()), so the trees learn which addresses lead to
poor pages. Rules are policy about places, so they are no labels. A URL is blocked if its score is at
least LIFT times the mean score of the training rows, or 0.5: bad pages are rare, so what stands out
among addresses stays below 0.5.

Null URLs, and those without "://", have an empty host and path and fit no rule; the trees judge them
as empty. Without labelled URLs of both kinds, the one kind there is (else allow) is the verdict. Null labels,
and pages without markup, are left out; a URL labelled both ways, or of several pages, counts once, as blocked
if any label says so. Repeated rows get equal verdicts. Empty tables give empty tables. A very long URL or
page costs time in proportion. Columns named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsloom.llm.common import read, stored

RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))
TREES, DEPTH = 12, 4
#: Weight of the overall share in a suffix's share, in URLs.
PRIOR = 20.0
#: White space between words.
WORD_GAP = "[\\x20\\x09-\\x0D]+"
SUFFIXES = ("label", "domain", "site", "segment")
#: How far above the training rows' mean a score blocks.
LIFT = 1.5
#: A page's visible text is poor with fewer words, a greater share of symbols, a smaller share of distinct words,
#: or words that are shorter or longer on average.
LEAST_WORDS, MOST_SYMBOLS, LEAST_DISTINCT, WORD_LENGTHS = 50, 0.02, 0.3, (3.0, 10.0)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def address(pages: DataFrame, url: str = "url") -> DataFrame:
    """Add host and path, never null."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(text, "://")
    rest = F.when(at > 0, F.substr(text, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, _UPPER, _LOWER), "path": path})


def fits(rule: str) -> Column:
    domain, _, path = rule.partition("/")
    host = F.col("host")
    return ((host == domain) | host.endswith("." + domain)) & F.col("path").startswith("/" + path)


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """Add rule and ruling (allow or block) of the longest rule that fits, else null."""
    longest = sorted(rules, key=lambda r: -len(r[0]))
    none = F.lit(None).cast("string")
    return pages.withColumns({c: F.coalesce(*(F.when(fits(r[0]), F.lit(r[k])) for r in longest), none) for k, c in enumerate(("rule", "ruling"))})


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


def lexical(pages: DataFrame, url: str = "url") -> tuple[DataFrame, list[str]]:
    """Add the features that a URL alone has; their names."""
    text, host, path = F.coalesce(F.col(url), F.lit("")), F.col("host"), F.col("path")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    chars = F.split(text, "")
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    entropy = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda sum_, c: sum_ - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    made = {
        "f_length": F.length(text),
        "f_host": F.length(host),
        "f_path": F.length(path),
        "f_labels": _count(host, "."),
        "f_depth": _count(path, "/"),
        "f_digits": F.length(F.regexp_replace(text, "[^0-9]", "")) / n,
        "f_host_digits": F.length(F.regexp_replace(host, "[^0-9]", "")) / F.greatest(F.length(host), F.lit(1)),
        "f_entropy": entropy,
        "f_parameters": _count(text, "="),
        "f_joins": _count(text, "&"),
        "f_hyphens": _count(host, "-"),
        "f_fragment": _count(text, "#"),
        "f_secure": text.startswith("https:").cast("int"),
    }
    return pages.withColumns({k: v.cast("double") for k, v in made.items()}), list(made)


def suffixes(pages: DataFrame) -> DataFrame:
    """Add the host's last label, last two and last three, and the first path segment."""
    host = F.col("host")
    found = [F.substring_index(host, ".", -k) for k in (1, 2, 3)] + [F.regexp_extract("path", "^/([^/]*)", 1)]
    return pages.withColumns(dict(zip(SUFFIXES, found, strict=True)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def visible(markup: Column) -> Column:
    """What a page shows: what follows each tag, but for scripts and styles. One pass, whatever is left open."""
    pieces = F.split(markup, "<", -1)
    hidden = lambda p: F.lower(F.substring(p, 1, 6)).rlike("^(?:script|style)") | (F.instr(p, ">") == 0)
    shown = lambda p, i: F.when(i == 0, p).when(hidden(p), "").otherwise(F.substr(p, F.instr(p, ">") + 1))
    return F.array_join(F.transform(pieces, shown), " ")


def poor(markup: Column) -> Column:
    """1 if a page's visible text is poor, 0 if not, null without markup."""

    def judged(text: Column) -> Column:
        symbols = F.length(F.regexp_replace(text, "[^|#$%&*{}=_~^]", "")) / F.greatest(F.length(text), F.lit(1))
        words = F.filter(F.split(text, WORD_GAP, -1), lambda w: w != "")

        def of(w: Column) -> Column:
            n = F.greatest(F.size(w), F.lit(1))
            mean = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)) / n
            few = (F.size(w) < LEAST_WORDS) | (F.size(F.array_distinct(w)) / n < LEAST_DISTINCT)
            return few | ~let(mean, lambda m: m.between(*WORD_LENGTHS))

        return (symbols > MOST_SYMBOLS) | let(words, of)

    return F.when(markup.isNotNull() & (markup != ""), let(visible(markup), judged).cast("long"))


def suffix_statistics(labelled: DataFrame) -> dict[str, DataFrame]:
    """For each suffix: its labelled URLs and how many of them are blocked, and as many of those that aren't in
    the chosen half. A third of all URLs may share one; counts are summed before they are shuffled."""
    aside = ~F.col("chosen")
    sums = lambda k: (F.count("*").alias(f"n_{k}"), F.sum("blocked").alias(f"b_{k}"), F.count_if(aside).alias(f"on_{k}"), F.sum(F.when(aside, F.col("blocked")).otherwise(0)).alias(f"ob_{k}"))
    return {k: labelled.groupBy(k).agg(*sums(k)) for k in SUFFIXES}


def with_statistics(pages: DataFrame, statistics: dict[str, DataFrame], base: float, training: bool = False) -> tuple[DataFrame, list[str]]:
    """Add share and log number for each suffix; base: the share of all. In training, rows of
    each half (chosen or not) get those of the other half alone: a share that a row's own label is in, or was taken out
    of, gives the label away."""
    names = []
    for k, table in statistics.items():
        pages = pages.join(table, k, "left")
        n, b, on, ob = (F.coalesce(F.col(f"{c}_{k}"), F.lit(0)) for c in ("n", "b", "on", "ob"))
        if training:
            n, b = F.when(F.col("chosen"), on).otherwise(n - on), F.when(F.col("chosen"), ob).otherwise(b - ob)
        pages = pages.withColumns({f"f_rate_{k}": (b + PRIOR * base) / (n + PRIOR), f"f_log_{k}": F.log1p(n.cast("double"))})
        names += [f"f_rate_{k}", f"f_log_{k}"]
    return pages, names


@dataclass
class Filter:
    """What was learnt: trees over the named features, suffix statistics, the share of blocked URLs and the
    score from which one is blocked."""

    trees: GBTClassificationModel
    features: list[str]
    statistics: dict[str, DataFrame]
    base: float
    block_at: float

    def scored(self, pages: DataFrame) -> DataFrame:
        """Add score to pages that have features and suffixes."""
        rows, _ = with_statistics(pages, self.statistics, self.base)
        assemble = VectorAssembler(inputCols=self.features, outputCol="_features", handleInvalid="keep")
        judged = self.trees.setProbabilityCol("_probability").setRawPredictionCol("_raw").setPredictionCol("_said").transform(assemble.transform(rows))
        return judged.withColumn("score", F.element_at(vector_to_array("_probability"), 2))


def learn(labels: DataFrame) -> Filter | str:
    """From (url, blocked): a filter; with labels of one kind, or none, the verdict for all."""
    given = stored(labels.dropna().groupBy("url").agg(F.max(F.col("blocked").cast("long")).alias("blocked")), "url-given")
    labelled = stored(suffixes(address(given)).withColumn("chosen", F.pmod(F.xxhash64("url"), F.lit(2)) == 0), "url-labels")
    kinds = {r["blocked"]: r["count"] for r in labelled.groupBy("blocked").count().collect()}  # two rows at most
    if len(kinds) < 2:
        return "block" if 1 in kinds else "allow"
    total = sum(kinds.values())
    base = kinds[1] / total
    statistics = {k: stored(t, f"url-{k}") for k, t in suffix_statistics(labelled).items()}
    rows, names = lexical(labelled)
    rows, more = with_statistics(rows, statistics, base, training=True)
    assemble = VectorAssembler(inputCols=names + more, outputCol="_features", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="_features", labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=7, minInstancesPerNode=5)
    training = stored(assemble.transform(rows.withColumn("blocked", F.col("blocked").cast("double"))).select("_features", "blocked"), "url-training")
    model = trees.fit(training)
    mean = model.transform(training).agg(F.avg(F.element_at(vector_to_array("probability"), 2))).first()[0]
    return Filter(model, names + more, statistics, base, min(0.5, LIFT * mean))


def judge(pages: DataFrame, rules=RULES, url: str = "url", labels: DataFrame | None = None, markup: str | None = None) -> DataFrame:
    """pages without markup, with host, path, rule, verdict and score (the trees' probability of block; null where
    a rule decides). labels: (url, blocked); without, they come from the column markup, if there is one."""
    extra = ("host", "path", "rule", "verdict", "score", "ruling")
    kept = [c for c in pages.columns if c.lower() not in extra and c != markup]
    known = ruled(address(pages.select(*kept), url), rules)
    if labels is None:
        blocked = poor(F.col(markup)) if markup else F.lit(None).cast("long")
        labels = pages.select(F.col(url).alias("url"), blocked.alias("blocked"))
    learnt = learn(labels.select("url", "blocked"))
    output = [*kept, "host", "path", "rule", "verdict", "score"]
    if isinstance(learnt, str):
        return known.withColumns({"verdict": F.coalesce("ruling", F.lit(learnt)), "score": F.lit(None).cast("double")}).select(*output)
    rows, _ = lexical(suffixes(known), url)
    judged = learnt.scored(rows).withColumn("score", F.when(F.col("ruling").isNull(), F.col("score")))
    return judged.withColumn("verdict", F.coalesce("ruling", F.when(F.col("score") >= learnt.block_at, "block").otherwise("allow"))).select(*output)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return judge(pages, markup="html").select("page_id", "host", "path", "rule", "verdict", "score")
