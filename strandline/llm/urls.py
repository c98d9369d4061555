"""URL filter: allow and block rules, and boosted trees where no rule fits.

Everything is DataFrame expressions: features, histograms and scoring run in the
JVM, and the driver only sees histograms of nodes x features x bins. The trees
learn from labelled URLs by their lexical form.

A null URL or one without ``://`` has an empty host and path; no rule fits it
and the trees judge its features. An empty training set leaves a constant score
of one half. Repeated rows are judged alike; other columns are passed by.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from strandline.llm.sampling import least_of
from strandline.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Host suffixes fall into so many buckets, each with its share of blocked URLs.
SUFFIXES = 256


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str], what: str) -> Column:
    """The longest rule that fits, or its verdict (``what`` is "rule" or "verdict")."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        out = F.when(fits, F.lit(rule if what == "rule" else rules[rule])).otherwise(out)
    return out


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    terms = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", F.lit(0.0)).otherwise(-share(c) * F.log2(share(c))))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))


def features(urls: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` with its lexical features f0..f9 and its suffix bucket."""
    u = F.coalesce(F.col(url), F.lit(""))
    host, path = host_of(u), path_of(u)
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    named = urls.withColumns({"_u": u, "_host": host, "_path": path, "_query": query})
    real = {
        "f0": F.length("_u"), "f1": F.length("_host"), "f2": F.length("_path"),
        "f3": _count(F.col("_path"), "/"), "f4": _count(F.col("_host"), "."),
        "f5": _count(F.col("_u"), "0123456789") / F.greatest(F.length("_u"), F.lit(1)),
        "f6": entropy(F.col("_host")), "f7": _count(F.col("_query"), "=&"),
        "f8": _count(F.col("_host"), "-"), "f9": entropy(F.col("_path")),
    }
    suffix = F.pmod(F.xxhash64(F.regexp_extract("_host", r"([^.]*)$", 1)), F.lit(SUFFIXES)).cast("int")
    return named.withColumns({k: v.cast("double") for k, v in real.items()} | {"suffix": suffix}).drop("_u", "_host", "_path", "_query")


NAMES = [f"f{i}" for i in range(10)] + ["f10"]


class Trees:
    """Gradient-boosted trees as data: nested (feature, threshold, low, high) or leaf values."""

    def __init__(self, base: float, rates: list[float], trees: list):
        self.base, self.rates, self.trees = base, rates, trees

    def suffix_rate(self) -> Column:
        return F.get(F.array(*[F.lit(float(x)) for x in self.rates]), F.col("suffix"))

    def margin(self) -> Column:
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + _value(tree)
        return out

    def score(self, rows: DataFrame, name: str = "score") -> DataFrame:
        """Adds the probability of label 1."""
        return rows.withColumn("f10", self.suffix_rate()).withColumn(name, 1 / (1 + F.exp(-self.margin()))).drop("f10")


def _value(tree) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    feature, threshold, low, high = tree
    return F.when(F.col(feature) <= threshold, _value(low)).otherwise(_value(high))


def _leaves(tree, path=()):
    """Adds node numbers: each leaf is its path's bits."""
    if isinstance(tree, float):
        return F.lit(int("1" + "".join(path), 2))
    feature, threshold, low, high = tree
    return F.when(F.col(feature) <= threshold, _leaves(low, (*path, "0"))).otherwise(_leaves(high, (*path, "1")))


def fit(labelled: DataFrame, sample: int = 10_000, rounds: int = 5, depth: int = 3, bins: int = 16, rate: float = 0.4, ridge: float = 1.0, url: str = "url", label: str = "label") -> Trees:
    """Trees from (url, label 0/1). At most ``sample`` distinct URLs of either label are used
    (a URL of both labels counts as 1), those of the least hashes; histograms come from grouped sums over them."""
    scratch = Scratch(labelled.sparkSession, "urls")
    known = labelled.select(F.col(url).alias("url"), F.col(label).cast("double").alias("y")).where("y is not null").groupBy("url").agg(F.max("y").alias("y"))
    known = least_of(known.withColumn("_h", F.xxhash64("url")), "y", ["_h", "url"], sample)
    rows = scratch.put(features(known).drop("url", "_h"))
    n, positive = rows.agg(F.count("*"), F.sum("y")).first()
    if not n or positive in (0, n):
        base = 0.0 if not n else math.log((positive + 0.5) / (n - positive + 0.5))
        return Trees(base, [0.5] * SUFFIXES, [])
    mean = positive / n
    rates = [mean] * SUFFIXES
    for bucket, count, ones in rows.groupBy("suffix").agg(F.count("*"), F.sum("y")).collect():
        rates[bucket] = (ones + 10 * mean) / (count + 10)
    model = Trees(math.log(mean / (1 - mean)), rates, [])
    rows = rows.withColumn("f10", model.suffix_rate())
    cuts = rows.agg(*[F.percentile_approx(c, [i / bins for i in range(1, bins)], 10_000).alias(c) for c in NAMES]).first()
    edges = {c: sorted(set(cuts[c])) for c in NAMES}
    place = [sum((F.col(c) > e).cast("int") for e in edges[c]).alias(f"b{i}") for i, c in enumerate(NAMES)]
    # rows alike in all bins are one weighted row
    packed = scratch.put(rows.select(*NAMES, "y", *place).groupBy(*[f"b{i}" for i in range(len(NAMES))]).agg(F.sum("y").alias("ones"), F.count("*").alias("n"), *[F.min(c).alias(c) for c in NAMES]))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-model.margin()))
        stats = packed.withColumn("_p", p).withColumns({"g": F.col("n") * F.col("_p") - F.col("ones"), "h": F.col("n") * F.col("_p") * (1 - F.col("_p"))})
        tree = 0.0
        for _ in range(depth):
            pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"b{i}").alias("b")) for i in range(len(NAMES))]))
            sums = stats.select(_leaves(tree).alias("node"), "g", "h", pairs.alias("x")).groupBy("node", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            tree = _grow(tree, sums, edges, rate, ridge)
        model.trees.append(tree)
    scratch.drop(packed)
    return model


def _grow(tree, sums, edges, rate, ridge):
    """Splits each leaf where the gain is largest; ties go to the first feature and bin."""
    by: dict[int, dict[int, dict[int, tuple[float, float]]]] = {}
    for node, f, b, g, h in sums:
        by.setdefault(node, {}).setdefault(f, {})[b] = (g, h)

    def leaf(g: float, h: float) -> float:
        return round(-rate * g / (h + ridge), 9)

    def split(node: int):
        if node not in by:
            return 0.0
        total = [sum(x[i] for x in by[node][0].values()) for i in (0, 1)]
        best = (1e-6, None)
        for f, hist in sorted(by[node].items()):
            g = h = 0.0
            for b, edge in enumerate(edges[NAMES[f]]):
                dg, dh = hist.get(b, (0.0, 0.0))
                g, h = g + dg, h + dh
                rest_g, rest_h = total[0] - g, total[1] - h
                if h < 1e-3 or rest_h < 1e-3:
                    continue
                gain = round(g * g / (h + ridge) + rest_g * rest_g / (rest_h + ridge) - total[0] ** 2 / (total[1] + ridge), 6)
                if gain > best[0]:
                    best = (gain, (NAMES[f], float(edge), leaf(g, h), leaf(rest_g, rest_h)))
        return best[1] if best[1] else leaf(*total)

    def walk(t, node: int):
        return split(node) if isinstance(t, float) else (t[0], t[1], walk(t[2], 2 * node), walk(t[3], 2 * node + 1))

    return walk(tree, 1)


def judge(pages: DataFrame, rules: dict[str, str], labelled: DataFrame | None = None, **how) -> DataFrame:
    """``pages`` with host, path, rule, verdict and score (probability of block).

    Without ``labelled`` (url, label: 1 to block), the URLs that a rule decides
    are the labelled ones.
    """
    named = pages.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    named = named.withColumns({"rule": rule_of(F.col("host"), F.col("path"), rules, "rule"), "_ruled": rule_of(F.col("host"), F.col("path"), rules, "verdict")})
    if labelled is None:
        labelled = named.where("_ruled is not null").select("url", (F.col("_ruled") == "block").cast("int").alias("label"))
    scored = fit(labelled, **how).score(features(named)).drop(*NAMES[:-1], "suffix")
    return scored.withColumn("verdict", F.coalesce("_ruled", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))).drop("_ruled")
