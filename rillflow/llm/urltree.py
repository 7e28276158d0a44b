"""URL filters: fixed host and path rules first, then a path-template tree per host.

Each URL's path is a branch of its host's tree. Segments vary in two ways that become wildcards: by
form (runs of digits, long hexadecimal) and by number (a node with many children, of which a segment holds only a small
share). The tree is built level by level, so that the children of wildcards come together and become wildcards in turn. A
branch at any depth whose rate of good labels does not differ from its siblings' by a two-proportion test, or that has no
labels, is merged with them and takes its parent's purity; any other has (good + a * above) / (labelled + a), where ``above`` is its
parent's purity, and for a host the rate of all labels. A template is rejected when its purity is below a threshold. URLs are first counted by (host, path by form), so later steps work on counts, and the verdict goes
back to rows by a join that no host or path, however common, can skew.

Defined cases: null URLs, and those without ``://``, have an empty host and path, match no rule and are judged as
the template of that empty host; hosts compare without regard to A-Z case; missing or null labels count as
unlabelled; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import skewless_left_join, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_KIDS = 8
SMALL_SHARE = 0.1
WEIGHT = 5.0
MIN_PURITY = 0.5
Z = 1.96

#: (action, host, path): a rule fits its host and all subdomains where the path starts with its path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its action; null where none does."""
    name = verdict = None
    for action, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, F.lit(h + p)) if name is None else name.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(action)) if verdict is None else verdict.when(fits, F.lit(action))
    return name, verdict


def form(path: Column) -> Column:
    """A path by form: long hexadecimal and runs of digits are wildcards."""
    return F.regexp_replace(F.regexp_replace(path, r"(?<=[/_.-])(?=[0-9a-f]*[0-9])[0-9a-f]{8,}(?=[/_.-]|$)", "{h}"), "[0-9]+", "{n}")


def templates(counted: DataFrame) -> DataFrame:
    """host, form and branch of each row of host, form, n: rare children of nodes with many children are wildcards.

    branch: the segments from the root, each after a slash; empty without a path. One round a level, until no node
    has more than MAX_KIDS paths, and so no more children, below it.
    """
    x = counted.select("host", "form", "n", F.slice(F.split("form", "/"), 2, 1 << 30).alias("segs"), F.lit("").alias("above"))
    depth = 0
    while True:
        x = x.withColumn("seg", F.get("segs", F.lit(depth)))
        kids = stored(x.filter("seg is not null").groupBy("host", "above", "seg").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("__n")), "url-kids")
        nodes = stored(kids.groupBy("host", "above").agg(F.sum("n").alias("all"), F.count(F.lit(1)).alias("kids"), F.sum("__n").alias("rows")), "url-nodes")
        most, total = nodes.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        if most <= MAX_KIDS:
            break
        many = nodes.filter(F.col("kids") > MAX_KIDS).select("host", "above", "all", F.col("kids").alias("__n"))
        rare = skewless_left_join(kids.withColumnRenamed("__n", "rows"), many, ["host", "above"], "__n", total)
        rare = stored(rare.filter(F.col("n") < SMALL_SHARE * F.col("all")).select("host", "above", "seg", F.lit(True).alias("rare"), F.col("rows").alias("__n")), "url-rare")
        marked = skewless_left_join(x, rare, ["host", "above", "seg"], "__n", total)
        step = F.concat("above", F.lit("/"), F.when(F.col("rare"), "*").otherwise(F.col("seg")))
        x = stored(marked.select("host", "form", "n", "segs", F.coalesce(step, "above").alias("above")), "url-level")
        depth += 1
    rest = F.slice("segs", depth + 1, 1 << 30)
    return x.select("host", "form", F.concat("above", F.when(F.size(rest) > 0, F.concat(F.lit("/"), F.array_join(rest, "/"))).otherwise("")).alias("branch"))


def purities(leaves: DataFrame, base: float, weight: float) -> DataFrame:
    """host, branch, purity and __n (rows) of each branch that a path ends in. leaves: host, branch, labelled, n_good."""
    per = stored(leaves.groupBy("host", "branch").agg(F.sum("labelled").alias("labelled"), F.sum("n_good").alias("n_good"), F.count(F.lit(1)).alias("__n")), "url-branches")
    parts = F.split("branch", "/")
    steps = per.select("host", "branch", "labelled", "n_good", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("depth"))
    steps = steps.withColumn("node", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    # The root of a host without a path in it, and its child of an empty segment, differ by depth.
    nodes = stored(steps.groupBy("host", "depth", "node").agg(F.sum("labelled").alias("labelled"), F.sum("n_good").alias("n_good"), F.count(F.lit(1)).alias("__n")), "url-tree")
    parent = F.array_join(F.slice(F.split("node", "/"), 1, F.col("depth") - 1), "/")
    above = nodes.select("host", (F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("labelled").alias("p_labelled"), F.col("n_good").alias("p_good"))
    # A node has few children: those that are not rare.
    x = nodes.withColumn("parent", F.when(F.col("depth") > 1, parent)).join(above, ["host", "depth", "parent"], "left")
    pooled = F.try_divide(F.col("p_good") + weight * base, F.col("p_labelled") + F.lit(weight))
    own = F.try_divide(F.col("n_good").cast("double"), F.col("labelled").cast("double"))
    rest = F.try_divide((F.col("p_good") - F.col("n_good")).cast("double"), (F.col("p_labelled") - F.col("labelled")).cast("double"))
    error = F.sqrt(pooled * (1 - pooled) * (F.try_divide(F.lit(1.0), F.col("labelled")) + F.try_divide(F.lit(1.0), F.col("p_labelled") - F.col("labelled"))))
    alike = (F.col("depth") > 1) & F.coalesce(F.abs(own - rest) <= Z * error, F.lit(True))
    known = stored(x.select("host", "depth", "node", alike.alias("alike"), F.col("labelled").alias("of"), F.col("n_good").alias("good"), "__n"), "url-nodes-judged")
    lined = skewless_left_join(steps.select("host", "branch", "depth", "node"), known, ["host", "depth", "node"], "__n", steps.count())
    one = F.array_sort(F.collect_list(F.struct("depth", "alike", "of", "good")))
    folded = F.aggregate(one, F.lit(float(base)), lambda above, s: F.when(s["alike"], above).otherwise((s["good"] + weight * above) / (s["of"] + F.lit(weight))))
    return per.select("host", "branch", "__n").join(lined.groupBy("host", "branch").agg(folded.alias("purity")), ["host", "branch"])


def verdicts(urls: DataFrame, weight: float = WEIGHT, min_purity: float = MIN_PURITY) -> DataFrame:
    """host, form, template, purity, verdict and n of each path by form. urls: host, path, good (true, false or null)."""
    counted = stored(urls.select("host", form(F.col("path")).alias("form"), "good").groupBy("host", "form").agg(
        F.count(F.lit(1)).alias("n"), F.count("good").alias("labelled"), F.coalesce(F.sum(F.col("good").cast("int")), F.lit(0)).alias("n_good")), "url-counts")
    labelled, good = counted.agg(F.coalesce(F.sum("labelled"), F.lit(0)), F.coalesce(F.sum("n_good"), F.lit(0))).first()
    base = (good + 1) / (labelled + 2)
    leaves = stored(counted.join(templates(counted.select("host", "form", "n")), ["host", "form"]), "url-templates")
    judged = purities(leaves, base, weight).withColumn("verdict", F.when(F.col("purity") < min_purity, "block").otherwise("allow"))
    full = skewless_left_join(leaves.select("host", "form", "branch", "n"), stored(judged, "url-judged"), ["host", "branch"], "__n", leaves.count())
    return full.select("host", "form", F.expr("substring(branch, 2)").alias("template"), "purity", "verdict", "n")


def judge(pages: DataFrame, labels: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity of every row. labels: page_id, good."""
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    x = stored(x, "url-pages")
    known = labels.groupBy(F.col("page_id").alias("__id")).agg(F.min("good").alias("good"))
    marked = x.join(known, x["page_id"] == F.col("__id"), "left").drop("__id")
    rows = stored(verdicts(marked), "url-verdicts")
    total = x.count()
    got = skewless_left_join(x.withColumn("form", form(F.col("path"))), rows, ["host", "form"], "n", total)
    name, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    return got.select("page_id", "host", "path", name.alias("rule"), F.coalesce(by_rule, F.col("verdict")).alias("verdict"), "template", "purity")
