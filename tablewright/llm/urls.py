"""URL filters: a tree of path templates for each host, generalised, merged and rejected by smoothed labelled purity.

Everything after the first pass works on counts of distinct path shapes, so a host with a third of all pages is a few rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, written

# The base rules, (host and its subdomains + beginning of the path) -> verdict.
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Where a node has more different children than this, those with less than their equal share of its pages are values of a variable segment, if their labels are alike.
MAX_CHILDREN = 20
#: Branches whose shares of good pages differ by fewer standard errors than this from their siblings' are merged.
SIMILAR = 1.96
#: A template is rejected when its share of good pages, smoothed by STRENGTH pages of the overall share, is below this.
PURITY, STRENGTH = 0.5, 10.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ://, and for null."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    own = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(own, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.regexp_extract(own, pattern, 2)


def rule(host: Column, path: Column, rules: dict[str, str] = RULES) -> Column:
    """The longest rule that fits, or null."""
    fits = []
    for r in sorted(rules, key=lambda r: (-len(r), r)):
        h, slash, p = r.partition("/")
        fits.append(F.when(((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(slash + p)), F.lit(r)))
    return F.coalesce(*fits)


def _segments(path: Column) -> Column:
    """The segments of a path, as many as it has; one with a digit is variable (*)."""
    return F.transform(F.array_remove(F.split(path, "/"), ""), lambda x: F.when(F.regexp_like(x, F.lit("[0-9]")), F.lit("*")).otherwise(x))


def shapes(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """host, segments, n, good, seen: a row for each distinct shape, with its pages, its good pages and its labelled ones."""
    host, path = parts(F.col("url"))
    own = pages.select("page_id", host.alias("host"), _segments(path).alias("segments"))
    marks = labelled.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max(F.col("bad").cast("int")).alias("bad"))
    both = own.join(marks, "page_id", "left")
    return both.groupBy("host", "segments").agg(F.count("*").alias("n"), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0)).alias("good"), F.count("bad").alias("seen"))


def _alike(g: str, k: str, all_g: str, all_k: str) -> Column:
    """Whether g good of k labelled pages are a share like that of the others of all_g and all_k. A side without labels is alike, and so are sides of one kind."""
    rest_g, rest_k, pool = F.col(all_g) - F.col(g), F.col(all_k) - F.col(k), F.try_divide(all_g, all_k)
    gap = F.abs(F.try_divide(g, k) - F.try_divide(rest_g, rest_k))
    error = F.sqrt(pool * (1 - pool) * (F.try_divide(F.lit(1), F.col(k)) + F.try_divide(F.lit(1), rest_k)))
    return F.coalesce(gap < SIMILAR * error, F.lit(True)) | (F.col(all_g) == 0) | (F.col(all_g) == F.col(all_k))


def _with_star(level: int) -> Column:
    """t with its segment of a level replaced by *."""
    return F.transform("t", lambda x, i: F.when(i == level, F.lit("*")).otherwise(x))


def templates(counted: DataFrame) -> DataFrame:
    """host, segments (of a shape), t (its template), t_good, t_seen and purity (of the template), for each row of shapes().

    Level by level from the root, as deep as two shapes have a way in common, the rare ones of too many children of a node
    become * where their labels are like those of the other rare ones; then, from the deepest such level up, siblings alike
    in their labels become * together. Nodes without labels are alike.
    """
    tree, level = counted.select("*", F.col("segments").alias("t"), F.lit(True).alias("open")), 0
    while True:
        # the ways to this level that shapes have in common; a shape that is alone on its way has no siblings further down
        own = tree.where(F.col("open") & (F.size("t") > level)).withColumn("way", F.slice("t", 1, level)).withColumn("child", F.get("t", F.lit(level)))
        children = own.groupBy("host", "way", "child").agg(F.sum("n").alias("c"), F.sum("good").alias("g"), F.sum("seen").alias("k"), F.count("*").alias("shapes"))
        nodes = children.groupBy("host", "way").agg(F.count("*").alias("kinds"), F.sum("c").alias("all"), F.sum("shapes").alias("shapes")).where("shapes > 1")
        nodes = written(nodes, "nodes")
        if nodes.isEmpty():
            break
        rare = children.drop("shapes").join(nodes.where(F.col("kinds") > MAX_CHILDREN).drop("shapes"), ["host", "way"]).where(F.col("c") * MAX_CHILDREN < F.col("all"))
        around = rare.groupBy("host", "way").agg(F.sum("g").alias("ag"), F.sum("k").alias("ak"))
        gone = rare.join(around, ["host", "way"]).where(_alike("g", "k", "ag", "ak")).select("host", "way", "child", F.lit(True).alias("gone"))
        both = tree.withColumn("way", F.slice("t", 1, level)).withColumn("child", F.get("t", F.lit(level)))
        both = both.join(nodes.select("host", "way", F.lit(True).alias("shared")), ["host", "way"], "left").join(gone, ["host", "way", "child"], "left")
        still = F.col("open") & F.col("shared").isNotNull() & (F.size("t") > level)
        both = both.select("host", "segments", "n", "good", "seen", F.when(F.col("gone") & still, _with_star(level)).otherwise(F.col("t")).alias("t"), still.alias("open"))
        tree, level = written(both, "generalised"), level + 1
    for i in reversed(range(level)):
        nodes = tree.where(F.size("t") > i).groupBy("host", "t").agg(F.sum("good").alias("g"), F.sum("seen").alias("k")).withColumn("others", _with_star(i))
        around = nodes.groupBy("host", "others").agg(F.sum("g").alias("ag"), F.sum("k").alias("ak"), F.count("*").alias("kinds")).where("kinds > 1")
        merged = nodes.join(around, ["host", "others"]).where(_alike("g", "k", "ag", "ak")).select("host", "t", F.lit(True).alias("merged"))
        tree = written(tree.join(merged, ["host", "t"], "left").withColumn("t", F.when(F.col("merged"), _with_star(i)).otherwise(F.col("t"))).drop("merged"), "templates")
    good, seen = tree.agg(F.sum("good"), F.sum("seen")).first()
    prior = good / seen if seen else 1.0
    nodes = tree.groupBy("host", "t").agg(F.sum("good").alias("t_good"), F.sum("seen").alias("t_seen"))
    return tree.select("host", "segments", "t").join(nodes.withColumn("purity", (F.col("t_good") + STRENGTH * prior) / (F.col("t_seen") + STRENGTH)), ["host", "t"])


def judged(pages: DataFrame, labelled: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """A row for each of pages (page_id, url): page_id, host, path, rule, verdict, template, purity.

    labelled (page_id, bad boolean): pages known to be bad or good; a page marked both ways counts as bad. The verdict is
    the rule's; without one, a template below PURITY is blocked. A null url, or one without ://, has an empty host and
    path, and such pages share a template. Without labels nothing is blocked but by rules. Rows with a null or repeated
    page_id are judged each; a label counts for all rows of its id. Other columns are left out.
    """
    host, path = parts(F.col("url"))
    own = pages.select("page_id", host.alias("host"), path.alias("path"), _segments(path).alias("segments"))
    tree = written(templates(written(shapes(pages, labelled), "shapes")), "tree")
    both = own.join(small(tree), ["host", "segments"]).withColumn("rule", rule(F.col("host"), F.col("path"), rules))
    by_rule = reduce(lambda c, r: c.when(F.col("rule") == r, F.lit(rules[r])), rules, F)
    verdict = F.coalesce(by_rule, F.when(F.col("purity") < PURITY, F.lit("block")).otherwise(F.lit("allow")))
    return both.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.concat_ws("/", "host", "t").alias("template"), "purity")


def labels_by_number(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """page_id, bad: the labels (doc_id, quality, toxic) of the document whose id is the last number in a page's path; bad if of poor quality or toxic."""
    number = F.regexp_extract(parts(F.col("url"))[1], r"([0-9]{1,18})[^0-9/]*/*$", 1)
    own = pages.select("page_id", F.try_to_number(number, F.lit("9" * 18)).cast("long").alias("doc_id")).where("doc_id IS NOT NULL")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))).cast("int")).alias("bad"))
    return own.join(marks, "doc_id").select("page_id", (F.col("bad") == 1).alias("bad"))
