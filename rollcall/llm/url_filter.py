"""Which pages to take by their URL: rules first, a logistic regression for all others.

Features are hashed runs of 3 to 5 characters of the host and of the path.  A model is
trained by gradient descent on a small labelled table: one row holds the examples and, turned
round, the examples each feature is in, and one nested ``aggregate`` goes over it, so an
epoch costs as much as the table has features.  The weights, at most ``BUCKETS`` numbers, are
a scalar subquery to the query over the pages.  That query is one projection: no shuffle, no
join, and every character of a URL is looked at a fixed number of times.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rollcall.session import materialize

BUCKETS = 1 << 14
WIDTHS = (3, 4, 5)
EPOCHS, RATE, DECAY = 150, 4.0, 1e-4
# Training takes this many labelled rows; of more, those of the smallest hashes.
MOST_LABELLED = 4096

# (verdict, host, start of the path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# Hosts of the labelled table: what they offer is told by their names.
BLOCKED = (
    "casino-win online-casino poker-bets free-bets sports-bets cheap-pills pills-shop spam-farm link-farm "
    "adult-x adult-cams xxx-tube ads-track ad-clicks click-bait free-iphone win-prizes payday-loans replica-watch crack-keys "
    "lottery-win bonus-spins diet-pills escort-x track-pixel"
).split()
ALLOWED = (
    "ththre thering nationtion wiki news library museum science weather recipes "
    "gardening history school-board city-council thther blog tiontion ththan archive sports "
    "theatre thesis theory theses travel"
).split()


def labelled_urls(spark: SparkSession) -> DataFrame:
    """A labelled table (url, label) for hosts of plain names: 1 is to be blocked.

    Both labels have the same domains, languages and paths, so only names tell them apart.
    """
    rows = []
    for label, names in ((1, BLOCKED), (0, ALLOWED)):
        for k, name in enumerate(names):
            before = ("", "www.", "blog.", "m.")[k % 4]
            domain = ("example.com", "example.org", "example.net")[k % 3]
            lang, end = ("en", "de", "fr", "es")[k % 4], ("", "/", ".html", "#top", "?page=2")[k % 5]
            rows.append((f"https://{before}{name}.{domain}/{lang}/{100 + 37 * k}{end}", label))
    return spark.createDataFrame(rows, "url string, label int")


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to the path, query or fragment; A-Z in lower case."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^([^/?#]*)", 1))
    return F.translate(F.coalesce(rest, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """What follows the host up to the query or fragment."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.regexp_extract(F.substring(url, at + 3, F.length(url)), r"^[^/?#]*([^?#]*)", 1))
    return F.coalesce(rest, F.lit(""))


def runs(text: Column, salt: int) -> Column:
    """Buckets of all runs of ``WIDTHS`` characters of ``^text$``."""
    framed = F.concat(F.lit("^"), text, F.lit("$"))

    def of_width(letters: Column, width: int) -> Column:
        def bucket(at: Column) -> Column:
            return F.pmod(F.xxhash64(F.lit(salt), *[F.get(letters, at + k) for k in range(width)]), F.lit(BUCKETS)).cast("int")

        starts = F.when(F.size(letters) >= width, F.sequence(F.lit(0), F.size(letters) - width))
        return F.coalesce(F.transform(starts, bucket), F.array().cast("array<int>"))

    # Characters as an array, bound once: a run is picked by its places, whatever its distance from the start.
    return F.transform(F.array(F.split(framed, "")), lambda letters: F.concat(*[of_width(letters, w) for w in WIDTHS]))[0]


def features(host_part: Column, path_part: Column) -> Column:
    """Distinct buckets of a URL; none if both parts are empty."""
    found = F.array_distinct(F.concat(runs(host_part, 1), runs(path_part, 2)))
    return F.when((host_part == "") & (path_part == ""), F.array().cast("array<int>")).otherwise(found)


def train(labelled: DataFrame) -> DataFrame:
    """One row (weights array<double> by bucket, bias) from ``labelled`` (url, label 0 or 1).

    Rows without a URL or label, or with a label that is neither, are left out.  Without any
    usable row all weights are 0.  Of more than ``MOST_LABELLED`` rows those of the smallest
    hashes are taken: the bound of what one task holds.
    """
    own = labelled.where("url is not null and label in (0, 1)").orderBy(F.xxhash64("url", "label"), "url", "label").limit(MOST_LABELLED)
    own = own.select(F.col("label").cast("double").alias("y"), features(host(F.col("url")), path(F.col("url"))).alias("buckets"))
    own = own.where(F.size("buckets") > 0)
    examples = own.agg(F.sort_array(F.collect_list(F.struct("y", "buckets"))).alias("examples"))
    examples = materialize(examples, "url-examples")
    # The same examples by feature: feature j of the list is in the examples ``inverse[j]``.
    placed = examples.select(F.posexplode("examples").alias("i", "x")).select("i", F.explode("x.buckets").alias("bucket"))
    inverse = placed.groupBy("bucket").agg(F.sort_array(F.collect_list("i")).alias("inside"))
    inverse = inverse.agg(F.sort_array(F.collect_list(F.struct("bucket", "inside"))).alias("inverse"))
    place = "transform(x.buckets, b -> array_position(buckets, b) - 1)"
    whole = examples.join(inverse).select(  # one row each
        F.expr("transform(examples, x -> struct(x.y as y, 1 / sqrt(size(x.buckets)) as scale, x.buckets as buckets))").alias("examples"),
        F.expr("transform(inverse, f -> f.bucket)").alias("buckets"),
        F.expr("transform(inverse, f -> f.inside)").alias("inverse"),
    )
    whole = whole.withColumn("examples", F.expr(f"transform(examples, x -> struct(x.y as y, x.scale as scale, {place} as js))"))
    score = "s.bias + x.scale * aggregate(x.js, 0D, (t, j) -> t + s.w[j])"
    errors = f"transform(examples, x -> x.y - 1 / (1 + exp(-({score}))))"
    slope = "aggregate(inside, 0D, (t, i) -> t + err[i] * examples[i].scale) / size(examples)"
    step = f"""
        element_at(transform(array({errors}), err -> struct(
            zip_with(s.w, inverse, (w, inside) -> w + {RATE} * ({slope} - {DECAY} * w)) as w,
            s.bias + {RATE} * aggregate(err, 0D, (t, e) -> t + e) / size(examples) as bias)), 1)"""
    start = "struct(cast(array_repeat(0D, size(inverse)) as array<double>) as w, 0D as bias)"
    fitted = materialize(whole, "url-training").select("buckets", F.expr(f"aggregate(sequence(1, {EPOCHS}), {start}, (s, epoch) -> if(size(examples) = 0, s, {step}))").alias("s"))
    by_bucket = fitted.select(F.explode(F.arrays_zip("buckets", F.col("s.w").alias("w"))).alias("f")).select("f.buckets", "f.w")
    every = fitted.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("buckets")).join(by_bucket, "buckets", "left")
    every = every.agg(F.sort_array(F.collect_list(F.struct("buckets", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("all"))
    return materialize(every.join(fitted.select("s.bias")).select(F.expr("transform(all, f -> f.w)").alias("weights"), "bias"), "url-model")


def fits(host_part: Column, path_part: Column, rule_host: str, rule_path: str) -> Column:
    """The rule's host or one below it, and a path that starts with the rule's."""
    return (F.endswith(F.concat(F.lit("."), host_part), F.lit("." + rule_host))) & F.startswith(path_part, F.lit(rule_path))


def first_rule(host_part: Column, path_part: Column, rules: Sequence[tuple[str, str, str]], pick) -> Column:
    """``pick`` of the longest rule that fits (of equally long ones, that of the longer host), or null."""
    longest = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r))
    cases = [F.when(fits(host_part, path_part, r[1], r[2]), F.lit(pick(r))) for r in longest]
    return F.coalesce(*cases) if cases else F.lit(None).cast("string")


def judge(pages: DataFrame, model: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule, score and verdict (allow or block); columns of these names are replaced.

    ``rules`` (verdict, host, path) are written by hand, so they are part of the query.
    A null URL, or one without ``://``, has neither host nor path: the method has nothing to
    hold against it, its score is 0 and it is allowed.  All rows stay, repeated ones too.
    """
    own = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    h, p = F.col("host"), F.col("path")
    own = own.withColumns({
        "rule": first_rule(h, p, rules, lambda r: r[1] + r[2]),
        "_said": first_rule(h, p, rules, lambda r: r[0]),
        "_buckets": features(h, p),
    })
    own = own.withColumns({"_weights": model.select("weights").scalar(), "_bias": model.select("bias").scalar()})
    total = F.expr("aggregate(_buckets, 0D, (t, b) -> t + _weights[b]) / sqrt(size(_buckets)) + _bias")
    own = own.withColumn("score", F.when(F.size("_buckets") > 0, 1 / (1 + F.exp(-total))).otherwise(0.0))
    by_method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return own.withColumn("verdict", F.coalesce("_said", by_method)).drop("_said", "_buckets", "_weights", "_bias")
