"""URL filter: rules by host and path; what no rule decides goes by two character language models.

Two smoothed Markov models of variable order, one of accepted and one of rejected URLs, are counted over every URL that a
rule decides. A URL's score is the mean over its characters of the difference of the log-likelihoods (accepted less
rejected); it is allowed from a threshold that is calibrated on the same URLs, half-way between the two classes' means.

DataFrame functions only. URLs are folded to the 44 symbols of ALPHABET first, so that the model has at most 44^3 rows
whatever the corpus; it is counted over all URLs with partial sums and broadcast under that bound. Each distinct folded
URL is scored once.

Null URLs and those without "://" have an empty host and path, fit no rule and are scored as the empty or whole text.
Repeated rows are kept. With no URL to learn either class from, every score and the threshold are 0: allow.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.common import ascii_lower, saved, table

#: (verdict, host, path): fits that host and its subdomains under paths that begin so; the longest that fits decides.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Pseudo-count that a context gives to the next shorter one.
WEIGHT = 4.0
ALPHABET = "^$~0abcdefghijklmnopqrstuvwxyz/.-_:?=#&%+@,;"


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; of two equally long ones, that with the longer host."""
    rule = verdict = F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def folded(url: Column) -> Column:
    """The URL from its host on, in ALPHABET, begun by two marks and ended by one."""
    s = ascii_lower(F.regexp_replace(F.coalesce(url, F.lit("")), "(?s)^.*?://", ""))
    s = F.regexp_replace(F.regexp_replace(s, "[0-9]", "0"), "[^0a-z/.\\-_:?=#&%+@,;]", "~")
    return F.concat(F.lit("^^"), s, F.lit("$"))


def grams(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s) - 2), lambda i: F.substr(s, i, F.lit(3)))


def language_model(counted: DataFrame) -> DataFrame:
    """(gram, gain) from rows (gram, yes, no): how much likelier its last symbol is after the others where accepted."""
    n = counted.select("gram", "yes", "no", F.substring("gram", 1, 2).alias("h2"), F.substring("gram", 2, 1).alias("h1"), F.substring("gram", 2, 2).alias("g2"), F.substring("gram", 3, 1).alias("g1"))
    sums = {k: n.groupBy(k).agg(F.sum("yes").alias(f"yes_{k}"), F.sum("no").alias(f"no_{k}")) for k in ("h2", "h1", "g2", "g1")}
    total = dict(zip(("yes", "no"), (x or 0 for x in counted.agg(F.sum("yes"), F.sum("no")).first())))
    if not all(total.values()):
        return counted.select("gram", F.lit(0.0).alias("gain"))
    for k, s in sums.items():
        n = n.join(F.broadcast(s), k)
    gain = F.lit(0.0)
    for side, sign in (("yes", 1), ("no", -1)):
        c = lambda k: F.col(f"{side}_{k}")  # noqa: E731, B023
        p = (c("g1") + 1.0) / (float(total[side] + len(ALPHABET)))
        p = (c("g2") + WEIGHT * p) / (c("h1") + WEIGHT)
        p = (F.col(side) + WEIGHT * p) / (c("h2") + WEIGHT)
        gain = gain + sign * F.log(p)
    return n.select("gram", gain.alias("gain"))


def judge(pages: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules=RULES) -> DataFrame:
    """keep, host, path, rule, score, threshold and verdict of each row; other columns aren't read."""
    host, path = host_of(F.col(url)), path_of(F.col(url))
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.select(*keep, host.alias("host"), path.alias("path"), folded(F.col(url)).alias("s")).withColumns({"rule": rule, "decided": decided})
    urls = rows.groupBy("s").agg(F.sum(F.when(F.col("decided") == "allow", 1).otherwise(0)).alias("yes"), F.sum(F.when(F.col("decided") == "block", 1).otherwise(0)).alias("no"))
    exploded = urls.select("s", "yes", "no", F.explode(grams(F.col("s"))).alias("gram"))
    model = saved(language_model(saved(exploded.groupBy("gram").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no")))))
    scores = urls.select("s", F.explode(grams(F.col("s"))).alias("gram")).join(F.broadcast(model), "gram").groupBy("s").agg((F.sum("gain") / F.count("*")).alias("score"))
    # Written first, so that the join below is a plain one whose frequent keys Spark can split.
    judged = saved(rows.join(saved(scores), "s").drop("s"))
    mid = tuple(judged.agg(F.avg(F.when(F.col("decided") == "allow", F.col("score"))), F.avg(F.when(F.col("decided") == "block", F.col("score")))).first())
    threshold = (mid[0] + mid[1]) / 2 if None not in mid else 0.0
    verdict = F.coalesce("decided", F.when(F.col("score") >= threshold, "allow").otherwise("block"))
    return judged.select(*keep, "host", "path", "rule", verdict.alias("verdict"), "score", F.lit(threshold).alias("threshold"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """The same result as DuckDB SQL, of one piece with the rules and constants above."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')".format
    rule = verdict = "NULL"
    for what, h, p in sorted(RULES, key=lambda r: (len(r[1] + r[2]), len(r[1]))):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h}{p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{what}' ELSE {verdict} END"

    def p(side: str) -> str:
        one = f"(SUM({side}) OVER (PARTITION BY substr(gram, 3, 1)) + 1.0) / (SUM({side}) OVER () + {len(ALPHABET)})"
        two = f"(SUM({side}) OVER (PARTITION BY substr(gram, 2, 2)) + {WEIGHT} * {one}) / (SUM({side}) OVER (PARTITION BY substr(gram, 2, 1)) + {WEIGHT})"
        return f"({side} + {WEIGHT} * {two}) / (SUM({side}) OVER (PARTITION BY substr(gram, 1, 2)) + {WEIGHT})"

    fold = f"regexp_replace(regexp_replace({lower("regexp_replace(coalesce(url, ''), '^.*?://', '', 's')")}, '[0-9]', '0', 'g'), '[^0a-z/.\\-_:?=#&%+@,;]', '~', 'g')"
    return f"""
WITH named AS (
  SELECT page_id, coalesce({lower("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, '^^' || {fold} || '$' AS s FROM pages
), judged AS (SELECT *, {rule} AS rule, {verdict} AS decided FROM named
), grams AS (SELECT s, decided, substr(s, i, 3) AS gram FROM (SELECT s, decided, unnest(range(1, length(s) - 1)) AS i FROM judged)
), counted AS (SELECT gram, SUM(CASE WHEN decided = 'allow' THEN 1.0 ELSE 0.0 END)::DOUBLE AS yes, SUM(CASE WHEN decided = 'block' THEN 1.0 ELSE 0.0 END)::DOUBLE AS no FROM grams GROUP BY gram
), model AS (SELECT gram, CASE WHEN SUM(yes) OVER () > 0 AND SUM(no) OVER () > 0 THEN ln({p("yes")}) - ln({p("no")}) ELSE 0 END AS gain FROM counted
), scores AS (SELECT s, SUM(gain) / COUNT(*) AS score FROM (SELECT DISTINCT s, unnest(range(1, length(s) - 1)) AS i FROM judged) x JOIN model ON gram = substr(s, i, 3) GROUP BY s
), scored AS (SELECT judged.*, score FROM judged JOIN scores USING (s)
), middle AS (SELECT coalesce((AVG(score) FILTER (decided = 'allow') + AVG(score) FILTER (decided = 'block')) / 2, 0) AS threshold FROM scored)
SELECT page_id, host, path, rule, coalesce(decided, CASE WHEN score >= (SELECT threshold FROM middle) THEN 'allow' ELSE 'block' END) AS verdict FROM scored"""
