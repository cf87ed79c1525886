"""URL filter by a character language-model ratio, in DataFrame expressions only.

Rules on host and path (the longest that fits wins) label a part of the URLs.  Accepted and rejected URLs each train a
smoothed variable-order Markov model over characters: the probability of a character after a context of ``order``
characters leans on that after one character less, in proportion to how little the context was seen
(``p_k = (n(context, c) + beta * p_(k-1)) / (n(context) + beta)``, down to a uniform distribution).  URLs without a rule
are judged by the log-likelihood difference divided by their length, against a threshold that is calibrated on held-out
labelled URLs: the cut of the score histogram with the least balanced error.

The query counts real characters with contexts of up to 5.  ``judge`` folds them to 32 symbols, with contexts of 2,
unless told otherwise.

The counts are a table keyed by context and character, and grow with the URLs.  Each gram of ``order + 1`` characters
that occurs gets its log-probability difference once, by joins with the counts of its shorter ends; the grams of a URL
are joined with those.  A bounded number of the most common grams is broadcast, so that no task gets all occurrences
of one; the others meet in a shuffle.

Cases: null urls and such without ``://`` have an empty host and path, match no rule, and are scored as their text
(null as empty); an empty text scores 0; without training URLs of a class its model is uniform, and without held-out
URLs of both classes the threshold is 0; other columns are ignored; repeated rows are judged alike.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands before a text as often as a context is long.
PAD = "\0"
#: So many of the most common grams are broadcast.
COMMON = 4096
BINS = 512


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"),
    Rule("example.net", "/en/", "allow"),
    Rule("example.com", "/de/", "block"),
    Rule("org", "/fr/", "allow"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def folded(text: Column) -> Column:
    """a-z in one case, one symbol for digits, ``/``, ``.``, ``-``, and one for all else."""
    return F.regexp_replace(F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9/.-]", "~"), "[0-9]", "0")


def grams(text: Column, order: int) -> Column:
    """Each character of a text behind its context."""
    padded = F.split(F.concat(F.lit(PAD * order), text), "")
    # The array is bound once, not split anew for each character.
    each = F.transform(F.array(padded), lambda a: F.transform(F.sequence(F.lit(1), F.size(a) - order), lambda i: F.array_join(F.slice(a, i, order + 1), "")))
    return F.when(F.length(text) > 0, F.get(each, F.lit(0)))


def ratios(counts: DataFrame, order: int, beta: float, alphabet: int) -> DataFrame:
    """The log-probability difference of each gram: ``gram, n, ratio``.  ``counts``: ``gram, n, n1, n0``."""
    out = counts.select("gram", "n", F.lit(1 / alphabet).alias("p1"), F.lit(1 / alphabet).alias("p0"))
    # From no context to the longest: the counts of a shorter context are sums over those of longer ones.
    for k in range(order + 1):
        end = {"end": F.substring("gram", order - k + 1, k + 1), "context": F.substring("gram", order - k + 1, k)}
        of = {key: counts.groupBy(c.alias(key)).agg(*(F.sum(f"n{side}").alias(f"{key}{side}") for side in "10")) for key, c in end.items()}
        ends, contexts = (F.broadcast(of[key]) if n < 2 else of[key] for key, n in (("end", k + 1), ("context", k)))
        out = out.withColumns(end).join(ends, "end").join(contexts, "context")
        out = out.select("gram", "n", *(((F.col(f"end{side}") + beta * F.col(f"p{side}")) / (F.col(f"context{side}") + beta)).alias(f"p{side}") for side in "10"))
    return out.select("gram", "n", (F.log("p1") - F.log("p0")).alias("ratio"))


def scores(texts: DataFrame, order: int, beta: float, fold: bool, alphabet: int) -> DataFrame:
    """The length-normalised log-likelihood difference of each text: ``id, score``.  ``texts``: ``id, text, accepted``, the last null where a text trains nothing."""
    each = texts.select("id", "accepted", F.explode(grams(folded(F.col("text")) if fold else F.col("text"), order)).alias("gram"))
    counts = written(each.groupBy("gram").agg(F.count("*").alias("n"), F.count_if("accepted").alias("n1"), F.count_if(~F.col("accepted")).alias("n0")), "grams")
    model = written(ratios(counts, order, beta, alphabet), "ratios")
    discard(counts)
    common = model.orderBy(F.desc("n"), "gram").limit(COMMON).select("gram", "ratio")
    met = each.select("id", "gram").join(F.broadcast(common), "gram", "left")
    rare = met.filter("ratio IS NULL").select("id", "gram").join(model.select("gram", "ratio"), "gram")
    # Texts that repeat have all their grams as often, which the mean leaves out.
    out = met.filter("ratio IS NOT NULL").select("id", "ratio").unionByName(rare.select("id", "ratio")).groupBy("id").agg(F.avg("ratio").alias("score"))
    return written(out, "scores")


def threshold(scored: DataFrame, reach: float = 4.0) -> DataFrame:
    """One row with ``threshold``: the cut between histogram bins with least balanced error; 0 without both classes.  ``scored``: ``score, accepted``."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("score") + reach) * (BINS / (2 * reach))).cast("int")))
    bins = scored.groupBy(bin_.alias("bin")).agg(F.count_if("accepted").alias("good"), F.count_if(~F.col("accepted")).alias("bad"))
    one = bins.groupBy().agg(F.array_sort(F.collect_list(F.struct("bin", "good", "bad"))).alias("b"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    lost = lambda cut: F.aggregate("b", F.lit(0.0), lambda a, x: a + F.when(x["bin"] < cut, x["good"] / F.col("good")).otherwise(x["bad"] / F.col("bad")))
    # Of equal cuts the one nearest to zero.
    cuts = F.transform(F.sequence(F.lit(0), F.lit(BINS)), lambda c: F.struct(F.round(lost(c), 9).alias("lost"), F.abs(c - BINS // 2).alias("far"), c.alias("cut")))
    cut = F.array_min(cuts)["cut"] * (2 * reach / BINS) - reach
    return one.select(F.when((F.col("good") > 0) & (F.col("bad") > 0), cut).otherwise(0.0).alias("threshold"))


def judge(pages: DataFrame, rules=RULES, order: int = 2, beta: float = 8.0, held_out: int = 5, fold: bool = True) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, score, threshold``."""
    host, path = host_and_path(F.col("url"))
    base = pages.select("page_id", F.coalesce("url", F.lit("")).alias("text"), host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    base = base.withColumn("rule", name).withColumn("by_rule", verdict).withColumn("id", F.unhex(F.md5(F.col("text").cast("binary"))))
    apart = F.conv(F.substring(F.md5(F.col("text").cast("binary")), 1, 8), 16, 10).cast("long") % held_out == 0
    accepted = F.col("by_rule") == "allow"
    scored = scores(base.select("id", "text", F.when(~apart, accepted).alias("accepted")), order, beta, fold, 32 if fold else 256)
    base = base.join(scored, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    cut = F.broadcast(threshold(base.filter(F.col("by_rule").isNotNull() & apart).select("score", accepted.alias("accepted"))))
    by_model = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return base.crossJoin(cut).select("page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score", "threshold")


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    judged = judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), order=5, fold=False)
    return judged.withColumns({c: F.round(c, 6) for c in ("score", "threshold")})


def _oracle(order: int = 5, beta: float = 8.0, alphabet: int = 256, held_out: int = 5, reach: float = 4.0) -> str:
    """The same model in SQL: a step for each length of context, then the histogram of held-out scores."""
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(RULES, key=lambda r: -len(r.name))
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{of(r)}'" for r in longest) + " END"
    side = lambda cut: f"CASE WHEN bin < {cut} THEN good / g ELSE bad / b END"
    steps = [f"m_0 AS (SELECT gram, 1.0 / {alphabet} AS p1, 1.0 / {alphabet} AS p0 FROM c)"]
    for k in range(order + 1):
        end, context = f"substr(gram, {order - k + 1}, {k + 1})", f"substr(gram, {order - k + 1}, {k})"
        steps += [
            f"e_{k} AS (SELECT {end} AS x, sum(n1) AS n1, sum(n0) AS n0 FROM c GROUP BY 1)",
            f"x_{k} AS (SELECT {context} AS x, sum(n1) AS n1, sum(n0) AS n0 FROM c GROUP BY 1)",
            f"m_{k + 1} AS (SELECT gram, (e.n1 + {beta} * p1) / (x.n1 + {beta}) AS p1, (e.n0 + {beta} * p0) / (x.n0 + {beta}) AS p0 "
            f"FROM m_{k} JOIN e_{k} e ON e.x = {end} JOIN x_{k} x ON x.x = {context})",
        ]
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS t, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, t, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {case(lambda r: r.name)} AS rule, {case(lambda r: r.verdict)} AS by_rule, ('0x' || substr(md5(t), 1, 8))::BIGINT % {held_out} = 0 AS apart FROM h),
g AS (SELECT page_id, CASE WHEN NOT apart THEN by_rule END AS side, unnest(list_transform(range(1, length(t) + 1), lambda i: substr(repeat(chr(1), {order}) || t, i, {order + 1}))) AS gram FROM r),
c AS (SELECT gram, count(*) FILTER (side = 'allow') AS n1, count(*) FILTER (side = 'block') AS n0 FROM g GROUP BY gram),
{", ".join(steps)},
s AS (SELECT page_id, avg(ln(p1) - ln(p0)) AS score FROM g JOIN m_{order + 1} USING (gram) GROUP BY page_id),
a AS (SELECT r.*, coalesce(score, 0.0) AS score FROM r LEFT JOIN s USING (page_id)),
b AS (SELECT greatest(0, least({BINS - 1}, floor((score + {reach}) * {BINS / (2 * reach)})))::INT AS bin, count(*) FILTER (by_rule = 'allow') AS good, count(*) FILTER (by_rule = 'block') AS bad FROM a WHERE apart AND by_rule IS NOT NULL GROUP BY 1),
n AS (SELECT sum(good) AS g, sum(bad) AS b FROM b),
w AS (SELECT cut, round(sum({side("cut")}), 9) AS lost FROM range({BINS + 1}) AS x(cut), b, n GROUP BY cut),
z AS (SELECT CASE WHEN g > 0 AND b > 0 THEN (SELECT cut * {2 * reach / BINS} - {reach} FROM w ORDER BY lost, abs(cut - {BINS // 2}), cut LIMIT 1) ELSE 0.0 END AS threshold FROM n)
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN score >= coalesce(threshold, 0) THEN 'allow' ELSE 'block' END) AS verdict, round(score, 6) AS score, round(coalesce(threshold, 0)::DOUBLE, 6) AS threshold FROM a, z
"""


ORACLE = _oracle()
