"""URL filter: rules first, then the ratio of two character language models.

Rules name a host and a path beginning and fit that host and its subdomains; the longest
rule that fits decides.  All other URLs are judged by two smoothed variable-order Markov
models, one of accepted and one of rejected URLs: contexts of up to ``ORDER`` characters,
each order interpolated with the next shorter one by Witten-Bell weights.  The difference
of the two log-likelihoods, divided by the length, is calibrated to a probability on held
out examples.

The models count the windows of all distinct examples (but one of ``CALIBRATE``, by hash),
so they grow with the input; counts, chances and scores are tables and are joined, never
gathered in one place.  Only the two numbers of the calibration curve are fitted on a bounded
sample, ``SAMPLE`` held out examples of each kind.  Every URL is scored whole.

Edge cases: a null URL, or one without ``://``, has empty host and path, fits no rule and
is scored as it stands (null as empty); without examples of both kinds every URL that no
rule fits is allowed with a null difference and probability 0.5; an example of both kinds counts for both; a kind whose
examples all fall on one side of the split is fitted and calibrated on the same ones; repeated rows
are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from bitloom.llm.common import join_unique, settle

ORDER = 5
#: Most held out examples of each kind that the calibration curve is fitted on.
SAMPLE = 20_000
#: One example of so many calibrates and isn't counted.
CALIBRATE = 4
ALPHABET = 256
#: Up to so many rules are compared in generated code; more are walked as a list.
MOST_COMPILED = 200
BLOCK_AT = 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"
#: Scores of windows are whole multiples of 1 / UNIT, so a sum is the same in any order.
UNIT = 1 << 32
KINDS = ("accepted", "rejected")


@dataclass(frozen=True)
class Rule:
    """``pattern`` is a host, a slash and the rest of a path's beginning, like ``net/`` or ``example.org/en/``."""

    verdict: str
    pattern: str

    @property
    def host(self) -> str:
        return self.pattern.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.pattern.split("/", 1)[1]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, with A-Z lower-cased, and path; both empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Iterable[Rule]) -> Column:
    """The pattern of the longest rule that fits, else null; of rules equally long the one with the longer host."""
    ordered = sorted(rules, key=lambda r: (-len(r.pattern), -len(r.host), r.pattern))

    def fits(its_host: Column, its_path: Column) -> Column:
        return ((host == its_host) | F.endswith(host, F.concat(F.lit("."), its_host))) & F.startswith(path, its_path)

    if len(ordered) > MOST_COMPILED:
        listed = [{"host": r.host, "path": r.path, "pattern": r.pattern} for r in ordered]
        every = F.from_json(F.lit(json.dumps(listed)), "array<struct<host:string,path:string,pattern:string>>")
        return F.get(F.filter(every, lambda r: fits(r["host"], r["path"])), 0)["pattern"]
    found = F.lit(None).cast("string")
    for r in reversed(ordered):
        found = F.when(fits(F.lit(r.host), F.lit(r.path)), F.lit(r.pattern)).otherwise(found)
    return found


def windows_of(urls: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` and a row for every character of ``url`` and for its end: the window of up to ORDER characters before it and itself."""
    # the characters are a column of their own and read twice, so they aren't split again for each window
    chars = urls.select(*keep, F.split(F.concat(F.lit(START), F.coalesce("url", F.lit("")), F.lit(END)), "").alias("_chars"))
    every = F.transform(
        F.sequence(F.lit(2), F.size("_chars")),
        lambda i: F.array_join(F.slice("_chars", F.greatest(i - ORDER, F.lit(1)), F.least(i, F.lit(ORDER + 1))), ""),
    )
    return chars.select(*keep, F.explode(every).alias("window"))


def endings(window: str) -> Column:
    """A window and all that end it, down to its last character."""
    return F.explode(F.transform(F.sequence(F.lit(1), F.length(window)), lambda i: F.substr(F.col(window), i)))


def window_counts(examples: DataFrame) -> DataFrame:
    """How often the examples (``url``, ``kind`` 0 or 1) of each kind hold each window of 1 to ORDER + 1 characters; settled."""
    sums = [F.sum(f"n_{k}").alias(f"n_{k}") for k in KINDS]
    one_of = [F.when(F.col("kind") == i, 1).otherwise(0).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    longest = windows_of(examples, ["kind"]).select("window", *one_of).groupBy("window").agg(*sums)
    return settle(longest.select(endings("window").alias("window"), *[f"n_{k}" for k in KINDS]).groupBy("window").agg(*sums), "window_counts")


def before_last(window: str) -> Column:
    return F.substr(F.col(window), F.lit(1), F.length(window) - 1)


def context_counts(counts: DataFrame) -> DataFrame:
    """For each context and kind how many characters follow it, and how many different ones; settled."""
    found = []
    for k in KINDS:
        found += [F.sum(f"n_{k}").alias(f"all_{k}"), F.sum(F.when(F.col(f"n_{k}") > 0, 1).otherwise(0)).alias(f"kinds_{k}")]
    return settle(counts.groupBy(before_last("window").alias("context")).agg(*found), "contexts")


def window_chances(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """For each ``window`` wanted the chance of its last character after the others, in both models.

    They are found from short windows to long ones.  A step joins windows on what precedes
    their last or follows their first character, so no key has more rows than there are characters.
    """
    contexts = context_counts(counts)
    every = settle(wanted.select(endings("window").alias("window")).distinct(), "wanted")
    shorter, steps = None, []
    for length in range(1, ORDER + 2):
        here = every.where(F.length("window") == length).join(counts, "window", "left")
        here = here.withColumn("context", before_last("window")).join(contexts, "context", "left")
        if shorter is None:
            here = here.withColumns({f"p_{k}": F.lit(1 / ALPHABET) for k in KINDS})
        else:
            here = here.withColumn("tail", F.substr(F.col("window"), F.lit(2))).join(shorter.withColumnRenamed("window", "tail"), "tail")
        chances = [
            F.when(F.col(f"all_{k}") > 0, (F.coalesce(f"n_{k}", F.lit(0)) + F.col(f"kinds_{k}") * F.col(f"p_{k}")) / (F.col(f"all_{k}") + F.col(f"kinds_{k}"))).otherwise(F.col(f"p_{k}")).alias(f"p_{k}")
            for k in KINDS
        ]
        shorter = settle(here.select("window", *chances), "chances")
        steps.append(shorter)
    found = steps[0]
    for step in steps[1:]:
        found = found.unionByName(step)
    return found.join(wanted.select("window"), "window", "left_semi")


def window_values(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """For each ``window`` wanted the log-likelihood difference (rejected minus accepted) that its last character adds, in units; settled."""
    value = F.round(F.log(F.col("p_rejected") / F.col("p_accepted")) * UNIT).cast("bigint")
    return settle(window_chances(wanted, counts).select("window", value.alias("value")), "values")


def url_key(url: Column) -> list[Column]:
    """Two hashes that name a URL; null is the empty one."""
    known = F.coalesce(url, F.lit(""))
    return [F.xxhash64(known).alias("key_1"), F.xxhash64(F.lit(1), known).alias("key_2")]


def differences(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """For each distinct ``url`` its key and the difference of log-likelihoods (rejected minus accepted) per character; settled."""
    distinct = urls.select(*url_key(F.col("url")), F.coalesce("url", F.lit("")).alias("url")).dropDuplicates(["key_1", "key_2"])
    windows = windows_of(settle(distinct, "urls"), ["key_1", "key_2"])
    wanted = settle(windows.groupBy("window").agg(F.count("*").alias("_rows")), "url_windows")
    valued = join_unique(windows, window_values(wanted, counts), ["window"], wanted)
    return settle(valued.groupBy("key_1", "key_2").agg((F.sum("value") / (F.count("*") * float(UNIT))).alias("difference")), "differences")


def calibrate(scores: np.ndarray, rejected: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic curve from score to the probability of rejection, with both kinds weighed alike."""
    weight = np.where(rejected, 0.5 / max(1, rejected.sum()), 0.5 / max(1, (~rejected).sum()))
    scale = scores.std() or 1.0
    x, a, b = scores / scale, 1.0, 0.0
    for _ in range(50):  # Newton steps with a ridge, as the kinds may be separable
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([np.sum(weight * (p - rejected) * x) + 1e-3 * a, np.sum(weight * (p - rejected))])
        v = weight * p * (1 - p)
        h = np.array([[np.sum(v * x * x) + 1e-3, np.sum(v * x)], [np.sum(v * x), np.sum(v) + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return float(a / scale), float(b)


def split_examples(accepted: DataFrame, rejected: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Distinct examples (``url``, ``kind``) to count, and at most SAMPLE of each kind to calibrate on; None without both kinds."""
    both = accepted.select("url", F.lit(0).alias("kind")).unionByName(rejected.select("url", F.lit(1).alias("kind")))
    both = settle(both.where(F.col("url").isNotNull()).distinct().withColumn("held", F.pmod(F.xxhash64("url"), F.lit(CALIBRATE)) == 0), "examples")
    sizes = {(r["kind"], r["held"]): r["count"] for r in both.groupBy("kind", "held").count().collect()}
    if {kind for kind, _ in sizes} != {0, 1}:
        return None
    whole = [kind for kind in (0, 1) if len([1 for k, _ in sizes if k == kind]) == 1]  # no split: all examples serve both ends
    all_of = F.col("kind").isin(whole) if whole else F.lit(False)
    held = both.where(F.col("held") | all_of)
    drawn = [held.where(F.col("kind") == kind).orderBy(F.xxhash64("url"), "url").limit(SAMPLE) for kind in (0, 1)]
    return both.where(~F.col("held") | all_of).select("url", "kind"), settle(drawn[0].unionByName(drawn[1]).select("url", "kind"), "calibration")


def judge(pages: DataFrame, accepted: DataFrame, rejected: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with the difference and p_block, the probability of rejection; null and 0.5 without examples (``url``) of both kinds."""
    split = split_examples(accepted, rejected)
    if split is None:
        return pages.withColumns({"difference": F.lit(None).cast("double"), "p_block": F.lit(0.5)})
    counted, sample = split
    urls = pages.select(F.col(url_col).alias("url"))
    found = differences(urls.unionByName(sample.select("url")), window_counts(counted))
    known = sample.select("kind", *url_key(F.col("url"))).join(found, ["key_1", "key_2"]).select("kind", "difference").collect()
    known = np.array(sorted((r["kind"], r["difference"]) for r in known))
    slope, offset = calibrate(known[:, 1], known[:, 0] == 1)
    rows = pages.withColumns(dict(zip(("key_1", "key_2"), url_key(F.col(url_col)))))
    often = urls.select(*url_key(F.col("url"))).groupBy("key_1", "key_2").agg(F.count("*").alias("_rows"))
    scored = join_unique(rows, found, ["key_1", "key_2"], often).drop("key_1", "key_2")
    away = F.least(F.greatest(slope * F.col("difference") + offset, F.lit(-500.0)), F.lit(500.0))
    return scored.withColumn("p_block", 1 / (1 + F.exp(-away)))


def filter_urls(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", accepted: DataFrame | None = None, rejected: DataFrame | None = None) -> DataFrame:
    """Id, host, path, rule, verdict, difference and p_block of every URL.

    The examples (frames with a column ``url``) default to the URLs that the rules allow and block.
    """
    host, path = host_and_path(F.col(url_col))
    verdict_of = F.from_json(F.lit(json.dumps({r.pattern: r.verdict for r in rules})), "map<string,string>") if rules else None
    parsed = pages.select(F.col(id_col), F.col(url_col).alias("_u"), host.alias("host"), path.alias("path")).withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    parsed = parsed.withColumn("ruled", F.element_at(verdict_of, F.col("rule")) if rules else F.lit(None).cast("string"))
    examples = [parsed.where(F.col("ruled") == v).select(F.col("_u").alias("url")) if given is None else given for v, given in (("allow", accepted), ("block", rejected))]
    scored = judge(parsed, *examples, "_u")
    by_model = F.when(F.col("difference").isNotNull() & (F.col("p_block") >= BLOCK_AT), F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("verdict", F.coalesce("ruled", by_model)).select(id_col, "host", "path", "rule", "verdict", "difference", "p_block")
