"""URL filter: explicit host and path rules, then a tree of path templates judged by labelled purity.

Built-in expressions only. URLs first collapse to (host, typed path), where
numbers, hexadecimal ids and dates are already wildcards; the tree is grown
on these rows, so a host with any share of the pages is a few rows, down to
the last segment of its deepest path, one round for each branching. Where a host's paths branch, siblings whose labelled share does not differ from their
parent's pool (z test) merge: into "*" those that are rare among many siblings,
into "~" the others. A segment whose share differs stays its own, however rare,
so no branch is lost in the size of its host. Segments without labels merge only where rare. A template is rejected if its share of bad labels,
shrunk towards its host and that towards the whole, reaches ``reject`` or, where bad pages are fewer,
``lift`` times the share of the whole, and its labels alone are above the whole by a one-sided test at ``z_reject``.

A NULL url or one without "://" has an empty host and path and is judged
as such a template. NULL labels count as unlabelled. Repeated pages keep
their rows. URLs of any length are read whole. Templates that tie with a bound are rejected. An
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Stored
from .common import LOWER, UPPER, hot_join

MAX_RULES = 1000


def host_path(url: str) -> tuple[Column, Column]:
    pattern = "://([^/?#]*)([^?#]*)"
    u = F.coalesce(F.col(url), F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule, NULL if none fits. Rules are (host, path, verdict)."""
    if len(rules) > MAX_RULES:
        raise ValueError("too many rules for an expression")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def typed_segment(s: Column) -> Column:
    """Numbers, dates, hexadecimal and UUID-like segments as wildcards; a file suffix stays."""
    suffix = F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1)
    stem = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
    kind = (
        F.when(stem.rlike(r"^\d{4}-\d{2}-\d{2}$"), "<date>")
        .when(stem.rlike(r"^\d+$"), "<n>")
        .when(stem.rlike(r"^(?=.*\d)[0-9a-fA-F-]{8,}$"), "<hex>")
        .when(stem.rlike(r"\d{3,}$"), F.concat(F.regexp_replace(stem, r"\d+$", ""), F.lit("<n>")))
    )
    return F.when(kind.isNotNull(), F.concat(kind, suffix)).otherwise(s)


def typed_path(path: Column) -> Column:
    """All segments, typed."""
    return F.concat_ws("/", F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), typed_segment))


def _shared(rows: DataFrame, total: int, siblings: int) -> DataFrame:
    """Rows with the segments that all rows of their branch share moved from ``_rest`` to the template.

    All of them if the branch cannot merge anywhere: it is one row, or has no labels and too few rows for rare siblings.
    """
    branch = rows.groupBy("host", "template").agg(F.min("_rest").alias("_lo"), F.max("_rest").alias("_hi"), F.sum("n_lab").alias("_l"), F.count(F.lit(1)).alias("_rows"))
    # what the first and the last path share, all between them share
    differ = F.array_position(F.zip_with("_lo", "_hi", lambda x, y: x.eqNullSafe(y)), F.lit(False))
    same = F.when(differ > 0, differ - 1).otherwise(F.size("_lo")).cast("int")
    settled = (F.col("_rows") == 1) | ((F.col("_l") == 0) & (F.col("_rows") <= siblings))
    step = Stored(branch.select("host", "template", F.when(settled, F.lit(2**30)).otherwise(same).alias("_k"), F.col("_rows").alias("_weight")), "url-shared").df
    joined = hot_join(rows, step, ["host", "template"], "_weight", total)
    k = F.least("_k", F.size("_rest"))
    longer = F.when(k > 0, F.concat_ws("/", F.col("template"), F.array_join(F.slice("_rest", 1, k), "/"))).otherwise(F.col("template"))
    rest = F.slice("_rest", k + 1, F.size("_rest") - k)
    return joined.select("host", "typed", "n", "n_lab", "n_bad", rest.alias("_rest"), longer.alias("template"))


def templates(typed: DataFrame, siblings: int = 20, share: float = 0.02, z: float = 1.96) -> DataFrame:
    """(host, typed, n, n_lab, n_bad, template) from (host, typed, n, n_lab, n_bad): the tree, one branching at a time, down to the last segment.

    Segments that a whole branch shares are passed in one step, so rounds follow
    the branchings of a path, not its segments. Rows leave when their path ends or their branch cannot merge.
    """
    stored = Stored(typed.withColumn("_rest", F.filter(F.split("typed", "/"), lambda x: x != "")).withColumn("template", F.lit("")).withColumn("_done", F.lit(False)), "url-level")
    paths = [stored.path]
    while True:
        rows = stored.df.filter("not _done").drop("_done")
        total = rows.count()
        if not total:
            break
        here = Stored(_shared(rows, total, siblings).withColumn("_s", F.coalesce(F.get("_rest", F.lit(0)), F.lit(""))), "url-here").df
        child = Stored(here.groupBy("host", "template", "_s").agg(F.sum("n").alias("_n"), F.sum("n_lab").alias("_l"), F.sum("n_bad").alias("_b"), F.count(F.lit(1)).alias("_rows")), "url-children").df
        parent = child.groupBy("host", "template").agg(F.sum("_n").alias("_pn"), F.sum("_l").alias("_pl"), F.sum("_b").alias("_pb"), F.count(F.lit(1)).alias("_kids"))
        kids = child.count()
        known = hot_join(child, Stored(parent, "url-parents").df, ["host", "template"], "_kids", kids)
        rare = (F.col("_kids") > siblings) & (F.col("_n") < F.lit(share) * F.col("_pn")) & (F.col("_s") != "")
        pool = F.try_divide(F.col("_pb").cast("double"), F.col("_pl"))
        score = F.try_divide(F.col("_b") - F.col("_l") * pool, F.sqrt(F.col("_l") * pool * (1 - pool)))
        # a pool of one kind has no score: its labelled branches are alike; branches without labels cannot be compared
        alike = (F.col("_s") != "") & (F.col("_kids") > 1) & (F.col("_l") > 0) & (F.coalesce(F.abs(score), F.lit(0.0)) <= z)
        blank = (F.col("_s") != "") & (F.col("_l") == 0) & rare
        name = F.when(F.col("_s") == "", "").when((alike & rare) | blank, "*").when(alike, "~").otherwise(F.col("_s"))
        step = Stored(known.select("host", "template", "_s", name.alias("_name"), F.col("_rows").alias("_weight")), "url-names").df
        joined = hot_join(here, step, ["host", "template", "_s"], "_weight", total)
        longer = F.when(F.col("_name") == "", F.col("template")).otherwise(F.concat_ws("/", "template", "_name"))
        rest = F.slice("_rest", 2, F.greatest(F.size("_rest") - 1, F.lit(0)))
        stored = Stored(joined.select("host", "typed", "n", "n_lab", "n_bad", rest.alias("_rest"), longer.alias("template"), (F.col("_s") == "").alias("_done")), "url-level")
        paths.append(stored.path)
    # one scan of all rounds; every row is done in one of them
    return stored.spark.read.schema(stored.schema).parquet(*paths).filter("_done").drop("_rest", "_done")


def judge(rows: DataFrame, reject: float = 0.5, lift: float = 2.0, z_reject: float = 1.645, k_template: float = 10.0, k_host: float = 50.0) -> DataFrame:
    """(host, typed, n, template, bad_share, verdict): shrunk labelled purity of every template."""
    total = rows.agg(F.sum("n_lab").alias("l"), F.sum("n_bad").alias("b")).first()
    overall = (total["b"] or 0) / total["l"] if total["l"] else 0.0
    by_host = rows.groupBy("host").agg(F.sum("n_lab").alias("_hl"), F.sum("n_bad").alias("_hb"))
    by_host = by_host.withColumn("_prior", (F.col("_hb") + F.lit(k_host * overall)) / (F.col("_hl") + F.lit(k_host))).select("host", "_prior")
    by_template = rows.groupBy("host", "template").agg(F.sum("n_lab").alias("_l"), F.sum("n_bad").alias("_b"), F.count(F.lit(1)).alias("_rows"))
    scored = by_template.join(by_host, "host").withColumn("bad_share", (F.col("_b") + k_template * F.col("_prior")) / (F.col("_l") + F.lit(k_template)))
    above = F.col("_b") - F.col("_l") * F.lit(overall) >= F.lit(z_reject) * F.sqrt(F.col("_l") * F.lit(overall * (1 - overall)))
    bad = (F.col("bad_share") >= min(reject, lift * overall)) & (F.col("_b") > 0) & above
    scored = Stored(scored.select("host", "template", "bad_share", F.when(bad, "block").otherwise("allow").alias("verdict"), "_rows"), "url-templates").df
    return hot_join(rows.select("host", "typed", "n", "template"), scored, ["host", "template"], "_rows", rows.count())


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", reject: float = 0.5, lift: float = 2.0, z_reject: float = 1.645) -> DataFrame:
    """(key, host, path, rule, verdict, template, bad_share). ``labels`` is (key, bad 0/1), one row per key."""
    host, path = host_path(url)
    base = pages.select(F.col(key).alias("_id"), host.alias("host"), path.alias("path")).withColumn("typed", typed_path(F.col("path")))
    lab = labels.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_id")).agg(F.max("bad").cast("int").alias("_bad"))
    known = base.filter(F.col("_id").isNotNull()).join(lab, "_id", "left").unionByName(base.filter(F.col("_id").isNull()).withColumn("_bad", F.lit(None).cast("int")))
    stored = Stored(known, "url-pages").df
    total = stored.count()
    typed = stored.groupBy("host", "typed").agg(F.count(F.lit(1)).alias("n"), F.count("_bad").alias("n_lab"), F.coalesce(F.sum("_bad"), F.lit(0)).alias("n_bad"))
    judged = Stored(judge(Stored(templates(typed), "url-tree").df, reject, lift, z_reject), "url-judged").df
    out = hot_join(stored, judged, ["host", "typed"], "n", total)
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return out.select(F.col("_id").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("verdict")).alias("verdict"), "template", "bad_share")
