"""URL filters: given rules first, then association rules mined from labelled URLs.

FP-growth finds token combinations that come with a label. Combinations that are
too rare, too uncertain, or say no more than a part of them are pruned. What is
left is looked up by token, so a URL meets only rules that share one with it.
"""

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passim.session import checkpointed

ALLOW, BLOCK = "allow", "block"
MIN_SUPPORT = 0.002
MIN_CONFIDENCE = 0.8
# How much likelier than usual a rule's verdict must be where the rule fits.
MIN_LIFT = 1.5
# Seeds: words of a host's name that label it as unwanted, where nothing better is known.
SEED_WORDS = ("adult", "ads", "bets", "casino", "pills", "porn", "spam", "warez")


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path: A-Z of the host lower-cased; both empty without ``://``."""
    whole = F.coalesce(url, F.lit(""))
    at = F.instr(whole, "://")
    rest = F.when(at > 0, F.substring(whole, at + 3, F.length(whole))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return lowered, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def given_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest rule that fits, as ``rule`` and ``verdict``; null if none does.

    A rule ``(verdict, host, path)`` fits its host and all hosts below it, if
    the path starts with its own. The list is a parameter of the filter and
    becomes part of the expression.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, own, prefix in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(own + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """Distinct tokens: scheme, labels of the host, their words and its end, folders, kind of page, names of parameters.

    Digits in a path or host become ``0``, so that numbered pages share a token.
    """
    whole = F.coalesce(url, F.lit(""))
    host, path = parts(whole)
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "0")
    named = lambda kind, values: F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(kind + ":"), v))
    labels = F.split(plain(host), r"\.")
    query = F.regexp_extract(whole, r"(?s)^[^?#]*\?([^#]*)", 1)
    return F.array_distinct(
        F.concat(
            named("scheme", F.array(F.lower(F.regexp_extract(whole, "(?s)^([^:/?#]+)://", 1)))),
            named("label", F.when(F.size(labels) > 2, F.slice(labels, 1, F.size(labels) - 2)).otherwise(labels)),
            named("word", F.flatten(F.transform(F.filter(labels, lambda v: v.contains("-")), lambda v: F.split(v, "-")))),
            named("end", F.array(F.substring_index(host, ".", -1))),
            named("path", F.split(plain(path), "/")),
            named("type", F.array(F.regexp_extract(F.lower(path), r"\.([a-z]{1,5})$", 1))),
            named("query", F.transform(F.split(query, "&"), lambda q: F.substring_index(F.lower(q), "=", 1))),
        )
    )


def seed_labels(pages: DataFrame, rules: list[tuple[str, str, str]], words: tuple[str, ...] = SEED_WORDS, url: str = "url") -> DataFrame:
    """``url, verdict`` of every row: ``block`` if a given rule says so or the
    host's name has a seed word, else ``allow``.

    Weak labels for :func:`mine`; a null URL has none.
    """
    address = F.col(f"`{url}`")
    host, path = parts(address)
    bad = F.arrays_overlap(F.split(host, "[.-]"), F.array(*[F.lit(w) for w in words]))
    given = F.coalesce(given_rule(host, path, rules)["verdict"], F.lit(ALLOW))
    verdict = F.when(address.isNotNull(), F.when(bad, BLOCK).otherwise(given))
    return pages.select(address.alias("url"), verdict.alias("verdict"))


def mine(
    labelled: DataFrame,
    url: str = "url",
    verdict: str = "verdict",
    min_support: float = MIN_SUPPORT,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
) -> list[dict]:
    """Rules ``tokens, verdict, confidence, support`` from labelled URLs.

    Every labelled row counts. A combination is pruned if its verdict is not
    ``min_lift`` times as likely as usual, or if it holds a shorter one of the
    same verdict with as much confidence. What is left is bounded by the support:
    each rule holds for that share of the rows, however many there are. Null URLs and
    labels take no part; without labelled rows there are no rules.
    """
    rows = labelled.select(F.col(f"`{url}`").alias("u"), F.col(f"`{verdict}`").alias("v")).where("u is not null and v is not null")
    baskets = rows.select(F.array_append(tokens(F.col("u")), F.concat(F.lit("verdict:"), "v")).alias("items"))
    if baskets.isEmpty():
        return []
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets)
    found = (
        model.associationRules.where(F.element_at("consequent", 1).startswith("verdict:"))
        .where(~F.exists("antecedent", lambda t: t.startswith("verdict:")) & (F.col("lift") >= min_lift))
        .select(F.array_sort("antecedent").alias("tokens"), F.expr("substring(consequent[0], 9)").alias("verdict"), "confidence", "support")
    )
    found = checkpointed(found)
    # The shortest rules of a verdict that are as sure as all that hold them.
    shorter = found.select(F.col("tokens").alias("part"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    inside = (F.col("verdict") == F.col("v")) & (F.size("part") < F.size("tokens")) & (F.col("c") >= F.col("confidence"))
    # A shorter rule's first token is one of the longer rule's.
    spread = found.withColumn("token", F.explode("tokens"))
    held = spread.join(shorter.withColumn("token", F.element_at("part", 1)), "token")
    held = held.where(inside & (F.size(F.array_except("part", "tokens")) == 0)).select("tokens", "verdict")
    kept = found.join(held.distinct(), ["tokens", "verdict"], "left_anti")
    return [r.asDict() for r in kept.orderBy(F.desc("confidence"), F.size("tokens"), F.desc("support"), "tokens", "verdict").collect()]


def mined_verdict(url: Column, rules: list[dict], default: str = ALLOW) -> Column:
    """The verdict of the surest mined rule whose tokens the URL has, or the default.

    The index holds each rule under one of its tokens. Equal confidence goes to
    the rule with more tokens, then more support, then to ``block``.
    """
    if not rules:
        return F.lit(default)
    index: dict[str, list[dict]] = {}
    for r in rules:
        index.setdefault(max(r["tokens"], key=lambda t: (len(t), t)), []).append(r | {"size": len(r["tokens"])})
    kind = "map<string,array<struct<confidence:double,size:int,support:double,verdict:string,tokens:array<string>>>>"
    table, own = F.from_json(F.lit(json.dumps(index)), kind), tokens(url)
    met = F.flatten(F.filter(F.transform(own, lambda t: F.try_element_at(table, t)), lambda x: x.isNotNull()))
    fits = F.filter(met, lambda r: F.size(F.array_except(r["tokens"], own)) == 0)
    best = F.array_max(F.transform(fits, lambda r: F.struct(r["confidence"], r["size"], r["support"], r["verdict"])))
    return F.coalesce(best["verdict"], F.lit(default))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]], mined: list[dict], url: str = "url") -> DataFrame:
    """The rows with ``host, path, rule, verdict``.

    The verdict is the longest given rule's, else the mined rules', else
    ``allow``. A null URL, or one without ``://``, has an empty host and path,
    no rule and the default. Columns of these names are replaced.
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    address = F.col(f"`{url}`")
    host, path = parts(address)
    # One structure, so that no column of the caller's can clash.
    made = pages.select(F.struct("*").alias("row"), F.struct(address.alias("url"), host.alias("host"), path.alias("path")).alias("at"))
    made = made.withColumn("given", given_rule(F.col("at.host"), F.col("at.path"), rules))
    verdict = F.coalesce(F.col("given.verdict"), mined_verdict(F.col("at.url"), mined))
    return made.select(*[F.col(f"row.`{c}`") for c in kept], "at.host", "at.path", F.col("given.rule").alias("rule"), verdict.alias("verdict"))
