"""URL filter: rules first, then a character language-model ratio, in DataFrame functions only.

URLs that a rule allows or blocks teach two variable-order Markov models over characters (orders 0 to a top order, Witten-Bell
smoothing: each order falls back on the one below, and a context never seen leaves all to it). A URL without a rule gets the
length-normalised difference of its log-likelihoods, and is allowed if it isn't under the threshold. One in ``HELD_OUT`` ruled URLs, by hash of
host and path, isn't taught: the threshold is calibrated on these, between the means of the two classes in proportion to their spreads, and
they show what the model is worth (columns held_out and model_verdict). Without evidence the threshold is 0, where both models find a URL equally
likely; with n URLs held out in the smaller class the calibrated one counts n / (n + ``CAUTION``).

The model is a table of the grams that occur, which grows with the URLs: a gram has the top order's context and its sign, and the
counts of lower orders are sums over it. Only the grams that are most frequent, of a bounded number, are sent to all tasks.

Defined results: a null url, or one without ://, has empty host and path, no rule, and the verdict of the empty text; if
no rule blocks or none allows anything, URLs without a rule are allowed; ties of the score with the threshold are allowed; a null id stays
null; repeated rows repeat their result; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, keep

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
ALPHABET = "abcdefghijklmnopqrstuvwxyz0-./?=&_%#:~*^"
SIGNS = len(ALPHABET)
HELD_OUT, CAUTION = 4, 20
#: All of printable ASCII but the boundary, a sign each for letters, numbers and others outside ASCII, and the boundary.
WIDE = "".join(chr(c) for c in range(0x21, 0x7F) if chr(c) != "^") + "\u00aa\u00b9\u00a4^"


def host_and_path(url: str) -> tuple[Column, Column]:
    rest = F.when(F.instr(F.col(url), "://") > 0, F.substring(F.col(url), F.instr(F.col(url), "://") + 3, F.length(url)))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits (struct of rule and verdict), or null."""
    found = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{start}")
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def folded(host: Column, path: Column, order: int, wide: bool) -> Column:
    """The text in the signs of the alphabet; a boundary for each place of a context stands before it and one after.

    The wide alphabet keeps digits apart and the path's capitals; the narrow one folds them.
    """
    text = F.concat(host, path)
    if wide:
        for sign, others in (("*", r"[\x00-\x20^\x7f]"), ("\u00aa", r"[\p{L}&&[^\x00-\x7f]]"), ("\u00b9", r"[\p{N}&&[^\x00-\x7f]]"), ("\u00a4", r"[^\x00-\x7f\u00aa\u00b9]")):
            text = F.regexp_replace(text, others, sign)
    else:
        text = F.translate(ascii_lower(text), "0123456789", "0" * 10)
        text = F.regexp_replace(text, r"[^a-z0\-./?=&_%#:~]", "*")
    return F.concat(F.lit("^" * order), text, F.lit("^"))


def grams(rows: DataFrame, order: int, *names: str) -> DataFrame:
    """The named columns and gram, a row for each sign of column text with the order signs before it."""
    places = F.explode(F.sequence(F.lit(1), F.char_length("text") - order)).alias("_at")
    return rows.select("text", *names, places).select(*names, F.substring("text", F.col("_at"), F.lit(order + 1)).alias("gram"))


def log_ratios(counts: DataFrame, order: int, signs: int) -> DataFrame:
    """(gram, ratio) for each gram of counts (gram, allow, block): log-probability of the last sign as accepted, less that as rejected."""
    sides = ("allow", "block")
    total = counts.agg(*[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in sides]).first()
    below = None
    for k in range(order + 1):
        level = counts.groupBy(F.substring("gram", -(k + 1), k + 1).alias("gram")).agg(*[F.sum(s).alias(s) for s in sides])
        if not k:
            below = level.select("gram", *[((F.col(s) + 1.0) / (total[s] + signs)).alias(f"p_{s}") for s in sides])
            continue
        # A context is followed by one row for each sign at most.
        over = Window.partitionBy(F.substring("gram", 1, k))
        level = level.withColumns({f"all_{s}": F.sum(s).over(over) for s in sides} | {f"kinds_{s}": F.count_if(F.col(s) > 0).over(over) for s in sides})
        level = level.withColumn("shorter", F.substring("gram", 2, k)).join(below.withColumnRenamed("gram", "shorter"), "shorter")
        p = {s: (F.col(s) + F.col(f"kinds_{s}") * F.col(f"p_{s}")) / (F.col(f"all_{s}") + F.col(f"kinds_{s}")) for s in sides}
        below = level.select("gram", *[F.when(F.col(f"all_{s}") > 0, p[s]).otherwise(F.col(f"p_{s}")).alias(f"p_{s}") for s in sides])
    return below.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, order: int = 5, wide: bool = True, often: int = 5000) -> DataFrame:
    """One row per row of pages: id_col, host, path, rule, verdict, score (length-normalised log ratio over contexts of up to order signs), held_out (from teaching), model_verdict (without the rules)."""
    host, path = host_and_path(url_col)
    rows = pages.select(F.col(id_col).alias("_id"), host.alias("host"), path.alias("path")).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumn("text", folded(F.col("host"), F.col("path"), order, wide)).withColumn("_row", F.monotonically_increasing_id())
    rows = keep(rows.withColumn("_held_out", F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0))
    verdict = F.col("verdict")
    taught = grams(rows.withColumn("verdict", F.when(~F.col("_held_out"), F.col("_rule.verdict"))), order, "verdict")
    counts = keep(taught.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_if(verdict == "allow").alias("allow"), F.count_if(verdict == "block").alias("block")))
    model = keep(log_ratios(counts, order, len(WIDE) if wide else SIGNS).join(counts.select("gram", "n"), "gram"))
    # Grams with over a share of 1 / often of all places are fewer than often: these alone are sent to all tasks, so no gram is a hot key of the join.
    limit = (model.agg(F.sum("n")).first()[0] or 0) / often
    hot, rare = F.broadcast(model.where(F.col("n") > limit).select("gram", "ratio")), model.where(F.col("n") <= limit).select("gram", "ratio")
    places = grams(rows, order, "_row")
    # A row's grams stand together, so each task sends about one row for each url.
    of_hot = places.join(hot, "gram").groupBy("_row").agg(F.sum("ratio").alias("part"))
    of_rare = places.join(hot, "gram", "left_anti").join(rare.hint("shuffle_hash"), "gram").groupBy("_row").agg(F.sum("ratio").alias("part"))
    scores = of_hot.unionAll(of_rare).groupBy("_row").agg(F.sum("part").alias("part"))
    scored = rows.join(scores, "_row").withColumn("score", F.col("part") / (F.char_length("text") - order))
    scored = keep(scored.select("_id", "host", "path", "_rule", "score", "_held_out"))
    sides = ("allow", "block")
    of = {v: F.when(F.col("_rule.verdict") == v, F.col("score")) for v in sides}
    apart = {v: F.when(F.col("_held_out"), of[v]) for v in sides}
    n = F.least(*[F.count(apart[v]) for v in sides])
    mean, spread = {v: F.avg(apart[v]) for v in sides}, {v: F.stddev_pop(apart[v]) + 1e-9 for v in sides}
    middle = (mean["allow"] * spread["block"] + mean["block"] * spread["allow"]) / (spread["allow"] + spread["block"])
    # Null, which blocks nothing, where one of the classes has no URL at all.
    threshold = F.when(F.count(of["allow"]) * F.count(of["block"]) > 0, F.coalesce(middle * n / (n + CAUTION), F.lit(0.0)))
    by_model = F.when(F.col("score") < scored.agg(threshold).scalar(), "block").otherwise("allow")
    out = scored.withColumn("_by_model", by_model)
    return out.select(F.col("_id").alias(id_col), "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce(F.col("_rule.verdict"), "_by_model").alias("verdict"), "score", F.col("_held_out").alias("held_out"), F.col("_by_model").alias("model_verdict"))
