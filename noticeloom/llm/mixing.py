"""Operator 4: mixing sources to target weights by hierarchical budgeting.

A token budget is propagated through the tree domain - language - source. At each node the children share by weight; a
child that cannot take its share (all its documents, in all epochs) passes the shortage to its siblings, and only what a
whole family cannot take reaches the relatives one level up. Each leaf then takes a prefix of its tokens from seeded
epochs: whole epochs first, then the beginning of one more, in an order drawn from the seed and the epoch's number.

All amounts are whole numbers, so the result is the same on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noticeloom.llm.common import materialize, table, texts

SEED = 11
EPOCHS = 2
#: Share of the corpus' tokens that the mixture has.
BUDGET_PERCENT = 60
TREE = ("domain", "lang", "source")

# The target weights of this corpus; a name that is not listed weighs 1.
DOMAIN_WEIGHTS = {"crawl": 2, "reference": 5, "community": 3}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 2}
#: The domain of a source: its number says it.
DOMAIN = "CASE WHEN source = 'src0' THEN 'crawl' WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6', 'src7', 'src8', 'src9') THEN 'reference' ELSE 'community' END"
#: A token is a run without blanks.
TOKEN = r"[^ \t\n\r\f]+"

_case = lambda column, weights: f"CASE {' '.join(f"WHEN {column} = '{k}' THEN {v}" for k, v in weights.items())} ELSE 1 END"


def _level_sql(n: int) -> str:
    """One level of the budgeting in SQL: children by how soon they are full; those that are full take all they have, the rest share by weight."""
    keys, up = ", ".join(TREE[:n]), ", ".join(TREE[: n - 1]) or "1"
    name = TREE[n - 1]
    parent = f"b{n - 1}.budget" if n > 1 else "(SELECT total FROM whole)"
    join = f"JOIN b{n - 1} USING ({', '.join(TREE[: n - 1])})" if n > 1 else ""
    return f"""c{n} AS (SELECT {keys}, sum(cap) AS cap, max(w{n}) AS w FROM leaf GROUP BY {keys}),
o{n} AS (SELECT c{n}.*, {parent} AS parent, row_number() OVER (PARTITION BY {up} ORDER BY CAST(cap AS DOUBLE) / w, {name}) AS place FROM c{n} {join}),
r{n} AS (SELECT *, sum(cap) OVER (PARTITION BY {up} ORDER BY place) - cap AS before, sum(w) OVER (PARTITION BY {up}) - sum(w) OVER (PARTITION BY {up} ORDER BY place) + w AS wleft FROM o{n}),
f{n} AS (SELECT *, cap * wleft <= (parent - before) * w AS filled FROM r{n}),
s{n} AS (SELECT *, parent - sum(CASE WHEN filled THEN cap ELSE 0 END) OVER (PARTITION BY {up}) AS rest, sum(CASE WHEN filled THEN 0 ELSE w END) OVER (PARTITION BY {up}) AS wrest FROM f{n}),
g{n} AS (SELECT *, CASE WHEN filled THEN cap ELSE DIV(rest * w, wrest) END AS share FROM s{n}),
h{n} AS (SELECT *, parent - sum(share) OVER (PARTITION BY {up}) AS over, row_number() OVER (PARTITION BY {up}, filled ORDER BY place) AS turn FROM g{n}),
b{n} AS (SELECT {keys}, share + CASE WHEN NOT filled AND turn <= over THEN 1 ELSE 0 END AS budget FROM h{n})"""


ORACLE = f"""
WITH docs AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '{TOKEN}')) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS text_md5 FROM documents),
placed AS (SELECT *, {DOMAIN} AS domain FROM docs),
leaf AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens, CAST(sum(n_tokens) * {EPOCHS} AS HUGEINT) AS cap, max({_case("domain", DOMAIN_WEIGHTS)}) AS w1, max({_case("lang", LANG_WEIGHTS)}) AS w2, 1 AS w3 FROM placed GROUP BY domain, lang, source),
whole AS (SELECT least(sum(cap), sum(tokens) * {BUDGET_PERCENT} // 100) AS total FROM leaf),
{", ".join(_level_sql(n).replace("DIV(rest * w, wrest)", "rest * w // wrest") for n in (1, 2, 3))},
taken AS (SELECT domain, lang, source, CASE WHEN tokens = 0 THEN 0 ELSE budget // tokens END AS full_epochs, CASE WHEN tokens = 0 THEN 0 ELSE budget % tokens END AS prefix FROM b3 JOIN leaf USING (domain, lang, source)),
ordered AS (SELECT p.*, full_epochs, prefix, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || CAST(full_epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || text_md5), doc_id, text_md5) - n_tokens AS before FROM placed p JOIN taken USING (domain, lang, source))
SELECT doc_id, domain, lang, source, n_tokens, CAST(full_epochs AS BIGINT) AS full_epochs, CAST(greatest(0, least(n_tokens, prefix - before)) AS BIGINT) AS prefix_tokens, CAST(full_epochs * n_tokens + greatest(0, least(n_tokens, prefix - before)) AS BIGINT) AS taken_tokens FROM ordered
"""


def _share(children: DataFrame, level: int) -> DataFrame:
    """Adds budget to rows (the first `level` keys of the tree, cap, w, parent): water-filling among siblings, exact in whole numbers."""
    family, name = list(TREE[: level - 1]), TREE[level - 1]
    whole = lambda c: c.cast("decimal(38,0)")
    order = Window.partitionBy(*family).orderBy(F.col("cap").cast("double") / F.col("w"), name)
    every = Window.partitionBy(*family)
    rows = children.withColumn("place", F.row_number().over(order))
    upto = every.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"before": F.sum("cap").over(upto) - F.col("cap"), "wleft": F.sum("w").over(every) - F.sum("w").over(upto) + F.col("w")})
    rows = rows.withColumn("filled", whole(F.col("cap")) * whole(F.col("wleft")) <= whole(F.col("parent") - F.col("before")) * whole(F.col("w")))
    rows = rows.withColumns({"rest": F.col("parent") - F.sum(F.when(F.col("filled"), F.col("cap")).otherwise(0)).over(every), "wrest": F.sum(F.when(F.col("filled"), 0).otherwise(F.col("w"))).over(every)})
    rows = rows.withColumn("share", F.when(F.col("filled"), F.col("cap")).otherwise(F.expr("cast(rest as decimal(19,0)) * w div wrest")).cast("long"))
    rows = rows.withColumns({"over": F.col("parent") - F.sum("share").over(every), "turn": F.row_number().over(Window.partitionBy(*family, "filled").orderBy("place"))})
    return rows.select(*family, name, (F.col("share") + F.when(~F.col("filled") & (F.col("turn") <= F.col("over")), 1).otherwise(0)).alias("budget"))


def leaf_budgets(leaves: DataFrame, total: int) -> DataFrame:
    """Leaf rows (domain, lang, source, tokens, cap, w1, w2, w3) with their budget of the total, which is at most the sum of caps."""
    budgets = None
    for level in (1, 2, 3):
        keys = list(TREE[:level])
        children = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.max(f"w{level}").cast("long").alias("w"))
        children = children.withColumn("parent", F.lit(total).cast("long")) if budgets is None else children.join(budgets.withColumnRenamed("budget", "parent"), keys[:-1])
        budgets = _share(children, level)
    return leaves.join(budgets, list(TREE))


def _order(epoch: Column) -> Column:
    """A document's place in an epoch: 32 hexadecimal digits, drawn by id and text, so that rows which share an id or have none lie apart."""
    return F.md5(F.concat(F.lit(f"{SEED}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text_md5"))


def mixed(documents: DataFrame, domain: str = DOMAIN, budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, domain_weights: dict[str, int] = DOMAIN_WEIGHTS, lang_weights: dict[str, int] = LANG_WEIGHTS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, full_epochs, prefix_tokens, taken_tokens for each row of documents; with keep also kept, a struct of its columns of those names.

    A document comes full_epochs times whole and once more with its first prefix_tokens tokens (0: not again). The last
    document of a leaf's prefix is the only one that may be cut. Null lang and source count as '', an empty text has no
    tokens and takes part with none; rows that share a doc_id, or have none, are documents by their texts. Weights are whole
    numbers; up to 10 ** 18 tokens in all.

    A leaf may hold any share of the rows: its prefix is found from sums over about the square root of its number of
    slices of the order, and only the slice in which the prefix ends is ordered by rows.
    """
    word_count = F.regexp_count("text", F.lit(TOKEN)).cast("long")
    carried = [F.struct(*(F.col(c) for c in keep)).alias("kept")] if keep else []
    rows = documents.select("doc_id", "text", "lang", "source", *carried)
    own = ["kept"] if keep else []
    docs = texts(rows, "lang", "source", *own).select("doc_id", *own, *(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), word_count.alias("n_tokens"), F.md5("text").alias("text_md5"))
    docs = materialize(docs.withColumn("domain", F.expr(domain)), "token-counts")
    sums = docs.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    leaves = materialize(sums.select("*", (F.col("tokens") * epochs).alias("cap"), F.expr(_case("domain", domain_weights)).alias("w1"), F.expr(_case("lang", lang_weights)).alias("w2"), F.lit(1).alias("w3")), "leaves")
    whole = leaves.agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens")).first()
    total = min(whole.cap or 0, (whole.tokens or 0) * budget_percent // 100)
    some = F.col("tokens") > 0
    slices = F.greatest(F.ceil(F.sqrt("rows")), F.lit(1)).cast("long")
    budgets = materialize(leaf_budgets(leaves, total).select(*TREE, F.when(some, F.expr("budget div tokens")).otherwise(0).alias("full_epochs"), F.when(some, F.col("budget") % F.col("tokens")).otherwise(0).alias("prefix"), slices.alias("slices")), "leaf-budgets")
    placed = docs.join(budgets, list(TREE)).withColumn("place", _order(F.col("full_epochs")))
    placed = materialize(placed.withColumn("slice", F.expr("cast(conv(substring(place, 1, 8), 16, 10) as bigint) * slices div 4294967296")), "placed")
    keys = [*TREE, "slice"]
    totals = placed.groupBy(*keys).agg(F.sum("n_tokens").alias("slice_tokens"), F.max("prefix").alias("prefix"))
    before = F.sum("slice_tokens").over(Window.partitionBy(*TREE).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("slice_tokens")
    starts = materialize(totals.withColumn("slice_before", before).select(*keys, "slice_before", ((F.col("slice_before") < F.col("prefix")) & (F.col("prefix") < F.col("slice_before") + F.col("slice_tokens"))).alias("ends_here")), "slices")
    placed = placed.join(starts, keys)
    inside = F.sum("n_tokens").over(Window.partitionBy(*keys).orderBy("place", "doc_id", "text_md5").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    cut = placed.where("ends_here").withColumn("prefix_tokens", F.greatest(F.lit(0), F.least("n_tokens", F.col("prefix") - F.col("slice_before") - inside)))
    uncut = placed.where("not ends_here").withColumn("prefix_tokens", F.when(F.col("slice_before") < F.col("prefix"), F.col("n_tokens")).otherwise(0))
    rows = cut.unionByName(uncut)
    return rows.select("doc_id", *TREE, "n_tokens", F.col("full_epochs").cast("long"), F.col("prefix_tokens").cast("long").alias("prefix_tokens"), (F.col("full_epochs") * F.col("n_tokens") + F.col("prefix_tokens")).cast("long").alias("taken_tokens"), *own)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))
