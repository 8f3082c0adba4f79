"""Mixing sources to target weights by hierarchical budgeting.

Documents are the leaves' supply in a tree of domain, language and source. A budget
of tokens flows down from the root: each node shares what it gets among its children
in proportion to their weights, but none gets more than its subtree can supply
(its tokens, ``max_epochs`` times). What a child can't take goes to its siblings
first; as a node's supply is that of its whole subtree, only what all siblings
together can't take stays with ancestors and goes to their siblings.

From each leaf a prefix of its seeded epochs is selected: in each epoch a leaf's
documents come in the order of a hash of seed, epoch and key. Whole epochs are taken
first, then documents of the next one while their tokens fit.

How it runs: tokens are counted once, into a table of numbers. Where a leaf's last
epoch is cut, a histogram over 4096 ranges of the hash tells in which range; only
the documents of that range are put in order. No text is moved and no leaf, however
large, is sorted. What is joined to the documents has one row for each leaf; Spark
broadcasts it if it is small enough.

Tokens are runs of characters other than blanks unless ``tokens`` gives a column.

Defined results:

* a null language or source counts as an empty one; sources without a domain are in
  "other"; weights not given are 1; a subtree of weight 0 gets nothing;
* shares are whole tokens, rounded down, so siblings together may lack some few;
* a null or empty text has no tokens: it costs nothing and comes in every epoch that
  reaches its hash; a leaf without any tokens gets nothing; a very long text is one
  document: it comes whole, where its tokens fit, or not at all;
* rows with one key have one hash: they are selected together or not at all;
* an empty table gives no rows; columns of other names go through untouched, and
  ``epoch`` is added (in place of a column of that name).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glyphsieve.llm.shared import written

LEAF = ["domain", "lang", "source"]
TOKEN = "[^ \\t\\r\\n\\f]+"


@dataclass(frozen=True)
class Tree:
    """Which domain a source is in, and whole-number weights by name at each level."""

    domains: Mapping[str, list[str]] = field(default_factory=dict)
    domain_weights: Mapping[str, int] = field(default_factory=dict)
    language_weights: Mapping[str, int] = field(default_factory=dict)
    source_weights: Mapping[str, int] = field(default_factory=dict)


#: The tree of the registered queries.
TREE = Tree(
    {"web": [f"src{i}" for i in range(8)], "books": [f"src{i}" for i in range(8, 13)], "forum": [f"src{i}" for i in range(13, 17)], "reference": [f"src{i}" for i in range(17, 20)]},
    {"web": 4, "books": 3, "forum": 1, "reference": 4, "other": 1},
    {"en": 4, "de": 2, "fr": 2, "es": 3},
    {"src0": 1, "src9": 5, "src18": 3},
)
PERCENT = 50
MAX_EPOCHS = 3
SEED = 11


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _weight(column: str, weights: Mapping[str, int]) -> str:
    return "CASE " + column + "".join(f" WHEN {_quoted(k)} THEN {int(v)}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _domain(tree: Tree) -> str:
    cases = "".join(f" WHEN source IN ({', '.join(map(_quoted, names))}) THEN {_quoted(d)}" for d, names in tree.domains.items() if names)
    return f"CASE{cases} ELSE 'other' END" if cases else "'other'"


def _shared(nodes: DataFrame, parent: list[str], child: list[str]) -> DataFrame:
    """``share`` of each child: water filling of the parent's ``budget`` up to ``cap`` by ``w``."""
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap").cast("double") / F.col("w").cast("double"), *child)
    whole = "decimal(38,0)"
    one = nodes.withColumns(
        {
            "w_rest": F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(whole),
            "b_rest": (F.col("budget") - F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).cast(whole),
        }
    ).withColumn("full", F.expr("cast(cap as decimal(20,0)) * cast(w_rest as decimal(17,0)) <= cast(w as decimal(17,0)) * cast(b_rest as decimal(20,0))"))
    two = one.withColumns(
        {
            "b_left": (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(by), F.lit(0))).cast("decimal(20,0)"),
            "w_left": F.sum(F.when(~F.col("full"), F.col("w"))).over(by).cast("decimal(17,0)"),
        }
    )
    return two.withColumn("share", F.expr("case when full then cap else (cast(w as decimal(17,0)) * b_left) div w_left end").cast("long"))


def allocate(supply: DataFrame, tree: Tree = TREE, *, budget: int | None = None, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(domain, lang, source, supply, share) from (domain, lang, source, supply): each leaf's part of the budget.

    Without a budget it is ``percent`` of all supply."""
    leaves = supply.filter("supply > 0").selectExpr(*LEAF, "supply", f"supply * {int(max_epochs)} AS cap", f"{_weight('domain', tree.domain_weights)} AS wd", f"{_weight('lang', tree.language_weights)} AS wl", f"{_weight('source', tree.source_weights)} AS w")
    leaves = leaves.filter("wd > 0 AND wl > 0 AND w > 0")
    total = supply.agg(F.coalesce(F.expr(f"sum(supply) * {int(percent)} div 100"), F.lit(0)).alias("budget")) if budget is None else None
    domains = leaves.groupBy("domain").agg(F.sum("cap").alias("cap"), F.first("wd").alias("w"))
    domains = domains.crossJoin(total) if total is not None else domains.withColumn("budget", F.lit(int(budget)).cast("long"))
    domains = _shared(domains, [], ["domain"]).select("domain", F.col("share").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"), F.first("wl").alias("w")).join(domains, "domain")
    langs = _shared(langs, ["domain"], ["lang"]).select("domain", "lang", F.col("share").alias("budget"))
    return _shared(leaves.select(*LEAF, "supply", "cap", "w").join(langs, ["domain", "lang"]), ["domain", "lang"], ["source"]).select(*LEAF, "supply", "share")


def _hash(seed: int, epoch: str, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(epoch).cast("string"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def plan(numbers: DataFrame, tree: Tree = TREE, *, seed: int = SEED, **budget) -> DataFrame:
    """(domain, lang, source, supply, share, whole, until) from (key, domain, lang, source, tokens).

    whole: epochs that are taken in full; until: the last hash taken in the next one, or null."""
    supply = numbers.groupBy(*LEAF).agg(F.sum("tokens").cast("long").alias("supply"))
    leaves = written(allocate(supply, tree, **budget).selectExpr("*", "share div supply AS whole", "share % supply AS rest"))
    cut = leaves.filter("rest > 0").select(*LEAF, "whole", "rest")
    keyed = numbers.join(cut, LEAF).withColumn("hash", _hash(seed, "whole", "key")).withColumn("range", F.substring("hash", 1, 3))
    ranges = keyed.groupBy(*LEAF, "range").agg(F.sum("tokens").alias("tokens"), F.first("rest").alias("rest"))
    before = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, 0))
    border = written(ranges.withColumn("after", before).filter("after > rest AND after - tokens <= rest").select(*LEAF, "range", (F.col("rest") - F.col("after") + F.col("tokens")).alias("room")))
    inside = keyed.select(*LEAF, "range", "hash", "tokens").join(border, [*LEAF, "range"])
    running = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("hash").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    last = inside.withColumn("sum", running).filter("sum <= room").groupBy(*LEAF).agg(F.max("hash").alias("last"))
    until = border.join(last, LEAF, "left").select(*LEAF, F.coalesce("last", "range").alias("until"))  # a range sorts before its hashes
    return written(leaves.drop("rest").join(until, LEAF, "left"))


def _numbered(docs: DataFrame, key: str, text: str, lang: str, source: str, tree: Tree, tokens: Column | None) -> list[Column]:
    count = tokens if tokens is not None else F.regexp_count(docs[text], F.lit(TOKEN))
    return [docs[key].alias("key"), F.coalesce(docs[lang].cast("string"), F.lit("")).alias("lang"), F.coalesce(docs[source].cast("string"), F.lit("")).alias("source"), F.coalesce(count.cast("long"), F.lit(0)).alias("tokens")]


def _epochs(rows: DataFrame, leaves: DataFrame, seed: int) -> DataFrame:
    """The rows (with key, domain, lang, source) once for each epoch that takes them."""
    joined = rows.join(leaves.select(*LEAF, "whole", "until"), LEAF)
    each = joined.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("epoch"))
    return each.filter((F.col("epoch") < F.col("whole")) | (_hash(seed, "epoch", "key") <= F.col("until")))


def _sized(docs: DataFrame, key: str, text: str, lang: str, source: str, tree: Tree, tokens: Column | None) -> DataFrame:
    return written(docs.select(*_numbered(docs, key, text, lang, source, tree, tokens)).selectExpr("key", f"{_domain(tree)} AS domain", "lang", "source", "tokens"))


def selection(docs: DataFrame, tree: Tree = TREE, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tokens: Column | None = None, seed: int = SEED, **budget) -> DataFrame:
    """(key, epoch, domain, lang, source, tokens): what is selected, without the texts."""
    numbers = _sized(docs, key, text, lang, source, tree, tokens)
    return _epochs(numbers, plan(numbers, tree, seed=seed, **budget), seed).select(F.col("key").alias(key), F.col("epoch").cast("int").alias("epoch"), *LEAF, "tokens")


def mixed(docs: DataFrame, tree: Tree = TREE, *, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source", tokens: Column | None = None, seed: int = SEED, **budget) -> DataFrame:
    """The selected rows with all their columns, and ``epoch``: a row comes once for each epoch that takes it."""
    leaves = plan(_sized(docs, key, text, lang, source, tree, tokens), tree, seed=seed, **budget)
    rest = [c for c in docs.columns if c.lower() != "epoch"]
    rows = docs.select(F.struct(*(docs[c] for c in rest)).alias("row"), *_numbered(docs, key, text, lang, source, tree, F.lit(0))).selectExpr("row", "key", f"{_domain(tree)} AS domain", "lang", "source")
    return _epochs(rows, leaves, seed).select("row.*", F.col("epoch").cast("int").alias("epoch"))


def _sql_shares(name: str, nodes: str, parent: str, child: str) -> str:
    by, order = f"PARTITION BY {parent}", f"PARTITION BY {parent} ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {child}"
    return f"""{name}_1 AS (
  SELECT *, sum(w) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest,
    budget - coalesce(sum(cap) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b_rest FROM ({nodes})
), {name}_2 AS (
  SELECT *, CAST(cap AS HUGEINT) * w_rest <= CAST(w AS HUGEINT) * b_rest AS is_full FROM {name}_1
), {name} AS (
  SELECT *, CASE WHEN is_full THEN cap ELSE CAST(w AS HUGEINT) * (budget - coalesce(sum(cap) FILTER (is_full) OVER ({by}), 0)) // coalesce(sum(w) FILTER (NOT is_full) OVER ({by}), 1) END AS share FROM {name}_2
)"""


def oracle(tree: Tree = TREE, percent: int = PERCENT, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> str:
    """The rows of selection() in DuckDB's SQL; here each leaf is put in order as a whole."""
    return f"""
WITH numbers AS (
  SELECT doc_id, {_domain(tree)} AS domain, lang, source, tokens FROM (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '{TOKEN}')), 0) AS BIGINT) AS tokens FROM documents)
), supply AS (
  SELECT domain, lang, source, sum(tokens) AS supply FROM numbers GROUP BY ALL
), leaves AS (
  SELECT *, supply * {max_epochs} AS cap, {_weight("domain", tree.domain_weights)} AS wd, {_weight("lang", tree.language_weights)} AS wl, {_weight("source", tree.source_weights)} AS w FROM supply WHERE supply > 0
), used AS (SELECT * FROM leaves WHERE wd > 0 AND wl > 0 AND w > 0
), {_sql_shares("d", f"SELECT domain, sum(cap) AS cap, first(wd) AS w, (SELECT sum(supply) * {percent} // 100 FROM supply) AS budget FROM used GROUP BY domain", "0", "domain")}
, {_sql_shares("l", "SELECT u.domain, u.lang, sum(u.cap) AS cap, first(u.wl) AS w, first(d.share) AS budget FROM used u JOIN d ON u.domain = d.domain GROUP BY u.domain, u.lang", "domain", "lang")}
, {_sql_shares("s", "SELECT u.domain, u.lang, u.source, u.supply, u.cap, u.w, l.share AS budget FROM used u JOIN l ON u.domain = l.domain AND u.lang = l.lang", "domain, lang", "source")}
, picked AS (
  SELECT domain, lang, source, share // supply AS whole, share % supply AS rest FROM s
), epochs AS (
  SELECT n.*, p.whole, p.rest, unnest(range(0, CAST(p.whole + 1 AS BIGINT))) AS epoch FROM numbers n JOIN picked p ON n.domain = p.domain AND n.lang = p.lang AND n.source = p.source
), ordered AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('{seed}|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), ''))) AS until FROM epochs
)
SELECT doc_id, CAST(epoch AS INTEGER) AS epoch, domain, lang, source, tokens FROM ordered WHERE epoch < whole OR (rest > 0 AND until <= rest)
"""
