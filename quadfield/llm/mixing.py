"""Mixing sources to target weights by hierarchical budgeting (DataFrame operations only).

Documents are leaves' rows of a tree domain > language > source.  A token is a word between ASCII white space.  The token budget
goes down the tree: at each node it is shared among the children by their weights; a child takes at most its capacity (its tokens
times ``max_epochs``), and what it can't take goes to its siblings by weight until they are full, too.  A node's capacity is the
sum below it, so a shortage only reaches the next ancestor when all siblings are full.  Shares are whole tokens, rounded down;
tokens lost to rounding are not spent.

A leaf with a budget of e full epochs and a rest repeats all its documents e times and adds a prefix of the next epoch: its
documents in an order seeded by (seed, epoch), as long as the running sum of their tokens stays within the rest.  Running sums
are split into parts by the first digits of the order's hash, so a source with a third of all rows is spread over tasks.

Null lang or source form children of their own (``?``); null or empty texts have no tokens: they belong to every epoch whose order
reaches them (a prefix of length zero costs nothing).  Repeated rows are rows of their own.  A child without an entry in its
weight table gets the weight ``default``; a weight of zero takes nothing.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadfield.llm.common import SPACES, row_key, staged, totals_before

SEED = 17
MAX_EPOCHS = 2
#: Share of all tokens that is spent.
SPEND = 0.6
DOMAINS = 3
#: Weights by level; whatever isn't named gets the default.
DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS = {"d0": 3, "d1": 2, "d2": 1}, {"en": 4, "de": 2, "fr": 2, "es": 2}, {"src0": 2}
DEFAULT_WEIGHT = 1
_LEVELS = ["domain", "language", "origin"]


def tokens(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """Domains of the synthetic sources: their number modulo three."""
    return F.concat(F.lit("d"), F.pmod(F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0)), F.lit(DOMAINS)).cast("string"))


def _weight(name: str, table: dict[str, int], default: int) -> Column:
    out = F.lit(default)
    for k, w in sorted(table.items()):
        out = F.when(F.col(name) == k, w).otherwise(out)
    return out.cast("long")


def _shared(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """``budget`` of each child from ``have`` (of its parent), ``weight`` and ``room``: full children first, the rest by weight.

    In the order of room per weight the children that fill up are a prefix: child i fills up if what is left after the children
    before it, shared by weight among it and those after it, is at least its room.
    """
    order = [F.try_divide(F.col("room").cast("double"), F.col("weight")).asc_nulls_last(), *_LEVELS]
    order = [o for o in order if not isinstance(o, str) or o in nodes.columns]
    up = Window.partitionBy(*parents).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parents)
    live = nodes.filter("weight > 0 AND room > 0")
    live = live.withColumn("left", F.greatest(F.col("have") - F.coalesce(F.sum("room").over(up), F.lit(0)), F.lit(0)))
    live = live.withColumn("rest", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up), F.lit(0)))
    live = live.withColumn("full", F.col("left").cast("decimal(20,0)") * F.col("weight") >= F.col("room").cast("decimal(20,0)") * F.col("rest"))
    cut = live.withColumn("spare", F.min(F.when(~F.col("full"), F.struct(F.negative("rest").alias("k"), "left", "rest"))).over(whole))
    share = F.expr("CAST((CAST(spare.left AS DECIMAL(20,0)) * weight) DIV spare.rest AS BIGINT)")
    return cut.withColumn("budget", F.when(F.col("full"), F.col("room")).otherwise(F.least(share, F.col("room")))).drop("left", "rest", "full", "spare", "have")


def budgets(leaves: DataFrame, total: int | Column, max_epochs: int = MAX_EPOCHS, weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), default: int = DEFAULT_WEIGHT) -> DataFrame:
    """(domain, language, origin, held, budget) for the leaves (domain, language, origin, held)."""
    base = leaves.withColumn("room", F.col("held") * max_epochs)
    root = F.lit(total).cast("long") if isinstance(total, int) else total
    above: DataFrame | None = None
    for depth in range(1, 4):
        keys = _LEVELS[:depth]
        nodes = base.groupBy(*keys).agg(F.sum("room").alias("room"), F.sum("held").alias("held")).withColumn("weight", _weight(keys[-1], weights[depth - 1], default))
        nodes = nodes.withColumn("have", root) if above is None else nodes.join(above, keys[:-1])
        above = _shared(nodes, keys[:-1] or [F.lit(0)])
        found = above
        above = above.select(*keys, F.col("budget").alias("have"))
    return found.select(*_LEVELS, "held", "budget")


def _leaves(docs: DataFrame, domain: Column | None) -> DataFrame:
    domain = domain_of(F.col("source")) if domain is None else domain
    return docs.select(
        "doc_id", "__key", tokens(F.col("text")).alias("tokens"), F.coalesce(domain, F.lit("?")).alias("domain"),
        F.coalesce("lang", F.lit("?")).alias("language"), F.coalesce("source", F.lit("?")).alias("origin"),
    )


def select_epochs(docs: DataFrame, spend: float = SPEND, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights=(DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS), default: int = DEFAULT_WEIGHT, domain: Column | None = None) -> DataFrame:
    """(doc_id, __key, domain, language, origin, tokens, epoch): one row for each time a document is taken, epochs from 0."""
    rows = staged(_leaves(docs.withColumn("__key", row_key(docs)), domain))
    leaves = rows.groupBy(*_LEVELS).agg(F.sum("tokens").alias("held"))
    root = leaves.agg(F.floor(F.sum("held") * F.lit(spend).cast("decimal(6,4)")).cast("long").alias("total")).first()
    plan = staged(budgets(leaves, int(root.total or 0), max_epochs, weights, default))
    plan = plan.select(*_LEVELS, F.expr("budget DIV held").alias("full"), F.expr("budget % held").alias("rest"))
    taken = rows.join(plan, _LEVELS)
    whole = taken.filter("full > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)))
    last = taken.withColumn("epoch", F.col("full")).withColumn("place", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch"), F.coalesce(F.col("doc_id").cast("string"), F.lit("?")))))
    last = last.filter("rest > 0").withColumn("part", F.substring("place", 1, 3))
    last = totals_before(last, _LEVELS, "part", ["place", "doc_id", "__key"], "tokens", "before").filter("before + tokens <= rest")
    out = ["doc_id", "__key", *_LEVELS, "tokens", "epoch"]
    return whole.select(*out).unionByName(last.select(*out))


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The documents of the mixture with all their columns, one row for each time a document is taken.

    Rows that agree in doc_id, text and leaf can't be told apart by the selection: what was taken of them is dealt among them, as
    evenly as it goes.  They are numbered along stored row ids in parts, so their number may be of any size.
    """
    own = ["__doc", "__k", "__domain", "__language", "__origin"]
    taken = select_epochs(docs, **settings).groupBy("doc_id", "__key", *_LEVELS).agg(F.count(F.lit(1)).alias("__taken")).toDF(*own, "__taken")
    keyed = docs.withColumn("__key", row_key(docs))
    leaf = _leaves(keyed, settings.get("domain")).drop("tokens")
    rows = leaf.groupBy(*leaf.columns).agg(F.count(F.lit(1)).alias("__rows")).filter("__rows > 1").toDF(*own, "__rows")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in own]
    taken = staged(taken.alias("a").join(rows.alias("b"), same, "left").select("a.*", F.coalesce("__rows", F.lit(1)).alias("__rows")))
    domain = settings.get("domain")
    domain = domain_of(F.col("source")) if domain is None else domain
    match = F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("__key") == F.col("__k")) & (F.coalesce(domain, F.lit("?")) == F.col("__domain"))
    match = match & (F.coalesce("lang", F.lit("?")) == F.col("__language")) & (F.coalesce("source", F.lit("?")) == F.col("__origin"))
    alone = keyed.join(taken.filter("__rows = 1"), match).select(*docs.columns, F.col("__taken").alias("__times"))
    several = taken.filter("__rows > 1")
    if not several.isEmpty():
        several = keyed.join(several, match).select(*docs.columns, *own, "__taken", "__rows")
        several = staged(several.withColumns({"__one": F.lit(1), "__id": F.monotonically_increasing_id()})).withColumn("__part", F.pmod("__id", F.lit(4096)))
        several = totals_before(several, own, "__part", ["__id"], "__one", "__no")
        times = F.expr("__taken DIV __rows") + F.when(F.col("__no") < F.col("__taken") % F.col("__rows"), 1).otherwise(0)
        alone = alone.unionByName(several.select(*docs.columns, times.cast("long").alias("__times")).filter("__times > 0"))
    return alone.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "__times"))).select(*docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    return select_epochs(docs).drop("__key")


def _case(name: str, table: dict[str, int]) -> str:
    return "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {w}" for k, w in sorted(table.items())) + f" ELSE {DEFAULT_WEIGHT} END"


def _level(keys: list[str], table: dict[str, int], above: str | None) -> str:
    """SQL of one level: the same rule, children in the order of room per weight."""
    name, up = f"n{len(keys)}", ", ".join(keys[:-1]) or "1"
    have = "(SELECT total FROM root)" if above is None else "have"
    join = "" if above is None else f" JOIN (SELECT {up}, budget AS have FROM {above}) USING ({up})"
    ks = ", ".join(keys)
    return f"""
{name}a AS (SELECT *, {have} AS given FROM (SELECT {ks}, sum(held)::BIGINT AS held, sum(held)::BIGINT * {MAX_EPOCHS} AS room, {_case(keys[-1], table)}::BIGINT AS weight FROM leaf GROUP BY {ks}){join}),
{name}b AS (SELECT *, greatest(given - coalesce(sum(room) OVER w, 0), 0)::HUGEINT AS lft, sum(weight) OVER (PARTITION BY {up}) - coalesce(sum(weight) OVER w, 0) AS rst
            FROM {name}a WHERE weight > 0 AND room > 0 WINDOW w AS (PARTITION BY {up} ORDER BY room::DOUBLE / weight, {ks} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}c AS (SELECT *, lft * weight >= room::HUGEINT * rst AS ful FROM {name}b),
{name}d AS (SELECT *, max(CASE WHEN NOT ful THEN rst END) OVER (PARTITION BY {up}) AS srst, max(CASE WHEN NOT ful THEN lft END) OVER (PARTITION BY {up}) AS slft FROM {name}c),
{name} AS (SELECT {ks}, held, CASE WHEN ful THEN room ELSE least((slft * weight // srst)::BIGINT, room) END AS budget FROM {name}d)"""


ORACLE = f"""
WITH t AS (SELECT doc_id, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> ''))::BIGINT AS tokens,
                  'd' || (coalesce(try_cast(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INT), 0) % {DOMAINS}) AS domain, coalesce(lang, '?') AS language, coalesce(source, '?') AS origin FROM documents),
leaf AS (SELECT domain, language, origin, sum(tokens)::BIGINT AS held FROM t GROUP BY ALL),
root AS (SELECT floor(sum(held) * {SPEND}::DECIMAL(6,4))::BIGINT AS total FROM leaf),{_level(_LEVELS[:1], DOMAIN_WEIGHTS, None)},{_level(_LEVELS[:2], LANG_WEIGHTS, "n1")},{_level(_LEVELS, SOURCE_WEIGHTS, "n2")},
taken AS (SELECT t.*, budget // held AS times, budget % held AS rest FROM t JOIN n3 USING (domain, language, origin)),
ends AS (SELECT *, md5(concat_ws(':', '{SEED}', times, doc_id)) AS place FROM taken),
last AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, language, origin ORDER BY place, doc_id) AS upto FROM ends)
SELECT doc_id, domain, language, origin, tokens, unnest(range(times)) AS epoch FROM taken
UNION ALL SELECT doc_id, domain, language, origin, tokens, times AS epoch FROM last WHERE upto <= rest AND rest > 0
"""
