"""Mixing sources to target weights, with DataFrame functions only.

``plan_mixture`` builds the tree domain / language / source from aggregated token counts and hands a token budget down
it. Each level is water-filled: children get budget in proportion to their weights, a child that cannot supply its
share (tokens times ``max_epochs``) gives all it has, and what it lacks goes to its siblings by weight. As a parent's
budget never exceeds what its whole subtree can supply, siblings absorb every shortage first; only what a whole family
lacks is passed to the parent's own siblings. Water-filling is closed form (one window over the children sorted by
supply / weight), in exact integer arithmetic.

``select_mixture`` turns each leaf's budget into whole epochs and a token prefix of one more. That epoch is a seeded
permutation, ordered by md5(seed : epoch : doc_id). The prefix's end is found by digits of that key: sums per (leaf, first two
hex digits), then of the next two within the pair of digits that holds the end, and so on, so no task orders more than 256
sums of a leaf, whatever it holds (the last step orders the keys that share six digits); every document then decides for itself by
comparing its key with its leaf's cut. Texts are counted where they lie and never shuffled.

Defined results. A null domain, language, source or text counts as ''. Null doc_id is the key ''. Documents without
tokens: 0 epochs' worth, taken only as their key falls before the cut. Rows that share a doc_id in a leaf fall on the
same side of the cut; at the cut they share the tokens left in proportion, rounded down. Negative or null weights are
0; a node without a weight gets ``default_weight``; weight 0 excludes a subtree. Ties in supply / weight are ordered by
name. Shares are rounded down, so up to one token per node may stay unassigned. Empty tables give no rows. Other columns may have any
names but those that begin with the prefix ("__mix_") of what ``select_mixture`` adds; ``keep_mixture`` takes any.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import broadcast_if_small, free_prefix, materialize

LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class MixtureSpec:
    """weights: level -> {name: integer weight among its siblings}. budget_percent: the budget as a share of all tokens;
    total_tokens overrides it."""

    weights: dict = field(default_factory=dict)
    default_weight: int = 1
    budget_percent: int = 60
    total_tokens: int | None = None
    max_epochs: int = 3
    seed: str = "mix-1"


def words(text: Column) -> Column:
    """Number of maximal runs of characters other than space, tab, line feed, carriage return."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \t\n\r]+")).cast("long")


def _weight(level: str, spec: MixtureSpec) -> Column:
    known = spec.weights.get(level, {})
    if not known:
        return F.lit(int(spec.default_weight)).cast("long")
    table = F.create_map(*[F.lit(x) for k, v in sorted(known.items()) for x in (k, max(0, int(v or 0)))])
    return F.coalesce(F.element_at(table, F.col(f"__mix_{level}")), F.lit(int(spec.default_weight))).cast("long")


def _fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes: parent keys, name, cap, weight, budget (of the parent; same for all siblings). Adds alloc."""
    big = "decimal(38,0)"
    order = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))
    live = F.col("weight") > 0
    ratio = F.when(live, F.col("cap") / F.col("weight")).otherwise(F.lit(0.0))
    upto = order.orderBy("ratio", name).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = order.orderBy("ratio", name).rowsBetween(1, W.unboundedFollowing)
    x = nodes.withColumn("ratio", ratio)
    x = x.withColumn("__c", F.sum("cap").over(upto).cast(big)).withColumn("__w", F.coalesce(F.sum("weight").over(after), F.lit(0)).cast(big))
    full = F.col("__c") * F.col("weight").cast(big) + F.col("cap").cast(big) * F.col("__w") <= F.col("budget").cast(big) * F.col("weight").cast(big)
    x = x.withColumn("__full", full | ~live)
    spare = F.col("budget") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("cap"))).over(order), F.lit(0))
    open_w = F.coalesce(F.sum(F.when(~F.col("__full"), F.col("weight"))).over(order), F.lit(0))
    x = x.withColumn("__spare", spare).withColumn("__open", open_w)
    share = F.expr("cast((cast(__spare as decimal(19,0)) * cast(weight as decimal(19,0))) div cast(greatest(__open, 1) as decimal(19,0)) as bigint)")
    return x.withColumn("alloc", F.when(F.col("__full"), F.col("cap")).otherwise(share)).drop("ratio", "__c", "__w", "__full", "__spare", "__open")


def plan_mixture(leaves: DataFrame, spec: MixtureSpec) -> DataFrame:
    """leaves: __mix_domain, __mix_lang, __mix_source, docs, tokens. Returns one row per leaf with its budget ``alloc``."""
    d, l, s = (f"__mix_{x}" for x in LEVELS)
    base = leaves.select(d, l, s, "docs", "tokens", *[_weight(x, spec).alias(f"w_{x}") for x in LEVELS])
    base = base.withColumn("cap", F.when((F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0), F.col("tokens") * spec.max_epochs).otherwise(F.lit(0).cast("long")))
    whole = W.partitionBy(F.lit(0))
    total = F.lit(int(spec.total_tokens)).cast("long") if spec.total_tokens is not None else F.floor(F.sum("tokens").over(whole) * int(spec.budget_percent) / 100).cast("long")
    dom = base.groupBy(d).agg(F.sum("cap").cast("long").alias("cap"), F.max("w_domain").alias("weight"), F.sum("tokens").cast("long").alias("tokens"))
    dom = dom.withColumn("budget", F.least(total, F.sum("cap").over(whole)).cast("long"))
    dom = _fill(dom, [], d).select(d, F.col("alloc").alias("budget"))
    lang = base.groupBy(d, l).agg(F.sum("cap").cast("long").alias("cap"), F.max("w_lang").alias("weight"))
    lang = _fill(lang.join(dom, d), [d], l).select(d, l, F.col("alloc").alias("budget"))
    src = base.withColumn("weight", F.col("w_source")).join(lang, [d, l])
    return _fill(src, [d, l], s).select(d, l, s, "docs", "tokens", "alloc")


def _edge(sums: DataFrame, leaf: list[str], by: str) -> DataFrame:
    """sums: leaf, by, t (of one value of by, each once) and rest, the tokens wanted of a leaf. The leaf, that value of by where a running
    sum of t reaches rest, the part of rest left for it, and its t."""
    upto = W.partitionBy(*leaf).orderBy(by).rowsBetween(W.unboundedPreceding, W.currentRow)
    found = sums.withColumn("upto", F.sum("t").over(upto)).where("upto - t < rest and upto >= rest")
    return found.select(*leaf, by, (F.col("rest") - F.col("upto") + F.col("t")).cast("long").alias("rest"), F.col("t").cast("long").alias("t"))


def _cuts(slim: DataFrame, plan: DataFrame, leaf: list[str], few: int, spec: MixtureSpec) -> DataFrame:
    """leaf, cut, cut_left, cut_tokens: the key at which the prefix of a leaf's last epoch ends, what is left for it, and what it has.
    slim: leaf, id, tokens; plan: leaf, epochs, rest."""
    key = F.md5(F.concat_ws(":", F.lit(spec.seed), F.col("epochs").cast("string"), F.col("id")))
    keyed = slim.join(broadcast_if_small(plan.where("rest > 0").select(*leaf, "epochs", "rest"), few), leaf).withColumn("key", key)
    digit = lambda k: F.substring("key", 2 * k - 1, 2).alias(f"d{k}")
    total = [F.sum("t").alias("t"), F.first("rest").alias("rest")]
    two = materialize(keyed.select(*leaf, "rest", F.col("tokens").alias("t"), digit(1), digit(2)).groupBy(*leaf, "d1", "d2").agg(*total), "mix-sums")
    edge = materialize(_edge(two.groupBy(*leaf, "d1").agg(*total), leaf, "d1").drop("t"), "mix-edge")
    narrow = lambda df, edge, keys: df.drop("rest").join(broadcast_if_small(edge, few), [*leaf, *keys])
    edge2 = _edge(narrow(two, edge, ["d1"]).select(*leaf, "d2", "t", "rest"), leaf, "d2").drop("t")
    edge = materialize(edge2.join(edge.select(*leaf, "d1"), leaf), "mix-edge")
    rows = narrow(keyed.select(*leaf, "rest", "key", F.col("tokens").alias("t"), digit(1), digit(2)), edge, ["d1", "d2"])
    rows = materialize(rows.select(*leaf, "key", digit(3), "t", "rest").groupBy(*leaf, "d3", "key").agg(*total), "mix-last")
    edge = _edge(rows.groupBy(*leaf, "d3").agg(*total), leaf, "d3").drop("t")
    last = _edge(narrow(rows, edge, ["d3"]).select(*leaf, "key", "t", "rest"), leaf, "key")
    return last.select(*leaf, F.col("key").alias("cut"), F.col("rest").alias("cut_left"), F.col("t").alias("cut_tokens"))


def select_mixture(docs: DataFrame, domain: Column, spec: MixtureSpec, prefix: str = "__mix_", keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text, lang, source and any others; without text unless keep_text, which counts each text once only) with domain,
    lang, source, tokens, epochs (whole epochs the document is used in) and prefix (tokens used of it in one more epoch), each behind the
    prefix, which no column of docs may have."""
    if free_prefix(docs, prefix) != prefix:
        raise ValueError(f"docs have a column that begins with {prefix}")
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    made = {"domain": blank(domain), "lang": blank(F.col("lang")), "source": blank(F.col("source")), "tokens": words(F.col("text")), "id": blank(F.col("doc_id"))}
    rows = docs.withColumns({prefix + k: v for k, v in made.items()})
    if not keep_text:
        rows = materialize(rows.drop("text"), "mix-tokens")
    leaf = [f"__mix_{x}" for x in LEVELS]
    slim = rows.select(*[F.col(prefix + x).alias(f"__mix_{x}") for x in LEVELS], F.col(prefix + "id").alias("id"), F.col(prefix + "tokens").alias("tokens"))
    slim = materialize(slim, "mix-tokens") if keep_text else slim
    leaves = slim.groupBy(*leaf).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    epochs = F.when(F.col("tokens") > 0, F.expr("alloc div tokens")).otherwise(F.lit(0)).cast("long")
    plan = plan_mixture(leaves, spec).withColumn("epochs", epochs)
    plan = materialize(plan.withColumn("rest", F.col("alloc") - F.col("epochs") * F.col("tokens")), "mix-plan")
    few = plan.count()
    full = plan.select(*leaf, "epochs").join(_cuts(slim, plan, leaf, few, spec), leaf, "left")
    at = {f"__mix_{x}": x for x in LEVELS} | {c: c for c in ("epochs", "cut", "cut_left", "cut_tokens")}
    full = materialize(full.select(*[F.col(c).alias(prefix + n) for c, n in at.items()]), "mix-cut")

    out = rows.join(broadcast_if_small(full, few), [prefix + x for x in LEVELS])
    col = lambda n: F.col(prefix + n)
    key = F.md5(F.concat_ws(":", F.lit(spec.seed), col("epochs").cast("string"), col("id")))
    share = F.expr(f"cast({prefix}cut_left * {prefix}tokens div greatest({prefix}cut_tokens, 1) as bigint)")
    used = F.when(col("cut").isNull(), F.lit(0)).when(col("key") < col("cut"), col("tokens")).when(col("key") == col("cut"), share).otherwise(F.lit(0)).cast("long")
    return out.withColumn(prefix + "key", key).withColumn(prefix + "prefix", used).drop(*[prefix + n for n in ("key", "id", "cut", "cut_left", "cut_tokens")])


def keep_mixture(docs: DataFrame, domain: Column, spec: MixtureSpec) -> DataFrame:
    """The documents used at all, once each and with their own columns only."""
    prefix = free_prefix(docs, "__mix_")
    picked = select_mixture(docs, domain, spec, prefix)
    return picked.where(f"{prefix}epochs > 0 or {prefix}prefix > 0 or {prefix}tokens = 0").select(*[F.col(f"`{c}`") for c in docs.columns])


def domain_of(source: Column) -> Column:
    """The domain of a source: sources are dealt to four domains by the crc32 of their name."""
    return F.element_at(F.array(*[F.lit(x) for x in ("web", "news", "code", "books")]), (F.crc32(F.coalesce(source, F.lit(""))) % 4 + 1).cast("int"))


QUERY_SPEC = MixtureSpec(
    weights={"domain": {"web": 40, "news": 30, "code": 10, "books": 20}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {"src0": 1, "src1": 3, "src2": 2}},
    default_weight=2, budget_percent=60, max_epochs=3, seed="mix-1",
)


def op1_source_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    picked = select_mixture(docs, domain_of(F.col("source")), QUERY_SPEC, keep_text=False)
    name = {"__mix_domain": "domain", "__mix_tokens": "n_tokens", "__mix_epochs": "epochs", "__mix_prefix": "prefix_tokens"}
    return picked.select("doc_id", *[F.col(k).alias(v) for k, v in name.items()], F.col("__mix_lang").alias("lang"), F.col("__mix_source").alias("source"))


def oracle(spec: MixtureSpec = QUERY_SPEC) -> str:
    """The same mixture in DuckDB SQL (crc32 by a table of the sources' domains is not needed: it has no crc32, so the
    domain of each source name is worked out here)."""
    import zlib

    names = ("web", "news", "code", "books")
    known = " ".join(f"WHEN 'src{i}' THEN '{names[zlib.crc32(f'src{i}'.encode()) % 4]}'" for i in range(64))
    case = lambda level, col: "CASE " + col + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(spec.weights[level].items())) + f" ELSE {spec.default_weight} END"

    def fill(nodes: str, parent: str, name: str) -> str:
        p = f"PARTITION BY {parent}" if parent else ""
        return f"""
        SELECT *, CASE WHEN sat THEN cap ELSE (((budget - coalesce(sum(CASE WHEN sat THEN cap END) OVER ({p}), 0))::HUGEINT * weight::HUGEINT) // greatest(coalesce(sum(CASE WHEN NOT sat THEN weight END) OVER ({p}), 0), 1))::BIGINT END AS alloc FROM (
          SELECT *, weight = 0 OR c * weight + cap::HUGEINT * w <= budget::HUGEINT * weight AS sat FROM (
            SELECT *, sum(cap) OVER ({p} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::HUGEINT AS c,
              coalesce(sum(weight) OVER ({p} ORDER BY ratio, {name} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::HUGEINT AS w
            FROM (SELECT *, CASE WHEN weight > 0 THEN cap / weight ELSE 0 END AS ratio FROM {nodes})))"""

    return f"""
    WITH docs AS (
      SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\r]+'), lambda x: x <> ''))::BIGINT AS n_tokens,
        CASE source {known} END AS domain FROM documents),
    leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {spec.max_epochs})::BIGINT AS cap,
        {case('domain', 'domain')} AS w_domain, {case('lang', 'lang')} AS w_lang, {case('source', 'source')} AS w_source FROM docs GROUP BY domain, lang, source),
    root AS (SELECT least(floor(sum(tokens) * {spec.budget_percent} / 100), sum(cap))::BIGINT AS budget FROM leaves),
    d0 AS (SELECT domain, sum(cap)::BIGINT AS cap, max(w_domain) AS weight, (SELECT budget FROM root) AS budget FROM leaves GROUP BY 1),
    d1 AS (SELECT domain, alloc AS budget FROM ({fill('d0', '', 'domain')})),
    l0 AS (SELECT domain, lang, sum(cap)::BIGINT AS cap, max(w_lang) AS weight, any_value(budget) AS budget FROM leaves JOIN d1 USING (domain) GROUP BY 1, 2),
    l1 AS (SELECT domain, lang, alloc AS budget FROM ({fill('l0', 'domain', 'lang')})),
    s0 AS (SELECT domain, lang, source, tokens, cap, w_source AS weight, budget FROM leaves JOIN l1 USING (domain, lang)),
    s1 AS (SELECT domain, lang, source, tokens, alloc, CASE WHEN tokens > 0 THEN alloc // tokens ELSE 0 END AS epochs FROM ({fill('s0', 'domain, lang', 'source')})),
    keyed AS (SELECT doc_id, domain, lang, source, n_tokens, epochs::BIGINT AS epochs, alloc - epochs * tokens AS rest, md5('{spec.seed}:' || epochs || ':' || doc_id) AS key FROM docs JOIN s1 USING (domain, lang, source)),
    run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key) - n_tokens AS before FROM keyed)
    SELECT doc_id, domain, n_tokens, epochs, greatest(least(n_tokens, rest - before), 0)::BIGINT AS prefix_tokens, lang, source FROM run"""
