"""URL filters: hand-written host and path rules, and association rules mined by FP-growth.

The tokens of labelled urls and the item ``label=block`` are the transactions. Frequent token sets, of any size, that imply the label
with enough confidence become rules; an inverted index from token to rule finds the rules whose tokens a url has all of. A
hand-written rule decides before any mined one; a url that neither reaches is allowed. DataFrame and SQL functions only.

What needs no mining is kept from it, since a set of n tokens has 2**n subsets: tokens that meet the label too seldom are in no rule;
a token that is a rule by itself makes every larger set with it superfluous; and tokens that stand in the same labelled rows, such as
those of one repeated url, are one item, of which a url must have any. None of this changes which urls a rule blocks.

Defined cases: a null url, or one without ``://``, has an empty host and path and is allowed unless a mined rule holds;
repeated rows are judged each; without labels no rule is mined; a label row with a null id, or an id of no page, is ignored; a
page with several label rows counts once for each; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence
from fractions import Fraction

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from probity.llm.common import checkpointed, table

RULES: tuple[tuple[str, str], ...] = (
    ("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"),
)
#: Share of the labelled rows, and rows at the least, that hold a rule's tokens and are to be blocked; and the share of those that hold them.
MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.002, 2, 0.5
#: Up to so many index rows the index is broadcast (about 2 MB); a larger one is joined by shuffle, salted.
BROADCAST_INDEX_ROWS, SALTS = 20_000, 16
LABEL = "label=block"


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: labels of the host, parts of the path that are not numbers, parts of the query."""

    def parts(text: Column, pattern: str, kind: str) -> Column:
        split = F.filter(F.split(text, pattern), lambda x: (x != "") & ~x.rlike("^[0-9]+$"))
        return F.transform(split, lambda x: F.concat(F.lit(kind), x))

    query = F.regexp_extract(_rest(url), "^[^?#]*[?]([^#]*)", 1)
    found = F.concat(
        parts(host_of(url), "[^a-z0-9-]+", "h:"),
        parts(ascii_lower(path_of(url)), "[^a-z0-9_-]+", "p:"),
        parts(ascii_lower(F.coalesce(query, F.lit(""))), "[^a-z0-9_-]+", "q:"),
    )
    return F.array_distinct(found)


def fixed_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule whose host or a subdomain of it is the url's and whose path begins the url's; and its verdict."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, start = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def mine(labelled: DataFrame, *, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules from rows (tokens, blocked), as an index (rule_id, needed, item, token): ``needed`` items of a rule, of each any of its tokens."""
    rows = checkpointed(labelled.select("tokens", "blocked", F.monotonically_increasing_id().alias("row")))
    count = rows.count()
    least = max(MIN_ROWS, math.ceil(Fraction(str(min_support)) * count))
    exploded = rows.select("row", "blocked", F.explode("tokens").alias("token"))
    seen = exploded.groupBy("token").agg(F.count("*").alias("n"), F.count_if("blocked").alias("b"), F.bit_xor(F.xxhash64("row")).alias("x"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    # tokens of an item stand in the same rows, so there are never more of them than in one url
    items = checkpointed(seen.where(F.col("b") >= least).groupBy("n", "b", "x", "y").agg(F.min("token").alias("item"), F.collect_list("token").alias("tokens")).select("item", "tokens", (F.col("b") >= F.col("n") * F.lit(min_confidence)).alias("alone")))
    shared = rows.select("row", "blocked").join(exploded.join(items.where("not alone").select(F.col("item").alias("token")), "token").groupBy("row").agg(F.collect_list("token").alias("items")), "row")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, count)), minConfidence=min_confidence).fit(
        rows.select("row").join(shared, "row", "left").select(F.when(F.col("blocked"), F.array_append("items", F.lit(LABEL))).otherwise(F.coalesce("items", F.array().cast("array<string>"))).alias("items"))
    )
    mined = model.associationRules.where(F.col("consequent")[0] == LABEL).select(F.array_sort("antecedent").alias("items"))
    rules = mined.unionByName(items.where("alone").select(F.array("item").alias("items")))
    listed = rules.select(F.concat_ws(" ", "items").alias("rule_id"), F.size("items").alias("needed"), F.explode("items").alias("item"))
    return checkpointed(listed.join(items.select("item", "tokens"), "item").select("rule_id", "needed", "item", F.explode("tokens").alias("token")))


def blocked_urls(urls: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct urls that have all items of a rule: an inverted index from token to rule, then a count of the items met."""
    exploded = urls.select("url").where("url is not null").distinct().select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    if index.count() <= BROADCAST_INDEX_ROWS:
        met = exploded.join(F.broadcast(index), "token")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = exploded.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["token", "salt"])
    full = met.groupBy("url", "rule_id").agg(F.count_distinct("item").alias("n"), F.max("needed").alias("needed")).where("n = needed")
    return full.groupBy("url").agg(F.min("rule_id").alias("mined_rule"))


def judge(pages: DataFrame, labels: DataFrame, *, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", **mining) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict and the mined rule that holds, if any."""
    pages = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    known = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("blocked"))
    labelled = pages.join(known.where("blocked is not null"), "page_id").select(F.coalesce(tokens_of(F.col("url")), F.array().cast("array<string>")).alias("tokens"), "blocked")
    found = blocked_urls(pages, mine(labelled, **mining))
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    return (
        pages.join(found, "url", "left")
        .select("page_id", host.alias("host"), path.alias("path"), "mined_rule")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("mined_rule").isNotNull(), "block"), F.lit("allow")).alias("verdict"), "mined_rule")
    )


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("mined_rule")


def _oracle() -> str:
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    rest = "case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end"

    def parts(text: str, pattern: str, kind: str) -> str:
        return f"list_transform(list_filter(string_split_regex({text}, '{pattern}'), lambda x: x <> '' and not regexp_full_match(x, '[0-9]+')), lambda x: '{kind}' || x)"

    cases = " ".join(
        f"when (host = '{t.partition('/')[0]}' or ends_with(host, '.{t.partition('/')[0]}')) and starts_with(path, '/{t.partition('/')[2]}') then '{t}'"
        for _, t in sorted(RULES, key=lambda r: (len(r[1]), r[1]), reverse=True)
    )
    verdicts = " ".join(f"when rule = '{t}' then '{k}'" for k, t in RULES)
    return f"""
with u as (select page_id, url, coalesce({rest}, '') as rest from pages),
p as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path,
  translate(regexp_extract(rest, '^[^?#]*[?]([^#]*)', 1), '{upper}', '{lower}') as query from u),
t as (select *, list_distinct(list_concat(list_concat({parts("host", "[^a-z0-9-]+", "h:")}, {parts(f"translate(path, '{upper}', '{lower}')", "[^a-z0-9_-]+", "p:")}), {parts("query", "[^a-z0-9_-]+", "q:")})) as tokens from p),
l as (select row_number() over () as k, tokens, (quality = 0 or coalesce(toxic = 1, false)) as blocked from t join labels on doc_id = page_id where (quality = 0 or coalesce(toxic = 1, false)) is not null),
e as (select k, blocked, unnest(tokens) as token from l),
least as (select greatest({MIN_ROWS}, ceil({MIN_SUPPORT} * count(*))) as n from l),
often as (select list(token) as tokens from (select token from e, least group by token, least.n having count(*) filter (blocked) >= least.n)),
f as (select blocked, list_sort(list_filter(l.tokens, lambda x: list_contains(coalesce(often.tokens, []), x))) as tokens from l, often),
g as (select tokens, blocked, count(*) as n from f group by all),
sets as (select s, sum(n) as n, coalesce(sum(n) filter (blocked), 0) as b from (
  select list_filter(tokens, lambda x, i: ((m >> (i - 1)) & 1) = 1) as s, n, blocked from (select *, unnest(range(1, cast(1 as bigint) << len(tokens))) as m from g)) group by s),
rules as (select s as tokens from sets, least where b >= least.n and b >= {MIN_CONFIDENCE} * sets.n),
m as (select distinct t.url from (select distinct url, tokens from t where url is not null) t join rules on list_has_all(t.tokens, rules.tokens)),
r as (select page_id, host, path, case {cases} end as rule, m.url is not null as mined from t left join m on t.url = m.url)
select page_id, host, path, rule, coalesce(case {verdicts} end, case when mined then 'block' end, 'allow') as verdict from r
"""


ORACLE_SQL = _oracle()
