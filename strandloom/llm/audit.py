"""Filter interaction audit: a histogram of failure masks, and every order of the filters from its cells."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import Scratch, table

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(LETTERS)]
SPACES = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> list[Column]:
    """Conditions A to D on a text that isn't null: few words, few distinct ones, many capitals, a symbol."""
    words = F.array_remove(F.split(text, SPACES), "")
    n = F.size(words).cast("long")
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long")
    return [n < 200, F.size(F.array_distinct(words)).cast("long") * 100 < n * 50, capitals * 100 > F.length(text).cast("long") * 3, text.rlike(r"[#$%&*|]")]


def _bits(conditions: list[Column]) -> Column:
    out = F.lit(0)
    for k, c in enumerate(conditions):
        out = out + F.when(c, F.lit(1 << k)).otherwise(F.lit(0))
    return out


def cells(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by the filters that they fail, 32 rows a part at most.

    Bit k of mask is filter ABCDE[k]. Texts are read once, and what goes through
    shuffles is a digest (SHA-256) of each text, not the text. E's first owner comes from a
    grouping by digest, whose copies are combined before the shuffle; only digests
    that several ids share are joined back, a join that can be split where one text is frequent.

    Null text: empty. Null part: the empty string. Null doc_id: not smaller than any
    other, so it neither fails E nor makes others fail; it has no labels. Rows with one
    doc_id and one text don't fail each other, and each counts. Of several labels of a
    document one with quality 1 (toxic 1) is enough. Texts of any length are read whole.
    An empty table has no cells. Other columns are left out, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = scratch.save(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        _bits(failures(text)).alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest"),
    ))
    first = slim.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    first = scratch.save(first.where("lo <> hi").select("digest", "lo"))  # a table, so that the join can split a frequent digest
    masked = slim.join(first, "digest", "left").select(
        "doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("lo"), 16).otherwise(0)).alias("mask"),
        # rows without an id have nothing to meet, and are dealt out by their text
        F.coalesce("doc_id", F.xxhash64("digest")).alias("_key"), F.col("doc_id").isNotNull().alias("_named"),
    )
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_key")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"),
    ).where("good = 1 or toxic = 1").withColumn("_named", F.lit(True))
    count = lambda c: F.count_if(F.col(c) == 1).alias(c)
    both = masked.join(marks, ["_key", "_named"], "left")
    return both.groupBy("part", "mask").agg(F.count("*").alias("n"), count("good"), count("toxic"))


def orders(found: DataFrame) -> DataFrame:
    """All 120 orders of the filters in 5 steps from the cells: 600 rows a part, whatever the number of documents."""
    each = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    each = each.withColumn("filter_order", F.explode(F.split(F.lit(" ".join(ORDERS)), " ")))
    each = each.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(LETTERS)))))
    bit_at = lambda k: F.expr("shiftleft(1, instr('ABCDE', {}) - 1)".format(f"substring(filter_order, {k}, 1)"))
    each = each.withColumn("bit", bit_at("step"))
    earlier = F.expr("aggregate(filter(sequence(1, 5), k -> k < step), 0, (s, k) -> s + shiftleft(1, instr('ABCDE', substring(filter_order, k, 1)) - 1))")
    each = each.withColumn("earlier", earlier)
    total = lambda what, where: F.expr(f"aggregate(filter(cells, c -> {where}), 0L, (s, c) -> s + {what})")
    fails, passed, failed = "(c.mask & bit) <> 0", "(c.mask & earlier) = 0", "(c.mask & earlier) <> 0"
    return each.select(
        "part", "filter_order", "step",
        total("c.n", "(c.mask & (earlier | bit)) = 0").alias("kept"),
        total("c.n", f"{fails} and {passed}").alias("removed"),
        total("c.n", f"{fails} and {failed}").alias("redundant"),
        total("c.n", "c.mask = bit").alias("unique_fails"),
        total("c.good", f"{fails} and {passed}").alias("good_lost"),
        total("c.toxic", f"{fails} and {passed}").alias("toxic_lost"),
        # of the orders, a filter comes before the others that a document fails in one of as many as it fails
        total(f"c.n * ({len(ORDERS)} div bit_count(c.mask))", fails).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir):
    """Cells of ``documents`` by lang and all orders from them; nulls, ties and repeated rows as in ``cells``."""
    return orders(cells(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP11_SQL = r"""
with base as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from documents),
owner as (select body, min(doc_id) as lo from base group by body),
marks as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
masks as (
  select part, coalesce(m.good, false) as good, coalesce(m.toxic, false) as toxic,
    case when len(words) < 200 then 1 else 0 end
      + case when 100 * len(list_distinct(words)) < 50 * len(words) then 2 else 0 end
      + case when 100 * length(regexp_replace(b.body, '[^A-Z]', '', 'g')) > 3 * length(b.body) then 4 else 0 end
      + case when regexp_matches(b.body, '[#$%&*|]') then 8 else 0 end
      + case when b.doc_id > o.lo then 16 else 0 end as mask
  from base b join owner o on b.body = o.body left join marks m on b.doc_id = m.doc_id),
cells as (select part, mask, count(*) as n, count_if(good) as good, count_if(toxic) as toxic from masks group by part, mask),
letters as (select unnest(['A', 'B', 'C', 'D', 'E']) as x, unnest([1, 2, 4, 8, 16]) as bit),
perms as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from letters a, letters b, letters c, letters d, letters e where a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps as (
  select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as earlier
  from perms, (select unnest([1, 2, 3, 4, 5]) as step))
select part, filter_order, step::int as step,
  sum(case when mask & (earlier | bit) = 0 then n else 0 end)::bigint as kept,
  sum(case when mask & bit <> 0 and mask & earlier = 0 then n else 0 end)::bigint as removed,
  sum(case when mask & bit <> 0 and mask & earlier <> 0 then n else 0 end)::bigint as redundant,
  sum(case when mask = bit then n else 0 end)::bigint as unique_fails,
  sum(case when mask & bit <> 0 and mask & earlier = 0 then good else 0 end)::bigint as good_lost,
  sum(case when mask & bit <> 0 and mask & earlier = 0 then toxic else 0 end)::bigint as toxic_lost,
  sum(case when mask & bit <> 0 then n * (120 // bit_count(mask)) else 0 end)::bigint as shapley
from cells, steps group by part, filter_order, step
"""
