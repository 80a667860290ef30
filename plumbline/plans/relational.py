"""Queries over alignment joins, rankings and set operations (survey sections 2.4 and 2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.scalars import numbers_in
from plumbline.operators import drift as R
from plumbline.operators import relational as Q
from plumbline.operators import splits as D
from plumbline.plans.bindings import (
    DOCS, EVENTS, SALES, arm_score, attribution, docs, events, r6, rounded, sales, sql_arm_score, sql_attribution, table, with_cte,
)
from plumbline.plans.registry import query


@query("j1_align", with_cte(SALES) + f"""
SELECT s.row_id, {sql_arm_score('a', prefix='s.')} AS a, {sql_arm_score('b', prefix='t.')} AS b FROM sales s JOIN sales t ON s.row_id = t.row_id WHERE s.segment <> 'BUILDING' AND t.priority <> '5-LOW'""")
def j1(spark, sf):
    s = sales(spark, sf)
    a = s.where("segment <> 'BUILDING'").select("row_id", arm_score("a").alias("a"))
    b = s.where("priority <> '5-LOW'").select("row_id", arm_score("b").alias("b"))
    return Q.align(a, b)


@query("j2_lookup", with_cte(DOCS) + """
, q AS (SELECT source, count(*) AS n_toxic FROM docs WHERE toxic = 1 AND y = 0 GROUP BY source)
SELECT d.row_id, coalesce(q.n_toxic, 0) AS n_toxic FROM docs d LEFT JOIN q USING (source)""")
def j2(spark, sf):
    d = docs(spark, sf)
    known = d.where("toxic = 1 AND y = 0").groupBy("source").agg(F.count(F.lit(1)).alias("n_toxic"))
    return Q.lookup(d, known, ["source"], {"n_toxic": 0}).select("row_id", "n_toxic")


@query("j3_exclude", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j3(spark, sf):
    return Q.exclude(table(spark, sf, "documents"), table(spark, sf, "labels"), ["doc_id"]).select("doc_id")


@query("j4_membership", "SELECT lang, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS is_good, count(*) AS n FROM documents GROUP BY ALL")
def j4(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1")
    marked = Q.membership(table(spark, sf, "documents"), good, "is_good", ["doc_id"])
    return marked.groupBy("lang", "is_good").agg(F.count(F.lit(1)).alias("n"))


@query("j5_expand", with_cte(DOCS) + """
SELECT scope, mask, count(*) AS n, CAST(sum(row_id * (mask + 1)) AS BIGINT) AS total FROM docs, (SELECT CAST(unnest(range(8)) AS INTEGER) AS mask), (SELECT unnest(['pooled', 'focus']) AS scope) GROUP BY ALL""")
def j5(spark, sf):
    out = Q.expand(docs(spark, sf), {"mask": list(range(8)), "scope": ["pooled", "focus"]})
    return out.groupBy("scope", "mask").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("row_id") * (F.col("mask") + 1)).alias("total"))


@query("j6_bin_by_edges", with_cte(EVENTS) + """
, e AS (SELECT event_type, list_distinct(quantile_disc(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edges FROM ev GROUP BY event_type)
SELECT event_type, CAST(len(list_filter(edges, lambda x: x < value)) AS INTEGER) AS bin, count(*) AS n FROM ev JOIN e USING (event_type) GROUP BY ALL""")
def j6(spark, sf):
    ev = events(spark, sf)
    return Q.bin_by_edges(ev, "value", R.decile_edges(ev, "value", ["event_type"]), ["event_type"]).groupBy("event_type", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("j7_full_outer", """
WITH a AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
b AS (SELECT l_suppkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, a.n AS n_returned, b.n AS n_accepted FROM a FULL OUTER JOIN b ON a.k = b.k""")
def j7(spark, sf):
    items = table(spark, sf, "lineitem")

    def side(flag, name):
        return items.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("k")).agg(F.count(F.lit(1)).alias(name))

    return side("R", "n_returned").join(side("A", "n_accepted"), "k", "full_outer")


@query("j8_unordered_pairs", with_cte(SALES) + """
, m AS (SELECT segment, grp, avg(y) AS v FROM sales GROUP BY ALL)
SELECT x.segment, x.grp AS a, z.grp AS b, round(x.v - z.v, 6) AS gap FROM m x JOIN m z ON x.segment = z.segment AND x.grp < z.grp""")
def j8(spark, sf):
    rates = sales(spark, sf).groupBy("segment", "grp").agg(F.avg("y").alias("v"))
    pairs = Q.unordered_pairs(rates, "grp", ["segment"], "v")
    return pairs.select("segment", "a", "b", r6(F.col("value_a") - F.col("value_b")).alias("gap"))


@query("j9_rank_wraparound", with_cte(DOCS) + """
, r AS (SELECT row_id, grp, row_number() OVER (PARTITION BY grp ORDER BY md5('deal|' || row_id), row_id) AS rk, count(*) OVER (PARTITION BY grp) AS n FROM docs),
s AS (SELECT DISTINCT grp, n, slot FROM r, (SELECT unnest(range(100)) AS slot))
SELECT s.grp, s.slot, r.row_id FROM s JOIN r ON r.grp = s.grp AND r.rk = s.slot % s.n + 1""")
def j9(spark, sf):
    from plumbline.functions.ordering import hash_rank

    ranked = hash_rank(docs(spark, sf).select("row_id", "grp"), "deal", "row_id", ["grp"], rank="rk", size="n")
    slots = ranked.select("grp", "n").distinct().withColumn("slot", F.explode(F.expr("sequence(0L, 99L)")))
    hits = slots.select("grp", "slot", (F.col("slot") % F.col("n") + 1).alias("rk"))
    return hits.join(ranked, ["grp", "rk"]).select("grp", "slot", "row_id")


@query("w1_rank_min", """
SELECT p_type, p_brand, count(*) AS n, CAST(rank() OVER (PARTITION BY p_type ORDER BY count(*) DESC) AS INTEGER) AS rank FROM part GROUP BY p_type, p_brand""")
def w1(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))
    return Q.rank_min(counts, ["p_type"], F.desc("n"))


@query("w2_rank_ordinal", with_cte(sql_attribution("a", 1, 32, "a")) + """
SELECT row_id, feature, CAST(row_number() OVER (PARTITION BY row_id ORDER BY abs(value) DESC, pos) AS INTEGER) AS rank FROM a""")
def w2(spark, sf):
    from plumbline.operators.attribution import feature_ranks

    return feature_ranks(attribution(spark, sf, 1, 32, "a"), "pos").select("row_id", "feature", "rank")


@query("w3_rank_average", with_cte(EVENTS) + """
SELECT row_id, rank() OVER (PARTITION BY event_type ORDER BY k) + (count(*) OVER (PARTITION BY event_type, k) - 1) / 2.0 AS rank FROM ev""")
def w3(spark, sf):
    return Q.rank_average(events(spark, sf), ["event_type"], "k").select("row_id", "rank")


@query("w4_cumulative", with_cte(EVENTS) + """
SELECT event_type, k, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY event_type ORDER BY k DESC) AS BIGINT) AS n_cum, CAST(sum(count(*)) OVER (PARTITION BY event_type) AS BIGINT) AS n_total FROM ev GROUP BY event_type, k""")
def w4(spark, sf):
    return Q.cumulative(events(spark, sf), "k", {"n": F.lit(1)}, ["event_type"], descending=True)


@query("w5_increment", with_cte(EVENTS) + """
, c AS (SELECT k, sum(count(*)) OVER (ORDER BY k) AS cum FROM ev GROUP BY k)
SELECT k, CAST(cum - coalesce(lag(cum) OVER (ORDER BY k), 0) AS BIGINT) AS step, CAST(cum AS BIGINT) AS cum FROM c""")
def w5(spark, sf):
    cells = Q.cumulative(events(spark, sf), "k", {"n": F.lit(1)})
    return cells.select("k", F.col("n").alias("step"), F.col("n_cum").alias("cum"))


@query("w6_running_maximum", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS d, count(*) AS n FROM orders GROUP BY 1)
SELECT strftime(d, '%Y-%m-%d') AS day, n, max(n) OVER (PARTITION BY year(d) ORDER BY d ROWS UNBOUNDED PRECEDING) AS peak FROM d""")
def w6(spark, sf):
    from pyspark.sql import Window

    days = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy(F.year("d")).orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    return days.select(F.date_format("d", "yyyy-MM-dd").alias("day"), "n", F.max("n").over(upto).alias("peak"))


@query("w7_share_of_total", with_cte(SALES) + "SELECT grp, nation, round(sum(price) / sum(sum(price)) OVER (PARTITION BY grp), 6) AS share FROM sales GROUP BY grp, nation")
def w7(spark, sf):
    totals = sales(spark, sf).groupBy("grp", "nation").agg(F.sum("price").alias("price"))
    return rounded(Q.share_of_total(totals, ["grp"], "price").drop("price"), "share")


@query("w8_top_k", with_cte(SALES) + """
SELECT grp, row_id, price FROM sales QUALIFY row_number() OVER (PARTITION BY grp ORDER BY price DESC, row_id) <= 5""")
def w8(spark, sf):
    return Q.top_k(sales(spark, sf).select("grp", "row_id", "price"), ["grp"], [F.desc("price"), F.asc("row_id")], 5)


@query("x1_union", with_cte(SALES) + "SELECT row_id FROM sales WHERE grp = 'ASIA' UNION SELECT row_id FROM sales WHERE segment = 'BUILDING'")
def x1(spark, sf):
    s = sales(spark, sf)
    return Q.union_rows(s.where("grp = 'ASIA'").select("row_id"), s.where("segment = 'BUILDING'").select("row_id"))


@query("x2_intersect", with_cte(SALES) + "SELECT row_id FROM sales WHERE grp = 'ASIA' INTERSECT SELECT row_id FROM sales WHERE segment = 'BUILDING'")
def x2(spark, sf):
    s = sales(spark, sf)
    return Q.overlap(s.where("grp = 'ASIA'").select("row_id"), s.where("segment = 'BUILDING'").select("row_id"))


@query("x3_except", "SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'N'")
def x3(spark, sf):
    li = table(spark, sf, "lineitem")
    return Q.difference(li.where("l_returnflag = 'R'").select("l_suppkey"), li.where("l_returnflag = 'N'").select("l_suppkey"))


@query("f1_numbers_in_text", with_cte(SALES) + """
, t AS (SELECT grp, printf('%.3f', avg(y)) || ' ± ' || printf('%.3f', stddev_pop(y)) AS text FROM sales GROUP BY grp)
SELECT grp, CAST(regexp_extract_all(text, '(-?\\d+\\.?\\d*)')[1] AS DOUBLE) AS mean, CAST(regexp_extract_all(text, '(-?\\d+\\.?\\d*)')[2] AS DOUBLE) AS std FROM t""")
def f1(spark, sf):
    from plumbline.functions.scalars import mean_pm_std

    texts = sales(spark, sf).groupBy("grp").agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).select("grp", mean_pm_std(F.col("m"), F.col("s")).alias("text"))
    found = texts.select("grp", numbers_in(F.col("text")).alias("n"))
    return found.select("grp", F.get("n", 0).alias("mean"), F.get("n", 1).alias("std"))


@query("f2_sigmoid", with_cte(SALES) + "SELECT row_id, round(1 / (1 + exp(-(price / 100000 - 2.5))), 6) AS p FROM sales")
def f2(spark, sf):
    from plumbline.functions.scalars import sigmoid

    return sales(spark, sf).select("row_id", r6(sigmoid(F.col("price") / 100000 - 2.5)).alias("p"))
