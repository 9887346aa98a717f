"""Queries of the dataset algebra, predicates, measures, cube, logs and replicated state, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import computed as cm
from tessera.functions import measures as ms
from tessera.operators import aggregation, crdt, dataset, joins, reducers
from tessera.plans import predicates as pr
from tessera.plans.cube import DATA_WITH_TOTALS, Cube, CubeQuery, StaticAttributes
from tessera.plans.tables import table
from tessera.session import new_path

Q = Callable[[SparkSession, str], DataFrame]
_Q: dict[str, Q] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        _Q[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def queries() -> dict[str, Q]:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


MONEY = "DECIMAL(18,2)"

# -- row transforms -----------------------------------------------------------------------------


@query("map_project", "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def _(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return dataset.map_rows(table(spark, d, "lineitem"), l_orderkey=F.col("l_orderkey"), l_linenumber=F.col("l_linenumber"), net=net)


@query("filter_rows", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def _(spark, d):
    return dataset.filter_rows(table(spark, d, "orders"), (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)).select("o_orderkey", "o_totalprice")


def _where(name: str, t: str, columns: str, p: pr.Predicate, sql: str) -> None:
    @query(name, f"SELECT {columns} FROM {t} WHERE {sql}")
    def _(spark, d):
        df = table(spark, d, t)
        return df.where(p.simplify().column(F.col, df.columns)).select(*columns.split(", "))


_where("filter_eq", "ad_log", "date, advertiser, banner, revenue", pr.eq("revenue", None), "revenue IS NULL")
_where("filter_noteq_nullsafe", "ad_log", "date, advertiser, banner, userId", pr.not_eq("userId", 13235), "userId IS NULL OR userId <> 13235")
_where("filter_compare", "lineitem", "l_orderkey, l_linenumber", pr.and_(pr.ge("l_quantity", 10.0), pr.lt("l_quantity", 20.0), pr.gt("l_tax", 0.02), pr.le("l_discount", 0.05)), "l_quantity >= 10 AND l_quantity < 20 AND l_tax > 0.02 AND l_discount <= 0.05")
_where("filter_between", "orders", "o_orderkey, o_custkey", pr.between("o_totalprice", 50000.0, 150000.0), "o_totalprice BETWEEN 50000 AND 150000")
_where("filter_in", "part", "p_partkey, p_size", pr.is_in("p_size", [1, 5, 9, 14]), "p_size IN (1, 5, 9, 14)")
_where("filter_has", "part", "p_partkey", pr.and_(pr.has("p_size"), pr.lt("p_size", 9)), "p_size < 9")
_where("filter_regexp_full", "events", "event_id, event_type", pr.regexp("event_type", "[cv].*"), "regexp_full_match(event_type, '[cv].*')")
_where("filter_or_not", "events", "event_id, user_id", pr.or_(pr.not_(pr.or_(pr.eq("event_type", "click"), pr.gt("value", 5.0))), pr.eq("user_id", 8)), "NOT (event_type = 'click' OR value > 5) OR user_id = 8")
_where("filter_contradiction", "part", "p_partkey", pr.and_(pr.eq("p_size", 3), pr.gt("p_size", 5)), "false")
_where("filter_json", "orders", "o_orderkey", pr.from_json({"o_totalprice >=": 200000.0, "o_orderstatus IN": ["O", "P"]}), "o_totalprice >= 200000 AND o_orderstatus IN ('O', 'P')")


@query("flat_map_explode", "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    return dataset.flat_map(table(spark, d, "documents"), F.split("text", " "), "word", ["doc_id"])


@query("take_until", """SELECT event_id, user_id FROM (SELECT *, coalesce(max(CASE WHEN event_type = 'purchase' OR event_type = 'error' THEN 1 ELSE 0 END)
    OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events) WHERE s = 0""")
def _(spark, d):
    return dataset.take_until(table(spark, d, "events"), F.col("event_type").isin("purchase", "error"), ["ts", "event_id"], ["user_id"]).select("event_id", "user_id")


def _double(batch, state):
    state["n"] = state.get("n", 0) + len(batch)
    return batch.assign(doubled=batch["value"] * 2)[["event_id", "doubled"]]


@query("transduce", "SELECT event_id, value * 2 AS doubled FROM events")
def _(spark, d):
    return dataset.transduce(table(spark, d, "events").select("event_id", "value"), "event_id long, doubled double", _double)


@query("splitter", """SELECT 'urgent' AS output, count(*) AS n FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'large', count(*) FROM orders WHERE o_totalprice > 200000""")
def _(spark, d):
    parts = dataset.split(table(spark, d, "orders"), urgent=F.col("o_orderpriority") == "1-URGENT", large=F.col("o_totalprice") > 200000)
    return dataset.union_all(*[p.select(F.lit(n).alias("output")) for n, p in parts.items()]).groupBy("output").agg(F.count("*").alias("n"))


@query("expressions", """SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE 'other' END AS state,
    xor(o_orderkey & 255, 7) AS bits, o_orderkey % 10 AS digit, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::INT AS days FROM orders""")
def _(spark, d):
    from tessera.functions.expressions import date_to_days, switch_by_key

    state = switch_by_key(F.col("o_orderstatus"), {"O": F.lit("open"), "F": F.lit("done")}, F.lit("other"))
    bits = F.col("o_orderkey").bitwiseAND(255).bitwiseXOR(7)
    days = date_to_days(F.col("o_orderdate").cast("date"), "1992-01-01")
    return table(spark, d, "orders").select("o_orderkey", state.alias("state"), bits.alias("bits"), (F.col("o_orderkey") % 10).alias("digit"), days.alias("days"))


# -- joins --------------------------------------------------------------------------------------


@query("join_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def _(spark, d):
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.join(table(spark, d, "orders"), right, ["o_custkey"]).select("o_orderkey", "c_name")


@query("join_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) AS o ON o_custkey = c_custkey")
def _(spark, d):
    right = table(spark, d, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.join(table(spark, d, "customer"), right, ["c_custkey"], "left").select("c_custkey", "o_orderkey")


@query("join_first_right", """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN
    (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) AS o ON o_custkey = c_custkey""")
def _(spark, d):
    right = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.join(table(spark, d, "customer"), right, ["c_custkey"], "left", first=["o_orderkey"]).select("c_custkey", "o_orderkey")


@query("join_legacy_tail", """SELECT p_partkey AS k, s_name FROM part LEFT JOIN supplier ON s_suppkey = p_partkey WHERE p_partkey <= (SELECT max(s_suppkey) FROM supplier)""")
def _(spark, d):
    left, right = table(spark, d, "part").select(F.col("p_partkey").alias("k")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), "s_name")
    return joins.join(left, right, ["k"], "left", first=["s_name"], legacy_tail=True)


@query("value_join", """SELECT c_custkey, CASE WHEN o_orderkey IS NULL THEN 'none' ELSE o_orderstatus END AS status FROM customer
    LEFT JOIN (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1) AS o ON o_custkey = c_custkey""")
def _(spark, d):
    first = dataset.first_per_key(table(spark, d, "orders"), ["o_custkey"], ["o_orderkey"]).withColumnRenamed("o_custkey", "c_custkey")
    inner = lambda both: {"c_custkey": F.col("c_custkey"), "status": F.col("o_orderstatus")}
    return joins.value_join(table(spark, d, "customer"), first, ["c_custkey"], inner, {"c_custkey": F.col("c_custkey"), "status": F.lit("none")})


@query("lookup_attribute", f"""SELECT advertiser, name, impressions FROM (SELECT advertiser, sum(impressions)::BIGINT AS impressions FROM ad_log GROUP BY advertiser) AS a
    LEFT JOIN (SELECT advertiser, min(name) AS name FROM advertisers GROUP BY advertiser) AS n USING (advertiser)""")
def _(spark, d):
    per = table(spark, d, "ad_log").groupBy("advertiser").agg(F.sum("impressions").alias("impressions"))
    return joins.lookup(per, table(spark, d, "advertisers"), ["advertiser"], ["name"])


@query("stitch_full_outer", """SELECT coalesce(a.k, b.k) AS c_nationkey, coalesce(n_customers, 0) AS n_customers, coalesce(n_suppliers, 0) AS n_suppliers
    FROM (SELECT c_nationkey AS k, count(*) AS n_customers FROM customer GROUP BY 1) AS a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n_suppliers FROM supplier GROUP BY 1) AS b ON a.k = b.k""")
def _(spark, d):
    zero = F.lit(0)
    inputs = [
        (table(spark, d, "customer"), {"c_nationkey": F.col("c_nationkey"), "c": F.lit(1), "s": zero}),
        (table(spark, d, "supplier"), {"c_nationkey": F.col("s_nationkey"), "c": zero, "s": F.lit(1)}),
    ]
    return reducers.merge_reduce(["c_nationkey"], inputs, n_customers=F.sum("c"), n_suppliers=F.sum("s"))


# -- reduce -------------------------------------------------------------------------------------

_BY_PART = f"SELECT l_partkey, sum(l_quantity::{MONEY})::DOUBLE AS qty, count(*) AS n FROM lineitem GROUP BY l_partkey"


@query("reduce_by_key", _BY_PART)
def _(spark, d):
    return reducers.reduce_by_key(table(spark, d, "lineitem"), ["l_partkey"], qty=F.sum(F.col("l_quantity").cast(MONEY)).cast("double"), n=F.count(F.lit(1)))


@query("partial_final_reduce", _BY_PART)
def _(spark, d):
    part = reducers.partial_reduce(table(spark, d, "lineitem").select("l_partkey", "l_quantity"), ["l_partkey"], "l_partkey long, qty double, n long", {"qty": ("sum", "l_quantity"), "n": ("count", "l_quantity")})
    return reducers.reduce_by_key(part, ["l_partkey"], qty=F.sum(F.col("qty").cast(MONEY)).cast("double"), n=F.sum("n"))


class _Range(reducers.Accumulator):
    def create(self):
        return None

    def accumulate(self, acc, rows):
        return self.combine(acc, (float(rows["value"].min()), float(rows["value"].max())))

    def combine(self, a, b):
        return b if a is None else (min(a[0], b[0]), max(a[1], b[1]))

    def result(self, acc):
        return {"spread": round(acc[1] - acc[0], 6)}


@query("accumulator_udaf", "SELECT user_id, round(max(value) - min(value), 6) AS spread FROM events WHERE value IS NOT NULL GROUP BY user_id")
def _(spark, d):
    return reducers.accumulate_by_key(table(spark, d, "events").where("value IS NOT NULL").select("user_id", "value"), ["user_id"], "user_id long", _Range(), "spread double")


@query("fold_with_filter", "SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 200000")
def _(spark, d):
    return reducers.fold(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", F.lit(0.0), lambda a, x: F.greatest(a, x), "top", keep=F.col("top") > 200000)


@query("merge_distinct", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1")
def _(spark, d):
    return reducers.merge_distinct(table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("word_count", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL) GROUP BY word")
def _(spark, d):
    words = dataset.flat_map(table(spark, d, "documents"), F.split("text", " "), "word")
    return reducers.reduce_by_key(words, ["word"], n=F.count(F.lit(1)))


@query("inverted_index", """SELECT word, list_sort(list(DISTINCT doc_id)) AS documents FROM
    (SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents WHERE text IS NOT NULL) GROUP BY word""")
def _(spark, d):
    words = dataset.flat_map(table(spark, d, "documents"), F.split("text", " "), "word", ["doc_id"])
    return words.groupBy("word").agg(ms.union("bigint").ingest(F.col("doc_id")).alias("documents"))


_RANKS = "".join(
    f", r{i} AS (SELECT e.b AS page_id, sum(r.rank / e.n) AS rank FROM edges AS e JOIN r{i - 1} AS r ON r.page_id = e.a GROUP BY e.b)" for i in range(1, 11)
)


@query("pagerank_10", f"""WITH links AS (SELECT DISTINCT revision_id AS a, parent_id AS b FROM ot_diffs WHERE parent_id > 0),
    edges AS (SELECT a, b, count(*) OVER (PARTITION BY a) AS n FROM links), r0 AS (SELECT DISTINCT a AS page_id, 1.0::DOUBLE AS rank FROM edges){_RANKS}
    SELECT page_id, round(rank, 6) AS rank FROM r10""")
def _(spark, d):
    """Revisions hand their rank on to their parents."""
    links = table(spark, d, "ot_diffs").where("parent_id > 0").groupBy(F.col("revision_id").alias("page_id")).agg(F.collect_set("parent_id").alias("links"))
    return reducers.pagerank(links, 10).select("page_id", F.round("rank", 6).alias("rank"))


# -- measures and aggregations ------------------------------------------------------------------

_BUCKET = "(l_suppkey % 20)"


def _two_level(spark, d, measure: ms.Measure, column: str | None, out: str) -> DataFrame:
    """Partial states by supplier and line number, merged by supplier group, then finished: the whole life of a state."""
    rows = table(spark, d, "lineitem")
    states = rows.groupBy((F.col("l_suppkey") % 20).alias("g"), "l_linenumber").agg(measure.ingest(None if column is None else F.col(column)).alias("s"))
    return states.groupBy("g").agg(measure.merge(F.col("s")).alias("s")).select("g", measure.finish(F.col("s")).alias(out))


@query("measure_sum", f"SELECT {_BUCKET} AS g, sum(l_partkey)::BIGINT AS v FROM lineitem GROUP BY 1")
def _(spark, d):
    return _two_level(spark, d, ms.sum_of("bigint"), "l_partkey", "v")


@query("measure_min", f"SELECT {_BUCKET} AS g, min(l_extendedprice) AS v FROM lineitem GROUP BY 1")
def _(spark, d):
    return _two_level(spark, d, ms.min_of("double"), "l_extendedprice", "v")


@query("measure_max", f"SELECT {_BUCKET} AS g, max(l_extendedprice) AS v FROM lineitem GROUP BY 1")
def _(spark, d):
    return _two_level(spark, d, ms.max_of("double"), "l_extendedprice", "v")


@query("measure_count", f"SELECT {_BUCKET} AS g, count(*) AS v FROM lineitem GROUP BY 1")
def _(spark, d):
    return _two_level(spark, d, ms.count_of("bigint"), None, "v")


@query("measure_union", f"SELECT {_BUCKET} AS g, list_sort(list(DISTINCT l_linenumber)) AS v FROM lineitem GROUP BY 1")
def _(spark, d):
    return _two_level(spark, d, ms.union("int"), "l_linenumber", "v")


@query("measure_hll", f"SELECT {_BUCKET} AS g, count(DISTINCT l_partkey) AS exact, true AS within FROM lineitem GROUP BY 1")
def _(spark, d):
    """The estimate against the exact number: of 1024 registers the standard error is 3.25 %, four of them are allowed."""
    exact = table(spark, d, "lineitem").groupBy((F.col("l_suppkey") % 20).alias("g")).agg(F.count_distinct("l_partkey").alias("exact"))
    near = F.abs(F.col("v") - F.col("exact")) <= 0.13 * F.col("exact")
    return _two_level(spark, d, ms.hll(1024), "l_partkey", "v").join(exact, "g").select("g", "exact", near.alias("within"))


_STATS = "SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS ss FROM lineitem GROUP BY l_suppkey"


def _stats(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"), F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("ss"))


@query("computed_div_zero", "SELECT date, banner, impressions, clicks, CASE WHEN conversions <> 0 THEN clicks::DOUBLE / conversions ELSE 0.0 END AS cpc FROM ad_log")
def _(spark, d):
    return cm.with_computed(table(spark, d, "ad_log").select("date", "banner", "impressions", "clicks", "conversions"), ["cpc"], {"cpc": cm.div("clicks", "conversions")}).drop("conversions")


@query("computed_stddev", f"SELECT l_suppkey, round(CASE WHEN ss / n - (s / n) * (s / n) > 0 THEN sqrt(ss / n - (s / n) * (s / n)) ELSE 0.0 END, 6) AS sd FROM ({_STATS})")
def _(spark, d):
    return cm.with_computed(_stats(spark, d), ["sd"], {"sd": cm.stddev("s", "ss", "n")}).select("l_suppkey", F.round("sd", 6).alias("sd"))


@query("computed_percent", f"SELECT l_suppkey, round(s / n / 50 * 100, 6) AS pct FROM ({_STATS})")
def _(spark, d):
    got = cm.with_computed(_stats(spark, d), ["pct"], {"avg": cm.div("s", "n"), "pct": cm.percent("avg", 50.0)})
    return got.select("l_suppkey", F.round("pct", 6).alias("pct"))


@query("computed_sqrt", f"SELECT l_suppkey, round(CASE WHEN s - 1300 > 0 THEN sqrt(s - 1300) ELSE 0.0 END, 6) AS r, round(s * s + 2 * n, 6) AS sq FROM ({_STATS})")
def _(spark, d):
    got = cm.with_computed(_stats(spark, d), ["r", "sq"], {"r": cm.sqrt(cm.sub("s", 1300)), "sq": cm.add(cm.sqr("s"), cm.mul("n", 2))})
    return got.select("l_suppkey", F.round("r", 6).alias("r"), F.round("sq", 6).alias("sq"))


def _lineitem_aggregation(spark, d) -> aggregation.Aggregation:
    s = aggregation.Structure({"l_returnflag": "string", "l_linestatus": "string", "l_linenumber": "int"}, {"qty": ms.sum_of("double"), "n": ms.count_of(), "top": ms.max_of("double")})
    a = aggregation.Aggregation(spark, new_path(spark, "agg"), s)
    rows = table(spark, d, "lineitem")
    for odd in (0, 1):  # two loads: overlapping chunks
        a.consume(rows.where(F.col("l_orderkey") % 2 == odd), {"qty": "l_quantity", "n": None, "top": "l_extendedprice"}, commit=f"load-{odd}")
    return a


@query("aggregation_query", "SELECT l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) AS qty, count(*) AS n, max(l_extendedprice) AS top FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus BETWEEN 'A' AND 'M' GROUP BY ALL")
def _(spark, d):
    return _lineitem_aggregation(spark, d).query(["l_returnflag", "l_linestatus", "l_linenumber"], ["qty", "n", "top"], pr.and_(pr.eq("l_returnflag", "A"), pr.between("l_linestatus", "A", "M")))


@query("rollup_key_subset", "SELECT l_linenumber, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY l_linenumber")
def _(spark, d):
    a = _lineitem_aggregation(spark, d)
    a.consolidate(a.pick_hot_segment())
    return a.query(["l_linenumber"], ["qty", "n"])


# -- sort, union, partitioning ------------------------------------------------------------------


def _places(page: DataFrame) -> DataFrame:
    """With the place of each row in an ordered page; a page is one partition, so the places are those it comes out in."""
    return page.coalesce(1).withColumn("place", F.monotonically_increasing_id() + 1)


@query("top_k", "SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100)")
def _(spark, d):
    return _places(dataset.sort(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey").limit(100))


@query("sorted_ranks", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place FROM orders")
def _(spark, d):
    """The place of each row in the global order, from a range-partitioned sort: partition offsets plus places within."""
    from tessera.session import cut

    ranged = table(spark, d, "orders").select("o_orderdate", "o_orderkey").repartitionByRange("o_orderdate", "o_orderkey").sortWithinPartitions("o_orderdate", "o_orderkey")
    placed = cut(ranged.withColumn("part", F.spark_partition_id()), "ranked")
    sizes = placed.groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # one row per partition
    within = F.row_number().over(Window.partitionBy("part").orderBy("o_orderdate", "o_orderkey"))
    return placed.withColumn("within", within).join(before, "part").select("o_orderkey", (F.col("before") + F.col("within")).alias("place"))


def _in_order(df: DataFrame, *key: str) -> DataFrame:
    """With ``in_order``: whether a row comes after the one before it in its partition, as the rows come out."""

    def check(state_batch, state):
        keys = list(zip(*[state_batch[k] for k in key]))
        before = [state.get("last"), *keys[:-1]]
        if keys:
            state["last"] = keys[-1]
        return state_batch.assign(in_order=[b is None or b <= k for b, k in zip(before, keys)])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    return dataset.transduce(df, f"{schema}, in_order boolean", check)


@query("repartition_sort", "SELECT o_custkey, o_orderkey, true AS in_order FROM orders")
def _(spark, d):
    return _in_order(dataset.repartition_sort(table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", partitions=8), "o_custkey")


@query("local_sort", "SELECT s_suppkey, s_name, true AS in_order FROM supplier")
def _(spark, d):
    return _in_order(dataset.local_sort(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_name"), "s_name")


@query("read_sorted", "SELECT c_nationkey, c_custkey, true AS in_order FROM customer")
def _(spark, d):
    from tessera.sources.files import read_sorted

    return _in_order(read_sorted(spark, f"{d}/customer.parquet", ["c_nationkey"]).select("c_nationkey", "c_custkey"), "c_nationkey")


@query("sorter_distinct", "SELECT user_id, min(event_id) AS event_id, true AS in_order FROM events GROUP BY user_id")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id")
    return _in_order(dataset.sort(dataset.first_per_key(e, ["user_id"], ["event_id"]), "user_id"), "user_id")


@query("merge_sorted_distinct", "SELECT k, min(tag) AS tag FROM (SELECT c_nationkey AS k, 'c' AS tag FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier) GROUP BY k")
def _(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.lit("c").alias("tag"))
    b = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"), F.lit("s").alias("tag"))
    return dataset.merge_sorted(a, b, key=["k"], distinct=True)


@query("union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def _(spark, d):
    return dataset.union_all(table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")))


@query("concat_ordered", "SELECT 0 AS source, o_orderkey, true AS in_order FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT 1, o_orderkey, true FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    o = table(spark, d, "orders")
    both = dataset.concat(*[o.where(F.col("o_orderstatus") == s).select("o_orderkey") for s in ("F", "P")], order=["o_orderkey"]).withColumnRenamed("__source", "source")
    return _in_order(both, "source", "o_orderkey")


@query("read_settings", "SELECT p_partkey, p_name FROM part WHERE p_size = 7 ORDER BY p_partkey DESC LIMIT 20 OFFSET 5")
def _(spark, d):
    return dataset.read_settings(table(spark, d, "part"), ["p_partkey", "p_name"], {"p_size": 7}, {"p_partkey": "desc"}, 5, 20)


@query("rendezvous_shard", "SELECT c_custkey, 2 AS n_owners, true AS kept FROM customer")
def _(spark, d):
    """Two owners of four for each key; with a fifth shard only what the new one takes moves."""
    keys = table(spark, d, "customer").select("c_custkey")
    both = dataset.rendezvous(dataset.rendezvous(keys, "c_custkey", ["a", "b", "c", "d"], copies=2, out="before"), "c_custkey", ["a", "b", "c", "d", "e"], copies=2, out="after")
    stay = F.array_except("after", F.lit(["e"]))
    return both.select("c_custkey", F.size(F.array_distinct("before")).alias("n_owners"), (F.size(F.array_except(stay, "before")) == 0).alias("kept"))


# -- cube ---------------------------------------------------------------------------------------

_NA = "advertiser <> 0 AND campaign <> 0 AND banner <> 0"


def ad_cube(spark: SparkSession, d: str) -> Cube:
    """A cube over the ad log: three aggregations, two of them partial, parents, attributes and computed measures."""
    dims = {"date": "int", "advertiser": "int", "campaign": "int", "banner": "int", "affiliate": "int", "site": "string"}
    measures = {
        "impressions": ms.sum_of(), "clicks": ms.sum_of(), "conversions": ms.sum_of(), "revenue": ms.sum_of("decimal(24,4)"), "errors": ms.sum_of(),
        "eventCount": ms.count_of(), "minRevenue": ms.min_of("double"), "maxRevenue": ms.max_of("double"), "users": ms.union("int"), "estimatedUsers": ms.hll(4096),
    }
    computed = {"ctr": cm.percent("clicks", "impressions"), "uniqueConversion": cm.percent("conversions", "clicks"), "revenuePerEvent": cm.div("revenue", "eventCount")}
    cube = Cube(spark, new_path(spark, "cube"), dims, measures, computed, {"campaign": "advertiser", "banner": "campaign", "site": "affiliate"})
    every = list(measures)
    advertisers = pr.and_(pr.not_eq("advertiser", 0), pr.not_eq("campaign", 0), pr.not_eq("banner", 0))
    cube.with_aggregation("advertisers", ["date", "advertiser", "campaign", "banner"], [m for m in every if m != "errors"], advertisers)
    cube.with_aggregation("affiliates", ["date", "affiliate", "site"], every, pr.and_(pr.not_eq("affiliate", 0), pr.not_eq("site", "--")))
    cube.with_aggregation("daily", ["date"], ["impressions", "clicks", "conversions", "revenue", "errors", "eventCount"])
    cube.with_aggregation("errors", ["date", "advertiser", "campaign", "banner"], ["errors"], advertisers)
    cube.with_attributes("advertiser", StaticAttributes(table(spark, d, "advertisers")), ["name"])
    log = table(spark, d, "ad_log")
    inputs = {m: m for m in ("impressions", "clicks", "conversions", "errors")}
    inputs |= {"revenue": "revenue", "minRevenue": "revenue", "maxRevenue": "revenue", "users": "userId", "estimatedUsers": "userId", "eventCount": None}
    cube.consume(log.withColumn("revenue", F.col("revenue").cast("decimal(18,4)")), {k: k for k in dims}, inputs, commit="all")
    return cube


def _named(df: DataFrame) -> DataFrame:
    """Dots out of names and decimals to doubles."""
    return df.select(*[F.col(f"`{c}`").cast("double").alias(c) if t.startswith("decimal") else F.col(f"`{c}`").alias(c.replace(".", "_")) for c, t in df.dtypes])


_REV = "sum(revenue::DECIMAL(18,4))"
_CTR = "CASE WHEN sum(impressions) <> 0 THEN sum(clicks)::DOUBLE / sum(impressions) ELSE 0.0 END * 100"


@query("cube_query_flagship", f"""SELECT date, coalesce(sum(impressions), 0)::BIGINT AS impressions, coalesce(sum(clicks), 0)::BIGINT AS clicks, coalesce({_REV}, 0)::DOUBLE AS revenue, {_CTR} AS ctr
    FROM ad_log WHERE date BETWEEN 19730 AND 19760 GROUP BY date ORDER BY ctr DESC, date LIMIT 10""")
def flagship(spark, d):
    return _named(ad_cube(spark, d).query(CubeQuery(("date",), ("impressions", "clicks", "revenue", "ctr"), pr.between("date", 19730, 19760), order=(("ctr", "desc"), ("date", "asc")), limit=10)).rows)


@query("cube_parent_expansion", f"""SELECT advertiser, campaign, banner, sum(impressions)::BIGINT AS impressions, coalesce(max(revenue), 0) AS "maxRevenue", count(*) AS "eventCount" FROM ad_log WHERE {_NA} GROUP BY ALL""")
def _(spark, d):
    where = pr.and_(pr.not_eq("advertiser", 0), pr.not_eq("campaign", 0), pr.not_eq("banner", 0))
    return _named(ad_cube(spark, d).query(CubeQuery(("banner",), ("impressions", "maxRevenue", "eventCount"), where)).rows)


@query("cube_having_attr", f"""SELECT advertiser, name AS advertiser_name, clicks FROM (SELECT advertiser, sum(clicks)::BIGINT AS clicks FROM ad_log WHERE {_NA} GROUP BY 1)
    LEFT JOIN (SELECT advertiser, min(name) AS name FROM advertisers GROUP BY 1) USING (advertiser) WHERE clicks > 20 AND name IS NOT NULL""")
def _(spark, d):
    where = pr.and_(pr.not_eq("advertiser", 0), pr.not_eq("campaign", 0), pr.not_eq("banner", 0))
    q = CubeQuery(("advertiser", "advertiser.name"), ("clicks",), where, pr.and_(pr.gt("clicks", 20), pr.not_eq("advertiser.name", None)))
    return _named(ad_cube(spark, d).query(q).rows)


@query("cube_order_limit_offset", """SELECT *, row_number() OVER (ORDER BY clicks DESC, date) AS place FROM
    (SELECT date, sum(clicks)::BIGINT AS clicks FROM ad_log GROUP BY date ORDER BY clicks DESC, date LIMIT 10 OFFSET 5)""")
def _(spark, d):
    return _places(_named(ad_cube(spark, d).query(CubeQuery(("date",), ("clicks",), order=(("clicks", "desc"), ("date", "asc")), limit=10, offset=5)).rows))


@query("cube_multi_agg_stitch", f"SELECT date, advertiser, sum(clicks)::BIGINT AS clicks, sum(errors)::BIGINT AS errors FROM ad_log WHERE {_NA} GROUP BY date, advertiser")
def _(spark, d):
    where = pr.and_(pr.not_eq("advertiser", 0), pr.not_eq("campaign", 0), pr.not_eq("banner", 0))
    return _named(ad_cube(spark, d).query(CubeQuery(("date", "advertiser"), ("clicks", "errors"), where)).rows)


@query("totals_row", f"""SELECT sum(impressions)::BIGINT AS impressions, sum(clicks)::BIGINT AS clicks, {_REV}::DOUBLE AS revenue, {_CTR} AS ctr, list_sort(list(DISTINCT userId) FILTER (userId IS NOT NULL)) AS users
    FROM ad_log WHERE affiliate <> 0 AND site <> '--'""")
def _(spark, d):
    q = CubeQuery(("site",), ("impressions", "clicks", "revenue", "ctr", "users"), pr.and_(pr.not_eq("affiliate", 0), pr.not_eq("site", "--")), pr.gt("clicks", 100), limit=3, report=DATA_WITH_TOTALS)
    return _named(ad_cube(spark, d).query(q).totals)


# -- replicated state ---------------------------------------------------------------------------

_NODE = "event_id % 4"


@query("crdt_gcounter", f"SELECT user_id, sum(n)::BIGINT AS value FROM (SELECT user_id, {_NODE} AS node, max(event_id) AS n FROM events GROUP BY 1, 2) GROUP BY user_id")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") % 4).alias("node"), F.col("event_id").alias("n"))
    return crdt.GCOUNTER.read(crdt.GCOUNTER.merge(rows, ["user_id"]), ["user_id"])


@query("crdt_pncounter", f"""SELECT user_id, (sum(p) - sum(n))::BIGINT AS value FROM (SELECT user_id, {_NODE} AS node, max(CASE WHEN event_type = 'click' THEN event_id ELSE 0 END) AS p,
    max(CASE WHEN event_type = 'error' THEN event_id ELSE 0 END) AS n FROM events GROUP BY 1, 2) GROUP BY user_id""")
def _(spark, d):
    one = lambda kind: F.when(F.col("event_type") == kind, F.col("event_id")).otherwise(0)
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") % 4).alias("node"), one("click").alias("p"), one("error").alias("n"))
    return crdt.PNCOUNTER.read(crdt.PNCOUNTER.merge(rows, ["user_id"]), ["user_id"])


@query("crdt_gset", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS value FROM events GROUP BY user_id")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("element"), F.lit(True).alias("added"))
    return crdt.GSET.read(crdt.GSET.merge(rows, ["user_id"]), ["user_id"])


@query("crdt_tpset", "SELECT user_id, list_sort(list(event_type)) AS value FROM (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING NOT bool_or(value > 45)) GROUP BY user_id")
def _(spark, d):
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("element"), F.lit(True).alias("added"), (F.col("value") > 45).alias("removed"))
    return crdt.TPSET.read(crdt.TPSET.merge(rows, ["user_id"]), ["user_id"])


@query("crdt_lww", "SELECT user_id, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS stamp, max(event_type) FILTER (ts = m) AS obj FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id")
def _(spark, d):
    got = crdt.lww(table(spark, d, "events"), ["user_id"], "ts", "event_type")
    return got.select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("stamp"), F.col("event_type").alias("obj"))


@query("crdt_lwwset", """SELECT user_id, list_sort(list(e)) AS value FROM (SELECT user_id, event_type AS e, max(CASE WHEN value >= 5 THEN event_id END) AS a, max(CASE WHEN value < 5 THEN event_id END) AS r
    FROM events GROUP BY 1, 2) WHERE a IS NOT NULL AND (r IS NULL OR a >= r) GROUP BY user_id""")
def _(spark, d):
    big = F.col("value") >= 5
    rows = table(spark, d, "events").select("user_id", F.col("event_type").alias("element"), F.when(big, F.col("event_id")).alias("added"), F.when(~big, F.col("event_id")).alias("removed"))
    return crdt.LWWSET.read(crdt.LWWSET.merge(rows, ["user_id"]), ["user_id"])


@query("crdt_gmap", "SELECT user_id, event_type, max(value) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    return crdt.gmap(table(spark, d, "events"), ["user_id"], "event_type", {"value": F.max("value")})


def _appends(spark, d) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("ts"), F.col("value").alias("state"), (F.col("event_type") == "error").alias("removed"))
    return e.withColumn("state", F.when(~F.col("removed"), F.col("state")))


_LIVE = """SELECT user_id, max(event_id) FILTER (event_type <> 'error') AS ts, max(value) FILTER (event_type <> 'error') AS state FROM events GROUP BY user_id
    HAVING max(event_id) FILTER (event_type <> 'error') IS NOT NULL AND coalesce(max(event_id) FILTER (event_type = 'error'), -1) < max(event_id) FILTER (event_type <> 'error')"""


@query("crdt_tombstone", _LIVE)
def _(spark, d):
    return crdt.live(_appends(spark, d), ["user_id"], {"state": F.max("state")})


@query("crdt_delta", f"SELECT * FROM ({_LIVE}) WHERE ts > 9900")
def _(spark, d):
    return crdt.extract(crdt.live(_appends(spark, d), ["user_id"], {"state": F.max("state")}), 9900, "ts")


# -- logs ---------------------------------------------------------------------------------------


_PER_TYPE = "SELECT event_type, count(*) AS n, sum(value::DECIMAL(18,2))::DOUBLE AS total FROM events GROUP BY event_type"


def _logged(spark, d, controller: bool) -> DataFrame:
    from tessera.sources.multilog import Multilog
    from tessera.streaming.etl import LogController, LogProcessor, log_to_cube

    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))
    log = Multilog(spark, new_path(spark, "log"), "event_id long, user_id long, event_type string, value double, ts timestamp")
    cube = Cube(spark, new_path(spark, "cube"), {"event_type": "string"}, {"n": ms.count_of(), "total": ms.sum_of("decimal(24,2)")})
    cube.with_aggregation("types", ["event_type"], ["n", "total"])
    state = new_path(spark, "positions")
    money = lambda df: df.withColumn("value", F.col("value").cast("decimal(18,2)"))
    for half in (0, 1):
        log.write(events.where(F.col("event_id") % 2 == half), F.col("user_id") % 3, F.date_trunc("month", "ts"))
        if controller:
            LogController(cube, [LogProcessor(cube, log, {"event_type": "event_type"}, {"n": None, "total": "value"}, transform=money)]).process()
        else:
            log_to_cube(log.stream(), cube, {"event_type": "event_type"}, {"n": None, "total": "value"}, state, transform=money)
    return _named(cube.query(CubeQuery(("event_type",), ("n", "total"))).rows)


@query("log_incremental_ingest", _PER_TYPE)
def _(spark, d):
    """The events written to a log in two parts, each taken in by a restarted stream; equal to one load of everything."""
    return _logged(spark, d, controller=False)


@query("log_controller_ingest", _PER_TYPE)
def _(spark, d):
    """The same from positions that are committed with the chunks."""
    return _logged(spark, d, controller=True)
