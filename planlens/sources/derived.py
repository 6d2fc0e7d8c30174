"""Review, area and document tables derived from the star-schema test tables.

Each table grows with its source: one plan per customer, one area per customer,
one polygon and one plan name per part, one document per order.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from planlens.functions.geo import POINT
from planlens.operators.areas import union_search
from planlens.operators.inclusion import NAME_RULES
from planlens.operators.reshape import cell_max
from planlens.operators.review import review_long
from planlens.questions import FIRST_ANSWER, N_QUESTIONS, question_key

PLANS_PER_SHEET = 20
STAR = 31
AREAS_PER_PLAN = 8

# Name endings that the name shortening knows.
NAME_TERMS = [term for term, _ in NAME_RULES]

LANGUAGES = ["english", "spanish", "french", "portuguese", "english"]


def _stat_entry(n: Column) -> Column:
    h = (F.col("c_custkey") * 31 + n * n * 17 + F.floor(F.abs(F.col("c_acctbal")))) % 11
    planned = n.between(31, 33)
    coded = (
        F.when(h <= 3, "1")
        .when(h <= 7, "0")
        .when(h == 8, F.when(n.between(34, 47), "0.5").otherwise("0"))
        .when(h == 9, F.when(planned, "Planned").otherwise("1"))
        .otherwise(F.when(planned | n.between(50, 59), F.lit(None)).otherwise("0"))
    )
    language = F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (F.col("c_custkey") % 5 + 1).cast("int"))
    return F.when(n == 3, F.col("n_name")).when(n == 4, language).otherwise(coded)


def _box(lon: Column, lat: Column, width: Column) -> Column:
    corners = [(lon, lat), (lon + width, lat), (lon + width, lat + width), (lon, lat + width), (lon, lat)]
    return F.array(*[F.struct(x.alias("lon"), y.alias("lat")).cast(POINT) for x, y in corners])


def _once(build: Callable) -> Callable:
    """Keep what a method returns for as long as its object lives."""

    @wraps(build)
    def kept(self, *args):
        key = (build.__name__, *args)
        if key not in self._planned:
            self._planned[key] = build(self, *args)
        return self._planned[key]

    return kept


class DerivedTables:
    """The tables below one folder of the test data; each is planned once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._planned: dict[tuple, object] = {}

    @_once
    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _partitioned(self, rows: DataFrame, key: str) -> DataFrame:
        """Rows partitioned by their later id while they are still narrow.

        They grow manyfold afterwards, and answers of a plan then need no second shuffle.
        """
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return rows.repartition(partitions, key)

    @_once
    def answers(self) -> DataFrame:
        """plan_id, name, type, q_id, q_num, entry: both record types of every plan."""
        return self._answers(self._partitioned(self.table("customer"), "c_custkey"))

    def _answers(self, plans: DataFrame, *kept: str) -> DataFrame:
        """The answers of ``plans``, rows of ``customer``, and the columns ``kept`` of these."""
        customers = plans.join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        number = F.explode(F.sequence(F.lit(FIRST_ANSWER), F.lit(N_QUESTIONS))).alias("q_num")
        kind = F.explode(F.array(F.lit("stat"), F.lit("detail"))).alias("type")
        rows = customers.select("*", number).select("*", kind)
        # Entries are computed after the record types are spread, so that a filter on the type comes first.
        stat = _stat_entry(F.col("q_num"))
        text = F.concat(F.lit(" - "), F.lower("c_mktsegment"), F.lit(" measure "), F.col("q_num"))
        return rows.select(
            F.col("c_custkey").alias("plan_id"),
            F.concat("c_name", F.lit(" (segment "), "c_mktsegment", F.lit(")")).alias("name"),
            "type",
            F.concat(F.lit("Q_"), F.col("q_num")).alias("q_id"),
            "q_num",
            F.when(F.col("type") == "stat", stat).when(stat.isin("1", "0.5", "Planned"), text).alias("entry"),
            *kept,
        )

    @_once
    def review(self) -> DataFrame:
        return review_long(self.answers(), question_key(self.spark))

    @_once
    def sheets(self) -> DataFrame:
        """Questionnaire sheets: 83 rows and two columns per plan, 20 plans to a sheet.

        The plans of a sheet lie together from the start, so their cells are not shuffled.
        """
        sheet = F.floor(F.col("c_custkey") / PLANS_PER_SHEET).alias("sheet_id")
        rows = self._answers(self._partitioned(self.table("customer").select("*", sheet), "sheet_id"), "sheet_id")
        # both heading rows come with the first answer, so that a plan's rows are made in one place
        entry, kind = F.col("entry"), F.col("type")
        cells = rows.select(
            "sheet_id",
            "plan_id",
            "type",
            F.inline(
                F.when(
                    F.col("q_num") == FIRST_ANSWER,
                    F.array(*[F.struct(n.alias("q_num"), v.alias("entry")) for n, v in [(F.lit(1), F.col("name")), (F.lit(2), kind), (F.col("q_num"), entry)]]),
                ).otherwise(F.array(F.struct("q_num", "entry")))
            ),
        )
        at = F.col("plan_id") % PLANS_PER_SHEET * 2 + F.when(kind == "stat", 0).otherwise(1)
        located = cells.select("sheet_id", "q_num", at.alias("_at"), "entry")
        columns = [cell_max(F.col("entry"), F.col("_at") == i).alias(f"p{i + 1}") for i in range(2 * PLANS_PER_SHEET)]
        key = question_key(self.spark).select("q_num", F.col("q_code").alias("code"), F.col("q_long").alias("plan-id"))
        wide = located.groupBy("sheet_id", "q_num").agg(*columns)
        return wide.join(F.broadcast(key), "q_num").select("sheet_id", "q_num", "code", "plan-id", *wide.columns[2:])

    @_once
    def atlas(self) -> DataFrame:
        places = self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
        customers = self.table("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
        segment = F.col("c_mktsegment")
        return customers.select(
            F.col("c_custkey").alias("mpa_id"),
            F.when(F.col("c_custkey") % 10 == 0, 0).otherwise(1).alias("implemente"),
            F.when(segment == "AUTOMOBILE", "All").when(segment == "BUILDING", "Part").otherwise("None").alias("no_take"),
            F.when(F.col("c_custkey") % 7 == 0, 0).otherwise(1).alias("is_mpa"),
            F.col("n_name").alias("country"),
            F.col("r_name").alias("region"),
            F.concat("r_name", F.lit("-"), F.col("n_nationkey") % 2).alias("subregion"),
        )

    @_once
    def _searched(self) -> DataFrame:
        """One search row per order, so an area has many; an unspecified priority means not searched yet."""
        status, plan = F.col("o_orderstatus"), F.floor(F.col("o_custkey") / AREAS_PER_PLAN) + 1
        unsearched = F.col("o_orderpriority") == "4-NOT SPECIFIED"
        outcome = F.when(unsearched, "NS").when(status == "F", "F").when(status == "P", "F-AI").otherwise("NI")
        return self.table("orders").select(
            F.col("o_custkey").alias("mpa_id"),
            outcome.alias("search"),
            F.when((status != "O") & ~unsearched, plan).alias("plan_id"),
            F.col("o_orderpriority").alias("notes"),
            F.when(status == "P", "shared").alias("network"),
            F.concat(F.lit("Area "), F.col("o_custkey")).alias("name"),
            F.year("o_orderdate").alias("_year"),
        )

    @_once
    def search_lists(self) -> tuple[DataFrame, DataFrame]:
        """The first list and the later additions."""
        rows = self._searched().drop("_year")
        later = F.col("notes") == "5-LOW"
        return rows.where(~later), rows.where(later).select("name", "network", "notes", "plan_id", "search", "mpa_id")

    @_once
    def search(self) -> DataFrame:
        """The whole search list: a projection of a scan, so that each step reads only the columns it needs."""
        return union_search(*self.search_lists())

    @_once
    def plans(self) -> DataFrame:
        """Plan metadata: least name, country and year of the search rows of a plan."""
        rows = self._searched().where(F.col("plan_id").isNotNull())
        located = rows.join(self.atlas().select("mpa_id", "country"), "mpa_id")
        return located.groupBy("plan_id").agg(
            F.concat(F.lit("Plan "), F.col("plan_id")).alias("name"),
            F.min("country").alias("country"),
            F.min("_year").alias("mp_year"),
        )

    @_once
    def all_plans(self) -> DataFrame:
        """Every plan number, searched or not."""
        plan = F.floor(F.col("c_custkey") / AREAS_PER_PLAN) + 1
        return self.table("customer").select(plan.alias("plan_id")).distinct()

    @_once
    def geometry(self) -> DataFrame:
        """Boxes, some with a hole or a second polygon, and eight kinds of bad geometries."""
        key, width = F.col("p_partkey"), F.col("p_size") * F.col("p_size") / 500.0
        lon, lat = (key * 37 % 340 - 170).cast("double"), (key * 53 % 140 - 70).cast("double")
        outer = _box(lon, lat, width)
        hole = _box(lon + width / 4, lat + width / 4, width / 2)
        second = _box(lon, lat - width - 1, width)
        first = F.when(F.col("p_size") % 2 == 0, F.array(outer, hole)).otherwise(F.array(outer))
        good = F.when(F.col("p_size") % 5 == 0, F.array(first, F.array(second))).otherwise(F.array(first))
        point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat")).cast(POINT)
        bad = {
            0: F.slice(outer, 1, 4),
            1: F.slice(outer, 1, 3),
            2: F.concat(F.array(point(lon, F.lit(95.0))), F.slice(outer, 2, 3), F.array(point(lon, F.lit(95.0)))),
            3: F.concat(F.slice(outer, 1, 2), F.array(point(lon, F.lit(None).cast("double"))), F.slice(outer, 4, 2)),
        }
        tie = F.array(*[F.get(outer, F.lit(i)) for i in (0, 2, 1, 3, 0)])
        angle = lambda i: (i % STAR) * (4 * math.pi / STAR)  # noqa: E731  every second corner, so the edges cross
        star = F.transform(
            F.sequence(F.lit(0), F.lit(STAR)), lambda i: point(lon + width / 2 * F.cos(angle(i)), lat + width / 2 * F.sin(angle(i)))
        )
        bad |= {5: tie, 7: star}
        kind = key % 50
        geometry = F.when(kind == 4, F.lit(None)).when(kind == 6, F.array(F.array(outer, _box(lon, lat - 2 * width, width / 2))))
        for remainder, ring in bad.items():
            geometry = geometry.when(kind == remainder, F.array(F.array(ring)))
        # As a generator's output the geometry is made once, as if read, however often later expressions mention it.
        made = F.explode(F.array(geometry.otherwise(good))).alias("geometry")
        return self._partitioned(self.table("part"), "p_partkey").select(key.alias("mpa_id"), made)

    @_once
    def names(self) -> DataFrame:
        """English plan names; the repeated term shows that only the first one is shortened."""
        term = F.element_at(F.array(*[F.lit(t) for t in NAME_TERMS]), (F.col("p_partkey") % 11 + 1).cast("int"))
        name = F.concat("p_name", F.lit(" "), term, F.lit(" and "), term, F.lit(" ("), "p_brand", F.lit(")"))
        return self.table("part").select(F.col("p_partkey").alias("plan_id"), name.alias("name_english"))

    @_once
    def references(self) -> DataFrame:
        """Document list with the headings of the sheet it comes from."""
        key = F.col("o_orderkey")
        return self.table("orders").select(
            F.col("o_custkey").alias("Plan ID"),
            F.when(key % 3 == 0, "appendix").otherwise("plan").alias("Document Type"),
            F.when(key % 7 != 0, key % 20 + 1).cast("double").alias("timeListed"),
            F.when(key % 4 != 0, F.col("o_orderpriority")).alias("Work-Plan"),
        )

    @_once
    def raw_cells(self) -> DataFrame:
        """Order rows as untrimmed text cells with several spellings of "no answer"."""
        kind, status = F.col("o_orderkey") % 5, F.col("o_orderstatus")
        cell = (
            F.when(kind == 0, " NA")
            .when(kind == 1, "NS")
            .when(kind == 2, "")
            .when(kind == 3, F.concat(F.lit("  "), status, F.lit(" ")))
            .otherwise(status)
        )
        return self.table("orders").select(
            F.col("o_orderkey").cast("string").alias("Plan ID"),
            cell.alias("Document Type"),
            F.when(kind == 4, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("Area #"),
            F.col("o_orderpriority").alias("notesText"),
        )
