"""The whole market-monitoring workflow on one data set, as lazy DataFrames.

``MarketRound`` wires the operators together for the test binding
(``souk.sources.tpch``).  Attributes are lazy plans, except the tables that
many outputs share (observations, item prices, lookups, the five-level means,
the basket, the survey statistics, the long report): those are written once
under the checkpoint folder when first used, and every later plan starts
from their scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk import config
from souk.functions import exprs as X
from souk.operators import analysis as A
from souk.operators import basket as B
from souk.operators import change as C
from souk.operators import cleaning as CL
from souk.operators import dims as D
from souk.operators import impute as I
from souk.operators import means as M
from souk.operators import report as RP
from souk.operators import reshape as R
from souk.operators import rounds as RD
from souk.operators import survey as S
from souk.plans import template
from souk.sources import export as EX
from souk.sources import files as FS
from souk.sources import tpch
from souk.sources.store import materialize

FOLLOWUPS = (("status_f_totalprice", "o_orderstatus", "F", "o_totalprice"),
             ("urgent_custkey", "o_orderpriority", "1-URGENT", "o_custkey"))


class MarketRound:
    def __init__(self, spark: SparkSession, sf_dir: str,
                 this_round: str = config.THIS_ROUND, last_round: str = config.LAST_ROUND,
                 baseline_round: str = config.BASELINE_ROUND):
        self.spark, self.sf_dir = spark, sf_dir
        self.this_round, self.last_round, self.baseline_round = this_round, last_round, baseline_round

    # ------------------------------------------------------------ inputs
    @cached_property
    def rounds(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tpch.rounds(self.spark, self.sf_dir)

    @cached_property
    def stacked(self) -> DataFrame:
        """U1 + F7 + P9 + F18: the three rounds, month named, order tagged."""
        df = RD.stack_rounds(self.rounds)
        df = df.withColumn("month", X.month_name(F.col("month"))).where(F.col("month").isNotNull())
        order = (F.when(F.col("month") == self.this_round, F.lit(config.ORDER_THIS))
                 .when(F.col("month") == self.last_round, F.lit(config.ORDER_LAST))
                 .otherwise(F.lit(config.ORDER_OTHER)))
        return df.withColumn("collection_order", order)

    @cached_property
    def settlements(self) -> DataFrame:
        return D.prepare_settlements(tpch.settlement_dimension(self.spark, self.sf_dir),
                                     centroid_district=config.BIND_CENTROID_DISTRICT)

    @cached_property
    def districts(self) -> DataFrame:
        return D.prepare_districts(tpch.district_dimension(self.spark, self.sf_dir))

    @cached_property
    def settlement_lookup(self) -> DataFrame:
        return materialize(D.settlement_lookup(self.settlements), "settlement_lookup")

    @cached_property
    def district_lookup(self) -> DataFrame:
        return materialize(D.district_lookup(self.districts), "district_lookup")

    @cached_property
    def obs(self) -> DataFrame:
        """M1.  The two lookups are one row per settlement / district; they
        are written once so the planner sees their real size and broadcasts
        them (under ``spark.sql.autoBroadcastJoinThreshold``) instead of
        shuffling the observations; above it, the join falls back to a
        sort-merge join on its own."""
        return RD.stack_and_enrich(self.rounds, self.settlement_lookup, self.district_lookup, west_nile=config.BIND_WEST_NILE)

    @cached_property
    def item_prices(self) -> DataFrame:
        """Written once (by month): the five levels, the counts and the
        medians all read it, and the month filters of the basket and the
        counts prune to their rounds."""
        return materialize(RD.item_prices(self.obs, self.this_round, self.last_round,
                                          unit_items=config.BIND_UNIT_ITEMS),
                           "item_prices", partition_by=("month",))

    # ------------------------------------------------------------ means
    def means(self, level: str) -> DataFrame:
        return M.area_means(self.item_prices, level)

    @cached_property
    def all_means(self) -> DataFrame:
        return materialize(M.all_level_means(self.item_prices), "area_means")

    def level_means(self, level: str) -> DataFrame:
        """One level out of the materialised five-level table (for the change
        tables and the report)."""
        return M.level_from_all(self.all_means, level)

    @cached_property
    def counts(self) -> DataFrame:
        return M.assessment_counts(self.item_prices, self.this_round)

    # ------------------------------------------------------------ basket
    @cached_property
    def all_medians(self) -> DataFrame:
        """One run over all rounds, written once; the basket, the baseline and the
        medians themselves are filters on the month."""
        return materialize(I.settlement_medians(self.item_prices, [self.this_round, self.last_round, self.baseline_round]),
                           "medians")

    @cached_property
    def medians(self) -> DataFrame:
        return self.all_medians.where(F.col("month").isin(self.this_round, self.last_round))

    @cached_property
    def imputed(self) -> DataFrame:
        return I.impute_hierarchical(self.medians)

    @cached_property
    def meb_baseline(self) -> DataFrame:
        """The baseline round's basket table (the original workflow reads a precomputed
        one; here it is computed the same way from the baseline round)."""
        return B.meb_from_medians(self.all_medians.where(F.col("month") == self.baseline_round),
                                  config.BIND_BASKET_ITEMS, config.BIND_FOOD_TOTAL_ORDER)

    @cached_property
    def meb(self) -> DataFrame:
        return materialize(B.meb_from_medians(self.medians, config.BIND_BASKET_ITEMS, config.BIND_FOOD_TOTAL_ORDER,
                                              baseline=self.meb_baseline), "meb")

    @cached_property
    def meb_regional(self) -> DataFrame:
        return B.meb_rollup(self.meb, "regional")

    @cached_property
    def meb_national(self) -> DataFrame:
        return B.meb_rollup(self.meb, "national")

    @cached_property
    def rank_all(self) -> DataFrame:
        return B.rank_all(self.meb, self.this_round)

    @cached_property
    def rank(self) -> DataFrame:
        return B.rank_areas(self.meb, self.this_round, k=3)

    # ------------------------------------------------------------ change
    @cached_property
    def change_settlement(self) -> DataFrame:
        return C.item_change(self.level_means("settlement"), ["settlement"])

    @cached_property
    def change_region(self) -> DataFrame:
        return C.item_change(self.level_means("region"), ["regions"])

    @cached_property
    def change_national(self) -> DataFrame:
        return C.item_change(self.level_means("national"), []) \
            .withColumn("regions", F.lit(config.NATIONAL_LABEL))

    @cached_property
    def change_meb_settlement(self) -> DataFrame:
        return C.meb_change(self.meb, ["settlement"])

    @cached_property
    def change_meb_region(self) -> DataFrame:
        return C.meb_change(self.meb_regional, ["regions"], prefix="regional_")

    @cached_property
    def change_meb_national(self) -> DataFrame:
        return C.meb_change(self.meb_national, [], prefix="national_") \
            .withColumn("regions", F.lit(config.NATIONAL_LABEL))

    @cached_property
    def change_settlement_merged(self) -> DataFrame:
        return C.merge_changes([self.change_settlement, self.change_meb_settlement], ["settlement"])

    @cached_property
    def change_region_merged(self) -> DataFrame:
        """Items and regional basket change, joined on the lower-cased region."""
        return C.merge_changes([C.with_lower_key(self.change_region, "regions"),
                                C.with_lower_key(self.change_meb_region, "regions")], ["regions"])

    # ------------------------------------------------------------ survey
    @cached_property
    def survey_orders(self) -> DataFrame:
        """Respondent table of the select-one and numeric answers, written
        once: shares, numeric means, labels and the statistics all read it."""
        return materialize(tpch.survey_orders(self.spark, self.sf_dir), "survey_orders")

    @cached_property
    def survey_events(self) -> DataFrame:
        """Respondent table of the select-multiple answers (one row per user
        and day), written once for the same reason."""
        return materialize(tpch.survey_events(self.spark, self.sf_dir), "survey_events")

    @cached_property
    def shares_one(self) -> DataFrame:
        return S.select_one_shares(self.survey_orders, config.BIND_SELECT_ONE).unionByName(
            S.select_one_shares(self.survey_events, ["mobile_accepted"]))

    @cached_property
    def shares_multiple(self) -> DataFrame:
        return S.select_multiple_shares(self.survey_events, ["event_types"])

    @cached_property
    def numeric(self) -> DataFrame:
        return S.numeric_means(self.survey_orders, config.BIND_NUMERIC)

    @cached_property
    def stats(self) -> DataFrame:
        return materialize(
            self.shares_one.unionByName(self.shares_multiple).unionByName(self.numeric), "stats")

    @cached_property
    def categorical(self) -> DataFrame:
        return self.stats.where(~F.col("dependent_var").isin(list(config.BIND_NUMERIC)))

    @cached_property
    def plan(self) -> DataFrame:
        """The analysis plan's rows, their kinds from the questionnaire."""
        return A.plan_rows(tpch.analysis_plan(self.spark), tpch.questions(self.spark))

    @cached_property
    def planned(self) -> DataFrame:
        """M12 from the plan, over both respondent tables."""
        return materialize(A.analyse_by_plan(self.survey_orders, self.plan)
                           .unionByName(A.analyse_by_plan(self.survey_events, self.plan)), "planned")

    @cached_property
    def labelled_by_list(self) -> DataFrame:
        """Answers and repeat values by each question's own list."""
        return A.label_by_list(self.planned, tpch.questions(self.spark), tpch.choice_lists(self.spark, self.sf_dir), True,
                               (("dependent_var", "dependent_var_value"), ("independent_var", "independent_var_value")))

    @cached_property
    def tests(self) -> DataFrame:
        """Hypothesis-test results per (question, grouping).  No test engine
        runs here; the bound table names some tests twice and leaves others out."""
        return tpch.test_results(self.spark, self.sf_dir)

    @cached_property
    def with_p_value(self) -> DataFrame:
        return S.attach_p_value(self.stats, self.tests)

    @cached_property
    def labelled(self) -> DataFrame:
        return S.label_choices(self.shares_one.where(F.col("dependent_var") == "home_region"),
                               tpch.choices(self.spark, self.sf_dir))

    @cached_property
    def labelled_categorical(self) -> DataFrame:
        """Answers by their labels, as the top answers show them; an answer
        that no choice list names keeps its code."""
        return S.label_choices(self.categorical, tpch.choices(self.spark, self.sf_dir), keep_unmatched=True)

    def top_keys(self) -> list[tuple[str, str, int]]:
        out = []
        for vars_, k in ((config.BIND_TOP3_VARS, 3), (config.BIND_TOP2_VARS, 2)):
            for area in config.REPORT_AREAS:
                for v in vars_:
                    for r in range(1, k + 1):
                        out.append((area, v, r))
        return out

    @cached_property
    def top_answers(self) -> DataFrame:
        cat = self.labelled_categorical
        return R.top_answers(cat, config.BIND_TOP3_VARS, config.REPORT_AREAS, 3).unionByName(
            R.top_answers(cat, config.BIND_TOP2_VARS, config.REPORT_AREAS, 2))

    @cached_property
    def top_wide(self) -> DataFrame:
        """R3 + R6: one row, ``numbers_<key>`` and ``dependent_var_value_<key>``."""
        cat = self.labelled_categorical
        t = R.top_k(cat, config.BIND_TOP3_VARS, config.REPORT_AREAS, 3).unionByName(
            R.top_k(cat, config.BIND_TOP2_VARS, config.REPORT_AREAS, 2))
        t = t.select(X.paste("independent_var_value", "dependent_var", "rank").alias("new_var"),
                     (F.col("numbers") * 100).alias("numbers"), "dependent_var_value")
        keys = [f"{a}_{v}_{r}" for a, v, r in self.top_keys()]
        p = t.groupBy().pivot("new_var", keys).agg(
            F.max("numbers").alias("numbers"),
            F.max("dependent_var_value").alias("dependent_var_value"))
        ren = {}
        for k in keys:
            ren[f"{k}_numbers"] = f"numbers_{k}"
            ren[f"{k}_dependent_var_value"] = f"dependent_var_value_{k}"
        return p.withColumnsRenamed(ren)

    @cached_property
    def area_scalars(self) -> DataFrame:
        return R.area_scalars(self.stats, config.BIND_NUMERIC, config.BIND_SHARE_VARS,
                              config.REPORT_AREAS)

    # ------------------------------------------------------------ cleaning
    @cached_property
    def cleaned(self) -> CL.Cleaned:
        return CL.apply_cleaning_log(tpch.cleaning_data(self.spark, self.sf_dir),
                                     tpch.cleaning_log(self.spark, self.sf_dir), id_col="o_orderkey")

    @cached_property
    def followups(self) -> DataFrame:
        return CL.derive_followups(self.cleaned.clean, FOLLOWUPS)

    # ------------------------------------------------------------ report
    def _this(self, df: DataFrame) -> DataFrame:
        return df.where(F.col("collection_order") == config.ORDER_THIS)

    @cached_property
    def report_long(self) -> DataFrame:
        """M16, written once: the one-row report reads it twice (its keys, its
        cells)."""
        return materialize(self.report_cells(), "report_long")

    def report_cells(self) -> DataFrame:
        """Every report cell as (key, num, str), in the template's order."""
        drop_items = ["price_nails"]
        pieces = []
        nat = self._this(self.level_means("national")).drop("month", "collection_order", *drop_items)
        pieces.append(R.wide_to_long(nat, "national_"))
        reg = self._this(self.level_means("region")).drop("month", "collection_order", *drop_items)
        pieces.append(self._by_region(reg))
        sett = self._this(self.level_means("settlement")).drop(
            "month", "collection_order", "district", "regions", *drop_items)
        pieces.append(R.wide_to_long(sett, F.concat(F.col("settlement"), F.lit("_")), ["settlement"]))
        # national item and basket changes are one row each: unioned as cells,
        # not joined (a join on the constant key would be a cross product)
        pieces.append(R.wide_to_long(self.change_national.drop("regions"), "national_"))
        pieces.append(R.wide_to_long(self.change_meb_national.drop("regions"), "national_"))
        pieces.append(self._by_region(self.change_region_merged))
        pieces.append(R.wide_to_long(self.change_settlement_merged,
                                     F.concat(F.col("settlement"), F.lit("_")), ["settlement"]))
        meb_set = self._this(self.meb).drop("month", "collection_order", "regions", "district")
        pieces.append(R.wide_to_long(meb_set, F.concat(F.col("settlement"), F.lit("_")),
                                     ["settlement"]))
        meb_reg = self._this(self.meb_regional).drop("month", "collection_order")
        pieces.append(self._by_region(meb_reg))
        meb_nat = self._this(self.meb_national).drop("month", "collection_order")
        pieces.append(R.wide_to_long(meb_nat, "national_", ["regions"]))
        pieces.append(R.to_long(self._this(self.meb_national), F.lit("national_regions"),
                                text=F.col("regions")))
        cnt = self.counts
        pieces.append(R.to_long(cnt, F.concat(F.lit("num_market_assessed_"), F.col("level")),
                                num=F.col("num_market_assessed")))
        pieces.append(R.to_long(cnt, F.concat(F.lit("num_assessed_"), F.col("level")),
                                num=F.col("num_assessed")))
        pieces.append(R.to_long(self.rank, F.concat(F.lit("expansive_rank_"),
                                                    F.col("rank").cast("string")),
                                text=F.col("settlement")))
        pieces += [self.top_answers, self.area_scalars]
        # every piece is (key, num, str) in that order: a positional union
        # needs no name matching
        out = pieces[0]
        for p in pieces[1:]:
            out = out.union(p)
        return out

    def _by_region(self, df: DataFrame) -> DataFrame:
        """Cells of any region: its name without blanks is the key's prefix."""
        prefix = F.concat(F.regexp_replace("regions", " ", ""), F.lit("_"))
        return R.wide_to_long(df.where(F.col("regions").isNotNull()), prefix, ["regions"])

    @cached_property
    def report_by_settlement(self) -> DataFrame:
        """The report's settlement cells as one row per settlement: this
        round's means, all changes and the basket, in fixed columns."""
        sett = self._this(self.level_means("settlement")).drop("month", "collection_order", "district", "regions")
        meb = self._this(self.meb).drop("month", "collection_order", "regions", "district")
        return C.merge_changes([sett, self.change_settlement_merged, meb], ["settlement"])

    @cached_property
    def report_row(self) -> DataFrame:
        """The report in the template's columns, whatever the data holds."""
        return RP.report_from_template(self.report_long, template.cells())

    # ------------------------------------------------------------ export
    def price_tables(self) -> dict[str, DataFrame]:
        """The means-and-change workbook: nine tables."""
        tables = [self.level_means("market"), self.level_means("settlement"),
                  self.level_means("district"), self.level_means("region"),
                  self.level_means("national"), self.change_settlement_merged,
                  self.change_region_merged, self.change_national, self.rank]
        return dict(zip(config.PRICE_TABLE_NAMES, tables))

    def basket_tables(self) -> dict[str, DataFrame]:
        """The basket workbook: six tables."""
        tables = [self.meb, self.meb_regional, self.meb_national, self.change_meb_settlement,
                  self.change_meb_region, self.change_meb_national]
        return dict(zip(config.BASKET_TABLE_NAMES, tables))

    def export(self, base: str, run_date: str) -> dict[str, str]:
        """Every output of a round (S6-S9) as one export that is whole or not there:
        the two table sets and the clean data as Parquet, the analysis table and the
        one-row report as CSV with ``n/a`` for missing values.  Returns the paths."""
        tables = {**self.price_tables(), **self.basket_tables(), "clean data": self.cleaned.clean,
                  "analysis": self.stats, "report": self.report_row}
        writers = {"analysis": ("csv", FS.write_summary), "report": ("csv", FS.write_csv), "clean data": ("parquet", FS.write_clean)}
        done = EX.publish(self.spark, f"{base.rstrip('/')}/{run_date}", tables, writers)
        return {name: t["path"] for name, t in done["tables"].items()}
