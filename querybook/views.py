"""Feed-shaped views over the given tables. All of them grow with the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardwise.sources.dimensions import official_states


class Views:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self.opened:
            self.opened[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self.opened[name]

    # --- shared pieces

    def _customers(self) -> DataFrame:
        """Customers with their state name, district name and PIN."""
        key = F.col("c_custkey")
        return self.table("customer").join(
            self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey")
        ).select(
            "c_custkey",
            F.col("c_mktsegment").alias("segment"),
            F.col("n_name").alias("state"),
            F.concat_ws(" ", "c_mktsegment", (key % 7).cast("string")).alias("district"),
            (F.lit(110000) + key % 900).cast("int").alias("pincode"),
        )

    def _orders(self, people: DataFrame) -> DataFrame:
        """Orders with their date and the ordering customer's columns."""
        orders = self.table("orders").select(
            "o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("date")
        )
        return orders.join(people, F.col("o_custkey") == F.col("c_custkey"))

    def _lines(self, people: DataFrame) -> DataFrame:
        """Line items with date and customer columns.

        The small tables meet first, so the largest one is joined only once.
        """
        lines = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", F.col("l_quantity").cast("bigint").alias("quantity")
        )
        return lines.join(self._orders(people), F.col("l_orderkey") == F.col("o_orderkey"))

    # --- canonical feeds

    def enrol(self) -> DataFrame:
        return (
            self._lines(self._customers())
            .select("date", "state", "district", "pincode", F.col("quantity").alias("adult_enrolments"))
        )

    def bio(self) -> DataFrame:
        """Districts numbered 6 are called 7 here: some names exist in one feed only."""
        key = F.col("o_orderkey")
        return (
            self._orders(self._customers())
            .select(
                "date", "state", F.translate("district", "6", "7").alias("district"), "pincode",
                (key % 13 + key % 29).alias("bio_stress"),
            )
        )

    def demo(self) -> DataFrame:
        volume = F.floor("value") + F.col("event_id") % 7
        return (
            self.table("events")
            .join(self._customers(), F.col("user_id") == F.col("c_custkey"))
            .select(
                F.col("ts").cast("date").alias("date"), "state", "district", "pincode",
                volume.alias("update_volume"),
            )
        )

    # --- raw, text-typed feeds

    def _raw_keys(self) -> list[Column]:
        order, customer = F.col("o_orderkey"), F.col("c_custkey")
        date = (
            F.when(order % 97 == 0, F.lit("not a date"))
            .when(order % 89 == 0, F.col("date").cast("string"))
            .when(order % 83 == 0, F.date_format("date", "dd-MM-yy"))
            .when(order % 79 == 0, F.date_format("date", "d MMM yyyy"))
            .when(order % 73 == 0, F.date_format("date", "yyyy-MM-dd HH:mm:ss"))
            .when(order % 71 == 0, F.date_format("date", "d/MMMM/yy"))
            .otherwise(F.date_format("date", "dd-MM-yyyy"))
        )
        state = (
            F.when(customer % 5 == 0, F.lower("state"))
            .when(customer % 5 == 1, F.concat(F.lit(" "), "state", F.lit(" ")))
            .when(customer % 5 == 2, F.lit("jammu & kashmir"))
            .when(customer % 5 == 3, F.lit("o'brien-nagar y.s.r."))
            .otherwise(F.col("state"))
        )
        pin = F.when(customer % 11 == 0, F.lit("NA")).when(
            customer % 13 != 0, F.col("pincode").cast("string")
        )
        return [
            date.alias("date"), state.alias("state"),
            F.lower("segment").alias("district"), pin.alias("pincode"),
        ]

    def raw_enrol(self) -> DataFrame:
        order, line = F.col("l_orderkey"), F.col("l_linenumber")
        return (
            self._lines(self._customers())
            .select(
                *self._raw_keys(),
                F.when(line != 7, line).alias("age_0_5"),
                (order % 5).cast("int").alias("age_5_17"),
                F.when(order % 17 != 0, F.col("quantity")).alias("age_18_greater"),
            )
        )

    def raw_bio(self) -> DataFrame:
        key = F.col("o_orderkey")
        return (
            self._orders(self._customers())
            .select(
                *self._raw_keys(),
                F.when(key % 31 != 0, key % 13).alias("bio_age_5_17"),
                F.when(key % 37 != 0, key % 29).alias("bio_age_17_"),
            )
        )

    def raw_demo(self) -> DataFrame:
        key = F.col("event_id")
        return (
            self.table("events")
            .select("event_id", "user_id", "value", F.col("ts").cast("date").alias("date"),
                    F.col("event_id").alias("o_orderkey"))
            .join(self._customers(), F.col("user_id") == F.col("c_custkey"))
            .select(
                *self._raw_keys(),
                F.when(key % 19 != 0, F.floor("value")).alias("demo_age_5_17"),
                F.when(key % 23 != 0, key % 7).alias("demo_age_17_"),
            )
        )

    # --- misspelled names

    def _dirty_names(self) -> DataFrame:
        """Per customer: a state and a district derived from an official name, some misspelled."""
        k, name = F.col("c_custkey"), F.col("nm")
        state = (
            F.when(k % 50 == 0, F.expr("substr(nm, 1, length(nm) - 1)"))
            .when(k % 50 == 1, F.lower(name))
            .when(k % 50 == 2, F.concat(F.lit("  "), F.upper(name), F.lit(" ")))
            .when(k % 50 == 3, F.replace(name, F.lit(" & "), F.lit(" And ")))
            .when(k % 50 == 4, F.concat(name, F.lit("x")))
            .otherwise(name)
        )
        district = (
            F.when(k % 50 == 5, F.concat(name, F.lit("h")))
            .when(k % 50 == 6, F.concat(F.substring(name, 1, 3), F.substring(name, 5, 40)))
            .when(k % 50 == 7, F.concat(F.substring(name, 1, 4), F.substring(name, 4, 40)))
            .otherwise(name)
        )
        apart = (k % 100 >= 55) & (k % 50).isin(5, 6, 7)
        pin = F.when(apart, F.lit(900000) + k % 37).otherwise(F.lit(500000) + (k % 37) * 10 + k % 3)
        official = official_states(self.spark).select("position", F.col("state").alias("nm"))
        return (
            self.table("customer").select("c_custkey")
            .join(official, F.col("position") == k % 37)
            .select("c_custkey", state.alias("state"), district.alias("district"),
                    pin.cast("int").alias("pincode"))
        )

    def dirty_enrol(self) -> DataFrame:
        return (
            self._lines(self._dirty_names())
            .select("date", "state", "district", "pincode", F.col("quantity").alias("adult_enrolments"))
        )

    # --- governance logs: one event per row of `events`

    def _log(self, scope: Column, action: Column, original: Column, target: Column,
             rows: DataFrame) -> DataFrame:
        def log_id(n):
            return F.concat(F.lit("g"), F.lpad(n.cast("string"), 12, "0"))

        event = F.col("event_id")
        revert = F.col("event_type") == "signup"
        merge = action == "Merge"
        return rows.select(
            log_id(event).alias("id"),
            F.col("ts"),
            scope.alias("scope"),
            F.when(revert, "Revert").otherwise(action).alias("action"),
            original.alias("original"),
            F.when(revert, log_id(F.greatest(event - 3, F.lit(0))))
            .when(merge, target).otherwise(F.lit("N/A")).alias("target"),
            F.concat(F.lit("Admin_"), F.lpad((F.col("user_id") % 5).cast("string"), 2, "0")).alias("user"),
        )

    def governance_log(self) -> DataFrame:
        """Merges, deletions and reverts of names that occur in the feeds (and some that don't)."""
        user, event = F.col("user_id"), F.col("event_id")
        rows = self.table("events").join(self._customers(), user == F.col("c_custkey"))
        is_state = event % 2 == 0
        delete = F.col("event_type") == "error"
        scope = F.when(is_state, "State").otherwise("District")
        action = F.when(delete, "Delete").otherwise("Merge")
        original = (
            F.when(is_state & delete, F.concat(F.lit("NATION_"), (user % 50 + 20).cast("string")))
            .when(is_state, F.concat(F.lit("NATION_"), (user % 25).cast("string")))
            .when(delete, F.concat_ws(" ", "segment", (user % 7 + 5).cast("string")))
            .otherwise(F.concat_ws(" ", "segment", (user % 7).cast("string")))
        )
        target = F.when(
            is_state, F.concat(F.lit("NATION_"), ((user + event) % 25).cast("string"))
        ).otherwise(F.concat(F.lit("HOUSEHOLD "), (event % 7).cast("string")))
        return self._log(scope, action, original, target, rows)

    def dirty_log(self) -> DataFrame:
        """Decisions already taken on the misspelled names."""
        rows = self.table("events").join(self._dirty_names(), F.col("user_id") == F.col("c_custkey"))
        is_state = F.col("event_id") % 2 == 0
        scope = F.when(is_state, "State").otherwise("District")
        action = F.when(F.col("event_type") == "error", "Delete").otherwise("Merge")
        original = F.when(is_state, F.col("state")).otherwise(F.col("district"))
        return self._log(scope, action, original, F.lit("Goa"), rows)
