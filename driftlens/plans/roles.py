"""The roles the star-schema tables play: sync histories, fact and dimension, dependency graphs, event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators.profile import Load, fingerprint_loads
from ..operators.selection import relabel
from ..sources import history as H
from ..sources.tables import read_table
from ..staging import deal

AS_OF = "2024-02-01 00:00:00"
TIME_COLUMNS = {"events": "ts", "orders": "o_orderdate", "lineitem": "l_shipdate"}
DETECTION_SECONDS = 42
OPEN_FROM = "2000-01-01 00:00:00"
RENAMED_REGION = ("EUROPE", "EUROPE AND UK")
RENAMED_SEGMENT = ("BUILDING", "CONSTRUCTION")
RENAMED_PRIORITY = ("2-HIGH", "2-UPPER")
MERGED_PRIORITY = ("5-LOW", "4-NOT SPECIFIED")
BASELINE_OFFSETS = [14, 10, 7, 4, 1]


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def day_text(column: str = "computed_at") -> Column:
    return F.col(column).cast("date").cast("string")


def micros_of(column: str) -> Column:
    """Microseconds of a moment since 1970, read off its wall clock."""
    return F.timestamp_diff("MICROSECOND", moment("1970-01-01 00:00:00"), F.col(column).cast("timestamp_ntz"))


SILENT_SECONDS = 172_800


# sync histories


def events_by_day(spark: SparkSession, folder: str) -> Load:
    """Events are loaded daily; the payload is a text column with many more than twenty values."""
    df = read_table(spark, folder, "events")
    day = F.col("ts").cast("date").cast("timestamp_ntz")
    chosen = ["event_type", "value", "user_id", "props"]
    return Load(df, "app", "events", day, profile_columns=chosen)


def orders_by_month(spark: SparkSession, folder: str) -> Load:
    month = F.trunc(F.col("o_orderdate").cast("date"), "month").cast("timestamp_ntz")
    chosen = ["o_orderstatus", "o_orderpriority", "o_totalprice"]
    return Load(read_table(spark, folder, "orders"), "sales", "orders", month, profile_columns=chosen)


def lineitem_by_month(spark: SparkSession, folder: str) -> Load:
    month = F.trunc(F.col("l_shipdate").cast("date"), "month").cast("timestamp_ntz")
    chosen = ["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return Load(read_table(spark, folder, "lineitem"), "sales", "lineitem", month, profile_columns=chosen)


def documents_by_source(spark: SparkSession, folder: str) -> Load:
    """Sources stand for loads: source n is the load of day n. Unlabelled documents give the nulls."""
    docs = read_table(spark, folder, "documents")
    labels = read_table(spark, folder, "labels")
    joined = docs.join(labels, "doc_id", "left")
    number = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    load = F.date_add(F.lit("2024-01-01").cast("date"), number).cast("timestamp_ntz")
    return Load(
        joined,
        "corpus",
        "documents",
        load,
        profile_columns=["lang", "n_chars", "quality", "toxic"],
    )


def customer_regions(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with the id of their region: the fact side of the region labels."""
    customer = read_table(spark, folder, "customer").select("c_nationkey", "c_acctbal")
    nation = read_table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_regionkey").cast("string").alias("region_id")
    )
    return customer.join(nation, "c_nationkey").select("region_id", "c_acctbal")


def rename_loads(spark: SparkSession, folder: str) -> tuple[list[Load], list[Load]]:
    """(after, before): a region label and a market segment are renamed, their neighbours stay as they were."""
    region = read_table(spark, folder, "region").select("r_name")
    segments = read_table(spark, folder, "customer").select("c_mktsegment", "c_acctbal")
    balances = read_table(spark, folder, "supplier").select("s_acctbal")
    regions_used = customer_regions(spark, folder)
    priorities = read_table(spark, folder, "orders").select("o_orderpriority")
    now = moment(AS_OF)

    def load(df, dataset, table):
        return Load(df, dataset, table, now, per_sync=False)

    unchanged = [load(regions_used, "crm", "customer_region"), load(balances, "market", "supplier")]
    before = [load(region, "crm", "region"), load(segments, "market", "customer"), load(priorities, "shop", "orders")]
    after = [
        load(relabel(region, "r_name", *RENAMED_REGION), "crm", "region"),
        load(relabel(segments, "c_mktsegment", *RENAMED_SEGMENT), "market", "customer"),
        # one value is renamed, another vanishes into a third at the same time
        load(
            relabel(relabel(priorities, "o_orderpriority", *MERGED_PRIORITY), "o_orderpriority", *RENAMED_PRIORITY),
            "shop",
            "orders",
        ),
    ]
    return after + unchanged, before + unchanged


def rename_scenario(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(current, history) fingerprints of the renames."""
    after, before = rename_loads(spark, folder)
    return fingerprint_loads(after), H.replicate(fingerprint_loads(before), BASELINE_OFFSETS, moment(AS_OF))


def all_of(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# fact and dimension of the KPIs


def facts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with the region of their customer as stage; cancelled work is unknown rather than false."""
    orders = read_table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_totalprice", "o_orderdate", "o_orderstatus", "o_orderkey"
    )
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nation = read_table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return (
        orders.join(customer, "c_custkey")
        .join(nation, "c_nationkey")
        .select(
            F.col("o_orderkey").alias("deal_id"),
            F.col("n_regionkey").alias("stage_id"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
            F.col("o_orderdate").alias("close_date"),
            F.when(F.col("o_orderstatus") == "P", F.lit(None).cast("boolean"))
            .otherwise(F.col("o_orderstatus") == "F")
            .alias("is_deleted"),
        )
    )


def stages(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "region").select(
        F.col("r_regionkey").alias("stage_id"), F.col("r_name").alias("label")
    )


# dependency graphs


def _id(kind: str, *columns: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.concat_ws("-", *[F.col(c).cast("string") for c in columns]))


def key_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Node table of the key graph region, nation, customer and supplier, order, line item."""
    none = F.lit(None).cast("string")

    def nodes(df, uid, name, resource_type, upstream, raw=none, owner=none, email=none):
        return df.select(
            uid.alias("uid"),
            F.struct(F.lit(0).alias("rank"), uid.alias("key")).alias("position"),
            name.alias("name"),
            F.lit(resource_type).alias("resource_type"),
            F.lit("warehouse").alias("source_name"),
            owner.alias("owner_name"),
            email.alias("owner_email"),
            raw.alias("raw_code"),
            none.alias("raw_sql"),
            none.alias("compiled_code"),
            none.alias("original_file_path"),
            none.alias("path"),
            F.array(*upstream).cast("array<string>").alias("depends_on"),
        )

    region = read_table(spark, folder, "region")
    nation = read_table(spark, folder, "nation")
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    supplier = read_table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    items = read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_returnflag"
    )
    # a line item has no key of its own: the shipments of an order by one supplier are one node
    shipments = items.groupBy("l_orderkey", "l_suppkey").agg(F.max("l_returnflag").alias("flag"))
    return all_of(
        [
            nodes(region, _id("region", "r_regionkey"), F.col("r_name"), "source", []),
            nodes(
                nation,
                _id("nation", "n_nationkey"),
                F.col("n_name"),
                "model",
                [_id("region", "n_regionkey")],
                raw=F.concat(F.lit("select * from region where r_name is not null -- "), F.col("n_name")),
            ),
            nodes(
                customer,
                _id("customer", "c_custkey"),
                F.concat(F.lit("segment "), F.col("c_mktsegment")),
                "model",
                [_id("nation", "c_nationkey")],
                raw=F.concat(F.lit("select * from nation where segment = '"), F.col("c_mktsegment"), F.lit("'")),
            ),
            nodes(supplier, _id("supplier", "s_suppkey"), _id("supplier", "s_suppkey"), "model", [_id("nation", "s_nationkey")]),
            nodes(orders, _id("order", "o_orderkey"), F.col("o_orderpriority"), "model", [_id("customer", "o_custkey")]),
            nodes(
                shipments,
                _id("shipment", "l_orderkey", "l_suppkey"),
                F.col("flag"),
                "exposure",
                [_id("order", "l_orderkey"), _id("supplier", "l_suppkey"), F.lit("unknown:0")],
                owner=F.when(F.col("flag") == "R", "returns desk").when(F.col("flag") == "A", "").otherwise(none),
                email=F.when(F.col("flag") != "N", "desk@example.com").otherwise(none),
            ),
        ]
    )


def region_starts(spark: SparkSession, folder: str) -> DataFrame:
    """Every region as the source of an incident on its label."""
    return read_table(spark, folder, "region").select(
        F.col("r_name").alias("source_table"), F.lit("r_name").alias("changed_column")
    )


def customer_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One manifest document per customer: two sources, a model with a literal filter, and a dashboard."""
    customer = read_table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    nation = read_table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    region = read_table(spark, folder, "region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
    # a small file is one task, but a document is many times its row
    rows = deal(customer.join(nation, "c_nationkey").join(region, "n_regionkey"), "c_custkey")
    sql = F.format_string(
        "select c.c_custkey from customer c join region r on r.r_regionkey = c.region "
        "where r.r_name = '%s' and c.c_mktsegment = '%s'",
        F.col("r_name"),
        F.col("c_mktsegment"),
    )

    def source(name):
        return F.struct(
            F.lit(name).alias("name"), F.lit("source").alias("resource_type"), F.lit("crm").alias("source_name")
        )

    def upstream(*uids):
        return F.struct(F.array(*uids).alias("nodes"))

    key = F.col("c_custkey").cast("string")
    model_uid = F.concat(F.lit("model.crm."), key)
    document = F.struct(
        F.create_map(
            model_uid,
            F.struct(
                F.concat(F.lit("active_"), key).alias("name"),
                F.lit("model").alias("resource_type"),
                F.concat(F.lit("models/active_"), key, F.lit(".sql")).alias("original_file_path"),
                sql.alias("raw_code"),
                upstream(F.lit("source.crm.region"), F.lit("source.crm.customer")).alias("depends_on"),
            ),
        ).alias("nodes"),
        F.create_map(
            F.lit("source.crm.region"), source("region"), F.lit("source.crm.customer"), source("customer")
        ).alias("sources"),
        F.create_map(
            F.concat(F.lit("exposure.crm."), key),
            F.struct(
                F.concat(F.lit("board_"), key).alias("name"),
                F.lit("exposure").alias("resource_type"),
                F.struct(F.col("c_name").alias("name"), F.lit("board@example.com").alias("email")).alias("owner"),
                upstream(model_uid, F.lit("model.crm.unknown")).alias("depends_on"),
            ),
        ).alias("exposures"),
    )
    return rows.select(key.alias("graph"), F.to_json(document).alias("value"))


def renaming_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """One manifest document per customer, whose three models carry the region's name on under other names."""
    customer = read_table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nation = read_table(spark, folder, "nation").select("n_nationkey", F.col("n_regionkey").alias("r_regionkey"))
    region = read_table(spark, folder, "region").select("r_regionkey", "r_name")
    rows = deal(customer.join(nation, "n_nationkey").join(region, "r_regionkey"), "c_custkey")
    key = F.col("c_custkey").cast("string")

    def model(name, sql, upstream):
        return F.struct(
            F.concat(F.lit(f"{name}_"), key).alias("name"),
            F.lit("model").alias("resource_type"),
            F.concat(F.lit(f"models/{name}_"), key, F.lit(".sql")).alias("original_file_path"),
            sql.alias("raw_code"),
            F.struct(F.array(upstream).alias("nodes")).alias("depends_on"),
        )

    def uid(name):
        return F.concat(F.lit(f"model.crm.{name}_"), key)

    base = F.lit("select g.r_regionkey, g.r_name as area from crm.region g -- g.r_name = 'EUROPE'")
    middle = F.format_string(
        "with t as (select * from {{ ref('base_%s') }}) select t.area zone, upper(t.area) as loud from t", key
    )
    last = F.format_string(
        "select count(*) n from {{ ref('middle_%s') }} v where v.zone in ('none', '%s') or '%s' = ZONE or loud = '%s'",
        key, "r_name", "r_name", "r_name",
    )
    source = F.struct(
        F.lit("region").alias("name"), F.lit("source").alias("resource_type"), F.lit("crm").alias("source_name")
    )
    document = F.struct(
        F.create_map(
            uid("base"), model("base", base, F.lit("source.crm.region")),
            uid("middle"), model("middle", middle, uid("base")),
            uid("last"), model("last", last, uid("middle")),
        ).alias("nodes"),
        F.create_map(F.lit("source.crm.region"), source).alias("sources"),
    )
    return rows.select(key.alias("graph"), F.to_json(document).alias("value"))


# event logs


def incident_events(spark: SparkSession, folder: str) -> DataFrame:
    return incident_events_of(read_table(spark, folder, "events"))


def incident_events_of(events: DataFrame) -> DataFrame:
    """Three events in a row belong to one incident; the event type is the action taken."""
    action = (
        F.when(F.col("event_type") == "purchase", "approve")
        .when(F.col("event_type") == "error", "dismiss")
        .when(F.col("event_type") == "click", "reenable")
        .when(F.col("event_type") == "signup", "investigate")
        .otherwise(F.col("event_type"))
    )
    return events.select(
        F.expr("concat('r', event_id div 3)").alias("report_id"),
        F.col("ts").alias("at"),
        F.col("event_id").alias("seq"),
        action.alias("action"),
    )


def opened_incidents(spark: SparkSession, folder: str) -> DataFrame:
    """An incident opens with its first cheap event; those without one never open."""
    return (
        read_table(spark, folder, "events")
        .where(F.col("value") < 60)
        .groupBy(F.expr("concat('r', event_id div 3)").alias("report_id"))
        .agg(F.min("ts").alias("opened_at"))
    )


def merge_states(spark: SparkSession, folder: str) -> DataFrame:
    """Fix of an incident: the dearest of its events, merged when dear enough."""
    best = (
        read_table(spark, folder, "events")
        .where(F.col("value") > 20)
        .groupBy(F.expr("concat('r', event_id div 3)").alias("report_id"))
        .agg(F.max_by(F.struct("event_id", "value", "ts"), F.struct("value", "event_id")).alias("e"))
    )
    merged = F.col("e.value") > 60
    return best.select(
        "report_id",
        F.col("e.event_id").alias("pr_number"),
        F.when(merged, "closed").otherwise("open").alias("pr_state"),
        merged.alias("merged"),
        F.when(merged, F.col("e.ts")).alias("merged_at"),
        F.concat(F.lit("https://example.com/pr/"), F.col("e.event_id").cast("string")).alias("pr_url"),
    )


def polls(spark: SparkSession, folder: str) -> DataFrame:
    return polls_of(read_table(spark, folder, "events"))


def polls_of(events: DataFrame) -> DataFrame:
    """Every event is a poll of the user's connector; the load time it shows is the day, sometimes empty."""
    return events.select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("connector_id"),
        F.col("ts").alias("polled_at"),
        F.col("event_id").alias("seq"),
        F.when(F.col("value") < 5, F.lit(""))
        .when(F.col("value") >= 10, day_text("ts"))
        .alias("succeeded_at"),
    )


def raw_sync_events(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "events").select(
        F.when(F.col("event_type") == "signup", "sync_end").otherwise(F.col("event_type")).alias("event"),
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("connector_id"),
        F.when(F.col("value") > 30, "app").alias("schema"),
        F.when(F.col("value") > 10, F.col("event_type")).alias("table"),
        F.col("ts").alias("received_at"),
    )


def connector_configs(spark: SparkSession, folder: str) -> DataFrame:
    """One configuration document per order: its status is the schema, its priority the table."""
    enabled = F.when(F.col("o_totalprice") > 400000, '{"enabled":true}').when(
        F.col("o_totalprice") > 200000, '{"enabled":false}'
    ).otherwise("{}")
    document = F.format_string(
        '{"data":{"schemas":{"%s":{"tables":{"%s":%s,"note":"text"}},"comment":7}}}',
        F.col("o_orderstatus"),
        F.col("o_orderpriority"),
        enabled,
    )
    return read_table(spark, folder, "orders").select(F.col("o_custkey").alias("connector_id"), document.alias("config"))


def configured_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Configured tables per connector, merged over its documents."""
    from ..sources.connectors import connector_tables

    return (
        connector_tables(connector_configs(spark, folder))
        .groupBy("connector_id", "schema_name", "table_name")
        .agg(F.bool_or("enabled").alias("enabled"))
    )


SCHEMA_ORDER = ("P", "F", "O")


def ordered_configs(spark: SparkSession, folder: str) -> DataFrame:
    """One configuration document per customer with several schemas, in an order that is not the alphabet's."""
    entry = F.transform(F.array_sort(F.collect_set("o_orderpriority")), lambda p: F.format_string('"%s":{"enabled":true}', p))
    schemas = read_table(spark, folder, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.concat_ws(",", entry).alias("tables"))
    part = F.format_string('"%s":{"tables":{%s}}', F.col("o_orderstatus"), F.col("tables"))
    documents = schemas.groupBy("o_custkey").agg(*[F.max(F.when(F.col("o_orderstatus") == s, part)).alias(s) for s in SCHEMA_ORDER])
    return documents.select(
        F.col("o_custkey").alias("connector_id"),
        F.format_string('{"data":{"schemas":{%s}}}', F.concat_ws(",", *SCHEMA_ORDER)).alias("config"),
    )


def watch_document(columns: DataFrame) -> DataFrame:
    """A watch list over a catalog: every table's own columns of text, and one that no table has."""
    text = F.array_sort(F.collect_list(F.when(F.col("data_type") == "string", F.col("column_name"))))
    entries = columns.groupBy("dataset_id", "table_name").agg(F.concat(text, F.array(F.lit("region_code"))).alias("profile_columns"))
    entry = F.struct(
        F.col("dataset_id").alias("dataset"), F.col("table_name").alias("table"), F.lit("high").alias("priority"), "profile_columns"
    )
    return entries.agg(F.to_json(F.struct(F.collect_list(entry).alias("watched_tables"))).alias("value"))


COVERED_DATASET = "F"
COVERED = (("F", "1-URGENT"), ("F", "3-MEDIUM"), ("O", "2-HIGH"), ("O", "3-MEDIUM"), ("P", "5-LOW"))


def baseline_loads(spark: SparkSession, folder: str) -> list[Load]:
    """Orders as many tables: the status is the dataset, the priority the table. Some of them have a past."""
    orders = read_table(spark, folder, "orders")
    year = F.trunc(F.col("o_orderdate").cast("date"), "year").cast("timestamp_ntz")
    return [
        Load(orders.where((F.col("o_orderstatus") == dataset) & (F.col("o_orderpriority") == table)), dataset, table, year, with_columns=False)
        for dataset, table in COVERED
    ]


def with_exact(weeks: DataFrame, rows: DataFrame) -> DataFrame:
    """Weekly estimates with the exact distinct count, and whether every estimate is within its bound.

    Values are counted by (week, column, value) with map-side sums, so that neither a week nor a value is one task's work.
    """
    columns = [c for c in rows.columns if c != "week"]
    cells = rows.select("week", *[F.col(c).cast("string").alias(c) for c in columns]).unpivot(["week"], columns, "name", "value")
    numbers = [c for c, kind in rows.dtypes if kind not in ("string", "timestamp_ntz")]
    counted = cells.groupBy("week", "name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    known = weeks.select(
        "week", "name", "row_count", "filled_count", "rank_bound", "count_bound",
        F.coalesce("quantiles", F.array().cast("array<double>")).alias("quantiles"),
        F.map_from_entries(F.coalesce("top_values", F.array().cast("array<struct<value:string,cnt:bigint>>"))).alias("top"),
    )
    met = counted.join(F.broadcast(known), ["week", "name"])  # a few rows a week
    x = F.when(F.col("name").isin(numbers), F.col("value").cast("double"))
    below = [F.sum(F.when(x < F.get("quantiles", F.lit(i)), F.col("cnt")).otherwise(0)).alias(f"below{i}") for i in range(5)]
    upto = [F.sum(F.when(x <= F.get("quantiles", F.lit(i)), F.col("cnt")).otherwise(0)).alias(f"upto{i}") for i in range(5)]
    listed = F.col("top")[F.coalesce("value", F.lit(K.NULL_KEY))]
    exact = met.groupBy("week", "name").agg(
        F.count("value").alias("exact_distinct"), *below, *upto,
        F.count(listed).alias("listed"),
        F.bool_and(F.coalesce(F.abs(listed - F.col("cnt")) <= F.col("count_bound"), F.lit(True))).alias("counts_within"),
    )
    out = weeks.join(exact, ["week", "name"])
    near = F.lit(True)
    for i, percent in enumerate(K.QUANTILE_PERCENTS):
        low, high = F.col(f"below{i}") / F.col("filled_count"), F.col(f"upto{i}") / F.col("filled_count")
        near = near & (low <= percent / 100 + F.col("rank_bound")) & (high >= percent / 100 - F.col("rank_bound"))
    return out.select(
        "*",
        (F.abs(F.col("distinct_count") - F.col("exact_distinct")) <= F.col("distinct_bound")).alias("distinct_within"),
        F.when(F.col("quantiles").isNotNull(), near).otherwise(True).alias("quantiles_within"),
        (F.col("counts_within") & (F.col("listed") == F.coalesce(F.size("top_values"), F.lit(0)))).alias("top_within"),
    ).drop("distinct_count")
