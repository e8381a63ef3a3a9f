"""Rows and values the tests share: fingerprints of a freight network, one of whose transport modes is renamed."""

from datetime import datetime

DATA = "/root/testdata/sf0.001"

COLUMN = (
    "struct<position:int,name:string,data_type:string,kind:string,null_pct:double,distinct_count:bigint,"
    "top_values:array<struct<value:string,cnt:bigint,pct:double>>,min_val:double,max_val:double,mean:double,"
    "stddev:double,p1:double,p25:double,p50:double,p75:double,p99:double,distribution:map<string,double>,entropy:double>"
)
FINGERPRINT = (
    "fingerprint_id string, computed_at timestamp_ntz, is_synthetic boolean, connection_id string, project_id string, "
    f"dataset_id string, table_name string, row_count bigint, schema_hash string, columns array<{COLUMN}>"
)


def column(position, name, dist=None, mean=None, stddev=None, null_pct=0.0, data_type=None):
    kind = "categorical" if dist is not None else "numeric"
    return (
        position, name, data_type or ("string" if dist is not None else "double"), kind, null_pct, 10, [],
        None, None, mean, stddev, None, None, None, None, None, dist or {}, None,
    )


def fingerprint(fid, table, day, rows, columns, synthetic=False, dataset="crm"):
    at = day if isinstance(day, datetime) else datetime(2026, 5, day)
    return (fid, at, synthetic, "c", "p", dataset, table, rows, "h", columns)


def frame(spark, rows):
    return spark.createDataFrame(rows, FINGERPRINT)


# A freight network: depots by transport mode, parcels by zone. One mode is renamed at the source.
MODES = {"barge": 0.31, "rail": 0.24, "road": 0.21, "air": 0.14, "pipe": 0.10}
ZONES = {"north": 0.44, "delta": 0.33, "hills": 0.23}
DEPOT_ROWS = [240, 252, 247, 260, 255, 249]
PARCEL_ROWS = [9100, 9350, 9040, 9275, 9420, 9190]


def renamed(shares, old, new):
    return {(new if k == old else k): v for k, v in shares.items()}


MODES_AFTER = renamed(MODES, "rail", "railway")


def depot_columns(modes):
    return [
        column(0, "floor_area", mean=1820.5, stddev=410.25),
        column(1, "mode", modes),
        column(2, "heated", {"true": 0.625, "false": 0.375}, data_type="boolean"),
    ]


def parcel_columns():
    return [column(0, "zone", ZONES), column(1, "weight", mean=12.75, stddev=6.5), column(2, "fragile", {"no": 0.9, "yes": 0.1})]
