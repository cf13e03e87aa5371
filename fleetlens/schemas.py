"""Explicit schemas of every external format. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, D, I, B = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# fixed values: feed fields, in feed order
VEHICLE = _struct(
    id=S, label=S, license_plate=S, route_id=S, trip_id=S, direction_id=I, start_date=S, start_time=S,
    lat=D, lon=D, speed=D, odo=L, stop_id=S, seq=I, status=I, ts=L,
)
VEHICLE_FIELDS = VEHICLE.fieldNames()
# fixed values: fields that may change inside an update
DYNAMIC_FIELDS = [
    "lat", "lon", "speed", "odo", "stop_id", "seq", "status", "trip_id", "route_id", "direction_id", "start_time",
]

FRAME = T.StructType(
    [
        T.StructField("t", L),
        T.StructField("keyframe", B),
        T.StructField("gap", B),
        T.StructField("gap_seconds", L),
        T.StructField("reason", S),
        T.StructField("part", I),
        T.StructField("new", T.ArrayType(VEHICLE)),
        T.StructField("del", T.ArrayType(S)),
        T.StructField("upd", T.ArrayType(VEHICLE)),
    ]
)

STOP = _struct(id=S, name=S, lat=D, lng=D)
POINT = _struct(lat=D, lon=D)
BRANCH_JSON = T.StructType(
    [
        T.StructField("name", S),
        T.StructField("shortName", S),
        T.StructField("shapeId", S),
        T.StructField("direction", I),
        T.StructField("points", T.ArrayType(T.ArrayType(D))),
        T.StructField("stops", T.ArrayType(STOP)),
    ]
)
SHAPES_JSON = T.MapType(
    S, T.StructType([T.StructField("color", S), T.StructField("ramales", T.ArrayType(BRANCH_JSON))])
)
LABEL_MAP_JSON = T.StructType([T.StructField("map", T.MapType(S, _struct(line=S, agencyName=S)))])
BRANCH_MAP_ENTRY = _struct(
    route_id=S, direction_id=I, first_seen=S, last_seen=S, status=S, assignment_status=S, shape_key=S,
    short_name=S, shape_id=S, name=S, confidence=D, method=S, assignment_type=S,
)
BRANCH_MAP_JSON = T.StructType(
    [
        T.StructField(
            "lines", T.MapType(S, T.StructType([T.StructField("entries", T.ArrayType(BRANCH_MAP_ENTRY))]))
        )
    ]
)
FAMILIES_JSON = T.StructType(
    [T.StructField("line", S), T.StructField("description", S), T.StructField("families", T.MapType(S, T.ArrayType(S)))]
)
RUN_METRICS_JSON = T.StructType(
    [
        T.StructField("model", S),
        T.StructField("best_epoch", I),
        T.StructField("val_mae_s", D),
        T.StructField("training_time_s", D),
        T.StructField(
            "history",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("epoch", I),
                        T.StructField("train_mae_s", D),
                        T.StructField("val_mae_s", D),
                        T.StructField("lr", D),
                    ]
                )
            ),
        ),
    ]
)

# fixed values: column order and types of the training table
TRAINING_COLUMNS = [
    ("ramal_id", "string"),
    ("seg_idx", "int"),
    ("dist_remaining_m", "float"),
    ("dist_along_norm", "float"),
    ("speed_mps", "float"),
    ("hour_sin", "float"),
    ("hour_cos", "float"),
    ("dow", "tinyint"),
    ("has_active_bus", "boolean"),
    ("observed_eta_s", "float"),
    ("time_since_start", "float"),
    ("ts_age_s", "float"),
    ("traj_flat", "array<float>"),
    ("traj_len", "tinyint"),
    ("fleet_flat", "array<float>"),
    ("n_fleet", "tinyint"),
    ("time_since_last_bus_s", "float"),
    ("last_bus_found", "boolean"),
]

GTFS = {
    "routes": "route_id string, agency_id string, route_short_name string, route_color string",
    "trips": "route_id string, trip_id string, trip_headsign string, direction_id int, shape_id string",
    "shapes": "shape_id string, shape_pt_lat double, shape_pt_lon double, shape_pt_sequence int",
    "stop_times": "trip_id string, stop_id string, stop_sequence int",
    "stops": "stop_id string, stop_name string, stop_lat double, stop_lon double",
}
