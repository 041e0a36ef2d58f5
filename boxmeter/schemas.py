"""Enumerations and record schemas of the data model."""

from pyspark.sql import types as T

# fixed values
DAMAGE_TYPES = ["glass_shatter", "lamp_broken", "crack", "scratch"]
PARTS = ["bumper", "door", "light", "window", "windshield", "hood", "fender", "mirror", "wheel", "other"]
SEVERITIES = ["minor", "moderate", "severe"]
ACTIONS = ["repair", "replacement"]
GENERAL_DAMAGE_TYPES = ["glass_shatter", "lamp_broken", "crack", "scratch", "dent", "paint_chip", "rust", "broken_part"]
GENERAL_PARTS = ["bumper", "door", "light", "window", "windshield", "hood", "fender", "mirror", "wheel", "other", "trunk", "roof", "grille", "sill"]
SHEET_COLUMNS = ["image_id", "file_name", "annotation_id", "damage_type", "bbox_x", "bbox_y", "bbox_w", "bbox_h", "part", "severity", "action", "comment"]
CALIBRATION_BINS = [(0.0, 0.5), (0.5, 0.7), (0.7, 0.9), (0.9, 1.0)]
THRESHOLDS = [0.0, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]

LABEL_FIELDS = {"part": PARTS, "severity": SEVERITIES, "action": ACTIONS}
ENUMS = {"damage_type": DAMAGE_TYPES, **LABEL_FIELDS}

DAMAGE = T.StructType(
    [
        T.StructField("damage_type", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("description", T.StringType()),
        T.StructField("bounding_box", T.ArrayType(T.DoubleType())),
    ]
)
ASSESSMENT = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("damages", T.ArrayType(DAMAGE)),
        T.StructField("overall_score", T.DoubleType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("vehicle_visible", T.BooleanType()),
    ]
)
#: meta values may be nested, so they are read as text; predictions have data as keys.
PREDICTIONS = T.StructType(
    [
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField("predictions", T.MapType(T.StringType(), ASSESSMENT)),
    ]
)
GT_DAMAGE = T.StructType(
    [
        T.StructField("annotation_id", T.LongType()),
        T.StructField("bbox", T.ArrayType(T.DoubleType())),
        T.StructField("damage_type", T.StringType()),
        T.StructField("part", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("action", T.StringType()),
    ]
)
GROUND_TRUTH = T.StructType(
    [
        T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
        T.StructField(
            "images",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("image_id", T.StringType()),
                        T.StructField("file_name", T.StringType()),
                        T.StructField("width", T.IntegerType()),
                        T.StructField("height", T.IntegerType()),
                        T.StructField("damages", T.ArrayType(GT_DAMAGE)),
                    ]
                )
            ),
        ),
    ]
)
EXAMPLE = T.StructType(
    [
        T.StructField("image_id", T.LongType()),
        T.StructField("file_name", T.StringType()),
        T.StructField("class_selected_for", T.StringType()),
    ]
)
SHEET = T.StructType([T.StructField(c, T.StringType()) for c in SHEET_COLUMNS])
