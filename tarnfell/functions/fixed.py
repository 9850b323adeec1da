"""Fixed values. They are part of the data contract and must not change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Coordinates.
COORD_SCALE = 100_000
WEB_MERCATOR_SPAN = 20037508.342789244
LATITUDE_LIMIT_APP = 85.0511
LATITUDE_LIMIT_SCRIPTS = 85.05112878
TILE_SIZE = 256
GRID_RES = 10.0
GRID_ORIGIN_X = 0.0
GRID_ORIGIN_Y = 8_000_000.0
HEIGHT_OFFSET = 32768
METRES_PER_DEGREE_EQUATOR = 111_319.5

# Place kinds, in id order.
KINDS = ["settlement", "terrain", "water", "watercourse", "wetland",
         "glacier", "nature", "cultural", "infrastructure", "other"]
SWEDEN, NORWAY = 0, 1
ALIAS_OFFSET = 1_000_000_000

# Type codes of the first register.
FIRST_REGISTER_KIND = {
    "BEBTÄTTX": "settlement", "BEBTX": "settlement", "TERRTX": "terrain", "VATTTX": "water",
    "VATTDELTX": "water", "VATTDRTX": "watercourse", "SANKTX": "wetland", "GLACIÄRTX": "glacier",
    "NATTX": "nature", "KULTURTX": "cultural", "KYRKATX": "cultural", "ANLTX": "infrastructure",
}
FIRST_REGISTER_SKIP = ["TRAKTTX"]
FIRST_REGISTER_RANK = {"BEBTÄTTX": 0, "KYRKATX": 5}
FIRST_REGISTER_DEFAULT_RANK = 3
FIRST_REGISTER_LANGUAGE = {
    "SV": "sv", "FI": "fi", "TF": "fit", "NS": "se", "LS": "smj", "US": "sju", "SS": "sma",
}

# Groups of the second register.
SECOND_REGISTER_GROUP_KIND = {
    "bebyggelse": "settlement", "terreng": "terrain", "ferskvann": "water",
    "sjø": "water", "markslag": "nature", "kultur": "cultural",
}
SECOND_REGISTER_SUBGROUP_KIND = {
    "rennendeVann": "watercourse", "våtmark": "wetland", "isOgPermafrost": "glacier",
    "verne-OgBruksområder": "nature", "bartFjell": "terrain", "løsmasseavsetninger": "terrain",
}
SECOND_REGISTER_SKIP_GROUPS = ["infrastruktur", "offentligAdministrasjon"]
SECOND_REGISTER_LANGUAGE = {
    "norsk": "no", "nordsamisk": "se", "lulesamisk": "smj", "sørsamisk": "sma",
    "skoltesamisk": "sms", "pitesamisk": "sje", "umesamisk": "sju", "kvensk": "fkv",
    "engelsk": "en", "svensk": "sv", "finsk": "fi", "russisk": "ru",
}
SPELLING_RANK = {"vedtatt": 0, "vedtattNavneledd": 1, "godkjent": 2,
                 "internasjonal": 3, "privat": 4, "uvurdert": 5}
NAME_STATUS_RANK = {"hovednavn": 0, "sidenavn": 1, "undernavn": 2}

# County codes of the first register.
COUNTIES = {
    "01": "Stockholms län", "03": "Uppsala län", "04": "Södermanlands län", "05": "Östergötlands län",
    "06": "Jönköpings län", "07": "Kronobergs län", "08": "Kalmar län", "09": "Gotlands län",
    "10": "Blekinge län", "12": "Skåne län", "13": "Hallands län", "14": "Västra Götalands län",
    "17": "Värmlands län", "18": "Örebro län", "19": "Västmanlands län", "20": "Dalarnas län",
    "21": "Gävleborgs län", "22": "Västernorrlands län", "23": "Jämtlands län",
    "24": "Västerbottens län", "25": "Norrbottens län",
}

# Search scoring.
KIND_DEMOTION = {3: 0.5, 4: 1.5, 7: 1.0, 8: 2.0, 9: 3.0}
SCAN_LIMIT = 60_000
RESULT_LIMIT = 40
MAX_TOKENS = 6

# Request telemetry.
SOURCES = ["offlineStore", "urlCache", "network", "upscaledAncestor",
           "expectedNoData", "unexpectedNoData", "failure"]
SERVED = ["offlineStore", "urlCache", "network", "upscaledAncestor"]
SERVED_LOCALLY = ["offlineStore", "urlCache", "upscaledAncestor"]
FAULTS = ["unexpectedNoData", "failure"]
LATENCY_BOUNDS_MS = [1, 3, 10, 30, 100, 300, 1_000, 3_000, 10_000]
MIN_REPORT_SAMPLES = 10

# Tile layers (server, name, source max z, offline min z, offline max z, is_slope, is_data).
LAYERS = [
    (0, "Kartverket", 18, 7, 14, False, False),
    (1, "Lantmäteriet", 16, 7, 14, False, False),
    (2, "Slope NO", 16, 7, 14, True, False),
    (3, "Slope SE", 13, 7, 13, True, False),
    (4, "Elevation", 12, 12, 12, False, True),
]
LAYER_SCHEMA = ("server int, name string, max_z int, offline_min_z int, offline_max_z int, "
                "is_slope boolean, is_data boolean")
PYRAMID_MIN_ZOOM, PYRAMID_MAX_ZOOM = 7, 14

# Measured bytes per tile position.
BASE_BYTES = {11: 84_000.0, 12: 61_000.0, 13: 55_000.0, 14: 50_000.0}
SLOPE_BYTES = {7: 34_000.0, 8: 31_000.0, 9: 37_000.0, 10: 38_000.0,
               11: 25_000.0, 12: 21_000.0, 13: 15_000.0, 14: 10_000.0}
SLOPE_COVERAGE = 0.45
ELEVATION_BYTES = 18_400.0
ELEVATION_COVERAGE = 0.8
MAX_DOWNLOAD_BYTES = 1_500_000_000

# Slope classes.
SLOPE_BREAKS = [30.0, 35.0, 40.0, 45.0, 50.0]
PALETTE = [(0, 0, 0), (255, 255, 0), (255, 170, 0), (255, 85, 0), (255, 0, 0), (115, 0, 0)]
RUNOUT_COLOURS = [(0, 77, 168), (76, 155, 255), (154, 177, 230)]
TERRAIN_SOURCES = ["dtm1", "dom1", "hoydekurver", "innsjohoyde"]

# Routes and profiles.
MARKER_SPACINGS = [1_000.0, 2_000.0, 5_000.0, 10_000.0, 25_000.0, 50_000.0, 100_000.0]
MAX_MARKERS = 60
ZOOM_SPACING = [(7.0, 100_000.0), (8.0, 50_000.0), (10.0, 25_000.0), (11.0, 10_000.0),
                (12.0, 5_000.0), (13.0, 2_000.0)]
ZOOM_SPACING_DEFAULT = 1_000.0
NICE_DISTANCES = [20.0, 50.0, 100.0, 200.0, 500.0, 1_000.0, 2_000.0, 5_000.0, 10_000.0,
                  20_000.0, 50_000.0, 100_000.0, 200_000.0, 500_000.0]
SCALE_BAR_POINTS = 120.0
SAMPLE_SPACING_M = 25.0
MAX_SAMPLES = 500
HYSTERESIS_M = 4.0

# Engagement.
REQUIRED_OPENS = 3
REQUIRED_MEASUREMENTS = 3
MIN_MEASUREMENT_M = 500.0
OPEN_GAP_SECONDS = 30 * 60
PROMPT_GAP_DAYS = 120.0

# Metadata audit.
FIELD_LIMITS = {"name": 30, "subtitle": 30, "promotional_text": 170, "keywords": 100,
                "description": 4000, "release_notes": 4000, "review_notes": 4000}
REQUIRED_FIELDS = ["name", "subtitle", "promotional_text", "keywords", "description",
                   "support_url", "privacy_url"]


def lookup(key: Column, values: dict, default=None) -> Column:
    """Value of a small fixed table, folded into the expression: no join."""
    pairs = [F.lit(x) for item in values.items() for x in item]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))


def layers(spark: SparkSession) -> DataFrame:
    """The tile-layer dimension: five literal rows."""
    return spark.createDataFrame(LAYERS, LAYER_SCHEMA)
