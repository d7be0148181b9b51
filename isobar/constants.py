"""Fixed values. They must equal the published ones for results to agree."""

# Canonical variables of a unified series.
TEMP = "temp_celsius"
HUMIDITY = "relative_humidity_percent"
WIND_SPEED = "wind_speed_ms"
WIND_DIR = "wind_direction_deg"
PRESSURE = "pressure_hpa"
PRECIP = "precipitation_mm"
CLOUD = "cloud_cover_percent"
CANONICAL = [TEMP, HUMIDITY, WIND_SPEED, WIND_DIR, PRESSURE, PRECIP, CLOUD]

# Forecast targets, in output order, with their loss weights.
TARGETS = [TEMP, PRECIP, HUMIDITY, WIND_SPEED, PRESSURE, CLOUD]
LOSS_WEIGHTS = {TEMP: 2.0, PRECIP: 3.0, HUMIDITY: 1.0, WIND_SPEED: 1.0, PRESSURE: 1.0, CLOUD: 1.0}

# Time grid and window lengths.
STEP_SECONDS = 900
INPUT_STEPS = 24
OUTPUT_STEPS = 24

# Physical limits (lower, upper); None is open.
LIMITS = {
    "temperature_celsius": (-50.0, 60.0),
    TEMP: (-50.0, 60.0),
    HUMIDITY: (0.0, 100.0),
    WIND_SPEED: (0.0, 100.0),
    PRESSURE: (800.0, 1100.0),
    CLOUD: (0.0, 100.0),
    PRECIP: (0.0, 500.0),
}
SATELLITE_LIMITS = {PRECIP: (0.0, None)}

# Variables each kind of source may deliver.
SOURCE_VARIABLES = {
    "satellite": [PRECIP],
    "reanalysis": ["temperature_celsius", HUMIDITY, WIND_SPEED, WIND_DIR, PRESSURE, CLOUD],
    "stations": ["temperature_celsius", "dewpoint_celsius", HUMIDITY, PRECIP, WIND_SPEED, WIND_DIR,
                 PRESSURE, "wind_gust_ms"],
}
# Preferred source first, per canonical variable.
SOURCE_PRIORITY = {
    TEMP: [("stations", "temperature_celsius"), ("reanalysis", "temperature_celsius")],
    HUMIDITY: [("stations", HUMIDITY), ("reanalysis", HUMIDITY)],
    WIND_SPEED: [("stations", WIND_SPEED), ("reanalysis", WIND_SPEED)],
    WIND_DIR: [("stations", WIND_DIR), ("reanalysis", WIND_DIR)],
    PRESSURE: [("stations", PRESSURE), ("reanalysis", PRESSURE)],
    PRECIP: [("satellite", PRECIP), ("stations", PRECIP)],
    CLOUD: [("reanalysis", CLOUD)],
}

# Station-observation column names.
STATION_COLUMNS = {
    "temp": "temperature_celsius",
    "dwpt": "dewpoint_celsius",
    "rhum": HUMIDITY,
    "prcp": PRECIP,
    "snow": "snow_mm",
    "wdir": WIND_DIR,
    "wspd": WIND_SPEED,
    "wpgt": "wind_gust_ms",
    "pres": PRESSURE,
    "tsun": "sunshine_minutes",
    "coco": "condition_code",
}
# Variables averaged over stations.
MERGED_STATION_VARIABLES = SOURCE_VARIABLES["stations"]

# Reanalysis column names: the first one present counts for temperature and wind components,
# the last one present counts for the others.
REANALYSIS_TEMPERATURE = ["t2m", "2m_temperature"]
REANALYSIS_WIND = [("u10", "v10"), ("10m_u_component_of_wind", "10m_v_component_of_wind")]
REANALYSIS_ALIASES = {
    PRESSURE: ["sp", "surface_pressure"],
    HUMIDITY: ["rh", "relative_humidity"],
    CLOUD: ["tcc", "total_cloud_cover"],
    "dewpoint_celsius": ["d2m", "2m_dewpoint_temperature"],
}

# Feature defaults.
LAGS = [1, 2, 3, 6]
WINDOWS = [4, 8, 12]
DIFFS = [1, 2, 3]
PRESSURE_TENDENCY_STEPS = 12
BASE_FEATURES = [TEMP, HUMIDITY, PRECIP, WIND_SPEED, PRESSURE, CLOUD]
CYCLIC_FEATURES = ["hour_sin", "hour_cos", "month_sin", "month_cos"]
EXTRA_FEATURES = ["heat_index", "pressure_change_3h"]
SEASONS = ["winter", "spring", "summer", "fall"]
PRECIP_CLASSES = ["no_rain", "light_rain", "moderate_rain", "heavy_rain", "unknown"]
CLOUD_CLASSES = ["clear", "partly_cloudy", "mostly_cloudy", "overcast", "unknown"]

# Thresholds of the weather description and classes.
RAIN_LIGHT, RAIN_MODERATE, RAIN_HEAVY = 0.2, 2.5, 7.6
CLOUDY, PARTLY_CLOUDY, COLD, HOT, WINDY = 60, 25, 10, 30, 10

# Climate normals by region: annual mean and amplitude of temperature, humidity, monthly rain (mm),
# wind (km/h), pressure (hPa).
NORMALS = {
    "chihuahua_city": (18.0, 12.0, 45.0, [5, 8, 3, 2, 5, 40, 80, 70, 50, 25, 10, 5], 8.0, 1013.0),
    "juarez": (20.0, 15.0, 35.0, [3, 5, 2, 2, 5, 8, 35, 30, 20, 10, 5, 3], 12.0, 1010.0),
    "mountains": (12.0, 8.0, 55.0, [10, 15, 8, 5, 15, 60, 120, 100, 80, 40, 15, 10], 15.0, 980.0),
}

# Typical mean and standard deviation per target, used when no fitted statistics exist.
TYPICAL_STATS = {
    TEMP: (15.0, 5.0),
    PRECIP: (0.5, 2.0),
    HUMIDITY: (60.0, 20.0),
    WIND_SPEED: (3.0, 2.0),
    PRESSURE: (1013.0, 10.0),
    CLOUD: (50.0, 30.0),
}
TYPICAL_CLAMPS = {
    PRECIP: (0.0, None),
    HUMIDITY: (0.0, 100.0),
    WIND_SPEED: (0.0, None),
    PRESSURE: (800.0, None),
    CLOUD: (0.0, 100.0),
}

# Locations.
STATE_CODE, STATE_NAME = "08", "CHIHUAHUA"
BOUNDING_BOX = (24.0, 32.0, -110.0, -100.0)
PREFIX_COORDINATES = {
    "31": (28.6320, -106.0691),
    "32": (31.6904, -106.4245),
    "33": (28.1901, -105.4700),
}
EARTH_RADIUS_KM = 6371.0088

# City coordinates by location code, in order of entry; a repeated code takes its last entry.
CITY_COORDINATES = [
    ("32000", 31.6904, -106.4245), ("32500", 31.6904, -106.4245), ("32400", 31.6904, -106.4245),
    ("32300", 31.6904, -106.4245), ("32100", 31.6904, -106.4245), ("32200", 31.6904, -106.4245),
    ("31000", 28.6320, -106.0691), ("31100", 28.6320, -106.0691), ("31200", 28.6320, -106.0691),
    ("31300", 28.6320, -106.0691), ("31400", 28.6320, -106.0691), ("31500", 28.6320, -106.0691),
    ("31600", 28.6320, -106.0691), ("31700", 28.6320, -106.0691), ("31800", 28.6320, -106.0691),
    ("31900", 28.6320, -106.0691), ("33000", 28.1901, -105.4700), ("31500", 28.4080, -106.8600),
    ("33800", 26.9304, -105.6667), ("33900", 27.1300, -104.9100), ("33700", 27.6917, -104.9500),
    ("32880", 29.5667, -104.4167), ("31700", 30.4167, -107.9167), ("31940", 29.2000, -108.1333),
    ("33200", 27.8333, -107.5833), ("33100", 26.8167, -107.0667), ("33200", 27.7500, -107.6333),
    ("33400", 27.0333, -107.7333), ("32800", 28.8833, -105.9000), ("33500", 26.7833, -105.8167),
    ("33600", 26.9833, -105.4000), ("33650", 26.7667, -105.1333), ("33630", 26.7667, -105.5833),
    ("33200", 27.0333, -106.0833), ("33400", 27.2500, -107.9167), ("33450", 26.1000, -106.9667),
    ("31840", 30.8833, -108.1833), ("31820", 31.1000, -107.9833), ("32500", 31.6904, -106.4245),
    ("32800", 31.3667, -106.0167), ("32800", 30.6167, -106.5167), ("31870", 29.8833, -107.0333),
]

# Error texts of forecasts, fixed values.
ERROR_INVALID = "Código postal inválido. Debe ser un string de 5 dígitos."
ERROR_UNKNOWN = "No se encontraron coordenadas para el código postal "
ERROR_NO_DATA = "No se pudieron obtener datos recientes para predicción"
