"""Fixed values that results depend on."""

# Geometry and scoring.
EARTH_RADIUS_M = 6_371_000.0
M_PER_DEG_GRID = 111_320.0
M_PER_DEG_LOCAL = 111_194.92664455873  # EARTH_RADIUS_M * pi / 180
M_PER_DEG_PROXIMITY = 111_195.0
SAMPLE_STEP_M = 5.0
MAX_STEPS = 2000
LENGTH_EPSILON = 2.220446049250313e-16
OWN_WALL_M = 3.0
OCCLUDER_CELL_M = 50.0
PROXIMITY_MARGIN_M = 5.0
PROXIMITY_CELL_M = 100.0
CONE_RAYS = 48
DISC_RAYS = 72
ZONE_RING_STEPS = 48
MAX_RING_POINTS = 5000
MAX_RING_CELLS = 10_000
CROSS_EPS = 1e-9
PARALLEL_EPS = 1e-12
RAY_MIN_T = 1e-6
SNAP_CELL_M = 100.0
SNAP_RINGS = 30

# Cameras.
KINDS = ("FIXED", "DOME", "PANNING", "UNKNOWN")
RANGE_M = {"FIXED": 25.0, "DOME": 20.0, "PANNING": 30.0, "UNKNOWN": 20.0}
HALF_FOV_DEG = 30.0
MODEL_PROFILES = (("q3839", 35.0, 90.0), ("q1809", 60.0, 45.0))
COMPASS = {"N": 0.0, "NE": 45.0, "NO": 45.0, "E": 90.0, "O": 90.0, "SE": 135.0, "SO": 135.0, "S": 180.0, "SW": 225.0, "W": 270.0, "NW": 315.0}
AI_FEATURES = ("artificial intelligence", "ai", "facedetection", "face detection", "face recognition", "facial recognition", "behaviour detection", "behavior detection")
MAX_TAG_BYTES = 80

# Streets, buildings, places.
WALKABLE = ("footway", "path", "pedestrian", "steps", "corridor", "living_street", "residential", "service", "track", "bridleway", "unclassified", "tertiary", "tertiary_link", "secondary", "secondary_link", "primary", "primary_link", "road")
LOW_BUILDINGS = ("shed", "garage", "garages", "carport", "roof", "hut", "kiosk", "greenhouse", "cabin")
LEVEL_HEIGHT_M, LOW_HEIGHT_M, DEFAULT_HEIGHT_M, OCCLUDER_MIN_HEIGHT_M = 3.2, 3.0, 9.0, 6.0
LOCALITIES = ("city", "borough", "suburb", "quarter", "neighbourhood", "town", "village")

# Zones as (id, lat, lon, radius m, status).
ZONES = (
    ("kotti", 52.4990, 13.4178, 150.0, "COMMISSIONING"),
    ("warschauer", 52.5060, 13.4498, 150.0, "PLANNED"),
    ("alex", 52.5219, 13.4132, 250.0, "PLANNED"),
    ("goerli", 52.4966, 13.4350, 350.0, "PLANNED"),
    ("rathaus", 52.5186, 13.4083, 70.0, "PLANNED"),
    ("stadthaus", 52.5153, 13.4154, 70.0, "PLANNED"),
    ("juedmus", 52.5020, 13.3954, 70.0, "PLANNED"),
)
ZONES_AS_OF = "29 October 2026"

# Interface presets.
AVOIDANCE = {"LOW": 1.0, "MEDIUM": 3.0, "HIGH": 6.0}
SEARCH_LIMIT, DEBOUNCE_MS, COVERAGE_CAP = 8, 180, 1500
VIEWPORT_MIN_M, VIEWPORT_MAX_M, VIEWPORT_DEFAULT_M = 500.0, 40_000.0, 2_000.0
WINDS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")
KIND_LABELS = {"STREET": "Street", "LOCALITY": "District", "STATION": "Station"}
BERLIN_BBOX = (52.3383, 13.0884, 52.6755, 13.7612)  # south, west, north, east
BERLIN_CENTRE_BOX = (52.500, 13.350, 52.540, 13.440)
# Accents that search folds away, letter by letter.
FOLD_FROM = "äàáâãåöòóôõøüùúûéèêëíìîïçñ"
FOLD_TO = "aaaaaaoooooouuuueeeeiiiicn"
