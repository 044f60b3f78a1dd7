"""Schemas of the tables. Spark keeps them; nothing is inferred."""

TAGS = "array<struct<k:string,v:string>>"
OSM_NODES = f"seq bigint, id bigint, lat double, lon double, tags {TAGS}"
OSM_WAYS = f"seq bigint, id bigint, refs array<bigint>, tags {TAGS}"
OSM_RELATIONS = f"seq bigint, id bigint, members array<struct<type:string,ref:bigint,role:string>>, tags {TAGS}"
CAMERAS = "osm_id bigint, lat double, lon double, kind string, direction_deg double, half_fov_deg double, range_m double, ai boolean, manufacturer string, model string"
NODES = "id bigint, lat double, lon double"
EDGES = "src bigint, dst bigint, length_m double, exposure double"
PLACES = "seq bigint, name string, kind string, lat double, lon double"
RING = "array<struct<lat:double,lon:double>>"
OCCLUDERS = f"ring_id bigint, ring {RING}"
ZONES = "id string, lat double, lon double, radius_m double, status string"
ROUTES = f"req_id bigint, status string, start_id bigint, goal_id bigint, path array<bigint>, length_m double, mean_exposure double, cost double"
