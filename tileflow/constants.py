"""Fixed values that are part of the semantics of tile serving."""

METATILE = 8
MAX_ZOOM = 20
MAX_SIZE = 1 << 20
REQ_LIMIT = 256
DIRTY_LIMIT = 8000
VERY_OLD_US = 31536000000000
MAX_LOAD_OLD = 16
MAX_LOAD_MISSING = 50
REQUEST_TIMEOUT = 3
CLIENT_PENALTY = 3
TILE_BUCKET = 5000
RENDER_BUCKET = 65
RENDER_TOPUP_US = 5_000_000
HASHIDX_SIZE = 2213
XMLCONFIGS_MAX = 100
MAX_SLAVES = 5
META_HEADER = 20 + 64 * 8

#: Commands on the wire.
COMMANDS = {0: "Ignore", 1: "Render", 2: "Dirty", 3: "Done", 4: "NotDone", 5: "RenderPrio", 6: "RenderBulk", 7: "RenderLow"}
#: Order in which queues are fetched from, and the queue each accepted command asks for.
FETCH_ORDER = ("Prio", "Request", "Low", "Dirty", "Bulk")
QUEUE_OF = {"RenderPrio": "Prio", "Render": "Request", "RenderLow": "Low", "Dirty": "Dirty", "RenderBulk": "Bulk"}

#: Zoom bands of the monitors: (band, first zoom, last zoom).
BANDS = ((1, 0, 8), (2, 9, 12), (3, 13, 14), (4, 15, 16), (5, 17, 18), (6, 19, 20))

MERCATOR = "+proj=merc +a=6378137 +b=6378137"
PLATE_CARREE = "+proj=eqc +lat_ts=0 +lat_0=0 +lon_0=0 +x_0=0 +y_0=0 +ellps=WGS84 +datum=WGS84 +units=m +no_defs"
BRITISH_GRID = "+proj=tmerc +lat_0=49 +lon_0=-2 +k=0.9996012717 +x_0=400000 +y_0=-100000 +ellps=airy +datum=OSGB36 +units=m +no_defs"
#: srs kind -> (x0, y0, x1, y1, aspect_x, aspect_y)
PROJECTIONS = {
    "mercator": (-20037508.3428, -20037508.3428, 20037508.3428, 20037508.3428, 1, 1),
    "plate_carree": (-20037508.3428, -10018754.1714, 20037508.3428, 10018754.1714, 2, 1),
    "british_grid": (0.0, 0.0, 700000.0, 1400000.0, 1, 2),
}
