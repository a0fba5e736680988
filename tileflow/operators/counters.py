"""Counters: one pass over outcomes, pre-aggregated, then laid out as the texts monitors read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tileflow.constants import BANDS


def band(z: Column) -> Column:
    """Zoom band 1..6 of the monitors."""
    out = F.lit(None).cast("int")
    for b, lo, hi in BANDS:
        out = F.when(z.between(lo, hi), F.lit(b)).otherwise(out)
    return out


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


#: Outcome counters of the server: (name, column, value).
CLASSES = [("NoResp200", "status", 200), ("NoResp304", "status", 304), ("NoResp404", "status", 404), ("NoResp503", "status", 503), ("NoResp5XX", "status", 500)]
FRESHNESS = [("NoFreshCache", "FRESH"), ("NoOldCache", "OLD"), ("NoVeryOldCache", "VERYOLD"), ("NoFreshRender", "FRESH_RENDER"), ("NoOldRender", "OLD_RENDER"), ("NoVeryOldRender", "VERYOLD_RENDER")]


def cells(outcomes: DataFrame) -> DataFrame:
    """outcomes(status, counter, z, layer_no, read_us) -> counts of each combination: a few hundred rows whatever the input."""
    return outcomes.groupBy("status", "counter", "z", "layer_no").agg(F.count("*").alias("n"), F.sum("read_us").alias("us"))


def total(value: str, condition: Column | None = None) -> Column:
    v = F.col(value) if condition is None else F.when(condition, F.col(value))
    return F.coalesce(F.sum(v), F.lit(0)).cast("long")


def serve_counters(outcomes: DataFrame, max_zoom: int, layers: list[tuple[int, str]]) -> tuple[DataFrame, list[str]]:
    """One row with every counter of the server, and their names in order.

    A 304 counts for its layer as a 200 does; zooms count 200 and 304 only; only a 200 reads a tile.
    """
    st, z, layer = F.col("status"), F.col("z"), F.col("layer_no")
    ok, read = st.isin(200, 304), st == 200
    cols = {name: total("n", st == value) for name, _, value in CLASSES}
    cols["NoRespOther"] = total("n", ~st.isin([v for _, _, v in CLASSES]))
    cols |= {name: total("n", F.col("counter") == value) for name, value in FRESHNESS}
    cols |= {f"NoRespZoom{i:02d}": total("n", ok & (z == i)) for i in range(max_zoom + 1)}
    cols |= {"NoTileBufferReads": total("n", read), "DurationTileBufferReads": total("us", read)}
    for i in range(max_zoom + 1):
        cols |= {f"NoTileBufferReadZoom{i:02d}": total("n", read & (z == i)), f"DurationTileBufferReadZoom{i:02d}": total("us", read & (z == i))}
    for n, uri in layers:
        cols |= {f"NoRes200Layer{uri}": total("n", ok & (layer == n)), f"NoRes404Layer{uri}": total("n", (st == 404) & (layer == n))}
    return cells(outcomes).agg(*[c.alias(k) for k, c in cols.items()]), list(cols)


def lines(row: DataFrame, names: list[str]) -> DataFrame:
    """One row of counters -> (line_no, line), "name: value" in the given order."""
    return row.select(F.posexplode(F.array(*[F.concat(F.lit(f"{n}: "), F.col(f"`{n}`").cast("string")) for n in names])).alias("line_no", "line"))


def prometheus(row: DataFrame, max_zoom: int, layers: list[tuple[int, str]]) -> DataFrame:
    """The same counters as (line_no, line) in the exposition format; durations become seconds."""
    zooms = range(max_zoom + 1)
    families = [
        ("tile_server_http_responses_total", "Number of HTTP responses by response code", [(f'status="{n}"', k) for n, k in (("200", "NoResp200"), ("304", "NoResp304"), ("404", "NoResp404"), ("503", "NoResp503"), ("5XX", "NoResp5XX"), ("other", "NoRespOther"))]),
        ("tile_server_tiles_total", "Tiles served", [(f'age="{age}",rendered="{how}"', k) for age, how, k in (("fresh", "no", "NoFreshCache"), ("old", "no", "NoOldCache"), ("outdated", "no", "NoVeryOldCache"), ("fresh", "yes", "NoFreshRender"), ("old", "attempted", "NoOldRender"), ("outdated", "attempted", "NoVeryOldRender"))]),
        ("tile_server_zoom_responses_total", "Tiles served by zoom level", [(f'zoom="{i:02d}"', f"NoRespZoom{i:02d}") for i in zooms]),
        ("tile_server_tile_reads_total", "Tiles served from the tile buffer", [(f'zoom="{i:02d}"', f"NoTileBufferReadZoom{i:02d}") for i in zooms]),
        ("tile_server_tile_reads_seconds_total", "Tile buffer duration", [(f'zoom="{i:02d}"', f"DurationTileBufferReadZoom{i:02d}") for i in zooms]),
        ("tile_server_layer_responses_total", "Layer responses", [(f'layer="{uri}",status="{s}"', f"NoRes{s}Layer{uri}") for _, uri in layers for s in (200, 404)]),
    ]
    out = []
    for family, help_text, samples in families:
        out += [F.lit(f"# HELP {family} {help_text}"), F.lit(f"# TYPE {family} counter")]
        for labels, key in samples:
            value = F.col(f"`{key}`")
            text = F.format_string("%.6f", value / 1e6) if "seconds" in family else value.cast("string")
            out.append(F.concat(F.lit(f"{family}{{{labels}}} "), text))
    return row.select(F.posexplode(F.array(*out)).alias("line_no", "line"))
