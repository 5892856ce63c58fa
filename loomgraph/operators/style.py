"""How a viewer draws nodes and edges, as lookups of fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Colour by language, shape by kind of node, style by kind of edge (colour, width, dashed,
# hidden; what isn't listed is solid, grey and one wide), brightness of an edge by its farther end's distance.
LANGUAGE_COLOUR = {"go": 0x00ADD8, "ts": 0x3178C6, "sol": 0x3C3C3D}
SHAPE = {
    "Package": "sphereLg", "File": "hex", "Struct": "cube", "Interface": "torus", "Class": "cylinder", "TypeAlias": "diamond", "Enum": "pyramid", "Contract": "star", "Mapping": "donut", "Event": "starburst",
    "Function": "coneLg", "Method": "coneSm", "Modifier": "tetra", "Constructor": "coneSpec", "Constant": "sphereSm", "Variable": "cubeSm", "Field": "cubeFlat", "Parameter": "cubeFlatSm", "LocalVariable": "cubeTiny",
    "Import": "ring", "Export": "ringExp", "Decorator": "ringSpike", "Goroutine": "coneBranched", "Channel": "pipe", "IfStmt": "plane", "LoopStmt": "plane", "SwitchStmt": "plane", "ReturnStmt": "plane", "CallSite": "plane",
}
EDGE_STYLE = {
    "contains": (0x999999, 1, False, True), "calls": (0xFFFFFF, 1, False, False), "invokes": (0xFFAA00, 1, False, False), "uses_type": (0xAAAAAA, 1, True, False), "instantiates": (0xAAAAAA, 1, True, False),
    "references": (0xAAAAAA, 1, True, False), "extends": (0x6699FF, 2, False, False), "implements": (0x66CCFF, 2, True, False), "binds_to": (0xFFD700, 3, False, False), "imports": (0x888888, 1, False, False),
    "exports": (0x888888, 1, False, False), "spawns": (0xFF66CC, 1, False, False), "sends_to": (0xFF99CC, 1, False, False), "receives_from": (0xCC99FF, 1, False, False), "reads": (0x99FF99, 1, False, False),
    "writes": (0xFF9999, 1, False, False), "modifies": (0xFFCC66, 1, False, False), "decorates": (0xCC99FF, 1, False, False), "emits": (0xFFAA00, 1, True, False),
}
PLAIN_EDGE = (0x999999, 1, False, False)
BRIGHTNESS = [1.0, 1.0, 0.55, 0.10]


def _pick(key: Column, values: dict, default=None) -> Column:
    table = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])
    got = F.element_at(table, key)
    return got if default is None else F.coalesce(got, F.lit(default))


def node_style(nodes: DataFrame) -> DataFrame:
    """id, colour and shape; null for a language or kind without one."""
    return nodes.select("id", _pick(F.col("language"), LANGUAGE_COLOUR).alias("colour"), _pick(F.col("type"), SHAPE).alias("shape"))


def edge_style(edges: DataFrame) -> DataFrame:
    """id, colour, width and dashed of the edges that are drawn."""
    col = [_pick(F.col("type"), {k: v[i] for k, v in EDGE_STYLE.items()}, PLAIN_EDGE[i]) for i in range(4)]
    return edges.where(~col[3]).select("id", col[0].alias("colour"), col[1].alias("width"), col[2].alias("dashed"))


def edge_brightness(edges: DataFrame, near: DataFrame) -> DataFrame:
    """id, brightness by the larger distance of an edge's ends from the focus; ends that ``near`` (id,
    depth) doesn't hold are as far as the last step."""
    a, b = near.select(F.col("id").alias("src"), F.col("depth").alias("da")), near.select(F.col("id").alias("dst"), F.col("depth").alias("db"))
    last = len(BRIGHTNESS) - 1
    far = F.least(F.greatest(F.coalesce("da", F.lit(last)), F.coalesce("db", F.lit(last))), F.lit(last)) + 1
    return edges.select("id", "src", "dst").join(a, "src", "left").join(b, "dst", "left").select("id", F.element_at(F.array(*[F.lit(x) for x in BRIGHTNESS]), far.cast("int")).alias("brightness"))
