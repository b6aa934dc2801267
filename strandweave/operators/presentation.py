"""Layout, payloads and small HTML or SVG pages of a graph.

Data for drawing (degrees, colour groups, widths) are DataFrames.  Positions and pages are
made on the driver from at most ``cap`` of the best connected entities.
"""

from __future__ import annotations

import base64
import gzip
import html
import json
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import variants as V
from strandweave.model import PropertyGraph, has_data, note, primary_type
from strandweave.operators import analytics
from strandweave.operators.records import label

CAP = 10_000
# A palette of fifteen colours.
PALETTE = ("#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac", "#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd")


def colour(value: str) -> str:
    """A hex colour with six digits; ValueError for anything else."""
    if m := re.fullmatch(r"#([0-9a-fA-F])([0-9a-fA-F])([0-9a-fA-F])", value):
        return "#" + "".join(c * 2 for c in m.groups()).lower()
    if re.fullmatch(r"#[0-9a-fA-F]{6}", value):
        return value.lower()
    raise ValueError(f"{value!r} is no hex colour")


def css_size(value: str | int) -> str:
    """A CSS length; whole numbers are pixels."""
    if isinstance(value, int):
        return f"{value}px"
    if re.fullmatch(r"\d+(\.\d+)?(px|%|em|rem|vh|vw)", value):
        return value
    raise ValueError(f"{value!r} is no CSS length")


def group_of(g: PropertyGraph, colour_by: str | None = None):
    """The colour group of an entity: a property where there is one, else its first type."""
    if colour_by in (None, "type"):
        return primary_type(F.col("types"))
    v = F.col("props")[colour_by]
    return F.when(V.present(v), V.shown(v)).otherwise("(no value)")


def node_payload(g: PropertyGraph, colour_by: str | None = None, size_by: str | None = None) -> DataFrame:
    """``(id, label, type, group, colour_index, degree, size)`` for each entity."""
    rows = g.entities.select("id", "ord", label(F.col("id"), F.col("props")).alias("label"), primary_type(F.col("types")).alias("type"), group_of(g, colour_by).alias("group"), (V.number_of(F.col("props")[size_by]) if size_by else F.lit(None).cast("double")).alias("own"))
    groups = rows.select("group").distinct()
    ranked = groups.select("group", (F.dense_rank().over(_everything()) - 1).alias("rank"))
    joined = rows.join(g.degrees(), "id").join(ranked, "group")
    basis = F.coalesce(F.col("own"), F.lit(0.0)) if size_by else F.col("degree").cast("double")
    most = joined.agg(F.max(basis).alias("most"))
    size = F.when(F.col("most") > 0, 3 + 17 * F.sqrt(F.greatest(basis, F.lit(0.0)) / F.col("most"))).otherwise(3.0)
    return joined.crossJoin(F.broadcast(most)).select("id", "ord", "label", "type", "group", (F.col("rank") % len(PALETTE)).alias("colour_index"), "degree", size.alias("size"))


def _everything():
    from pyspark.sql import Window

    # over distinct groups only, which a legend lists
    return Window.orderBy("group")


def edge_payload(g: PropertyGraph) -> DataFrame:
    """``(source, target, type, width)`` with the width growing with the logarithm of the weight."""
    w = F.coalesce(V.number_of(F.col("props")["weight"]), F.lit(1.0))
    return g.relationships.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type", (1 + 2 * F.log1p(F.greatest(w, F.lit(0.0)))).alias("width"))


def positions(n: int, a: np.ndarray, b: np.ndarray, *, iterations: int | None = None, gravity: float = 1.0, seed: int = 42) -> np.ndarray:
    """Force-directed positions: linear attraction along edges, repulsion by degrees, pull to the centre.

    Repulsion is taken against the cells of a grid, so a round's cost grows with n times
    the number of cells that are not empty.
    """
    rng = np.random.default_rng(seed)
    xy = rng.uniform(-1, 1, (n, 2)) * max(1.0, np.sqrt(n))
    if n < 2:
        return xy
    mass = 1.0 + np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    rounds = min(200, 50 + n // 100) if iterations is None else iterations
    side = int(min(24, max(2, np.sqrt(n) / 2)))
    for turn in range(rounds):
        low, high = xy.min(axis=0), xy.max(axis=0)
        cell = np.minimum(((xy - low) / np.maximum(high - low, 1e-9) * side).astype(int), side - 1)
        key = cell[:, 0] * side + cell[:, 1]
        weight = np.bincount(key, mass, side * side)
        used = np.flatnonzero(weight)
        centre = np.stack([np.bincount(key, mass * xy[:, k], side * side)[used] / weight[used] for k in (0, 1)], axis=1)
        force = -gravity * mass[:, None] * xy / np.maximum(np.linalg.norm(xy, axis=1, keepdims=True), 1e-9) * 0.05
        for at in range(0, n, 4096):
            d = xy[at : at + 4096, None, :] - centre[None]
            push = mass[at : at + 4096, None] * weight[used][None] / np.maximum(np.square(d).sum(axis=2), 0.05)
            force[at : at + 4096] += 0.05 * (d * push[:, :, None]).sum(axis=1)
        pull = xy[b] - xy[a]
        np.add.at(force, a, pull)
        np.add.at(force, b, -pull)
        norm = np.maximum(np.linalg.norm(force, axis=1, keepdims=True), 1e-9)
        step = max(0.02, 1 - turn / rounds) * np.sqrt(n) * 0.1
        xy = xy + force / norm * np.minimum(norm / mass[:, None], step)
    return xy


def _capped(g: PropertyGraph, cap: int) -> PropertyGraph:
    """The best connected entities that a page can show, with a note of what is left out; ``cap`` raises the limit."""
    n = g.entities.count()
    if n > cap:
        note(f"{n - cap} of {n} entities are not shown; cap={n} shows all")
    return analytics.cap_most_connected(g, cap)


def layout(g: PropertyGraph, *, gravity: float = 1.0, iterations: int | None = None, seed: int = 42, cap: int = CAP) -> dict[str, tuple[float, float]]:
    """Positions by id, for at most ``cap`` of the best connected entities."""
    small = _capped(g, cap)
    ids = [r["id"] for r in small.entities.orderBy("ord", "id").select("id").collect()]
    place = {x: i for i, x in enumerate(ids)}
    pairs = small.relationships.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct().orderBy("a", "b").collect()
    a, b = (np.array([place[r[k]] for r in pairs], int) for k in (0, 1))
    xy = positions(len(ids), a, b, iterations=iterations, gravity=gravity, seed=seed)
    return {x: (float(xy[i, 0]), float(xy[i, 1])) for x, i in place.items()}


def payload(g: PropertyGraph, *, colour_by=None, colour_map=None, size_by=None, cap: int = CAP, **layout_options) -> dict:
    """Nodes, edges and legend for a page."""
    small = _capped(g, cap)
    xy = layout(small, cap=cap, **layout_options)
    own = {k: colour(v) for k, v in (colour_map or {}).items()}
    nodes = node_payload(small, colour_by, size_by).orderBy("ord", "id").collect()
    shade = lambda r: own.get(r["group"], PALETTE[r["colour_index"]])
    return {
        "nodes": [{"id": r["id"], "label": r["label"], "type": r["type"], "x": xy[r["id"]][0], "y": xy[r["id"]][1], "size": round(r["size"], 3), "color": shade(r)} for r in nodes],
        "edges": [r.asDict() for r in edge_payload(small).collect()],
        "legend": {r["group"]: shade(r) for r in sorted(nodes, key=lambda r: r["group"])},
    }


def svg(data: dict, width: int = 800, height: int = 600) -> str:
    """A drawing of a payload."""
    nodes = data["nodes"]
    xs, ys = [n["x"] for n in nodes] or [0], [n["y"] for n in nodes] or [0]
    fit = lambda v, low, high, size: 30 + (v - low) / ((high - low) or 1) * (size - 60)
    at = {n["id"]: (fit(n["x"], min(xs), max(xs), width), fit(n["y"], min(ys), max(ys), height)) for n in nodes}
    lines = [f'<line x1="{at[e["source"]][0]:.1f}" y1="{at[e["source"]][1]:.1f}" x2="{at[e["target"]][0]:.1f}" y2="{at[e["target"]][1]:.1f}" stroke="#bbb" stroke-width="{e["width"]:.1f}"/>' for e in data["edges"]]
    marks = [f'<circle cx="{at[n["id"]][0]:.1f}" cy="{at[n["id"]][1]:.1f}" r="{n["size"]:.1f}" fill="{n["color"]}"><title>{html.escape(n["label"])}</title></circle>' for n in nodes]
    names = [f'<text x="{at[n["id"]][0]:.1f}" y="{at[n["id"]][1] - n["size"] - 2:.1f}" font-size="10" text-anchor="middle">{html.escape(n["label"])}</text>' for n in nodes] if len(nodes) <= 60 else []
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="0 0 {width} {height}" width="{width}" height="{height}">{"".join(lines + marks + names)}</svg>'


def page(data: dict, title: str, three: bool = False) -> str:
    """A page of its own that draws a payload on a canvas; the data are compressed inside."""
    packed = base64.b64encode(gzip.compress(json.dumps(data).encode(), mtime=0)).decode()
    legend = "".join(f'<li><span style="background:{c}"></span>{html.escape(k)}</li>' for k, c in data["legend"].items())
    depth = "Math.sin(i*12.9898)*0.5" if three else "0"
    script = (
        "const raw=Uint8Array.from(atob(document.getElementById('d').textContent),c=>c.charCodeAt(0));"
        "new Response(new Blob([raw]).stream().pipeThrough(new DecompressionStream('gzip'))).json().then(g=>{"
        "const c=document.querySelector('canvas'),k=c.getContext('2d');let t=0;const at={};"
        "const xs=g.nodes.map(n=>n.x),ys=g.nodes.map(n=>n.y),a=Math.min(...xs),b=Math.max(...xs),p=Math.min(...ys),q=Math.max(...ys);"
        f"function draw(){{k.clearRect(0,0,c.width,c.height);g.nodes.forEach((n,i)=>{{const u=(n.x-a)/((b-a)||1)-.5,v=(n.y-p)/((q-p)||1)-.5,w={depth};"
        "at[n.id]=[c.width/2+(u*Math.cos(t)-w*Math.sin(t))*c.width*.9,c.height/2+v*c.height*.9]});k.strokeStyle='#bbb';"
        "g.edges.forEach(e=>{const s=at[e.source],d=at[e.target];if(s&&d){k.lineWidth=e.width/2;k.beginPath();k.moveTo(...s);k.lineTo(...d);k.stroke()}});"
        "g.nodes.forEach(n=>{k.fillStyle=n.color;k.beginPath();k.arc(...at[n.id],n.size/2,0,7);k.fill()})}draw();"
        + ("setInterval(()=>{t+=.01;draw()},40);" if three else "")
        + "});"
    )
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>li span{{display:inline-block;width:1em;height:1em}}</style></head><body><canvas width="1000" height="700"></canvas><ul>{legend}</ul><script id="d" type="text/plain">{packed}</script><script>{script}</script></body></html>'


def visualise(g: PropertyGraph, renderer: str = "2d", *, colour_by=None, colour_map=None, size_by=None, collapse_edges: bool = False, cap: int = CAP, path: str | None = None, **layout_options) -> str:
    """A page (``2d``, ``3d``, ``pyvis``) or a drawing (``svg``) of the graph."""
    if renderer not in ("2d", "3d", "svg", "pyvis"):
        raise ValueError(f"unknown renderer {renderer!r}")
    drawn = g.collapse_edges() if collapse_edges else g
    data = payload(drawn, colour_by=colour_by or ("community" if "community" in g.derived_fields else None), colour_map=colour_map, size_by=size_by, cap=cap, **layout_options)
    out = svg(data) if renderer == "svg" else page(data, g.title, renderer == "3d")
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(out)
    return out


def glimpse(g: PropertyGraph, **options) -> str:
    """A drawing of the types and how many relationships join them."""
    return visualise(g.merge_by_primary_type(), "svg", colour_by="label", **options)


def images(g: PropertyGraph, limit: int = 48) -> DataFrame:
    """``(id, label, path)`` of pictures: entities' thumbnails if there are any, else image files."""
    text = lambda k: V.text_of(F.col("props")[k])
    rows = g.entities.select("id", "ord", label(F.col("id"), F.col("props")).alias("label"), text("thumbnail").alias("thumb"), F.when(has_data() & F.coalesce(F.startswith(text("encodingFormat"), F.lit("image/")), F.col("id").rlike(r"(?i)\.(png|jpe?g|gif|webp|svg)$")), F.coalesce(text("raw_id"), F.col("id"))).alias("file"))
    thumbs = rows.where("thumb IS NOT NULL")
    path = "thumb" if not thumbs.isEmpty() else "file"
    own = rows.where(F.col(path).isNotNull()).groupBy(F.col(path).alias("path")).agg(F.min_by(F.struct("id", "label"), "ord").alias("e"), F.min("ord").alias("ord"))
    return own.orderBy("ord", "path").limit(limit).select("e.id", "e.label", "path")


def gallery(g: PropertyGraph, *, limit: int = 48, columns: int = 4) -> str:
    """A page of pictures with their labels."""
    cells = "".join(f'<figure><img loading="lazy" src="{html.escape(r["path"])}"><figcaption>{html.escape(r["label"])}</figcaption></figure>' for r in images(g, limit).collect())
    return f'<div style="display:grid;grid-template-columns:repeat({int(columns)},1fr)">{cells}</div>'


def safe_path(source: str, raw_id: str) -> str | None:
    """An entity's file below its collection's folder; None for what leads out of it."""
    import posixpath

    if raw_id.startswith("#") or "://" in raw_id or raw_id in ("./", ""):
        return None
    normal = posixpath.normpath(raw_id.lstrip("/"))
    return None if normal.startswith("..") else f"{source.rstrip('/')}/{normal}"


def inspect(g: PropertyGraph, entity_id: str) -> str | None:
    """The text of an entity's file, or None."""
    row = g.entities.where(F.col("id") == entity_id).select("source", F.coalesce(V.text_of(F.col("props")["raw_id"]), F.col("id")).alias("raw")).first()
    path = safe_path(row["source"] or g.source or "", row["raw"]) if row else None
    if path is None:
        return None
    found = g.entities.sparkSession.read.format("binaryFile").load(path).select("content").first()
    if found is None:
        return None
    try:
        return bytes(found["content"]).decode()
    except UnicodeDecodeError:
        return bytes(found["content"]).decode("latin-1")


def view(g: PropertyGraph, entity_id: str, characters: int = 5000, rows: int = 50) -> str:
    """A small page of an entity's file: a picture, a table's first rows, or its text's start."""
    low = entity_id.lower()
    if re.search(r"\.(png|jpe?g|gif|webp|svg)$", low):
        return f'<img src="{html.escape(entity_id)}">'
    if re.search(r"\.(mp3|wav|ogg)$", low):
        return f'<audio controls src="{html.escape(entity_id)}"></audio>'
    if low.endswith(".pdf"):
        return f'<embed type="application/pdf" src="{html.escape(entity_id)}">'
    text = inspect(g, entity_id)
    if text is None:
        return f"<p>{html.escape(entity_id)} has no file here</p>"
    if low.endswith((".csv", ".tsv")):
        import csv
        import io

        lines = list(csv.reader(io.StringIO(text), delimiter="\t" if low.endswith(".tsv") else ","))[: rows + 1]
        return "<table>" + "".join("<tr>" + "".join(f"<td>{html.escape(c)}</td>" for c in line) + "</tr>" for line in lines) + "</table>"
    return f"<pre>{html.escape(text[:characters])}</pre>"
