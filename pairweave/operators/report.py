"""Tables behind the figures, and small HTML files drawn from them.

Figures are for what a person can look at: a page is one string on the driver and holds all rows of its
tables, in order. With a ``limit``, a table of more rows is an error; nothing is cut.
"""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from pairweave.operators.graph import degrees

#: A qualitative palette of our own: hues in equal steps.
PALETTE = [f"hsl({(47 * k) % 360},{60 + 15 * (k % 2)}%,{42 + 8 * (k % 3)}%)" for k in range(48)]


def viewer_nodes(edges: DataFrame, annotation: DataFrame, by: str = "super_class", least: float = 3.0, most: float = 22.0, constant: float | None = None) -> DataFrame:
    """node_id, class, its code in alphabetical order, degree, and a marker size whose area follows the degree (or ``constant``).

    ``by`` is any column of the annotation: its values are classes, as text; nodes without one are "unknown".
    """
    annotation = annotation.select("feature", F.col(by).cast("string").alias(by))
    nodes = degrees(edges).join(annotation.select(F.col("feature").alias("node_id"), by), "node_id", "left")
    nodes = nodes.withColumn("class", F.coalesce(by, F.lit("unknown")))
    top = degrees(edges).agg(F.max("degree").alias("top"))  # one row
    codes = nodes.select("class").distinct().withColumn("code", F.row_number().over(Window.orderBy("class")) - 1)
    sized = nodes.crossJoin(F.broadcast(top)).join(codes, "class")
    size = least + (most - least) * F.sqrt(F.col("degree") / F.col("top")) if constant is None else F.lit(float(constant))
    return sized.select("node_id", "class", "code", "degree", size.alias("marker_size"))


def hover_text(nodes: DataFrame, annotation: DataFrame, fields: list[str], name: str | None = None) -> DataFrame:
    """``nodes`` with hover: the id, the value of ``name``, "field: value" for each field, and the degree, a line each.

    A missing field reads "unknown"; a missing name has no line.
    """
    known = annotation.select(F.col("feature").alias("node_id"), *(F.col(c).cast("string").alias(f"_{c}") for c in dict.fromkeys([*fields, *([name] if name else [])])))
    lines = [F.col("node_id")] + ([F.col(f"_{name}")] if name else [])
    lines += [F.concat(F.lit(f"{c}: "), F.coalesce(f"_{c}", F.lit("unknown"))) for c in fields]
    lines.append(F.concat(F.lit("degree: "), F.col("degree").cast("string")))
    return nodes.join(known, "node_id", "left").select(*nodes.columns, F.concat_ws("\n", *lines).alias("hover"))


def edge_groups(edges: DataFrame, value: str, kind: str = "auto", threshold: int = 20, bins: int = 15, low: float | None = None, high: float | None = None) -> DataFrame:
    """source, target, code, label: how a general plot colours edges by any of their columns.

    Categories (what is no number, or has at most ``threshold`` values, if ``kind`` is "auto") are coded in
    the order of their text, edges without a value being "unknown". Continuous values are coded by bin and
    labelled by its number; edges without one are left out.
    """
    if kind not in ("auto", "categorical", "continuous"):
        raise ValueError(f"kind must be 'auto', 'categorical' or 'continuous', not {kind!r}")
    if kind == "continuous" or kind == "auto" and not is_categorical(edges, value, threshold):
        return binned_edges(edges, value, bins, low, high).select("source", "target", F.col("bin").alias("code"), F.col("bin").cast("string").alias("label"))
    named = edges.select("source", "target", F.coalesce(F.col(value).cast("string"), F.lit("unknown")).alias("label"))
    codes = named.select("label").distinct().withColumn("code", F.row_number().over(Window.orderBy("label")) - 1)  # a row per category
    return named.join(codes, "label").select("source", "target", "code", "label")


def viewer_edges(edges: DataFrame, positions: DataFrame, nodes: DataFrame) -> DataFrame:
    """Both ends' coordinates (4 decimals) and class codes, and the sign of r."""
    out = edges
    for e in ("source", "target"):
        at = positions.select(F.col("node_id").alias(e), F.round("x", 4).alias(f"x_{e}"), F.round("y", 4).alias(f"y_{e}"))
        out = out.join(at, e).join(nodes.select(F.col("node_id").alias(e), F.col("code").alias(f"code_{e}")), e)
    return out.select("source", "target", "x_source", "y_source", "x_target", "y_target", "code_source", "code_target", (F.col("r") >= 0).cast("int").alias("positive"))


def binned_edges(edges: DataFrame, value: str, bins: int = 15, low: float | None = None, high: float | None = None) -> DataFrame:
    """source, target, bin of a continuous value between its (or the given) limits; nulls are left out."""
    some = edges.filter(F.col(value).isNotNull())
    ends = some.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))  # one row
    placed = some.crossJoin(F.broadcast(ends))
    lo = F.col("_lo") if low is None else F.lit(float(low))
    hi = F.col("_hi") if high is None else F.lit(float(high))
    span = F.when(hi == lo, 1.0).otherwise(hi - lo)
    cut = ((F.col(value) - lo) / span * bins).cast("int")
    return placed.select("source", "target", F.least(F.lit(bins - 1), F.greatest(F.lit(0), cut)).alias("bin"))


def is_categorical(df: DataFrame, column: str, threshold: int = 20) -> bool:
    """Not a number, or with few distinct values."""
    if dict(df.dtypes)[column] in ("string", "boolean"):
        return True
    return df.select(column).filter(F.col(column).isNotNull()).distinct().limit(threshold + 1).count() <= threshold


def cluster_edges(jaccard: DataFrame, p_values: DataFrame | None = None, alpha: float = 0.05, least: float = 1.0, most: float = 10.0) -> DataFrame:
    """Cluster pairs to draw: similarity not 0, p below alpha, width by share of the largest similarity."""
    top = jaccard.agg(F.max(F.abs("similarity")).alias("top"))  # one row
    drawn = jaccard.filter("similarity != 0")
    if p_values is not None:
        drawn = drawn.join(p_values.filter(F.col("p") < alpha).select("cluster_i", "cluster_j"), ["cluster_i", "cluster_j"], "left_semi")
    return drawn.crossJoin(F.broadcast(top)).select("cluster_i", "cluster_j", "similarity", (least + (most - least) * F.abs("similarity") / F.col("top")).alias("width"))


def pivot_matrix(pairs: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A long table of pairs as a square, for export of small ones."""
    return pairs.groupBy(row).pivot(column).agg(F.first(value)).orderBy(row)


_PAGE = """<!doctype html><meta charset="utf-8"><title>%(title)s</title>
<style>body{font:13px sans-serif}#legend span,#groups span{margin-right:1em}#legend span{cursor:pointer}.off{opacity:.3}
#tip{position:absolute;display:none;background:#fffd;border:1px solid #999;padding:3px 6px;white-space:pre;pointer-events:none}</style>
<h3>%(title)s</h3><select id="sets" hidden></select><div id="legend"></div><div id="groups"></div><canvas id="c" width="1100" height="800"></canvas><div id="tip"></div>
<script>
const D=%(data)s, on=D.classes.map(()=>true), canvas=document.getElementById("c"), ctx=canvas.getContext("2d");
const all=D.nodes.flatMap(n=>[n.x,n.y]), span=Math.max(1e-9,...all.map(Math.abs)), tip=document.getElementById("tip");
const px=x=>550+520*x/span, py=y=>400-370*y/span;
let set=null;
function share(v){return `hsl(0,${20+70*v}%%,${95-50*v}%%)`}
function draw(){ctx.clearRect(0,0,1100,800);
 for(const e of D.edges) if(on[e.a]&&on[e.b]){ctx.strokeStyle=e.g!==undefined?D.groups[e.g].colour:e.s?"rgba(60,60,60,.25)":"rgba(200,60,60,.35)";ctx.lineWidth=e.w||1;ctx.beginPath();ctx.moveTo(px(e.x0),py(e.y0));ctx.lineTo(px(e.x1),py(e.y1));ctx.stroke()}
 D.nodes.forEach((n,i)=>{if(!on[n.k])return;ctx.fillStyle=set?share(set.values[i]):D.colours[n.k];ctx.beginPath();ctx.arc(px(n.x),py(n.y),n.r/2,0,7);ctx.fill();
  if(set&&set.significant[i]){ctx.strokeStyle="black";ctx.lineWidth=2;ctx.stroke()}})}
D.classes.forEach((name,k)=>{const s=document.createElement("span");s.textContent="\\u25cf "+name;s.style.color=D.colours[k];
 s.onclick=()=>{on[k]=!on[k];s.className=on[k]?"":"off";draw()};
 s.ondblclick=()=>{on.forEach((_,j)=>on[j]=j===k);[...document.getElementById("legend").children].forEach((c,j)=>c.className=on[j]?"":"off");draw()};
 document.getElementById("legend").append(s)});
(D.groups||[]).forEach(g=>{const s=document.createElement("span");s.textContent="\\u2014 "+g.label;s.style.color=g.colour;document.getElementById("groups").append(s)});
if(D.sets){const box=document.getElementById("sets");box.hidden=false;["(none)",...D.sets.map(s=>s.label)].forEach(t=>box.append(new Option(t)));
 box.onchange=()=>{set=box.selectedIndex?D.sets[box.selectedIndex-1]:null;draw()}}
canvas.onmousemove=m=>{let best=-1,near=64;D.nodes.forEach((n,i)=>{const d=(px(n.x)-m.offsetX)**2+(py(n.y)-m.offsetY)**2;if(on[n.k]&&n.h&&d<near){near=d;best=i}});
 tip.style.display=best<0?"none":"block";if(best>=0){const v=set?"\\n"+set.label+": "+(100*set.values[best]).toFixed(1)+"%%":"";tip.textContent=D.nodes[best].h+v;tip.style.left=m.pageX+12+"px";tip.style.top=m.pageY+8+"px"}};
draw();
</script>"""


def _page(title: str, data: dict) -> str:
    return _PAGE % {"title": html.escape(title), "data": json.dumps(data).replace("</", "<\\/")}


#: Rows of each table that a page holds unless told otherwise: a page is one string on the driver.
PAGE_ROWS = 200_000


def _rows(df: DataFrame, limit: int | None) -> Iterator[Row]:
    for k, row in enumerate((df if limit is None else df.limit(limit + 1)).toLocalIterator()):
        if k == limit:
            raise ValueError(f"more than {limit} rows to draw; raise limit or filter before")
        yield row


def network_html(nodes: DataFrame, edges: DataFrame, positions: DataFrame, title: str = "network", limit: int | None = PAGE_ROWS, groups: DataFrame | None = None) -> str:
    """A page with a canvas and a legend: a click hides a class and its edges, a double click isolates it.

    Where nodes have a column hover (``hover_text``), it shows at the pointer. ``groups`` (``edge_groups``)
    colours edges, leaving out those without a group; else their colour is the sign of r.
    """
    rows = list(_rows(nodes.join(positions, "node_id").orderBy("node_id"), limit))
    drawn = viewer_edges(edges, positions, nodes)
    drawn = drawn if groups is None else drawn.join(groups.select("source", "target", F.col("code").alias("group"), "label"), ["source", "target"])
    lines = list(_rows(drawn.orderBy("source", "target"), limit))
    classes = dict(sorted({r["code"]: r["class"] for r in rows}.items()))
    hover = "hover" in nodes.columns
    data = {
        "classes": list(classes.values()),
        "colours": [PALETTE[k % len(PALETTE)] for k in range(len(classes))],
        "nodes": [{"x": r["x"], "y": r["y"], "r": r["marker_size"], "k": r["code"]} | ({"h": r["hover"]} if hover else {}) for r in rows],
        "edges": [{"x0": e["x_source"], "y0": e["y_source"], "x1": e["x_target"], "y1": e["y_target"], "a": e["code_source"], "b": e["code_target"], "s": e["positive"]} for e in lines],
    }
    if groups is not None:
        labels = dict(sorted({e["group"]: e["label"] for e in lines}.items()))
        place = {code: k for k, code in enumerate(labels)}
        data["groups"] = [{"label": label, "colour": PALETTE[code % len(PALETTE)]} for code, label in labels.items()]
        data["edges"] = [drawn | {"g": place[e["group"]]} for drawn, e in zip(data["edges"], lines, strict=True)]
    return _page(title, data)


def cluster_html(sizes: DataFrame, edges: DataFrame, positions: DataFrame, abundance: DataFrame | None = None, title: str = "clusters", limit: int | None = PAGE_ROWS, significance: DataFrame | None = None, names: DataFrame | None = None) -> str:
    """Clusters as circles (area by size), joined by lines (width by similarity).

    With ``abundance`` (cluster, set_id, abundance) a list above selects a set, whose share colours the
    clusters; those where it is significant (cluster, set_id, significant) have a border. ``names``
    (set_id, set_name) names the sets in the list. A table below holds the numbers.
    """
    rows = list(_rows(sizes.join(positions, "cluster").orderBy("cluster"), limit))
    at = {r["cluster"]: r for r in rows}
    place = {c: k for k, c in enumerate(at)}
    top = max((r["n"] for r in rows), default=1)
    lines = [e for e in _rows(edges.orderBy("cluster_i", "cluster_j"), limit) if e["cluster_i"] in at and e["cluster_j"] in at]
    data = {
        "classes": [f"cluster {r['cluster']} (n={r['n']})" for r in rows],
        "colours": [PALETTE[k % len(PALETTE)] for k in range(len(rows))],
        "nodes": [{"x": r["x"], "y": r["y"], "r": 15 + 45 * (r["n"] / top) ** 0.5, "k": k, "h": f"cluster {r['cluster']}\nn={r['n']}"} for k, r in enumerate(rows)],
        "edges": [{"x0": at[e["cluster_i"]]["x"], "y0": at[e["cluster_i"]]["y"], "x1": at[e["cluster_j"]]["x"], "y1": at[e["cluster_j"]]["y"], "a": place[e["cluster_i"]], "b": place[e["cluster_j"]], "s": int(e["similarity"] >= 0), "w": e["width"]} for e in lines],
    }
    if abundance is None:
        return _page(title, data)
    told = abundance.select("cluster", "set_id", "abundance")
    told = told.withColumn("significant", F.lit(False)) if significance is None else told.join(significance.select("cluster", "set_id", "significant"), ["cluster", "set_id"], "left")
    told = told.withColumn("set_name", F.lit(None).cast("string")) if names is None else told.join(names.groupBy("set_id").agg(F.min("set_name").alias("set_name")), "set_id", "left")
    cells, sets = list(_rows(told.orderBy("set_id", "cluster"), limit)), {}
    for c in cells:
        own = sets.setdefault(c["set_id"], {"label": c["set_id"] if c["set_name"] is None else f"{c['set_id']}: {c['set_name']}", "values": [0.0] * len(rows), "significant": [False] * len(rows)})
        if c["cluster"] in place:
            own["values"][place[c["cluster"]]], own["significant"][place[c["cluster"]]] = c["abundance"], bool(c["significant"])
    data["sets"] = list(sets.values())
    return _page(title, data) + "<table>" + "".join(f"<tr><td>{html.escape(str(c['set_id']))}<td>{c['cluster']}<td>{c['abundance']:.3f}" for c in cells) + "</table>"


def dendrogram_svg(steps: list[tuple[int, int, float]], labels: list[str], width: int = 900, height: int = 400) -> str:
    """Linkage steps (left, right, height) of a small number of clusters."""
    import numpy as np

    from pairweave.operators.cluster import leaf_order

    n = len(labels)
    table = np.array([(a, b, h, 0) for a, b, h in steps], float).reshape(-1, 4)
    order = leaf_order(table)
    gap, top = width / max(1, n), max((h for _, _, h in steps), default=1) or 1
    x = {leaf: (k + 0.5) * gap for k, leaf in enumerate(order)}
    y, out = dict.fromkeys(range(n), height - 30.0), []
    for k, (a, b, h) in enumerate(steps):
        level = (height - 30) * (1 - h / top) + 5
        out.append(f'<path d="M{x[a]:.1f} {y[a]:.1f}V{level:.1f}H{x[b]:.1f}V{y[b]:.1f}" fill="none" stroke="#444"/>')
        x[n + k], y[n + k] = (x[a] + x[b]) / 2, level
    text = [f'<text x="{x[k]:.1f}" y="{height - 10}" font-size="10" text-anchor="middle">{html.escape(labels[k])}</text>' for k in range(n)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(out + text)}</svg>'
