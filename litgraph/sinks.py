"""Outputs: CSV and text through Spark, network pages as self-contained HTML.

Ranked tables are bounded by their limits, so one file each is right. Pages draw trimmed graphs (max_graph_nodes).
"""

from __future__ import annotations

import html
import json
import os
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import layout

TERM_COLUMNS = ("term", "score", "corpus_count", "doc_freq")
PAPER_COLUMNS = ("pmid", "title", "year", "journal", "in_corpus_citations", "global_citations", "url")
AUTHOR_COLUMNS = ("author", "papers", "in_corpus_citations", "global_citations")


def write_csv(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
    return path


TRIAL_COLUMNS = ("arm", "review", "n_retrieved", "n_target", "hits", "precision", "recall", "f1")


def write_trials(scored: DataFrame, path: str) -> str:
    """One row per arm and review, in their order. Not put into one file: reviews may be any number."""
    scored.select(*TRIAL_COLUMNS).orderBy("arm", "review").write.mode("overwrite").option("header", True).csv(path)
    return path


def ranked_terms(ranked: DataFrame) -> DataFrame:
    return ranked.orderBy("rank").select("term", F.round("score", 4).alias("score"), "corpus_count", "doc_freq")


def pmid_lines(docs: DataFrame) -> DataFrame:
    """(value): bare pmids in corpus order, each once."""
    firsts = docs.where("pmid IS NOT NULL").groupBy("pmid").agg(F.min("doc_seq").alias("at"))
    return firsts.orderBy("at").select(F.col("pmid").alias("value"))


def write_pmids(docs: DataFrame, path: str) -> str | None:
    """Nothing is written if there is no pmid."""
    lines = pmid_lines(docs)
    if lines.isEmpty():
        return None
    lines.coalesce(1).write.mode("overwrite").text(path)
    return path


def sized(nodes: DataFrame, value: str, low: float, span: float) -> DataFrame:
    """``size`` = low + span * value / largest, over all nodes; all of size ``low`` if the largest is 0."""
    top = F.max(value).over(Window.partitionBy())
    return nodes.withColumn("size", F.lit(low) + F.lit(span) * F.when(top > 0, F.col(value) / top).otherwise(0.0))


def paper_view(nodes: DataFrame) -> DataFrame:
    lines = F.concat_ws("\n", F.nullif("title", F.lit("")), F.nullif(F.concat_ws(", ", F.nullif("journal", F.lit("")), F.nullif("year", F.lit(""))), F.lit("")), F.concat(F.lit("PMID "), "pmid"), F.concat(F.lit("cited in corpus: "), "in_corpus_citations"), F.concat(F.lit("cited overall: "), F.coalesce(F.col("global_citations").cast("string"), F.lit("unknown"))))
    seen = nodes.withColumn("value", F.col("in_corpus_citations") + 1).withColumn("tooltip", lines)
    return sized(seen.withColumnRenamed("pmid", "node"), "in_corpus_citations", 10, 30)


def author_view(nodes: DataFrame, value: str = "in_corpus_citations") -> DataFrame:
    lines = F.concat_ws("\n", "author", F.concat(F.lit("papers: "), "papers"), F.concat(F.lit("cited in corpus: "), "in_corpus_citations"), F.concat(F.lit("cited overall: "), "global_citations"))
    seen = nodes.withColumn("value", F.col(value) + 1).withColumn("tooltip", lines)
    return sized(seen.withColumnRenamed("author", "node"), value, 10, 30)


#: Nodes of a page that carry a label
LABELLED = 20
PAGE = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1>
<svg id="s" width="1100" height="800" viewBox="-1.15 -1.15 2.3 2.3"></svg><p>Colour: from few (pale) to many. Arrows point to what is cited.</p><script>
const G={data};const S=document.getElementById("s"),N="http://www.w3.org/2000/svg";let t=0;
function spin(p){{const c=Math.cos(t),s=Math.sin(t);return[p.x*c+p.z*s,p.y]}}
const D='<defs><marker id="m" viewBox="0 0 8 8" refX="8" refY="4" markerWidth="7" markerHeight="7" orient="auto"><path d="M0 0 8 4 0 8z" fill="#999"/></marker></defs>';
const shade=n=>"hsl(212,70%,"+(82-52*(n.size-10)/30)+"%)";
function draw(){{S.innerHTML=D;const at={{}};G.nodes.forEach(n=>at[n.node]=spin(n));
G.edges.forEach(e=>{{const l=document.createElementNS(N,"line"),a=at[e[0]],b=at[e[1]];if(!a||!b)return;
l.setAttribute("x1",a[0]);l.setAttribute("y1",a[1]);l.setAttribute("x2",b[0]);l.setAttribute("y2",b[1]);
l.setAttribute("stroke","#bbb");l.setAttribute("stroke-width",.002);l.setAttribute("marker-end","url(#m)");S.append(l)}});
G.nodes.forEach(n=>{{const c=document.createElementNS(N,"circle");c.setAttribute("cx",at[n.node][0]);c.setAttribute("cy",at[n.node][1]);
c.setAttribute("r",n.size/1500);c.setAttribute("fill",shade(n));const h=document.createElementNS(N,"title");h.textContent=n.tooltip;c.append(h);S.append(c);
if(n.label){{const x=document.createElementNS(N,"text");x.setAttribute("x",at[n.node][0]+.02);x.setAttribute("y",at[n.node][1]);x.setAttribute("font-size",.03);x.textContent=n.label;S.append(x)}}}})}}
draw();S.onmousemove=e=>{{if(e.buttons&&{spin}){{t+=e.movementX/150;draw()}}}};</script></body></html>
"""


def write_network(view: DataFrame, edges: DataFrame, path: str, title: str, three_d: bool = False, seed: int = 0) -> str:
    """A page with the graph laid out in shells; nodes carry size, tooltip and, the ``LABELLED`` largest, a label.
    ``edges`` (a, b) are drawn as arrows."""
    shell = layout.shells(view.select("node"), edges, seed)
    rows = view.select("node", "size", "tooltip").join(shell.select("node", "x", "y", "z"), "node").collect()
    large = {r["node"] for r in sorted(rows, key=lambda r: (-r["size"], r["node"]))[:LABELLED]}
    nodes = [{"node": r["node"], "label": r["tooltip"].split("\n")[0][:60] if r["node"] in large else "", "size": r["size"], "tooltip": r["tooltip"], "x": r["x"], "y": r["y"], "z": r["z"] if three_d else 0.0} for r in rows]
    data = json.dumps({"nodes": nodes, "edges": [[e["a"], e["b"]] for e in edges.collect()]}).replace("</", "<\\/")
    with open(path, "w", encoding="utf-8") as f:
        f.write(PAGE.format(title=html.escape(title), data=data, spin="true" if three_d else "false"))
    return path


def write_graphml(view: DataFrame, edges: DataFrame, path: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write('<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="v" for="node" attr.name="value" attr.type="long"/><graph edgedefault="directed">\n')
        for r in view.select("node", "value").collect():
            f.write(f"<node id={quoteattr(r['node'])}><data key=\"v\">{escape(str(r['value']))}</data></node>\n")
        for e in edges.collect():
            f.write(f"<edge source={quoteattr(e['a'])} target={quoteattr(e['b'])}/>\n")
        f.write("</graph></graphml>\n")
    return path


def write_scatter(points: DataFrame, clusters: DataFrame, path: str) -> str:
    """Terms in the plane of their two leading components, coloured by cluster."""
    rows = points.join(clusters.select("term", "cluster_id"), "term").collect()
    top = max((max(abs(r["x"]), abs(r["y"])) for r in rows), default=1.0) or 1.0
    dots = "".join(f'<circle cx="{r["x"] / top:.4f}" cy="{r["y"] / top:.4f}" r=".012" fill="hsl({(r["cluster_id"] * 67) % 360},{0 if r["cluster_id"] < 0 else 65}%,50%)"><title>{html.escape(r["term"])}</title></circle>' for r in rows)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!doctype html><meta charset="utf-8"><title>Term clusters</title><svg width="900" height="900" viewBox="-1.1 -1.1 2.2 2.2">{dots}</svg>\n')
    return path


def local(path: str) -> str:
    os.makedirs(path, exist_ok=True)
    return path
