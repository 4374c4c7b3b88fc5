"""Exports: JSON, a self-contained HTML page, and a Markdown report.

The tables of an export are written by Spark; the driver only fills templates with top-k rows and counts.
"""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators import lookup


def export_json(entities: DataFrame, edges: DataFrame, out: str) -> None:
    """Writes ``nodes`` and ``links`` as JSON lines below ``out``; dangling edges are left out."""
    nodes, links = lookup.nodes_and_links(entities, edges)
    nodes.write.mode("overwrite").json(f"{out}/nodes")
    links.write.mode("overwrite").json(f"{out}/links")


def export_html(entities: DataFrame, edges: DataFrame, out: str) -> str:
    """Writes the whole graph as script files below ``out`` and returns the page that loads them, to be saved there.

    Spark writes a call per node and link, in as many files as there are partitions; the page only names the files.
    """
    parts = []
    for name, df in zip(("nodes", "links"), lookup.nodes_and_links(entities, edges)):
        row = F.regexp_replace(F.to_json(F.struct(*df.columns)), "<", "\\\\u003c")
        df.select(F.concat(F.lit(f"graph.{name}.push("), row, F.lit(");")).alias("value")).write.mode("overwrite").text(f"{out}/{name}")
        files = df.sparkSession.read.text(f"{out}/{name}").inputFiles()
        parts += [f'<script src="{name}/{path.rsplit("/", 1)[-1]}"></script>' for path in sorted(files)]
    head = '<!doctype html><meta charset="utf-8"><title>Call graph</title><script>const graph = {nodes: [], links: []};</script>'
    return "\n".join([head, *parts]) + "\n"


def markdown_report(entities: DataFrame, edges: DataFrame, title: str) -> str:
    """Counts, best connected entities, largest files and calls between folders."""
    counts = lookup.graph_counts(entities, edges).first()
    god = lookup.god_nodes(entities, edges).collect()
    files = lookup.largest_files(entities).collect()
    cross = lookup.cross_module_edges(entities, edges, by_folder=True).collect()
    lines = [
        f"# {html.escape(title)}",
        "",
        f"- entities: {counts['n_entities']} in {counts['n_files']} files, {counts['n_languages']} languages",
        f"- tests: {counts['n_tests']}",
        f"- calls: {counts['n_edges']}",
        "",
        "## Most connected",
        *([f"- `{r['id']}`: {r['degree']}" for r in god] or ["none"]),
        "",
        "## Largest files",
        *([f"- `{r['file_path']}`: {r['n_entities']}" for r in files] or ["none"]),
        "",
        "## Calls between folders",
        *([f"- `{r['src']}` to `{r['dst']}`" for r in cross] or ["none"]),
    ]
    return "\n".join(lines) + "\n"
