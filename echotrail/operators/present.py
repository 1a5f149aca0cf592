"""Results as nested rows, JSON and tables of text."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names longer than this are cut.
NAME_LENGTH = 15


def short_name(name: str) -> str:
    return name if len(name) <= NAME_LENGTH else name[:NAME_LENGTH] + "..."


def results_json(results: DataFrame, links: DataFrame) -> DataFrame:
    """(match, json): entities with their roles, links with their flows, and the score of every result.

    ``links`` are aggregated links (match, role_a, role_b, num_edges, ...).
    """
    roles = sorted((c for c in results.columns if c.startswith("n_")), key=lambda c: int(c[2:]))
    entities = F.array(*[F.struct(F.lit(f"E{c[2:]}").alias("role"), F.col(c).cast("string").alias("uid")) for c in roles])
    own = F.array_sort(F.collect_list(F.struct("role_a", "role_b", "num_edges", "out_flow", "in_flow", "net_flow")))
    joined = results.join(links.groupBy("match").agg(own.alias("links")), "match", "left")
    return joined.select("match", F.to_json(F.struct(F.col("score"), entities.alias("entities"), F.coalesce("links", F.array()).alias("links"))).alias("json"))


def sankey(results: DataFrame, links: DataFrame, phases: DataFrame) -> DataFrame:
    """(match, json): nodes by name, and their links overall and phase by phase.

    A negative net flow turns a link around. Each phase lists every pair, with
    0 where nothing flowed in it; a link keeps its number.
    """
    roles = sorted((c for c in results.columns if c.startswith("n_")), key=lambda c: int(c[2:]))
    name = lambda c: F.when(F.length(F.col(c).cast("string")) > NAME_LENGTH, F.concat(F.substring(F.col(c).cast("string"), 1, NAME_LENGTH), F.lit("..."))).otherwise(F.col(c).cast("string"))
    nodes = results.select("match", F.array(*[F.struct(name(c).alias("name")) for c in roles]).alias("nodes"))
    pairs = links.select("match", "role_a", "role_b").distinct()
    steps = phases.select("match", F.col("phase").cast("int").alias("phase")).distinct()
    every = pairs.join(steps, "match").join(phases.select("match", "phase", "role_a", "role_b", "net_flow"), ["match", "phase", "role_a", "role_b"], "left")
    rows = links.select("match", F.lit(-1).alias("phase"), "role_a", "role_b", "net_flow").unionByName(every.select("match", "phase", "role_a", "role_b", "net_flow"))
    rows = rows.withColumn("net_flow", F.coalesce("net_flow", F.lit(0.0)))
    turned = F.col("net_flow") < 0
    link = F.struct("role_a", "role_b", F.when(turned, F.col("role_b")).otherwise(F.col("role_a")).alias("source"), F.when(turned, F.col("role_a")).otherwise(F.col("role_b")).alias("target"), F.abs("net_flow").alias("value"))
    listed = rows.groupBy("match", "phase").agg(F.array_sort(F.collect_list(link)).alias("l"))
    numbered = F.transform("l", lambda x, i: F.struct(i.alias("id"), x["source"].alias("source"), x["target"].alias("target"), x["value"].alias("value")))
    phased = listed.select("match", "phase", numbered.alias("l")).groupBy("match").agg(F.array_sort(F.collect_list(F.struct("phase", "l"))).alias("p"))
    joined = nodes.join(phased, "match", "left")
    return joined.select("match", F.to_json(F.struct("nodes", F.coalesce(F.col("p.l"), F.array()).alias("links"))).alias("json"))


def sankey_document(rows: list[tuple[int, str]], limit: int = 5) -> str:
    """One JSON document of a search's few results; match 0 is the query."""
    own = next((j for m, j in rows if m == 0), '{"nodes":[],"links":[]}')
    rest = [j for m, j in sorted(rows) if m != 0][:limit]
    return f'{{"query":{own},"results":[{",".join(rest)}]}}'


def text_table(results: list[dict]) -> str:
    """One line a result: the score, then role:node of every entity."""
    return "\n".join("\t".join([str(r["score"]), *[f"E{c[2:]}:{v}" for c, v in r.items() if c.startswith("n_")]]) for r in results)


def entity_table(entities: list[tuple[float, str, dict[str, str | None]]]) -> str:
    """An HTML table of (score, id, properties), a column for every property that occurs."""
    keys = sorted({k for _, _, p in entities for k in p})
    cell = lambda tag, x: f"<{tag}>{html.escape(str(x))}</{tag}>"
    head = "".join(cell("th", x) for x in ("Score", "ID", *keys))
    body = "".join("<tr>" + cell("td", s) + cell("td", u) + "".join(cell("td", "null" if k in p and p[k] is None else p.get(k, "")) for k in keys) + "</tr>" for s, u, p in entities)
    return f"<table><tr>{head}</tr>{body}</table>"


def time_plot_rows(links: DataFrame) -> DataFrame:
    """What a time plot draws: per transaction of a match its rows, direction, time and the match's fitting unit."""
    from pyspark.sql import Window as W

    ms = F.unix_millis(F.col("time").cast("timestamp"))
    whole = W.partitionBy("match")
    span = F.max(ms).over(whole) - F.min(ms).over(whole)
    unit = F.when(span >= 2 * 86_400_000, "days").when(span >= 2 * 3_600_000, "hours").when(span >= 2 * 60_000, "minutes").otherwise("seconds")
    return links.select("match", "time", "role_s", "role_t", "usd", F.when(F.col("role_s") < F.col("role_t"), "down").otherwise("up").alias("direction"), unit.alias("unit"))


def exemplar_query(ids: list[str]) -> dict:
    """A pattern descriptor with one role for each exemplar id."""
    roles = [{"uid": f"E{i}", "role": f"Entity Role {i}", "examplars": [x]} for i, x in enumerate(ids)]
    return {"uid": "PD0", "name": "Pattern Descriptor 0", "description": None, "entities": roles, "links": []}


def exemplars_of(descriptor: dict) -> list[str]:
    """The first exemplar of every role."""
    return [e["examplars"][0] for e in descriptor["entities"] if e.get("examplars")]
