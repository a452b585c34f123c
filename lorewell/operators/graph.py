"""Notes as a graph: links, tags and headers taken from texts, traversal, PageRank, maintenance.

Iterations carry slim frames and cut their lineage in the shared checkpoint folder each round. Edge
identifiers of stored tables and nodes made here follow one rule (note:, note_ref:, tag:), so a real note
does have backlinks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorewell.functions import model as m
from lorewell.functions import text as t
from lorewell.session import checkpoint

# The notations of notes.
WIKILINK = r"\[\[([^\]\|]+)(?:\|([^\]]+))?\]\]"
TAG = r"#([\w/\-]+)"
HEADER = r"(?m)^(#{1,6})[ \t]+(\S.*)$"
DAMPING, ROUNDS, HOPS = 0.85, 10, 2
MOST_ROUNDS, TOLERANCE = 100, 1e-6
QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def notes(spark: SparkSession, folder: str) -> DataFrame:
    return m.documents(spark, folder).where("extraction_method = 'obsidian_graph_rag' and text is not null")


_NOTES_SQL = "(SELECT * FROM documents WHERE extraction_method = 'obsidian_graph_rag' AND text IS NOT NULL)"


@query(
    "gr1_wikilinks",
    rf"""WITH l AS (SELECT doc_id, 'note:' || file_path AS note, 'note_ref:' || trim(unnest(regexp_extract_all(text, '\[\[([^\]\|]+)(?:\|([^\]]+))?\]\]', 1))) AS ref FROM {_NOTES_SQL})
      SELECT note AS source_id, ref AS target_id, 'wikilink' AS edge_type, count(*) AS n FROM l GROUP BY ALL UNION ALL SELECT ref, note, 'backlink', count(*) FROM l GROUP BY ALL""",
)
def wikilinks(spark: SparkSession, folder: str) -> DataFrame:
    """Edges from each note to what it links, and back; n is the number of occurrences."""
    links = notes(spark, folder).select(
        F.concat(F.lit("note:"), "file_path").alias("note"), F.explode(F.regexp_extract_all("text", F.lit(WIKILINK), 1)).alias("ref")
    ).withColumn("ref", F.concat(F.lit("note_ref:"), F.trim("ref")))
    counted = links.groupBy("note", "ref").agg(F.count("*").alias("n"))
    out = counted.select(F.col("note").alias("source_id"), F.col("ref").alias("target_id"), F.lit("wikilink").alias("edge_type"), "n")
    return out.unionByName(counted.select(F.col("ref").alias("source_id"), F.col("note").alias("target_id"), F.lit("backlink").alias("edge_type"), "n"))


@query("gr2_tags", rf"SELECT DISTINCT 'note:' || file_path AS source_id, 'tag:' || unnest(regexp_extract_all(text, '#([\w/\-]+)', 1)) AS target_id FROM {_NOTES_SQL}")
def tags(spark: SparkSession, folder: str) -> DataFrame:
    found = notes(spark, folder).select("file_path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(TAG), 1))).alias("tag"))
    return found.select(F.concat(F.lit("note:"), "file_path").alias("source_id"), F.concat(F.lit("tag:"), "tag").alias("target_id"))


@query(
    "gr3_header_tree",
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM {_NOTES_SQL}),
      h AS (SELECT doc_id, line_no, length(regexp_extract(line, '^(#{{1,6}})[ \t]+\S', 1)) AS level, regexp_extract(line, '^#{{1,6}}[ \t]+(\S.*?)\s*$', 1) AS title, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS place
        FROM l WHERE regexp_matches(line, '^#{{1,6}}[ \t]+\S'))
      SELECT a.doc_id, a.place, a.level, a.title, (SELECT max(b.place) FROM h b WHERE b.doc_id = a.doc_id AND b.place < a.place AND b.level < a.level) AS parent FROM h a""",
)
def header_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Each header with the nearest earlier header of a lower level. The tree is built inside the row of its note: no shuffle."""
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"^#{1,6}[ \t]+\S"))
    heads = F.transform(
        lines, lambda x: F.struct(F.length(F.regexp_extract(x, r"^(#{1,6})", 1)).alias("level"), F.regexp_extract(x, r"^#{1,6}[ \t]+(\S.*?)\s*$", 1).alias("title"))
    )
    rows = notes(spark, folder).select("doc_id", heads.alias("heads")).where(F.size("heads") > 0)
    each = rows.select("doc_id", "heads", F.posexplode("heads").alias("at", "head"))
    # The highest earlier place with a lower level.
    parent = F.expr("aggregate(sequence(0, greatest(at - 1, 0)), cast(null as int), (best, i) -> if(i < at and heads[i].level < head.level, i + 1, best))")
    return each.select("doc_id", (F.col("at") + 1).cast("long").alias("place"), F.col("head.level").cast("long").alias("level"), F.col("head.title").alias("title"), parent.cast("long").alias("parent"))


@query("gr4_note_nodes", rf"SELECT 'note:' || file_path AS node_id, left(text, 200) AS preview, length(text) AS size, regexp_matches(text, '\A---\n') AS has_frontmatter FROM {_NOTES_SQL}")
def note_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of notes; the preview of 200 characters is the feature."""
    return notes(spark, folder).select(
        F.concat(F.lit("note:"), "file_path").alias("node_id"), F.substring("text", 1, 200).alias("preview"), F.length("text").cast("long").alias("size"), F.col("text").rlike(r"\A---\n").alias("has_frontmatter")
    )


def reach(edges: DataFrame, starts: DataFrame, hops: int = HOPS) -> DataFrame:
    """(start_id, node_id, hops): nodes reached over out-edges, the start left out; each round joins the new frontier only."""
    out = edges.where("source_id is not null and target_id is not null").select("source_id", "target_id").distinct()
    seen = starts.select(F.col("node_id").alias("start_id"), "node_id", F.lit(0).alias("hops"))
    frontier = seen
    for hop in range(1, hops + 1):
        new = frontier.select("start_id", F.col("node_id").alias("source_id")).join(out, "source_id").select("start_id", F.col("target_id").alias("node_id")).distinct()
        frontier = checkpoint(new.join(seen.select("start_id", "node_id"), ["start_id", "node_id"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


@query(
    "gr5_two_hops",
    f"""WITH e AS (SELECT DISTINCT source_id, target_id FROM graph_edges WHERE edge_type = 'wikilink' AND source_id IS NOT NULL AND target_id IS NOT NULL),
      one AS (SELECT DISTINCT source_id AS start_id, target_id AS node_id FROM e WHERE source_id <> target_id AND source_id IN (SELECT node_id FROM graph_nodes WHERE node_type = 'note')),
      two AS (SELECT DISTINCT o.start_id, e.target_id AS node_id FROM one o JOIN e ON e.source_id = o.node_id WHERE e.target_id <> o.start_id)
      SELECT start_id, node_id, CAST(min(hops) AS INTEGER) AS hops FROM (SELECT *, 1 AS hops FROM one UNION ALL SELECT *, 2 FROM two) GROUP BY ALL""",
)
def two_hops(spark: SparkSession, folder: str) -> DataFrame:
    starts = m.nodes(spark, folder).where("node_type = 'note'").select("node_id")
    return reach(m.table(spark, folder, "graph_edges").where("edge_type = 'wikilink'"), starts)


@query("gr6_backlinks", f"SELECT target_id, source_id, count(*) AS n FROM {m.EDGES_SQL} WHERE edge_type = 'wikilink' AND target_id IS NOT NULL GROUP BY ALL")
def backlinks(spark: SparkSession, folder: str) -> DataFrame:
    return m.edges(spark, folder).where("edge_type = 'wikilink' and target_id is not null").groupBy("target_id", "source_id").agg(F.count("*").alias("n"))


@query("gr7_notes_by_tag", f"SELECT target_id AS tag, count(DISTINCT source_id) AS notes, min(source_id) AS first_note FROM {m.EDGES_SQL} WHERE edge_type = 'tag' AND target_id IS NOT NULL GROUP BY ALL")
def notes_by_tag(spark: SparkSession, folder: str) -> DataFrame:
    """Counted map-side: a tag that most notes have is no hot key."""
    pairs = m.table(spark, folder, "graph_edges").where("edge_type = 'tag' and target_id is not null").select("source_id", "target_id").distinct()
    return pairs.groupBy(F.col("target_id").alias("tag")).agg(F.count("source_id").alias("notes"), F.min("source_id").alias("first_note"))


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = MOST_ROUNDS, damping: float = DAMPING, tolerance: float | None = TOLERANCE) -> DataFrame:
    """(node_id, rank); parallel edges weigh together, dangling rank is spread evenly.

    Ends when the ranks change by less than `tolerance` a node in all; that they still do after `rounds` rounds
    is an error. With the tolerance None exactly `rounds` rounds are made.
    """
    weights = edges.groupBy("source_id", "target_id").agg(F.count("*").alias("w"))
    out = weights.groupBy("source_id").agg(F.sum("w").alias("all"))
    share = checkpoint(weights.join(out, "source_id").select("source_id", "target_id", (F.col("w") / F.col("all")).alias("share")))
    n = nodes.count()
    ranks = nodes.select("node_id", F.lit(1.0 / max(n, 1)).alias("rank"))
    has_out = checkpoint(nodes.join(out.select(F.col("source_id").alias("node_id"), F.lit(True).alias("linked")), "node_id", "left").select("node_id", F.coalesce("linked", F.lit(False)).alias("linked")))
    for _ in range(rounds):
        earlier = ranks
        lost = ranks.join(has_out, "node_id").where(~F.col("linked")).agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = share.join(ranks.withColumnRenamed("node_id", "source_id"), "source_id").groupBy(F.col("target_id").alias("node_id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        ranks = checkpoint(
            nodes.join(got, "node_id", "left").crossJoin(F.broadcast(lost))  # one number
            .select("node_id", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)).alias("rank"))
        )
        if tolerance is not None:
            change = ranks.join(earlier.withColumnRenamed("rank", "was"), "node_id").agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
            if (change or 0.0) < tolerance * n:
                return ranks
    if tolerance is not None and n:
        raise RuntimeError(f"ranks still change after {rounds} rounds")
    return ranks


_RANK_SQL = "r0 AS (SELECT node_id, 1e0 / (SELECT count(*) FROM v) AS rank FROM v)" + "".join(
    f""", r{i} AS (SELECT v.node_id, 0.15e0 / (SELECT count(*) FROM v) + 0.85e0 * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{i - 1} WHERE node_id NOT IN (SELECT source_id FROM sh)) / (SELECT count(*) FROM v)) AS rank
      FROM v LEFT JOIN (SELECT target_id, sum(share * rank) AS got FROM sh JOIN r{i - 1} ON r{i - 1}.node_id = sh.source_id GROUP BY target_id) g ON g.target_id = v.node_id)""" for i in range(1, ROUNDS + 1)
)
_SHARE_SQL = f"""v AS MATERIALIZED (SELECT DISTINCT node_id FROM graph_nodes), w AS (SELECT source_id, target_id, count(*) AS w FROM {m.EDGES_SQL} WHERE source_id IN (SELECT node_id FROM v) AND target_id IN (SELECT node_id FROM v) GROUP BY ALL),
  sh AS MATERIALIZED (SELECT source_id, target_id, w / CAST(sum(w) OVER (PARTITION BY source_id) AS DOUBLE) AS share FROM w)"""


@query("gr8_pagerank", f"WITH {_SHARE_SQL}, {_RANK_SQL.replace(' AS (SELECT v.', ' AS MATERIALIZED (SELECT v.')} SELECT node_id, round(rank, 9) AS rank FROM r{ROUNDS}")
def ranked_nodes(spark: SparkSession, folder: str) -> DataFrame:
    v = checkpoint(m.table(spark, folder, "graph_nodes").select("node_id").distinct())
    e = m.edges(spark, folder).select("source_id", "target_id")
    e = e.join(v.withColumnRenamed("node_id", "source_id"), "source_id", "left_semi").join(v.withColumnRenamed("node_id", "target_id"), "target_id", "left_semi")
    # A fixed number of rounds, which the SQL unrolls.
    return pagerank(e, v, ROUNDS, tolerance=None).select("node_id", F.round("rank", 9).alias("rank"))


@query("gr10_latest_nodes", f"SELECT node_id, node_type, title FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY created_at DESC NULLS LAST, coalesce(content, '')) AS r FROM {m.NODES_SQL}) WHERE r = 1")
def latest_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Upsert: of several rows for a node the newest wins."""
    newest = Window.partitionBy("node_id").orderBy(F.desc_nulls_last("created_at"), F.coalesce("content", F.lit("")))
    return m.table(spark, folder, "graph_nodes").withColumn("r", F.row_number().over(newest)).where("r = 1").select("node_id", "node_type", "title")


@query("gr10_edges_by_end", f"SELECT node_id, sum(o) AS out_edges, sum(i) AS in_edges FROM (SELECT source_id AS node_id, 1 AS o, 0 AS i FROM {m.EDGES_SQL} UNION ALL SELECT target_id, 0, 1 FROM {m.EDGES_SQL}) WHERE node_id IS NOT NULL GROUP BY ALL".replace("sum(o)", "CAST(sum(o) AS BIGINT)").replace("sum(i)", "CAST(sum(i) AS BIGINT)"))
def edges_by_end(spark: SparkSession, folder: str) -> DataFrame:
    e = m.edges(spark, folder)
    ends = e.select(F.col("source_id").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("target_id").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.where("node_id is not null").groupBy("node_id").agg(F.sum("o").alias("out_edges"), F.sum("i").alias("in_edges"))


@query(
    "gr11_after_note_deletion",
    f"""WITH gone AS (SELECT DISTINCT record_key AS k FROM deletion_log WHERE table_name = 'graph_nodes'),
      kept AS (SELECT node_id, node_type FROM {m.NODES_SQL} WHERE node_id NOT IN (SELECT k FROM gone) AND regexp_replace(node_id, ':h[0-9]+$', '') NOT IN (SELECT k FROM gone)),
      held AS (SELECT target_id FROM graph_edges WHERE source_id IN (SELECT node_id FROM kept) AND target_id IS NOT NULL)
      SELECT node_id, node_type FROM kept WHERE node_type NOT IN ('tag', 'note_ref') OR node_id IN (SELECT target_id FROM held)""",
)
def after_note_deletion(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes that stay when the logged nodes are deleted with their headers, and then tags and placeholders that nothing points to."""
    gone = m.table(spark, folder, "deletion_log").where("table_name = 'graph_nodes'").select(F.col("record_key").alias("k")).distinct()
    n = m.nodes(spark, folder).select("node_id", "node_type", F.regexp_replace("node_id", ":h[0-9]+$", "").alias("note"))
    kept = n.join(gone, n["node_id"] == gone["k"], "left_anti").join(gone, F.col("note") == gone["k"], "left_anti").drop("note")
    held = m.table(spark, folder, "graph_edges").where("target_id is not null").join(kept.select(F.col("node_id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("node_id")).distinct()
    loose = F.col("node_type").isin("tag", "note_ref")
    return kept.where(~loose | F.col("node_type").isNull()).unionByName(kept.where(loose).join(held, "node_id", "left_semi"))


@query("gr12_renamed_paths", f"SELECT id, replace(source_id, 'kb/vault-', 'kb/notes-') AS source_id, replace(target_id, 'kb/vault-', 'kb/notes-') AS target_id FROM {m.EDGES_SQL}")
def renamed_paths(spark: SparkSession, folder: str) -> DataFrame:
    change = lambda c: F.replace(F.col(c), F.lit("kb/vault-"), F.lit("kb/notes-")).alias(c)
    return m.edges(spark, folder).select("id", change("source_id"), change("target_id"))


@query("gr13_chunks_per_node", f"SELECT node_id, coalesce(link_type, 'primary') AS link_type, count(DISTINCT chunk_id) AS chunks FROM {m.LINKS_SQL} GROUP BY ALL")
def chunks_per_node(spark: SparkSession, folder: str) -> DataFrame:
    return m.links(spark, folder).groupBy("node_id", F.coalesce("link_type", F.lit("primary")).alias("link_type")).agg(F.count_distinct("chunk_id").alias("chunks"))


FOOTER_SQL = rf"""WITH n AS (SELECT d.doc_id, coalesce(g.title, regexp_replace(regexp_extract(file_path, '[^/]*$'), '^(.+)\.[^.]*$', '\1')) AS title, regexp_replace(regexp_extract(file_path, '[^/]*$'), '^(.+)\.[^.]*$', '\1') AS note,
        list_distinct(regexp_extract_all(text, '#([\w/\-]+)', 1)) AS tags, list_transform(regexp_extract_all(text, '\[\[([^\]\|]+)(?:\|([^\]]+))?\]\]', 1), lambda x: trim(x)) AS links
        FROM {_NOTES_SQL} d LEFT JOIN (SELECT node_id, min(title) AS title FROM graph_nodes WHERE node_type = 'note' GROUP BY node_id) g ON g.node_id = 'note:' || d.file_path),
      l AS (SELECT DISTINCT doc_id, title, ref FROM (SELECT doc_id, title, unnest(links) AS ref FROM n)),
      b AS (SELECT n.doc_id, l.doc_id AS from_id, l.title AS near FROM l JOIN n ON n.title = l.ref WHERE n.doc_id <> l.doc_id),
      c AS (SELECT doc_id, count(DISTINCT from_id) AS linked FROM b GROUP BY doc_id),
      r AS (SELECT doc_id, list(near ORDER BY near) AS near FROM (SELECT doc_id, ref AS near FROM l WHERE ref <> title UNION SELECT b.doc_id, b.near FROM b JOIN n USING (doc_id) WHERE b.near <> n.title) GROUP BY doc_id)
      SELECT n.doc_id, '---' || chr(10) || 'Note: ' || note
        || CASE WHEN len(tags) > 0 THEN chr(10) || 'Tags: ' || array_to_string(list_transform(list_sort(tags), lambda x: '#' || x), ', ') ELSE '' END
        || CASE WHEN len(links) > 0 THEN chr(10) || 'Links to: ' || array_to_string(links[1:5], ', ') || CASE WHEN len(links) > 5 THEN ' (+' || (len(links) - 5) || ' more)' ELSE '' END ELSE '' END
        || CASE WHEN linked > 0 THEN chr(10) || 'Linked from: ' || linked || ' notes' ELSE '' END
        || CASE WHEN len(near) > 0 THEN chr(10) || 'Related notes: ' || array_to_string(near[1:3], ', ') || CASE WHEN len(near) > 3 THEN '...' ELSE '' END ELSE '' END AS footer
      FROM n LEFT JOIN c ON c.doc_id = n.doc_id LEFT JOIN r ON r.doc_id = n.doc_id"""


def footers(texts: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(doc_id, footer) of notes (doc_id, file_path, text): name, tags, first five links, how many notes link to it, first three related notes.

    Notes are linked by their titles (nodes: (node_id, title); the file name where there is none). Related are
    the linked titles and those of the notes that link to it, in alphabetical order. Links are counted and the
    first four titles taken before anything is gathered, so a note that all others link to is no hot row.
    """
    n = texts.select(
        "doc_id", "file_path", t.stem("file_path").alias("note"), F.sort_array(F.array_distinct(F.regexp_extract_all("text", F.lit(TAG), 1))).alias("tags"),
        F.transform(F.regexp_extract_all("text", F.lit(WIKILINK), 1), F.trim).alias("links"),
    )
    if nodes is None:
        n = n.withColumn("title", F.col("note"))
    else:
        named = nodes.groupBy("node_id").agg(F.min("title").alias("named"))
        n = n.join(named, F.concat(F.lit("note:"), "file_path") == F.col("node_id"), "left").withColumn("title", F.coalesce("named", "note"))
    n = checkpoint(n.select("doc_id", "note", "title", "tags", "links"))
    links = n.select("doc_id", "title", F.explode("links").alias("ref")).distinct()
    titles = n.select(F.col("doc_id").alias("to_id"), F.col("title").alias("ref"))
    back = links.join(titles, "ref").where("doc_id <> to_id").select(F.col("to_id").alias("doc_id"), F.col("ref").alias("own"), F.col("doc_id").alias("from_id"), F.col("title").alias("near"))
    linked = back.groupBy("doc_id").agg(F.count_distinct("from_id").alias("linked"))
    near = links.where("ref <> title").select("doc_id", F.col("ref").alias("near")).unionByName(back.where("near <> own").select("doc_id", "near")).distinct()
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("near"))
    near = near.withColumn("at", at).where("at <= 4").groupBy("doc_id").agg(F.sort_array(F.collect_list("near")).alias("near"))
    n = n.join(linked, "doc_id", "left").join(near, "doc_id", "left")
    more = F.when(F.size("links") > 5, F.concat(F.lit(" (+"), (F.size("links") - 5).cast("string"), F.lit(" more)"))).otherwise("")
    tag_line = F.when(F.size("tags") > 0, F.concat(F.lit("\nTags: "), F.array_join(F.transform("tags", lambda x: F.concat(F.lit("#"), x)), ", "))).otherwise("")
    link_line = F.when(F.size("links") > 0, F.concat(F.lit("\nLinks to: "), F.array_join(F.slice("links", 1, 5), ", "), more)).otherwise("")
    from_line = F.when(F.col("linked") > 0, F.concat(F.lit("\nLinked from: "), F.col("linked").cast("string"), F.lit(" notes"))).otherwise("")
    near_line = F.when(F.size("near") > 0, F.concat(F.lit("\nRelated notes: "), F.array_join(F.slice("near", 1, 3), ", "), F.when(F.size("near") > 3, "...").otherwise(""))).otherwise("")
    return n.select("doc_id", F.concat(F.lit("---\nNote: "), "note", tag_line, link_line, from_line, near_line).alias("footer"))


@query("gr14_context_footer", FOOTER_SQL)
def context_footer(spark: SparkSession, folder: str) -> DataFrame:
    """What is appended to each chunk of a note."""
    titles = m.table(spark, folder, "graph_nodes").where("node_type = 'note'").select("node_id", "title")
    return footers(notes(spark, folder), titles)


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Write the graph as JSON lines; the kind of an edge is always called edge_type."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def import_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    edges = spark.read.json(f"{path}/edges")
    if "type" in edges.columns and "edge_type" not in edges.columns:
        edges = edges.withColumnRenamed("type", "edge_type")
    return spark.read.json(f"{path}/nodes"), edges
