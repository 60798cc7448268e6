"""Merkle manifest of a dataset: a tree a lang over its rows by doc_id, a tree over the langs' subroots, and proofs that a recursive query climbs.

Rows are leaves. Eight consecutive nodes of a level have one parent, until one node is left. Each inner node is stored as a row that holds its children's digests and points at its own parent and
its place there. The climb is a recursive query from all leaves at once: each step joins the parents, replaces each leaf's slot by the digest folded so far, and appends the siblings as a row
of that level, so that no proof is carried from level to level; the eight leaves of a run share a row, as all siblings above their parent are the same to them. It has as many steps as the trees are deep: the logarithm, to base 8, of the rows and of the langs.

Places come from a range partitioning by lang, doc_id and digest: one count a partition moves the places within it, so no task sees a whole lang, however many rows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rillflow.llm.common import dropped, shuffle_partitions, written

#: Children of a node.
FAN = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
#: Tables of up to so many short rows may be broadcast; larger ones are shuffled.
BROADCAST_MOST = 1 << 16
#: Node ids: bits of a level's number, and the mark of the tree over langs.
LEVEL, TOP = 1 << 50, 1 << 62


def digest(*parts: Column) -> Column:
    """SHA-256 of texts one after the other, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def text_of(x: Column) -> Column:
    """Lowercase hex of bytes."""
    return F.lower(F.hex(x))


def leaf_of(text: Column) -> Column:
    """Digest of a row's fields, each `-` if null, else its UTF-8 byte count, a colon and its value, with this text."""
    field = lambda x: F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-"))
    return digest(*[field(F.col(c).cast("string")) for c in FIELDS[:-1]], field(text))


def placed(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df, written, with each row's place in the order of the columns by. Equal rows may change places."""
    ranged = df.repartitionByRange(shuffle_partitions(df.sparkSession), *by).sortWithinPartitions(*by)
    out = written(ranged.withColumn("_m", F.monotonically_increasing_id()), "placed")
    part = F.shiftrightunsigned("_m", 33)
    parts = out.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # one row a partition
    before = written(parts, "parts").selectExpr("_p", "coalesce(sum(_n) OVER (ORDER BY _p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _b")
    moved = out.withColumn("_p", part).join(F.broadcast(before), "_p")
    return moved.select(*df.columns, (F.col("_b") + F.col("_m").bitwiseAND((1 << 33) - 1)).alias(name))


def sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_MOST else df


def levels(nodes: DataFrame, most: int, first: int = 0) -> list[DataFrame]:
    """The inner nodes over nodes (tree, n, pos, digest; n: nodes of the tree), a written table a level.

    A row has tree, n and pos in its own level, id, its children's digests one after the other, its digest, and parent and place in the next level where n is over 1.
    """
    out, level = [], first
    while most > 1:
        level += 1
        up = F.floor(F.col("pos") / FAN).cast("long")
        runs = nodes.where("n > 1").groupBy("tree", "n", up.alias("pos")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("c"))
        hexes = F.array_join(F.transform("c.digest", text_of), "")
        runs = runs.select("tree", F.ceil(F.col("n") / FAN).cast("long").alias("n"), "pos", hexes.alias("_h")).select("*", F.unhex("_h").alias("children"), digest(F.col("_h")).alias("digest")).drop("_h")
        runs = runs.withColumns({"id": node_id(level, F.col("pos")), "parent": F.when(F.col("n") > 1, node_id(level + 1, F.floor(F.col("pos") / FAN).cast("long"))), "place": (F.col("pos") % FAN).cast("int")})
        nodes = written(runs, f"level-{level}")
        out.append(nodes)
        most = -(-most // FAN)
    return out


def node_id(level: int, pos: Column) -> Column:
    """Trees of langs are told apart by their first leaf's place among all leaves, which is below those of the trees behind it by more than any place within it."""
    return F.lit(level * LEVEL) + F.col("tree") + pos


CLIMB = """WITH RECURSIVE climb(run, level, at, place, leaves, siblings) AS (
  SELECT run, 0, at, CAST(NULL AS INT), leaves, CAST('' AS BINARY) FROM {starts}
  UNION ALL
  SELECT c.run, c.level + 1, n.parent, n.place,
    transform(c.leaves, x -> named_struct('leaf', x.leaf, 'slot', x.slot, 'place', n.place, 'folded',
      unhex(sha2(CAST(concat(lower(hex(substring(n.children, 1, 32 * x.place))), lower(hex(x.folded)), lower(hex(substring(n.children, 32 * x.place + 33)))) AS BINARY), 256)))),
    if(c.place IS NULL, n.children, concat(substring(n.children, 1, 32 * c.place), substring(n.children, 32 * c.place + 33)))
  FROM climb c JOIN {nodes} n ON c.at = n.id)
SELECT run, max_by(leaves, level) AS leaves, sort_array(collect_list(struct(level, siblings))) AS proof FROM climb GROUP BY run"""


def climbed(starts: DataFrame, nodes: DataFrame) -> DataFrame:
    """leaf, the digest folded up to the root, and proof, the digest of its siblings by level, of starts (leaf, at, place, folded): by a recursive query over nodes (id, children, parent, place).

    The leaves of a run climb in one row, each with its own digest: what is above their parent, and so what is appended there, is the same to them.
    """
    spark: SparkSession = starts.sparkSession
    runs = starts.groupBy("at").agg(F.collect_list(F.struct("leaf", F.coalesce("place", F.lit(0)).alias("slot"), "place", "folded")).alias("leaves")).select(F.coalesce("at", F.lit(-1)).alias("run"), "at", "leaves")
    key = "spark.sql.cteRecursionRowLimit"
    limit = spark.conf.get(key, None)
    spark.conf.set(key, "-1")  # a row a run and level; read while the query runs
    try:
        up = written(spark.sql(CLIMB, starts=runs, nodes=nodes), "climbed")
    finally:
        spark.conf.unset(key) if limit is None else spark.conf.set(key, limit)
    above = F.array_join(F.transform(F.slice("proof", 3, F.greatest(F.size("proof"), F.lit(1))), lambda x: text_of(x["siblings"])), "")
    each = up.select(F.explode("leaves").alias("x"), F.coalesce(F.get("proof.siblings", F.lit(1)), F.lit("").cast("binary")).alias("run"), above.alias("above"))
    others = lambda side: text_of(F.expr(side))
    return each.select("x.leaf", "x.folded", digest(others("substring(run, 1, 32 * x.slot)"), others("substring(run, 32 * x.slot + 33)"), F.col("above")).alias("proof"))


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """leaves (leaf, doc_id, tree, n, pos, digest, tampered, at, place), inner nodes (id, children, parent, place, digest), subroots (tree, lang, subroot, root) of docs, as tables in the shared folder.

    at and place are a leaf's parent and its place there, null if it is the root. tampered: the digest of a row whose text has its A-Z lower-cased, where 3 divides crc32(doc_id).
    """
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.col("text").cast("string")
    read = docs.select("doc_id", "lang", leaf_of(text).alias("digest"), F.when(hit, leaf_of(F.translate(text, UPPER, LOWER))).alias("tampered"))
    rows = written(read, "leaves")
    leaves = placed(rows, ["lang", "doc_id", "digest"], "leaf")
    found = written(leaves.groupBy("lang").agg(F.min("leaf").alias("tree"), F.count("*").alias("n")), "langs")
    count, most = found.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    langs = placed(found, ["tree"], "rank")
    leaves = leaves.join(sized(langs.withColumnRenamed("lang", "_lang"), count), F.col("lang").eqNullSafe(F.col("_lang"))).withColumn("pos", F.col("leaf") - F.col("tree"))
    own = levels(leaves.select("tree", "n", "pos", "digest"), most)
    # the last node of each tree of a lang, a lone leaf itself, is a leaf of the tree over langs
    heads = leaves.where("n = 1").select("tree", "digest")
    for x in own:
        heads = heads.unionByName(x.where("n = 1").select("tree", "digest"))
    heads = written(heads.join(langs.select("tree", "lang", "rank"), "tree"), "subroots")
    top = levels(heads.select(F.lit(TOP).alias("tree"), F.lit(count).cast("long").alias("n"), F.col("rank").alias("pos"), "digest"), count)
    above = lambda rank: F.when(F.lit(count > 1), F.lit(TOP + LEVEL) + F.floor(rank / FAN).cast("long"))
    columns = ["id", "children", "parent", "place", "digest"]
    ranks = sized(langs.select("tree", "rank"), count)
    nodes = None
    for x in own:
        linked = x.join(ranks, "tree").withColumns({"parent": F.coalesce("parent", above(F.col("rank"))), "place": F.when(F.col("n") > 1, F.col("place")).otherwise((F.col("rank") % FAN).cast("int"))}).select(*columns)
        nodes = linked if nodes is None else nodes.unionByName(linked)
    for x in top:
        nodes = x.select(*columns) if nodes is None else nodes.unionByName(x.select(*columns))
    if nodes is None:
        nodes = docs.sparkSession.createDataFrame([], "id long, children binary, parent long, place int, digest binary")
    lone = F.col("n") == 1
    at = F.when(lone, above(F.col("rank"))).otherwise(F.lit(LEVEL) + F.col("tree") + F.floor(F.col("pos") / FAN).cast("long"))
    leaves = leaves.select("leaf", "doc_id", "tree", "n", "pos", "digest", "tampered", at.alias("at"), F.when(lone, F.col("rank") % FAN).otherwise(F.col("pos") % FAN).cast("int").alias("place"))
    # one node is the root: the only subroot or the last level's only node
    root = (top[-1] if top else heads).select(F.col("digest").alias("root"))
    subroots = heads.select("tree", "lang", F.col("digest").alias("subroot")).crossJoin(F.broadcast(root))
    tables = [written(x, n) for x, n in ((leaves, "manifest-leaves"), (nodes, "manifest-nodes"), (subroots, "manifest-subroots"))]
    dropped(rows, found, heads, *own, *top)
    return tables[0], tables[1], tables[2]


def dataset_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs, digests as lowercase hex.

    Null fields are hashed as `-`; a null doc_id sorts first and is never tampered. An empty text is a text of 0 bytes. Rows of one doc_id follow each other by digest, and equal rows are leaves of
    their own, with equal digests. Very long texts are hashed whole. A table of one row has its leaf as subroot and root and the proof of no siblings; an empty table has no rows. Columns other than
    doc_id, source, lang, n_chars and text are not read.
    """
    leaves, nodes, subroots = manifest(docs.select(*FIELDS))
    starts = leaves.select("leaf", "at", "place", F.coalesce("tampered", "digest").alias("folded"))
    inner = nodes.select("id", "children", "parent", "place")
    up = climbed(starts, sized(inner, inner.count()))
    out = leaves.select("leaf", "doc_id", "tree", "digest").join(up, "leaf").join(sized(subroots, subroots.count()), "tree")
    return out.select(
        "doc_id", text_of(F.col("digest")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"), text_of(F.col("proof")).alias("proof_sha256"),
        text_of(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
