"""A Merkle manifest of a dataset: a leaf for each row, a tree of runs of three for each source, and one over the sources.

Rows are numbered within their source by ranges of (source, doc_id), so no task holds a source. LEVELS levels of a tree are
built at once in blocks of 3^LEVELS neighbours: on level l a node stands in the row of its first leaf, and lag and lead by
3^l and 2 * 3^l rows, masked by the node's slot in its run and the length of the run, bring its siblings; the first child's
row hashes the parent. All levels of a block share one window, so they take one shuffle. Block roots are the nodes of the
next, 3^LEVELS times smaller step, until each tree has one root; sources' roots, in their order, are the leaves of the
last tree. Then proofs are handed down: a step's rows get their block root's path and put their own before it.

H is the lowercase hex sha256 of its inputs, one after the other; digests are put in as hex text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leaguelens.llm.common import checkpointed, join_counted, sums_before

#: Levels of a tree that a block holds, and leaves of a block.
LEVELS = 6
BLOCK = 3**LEVELS


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column, columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars")) -> Column:
    return hashed(*(encoded(F.col(c)) for c in columns), encoded(text))


def stage(nodes: DataFrame) -> DataFrame:
    """nodes (grp, pos, n, digest, ...) with `up`, the digest of the block's root, in the block's first row, and `own`, the
    siblings of the node and its ancestors in the block, lowest first, each as (left, right) texts.

    n: nodes of the group. A level of a group with one node only has no runs and no entry; a run of one has an empty one.
    """
    rows = nodes.withColumn("block", F.expr(f"pos div {BLOCK}"))
    order = Window.partitionBy("grp", "block").orderBy("pos")
    down = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_d0", F.col("digest"))
    for level in range(LEVELS):
        step, d = 3**level, F.col(f"_d{level}")
        rows = rows.withColumns({"_a2": F.lag(d, 2 * step).over(order), "_a1": F.lag(d, step).over(order), "_b1": F.lead(d, step).over(order), "_b2": F.lead(d, 2 * step).over(order)})
        slot, active, first = F.expr(f"(pos div {step}) % 3"), F.col("n") > step, F.col("pos") % (3 * step) == 0
        b1, b2 = F.coalesce("_b1", F.lit("")), F.coalesce("_b2", F.lit(""))  # a short run has no row there
        left = F.when(slot == 0, F.lit("")).when(slot == 1, F.col("_a1")).otherwise(F.concat("_a2", "_a1"))
        right = F.when(slot == 0, F.concat(b1, b2)).when(slot == 1, b1).otherwise(F.lit(""))
        rows = rows.withColumns(
            {
                f"_s{level}": F.when(active & d.isNotNull(), F.struct(left.alias("left"), right.alias("right"))),
                f"_d{level + 1}": F.when(first, F.when(active, hashed(d, b1, b2)).otherwise(d)),
            }
        ).drop("_a2", "_a1", "_b1", "_b2", f"_d{level}")
    # The last value so far on a level is that of the row's own ancestor, as all rows of a group have the same levels.
    path = F.array(*(F.last(f"_s{level}", ignorenulls=True).over(down) for level in range(LEVELS)))
    rows = rows.withColumn("own", F.filter(path, lambda s: s.isNotNull()))
    return rows.withColumnRenamed(f"_d{LEVELS}", "up").drop(*(f"_s{level}" for level in range(LEVELS)))


def ascend(nodes: DataFrame) -> list[DataFrame]:
    """nodes (grp, pos, n, digest, ...) and the smaller steps above, the last with one node for each group."""
    steps = [nodes]
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        up = stage(steps[-1].select("grp", "pos", "n", "digest")).where(F.col("pos") % BLOCK == 0)
        steps.append(checkpointed(up.select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("up").alias("digest"))))
        most = -(-most // BLOCK)
    return steps


def descend(steps: list[DataFrame], above: DataFrame) -> DataFrame:
    """The rows of the first of `steps`, each with `path`, all siblings from its level upwards, and the further columns of
    `above`, which has grp, the path of the group's root, and more that all rows of the group get."""
    more = [c for c in above.columns if c not in ("grp", "path")]
    found = steps[-1].join(above, "grp")
    for below in steps[-2::-1]:
        upper = found.select("grp", F.col("pos").alias("block"), F.col("path").alias("_upper"), *more)
        found = stage(below).join(upper, ["grp", "block"]).withColumn("path", F.concat("own", "_upper")).drop("own", "_upper", "up", "block")
    return found


def manifest(docs: DataFrame, tampered_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, path, altered: each row's leaf, the roots of its source and of all, its siblings on every
    level as (left, right) texts, and the leaf that `tampered_text` in place of its text would give.

    docs has doc_id, source, lang, n_chars and text; nulls count as `-`. A null source is a source of its own, the first. In a
    source a null doc_id comes first, and rows of one doc_id are ordered by their leaf, so the manifest doesn't depend on
    the order of the rows; repeated rows are leaves of their own. An empty table gives no rows. Further columns are
    ignored. Texts are read once and not shuffled.
    """
    text = F.col("text")
    leaves = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf(text).alias("digest"), (leaf(text) if tampered_text is None else F.when(tampered_text.eqNullSafe(text), F.lit(None)).otherwise(leaf(tampered_text))).alias("altered"))
    leaves = checkpointed(leaves.withColumn("altered", F.coalesce("altered", "digest")))
    one = F.lit(1).cast("long")
    told = leaves.withColumns({"_one": one, "key": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")), "_row": F.monotonically_increasing_id()})
    order = [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("_row")]
    numbered = sums_before(told, order, everything="_one").select("doc_id", "key", "digest", "altered", "everything")
    counted = told.groupBy("source", "key").agg(F.count("*").alias("n")).withColumn("_one", one)
    sources = checkpointed(sums_before(counted, [F.col("source").asc_nulls_first()], grp="_one", start="n").select("key", "n", "grp", "start"))
    n_rows, n_sources = sources.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    placed = join_counted(numbered, sources.withColumn("nodes", F.col("n")), "key", "n", n_rows)
    steps = ascend(placed.select("grp", (F.col("everything") - F.col("start")).alias("pos"), F.col("nodes").alias("n"), "digest", "doc_id", "altered"))
    subroots = steps[-1].select(F.lit(0).cast("long").alias("grp"), F.col("grp").alias("pos"), F.lit(n_sources).cast("long").alias("n"), "digest")
    over = ascend(subroots)
    top = over[-1].select("grp", F.expr("cast(array() as array<struct<left:string,right:string>>)").alias("path"), F.col("digest").alias("root"))
    of_sources = descend(over, top).select(F.col("pos").alias("grp"), "path", F.col("digest").alias("subroot"), "root")
    return descend(steps, of_sources).select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "path", "altered")


def proof(path: Column) -> Column:
    """H of all siblings of a path, level by level upwards, from left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda s: F.concat(s.left, s.right))).cast("binary"), 256)


def folded(path: Column, start: Column) -> Column:
    """The root that a leaf `start` gives with the siblings of `path`."""
    return F.aggregate(path, start, lambda h, s: hashed(s.left, h, s.right))


def verified(rows: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of the rows of a manifest."""
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("path"), F.col("altered")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Every document's place in the manifest, checked against a copy in which half of the texts lost their line breaks.

    A row without doc_id isn't tampered with."""
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return verified(manifest(spark.read.parquet(f"{sf_dir}/documents.parquet"), cut))


def _sql() -> str:
    def enc(x: str) -> str:
        return f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || CAST({x} AS VARCHAR) END"

    head = " || ".join(enc(c) for c in ("doc_id", "source", "lang", "n_chars"))
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: list_transform(range(8), lambda i: (ascii(ch) >> i::INTEGER) & 1)))::BIGINT[]), lambda c, b: xor(c >> 1, 3988292384::BIGINT * (xor(c, b) & 1))), 4294967295::BIGINT)"

    def tree(name: str, base: str) -> str:
        return f"""{name}(lvl, grp, pos, n, digest) AS ({base}
 UNION ALL SELECT lvl + 1, grp, pos // 3, (n + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM {name} WHERE n > 1 GROUP BY lvl, grp, pos // 3, n)"""

    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, source, sha256({head} || {enc('text')}) AS leaf,
  CASE WHEN {crc} % 2 = 0 THEN sha256({head} || {enc("replace(text, chr(10), '')")}) ELSE sha256({head} || {enc('text')}) END AS altered FROM documents),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS grp,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
{tree('t', 'SELECT 0, grp, pos, n, leaf FROM p')},
sub AS (SELECT grp, digest, count(*) OVER () AS n FROM t WHERE n = 1),
{tree('u', 'SELECT 0, 0, grp, n, digest FROM sub')},
runs AS (SELECT 0 AS part, lvl, grp, pos // 3 AS run, list(digest ORDER BY pos) AS members FROM t WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT 1, lvl, 0, pos // 3, list(digest ORDER BY pos) FROM u WHERE n > 1 GROUP BY ALL),
deep AS (SELECT part, grp, max(lvl) + 1 AS levels FROM runs GROUP BY part, grp),
f(r, grp, part, lvl, spot, h, siblings) AS (SELECT r, grp, 0, 0, pos, altered, '' FROM p
  UNION ALL SELECT f.r, f.grp, CASE WHEN m.members IS NULL THEN f.part + 1 ELSE f.part END, CASE WHEN m.members IS NULL THEN 0 ELSE f.lvl + 1 END,
   CASE WHEN m.members IS NULL THEN f.grp ELSE f.spot // 3 END,
   CASE WHEN m.members IS NULL THEN h ELSE sha256(array_to_string(list_transform(m.members, lambda x, i: CASE WHEN i = f.spot % 3 + 1 THEN h ELSE x END), '')) END,
   siblings || coalesce(array_to_string(list_filter(m.members, lambda x, i: i <> f.spot % 3 + 1), ''), '')
  FROM f LEFT JOIN runs m ON m.part = f.part AND m.lvl = f.lvl AND m.run = f.spot // 3 AND m.grp = CASE WHEN f.part = 0 THEN f.grp ELSE 0 END WHERE f.part < 2)
SELECT doc_id, leaf, sub.digest AS subroot, root.digest AS root, sha256(siblings) AS proof_sha256, h AS folded_root, h = root.digest AS verified
FROM p JOIN f USING (r) JOIN sub ON sub.grp = p.grp JOIN (SELECT digest FROM u WHERE n = 1) root ON true WHERE f.part = 2
"""


OP12_SQL = _sql()
