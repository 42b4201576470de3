"""A Merkle manifest of a dataset: one tree a group, one tree over the groups, and every row's authentication path.

Rows become leaves inside the row, so only digests move. A tree is cut into aligned blocks of ARITY ** BLOCK_LEVELS
nodes. A block's root comes from one treehash stack; the roots are the nodes of the next, far smaller round, until
one node a tree is left. On the way back each block learns the path that its root has further up, once for all of its
nodes, and walks its own leaves in order: at every level a treehash stack that runs one node a step builds the
siblings of the run to come, so that they are ready when the walk enters it. So a block of n nodes keeps siblings and
stacks of its log n levels beside the nodes themselves, and a tree that holds a third of all rows is many blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import ship
from .common import cut, partitions

#: Nodes that become one, levels of a block (729 nodes), and (tree, part) pairs up to which they are broadcast.
ARITY, BLOCK_LEVELS, SMALL = 3, 6, 100_000
PATH = "array<struct<place:int,others:string>>"
PATH_TYPE = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.string())]))


def node(digests: Sequence[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def leaf(*fields: Column) -> Column:
    """The digest of a row: each field as its length in UTF-8 bytes, a colon and its text; a minus sign where it is null."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[one(c) for c in fields]), 256)


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path, inside the row."""
    start = F.when(digest.isNotNull() & path.isNotNull(), digest)
    return F.aggregate(path, start, lambda d, s: F.sha2(F.concat(F.substring(s["others"], F.lit(1), s["place"] * 64), d, F.substring(s["others"], s["place"] * 64 + 1, F.length(s["others"]))), 256))


class Treehash:
    """A stack of unfinished runs: nodes go in one by one, the nodes of the levels above come out as they are complete.

    done(level, digest) is told of each node above the lowest level; keeps at most ARITY - 1 nodes a level.
    """

    def __init__(self, levels: int, done=lambda level, digest: None):
        self.runs: list[list[str]] = [[] for _ in range(levels + 1)]
        self.levels, self.done = levels, done

    def push(self, digest: str, level: int = 0) -> None:
        while True:
            run = self.runs[level]
            run.append(digest)
            if level == self.levels or len(run) < ARITY:
                return
            digest, level = node(run), level + 1
            run.clear()
            self.done(level, digest)

    def close(self) -> list[str]:
        """The nodes of the highest level, runs that stayed short included."""
        for level in range(self.levels):
            if self.runs[level]:
                digest = node(self.runs[level])
                self.runs[level].clear()
                self.done(level + 1, digest)
                self.push(digest, level + 1)
        return self.runs[self.levels]


def levels_of(n: int) -> int:
    """Levels above the nodes of a tree of n nodes, up to those of a block."""
    levels, span = 0, 1
    while span < n and levels < BLOCK_LEVELS:
        levels, span = levels + 1, span * ARITY
    return levels


def walk(digests: Sequence[str], levels: int) -> Iterator[list[tuple[int, str]]]:
    """The path of each node of a block, in order: by level the node's place in its run and the others of the run.

    The siblings of a run at level h are that run's nodes. While the walk passes through one run, the stack of level h
    takes in the nodes under the next one, as many as the walk takes steps, so no level ever has to catch up.
    """
    n = len(digests)
    spans = [ARITY**h for h in range(levels)]
    now: list[list[str]] = [[] for _ in range(levels)]  # nodes of the run that the walk is in, by level
    coming: list[list[str]] = [[] for _ in range(levels)]
    stacks: list[Treehash | None] = [None] * levels

    def start(h: int) -> None:
        coming[h] = []
        stacks[h] = Treehash(h, lambda level, digest, own=coming[h], h=h: own.append(digest) if level == h else None)

    def step(h: int, at: int, last: int) -> None:
        """The stack of level h takes in node `at`; after node `last` of its run it is closed."""
        if h == 0:
            coming[0].append(digests[at])
            return
        stacks[h].push(digests[at])
        stacks[h].runs[h].clear()  # told to `coming` already
        if at == last:
            stacks[h].close()

    for h in range(levels):  # the first runs
        start(h)
        last = min(n, spans[h] * ARITY) - 1
        for at in range(last + 1):
            step(h, at, last)
        now[h] = coming[h]
        start(h)
    for i in range(n):
        path = []
        for h in range(levels):
            whole = spans[h] * ARITY
            if i and i % whole == 0:
                now[h] = coming[h]
                start(h)
            place = i // spans[h] % ARITY
            path.append((place, "".join(now[h][:place] + now[h][place + 1 :])))
        yield path
        for h in range(levels):
            whole = spans[h] * ARITY
            ahead = i + whole
            if ahead < n:
                step(h, ahead, min(n, (i // whole + 2) * whole) - 1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of batches that are sorted by (tree, block), block by block; a block is bounded, so its rows are."""
    held: list[dict] = []
    key = None
    for batch in batches:
        for row in batch.to_pylist():
            now = (row["tree"], row["block"])
            if now != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append(row)
    if held:
        yield key, held


def _emitted(rows: Iterator[dict], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _roots(batches):
    """The next round's node of each block."""

    def rows():
        for (tree, block), own in _blocks(batches):
            stack = Treehash(levels_of(own[0]["n"]))
            for row in own:
                stack.push(row["digest"])
            yield {"tree": tree, "pos": block, "n": -(-own[0]["n"] // ARITY**BLOCK_LEVELS), "digest": stack.close()[0]}

    return _emitted(rows(), pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())]))


def _walk(keep: bool):
    """Nodes with their paths to the root; the first row of a block holds what its own root has further up."""

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        kinds = [("tree", pa.string()), ("pos", pa.int64()), ("subroot", pa.string()), ("path", PATH_TYPE)] + ([("digest", pa.string()), ("row", first.schema.field("row").type)] if keep else [])

        def rows():
            for (tree, _), (above, *own) in _blocks(b for part in ([first], batches) for b in part):
                upper = [(s["place"], s["others"]) for s in above["path"]]
                for row, path in zip(own, walk([r["digest"] for r in own], levels_of(own[0]["n"])), strict=True):
                    yield {"tree": tree, "pos": row["pos"], "subroot": above["subroot"], "path": [{"place": p, "others": o} for p, o in path + upper]} | ({"digest": row["digest"], "row": row["row"]} if keep else {})

        yield from _emitted(rows(), pa.schema(kinds))

    return run


def _block() -> Column:
    return F.floor(F.col("pos") / ARITY**BLOCK_LEVELS).cast("long")


def placed(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """rows (tree, ...) with pos, the row's place in its tree by `order` (from 0), and n, the rows of the tree.

    Rows are sorted by ranges, so a tree may span many tasks; what precedes a task's rows of a tree is a sum over the
    tasks before it. There are at most as many (tree, task) pairs as trees and tasks together.
    """
    at = rows.repartitionByRange(partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    at = cut(at.withColumn("at", F.monotonically_increasing_id())).withColumn("task", F.shiftright("at", 33))
    spans = at.groupBy("tree", "task").agg(F.min("at").alias("first"), F.count("*").alias("k"))
    earlier = W.partitionBy("tree").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    spans = cut(spans.select("tree", "task", "first", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"), F.sum("k").over(W.partitionBy("tree")).alias("n")))
    few = spans.count() <= SMALL
    found = at.join(F.broadcast(spans) if few else spans, ["tree", "task"])
    return found.withColumn("pos", F.col("at") - F.col("first") + F.col("before")).drop("at", "task", "first", "before")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """nodes (tree, pos, n, digest), then the roots of their blocks, and so on; a tree ends with its only node."""
    out = [nodes]
    while not (more := out[-1].where("n > 1")).isEmpty():
        blocked = more.select("tree", _block().alias("block"), "pos", "n", "digest")
        made = blocked.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
        out.append(cut(made.mapInArrow(_roots, "tree string, pos long, n long, digest string")))
    return out


def ended(tiers: Sequence[DataFrame]) -> DataFrame:
    """(tree, digest) of each tree's root."""
    out = tiers[0].where("n = 1").select("tree", "digest")
    for tier in tiers[1:]:
        out = out.union(tier.where("n = 1").select("tree", "digest"))
    return out


def walked(tiers: Sequence[DataFrame], top: DataFrame, keep: bool = False) -> DataFrame:
    """(tree, pos, subroot, path) of the first tier's nodes, with digest and row if asked; top: (tree, subroot, path) of the trees' roots."""
    down = None
    for k in reversed(range(len(tiers))):
        own = keep and k == 0
        more = ["digest", "row"] if own else []
        lone = tiers[k].where("n = 1").select("tree", "pos", *more).join(top, "tree").select("tree", "pos", "subroot", "path", *more)
        if down is None:
            down = lone
        else:
            nodes = tiers[k].where("n > 1").select("tree", _block().alias("block"), "pos", "n", "digest", F.lit(None).cast("string").alias("subroot"), F.lit(None).cast(PATH).alias("path"), *(["row"] if own else []))
            heads = down.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("digest"), "subroot", "path", *([F.lit(None).cast(tiers[0].schema["row"].dataType).alias("row")] if own else []))
            met = nodes.union(heads).repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
            kind = f"tree string, pos long, subroot string, path {PATH}" + (f", digest string, row {tiers[0].schema['row'].dataType.simpleString()}" if own else "")
            down = met.mapInArrow(_walk(own), kind).union(lone)
        if k:
            down = cut(down)
    return down


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), keep: dict[str, Column] | None = None) -> DataFrame:
    """(id, leaf, subroot, root, proof and the columns of keep) of every row of docs.

    The leaves of a group ascend by id, then by leaf (a null id comes first, rows that are alike in all fields are
    leaves of their own); groups ascend bytewise, null first. proof lists, from the leaf up, the row's place in its
    run and the other nodes of the run, joined; folded() takes it. A null or empty text is a field like any other. An
    empty table gives an empty manifest. Other columns are not read, whatever their names; keep holds expressions
    over docs.
    """
    spark = docs.sparkSession
    ship(spark)
    keep = keep or {}
    tree = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    held = F.struct(F.col(id_col).alias("id"), *[c.alias(f"k{i}") for i, c in enumerate(keep.values())])
    leaves = cut(docs.select(tree.alias("tree"), F.col(id_col).alias("id"), leaf(*[F.col(c) for c in fields]).alias("digest"), held.alias("row")))
    tiers = rounds(placed(leaves, ["id", "digest"]).select("tree", "pos", "n", "digest", "row"))
    subroots = cut(ended(tiers))
    groups = rounds(placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"]).select("tree", "pos", "n", "digest", F.struct("group").alias("row")))
    root = ended(groups).first()
    none = F.array().cast(PATH)
    above = spark.createDataFrame([("", "")], "tree string, subroot string").withColumn("path", none)
    top = cut(walked(groups, above, True).select(F.col("row.group").alias("tree"), F.col("digest").alias("subroot"), "path"))
    out = walked(tiers, top, True)
    named = [F.col("row.id").alias(id_col), F.col("digest").alias("leaf"), "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), F.col("path").alias("proof")]
    return out.select(*named, *[F.col(f"row.k{i}").alias(name) for i, name in enumerate(keep)])


def op11_merkle(docs: DataFrame) -> DataFrame:
    """The columns of the query: the manifest of docs, and what a copy of docs without some line ends would fold to."""
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    cut_text = F.replace("text", F.lit("\n"), F.lit(""))
    other = F.when(even & F.col("text").contains("\n"), leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), cut_text))
    rows = manifest(docs, keep={"tampered": other})
    proof = F.sha2(F.array_join(F.transform("proof", lambda s: s["others"]), "").cast("binary"), 256)
    back = folded(F.coalesce("tampered", "leaf"), F.col("proof"))
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), back.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


def _sql() -> str:
    field = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR))::VARCHAR || ':' || ({c})::VARCHAR, '-')"
    digest = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    code = "list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::UBIGINT)"
    crc = f"xor(4294967295::UBIGINT, list_reduce({code}, lambda c, b: list_reduce(range(8)::UBIGINT[], lambda d, k: xor(d >> 1, 3988292384::UBIGINT * (d & 1::UBIGINT)), xor(c, b)), 4294967295::UBIGINT))"
    above = lambda of, keys: f"SELECT level + 1, {keys} (pos // 3)::BIGINT, ((n + 2) // 3)::BIGINT, sha256(string_agg(h, '' ORDER BY pos)) FROM {of} WHERE n > 1 GROUP BY level, {keys} pos // 3, n"
    power = "(3 ** t.level)::BIGINT"
    others = lambda side: f"coalesce(string_agg(t.h, '' ORDER BY t.pos) FILTER (WHERE t.pos {side} b.pos // {power}), '')"
    path = lambda of, base, keys, same: f"SELECT {keys} b.pos, t.level, {{'l': {others('<')}, 'r': {others('>')}, 'd': ''}} AS s FROM {base} b JOIN {of} t ON {same} t.n > 1 AND t.pos // 3 = b.pos // (3 * {power}) GROUP BY {keys} b.pos, t.level"
    return f"""WITH RECURSIVE leaves AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {digest('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {digest("replace(text, chr(10), '')")} ELSE {digest('text')} END AS other FROM documents),
base AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
tiers AS (SELECT 0 AS level, tree, pos, n, leaf AS h FROM base UNION ALL {above('tiers', 'tree,')}),
subs AS (SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM tiers WHERE n = 1),
tops AS (SELECT 0 AS level, pos, n, h FROM subs UNION ALL {above('tops', '')}),
low AS ({path('tiers', 'base', 'b.tree,', 't.tree = b.tree AND')}), high AS ({path('tops', 'subs', '', '')}),
lows AS (SELECT tree, pos, list(s ORDER BY level) AS path FROM low GROUP BY tree, pos), highs AS (SELECT pos, list(s ORDER BY level) AS path FROM high GROUP BY pos),
rows AS (SELECT b.doc_id, b.leaf, b.other, s.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root, coalesce(l.path, []) || coalesce(h.path, []) AS path FROM base b JOIN subs s USING (tree) LEFT JOIN lows l ON l.tree = b.tree AND l.pos = b.pos LEFT JOIN highs h ON h.pos = s.pos),
backs AS (SELECT *, list_reduce([{{'l': '', 'r': '', 'd': other}}] || path, lambda a, s: {{'l': '', 'r': '', 'd': sha256(s.l || a.d || s.r)}}).d AS folded_root FROM rows)
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda s: s.l || s.r), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM backs"""


SQL = _sql()
