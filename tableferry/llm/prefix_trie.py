"""Prefix trie of conversations: padded turn-id matrices in ranges of the sorted turns, joined where ranges meet."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm.store import small, staged

# Bytes of a turn's id, an MD5 of its role and text; columns of a matrix that are sorted at a time.
ID_BYTES, BAND = 16, 16
# Turns that a shard is sized for; ids of members that travel in one row.
SHARD_TURNS, IDS_A_ROW = 1 << 19, 2000
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PART = f"kind string, {NODE}, key binary, parent_key binary, shard long, place long, path binary, words binary, ids binary, first_id long"
_FIELDS = [f.split() for f in PART.split(", ")]
_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batch(size: int, **columns) -> pa.RecordBatch:
    arrays = [pa.array(columns[n], _TYPES[t]) if n in columns else pa.nulls(size, _TYPES[t]) for n, t in _FIELDS]
    return pa.RecordBatch.from_arrays(arrays, [n for n, _ in _FIELDS])


def rebuilt(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation as ``conv_id, path, words``: ids and word counts of its turns, the first ones taken from its family's first.

    One shuffle by family brings at most ``family`` conversations together; texts stay behind as MD5 and word count. Turns go by
    turn, null first, and turns of one number by role, the first 64 characters of the text and its MD5.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        F.substring(text, 1, 64).alias("start"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    rows = rows.withColumn("base", F.expr(f"conv_id - conv_id % {family}"))
    rows = rows.withColumn("taken", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("long"))
    order = ["base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "role", "start", "id"]
    rows = rows.repartition("base").sortWithinPartitions(*order).select("base", "conv_id", "taken", "id", "words")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, taken, ids, words = (None, None), 0, [], []
        head: tuple[list[bytes], list[int]] = ([], [])
        done: list[tuple[int, bytes, bytes]] = []

        def close() -> None:
            nonlocal head
            base, conv = now
            if conv == base:
                head = ids[:heads], words[:heads]
            own = [*head[0][:taken], *ids[taken:]], [*head[1][:taken], *words[taken:]]
            done.append((conv, b"".join(own[0]), np.array(own[1], "<i8").tobytes()))

        def given() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), (pa.int64(), pa.binary(), pa.binary()))], ["conv_id", "path", "words"])
            done.clear()
            return out

        for batch in batches:
            for base, conv, h, i, w in zip(*(batch.column(c).to_pylist() for c in ("base", "conv_id", "taken", "id", "words"))):
                if (base, conv) != now:
                    if now[1] is not None:
                        close()
                    if base != now[0]:
                        head = ([], [])
                    now, taken, ids, words = (base, conv), h, [], []
                ids.append(i)
                words.append(w)
            if len(done) >= 1000:
                yield given()
        if now[1] is not None:
            close()
        if done:
            yield given()

    return rows.mapInArrow(gather, "conv_id long, path binary, words binary")


def in_order(turns: np.ndarray, at: np.ndarray, lengths: np.ndarray, conv: np.ndarray) -> np.ndarray:
    """Rows by their turn ids, shorter ones first, then by ``conv``: matrices of ``BAND`` columns, padded with -1, lexsorted one by one."""
    rank, order = np.zeros(len(at), np.int64), np.lexsort((conv,))
    for low in range(0, int(lengths.max(initial=0)), BAND):
        longer = np.zeros(len(at), bool)
        longer[rank[lengths > low]] = True
        slots = np.flatnonzero(longer[rank[order]])
        rows = order[slots]
        matrix = padded(turns, at[rows], lengths[rows], low)
        rows = rows[by := np.lexsort((conv[rows], *matrix.T[::-1], rank[rows]))]
        order[slots] = rows
        matrix = matrix[by]
        new = np.zeros(len(at), bool)
        new[slots] = np.r_[True, (matrix[1:] != matrix[:-1]).any(axis=1) | (rank[rows[1:]] != rank[rows[:-1]])]
        new[1:] |= rank[order[1:]] != rank[order[:-1]]
        new[0] = False
        rank[order] = np.cumsum(new)
    return order


def padded(turns: np.ndarray, at: np.ndarray, lengths: np.ndarray, low: int) -> np.ndarray:
    """Columns ``low`` to ``low + BAND`` of the rows' turn ids, -1 where a row has ended."""
    width = int(min(BAND, max(0, lengths.max(initial=0) - low)))
    places = np.arange(low, low + width)
    inside = places < lengths[:, None]
    matrix = np.full((len(at), width), -1, np.int64)
    matrix[inside] = turns[(at[:, None] + places)[inside]]
    return matrix


def first_new(turns: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For sorted rows the least depth whose prefix the row before lacks, a row's length and 1 if it lacks none; 0 for the first row.

    Changes between neighbouring rows are OR-accumulated along the columns; what is set marks the start of a node.
    """
    fresh = lengths + 1
    rows = np.arange(len(at))
    for low in range(0, int(lengths.max(initial=0)), BAND):
        rows = rows[lengths[rows] > low]
        matrix = padded(turns, at[rows], lengths[rows], low)
        before = padded(turns, at[rows - 1], np.where(rows > 0, lengths[rows - 1], 0), low)
        width = matrix.shape[1]
        wide = np.full(matrix.shape, -1, np.int64)
        wide[:, : before.shape[1]] = before[:, :width]
        changed = (matrix != wide) | (fresh[rows] <= low)[:, None]
        starts = np.logical_or.accumulate(changed, axis=1)
        found = starts.any(axis=1)
        fresh[rows[found]] = np.minimum(fresh[rows[found]], low + 1 + starts[found].argmax(axis=1))
    fresh[:1] = 0
    return fresh


def prefix_keys(path: bytes, depth: int) -> list[bytes]:
    """A name for each prefix of a row, from no turns to ``depth`` of them."""
    running, out = hashlib.md5(), []
    for d in range(depth + 1):
        out.append(running.copy().digest())
        running.update(path[d * ID_BYTES : (d + 1) * ID_BYTES])
    return out


def _ended(conv: np.ndarray) -> bytes:
    return ",".join(map(str, conv.tolist())).encode()


def solve(table: pa.Table, shard: int) -> Iterator[pa.RecordBatch]:
    """The nodes of one shard by reduceat over each depth, and what its first and last rows bring to nodes shared with others."""
    conv, paths = table.column("conv_id").to_numpy(), table.column("path").to_pylist()
    raw = np.frombuffer(b"".join(paths), f"S{ID_BYTES}") if any(paths) else np.zeros(0, f"S{ID_BYTES}")
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), "<i8")
    lengths = np.array([len(p) // ID_BYTES for p in paths], np.int64)
    at = np.r_[0, np.cumsum(lengths)[:-1]]
    # S16 drops trailing zero bytes when it compares, which keeps the order of equal lengths.
    turns = np.unique(raw, return_inverse=True)[1].astype(np.int64)
    order = in_order(turns, at, lengths, conv)
    conv, lengths, at = conv[order], lengths[order], at[order]
    fresh = first_new(turns, at, lengths)
    sums = np.r_[0, np.cumsum(words)]
    total = sums[at + lengths] - sums[at]
    own = sums[at + lengths] - sums[np.minimum(at + np.maximum(fresh, 1) - 1, at + lengths)]
    # A row's whole path is childless if the next row neither goes on from it nor repeats it; a row that repeats has nothing new.
    leaf = np.r_[fresh[1:] <= lengths[:-1], True]
    ends_at = np.flatnonzero(fresh <= lengths)
    last = len(conv) - 1
    edges = {0: prefix_keys(paths[order[0]], int(lengths[0])), last: prefix_keys(paths[order[last]], int(lengths[last]))}
    ended = np.r_[ends_at[1:], len(conv)]

    rows, above, above_conv, above_edge = np.arange(len(conv)), None, None, None
    for depth in range(int(lengths.max(initial=0)) + 1):
        rows = rows[lengths[rows] >= depth]
        start = np.flatnonzero(fresh[rows] <= depth)
        first = rows[start]
        sizes = np.diff(np.r_[start, len(rows)])
        smallest = np.minimum.reduceat(conv[rows], start)
        child = (fresh[rows] == depth + 1) & (lengths[rows] > depth)
        child[start] = lengths[first] > depth
        children, leaves = np.add.reduceat(child.astype(np.int64), start), np.add.reduceat(leaf[rows].astype(np.int64), start)
        tail = sums[at[rows] + lengths[rows]] - sums[at[rows] + max(depth - 1, 0)]
        fresh_words = own[rows].copy()
        fresh_words[start] = tail[start]
        saved = np.add.reduceat(tail - fresh_words, start)
        # Nodes that hold the first or the last row may go on in another shard.
        edge = np.full(len(first), -1, np.int64)
        for row, keys in edges.items():
            if depth < len(keys):
                edge[np.searchsorted(first, row, side="right") - 1] = row
        parent = np.searchsorted(above, first, side="right") - 1 if above is not None else None
        keys = [edges[e][depth] if e >= 0 else None for e in edge.tolist()]
        parent_keys = [None] * len(first) if parent is None else [edges[e][depth - 1] if e >= 0 else None for e in above_edge[parent].tolist()]
        # Members that end here are the node's first rows.
        ends = np.minimum(np.searchsorted(ends_at, first), len(ends_at) - 1)
        ending = (ends_at[ends] == first) & (lengths[first] == depth)
        hashes = [hashlib.sha256(_ended(conv[a:b])).hexdigest() if own_ends and e < 0 else NO_ENDS
                  for a, b, own_ends, e in zip(first.tolist(), ended[ends].tolist(), ending.tolist(), edge.tolist())]
        yield _batch(
            len(first), kind=["edge" if e >= 0 else "node" for e in edge.tolist()], conv_id=smallest, depth=np.full(len(first), depth),
            parent_conv_id=[None] * len(first) if parent is None else above_conv[parent], n_convs=sizes, n_children=children,
            n_leaves=leaves, saved_tokens=saved, ends_sha256=hashes, key=keys, parent_key=parent_keys,
        )
        for i in np.flatnonzero(ending & (edge >= 0)).tolist():
            a, b = int(first[i]), int(ended[ends[i]])
            for k in range(a, b, IDS_A_ROW):
                some = conv[k : min(b, k + IDS_A_ROW)]
                yield _batch(1, kind=["ends"], key=[keys[i]], first_id=some[:1], ids=[_ended(some)])
        above, above_conv, above_edge = first, smallest, edge
    for place, row in enumerate((0, last)):
        whole = words[at[row] : at[row] + lengths[row]].tobytes()
        yield _batch(1, kind=["border"], shard=[shard], place=[place], path=[paths[order[row]]], words=[whole])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [b for b in batches if b.num_rows]
    if held:
        yield from solve(pa.Table.from_batches(held), TaskContext.get().partitionId())


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What neighbouring shards counted twice: prefixes of a shard's first row that the last row of the one before has, too."""
    for batch in batches:
        for path, before, words in zip(*(batch.column(c).to_pylist() for c in ("path", "before", "words"))):
            length, earlier = len(path) // ID_BYTES, len(before) // ID_BYTES
            common = 0
            while common < min(length, earlier) and path[common * ID_BYTES : (common + 1) * ID_BYTES] == before[common * ID_BYTES : (common + 1) * ID_BYTES]:
                common += 1
            sums = np.r_[0, np.cumsum(np.frombuffer(words, "<i8"))]
            depth = np.arange(common + 1)
            yield _batch(
                common + 1, kind=["edge"] * (common + 1), depth=depth, n_convs=np.zeros(common + 1, np.int64),
                n_children=np.where(depth < common, -1, 0), n_leaves=np.full(common + 1, -1 if common == earlier else 0),
                saved_tokens=sums[common] - sums[np.maximum(depth - 1, 0)], key=prefix_keys(path, common),
            )


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the ids of each node, whose rows come in ascending order; only the running digest is held."""
    now, running, done = None, hashlib.sha256(), []
    for batch in batches:
        for key, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
            if key != now:
                if now is not None:
                    done.append((now, running.hexdigest()))
                now, running = key, hashlib.sha256(ids)
            else:
                running.update(b"," + ids)
    if now is not None:
        done.append((now, running.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["key", "sha"])


def prefix_trie(spark: SparkSession, conversations: DataFrame, shard_turns: int = SHARD_TURNS, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt conversations:
    ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Conversations are cut into ranges of their turn ids, so that a node's members are neighbours. In a range numpy sorts padded
    matrices of turn ids and adds up every depth. All figures are sums over rows, given which of its prefixes the row before
    has; so nodes that reach over a border are sums of their shards' parts, less what both sides of a border counted. A path
    with very many members is cut by conv_id like any other range. A conversation travels as 24 bytes a turn and must fit a
    task as such; range borders come from Spark's sample of paths.

    A null role or text is an empty one; rows with a null conv_id belong to no conversation. Rows that repeat a turn are turns of
    their own, in the order ``rebuilt`` states. An empty table gives no rows, and other columns are not read.
    """
    whole = staged(spark, rebuilt(conversations), "rebuilt")
    count, turns = whole.agg(F.count(F.lit(1)), F.sum(F.octet_length("path") / ID_BYTES)).first()
    if not count:
        return spark.createDataFrame([], NODE)
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((turns or 0) // shard_turns) + 1)
    ranged = whole.repartitionByRange(shards, "path", "conv_id")
    parts = staged(spark, ranged.mapInArrow(_shards, PART), "shard-nodes")

    borders = parts.filter("kind = 'border'").select("shard", "place", "path", "words")
    filled = sorted(r["shard"] for r in borders.select("shard").distinct().collect())
    following = spark.createDataFrame(list(zip(filled, filled[1:])), "shard long, after long")
    ahead = borders.filter("place = 1").select("shard", F.col("path").alias("before")).join(F.broadcast(following), "shard")
    met = ahead.drop("shard").join(borders.filter("place = 0").select(F.col("shard").alias("after"), "path", "words"), "after")
    fixes = met.select("path", "before", "words").mapInArrow(_corrections, PART)

    sums = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    edges = parts.filter("kind = 'edge'").select("key", "depth", "parent_key", "conv_id", *sums)
    edges = edges.unionByName(fixes.select("key", "depth", "parent_key", "conv_id", *sums)).groupBy("key").agg(
        F.min("depth").alias("depth"), F.min("parent_key").alias("parent_key"), F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums]
    )
    ends = parts.filter("kind = 'ends'").select("key", "first_id", "ids").repartition("key").sortWithinPartitions("key", "first_id")
    ends = ends.select("key", "ids").mapInArrow(_hashed, "key binary, sha string")
    edges = staged(spark, edges.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NO_ENDS))).drop("sha"), "edge-nodes")

    names = small(spark, edges.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("known")), edges)
    nodes = parts.filter("kind = 'node'").withColumn("conv", F.col("conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", *sums, "ends_sha256"]
    every = edges.withColumn("parent_conv_id", F.lit(None).cast("long")).select("parent_key", *columns)
    every = every.unionByName(nodes.filter("parent_key is not null").select("parent_key", *columns))
    every = every.join(names, "parent_key", "left").withColumn("parent_conv_id", F.col("known")).select(*columns)
    return every.unionByName(nodes.filter("parent_key is null").select(*columns))


ORACLE = r"""
with crc as (
  select list_transform(range(256), lambda i: list_reduce(list_prepend(i, [1, 1, 1, 1, 1, 1, 1, 1]),
    lambda c, x: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as steps
), ids as (
  select c, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast(c as varchar), ''), lambda d: cast(ascii(d) as bigint))),
    lambda a, b: xor(a >> 8, steps[(xor(a, b) & 255) + 1])), 4294967295) % 4 as h
  from (select distinct cast(conv_id as bigint) as c from conversations where conv_id is not null), crc
), filled as (
  select cast(conv_id as bigint) as c, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), named as (
  select c, turn, role, text, md5(concat(cast(strlen(role) as varchar), ':', role, text)) as id from filled
), own as (
  select c, row_number() over (partition by c order by turn nulls first, role, left(text, 64), id) as k, id,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as words from named
), sizes as (
  select c, count(*) as n from own group by c
), turns as (
  select i.c, o.k as pos, o.id, o.words from ids i join own o on o.c = i.c - i.c % 20 and o.k <= i.h
  union all
  select i.c, o.k - i.h + least(i.h, coalesce(s.n, 0)), o.id, o.words
  from ids i join own o on o.c = i.c and o.k > i.h left join sizes s on s.c = i.c - i.c % 20
), steps as (
  select c, pos as depth, string_agg(id, '') over (partition by c order by pos) as path, words from turns
  union all select c, 0, '', 0 from ids
), last as (
  select c, max(depth) as depth from steps group by c
), ends as (
  select s.path, sha256(string_agg(cast(s.c as varchar), ',' order by s.c)) as ends_sha256 from steps s join last l on l.c = s.c and l.depth = s.depth group by s.path
), nodes as (
  select path, depth, min(c) as conv_id, count(*) as n_convs, (count(*) - 1) * min(words) as saved from steps group by path, depth
), children as (
  select left(path, 32 * (depth - 1)) as path, count(*) as n from nodes where depth > 0 group by 1
), above as (
  select left(n.path, 32 * d) as path, sum(n.saved) as saved, count(*) filter (c.n is null) as leaves
  from (select *, unnest(range(depth + 1)) as d from nodes) n left join children c on c.path = n.path group by 1
)
select n.conv_id, cast(n.depth as bigint) as depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children,
  cast(a.leaves as bigint) as n_leaves, cast(a.saved as bigint) as saved_tokens,
  coalesce(e.ends_sha256, 'e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855') as ends_sha256
from nodes n join above a on a.path = n.path left join children c on c.path = n.path left join ends e on e.path = n.path
  left join nodes p on n.depth > 0 and p.depth = n.depth - 1 and p.path = left(n.path, 32 * (n.depth - 1))
"""
