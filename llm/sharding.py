"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame and SQL functions.

Each source partition's row count is split over the shards as if all rows had been dealt at random: the counts are a
draw from the multivariate hypergeometric distribution, made down a binary tree over the partitions (every node splits
its shards' remaining sizes between its halves), so levels are narrow and nodes independent. A partition then permutes
its rows by a seeded hash and sends its first rows to the first shard, the next to the second, and so on; a shard
permutes what it gets by another hash, in buckets of hash ranges, so that a shard's size is no limit on parallelism.

All draws are seeded hashes, so a lost executor's work is redone with the same result. Rows are dealt by partition and
hash, not by content: no hot source, text or id can gather in one task. Null text: no bytes; null doc_ids and repeated
rows are placed like any row; an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import documents, narrow, stage

#: Fixed values of the contract.
SHARDS, ROW_BYTES = 24, 8
#: About so many rows are permuted by one task inside a shard.
BUCKET_ROWS = 50_000
#: Tree levels before its nodes are spread over tasks.
LEVELS_IN_ONE_TASK = 6


def _uniform(*parts: str) -> str:
    """A double in (0, 1) from a seeded hash of SQL expressions."""
    return f"((shiftrightunsigned(xxhash64({', '.join(parts)}), 11) + 0.5D) / 9007199254740992D)"


def _hypergeometric(u: str, total: str, good: str, draws: str) -> str:
    """SQL for the number of good items among `draws` of `total` items: inverse distribution function, summed outwards
    from the mode by the ratio of neighbouring probabilities, over 12 standard deviations on either side."""
    bind = lambda name, fields, body: f"transform(array(named_struct({fields})), {name} -> {body})[0]"
    up = "(p.good - k) * (p.draws - k) / ((k + 1D) * (p.total - p.good - p.draws + k + 1D))"
    down = "k * (p.total - p.good - p.draws + k) / ((p.good - k + 1D) * (p.draws - k + 1D))"

    def walk(ks: str, ratio: str, start: str, then: str, end: str) -> str:
        return f"aggregate({ks}, named_struct({start}), (s, k) -> {bind('r', f'{chr(39)}w{chr(39)}, s.w * {ratio}', then)}, s -> {end})"

    ups = "IF(q.top > q.m, sequence(q.m, q.top - 1), array())"
    downs = "IF(q.low < q.m, sequence(q.m, q.low + 1), array())"
    adds = "named_struct('w', r.w, 'sum', s.sum + r.w)"
    # left: what is left of the drawn weight; k: the outcome once it is used up
    takes = "named_struct('w', r.w, 'left', s.left - r.w, 'k', IF(s.left > 0D, {next}, s.k))"
    total_of = lambda ks, ratio: walk(ks, ratio, "'w', 1D, 'sum', 0D", adds, "s.sum")
    find = lambda ks, ratio, nxt, left: walk(
        ks, ratio, f"'w', 1D, 'left', {left}, 'k', q.m", takes.format(next=nxt), "s.k"
    )
    pick = bind(
        "t", "'x', p.u * (1D + q.up + q.down), 'up', q.up",
        f"CASE WHEN t.x <= 1D THEN q.m WHEN t.x <= 1D + t.up THEN {find(ups, up, 'k + 1L', 't.x - 1D')}"
        f" ELSE {find(downs, down, 'k - 1L', 't.x - 1D - t.up')} END",
    )
    sums = bind(
        "q", f"'m', q.m, 'low', q.low, 'top', q.top, 'up', {total_of(ups, up)}, 'down', {total_of(downs, down)}", pick
    )
    window = bind(
        "q",
        "'m', q.m, 'low', greatest(0L, p.draws + p.good - p.total, q.m - q.width), 'top', least(p.draws, p.good, q.m + q.width)", sums
    )
    mode = bind(
        "q",
        "'m', greatest(0L, p.draws + p.good - p.total, least(p.draws, p.good, bigint((p.draws + 1D) * (p.good + 1D) / (p.total + 2D)))), "
        "'width', bigint(12D * sqrt(p.draws * (p.good / double(p.total)) * (1D - p.good / double(p.total))) + 12D)", window
    )
    return (
        f"IF({total} = 0L, 0L, "
        + bind("p", f"'u', {u}, 'total', bigint({total}), 'good', bigint({good}), 'draws', bigint({draws})", mode) + ")"
    )


def communication_matrix(counts: DataFrame, sizes: list[int], seed: int = 0) -> DataFrame:
    """counts: (part, n), a row for each partition. Gives (part, sent array<long>): how many rows it sends to each shard.
    Sums over shards are the partition's n, sums over partitions the shards' sizes."""
    n_parts = counts.count()
    leaves = counts.agg(F.sort_array(F.collect_list(F.struct("part", F.col("n").cast("long").alias("n")))).alias("leaves"))
    nodes = leaves.where("size(leaves) > 0").select(
        "leaves", F.array(*[F.lit(s).cast("long") for s in sizes]).alias("left_over")
    )
    draw = _hypergeometric(_uniform(str(seed), "first", "n_leaves", "j"), "a.total", "left_over[j]", "a.draws")
    # splits one node: how much of every shard goes to the node's first half
    split = f"""aggregate(sequence(0, {len(sizes) - 1}),
        named_struct('total', total, 'draws', half_total, 'out', cast(array() AS array<bigint>)),
        (a, j) -> transform(array({draw}), x -> named_struct('total', a.total - left_over[j], 'draws', a.draws - x,
                                                              'out', concat(a.out, array(x))))[0],
        a -> a.out)"""
    for level in range(max(0, n_parts - 1).bit_length()):
        if level == LEVELS_IN_ONE_TASK:
            nodes = nodes.repartition(F.expr("leaves[0].part"))
        sized = nodes.selectExpr(
            "leaves", "left_over", "size(leaves) AS n_leaves", "leaves[0].part AS first",
            "aggregate(left_over, 0L, (s, x) -> s + x) AS total",
            "aggregate(slice(leaves, 1, int(ceil(size(leaves) / 2))), 0L, (s, x) -> s + x.n) AS half_total",
        )
        halves = sized.selectExpr("leaves", "left_over", "int(ceil(n_leaves / 2)) AS half", f"{split} AS taken")
        nodes = halves.selectExpr(
            """inline(filter(array(
                named_struct('leaves', slice(leaves, 1, half), 'left_over', taken),
                named_struct('leaves', slice(leaves, half + 1, size(leaves) - half),
                             'left_over', zip_with(left_over, taken, (a, b) -> a - b))), x -> size(x.leaves) > 0))"""
        )
    return nodes.selectExpr("leaves[0].part AS part", "left_over AS sent")


def uniform_shards(rows: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """The given (narrow) rows with shard int and slot long: sizes at most one apart, every assignment equally likely,
    slots 0, 1, ... in each shard. Column names starting with `__` are taken."""
    names = rows.columns
    key = lambda salt: F.xxhash64(F.lit(seed), F.lit(salt), *[F.col(f"`{c}`") for c in names])
    placed = stage(rows.withColumn("__part", F.spark_partition_id()), "shard-rows")
    counts = stage(placed.groupBy(F.col("__part").alias("part")).agg(F.count("*").alias("n")), "shard-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    sizes = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = stage(communication_matrix(counts, sizes, seed), "shard-matrix")
    cuts = matrix.select(
        F.col("part").alias("__part"),
        F.expr("transform(sequence(1, size(sent)), k -> aggregate(slice(sent, 1, k), 0L, (s, x) -> s + x)) AS __cuts"),
    )
    nth = F.row_number().over(Window.partitionBy("__part").orderBy(key(1), *names)) - 1
    buckets = max(1, -(-total // (shards * BUCKET_ROWS)))
    bucket = F.shiftrightunsigned(F.shiftrightunsigned(key(2), 33) * F.lit(buckets), 31)
    sent = stage(
        placed.withColumn("__nth", nth)
        .join(cuts, "__part")
        .withColumn("shard", F.expr("int(size(filter(__cuts, c -> c <= __nth)))"))
        .withColumn("__bucket", bucket)
        .select(*names, "shard", "__bucket"),
        "shard-sent",
    )
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sent.groupBy("shard", "__bucket").agg(F.count("*").alias("n")).select(
        "shard", "__bucket", F.coalesce(before, F.lit(0)).alias("__before")
    )
    inside = F.row_number().over(Window.partitionBy("shard", "__bucket").orderBy(key(2), *names)) - 1
    return sent.withColumn("__inside", inside).join(offsets, ["shard", "__bucket"]).select(
        *names, "shard", (F.col("__before") + F.col("__inside")).cast("long").alias("slot")
    )


def op9_hypergeometric_shards(spark, sf_dir: str) -> DataFrame:
    rows = narrow(documents(spark, sf_dir)).select(
        "doc_id",
        (F.octet_length("text") + F.lit(ROW_BYTES)).cast("long").alias("size"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    return uniform_shards(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
