"""Mixes of sources at target weights (problem 4).

A mix has lines (source, tool type or any) with shares that add up to 1. A line's capacity is ``max_repeats`` times the
characters of its rows. Lines without rows are reported with nothing; a line that is short supplies its capacity, and
what it lacks falls to the others in proportion to their shares: every line gives ``min(capacity, level x share)``.
The level is set by ``size``, the characters wanted in all, or by default is the highest at which lines with at least
``FULL`` of the shares (of lines with rows) give theirs whole, so that no small line throttles its mix.

Rows of a line stand in the order of a hash of (line, id), their position. A line's quota is met by whole rounds over
all its rows, then by rows of one more round in that order up to the quota, then by the largest unused row that fits
what is left. The end of the part round is found by nested blocks of positions: sizes of ``FAN`` blocks a line come to
the driver, then those of the block in which the quota ends, until it has at most ``BLOCK_ROWS`` rows. Rows are read
once; id, size and position are kept.

Which output shard gets which blocks is drawn by a splitting tree: a node holds the number of (copy, block) units of
each line and halves its shards; how many of each line go left is drawn from the multivariate hypergeometric
distribution, so quotas stay exact. Units are dealt in permuted order without overlap, and rows are shuffled inside their
shard by a hash. The numbers of shards and blocks follow from the size of the mix, up to ``MOST_SHARDS`` shards.

Rows with null or empty text have size 0 and are in no mix. A row belongs to one line of a mix: that of its tool type,
else that of any. Lines named twice are one, with the sum of the shares. Rows of one id have one position and go together.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import stable

SEED = 20
#: Share of a mix's lines (by target share) that must be met in full.
FULL = 0.9
#: Blocks that a range of positions is cut into at once, and rows of a block that is cut no further.
FAN, BLOCK_ROWS = 256, 10_000
#: Characters of one output shard, and bounds of their number.
SHARD_CHARS, LEAST_SHARDS, MOST_SHARDS = 256_000_000, 16, 1024
#: Hexadecimal digits of a position.
DIGITS = 15
_RANGE = 16**DIGITS

USES = "mix_name string, source string, tool_type string"


def split_tree(counts: np.ndarray, shards: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Units of each line for every shard: the counts of a node are split between the halves of its shards.

    The total of the left half is in proportion to its shards; given it, the lines' counts follow the multivariate
    hypergeometric distribution.
    """
    if shards == 1:
        return [counts]
    left = shards // 2
    total = int(counts.sum())
    take = (total * left + shards // 2) // shards
    a = rng.multivariate_hypergeometric(counts, take, method="marginals") if total else counts * 0
    return split_tree(a, left, rng) + split_tree(counts - a, shards - left, rng)


def level(capacity: list[int], share: list[float], size: int | None = None) -> float:
    """The level at which lines give ``min(capacity, level x share)``; see the module's text."""
    some = sorted((c / s, c, s) for c, s in zip(capacity, share) if c > 0 and s > 0)
    if not some:
        return 0.0
    shares = sum(s for *_, s in some)
    if size is None:
        short, best = 0.0, some[0][0]
        for r, _, s in some:
            if short > (1 - FULL) * shares + 1e-9:
                break
            best, short = r, short + s
        return best
    left = float(size)
    for r, c, s in some:
        if left / shares <= r:
            return left / shares
        left, shares = left - c, shares - s
    return some[-1][0]


def _lines(targets: DataFrame) -> list[dict]:
    merged: dict[tuple, dict] = {}
    for r in targets.select("mix_name", "source", "tool_type", "target_share", "max_repeats").collect():  # a fixed table
        x = merged.setdefault((r.mix_name, r.source, r.tool_type), {"mix": r.mix_name, "source": r.source, "tool": r.tool_type, "share": 0.0, "repeats": 0})
        x["share"] += float(r.target_share or 0)
        x["repeats"] = max(x["repeats"], int(r.max_repeats or 0))
    lines = sorted(merged.values(), key=lambda x: (x["mix"] or "", x["source"] or "", x["tool"] is not None, x["tool"] or ""))
    for i, x in enumerate(lines):
        x["line"] = i
        x["but"] = [y["tool"] for y in lines if x["tool"] is None and y["tool"] is not None and (y["mix"], y["source"]) == (x["mix"], x["source"])]
    return lines


def _part_rounds(rows: DataFrame, rest: dict[int, int]) -> dict[int, tuple[int, int]]:
    """{line: (last position of the part round, characters still missing)}; -1 if no row fits."""
    spark = rows.sparkSession
    at = {k: (0, n) for k, n in rest.items()}  # start of the range that holds the end of the round, characters to take in it
    width, done, left = _RANGE, {}, set(rest)
    while left:
        step = max(1, width // FAN)
        ranges = spark.createDataFrame([(k, at[k][0]) for k in left], "line int, low long")
        inside = rows.join(F.broadcast(ranges), "line").where(f"pos >= low and pos < low + {width}")
        blocks: dict[int, dict[int, tuple[int, int]]] = {}
        for r in inside.groupBy("line", F.expr(f"(pos - low) div {step}").alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect():  # lines x FAN
            blocks.setdefault(r.line, {})[r.b] = (int(r.n), r["rows"])
        ends = {}
        for k in sorted(left):
            low, need = at[k]
            for b in sorted(blocks.get(k, {})):
                n, count = blocks[k][b]
                if n > need:
                    at[k] = (low + b * step, need)
                    if count <= BLOCK_ROWS or step == 1:
                        ends[k] = at[k]
                    break
                need -= n
            else:
                done[k] = (low + width - 1, need)
        if ends:
            small = spark.createDataFrame([(k, low) for k, (low, _) in ends.items()], "line int, low long")
            found = rows.join(F.broadcast(small), "line").where(f"pos >= low and pos < low + {step}").groupBy("line", "pos").agg(F.sum("n").alias("n")).collect()  # lines x BLOCK_ROWS
            for k, (low, need) in ends.items():
                last = low - 1
                for pos, n in sorted((r.pos, int(r.n)) for r in found if r.line == k):
                    if n > need:
                        break
                    last, need = pos, need - n
                done[k] = (last, need)
        left -= set(done)
        width = step
    return done


def planned(df: DataFrame, targets: DataFrame, id_col: str = "sample_id", text_col: str = "tool_output", size: int | None = None) -> tuple[DataFrame, list[dict]]:
    """((line, id, n, pos, copies) of every row of a line, plan of each line); copies is 0 for rows that aren't used."""
    spark = df.sparkSession
    lines = _lines(targets)
    kind = dict(df.dtypes)[id_col]
    if not lines:
        return spark.createDataFrame([], f"line int, id {kind}, n long, pos long, copies int"), []
    table = spark.createDataFrame([(x["line"], x["source"], x["tool"], x["but"], f"{x['mix']}|{x['source']}|{x['tool'] or ''}|") for x in lines], "line int, of_source string, of_tool string, but array<string>, name string")
    rows = df.select(F.col(id_col).alias("id"), "source", "tool_type", F.length(text_col).cast("long").alias("n")).where("n > 0")
    fits = (F.col("source") == F.col("of_source")) & F.when(F.col("of_tool").isNull(), ~F.coalesce(F.array_contains("but", F.col("tool_type")), F.lit(False))).otherwise(F.col("of_tool") == F.col("tool_type"))
    position = F.conv(F.substring(F.md5(F.concat(F.col("name"), F.col("id").cast("string"))), 1, DIGITS), 16, 10).cast("long")
    rows = stable(rows.join(F.broadcast(table), fits).select("line", "id", "n", position.alias("pos")))
    had = {r.line: (int(r.n), r["rows"]) for r in rows.groupBy("line").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    for x in lines:
        x["total"], x["rows"] = had.get(x["line"], (0, 0))
    for mix in {x["mix"] for x in lines}:
        own = [x for x in lines if x["mix"] == mix]
        at = level([x["total"] * x["repeats"] for x in own], [x["share"] for x in own], size)
        for x in own:
            x["quota"] = min(x["total"] * x["repeats"], math.floor(at * x["share"] + 1e-6)) if x["share"] > 0 else 0
        total = max(1, sum(x["quota"] for x in own))
        for x in own:
            x["planned_share"] = x["quota"] / total
            x["rounds"], x["rest"] = divmod(x["quota"], x["total"]) if x["total"] else (0, 0)
            x["last"], x["extra"] = -1, None
    ends = _part_rounds(rows, {x["line"]: x["rest"] for x in lines if x["rest"]})
    for x in lines:
        x["last"], x["missing"] = ends.get(x["line"], (-1, 0))
    gaps = spark.createDataFrame([(x["line"], x["last"], x["missing"]) for x in lines if x["missing"]], "line int, last long, missing long")
    best = F.max(F.struct("n", (-F.col("pos")).alias("back")))
    for r in rows.join(F.broadcast(gaps), "line").where("pos > last and n <= missing").groupBy("line", "missing").agg(best.alias("best")).collect():  # one a line
        lines[r.line]["extra"] = -r.best.back
    extra = spark.createDataFrame([(x["line"], x["extra"]) for x in lines if x["extra"] is not None], "line int, pos long")
    for r in rows.join(F.broadcast(extra), ["line", "pos"]).groupBy("line").agg(F.sum("n").alias("n")).collect():
        if r.n > lines[r.line]["missing"]:  # rows of one id, which go together
            lines[r.line]["extra"] = None
    use = spark.createDataFrame([(x["line"], x["rounds"], x["last"], x["extra"]) for x in lines], "line int, rounds int, last long, extra long")
    more = ((F.col("pos") <= F.col("last")) | F.coalesce(F.col("pos") == F.col("extra"), F.lit(False))).cast("int")
    return rows.join(F.broadcast(use), "line").select("line", "id", "n", "pos", (F.col("rounds") + more).alias("copies")), lines


def _deal(lines: list[dict], shards: int, blocks: int) -> list[tuple[int, int, int, int]]:
    """(line, copy, block, shard) of every unit; those of the part round are the blocks up to its end."""
    out = []
    for mix in sorted({x["mix"] for x in lines}, key=str):
        own = [x for x in lines if x["mix"] == mix]
        units = []
        for x in own:
            stop = 0 if x["last"] < 0 and x["extra"] is None else max(0, x["last"]) * blocks // _RANGE + 1
            units.append([(c, b) for c in range(x["rounds"]) for b in range(blocks)] + [(x["rounds"], b) for b in range(stop)])
            x["stop"] = max(0, stop - 1)
        tree = split_tree(np.array([len(u) for u in units], np.int64), shards, np.random.default_rng([SEED, len(own), sum(map(len, units))]))
        for j, (x, u) in enumerate(zip(own, units)):
            order, at = np.random.default_rng([SEED + 1, x["line"]]).permutation(len(u)), 0
            for shard, counts in enumerate(tree):
                out += [(x["line"], *u[k], shard) for k in order[at : at + int(counts[j])]]
                at += int(counts[j])
    return out


def mix(df: DataFrame, targets: DataFrame, id_col: str = "sample_id", text_col: str = "tool_output", shards: int | None = None, size: int | None = None) -> DataFrame:
    """mix_name, source, tool_type (of the line), id, copy, shard, place (order in the shard), n_chars: every use of a row."""
    spark = df.sparkSession
    used, lines = planned(df, targets, id_col, text_col, size)
    if not lines:
        return spark.createDataFrame([], f"{USES}, {id_col} {dict(df.dtypes)[id_col]}, copy int, shard int, place long, n_chars long")
    if shards is None:
        most = max(sum(x["quota"] for x in lines if x["mix"] == m) for m in {x["mix"] for x in lines})
        shards = min(MOST_SHARDS, max(LEAST_SHARDS, 1 << max(0, math.ceil(math.log2(max(1, most / SHARD_CHARS))))))
    blocks = max(FAN, 1 << math.ceil(math.log2(4 * shards)))
    deal = F.broadcast(spark.createDataFrame(_deal(lines, shards, blocks), "line int, copy int, block int, shard int"))  # lines x repeats x blocks, at most 4 x MOST_SHARDS
    names = F.broadcast(spark.createDataFrame([(x["line"], x["mix"], x["source"], x["tool"], x["rounds"], x["stop"]) for x in lines], f"line int, {USES}, rounds int, stop int"))
    uses = used.where("copies > 0").withColumn("copy", F.explode(F.expr("sequence(0, copies - 1)"))).join(names, "line")
    block = (F.col("pos") / F.lit(_RANGE // blocks)).cast("int")
    uses = uses.withColumn("block", F.when(F.col("copy") < F.col("rounds"), block).otherwise(F.least(block, "stop"))).join(deal, ["line", "copy", "block"])
    return uses.select("mix_name", "source", "tool_type", F.col("id").alias(id_col), "copy", "shard", F.xxhash64("id", "copy", "line", F.lit(SEED + 3)).alias("place"), F.col("n").alias("n_chars"))


def write_shards(mixed: DataFrame, path: str) -> None:
    """One folder a mix and shard; its files follow each other in the shuffled order, cut where a task ends."""
    mixed.repartitionByRange("mix_name", "shard", "place").sortWithinPartitions("mix_name", "shard", "place").write.mode("overwrite").partitionBy("mix_name", "shard").parquet(path)


def report(used: DataFrame, lines: list[dict]) -> DataFrame:
    """Per line: target, planned and reached share, capacity, rows used, uses, most uses of one row, characters.

    planned_share is the target with what short lines lack given to the others; 0 for lines that have no rows.
    """
    spark = used.sparkSession
    about = spark.createDataFrame(
        [(x["line"], x["mix"], x["source"], x["tool"], x["share"], x["repeats"], x["rows"], x["total"], x["quota"], x["planned_share"]) for x in lines],
        f"line int, {USES}, target_share double, max_repeats int, available_rows long, available_chars long, planned_chars long, planned_share double",
    )
    got = used.where("copies > 0").groupBy("line").agg(F.count("*").alias("n_rows"), F.sum("copies").alias("n_uses"), F.max("copies").cast("long").alias("most_uses"), F.sum(F.col("n") * F.col("copies")).alias("chars"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = about.join(F.broadcast(got), "line", "left").select("mix_name", "source", "tool_type", "target_share", "max_repeats", "available_rows", "available_chars", "planned_chars", "planned_share", *map(zero, ("n_rows", "n_uses", "most_uses", "chars")))
    total = F.broadcast(out.groupBy("mix_name").agg(F.sum("chars").alias("mix_chars")))
    return out.join(total, "mix_name").withColumn("reached_share", F.col("chars") / F.greatest("mix_chars", F.lit(1))).drop("mix_chars")
