"""Problem 9: filling fixed-capacity containers with items, by minimum bin slack."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm._positions import positions
from panelforge.llm.encode import count_tokens
from panelforge.plans.lineage import cut


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum is closest to ``room`` from below.

    Subset sums are the bits of one integer: bit s is set once s can be reached. Lengths are taken longest first, their
    counts by doubling; the search ends once ``room`` itself is reached. Counts are then traced back through the
    integers before each length.
    """
    mask, reach = (1 << (room + 1)) - 1, 1
    steps: list[tuple[int, int]] = []
    for length in sorted((x for x in counts if 0 < x <= room and counts[x] > 0), reverse=True):
        steps.append((length, reach))
        left, part = min(counts[length], room // length), 1
        while left > 0:
            take = min(part, left)
            reach |= (reach << (length * take)) & mask
            left -= take
            part *= 2
        if reach >> room & 1:
            break
    best = reach.bit_length() - 1
    picked: dict[int, int] = {}
    for length, before in reversed(steps):
        k = 0
        while not before >> best & 1:
            best -= length
            k += 1
        if k:
            picked[length] = k
    return picked


def fill_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, containers, lengths in each) that use up ``counts`` (length -> number of items, 1..capacity).

    Each pattern holds the longest length left (it only gets harder to place) and the fullest choice for the rest of the
    container, and is repeated as long as the counts allow. So the number of patterns follows the number of different
    lengths, at most ``capacity``, not the number of items.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    plan: list[tuple[int, int, dict[int, int]]] = []
    first = 1
    while left:
        longest = max(left)
        left[longest] -= 1
        pattern = fullest(left, capacity - longest)
        left[longest] += 1
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(left[k] // c for k, c in pattern.items())
        plan.append((first, times, pattern))
        first += times
        for k, c in pattern.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
    return plan


def pack(items: DataFrame, item: str, size: str, capacity: int) -> DataFrame:
    """item, piece_no, n_tokens, container_id: every row of ``items`` placed in containers of ``capacity``.

    An item above the capacity is cut into full pieces and a rest; others stay whole (piece_no 1). Null, zero and
    negative sizes need no room: they are spread evenly over the containers (container 0 if there are none). Repeated
    rows are items of their own; an empty table gives no rows. ``item`` needs an order; null items are allowed.
    """
    return pack_all(items, item, size, {0: capacity}).drop("budget_id")


def pack_all(items: DataFrame, item: str, size: str, capacities: dict[int, int]) -> DataFrame:
    """``pack`` for several capacities at once, by budget_id.

    Only how many items there are of each size is gathered, at most ``capacity`` numbers; the plan made of them says
    which places of each size lie in which container. Items get their places within their size by one global sort.
    """
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be at least 1")
    spark = items.sparkSession
    whole = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    budgets = F.explode(F.array(*(F.struct(F.lit(b).alias("budget_id"), F.lit(c).alias("capacity")) for b, c in capacities.items()))).alias("b")
    cuts = items.select(F.col(item).alias("item"), whole.alias("n"), budgets).select("item", "n", "b.*")
    pieces = F.sequence(F.lit(1), F.greatest(F.ceil(F.col("n") / F.col("capacity")), F.lit(1)).cast("int"))
    rows = cuts.select("budget_id", "capacity", "item", "n", F.explode(pieces).alias("piece_no"))
    rows = cut(rows.select("budget_id", "item", "piece_no", F.least(F.col("capacity"), F.col("n") - (F.col("piece_no") - 1) * F.col("capacity")).cast("int").alias("n_tokens")))
    histograms: dict[int, dict[int, int]] = {b: {} for b in capacities}
    for r in rows.filter("n_tokens > 0").groupBy("budget_id", "n_tokens").agg(F.count("*").alias("c")).collect():  # at most the capacities
        histograms[r["budget_id"]][r["n_tokens"]] = r["c"]
    # one entry a pattern and length: their number follows the capacity, not the items
    table = []
    for b, capacity in capacities.items():
        lists: dict[int, tuple[list, list, list]] = {0: ([], [], [])}
        used = dict.fromkeys(histograms[b], 0)
        containers = 0
        for first, times, pattern in fill_plan(histograms[b], capacity):
            containers = first + times - 1
            for length, each in pattern.items():
                for values, x in zip(lists.setdefault(length, ([], [], [])), (used[length] + 1, each, first)):
                    values.append(x)
                used[length] += each * times
        table += [(b, length, containers, *values) for length, values in lists.items()]
    # a pattern uses up a length, so there are at most ``capacity`` of them, of at most sqrt(2 x capacity) different lengths
    most = max((len(row[3]) for row in table), default=1)
    spans = spark.createDataFrame(table, "budget_id int, n_tokens int, containers long, starts array<long>, eachs array<long>, firsts array<long>")
    placed = positions(rows, ["budget_id", "n_tokens"], [F.col("item").asc_nulls_first(), F.col("piece_no").asc()], "place")
    found = placed.join(F.broadcast(spans), ["budget_id", "n_tokens"]).withColumn("k", _last_at_most("starts", "place", most))
    container = F.get("firsts", F.col("k")) + F.floor((F.col("place") - F.get("starts", F.col("k"))) / F.get("eachs", F.col("k")))
    empty = F.when(F.col("containers") > 0, F.pmod(F.col("place") - 1, F.col("containers")) + 1).otherwise(F.lit(0))
    return found.select("budget_id", F.col("item").alias(item), "piece_no", "n_tokens", F.when(F.col("n_tokens") == 0, empty).otherwise(container).cast("long").alias("container_id"))


def _last_at_most(starts: str, value: str, most: int):
    """Index of the last element of an ascending array, of at most ``most``, that is not above the value; the first always is not."""
    step = lambda acc, p: F.when((acc + p < F.size(starts)) & (F.get(F.col(starts), acc + p) <= F.col(value)), acc + p).otherwise(acc)
    powers = F.array(*(F.lit(1 << i) for i in range(max(most, 1).bit_length() - 1, -1, -1)))
    return F.aggregate(powers, F.lit(0), step)


def pack_documents(documents: DataFrame, budgets: DataFrame) -> DataFrame:
    """budget_id, doc_id, piece_no, n_tokens, container_id for each budget of purpose pack (a table of a few rows)."""
    capacities = {b["budget_id"]: b["max_tokens"] for b in budgets.filter("lower(purpose) = 'pack' and max_tokens > 0").orderBy("budget_id").collect()}  # 6 rows at any scale
    if not capacities:
        return documents.sparkSession.createDataFrame([], "budget_id int, doc_id long, piece_no int, n_tokens int, container_id long")
    return pack_all(count_tokens(documents, "doc_id", "text"), "doc_id", "n_tokens", capacities)
