"""Filling fixed-capacity containers with items by vector best-fit (problem 9)."""

from bisect import bisect_left, insort
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.plans.lineage import cut

#: Items that one task packs; a group of that size wastes at most a fraction of one container in thousands.
GROUP_ITEMS = 20_000
#: Containers filled less than this are unpacked and packed again together with those of the other groups.
REPACK_FILL = 0.98


@dataclass(frozen=True)
class Limits:
    """Capacities of a container besides tokens, and the weights of what is left in choosing one.

    ``max_docs`` and ``max_attention`` (the sum of the squares of the item lengths) bound every container of two or more items;
    None means what tokens alone allow. ``tokens_per_doc`` and ``attention_share`` state them by capacity instead: one document per so many
    tokens, and a share of the square of the capacity.
    """

    max_docs: int | None = None
    max_attention: int | None = None
    w_tokens: float = 1.0
    w_docs: float = 0.01
    w_attention: float = 0.01
    tokens_per_doc: int | None = None
    attention_share: float | None = None

    def of(self, capacity: int) -> tuple[int, int]:
        """(documents, attention) that a container of a capacity may hold."""
        docs = self.max_docs or (max(1, capacity // self.tokens_per_doc) if self.tokens_per_doc else max(1, capacity))
        attention = self.max_attention or (int(self.attention_share * capacity * capacity) if self.attention_share else capacity * capacity)
        return docs, attention


#: Limits of the registered queries: a document per 16 tokens, so that empty and tiny texts do not pile up in one container, and nine
#: tenths of the attention that one document of full length costs.
PRODUCTION = Limits(tokens_per_doc=16, attention_share=0.9)


def best_fit(sizes: list[int], capacity: int, limits: Limits = Limits()) -> list[int]:
    """Container number of each size, sizes being given in decreasing order, none above ``capacity``.

    Each container has three residuals: tokens, documents and attention cost. An item goes where the weighted norm of what
    is left afterwards is least, among containers in which it fits in every respect, the earlier one of equals; else it opens a new
    one. An item whose own attention cost is above the limit has a container to itself.

    Containers are kept by token residual, then by documents left, then in order of attention left: of those with equal tokens
    and documents the first that still takes the item is the best. A bit mask finds the next token residual that occurs, and the
    search stops when the token part of the norm alone exceeds the best one found, so no container that could win is passed over.
    """
    max_docs, max_att = limits.of(capacity)
    wt, wd, wa = limits.w_tokens / capacity**2, limits.w_docs / max_docs**2, limits.w_attention / max_att**2
    free: dict[int, dict[int, list[tuple[int, int]]]] = {}
    mask = 0
    docs: list[int] = []
    att: list[int] = []
    out = []
    for s in sizes:
        cost = s * s
        best = None  # norm, container, tokens left, documents left, index in its list
        seek = mask >> s
        base = s
        while seek and cost <= max_att:
            r = base + (seek & -seek).bit_length() - 1
            part = wt * (r - s) ** 2
            if best and part > best[0]:
                break
            for d, row in free[r].items():
                i = bisect_left(row, (cost, -1))
                if i < len(row):
                    a, b = row[i]
                    after = part + wd * (d - 1) ** 2 + wa * (a - cost) ** 2
                    if best is None or (after, b) < best[:2]:
                        best = (after, b, r, d, i)
            seek >>= r - base + 1
            base = r + 1
        if best:
            _, b, r, d, i = best
            free[r][d].pop(i)
            if not free[r][d]:
                del free[r][d]
                if not free[r]:
                    del free[r]
                    mask &= ~(1 << r)
        else:
            b, r = len(docs), capacity
            docs.append(max_docs)
            att.append(max_att)
        docs[b] -= 1
        att[b] -= cost
        left = r - s
        if docs[b] > 0 and att[b] >= 0:
            insort(free.setdefault(left, {}).setdefault(docs[b], []), (att[b], b))
            mask |= 1 << left
        out.append(b)
    return out


def pieces(sizes: DataFrame, capacities: list[tuple[int, int]]) -> DataFrame:
    """Items for every capacity: a document above the capacity is cut into full pieces and a rest, all others stay whole.

    ``sizes``: doc_id, tokens. Result: capacity_id, capacity, doc_id, part, start_token, tokens. Null sizes count as 0; a document of 0
    tokens is an item of 0 tokens. ``capacities`` is a list of the driver, so each document meets each by an explode, not a join.
    """
    caps = F.explode(F.array(*[F.struct(F.lit(i).cast("bigint").alias("capacity_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c in capacities]))
    n, c = F.col("n"), F.col("cap.capacity")
    parts = F.greatest(F.lit(1), F.ceil(n / c)).cast("int")
    wide = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).alias("n"), caps.alias("cap")).select("doc_id", "n", "cap", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    start = F.col("part") * c
    return wide.select("cap.capacity_id", "cap.capacity", "doc_id", F.col("part").cast("bigint").alias("part"), start.cast("bigint").alias("start_token"), F.least(c, F.col("n") - start).cast("bigint").alias("tokens"))


def pack(sizes: DataFrame, capacities: list[tuple[int, int]], limits: Limits = Limits(), group_items: int = GROUP_ITEMS) -> DataFrame:
    """Containers for every capacity: (capacity_id, capacity, container_id, doc_id, part, start_token, tokens, alone).

    Every document is in exactly one container per capacity, whole, unless it alone exceeds the capacity; no container holds more
    tokens than its capacity, and none of two or more items more documents or attention cost than the limits allow. ``alone`` marks
    items whose own attention cost is above the limit; they have a container to themselves. Ties and repeated rows are separate items; an
    empty input gives no containers; non-positive capacities are an error.

    Plan: items are dealt by hash into groups of about ``group_items``, each packed in one task (size-bounded, whatever the key
    distribution), then the containers left with room are dissolved and their items packed again in few groups. Full pieces
    of long documents fill containers of their own and skip packing.
    """
    if any(c <= 0 for _, c in capacities):
        raise ValueError("capacities must be positive")
    items = pieces(sizes, capacities)
    # what fills a container by its tokens or its attention is one
    bound = F.coalesce(*[F.when(F.col("capacity_id") == i, F.lit(limits.of(c)[1])) for i, c in capacities]) if capacities else F.lit(0)
    items = items.withColumn("alone", F.col("tokens") * F.col("tokens") > bound)
    single = F.col("alone") | (F.col("tokens") == F.col("capacity"))
    full = items.where(single).withColumn("container_id", F.concat_ws("-", "capacity_id", F.lit("f"), "doc_id", "part"))
    rest = items.where(~single)
    first = _packed(rest, sizes.count() or 1, group_items, limits, "a")
    first = cut(first)
    again = first.where(F.col("fill") < REPACK_FILL * F.col("capacity"))
    counted = again.groupBy("capacity_id").count().agg(F.max("count")).first()[0] or 0
    kept = first.where(F.col("fill") >= REPACK_FILL * F.col("capacity"))
    second = _packed(again.select(rest.columns), counted, group_items * 4, limits, "b")
    names = ["capacity_id", "capacity", "container_id", "doc_id", "part", "start_token", "tokens", "alone"]
    return full.select(names).unionByName(kept.select(names)).unionByName(second.select(names))


def _packed(items: DataFrame, count: int, group_items: int, limits: Limits, mark: str) -> DataFrame:
    groups = max(1, -(-count // group_items))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], ignore_index=True)
        capacity = int(pdf["capacity"].iat[0])
        bins = best_fit(pdf["tokens"].tolist(), capacity, limits)
        b = pd.Series(bins)
        head = f"{pdf['capacity_id'].iat[0]}-{mark}{pdf['g'].iat[0]}-"
        pdf["container_id"] = head + b.astype(str)
        pdf["fill"] = pdf["tokens"].groupby(b).transform("sum")
        return pdf.drop(columns="g")

    schema = "capacity_id bigint, capacity bigint, doc_id bigint, part bigint, start_token bigint, tokens bigint, alone boolean, container_id string, fill bigint"
    dealt = items.withColumn("g", F.pmod(F.xxhash64("doc_id", "part", F.lit(mark)), F.lit(groups)).cast("int"))
    return dealt.groupBy("capacity_id", "g").applyInPandas(fill, schema)


def packing_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, items, tokens, items above the attention limit, the least number of containers that could hold the
    tokens, and the unused share."""
    per = packed.groupBy("capacity_id", "capacity").agg(F.count_distinct("container_id").alias("containers"), F.count("*").alias("items"), F.sum("tokens").alias("tokens"), F.count_if("alone").alias("alone"))
    return per.select("*", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused"))
