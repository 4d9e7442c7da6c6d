"""Filling containers of fixed capacity with texts, measured in tokens.

1. Every text is tokenized once, where it is read. A text longer than the capacity is cut into full pieces and a rest;
   nothing else is ever split. What remains per piece are a few numbers.
2. How many pieces there are of each length is a histogram of at most ``capacity`` + 1 counts, whatever the size of the
   corpus. On it the packing is planned: a container is opened with the longest length left; its gap is filled exactly
   by one, two or three lengths whose sum is indexed, as far as their counts last; where no such combination exists, the
   best-fitting (longest that fits) length is added and the smaller gap is tried again. A combination is consumed as
   often as its rarest length allows, so the plan has at most a few thousand patterns.
3. Pieces are numbered within their length without a global sort: a number within the task, plus the offset of the
   task, which comes from the (task, length) counts. The number decides pattern, container and position by binary search
   in the broadcast plan. No task ever sees a group of unbounded size, and a length that a third of all texts share is
   handled like any other.

Defined results: null and empty texts are pieces of 0 tokens, spread over the containers (into container 0 if there is
no other); a row that is repeated is packed as often as it stands there; an empty table gives no rows; extra columns
aren't read. Container numbers are dense from 0, positions count from 0 within a container.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut

# fixed value: the pre-tokenization pattern that belongs to the byte-level vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
CHUNK = 200_000  # characters encoded at once


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def token_counter(ranks: dict[bytes, int], pattern: str = PATTERN):
    import tiktoken

    encode = tiktoken.Encoding("lengths", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def count(text: str | None) -> int:
        if not text:
            return 0
        n = start = 0
        while len(text) - start > CHUNK:
            # between a letter and " x" the pattern always has a boundary, so the parts have the tokens of the whole
            end = start + CHUNK
            while end < len(text) - 1 and not (text[end] == " " and text[end - 1].isalpha() and text[end + 1].isalpha()):
                end += 1
            if end >= len(text) - 1:
                break
            n += len(encode(text[start:end]))
            start = end
        return n + len(encode(text[start:]))

    return count


@dataclass
class PackPlan:
    """Patterns as arrays: ``first[p]`` is the first container of pattern p, ``size[p]`` its number of pieces. Per length
    the ranks from ``start`` on belong to pattern ``pattern``, ``each`` to a container, from position ``at`` on."""

    first: np.ndarray
    size: np.ndarray
    containers: int
    by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    used: int


def _exact(counts: np.ndarray, gap: int) -> list[int] | None:
    """One, two or three available lengths that sum to the gap; the longest first."""
    if gap < len(counts) and counts[gap] > 0:
        return [gap]

    def pair(total: int, top: int) -> list[int] | None:
        hi = min(top, total - 1, len(counts) - 1)
        lo = (total + 1) // 2
        if hi < lo:
            return None
        a = np.arange(hi, lo - 1, -1)
        ok = (counts[a] > 0) & (counts[total - a] > 0)
        if total % 2 == 0 and counts[total // 2] < 2:
            ok &= a != total // 2
        k = int(np.argmax(ok)) if ok.any() else -1
        return [int(a[k]), total - int(a[k])] if k >= 0 else None

    if got := pair(gap, gap):
        return got
    for a in np.flatnonzero(counts[: gap - 1])[::-1] if gap > 2 else ():
        if 3 * a < gap:
            break
        counts[a] -= 1
        rest = pair(gap - int(a), int(a))
        counts[a] += 1
        if rest:
            return [int(a), *rest]
    return None


def plan_packing(histogram: dict[int, int], capacity: int) -> PackPlan:
    """Packing of a histogram length -> count; lengths from 1 to capacity."""
    counts = np.zeros(capacity + 1, np.int64)
    for k, n in histogram.items():
        if 0 < k <= capacity:
            counts[k] += n
    used = int((counts * np.arange(capacity + 1)).sum())
    patterns: list[tuple[int, dict[int, int]]] = []
    while counts.any():
        pattern: dict[int, int] = {}
        gap = capacity

        def take(k: int, pattern: dict[int, int] = pattern) -> None:
            pattern[k] = pattern.get(k, 0) + 1
            counts[k] -= 1

        top = int(np.flatnonzero(counts)[-1])
        take(top)
        gap -= top
        while gap:
            if got := _exact(counts, gap):
                for k in got:
                    take(k)
                break
            fits = np.flatnonzero(counts[: gap + 1])
            if not len(fits):
                break
            take(int(fits[-1]))
            gap -= int(fits[-1])
        more = min(int(counts[k]) // m for k, m in pattern.items())
        for k, m in pattern.items():
            counts[k] -= more * m
        patterns.append((1 + more, pattern))
    first = np.cumsum([0, *[n for n, _ in patterns]])
    parts: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    for p, (n, pattern) in enumerate(patterns):
        at = 0
        for k in sorted(pattern, reverse=True):
            m = pattern[k]
            parts.setdefault(k, []).append((ranks.get(k, 0), p, m, at))
            ranks[k] = ranks.get(k, 0) + n * m
            at += m
    by_length = {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in parts.items()}
    return PackPlan(first[:-1].astype(np.int64), np.array([sum(x.values()) for _, x in patterns], np.int64), int(first[-1]), by_length, used)


def place(plan: PackPlan, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(container, position) of the pieces with these lengths and ranks within their length."""
    container, position = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    if not len(length):
        return container, position
    order = np.argsort(length, kind="stable")
    values, starts = np.unique(length[order], return_index=True)
    for k, a, b in zip(values, starts, [*starts[1:], len(order)], strict=True):
        mine = order[a:b]
        r = rank[mine]
        if k == 0:
            n = max(1, plan.containers)
            container[mine] = r % n
            p = np.searchsorted(plan.first, r % n, side="right") - 1
            position[mine] = r // n + (plan.size[p] if plan.containers else 0)
            continue
        start, pattern, each, at = plan.by_length[int(k)]
        j = np.searchsorted(start, r, side="right") - 1
        q = r - start[j]
        container[mine] = plan.first[pattern[j]] + q // each[j]
        position[mine] = at[j] + q % each[j]
    return container, position


def pieces(documents: DataFrame, capacity: int, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, task, task_rank): one row per text or piece; task_rank counts the pieces of
    a length within a task."""
    ranks = documents.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # the vocabulary: a fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = token_counter(ranks.value)
        seen: dict[int, int] = {}
        task = TaskContext.get().partitionId()
        for pdf in batches:
            rows = []
            for doc, text in zip(pdf["d"], pdf["t"], strict=True):
                n = count(text)
                for piece in range(max(1, -(-n // capacity))):
                    k = min(capacity, n - piece * capacity)
                    seen[k] = seen.get(k, -1) + 1
                    rows.append((doc, piece, piece * capacity, k, task, seen[k]))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "token_start", "n_tokens", "task", "task_rank"])

    d = documents.select(F.col(id_column).cast("bigint").alias("d"), F.col(text_column).alias("t"))
    return d.mapInPandas(run, "doc_id long, piece int, token_start long, n_tokens int, task int, task_rank long")


def pack(documents: DataFrame, capacity: int = 2048, vocabulary: str = VOCABULARY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, piece, token_start, n_tokens, container_id, position)."""
    items = cut(pieces(documents, capacity, vocabulary, id_column, text_column))
    per_task = items.groupBy("task", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.n_tokens: r.n for r in per_task.groupBy("n_tokens").agg(F.sum("n").alias("n")).collect()}  # at most capacity + 1 rows
    plan = plan_packing(histogram, capacity)
    shared = items.sparkSession.sparkContext.broadcast(plan)  # bounded by the capacity
    before = F.sum("n").over(W.partitionBy("n_tokens").orderBy("task").rowsBetween(W.unboundedPreceding, -1))
    offsets = per_task.select("task", "n_tokens", F.coalesce(before, F.lit(0)).alias("offset"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c, p = place(shared.value, pdf["n_tokens"].to_numpy(np.int64), pdf["rank"].to_numpy(np.int64))
            yield pdf.drop(columns="rank").assign(container_id=c, position=p)

    ranked = items.join(offsets, ["task", "n_tokens"]).select("doc_id", "piece", "token_start", "n_tokens", (F.col("offset") + F.col("task_rank")).alias("rank"))
    return ranked.mapInPandas(run, "doc_id long, piece int, token_start long, n_tokens int, container_id long, position long")
