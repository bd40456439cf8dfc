"""Ranks of the chunks of one slot of posting blocks, for all questions of a pass.

A slot is one group: its blocks meet the questions whose terms all have a block in it (``wordhits``), so that neither
postings nor pairs of questions and chunks are rows of a shuffle; of a slot only each question's k best chunks leave, less
those that can't reach the k-th rank of slots seen before in the same task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeframe.operators.streams import passes
from lodeframe.operators.wordhits import PASS_WORDS, Batch, best_of, told


def _lengths(lists: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.list_value_length(lists), 0)).astype(np.int64)


class _Slot(Batch):
    """A slot's blocks as a batch of chunks; ``names``: the chunks' ids by their number."""

    def __init__(self, blocks: pa.Table, vocabulary: pa.Array):
        code = np.asarray(pc.index_in(blocks.column("token").combine_chunks(), value_set=vocabulary))
        by_code = np.argsort(code)
        lists, places = (blocks.column(c).combine_chunks().take(pa.array(by_code)) for c in ("chunks", "places"))
        coded = lists.flatten().dictionary_encode()
        by_name = np.asarray(pc.array_sort_indices(coded.dictionary)).astype(np.int64)
        number = np.empty(len(by_name), np.int64)
        number[by_name] = np.arange(len(by_name))
        each = places.flatten()
        held = np.zeros(len(vocabulary), np.int64)
        held[code[by_code]] = _lengths(lists)
        # entries of a block are in their chunks' order
        self.names = coded.dictionary.take(pa.array(by_name))
        self.list_up(held, number[np.asarray(coded.indices)], _lengths(each), np.asarray(each.flatten()).astype(np.int64), len(by_name))


def _ranked(k: int):
    def meet(sent):
        limit: list[np.ndarray] = []  # of the slots that this task has seen

        def ranked(blocks: pa.Table) -> pa.Table:
            asked = sent.value
            if not limit:
                limit.append(np.full(len(asked["offsets"]) - 1, np.inf))
            slot = _Slot(blocks, asked["words"])
            q, rows, rank = best_of(slot, asked, dict.fromkeys(range(len(asked["areas"]))), k, limit[0])
            return pa.table([asked["query_id"].take(pa.array(q)), slot.names.take(pa.array(rows)), pa.array(rank)], names=["query_id", "chunk_id", "rank"])

        return ranked

    return meet


def slot_ranks(blocks: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, chunk_id, rank: of every slot each question's best chunks with all its words, k of them at most but for ties.
    ``blocks``: slot, token, entries; ``asked``: query_id, ts, prefix. Blocks that lie by slot already are not shuffled."""
    part = lambda name: F.transform("entries", lambda e: e[name])
    left = blocks.select("slot", "token", part("chunk_id").alias("chunks"), part("pos").alias("places"))
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, chunk_id {left.schema['chunks'].dataType.elementType.simpleString()}, rank double"

    def opened(sent, own: DataFrame) -> DataFrame:
        words = own.select(F.explode("ts").alias("token")).distinct()
        some = left.join(F.broadcast(words) if sent.value["offsets"][-1] <= PASS_WORDS else words, "token", "left_semi")
        return some.groupBy("slot").applyInArrow(_ranked(k)(sent), kinds)

    return passes(blocks.sparkSession, asked.select("query_id", "ts", "prefix"), F.size("ts"), PASS_WORDS, told, opened)
