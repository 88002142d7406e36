"""Greedy word-piece counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .text import blocks, byte_rows, one_array, prepare, sums, words_of


class Automaton:
    """A trie over the bytes of a vocabulary with failure links and popped-token counts.

    ``fail[v]`` is the state after the pieces that greedy matching is sure of at ``v`` have
    been popped, and ``pops[v]`` how many those are; ``fail`` is -1 where no piece of the
    vocabulary can follow. A text is read once, byte by byte, and no piece is built.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        children: list[dict[int, int]] = [{}]
        accepts = [False]
        for piece in vocabulary:
            state = 0
            for byte in piece:
                step = children[state].get(byte)
                if step is None:
                    step = len(children)
                    children[state][byte] = step
                    children.append({})
                    accepts.append(False)
                state = step
            accepts[state] = state != 0
        fail, pops = [-1] * len(children), [0] * len(children)
        level = [0]
        while level:
            following = []
            for state in level:
                for byte, child in children[state].items():
                    following.append(child)
                    if accepts[child]:
                        fail[child], pops[child] = 0, 1
                        continue
                    back, popped = fail[state], pops[state]
                    while back >= 0 and byte not in children[back]:
                        popped += pops[back]
                        back = fail[back]
                    if back >= 0:
                        fail[child], pops[child] = children[back][byte], popped
            level = following
        edges = sorted((state << 8 | byte, child) for state, step in enumerate(children) for byte, child in step.items())
        self.keys = np.array([k for k, _ in edges] + [np.iinfo(np.int64).max], np.int64)
        self.targets = np.array([c for _, c in edges] + [-1], np.int64)
        self.fail = np.array(fail, np.int64)
        self.pops = np.array(pops, np.int64)

    def step(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        wanted = states << 8 | symbols
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.targets[at], -1)

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Pieces of each row of bytes; a row that has no full match is one unknown piece."""
        lengths = np.diff(offsets)
        order = np.argsort(-lengths, kind="stable")
        starts, lengths = offsets[:-1][order], lengths[order]
        states = np.zeros(len(order), np.int64)
        total = np.zeros(len(order), np.int64)
        lost = np.zeros(len(order), bool)
        for column in range(int(lengths[0]) if len(lengths) else 0):
            active = np.searchsorted(-lengths, -column, side="left")  # rows longer than the column
            rows = np.flatnonzero(~lost[:active])
            symbols = data[starts[rows] + column].astype(np.int64)
            while len(rows):
                reached = self.step(states[rows], symbols)
                found = reached >= 0
                states[rows[found]] = reached[found]
                rows, symbols = rows[~found], symbols[~found]
                back = self.fail[states[rows]]
                total[rows] += self.pops[states[rows]]
                gone = back < 0
                lost[rows[gone]] = True
                states[rows] = back
                rows, symbols = rows[~gone], symbols[~gone]
        rows = np.flatnonzero(~lost & (states > 0))
        while len(rows):  # pop what is left at the end of a row
            back = self.fail[states[rows]]
            total[rows] += self.pops[states[rows]]
            lost[rows[back < 0]] = True
            states[rows] = back
            rows = rows[back > 0]
        total[lost] = 1
        result = np.empty(len(order), np.int64)
        result[order] = total
        return result


@lru_cache(maxsize=2)
def load(path: str) -> Automaton:
    """The automaton of a file with one base64 piece and its rank in each line."""
    with open(path, "rb") as lines:
        return Automaton(base64.b64decode(line.split()[0]) for line in lines if line.strip())


def token_counts(documents: DataFrame, vocabulary: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Words and greedy longest-match pieces of every whole text.

    ``vocabulary`` is a file that every machine has at that path. A word is a run of other
    than ASCII white space and is read with a space before it, as the vocabulary has its
    word beginnings; a word that the vocabulary cannot cover counts as one piece.

    NULL and empty texts have no words. Every row of the input gives a row, repeated and
    NULL ids too; other columns are not read.
    """
    prepare(documents.sparkSession)
    kind = documents.schema[id_column].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = load(vocabulary)
        for table in blocks(batches):
            codes, offsets, words = words_of(one_array(table.column("text")), lower=False)
            data, starts = byte_rows(words.cast(pa.string()))
            spaced = np.full(len(data) + len(words), 32, np.uint8)
            shifted = starts + np.arange(len(starts))
            place = np.ones(len(spaced), bool)
            place[shifted[:-1]] = False
            spaced[place] = data
            pieces = automaton.counts(spaced, shifted)
            yield pa.RecordBatch.from_arrays(
                [one_array(table.column("id")), pa.array(np.diff(offsets)), pa.array(sums(pieces[codes], offsets))],
                ["id", "n_words", "n_pieces"],
            )

    rows = documents.select(documents[id_column].alias("id"), documents[text_column].alias("text"))
    counted = rows.mapInArrow(count, f"id {kind}, n_words long, n_pieces long")
    return counted.withColumnRenamed("id", id_column)
