"""Byte-level BPE by a deterministic automaton over token labels.

The automaton starts as one state with an arc for every byte. Each merge
(a, b) -> ab, taken in rank order, adds a gadget: the state that arcs labelled
a lead to loses its b arc, and ab arcs are added beside the a arcs, leading
where b led. A path that spells a word is then its BPE encoding, and there is
exactly one. All arcs with one label lead to one state, so a state is known by
the last label. The whole table has a row for each of 50,000 states and a column
for each of as many labels, yet it follows from the merges: a state has the
arcs of the state it was copied from but for those it lost since. So it is
compiled on the driver into arrays of the merges and of the spelling trie, which
are sent to the workers; an entry is worked out when first used and remembered.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the published pre-splitting pattern of the byte_bpe_50k vocabulary.
PRE_SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Encoded words a Python worker keeps at a time.
CACHE_WORDS = 400_000
#: Entries of the transition table that a worker remembers.
CACHE_ARCS = 2_000_000
_FOREVER = 1 << 60


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file (base64 token and rank per line), in rank order."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return [base64.b64decode(a) for a, _ in sorted(pairs, key=lambda p: int(p[1]))]


class TokenAutomaton:
    """Encoder and decoder over compiled tables (ids are ranks).

    labels: spelling of each label; left, right: its parts, -1 for bytes; trie:
    next node by 256 * node + byte; ends: label that a trie node spells or -1.
    """

    def __init__(self, labels: list[bytes], left: list[int], right: list[int], trie: dict[int, int], ends: list[int]):
        self.labels, self.left, self.right, self.trie, self.ends = labels, left, right, trie, ends
        self.arcs: dict[int, bool] = {}
        self.lost: list[dict[int, int]] = [{} for _ in labels]
        for token, (a, b) in enumerate(zip(left, right)):
            if a >= 0:
                self.lost[a][b] = token

    @classmethod
    def compiled(cls, tokens: list[bytes]) -> TokenAutomaton:
        """The automaton of tokens in rank order, by one gadget for each merge."""
        machine = cls(tokens, [-1] * len(tokens), [-1] * len(tokens), {}, [-1])
        for token, spelled in enumerate(tokens):
            if len(spelled) > 1:
                path = machine._path(spelled)
                if len(path) != 2:
                    raise ValueError(f"token {token} is not the merge of two earlier ones")
                a, b = path
                machine.left[token], machine.right[token] = a, b
                machine.lost[a][b] = token
                machine.arcs.clear()
            node = 0
            for byte in spelled:
                key = 256 * node + byte
                if key not in machine.trie:
                    machine.trie[key] = len(machine.ends)
                    machine.ends.append(-1)
                node = machine.trie[key]
            machine.ends[node] = token
        machine.arcs.clear()
        return machine

    def tables(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """What ``from_tables`` makes the automaton of again."""
        return self.labels, np.array(self.left, np.int32), np.array(self.right, np.int32), np.array([*self.trie], np.int32), np.array([*self.trie.values()], np.int32), np.array(self.ends, np.int32)

    @classmethod
    def from_tables(cls, labels, left, right, keys, nodes, ends) -> TokenAutomaton:
        return cls(labels, left.tolist(), right.tolist(), dict(zip(keys.tolist(), nodes.tolist())), ends.tolist())

    def _has_arc(self, state: int, label: int) -> bool:
        """Whether the state that label ``state`` leads to has an arc ``label``.

        An arc for a merged label exists where the arc of its left part existed
        when the merge was made, so the left parts are followed; a state shares
        the losses of its right part's state up to its own making.
        """
        until = _FOREVER
        lost, left, right = self.lost, self.left, self.right
        while True:
            copied, at = _FOREVER, state
            while True:
                when = lost[at].get(label)
                if when is not None and when < copied and when <= until:
                    return False
                if right[at] < 0:
                    break
                copied, at = at, right[at]  # a label is numbered by when it was made
            if left[label] < 0:
                return True
            until, label = label, left[label]

    def _path(self, word: bytes) -> list[int]:
        """Labels of the one path that spells ``word``."""
        n = len(word)
        last = [-1] * (n + 1)
        step, ends, arcs, size = self.trie.get, self.ends, self.arcs, len(self.labels)
        for i in range(n):
            state = last[i]
            if state < 0 and i:
                continue
            node = 0
            for j in range(i, n):
                node = step(256 * node + word[j], -1)
                if node < 0:
                    break
                label = ends[node]
                if label >= 0:
                    if i:
                        key = state * size + label
                        ok = arcs.get(key)
                        if ok is None:
                            if len(arcs) >= CACHE_ARCS:
                                arcs.clear()
                            ok = arcs[key] = self._has_arc(state, label)
                        if not ok:
                            continue
                    last[j + 1] = label
        path = []
        while n:
            path.append(last[n])
            n -= len(self.labels[last[n]])
        return path[::-1]

    def encode(self, text: str, words: dict[str, list[int]]) -> list[int]:
        """Ids of a text; ``words`` keeps the paths of words met before."""
        out: list[int] = []
        for word in _split(text):
            ids = words.get(word)
            if ids is None:
                if len(words) >= CACHE_WORDS:
                    words.clear()
                ids = words[word] = self._path(word.encode())
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined."""
        return b"".join([self.labels[i] for i in ids]).decode(errors="replace")


_split = regex.compile(PRE_SPLIT).findall
_compiled: dict[str, TokenAutomaton] = {}
_made: dict[str, tuple[TokenAutomaton, dict[str, list[int]]]] = {}


def automaton(vocabulary: str, folder: str = TOKENIZERS) -> TokenAutomaton:
    """The automaton of a vocabulary, compiled once per process."""
    path = f"{folder}/{vocabulary}.tiktoken"
    if path not in _compiled:
        _compiled[path] = TokenAutomaton.compiled(read_ranks(path))
    return _compiled[path]


def _sent(spark: SparkSession, vocabulary: str, folder: str):
    """A function that gives a worker its automaton and word store; the tables travel, as large as the vocabulary, and the file is read by the driver only."""
    name, tables = f"{folder}/{vocabulary}", spark.sparkContext.broadcast(automaton(vocabulary, folder).tables())

    def made() -> tuple[TokenAutomaton, dict[str, list[int]]]:
        if name not in _made:
            _made[name] = TokenAutomaton.from_tables(*tables.value), {}
        return _made[name]

    return made


def encode_column(df: DataFrame, text: str, keep: list[str], vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and ids (array<int>): the tokens of ``text``, without special tokens.

    Null and empty texts give an empty list; strings of special tokens are
    ordinary text; texts of any length are encoded whole; each row is encoded
    by itself, so repeated rows and empty tables need no care.
    """
    names = list(dict.fromkeys(keep))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema] + ["ids array<int>"])

    made = _sent(df.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, words = made()
        for batch in batches:
            ends, parts = [0], []
            for value in batch.column("_text"):
                ids = machine.encode(value.as_py() or "", words)
                parts.append(np.array(ids, np.int32))
                ends.append(ends[-1] + len(ids))
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [lists], names=[*names, "ids"])

    return df.select(*names, df[text].alias("_text")).mapInArrow(run, schema)


def decode_column(df: DataFrame, ids: str, keep: list[str], vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``keep`` columns and text: the inverse of ``encode_column`` (a null list gives an empty text)."""
    names = list(dict.fromkeys(keep))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*names).schema] + ["text string"])

    made = _sent(df.sparkSession, vocabulary, folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, _ = made()
        for batch in batches:
            texts = [machine.decode(v.as_py() or []) for v in batch.column("_ids")]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(texts, pa.string())], names=[*names, "text"])

    return df.select(*names, df[ids].alias("_ids")).mapInArrow(run, schema)
