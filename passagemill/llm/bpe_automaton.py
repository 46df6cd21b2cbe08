"""BPE with word ends as a deterministic automaton over tokens, after Berglund, Martens and van der Merwe (2024).

The automaton accepts exactly the token sequences that the merges produce. It is compiled by one gadget per merge (u, v):
u leads from now on to a new state, a copy of its old one without the arc v, and the merged token's arc stands beside every
arc u and leads where v leads. Arcs are not copied: a state keeps its parent and the arc that it lost, and an arc of a merged
token is derived from the arc of its left part in the state as it was when the merge came.

A word is read symbol by symbol; as every prefix has exactly one accepted path, the table of arcs decides each step.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

WORD_CACHE = 400_000  # a worker remembers the tokens of so many white-space separated words, twice
ARCS = 1_000_000  # entries of the transition table that a worker holds at once


class Automaton:
    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        self.number = dict(vocabulary)  # the tokens that have an arc
        self.never: set[int] = set()  # merged tokens that no text ever has
        self.label = {number: token for token, number in vocabulary.items()}
        self.longest = max(map(len, vocabulary), default=1)
        # Per state: the token that leads to it, and the number of the merge that made it. State 0 has every arc.
        self.owner, self.made = [-1], [-1]
        self.enter: dict[int, int] = {}  # token -> the state it leads to
        self.origin: dict[int, int] = {}  # token -> the state it led to when it came into being
        self.born: dict[int, int] = {}  # merged token -> the number of its merge
        self.left: dict[int, int] = {}  # merged token -> its left part
        self.lost: dict[tuple[int, int], int] = {}  # (u, v) -> the merge that took the arc v away behind u
        self.family: dict[int, tuple[list[int], list[int]]] = {}  # u -> merges, and the states they made behind u
        self.arcs: dict[int, bool] = {}  # by state and token
        for number, (left, right) in enumerate(merges):
            self._gadget(number, vocabulary[left], vocabulary[right], vocabulary[left + right])

    def _gadget(self, number: int, u: int, v: int, merged: int) -> None:
        if merged in self.born or merged in self.never:
            raise ValueError("two merges make the same token")
        if u in self.never or v in self.never or not self._derive(self.enter.get(u, 0), v):
            self.never.add(merged)  # earlier merges leave no u before a v
            self.number.pop(self.label[merged])
            return
        old = self.enter.get(v, 0)
        state = len(self.owner)
        self.owner.append(u)
        self.made.append(number)
        numbers, states = self.family.setdefault(u, ([], []))
        numbers.append(number)
        states.append(state)
        self.enter[u] = state
        self.enter[merged] = self.origin[merged] = old
        self.born[merged], self.left[merged], self.lost[u, v] = number, u, number

    def has_arc(self, state: int, token: int) -> bool:
        """Whether ``token`` may follow in ``state``: the row of the transition table, filled as it is used."""
        known = self.arcs.get(state << 32 | token)
        if known is None:
            if len(self.arcs) >= ARCS:
                self.arcs.clear()
            known = self.arcs[state << 32 | token] = self._derive(state, token)
        return known

    def _derive(self, state: int, token: int) -> bool:
        while True:
            above = state
            while above:  # the arcs that the state and those it was copied from have lost
                owner = self.owner[above]
                if self.lost.get((owner, token), self.made[above] + 1) <= self.made[above]:
                    return False
                above = self.origin.get(owner, 0)
            since = self.born.get(token)
            if since is None:
                return True
            while state and self.made[state] > since:  # the state as it was when the token came
                owner = self.owner[state]
                numbers, states = self.family[owner]
                place = bisect_right(numbers, since)
                state = states[place - 1] if place else self.origin.get(owner, 0)
            token = self.left[token]

    def encode(self, symbols: list[str]) -> list[int]:
        """The tokens of one word, given as its base symbols.

        Long arcs are tried first. An accepted path to a place is the only one, so a place that led nowhere is not tried again.
        """
        n, word, ends = len(symbols), "".join(symbols), [0]
        for symbol in symbols:
            ends.append(ends[-1] + len(symbol))
        number_of, enter, arcs = self.number.get, self.enter.get, self.arcs
        path, dead = [(0, 0, 0)], [False] * (n + 1)  # of each step: where it ends, the state, and its token
        begin, state, end = 0, 0, min(n, self.longest)
        while begin < n:
            start = ends[begin]
            while end > begin:
                token = number_of(word[start : ends[end]])
                if token is not None and not dead[end]:
                    allowed = arcs.get(state << 32 | token)
                    if allowed if allowed is not None else self.has_arc(state, token):
                        break
                end -= 1
            if end > begin:
                begin, state = end, enter(token, 0)
                path.append((begin, state, token))
                end = min(n, begin + self.longest)
                continue
            dead[begin] = True
            if len(path) == 1:
                raise ValueError("a symbol is not in the vocabulary")
            end = path.pop()[0] - 1
            begin, state, _ = path[-1]
        return [token for _, _, token in path[1:]]


class Codec:
    """Encodes whole texts by the automaton, and decodes ids by emitting the labels of their arcs.

    The library's own normaliser and pre-tokeniser cut the words; nothing that they do reaches over white space, so
    each white-space separated word is encoded once and remembered.
    """

    def __init__(self, definition: str):
        model = json.loads(definition)
        if model["decoder"] is not None or model["post_processor"] is not None or model["model"]["type"] != "BPE":
            raise ValueError("this kind of tokenizer is not supported")
        self.tokenizer = Tokenizer.from_str(definition)
        if any(entry["lstrip"] or entry["rstrip"] or entry["single_word"] or entry["content"].split() != [entry["content"]] for entry in model["added_tokens"]):
            raise ValueError("special tokens that reach over white space or need word bounds are not supported")
        # Only a normaliser that does nothing else to plain letters lets them pass by it.
        letters = "abcXYZ"
        shown = self.tokenizer.normalizer.normalize_str(letters) if self.tokenizer.normalizer else letters
        self.plain = {letters: str, letters.lower(): str.lower}.get(shown)
        self.special = {entry["content"]: entry["id"] for entry in model["added_tokens"]}
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge) for merge in model["model"]["merges"]]
        self.suffix = model["model"]["end_of_word_suffix"] or ""
        self.automaton = Automaton(model["model"]["vocab"], merges)
        self.label = self.automaton.label | {number: token for token, number in self.special.items()}
        # Ids and labels of words met lately; the older half leaves when the younger one is full.
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.older: dict[bytes, tuple[bytes, bytes]] = {}
        self.pieces: dict[str, list[int]] = {}

    def _encode(self, word: str) -> list[int]:
        if self.plain and word.isascii() and word.isalpha():  # one piece whatever the pattern
            return self._piece(self.plain(word))
        ids: list[int] = []
        for part in self.splitter.split(word) if self.splitter else [word]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                plain = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
                    if piece:
                        ids += self._piece(piece)
        return ids

    def _piece(self, piece: str) -> list[int]:
        known = self.pieces.get(piece)
        if known is None:
            known = self.automaton.encode([*piece[:-1], piece[-1] + self.suffix])
            if len(piece) <= 64:
                if len(self.pieces) >= WORD_CACHE:
                    self.pieces = {}
                self.pieces[piece] = known
        return known

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.label[number] for number in ids)

    def _learn(self, word: bytes) -> tuple[bytes, bytes]:
        known = self.older.pop(word, None)
        if known is None:
            numbers = self._encode(word.decode())
            known = struct.pack(f"<{len(numbers)}I", *numbers), self.decode(numbers).encode()
        if len(word) <= 64:
            if len(self.words) >= WORD_CACHE:
                self.older, self.words = self.words, {}
            self.words[word] = known
        return known

    def run(self, text: str) -> tuple[int, str, str]:
        """The number of ids, the SHA-256 of the ids as little-endian 32-bit integers, and that of the decoded text."""
        entries = []
        for word in text.encode().split():
            entries.append(self.words.get(word) or self._learn(word))
        ids = b"".join([entry[0] for entry in entries])
        decoded = b" ".join([entry[1] for entry in entries if entry[1]])
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()


_codecs: dict[str, Codec] = {}


def codec_of(definition: str) -> Codec:
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(definition)
    return _codecs[key]


def round_trip(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of each row's whole text.

    Ids equal those of the tokenizer's own library without added special tokens; special strings inside a text are special
    tokens, as is its default. The file is read by the driver and broadcast (its size is the vocabulary's). Null and empty
    texts have no ids; repeated rows and rows without an id are encoded each; an empty table gives an empty table; other
    columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(definition.value)
        for batch in batches:
            counts, ids, decoded = [], [], []
            for text in batch.column("_text"):
                for values, value in zip((counts, ids, decoded), codec.run(text.as_py() or "")):
                    values.append(value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    id_type = rows.schema["_id"].dataType.simpleString()
    return rows.mapInArrow(kernel, f"_id {id_type}, n_tokens bigint, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
