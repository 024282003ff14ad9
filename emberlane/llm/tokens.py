"""Token counts by a compiled finite-state transducer.

A byte-pair vocabulary is compiled, as far as texts need it, into a deterministic transducer over characters: a state holds
the vocabulary prefixes that the last characters may still complete, each with the last token before it, and a transition
carries the number of tokens it emits (which may be negative, when a longer token swallows shorter ones). Whether two
tokens may stand side by side is decided once, by running the merges on the two alone; a tokenization whose neighbours
all may is the one that merging makes of the whole text.

No piece holds a space after another character, so the transducer is back in one state wherever a space begins after
something else, and likewise behind any character without pieces of its own (a line break, for one), which costs its
UTF-8 bytes. A chunk of text thus has a small state map: what it reads before its first such place (to be run from
whichever state comes in), the tokens from there on, and the state it ends in. Maps compose associatively, so the chunks of
a long text are summed by a parallel prefix scan. Stretches between such places are remembered with their counts.

Null texts are empty and have no tokens. Repeated rows are counted alike, an empty table gives no rows; only the id and the
text are read, whatever other columns there are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Characters of a chunk: longer texts are scanned chunk by chunk.
CHUNK = 1 << 16
#: Remembered stretches and states; beyond it the memory is emptied and filled again, with the same results.
MEMORY = 700_000
STATES = 250_000
_SPACE = "▁"


class Transducer:
    """Counts tokens of a sentencepiece BPE vocabulary with byte fallback and a leading space."""

    def __init__(self, pieces: dict[str, float]):
        self.score = pieces
        self.single = {c for p in pieces for c in p}
        joined = {c for p in pieces if len(p) > 1 for c in p}
        #: characters that never merge: one token if they are a piece, otherwise one for each byte
        self.alone = {"\n"} - joined
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces) or not self.alone:
            raise ValueError("this vocabulary has pieces across word starts")
        self.prefixes: dict[str, int] = {"": 0}
        self.children: list[dict[str, int]] = [{}]
        self.token_at: list[str | None] = [None]
        for piece in pieces:
            if self._merged(piece) == [piece]:
                node = 0
                for c in piece:
                    if c not in self.children[node]:
                        self.children[node][c] = len(self.children)
                        self.children.append({})
                        self.token_at.append(None)
                    node = self.children[node][c]
                self.token_at[node] = piece
        self.pairs: dict[tuple[str, str], bool] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: (live prefixes as (node, token before or None, tokens since), last token or None)
        self.states: list[tuple] = [((), None)]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]
        self.memory: dict[str, int] = {}

    def _merged(self, text: str) -> list[str]:
        """The merges themselves, on a short text: best score first, leftmost among equals."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _may_follow(self, left: str | None, right: str) -> bool:
        if left is None:
            return True
        found = self.pairs.get((left, right))
        if found is None:
            found = self.pairs[left, right] = self._merged(left + right) == [left, right]
        return found

    def _compile(self, state: int, char: str) -> tuple[int, int]:
        """The transition from a state on a character: (next state, tokens emitted)."""
        live, last = self.states[state]
        chosen, emitted, moved = None, 0, []
        for node, before, since in (*live, (0, last, 0)):
            after = self.children[node].get(char)
            if after is None:
                continue
            token = self.token_at[after]
            if token is not None and chosen is None and self._may_follow(before, token):
                chosen, emitted = token, since + 1
            if self.children[after]:
                moved.append((after, before, since))
        if chosen is None:
            target, emitted = ((), None), len(char.encode("utf-8", "surrogatepass"))
        else:
            target = (tuple((n, b, s - emitted) for n, b, s in moved), chosen)
        to = self.number.get(target)
        if to is None:
            to = self.number[target] = len(self.states)
            self.states.append(target)
            self.moves.append({})
        self.moves[state][char] = to, emitted
        return to, emitted

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """(state, tokens) after reading a text from a state."""
        total, moves = 0, self.moves
        for char in text:
            move = moves[state].get(char) or self._compile(state, char)
            state = move[0]
            total += move[1]
        return state, total

    def stretch(self, text: str) -> int:
        """Tokens of a text read from the start state, remembered."""
        found = self.memory.get(text)
        if found is None:
            found = self.memory[text] = self.run(text)[1]
        return found

    def tidy(self) -> None:
        """Forget everything compiled once it is too much; only between texts."""
        if len(self.states) > STATES or len(self.memory) > MEMORY:
            self._reset()

    # -- chunks

    _CUT = re.compile(f"(?<=[^{_SPACE}])(?={_SPACE})|(?<=\n)")

    def map_of(self, chunk: str) -> ChunkMap:
        """The state map of a chunk (spaces already written as pieces have them)."""
        first = self._CUT.search(chunk)
        if first is None:
            return ChunkMap(chunk, None, 0)
        head, rest = chunk[: first.start()], chunk[first.start() :]
        last = max(rest.rfind("\n") + 1, self._last_start(rest))
        total = sum(map(self.stretch, self._stretches(rest[:last])))
        state, tokens = self.run(rest[last:])
        return ChunkMap(head, state, total + tokens)

    @staticmethod
    def _last_start(text: str) -> int:
        end = len(text.rstrip(_SPACE))
        if end < len(text):
            return end
        at = text.rfind(_SPACE)
        return len(text[: at + 1].rstrip(_SPACE)) if at >= 0 else 0

    _STRETCH = re.compile(f"{_SPACE}*[^{_SPACE}\n]*\n|{_SPACE}*[^{_SPACE}\n]+|{_SPACE}+")

    def _stretches(self, text: str) -> list[str]:
        return self._STRETCH.findall(text)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """The map of a's text followed by b's."""
        if a.state is None:
            return ChunkMap(a.head + b.head, b.state, b.tokens)
        # at the seam itself a new stretch may begin
        state, total = a.state, a.tokens
        state, tokens = self.run(b.head, state)
        total += tokens
        return ChunkMap(a.head, state if b.state is None else b.state, total + b.tokens)

    def scan(self, maps: list[ChunkMap]) -> list[ChunkMap]:
        """Maps of all prefixes, in a logarithmic number of rounds of independent compositions."""
        maps, step = list(maps), 1
        while step < len(maps):
            maps = maps[:step] + [self.compose(maps[i - step], maps[i]) for i in range(step, len(maps))]
            step *= 2
        return maps

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = _SPACE + text.replace(" ", _SPACE)
        if len(text) <= CHUNK:
            return sum(map(self.stretch, self._stretches(text)))
        whole = self.scan([self.map_of(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)])[-1]
        return self.run(whole.head)[1] + whole.tokens


@dataclass(frozen=True)
class ChunkMap:
    """head: what is read in the state that comes in; state and tokens: where and with how many it ends, None: no fixed place."""

    head: str
    state: int | None
    tokens: int


def load(path: str) -> Transducer:
    """The transducer of a sentencepiece BPE model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    return Transducer({model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))})


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = base.remembered(f"tokens {path}", lambda: load(path))
        for ids, values in base.pieces(batches):
            machine.tidy()
            n = [machine.count(v.decode("utf-8", "surrogatepass")) for v in values]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(v) for v in values], pa.int64()), pa.array(n, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return count


def report(docs: DataFrame, model_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path(MODEL)
    counted = base.texts(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(_counter(model_path), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
