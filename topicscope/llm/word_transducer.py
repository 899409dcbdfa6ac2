"""Token counts by a compiled finite-state tokenizer.

The tokenizer (byte-pair merges with word ends, lower case, white space dropped) is compiled into two
deterministic transducers:

* A cutting transducer over character classes.  Its transitions say where words begin.  Its states are
  few, so a chunk of text is a map from the state at its beginning to the state at its end.  The chunks
  of a batch run side by side (numpy), their maps are composed by a parallel prefix scan, and the state
  that each chunk really begins in follows.  A text of any length is cut in even chunks that way.
* A word transducer over bytes.  A state holds what the future needs: the beginnings of tokens that are
  under way, each with the token before it and the count so far.  Each transition is annotated with the
  number of tokens that it emits.  States are made when a word first needs them and then kept; since a
  word's count depends on the word alone, a hash index keeps the counts of the words met so far.

Both caches start anew beyond a fixed size, which bounds a worker's memory.

Defined results: a null text counts as empty (0 tokens); strings of special tokens inside a text are
one token each, as in the library; repeated rows are counted one by one; other columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicscope.llm.byte_bpe import MergeTrees, PieceTable, char_kinds
from topicscope.llm.spans import code_points, span_hashes, text_groups

#: Characters of a chunk, and transitions that the word transducer keeps.
CHUNK = 512
MOST_TRANSITIONS = 800_000
#: The end of a word, as a symbol after its bytes.
END = "Ā"


def byte_letters() -> dict[str, str]:
    """The character that stands for each byte in the vocabulary -> the byte as a character: printable
    characters stand for themselves, the other bytes in order for the characters from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): chr(b) for b in shown} | {chr(256 + k): chr(b) for k, b in enumerate(hidden)}


class WordMerges(MergeTrees):
    """Merges of listed pairs; every word's last symbol first takes up the word's end."""

    def __init__(self, vocabulary: dict[str, int], merges: list, suffix: str):
        letters = byte_letters()

        def symbols(token: str) -> str:
            end = token.endswith(suffix)
            return "".join(map(letters.__getitem__, token[: len(token) - len(suffix) * end])) + END * end

        self.pairs = {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            self.pairs.setdefault((symbols(a), symbols(b)), rank)
        super().__init__({symbols(t): i for t, i in vocabulary.items()})

    def merge_rank(self, a: str, b: str) -> int | None:
        if b == END:
            return -1 if len(a) == 1 else None
        return self.pairs.get((a, b))


class WordTransducer:
    """Counts a word's tokens by transitions that are annotated with emitted tokens."""

    def __init__(self, merges: WordMerges):
        self.merges = merges
        self.beginnings = {t[:k] for t in merges.ranks for k in range(1, len(t))}
        self._reset()

    def _reset(self) -> None:
        self.names = {(("", None, 0),): 0}
        self.states: list[tuple] = [(("", None, 0),)]
        self.moves: list[dict] = [{}]
        self.size = 0

    def _move(self, state: int, symbol: str) -> tuple[int, int]:
        """A transition that is not known yet: the next state and the tokens it emits."""
        on, done = [], None
        for begun, before, count in self.states[state]:
            now = begun + symbol
            if done is None and self.merges.real(now) and (before is None or self.merges.follows(before, now)):
                done = (now, count + 1)
            if now in self.beginnings:
                on.append((now, before, count))
        if done is None:
            if symbol != END:
                raise ValueError("a byte is not in the vocabulary")
            return -1, 0
        token, emitted = done
        name = (*((now, before, count - emitted) for now, before, count in on), ("", token, 0))
        if symbol == END:
            move = (0, emitted)
        else:
            if name not in self.names:
                self.names[name] = len(self.states)
                self.states.append(name)
                self.moves.append({})
            move = (self.names[name], emitted)
        self.moves[state][symbol] = move
        self.size += 1
        return move

    def count(self, word: bytes) -> int:
        """The number of tokens of a non-empty word."""
        if self.size > MOST_TRANSITIONS:
            self._reset()
        state = total = 0
        moves = self.moves
        for symbol in word.decode("latin-1") + END:
            move = moves[state].get(symbol) or self._move(state, symbol)
            state = move[0]
            total += move[1]
        return total


# ---- the cutting transducer ------------------------------------------------------------------------

# classes of characters; the letters of contractions have classes of their own
_SPACE, _LETTER, _NUMBER, _OTHER, _QUOTE, _SHORT, _R, _V, _L, _E = range(10)
_LETTERS = (_LETTER, _SHORT, _R, _V, _L, _E)
# states: between words, in letters, after a number, in other characters, after a quote that began a
# word, after quote and r / v / l, after a whole contraction
_FREE, _IN_LETTERS, _AFTER_NUMBER, _IN_OTHER, _AFTER_QUOTE, _AFTER_R, _AFTER_V, _AFTER_L, _CLOSED = range(9)
#: what a transition emits: a word begins here, a word began at the character before
_HERE, _BEFORE = 1, 2


def cutting_table() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by state and class."""
    step, emit = np.zeros((9, 10), np.int8), np.zeros((9, 10), np.int8)

    def fresh(kind: int) -> int:  # the state after a character that begins a word
        return _IN_LETTERS if kind in _LETTERS else {_SPACE: _FREE, _NUMBER: _AFTER_NUMBER, _OTHER: _IN_OTHER, _QUOTE: _AFTER_QUOTE}[kind]

    for state in range(9):
        for kind in range(10):
            step[state, kind], emit[state, kind] = fresh(kind), _HERE * (kind != _SPACE)
            if state == _IN_LETTERS and kind in _LETTERS:
                emit[state, kind] = 0
            if state in (_IN_OTHER, _AFTER_QUOTE) and kind in (_OTHER, _QUOTE):
                step[state, kind], emit[state, kind] = _IN_OTHER, 0
            if state == _AFTER_QUOTE and kind in (_SHORT, _R, _V, _L):
                step[state, kind] = {_SHORT: _CLOSED, _R: _AFTER_R, _V: _AFTER_V, _L: _AFTER_L}[kind]
                emit[state, kind] = 0
            if state in (_AFTER_R, _AFTER_V, _AFTER_L):
                if kind == (_L if state == _AFTER_L else _E):
                    step[state, kind], emit[state, kind] = _CLOSED, 0
                else:  # no contraction: the letter began a word of its own
                    emit[state, kind] = _BEFORE | (0 if kind in _LETTERS else emit[state, kind])
    return step, emit


_tables: dict[str, np.ndarray] = {}


def class_table() -> np.ndarray:
    if "class" not in _tables:
        table = char_kinds().copy()  # white space, letters, numbers and others have the numbers 0 to 3
        table[0x27] = _QUOTE
        for letters, kind in (("stmd", _SHORT), ("r", _R), ("v", _V), ("l", _L), ("e", _E)):
            for c in letters:
                table[ord(c)] = kind
        _tables["class"] = table
        step, emit = cutting_table()
        _tables["step"], _tables["emit"] = step.ravel().astype(np.int16) * 10, emit.ravel()
    return _tables["class"]


def compose_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix scan of state maps (rows): row k becomes the map of chunks 0 to k together."""
    maps = maps.copy()
    reach = 1
    while reach < len(maps):
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return maps


def emissions(classes: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """What the cutting transducer emits at each character of a class array."""
    n = len(classes)
    lanes = -(-n // chunk)
    padded = np.zeros(lanes * chunk, np.int16)
    padded[:n] = classes
    columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
    step, emit = _tables["step"], _tables["emit"]
    out = np.zeros((chunk, lanes), np.int8)
    # all states side by side until every chunk's map is constant, from there on one state for each chunk
    maps = np.tile(np.arange(9, dtype=np.int16) * 10, (lanes, 1))
    known = chunk
    for k in range(chunk):
        maps = step[maps + columns[k][:, None]]
        if k % 16 == 15 and (maps == maps[:, :1]).all():
            known = k + 1
            break
    state = maps[:, 0].copy()
    for k in range(known, chunk):
        at = state + columns[k]
        out[k] = emit[at]
        state = step[at]
    if known < chunk:
        maps = np.repeat(state[:, None], 9, axis=1)
    entry = np.zeros(lanes, np.int16)
    entry[1:] = compose_scan(maps // 10)[:-1, _FREE] * 10
    state = entry
    for k in range(known):
        at = state + columns[k]
        out[k] = emit[at]
        state = step[at]
    return out.T.ravel()[:n]


def cut_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """Code points, begins and ends of the words, the number of the first word of each text (one more),
    and the joined texts; the texts are normalised and get a blank each behind them."""
    joined = [t + " " for t in texts]
    cps, starts = code_points(joined)
    classes = class_table()[cps]
    emitted = emissions(classes)
    begin = (emitted & _HERE).astype(bool)
    begin[:-1] |= (emitted[1:] & _BEFORE).astype(bool)
    gap = classes == _SPACE
    gap[1:] &= classes[:-1] != _SPACE
    events = np.flatnonzero(begin | gap)
    at = np.flatnonzero(begin[events])
    begins = events[at]
    ends = events[np.minimum(at + 1, len(events) - 1)]
    return cps, begins, ends, np.searchsorted(begins, starts), "".join(joined)


class WordTokenizer:
    """A tokenizer file of byte-pair merges with word ends; made once per Python worker."""

    _made: dict[str, "WordTokenizer"] = {}

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.path = path
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))))
        self.model = made["model"]
        self._counts: PieceTable | None = None

    def normalise(self, text: str) -> str:
        """Canonical composition and lower case, each character on its own."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def segments(self, texts: list[str]) -> tuple[list[str], list[int], list[list[int]]]:
        """Normalised texts without special strings, the number of segments of each text, and the ids of
        the special tokens between a text's segments."""
        parts, sizes, between = [], [], []
        for text in texts:
            ids = []
            if "<|" in text and self.special_pattern.search(text):
                ids = [self.special[m.group()] for m in self.special_pattern.finditer(text)]
                parts += map(self.normalise, self.special_pattern.split(text))
            else:
                parts.append(self.normalise(text))
            sizes.append(len(ids) + 1)
            between.append(ids)
        return parts, sizes, between

    def counts(self, texts: list[str]) -> np.ndarray:
        """The number of tokens of each text."""
        if self._counts is None:
            transducer = WordTransducer(WordMerges(self.model["vocab"], self.model["merges"], self.model["end_of_word_suffix"]))
            self._counts = PieceTable(lambda words: [[transducer.count(w.encode())] for w in words])
        parts, sizes, between = self.segments(texts)
        _, words, first, table = self.word_numbers(parts, self._counts)
        total = np.concatenate([[0], np.cumsum(table.ids[table.begins[words]], dtype=np.int64)])
        edges = np.concatenate([[0], np.cumsum(sizes)])
        return total[first[edges[1:]]] - total[first[edges[:-1]]] + np.array([len(x) for x in between], np.int64)

    @staticmethod
    def word_numbers(parts: list[str], table: PieceTable):
        """The table's number of each word of the normalised texts, and the first word of each text."""
        cps, begins, ends, first, whole = cut_words(parts)
        cut = lambda at: [whole[b:e] for b, e in zip(begins[at].tolist(), ends[at].tolist())]
        return begins, table.numbers(span_hashes(cps, begins, ends), cut), first, table


def _counter(path: str, most: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(batches):
        tokenizer = WordTokenizer.of(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [tokenizer.counts(texts[lo:hi]) for lo, hi in text_groups(texts)]
            counts = np.concatenate(counts) if counts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64()), pa.array(counts > most)], schema=schema)

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(_counter(path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
