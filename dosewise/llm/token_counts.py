"""Token counts by a finite-state compilation of a byte-pair tokenizer.

The tokenizer is compiled, transition by transition as texts need them, into a
deterministic transducer over characters. Its states hold what the rest of the
text can depend on: the class of the running piece (letters, digits, other,
white space, a contraction that may still grow) and, for the last bytes of the
piece that may begin a longer token, the last token of the encoding up to each
place. Each transition carries the change of the token count, as if the text
ended after it; the sum along a text is its number of tokens.

That works since the encoding of a prefix is determined by its last token: token
t ends the encoding of x + t if the last token of x and t stay apart when encoded
together, which is so for exactly one t.

Texts are cut in chunks. White space after another character always begins a
new piece, so whatever the state at its start, a chunk is a map: the head before
the first such place has yet to be run from the state before, the rest is a
constant count and exit state. The maps compose associatively, and a parallel
prefix scan composes those of a text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dosewise.llm.arrow import portions

#: Characters of a chunk.
CHUNK = 1 << 14
#: Compiled states kept; beyond, compilation starts anew. Counts don't depend on it.
MAX_STATES = 150_000

#: The white space characters of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Endings that an apostrophe takes into its own piece.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")

_SYNC = re.compile(f"(?<=[^{WHITE}])[{WHITE}]")

#: Bytes that may begin a longer token, and (last token, count) at each place back from the end.
Place = tuple[bytes, tuple]
START: Place = (b"", ((None, 0),))
BEGIN = ("begin",)


class ChunkMap(NamedTuple):
    """head: text to run from the state before; then count tokens and state exit.
    Without a place to synchronise the head is all and exit is None."""

    head: str
    exit: int | None
    count: int


class Transducer:
    """A byte-level byte-pair tokenizer file as a lazily compiled transducer."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        ranges = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in ranges]
        byte_of = {chr(b): b for b in ranges} | {chr(256 + i): b for i, b in enumerate(rest)}
        raw = lambda s: bytes(byte_of[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(merges)}
        special = [t["content"] for t in spec["added_tokens"]]
        self.tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special and all(c in byte_of for c in t)}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t))}
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None
        self._apart: dict[tuple[bytes, bytes], bool] = {}
        self._reset()

    def _reset(self) -> None:
        self.ids: dict[tuple, int] = {BEGIN: 0}
        self.states: list[tuple] = [BEGIN]
        self.table: list[dict[str, tuple[int, int]]] = [{}]

    def encode(self, piece: bytes) -> list[bytes]:
        """Merge by rank, as the tokenizer defines it; only for short byte strings."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: self.rank.get((parts[i], parts[i + 1]), len(self.rank)))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def apart(self, a: bytes, b: bytes) -> bool:
        known = self._apart.get((a, b))
        if known is None:
            if len(self._apart) > 4 * MAX_STATES:
                self._apart.clear()
            known = self._apart[a, b] = self.encode(a + b) == [a, b]
        return known

    def _byte(self, place: Place, byte: bytes) -> tuple[Place, int]:
        tail, back = place
        tail += byte
        for n in range(len(tail), 0, -1):
            token, before = tail[-n:], back[n - 1] if n <= len(back) else None
            if before and token in self.tokens and (before[0] is None or self.apart(before[0], token)):
                break
        delta = before[1] + 1
        moved = ((token, 0), *((x[0], x[1] - delta) if x else None for x in back))
        while tail and tail not in self.prefixes:
            tail = tail[1:]
        kept = tuple(x if not j or tail[len(tail) - j :] in self.prefixes else None for j, x in enumerate(moved[: len(tail) + 1]))
        return (tail, kept), delta

    def _feed(self, place: Place, char: str) -> tuple[Place, int]:
        total = 0
        for b in char.encode("utf-8", "surrogatepass"):
            place, delta = self._byte(place, bytes([b]))
            total += delta
        return place, total

    def _begin(self, char: str) -> tuple[tuple, int]:
        """A new piece with this character."""
        place, delta = self._feed(START, char)
        kind = _kind(char)
        if kind == "white":
            return (kind, char, True, delta, place), delta
        return ("quote" if char == "'" else kind, place), delta

    def step(self, state: tuple, char: str) -> tuple[tuple, int]:
        """Next state and change of the token count."""
        kind = _kind(char)
        if state[0] == "white":
            _, last, alone, d_last, place = state
            if kind == "white":
                place, delta = self._feed(place, char)
                return (kind, char, False, delta, place), delta
            undone = 0 if alone else -d_last  # the last white space leaves its run
            if not alone:
                place, again = self._feed(START, last)
                undone += again
            if last == " ":  # and begins the next piece
                place, delta = self._feed(place, char)
                return (kind, place), undone + delta
            new, delta = self._begin(char)
            return new, undone + delta
        if state[0] == "quote":
            if char in ENDINGS:
                return BEGIN, len(self.encode(f"'{char}".encode())) - 1
            if kind == "other":
                place, delta = self._feed(state[1], char)
                return (kind, place), delta
            new, delta = self._begin(char)
            grows = any(e[0] == char for e in ENDINGS)
            return (("ending", char, new[1]) if grows else new), delta
        if state[0] == "ending":
            if state[1] + char in ENDINGS:
                return BEGIN, len(self.encode(f"'{state[1]}{char}".encode())) - 2
            state = ("letter", state[2])
        if state[0] == kind:
            place, delta = self._feed(state[1], char)
            return (kind, place), delta
        return self._begin(char)

    def _compile(self, s: int, char: str) -> tuple[int, int]:
        new, delta = self.step(self.states[s], char)
        to = self.ids.setdefault(new, len(self.states))
        if to == len(self.states):
            self.states.append(new)
            self.table.append({})
        self.table[s][char] = to, delta
        return to, delta

    def run(self, s: int, text: str) -> tuple[int, int]:
        """Exit state and tokens of text from state s."""
        table, total = self.table, 0
        for char in text:
            try:
                s, delta = table[s][char]
            except KeyError:
                s, delta = self._compile(s, char)
            total += delta
        return s, total

    def chunk_map(self, chunk: str) -> ChunkMap:
        at = _SYNC.search(chunk)
        if not at:
            return ChunkMap(chunk, None, 0)
        return ChunkMap(chunk[: at.start()], *self.run(0, chunk[at.start() :]))

    def compose(self, f: ChunkMap, g: ChunkMap) -> ChunkMap:
        """f, then g."""
        if f.exit is None:
            return ChunkMap(f.head + g.head, g.exit, g.count)
        state, count = self.run(f.exit, g.head)
        if g.exit is None:
            return ChunkMap(f.head, state, f.count + count)
        return ChunkMap(f.head, g.exit, f.count + count + g.count)

    def count(self, text: str) -> int:
        """Tokens of a text; special tokens in it count as one each."""
        if len(self.states) > MAX_STATES:
            self._reset()
        found = self.special.findall(text) if self.special else []
        pieces = self.special.split(text) if found else [text]
        return len(found) + sum(self._plain(p) for p in pieces if p)

    def _plain(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.run(0, text)[1]
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        whole = prefix_scan(maps, self.compose)[-1]
        return self.run(0, whole.head)[1] + whole.count


def _kind(char: str) -> str:
    if char in WHITE:
        return "white"
    major = unicodedata.category(char)[0]
    return {"L": "letter", "N": "digit"}.get(major, "other")


def prefix_scan(items: list, compose: Callable) -> list:
    """All prefixes composed; neighbours in pairs first, so of logarithmic depth."""
    if len(items) < 2:
        return items
    pairs = prefix_scan([compose(a, b) for a, b in zip(items[::2], items[1::2], strict=False)], compose)
    return [
        items[0] if i == 0 else pairs[i // 2] if i % 2 else compose(pairs[i // 2 - 1], items[i]) for i in range(len(items))
    ]


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    """One transducer for a file in each Python worker."""
    if path not in _compiled:
        _compiled[path] = Transducer(path)
    return _compiled[path]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens for every row of docs (doc_id, text, ...).

    n_tokens is what the tokenizer file at path (a byte-level byte-pair model in
    JSON, on every worker) gives without added tokens. Null counts as empty;
    repeated rows give repeated results; other columns are ignored.
    """

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for part in portions(batches):
            texts = part.column("text").to_pylist()
            n = pa.array([machine.count(t) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col("text").cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
        text.alias("text"),
    )
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
